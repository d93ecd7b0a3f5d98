"""Semantics that the tables do not show, and properties that hold for any input."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import aggregates, arrays, conversions, dates, documents, numeric, strings
from docloom.operators import nested, relations, stages
from docloom.sources import readers, schemas


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_whole_numbers_keep_what_is_not_finite(spark):
    x = [F.lit(v) for v in (float("inf"), float("-inf"), 1e300, -2.5, 2.5)]
    assert one(spark, *(numeric.ceiling(v) for v in x)) == (float("inf"), float("-inf"), 1e300, -2.0, 3.0)
    assert one(spark, *(numeric.floor(v) for v in x)) == (float("inf"), float("-inf"), 1e300, -3.0, 2.0)
    assert one(spark, *(numeric.truncate(v) for v in x)) == (float("inf"), float("-inf"), 1e300, -2.0, 2.0)
    nan = one(spark, *(f(F.lit(float("nan"))) for f in (numeric.ceiling, numeric.floor, numeric.truncate)))
    assert all(v != v for v in nan)


def test_densify_follows_the_grid(spark):
    df = spark.createDataFrame([(0,), (3,), (10,)], "x long")
    assert sorted(r.x for r in stages.densify(df, "x", 4).collect()) == [0, 3, 4, 8, 10]
    keyed = spark.createDataFrame([("a", 1), ("b", 9), (None, 5)], "k string, x long")
    found = sorted(((r.k or "", r.x) for r in stages.densify(keyed, "x", 4, ["k"], "full").collect()))
    assert found == [(k, x) for k in ("", "a", "b") for x in (1, 5, 9)]


def test_bucket_auto_counts_nulls_first(spark):
    df = spark.createDataFrame([(None,), (1,), (2,), (3,)], "x int")
    rows = {r.bucket: (r.low, r.high, r.n) for r in stages.bucket_auto(df, "x", 2, n=F.count("*")).collect()}
    assert rows == {0: (None, 1, 2), 1: (2, 3, 2)}
    only = spark.createDataFrame([(None,), (None,)], "x int")
    assert [r.n for r in stages.bucket_auto(only, "x", 2, n=F.count("*")).collect()] == [2]


def test_bucket_auto_cuts_at_exact_ranks(spark):
    for base in (0, 1 << 60):  # doubles cannot tell the latter apart
        df = spark.range(60_000).repartition(6).select((base + F.col("id") * 7919 % 60_013).alias("x"))
        values = sorted(r.x for r in df.collect())
        rows = sorted((r.bucket, r.low, r.high, r.n) for r in stages.bucket_auto(df, "x", 4, n=F.count("*")).collect())
        assert rows == [(i, values[15_000 * i], values[15_000 * i + 14_999], 15_000) for i in range(4)]
    tied = spark.createDataFrame([(x,) for x in (1.0, 1.0, 1.0, 2.0, float("nan"))], "x double")
    assert sorted((r.bucket, r.n) for r in stages.bucket_auto(tied, "x", 4, n=F.count("*")).collect()) == [(0, 3), (2, 1), (3, 1)]


def test_lookups_above_a_value_make_no_pairs(spark):
    key = lambda k: F.when(F.col("id") % k > 0, F.col("id") % 3)
    value = lambda p, k: F.when(F.col("id") % k > 0, F.when(F.col("id") % 97 == 1, float("nan")).otherwise(F.col("id") * p % 500 / 2.0))
    df = spark.range(700).select("id", key(50).alias("k"), value(7, 60).alias("x"))
    other = spark.range(900).select(F.col("id").alias("doc"), key(40).alias("k2"), value(11, 70).alias("y"))
    gathered = stages.lookup_where(df, other, "id", (F.col("k2") == F.col("k")) & (F.col("y") > F.col("x")), "found")
    plain = {(r.id, r.n or None, r.least) for r in gathered.select("id", F.size("found").alias("n"), F.array_min("found.doc").alias("least")).collect()}
    measures = {"n": (F.count("*"), F.sum), "least": (F.min("doc"), F.min)}
    made = stages.lookup_above(df, other, ("k", "x"), ("k2", "y"), **measures)
    assert {(r.id, r.n, r.least) for r in made.collect()} == plain and len(plain) == 700
    # 1,600 million pairs of one key, never met
    many = spark.range(40_000).select("id", F.lit(1).alias("k"), (F.col("id") % 5_000).alias("x"))
    top = stages.lookup_above(many, many.toDF("doc", "k2", "y"), ("k", "x"), ("k2", "y"), **measures).agg(F.sum("n"), F.count("*")).first()
    assert tuple(top) == (sum(8 * (4_999 - x) for x in range(5_000)) * 8, 40_000)


def test_samples_change_with_the_seed(spark):
    df = spark.range(1000)
    a, b = ({r.id for r in stages.sample(df, 50, seed).collect()} for seed in (1, 2))
    assert len(a) == len(b) == 50 and a != b


def test_graph_lookup_plans_stay_flat(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "s int, t int")
    made = stages.graph_lookup(edges.where("s = 0"), edges, "s", "s", "t", 8)
    assert {(r.node, r.depth) for r in made.collect()} == {(i + 1, i) for i in range(9)}
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_top_values_without_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", None), ("a", 2), ("b", None)], "k string, x int")
    assert {r.k: r.top for r in aggregates.top_n(df, ["k"], "x", 2).collect()} == {"a": [3, 2], "b": []}
    assert {r.k: r.top for r in aggregates.top_n(df, ["k"], "x", 2, descending=False).collect()} == {"a": [1, 2], "b": []}


def test_maps_keyed_by_ids_are_open(spark):
    rows = [(f'{{"a": 1, "m": {{"id{i}": {{"x": {i}}}}}}}',) for i in range(200)]
    found = schemas.infer(spark.createDataFrame(rows, "j string"), "j")
    assert found["required"] == ["a", "m"] and found["properties"]["m"] == {"bsonType": "object", "properties": {}, "required": [], "additionalProperties": True}


def test_schemas_are_stored_and_loaded(spark, tmp_path, data):
    schema = readers.Catalog(spark, data).schema("orders")
    readers.save_schema(spark, schema, f"{tmp_path}/orders.schema")
    assert readers.load_schema(spark, f"{tmp_path}/orders.schema") == schema
    typed = readers.read(spark, f"{data}/orders.parquet", schema=schemas.to_spark(schema))
    assert typed.columns == list(schema["properties"])


def test_sample_rate(spark):
    n = stages.sample_rate(spark.range(10_000), 0.2).count()
    assert 1_700 < n < 2_300 and stages.sample_rate(spark.range(50), 0.0).count() == 0


def test_names_of_a_folder(spark, data):
    assert {"nation", "region"} <= set(readers.names(spark, data))


def test_math_edges(spark):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    row = one(spark, numeric.divide(F.lit(6), F.lit(2)), numeric.divide(F.lit(1), F.lit(0)), numeric.sqrt(F.lit(-1.0)), numeric.sin(inf), numeric.log(nan), numeric.log(F.lit(0.0)), numeric.mod(F.lit(-7), F.lit(3)), numeric.round_even(F.lit(2.5)), numeric.round_even(F.lit(2.5), 101))
    assert row[:4] == (3.0, None, None, None) and row[4] != row[4] and row[5:] == (None, -1, 2.0, None)


def test_strings(spark):
    row = one(spark, strings.position("z", F.lit("abc")), strings.substring(F.lit("héllo"), 1, 3), strings.substring(F.lit("abc"), 1), strings.split_part(F.lit("a,b,c"), ",", -3), strings.split_part(F.lit("a"), ",", 0), strings.like(F.lit("A\nB"), "a%b"), strings.replace_first(F.lit("xaya"), "a", "bb"))
    assert row == (-1, "éll", "bc", "a", "", True, "xbbya")


def test_dates_count_boundaries(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    row = one(
        spark,
        dates.date_diff("year", at("2023-12-31 23:59:59"), at("2024-01-01 00:00:00")),
        dates.date_diff("week", at("2024-01-06"), at("2024-01-07")),
        dates.date_diff("week", at("2024-01-06"), at("2024-01-07"), "monday"),
        dates.date_diff("hour", at("2024-01-01 00:59:00"), at("2024-01-01 01:01:00")),
        dates.extract("week", at("2024-01-07")),
        F.date_format(dates.date_trunc("week", at("2024-01-10"), "wednesday"), "yyyy-MM-dd"),
        F.date_format(dates.date_add("month", 1, at("2024-01-31")), "yyyy-MM-dd"),
    )
    assert row == (1, 1, 0, 1, 1, "2024-01-10", "2024-02-29")


def test_conversions(spark):
    v = conversions.convert
    row = one(spark, v(F.lit("false"), "string", "bool"), v(F.lit("x"), "string", "int", on_error=F.lit(-1)), v(F.lit(None).cast("string"), "string", "int", on_null=F.lit(-2)), v(F.lit(3.9), "double", "int"), v(F.lit(1e300), "double", "long"), v(F.lit(0), "int", "bool"))
    assert row == (True, -1, -2, 3, None, False)


def test_arrays(spark):
    a = F.array(*map(F.lit, (1, 2, 3)))
    row = one(spark, arrays.slice_first(a, 9), arrays.slice_first(a, -2), arrays.slice_from(a, -9, 2), arrays.slice_from(a, 1, 0), arrays.element(a, -3), arrays.element(a, 3), arrays.index_of(a, 7), arrays.set_equals(a, F.reverse(a)))
    assert row == ([1, 2, 3], [2, 3], [1, 2], None, 1, None, -1, True)


def test_arrays_keep_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "i int, s string")
    row = df.agg(aggregates.add_to_array("s", "i").alias("all"), aggregates.add_to_set("s").alias("set")).first()
    assert row["all"] == [None, "a", None] and row["set"] == [None, "a"]


def test_unwind_of_scalars_and_clashes(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "i int, v string")
    assert [tuple(r) for r in nested.unwind(df, "v", index="k").collect()] == [(1, "x", None)]
    assert nested.unwind(df, "v", outer=True).count() == 2
    with pytest.raises(ValueError, match="column already"):
        nested.unwind(df, "v", index="i")
    with pytest.raises(ValueError, match="clash"):
        nested.flatten(df.select(F.lit(1).alias("a_b"), F.struct(F.lit(2).alias("b")).alias("a")))
    with pytest.raises(ValueError, match="several"):
        relations.spread(df.select(F.struct("i").alias("x"), F.struct("i").alias("y")))


def test_not_in_an_empty_list_keeps_nulls(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    none = spark.createDataFrame([], "y int")
    assert relations.anti_in(df, "x", none, "y").count() == 2
    assert relations.anti_in(df, "x", spark.createDataFrame([(None,)], "y int"), "y").count() == 0


def test_densify_bounds_and_bucket_error(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0)], "k string, x long, v double")
    assert sorted(r.x for r in stages.densify(df, "x", 1, ["k"], (0, 7)).collect()) == [0, 1, 2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="outside the boundaries"):
        stages.bucket(df, F.col("x"), [0, 3], n=F.count("*")).collect()


def test_variant_keys_order_and_group(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ('"a"',), ("null",), ("true",)], "j string").withColumn("v", F.parse_json("j"))
    assert df.groupBy(documents.sort_key(F.col("v")).alias("k")).count().count() == 4


SCHEMAS = st.recursive(
    st.sampled_from(["string", "int", "long", "double", "bool", "null"]).map(lambda k: {"bsonType": k}),
    lambda s: s.map(lambda x: {"bsonType": "array", "items": x})
    | st.dictionaries(st.sampled_from("abc"), s, min_size=1).map(lambda p: {"bsonType": "object", "properties": p, "required": sorted(p)[:1], "additionalProperties": False}),
    max_leaves=6,
)


@settings(max_examples=60, deadline=None)
@given(SCHEMAS, SCHEMAS)
def test_schema_union_is_a_least_upper_bound(a, b):
    both = schemas.union(a, b)
    assert schemas.union(a, a) == a and schemas.union(both, a) == both
    kinds = {o["bsonType"] for x in (a, b) for o in schemas.options(x)}
    assert {o["bsonType"] for o in schemas.options(both)} == kinds
    assert schemas.satisfies(both, kinds) == "must"


def test_schema_inference(spark):
    rows = [('{"a": 1, "b": {"c": "x"}}',), ('{"a": 2.5, "b": {"c": null, "d": [1, "y"]}}',), ("not json",), (None,)]
    found = schemas.infer(spark.createDataFrame(rows, "j string"), "j")
    assert found["required"] == ["a", "b"]
    assert schemas.contains_field(found["properties"]["b"], "d") == "may" and schemas.contains_field(found, "z") == "not"
    assert schemas.to_spark(found)["a"].dataType == T.DoubleType()
    assert schemas.comparable(found["properties"]["a"], {"bsonType": "long"}) == "must" and schemas.comparable({"bsonType": "string"}, {"bsonType": "int"}) == "not"
    assert dict(schemas.paths(found))["b.d"]["bsonType"] == "array"


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_readers_and_writers(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, s string")
    readers.write(df, f"{tmp_path}/t.{kind}", kind)
    back = readers.read(spark, f"{tmp_path}/t.{kind}", kind, "x int, s string")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, None)]


def test_catalog(spark, data):
    catalog = readers.Catalog(spark, data)
    assert schemas.contains_field(catalog.schema("nation"), "n_name") == "must"
    assert catalog.describe("region").count() == 2


def test_filters_and_columns_reach_the_scan(spark, data):
    from docloom.plans import QUERIES

    plan = QUERIES["tpch_q6"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_orderkey" not in plan
