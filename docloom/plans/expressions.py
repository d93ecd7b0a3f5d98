"""Expression operators and accumulators of pipeline stages that are Spark functions of another name."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import aggregates as A
from docloom.functions import arrays as X
from docloom.functions import conversions, dates, strings
from docloom.plans.registry import query

C = F.col


def rounded(**columns):
    return [F.round(c, 8).alias(n) for n, c in columns.items()]


@query("""select l_orderkey, l_linenumber, round(acos(l_discount), 8) as acos_, round(asin(l_discount), 8) as asin_, round(atan(l_quantity), 8) as atan_, round(atan2(l_quantity, l_tax + 1), 8) as atan2_,
    round(sinh(l_discount), 8) as sinh_, round(cosh(l_discount), 8) as cosh_, round(tanh(l_discount), 8) as tanh_, round(exp(l_discount), 8) as exp_, round(asinh(l_quantity), 8) as asinh_, round(atanh(l_discount), 8) as atanh_ from lineitem""")
def expr_math(t):
    d, q = C("l_discount"), C("l_quantity")
    return t("lineitem").select("l_orderkey", "l_linenumber", *rounded(acos_=F.acos(d), asin_=F.asin(d), atan_=F.atan(q), atan2_=F.atan2(q, C("l_tax") + 1), sinh_=F.sinh(d), cosh_=F.cosh(d), tanh_=F.tanh(d), exp_=F.exp(d), asinh_=F.asinh(q), atanh_=F.atanh(d)))


@query("select o_orderkey, o_custkey & 12 as a, o_custkey | 5 as o, xor(o_custkey, 9) as x, ~o_custkey as n from orders")
def expr_bits(t):
    k = C("o_custkey")
    return t("orders").select("o_orderkey", k.bitwiseAND(F.lit(12)).alias("a"), k.bitwiseOR(F.lit(5)).alias("o"), k.bitwiseXOR(F.lit(9)).alias("x"), F.bitwise_not(k).alias("n"))


@query("""select p_partkey, regexp_matches(p_name, 'i.g') as hit, coalesce(regexp_extract(p_name, '[aeiou][a-z]'), '') as first_, regexp_extract_all(p_name, '[aeiou][a-z]') as all_,
    case when lower(p_name) < 'old' then -1 when lower(p_name) > 'old' then 1 else 0 end as cmp, instr(p_name, 'b') - 1 as at, string_split(p_name, ' ') as parts, strlen(p_name) as bytes from part""")
def expr_strings(t):
    return t("part").select(
        "p_partkey", F.rlike("p_name", F.lit("i.g")).alias("hit"), F.regexp_extract("p_name", "[aeiou][a-z]", 0).alias("first_"), F.regexp_extract_all("p_name", F.lit("[aeiou][a-z]"), F.lit(0)).alias("all_"),
        strings.compare_case_insensitive("p_name", F.lit("old")).alias("cmp"), strings.position("b", "p_name").alias("at"), F.split("p_name", " ").alias("parts"), strings.octet_length("p_name").alias("bytes"),
    )


@query("""select o_custkey, list_reverse(k) as back, len(k) as n, list_sort(list_distinct(list_concat(k, [1, 2, 3]))) as un, list_sort(list_distinct(list_filter(k, lambda x: x % 2 = 0))) as even, list_position(k, k[1]) - 1 as place, range(0, 3) as r
    from (select o_custkey, list(o_orderkey order by o_orderkey) as k from orders group by 1)""")
def expr_arrays(t):
    k = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    small = F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))
    return k.select(
        "o_custkey", F.reverse("k").alias("back"), X.size("k").alias("n"), F.array_sort(F.array_union("k", small)).alias("un"), F.array_sort(F.array_distinct(X.filter_("k", lambda x: x % 2 == 0))).alias("even"),
        X.index_of("k", X.element("k", 0)).alias("place"), F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")).alias("r"),
    )


@query("""select user_id, quantile_cont(value, 0.5) as med, quantile_cont(value, 0.9) as p90, max(value, 2) as top2, min(value, 2) as low2, arg_max(event_type, event_id) as latest, round(covar_pop(value, event_id), 3) as cov from events group by 1""")
def expr_accumulators(t):
    made = t("events").groupBy("user_id").agg(
        F.percentile("value", F.lit(0.5)).alias("med"), F.percentile("value", F.lit(0.9)).alias("p90"),
        A.last_by("event_type", "event_id").alias("latest"), F.round(F.covar_pop("value", "event_id"), 3).alias("cov"),
    )
    top = A.top_n(t("events"), ["user_id"], "value", 2, name="top2")
    low = A.top_n(t("events"), ["user_id"], "value", 2, name="low2", descending=False)
    return made.join(top, "user_id").join(low, "user_id").select("user_id", "med", "p90", "top2", "low2", "latest", "cov")


@query("""select o_custkey, list_transform(s, lambda x: try_cast(x as integer)) as whole, list_filter(s, lambda x: x <> '1') as without, list_transform(d, lambda x: x.k) as keys, list_filter(n, lambda x: x is not null) as solid,
    coalesce(list_product(list_filter(n, lambda x: x is not null)), 1) as times from (select o_custkey, list(o_orderkey::varchar order by o_orderkey) as s, list({'k': o_orderkey} order by o_orderkey) as d, list(nullif(o_orderkey % 3, 0)::double order by o_orderkey) as n from orders group by 1)""")
def expr_arrays_more(t):
    lists = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    lists = lists.select("o_custkey", X.map_("k", lambda x: x.cast("string")).alias("s"), X.map_("k", lambda x: F.struct(x.alias("k"))).alias("d"), X.map_("k", lambda x: F.nullif(x % 3, F.lit(0)).cast("double")).alias("n"))
    return lists.select("o_custkey", X.cast("s", "int").alias("whole"), X.remove("s", "1").alias("without"), X.extract("d", "k").alias("keys"), X.compact("n").alias("solid"), X.product("n").alias("times"))


@query("select event_id, year(ts) as sql_tsi_year, quarter(ts) as sql_tsi_quarter, month(ts) as sql_tsi_month, day(ts) as sql_tsi_day, dayofyear(ts) as dayofyear, dayofweek(ts) + 1 as dayofweek, 1 as moments, true as later from events")
def expr_date_names_now(t):
    parts = ("sql_tsi_year", "sql_tsi_quarter", "sql_tsi_month", "sql_tsi_day", "dayofyear", "dayofweek")
    df = t("events").withColumn("now", dates.now())
    moments = df.agg(F.count_distinct("now").cast("int").alias("moments"))
    return df.join(F.broadcast(moments), F.lit(True)).select("event_id", *(dates.extract(p, "ts").alias(p) for p in parts), "moments", (C("now") > C("ts")).alias("later"))


@query("select l_suppkey, avg(distinct l_quantity) as mean, sum(distinct l_quantity) as total from lineitem group by 1")
def expr_distinct_aggregates(t):
    return t("lineitem").groupBy("l_suppkey").agg(A.avg_distinct("l_quantity").alias("mean"), F.sum_distinct("l_quantity").alias("total"))


@query("""select event_id, try_cast(strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp) as back, date_trunc('day', ts)::timestamp as d, ts - interval 3 hour as earlier, case when value > 10 then 'high' else coalesce(null, event_type) end as sw, value is null as missing,
    try_cast(event_type as integer) as no_int, cast(round_even(value, 0) as bigint)::varchar as s from events""")
def expr_dates_conditions(t):
    text = dates.to_text("ts", "yyyy-MM-dd HH:mm:ss")
    return t("events").select(
        "event_id", dates.from_text(text).alias("back"), dates.date_trunc("day", "ts").cast("timestamp").alias("d"), dates.date_add("hour", -3, "ts").alias("earlier"), F.when(C("value") > 10, "high").otherwise(F.coalesce(F.lit(None), "event_type")).alias("sw"),
        C("value").isNull().alias("missing"), conversions.convert("event_type", "string", "int").alias("no_int"), conversions.convert(F.bround("value", 0).cast("long"), "long", "string").alias("s"),
    )
