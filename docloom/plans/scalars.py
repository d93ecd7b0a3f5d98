"""Scalar functions: each query shows one group of them over a table's columns and over edge cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import arrays as X
from docloom.functions import dates as D
from docloom.functions import numeric as N
from docloom.functions import strings as S
from docloom.operators import relations as R
from docloom.plans.registry import query

C = F.col
NUMBERS = "(values (0.0::double), (1.0), (-1.0), (2.5), (-2.5), (3.5), (100.0), (1e9), ('inf'::double), ('-inf'::double), (null)) v(x)"


def numbers(t):
    rows = [{"x": v} for v in (0.0, 1.0, -1.0, 2.5, -2.5, 3.5, 100.0, 1e9, float("inf"), float("-inf"))]
    return R.array_rows(t("region").sparkSession, [*rows, {}], "x double")


@query(f"select x, case when not isinf(x) then round(sin(x), 9) end as s, case when not isinf(x) then round(cos(x), 9) end as c, case when not isinf(x) then round(tan(x), 6) end as t from {NUMBERS}")
def fn_math_trig(t):
    return numbers(t).select("x", F.round(N.sin("x"), 9).alias("s"), F.round(N.cos("x"), 9).alias("c"), F.round(N.tan("x"), 6).alias("t"))


@query(f"select x, case when x > 0 then ln(x) end as l, case when x > 0 then ln(x) / ln(2) end as l2, case when x > 0 then log10(x) end as l10, case when x >= 0 then sqrt(x) end as r, null::double as none from {NUMBERS}")
def fn_math_log_sqrt(t):
    return numbers(t).select("x", N.log("x").alias("l"), N.log("x", 2).alias("l2"), N.log10("x").alias("l10"), N.sqrt("x").alias("r"), N.log("x", 1).alias("none"))


@query(f"select x, abs(x) as a, ceil(x) as u, floor(x) as d, round_even(x, 0) as r, degrees(x) as deg, radians(x) as rad from {NUMBERS}")
def fn_math_round(t):
    return numbers(t).select(
        "x", N.absolute("x").alias("a"), N.ceiling("x").alias("u"), N.floor("x").alias("d"), N.round_even("x").alias("r"), N.degrees("x").alias("deg"), N.radians("x").alias("rad"),
    )


@query("select l_orderkey, l_linenumber, round(pow(l_quantity, 2), 4) as p, l_quantity::int % 7 as m, -(l_quantity::int) % 7 as neg, trunc(l_extendedprice) as whole from lineitem")
def fn_math_pow_mod(t):
    q = C("l_quantity").cast("int")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(N.power("l_quantity", 2), 4).alias("p"), N.mod(q, F.lit(7)).alias("m"), N.mod(-q, F.lit(7)).alias("neg"), N.truncate("l_extendedprice").alias("whole"))


@query("select doc_id, length(text) as n, strlen(text) as o, bit_length(text) as b from documents")
def fn_string_lengths(t):
    return t("documents").select("doc_id", S.char_length("text").alias("n"), S.octet_length("text").alias("o"), S.bit_length("text").alias("b"))


@query("select doc_id, instr(text, 'th') - 1 as p, substring(text, 4, 10) as s, substring(text, 6) as tail, upper(replace(substring(text, 1, 5), 'ß', 'SS')) as u, lower(substring(text, 1, 5)) as l from documents")
def fn_string_position_substring(t):
    return t("documents").select(
        "doc_id", S.position("th", "text").alias("p"), S.substring("text", 3, 10).alias("s"), S.substring("text", 5).alias("tail"), S.upper(S.substring("text", 0, 5)).alias("u"), S.lower(S.substring("text", 0, 5)).alias("l"),
    )


@query("select s, trim(s) as b, ltrim(s, ' x') as l, rtrim(s, 'y ') as r, replace(s, 'a', 'bb') as rep from (values ('  xa y '), ('xxayy'), (''), (null)) v(s)")
def fn_string_trim_replace(t):
    df = R.array_rows(t("region").sparkSession, [{"s": "  xa y "}, {"s": "xxayy"}, {"s": ""}, {}], "s string")
    return df.select("s", S.trim("s").alias("b"), S.trim("s", " x", "leading").alias("l"), S.trim("s", "y ", "trailing").alias("r"), S.replace("s", "a", "bb").alias("rep"))


@query("select p_partkey, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', -1) as z, split_part(p_name, ' ', 9) as none, null as bad, p_name || '-' || p_brand as c from part")
def fn_string_split_concat(t):
    return t("part").select("p_partkey", S.split_part("p_name", " ", 1).alias("a"), S.split_part("p_name", " ", -1).alias("z"), S.split_part("p_name", " ", 9).alias("none"), S.split_part("p_name", "", 1).alias("bad"), S.concat("p_name", F.lit("-"), "p_brand").alias("c"))


@query("""select event_id, year(ts) as y, quarter(ts) as q, month(ts) as mo, day(ts) as d, hour(ts) as h, minute(ts) as mi, second(ts) as s, (extract(millisecond from ts)::int % 1000) as ms,
    dayofyear(ts) as doy, dayofweek(ts) + 1 as dow, weekofyear(ts) as iso_week, isodow(ts) as iso_day, isoyear(ts) as iso_year, floor((dayofyear(ts) + 6 - dayofweek(ts)) / 7)::int as week from events""")
def fn_date_extract(t):
    parts = {"y": "year", "q": "quarter", "mo": "month", "d": "day", "h": "hour", "mi": "minute", "s": "second", "ms": "millisecond", "doy": "day_of_year", "dow": "day_of_week", "iso_week": "iso_week", "iso_day": "iso_weekday", "iso_year": "iso_year", "week": "week"}
    return t("events").select("event_id", *(D.extract(p, "ts").alias(n) for n, p in parts.items()))


_DIFFS = ("year", "quarter", "month", "day", "hour", "minute", "second")


@query("select l_orderkey, l_linenumber, " + ", ".join(f"date_diff('{p}', o_orderdate, l_shipdate) as d_{p}" for p in _DIFFS) + """, (floor((epoch(l_shipdate) / 86400 + 4) / 7) - floor((epoch(o_orderdate) / 86400 + 4) / 7))::bigint as d_week,
    (floor((epoch(l_shipdate) / 86400 + 3) / 7) - floor((epoch(o_orderdate) / 86400 + 3) / 7))::bigint as d_week_monday from lineitem, orders where l_orderkey = o_orderkey""")
def fn_date_diff(t):
    met = t("lineitem").join(t("orders"), C("l_orderkey") == C("o_orderkey"))
    two = ("o_orderdate", "l_shipdate")
    return met.select("l_orderkey", "l_linenumber", *(D.date_diff(p, *two).alias(f"d_{p}") for p in _DIFFS), D.date_diff("week", *two).alias("d_week"), D.date_diff("week", *two, "monday").alias("d_week_monday"))


@query("""select event_id, ts + interval 1 month as mo, ts - interval 2 year as y, ts + interval 3 month as q, ts + interval 14 day as w, ts + interval 90 minute as mi, ts + interval 250 millisecond as ms from events""")
def fn_date_add(t):
    add = {"mo": ("month", 1), "y": ("year", -2), "q": ("quarter", 1), "w": ("week", 2), "mi": ("minute", 90), "ms": ("millisecond", 250)}
    return t("events").select("event_id", *(D.date_add(p, n, "ts").alias(k) for k, (p, n) in add.items()))


@query("""select event_id, date_trunc('year', ts)::timestamp as y, date_trunc('month', ts)::timestamp as mo, date_trunc('hour', ts)::timestamp as h, date_trunc('week', ts)::timestamp as monday,
    (date_trunc('week', ts + interval 1 day) - interval 1 day)::timestamp as sunday from events""")
def fn_date_trunc(t):
    cut = {"y": D.date_trunc("year", "ts"), "mo": D.date_trunc("month", "ts"), "h": D.date_trunc("hour", "ts"), "monday": D.date_trunc("week", "ts", "monday"), "sunday": D.date_trunc("week", "ts")}
    return t("events").select("event_id", *(c.cast("timestamp").alias(n) for n, c in cut.items()))


@query("select event_id, make_timestamp(year(ts), month(ts), day(ts), 1, 30, 0) as made, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as iso from events")
def fn_date_parts_text(t):
    made = D.from_parts(D.extract("year", "ts"), D.extract("month", "ts"), D.extract("day", "ts"), 1, 30)
    return t("events").select("event_id", made.alias("made"), D.to_text("ts").alias("iso"))


def _vectors(t):
    return t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


_VECTORS = "(select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings)"


@query(f"select vec_id, len(v) as n, v[1] as a, v[-1] as z, null as beyond, v[1:3] as head, v[len(v) - 1:len(v)] as tail, v[3:5] as mid, v[len(v) - 2:len(v) - 1] as back from {_VECTORS}")
def slice_size(t):
    return _vectors(t).select(
        "vec_id", X.size("v").alias("n"), X.element("v", 0).alias("a"), X.element("v", -1).alias("z"), X.element("v", 100_000).alias("beyond"), X.slice_first("v", 3).alias("head"), X.slice_first("v", -2).alias("tail"), X.slice_from("v", 2, 3).alias("mid"), X.slice_from("v", -3, 2).alias("back"),
    )


@query(f"""select vec_id, list_transform(v, lambda x: x * 2) as doubled, list_filter(v, lambda x: x > 0) as positive, round(list_sum(v) + 1e-9, 3) as total, len(list_filter(v, lambda x: x > 0)) as n,
    round(list_avg(v) + 1e-9, 4) as mean, len(list_filter(v, lambda x: x > -9)) = len(v) as every, len(list_filter(v, lambda x: x > 1)) > 0 as some from {_VECTORS}""")
def hof_map_filter_reduce(t):
    return _vectors(t).select(
        "vec_id", X.map_("v", lambda x: x * 2).alias("doubled"), X.filter_("v", lambda x: x > 0).alias("positive"), F.round(X.reduce_("v", F.lit(0.0), lambda a, x: a + x) + 1e-9, 3).alias("total"),
        X.count_if("v", lambda x: x > 0).alias("n"), F.round(X.average("v") + 1e-9, 4).alias("mean"), X.all_("v", lambda x: x > -9).alias("every"), X.any_("v", lambda x: x > 1).alias("some"),
    )


@query(f"select vec_id, list_reverse_sort(v)[1:2] as most, list_sort(v)[1:2] as least, list_position(v, v[2]) - 1 as place, array_to_string(list_transform(v, lambda x: x > 0), ',') as signs from {_VECTORS}")
def array_order(t):
    return _vectors(t).select("vec_id", X.max_n("v", 2).alias("most"), X.min_n("v", 2).alias("least"), X.index_of("v", X.element("v", 1)).alias("place"), X.join(X.map_("v", lambda x: (x > 0).cast("string")), ",").alias("signs"))


@query("""select o_custkey, list_sort(list_distinct(a)) as s, len(list_filter(list_distinct(a), lambda x: x <> 'F')) = 0 as only_f from (select o_custkey, list(o_orderstatus) as a from orders group by 1)""")
def array_sets(t):
    a = t("orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("a"))
    return a.select("o_custkey", F.array_sort(F.array_distinct("a")).alias("s"), X.is_subset("a", F.array(F.lit("F"))).alias("only_f"))
