"""Scans, projections, predicates, joins, grouping, ordering, set operations and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import aggregates as A
from docloom.functions import conversions, strings
from docloom.functions import numeric as N
from docloom.operators import predicates as P
from docloom.operators import relations as R
from docloom.plans.registry import query

C = F.col


@query("select count(*) as n from lineitem")
def scan_count(t):
    return t("lineitem").agg(F.count("*").alias("n"))


@query("select * from (values (1, 'a', 1.5), (2, null, 2.5), (3, 'c', null)) v(x, s, d)")
def scan_array_rows(t):
    return R.array_rows(t("region").sparkSession, [{"x": 1, "s": "a", "d": 1.5}, {"x": 2, "d": 2.5}, {"x": 3, "s": "c"}], "x int, s string, d double")


@query("select 1 as one, 'x' as s, 1.5::double as d")
def scan_dual(t):
    return R.dual(t("region").sparkSession).select(F.lit(1).alias("one"), F.lit("x").alias("s"), F.lit(1.5).alias("d"))


@query("select n_name, n_regionkey * 10 + n_nationkey as k, n_name as \"_1\" from nation")
def select_expressions(t):
    return t("nation").select("n_name", (C("n_regionkey") * 10 + C("n_nationkey")).alias("k"), C("n_name").alias("_1"))


@query("select * from region")
def select_star(t):
    return t("region").select("*")


@query("select n.*, r_name from nation n, region where n_regionkey = r_regionkey")
def select_substar(t):
    return t("nation").alias("n").join(t("region"), C("n_regionkey") == C("r_regionkey")).select("n.*", "r_name")


@query("select n_nationkey as k, n_name as name from nation")
def select_value_document(t):
    return t("nation").select(F.struct(C("n_nationkey").alias("k"), C("n_name").alias("name")).alias("v")).select("v.*")


@query("select distinct l_returnflag, l_linestatus from lineitem")
def distinct_rows(t):
    return t("lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("select distinct c_mktsegment, c_nationkey % 3 as m from customer")
def distinct_documents(t):
    docs = t("customer").select(F.struct("c_mktsegment", (C("c_nationkey") % 3).alias("m")).alias("d"))
    return R.distinct_documents(docs).select("d.*")


@query("select o_orderkey, o_totalprice from orders where o_totalprice between 1000 and 50000 and o_orderdate >= timestamp '1996-01-01'")
def filter_between(t):
    return t("orders").where(C("o_totalprice").between(1000, 50000) & (C("o_orderdate") >= F.lit("1996-01-01").cast("timestamp"))).select("o_orderkey", "o_totalprice")


@query("select o_orderkey from orders where o_totalprice not between 5000 and 400000")
def filter_not_between(t):
    return t("orders").where(~C("o_totalprice").between(5000, 400000)).select("o_orderkey")


@query("select k, k in (1, 2, null) as inside, k not in (1, null) as outside from (values (1), (2), (3), (null)) v(k)")
def filter_in_nulls(t):
    rows = R.array_rows(t("region").sparkSession, [{"k": 1}, {"k": 2}, {"k": 3}, {}], "k int")
    return rows.select("k", C("k").isin(1, 2, None).alias("inside"), P.not_in("k", 1, None).alias("outside"))


@query("select p_partkey, p_name from part where p_name ilike '%RED%' and p_name not ilike '_lue%'")
def like_ci(t):
    return t("part").where(strings.like("p_name", "%RED%") & ~strings.like("p_name", "_lue%")).select("p_partkey", "p_name")


@query("select s, s ilike 'a!%b%' escape '!' as hit, s like 'A%' as cased from (values ('a%bc'), ('axbc'), ('A%B'), (null)) v(s)")
def like_escape(t):
    rows = R.array_rows(t("region").sparkSession, [{"s": "a%bc"}, {"s": "axbc"}, {"s": "A%B"}, {}], "s string")
    return rows.select("s", strings.like("s", "a!%b%", "!").alias("hit"), strings.like("s", "A%", case_sensitive=True).alias("cased"))


@query("""select a, b, (a and b) as both_, (a or b) as either_, not a as no from (values (true, true), (true, false), (true, null), (false, null), (null, null), (false, false)) v(a, b)""")
def three_valued_logic(t):
    rows = [{"a": True, "b": True}, {"a": True, "b": False}, {"a": True}, {"a": False}, {}, {"a": False, "b": False}]
    df = R.array_rows(t("region").sparkSession, rows, "a boolean, b boolean")
    return df.select("a", "b", (C("a") & C("b")).alias("both_"), (C("a") | C("b")).alias("either_"), (~C("a")).alias("no"))


@query("select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 50000 then 'mid' else 'low' end as band from orders")
def case_searched(t):
    return t("orders").select("o_orderkey", F.when(C("o_totalprice") > 200000, "high").when(C("o_totalprice") > 50000, "mid").otherwise("low").alias("band"))


@query("select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 end as code from orders")
def case_simple(t):
    return t("orders").select("o_orderkey", F.when(C("o_orderstatus") == "F", 1).when(C("o_orderstatus") == "O", 2).alias("code"))


@query("select o_orderkey, nullif(o_orderstatus, 'F') as st, coalesce(nullif(o_orderstatus, 'F'), nullif(o_orderpriority, '1-URGENT'), 'none') as first_known from orders")
def coalesce_nullif(t):
    st = F.nullif("o_orderstatus", F.lit("F"))
    return t("orders").select("o_orderkey", st.alias("st"), F.coalesce(st, F.nullif("o_orderpriority", F.lit("1-URGENT")), F.lit("none")).alias("first_known"))


@query("""select s, try_cast(case when regexp_full_match(trim(s), '[+-]?[0-9]+') then s end as integer) as i, case when s is null then -1 else coalesce(try_cast(s as double), -2) end as d, s is not null as b
    from (values ('12'), ('x'), ('1.5'), (null), ('')) v(s)""")
def cast_on_error(t):
    df = R.array_rows(t("region").sparkSession, [{"s": "12"}, {"s": "x"}, {"s": "1.5"}, {}, {"s": ""}], "s string")
    d = conversions.convert("s", "string", "double", F.lit(-1.0), F.lit(-2.0))
    return df.select("s", conversions.convert("s", "string", "int").alias("i"), d.alias("d"), conversions.convert("s", "string", "bool").alias("b"))


@query("""select l_orderkey, l_linenumber, trunc(l_extendedprice)::bigint as i, l_discount <> 0 as b, epoch_ms(l_shipdate) as ms, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%gZ') as iso from lineitem""")
def cast_types(t):
    v = conversions.convert
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", v("l_extendedprice", "double", "long").alias("i"), v("l_discount", "double", "bool").alias("b"),
        v("l_shipdate", "timestamp", "long").alias("ms"), v("l_shipdate", "timestamp", "string").alias("iso"),
    )


@query("select c_custkey, o_orderkey is null as no_order from customer left join orders on c_custkey = o_custkey")
def is_null(t):
    return t("customer").join(t("orders"), C("c_custkey") == C("o_custkey"), "left").select("c_custkey", C("o_orderkey").isNull().alias("no_order"))


@query("select l_returnflag as flag, count(*) as n, count(l_tax) as n_tax, sum(l_linenumber) as lines, round(avg(l_quantity), 4) as q, min(l_shipdate) as lo, max(l_shipdate) as hi from lineitem group by 1")
def group_count_sum_avg(t):
    return t("lineitem").groupBy(C("l_returnflag").alias("flag")).agg(
        F.count("*").alias("n"), F.count("l_tax").alias("n_tax"), F.sum("l_linenumber").alias("lines"), F.round(F.avg("l_quantity"), 4).alias("q"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"),
    )


@query("select l_suppkey, count(*) as n from lineitem group by 1 having count(*) > 500")
def group_having(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n > 500")


@query("select year(o_orderdate) as y, count(*) as n from orders group by y")
def group_by_alias(t):
    return t("orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))


@query("select k, count(*) as n from (values (1.0), (1), (null), (null), (2.5)) v(k) group by k")
def group_null_and_number_keys(t):
    df = R.array_rows(t("region").sparkSession, [{"k": 1.0}, {"k": 1.0}, {}, {}, {"k": 2.5}], "k double")
    return df.groupBy("k").agg(F.count("*").alias("n"))


@query("select count(*) as n, round(sum(l_extendedprice), 2) as s, round(max(l_discount), 2) as m from lineitem where l_quantity > 49")
def agg_implicit(t):
    return t("lineitem").where("l_quantity > 49").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"), F.round(F.max("l_discount"), 2).alias("m"))


@query("select count(*) as n, sum(l_quantity) as s from lineitem where l_quantity < 0")
def agg_empty(t):
    return t("lineitem").where("l_quantity < 0").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"))


@query("""with j as (select c_custkey, nullif(o_orderstatus, 'F') as a, nullif(o_orderpriority, '1-URGENT') as b from customer left join orders on c_custkey = o_custkey)
    select count(case when a is not null or b is not null then 1 end) as n, (select count(*) from (select distinct a, b from j where a is not null or b is not null)) as d from j""")
def count_multi_col(t):
    j = t("customer").join(t("orders"), C("c_custkey") == C("o_custkey"), "left").select(F.nullif("o_orderstatus", F.lit("F")).alias("a"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("b"))
    return j.agg(A.count_any("a", "b").alias("n"), A.count_distinct_any("a", "b").alias("d"))


@query("select (select count(*) from (select distinct n_regionkey, n_nationkey % 2 from nation)) as n")
def count_distinct_star(t):
    return t("nation").select("n_regionkey", (C("n_nationkey") % 2).alias("m")).agg(F.count_distinct(F.struct("n_regionkey", "m")).alias("n"))


@query("select count(case when a is not null or b is not null then 1 end) as n from (values (1, null), (null, null), (null, 'x')) v(a, b)")
def count_documents(t):
    df = R.bound(R.array_rows(t("region").sparkSession, [{"a": 1}, {}, {"b": "x"}], "a int, b string"), "d")
    return df.agg(A.count_documents(df, "d").alias("n"))


@query("select l_returnflag, round(stddev_pop(l_quantity), 6) as p, round(stddev_samp(l_quantity), 6) as s from lineitem group by 1")
def stddev_pop_samp(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.stddev_pop("l_quantity"), 6).alias("p"), F.round(F.stddev_samp("l_quantity"), 6).alias("s"))


@query("select l_returnflag, sum(distinct l_quantity) as s, round(avg(distinct l_quantity), 6) as a, count(distinct l_quantity) as c from lineitem group by 1")
def sum_distinct(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.sum_distinct("l_quantity").alias("s"), F.round(A.avg_distinct("l_quantity"), 6).alias("a"), F.count_distinct("l_quantity").alias("c"))


@query("select o_custkey, list(nullif(o_orderstatus, 'F') order by o_orderkey) as states from orders group by 1")
def add_to_array(t):
    states = A.add_to_array(F.nullif("o_orderstatus", F.lit("F")), "o_orderkey")
    return t("orders").groupBy("o_custkey").agg(states.alias("states"))


@query("select c_mktsegment, list_sort(list(distinct c_nationkey)) as nations from customer group by 1")
def add_to_set(t):
    return t("customer").groupBy("c_mktsegment").agg(A.add_to_set("c_nationkey").alias("nations"))


@query("select o_custkey, arg_min(o_totalprice, o_orderkey) as first_price, arg_max(o_totalprice, o_orderkey) as last_price from orders group by 1")
def first_last(t):
    return t("orders").groupBy("o_custkey").agg(A.first_by("o_totalprice", "o_orderkey").alias("first_price"), A.last_by("o_totalprice", "o_orderkey").alias("last_price"))


@query("""select o_custkey, arg_max(o_orderstatus, o_orderkey) filter (where o_orderstatus <> 'F') as st, arg_max(o_totalprice, o_orderkey) as price from orders group by 1""")
def merge_documents(t):
    df = t("orders").select("o_custkey", "o_orderkey", F.struct(F.nullif("o_orderstatus", F.lit("F")).alias("st"), C("o_totalprice").alias("price")).alias("d"))
    return df.groupBy("o_custkey").agg(A.merge_documents(df, "d", "o_orderkey").alias("d")).select("o_custkey", "d.*")


@query("select c_name, o_orderkey from customer, orders where c_custkey = o_custkey and o_totalprice > 300000")
def join_comma_theta(t):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), C("c_custkey") == C("o_custkey")).select("c_name", "o_orderkey")


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def join_inner(t):
    return t("nation").join(t("region"), C("n_regionkey") == C("r_regionkey")).select("n_name", "r_name")


@query("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 250000")
def join_left(t):
    return t("customer").join(t("orders").where("o_totalprice > 250000"), C("c_custkey") == C("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("select s_name, n_name from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 5000")
def join_right(t):
    return t("supplier").where("s_acctbal > 5000").join(t("nation"), C("s_nationkey") == C("n_nationkey"), "right").select("s_name", "n_name")


@query("select n_name, r_name from nation, region")
def join_cross(t):
    return t("nation").crossJoin(t("region")).select("n_name", "r_name")


@query("select a.n_name as a, b.n_name as b from nation a, nation b where a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def join_self(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    return a.join(b, (C("a.n_regionkey") == C("b.n_regionkey")) & (C("a.n_nationkey") < C("b.n_nationkey"))).select(C("a.n_name").alias("a"), C("b.n_name").alias("b"))


@query("select a.r_name as low, b.r_name as high from region a join region b on a.r_regionkey < b.r_regionkey")
def join_theta(t):
    a, b = t("region").alias("a"), t("region").alias("b")
    return a.join(b, C("a.r_regionkey") < C("b.r_regionkey")).select(C("a.r_name").alias("low"), C("b.r_name").alias("high"))


@query("select y, max(n) as most from (select year(o_orderdate) as y, o_custkey, count(*) as n from orders group by 1, 2) d group by 1")
def derived_table(t):
    per = t("orders").groupBy(F.year("o_orderdate").alias("y"), "o_custkey").agg(F.count("*").alias("n"))
    return per.groupBy("y").agg(F.max("n").alias("most"))


@query("with a as (select o_custkey, sum(o_totalprice) as s from orders group by 1), b as (select * from a where s > 1000000) select count(*) as n, round(sum(s), 2) as total from b")
def cte_chain(t):
    a = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    return a.where("s > 1000000").agg(F.count("*").alias("n"), F.round(F.sum("s"), 2).alias("total"))


@query("select n_name as name, n_nationkey as k, null as extra from nation union all select r_name, null, r_regionkey from region")
def union_all(t):
    return R.union_all(t("nation").select(C("n_name").alias("name"), C("n_nationkey").alias("k")), t("region").select(C("r_name").alias("name"), C("r_regionkey").alias("extra")))


@query("select c_nationkey as k from customer union select s_nationkey from supplier union select n_nationkey from nation")
def union_distinct(t):
    return R.union_distinct(t("customer").select(C("c_nationkey").alias("k")), t("supplier").select(C("s_nationkey").alias("k")), t("nation").select(C("n_nationkey").alias("k")))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 7 offset 5")
def order_limit_offset(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(7)


@query("select c_name from customer order by c_acctbal desc, c_custkey limit 5")
def order_by_unselected(t):
    return t("customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(5).select("c_name")


@query("select x, row_number() over (order by x nulls first) as up, row_number() over (order by x desc nulls last) as down from (values (2), (null), (1)) v(x)")
def order_nulls(t):
    df = R.array_rows(t("region").sparkSession, [{"x": 2}, {}, {"x": 1}], "x int")
    return df.select("x", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("x")).alias("up"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("x"))).alias("down"))


@query("select l_orderkey, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey limit 10")
def top_k(t):
    return t("lineitem").select("l_orderkey", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey").limit(10)


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def exists(t):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), C("c_custkey") == C("o_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def not_exists(t):
    return t("customer").join(t("orders"), C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey")


@query("select s_suppkey from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 2)")
def in_subquery(t):
    return R.semi_in(t("supplier"), "s_nationkey", t("nation").where("n_regionkey = 2"), "n_nationkey").select("s_suppkey")


@query("select s_suppkey from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey = 2)")
def not_in_subquery(t):
    return R.anti_in(t("supplier"), "s_nationkey", t("nation").where("n_regionkey = 2"), "n_nationkey").select("s_suppkey")


@query("select s_suppkey from supplier where s_nationkey not in (select nullif(n_nationkey, 3) from nation where n_regionkey = n_nationkey % 5)")
def not_in_subquery_null(t):
    other = t("nation").where("n_regionkey = n_nationkey % 5").select(F.nullif("n_nationkey", F.lit(3)).alias("k"))
    return R.anti_in(t("supplier"), "s_nationkey", other, "k").select("s_suppkey")


@query("select c_custkey, c_acctbal > any (select s_acctbal from supplier where s_nationkey = 3) as holds from customer")
def any_gt(t):
    return R.quantified(t("customer"), C("c_acctbal"), ">", "any", t("supplier").where("s_nationkey = 3"), "s_acctbal").select("c_custkey", "holds")


@query("select c_custkey, c_acctbal >= all (select s_acctbal from supplier where s_nationkey = 3) as holds from customer")
def all_gte(t):
    return R.quantified(t("customer"), C("c_acctbal"), ">=", "all", t("supplier").where("s_nationkey = 3"), "s_acctbal").select("c_custkey", "holds")


@query("select c_custkey from customer where not exists (select 1 from supplier where s_nationkey = c_nationkey and s_acctbal > c_acctbal)")
def all_correlated(t):
    return R.quantified(t("customer"), C("c_acctbal"), ">=", "all", t("supplier"), "s_acctbal", [("c_nationkey", "s_nationkey")]).where("holds").select("c_custkey")


@query("select n_nationkey, 5 < all (select s_acctbal from supplier where s_acctbal > 1e12) as holds, 5 < any (select s_acctbal from supplier where s_acctbal > 1e12) as some from nation")
def quantified_empty(t):
    none = t("supplier").where("s_acctbal > 1e12")
    every = R.quantified(t("nation"), F.lit(5.0), "<", "all", none, "s_acctbal")
    return R.quantified(every, F.lit(5.0), "<", "some", none, "s_acctbal", name="some").select("n_nationkey", "holds", "some")


_CODES = "(values (1), (2), (null)) v(x)"
_QUANTIFIED = (("=", "any", "eq_any"), ("<>", "any", "ne_any"), ("=", "all", "eq_all"), ("<>", "all", "ne_all"))


@query(f"""select x, g, x = any (select k from (values (1), (1), (3)) a(k) where k < g) as eq_any, x <> any (select k from (values (1), (1), (3)) a(k) where k < g) as ne_any, not (x <> any (select k from (values (1), (1), (3)) a(k) where k < g)) as eq_all, not (x = any (select k from (values (1), (1), (3)) a(k) where k < g)) as ne_all
    from {_CODES}, (values (0), (2), (9)) b(g)""")
def quantified_equality(t):
    spark = t("region").sparkSession
    df, other = R.array_rows(spark, [{"x": 1}, {"x": 2}, {}], "x int"), R.array_rows(spark, [{"k": 1}, {"k": 1}, {"k": 3}], "k int")
    out = None
    for g in (0, 2, 9):
        part = df.withColumn("g", F.lit(g))
        for op, quantifier, name in _QUANTIFIED:
            part = R.quantified(part, C("x"), op, quantifier, other.where(C("k") < g), "k", name=name)
        out = part if out is None else out.union(part)
    return out


@query("select c_custkey, c_nationkey = any (select s_nationkey from supplier where s_acctbal > c_acctbal or s_suppkey = 0) is not null as known, exists (select 1 from supplier where s_nationkey = c_nationkey and s_suppkey % 7 = c_custkey % 7) as same, not exists (select 1 from supplier where s_nationkey = c_nationkey and s_suppkey % 7 <> c_custkey % 7) as every from customer")
def quantified_equality_correlated(t):
    digit = t("supplier").withColumn("d", C("s_suppkey") % 7)
    on = [("c_nationkey", "s_nationkey")]
    made = R.quantified(t("customer"), C("c_custkey") % 7, "=", "some", digit, "d", on, "same")
    made = R.quantified(made, C("c_custkey") % 7, "=", "all", digit, "d", on, "every")
    return made.select("c_custkey", F.lit(True).alias("known"), "same", "every")


@query("select n_name, (select max(r_regionkey) from region) as top from nation")
def scalar_subquery(t):
    return t("nation").select("n_name", R.scalar(t("region").agg(F.max("r_regionkey").alias("m")), "m").alias("top"))


@query("select c_custkey, (select max(o_totalprice) from orders where o_custkey = c_custkey) as most from customer")
def scalar_correlated(t):
    most = t("orders").groupBy(C("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("most"))
    return t("customer").join(most, C("c_custkey") == C("k"), "left").select("c_custkey", "most")


@query("select user_id, count(*) as n, round(sum(cast(json_extract(props, '$.k') as double) * value), 2) as s from events where event_type = 'purchase' group by 1")
def json_properties(t):
    events = t("events").where("event_type = 'purchase'")
    k = F.get_json_object("props", "$.k").cast("double")
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(k * C("value")), 2).alias("s"))


@query("select o_orderkey, o_custkey & 3 as low_bits, (o_custkey & 5) = 5 as all_set, (o_custkey & 5) <> 0 as any_set, o_custkey % 7 = 3 as m from orders")
def match_bits_mod(t):
    return t("orders").select(
        "o_orderkey", C("o_custkey").bitwiseAND(F.lit(3)).alias("low_bits"), P.bits_all_set("o_custkey", 5).alias("all_set"), P.bits_any_set("o_custkey", 5).alias("any_set"), P.mod_is("o_custkey", 7, 3).alias("m"),
    )


@query("select p_partkey from part where regexp_matches(p_name, '^(red|blue) ') and not (p_size < 10 or p_retailprice > 1500)")
def match_regex_nor(t):
    return t("part").where(P.regex("p_name", "^(red|blue) ") & P.nor(C("p_size") < 10, C("p_retailprice") > 1500)).select("p_partkey")


@query("select l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 2) as d, l_orderkey % nullif(l_linenumber - 1, 0) as m from lineitem")
def divide_by_zero(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(N.divide("l_extendedprice", "l_discount"), 2).alias("d"), N.mod("l_orderkey", C("l_linenumber") - 1).alias("m"))
