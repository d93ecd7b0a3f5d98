"""Decision-support queries over the star schema, in frames; columns that the tables lack are left out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from docloom.plans.registry import query

C = F.col


def revenue():
    return C("l_extendedprice") * (1 - C("l_discount"))


def day(text: str):
    return F.lit(datetime.fromisoformat(text))


def total(c, name, digits=2):
    return F.round(F.sum(c), digits).alias(name)


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge,
    round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 4) as avg_disc, count(*) as count_order
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2 order by 1, 2""")
def tpch_q1(t):
    return (
        t("lineitem").where(C("l_shipdate") <= day("1998-09-02")).groupBy("l_returnflag", "l_linestatus")
        .agg(
            total("l_quantity", "sum_qty"), total("l_extendedprice", "sum_base_price"), total(revenue(), "sum_disc_price"), total(revenue() * (1 + C("l_tax")), "sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("count_order"),
        ).orderBy("l_returnflag", "l_linestatus")
    )


@query("""select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, o_orderdate from customer, orders, lineitem
    where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < timestamp '1995-03-15' and l_shipdate > timestamp '1995-03-15'
    group by l_orderkey, o_orderdate order by revenue desc, o_orderdate, l_orderkey limit 10""")
def tpch_q3(t):
    buyers = t("customer").where(C("c_mktsegment") == "BUILDING")
    orders = t("orders").where(C("o_orderdate") < day("1995-03-15"))
    lines = t("lineitem").where(C("l_shipdate") > day("1995-03-15"))
    met = buyers.join(orders, C("c_custkey") == C("o_custkey")).join(lines, C("l_orderkey") == C("o_orderkey"))
    return met.groupBy("l_orderkey", "o_orderdate").agg(total(revenue(), "revenue")).orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10)


@query("""select o_orderpriority, count(*) as order_count from orders where o_orderdate >= timestamp '1993-07-01' and o_orderdate < timestamp '1996-10-01'
    and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate + interval 60 day) group by 1 order by 1""")
def tpch_q4_shape(t):
    orders = t("orders").where((C("o_orderdate") >= day("1993-07-01")) & (C("o_orderdate") < day("1996-10-01")))
    late = (C("l_orderkey") == C("o_orderkey")) & (C("l_shipdate") > C("o_orderdate") + F.expr("interval 60 day"))
    return orders.join(t("lineitem"), late, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("order_count")).orderBy("o_orderpriority")


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer, orders, lineitem, supplier, nation, region
    where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey
    and n_regionkey = r_regionkey and r_name = 'ASIA' and o_orderdate >= timestamp '1994-01-01' and o_orderdate < timestamp '1997-01-01' group by 1 order by 2 desc""")
def tpch_q5(t):
    nations = t("nation").join(t("region").where(C("r_name") == "ASIA"), C("n_regionkey") == C("r_regionkey"))
    sellers = t("supplier").join(nations, C("s_nationkey") == C("n_nationkey"))
    orders = t("orders").where((C("o_orderdate") >= day("1994-01-01")) & (C("o_orderdate") < day("1997-01-01")))
    met = t("customer").join(orders, C("c_custkey") == C("o_custkey")).join(t("lineitem"), C("l_orderkey") == C("o_orderkey"))
    met = met.join(sellers, (C("l_suppkey") == C("s_suppkey")) & (C("c_nationkey") == C("s_nationkey")))
    return met.groupBy("n_name").agg(total(revenue(), "revenue")).orderBy(F.desc("revenue"))


@query("""select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_shipdate >= timestamp '1994-01-01' and l_shipdate < timestamp '1995-01-01'
    and l_discount between 0.05 and 0.07 and l_quantity < 24""")
def tpch_q6(t):
    lines = t("lineitem").where((C("l_shipdate") >= day("1994-01-01")) & (C("l_shipdate") < day("1995-01-01")) & C("l_discount").between(0.05, 0.07) & (C("l_quantity") < 24))
    return lines.agg(total(C("l_extendedprice") * C("l_discount"), "revenue"))


@query("""select n1.n_name as supp_nation, n2.n_name as cust_nation, year(l_shipdate) as l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
    from supplier, lineitem, orders, customer, nation n1, nation n2 where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey
    and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey and ((n1.n_name = 'NATION_6' and n2.n_name = 'NATION_7') or (n1.n_name = 'NATION_7' and n2.n_name = 'NATION_6'))
    and l_shipdate between timestamp '1995-01-01' and timestamp '1996-12-31' group by 1, 2, 3 order by 1, 2, 3""")
def tpch_q7(t):
    two = t("nation").where(C("n_name").isin("NATION_6", "NATION_7"))
    sellers = t("supplier").join(two.select(C("n_nationkey").alias("k1"), C("n_name").alias("supp_nation")), C("s_nationkey") == C("k1"))
    buyers = t("customer").join(two.select(C("n_nationkey").alias("k2"), C("n_name").alias("cust_nation")), C("c_nationkey") == C("k2"))
    lines = t("lineitem").where(C("l_shipdate").between(day("1995-01-01"), day("1996-12-31")))
    met = lines.join(sellers, C("l_suppkey") == C("s_suppkey")).join(t("orders"), C("l_orderkey") == C("o_orderkey")).join(buyers, C("o_custkey") == C("c_custkey"))
    met = met.where(C("supp_nation") != C("cust_nation"))
    return met.groupBy("supp_nation", "cust_nation", F.year("l_shipdate").alias("l_year")).agg(total(revenue(), "revenue")).orderBy("supp_nation", "cust_nation", "l_year")


@query("""select year(o_orderdate) as o_year, round(sum(case when n2.n_name = 'NATION_2' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as mkt_share
    from part, supplier, lineitem, orders, customer, nation n1, nation n2, region where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey
    and o_custkey = c_custkey and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and r_name = 'AMERICA' and s_nationkey = n2.n_nationkey
    and o_orderdate between timestamp '1995-01-01' and timestamp '1996-12-31' and p_size < 25 group by 1 order by 1""")
def tpch_q8(t):
    american = t("nation").join(t("region").where(C("r_name") == "AMERICA"), C("n_regionkey") == C("r_regionkey")).select(C("n_nationkey").alias("k1"))
    buyers = t("customer").join(american, C("c_nationkey") == C("k1"), "left_semi")
    sellers = t("supplier").join(t("nation").select("n_nationkey", "n_name"), C("s_nationkey") == C("n_nationkey"))
    orders = t("orders").where(C("o_orderdate").between(day("1995-01-01"), day("1996-12-31")))
    met = t("lineitem").join(t("part").where(C("p_size") < 25), C("l_partkey") == C("p_partkey")).join(sellers, C("l_suppkey") == C("s_suppkey"))
    met = met.join(orders, C("l_orderkey") == C("o_orderkey")).join(buyers, C("o_custkey") == C("c_custkey"))
    share = F.round(F.sum(F.when(C("n_name") == "NATION_2", revenue()).otherwise(0.0)) / F.sum(revenue()), 6)
    return met.groupBy(F.year("o_orderdate").alias("o_year")).agg(share.alias("mkt_share")).orderBy("o_year")


@query("""select c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, c_acctbal, n_name from customer, orders, lineitem, nation
    where c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate >= timestamp '1993-10-01' and o_orderdate < timestamp '1996-01-01' and l_returnflag = 'R'
    and c_nationkey = n_nationkey group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20""")
def tpch_q10(t):
    orders = t("orders").where((C("o_orderdate") >= day("1993-10-01")) & (C("o_orderdate") < day("1996-01-01")))
    met = t("customer").join(orders, C("c_custkey") == C("o_custkey")).join(t("lineitem").where("l_returnflag = 'R'"), C("l_orderkey") == C("o_orderkey")).join(t("nation"), C("c_nationkey") == C("n_nationkey"))
    return met.groupBy("c_custkey", "c_name", "c_acctbal", "n_name").agg(total(revenue(), "revenue")).orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query("""select l_linestatus, sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as high_line_count,
    sum(case when o_orderpriority not in ('1-URGENT', '2-HIGH') then 1 else 0 end) as low_line_count from orders, lineitem where o_orderkey = l_orderkey and l_shipdate > o_orderdate
    group by 1 order by 1""")
def tpch_q12_shape(t):
    high = C("o_orderpriority").isin("1-URGENT", "2-HIGH")
    met = t("orders").join(t("lineitem"), (C("o_orderkey") == C("l_orderkey")) & (C("l_shipdate") > C("o_orderdate")))
    return met.groupBy("l_linestatus").agg(F.count_if(high).alias("high_line_count"), F.count_if(~high).alias("low_line_count")).orderBy("l_linestatus")


@query("""select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left join orders on c_custkey = o_custkey and o_orderstatus <> 'P' group by 1) group by 1 order by 2 desc, 1 desc""")
def tpch_q13_shape(t):
    met = t("customer").join(t("orders"), (C("c_custkey") == C("o_custkey")) & (C("o_orderstatus") != "P"), "left")
    per = met.groupBy("c_custkey").agg(F.count("o_orderkey").alias("c_count"))
    return per.groupBy("c_count").agg(F.count("*").alias("custdist")).orderBy(F.desc("custdist"), F.desc("c_count"))


@query("""select round(100.0 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as promo_revenue
    from lineitem, part where l_partkey = p_partkey and l_shipdate >= timestamp '1995-09-01' and l_shipdate < timestamp '1996-10-01'""")
def tpch_q14(t):
    lines = t("lineitem").where((C("l_shipdate") >= day("1995-09-01")) & (C("l_shipdate") < day("1996-10-01")))
    met = lines.join(t("part"), C("l_partkey") == C("p_partkey"))
    promo = F.sum(F.when(C("p_type").startswith("PROMO"), revenue()).otherwise(0.0))
    return met.agg(F.round(100.0 * promo / F.sum(revenue()), 6).alias("promo_revenue"))


@query("""with revenue as (select l_suppkey as supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) as total_revenue from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1996-04-01' group by 1)
    select s_suppkey, s_name, total_revenue from supplier, revenue where s_suppkey = supplier_no and total_revenue = (select max(total_revenue) from revenue) order by 1""")
def tpch_q15(t):
    lines = t("lineitem").where((C("l_shipdate") >= day("1996-01-01")) & (C("l_shipdate") < day("1996-04-01")))
    earned = lines.groupBy(C("l_suppkey").alias("supplier_no")).agg(total(revenue(), "total_revenue"))
    best = earned.agg(F.max("total_revenue").alias("best"))
    met = earned.join(F.broadcast(best), C("total_revenue") == C("best"))
    return t("supplier").join(met, C("s_suppkey") == C("supplier_no")).select("s_suppkey", "s_name", "total_revenue").orderBy("s_suppkey")


@query("""select round(sum(l_extendedprice) / 7.0, 2) as avg_yearly from lineitem, part where p_partkey = l_partkey and p_size < 10
    and l_quantity < (select 0.5 * avg(l2.l_quantity) from lineitem l2 where l2.l_partkey = p_partkey)""")
def tpch_q17_shape(t):
    small = t("part").where("p_size < 10").select("p_partkey")
    lines = t("lineitem").join(small, C("l_partkey") == C("p_partkey"))
    half = lines.groupBy(C("l_partkey").alias("k")).agg((0.5 * F.avg("l_quantity")).alias("half"))
    return lines.join(half, C("l_partkey") == C("k")).where("l_quantity < half").agg(F.round(F.sum("l_extendedprice") / 7.0, 2).alias("avg_yearly"))


@query("""select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) as total_qty from customer, orders, lineitem
    where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 200) and c_custkey = o_custkey and o_orderkey = l_orderkey
    group by 1, 2, 3, 4, 5 order by o_totalprice desc, o_orderdate, o_orderkey limit 100""")
def tpch_q18(t):
    # the sum that picks the orders is the one that is asked for: one aggregate serves both
    large = t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total_qty")).where("total_qty > 200")
    met = t("orders").join(large, C("o_orderkey") == C("l_orderkey")).join(t("customer"), C("o_custkey") == C("c_custkey"))
    return met.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "total_qty").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100)


@query("""select round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem, part where p_partkey = l_partkey and
    ((p_brand = 'Brand#12' and l_quantity between 1 and 11 and p_size between 1 and 5) or (p_brand = 'Brand#23' and l_quantity between 10 and 20 and p_size between 1 and 10)
    or (p_brand = 'Brand#34' and l_quantity between 20 and 30 and p_size between 1 and 15))""")
def tpch_q19_shape(t):
    def one(brand, low, high, size):
        return (C("p_brand") == brand) & C("l_quantity").between(low, high) & C("p_size").between(1, size)

    either = one("Brand#12", 1, 11, 5) | one("Brand#23", 10, 20, 10) | one("Brand#34", 20, 30, 15)
    return t("lineitem").join(t("part"), (C("l_partkey") == C("p_partkey")) & either).agg(total(revenue(), "revenue"))


@query("""select s_name, count(*) as numwait from supplier, lineitem l1, orders, nation where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F'
    and exists (select 1 from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
    and not exists (select 1 from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_returnflag = 'R')
    and s_nationkey = n_nationkey and n_name = 'NATION_6' group by 1 order by 2 desc, 1 limit 100""")
def tpch_q21_shape(t):
    # both tests look at the suppliers of an order: least and greatest tell whether there is another one
    per = t("lineitem").groupBy(C("l_orderkey").alias("k")).agg(
        F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi"),
        F.min(F.when(C("l_returnflag") == "R", C("l_suppkey"))).alias("r_lo"), F.max(F.when(C("l_returnflag") == "R", C("l_suppkey"))).alias("r_hi"),
    )
    sellers = t("supplier").join(t("nation").where("n_name = 'NATION_6'"), C("s_nationkey") == C("n_nationkey"))
    met = t("lineitem").join(sellers, C("l_suppkey") == C("s_suppkey")).join(t("orders").where("o_orderstatus = 'F'"), C("l_orderkey") == C("o_orderkey")).join(per, C("l_orderkey") == C("k"))
    alone = F.coalesce((C("r_lo") == C("l_suppkey")) & (C("r_hi") == C("l_suppkey")), C("r_lo").isNull())
    return met.where((C("lo") != C("hi")) & alone).groupBy("s_name").agg(F.count("*").alias("numwait")).orderBy(F.desc("numwait"), "s_name").limit(100)


@query("""select c_mktsegment, count(*) as numcust, round(sum(c_acctbal), 2) as totacctbal from customer where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0)
    and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') group by 1 order by 1""")
def tpch_q22_shape(t):
    customers = t("customer")
    mean = customers.where("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean"))
    rich = customers.join(F.broadcast(mean), C("c_acctbal") > C("mean"))
    idle = rich.join(t("orders").where("o_orderstatus = 'F'"), C("o_custkey") == C("c_custkey"), "left_anti")
    return idle.groupBy("c_mktsegment").agg(F.count("*").alias("numcust"), total("c_acctbal", "totacctbal")).orderBy("c_mktsegment")


_SUPPLIES = "(select l_partkey as ps_partkey, l_suppkey as ps_suppkey, min(l_extendedprice / l_quantity) as ps_supplycost, sum(l_quantity) as ps_availqty from lineitem group by 1, 2)"


def supplies(t):
    """Which supplier delivers which part, at what cost and in what quantity, as order lines show."""
    return t("lineitem").groupBy(C("l_partkey").alias("ps_partkey"), C("l_suppkey").alias("ps_suppkey")).agg(F.min(C("l_extendedprice") / C("l_quantity")).alias("ps_supplycost"), F.sum("l_quantity").alias("ps_availqty"))


@query(f"""with s as {_SUPPLIES}, e as (select s.*, s_name, s_acctbal, n_name from s, supplier, nation, region where ps_suppkey = s_suppkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_regionkey = 3),
    m as (select ps_partkey as k, min(ps_supplycost) as least from e group by 1)
    select s_acctbal, s_name, n_name, p_partkey, round(ps_supplycost, 4) as cost from part, e, m where p_partkey = ps_partkey and p_partkey = k and ps_supplycost = least and p_size < 15 order by s_acctbal desc, n_name, s_name, p_partkey limit 100""")
def tpch_q2_shape(t):
    near = t("supplier").join(t("nation").where("n_regionkey = 3"), C("s_nationkey") == C("n_nationkey"))
    offers = supplies(t).join(near, C("ps_suppkey") == C("s_suppkey"))
    least = offers.groupBy(C("ps_partkey").alias("k")).agg(F.min("ps_supplycost").alias("least"))
    best = offers.join(least, (C("ps_partkey") == C("k")) & (C("ps_supplycost") == C("least")))
    met = best.join(t("part").where("p_size < 15"), C("p_partkey") == C("ps_partkey"))
    return met.select("s_acctbal", "s_name", "n_name", "p_partkey", F.round("ps_supplycost", 4).alias("cost")).orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey").limit(100)


@query(f"""with s as {_SUPPLIES} select n_name as nation, year(o_orderdate) as o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 2) as sum_profit
    from part, supplier, lineitem, s, orders, nation where s_suppkey = l_suppkey and ps_suppkey = l_suppkey and ps_partkey = l_partkey and p_partkey = l_partkey and o_orderkey = l_orderkey and s_nationkey = n_nationkey and p_name like '%red%' group by 1, 2""")
def tpch_q9_shape(t):
    lines = t("lineitem").join(t("part").where("p_name like '%red%'"), C("p_partkey") == C("l_partkey"))
    lines = lines.join(supplies(t), (C("ps_partkey") == C("l_partkey")) & (C("ps_suppkey") == C("l_suppkey")))
    met = lines.join(t("supplier"), C("s_suppkey") == C("l_suppkey")).join(t("nation"), C("s_nationkey") == C("n_nationkey")).join(t("orders"), C("o_orderkey") == C("l_orderkey"))
    return met.groupBy(C("n_name").alias("nation"), F.year("o_orderdate").alias("o_year")).agg(total(revenue() - C("ps_supplycost") * C("l_quantity"), "sum_profit"))


@query(f"""with s as {_SUPPLIES}, v as (select ps_partkey, sum(ps_supplycost * ps_availqty) as worth from s, supplier where ps_suppkey = s_suppkey and s_nationkey = 7 group by 1)
    select ps_partkey, round(worth, 2) as worth from v where worth > (select sum(worth) * 0.0005 from v)""")
def tpch_q11_shape(t):
    own = supplies(t).join(t("supplier").where("s_nationkey = 7"), C("ps_suppkey") == C("s_suppkey"))
    worth = own.groupBy("ps_partkey").agg(F.sum(C("ps_supplycost") * C("ps_availqty")).alias("worth"))
    least = worth.agg((F.sum("worth") * 0.0005).alias("least"))
    return worth.join(F.broadcast(least), C("worth") > C("least")).select("ps_partkey", F.round("worth", 2).alias("worth"))


@query(f"""with s as {_SUPPLIES} select p_brand, p_type, p_size, count(distinct ps_suppkey) as supplier_cnt from s, part where p_partkey = ps_partkey and p_brand <> 'Brand#45' and p_type not like 'MEDIUM%' and p_size in (49, 14, 23, 45, 19, 3, 36, 9)
    and ps_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) group by 1, 2, 3""")
def tpch_q16_shape(t):
    parts = t("part").where((C("p_brand") != "Brand#45") & ~C("p_type").like("MEDIUM%") & C("p_size").isin(49, 14, 23, 45, 19, 3, 36, 9))
    offers = supplies(t).join(t("supplier").where("s_acctbal < 0"), C("ps_suppkey") == C("s_suppkey"), "left_anti")
    return offers.join(parts, C("p_partkey") == C("ps_partkey")).groupBy("p_brand", "p_type", "p_size").agg(F.count_distinct("ps_suppkey").alias("supplier_cnt"))


@query(f"""with s as {_SUPPLIES} select s_suppkey, s_name from supplier, nation where s_nationkey = n_nationkey and n_nationkey < 9 and s_suppkey in (select ps_suppkey from s where ps_partkey in (select p_partkey from part where p_name like 'red%')
    and ps_availqty > (select 0.5 * sum(l_quantity) from lineitem where l_partkey = ps_partkey and l_suppkey = ps_suppkey and l_shipdate >= timestamp '1994-01-01' and l_shipdate < timestamp '1997-01-01'))""")
def tpch_q20_shape(t):
    years = t("lineitem").where((C("l_shipdate") >= day("1994-01-01")) & (C("l_shipdate") < day("1997-01-01")))
    half = years.groupBy("l_partkey", "l_suppkey").agg((0.5 * F.sum("l_quantity")).alias("half"))
    red = supplies(t).join(t("part").where("p_name like 'red%'"), C("p_partkey") == C("ps_partkey"), "left_semi")
    enough = red.join(half, (C("l_partkey") == C("ps_partkey")) & (C("l_suppkey") == C("ps_suppkey")) & (C("ps_availqty") > C("half")))
    return t("supplier").where("s_nationkey < 9").join(enough, C("s_suppkey") == C("ps_suppkey"), "left_semi").select("s_suppkey", "s_name")
