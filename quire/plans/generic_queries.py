"""General relational coverage on the star schema: joins, semi and anti joins, grouping sets, windows, set operations, as-of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.sources.tables import table

CENTS = "cast(round({} * 100) as long)"


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    return li.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date")).groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.expr(CENTS.format("l_quantity"))).alias("qty_100"), F.sum(F.expr(CENTS.format("l_extendedprice"))).alias("price_100"), F.count("*").alias("n"))


def shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = _t(spark, sf_dir, "customer", "orders", "lineitem")
    j = c.where("c_mktsegment = 'BUILDING'").join(o, c.c_custkey == o.o_custkey).join(li, o.o_orderkey == li.l_orderkey)
    return j.groupBy("l_orderkey").agg(F.sum(F.expr(CENTS.format("l_extendedprice"))).alias("price_100")).orderBy(F.desc("price_100"), "l_orderkey").limit(10)


def nation_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s, li = _t(spark, sf_dir, "region", "nation", "supplier", "lineitem")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("items"), F.sum(F.expr(CENTS.format("l_extendedprice"))).alias("price_100"))


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def customers_with_urgent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o.where("o_orderpriority like '1%'"), c.c_custkey == o.o_custkey, "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("n"))


def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    out = o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))
    return out.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n", "level")


def top_parts_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    sums = li.groupBy("l_suppkey", "l_partkey").agg(F.sum(F.expr(CENTS.format("l_extendedprice"))).alias("price_100"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("price_100"), "l_partkey")
    return sums.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


def part_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    a, b = li.where("l_returnflag = 'R'").select("l_partkey"), li.where("l_linenumber = 1").select("l_partkey")
    tag = lambda df, k: df.agg(F.count("*").alias("n"), F.sum("l_partkey").cast("long").alias("total")).withColumn("op", F.lit(k))
    return tag(a.intersect(b), "intersect").unionByName(tag(a.subtract(b), "except")).unionByName(tag(a.union(b).distinct(), "union"))


def asof_order_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the same user's last click before it: both sides in one ordered window, no range join."""
    (e,) = _t(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    out = e.withColumn("click", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w))
    return out.where("event_type = 'purchase'").select("event_id", "click")


QUERIES = {f.__name__: f for f in (pricing_summary, shipping_priority, nation_volume, customers_without_orders, customers_with_urgent_orders, order_rollup, top_parts_by_supplier, part_set_operations, asof_order_event)}
C = "sum(round({} * 100)::bigint)::bigint"
ORACLES = {
    "pricing_summary": f"SELECT l_returnflag, l_linestatus, {C.format('l_quantity')} AS qty_100, {C.format('l_extendedprice')} AS price_100, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL",
    "shipping_priority": f"SELECT l_orderkey, {C.format('l_extendedprice')} AS price_100 FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "nation_volume": f"SELECT r_name, n_name, count(*) AS items, {C.format('l_extendedprice')} AS price_100 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "customers_without_orders": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1",
    "customers_with_urgent_orders": "SELECT c_nationkey, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') GROUP BY 1",
    "order_rollup": "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n, grouping(o_orderstatus, o_orderpriority)::bigint AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "top_parts_by_supplier": f"WITH s AS (SELECT l_suppkey, l_partkey, {C.format('l_extendedprice')} AS price_100 FROM lineitem GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY price_100 DESC, l_partkey) AS rank FROM s QUALIFY rank <= 3",
    "part_set_operations": "WITH a AS (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1) SELECT 'intersect' AS op, count(*) AS n, sum(l_partkey)::bigint AS total FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*), sum(l_partkey)::bigint FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'union', count(*), sum(l_partkey)::bigint FROM (SELECT * FROM a UNION SELECT * FROM b)",
    "asof_order_event": "SELECT event_id, click FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click FROM events) WHERE event_type = 'purchase'",
}
