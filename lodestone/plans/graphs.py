"""Queries over dependency edges: parts bought together in one order, where discount and quantity are high."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from .registry import query

EDGES = """e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_discount >= 0.1 AND a.l_quantity >= 45 AND a.l_partkey <> b.l_partkey)"""
REACH = f"WITH RECURSIVE {EDGES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) "


def edges(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    a = li.where("l_discount >= 0.1 and l_quantity >= 45").select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    return a.join(li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst")), ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct()


@query("fan_in_out", f"""WITH {EDGES}, n AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e)
SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, round(sum(o) / (sum(i) + sum(o)), 6) AS instability FROM n GROUP BY node""")
def fan_in_out(spark: SparkSession, sf: str) -> DataFrame:
    return graph.fans(edges(spark, sf))


@query("god_modules", f"WITH {EDGES}, n AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) SELECT node, count(*) AS degree FROM n GROUP BY node HAVING count(*) >= 3")
def god_modules(spark: SparkSession, sf: str) -> DataFrame:
    return graph.fans(edges(spark, sf)).select("node", (F.col("fan_in") + F.col("fan_out")).alias("degree")).where("degree >= 3")


LAYERED = """e AS (SELECT DISTINCT 300 + l_suppkey % 20 AS src, l_partkey % 5 AS dst FROM lineitem UNION SELECT DISTINCT l_partkey % 5, 100 + l_orderkey % 7 FROM lineitem WHERE l_linenumber = 1 UNION SELECT DISTINCT 100 + l_orderkey % 7, 200 + l_partkey % 30 FROM lineitem)"""


def layered_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Many modules over a few hubs, over a middle layer that itself imports much."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    hub, middle = F.col("l_partkey") % 5, 100 + F.col("l_orderkey") % 7
    top = li.select((300 + F.col("l_suppkey") % 20).alias("src"), hub.alias("dst"))
    return top.union(li.where("l_linenumber = 1").select(hub, middle)).union(li.select(middle, 200 + F.col("l_partkey") % 30)).distinct()


@query("stability_direction", f"""WITH {LAYERED}, n AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e), s AS (SELECT node, sum(i) AS fi, round(sum(o) / (sum(i) + sum(o)), 6) AS ins FROM n GROUP BY node)
SELECT src, dst, round(b.ins - a.ins, 6) AS delta FROM e JOIN s a ON a.node = src JOIN s b ON b.node = dst WHERE a.fi >= 3 AND b.ins - a.ins > 0.35""")
def stability_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Modules that many depend on and that import much less stable ones, by the limits' defaults."""
    return graph.unstable_dependencies(layered_edges(spark, sf))


@query("transitive_dependents", REACH + "SELECT dst AS node, count(DISTINCT src) AS dependents FROM r GROUP BY dst")
def transitive_dependents(spark: SparkSession, sf: str) -> DataFrame:
    return graph.closure(edges(spark, sf)).groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("dependents"))


@query("change_impact", REACH + "SELECT dst AS changed, src AS affected FROM r WHERE dst % 10 = 0 AND src <> dst")
def change_impact(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return graph.dependents(e, e.where("dst % 10 = 0").select(F.col("dst").alias("node"))).select(F.col("root").alias("changed"), F.col("node").alias("affected"))


STATUS = "t AS (SELECT o_custkey AS c, o_orderstatus AS s, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders)"


@query("status_cycles", f"""WITH RECURSIVE {STATUS}, e AS (SELECT DISTINCT s AS src, nx AS dst FROM t WHERE nx IS NOT NULL AND nx <> s), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
m AS (SELECT a.src AS node, min(least(a.src, a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM m""")
def status_cycles(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf}/orders.parquet")
    after = F.lead("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    e = o.select(F.col("o_orderstatus").alias("src"), after.alias("dst")).where("dst is not null and dst <> src").distinct()
    return graph.cycles(graph.closure(graph.on_cycles(e)))


@query("layer_boundary", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('ASIA', 'EUROPE')")
def layer_boundary(spark: SparkSession, sf: str) -> DataFrame:
    """Edges supplier to nation whose region is in no allowed layer; nations and regions are fixed small dimensions, broadcast by size."""
    t = lambda x: spark.read.parquet(f"{sf}/{x}.parquet")
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.where(~F.col("r_name").isin("ASIA", "EUROPE")).select("s_suppkey", "n_name", "r_name")
