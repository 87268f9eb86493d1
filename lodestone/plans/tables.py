"""Queries that compare two states of a table or match it against policies: contracts, moves, manifests, advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


BASE_HEAD = "base AS (SELECT p_partkey AS k, p_type AS sig FROM part WHERE p_partkey % 10 <> 1), head AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_type || '+' ELSE p_type END AS sig FROM part WHERE p_partkey % 10 <> 2)"


def _base_head(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("sig"))
    return p.where("k % 10 <> 1"), p.where("k % 10 <> 2").withColumn("sig", F.when(F.col("k") % 7 == 0, F.concat("sig", F.lit("+"))).otherwise(F.col("sig")))


@query("contract_breaking", f"WITH {BASE_HEAD} SELECT k AS symbol, CASE WHEN h.sig IS NULL THEN 'removed' ELSE 'changed' END AS change FROM base b LEFT JOIN head h USING (k) WHERE h.sig IS NULL OR h.sig <> b.sig")
def contract_breaking(spark: SparkSession, sf: str) -> DataFrame:
    b, h = _base_head(spark, sf)
    j = b.join(h.withColumnRenamed("sig", "new"), "k", "left")
    return j.where("new is null or new <> sig").select(F.col("k").alias("symbol"), F.when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


@query("signature_diff", f"WITH {BASE_HEAD} SELECT k AS symbol, b.sig AS old, h.sig AS new FROM base b FULL OUTER JOIN head h USING (k) WHERE b.sig IS DISTINCT FROM h.sig")
def signature_diff(spark: SparkSession, sf: str) -> DataFrame:
    b, h = _base_head(spark, sf)
    j = b.withColumnRenamed("sig", "old").join(h.withColumnRenamed("sig", "new"), "k", "full_outer")
    return j.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.col("k").alias("symbol"), "old", "new")


@query("move_pairs", """WITH d AS (SELECT p_brand AS b, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part WHERE p_partkey % 10 = 1),
a AS (SELECT p_brand AS b, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part WHERE p_partkey % 10 = 2) SELECT b AS basename, d.k AS deleted, a.k AS added FROM d JOIN a USING (b, r)""")
def move_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = _t(spark, sf, "part")
    side = lambda n, name: p.where(F.col("p_partkey") % 10 == n).select(F.col("p_brand").alias("basename"), F.col("p_partkey").alias(name), F.row_number().over(w).alias("r"))
    return side(1, "deleted").join(side(2, "added"), ["basename", "r"]).select("basename", "deleted", "added")


ADVISORIES = [("A-1", "Brand#1", "STANDARD", 10, 20), ("A-2", "Brand#2", "PROMO", 0, 15), ("A-3", "Brand#3", "ECONOMY", 30, 50)]


@query("advisory_match", "WITH adv(id, eco, pkg, lo, hi) AS (VALUES " + ", ".join(map(str, ADVISORIES)) + ") SELECT p_partkey, id, p_size AS version FROM part JOIN adv ON lower(left(p_brand, 7)) = lower(eco) AND lower(split_part(p_type, ' ', 1)) = lower(pkg) AND p_size >= lo AND p_size < hi")
def advisory_match(spark: SparkSession, sf: str) -> DataFrame:
    """Equi-join on lower-cased ecosystem and package; the version range is a residual. The advisory list is a literal table."""
    adv = spark.createDataFrame(ADVISORIES, "id string, eco string, pkg string, lo int, hi int").select("id", "lo", "hi", F.lower("eco").alias("e"), F.lower("pkg").alias("p"))
    parts = _t(spark, sf, "part").select("p_partkey", F.col("p_size").alias("version"), F.lower(F.left("p_brand", F.lit(7))).alias("e"), F.lower(F.split("p_type", " ")[0]).alias("p"))
    return parts.join(F.broadcast(adv), ["e", "p"]).where("version >= lo and version < hi").select("p_partkey", "id", "version")


@query("missing_lockfile", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 40)")
def missing_lockfile(spark: SparkSession, sf: str) -> DataFrame:
    locked = _t(spark, sf, "lineitem").where("l_quantity >= 40").select(F.col("l_partkey").alias("p_partkey"))
    return _t(spark, sf, "part").select("p_partkey").join(locked, "p_partkey", "left_anti")


@query("unpinned_dependencies", "SELECT p_partkey, p_name FROM part WHERE p_size < 5 AND p_retailprice < 1000")
def unpinned_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").where("p_size < 5 and p_retailprice < 1000").select("p_partkey", "p_name")


DAY = "date_trunc('day', o_orderdate)"


@query("oversized_diff", f"SELECT CAST({DAY} AS DATE) AS day, count(*) AS files, count(DISTINCT o_orderpriority) AS concerns, round(sum(o_totalprice), 2) AS size FROM orders GROUP BY 1 HAVING count(*) > 8 OR sum(o_totalprice) > 1500000")
def oversized_diff(spark: SparkSession, sf: str) -> DataFrame:
    by = _t(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("files"), F.countDistinct("o_orderpriority").alias("concerns"), F.sum("o_totalprice").alias("s"))
    return by.where("files > 8 or s > 1500000").select("day", "files", "concerns", F.round("s", 2).alias("size"))


@query("coverage_delta", "SELECT l_suppkey AS path, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS covered, (count(*) FILTER (WHERE l_returnflag = 'R') * 100) // count(*) AS pct FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 GROUP BY 1")
def coverage_delta(spark: SparkSession, sf: str) -> DataFrame:
    by = _t(spark, sf, "lineitem").where("l_linenumber between 2 and 4").groupBy(F.col("l_suppkey").alias("path")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("covered"))
    return by.withColumn("pct", F.expr("covered * 100 div total"))
