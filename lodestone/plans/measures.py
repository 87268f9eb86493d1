"""Queries over measurements in time: regressions, churn, co-change, trends, retention, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import repository
from .registry import query


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


@query("bench_regression", """WITH b AS (SELECT event_type AS name, avg(value) FILTER (WHERE event_id % 2 = 0) AS base, avg(value) FILTER (WHERE event_id % 2 = 1) AS now FROM events GROUP BY 1)
SELECT name, round(base, 6) AS base, round(now, 6) AS now, round((now - base) * 100 / base, 6) AS growth FROM b WHERE base > 0""")
def bench_regression(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.col("event_id") % 2 == 1
    b = _events(spark, sf).groupBy(F.col("event_type").alias("name")).agg(F.avg(F.when(~odd, F.col("value"))).alias("b"), F.avg(F.when(odd, F.col("value"))).alias("n")).where("b > 0")
    return b.select("name", F.round("b", 6).alias("base"), F.round("n", 6).alias("now"), F.round((F.col("n") - F.col("b")) * 100 / F.col("b"), 6).alias("growth"))


@query("churn_hotspots", "SELECT user_id AS path, count(*) AS commits, count(*) FILTER (WHERE event_type = 'error') AS defects, round(sum(value), 4) AS churn FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error') >= 2")
def churn_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    by = _events(spark, sf).groupBy(F.col("user_id").alias("path")).agg(F.count(F.lit(1)).alias("commits"), F.count_if(F.col("event_type") == "error").alias("defects"), F.round(F.sum("value"), 4).alias("churn"))
    return by.where("defects >= 2")


@query("co_change", f"""WITH c AS (SELECT DISTINCT date_trunc('minute', ts) AS h, user_id AS u FROM events), s AS (SELECT h FROM c GROUP BY h HAVING count(*) <= {repository.MAX_FILES}),
p AS (SELECT a.u AS path, b.u AS partner, count(*) AS n FROM s JOIN c a USING (h) JOIN c b USING (h) WHERE a.u <> b.u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, partner) AS rank FROM p) SELECT path, partner, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def co_change(spark: SparkSession, sf: str) -> DataFrame:
    """Files changed in one commit (a minute). A commit of more than MAX_FILES files says nothing on what belongs together and goes, which bounds the pairs."""
    c = _events(spark, sf).select(F.date_trunc("minute", "ts").alias("commit"), F.col("user_id").alias("path")).distinct()
    return repository.co_change(c, least=1, k=3)


DAILY = "d AS (SELECT event_type AS key, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS score FROM events GROUP BY ALL)"


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("score"))


@query("score_trend", f"WITH {DAILY} SELECT key, day, score, score - lag(score) OVER (PARTITION BY key ORDER BY day) AS delta FROM d")
def score_trend(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf).withColumn("delta", F.col("score") - F.lag("score").over(Window.partitionBy("key").orderBy("day")))


@query("history_retention", f"WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day DESC) AS r FROM d) SELECT key, day, score FROM r WHERE r <= 5")
def history_retention(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("day")))
    return _daily(spark, sf).withColumn("r", rank).where("r <= 5").select("key", "day", "score")


@query("events_tumbling", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    by = _events(spark, sf).groupBy("event_type", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select("event_type", F.col("window.start").alias("start"), "n", "total")


@query("triage_latest", "SELECT user_id, event_type AS verdict, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def triage_latest(spark: SparkSession, sf: str) -> DataFrame:
    latest = F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("x")
    return _events(spark, sf).groupBy("user_id").agg(latest).select("user_id", F.col("x.event_type").alias("verdict"), F.col("x.ts").alias("ts"))
