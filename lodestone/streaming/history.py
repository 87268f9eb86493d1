"""Secrets in a growing log: log files arrive in a folder, each is scanned once, and a secret is reported once.

Every file is one log (as `git log -p -U0` prints it). A batch of files is parsed with windows inside each file, scanned, and findings whose rule,
path and masked value are known already are dropped by an anti-join with what was found before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.secrets import Settings, first_seen, scan_secrets
from ..sources.repository import added_lines

KEY = ["rule_id", "path", "message"]


def log_lines(files: DataFrame) -> DataFrame:
    """(log, ordinal, text) of whole log files (value, name)."""
    return files.select(F.col("name").alias("log"), F.posexplode(F.split("value", "\n")).alias("ordinal", "text"))


def findings_of(log: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(rule_id, path, message, severity, confidence, line, commit): secrets that the log's commits added, the newest of each."""
    added = added_lines(log)
    place = F.concat_ws("\x00", "commit", "path")
    scanned = scan_secrets(added.select(place.alias("path"), "line", "line_text"), settings).withColumnRenamed("path", "place")
    orders = added.select(place.alias("place"), "line", "order").distinct()
    parts = F.split("place", "\x00")
    placed = scanned.join(orders, ["place", "line"]).select("rule_id", parts[1].alias("path"), "message", "severity", "confidence", "line", parts[0].alias("commit"), "order")
    return first_seen(placed)


def watch(spark: SparkSession, folder: str, store: str, checkpoint: str, settings: Settings = Settings(), once: bool = True) -> StreamingQuery:
    """Scan log files as they arrive in `folder` and append new findings to the Parquet table `store`. A batch that is run again adds nothing twice."""
    arrived = spark.readStream.format("text").option("wholetext", True).load(folder).select("value", F.col("_metadata.file_path").alias("name"))

    def batch(files: DataFrame, number: int) -> None:
        found = findings_of(log_lines(files), settings).withColumn("batch", F.lit(number))
        known = _known(spark, store)
        fresh = found if known is None else found.join(known.where(F.col("batch") != number).select(*KEY).distinct(), KEY, "left_anti")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)

    writer = arrived.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _known(spark: SparkSession, store: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(store) if fs.exists(path) and fs.listStatus(path) else None


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window of an event stream; events later than `late` are not waited for. An extension."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), "n")
