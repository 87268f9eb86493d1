"""Keyed score histories that keep their last entries: of scores, rule statistics and waiver audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How many entries a key keeps, by kind of history.
KEEP = {"slop": 50, "performance": 50, "legibility": 50, "rule_stats": 100, "waiver_audit": 100}


def trimmed(history: DataFrame, key: list[str], time: str, keep: int) -> DataFrame:
    """The last `keep` entries of each key. Entries of one key and time are one: the last by all other columns."""
    others = sorted(set(history.columns) - {*key, time})
    one = history.groupBy(*key, time).agg(F.max(F.struct(*others)).alias("x")).select(*key, time, *(F.col(f"x.{c}") for c in others))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(time)))
    return one.withColumn("rank of entry", rank).where(F.col("rank of entry") <= keep).drop("rank of entry").select(*history.columns)


def append(spark: SparkSession, new: DataFrame, path: str, kind: str, key: list[str], time: str = "at") -> DataFrame:
    """Add entries to the history at `path`, trim it and return it. The new state is written beside the old one before it takes its place."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at, beside = fs_path(path), fs_path(path + ".next")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = spark.read.schema(new.schema).parquet(path).unionByName(new) if fs.exists(at) else new
    trimmed(whole, key, time, KEEP[kind]).write.mode("overwrite").parquet(path + ".next")
    fs.delete(at, True)
    fs.rename(beside, at)
    return spark.read.schema(new.schema).parquet(path)


def with_delta(history: DataFrame, key: list[str], value: str, time: str = "at") -> DataFrame:
    """Each entry's previous value and the change since."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(time))
    return history.withColumn("previous", before).withColumn("delta", F.col(value) - F.col("previous"))


def latest(history: DataFrame, key: list[str], time: str = "at") -> DataFrame:
    """The last entry of each key, as of now."""
    others = [c for c in history.columns if c not in key]
    return history.groupBy(*key).agg(F.max_by(F.struct(*others), F.col(time)).alias("x")).select(*key, *(F.col(f"x.{c}") for c in others))


def merge_cache(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A scan cache by key: new entries take the place of old ones."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def stale(files: DataFrame, cache: DataFrame, config_hash: str) -> DataFrame:
    """The files to scan again: those that no cache entry of equal content and settings covers."""
    known = cache.where(F.col("config_hash") == config_hash).select("section", "path", "sha256")
    return files.join(known, [c for c in ("section", "path", "sha256") if c in files.columns], "left_anti")
