"""Where intermediate tables go: the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session that names none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows that go to a Python worker at once while an intermediate table is made: rows hold whole texts, and pairs two of them.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on the session hands Python workers at most BATCH_ROWS rows at once, also while a caller writes what an operator returned."""
    now = int(spark.conf.get(BATCH_SETTING))
    spark.conf.set(BATCH_SETTING, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(BATCH_SETTING)
    bound_batches(spark)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete the files behind a materialised table."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
