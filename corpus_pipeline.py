"""Corpus pipeline: quality, near duplicates, benchmark leaks, mixing, training order.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents; the
last returns the index of the written sequences. Between stages the rows are written as Parquet and read again.
What a stage returns holds whole rows and is computed as it is written, so a stage lets its session hand a bounded
number of rows to Python workers at once, and that stays so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bloom, decontaminate, mixing, ngram_join, quality_crf, training_order
from lodestone.llm.queries import MIX
from lodestone.llm.workspace import bound_batches, materialise, new_path, table

ID_FILTER_BITS = 1 << 26


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the line classifier rejects go. A null or empty text is one empty line and is judged as that; ids, repeated or null, play no part."""
    bound_batches(spark)
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share four fifths of their five-word shingles are linked. Of each group the one with the smallest id stays.

    Rows that repeat an id stay or go together; rows with a null id, a null text or no word link with nothing and stay.
    """
    bound_batches(spark)
    groups = ngram_join.ngram_jaccard_components(docs, width=5, percent=80)
    gone = materialise(groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "gone")
    pieces = bloom.seen(gone.select(F.xxhash64("doc_id").alias("h")), bloom.key_hashes, ID_FILTER_BITS)
    sure, maybe = bloom.split(docs, F.xxhash64("doc_id"), pieces, ID_FILTER_BITS)  # only rows that may go are shuffled
    return sure.unionByName(maybe.join(gone, "doc_id", "left_anti").select(*docs.columns))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a word in twenty, or more, inside benchmark windows go; the others lose the words inside such windows.

    Each row is judged by its own text, whatever its id (also if null or repeated). A null text has no words and stays.
    """
    bound_batches(spark)
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    found = decontaminate.scan_benchmark(rows, table(spark, sf_dir, "benchmark"), id_col="row", cut=True).where(~decontaminate.contaminated())
    new = {c: F.col("row")[c] for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in new:
        new["n_chars"] = F.when(F.col("n_hit") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return found.select(*[new[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat or go so that languages hold their shares of the tokens. Rows without tokens take their cell's rate; rows of one id and text repeat alike."""
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"), MIX)


def training(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order, in shards; the index of all sequences. Every row counts; a null or empty text is one sequence of an end mark."""
    bound_batches(spark)
    return training_order.write_training_order(docs, new_path(spark, "shards"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", leaks), ("mixing sources to target weights", mix), ("token-ID / binary output", training)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", ""))
    return STAGES[-1][1](spark, docs, sf_dir)
