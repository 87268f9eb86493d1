"""Bounded training samples: so many rows of each class, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(divisor))


def held_out(id_col: Column, divisor: int, value: int) -> Column:
    """A row with a null id is not held out; it is never learned from either, as it has no label."""
    return F.coalesce(remainder(id_col, divisor) == value, F.lit(False))


def short_enough(known: DataFrame, docs: DataFrame, max_chars: int) -> DataFrame:
    """(id, label) of the labelled documents whose text has at most max_chars characters. Raises if a class has only longer ones."""
    sized = known.join(docs.select("id", F.length("text").alias("size")), "id")
    lost = [r.label for r in sized.groupBy("label").agg(F.min("size").alias("least")).where(F.col("least") > max_chars).collect()]
    if lost:
        raise ValueError(f"no labelled text of at most {max_chars} characters for {sorted(lost)}")
    return sized.where(F.col("size") <= max_chars).select("id", "label")


def sample_ids(labelled: DataFrame, per_class: int) -> DataFrame:
    """(id, label) of `per_class` rows of each label, or all if there are fewer: those of the smallest hashes.

    Rows are counted first; then only rows below a hash that some twice per_class of a label lie below are ranked, so no group is large.
    """
    own = labelled.where("id is not null and label is not null").select("id", "label").distinct()
    sizes = own.groupBy("label").agg(F.count(F.lit(1)).alias("n"))  # one row for each label
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    bound = F.when(F.col("n") <= 2 * per_class + 100, F.lit(1 << 40)).otherwise(((2 * per_class + 100) * float(1 << 40) / F.col("n")).cast("long"))
    few = own.join(F.broadcast(sizes), "label").where(h < bound)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(h, "id"))
    return few.withColumn("rank", rank).where(F.col("rank") <= per_class).select("id", "label")


def texts_of(docs: DataFrame, ids: DataFrame, max_chars: int) -> list[tuple[str, object]]:
    """The sampled texts with their labels, on the driver: bounded by the sample's size and max_chars. Longer texts are left out; of a repeated id the least text counts."""
    found = docs.where(F.length("text") <= max_chars).join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.label) for r in sorted(found, key=lambda r: (str(r.id), r.text))]
