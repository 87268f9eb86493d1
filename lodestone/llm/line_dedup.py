"""Line deduplication with two Bloom filters.

1. Every task hashes its lines into two filters: `once` (seen) and `twice` (seen again in another document). The
   filters of tasks merge bit by bit: once = a | b, twice = a2 | b2 | (a & b). All bits of a line that two tasks
   have seen are in both `once` filters, so `twice` misses no repeated line; it may only suspect too many.
2. Only suspected lines are shuffled, as SHA-256 keys, and counted exactly by distinct documents. Partial sums
   are made before the shuffle, so a line that a third of the corpus holds costs one row a task.
3. Each document gets the list of its own keys to drop and is rewritten.

The filters have a fixed size (`bits`), whatever the input: what is broadcast does not grow. More input fills
them and lets more lines through as suspects; the exact count still decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, spans


def _line_keys(data: np.ndarray, at: np.ndarray):
    """Spans of stripped lines, their hashes, and each text's first line."""
    starts, ends, first = spans.line_spans(data, at)
    low, high = spans.strip_spans(data, starts, ends)
    return starts, ends, low, high, spans.word_hashes(data, low, high), first


def _distinct_in_texts(h: np.ndarray, full: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hashes of non-empty lines, one for each text that holds it."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[full]
    h = h[full]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new]


def _line_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, _, data, at in spans.chunked(batch.column(1)):
        _, _, low, high, h, first = _line_keys(data, at)
        yield _distinct_in_texts(h, high > low, first)


def _digest(data: np.ndarray, low: int, high: int) -> bytes:
    return hashlib.sha256(spans.LOWER[data[low:high]].tobytes()).digest()


def _suspects(pieces, bits: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = bloom.load(pieces, bits)
        for batch in batches:
            for low_row, _, data, at in spans.chunked(batch.column(1)):
                _, _, low, high, h, first = _line_keys(data, at)
                hits = np.flatnonzero((high > low) & bloom.has(twice, h, bits))
                if not len(hits):
                    continue
                text = np.searchsorted(first, hits, "right") - 1
                seen: dict[tuple[int, bytes], int] = {}
                for t, i in zip(text.tolist(), hits.tolist(), strict=True):
                    seen.setdefault((t, _digest(data, low[i], high[i])), i - int(first[t]))
                rows = [t for t, _ in seen]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r + low_row for r in rows])), pa.array([k for _, k in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())],
                    names=["id", "key", "line"],
                )

    return task


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text, drops = batch.columns
        text = pc.fill_null(text, "")
        lines = pc.add(pc.cast(pc.count_substring(text, "\n"), pa.int64()), 1)
        dropped = np.zeros(len(text), np.int64)
        mask = np.asarray(pc.is_valid(drops).to_numpy(zero_copy_only=False))
        new = []
        for row in np.flatnonzero(mask):
            data, at = spans.text_buffers(text.slice(int(row), 1))
            starts, ends, low, high, _, _ = _line_keys(data, at)
            # a keep position >= 0 spares that one line (first occurrence)
            spare = {(d["key"]): d["keep"] for d in drops[int(row)].as_py()}
            kept, raw = [], data.tobytes()
            for i in range(len(starts)):
                key = _digest(data, low[i], high[i]) if high[i] > low[i] else None
                if key is None or key not in spare or spare[key] == i:
                    kept.append(raw[starts[i] : ends[i]])
            dropped[row] = len(starts) - len(kept)
            new.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
        if new:
            text = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
        yield pa.RecordBatch.from_arrays([ids, text, lines, pa.array(dropped)], names=["id", "text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep: str = "none", bits: int = 1 << 27) -> DataFrame:
    """Drop the lines whose key is in at least `min_docs` documents.

    A line's key is the line without white space at its ends and with A-Z lower-cased. keep="none" drops every such
    line; keep="first" spares the first line (by id, then position). Returns (id, text, n_lines, n_dropped), one row
    for each input row; other columns of `docs` are not read. A null or empty text is one empty line; an empty key
    is never dropped. Rows that repeat an id count as one document and lose the same keys; rows with a null id
    count as one document together. An empty table gives an empty table.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep: none or first")
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = bloom.twice_seen(docs, _line_hashes, bits)
    suspects = docs.mapInArrow(_suspects(pieces, bits), f"id {kind}, key binary, line long")
    in_docs = suspects.groupBy("key", "id").agg(F.min("line").alias("line"))
    least = F.min(F.struct("id", "line")).alias("least") if keep == "first" else F.lit(None).cast(f"struct<id:{kind},line:bigint>").alias("least")
    frequent = in_docs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *([least] if keep == "first" else [])).where(F.col("n") >= min_docs)
    if keep != "first":
        frequent = frequent.withColumn("least", least)
    spare = F.when(F.col("least.id").eqNullSafe(F.col("id")) & F.col("least.line").isNotNull(), F.col("least.line")).otherwise(F.lit(-1))
    drops = in_docs.join(frequent.select("key", "least"), "key").groupBy("id").agg(F.collect_list(F.struct("key", spare.alias("keep"))).alias("drops"))
    drops = drops.withColumnRenamed("id", "drop_id")
    joined = docs.join(drops, docs["id"].eqNullSafe(drops["drop_id"]), "left").select("id", "text", "drops")
    return joined.mapInArrow(_rewrite, f"id {kind}, text string, n_lines long, n_dropped long").withColumnRenamed("id", id_col)
