"""Substring deduplication over sliding spans of sentences.

A sentence ends at a line break, at . ! ? before white space (closing quotes or brackets may stand between), or at the full
stops of ideographic scripts. Every run of `min_sentences` consecutive sentences is a span, so any longer repeated run is covered by
spans; so that passages of few but long sentences count too, shorter runs of `long_words` words or more are spans as well, and so is
the whole of a text of fewer sentences that has `min_words` words. Spans are hashed by their words, with two hashes of 64
bits that share nothing. A twice-seen Bloom filter keeps spans seen once out of the shuffle; the rest are counted with
partial sums, joined with their first occurrence (by id, text hash, position), and every sentence covered by a span
that is not the first of its kind is removed. Only documents that may lose something are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, spans, workspace

_U = np.uint64
STOP = np.zeros(256, bool)
STOP[[0x21, 0x2E, 0x3F]] = True
CLOSER = np.zeros(256, bool)
CLOSER[[0x22, 0x27, 0x29, 0x5D]] = True
#: The last three bytes of the ideographic full stop and the full-width ! and ?: fixed values.
WIDE_STOPS = ((0xE3, 0x80, 0x82), (0xEF, 0xBC, 0x81), (0xEF, 0xBC, 0x9F))
FILTER_BITS = 1 << 28
ID_FILTER_BITS = 1 << 26
OTHER_BYTE_VALUE = spans.mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95) + _U(0x2545F4914F6CDD1D))


def _breaks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes that end a sentence."""
    n = len(data)
    open_after = np.ones(n + 2, bool)
    open_after[:n] = spans.SPACE[data]
    open_after[at] = True  # a text's end, seen from its last byte, is the first byte of the next text
    closes = np.zeros(n + 1, bool)
    closes[:n] = CLOSER[data]
    closes[at] = False
    out = STOP[data] & (open_after[1 : n + 1] | (closes[1 : n + 1] & open_after[2 : n + 2]))
    for a, b, c in WIDE_STOPS:
        out[2:] |= (data[2:] == c) & (data[1:-1] == b) & (data[:-2] == a)
    return out | (data == 0x0A)


def sentences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all sentences (each with the stops and, up to the next word, the space behind it), and each text's first."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_breaks(data, at)
    before = np.concatenate(([False], inside[:-1]))
    before[at[at < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    # a piece of white space between stops belongs to the sentence before it
    solid = np.flatnonzero(spans.NON_SPACE[data] & ~STOP[data])
    edges = np.append(starts, len(data))
    has_word = np.searchsorted(solid, edges[1:]) > np.searchsorted(solid, edges[:-1])
    starts = starts[has_word]
    return starts, np.searchsorted(starts, at)


class _Spans:
    """Spans of the texts in a run of bytes: sentence range, text and two hashes of each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, rule: tuple[int, int, int]):
        min_sentences, min_words, long_words = rule
        self.starts, self.first = sentences(data, at)
        self.data = data
        # words end at white space, and where a sentence of a script without spaces ends
        self.word_starts, self.word_ends, _ = spans.word_spans(data, np.union1d(at, self.starts), spans.NON_SPACE)
        n = len(self.starts)
        text = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        before = np.searchsorted(self.word_starts, self.starts)
        word_first = np.searchsorted(self.word_starts, at)
        last = np.append(text[1:] != text[:-1], True) if n else np.zeros(0, bool)
        ends_word = np.where(last, word_first[text + 1], np.append(before, 0)[1:])
        begin, end = [], []
        index = np.arange(n)
        count = np.diff(self.first)[text] if n else index
        for k in range(1, min_sentences + 1):
            i = index[index + k <= self.first[text + 1]]
            words = ends_word[i + k - 1] - before[i]
            if k < min_sentences:
                i = i[(words >= long_words) | ((count[i] == k) & (words >= min_words))]
            begin.append(i)
            end.append(i + k)
        self.begin, self.end = np.concatenate(begin), np.concatenate(end)
        self.text = text[self.begin]
        self.low, self.high = before[self.begin], ends_word[self.end - 1]
        self.h1 = spans.hash_spans(spans.word_hashes(data, self.word_starts, self.word_ends), self.low, self.high)

    def second(self, which: np.ndarray) -> np.ndarray:
        values = spans.hash_spans(OTHER_BYTE_VALUE[spans.LOWER[self.data]], self.word_starts, self.word_ends)
        return spans.hash_spans(values, self.low[which], self.high[which])


def _span_hashes(rule: tuple[int, int, int]):
    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, at in spans.chunked(batch.column(1)):
            yield _Spans(data, at, rule).h1

    return values


def _suspects(pieces, rule: tuple[int, int, int]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = bloom.load(pieces, FILTER_BITS) if words is None else words
            for low, _, data, at in spans.chunked(batch.column(1)):
                s = _Spans(data, at, rule)
                again = np.flatnonzero(bloom.has(words, s.h1, FILTER_BITS))
                row = pa.array(s.text[again] + low)
                offset = s.begin[again] - s.first[s.text[again]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(2).take(row), pa.array(s.h1[again].view(np.int64)), pa.array(s.second(again).view(np.int64)), pa.array(offset.astype(np.int32)), pa.array((s.end - s.begin)[again].astype(np.int32))],
                    names=["id", "th", "h1", "h2", "pos", "size"],
                )

    return task


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text, cuts = batch.columns
        text = pc.fill_null(text, "")
        total, removed = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        mask = np.asarray(pc.is_valid(cuts).to_numpy(zero_copy_only=False))
        new = []
        for low, high, data, at in spans.chunked(text):
            starts, first = sentences(data, at)
            total[low:high] = np.diff(first)
            for row in np.flatnonzero(mask[low:high]):
                own = starts[first[row] : first[row + 1]]
                gone = np.zeros(len(own), bool)
                for c in cuts[low + int(row)].as_py():
                    gone[c["pos"] : c["pos"] + c["size"]] = True
                removed[low + row] = gone.sum()
                edges = np.append(own, at[row + 1])
                kept = [data[at[row] : own[0]].tobytes()] if len(own) else [data[at[row] : at[row + 1]].tobytes()]
                kept += [data[edges[i] : edges[i + 1]].tobytes() for i in np.flatnonzero(~gone)]
                new.append(b"".join(kept).decode("utf-8"))
        if new:
            text = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
        yield pa.RecordBatch.from_arrays([ids, text, pa.array(total), pa.array(removed)], names=["id", "text", "n_sentences", "n_removed"])


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 3, min_words: int = 10, long_words: int = 40) -> DataFrame:
    """Remove sentences covered by a repeated span that is not the first of its kind.

    Returns (id, text, n_sentences, n_removed, repeats_of), one row for each input row; repeats_of lists the ids of the
    documents that hold the first occurrences (its own id for a repeat within the document). Words compare without
    regard to A-Z case; white space between them does not count. Null texts are empty texts and have no sentence. Rows
    that repeat an id with other texts are documents of their own; equal rows are one document and fare alike, so they
    all stay if no other row holds their spans first. Rows with a null id take part: null orders before all ids. Of equal
    spans the one with the least id, then text hash, then position stays. An empty table gives an empty table; other
    columns of `docs` are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rule = (min_sentences, min_words, long_words)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    pieces = bloom.twice_seen(docs, _span_hashes(rule), FILTER_BITS)
    suspects = workspace.materialise(docs.mapInArrow(_suspects(pieces, rule), f"id {kind}, th long, h1 long, h2 long, pos int, size int"), "spans")
    firsts = suspects.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "pos")).alias("origin"), F.max(F.struct("id", "th", "pos")).alias("last")).where("not origin <=> last").drop("last")
    firsts = workspace.materialise(firsts, "firsts")  # as a table, so that the join can split a hot span's rows
    later = suspects.join(firsts, ["h1", "h2"]).where(~F.struct("id", "th", "pos").eqNullSafe(F.col("origin")))
    cuts = later.groupBy("id", "th").agg(F.collect_set(F.struct("pos", "size")).alias("cuts"), F.array_sort(F.collect_set("origin.id")).alias("repeats_of"))
    cuts = workspace.materialise(cuts.withColumnsRenamed({"id": "cut_id", "th": "cut_th"}), "cuts")
    touched = bloom.seen(cuts.select(F.xxhash64("cut_id", "cut_th").alias("h")), bloom.key_hashes, ID_FILTER_BITS)
    sure, maybe = bloom.split(docs, F.xxhash64("id", "th"), touched, ID_FILTER_BITS)
    shape = f"id {kind}, text string, cuts array<struct<pos:int,size:int>>, repeats_of array<{kind}>"
    none = [F.lit(None).cast(x.split(" ", 1)[1]).alias(x.split(" ", 1)[0]) for x in shape.split(", ")[2:]]
    joined = maybe.join(cuts, maybe["id"].eqNullSafe(cuts["cut_id"]) & (maybe["th"] == cuts["cut_th"]), "left").select("id", "text", "cuts", "repeats_of")
    rewrite = lambda df: df.mapInArrow(_with_last(_rewrite), f"id {kind}, text string, n_sentences long, n_removed long, repeats_of array<{kind}>")
    rewritten = rewrite(sure.select("id", "text", *none)).unionByName(rewrite(joined))
    return rewritten.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_sentences", "n_removed", F.coalesce("repeats_of", F.array().cast(f"array<{kind}>")).alias("repeats_of"))


def _with_last(task):
    """Run a task on all columns but the last, which goes along unchanged."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            for out in task(iter([batch.select(range(n - 1))])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(n - 1)], names=[*out.schema.names, batch.schema.names[n - 1]])

    return wrapped
