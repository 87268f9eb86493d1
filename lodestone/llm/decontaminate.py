"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over all training texts.

Benchmark items are cut into windows of `width` words. The driver turns blocks of about `block_chars` characters of items into
sorted arrays: the windows' 64-bit hashes (each window once), the items that hold each, and the items' words to compare
with. A task computes the hash of every window of a text with array operations, looks it up, and compares the words of each hash hit with the
benchmark's words, so a hit is never a collision. If there are several blocks, a task holds one at a time: what it holds does not grow with the
benchmark. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import spans

_U = np.uint64
MAP_BITS = 20
OTHER = _U(0x9FB21C651E98DF25)


class _Words:
    """Words of a run of texts, their hashes, and their bytes with one space after each."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data = spans.LOWER[data]
        self.starts, self.ends, self.first = spans.word_spans(self.data, at, spans.ALNUM)
        self.values = spans.word_hashes(data, self.starts, self.ends)

    def windows(self, begin: np.ndarray, size: int) -> np.ndarray:
        return spans.hash_spans(self.values, begin, begin + size)

    def same(self, i: int, other: _Words, j: int, size: int) -> bool:
        """Whether `size` words from i on are those of the other from j on."""
        a, b, c, d = self.starts[i : i + size], self.ends[i : i + size], other.starts[j : j + size], other.ends[j : j + size]
        if (b - a != d - c).any():
            return False
        return all((self.data[p:q] == other.data[r:s]).all() for p, q, r, s in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True))


class Index:
    """Windows of one block of items. For each window length: a bit map, the hashes in order, a place of each in the items' words, and the items that have it."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.names = [item for item, _ in items]
        data, at = spans.text_buffers(pa.array([text for _, text in items], pa.string()))
        self.words = _Words(data, at)
        count = np.diff(self.words.first)
        size_of = np.minimum(count, width)
        self.by_length = []
        for size in np.unique(size_of[size_of > 0]).tolist():
            begin = spans.window_starts(self.words.first, size)
            item = np.searchsorted(self.words.first, begin, "right") - 1
            begin, item = begin[size_of[item] == size], item[size_of[item] == size]
            h = self.words.windows(begin, size)
            order = np.lexsort((item, h))
            h, begin, item = h[order], begin[order], item[order]
            # windows of one hash and other words (by a second hash of the same words) are kept apart
            second = spans.hash_spans(spans.mix(self.words.values ^ OTHER), begin, begin + size)
            order = np.lexsort((item, second, h))
            h, second, begin, item = h[order], second[order], begin[order], item[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (second[1:] != second[:-1])))
            heads = np.append(np.flatnonzero(new), len(h))
            seen = np.zeros(1 << MAP_BITS, bool)
            seen[(h >> _U(64 - MAP_BITS)).astype(np.int64)] = True
            self.by_length.append((size, seen, h[new], begin[new], heads, item))

    def scan(self, w: _Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are inside a window, and for each text with a window the items."""
        delta = np.zeros(len(w.starts) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for size, seen, hashes, places, heads, owners in self.by_length:
            begin = spans.window_starts(w.first, size)
            if not len(begin):
                continue
            h = w.windows(begin, size)
            maybe = np.flatnonzero(seen[(h >> _U(64 - MAP_BITS)).astype(np.int64)])
            at = np.searchsorted(hashes, h[maybe])
            found = hashes[np.minimum(at, len(hashes) - 1)] == h[maybe]
            for i, k in zip(begin[maybe[found]].tolist(), at[found].tolist(), strict=True):
                value = hashes[k]
                while k < len(hashes) and hashes[k] == value:
                    if w.same(i, self.words, int(places[k]), size):
                        delta[i] += 1
                        delta[i + size] -= 1
                        text = int(np.searchsorted(w.first, i, "right")) - 1
                        items.setdefault(text, set()).update(self.names[o] for o in owners[heads[k] : heads[k + 1]].tolist())
                    k += 1
        return np.cumsum(delta)[:-1] > 0, items


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _indices(blocks: list) -> Iterator[Index]:
    """One block after another; of several, none stays in memory after its turn."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)


def _without(data: np.ndarray, w: _Words, low: int, high: int, runs: list[tuple[int, int]]) -> str:
    raw, kept, last = data, [], low
    for a, b in runs:
        kept.append(raw[last : w.starts[a]].tobytes())
        last = int(w.ends[b - 1])
    return b"".join([*kept, raw[last:high].tobytes()]).decode()


def _scan(blocks: list, cut: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            words, hits, items = np.zeros(n, np.int64), np.zeros(n, np.int64), [[] for _ in range(n)]
            changed: dict[int, str] = {}
            for low, high, data, at in spans.chunked(batch.column(1)):
                w = _Words(data, at)
                hit = np.zeros(len(w.starts), bool)
                for index in _indices(blocks):
                    more, found = index.scan(w)
                    hit |= more
                    for t, ids in found.items():
                        items[low + t] += ids
                words[low:high] = np.diff(w.first)
                hits[low:high] = spans.per_text(hit, w.first)
                if cut:
                    for t in np.flatnonzero(hits[low:high]).tolist():
                        first = int(w.first[t])
                        runs = [(a + first, b + first) for a, b in _runs(hit[first : w.first[t + 1]])]
                        changed[low + t] = _without(data, w, int(at[t]), int(at[t + 1]), runs)
            columns = [batch.column(0), pa.array(words), pa.array(hits), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))]
            names = ["id", "n_words", "n_hit", "items"]
            if cut:
                text = batch.column(1)
                if changed:
                    rows = np.zeros(n, bool)
                    rows[list(changed)] = True
                    text = pc.replace_with_mask(text, pa.array(rows), pa.array([changed[r] for r in sorted(changed)], text.type))
                columns.insert(1, text)
                names.insert(1, "text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return task


def scan_benchmark(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, cut: bool = False, block_chars: int = 4_000_000
) -> DataFrame:
    """Find benchmark windows in training texts.

    Words are runs of digits, letters a-z after lower-casing A-Z, and non-ASCII code points. A window is `width`
    consecutive words of an item, or the whole of a shorter item. Returns one row for each input row: id, n_words,
    n_hit (words inside any window), items (distinct ids as strings, sorted); with cut=True also text without the
    hit words. A null text has no words and, cut, stays null. Items with a null id or no words match nothing; items that share a
    window, or repeat an id, all count. Repeated rows are scanned each for itself; empty tables give no hits or no rows. No other
    column of either table is read. Blocks hold about `block_chars` characters; an item longer than that makes a longer block.
    """
    spark = docs.sparkSession
    # the id may be a whole row: its type goes as it is, as names of any kind do not survive being written and read
    shape = StructType([StructField("id", docs.schema[id_col].dataType), *([StructField("text", StringType())] if cut else []), StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType()))])
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()["chars"]
    n = max(1, -(-int(size) // block_chars))
    blocks = []
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        blocks.append(spark.sparkContext.broadcast(Index([(r.item, r.text) for r in part.collect()], width)))  # about block_chars characters
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = source.mapInArrow(_scan(blocks, cut), shape)
    return found.select(F.col("id").alias(id_col), *([F.col("text").alias(text_col)] if cut else []), "n_words", "n_hit", "items")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """One word in twenty, or more, lies in a benchmark window."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
