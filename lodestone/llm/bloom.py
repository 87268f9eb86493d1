"""A pair of Bloom filters, `once` and `twice`, built in parallel and merged bit by bit.

The filters have a fixed number of bits, so what is broadcast never grows with the input. `twice` holds every value
that two additions have seen (and, rarely, others): once = a | b, twice = a2 | b2 | (a & b).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from . import spans

PIECE = 1 << 16
_U = np.uint64


def bits_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = _U(bits - 1)
    return (h & mask).astype(np.int64), ((h >> _U(32)) & mask).astype(np.int64)


def has(words: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(h), bool)
    for at in bits_of(h, bits):
        out &= (words[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out


def put(words: np.ndarray, h: np.ndarray, bits: int) -> None:
    for at in bits_of(h, bits):
        np.bitwise_or.at(words, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _build(values_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)  # zero pages cost memory once touched
        for batch in batches:
            for values in values_of(batch):
                distinct, counts = np.unique(values, return_counts=True)
                again = (counts > 1) | has(once, distinct, bits)
                put(twice, distinct[again], bits)
                put(once, distinct, bits)
        for k in range(0, len(once), PIECE):
            a, b = once[k : k + PIECE], twice[k : k + PIECE]
            if a.any():
                yield pa.RecordBatch.from_pydict(
                    {"piece": pa.array([k], pa.int64()), "once": pa.array([zlib.compress(a.tobytes(), 1)], pa.binary()), "twice": pa.array([zlib.compress(b.tobytes(), 1)], pa.binary())}
                )

    return task


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams over the pieces of all tasks; holds two arrays for each piece of the filter dealt to this task."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            once, twice = held.get(k, (None, None))
            held[k] = (a, b) if once is None else (once | a, twice | b | (once & a))
    for k, (_, twice) in held.items():
        if twice.any():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int64()), "twice": pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())})


def twice_seen(df: DataFrame, values_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int):
    """Broadcast pieces of the filter of 64-bit values that values_of() gives twice or more over all rows."""
    if bits & (bits - 1) or bits < PIECE * 8:
        raise ValueError("bits: a power of two, 524288 at least")
    spark = df.sparkSession
    parts = max(1, min(bits >> 19, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    merged = df.mapInArrow(_build(values_of, bits), "piece long, once binary, twice binary").repartition(parts, "piece").mapInArrow(_merge, "piece long, twice binary")
    return spark.sparkContext.broadcast([(r.piece, bytes(r.twice)) for r in merged.collect()])  # bits / 8 bytes at most


def _build_once(values_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            for values in values_of(batch):
                put(once, values, bits)
        for k in range(0, len(once), PIECE):
            if once[k : k + PIECE].any():
                packed = pa.array([zlib.compress(once[k : k + PIECE].tobytes(), 1)], pa.binary())
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int64()), "once": packed, "twice": packed})

    return task


def seen(df: DataFrame, values_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int):
    """Broadcast pieces of the filter of all values that values_of() gives."""
    spark = df.sparkSession
    parts = max(1, min(bits >> 19, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    merged = df.mapInArrow(_build_once(values_of, bits), "piece long, once binary, twice binary").repartition(parts, "piece").mapInArrow(_merge, "piece long, twice binary")
    return spark.sparkContext.broadcast([(r.piece, bytes(r.twice)) for r in merged.collect()])  # bits / 8 bytes at most


def load(pieces, bits: int) -> np.ndarray:
    words = np.zeros(bits >> 3, np.uint8)
    for k, piece in pieces.value:
        words[k : k + PIECE] = np.frombuffer(zlib.decompress(piece), np.uint8)
    return words


def key_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """For tables of one column of 64-bit hashes."""
    yield mixed(batch.column(0))


def mixed(column: pa.Array) -> np.ndarray:
    return spans.mix(column.to_numpy().view(_U))


def split(df: DataFrame, key: Column, pieces, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose key hash is surely not in a filter of key_hashes(), and those whose may be; both in the columns of `df`."""
    return _rows(df, key, pieces, bits, False), _rows(df, key, pieces, bits, True)


def maybe(df: DataFrame, key: Column, pieces, bits: int, then=None, shape: str | None = None) -> DataFrame:
    """The rows whose key hash may be in the filter, or what `then`, a function for mapInArrow, makes of them in the same Python worker: one worker a task, not two."""
    return _rows(df, key, pieces, bits, True, then, shape)


def _rows(df: DataFrame, key: Column, pieces, bits: int, wanted: bool, then=None, shape: str | None = None) -> DataFrame:
    name = "key hash"
    while name in df.columns:
        name += " "

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = load(pieces, bits) if words is None else words
            last = batch.num_columns - 1
            yield batch.filter(pa.array(has(words, mixed(batch.column(last)), bits) == wanted)).select(range(last))

    return df.select("*", key.alias(name)).mapInArrow((lambda batches: then(task(batches))) if then else task, shape or df.schema)
