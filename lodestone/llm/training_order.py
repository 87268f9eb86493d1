"""Training-order materialisation: token sequences in a keyed random order, in shards of fixed stride.

Texts are encoded with a given byte-pair vocabulary and cut into sequences of `seq_len` ids (an end mark closes each
text; the last sequence is padded with it). Sequences are numbered 0 .. n-1 in input order: one pass counts each
task's sequences, and a second pass numbers them from the tasks' offsets. A Feistel network keyed by `seed` permutes the numbers; values
outside 0 .. n-1 walk along their cycle until they are inside, so every sequence has one global slot and every slot one
sequence. Range partitions of whole shards write `rows_per_shard` records of equal size to each file: slot s
is record s mod rows_per_shard of shard s div rows_per_shard, so a reader can start at any slot with one seek.

A task writes a shard under another name and renames it at its end, so a retried task leaves the same file.
"""

from __future__ import annotations

import base64
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans, workspace

_U = np.uint64
ROUNDS = 4
CHUNK = 8 << 20
#: The pre-tokenisation pattern that goes with the vocabulary: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZER_DIR = "/opt/tokenizers"


class Permutation:
    """A keyed bijection of 0 .. n-1."""

    def __init__(self, n: int, seed: int):
        self.n = n
        self.half = max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.keys = spans.mix(np.arange(1, ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed % (1 << 64)))

    def _feistel(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        h, mask = _U(self.half), _U((1 << self.half) - 1)
        left, right = x >> h, x & mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (spans.mix(left + key) & mask), left
            else:
                left, right = right, left ^ (spans.mix(right + key) & mask)
        return (left << h) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._feistel(np.asarray(x, dtype=_U), back)
        while (outside := out >= _U(self.n)).any():
            out[outside] = self._feistel(out[outside], back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


class _Pieces:
    """Texts cut before every single ASCII space between other ASCII characters that are no space. There the pattern always begins a new match, so
    pieces encode on their own, and equal pieces of a run of texts are encoded once."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        n = len(data)
        plain = (data < 0x80) & ~spans.SPACE[data]
        cut = np.zeros(n, bool)
        cut[1:-1] = (data[1:-1] == 0x20) & plain[:-2] & plain[2:]
        cut[at[at < n]] = True
        self.starts = np.flatnonzero(cut)
        self.ends = np.append(self.starts[1:], n)
        self.of_text = np.searchsorted(self.starts, at)
        size = self.ends - self.starts
        # the first and the last eight bytes and the length say all of a piece of sixteen; longer ones have a hash as well
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
        mask = np.where(size >= 8, ~_U(0), (_U(1) << (np.minimum(size, 7).astype(_U) * _U(8))) - _U(1))
        head, tail = words[self.starts] & mask, words[np.maximum(self.ends - 8, self.starts)] & mask
        key = spans.mix(head ^ spans.mix(tail + size.astype(_U) * _U(0x9E3779B97F4A7C15)))
        long = np.flatnonzero(size > 16)
        if len(long):
            offset = np.concatenate(([0], np.cumsum(size[long])))
            inside = data[_ranges(self.starts[long], size[long])]
            key[long] ^= spans.hash_spans(spans.BYTE_VALUE[inside], offset[:-1], offset[1:])
        self.code, kinds = pd.factorize(key)
        self.first = np.zeros(len(kinds), np.int64)
        self.first[self.code[::-1]] = np.arange(len(key))[::-1]
        rep = self.first[self.code]
        odd = np.flatnonzero((head != head[rep]) | (tail != tail[rep]) | (size != size[rep]))  # other pieces of one key
        self.code[odd] = len(kinds) + np.arange(len(odd))
        self.first = np.concatenate((self.first, odd))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Encoder:
    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.core = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.lengths = np.zeros(self.end, np.int64)
        self.lengths[list(ranks.values())] = [len(token) for token in ranks]
        self.kind = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<u4")

    def encode(self, data: np.ndarray, at: np.ndarray, count_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(at) - 1, np.int64)
        pieces = _Pieces(data, at)
        starts, ends = pieces.starts[pieces.first], pieces.ends[pieces.first]
        # pieces that begin with a space and end without one can stand in a row: one call encodes them all
        plain = (data < 0x80) & ~spans.SPACE[data]
        row = (ends - starts >= 2) & (data[starts] == 0x20) & plain[np.minimum(starts + 1, len(data) - 1)] & plain[ends - 1]
        ids = self.core.encode_to_numpy(data[_ranges(starts[row], (ends - starts)[row])].tobytes().decode(), disallowed_special=())
        reached = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum((ends - starts)[row])) + 1
        raw = data.tobytes()
        alone = [self.core.encode_ordinary(raw[a:b].decode()) for a, b in zip(starts[~row].tolist(), ends[~row].tolist(), strict=True)]
        size = np.zeros(len(row), np.int64)
        size[row] = np.diff(reached, prepend=0)
        size[~row] = np.fromiter(map(len, alone), np.int64, len(alone))
        by_piece = size[pieces.code]
        counts = spans.per_text(by_piece, pieces.of_text)
        if count_only:
            return np.zeros(0, self.kind), counts
        flat = np.concatenate((ids.astype(self.kind), np.fromiter(itertools.chain.from_iterable(alone), self.kind, int(size[~row].sum()))))
        offset = np.zeros(len(row), np.int64)
        offset[row] = np.cumsum(size[row]) - size[row]
        offset[~row] = len(ids) + np.cumsum(size[~row]) - size[~row]
        return flat[_ranges(offset[pieces.code], by_piece)], counts

    def records(self, data: np.ndarray, at: np.ndarray, seq_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The padded records of all texts, how many each has, and how many ids each has with its end mark."""
        ids, counts = self.encode(data, at)
        rows = sequences(counts, seq_len)
        out = np.full((int(rows.sum()), seq_len), self.end, self.kind)
        out.ravel()[_ranges((np.cumsum(rows) - rows) * seq_len, counts)] = ids
        return out, rows, counts + 1


def sequences(counts: np.ndarray, seq_len: int) -> np.ndarray:
    """How many records the ids of a text and an end mark fill."""
    return -(-(counts + 1) // seq_len)


_encoders: dict[bytes, Encoder] = {}


def _encoder(vocabulary) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if vocabulary.value not in _encoders:
        _encoders.clear()
        _encoders[vocabulary.value] = Encoder(vocabulary.value)
    return _encoders[vocabulary.value]


def _count(vocabulary, seq_len: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, n = None, 0
        for batch in batches:
            encoder = encoder or _encoder(vocabulary)
            for _, _, data, at in spans.chunked(batch.column(1), CHUNK):
                n += int(sequences(encoder.encode(data, at, count_only=True)[1], seq_len).sum())
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([n], pa.int64())})

    return task


def _number(vocabulary, offsets, seq_len: int, total: int, seed: int, rows_per_shard: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, pack = None, zstandard.ZstdCompressor(level=1)
        order = Permutation(total, seed)
        part = TaskContext.get().partitionId()
        begin, end = offsets.value.get(part, (0, 0))
        at = begin
        for batch in batches:
            encoder = encoder or _encoder(vocabulary)
            for low, high, data, offsets_of in spans.chunked(batch.column(1), CHUNK):
                records, rows, ids = encoder.records(data, offsets_of, seq_len)
                row = np.repeat(np.arange(low, high), rows)
                seq = _ranges(np.zeros(len(rows), np.int64), rows)
                sizes = np.minimum(seq_len, np.repeat(ids, rows) - seq * seq_len)
                slots = order.slots(np.arange(at, at + len(row)))
                at += len(row)
                packed = pa.array([pack.compress(r) for r in records], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(seq.astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(slots), pa.array(slots // rows_per_shard), packed],
                    names=["id", "seq", "n_tokens", "slot", "shard", "data"],
                )
        if at != end:
            raise RuntimeError(f"task {part} counted {end - begin} sequences and now has {at - begin}: the input changed between the passes")

    return task


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(folder: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, root = _file_system(folder)
        unpack = zstandard.ZstdDecompressor()
        attempt = TaskContext.get().taskAttemptId()
        shard, out, path = None, None, ""

        def close():
            if out is not None:
                out.close()
                store.move(f"{path}.{attempt}", path)

        for batch in batches:
            data, shards = batch.column(5), batch.column(4).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if shards[a] != shard:
                    close()
                    shard = int(shards[a])
                    path = f"{root}/shard-{shard:08d}.bin"
                    out = store.open_output_stream(f"{path}.{attempt}")
                out.write(b"".join(unpack.decompress(data[i].as_py()) for i in range(a, b)))
            yield batch.select(range(5))
        close()

    return task


def vocabulary_path(name: str = DEFAULT_VOCABULARY, folder: str = TOKENIZER_DIR) -> str:
    return f"{folder}/{name}"


def write_training_order(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, seq_len: int = 256, rows_per_shard: int = 16384, seed: int = 1
) -> DataFrame:
    """Write the shards into `folder` (one that all executors share) and return the index of all sequences.

    Returns (id, seq, n_tokens, slot, shard, record), one row for each sequence: `n_tokens` ids, with the end mark,
    are valid in record `record` of file shard-%08d.bin; record size is seq_len ids of two bytes (four for vocabularies of
    2^16 ids or more), little-endian. layout.json holds the parameters. A null text is an empty text: one sequence of
    an end mark. Every row counts, repeated or with a null id. An empty table writes no shard and gives an empty index. The
    numbering follows the input's files and rows, so equal input, settings and seed give equal shards. `vocabulary` is the
    path of a file of ranks, read on the driver. No other column of `docs` is read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = workspace.materialise(docs, "ordered")  # both passes must see the same rows in the same tasks
    with open(vocabulary or vocabulary_path(), "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    counted = docs.mapInArrow(_count(ranks, seq_len), "part int, n long").collect()  # a row for each task
    at, total = {}, 0
    for r in sorted(counted):
        at[r.part] = (total, total + r.n)
        total += r.n
    offsets = spark.sparkContext.broadcast(at)
    schema = f"id {kind}, seq int, n_tokens int, slot long, shard long"
    index = workspace.new_path(spark, "order-index")
    _make_folder(spark, folder)
    if total:
        numbered = docs.mapInArrow(_number(ranks, offsets, seq_len, total, seed, rows_per_shard), f"{schema}, data binary")
        # the ranges are known, so no sample of the input is taken to find them: each partition gets consecutive whole shards
        shards = -(-total // rows_per_shard)
        parts = min(shards, 20_000)
        ranged = numbered.repartitionById(parts, F.expr(f"cast(shard * {parts} div {shards} as int)")).sortWithinPartitions("slot")
        ranged.mapInArrow(_write(folder), schema).write.parquet(index)
    else:
        spark.createDataFrame([], schema).write.parquet(index)
    encoder = Encoder(ranks.value)
    _put_text(spark, f"{folder}/layout.json", json.dumps({"sequences": total, "seq_len": seq_len, "id_bytes": encoder.kind.itemsize, "rows_per_shard": rows_per_shard, "pad": encoder.end, "seed": seed}))
    return spark.read.schema(schema).parquet(index).withColumn("record", F.col("slot") % rows_per_shard).withColumnRenamed("id", id_col)


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def _put_text(spark: SparkSession, where: str, text: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_slots(folder: str, begin: int, end: int) -> Iterator[np.ndarray]:
    """The records of slots begin .. end-1 in order: a resumable sequential read with one seek in each shard."""
    store, root = _file_system(folder)
    with store.open_input_stream(f"{root}/layout.json") as f:
        layout = json.loads(f.read())
    kind = np.dtype(f"<u{layout['id_bytes']}")
    stride, per = layout["seq_len"] * kind.itemsize, layout["rows_per_shard"]
    end = min(end, layout["sequences"])
    while begin < end:
        shard, record = divmod(begin, per)
        n = min(end - begin, per - record)
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(record * stride)
            block = np.frombuffer(f.read(n * stride), kind).reshape(n, layout["seq_len"])
        yield from block
        begin += n
