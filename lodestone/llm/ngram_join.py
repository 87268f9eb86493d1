"""Exact n-gram Jaccard join: prefix filters under several global token orders, then verification.

1. One pass gives every document's set size and a 128-bit signature of its set; documents with equal sets collapse to
   one representative each. The same pass counts shingles in a fixed-size table of counters, which orders
   shingles by rough frequency (rare first). Any function of the shingle is a valid global order; this one keeps
   passages that many documents share out of the prefixes.
2. Two sets with Jaccard >= t share a shingle in their prefixes of n - ceil(t n) + 1 under *every* global order, and
   l shingles in prefixes that are l - 1 longer. The first order (frequency class, then hash 1) makes the index: only
   shingles that two prefixes hold stay. The second and third orders (l = n / 10) filter its candidates, both at once, by
   32 bits of each shingle; shingles of one prefix that are equal in those bits count as shared, so no pair is lost.
3. Round one compares each document with the centres of its index shingles (the two it shares most of them with), so
   a group of thousands of near copies costs two pairs a document. Components come from star contraction.
4. Round two looks at the shingles whose holders are still in different components.
   a. A document of which too many shingles are in no other open document links with none: it goes. A quarter of the shingles tells
      for most, then all of them for the rest.
   b. The rest is compared with the centre of each open shingle. For a centre c write x = c - R + A, w = 100 |R| + p |A|.
      Then x and y link if and only if (100 + p) (|Rx & Ry| + |Ax & Ay|) >= wx + wy - (100 - p) |c|. Both link with c
      unless one of the two is beyond (100 - p) |c|, so beyond that the *differences* must overlap, by more than half of the lesser: a prefix
      filter over the differences (rarest first) finds such pairs, and most of its candidates are decided inside the join.
   c. Holders that share less than half of a centre have long differences; those meet directly, through the filters of step 2.
   Every pair that links is in (b) or (c) for any index shingle it shares, so no link is lost.

Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, spans, workspace
from .components import connected_components

_U = np.uint64
COUNTER_BITS = 21
ID_FILTER_BITS = 1 << 26
SEEDS = (_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3))
SPARE = 10  # prefixes under the filtering orders are longer by one shingle in so many
CENTRES = 2
SAMPLES = (4, 1)  # of the open documents' shingles one in so many is counted, on ever fewer documents
CARRIED = 512  # a document's differences go through the join up to so many; longer ones are compared after it
REMOVED = _U(0x5851F42D4C957F2D)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text by text, and where each text's begin."""
    starts, ends, first = spans.word_spans(data, at, spans.NON_SPACE)
    values = spans.word_hashes(data, starts, ends)
    begin = spans.window_starts(first, width)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < width))
    text = np.concatenate((np.searchsorted(first, begin, "right") - 1, short))
    h = spans.hash_spans(values, np.concatenate((begin, first[short])), np.concatenate((begin + width, first[short + 1])))
    order = spans.order_by_text(text, h)
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(at)))


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def _signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.diff(first), _sum_by(spans.mix(h ^ SEEDS[0]), first).view(np.int64), _sum_by(spans.mix(h ^ SEEDS[1]), first).view(np.int64)


def _measure(width: int):
    """Rows of documents (kind 0) and, at the end of the task, pieces of its counters (kind 1)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTER_BITS, np.uint32)
        names = ["kind", "id", "n", "s1", "s2", "piece", "counts"]
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for low, high, data, at in spans.chunked(batch.column(1)):
                h, first = shingle_sets(data, at, width)
                np.add.at(counters, (h >> _U(64 - COUNTER_BITS)).astype(np.int64), 1)
                n, s1, s2 = _signatures(h, first)
                rows = high - low
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(rows, np.int32)), batch.column(0).slice(low, rows), pa.array(n), pa.array(s1), pa.array(s2), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary())], names=names
                )
        if kind is not None:
            for k in range(0, len(counters), bloom.PIECE):
                part = counters[k : k + bloom.PIECE]
                if part.any():
                    packed = zlib.compress(np.minimum(part, 255).astype(np.uint8).tobytes(), 1)
                    null = pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.nulls(1, kind), null, null, null, pa.array([k], pa.int64()), pa.array([packed], pa.binary())], names=names)

    return task


def _add_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(k, np.zeros(bloom.PIECE, np.uint32))
            held[k] += np.frombuffer(zlib.decompress(packed), np.uint8)
    for k, part in held.items():
        yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int64()), "counts": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})


def _classes(measured: DataFrame):
    """Broadcast frequency classes of all counters: half octaves above twice the mean. 2^23 bytes, whatever the input."""
    spark = measured.sparkSession
    parts = max(1, min(1 << COUNTER_BITS - 16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    merged = measured.where("kind = 1").select("piece", "counts").repartition(parts, "piece").mapInArrow(_add_counters, "piece long, counts binary")
    counts = np.zeros(1 << COUNTER_BITS, np.uint32)
    for r in merged.collect():
        counts[r.piece : r.piece + bloom.PIECE] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.uint32)
    base = max(4.0, 2.0 * float(counts.mean()))
    return spark.sparkContext.broadcast(zlib.compress(np.maximum(0, np.log2(np.maximum(counts, 1) / base) * 2 + 1).astype(np.uint8).tobytes(), 1))


def _need(n):
    """How many shingles the filtering orders' prefixes must share."""
    return n // SPARE + 1


def _lengths(n: np.ndarray, percent: int, order: int) -> np.ndarray:
    first = n - -(-percent * n // 100) + 1
    return np.minimum(first, n) if order == 0 else np.minimum(first - 1 + _need(n), n)


def _prefix(h: np.ndarray, first: np.ndarray, classes: np.ndarray, percent: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (text, shingle) pairs in prefixes under one order."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    rank = np.minimum(classes[(h >> _U(64 - COUNTER_BITS)).astype(np.int64)], 31).astype(_U)
    # text, class and the head of the hash in one word; equal words at a prefix's end are all taken in, so the cut is the same everywhere
    word = (text.astype(_U) << _U(40)) | (rank << _U(35)) | (spans.mix(h ^ SEEDS[order]) >> _U(29))
    by = np.argsort(word)
    word = word[by]
    last, full = np.zeros(len(n), _U), np.flatnonzero(n)
    last[full] = word[first[full] + _lengths(n, percent, order)[full] - 1]
    inside = word <= last[text]
    return text[inside], h[by][inside]


def _lists(text: np.ndarray, values: np.ndarray, rows: int, kind: type = np.int64) -> pa.Array:
    offsets = np.searchsorted(text, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64).astype(kind)))


def _table(classes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(classes.value), np.uint8)


def _index(classes, doubtful, width: int, percent: int):
    """Every document's signature and first prefix, and whether its row may not be the one that stands for its set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words = None
        for batch in batches:
            if table is None:
                table, words = _table(classes), bloom.load(doubtful, ID_FILTER_BITS)
            maybe = bloom.has(words, bloom.mixed(batch.column(2)), ID_FILTER_BITS)
            for low, high, data, at in spans.chunked(batch.column(1)):
                h, first = shingle_sets(data, at, width)
                n, s1, s2 = _signatures(h, first)
                prefix = _lists(*_prefix(h, first, table, percent, 0), high - low)
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(n), pa.array(s1), pa.array(s2), pa.array(maybe[low:high]), prefix], names=["id", "n", "s1", "s2", "maybe", "p"])
                yield out.filter(pa.array(n > 0))

    return task


def _filters(classes, width: int, percent: int):
    """(id, n, p2, p3): 32 bits of each shingle of the prefixes under the filtering orders."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = _table(classes) if table is None else table
            for low, high, data, at in spans.chunked(batch.column(1)):
                h, first = shingle_sets(data, at, width)
                lists = [_lists(*_prefix(h, first, table, percent, k), high - low, np.int32) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(first)), *lists], names=["id", "n", "p2", "p3"])

    return task


def _set_rows(width: int, one_in: int):
    """(id, h) for one in so many shingles, by hash."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in spans.chunked(batch.column(1)):
                h, first = shingle_sets(data, at, width)
                text = np.repeat(np.arange(low, high), np.diff(first))
                some = spans.mix(h ^ REMOVED) & _U(one_in - 1) == 0
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[some])), pa.array(h[some].view(np.int64))], names=["id", "h"])

    return task


def _of_signature(width: int):
    """Where an id repeats, only the text that stands for it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in spans.chunked(batch.column(1)):
                part = batch.slice(low, high - low)
                _, s1, s2 = _signatures(*shingle_sets(data, at, width))
                same = (part.column(3).to_numpy() == s1) & (part.column(4).to_numpy() == s2)
                yield part.filter(pa.array(same)).select([0, 1, 2])

    return task


def _compare(width: int):
    """Pairs (a, b, text of a, text of b) to (a, b, common, na, nb, difference): what a lacks of b and has beside it."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, _, data, at in spans.chunked(column):
            h, first = shingle_sets(data, at, width)
            out += np.split(h, first[1:-1])
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                common, na, nb, differences = [], [], [], []
                for a, b in zip(sets(part.column(2)), sets(part.column(3)), strict=True):
                    both = np.concatenate((a, b))
                    by = np.argsort(both)
                    same = both[by][1:] == both[by][:-1]
                    common.append(int(same.sum()))
                    na.append(len(a))
                    nb.append(len(b))
                    alone = np.ones(len(both), bool)
                    alone[by[1:][same]] = alone[by[:-1][same]] = False
                    near = 2 * common[-1] >= len(b)
                    differences.append(np.concatenate((both[: len(a)][alone[: len(a)]], spans.mix(both[len(a) :][alone[len(a) :]] ^ REMOVED))) if near else both[:0])
                offsets = np.concatenate(([0], np.cumsum([len(d) for d in differences]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(differences).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.int64()) for x in (common, na, nb)), lists], names=["a", "b", "common", "na", "nb", "difference"])

    return task


class _Join:
    """The tables of one join, and what is to be deleted after it."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent, self.kind = docs, width, percent, docs.schema["id"].dataType.simpleString()
        self.made: list[DataFrame] = []
        self.labels: dict[int, str] = {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.made.append(workspace.materialise(df, label))
        self.labels[id(self.made[-1])] = label
        return self.made[-1]

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self.made = [x for x in self.made if x is not df]
            workspace.drop(df)

    def clear(self, since: int, *kept: DataFrame | str) -> None:
        """Delete the tables made since, but for those named. Shuffles that nothing refers to any more go as well, once their handles are collected."""
        self.drop(*[df for df in self.made[since:] if not any(df is k or self.labels[id(df)] == k for k in kept)])
        self.free()

    def free(self) -> None:
        """Delete the files of shuffles that nothing refers to any more."""
        gc.collect()
        self.docs.sparkSession._jvm.java.lang.System.gc()

    def likely(self, ids: DataFrame, then=None, shape: str | None = None) -> DataFrame:
        """(id, text) of the rows that may have one of some ids, by a Bloom filter; or what `then` makes of them, in columns `shape`."""
        pieces = bloom.seen(ids.select(F.xxhash64("id").alias("h")), bloom.key_hashes, ID_FILTER_BITS)
        return bloom.maybe(self.docs.where("id is not null"), F.xxhash64("id"), pieces, ID_FILTER_BITS, then, shape)

    def texts(self, reps: DataFrame, ids: DataFrame) -> DataFrame:
        """The texts of the given representatives. A Bloom filter of their ids keeps most other texts out of the shuffle."""
        wanted = self.keep(reps.select(F.col("rep").alias("id"), "s1", "s2", "rows").join(ids, "id", "left_semi"), "wanted")
        # not by broadcast: the task would hold two Python workers, one for either side of the join
        found = self.likely(wanted).join(wanted.hint("merge"), "id").select("id", "text", "rows", "s1", "s2").mapInArrow(_of_signature(self.width), f"id {self.kind}, text string, rows long")
        found = self.keep(found, "texts")
        self.free()
        return found.where("rows = 1").unionByName(found.where("rows > 1").dropDuplicates(["id"])).select("id", "text")

    def filtered(self, pairs: DataFrame, texts: DataFrame, classes) -> DataFrame:
        """The pairs that share enough of their prefixes under the second and the third order."""
        lists = self.keep(texts.mapInArrow(_filters(classes, self.width, self.percent), f"id {self.kind}, n long, p2 array<int>, p3 array<int>"), "prefixes")
        side = lambda x: lists.select(*(F.col(c).alias(f"{c}{x}" if c != "id" else x) for c in lists.columns))
        least = F.floor(F.least("na", "nb") / SPARE) + 1
        # what is equal in its 32 bits within one prefix is one element of the intersection; it may have been several shared shingles
        most = lambda p: F.size(F.array_intersect(f"{p}a", f"{p}b")) + F.size(f"{p}a") - F.size(F.array_distinct(f"{p}a"))
        found = self.keep(pairs.join(side("a"), "a").join(side("b"), "b").where((most("p2") >= least) & (most("p3") >= least)).select("a", "b"), "candidates")
        self.drop(lists)
        self.free()
        return found

    def compared(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        text = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
        shape = f"a {self.kind}, b {self.kind}, common long, na long, nb long, difference array<long>"
        compared = self.keep(pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_compare(self.width), shape), "pairs")
        self.free()
        return compared

    def links(self, common, na, nb):
        return (100 + self.percent) * common >= self.percent * (na + nb)

    def close(self, na, nb):
        return F.least(na, nb) * 100 >= F.greatest(na, nb) * self.percent

    def linked(self, compared: DataFrame) -> DataFrame:
        return compared.where(self.links(F.col("common"), F.col("na"), F.col("nb"))).select("a", "b")


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of `percent` / 100 or more; return their components.

    A set holds the distinct runs of `width` words (non-white-space, A-Z lower-cased), or the whole sequence of a
    shorter text. Returns (id, n_shingles, component_id) for each input row; component_id is the smallest id
    reachable by links. Texts that are null or have no word have an empty set, link with nothing and are their own
    component. Rows with a null id link with nothing and have a null component_id. Rows that repeat an id are one
    document: each keeps its own n_shingles, and the row with the smallest signature stands for the id in the join. An
    empty table gives an empty table. No other column of `docs` is read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    j = _Join(docs, width, percent)
    measured = j.keep(docs.mapInArrow(_measure(width), f"kind int, id {kind}, n long, s1 long, s2 long, piece long, counts binary"), "shingles")
    rows = measured.where("kind = 0").select("id", "n", "s1", "s2")
    classes = _classes(measured)
    sets = j.keep(rows.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct("n", "s1", "s2")).alias("x"), F.count(F.lit(1)).alias("rows")).select("id", "x.*", "rows"), "sets")
    reps = j.keep(sets.groupBy("n", "s1", "s2").agg(F.min(F.struct("id", "rows")).alias("x")).select("n", "s1", "s2", F.col("x.id").alias("rep"), "x.rows"), "representatives")  # as a table, so that the join can split a hot group
    owned = j.keep(sets.join(reps.drop("rows"), ["n", "s1", "s2"]).where("id <> rep or rows > 1").select("id", "rep"), "copies")
    doubtful = bloom.seen(owned.select(F.xxhash64("id").alias("h")), bloom.key_hashes, ID_FILTER_BITS)
    indexed = docs.where("id is not null").withColumn("h", F.xxhash64("id")).mapInArrow(_index(classes, doubtful, width, percent), f"id {kind}, n long, s1 long, s2 long, maybe boolean, p array<long>")
    indexed = j.keep(indexed, "prefixes")
    key = ["id", "n", "s1", "s2"]
    settled = indexed.where("maybe").join(reps.withColumnRenamed("rep", "id"), key, "left_semi").dropDuplicates(key)
    entries = indexed.where("not maybe").unionByName(settled).select("id", F.col("n").cast("int").alias("n"), F.explode("p").alias("token"))
    again = j.keep(entries.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token"), "tokens")
    j.free()
    shared = j.keep(entries.join(again, "token"), "index")
    j.drop(again, indexed)
    del entries, settled, indexed, again
    mark = len(j.made)
    j.clear(mark)

    # round one: a shingle's centre is the holder with the highest share of index shingles, as the source of edited copies is
    by_id = shared.repartition("id")  # one shuffle for both sides
    share = by_id.groupBy("id").agg((-F.round(F.count(F.lit(1)) / F.first("n"), 3)).cast("float").alias("by"))
    starred = _starred(j, by_id.join(share, "id"), "by")
    with_most = starred.where(j.close(F.col("n"), F.col("nc"))).groupBy("id", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "c")), asc=False), 1, CENTRES).alias("best"))
    pairs = with_most.select(F.col("id").alias("a"), F.explode("best.c").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = j.keep(pairs, "stars")
    texts = j.texts(reps, pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct())
    edges = j.keep(j.linked(j.compared(j.filtered(pairs, texts, classes), texts)), "edges")
    groups = j.keep(connected_components(edges, "a", "b"), "groups")
    del by_id, share, starred, with_most, pairs, texts
    j.clear(mark, edges, groups)

    second = _round_two(j, shared, reps, groups, classes)
    if second is not None and not second.isEmpty():
        groups = j.keep(connected_components(edges.unionAll(second), "a", "b"), "groups")
    copies = owned.where("id <> rep")
    whole = copies.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    placed_ids = whole.unionAll(groups.select(F.col("node").alias("id"), "component")).withColumnRenamed("id", "own")
    result = rows.join(placed_ids, rows["id"] == placed_ids["own"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    result = workspace.materialise(result, "components")
    for done in j.made:
        workspace.drop(done)
    return result


def _starred(j: _Join, held: DataFrame, by: str) -> DataFrame:
    """Index rows (token, id, n, ...) with their shingle's centre, the holder of least `by` and id; not the centre's own."""
    held = j.keep(held, "ranked")
    centres = held.groupBy("token").agg(F.min(F.struct(by, "id", "n")).alias("x")).select("token", F.col("x.id").alias("c"), F.col("x.n").alias("nc"))
    centres = j.keep(centres, "centres")  # as a table, so that the join can split a hot shingle
    return held.join(centres, "token").where("id <> c")


def _round_two(j: _Join, shared: DataFrame, reps: DataFrame, groups: DataFrame, classes) -> DataFrame | None:
    """Links between documents that share an index shingle and are in different components so far."""
    p = j.percent
    placed = j.keep(shared.join(groups.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "n", F.coalesce("component", "id").alias("component")), "placed")
    mark = len(j.made)
    placed = _open(j, placed)
    holders = placed.select("id").distinct().join(reps.select(F.col("rep").alias("id"), "n", "rows"), "id")
    holders = j.keep(holders, "holders")
    likely = j.likely(holders, _set_rows(j.width, SAMPLES[0]), f"id {j.kind}, h long")
    # a repeated id may have shingles of another of its texts here, so it stays for now
    reach = _reaching(j, holders, likely, F.col("rows") > 1)
    texts = None
    for one_in in SAMPLES[1:]:
        j.clear(mark, placed, holders, reach, "texts")
        placed = _open(j, placed.join(reach.select("id"), "id", "left_semi"))
        holders = j.keep(holders.join(placed.select("id").distinct(), "id", "left_semi"), "holders")
        if holders.isEmpty():
            return None
        texts = texts or j.texts(reps, holders.select("id"))
        rows = texts.join(holders.select("id"), "id", "left_semi").mapInArrow(_set_rows(j.width, one_in), f"id {j.kind}, h long")
        reach = _reaching(j, holders, rows, F.lit(False))
    placed = _open(j, placed.join(reach.select("id"), "id", "left_semi"))
    if placed.isEmpty():
        return None
    j.clear(mark, placed, reach, "texts")
    starred = j.keep(_starred(j, placed.join(reach, "id"), "by"), "open")
    stars = j.compared(starred.select(F.col("id").alias("a"), F.col("c").alias("b")).distinct(), texts)
    component = placed.groupBy("id").agg(F.first("component").alias("component"))
    alone, missing = F.col("na") - F.col("common"), F.col("nb") - F.col("common")
    stars = stars.withColumns({"w": 100 * missing + p * alone, "free": (100 - p) * F.col("nb")})
    found = j.linked(stars).unionAll(_by_difference(j, stars.where("2 * common >= nb"), component, texts)).distinct()
    # less than half of the centre, or so little more that the other of a pair may have less
    far = stars.where(100 * F.col("common") < 50 * F.col("nb") + (100 - p) * F.col("na")).select(F.col("a").alias("id"), F.col("b").alias("c"), "common")
    rest = j.keep(starred.select("token", "id", "n", "c").join(far, ["id", "c"]).join(component, "id"), "far")
    one, other = rest, rest.select("token", *(F.col(x).alias(f"{x}_") for x in ("id", "n", "component", "common")))
    most = F.least("common", "common_") + F.least(F.col("n") - F.col("common"), F.col("n_") - F.col("common_"))
    met = one.join(other, "token").where((F.col("id") < F.col("id_")) & (F.col("component") != F.col("component_")) & j.close(F.col("n"), F.col("n_")) & j.links(most, F.col("n"), F.col("n_")))
    direct = j.keep(met.select(F.col("id").alias("a"), F.col("id_").alias("b")).distinct(), "direct")
    checked = j.compared(j.filtered(direct, texts, classes), texts)
    return j.keep(found.unionAll(j.linked(checked)), "links")


def _reaching(j: _Join, holders: DataFrame, rows: DataFrame, spared) -> DataFrame:
    """(id, by) of the documents of which enough shingles may be in another's set: no pair shares more than a set less those that it alone has."""
    p = j.percent
    alone = rows.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id")).where("k = 1").groupBy("id").agg(F.count(F.lit(1)).alias("u"))
    at_most = F.col("n") - F.coalesce("u", F.lit(0))
    enough = (100 + p) * at_most >= p * (F.col("n") + F.ceil(F.col("n") * p / 100))
    return j.keep(holders.join(alone, "id", "left").where(enough | spared).select("id", (-F.round(at_most / F.col("n"), 3)).cast("float").alias("by")), "reach")


def _open(j: _Join, placed: DataFrame) -> DataFrame:
    """The rows of shingles that documents of two components, or more, hold."""
    tokens = j.keep(placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token"), "tokens")
    return j.keep(placed.join(tokens, "token", "left_semi"), "placed")


def _by_difference(j: _Join, stars: DataFrame, component: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among the documents around each centre of which one at least does not link with the centre."""
    p = j.percent
    beyond = F.col("w") > F.col("free")
    # what the differences must share: with any other if this one is beyond the centre's reach, and with one that is beyond
    with_any = F.greatest(F.ceil((F.col("w") - F.col("free")) / 100), F.lit(1))
    with_beyond = F.floor(F.col("w") / (100 + p)) + 1
    least = F.when(beyond, F.least(with_any, with_beyond)).otherwise(with_beyond)
    docs = stars.select(F.col("b").alias("c"), F.col("a").alias("id"), "w", "free", beyond.alias("beyond"), F.size("difference").alias("size"), (F.size("difference") - least + 1).alias("length"), "difference").where("length > 0")
    rows = j.keep(docs.select("c", "id", F.explode("difference").alias("e")), "differences")
    counts = j.keep(rows.groupBy("c", "e").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "counts")
    kept = rows.join(counts, ["c", "e"]).groupBy("c", "id").agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("x"))
    # elements that one document alone has come first in the order; they fill the prefix and meet nothing
    known = docs.drop("difference").join(kept, ["c", "id"]).join(component, "id").withColumn("length", F.col("length") - (F.col("size") - F.size("x"))).where("length > 0")
    elements = F.transform("x", lambda v: v["e"])
    known = known.select("c", "id", "w", "free", "beyond", "component", "size", F.when(F.size("x") <= CARRIED, elements).alias("all"), F.slice(elements, F.lit(1), F.greatest(F.least("length", F.size("x")), F.lit(0)).cast("int")).alias("prefix"))
    spread = j.keep(known.select("c", "id", "w", "free", "beyond", "component", "size", "all", F.explode("prefix").alias("e")), "prefixes")
    other = spread.select("c", "e", *(F.col(x).alias(f"{x}_") for x in ("id", "w", "beyond", "component", "size", "all")))
    most = F.coalesce(F.size(F.array_intersect("all", "all_")), F.least("size", "size_"))
    enough = (100 + p) * most >= F.col("w") + F.col("w_") - F.col("free")
    once = ~F.col("beyond_") | (F.col("id") < F.col("id_"))
    met = spread.where("beyond").join(other, ["c", "e"]).where((F.col("id") != F.col("id_")) & (F.col("component") != F.col("component_")) & once & enough)
    pairs = j.keep(met.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct(), "pairs")
    return j.linked(j.compared(pairs, texts))
