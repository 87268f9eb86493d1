"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are character shares, word repetition, length and layout, together with
those of the lines before and after it. Labels are known for documents only, so in training each line takes its
document's label; transitions then tie neighbouring lines together. A document's score is the mean of its lines'
forward-backward marginals, weighted by line length, mapped to a probability by a logistic fit on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf, samples, spans

PER_CLASS = 1200
MAX_CHARS = 30_000
GOOD = 0.7
#: Lines whose features are turned into 64 bits at once while the model is fitted.
LINES = 1 << 15


def _set(*parts: tuple[int, int] | str) -> np.ndarray:
    out = np.zeros(256, bool)
    for p in parts:
        if isinstance(p, str):
            out[[ord(c) for c in p]] = True
        else:
            out[p[0] : p[1]] = True
    return out


CLASSES = [_set((0x41, 0x5B)), _set((0x61, 0x7B)), _set((0x30, 0x3A)), _set((0x80, 0x100)), _set("#*$%&|<>"), _set("!@^~_=+\\/{}[]`"), _set(".,;:?"), spans.SPACE]
ENDS = _set(".?!\"')")


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, the lines' lengths in bytes, and each text's first line."""
    starts, ends, first = spans.line_spans(data, at)
    size = (ends - starts).astype(np.float32)
    safe = np.maximum(size, 1)
    columns = []
    for members in CLASSES:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(members[data], out=sums[1:])
        columns.append((sums[ends] - sums[starts]) / safe)
    low, high = spans.strip_spans(data, starts, ends)
    full = high > low
    last = np.zeros(len(starts), bool)
    last[full] = ENDS[data[high[full] - 1]]
    word_starts, word_ends, _ = spans.word_spans(data, at, spans.NON_SPACE)
    line_word = np.append(np.searchsorted(word_starts, starts), len(word_starts))
    words = np.diff(line_word)
    h = spans.word_hashes(data, word_starts, word_ends)
    line = np.repeat(np.arange(len(starts)), words)
    order = np.lexsort((h, line))
    a, b = h[order], line[order]
    again = np.zeros(len(h), bool)
    again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    repeated = np.bincount(b[again], minlength=len(starts))[: len(starts)]
    beside = np.zeros(len(h), bool)
    beside[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    stutter = np.bincount(line[beside], minlength=len(starts))[: len(starts)]
    many = np.maximum(words, 1)
    key = spans.word_hashes(data, low, high)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((key, text))
    copy = np.zeros(len(key), bool)
    copy[order[1:]] = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    upper, symbols = columns[0], columns[4] + columns[5]
    columns += [
        repeated / many, repeated / np.sqrt(many) / 4, stutter / many, np.log1p(size) / 8, np.log1p(words) / 6, np.minimum(size / many, 30) / 10, last, ~full, copy & full,
        words < 4, symbols > 0.04, upper > 0.5, stutter > 2, columns[4] > 0.08,
    ]
    own = np.stack(columns, axis=1).astype(np.float32)
    opens, closes = np.zeros(len(own), bool), np.zeros(len(own), bool)
    opens[first[:-1]] = True
    closes[first[1:] - 1] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[opens], after[closes] = 0, 0
    return np.concatenate((own, before, after, np.stack((opens, closes, np.ones(len(own))), axis=1)), axis=1).astype(np.float32), size, first


def sample_features(texts: list[str | None], limit: int = spans.CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features of all texts, made for runs of about `limit` bytes: the work arrays are many times a run's size, and the driver holds them."""
    lines = sum((t or "").count("\n") + 1 for t in texts)
    x, size, first = np.zeros((lines, 0), np.float32), np.empty(lines, np.float32), np.zeros(len(texts) + 1, np.int64)
    for low, high, data, at in spans.chunked(pa.array(texts, pa.string()), limit):
        own, own_size, own_first = line_features(data, at)
        if not low:
            x = np.empty((lines, own.shape[1]), np.float32)
        first[low : high + 1] = first[low] + own_first
        x[first[low] : first[high]], size[first[low] : first[high]] = own, own_size
    return x, size, first


def _document_means(p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    weight = size.astype(float) + 1
    sums, total = np.concatenate(([0], np.cumsum(p * weight))), np.concatenate(([0], np.cumsum(weight)))
    return (sums[first[1:]] - sums[first[:-1]]) / (total[first[1:]] - total[first[:-1]])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class QualityModel:
    def __init__(self, emission: np.ndarray, trans: np.ndarray, link: tuple[float, float]):
        self.emission, self.trans, self.link = emission, trans, link

    def _good(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        scores = np.zeros((len(x), 2))
        scores[:, 1] = x @ self.emission
        return crf.marginals(scores, first, self.trans)[:, 1]

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        x, size, first = line_features(data, at)
        mean = _document_means(self._good(x, first), size, first)
        return 1 / (1 + np.exp(-(self.link[0] * _logit(mean) + self.link[1])))


def fit(examples: list[tuple[str, int]], rounds: int = 150, l2: float = 1.0) -> QualityModel:
    """With no examples, or of one class only, every text gets the same score: one half, or close to that class."""
    labels = np.array([int(y) for _, y in examples], np.int64)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return QualityModel(np.zeros(len(line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0][0]), np.float32), np.zeros((2, 2)), (0.0, float(np.log(share / (1 - share)))))
    x, size, first = sample_features([t for t, _ in examples])
    runs = [slice(i, i + LINES) for i in range(0, len(x), LINES)]
    y = np.repeat(labels, np.diff(first))
    emission, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    seen = crf.observed_pairs(y, first, 2)
    adam = crf.Adam([emission, trans], 0.1)
    # a document counts once, however many lines it has
    weight = np.repeat(1 / np.maximum(np.diff(first), 1), np.diff(first))
    for _ in range(rounds):
        scores = np.zeros((len(x), 2))
        for run in runs:
            scores[run, 1] = x[run] @ emission
        p, expected, _ = crf.marginals(scores, first, trans, pairs=True)
        off = (y - p[:, 1]) * weight
        adam.step([sum(x[run].T @ off[run] for run in runs) - l2 * emission / 4, (seen - expected) * (len(examples) / len(x)) - 20 * l2 * trans])
    model = QualityModel(emission.astype(np.float32), trans, (1.0, 0.0))
    z = _logit(_document_means(model._good(x, first), size, first))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit with a weak pull towards (1, 0)
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((labels - q) * z).sum() - (a - 1), (labels - q).sum() - b])
        r = q * (1 - q)
        hess = np.array([[(r * z * z).sum() + 1, (r * z).sum()], [(r * z).sum(), r.sum() + 1]])
        step = np.linalg.solve(hess, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-6:
            break
    model.link = (float(a), float(b))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """Score every text: (id, held_out, score, predicted), one row for each input row.

    Learned from at most `per_class` labelled documents of each class whose crc32(id as text) mod 4 is not 2 and
    whose texts have at most MAX_CHARS characters (the bound of what the driver holds). Scoring reads only the text,
    and all of it. A null or empty text is one empty line and gets that line's score. Rows with a null id are scored and are not held
    out. Repeated rows get equal scores; where labels repeat an id, the smallest label counts. Without labels all
    scores are one half; an empty table gives an empty table. A class that has longer texts only raises a ValueError.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    model = _learn(docs, labels, id_col, text_col, label_col, per_class)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model.value, batch.column(1)))], names=["id", "score"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), samples.held_out(F.col("id"), 4, 2).alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is GOOD or more; nothing is shuffled. Same model and cases as score_quality."""
    model = _learn(docs, labels, id_col, text_col, label_col, per_class)
    place = docs.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model.value, batch.column(place)) >= GOOD))

    return docs.mapInArrow(task, docs.schema)


def _learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int):
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").where(~samples.held_out(F.col("id"), 4, 2)).groupBy("id").agg(F.min("label").alias("label"))
    model = fit(samples.texts_of(texts, samples.sample_ids(samples.short_enough(known, texts, MAX_CHARS), per_class), MAX_CHARS))
    spans.release_memory()
    return docs.sparkSession.sparkContext.broadcast(model)


def _scores(model: QualityModel, text: pa.Array) -> np.ndarray:
    parts = [model.score(data, at) for _, _, data, at in spans.chunked(text)]
    return np.concatenate(parts) if parts else np.zeros(0)
