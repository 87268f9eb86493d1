"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A token is what is left of a word when all but its letters are dropped; three or more single letters in a row are one token.
Two tokens compare by their common subsequences of three symbols (letters, and a mark before the first), each weighted by
decay ^ (gaps it spans), over the landmark's squared norm or a share of both norms, to the power POWER. So an insult with inserted characters or gaps still resembles the plain one.
A sentence's kernel is the sum over its distinct tokens. Landmarks are tokens or their stems: those that mark toxic documents most,
and frequent neutral ones; Nyström features (kernel values against the landmarks, whitened) feed a linear support vector machine over labelled
sentences. As its score is a sum over tokens, each distinct token of a block is scored once. A document's score
is its worst sentence's, mapped to a probability by a logistic fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples, spans
from .language_crf import fold

PER_CLASS = 1200
MAX_CHARS = 8_000
DECAY = 0.9
MAX_SPAN = 5
POWER = 3
POSITIVE, NEUTRAL, HARD = 28, 6, 30
BENT = 0.3  # weight of a distorted example
STEMS = (4, 5, 6)
SYMBOLS = 35
MARK = 34
LENIENCE = 0.7
CHUNK = 4 << 20
_U = np.uint64
PULL = 3.0
GAPS = [(a, b) for a in range(1, MAX_SPAN) for b in range(1, MAX_SPAN - a + 1)]

#: 0-25 for a-z, 26-33 for the later bytes of non-ASCII code points by their low bits, -1 for what is dropped.
CODE = np.full(256, -1, np.int64)
CODE[0x61:0x7B] = np.arange(26)
CODE[0x80:0xC0] = 26 + np.arange(0x80, 0xC0) % 8
STOP = np.zeros(256, bool)
STOP[[0x21, 0x2E, 0x3F]] = True


class Tokens:
    """Tokens of a run of texts: letter codes end to end, and each token's text and sentence."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        folded = fold(data)
        starts, ends, first = spans.word_spans(folded, at, spans.NON_SPACE)
        codes = CODE[folded]
        letter = codes >= 0
        count = np.concatenate(([0], np.cumsum(letter)))
        size = count[ends] - count[starts]
        text = np.repeat(np.arange(len(at) - 1), np.diff(first))
        # a sentence ends with its last word's stop, at a line break, or with the text
        breaks = np.concatenate(([0], np.cumsum(folded == 0x0A)))
        stops = np.zeros(len(starts), bool)
        if len(starts):
            stops[:-1] = (STOP[folded[ends[:-1] - 1]] & (size[:-1] != 1)) | (breaks[starts[1:]] > breaks[ends[:-1]]) | (text[1:] != text[:-1])
        sentence = np.concatenate(([0], np.cumsum(stops[:-1]))) if len(starts) else np.zeros(0, np.int64)
        # runs of three or more single letters join
        single = size == 1
        run_start = np.flatnonzero(single & np.concatenate(([True], ~single[:-1] | (sentence[1:] != sentence[:-1])))) if len(starts) else np.zeros(0, np.int64)
        run_end = np.flatnonzero(single & np.concatenate((~single[1:] | (sentence[1:] != sentence[:-1]), [True]))) + 1 if len(starts) else run_start
        joined = np.zeros(len(starts), bool)
        for a, b in zip(*((x[run_end - run_start >= 3]).tolist() for x in (run_start, run_end)), strict=True):
            joined[a + 1 : b] = True
        heads = np.flatnonzero(~joined & (size > 0))
        self.text, self.sentence = text[heads], sentence[heads]
        inside = np.flatnonzero(letter & spans.NON_SPACE[folded])
        plain = np.searchsorted(inside, starts[heads])
        self.codes = np.insert(codes[inside], plain, MARK)
        self.offset = np.append(plain + np.arange(len(plain)), len(self.codes))
        self.hashes = spans.hash_spans(spans.mix(self.codes.astype(_U) + _U(1)), self.offset[:-1], self.offset[1:])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The first token of each kind, and each token's kind."""
        _, first, kind = np.unique(self.hashes, return_index=True, return_inverse=True)
        return first, kind

    def once(self, kind: np.ndarray) -> np.ndarray:
        """Places of the first token of its kind in each sentence."""
        order = np.lexsort((kind, self.sentence))
        k, s = kind[order], self.sentence[order]
        return order[np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])))]

    def select(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and offsets of some tokens."""
        size = self.offset[which + 1] - self.offset[which]
        offset = np.concatenate(([0], np.cumsum(size)))
        where = np.arange(offset[-1]) + np.repeat(self.offset[which] - offset[:-1], size)
        return self.codes[where], offset


def _triples(codes: np.ndarray, offset: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of gaps: (places, triple codes, weight)."""
    left = np.repeat(offset[1:], np.diff(offset)) - np.arange(len(codes))
    for a, b in GAPS:
        at = np.flatnonzero(left > a + b)
        if len(at):
            yield at, (codes[at] * SYMBOLS + codes[at + a]) * SYMBOLS + codes[at + a + b], DECAY ** (a + b - 2)


def _norms(codes: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Root of the summed squared weights of each token."""
    total = np.zeros(len(codes))
    for at, _, w in _triples(codes, offset):
        total[at] += w * w
    sums = np.concatenate(([0], np.cumsum(total)))
    return np.sqrt(np.maximum(sums[offset[1:]] - sums[offset[:-1]], 1.0))


class Kernel:
    """Kernel values of tokens against fixed landmark tokens, through a table of the landmarks' weighted triples."""

    def __init__(self, codes: np.ndarray, offset: np.ndarray):
        n = len(offset) - 1
        self.table = np.zeros((SYMBOLS**3, n), np.float32)
        owner = np.repeat(np.arange(n), np.diff(offset))
        for at, triple, w in _triples(codes, offset):
            np.add.at(self.table, (triple, owner[at]), w)
        # the landmark's norm, with its own repeated triples added up
        self.norm = np.sqrt(np.maximum((self.table.astype(float) ** 2).sum(axis=0), 1.0)).astype(np.float32)
        self.table /= self.norm

    def values(self, codes: np.ndarray, offset: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offset) - 1, self.table.shape[1]), np.float32)
        for low in range(0, len(out), 4096):
            o = offset[low : low + 4097]
            c = codes[o[0] : o[-1]]
            o = o - o[0]
            sums = np.zeros((len(c) + 1, self.table.shape[1]), np.float32)
            for at, triple, w in _triples(c, o):
                sums[at] += self.table[triple] * np.float32(w)
            part = np.add.reduceat(sums, o[:-1], axis=0)
            # a longer token than the landmark is not held against it fully: it may contain it
            out[low : low + 4096] = part / np.maximum(self.norm[None, :], LENIENCE * _norms(c, o)[:, None])
        return np.minimum(out, 1) ** POWER


class ToxicityModel:
    def __init__(self, kernel: Kernel | None, alpha: np.ndarray, bias: float, link: tuple[float, float]):
        self.kernel, self.alpha, self.bias, self.link = kernel, alpha, bias, link

    def margins(self, tokens: Tokens, texts: int) -> np.ndarray:
        """The largest sentence margin of each text; texts without a token have the margin of an empty sentence."""
        worst = np.full(texts, self.bias)
        if self.kernel is None or not len(tokens.text):
            return worst
        first, kind = tokens.distinct()
        value = self.kernel.values(*tokens.select(first)) @ self.alpha
        at = tokens.once(kind)
        sentence = tokens.sentence[at]
        heads = np.flatnonzero(np.concatenate(([True], np.diff(sentence) != 0)))
        sums = np.add.reduceat(value[kind[at]], heads) + self.bias
        np.maximum.at(worst, tokens.text[at][heads], sums)
        return worst

    def score(self, margins: np.ndarray) -> np.ndarray:
        """Beyond the hinge's margins of -1 and 1 a sentence is no surer; a small slope keeps the order of the rest."""
        seen = _seen(margins)
        return 1 / (1 + np.exp(-np.clip(self.link[0] * seen + self.link[1], -30, 30)))


def _stems(tokens: Tokens, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place and length of each distinct stem (the mark and the first letters, or a whole token of up to 12), and the stems of each kind of token; their count for none."""
    low = tokens.offset[first]
    size = tokens.offset[first + 1] - low - 1
    lengths = np.stack([np.where(size >= m, m, 0) for m in STEMS] + [np.where((size > STEMS[-1]) & (size <= 12), size, 0)], axis=1)
    at = np.repeat(low, lengths.shape[1])
    n = lengths.ravel()
    h = spans.hash_spans(spans.mix(tokens.codes.astype(_U) + _U(1)), at, at + n + 1)
    _, place, kind = np.unique(h[n > 0], return_index=True, return_inverse=True)
    rows = np.full(len(n), len(place))
    rows[n > 0] = kind
    return at[n > 0][place], n[n > 0][place] + 1, rows.reshape(lengths.shape)


def _marking(text: np.ndarray, stem: np.ndarray, labels: np.ndarray, n: int, code_of) -> list[int]:
    """Stems that mark toxic texts, greedily: a text that a chosen stem covers counts for less afterwards."""
    toxic = labels[text] == 1
    in_clean = np.bincount(stem[~toxic], minlength=n)
    t_text, t_stem = text[toxic], stem[toxic]
    seldom = np.bincount(t_stem, minlength=n)
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    weight, out = np.ones(len(labels)), []
    barred = (seldom < 4) | (seldom / n1 < 8 * in_clean / n0)
    for _ in range(POSITIVE):
        rate1, rate0 = np.bincount(t_stem, weight[t_text], n) / n1, (in_clean + 0.5) / n0
        z = (rate1 - rate0) / np.sqrt((rate1 + rate0) / 2 * (1 / n1 + 1 / n0))
        z[barred] = 0
        best = int(z.argmax())
        if z[best] < 2.5:
            break
        out.append(best)
        own = code_of(best).tolist()
        for k in np.flatnonzero(~barred).tolist():  # stems of the same word say the same
            other = code_of(k).tolist()
            if other[: len(own)] == own or own[: len(other)] == other:
                barred[k] = True
        weight[np.unique(t_text[t_stem == best])] *= 0.6
    return out


def _distort(word: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """The token with a letter put in, and with a letter missing: what the classifier has to tolerate."""
    out = []
    for _ in range(2):
        at = int(rng.integers(2, len(word)))
        out.append(np.concatenate((word[:at], rng.integers(0, 26, 1), word[at:])))
    if len(word) > 6:
        at = int(rng.integers(2, len(word) - 1))
        out.append(np.concatenate((word[:at], word[at + 1 :])))
    return out


def fit(examples: list[tuple[str, int]]) -> ToxicityModel:
    """With no examples, or of one class only, every text gets the same score: one half, or close to that class."""
    labels = np.array([int(y) for _, y in examples], np.int64)
    share = (labels.sum() + 1) / (len(labels) + 2)
    constant = ToxicityModel(None, np.zeros(0), 0.0, (0.0, float(np.log(share / (1 - share)))))
    if len(set(labels.tolist())) < 2:
        return constant
    data, at = spans.text_buffers(pa.array([t for t, _ in examples], pa.string()))
    tokens = Tokens(data, at)
    first, kind = tokens.distinct()
    stem_at, stem_size, stem_of = _stems(tokens, first)
    n = len(stem_at)
    code_of = lambda k: tokens.codes[stem_at[k] : stem_at[k] + stem_size[k]]
    pairs = np.unique(np.repeat(tokens.text, stem_of.shape[1]) * np.int64(n + 1) + stem_of[kind].ravel())
    of_text, of_stem = pairs // (n + 1), pairs % (n + 1)
    of_text, of_stem = of_text[of_stem < n], of_stem[of_stem < n]
    positive = _marking(of_text, of_stem, labels, n, code_of)
    if not len(positive):
        return constant
    clean_count = np.bincount(of_stem[labels[of_text] == 0], minlength=n)
    chosen = set(positive)
    neutral = [code_of(k) for k in np.argsort(-clean_count, kind="stable").tolist() if k not in chosen][:NEUTRAL]
    landmarks = [code_of(k) for k in positive]
    marked = np.isin(stem_of, positive).any(axis=1)
    # twice: the second time with the tokens of clean documents that the first model takes for insults as landmarks too
    model = _fit_landmarks(tokens, first, kind, marked, labels, [*landmarks, *neutral])
    in_clean = np.bincount(np.unique(tokens.text[labels[tokens.text] == 0] * np.int64(len(first)) + kind[labels[tokens.text] == 0]) % len(first), minlength=len(first))
    harm = np.where((in_clean > 0) & ~marked, model.kernel.values(*tokens.select(first)) @ model.alpha, 0)
    worst = [i for i in np.argsort(-harm * np.sqrt(in_clean), kind="stable")[:HARD].tolist() if harm[i] > 0.3]
    hard = [tokens.codes[tokens.offset[first[i]] : tokens.offset[first[i] + 1]] for i in worst]
    model = _fit_landmarks(tokens, first, kind, marked, labels, [*landmarks, *neutral, *hard])
    margins = _seen(model.margins(tokens, len(examples)))
    a, c = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * margins + c, -30, 30)))
        r = q * (1 - q)
        g = np.array([((labels - q) * margins).sum() - PULL * (a - 3), (labels - q).sum() - 0.01 * c])
        hess = np.array([[(r * margins * margins).sum() + PULL, (r * margins).sum()], [(r * margins).sum(), r.sum() + 0.01]])
        step = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, c = a + step[0], c + step[1]
        if abs(step).max() < 1e-7:
            break
    model.link = (float(a), float(c))
    return model


def _fit_landmarks(tokens: Tokens, first: np.ndarray, kind: np.ndarray, marked: np.ndarray, labels: np.ndarray, landmarks: list[np.ndarray]) -> ToxicityModel:
    """The support vector machine over the sample's sentences in the Nyström features of some landmarks."""
    ends = np.cumsum([0] + [len(x) for x in landmarks])
    kernel = Kernel(np.concatenate(landmarks), ends)
    square = kernel.values(np.concatenate(landmarks), ends).astype(float)
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    keep = values > 1e-3 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    by_kind = kernel.values(*tokens.select(first)) @ whiten.astype(np.float32)
    at_once = tokens.once(kind)
    sentence = tokens.sentence[at_once]
    heads = np.flatnonzero(np.concatenate(([True], np.diff(sentence) != 0)))
    x = np.add.reduceat(by_kind[kind[at_once]], heads, axis=0)
    text = tokens.text[at_once][heads]
    has_mark = np.add.reduceat(marked[kind[at_once]].astype(int), heads) > 0
    # labelled sentences: those of clean documents, and those of toxic documents that hold a marking token
    clean = np.flatnonzero(labels[text] == 0)
    use = np.concatenate((clean, np.flatnonzero((labels[text] == 1) & has_mark)))
    y = np.where(labels[text[use]] == 1, 1.0, -1.0)
    rng = np.random.default_rng(3)
    # the marking tokens again in a distorted spelling, put into clean sentences
    plain = first[marked][np.argsort(-np.bincount(kind, minlength=len(first))[marked], kind="stable")[:200]]
    bent = [w for i in plain for w in _distort(tokens.codes[tokens.offset[i] : tokens.offset[i + 1]], rng)]
    bent_x = kernel.values(np.concatenate(bent), np.concatenate(([0], np.cumsum([len(w) for w in bent])))) @ whiten.astype(np.float32)
    mixed = np.concatenate([bent_x + x[rng.choice(clean, len(bent_x))] for _ in range(2)]) if len(clean) else bent_x
    target = np.concatenate((y, np.ones(len(mixed))))
    weight = np.concatenate((np.where(y > 0, 1.0, 0.0), np.full(len(mixed), BENT)))
    weight = np.where(target > 0, 0.3 * weight / max(1e-9, weight.sum()), 0.7 / max(1, len(clean))) * len(target)
    w, b = _svm(np.concatenate((x[use], mixed)).astype(float), target, weight)
    return ToxicityModel(kernel, (whiten @ w).astype(np.float32), b, (1.0, 0.0))


def _seen(margins: np.ndarray) -> np.ndarray:
    return np.clip(margins, -1, 1) + 0.01 * np.clip(margins, -10, 10)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Squared-hinge linear support vector machine by Newton steps on the rows inside the margin."""
    full = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    theta = np.zeros(full.shape[1])
    ridge = np.full(full.shape[1], l2 * len(x))
    ridge[-1] *= 1e-3
    objective = lambda t: 0.5 * (ridge * t * t).sum() + 0.5 * (weight * np.maximum(0, 1 - y * (full @ t)) ** 2).sum()
    value = objective(theta)
    for _ in range(rounds):
        inside = y * (full @ theta) < 1
        g = ridge * theta - full[inside].T @ (weight[inside] * (y[inside] - full[inside] @ theta))
        h = (full[inside] * weight[inside][:, None]).T @ full[inside] + np.diag(ridge)
        step, size = np.linalg.solve(h, g), 1.0
        while (new := objective(theta - size * step)) > value and size > 1e-4:
            size /= 2
        theta = theta - size * step
        if value - new < 1e-8 * abs(value):
            break
        value = new
    return theta[:-1], float(theta[-1])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """Score every text: (id, held_out, score, predicted), one row for each input row.

    Learned from at most `per_class` labelled documents of each class whose crc32(id as text) mod 3 is not 1 and whose
    texts have at most MAX_CHARS characters (the bound of what the driver holds). Scoring reads the whole text and
    nothing else. A null or empty text has an empty sentence's score. Rows with a null id are scored and are not
    held out. Repeated rows get equal scores; where labels repeat an id, the largest label counts. Without labels all
    scores are one half; an empty table gives an empty table. A class that has longer texts only raises a ValueError.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").where(~samples.held_out(F.col("id"), 3, 1)).groupBy("id").agg(F.max("label").alias("label"))
    model = docs.sparkSession.sparkContext.broadcast(fit(samples.texts_of(docs, samples.sample_ids(samples.short_enough(known, docs, MAX_CHARS), per_class), MAX_CHARS)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.score(model.value.margins(Tokens(data, at), high - low)) for low, high, data, at in spans.chunked(batch.column(1), CHUNK)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["id", "score"])

    scored = docs.mapInArrow(task, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), samples.held_out(F.col("id"), 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
