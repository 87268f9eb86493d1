"""Word-level language identification with a linear-chain conditional random field.

States are the languages seen in training. A word's score is the sum of weights of its byte n-grams (lengths 1 to 4 of
the word between marks, so those at the ends are its affixes) and of the word itself if the training lexicon has it.
Transitions are learned on chains that also switch language: pieces of documents of different languages joined
end to end. Forward-backward marginals, weighted by word length, sum to the document's language.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf, samples, spans

PER_CLASS = 250
MAX_CHARS = 8_000
PIECE_WORDS = 80
TABLE_BITS = 15
LEXICON = 4000
RUN_WORDS = 1_000_000
_U = np.uint64

#: ASCII letters and all bytes of non-ASCII code points, after folding.
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the Latin-1 letters (two bytes, the first C3)."""
    out = spans.LOWER[data]
    if len(out) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 0x20
    return out


class WordFeatures:
    """n-gram rows of all words of some texts, as indices into the weight table (row 0 stays zero)."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        folded = fold(data)
        starts, ends, self.first = spans.word_spans(folded, at, LETTER)
        self.size = ends - starts
        self.hashes = spans.hash_spans(spans.BYTE_VALUE[folded], starts, ends)
        marked = self.size + 2
        self.offset = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=self.offset[1:])
        total = int(self.offset[-1])
        begin = self.offset[:-1]
        where = np.arange(total) + np.repeat(starts - 1 - begin, marked)
        self.bytes = folded[np.clip(where, 0, max(len(folded) - 1, 0))].astype(np.uint64) if total else np.zeros(0, _U)
        self.bytes[begin] = 0x5E
        self.bytes[begin + marked - 1] = 0x24
        self.left = np.repeat(self.offset[1:], marked) - np.arange(total)  # bytes up to the word's end

    def rows(self) -> Iterator[np.ndarray]:
        code = np.zeros(len(self.bytes), _U)
        for n in range(1, 5):
            if len(code) >= n:
                code[: len(code) - n + 1] = code[: len(code) - n + 1] * _U(257) + self.bytes[n - 1 :]
            slot = (code * _U(0x9E3779B97F4A7C15) >> _U(64 - TABLE_BITS)).astype(np.int32) + ((n - 1) << TABLE_BITS) + 1
            slot[self.left < n] = 0
            yield slot


class LanguageModel:
    def __init__(self, langs: list[str], weights: np.ndarray, lexicon: np.ndarray, lexical: np.ndarray, trans: np.ndarray):
        self.langs, self.weights, self.lexicon, self.lexical, self.trans = langs, weights, lexicon, lexical, trans

    def emissions(self, f: WordFeatures) -> np.ndarray:
        out = np.zeros((len(f.size), len(self.langs)), np.float32)
        if not len(f.size):
            return out
        sums = sum(self.weights[slot] for slot in f.rows())
        out += np.add.reduceat(sums, f.offset[:-1], axis=0) / np.sqrt(f.size + 2)[:, None]
        return out + self.lexical[self.lexical_rows(f)]

    def lexical_rows(self, f: WordFeatures) -> np.ndarray:
        """Row in `lexical`; its last row, of zeros, is for unknown words."""
        if not len(self.lexicon):
            return np.zeros(len(f.size), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, f.hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == f.hashes, at, len(self.lexicon))

    def label(self, emissions: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of each text and its share of the (length-weighted) marginals; -1 where there is no word."""
        p = crf.marginals(emissions, first, self.trans) * size[:, None]
        sums = np.zeros((len(p) + 1, len(self.langs)))
        np.cumsum(p, axis=0, out=sums[1:])
        share = sums[first[1:]] - sums[first[:-1]]
        total = share.sum(axis=1)
        best = share.argmax(axis=1)
        return np.where(total > 0, best, -1), share.max(axis=1) / np.maximum(total, 1e-9)


def _two_pieces(text: str) -> str:
    """Two pieces of a text, chosen anywhere in it by its hash; all of a text that has no more."""
    words = text.split()
    pieces = -(-len(words) // PIECE_WORDS)
    if pieces > 2:
        h = zlib.crc32(text.encode())
        a = h % pieces
        b = (a + 1 + h // pieces % (pieces - 1)) % pieces
        words = [w for k in sorted((a, b)) for w in words[k * PIECE_WORDS : (k + 1) * PIECE_WORDS]]
    return " ".join(words)


def fit(examples: list[tuple[str, str]], rounds: int = 40, l2: float = 0.02) -> LanguageModel:
    """With no examples the model knows no language and every text is `und`."""
    langs = sorted({y for _, y in examples})
    empty = LanguageModel(langs, np.zeros(((4 << TABLE_BITS) + 1, max(1, len(langs))), np.float32), np.zeros(0, _U), np.zeros((1, max(1, len(langs))), np.float32), np.zeros((max(1, len(langs)),) * 2))
    if len(langs) < 2:
        return empty
    data, at = spans.text_buffers(pa.array([_two_pieces(t) for t, _ in examples], pa.string()))
    f = WordFeatures(data, at)
    labels = np.repeat([langs.index(y) for _, y in examples], np.diff(f.first))
    # chains: pieces of PIECE_WORDS words; a chain of four pieces, dealt in hash order, so that most chains switch language
    words = np.arange(len(f.size)) - np.repeat(f.first[:-1], np.diff(f.first))
    text = np.repeat(np.arange(len(examples)), np.diff(f.first))
    keep = words < 2 * PIECE_WORDS
    piece = (text * 2 + words // PIECE_WORDS)[keep]
    chosen = np.flatnonzero(keep)
    order = np.lexsort((np.arange(len(piece)), spans.mix(piece.astype(_U))))
    item = chosen[order]
    y = labels[item]
    change = np.flatnonzero(np.diff(piece[order])) + 1
    bounds = np.concatenate(([0], change, [len(item)]))[::4]
    first = bounds if bounds[-1] == len(item) else np.append(bounds, len(item))
    values, counts = np.unique(f.hashes[item], return_counts=True)
    top = np.argsort(-counts, kind="stable")[:LEXICON]
    lexicon = np.sort(values[top[counts[top] >= 3]])
    k = len(langs)
    model = LanguageModel(langs, empty.weights.astype(float), lexicon, np.zeros((len(lexicon) + 1, k)), np.zeros((k, k)))
    slots, known = list(f.rows()), model.lexical_rows(f)
    word_of = np.repeat(np.arange(len(f.size)), np.diff(f.offset))
    scale = 1 / np.sqrt(f.size + 2)
    seen = crf.observed_pairs(y, first, k)
    target = np.eye(k)[y]
    adam = crf.Adam([model.weights, model.lexical, model.trans], 0.05)
    for _ in range(rounds):
        p, expected, _ = crf.marginals(model.emissions(f)[item].astype(float), first, model.trans, pairs=True)
        error = np.zeros((len(f.size), k))
        error[item] = target - p
        by_byte = (error * scale[:, None])[word_of]
        g = np.stack([sum(np.bincount(s, by_byte[:, j], len(model.weights)) for s in slots) for j in range(k)], axis=1)
        g[0] = 0
        lex = np.stack([np.bincount(known, error[:, j], len(model.lexical)) for j in range(k)], axis=1)
        lex[-1] = 0
        adam.step([g - l2 * model.weights, lex - l2 * model.lexical, seen - expected - l2 * model.trans])
    return LanguageModel(langs, model.weights.astype(np.float32), lexicon, model.lexical.astype(np.float32), model.trans)


def _no_letters(texts: pa.Array, rows: np.ndarray) -> list[int]:
    return [int(r) for r in rows if not any(c.isalpha() for c in texts[int(r)].as_py() or "")]


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS) -> DataFrame:
    """Predict each text's language: (id, held_out, lang_pred, score), one row for each input row.

    Learned from at most `per_class` documents of each language (non-null, crc32(id as text) mod 4 not 2, at most
    MAX_CHARS characters), of each two pieces of PIECE_WORDS words, drawn from the whole text by its hash. Predictions read the whole text and nothing else. A null text, or one without a
    letter, is `und` with score 0. Rows with a null id are predicted and are not held out. Repeated rows get equal
    predictions. If nothing can be learned all texts are `und`; if one language can, it is predicted with score 1. An
    empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("label"), F.col(text_col).alias("text")).where(F.length("text").between(1, MAX_CHARS)).where(~samples.held_out(F.col("id"), 4, 2)).select("id", "label")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(samples.texts_of(docs, samples.sample_ids(known, per_class), MAX_CHARS)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            best, share = np.full(len(batch), -1), np.zeros(len(batch))
            held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []

            def flush(held=held, best=best, share=share):
                if held:
                    base = np.cumsum([0] + [len(x[2]) for x in held])
                    first = np.concatenate([x[4][:-1] + b for x, b in zip(held, base, strict=False)] + [base[-1:]])
                    low, high = held[0][0], held[-1][1]
                    best[low:high], share[low:high] = m.label(np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]).astype(np.float32), first)
                    held.clear()

            if m.langs:
                for low, high, data, at in spans.chunked(batch.column(1)):
                    f = WordFeatures(data, at)
                    held.append((low, high, m.emissions(f), f.size, f.first))
                    if sum(len(x[2]) for x in held) > RUN_WORDS:
                        flush()
                flush()
            # a text whose only letters could be non-ASCII ones is looked at character by character
            ascii_letter = np.zeros(len(batch), bool)
            for low, high, data, at in spans.chunked(batch.column(1)):
                sums = np.concatenate(([0], np.cumsum(spans.LOWER[data] - np.uint8(0x61) < 26)))
                ascii_letter[low:high] = sums[at[1:]] > sums[at[:-1]]
            none = _no_letters(batch.column(1), np.flatnonzero(~ascii_letter))
            best[none] = -1
            share[none] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.langs[b] if b >= 0 else "und" for b in best.tolist()], pa.string()), pa.array(np.clip(share, 0, 1))], names=["id", "lang_pred", "score"])

    found = docs.mapInArrow(task, f"id {kind}, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), samples.held_out(F.col("id"), 4, 2).alias("held_out"), "lang_pred", "score")
