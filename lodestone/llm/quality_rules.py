"""Line-first quality rules in Spark SQL expressions only.

Every line is tested by punctuation, navigation and boilerplate rules; failing lines are removed; a document that
loses too much of its text by that, or fails the base rules on words, is rejected. All of it is one projection
over the text: no shuffle, no Python, and work in proportion to the text's length (times its logarithm where windows
of words repeat).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Line rules: fixed patterns, the same in Java and RE2 syntax.
BARS = "|»›•"
MAX_BARS = 2
ENDING = "[.!?…:;\"'”’»)]\\s*\\z"
SHOUT = "[!?#*$%&]{2}"
MAX_SHOUTS = 2
BOILERPLATE = (
    "cookie|privacy policy|terms of (use|service)|all rights reserved|click here|sign up|subscribe|read more|log ?in to|javascript|"
    "(licensed|released) under|this work is licensed|copyright \\(c\\)|share this|back to top"
)
MIN_LINE_CHARS_UNENDED = 40
KEEP_PERCENT = 40
MIN_WORDS = 10
REPEAT_PERCENT = 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once, so that lambdas inside do not work it out again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stripped_length(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words which the text holds twice or more."""

    def covered(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            beside = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            repeated = F.transform(s, lambda e, k: F.when(beside(e, k - 1) | beside(e, k + 1), e["i"]))
            return F.array_sort(F.filter(repeated, lambda i: i.isNotNull()))

        def total(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_let(pairs, lambda s: _let(positions(s), total)))

    def windows(h: Column) -> Column:
        heads = F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        return F.transform(heads, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(_let(hashes, lambda h: _let(windows(h), covered)))


def line_fails(line: Column) -> Column:
    """Navigation (bars), boilerplate phrases, shouting punctuation, or a line of prose length that does not end as a sentence."""
    bars = F.length(line) - _stripped_length(line, BARS) > MAX_BARS
    shouts = F.regexp_count(line, F.lit(SHOUT)) > MAX_SHOUTS
    boilerplate = F.lower(line).rlike(BOILERPLATE)
    unended = (F.length(line) >= MIN_LINE_CHARS_UNENDED) & ~line.rlike(ENDING)
    return bars | shouts | unended | boilerplate


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base statistics, the verdict and the cleaned text of every document, one row for each input row.

    Returns (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed,
    text). Words are runs of non-white-space. A null text has no words and fails; so does an empty one. kept is false if
    base_failed, else whether the lines that pass hold KEEP_PERCENT of the characters of all lines with a word, or more.
    Blank lines are neutral and stay. Repeated rows get equal results; an empty table gives an empty table; other
    columns of `docs` are not read. Windows of words are compared by 64-bit hash within a document.
    """
    t = F.coalesce(F.col("t"), F.lit(""))
    words = F.filter(F.split(F.col("t"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    lines = F.filter(F.split(t, "\n"), lambda x: _stripped_length(x, WHITE) > 0)
    counted = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    chars = lambda x: F.aggregate(F.transform(x, lambda y: F.length(y)), F.lit(0).cast("long"), lambda a, y: a + y)
    by_line = _let(
        lines,
        lambda x: _let(
            F.filter(x, lambda y: ~line_fails(y)),
            lambda good: F.struct(
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), (F.size(x) - F.size(good)).cast("long").alias("n_lines_removed"), chars(x).alias("all_chars"), chars(good).alias("good_chars")
            ),
        ),
    )
    measured = base.select("id", "t", counted.alias("w"), by_line.alias("l"))
    failed = (F.col("w.n_words") < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > REPEAT_PERCENT * F.col("w.n_words"))
    cleaned = F.array_join(F.filter(F.split(t, "\n"), lambda x: (_stripped_length(x, WHITE) == 0) | ~line_fails(x)), "\n")
    return measured.select(
        F.col("id").alias(id_col),
        "w.n_words",
        _stripped_length(t, WHITE).cast("long").alias("word_chars"),
        (F.length(t) - _stripped_length(t, SYMBOLS)).cast("long").alias("n_symbols"),
        "l.n_dup_lines",
        "w.n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * F.col("l.good_chars") >= KEEP_PERCENT * F.col("l.all_chars"))).alias("kept"),
        "l.n_lines_removed",
        cleaned.alias(text_col),
    )
