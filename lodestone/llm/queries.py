"""One registered query for each training-data operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_crf, line_dedup, mixing, ngram_join, quality_crf, quality_rules, span_dedup, toxicity_kernel, training_order
from .workspace import new_path, table

# Character sets of the contracts, as DuckDB strings.
SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, keep="none")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), keyed AS (
  SELECT *, {FOLD.format(f"trim(line, {SPACES})")} AS k FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id
"""


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.concat_ws(",", "items"), "utf-8"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated")
    )


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM grams),
windows AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
),
hits AS (SELECT doc_id, size, i, item_id FROM windows JOIN grams USING (size, gram)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify_language(table(spark, sf_dir, "documents"))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.write_training_order(table(spark, sf_dir, "documents"), new_path(spark, "shards"))


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = span_dedup.dedup_spans(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_sentences", "n_removed", "repeats_of", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("text")


_FAILS = rf"""(length(l) - length(translate(l, '{quality_rules.BARS}', '')) > {quality_rules.MAX_BARS}
  OR len(regexp_extract_all(l, '{quality_rules.SHOUT}')) > {quality_rules.MAX_SHOUTS}
  OR regexp_matches(lower(l), '{quality_rules.BOILERPLATE}')
  OR length(l) >= {quality_rules.MIN_LINE_CHARS_UNENDED} AND NOT regexp_matches(l, '{quality_rules.ENDING.replace("'", "''")}'))"""
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
again AS (SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM windows JOIN again USING (doc_id, g)) GROUP BY doc_id),
lines AS (SELECT doc_id, l, {_FAILS} AS fails FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE translate(l, {SPACES}, '') <> ''),
by_line AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (WHERE fails) AS n_lines_removed, sum(length(l)) AS chars, coalesce(sum(length(l)) FILTER (WHERE NOT fails), 0) AS good
  FROM lines GROUP BY doc_id
),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(translate(t, {SPACES}, '')) AS word_chars, length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')) AS n_symbols,
         coalesce(n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed
  FROM w LEFT JOIN repeated USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * coalesce(good, 0) >= {quality_rules.KEEP_PERCENT} * coalesce(chars, 0) AS kept, coalesce(n_lines_removed, 0) AS n_lines_removed
FROM base LEFT JOIN by_line USING (doc_id)
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_kernel.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: What the mix should hold of each language's tokens.
MIX = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_output, op2_span_dedup, op3_line_dedup, op4_quality_classifier, op5_quality_rules, op6_benchmark_decontamination, op7_toxicity, op8_language_id, op9_ngram_jaccard_join, op10_source_mixing,
    )
}
ORACLES = {"op3_line_dedup": OP3_SQL, "op5_quality_rules": OP5_SQL, "op6_benchmark_decontamination": OP6_SQL, "op9_ngram_jaccard_join": OP9_SQL}
