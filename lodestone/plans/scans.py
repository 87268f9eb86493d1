"""Queries over documents as files: scans, suppression, summaries, scores, clones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import findings as fi
from ..sources.text import files_from_documents, lines
from .registry import query

TODAY = "2024-06-01"
WAIVERS = [(1, "quality.email", "en/*/*", None), (2, "*", "fr/src1/**", "2030-01-01"), (3, "*", "de/**", "2020-01-01")]


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines(files_from_documents(spark, sf))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return fi.enrich(fi.scan(_lines(spark, sf)), fi.rules_frame(spark))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FILES = "files AS (SELECT lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) AS path, doc_id, source, lang, coalesce(text, '') AS text FROM documents)"
LINES = FILES + ", lines AS (SELECT path, doc_id, source, lang, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS line_text FROM files)"
RULES = "rules(rule_id, section, default_level, title, weight, pattern) AS (VALUES " + ", ".join(f"({_quote(r.id)}, {_quote(r.section)}, {_quote(r.level)}, {_quote(r.message)}, {r.weight}, {_quote(r.pattern)})" for r in fi.TEXT_RULES) + ")"
FOUND = f"""{LINES}, {RULES}, findings AS (
  SELECT rule_id, default_level AS severity, section, path, line, title AS message, sha256(rule_id || '|' || path || '|' || CAST(line AS VARCHAR) || '|' || title) AS fingerprint
  FROM lines JOIN rules ON regexp_matches(line_text, pattern)
)"""
with_found = f"WITH {FOUND} "
PART = "CAST(split_part(path, '/', 3) AS BIGINT)"


@query("scan_findings", with_found + "SELECT * FROM findings")
def scan_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf)


@query("section_summary", with_found + "SELECT section, count(*) AS findings, count(DISTINCT path) AS files, CASE max(CASE severity WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS status FROM findings GROUP BY section")
def section_summary(spark: SparkSession, sf: str) -> DataFrame:
    return fi.section_summary(_findings(spark, sf))


@query("report_summary", with_found + "SELECT count(*) AS findings, count(*) FILTER (WHERE severity = 'fail') AS fails, count(DISTINCT path) AS files, count(DISTINCT rule_id) AS rules FROM findings")
def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "fail").alias("fails"), F.countDistinct("path").alias("files"), F.countDistinct("rule_id").alias("rules"))


@query("scan_high_entropy", f"""WITH {LINES}, w AS (SELECT path, line, unnest(regexp_extract_all(line_text, '[A-Za-z0-9]{{16,}}')) AS token FROM lines),
c AS (SELECT DISTINCT token, unnest(string_split(token, '')) AS ch, length(token) AS n FROM w), d AS (SELECT token, len(list_filter(string_split(token, ''), lambda x: x = ch)) AS k, n FROM (SELECT DISTINCT token, ch, n FROM c)),
e AS (SELECT token, round(-sum((k / n) * log2(k / n)), 6) AS entropy FROM d GROUP BY token) SELECT path, line, token, entropy FROM w JOIN e USING (token) WHERE entropy >= 3.5""")
def scan_high_entropy(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _lines(spark, sf).select("path", "line", F.explode(F.regexp_extract_all("line_text", F.lit("[A-Za-z0-9]{16,}"), F.lit(0))).alias("token"))
    chars = F.split("token", "")
    n = F.length("token")
    part = lambda ch: F.size(F.filter(chars, lambda x: x == ch)) / n
    entropy = -F.aggregate(F.transform(F.array_distinct(chars), lambda ch: part(ch) * F.log2(part(ch))), F.lit(0.0), lambda a, x: a + x)
    return tokens.withColumn("entropy", F.round(entropy, 6)).where("entropy >= 3.5")


@query("scan_prompt_rules", "SELECT conv_id, turn, role, CASE WHEN regexp_matches(lower(text), 'ignore (all|any|the|previous) ') THEN 'prompts.override' ELSE 'prompts.long-turn' END AS rule_id FROM conversations WHERE regexp_matches(lower(text), 'ignore (all|any|the|previous) ') OR length(text) > 600")
def scan_prompt_rules(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    override = F.lower("text").rlike("ignore (all|any|the|previous) ")
    return t.where(override | (F.length("text") > 600)).select("conv_id", "turn", "role", F.when(override, "prompts.override").otherwise("prompts.long-turn").alias("rule_id"))


@query("context_window_fingerprint", f"""WITH {LINES}, f AS (SELECT path, line, trim(regexp_replace(line_text, '[ \\t]+', ' ', 'g')) AS t FROM lines)
SELECT path, line, sha256(path || '|' || string_agg(t, chr(10)) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS context_fingerprint FROM f""")
def context_window_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    windows = fi.context_fingerprint(files_from_documents(spark, sf))
    return windows.select("path", "line", F.sha2(F.concat_ws("|", "path", "window"), 256).alias("context_fingerprint"))


def _reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Precedence: baseline (documents with ids divisible by 7), waiver, inline (lines at or after one with a mail address)."""
    found = _findings(spark, sf)
    base = found.where(F.pmod(F.element_at(F.split("path", "/"), -1).cast("long"), F.lit(7)) == 0).select("fingerprint").distinct().withColumn("in_base", F.lit(True))
    marks = fi.inline_directives(_lines(spark, sf), "@").select("path", F.explode(F.array("d_line", F.col("d_line") + 1)).alias("line")).distinct().withColumn("in_line", F.lit(True))
    joined = found.join(base, "fingerprint", "left").join(marks, ["path", "line"], "left")
    reason = F.when(F.col("in_base"), "baseline").when(fi.waived_by(found, WAIVERS, TODAY).isNotNull(), "waiver").when(F.col("in_line") & (F.col("rule_id") != "quality.email"), "inline")
    return joined.select(*found.columns, reason.alias("reason"))


WAIVED = "((rule_id = 'quality.email' AND regexp_matches(path, '^en/[^/]*/[^/]*$')) OR regexp_matches(path, '^fr/src1/.*$'))"
REASONS = with_found + f""", base AS (SELECT DISTINCT fingerprint FROM findings WHERE {PART} % 7 = 0),
marks AS (SELECT DISTINCT path, line FROM (SELECT path, line FROM lines WHERE contains(line_text, '@') UNION ALL SELECT path, line + 1 FROM lines WHERE contains(line_text, '@'))),
reasons AS (SELECT f.*, CASE WHEN b.fingerprint IS NOT NULL THEN 'baseline' WHEN {WAIVED.replace("path", "f.path")} THEN 'waiver' WHEN m.path IS NOT NULL AND rule_id <> 'quality.email' THEN 'inline' END AS reason
  FROM findings f LEFT JOIN base b USING (fingerprint) LEFT JOIN marks m ON m.path = f.path AND m.line = f.line) """


@query("suppressed_findings", REASONS + "SELECT rule_id, path, line, reason FROM reasons")
def suppressed_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _reasons(spark, sf).select("rule_id", "path", "line", "reason")


@query("rule_stats", REASONS + """SELECT rule_id, count(*) FILTER (WHERE reason IS NULL) AS emitted, count(*) FILTER (WHERE reason = 'baseline') AS baseline, count(*) FILTER (WHERE reason = 'waiver') AS waiver,
count(*) FILTER (WHERE reason = 'inline') AS inline, round(count(reason) / count(*), 6) AS ratio FROM reasons GROUP BY rule_id""")
def rule_stats(spark: SparkSession, sf: str) -> DataFrame:
    return fi.rule_stats(_reasons(spark, sf))


@query("baseline_suppression", with_found + f"SELECT rule_id, path, line FROM findings WHERE fingerprint NOT IN (SELECT fingerprint FROM findings WHERE {PART} % 7 = 0)")
def baseline_suppression(spark: SparkSession, sf: str) -> DataFrame:
    found = _findings(spark, sf)
    base = found.where(F.pmod(F.element_at(F.split("path", "/"), -1).cast("long"), F.lit(7)) == 0)
    return fi.without_baseline(found, base).select("rule_id", "path", "line")


@query("inline_suppression", with_found + "SELECT rule_id, path, line FROM findings f WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.path = f.path AND contains(l.line_text, 'cense') AND f.line IN (l.line, l.line + 1))")
def inline_suppression(spark: SparkSession, sf: str) -> DataFrame:
    return fi.without_inline(_findings(spark, sf), fi.inline_directives(_lines(spark, sf), "cense")).select("rule_id", "path", "line")


@query("waiver_audit", with_found + f"""SELECT idx, coalesce(n, 0) AS matches, CASE WHEN idx = 3 THEN 'expired' WHEN coalesce(n, 0) = 0 THEN 'unused' ELSE 'active' END AS status FROM (VALUES (1), (2), (3)) w(idx) LEFT JOIN
(SELECT CASE WHEN rule_id = 'quality.email' AND regexp_matches(path, '^en/[^/]*/[^/]*$') THEN 1 ELSE 2 END AS idx, count(DISTINCT fingerprint) AS n FROM findings WHERE {WAIVED} GROUP BY 1) USING (idx)""")
def waiver_audit(spark: SparkSession, sf: str) -> DataFrame:
    found = _findings(spark, sf)
    hits = found.withColumn("idx", fi.waived_by(found, WAIVERS, TODAY)).where("idx is not null").groupBy("idx").agg(F.countDistinct("fingerprint").alias("n"))
    all_waivers = spark.createDataFrame([(i, e is not None and e < TODAY) for i, _, _, e in WAIVERS], "idx int, expired boolean")
    status = F.when(F.col("expired"), "expired").when(F.coalesce("n", F.lit(0)) == 0, "unused").otherwise("active")
    return F.broadcast(all_waivers).join(hits, "idx", "left").select("idx", F.coalesce("n", F.lit(0)).cast("long").alias("matches"), status.alias("status"))


@query("diff_scope_filter", with_found + f"SELECT rule_id, path, line FROM findings WHERE {PART} % 3 = 0 AND (({PART} % 2 = 0) OR line BETWEEN 1 + {PART} % 5 AND 6 + {PART} % 5)")
def diff_scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    ranges = files_from_documents(spark, sf).where(i % 3 == 0).select("path", (i % 2 == 0).alias("all_changed"), (1 + i % 5).cast("int").alias("lo"), (6 + i % 5).cast("int").alias("hi"))
    return fi.in_scope(_findings(spark, sf), ranges).select("rule_id", "path", "line")


@query("language_score", with_found + "SELECT split_part(path, '/', 1) AS lang, CAST(least(sum(weight) * 10, 100) AS BIGINT) AS score, count(*) AS signals FROM findings JOIN rules USING (rule_id) GROUP BY 1")
def language_score(spark: SparkSession, sf: str) -> DataFrame:
    return fi.weighted_score(_findings(spark, sf).withColumn("lang", F.split("path", "/")[0]), fi.rules_frame(spark), "lang")


@query("file_risk_rank", with_found + """, s AS (SELECT path, CAST(least(sum(weight) * 5, 100) AS BIGINT) AS score, count(*) AS signals FROM findings JOIN rules USING (rule_id) GROUP BY path)
SELECT path, score, signals, CAST(row_number() OVER (ORDER BY score DESC, signals DESC, path) AS INTEGER) AS rank FROM s ORDER BY rank LIMIT 20""")
def file_risk_rank(spark: SparkSession, sf: str) -> DataFrame:
    return fi.file_risk(_findings(spark, sf), fi.rules_frame(spark), 20)


@query("production_risk", with_found + """SELECT split_part(path, '/', 2) AS source, count(*) AS findings, CAST(least(100, sum(CASE WHEN rule_id LIKE 'security.%' THEN 12 WHEN rule_id LIKE 'supply_chain.%' THEN 15 ELSE 5 END + CASE severity WHEN 'fail' THEN 25 ELSE 10 END)) AS BIGINT) AS score FROM findings GROUP BY 1""")
def production_risk(spark: SparkSession, sf: str) -> DataFrame:
    family = F.when(F.col("rule_id").startswith("security."), 12).when(F.col("rule_id").startswith("supply_chain."), 15).otherwise(5)
    weight = family + F.when(F.col("severity") == "fail", 25).otherwise(10)
    return _findings(spark, sf).groupBy(F.split("path", "/")[1].alias("source")).agg(F.count(F.lit(1)).alias("findings"), F.least(F.lit(100), F.sum(weight)).cast("long").alias("score"))


@query("duplicate_helper", f"WITH {FILES}, n AS (SELECT path, trim(regexp_replace(lower(text), '[ \\t\\n]+', ' ', 'g')) AS body FROM files) SELECT min(path) AS first_path, count(*) AS copies FROM n WHERE length(body) >= 40 GROUP BY body HAVING count(*) > 1")
def duplicate_helper(spark: SparkSession, sf: str) -> DataFrame:
    body = F.trim(F.regexp_replace(F.lower("text"), "[ \\t\\n]+", " "))
    n = files_from_documents(spark, sf).select("path", body.alias("body")).where(F.length("body") >= 40)
    return n.groupBy(F.sha2("body", 256)).agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("first_path", "copies")


@query("clone_blocks", f"""WITH {LINES}, b AS (SELECT path, line, string_agg(lower(trim(line_text)), chr(10)) OVER w AS block, count(*) OVER w AS n FROM lines WINDOW w AS (PARTITION BY path ORDER BY line ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
s AS (SELECT block, count(DISTINCT path) AS files, count(*) AS places, min(path) AS first_path FROM b WHERE n = 3 AND length(block) >= 60 GROUP BY block HAVING count(DISTINCT path) > 1) SELECT sha256(block) AS block_hash, files, places, first_path FROM s""")
def clone_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Clones as groups of equal three-line blocks, not pairs: linear in the number of lines. Blocks are cut from the split text, so only they are shuffled."""
    flat = F.transform(F.split("text", "\n"), lambda x: F.lower(F.trim(x)))
    l = files_from_documents(spark, sf).select("path", flat.alias("l")).where(F.size("l") >= 3)  # noqa: E741
    blocks = F.transform(F.sequence(F.lit(1), F.size("l") - 2), lambda i: F.array_join(F.slice("l", i, 3), "\n"))
    b = l.select("path", F.explode(F.filter(blocks, lambda x: F.length(x) >= 60)).alias("block"))
    return b.groupBy(F.sha2("block", 256).alias("block_hash")).agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("places"), F.min("path").alias("first_path")).where("files > 1")


@query("oversized_units", f"WITH {FILES} SELECT path, length(text) AS chars, CAST(len(string_split(rtrim(text, chr(10)), chr(10))) AS BIGINT) AS n_lines FROM files WHERE length(text) > 8000 OR len(string_split(rtrim(text, chr(10)), chr(10))) > 60")
def oversized_units(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(F.split(F.regexp_replace("text", "\\n+\\z", ""), "\n")).cast("long")
    return files_from_documents(spark, sf).select("path", F.length("text").cast("long").alias("chars"), n.alias("n_lines")).where("chars > 8000 or n_lines > 60")


@query("dominant_style", f"""WITH {FILES}, s AS (SELECT source, CASE WHEN contains(text, '|') THEN 'table' WHEN contains(text, chr(10)) THEN 'prose' ELSE 'line' END AS style FROM files), c AS (SELECT source, style, count(*) AS n FROM s GROUP BY ALL)
SELECT source, arg_max(style, n * 10 + CASE style WHEN 'line' THEN 2 WHEN 'prose' THEN 1 ELSE 0 END) AS style, CAST(max(n) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY source HAVING sum(n) >= 3""")
def dominant_style(spark: SparkSession, sf: str) -> DataFrame:
    style = F.when(F.col("text").contains("|"), "table").when(F.col("text").contains("\n"), "prose").otherwise("line")
    c = files_from_documents(spark, sf).groupBy("source", style.alias("style")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.col("n") * 10 + F.when(F.col("style") == "line", 2).when(F.col("style") == "prose", 1).otherwise(0)
    return c.groupBy("source").agg(F.max_by("style", rank).alias("style"), F.max("n").alias("n"), F.sum("n").alias("total")).where("total >= 3")


@query("ambiguous_basenames", "SELECT source, count(DISTINCT lang) AS dirs, count(*) AS files FROM documents GROUP BY source HAVING count(DISTINCT lang) > 2")
def ambiguous_basenames(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").agg(F.countDistinct("lang").alias("dirs"), F.count(F.lit(1)).alias("files")).where("dirs > 2")


@query("license_policy", f"WITH {LINES} SELECT DISTINCT path, name FROM (SELECT path, unnest(regexp_extract_all(line_text, '(GNU|Apache|MIT|CC BY[-A-Z]*)')) AS name FROM lines WHERE contains(line_text, 'icense')) WHERE name IN ('GNU', 'CC BY-NC')")
def license_policy(spark: SparkSession, sf: str) -> DataFrame:
    names = F.regexp_extract_all("line_text", F.lit("(GNU|Apache|MIT|CC BY[-A-Z]*)"), F.lit(1))
    return _lines(spark, sf).where(F.col("line_text").contains("icense")).select("path", F.explode(names).alias("name")).where(F.col("name").isin("GNU", "CC BY-NC")).distinct()


@query("history_secret_dedupe", f"WITH {LINES} SELECT line_text, max(doc_id) AS newest, count(*) AS seen FROM lines WHERE regexp_matches(line_text, {_quote(fi.TEXT_RULES[0].pattern)}) GROUP BY line_text")
def history_secret_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).where(F.col("line_text").rlike(fi.TEXT_RULES[0].pattern)).groupBy("line_text").agg(F.max("doc_id").alias("newest"), F.count(F.lit(1)).alias("seen"))


@query("dead_links", "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) SELECT link, count(DISTINCT page_id) AS pages FROM l WHERE link NOT IN (SELECT url FROM pages WHERE url IS NOT NULL) GROUP BY link")
def dead_links(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.join(pages.select(F.col("url").alias("link")), "link", "left_anti").groupBy("link").agg(F.countDistinct("page_id").alias("pages"))


@query("doc_legibility", "SELECT source, CAST(sum(CASE WHEN length(text) < 20000 THEN 25 ELSE 0 END + CASE WHEN contains(text, chr(10)) THEN 20 ELSE 0 END) // count(*) AS BIGINT) AS score FROM documents GROUP BY source")
def doc_legibility(spark: SparkSession, sf: str) -> DataFrame:
    points = F.when(F.length("text") < 20000, 25).otherwise(0) + F.when(F.col("text").contains("\n"), 20).otherwise(0)
    return spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").agg(F.sum(points).alias("s"), F.count(F.lit(1)).alias("n")).select("source", F.expr("s div n").alias("score"))
