"""Queries over secrets, rule packs, sinks, scores, versions, clones, caches and naming, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clones, rulepacks, scores, secrets
from ..operators import findings as fi
from ..operators import graph as g
from ..sinks import history, reports
from ..sources import manifests
from ..sources.text import files_from_documents, lines
from .graphs import EDGES, edges
from .registry import query
from .scans import FILES, LINES, _quote, with_found


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines(files_from_documents(spark, sf))


SECRET_NAME = "(?i)(?:secret|token|api_?key|password|passwd)[ ]*[:=][ ]*([^ \t,;]{6,})"
MASK = "CASE WHEN length({0}) >= 12 THEN {0}[1:4] || '…' || {0}[-4:] ELSE '…' END"


@query("scan_secret_assignment", f"""WITH {LINES}, v AS (SELECT path, line, regexp_extract(line_text, {_quote(SECRET_NAME)}, 1) AS value FROM lines)
SELECT path, line, {MASK.format("value")} AS masked FROM v WHERE value <> '' AND NOT regexp_matches(value, {_quote(secrets.PLACEHOLDER)}) AND length(replace(value, value[1], '')) > 0""")
def scan_secret_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Values given to names of secrets, masked; placeholders are none. Documents write them without quotes."""
    value = F.regexp_extract("line_text", SECRET_NAME, 1)
    v = _lines(spark, sf).select("path", "line", value.alias("value")).where("value <> ''")
    return v.where(~secrets.is_placeholder(F.col("value"))).select("path", "line", secrets.masked(F.col("value")).alias("masked"))


CREDENTIALS = " UNION ALL ".join(f"SELECT path, line, {_quote(name)} AS provider, regexp_extract(line_text, {_quote(p)}, 1) AS value FROM lines" for name, p in secrets.PROVIDERS)


@query("scan_credentials", f"""WITH {LINES}, v AS ({CREDENTIALS})
SELECT path, line, provider || ': ' || {MASK.format("value")} AS message FROM v WHERE value <> '' AND NOT regexp_matches(value, {_quote(secrets.PLACEHOLDER)}) AND length(replace(value, value[1], '')) > 0
UNION ALL SELECT path, line, 'private key block' FROM lines WHERE regexp_matches(line_text, {_quote(secrets.KEY_BLOCK)})""")
def scan_credentials(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan_secrets(_lines(spark, sf))
    return found.where(F.col("rule_id").isin(secrets.CREDENTIAL, secrets.PRIVATE_KEY)).select("path", "line", "message")


PACK = [
    {"id": "pack.licence", "pattern": "(?i)licen[cs]ed under", "paths": ["en/**"], "level": "fail"},
    {"id": "pack.address", "pattern": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "exclude": ["de/**"], "unless": "^[0-9.]+$"},
    {"id": "pack.source", "path_pattern": "/src1/[0-9]*7$"},
]


@query("scan_custom_rulepack", f"""WITH {LINES} SELECT rule_id, severity, path, line FROM (
SELECT 'pack.licence' AS rule_id, 'fail' AS severity, path, line FROM lines WHERE path LIKE 'en/%' AND regexp_matches(line_text, '(?i)licen[cs]ed under') UNION ALL
SELECT 'pack.address', 'warn', path, line FROM lines WHERE NOT starts_with(path, 'de/') AND regexp_matches(line_text, '[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}') AND NOT regexp_matches(line_text, '^[0-9.]+$') UNION ALL
SELECT 'pack.source', 'warn', path, NULL FROM lines WHERE line = 1 AND regexp_matches(path, '/src1/[0-9]*7$'))""")
def scan_custom_rulepack(spark: SparkSession, sf: str) -> DataFrame:
    return rulepacks.run_pack(_lines(spark, sf), rulepacks.compile_pack(PACK)).select("rule_id", "severity", "path", "line")


@query("findings_with_context", with_found + """, f AS (SELECT path, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))) AS l FROM files)
SELECT rule_id, f.path, line, sha256(rule_id || '|' || f.path || '|' || array_to_string(l[greatest(line - 2, 1):line + 2], chr(10))) AS context_fingerprint FROM findings JOIN f USING (path)""")
def findings_with_context(spark: SparkSession, sf: str) -> DataFrame:
    files = files_from_documents(spark, sf)
    found = fi.enrich(fi.scan(lines(files)), fi.rules_frame(spark))
    return fi.with_context(found, files).select("rule_id", "path", "line", "context_fingerprint")


@query("annotation_lines", with_found + """SELECT '::' || CASE severity WHEN 'fail' THEN 'error' ELSE 'warning' END || ' file=' || path || ',line=' || CAST(line AS VARCHAR) || ',col=1::[' || rule_id || '] ' || replace(message, '%', '%25') || '. Fix: see rule guidance' AS line_text FROM findings""")
def annotation_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = fi.enrich(fi.scan(_lines(spark, sf)), fi.rules_frame(spark))
    return reports.annotation_lines(found).select("line_text")


@query("baseline_entries", with_found + "SELECT fingerprint, rule_id, path, line, message FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY rule_id, path, line) AS r FROM findings) WHERE r = 1")
def baseline_entries(spark: SparkSession, sf: str) -> DataFrame:
    return reports.baseline_entries(fi.enrich(fi.scan(_lines(spark, sf)), fi.rules_frame(spark)))


PART_DEPS = "deps AS (SELECT p_type AS path, CASE p_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'python' ELSE 'cargo' END AS ecosystem, p_brand AS name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_partkey % 5 AS VARCHAR) || '.' || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 7 = 0 THEN '.1-beta' ELSE '.0' END END AS version, '' AS requirement, p_partkey AS k FROM part)"


def _part_deps(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    ecosystem = F.when(k % 3 == 0, "npm").when(k % 3 == 1, "python").otherwise("cargo")
    version = F.when(k % 4 == 0, "").otherwise(F.concat((k % 5).cast("string"), F.lit("."), F.col("p_size").cast("string"), F.when(k % 7 == 0, ".1-beta").otherwise(".0")))
    return _t(spark, sf, "part").select(F.col("p_type").alias("path"), ecosystem.alias("ecosystem"), F.col("p_brand").alias("name"), version.alias("version"), F.lit("").alias("requirement"), k.alias("k"))


@query("bill_of_materials", f"""WITH {PART_DEPS} SELECT DISTINCT 'dependency:' || ecosystem || ':' || path || ':' || name || '@' || v AS ref,
'pkg:' || CASE ecosystem WHEN 'python' THEN 'pypi' ELSE ecosystem END || '/' || name || CASE WHEN regexp_matches(v, '^v?[0-9]+([.][0-9A-Za-z+-]+)*$') THEN '@' || v ELSE '' END AS purl FROM (SELECT *, CASE WHEN version = '' THEN 'unspecified' ELSE version END AS v FROM deps)""")
def bill_of_materials(spark: SparkSession, sf: str) -> DataFrame:
    return reports.components(_part_deps(spark, sf)).select("ref", "purl")


ADVISORIES = [("A1", "NPM", "brand#11", ">=1.0,<3.20", "3.20"), ("A2", "python", "Brand#22", "<2.10.1", "2.11"), ("A3", "cargo", "Brand#33", "=4.7.0", ""), ("A4", "npm", "Brand#44", "soon", "")]
VERSIONS = "v AS (SELECT *, list_transform(string_split(regexp_replace(version, '[-+].*$', ''), '.'), lambda x: CAST(x AS INTEGER)) AS parts, parts[1] * 1000000 + parts[2] * 1000 + parts[3] AS p FROM deps WHERE version <> '')"


@query("vulnerable_dependencies", f"""WITH {PART_DEPS}, {VERSIONS} SELECT k, 'A1' AS id FROM v WHERE ecosystem = 'npm' AND lower(name) = 'brand#11' AND p >= 1000000 AND p < 3020000
UNION ALL SELECT k, 'A2' FROM v WHERE ecosystem = 'python' AND lower(name) = 'brand#22' AND p < 2010001 UNION ALL SELECT k, 'A3' FROM v WHERE ecosystem = 'cargo' AND lower(name) = 'brand#33' AND p = 4007000""")
def vulnerable_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([(*a, "high") for a in ADVISORIES], "id string, ecosystem string, package string, affected string, fixed string, severity string")
    return manifests.vulnerable(_part_deps(spark, sf).withColumn("line", F.col("k")), known).select(F.col("line").alias("k"), "id")


# Events as findings: the rule by the event's id, the path by its user.
EVENT_RULES = ("quality.ai.swallowed-error", "quality.ai.dead-code", "quality.ai.semantic-doc-mismatch", "quality.coverage-delta", "performance.n-plus-one-query", "performance.go.sleep-in-loop", "data.unbounded-read", "reliability.missing-timeout", "change.oversized-diff", "security.weak-hash")
EVENT_FINDINGS = "f AS (SELECT user_id AS path, ([" + ", ".join(_quote(r) for r in EVENT_RULES) + "])[event_id % 10 + 1] AS rule_id, CASE event_id % 3 WHEN 0 THEN 'fail' ELSE 'warn' END AS severity, ['high', 'medium', 'low'][event_id % 7 % 3 + 1] AS confidence, event_id FROM events)"


def _event_findings(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    return _t(spark, sf, "events").select(F.col("user_id").alias("path"), pick(EVENT_RULES, i % 10).alias("rule_id"), F.when(i % 3 == 0, "fail").otherwise("warn").alias("severity"), pick(("high", "medium", "low"), i % 7 % 3).alias("confidence"), "event_id")


LEVEL = "CASE WHEN score >= {1} THEN 'fail' WHEN score >= {0} THEN 'warn' ELSE 'pass' END AS level"
SLOP = "CASE rule_id WHEN 'quality.ai.swallowed-error' THEN 4 WHEN 'quality.ai.dead-code' THEN 3 WHEN 'quality.ai.semantic-doc-mismatch' THEN 3 END"


@query("slop_score", f"WITH {EVENT_FINDINGS}, s AS (SELECT path, CAST(least(10 * sum({SLOP}), 100) AS BIGINT) AS score, count({SLOP}) AS signals FROM f WHERE {SLOP} IS NOT NULL GROUP BY path) SELECT path, score, signals, {LEVEL.format(20, 40)} FROM s")
def slop_score(spark: SparkSession, sf: str) -> DataFrame:
    return scores.saturated(_event_findings(spark, sf), scores.slop_weight(F.col("rule_id")), ["path"])


@query("performance_score", f"WITH {EVENT_FINDINGS}, s AS (SELECT path, CAST(least(10 * sum(w), 100) AS BIGINT) AS score, count(*) AS signals FROM (SELECT path, CASE rule_id WHEN 'performance.n-plus-one-query' THEN 5 WHEN 'performance.go.sleep-in-loop' THEN 2 END AS w FROM f) WHERE w IS NOT NULL GROUP BY path) SELECT path, score, signals, {LEVEL.format(20, 40)} FROM s")
def performance_score(spark: SparkSession, sf: str) -> DataFrame:
    return scores.saturated(_event_findings(spark, sf), scores.performance_weight(F.col("rule_id")), ["path"])


@query("change_risk", f"""WITH {EVENT_FINDINGS}, a AS (SELECT path, least(10 * sum(coalesce({SLOP}, 0)), 100) AS slop, count(*) FILTER (WHERE rule_id LIKE 'quality.ai.%') AS ai_findings, count(*) FILTER (WHERE rule_id = 'quality.ai.semantic-doc-mismatch') AS semantic_findings,
bool_or(rule_id = 'quality.coverage-delta') AS gap, max(event_id % 8) AS files, bool_or(event_id % 11 = 0) AS marked FROM f GROUP BY path),
s AS (SELECT *, CAST(least(100, least(slop // 2, 50) + CASE WHEN marked THEN 15 ELSE 0 END + CASE WHEN files >= 5 THEN 10 WHEN files >= 2 THEN 5 ELSE 0 END + least(5 * semantic_findings, 15) + CASE WHEN gap THEN 10 ELSE 0 END) AS BIGINT) AS score FROM a)
SELECT path, score, {LEVEL.format(30, 60)}, ai_findings, semantic_findings FROM s WHERE score > 0""")
def change_risk(spark: SparkSession, sf: str) -> DataFrame:
    return scores.change_risk(_event_findings(spark, sf), F.col("event_id") % 8, F.col("event_id") % 11 == 0, ["path"])


FAMILY = "CASE WHEN rule_id LIKE 'change.%' THEN 'change_safety' WHEN rule_id LIKE 'quality.ai.%' THEN 'ai_quality' WHEN rule_id LIKE 'quality.%' THEN 'maintainability' END"
WEIGHT = "CASE severity WHEN 'fail' THEN 35 ELSE 18 END + CASE confidence WHEN 'high' THEN 5 WHEN 'low' THEN -5 ELSE 0 END"


def _families(spark: SparkSession, sf: str) -> DataFrame:
    rule = F.col("rule_id")
    return scores.family_metric(_event_findings(spark, sf), [("change_safety", rule.startswith("change.")), ("ai_quality", rule.startswith("quality.ai.")), ("maintainability", rule.startswith("quality."))], ["path"])


@query("pr_summary_metrics", f"WITH {EVENT_FINDINGS} SELECT path, label, count(*) AS count, CAST(max(w) AS BIGINT) AS weight, CAST(sum(w) AS BIGINT) AS contribution FROM (SELECT path, {FAMILY} AS label, {WEIGHT} AS w FROM f) WHERE label IS NOT NULL GROUP BY path, label")
def pr_summary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _families(spark, sf)


@query("pr_summary_score", f"WITH {EVENT_FINDINGS}, s AS (SELECT path, CAST(least(sum(w), 100) AS BIGINT) AS score FROM (SELECT path, {FAMILY} AS label, {WEIGHT} AS w FROM f) WHERE label IS NOT NULL GROUP BY path) SELECT path, score, {LEVEL.format(35, 70)} FROM s")
def pr_summary_score(spark: SparkSession, sf: str) -> DataFrame:
    return scores.family_score(_families(spark, sf), ["path"]).select("path", "score", "level")


@query("production_risk_components", f"""WITH {EVENT_FINDINGS} SELECT label, count(*) AS count, CAST(max(w) AS BIGINT) AS weight, CAST(sum(w) AS BIGINT) AS contribution FROM
(SELECT CASE WHEN rule_id LIKE 'reliability.%' THEN 'reliability' WHEN rule_id LIKE 'data.%' THEN 'data_correctness' END AS label, CASE WHEN rule_id LIKE 'reliability.%' THEN 12 ELSE 15 END + CASE severity WHEN 'fail' THEN 25 ELSE 10 END AS w FROM f) WHERE label IS NOT NULL GROUP BY label""")
def production_risk_components(spark: SparkSession, sf: str) -> DataFrame:
    return scores.production_components(_event_findings(spark, sf))


@query("corpus_evaluation", f"""WITH {EVENT_FINDINGS}, hit AS (SELECT DISTINCT path AS c, rule_id FROM f WHERE event_id % 4 <> 0), want AS (SELECT path AS c, rule_id, bool_and(event_id % 5 = 0) AS gap FROM f WHERE event_id % 6 <> 1 GROUP BY ALL),
j AS (SELECT coalesce(h.rule_id, w.rule_id) AS rule_id, h.c IS NOT NULL AS hit, w.c IS NOT NULL AS want, coalesce(gap, false) AS gap FROM hit h FULL JOIN want w ON h.c = w.c AND h.rule_id = w.rule_id),
n AS (SELECT rule_id, count(*) FILTER (WHERE hit AND want) AS tp, count(*) FILTER (WHERE hit AND NOT want) AS fp, count(*) FILTER (WHERE NOT hit AND want AND NOT gap) AS fn, count(*) FILTER (WHERE NOT hit AND gap) AS known_gaps FROM j GROUP BY rule_id)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall FROM n""")
def corpus_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    f = _event_findings(spark, sf).withColumnRenamed("path", "case")
    return scores.corpus_evaluation(f.where("event_id % 6 <> 1").withColumn("known_gap", F.col("event_id") % 5 == 0), f.where("event_id % 4 <> 0"))


@query("triage_filter", f"WITH {EVENT_FINDINGS}, v AS (SELECT path, CASE arg_max(event_id % 2, event_id) WHEN 0 THEN 'dismiss' ELSE 'keep' END AS verdict FROM f WHERE event_id % 9 = 0 GROUP BY path) SELECT rule_id, path, event_id FROM f WHERE path NOT IN (SELECT path FROM v WHERE verdict = 'dismiss')")
def triage_filter(spark: SparkSession, sf: str) -> DataFrame:
    f = _event_findings(spark, sf).withColumn("fingerprint", F.col("path"))
    verdicts = f.where("event_id % 9 = 0").select("fingerprint", F.when(F.col("event_id") % 2 == 0, "dismiss").otherwise("keep").alias("verdict"), F.col("event_id").alias("at"))
    return fi.kept_after_triage(f, verdicts).select("rule_id", "path", "event_id")


@query("clone_runs", f"""WITH {FILES}, one AS (SELECT min(path) AS path, arg_min(text, path) AS text FROM files GROUP BY sha256(lower(text))),
t AS (SELECT path, regexp_extract_all(lower(text), {_quote(clones.TOKEN)}) AS t FROM one), w AS (SELECT path, CAST(pos AS INTEGER) AS pos, array_to_string(t[pos + 1:pos + 40], ' ') AS h FROM (SELECT path, t, unnest(range(0, len(t) - 39)) AS pos FROM t WHERE len(t) >= 40)),
a AS (SELECT h, min((path, pos)) AS x FROM w GROUP BY h HAVING count(*) > 1), m AS (SELECT x[1] AS path_a, x[2] AS pos_a, path AS path_b, pos AS pos_b, pos - x[2] AS d FROM w JOIN a USING (h) WHERE path <> x[1] OR pos >= x[2] + 40),
s AS (SELECT *, CASE WHEN pos_b - lag(pos_b) OVER o <= 40 THEN 0 ELSE 1 END AS st FROM m WINDOW o AS (PARTITION BY path_a, path_b, d ORDER BY pos_b)), r AS (SELECT *, sum(st) OVER (PARTITION BY path_a, path_b, d ORDER BY pos_b) AS run FROM s)
SELECT path_a, CAST(min(pos_a) AS INTEGER) AS start_a, path_b, CAST(min(pos_b) AS INTEGER) AS start_b, CAST(max(pos_b) - min(pos_b) + 40 AS INTEGER) AS tokens FROM r GROUP BY path_a, path_b, d, run""")
def clone_runs(spark: SparkSession, sf: str) -> DataFrame:
    return clones.clone_runs(files_from_documents(spark, sf), 40)


@query("unreachable_modules", f"WITH RECURSIVE {EDGES}, r AS (SELECT src AS node FROM e WHERE src % 5 = 0 UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT node FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) WHERE node NOT IN (SELECT node FROM r)")
def unreachable_modules(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    return g.unreachable(nodes, e, e.where("src % 5 = 0").select(F.col("src").alias("node")))


@query("rebuild_cascade", f"""WITH RECURSIVE {EDGES}, r AS (SELECT dst AS root, src AS node FROM e UNION SELECT r.root, e.src FROM r JOIN e ON e.dst = r.node), d AS (SELECT root AS node, count(*) AS dependents FROM r WHERE root <> node GROUP BY root), i AS (SELECT dst AS node, count(DISTINCT src) AS importers FROM e GROUP BY dst)
SELECT node, importers, dependents, CASE WHEN dependents > 2 THEN 'rebuild-amplifier' ELSE 'hot' END AS kind FROM i JOIN d USING (node) WHERE dependents > 2 OR importers > 1""")
def rebuild_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return g.rebuild_cascade(edges(spark, sf), 1, 2)


@query("stale_files", f"WITH {FILES} SELECT path FROM files WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0)")
def stale_files(spark: SparkSession, sf: str) -> DataFrame:
    """What a cache that knows every third document, of which every other with a text that has changed since, leaves to scan."""
    files = files_from_documents(spark, sf).select("path", "doc_id", F.sha2("text", 256).alias("sha256")).withColumn("section", F.lit("quality"))
    cache = files.where("doc_id % 3 = 0").select("section", "path", F.when(F.col("doc_id") % 2 == 0, F.col("sha256")).otherwise("old").alias("sha256"), F.lit("c1").alias("config_hash"))
    return history.stale(files, cache, "c1").select("path")


@query("naming_drift", f"""WITH {FILES}, n AS (SELECT source, path, len(regexp_extract_all(text, '(^|[^A-Za-z0-9_])[a-z]+_[a-z_]+')) AS snake, len(regexp_extract_all(text, '(^|[^A-Za-z0-9_])[A-Z][a-z]+')) AS capital FROM files),
d AS (SELECT source, CASE WHEN sum(snake) >= sum(capital) THEN 'snake' ELSE 'capital' END AS style FROM n GROUP BY source HAVING sum(snake) + sum(capital) >= 3)
SELECT path, style, CAST(CASE style WHEN 'snake' THEN capital ELSE snake END AS INTEGER) AS divergent FROM n JOIN d USING (source) WHERE CASE style WHEN 'snake' THEN capital ELSE snake END >= 2 AND CASE style WHEN 'snake' THEN capital > snake ELSE snake > capital END""")
def naming_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose names follow another convention than most of their source's do.

    Both patterns begin with their rarest character and look back from it; the one for snake case reads the text backwards, from the first underscore of a
    name. Texts are read once: the sums and the join take the counts from one shuffle.
    """
    n = lambda text, p: F.regexp_count(text, F.lit(p))
    snake, capital = n(F.reverse("text"), "_(?<=[a-z_]_)[a-z]++(?![A-Za-z0-9_])"), n("text", "[A-Z](?<![A-Za-z0-9_][A-Z])[a-z]")
    counts = files_from_documents(spark, sf).select("source", "path", snake.alias("snake"), capital.alias("capital")).repartition("path")
    whole = counts.groupBy("source").agg(F.sum("snake").alias("s"), F.sum("capital").alias("c")).where("s + c >= 3").select("source", F.when(F.col("s") >= F.col("c"), "snake").otherwise("capital").alias("style"))
    joined = counts.join(whole, "source")
    divergent, matching = (F.when(F.col("style") == a, F.col("capital")).otherwise(F.col("snake")) for a in ("snake", "capital"))
    return joined.where((divergent >= 2) & (divergent > matching)).select("path", "style", divergent.cast("int").alias("divergent"))


@query("keyword_complexity", f"WITH {FILES} SELECT path, CAST(1 + len(regexp_extract_all(text, '(?i)(^|[^A-Za-z0-9_])(if|for|while|case|catch)[^A-Za-z0-9_]')) AS INTEGER) AS complexity FROM files WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(if|for|while|case|catch)[^A-Za-z0-9_]')")
def keyword_complexity(spark: SparkSession, sf: str) -> DataFrame:
    hits = F.regexp_count("text", F.lit("(?i)(^|[^A-Za-z0-9_])(if|for|while|case|catch)[^A-Za-z0-9_]"))
    return files_from_documents(spark, sf).select("path", (hits + 1).cast("int").alias("complexity")).where("complexity > 1")


@query("size_budget", "SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY source HAVING sum(strlen(coalesce(text, ''))) > 20000")
def size_budget(spark: SparkSession, sf: str) -> DataFrame:
    return files_from_documents(spark, sf).groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes")).where("bytes > 20000")


@query("score_history_trimmed", "WITH d AS (SELECT event_type AS key, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS score FROM events GROUP BY ALL), r AS (SELECT *, lag(score) OVER (PARTITION BY key ORDER BY day) AS previous, row_number() OVER (PARTITION BY key ORDER BY day DESC) AS r FROM d) SELECT key, day, score, CASE WHEN r < 7 THEN previous END AS previous FROM r WHERE r <= 7")
def score_history_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    daily = _t(spark, sf, "events").groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("score"))
    return history.with_delta(history.trimmed(daily, ["key"], "day", 7), ["key"], "score", "day").drop("delta")


@query("without_lockfile", "WITH f AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'package.json' WHEN 1 THEN 'Cargo.toml' WHEN 2 THEN 'Cargo.lock' ELSE 'yarn.lock' END AS name, CAST(s_nationkey AS VARCHAR) AS d FROM supplier), p AS (SELECT DISTINCT d, name FROM f) SELECT d || '/' || name AS path FROM p a WHERE name = 'package.json' AND NOT EXISTS (SELECT 1 FROM p b WHERE b.d = a.d AND b.name = 'yarn.lock') OR name = 'Cargo.toml' AND NOT EXISTS (SELECT 1 FROM p b WHERE b.d = a.d AND b.name = 'Cargo.lock')")
def without_lockfile(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, "package.json").when(k == 1, "Cargo.toml").when(k == 2, "Cargo.lock").otherwise("yarn.lock")
    return manifests.without_lockfile(_t(spark, sf, "supplier").select(F.concat_ws("/", F.col("s_nationkey").cast("string"), name).alias("path")))


@query("line_snippets", with_found + ", f AS (SELECT path, string_split(text, chr(10)) AS l FROM files) SELECT rule_id, f.path, line, array_to_string(list_transform(range(greatest(line - 4, 1), least(line + 3, len(l)) + 1), lambda i: CAST(i AS VARCHAR) || ': ' || l[i]), chr(10)) AS snippet FROM findings JOIN f USING (path)")
def line_snippets(spark: SparkSession, sf: str) -> DataFrame:
    files = files_from_documents(spark, sf)
    return fi.snippets(fi.enrich(fi.scan(lines(files)), fi.rules_frame(spark)), files)


