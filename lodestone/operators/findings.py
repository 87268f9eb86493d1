"""The findings pipeline: text rules to findings, enrichment, scope, suppression and summaries.

A rule is data. All rules of a table are tested in one projection over its lines, so the number of rules does not
change the number of scans; only lines with a hit leave the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.text import glob_to_regex


@dataclass(frozen=True)
class Rule:
    id: str
    section: str
    level: str
    pattern: str  # in the syntax that Java and RE2 share
    message: str
    marker: str = ""  # a literal that a matching line must hold, tested first
    weight: int = 1


# The rule set of the shared tables: fixed values.
TEXT_RULES = (
    Rule("security.secret-assignment", "security", "fail", "(?i)(password|passwd|secret|token|api_key)[ ]*[=:][ ]*[^ \\t,;]{6,}", "possible hard-coded secret", "", 5),
    Rule("security.private-address", "security", "warn", "(^|[^0-9.])(10|127|192)[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}([^0-9.]|$)", "address in source", ".", 3),
    Rule("supply_chain.license-line", "supply_chain", "warn", "(Licensed|Released) under|This work is licensed", "license notice", "", 2),
    Rule("quality.email", "quality", "warn", "[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}", "mail address in source", "@", 1),
    Rule("quality.shouting", "quality", "warn", "[A-Z]{10}", "word of ten capitals or more", "", 1),
    Rule("quality.bar-separated", "quality", "warn", "[|][^|]*[|][^|]*[|]", "navigation-like line", "|", 1),
)


def rules_frame(spark: SparkSession, rules: tuple[Rule, ...] = TEXT_RULES) -> DataFrame:
    return spark.createDataFrame([(r.id, r.section, r.level, r.message, r.weight) for r in rules], "rule_id string, section string, default_level string, title string, weight int")


def scan(lines: DataFrame, rules: tuple[Rule, ...] = TEXT_RULES) -> DataFrame:
    """(rule_id, path, line) of every hit."""
    t = F.col("line_text")
    test = lambda r: (t.contains(r.marker) & t.rlike(r.pattern)) if r.marker else t.rlike(r.pattern)
    hits = F.array_compact(F.array(*(F.when(test(r), F.lit(r.id)) for r in rules)))
    return lines.select("path", "line", F.explode(hits).alias("rule_id"))


def normal_severity(c: Column) -> Column:
    return F.when(c.isin("fail", "warn", "pass"), c).otherwise("warn")


def normal_confidence(c: Column) -> Column:
    return F.when(F.lower(c).isin("high", "medium", "low"), F.lower(c)).otherwise("")


def kept_after_triage(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings whose last verdict (fingerprint, verdict, at) is not to dismiss them; a finding without a verdict stays."""
    last = verdicts.groupBy("fingerprint").agg(F.max_by("verdict", "at").alias("verdict"))
    return findings.join(last.where("verdict = 'dismiss'").select("fingerprint"), "fingerprint", "left_anti").select(*findings.columns)


def fingerprint(*parts: str) -> Column:
    return F.sha2(F.concat_ws("|", *(F.col(p).cast("string") for p in parts)), 256)


def enrich(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule metadata by a broadcast join (the catalogue is a few hundred rows), severity and fingerprint."""
    joined = hits.join(F.broadcast(rules), "rule_id", "left").withColumn("message", F.coalesce("title", F.lit("")))
    return joined.select("rule_id", normal_severity(F.coalesce("default_level", F.lit("warn"))).alias("severity"), "section", "path", "line", "message", fingerprint("rule_id", "path", "line", "message").alias("fingerprint"))


def _around(lines: Column, at: Column, before: int, after: int) -> Column:
    """The elements of an array from `before` places before a place (from 0) to `after` after it."""
    low = F.greatest(at - before, F.lit(0))
    return F.slice(lines, low + 1, at + after + 1 - low)


def context_fingerprint(files: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """(path, line, window): the two lines before to the two after, white space collapsed. Windows are cut from the split text: no shuffle."""
    flat = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t]+", " ")))
    windows = files.select("path", flat.alias("l")).select("path", F.posexplode(F.transform("l", lambda x, i: F.array_join(_around(F.col("l"), i, before, after), "\n"))).alias("pos", "window"))
    return windows.select("path", (F.col("pos") + 1).alias("line"), "window")


def with_context(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with their context fingerprint, the hash of rule, path and window; without a line or a source it is the fingerprint itself.

    Only the windows of lines with a finding are made: the lines of a path's findings go to its text, and not the text to them.
    """
    flat = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t]+", " ")))
    wanted = findings.where("line > 0").groupBy("path").agg(F.collect_set("line").alias("wanted"))
    cut = files.select("path", "text").join(wanted, "path").select("path", flat.alias("l"), F.explode("wanted").alias("line"))
    windows = cut.where(F.col("line") <= F.size("l")).select("path", "line", F.array_join(_around(F.col("l"), F.col("line") - 1, 2, 2), "\n").alias("window"))
    made = F.sha2(F.concat_ws("|", "rule_id", "path", "window"), 256)
    joined = findings.join(windows, ["path", "line"], "left")
    return joined.select(*findings.columns, F.when(F.col("window").isNotNull(), made).otherwise(F.col("fingerprint")).alias("context_fingerprint"))


def snippets(findings: DataFrame, files: DataFrame, before: int = 4, after: int = 3) -> DataFrame:
    """(rule_id, path, line, snippet): numbered lines around each finding."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    joined = findings.where("line > 0").select("rule_id", "path", "line").join(files.select("path", numbered.alias("l")), "path")
    return joined.where(F.col("line") <= F.size("l")).select("rule_id", "path", "line", F.array_join(_around(F.col("l"), F.col("line") - 1, before, after), "\n").alias("snippet"))


def in_scope(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings on changed lines: equi-join on the path with the range as residual; findings without a path or line stay in a changed file."""
    r = ranges.withColumnRenamed("path", "r_path")
    cond = (findings["path"] == r["r_path"]) & (r["all_changed"] | (F.coalesce(findings["line"], F.lit(0)) <= 0) | findings["line"].between(r["lo"], r["hi"]))
    return findings.where("path is not null").join(r, cond, "left_semi").unionByName(findings.where("path is null"))


def without_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that no baseline entry knows, by the fingerprint or, where both sides have one, the context fingerprint. Two equi-joins, no OR."""
    left = findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")
    if "context_fingerprint" in findings.columns and "context_fingerprint" in baseline.columns:
        left = left.join(baseline.select("context_fingerprint").where("context_fingerprint is not null").distinct(), "context_fingerprint", "left_anti")
    return left.select(*findings.columns)


def waived_by(findings: DataFrame, waivers: list[tuple[int, str, str, str | None]], today: str) -> Column:
    """The first waiver (index, rule or *, path glob, expiry or None) that matches and has not expired; waivers are configuration, so they fuse into the projection."""
    live = [(i, r, g) for i, r, g, e in waivers if e is None or e >= today]
    tests = [F.when(((F.col("rule_id") == r) if r != "*" else F.lit(True)) & F.col("path").rlike(glob_to_regex(g)), F.lit(i)) for i, r, g in live]
    return F.coalesce(*tests, F.lit(None).cast("int"))


def inline_directives(lines: DataFrame, marker: str) -> DataFrame:
    """(path, d_line) of lines that hold a directive."""
    return lines.where(F.col("line_text").contains(marker)).select("path", F.col("line").alias("d_line"))


def without_inline(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """A directive covers its own line, the next, and findings on the whole file (line 0 or none); all become keys, so the join is an equi-join."""
    keys = directives.select("path", F.explode(F.array("d_line", F.col("d_line") + 1, F.lit(0))).alias("at")).distinct()
    keyed = findings.withColumn("at", F.greatest(F.coalesce(F.col("line"), F.lit(0)), F.lit(0)))
    return keyed.join(keys, ["path", "at"], "left_anti").select(*findings.columns)


def section_summary(findings: DataFrame) -> DataFrame:
    rank = F.max(F.when(F.col("severity") == "fail", 2).when(F.col("severity") == "warn", 1).otherwise(0))
    by = findings.groupBy("section").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("path").alias("files"), rank.alias("r"))
    return by.select("section", "findings", "files", F.when(F.col("r") == 2, "fail").when(F.col("r") == 1, "warn").otherwise("pass").alias("status"))


def rule_stats(findings: DataFrame) -> DataFrame:
    """Per rule: emitted, suppressed by reason, and the suppressed share. Needs a `reason` column, null for emitted."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    by = findings.groupBy("rule_id").agg(n(F.col("reason").isNull(), "emitted"), n(F.col("reason") == "baseline", "baseline"), n(F.col("reason") == "waiver", "waiver"), n(F.col("reason") == "inline", "inline"))
    gone = F.col("baseline") + F.col("waiver") + F.col("inline")
    return by.withColumn("ratio", F.round(gone / (F.col("emitted") + gone), 6))


def weighted_score(findings: DataFrame, rules: DataFrame, by: str, factor: int = 10, cap: int = 100) -> DataFrame:
    joined = findings.join(F.broadcast(rules.select("rule_id", "weight")), "rule_id")
    return joined.groupBy(by).agg(F.least(F.sum("weight") * factor, F.lit(cap)).cast("long").alias("score"), F.count(F.lit(1)).alias("signals"))


def file_risk(findings: DataFrame, rules: DataFrame, k: int) -> DataFrame:
    """The k riskiest files; a top-k, so no global sort."""
    scored = weighted_score(findings, rules, "path", 5)
    top = scored.orderBy(F.desc("score"), F.desc("signals"), "path").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("signals"), "path")))
