"""Report writers: text, JSON, SARIF 2.1.0, annotations, review comment, CycloneDX 1.6, baseline.

A report is a table of findings (rule_id, section, severity, path, line, column, message and optional why, how_to_fix,
title). Counting and ordering happen in Spark; rows stream to the writer one partition at a time, so the driver never holds
all findings. Formats that are for people are cut to their first rows by the query, not by the writer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "0.2.0"
TOOL = "lodestone"
COMMENT_LIMIT = 50
#: Sections in the order in which reports show them; others follow by name.
SECTIONS = ("quality", "design", "security", "prompts", "ci", "supply_chain", "contracts", "context", "performance", "change", "data", "reliability", "delivery", "custom")
LEVELS = {"fail": "error", "warn": "warning", "pass": "note"}


def section_rank(section: Column) -> Column:
    found = F.array_position(F.array(*map(F.lit, SECTIONS)), section)
    return F.when(found > 0, found).otherwise(F.lit(len(SECTIONS) + 1))


def normal(findings: DataFrame) -> DataFrame:
    """All columns that a writer reads; those that the table lacks are null."""
    wanted = {"rule_id": "string", "section": "string", "severity": "string", "path": "string", "line": "int", "column": "int", "message": "string", "why": "string", "how_to_fix": "string", "title": "string", "fingerprint": "string"}
    return findings.select(*(F.col(c).cast(t).alias(c) if c in findings.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()))


def ordered(findings: DataFrame) -> DataFrame:
    return normal(findings).orderBy(section_rank(F.col("section")), "section", "path", F.col("line").asc_nulls_first(), "rule_id", "message")


def summary(findings: DataFrame, suppressed: int = 0) -> dict:
    """Sections by status, findings, suppressed findings. One row a section reaches the driver."""
    worst = F.max(F.when(F.col("severity") == "fail", 2).when(F.col("severity") == "warn", 1).otherwise(0))
    rows = normal(findings).groupBy("section").agg(worst.alias("worst"), F.count(F.lit(1)).alias("n")).orderBy(section_rank(F.col("section")), "section").collect()
    status = [("pass", "warn", "fail")[r.worst] for r in rows]
    return {
        "sections": [{"name": r.section, "status": s, "findings": r.n} for r, s in zip(rows, status, strict=True)],
        "passed": status.count("pass"),
        "warned": status.count("warn"),
        "failed": status.count("fail"),
        "findings": sum(r.n for r in rows),
        "suppressed": suppressed,
    }


def exit_code(report: dict) -> int:
    """Not zero when a section failed."""
    return int(report["failed"] > 0)


def _stripped(*values: str | None) -> str:
    return next((v for v in values if v and v.strip()), "")


def _sum_line(s: dict) -> str:
    return f"Summary: {s['passed']} pass, {s['warned']} warn, {s['failed']} fail, {s['findings']} findings, {s['suppressed']} suppressed"


def text(findings: DataFrame, suppressed: int = 0) -> Iterator[str]:
    s = summary(findings, suppressed)
    yield f"{TOOL} {VERSION}\n\n"
    width = max([7, *(len(x["name"] or "") for x in s["sections"])])
    yield f"{'SECTION':<{width}}  STATUS  FINDINGS\n"
    for x in s["sections"]:
        yield f"{x['name'] or '':<{width}}  {x['status'].upper():<6}  {x['findings']}\n"
    section = None
    for r in ordered(findings).toLocalIterator():
        if r.section != section:
            section = r.section
            yield f"\n[{section}]\n"
        where = f"{r.path}:{r.line}" if r.path and r.line else r.path or "-"
        yield f"  {(r.severity or 'warn').upper():<4} {r.rule_id} {where}  {r.message or ''}\n"
        if _stripped(r.how_to_fix):
            yield f"       fix: {r.how_to_fix}\n"
    yield f"\n{_sum_line(s)}\n"


def json_report(findings: DataFrame, suppressed: int = 0) -> Iterator[str]:
    yield json.dumps({"version": VERSION, "summary": summary(findings, suppressed)}, indent=2)[:-2] + ',\n  "findings": ['
    first = True
    for r in ordered(findings).toLocalIterator():
        row = {k: v for k, v in r.asDict().items() if v not in (None, "")}
        yield ("\n    " if first else ",\n    ") + json.dumps(row, ensure_ascii=False)
        first = False
    yield ("" if first else "\n  ") + "]\n}\n"


def sarif(findings: DataFrame) -> Iterator[str]:
    """The rules found, once each in order of their ids, and all results."""
    rows = ordered(findings)
    rules = rows.groupBy("rule_id").agg(F.first("title", True).alias("title"), F.first("how_to_fix", True).alias("fix"), F.max("severity").alias("severity")).orderBy("rule_id").toLocalIterator()
    described = [
        {"id": r.rule_id, "name": r.rule_id, "shortDescription": {"text": _stripped(r.title, r.rule_id)}, "help": {"text": _stripped(r.fix, "See rule guidance.")}, "defaultConfiguration": {"level": LEVELS.get(r.severity, "warning")}} for r in rules
    ]
    run = {"tool": {"driver": {"name": TOOL, "version": VERSION, "semanticVersion": VERSION, "rules": described}}, "invocations": [{"executionSuccessful": True}]}
    yield '{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [' + json.dumps(run)[:-1] + ', "results": ['
    first = True
    for r in rows.toLocalIterator():
        result: dict = {"ruleId": r.rule_id, "level": LEVELS.get(r.severity, "warning"), "message": {"text": _stripped(r.message, r.title, r.rule_id)}}
        if r.path:
            region = {"startLine": max(1, r.line or 1)} | ({"startColumn": r.column} if r.column and r.column > 0 else {})
            result["locations"] = [{"physicalLocation": {"artifactLocation": {"uri": r.path}, "region": region}}]
        if r.fingerprint:
            result["partialFingerprints"] = {"primary": r.fingerprint}
        yield ("\n" if first else ",\n") + json.dumps(result, ensure_ascii=False)
        first = False
    yield "]}]}\n"


def annotation_lines(findings: DataFrame) -> DataFrame:
    """(line) of workflow commands: % and line breaks of the message are escaped, line and column are 1 at least."""
    f = normal(findings)
    level = F.when(F.col("severity") == "fail", "error").otherwise("warning")
    filled = lambda c, other: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c).otherwise(other)
    said = F.concat(F.lit("["), "rule_id", F.lit("] "), filled(F.col("why"), F.coalesce("message", F.lit(""))), F.lit(". Fix: "), filled(F.col("how_to_fix"), F.lit("see rule guidance")))
    for plain, escaped in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        said = F.replace(said, F.lit(plain), F.lit(escaped))
    at = lambda c: F.greatest(F.lit(1), F.coalesce(c, F.lit(0))).cast("string")
    place = F.when(F.coalesce("path", F.lit("")) != "", F.concat(F.lit(" file="), "path", F.lit(",line="), at("line"), F.lit(",col="), at("column"))).otherwise("")
    return f.select(F.concat(F.lit("::"), level, place, F.lit("::"), said).alias("line_text"), *f.columns)


def annotations(findings: DataFrame) -> Iterator[str]:
    yield f"::notice title={TOOL}::version {VERSION}\n"
    for r in annotation_lines(findings).orderBy(section_rank(F.col("section")), "section", "path", F.col("line").asc_nulls_first(), "rule_id").toLocalIterator():
        yield r.line_text + "\n"


def _sentence(value: str, other: str) -> str:
    said = re.sub(r"\s+", " ", value or "").strip() or other
    return said if said.endswith((".", "!", "?")) else said + "."


def comment(findings: DataFrame, suppressed: int = 0, limit: int = COMMENT_LIMIT) -> Iterator[str]:
    """Markdown; the first `limit` findings."""
    s = summary(findings, suppressed)
    yield f"## {TOOL} suggestions\n\n_version {VERSION}_\n\n"
    if not s["findings"]:
        yield f"No policy findings in this scan.\n\n{_sum_line(s)}\n"
        return
    yield f"{_sum_line(s)}\n"
    section, k = None, 0
    for r in ordered(findings).limit(limit).collect():
        if r.section != section:
            section, k = r.section, 0
            yield f"\n### {section}\n\n"
        k += 1
        where = f"`{r.path}:{r.line}`" if r.path and r.line else f"`{r.path}`" if r.path else "the repository"
        yield f"{k}. `{r.rule_id}` at {where}\n   - Why: {_sentence(_stripped(r.why, r.message), 'See report output for details.')}\n   - Fix: {_sentence(_stripped(r.how_to_fix), 'See rule guidance.')}\n"
    if s["findings"] > limit:
        yield f"\n_Only the first {limit} findings are shown here. {s['findings'] - limit} additional findings were omitted._\n"


#: Package URL types by ecosystem: fixed values.
PURL_TYPES = {"go": "golang", "npm": "npm", "python": "pypi", "pypi": "pypi", "cargo": "cargo", "rust": "cargo", "conan": "conan", "vcpkg": "generic", "cmake": "generic"}


def components(deps: DataFrame) -> DataFrame:
    """(ref, name, version, purl, ecosystem, path, scope, license) of distinct dependencies, each with its package URL."""
    version = F.coalesce(F.nullif(F.trim("version"), F.lit("")), F.nullif(F.trim("requirement"), F.lit("")), F.lit("unspecified"))
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in PURL_TYPES.items() for x in pair)), F.lower("ecosystem"))
    pinned = F.when(version.rlike(r"^v?[0-9]+([.][0-9A-Za-z+-]+)*$"), F.concat(F.lit("@"), version)).otherwise("")
    ref = F.concat(F.lit("dependency:"), F.trim("ecosystem"), F.lit(":"), F.trim("path"), F.lit(":"), F.trim("name"), F.lit("@"), version)
    purl = F.concat(F.lit("pkg:"), F.coalesce(kind, F.lit("generic")), F.lit("/"), F.replace(F.trim("name"), F.lit("@"), F.lit("%40")), pinned)
    return deps.select(ref.alias("ref"), F.trim("name").alias("name"), version.alias("version"), purl.alias("purl"), "ecosystem", "path", *(F.col(c) if c in deps.columns else F.lit(None).cast("string").alias(c) for c in ("scope", "license"))).dropDuplicates(["ref"])


def cyclonedx(deps: DataFrame) -> Iterator[str]:
    """A bill of materials without time or random id: equal input gives equal bytes."""
    yield '{"$schema": "http://cyclonedx.org/schema/bom-1.6.schema.json", "bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1, "components": ['
    first = True
    for r in components(deps).orderBy("ref").toLocalIterator():
        c: dict = {"type": "library", "bom-ref": r.ref, "name": r.name, "version": r.version, "purl": quote(r.purl, safe=":/@%+.")}
        if r.license:
            c["licenses"] = [{"license": {"name": r.license}}]
        c["properties"] = [{"name": "ecosystem", "value": r.ecosystem}, {"name": "manifest-path", "value": r.path}, *([{"name": "scope", "value": r.scope}] if r.scope else [])]
        yield ("\n" if first else ",\n") + json.dumps(c, ensure_ascii=False)
        first = False
    yield "]}\n"


def baseline_entries(findings: DataFrame) -> DataFrame:
    """(fingerprint, context_fingerprint, rule_id, path, line, message), one row for each fingerprint: the least by rule, path and line."""
    columns = [c for c in ("context_fingerprint", "rule_id", "path", "line", "message") if c in findings.columns]
    least = F.min(F.struct("rule_id", "path", "line", *(c for c in columns if c not in ("rule_id", "path", "line")))).alias("x")
    return findings.where("fingerprint is not null").groupBy("fingerprint").agg(least).select("fingerprint", *(F.col(f"x.{c}") for c in columns))


def write_baseline(findings: DataFrame, path: str) -> None:
    """One JSON object a line, in order of rule, path and line."""
    baseline_entries(findings).orderBy("rule_id", "path", "line", "fingerprint").write.mode("overwrite").json(path)


def read_baseline(spark, path: str) -> DataFrame:
    """(key): both kinds of fingerprint of every entry."""
    rows = spark.read.schema("fingerprint string, context_fingerprint string").json(path)
    return rows.select(F.explode(F.array("fingerprint", "context_fingerprint")).alias("key")).where("key <> ''").distinct()


FORMATS = {"text": text, "json": json_report, "sarif": sarif, "github": annotations, "github-comment": comment}


def render(findings: DataFrame, form: str = "text", deps: DataFrame | None = None) -> Iterator[str]:
    form = (form or "text").strip().lower()
    if form in ("cyclonedx", "cyclonedx-json"):
        if deps is None:
            raise ValueError("cyclonedx needs a table of dependencies")
        return cyclonedx(deps)
    if form not in FORMATS:
        raise ValueError(f"unsupported report format {form!r}")
    return FORMATS[form](findings)


def each_section(findings: DataFrame, call) -> None:
    """Call call(section, rows) for one section after another, in report order; sections are few, and each one's rows stay a table."""
    for r in normal(findings).select("section").distinct().orderBy(section_rank(F.col("section")), "section").collect():
        call(r.section, findings.where(F.col("section").eqNullSafe(r.section)))
