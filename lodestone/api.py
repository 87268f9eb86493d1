"""Entry points for programs: scan a tree or a patch, scan a log, explain rules, write reports."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings_of
from .operators import catalogue, clones, graph, rulepacks, secrets
from .operators import findings as fi
from .parsers import taint, units
from .sinks import reports
from .sources import manifests, references, repository
from .sources.text import count_lines, files_from_tree, lines, looks_generated, unified_diff
from .streaming.history import findings_of

COLUMNS = "rule_id string, section string, severity string, confidence string, path string, line int, message string"
DIRECTIVE = "lodestone:ignore"


def _shaped(df: DataFrame, section: str | None = None) -> DataFrame:
    own = df.columns
    get = lambda c, kind: F.col(c).cast(kind).alias(c) if c in own else F.lit(None).cast(kind).alias(c)
    named = F.lit(section) if section else F.split("rule_id", "[.]")[0]
    return df.select("rule_id", (F.col("section") if "section" in own else named).alias("section"), get("severity", "string"), get("confidence", "string"), get("path", "string"), get("line", "int"), get("message", "string"))


def evaluate(files: DataFrame, held: dict, base: DataFrame | None = None) -> DataFrame:
    """Findings of all sections that the settings turn on over files (path, text, lang, size), before any suppression."""
    spark = files.sparkSession
    q, d = held["quality"], held["design"]
    source = files.where("text is not null")
    wanted = set(held["sections"])
    rules = tuple(r for r in catalogue.RULES if r.section in wanted)
    parts: list[DataFrame] = []
    if rules:
        parts.append(_shaped(catalogue.run_catalogue(source, rules)))
    functions = units.functions(source)
    if "quality" in wanted:
        long = source.where(count_lines(F.col("text")) > q["max_file_lines"]).where(~looks_generated(F.col("text")))
        parts.append(_shaped(long.select(F.lit("quality.max-file-lines").alias("rule_id"), F.lit("warn").alias("severity"), "path", F.concat(count_lines(F.col("text")).cast("string"), F.lit(" lines")).alias("message"))))
        sizes = units.size_findings(functions, q["max_function_lines"], q["max_parameters"], q["max_complexity"])
        parts.append(_shaped(sizes.select("rule_id", F.lit("warn").alias("severity"), "path", "line", F.concat("name", F.lit(": "), F.col("value").cast("string")).alias("message"))))
        parts.append(_shaped(units.unreachable(functions).select(F.lit("quality.ai.dead-code").alias("rule_id"), F.lit("warn").alias("severity"), "path", "line", F.concat(F.lit("never reached in "), "name").alias("message"))))
        copied = clones.clone_runs(source.where(F.lower("lang").isin(*catalogue.CODE)), q["clone_tokens"])
        parts.append(_shaped(copied.select(F.lit("quality.duplicate-code").alias("rule_id"), F.lit("warn").alias("severity"), F.col("path_b").alias("path"), F.concat(F.col("tokens").cast("string"), F.lit(" tokens as in "), "path_a").alias("message"))))
    if "ci" in wanted:
        parts.append(_shaped(units.test_quality(units.test_blocks(functions)).select("rule_id", F.lit("warn").alias("severity"), "path", "line", F.col("name").alias("message"))))
    if "smell" in wanted:
        parts.append(_shaped(units.data_clumps(functions).select(F.lit("smell.data-clump").alias("rule_id"), F.lit("warn").alias("severity"), "path", F.concat("params", F.lit(" in "), F.col("functions").cast("string"), F.lit(" functions")).alias("message"))))
    if "security" in wanted:
        s = held["secrets"]
        if s["enabled"]:
            custom = tuple((c["id"], c["regex"], c.get("message", c["id"]), c.get("level", "fail")) for c in s["custom_patterns"])
            own = secrets.Settings(tuple(s["allow_paths"]), tuple(s["allow_patterns"]), custom, s["entropy"], s["min_length"], s["min_entropy"])
            small = source.where(F.col("size") <= secrets.MAX_FILE_BYTES) if "size" in source.columns else source
            parts.append(_shaped(secrets.demote_fixtures(secrets.scan_secrets(lines(small.select("path", "text")), own)), "security"))
        parts.append(_shaped(taint.taint_findings(source)))
    if "design" in wanted:
        imports = units.imports(source)
        every = [references.python_edges(imports, source), references.script_edges(imports, source), references.java_edges(imports, source), references.rust_edges(imports, source), references.cpp_edges(imports, source)]
        edges = every[0].select("src", "dst")
        for e in every[1:]:
            edges = edges.unionByName(e.select("src", "dst"))
        cycles = graph.cycle_report(edges)
        parts.append(_shaped(cycles.select(F.lit("design.import-cycle").alias("rule_id"), F.lit("fail").alias("severity"), F.col("component").alias("path"), F.col("members").alias("message"))))
        big = graph.fans(edges).where(F.col("fan_in") + F.col("fan_out") > d["god_module"])
        parts.append(_shaped(big.select(F.lit("design.god-module").alias("rule_id"), F.lit("warn").alias("severity"), F.col("node").alias("path"), F.concat((F.col("fan_in") + F.col("fan_out")).cast("string"), F.lit(" neighbours")).alias("message"))))
        loose = graph.unstable_dependencies(edges, d["min_fan_in"], d["max_instability_delta"])
        parts.append(_shaped(loose.select(F.lit("design.stability-direction").alias("rule_id"), F.lit("warn").alias("severity"), F.col("src").alias("path"), F.concat(F.lit("imports the less stable "), "dst").alias("message"))))
        if d["layers"]:
            broken = graph.crossed_boundaries(edges, [(x["paths"], x["name"]) for x in d["layers"]], [(x["name"], y) for x in d["layers"] for y in x.get("may_import", [])])
            parts.append(_shaped(broken.select(F.lit("design.layer-boundary").alias("rule_id"), F.lit("fail").alias("severity"), F.col("src").alias("path"), "line", F.concat("src_boundary", F.lit(" imports "), "dst_boundary", F.lit(": "), "dst").alias("message"))))
    if "supply_chain" in wanted:
        deps = manifests.dependencies(source)
        parts.append(_shaped(deps.where("version = '' and scope <> 'indirect'").select(F.lit("supply_chain.unpinned-dependency").alias("rule_id"), F.lit("warn").alias("severity"), "path", "line", F.concat("name", F.lit(" "), "requirement").alias("message"))))
        parts.append(_shaped(manifests.without_lockfile(files).select(F.lit("supply_chain.missing-lockfile").alias("rule_id"), F.lit("fail").alias("severity"), "path", F.lit("no lock file beside it").alias("message"))))
    if "context" in wanted:
        docs = lines(source.where(F.col("path").rlike(r"(^|/)(AGENTS\.md|\.cursorrules|copilot-instructions\.md|README\.md)$")).select("path", "text"))
        lost = references.unresolved_references(references.doc_references(docs), files, references.command_targets(source))
        parts.append(_shaped(lost.select(F.when(F.col("kind") == "link", "context.doc-link-rot").otherwise("context.agent-docs-drift").alias("rule_id"), F.lit("warn").alias("severity"), "path", "line", F.concat(F.lit("refers to "), "target").alias("message"))))
    for path in held["rule_packs"]:
        parts.append(_shaped(rulepacks.run_pack(lines(source.select("path", "text")), rulepacks.load_pack(path))))
    parts += [_command(spark, c) for c in held["commands"]["checks"] if held["commands"]["trusted"]]
    found = spark.createDataFrame([], COLUMNS)
    for p in parts:
        found = found.unionByName(p)
    return found.distinct()


def _command(spark: SparkSession, check: dict) -> DataFrame:
    """One finding if a trusted command does not end with 0."""
    done = subprocess.run(check["command"], capture_output=True, text=True, timeout=check.get("timeout", 600), check=False)
    rows = [(f"{check.get('section', 'quality')}.command-check", check.get("section", "quality"), "fail", "high", None, None, f"{check.get('name', check['command'][0])} ended with {done.returncode}")] if done.returncode else []
    return spark.createDataFrame(rows, COLUMNS)


def suppressed(findings: DataFrame, files: DataFrame, held: dict, today: str | None = None) -> DataFrame:
    """Findings with the reason that hides them, null for none: baseline, then waiver, then a directive in the file."""
    spark = findings.sparkSession
    marked = fi.with_context(findings.withColumn("fingerprint", fi.fingerprint("rule_id", "path", "line", "message")), files)
    reasons = marked.withColumn("in_base", F.lit(False))
    if held["baseline"]:
        known = reports.read_baseline(spark, held["baseline"])
        one = known.select(F.col("key").alias("fingerprint"), F.lit(True).alias("b1"))
        two = known.select(F.col("key").alias("context_fingerprint"), F.lit(True).alias("b2"))
        reasons = marked.join(one, "fingerprint", "left").join(two, "context_fingerprint", "left").withColumn("in_base", F.coalesce("b1", "b2", F.lit(False)))
    waivers = [(k, w.get("rule", "*"), w.get("path", "**"), w.get("expires_on")) for k, w in enumerate(held["waivers"])]
    waived = fi.waived_by(reasons, waivers, today or date.today().isoformat()) if waivers else F.lit(None).cast("int")
    marks = fi.inline_directives(lines(files.where("text is not null").select("path", "text")), DIRECTIVE)
    keys = marks.select("path", F.explode(F.array("d_line", F.col("d_line") + 1, F.lit(0))).alias("at")).distinct().withColumn("marked", F.lit(True))
    at = F.greatest(F.coalesce(F.col("line"), F.lit(0)), F.lit(0))
    joined = reasons.withColumn("at", at).withColumn("waiver", waived).join(keys, ["path", "at"], "left")
    reason = F.when(F.col("in_base"), "baseline").when(F.col("waiver").isNotNull(), "waiver").when(F.col("marked"), "inline")
    return joined.select(*findings.columns, "fingerprint", "context_fingerprint", "waiver", reason.alias("reason"))


def scan(spark: SparkSession, root: str, held: dict | None = None, base: str | None = None, today: str | None = None) -> tuple[DataFrame, int]:
    """The findings of a tree that nothing hides, and how many were hidden. With `base` only those on lines changed since."""
    held = held or settings_of.build()
    files = files_from_tree(spark, root, tuple(held["exclude"]) + (".git/**", ".lodestone/**", "dist/**"))
    found = evaluate(files, held)
    if base:
        found = fi.in_scope(found, repository.changed_ranges(spark, root, base))
    every = suppressed(found, files, held, today).cache()
    hidden = every.where("reason is not null").count()
    return every.where("reason is null").drop("reason", "waiver"), hidden


def scan_patch(spark: SparkSession, root: str, patch: str, held: dict | None = None) -> tuple[DataFrame, int]:
    """The findings that a patch, not applied to the tree, would bring on the lines it changes."""
    held = held or settings_of.build()
    copy = repository.patched_tree(root, patch)
    try:
        files = files_from_tree(spark, copy, tuple(held["exclude"]) + (".git/**",))
        ranges = unified_diff(spark.createDataFrame(list(enumerate(patch.split("\n"))), "ordinal long, text string"))
        every = suppressed(fi.in_scope(evaluate(files, held), ranges), files, held).cache()
        hidden = every.where("reason is not null").count()
        kept = every.where("reason is null").drop("reason", "waiver")
        return spark.createDataFrame(kept.collect(), kept.schema), hidden  # the copy goes; a patch's findings are few
    finally:
        shutil.rmtree(copy, ignore_errors=True)


def scan_history(spark: SparkSession, root: str, max_commits: int = repository.MAX_COMMITS, every_ref: bool = False) -> DataFrame:
    """Secrets that commits added, the newest commit of each."""
    return findings_of(repository.history(spark, root, max_commits, every_ref).withColumn("log", F.lit(root)))


def waiver_audit(every: DataFrame, held: dict, today: str) -> list[dict]:
    """For each waiver how many findings it hid, and whether it has expired or hides nothing."""
    counts = {r.waiver: r.n for r in every.where("waiver is not null").groupBy("waiver").agg(F.countDistinct("fingerprint").alias("n")).collect()}
    out = []
    for k, w in enumerate(held["waivers"]):
        expired = bool(w.get("expires_on")) and w["expires_on"] < today
        out.append({"index": k, "rule": w.get("rule", "*"), "path": w.get("path", "**"), "matches": counts.get(k, 0), "status": "expired" if expired else "active" if counts.get(k) else "unused"})
    return out


def rules() -> list[dict]:
    seen: dict[str, dict] = {}
    for r in catalogue.RULES:
        held = seen.setdefault(r.id, {"id": r.id, "section": r.section, "level": r.level, "unit": r.unit, "languages": []})
        held["languages"] = sorted({*held["languages"], *r.langs})
    return sorted(seen.values(), key=lambda r: r["id"])


def explain(rule: str) -> dict:
    found = [r for r in rules() if r["id"] == rule]
    if not found:
        raise ValueError(f"no rule {rule!r}")
    return found[0] | {"patterns": [{"has": r.has, "lacks": r.lacks, "name": r.name} for r in catalogue.RULES if r.id == rule]}


def write_report(findings: DataFrame, form: str, write: Callable[[str], object], deps: DataFrame | None = None) -> None:
    for part in reports.render(findings, form, deps):
        write(part)

