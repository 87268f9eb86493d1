"""Imported reports: SARIF, Gitleaks, Trivy, LCOV, benchmark output. Secret values are in no schema, so they are never decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SARIF = "runs array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>>>>>"
GITLEAKS = "RuleID string, File string, StartLine int, StartColumn int"
TRIVY = "Results array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,Severity:string>>,Misconfigurations:array<struct<ID:string,Severity:string,CauseMetadata:struct<StartLine:int>>>,Secrets:array<struct<RuleID:string,StartLine:int>>>>"


def _rule(tool, rule):
    return F.lower(F.concat_ws(".", F.lit("external"), tool, rule)).alias("rule_id")


def sarif(spark: SparkSession, path: str) -> DataFrame:
    runs = spark.read.schema(SARIF).json(path, multiLine=True).select(F.explode("runs").alias("run"))
    results = runs.select(F.col("run.tool.driver.name").alias("tool"), F.explode("run.results").alias("r"))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    level = F.when(F.col("r.level") == "error", "fail").otherwise("warn")
    return results.select(_rule(F.col("tool"), F.col("r.ruleId")), level.alias("severity"), place["artifactLocation"]["uri"].alias("path"), place["region"]["startLine"].alias("line"), place["region"]["startColumn"].alias("column"))


def gitleaks(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.schema(GITLEAKS).json(path, multiLine=True)
    return found.select(_rule(F.lit("gitleaks"), F.col("RuleID")), F.lit("fail").alias("severity"), F.col("File").alias("path"), F.col("StartLine").alias("line"), F.col("StartColumn").alias("column"))


def trivy(spark: SparkSession, path: str) -> DataFrame:
    results = spark.read.schema(TRIVY).json(path, multiLine=True).select(F.explode("Results").alias("x")).select("x.*")
    grave = lambda c: F.when(F.col(c).isin("CRITICAL", "HIGH"), "fail").otherwise("warn").alias("severity")
    no = F.lit(None).cast("int")
    parts = [
        results.select("Target", F.explode("Vulnerabilities").alias("v")).select(_rule(F.lit("trivy"), F.col("v.VulnerabilityID")), grave("v.Severity"), F.col("Target").alias("path"), no.alias("line"), no.alias("column")),
        results.select("Target", F.explode("Misconfigurations").alias("v")).select(_rule(F.lit("trivy"), F.col("v.ID")), grave("v.Severity"), F.col("Target").alias("path"), F.col("v.CauseMetadata.StartLine").alias("line"), no.alias("column")),
        results.select("Target", F.explode("Secrets").alias("v")).select(_rule(F.lit("trivy"), F.col("v.RuleID")), F.lit("fail").alias("severity"), F.col("Target").alias("path"), F.col("v.StartLine").alias("line"), no.alias("column")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def lcov(lines: DataFrame) -> DataFrame:
    """(path, line, hits) from the lines (report, ordinal, text) of LCOV reports."""
    w = Window.partitionBy("report").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("path", F.last(F.when(F.col("text").startswith("SF:"), F.expr("substring(text, 4)")), ignorenulls=True).over(w))
    da = named.where(F.col("text").startswith("DA:")).select("path", F.split(F.expr("substring(text, 4)"), ",").alias("v"))
    return da.select("path", F.col("v")[0].cast("int").alias("line"), F.col("v")[1].cast("long").alias("hits")).groupBy("path", "line").agg(F.max("hits").alias("hits"))


def benchmark_output(lines: DataFrame) -> DataFrame:
    """(name, ns_per_op) from benchmark output lines (text); the name goes without the number of processors at its end."""
    pattern = r"^(Benchmark\S*?)(?:-\d+)?\s+\d+\s+([0-9.]+) ns/op"
    return lines.where(F.col("text").rlike(pattern)).select(F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).cast("double").alias("ns_per_op"))


def go_cover(lines: DataFrame) -> DataFrame:
    """(path, line, hits) from the lines (text) of a Go cover profile: each block covers its lines, and the largest count of a line stands."""
    block = r"^(.+):(\d+)\.\d+,(\d+)\.\d+ \d+ (\d+)$"
    part = lambda k: F.regexp_extract("text", block, k)
    rows = lines.where(F.col("text").rlike(block)).select(part(1).alias("path"), part(2).cast("int").alias("lo"), part(3).cast("int").alias("hi"), part(4).cast("long").alias("hits"))
    return rows.select("path", F.explode(F.sequence("lo", F.greatest("lo", "hi"))).alias("line"), "hits").groupBy("path", "line").agg(F.max("hits").alias("hits"))


def govulncheck(lines: DataFrame) -> DataFrame:
    """(rule_id, severity, osv, module, version, path, line) from a stream of JSON objects, one on each line (text)."""
    shape = "finding struct<osv:string,fixed_version:string,trace:array<struct<module:string,version:string,package:string,function:string,position:struct<filename:string,line:int>>>>"
    found = lines.select(F.from_json("text", shape)["finding"].alias("f")).where("f.osv is not null")
    top, last = F.get("f.trace", F.lit(0)), F.element_at("f.trace", -1)
    called = top["function"].isNotNull()
    return found.select(F.lit("security.govulncheck").alias("rule_id"), F.when(called, "fail").otherwise("warn").alias("severity"), F.col("f.osv").alias("osv"), top["module"].alias("module"), top["version"].alias("version"), last["position"]["filename"].alias("path"), last["position"]["line"].alias("line")).distinct()


def bundle_stats(spark: SparkSession, path: str) -> DataFrame:
    """(asset, bytes) from the statistics of esbuild (outputs) or webpack (assets)."""
    raw = spark.read.text(path, wholetext=True)
    shape = "outputs map<string,struct<bytes:bigint>>, assets array<struct<name:string,size:bigint>>"
    held = raw.select(F.from_json("value", shape).alias("x"))
    one = held.select(F.explode(F.map_entries("x.outputs")).alias("e")).select(F.col("e.key").alias("asset"), F.col("e.value.bytes").alias("bytes"))
    return one.unionByName(held.select(F.explode("x.assets").alias("e")).select(F.col("e.name").alias("asset"), F.col("e.size").alias("bytes")))


def time_trace(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, ms, events) from clang's time traces: complete events, summed by name."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "traceEvents array<struct<name:string,ph:string,dur:bigint>>").alias("x"))
    return raw.select("file", F.explode("x.traceEvents").alias("e")).where("e.ph = 'X'").groupBy("file", F.col("e.name").alias("name")).agg((F.sum("e.dur") / 1000.0).alias("ms"), F.count(F.lit(1)).alias("events"))


def cargo_timings(spark: SparkSession, path: str) -> DataFrame:
    """(unit, version, seconds) from the data in cargo's timing report."""
    raw = spark.read.text(path, wholetext=True)
    data = F.regexp_extract("value", r"(?s)UNIT_DATA\s*=\s*(\[.*?\]);", 1)
    units = raw.select(F.explode(F.from_json(data, "array<struct<name:string,version:string,duration:double>>")).alias("u"))
    return units.select(F.col("u.name").alias("unit"), F.col("u.version").alias("version"), F.col("u.duration").alias("seconds"))


def compile_commands(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(file, directory, arguments) of a compilation database; entries outside the root are left out."""
    held = spark.read.schema("directory string, file string, command string, arguments array<string>").json(path, multiLine=True)
    whole = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))
    arguments = F.coalesce("arguments", F.split("command", " +"))
    return held.select(whole.alias("file"), "directory", arguments.alias("arguments")).where(F.col("file").startswith(root.rstrip("/") + "/") & ~F.col("file").contains("/../"))


def over_budget(measured: DataFrame, budgets: DataFrame) -> DataFrame:
    """(name, measured, max): what is above its budget; both tables are keyed by name."""
    return measured.groupBy("name").agg(F.sum("value").alias("measured")).join(budgets, "name").where(F.col("measured") > F.col("max")).select("name", "measured", "max")


def regressions(base: DataFrame, now: DataFrame, percent: float = 20.0) -> DataFrame:
    """(name, base, now, growth) of measurements (name, value) that grew by more than `percent`; a base of 0 or less tells nothing."""
    b, n = base.groupBy("name").agg(F.avg("value").alias("base")), now.groupBy("name").agg(F.avg("value").alias("now"))
    return b.where("base > 0").join(n, "name").withColumn("growth", F.round((F.col("now") - F.col("base")) * 100 / F.col("base"), 6)).where(F.col("growth") > percent)


MAX_REPORT_BYTES = 16 << 20


def import_report(spark: SparkSession, form: str, path: str, root: str | None = None) -> DataFrame:
    """Findings of an outside report: sarif, gitleaks or trivy. A path outside `root`, or a file above MAX_REPORT_BYTES, raises ValueError."""
    import os

    readers = {"sarif": sarif, "gitleaks": gitleaks, "trivy": trivy}
    if form not in readers:
        raise ValueError(f"unknown report format {form!r}")
    if "://" not in path:
        real = os.path.realpath(path)
        if root is not None and os.path.commonpath([real, os.path.realpath(root)]) != os.path.realpath(root):
            raise ValueError(f"{path} is outside {root}")
        if os.path.getsize(real) > MAX_REPORT_BYTES:
            raise ValueError(f"{path} is above {MAX_REPORT_BYTES} bytes")
    return readers[form](spark, path)
