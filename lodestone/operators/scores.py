"""Scores over findings: weighted sums, change risk, pull-request families, production risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the AI-quality score: fixed values.
SLOP_WEIGHTS = {
    "quality.ai.swallowed-error": 4, "quality.ai.narrative-comment": 1, "quality.ai.hallucinated-import": 5, "quality.ai.dead-code": 3, "quality.ai.over-mocked-test": 3,
    "quality.ai.local-idiom-drift": 2, "quality.ai.error-style-drift": 2, "quality.ai.naming-drift": 1, "quality.ai.change-risk": 4, "quality.ai.provenance-policy": 2,
    "quality.ai.semantic-doc-mismatch": 3, "quality.ai.contract-drift": 4, "quality.ai.semantic-error-message": 4, "quality.ai.semantic-test-coverage": 4, "quality.ai.semantic-test-adequacy": 4,
}
# Weights of the performance score by what the rule's name says, tested in this order: fixed values.
PERFORMANCE_WEIGHTS = (
    ("n-plus-one-query", 5), ("sync-io-in-|lock-held-across", 4), ("unbounded-goroutines|unbounded-concurrency", 4), ("unbounded-read|timer-leak|timer-listener", 3),
    ("regex-compile-in-loop|defer-in-loop|sleep-in-loop|nested-loop-scan|slice-membership|range-for-copy|flush-in-loop|await-in-loop", 2), ("alloc-in-loop|string-concat-in-loop", 1),
)
SLOP_LEVELS, RISK_LEVELS, FAMILY_LEVELS = (20, 40), (30, 60), (35, 70)


def level_of(score: Column, bounds: tuple[int, int]) -> Column:
    return F.when(score >= bounds[1], "fail").when(score >= bounds[0], "warn").otherwise("pass")


def slop_weight(rule: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in SLOP_WEIGHTS.items() for x in pair)), rule)


def performance_weight(rule: Column) -> Column:
    weight = F.lit(None).cast("int")
    for pattern, value in reversed(PERFORMANCE_WEIGHTS):
        weight = F.when(rule.rlike(f"^performance[.](.*[.])?({pattern})"), F.lit(value)).otherwise(weight)
    return weight


def saturated(findings: DataFrame, weight: Column, by: list[str], bounds: tuple[int, int] = SLOP_LEVELS) -> DataFrame:
    """(by..., score, signals, level): ten times the sum of weights, 100 at most; findings without a weight do not count."""
    scored = findings.withColumn("finding weight", weight).where(F.col("finding weight").isNotNull())
    by_key = scored.groupBy(*by).agg(F.least(10 * F.sum("finding weight"), F.lit(100)).cast("long").alias("score"), F.count(F.lit(1)).alias("signals"))
    return by_key.withColumn("level", level_of(F.col("score"), bounds))


def change_risk(findings: DataFrame, changed_files: Column | int, provenance: Column | bool, by: list[str]) -> DataFrame:
    """(by..., score, level, ai_findings, semantic_findings): half the AI-quality score up to 50, provenance 15, breadth 10 from five files and 5 from two, 5 for each semantic finding up to 15, a coverage gap 10; 100 at most."""
    rule = F.col("rule_id")
    ai = rule.startswith("quality.ai.") & (rule != "quality.ai.provenance-policy") & (rule != "quality.ai.change-risk")
    semantic = rule.rlike("^quality[.]ai[.](semantic-|contract-drift)")
    files = changed_files if isinstance(changed_files, Column) else F.lit(changed_files)
    by_key = findings.groupBy(*by).agg(
        F.least(10 * F.sum(F.when(ai, F.coalesce(slop_weight(rule), F.lit(0))).otherwise(0)), F.lit(100)).alias("slop"),
        F.count_if(ai).alias("ai_findings"), F.count_if(semantic).alias("semantic_findings"), F.bool_or(rule == "quality.coverage-delta").alias("gap"), F.max(files).alias("files"),
        F.bool_or(provenance if isinstance(provenance, Column) else F.lit(provenance)).alias("marked"),
    )
    breadth = F.when(F.col("files") >= 5, 10).when(F.col("files") >= 2, 5).otherwise(0)
    total = F.least(F.expr("slop div 2"), F.lit(50)) + F.when(F.col("marked"), 15).otherwise(0) + breadth + F.least(5 * F.col("semantic_findings"), F.lit(15)) + F.when(F.col("gap"), 10).otherwise(0)
    score = F.least(total, F.lit(100)).cast("long")
    return by_key.select(*by, score.alias("score"), level_of(score, RISK_LEVELS).alias("level"), "ai_findings", "semantic_findings").where("score > 0")


def family_metric(findings: DataFrame, families: list[tuple[str, Column]], by: list[str] | None = None) -> DataFrame:
    """(by..., label, count, weight, contribution): a finding counts for the first family that matches; 35 for a failure, 18 for a warning, 10 otherwise, 5 more or less by confidence."""
    label = F.lit(None).cast("string")
    for name, test in reversed(families):
        label = F.when(test, F.lit(name)).otherwise(label)
    level, confidence = F.lower("severity"), F.lower("confidence")
    weight = F.when(level.isin("fail", "error"), 35).when(level.isin("warn", "warning"), 18).otherwise(10) + F.when(confidence == "high", 5).when(confidence == "low", -5).otherwise(0)
    own = findings.select(*(by or []), label.alias("label"), weight.alias("w")).where("label is not null")
    return own.groupBy(*(by or []), "label").agg(F.count(F.lit(1)).alias("count"), F.max("w").cast("long").alias("weight"), F.sum("w").cast("long").alias("contribution"))


def family_score(components: DataFrame, by: list[str] | None = None, bounds: tuple[int, int] = FAMILY_LEVELS) -> DataFrame:
    """(by..., score, level) and the components, greatest first, then by label."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("contribution")).alias("k"), "label", "count", "contribution")))
    scored = components.groupBy(*(by or [])).agg(F.least(F.sum("contribution"), F.lit(100)).cast("long").alias("score"), F.transform(listed, lambda c: F.struct(c["label"].alias("label"), c["count"].alias("count"), c["contribution"].alias("contribution"))).alias("components"))
    return scored.withColumn("level", level_of(F.col("score"), bounds))


def production_components(findings: DataFrame, by: list[str] | None = None, reliability: int = 12, data: int = 15, fail: int = 25, warn: int = 10) -> DataFrame:
    """Components of the production risk: reliability and data findings, weighted by family and level."""
    rule, level = F.col("rule_id"), F.lower("severity")
    is_data = rule.startswith("data.") | (rule == "contracts.non-expand-contract-migration")
    label = F.when(rule.startswith("reliability."), "reliability").when(is_data, "data_correctness")
    weight = F.when(rule.startswith("reliability."), reliability).otherwise(data) + F.when(level.isin("fail", "error"), fail).when(level.isin("warn", "warning"), warn).otherwise(0)
    own = findings.select(*(by or []), label.alias("label"), weight.alias("w")).where("label is not null")
    return own.groupBy(*(by or []), "label").agg(F.count(F.lit(1)).alias("count"), F.max("w").cast("long").alias("weight"), F.sum("w").cast("long").alias("contribution"))


def corpus_evaluation(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(rule_id, tp, fp, fn, known_gaps, precision, recall) of findings (case, rule_id) against expectations (case, rule_id, known_gap)."""
    hit = found.select("case", "rule_id").distinct().withColumn("hit", F.lit(True))
    want = expected.groupBy("case", "rule_id").agg(F.bool_and(F.coalesce("known_gap", F.lit(False))).alias("gap")).withColumn("want", F.lit(True))
    both = hit.join(want, ["case", "rule_id"], "full_outer")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    tp, fp, fn = F.count_if(yes("hit") & yes("want")), F.count_if(yes("hit") & ~yes("want")), F.count_if(~yes("hit") & yes("want") & ~yes("gap"))
    by = both.groupBy("rule_id").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if(~yes("hit") & yes("gap")).alias("known_gaps"))
    return by.withColumns({"precision": F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6), "recall": F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6)})
