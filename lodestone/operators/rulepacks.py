"""Rule packs given by the user: paths, extensions and patterns as data, all tested in one pass over the lines."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.text import matches_any


@dataclass(frozen=True)
class PackRule:
    id: str
    pattern: str = ""  # empty: the path alone makes the finding
    message: str = ""
    level: str = "warn"
    section: str = "custom"
    paths: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    path_pattern: str = ""
    unless: str = ""  # a line that matches it too is no hit


def compile_pack(rules: list[dict]) -> list[PackRule]:
    """Checked rules; raises ValueError that names every faulty one, so that none is dropped in silence."""
    out, wrong, seen = [], [], set()
    for k, raw in enumerate(rules):
        unknown = set(raw) - set(PackRule.__dataclass_fields__)
        name = raw.get("id") or f"rule {k}"
        if not raw.get("id") or unknown or name in seen:
            wrong.append(f"{name}: " + ("no id" if not raw.get("id") else f"unknown keys {sorted(unknown)}" if unknown else "repeated id"))
            continue
        seen.add(name)
        rule = PackRule(**{k2: tuple(v) if isinstance(v, list) else v for k2, v in raw.items()})
        for pattern in (rule.pattern, rule.path_pattern, rule.unless):
            try:
                re.compile(pattern)
            except re.error as e:
                wrong.append(f"{name}: {e}")
        if rule.level not in ("warn", "fail"):
            wrong.append(f"{name}: level {rule.level!r}")
        if not (rule.pattern or rule.paths or rule.path_pattern or rule.extensions):
            wrong.append(f"{name}: neither a pattern nor a path")
        out.append(rule)
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def load_pack(path: str) -> list[PackRule]:
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    return compile_pack(held["rules"] if isinstance(held, dict) else held)


def on_path(rule: PackRule, path: Column) -> Column:
    """Not excluded, and of the extensions, globs and pattern that the rule names."""
    test = ~matches_any(path, rule.exclude) if rule.exclude else F.lit(True)
    if rule.extensions:
        test &= F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)).isin(*(e.lower() if e.startswith(".") else "." + e.lower() for e in rule.extensions))
    if rule.paths:
        test &= matches_any(path, rule.paths)
    if rule.path_pattern:
        test &= path.rlike(rule.path_pattern)
    return test


def run_pack(lines: DataFrame, rules: list[PackRule]) -> DataFrame:
    """(rule_id, section, severity, path, line, message): a row for each line that a pattern matches; one with a null line for each path of a rule without a pattern."""
    t, p = F.col("line_text"), F.col("path")
    hit = lambda r, line: F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.section).alias("section"), F.lit(r.level).alias("severity"), line.alias("line"), F.lit(r.message or r.id).alias("message"))
    tests = []
    for r in rules:
        on = on_path(r, p)
        if r.pattern:
            tests.append(F.when(on & t.rlike(r.pattern) & (~t.rlike(r.unless) if r.unless else F.lit(True)), hit(r, F.col("line"))))
        else:
            tests.append(F.when(on & (F.col("line") == 1), hit(r, F.lit(None).cast("int"))))
    return lines.select("path", F.explode(F.array_compact(F.array(*tests))).alias("h")).select("h.rule_id", "h.section", "h.severity", "path", "h.line", "h.message")
