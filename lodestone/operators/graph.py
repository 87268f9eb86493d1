"""Dependency graphs as edge tables: fans, instability, closures, cycles. Every step is a join or an aggregation of edges."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Write and read again in the shared folder, so plans stay short over rounds."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-graph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fans(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, instability) without self edges: one aggregation over both ends."""
    e = edges.where("src <> dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(e.select("dst", F.lit(1), F.lit(0)))
    by = ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return by.withColumn("instability", F.round(F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")), 6))


def closure(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(src, dst) for every pair with a path, by semi-naive rounds: only new pairs are joined again, until there are none.

    Raises if pairs were still new in round `max_rounds`.
    """
    edges = _cut(edges.where("src <> dst").distinct())
    seen, new = edges, edges
    for done in itertools.count(1):
        step = new.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        new = _cut(step.join(seen, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            break
        if done == max_rounds:
            raise RuntimeError(f"closure: still new pairs in round {max_rounds}")
        seen = _cut(seen.unionByName(new))
    return seen


def cycles(reach: DataFrame) -> DataFrame:
    """(node, component, size) of nodes on a cycle; component is the smallest node of the strongly connected set."""
    mutual = reach.join(reach.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    by = mutual.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("component"))
    return by.select(F.col("src").alias("node"), "component").join(by.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("node", "component", "size")


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(root, node) for every node that a path leads to from a root (node) of `start`, the root itself only if it lies on a cycle. Only the starts' reach is made."""
    edges = _cut(edges.select("src", "dst").distinct())
    new = _cut(start.select(F.col("node").alias("root")).distinct().join(edges, F.col("root") == F.col("src")).select("root", F.col("dst").alias("node")).distinct())
    seen = new
    while not new.isEmpty():
        step = new.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        new = _cut(step.join(seen, ["root", "node"], "left_anti"))
        seen = _cut(seen.unionByName(new))
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def dependents(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(root, node): every node that depends, over any number of steps, on a target; without the target itself."""
    return reached(reverse(edges), targets).where("root <> node")


def on_cycles(edges: DataFrame) -> DataFrame:
    """The edges that may lie on a cycle: nodes without a way in or out are cut off, again and again, until none is left. What a long chain leaves is small."""
    left = _cut(edges.where("src <> dst").distinct())
    while True:
        ins, outs = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        kept = _cut(left.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        if kept.count() == left.count():
            return kept
        left = kept


def cycle_report(edges: DataFrame) -> DataFrame:
    """(component, members, size): strongly connected sets of more than one node, and nodes with an edge to themselves; members in order, joined by <->."""
    found = cycles(closure(on_cycles(edges)))
    alone = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    every = found.select("node", "component").unionByName(alone)
    return every.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_set("node")), lambda x: x.cast("string")), " <-> ").alias("members"), F.count(F.lit(1)).alias("size"))


def unstable_dependencies(edges: DataFrame, min_fan_in: int = 3, max_delta: float = 0.35) -> DataFrame:
    """(src, dst, delta): a node that many depend on imports one that is less stable by more than max_delta."""
    own = fans(edges)
    a, b = own.select(F.col("node").alias("src"), F.col("fan_in").alias("in_a"), F.col("instability").alias("a")), own.select(F.col("node").alias("dst"), F.col("instability").alias("b"))
    joined = edges.where("src <> dst").select("src", "dst").distinct().join(a, "src").join(b, "dst")
    return joined.where((F.col("in_a") >= min_fan_in) & (F.col("b") - F.col("a") > max_delta)).select("src", "dst", F.round(F.col("b") - F.col("a"), 6).alias("delta"))


def change_impact(edges: DataFrame, changed: DataFrame, more_than: int = 10, sample: int = 12) -> DataFrame:
    """(changed, dependents, sample): changed nodes with more than so many transitive dependents, and the first of those in order."""
    by = dependents(edges, changed).groupBy(F.col("root").alias("changed")).agg(F.count(F.lit(1)).alias("dependents"), F.slice(F.array_sort(F.collect_set("node")), 1, sample).alias("sample"))
    return by.where(F.col("dependents") > more_than)


def rebuild_cascade(edges: DataFrame, direct: int = 8, transitive: int = 20) -> DataFrame:
    """(node, importers, dependents, kind): hot nodes with more than `direct` importers, amplifiers with more than `transitive` dependents."""
    importers = edges.where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("importers"))
    every = dependents(edges, importers.select("node")).groupBy(F.col("root").alias("node")).agg(F.count(F.lit(1)).alias("dependents"))
    kind = F.when(F.col("dependents") > transitive, "rebuild-amplifier").when(F.col("importers") > direct, "hot")
    return importers.join(every, "node").select("node", "importers", "dependents", kind.alias("kind")).where("kind is not null")


def unreachable(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes (node) that no entry leads to and that are none."""
    held = reached(edges, entries).select("node").union(entries.select("node")).distinct()
    return nodes.select("node").distinct().join(held, "node", "left_anti")


def assigned(nodes: DataFrame, boundaries: list[tuple[str, str]]) -> DataFrame:
    """(node, boundary): the first boundary (glob, name) that matches each node; null if none does. Boundaries are settings, so they fuse into the projection."""
    from ..sources.text import glob_to_regex

    name = F.lit(None).cast("string")
    for glob, own in reversed(boundaries):
        name = F.when(F.col("node").rlike(glob_to_regex(glob)), F.lit(own)).otherwise(name)
    return nodes.select("node", name.alias("boundary"))


def crossed_boundaries(edges: DataFrame, boundaries: list[tuple[str, str]], allowed: list[tuple[str, str]]) -> DataFrame:
    """(src, dst, line, src_boundary, dst_boundary) of edges from one boundary to another that are not allowed; once each."""
    side = lambda c: assigned(edges.select(F.col(c).alias("node")), boundaries).distinct().toDF(c, f"{c}_boundary")
    joined = edges.join(side("src"), "src").join(side("dst"), "dst").where("src_boundary is not null and dst_boundary is not null and src_boundary <> dst_boundary")
    good = F.lit(False)
    for a, b in allowed:
        good |= ((F.col("src_boundary") == a) | F.lit(a == "*")) & ((F.col("dst_boundary") == b) | F.lit(b == "*"))
    return joined.where(~good).groupBy("src", "dst", "src_boundary", "dst_boundary").agg(F.min("line").alias("line") if "line" in edges.columns else F.lit(None).cast("int").alias("line"))


def capability_breaches(edges: DataFrame, capabilities: list[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    """(src, dst, capability): imports of a sensitive module (pattern of dst, name, globs of allowed sources) from elsewhere."""
    from ..sources.text import matches_any

    tests = [F.when(F.col("dst").rlike(pattern) & ~matches_any(F.col("src"), globs), F.lit(name)) for pattern, name, globs in capabilities]
    return edges.select("src", "dst", F.explode(F.array_compact(F.array(*tests))).alias("capability")).distinct()
