"""A version-controlled tree: changed lines and files, base texts, logs. Commands run on the driver; what they print becomes tables."""

from __future__ import annotations

import os
import subprocess
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as text_source

DEFECT = "(?i)(^|[^a-z])(fix(e[sd])?|bug|defect|regression|incident|hotfix|revert)([^a-z]|$)"
MAX_COMMITS = 200
MAX_FILES = 50  # a commit of more files says nothing on what belongs together


def run(root: str, *args: str) -> str:
    """Output of one git command; raises RuntimeError with what it said if it fails."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace", timeout=600, check=False)
    if done.returncode:
        raise RuntimeError(f"git {' '.join(args)}: {done.stderr.strip()}")
    return done.stdout


def _table(spark: SparkSession, printed: str) -> DataFrame:
    """(ordinal, text) of the lines."""
    return spark.createDataFrame(list(enumerate(printed.split("\n"))), "ordinal long, text string")


def changed_ranges(spark: SparkSession, root: str, base: str) -> DataFrame:
    """(path, all_changed, lo, hi) against a base; if the two have parted, against where they did."""
    try:
        printed = run(root, "diff", "--unified=0", base)
    except RuntimeError:
        printed = run(root, "diff", "--unified=0", f"{base}...HEAD")
    return text_source.unified_diff(_table(spark, printed))


def changed_files(spark: SparkSession, root: str, base: str) -> DataFrame:
    """(path, status): A, M or D; a rename is a deletion and an addition."""
    return name_status(_table(spark, run(root, "diff", "--name-status", "--no-renames", base)))


def name_status(lines: DataFrame) -> DataFrame:
    parts = F.split("text", "\t")
    return lines.where(F.col("text").rlike("^[AMDT]\t")).select(parts[1].alias("path"), F.when(parts[0] == "T", "M").otherwise(parts[0]).alias("status"))


def base_texts(spark: SparkSession, root: str, base: str, paths: list[str]) -> DataFrame:
    """(path, text) at the base; a path that is not there is left out."""
    rows = []
    for p in paths:
        try:
            rows.append((p, run(root, "show", f"{base}:{p}")))
        except RuntimeError:
            continue
    return spark.createDataFrame(rows, "path string, text string")


def patched_tree(root: str, patch: str) -> str:
    """A copy of the tree with a patch applied; the tree itself is not touched. The caller deletes the copy."""
    copy = tempfile.mkdtemp(prefix="patched-")
    run(root, "worktree", "list")  # fails early if it is no repository
    subprocess.run(["git", "clone", "--quiet", "--no-hardlinks", root, copy], check=True, capture_output=True)
    with tempfile.NamedTemporaryFile("w", suffix=".patch", delete=False) as f:
        f.write(patch)
    try:
        run(copy, "apply", "--whitespace=nowarn", f.name)
    finally:
        os.unlink(f.name)
    return copy


def history(spark: SparkSession, root: str, max_commits: int = MAX_COMMITS, every_ref: bool = False) -> DataFrame:
    """(ordinal, text) of the log with patches, newest first."""
    return _table(spark, run(root, "log", "-p", "-U0", "--format=commit %H %ct", f"--max-count={max_commits}", *(["--all"] if every_ref else [])))


def added_lines(log: DataFrame) -> DataFrame:
    """(commit, path, line, line_text, order) of the lines that a log (ordinal, text, and optionally the log's id `log`) added.

    The commit, the file and the hunk that a line belongs to are the last ones named before it; its number is the hunk's start and how
    many added lines came before it in the hunk.
    """
    own = log if "log" in log.columns else log.withColumn("log", F.lit(0))
    upto = Window.partitionBy("log").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("text")
    commit = F.regexp_extract("text", r"^commit ([0-9a-f]{7,40})( |$)", 1)
    start = F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    last = lambda c: F.last(F.when(c != "", c), ignorenulls=True).over(upto)
    head = F.col("text").rlike(r"^(diff --git |commit [0-9a-f]{7,40}( |$))")
    named = own.withColumns({"commit": last(commit), "block": F.sum(head.cast("int")).over(upto), "hunks": F.sum((start != "").cast("int")).over(upto)})
    in_block = Window.partitionBy("log", "block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    in_hunk = Window.partitionBy("log", "block", "hunks").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    open_hunk = F.last(F.when(start != "", start.try_cast("int")), ignorenulls=True).over(in_block)
    # a header's +++ comes before the block's first hunk; after that it is an added line that begins with ++
    path = F.first(F.when(t.rlike(r"^\+\+\+ (b/|/dev/null)"), F.regexp_extract("text", r"^\+\+\+ (?:b/)?([^\t]+)", 1)), ignorenulls=True).over(in_block)
    placed = named.withColumns({"path": path, "start": open_hunk, "k": F.sum(t.startswith("+").cast("int")).over(in_hunk)})
    added = placed.where(t.startswith("+") & F.col("start").isNotNull() & (F.col("path") != "/dev/null"))
    return added.select("commit", "path", (F.col("start") + F.col("k") - 1).cast("int").alias("line"), F.substring("text", 2, 65536).alias("line_text"), (-F.col("ordinal")).alias("order"))


def commit_files(log: DataFrame) -> DataFrame:
    """(commit, subject, path, added, deleted) from a log of `commit HASH SUBJECT` and numstat lines (ordinal, text); a binary file has no counts."""
    own = log if "log" in log.columns else log.withColumn("log", F.lit(0))
    upto = Window.partitionBy("log").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("text").rlike(r"^commit [0-9a-f]{7,40}( |$)"), F.col("text"))
    named = own.withColumn("head", F.last(head, ignorenulls=True).over(upto))
    parts = F.split("text", "\t", 3)
    stat = named.where(F.col("text").rlike(r"^(\d+|-)\t(\d+|-)\t"))
    return stat.select(F.regexp_extract("head", r"^commit ([0-9a-f]+)", 1).alias("commit"), F.regexp_extract("head", r"^commit [0-9a-f]+ ?(.*)$", 1).alias("subject"), parts[2].alias("path"), parts[0].try_cast("int").alias("added"), parts[1].try_cast("int").alias("deleted"))


def without_bulk(commits: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Commits of more than max_files files tell nothing on co-change and go, by rule."""
    small = commits.groupBy("commit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_files).select("commit")
    return commits.join(small, "commit", "left_semi")


def file_metrics(commits: DataFrame) -> DataFrame:
    """(path, commits, churn, defects, subjects): subjects are the twelve that come last by commit."""
    churn = F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))
    return commits.groupBy("path").agg(F.countDistinct("commit").alias("commits"), F.sum(churn).cast("long").alias("churn"), F.count_if(F.col("subject").rlike(DEFECT)).alias("defects"), F.slice(F.array_sort(F.collect_set("subject")), 1, 12).alias("subjects"))


def co_change(commits: DataFrame, least: int = 2, k: int = 3) -> DataFrame:
    """(path, partner, n, rank): of files changed in one commit the k most frequent partners; commits are bounded by without_bulk()."""
    c = without_bulk(commits).select("commit", "path").distinct()
    pairs = c.join(c.withColumnRenamed("path", "partner"), "commit").where("path <> partner").groupBy("path", "partner").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "partner"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def is_defect(subject: Column) -> Column:
    return subject.rlike(DEFECT)
