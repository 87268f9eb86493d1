"""Files and lines as tables, from the shared document table or from a source tree."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE_BYTES = 32 << 20
DEFAULT_EXCLUDES = (".git/**", ".gocache/**", ".gomodcache/**", ".lodestone/**", "dist/**")


def glob_to_regex(glob: str) -> str:
    """Anchored: ** is any text, * any text without a slash, ? one character that is not a slash."""
    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(x) or re.escape(x) for x in re.findall(r"\*\*|.", glob)) + "$"


def matches_any(path: Column, globs: tuple[str, ...]) -> Column:
    return path.rlike("|".join(f"(?:{glob_to_regex(g)})" for g in globs)) if globs else F.lit(False)


def files_from_tree(spark: SparkSession, root: str, excludes: tuple[str, ...] = DEFAULT_EXCLUDES) -> DataFrame:
    """(path, text, size, sha256, lang) of every file under root that no exclude glob matches.

    A file above MAX_FILE_BYTES is not read, and its text and hash are null: it stays visible, with its size.
    """
    small = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MAX_FILE_BYTES)
    large = oversized_files(spark, root)
    raw = small.select("path", "content", "length").unionByName(large.select("path", F.lit(None).cast("binary").alias("content"), F.col("size").alias("length")))
    base = root.rstrip("/") + "/"
    path = F.regexp_replace("path", "^[a-z]+:/*" + re.escape(base.split("://")[-1].lstrip("/")), "")
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return raw.select(path.alias("path"), F.col("content").cast("string").alias("text"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), ext.alias("lang")).where(~matches_any(F.col("path"), excludes))


def files_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, doc_id, source, lang, text): a document is a file at lang/source/doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), "doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """One row for each line, from 1; a text that ends in a line break has an empty last line."""
    others = [c for c in files.columns if c != "text"]
    return files.select(*others, F.posexplode(F.split("text", "\n")).alias("pos", "line_text")).withColumn("line", F.col("pos") + 1).drop("pos")


def unified_diff(diff_lines: DataFrame) -> DataFrame:
    """(path, all_changed, lo, hi) from the lines (ordinal, text) of unified diffs; `diff`, if the table has it, tells one diff from another.

    A file without hunks, and a deleted one (under its old path), is changed as a whole. Inside a hunk of n lines nothing is a header, whatever it
    begins with, as lines of a hunk are counted.
    """
    from pyspark.sql import Window

    own = diff_lines if "diff" in diff_lines.columns else diff_lines.withColumn("diff", F.lit(0))
    upto = Window.partitionBy("diff").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("text")
    hunk = r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    count = lambda k: F.when(F.regexp_extract("text", hunk, k) == "", F.lit(1)).otherwise(F.regexp_extract("text", hunk, k).try_cast("int"))
    is_hunk = t.rlike(hunk)
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    # where a hunk ends, if it holds what it says: by then its removed, added and shared lines have been seen
    marked = own.withColumns({"start": last(F.when(is_hunk, F.col("ordinal"))), "old": last(F.when(is_hunk, count(1))), "new": last(F.when(is_hunk, count(3)))})
    since = Window.partitionBy("diff", "start").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda test: F.coalesce(F.sum(F.when(test & ~is_hunk, 1).otherwise(0)).over(since), F.lit(0))
    used = marked.withColumns({"used_old": before(t.rlike("^[- ]")), "used_new": before(t.rlike("^[+ ]"))})
    inside = F.col("start").isNotNull() & ~is_hunk & ((F.col("used_old") < F.col("old")) | (F.col("used_new") < F.col("new")))
    heads = used.withColumn("outside", ~F.coalesce(inside, F.lit(False)))
    name = lambda sign: F.when(F.col("outside"), F.nullif(F.regexp_extract("text", "^" + sign + r" (?:[ab]/)?([^\t]+)", 1), F.lit("")))
    named = heads.withColumns({"was": last(name("---")), "now": last(name(r"\+\+\+"))})
    named = named.withColumns({"path": F.when(F.col("now") == "/dev/null", F.col("was")).otherwise(F.col("now")), "gone": F.col("now") == "/dev/null"})
    lo = F.regexp_extract("text", hunk, 2).try_cast("int")
    hunks = named.where(is_hunk & F.col("outside") & ~F.col("gone")).select("path", F.lit(False).alias("all_changed"), lo.alias("lo"), (lo + F.greatest(count(3), F.lit(1)) - 1).alias("hi"))
    files = named.where(name(r"\+\+\+").isNotNull()).select("path").distinct()
    whole = files.join(hunks.select("path").distinct(), "path", "left_anti")
    return hunks.unionByName(whole.select("path", F.lit(True).alias("all_changed"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi")))


def union_ranges(*ranges: DataFrame) -> DataFrame:
    """The ranges of several diffs; a path that is changed as a whole in one is so in all."""
    every = ranges[0]
    for r in ranges[1:]:
        every = every.unionByName(r)
    whole = every.groupBy("path").agg(F.max("all_changed").alias("whole"))
    joined = every.join(whole, "path")
    none = F.lit(None).cast("int")
    return joined.select("path", F.col("whole").alias("all_changed"), F.when(~F.col("whole"), F.col("lo")).otherwise(none).alias("lo"), F.when(~F.col("whole"), F.col("hi")).otherwise(none).alias("hi")).distinct()


def count_lines(text: Column) -> Column:
    """Lines of a text without its last line breaks; an empty text has one."""
    return F.size(F.split(F.regexp_replace(text, "\\n+\\z", ""), "\n"))


def looks_generated(text: Column) -> Column:
    return F.substring(text, 1, 4096).rlike(r"(?i)code generated .* do not edit|@generated|do not edit this file|auto-?generated")


def oversized_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of files above MAX_FILE_BYTES, which files_from_tree() refuses."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") > MAX_FILE_BYTES).select("path", F.col("length").alias("size"))
