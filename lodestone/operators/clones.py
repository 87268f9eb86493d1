"""Clone pairs: runs of equal tokens in two places.

Every window of `k` tokens is known by the least hash of its shorter grams: windows that are equal have the same one, and neighbours mostly share it.
Windows are therefore moved in stretches, and only those whose least hash occurs in several places. Each meets the first place of its tokens (linear
in the windows, however many copies there are), and runs of windows on one diagonal merge into the longest stretch. Texts that are wholly equal count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"
BITS = 1 << 27


def tokens(text: Column) -> Column:
    """The matches of TOKEN, by classes that Java looks up faster; its \\w is ASCII."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\w+|[^\s\w]"), F.lit(0))


def stretches(files: DataFrame, k: int, hashes: bool = True) -> DataFrame:
    """(m, x, path, s, hs): neighbouring windows of k tokens, from place s, at most k of them; hs has a hash of each.

    m is the least hash of the windows' grams and x a hash of the whole text. Hashes of longer grams are made of those of shorter ones.
    """
    gram = max(k // 2, 1)
    text = F.coalesce("text", F.lit(""))
    t = files.select("path", F.xxhash64(F.lower(text)).alias("x"), F.transform(tokens(text), lambda w: F.xxhash64(w)).alias("g"))
    beside = lambda c, by, f: F.transform(c, lambda v, i: f(v, F.get(c, i + by)))
    span = 1
    while span < gram:
        by = min(span, gram - span)
        t, span = t.withColumn("g", beside("g", by, F.xxhash64)), span + by
    t, span = t.withColumn("m", F.col("g")), 1
    while span < k - gram + 1:
        by = min(span, k - gram + 1 - span)
        t, span = t.withColumn("m", beside("m", by, F.least)), span + by
    last = F.size("g") - k
    begins = F.filter(F.sequence(F.lit(0), last), lambda i: (i % k == 0) | (F.get("m", i) != F.get("m", i - 1)))
    t = t.withColumn("b", F.when(last >= 0, begins))
    parts = [*range(0, k - gram, gram), k - gram]
    each = lambda s, j: F.transform(F.sequence(s, F.coalesce(F.get("b", j + 1) - 1, last)), lambda i: F.xxhash64(*(F.get("g", i + p) for p in parts)))
    found = F.transform("b", lambda s, j: F.struct(F.get("m", s).alias("m"), s.alias("s"), *([each(s, j).alias("hs")] if hashes else [])))
    return t.select("path", "x", F.explode(found).alias("w")).select("w.m", "x", "path", "w.s", *(["w.hs"] if hashes else []))


def repeated(files: DataFrame, k: int) -> DataFrame:
    """(part, bits): a bitmap, of fixed size, of the least hashes that occur in several places of unequal texts."""
    places = stretches(files, k, hashes=False).select("m", F.xxhash64("x", "s").alias("y")).repartition("m")
    several = places.groupBy("m").agg(F.min("y").alias("a"), F.max("y").alias("b")).where("a <> b")
    at = several.select(F.col("m").bitwiseAND(BITS - 1).alias("at"))
    return at.groupBy(F.expr("at div 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))


def clone_runs(files: DataFrame, k: int = 30) -> DataFrame:
    """(path_a, start_a, path_b, start_b, tokens): each stretch of equal tokens between a place and the first place of its windows.

    The first place is the least by path and position. Stretches on one diagonal that touch or overlap are one. Within one file the
    two stretches do not overlap. Wholly equal files count once, by the least path; see equal_files().
    """
    every = stretches(files, k).withColumn("at", F.col("m").bitwiseAND(BITS - 1)).withColumn("part", F.expr("at div 32768"))
    bit = F.expr("getbit(cast(conv(hex(substring(bits, cast(at % 32768 div 8 as int) + 1, 1)), 16, 10) as bigint), cast(at % 8 as int)) = 1")
    open_ = every.join(F.broadcast(repeated(files, k)), "part").where(bit).select("m", "x", "path", "s", "hs").repartition("m")
    one = open_.groupBy("m", "x", "s").agg(F.min("path").alias("path"), F.first("hs").alias("hs"))
    w = one.select("m", "path", "s", F.posexplode("hs").alias("i", "h")).withColumn("pos", F.col("s") + F.col("i"))
    first = Window.partitionBy("m", "h").orderBy("path", "pos")
    met = w.withColumn("path_a", F.first("path").over(first)).withColumn("pos_a", F.first("pos").over(first)).where((F.col("path") != F.col("path_a")) | (F.col("pos") >= F.col("pos_a") + k))
    diagonal = met.groupBy("m", "path_a", F.col("path").alias("path_b"), "s", (F.col("pos") - F.col("pos_a")).alias("d")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    along = Window.partitionBy("path_a", "path_b", "d").orderBy("lo")
    starts = F.when(F.col("lo") - F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1)) <= k, 0).otherwise(1)
    runs = diagonal.withColumn("starts", starts).withColumn("run", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    by = runs.groupBy("path_a", "path_b", "d", "run").agg(F.min("lo").alias("start_b"), (F.max("hi") - F.min("lo") + k).cast("int").alias("tokens"))
    return by.select("path_a", (F.col("start_b") - F.col("d")).alias("start_a"), "path_b", "start_b", "tokens")


def equal_files(files: DataFrame) -> DataFrame:
    """(path, same_as): files whose text, but for case, is that of a file of lesser path."""
    h = files.select("path", F.sha2(F.lower(F.coalesce("text", F.lit(""))), 256).alias("x"))
    first = h.groupBy("x").agg(F.min("path").alias("same_as"))
    return h.join(first, "x").where("path <> same_as").select("path", "same_as")


def report_order(runs: DataFrame, limit: int = 1000) -> DataFrame:
    """The first `limit` stretches in report order: a top-k report."""
    return runs.orderBy("path_a", "start_a", "path_b", "start_b").limit(limit)
