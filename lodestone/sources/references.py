"""What files refer to: imports resolved to edges, links, commands and paths in documents."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE_EXTENSIONS = "(ts|tsx|js|jsx|mjs|cjs)"
CPP_EXTENSIONS = "(c|cc|cpp|cxx|h|hh|hpp|hxx)"


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def normal_path(path: Column) -> Column:
    """A path without . and .. parts; null if it leaves the tree."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    left = F.array().cast("array<string>")
    step = lambda held, p: F.when(p != "..", F.concat(held, F.array(p))).when((F.size(held) > 0) & (F.element_at(held, -1) != F.lit("\x00")), F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.array(F.lit("\x00")))
    walked = F.aggregate(parts, left, step)
    return F.when(~F.array_contains(walked, "\x00"), F.array_join(walked, "/"))


def python_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, line, names) among the Python files: absolute and relative imports, of modules and of names that are modules; the nearest root wins."""
    py = files.where(F.col("path").endswith(".py")).select("path")
    dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", ""), "/", ".")
    # every tail of a dotted path may be how it is imported
    parts = F.split(dotted, "[.]")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    known = py.select("path", F.explode(tails).alias("module")).groupBy("module").agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("x")).select("module", F.col("x.path").alias("dst"))
    own = imports.where(F.col("lang") == "py")
    package = F.split(F.regexp_replace(_folder(F.col("path")), "/", "."), "[.]")
    base = F.array_join(F.slice(package, F.lit(1), F.greatest(F.size(package) - (F.col("level") - 1), F.lit(0))), ".")
    absolute = F.when(F.col("level") > 0, F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif("module", F.lit("")))).otherwise(F.col("module"))
    wanted = own.select(F.col("path").alias("src"), "line", "names", absolute.alias("m")).where("m <> ''")
    both = wanted.select("src", "line", "names", F.explode(F.concat(F.array("m"), F.transform("names", lambda n: F.concat_ws(".", "m", n)))).alias("module"))
    return both.join(known, "module").where("src <> dst").groupBy("src", "dst").agg(F.min("line").alias("line"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"))


def script_edges(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(src, dst, line, names) among TypeScript and JavaScript files: relative imports, and prefixes that `aliases` maps to folders; extensions and index files are tried."""
    known = files.where(F.col("path").rlike(rf"\.{SOURCE_EXTENSIONS}$")).select(F.col("path").alias("dst"))
    stem = F.regexp_replace("dst", rf"\.{SOURCE_EXTENSIONS}$", "")
    named = known.select("dst", F.explode(F.array_distinct(F.array(F.col("dst"), stem, F.regexp_replace(stem, "/index$", "")))).alias("key"))
    named = named.groupBy("key").agg(F.min("dst").alias("dst"))
    m = F.col("module")
    target = F.when(m.startswith("."), normal_path(F.concat_ws("/", _folder(F.col("path")), m)))
    for prefix, folder in sorted((aliases or {}).items(), key=lambda x: -len(x[0])):
        bare = prefix.removesuffix("*")
        target = F.coalesce(target, F.when(m.startswith(bare), normal_path(F.concat(F.lit(folder.removesuffix("*")), F.substring(m, len(bare) + 1, 4096)))))
    own = imports.where(F.col("lang").isin("ts", "tsx", "js", "jsx", "mjs", "cjs")).select(F.col("path").alias("src"), "line", "names", target.alias("key")).where("key is not null")
    return own.join(named, "key").where("src <> dst").groupBy("src", "dst").agg(F.min("line").alias("line"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"))


def go_edges(imports: DataFrame, module: str) -> DataFrame:
    """(src, dst, line) among the packages (folders) of one Go module."""
    inside = imports.where((F.col("lang") == "go") & (F.col("module").startswith(module + "/") | (F.col("module") == module)))
    dst = F.regexp_replace(F.substring("module", len(module) + 1, 4096), "^/", "")
    edges = inside.select(_folder(F.col("path")).alias("src"), F.when(dst == "", ".").otherwise(dst).alias("dst"), "line")
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.min("line").alias("line"))


def java_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, line) among Java files by the end of their paths: import a.b.C is the file that ends in a/b/C.java."""
    parts = F.split(F.regexp_replace("path", r"\.java$", ""), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    known = files.where(F.col("path").endswith(".java")).select("path", F.explode(tails).alias("module")).groupBy("module").agg(F.min("path").alias("dst"))
    own = imports.where(F.col("lang") == "java").select(F.col("path").alias("src"), "module", "line")
    return own.join(known, "module").where("src <> dst").groupBy("src", "dst").agg(F.min("line").alias("line"))


def rust_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, line) among Rust files: crate::a::b::Item is src/a/b.rs or src/a/b/mod.rs of the same crate; the longest path that is a file wins."""
    at = F.regexp_extract("path", r"^(.*?)(?:^|/)src/", 1)
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract("path", r"(?:^|/)src/(.*)\.rs$", 1), "/mod$", ""), "/", "::")
    known = files.where(F.col("path").endswith(".rs")).select(at.alias("crate"), stem.alias("key"), F.col("path").alias("dst"))
    own = imports.where((F.col("lang") == "rs") & F.col("module").startswith("crate::")).select(F.col("path").alias("src"), "line", at.alias("crate"), F.split(F.substring("module", 8, 4096), "::").alias("p"))
    heads = own.select("src", "line", "crate", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", F.lit(1), i), "::"))).alias("n", "key"))
    met = heads.join(known, ["crate", "key"]).where("src <> dst")
    best = met.groupBy("src", "line", "crate").agg(F.max(F.struct("n", "dst")).alias("x"))
    return best.select("src", F.col("x.dst").alias("dst"), "line").groupBy("src", "dst").agg(F.min("line").alias("line"))


def cpp_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, line) among C and C++ files: an include beside the file, else the file with the shortest path that ends in it."""
    known = files.where(F.col("path").rlike(rf"\.{CPP_EXTENSIONS}$")).select(F.col("path").alias("dst"))
    parts = F.split("dst", "/")
    tails = known.select("dst", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))).alias("key"))
    nearest = tails.groupBy("key").agg(F.min(F.struct(F.length("dst").alias("n"), "dst")).alias("x")).select("key", F.col("x.dst").alias("far"))
    own = imports.where(F.col("lang").isin("c", "cc", "cpp", "cxx", "h", "hh", "hpp")).select(F.col("path").alias("src"), "line", F.col("module").alias("key"), normal_path(F.concat_ws("/", _folder(F.col("path")), "module")).alias("beside"))
    met = own.join(known.withColumnRenamed("dst", "near"), own["beside"] == F.col("near"), "left").join(nearest, "key", "left")
    edges = met.select("src", F.coalesce("near", "far").alias("dst"), "line").where("dst is not null and src <> dst")
    return edges.groupBy("src", "dst").agg(F.min("line").alias("line"))


def doc_references(lines: DataFrame) -> DataFrame:
    """(path, line, kind, target): links, code spans that look like paths, make targets and npm scripts in lines of documents."""
    t = F.col("line_text")
    every = lambda pattern, kind: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("target")))
    found = F.concat(
        every(r"\]\(([^)\s#]+)[^)]*\)", "link"), every(r"`((?:\./)?[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+)`", "path"), every(r"(?:^|[`$ ])make +([A-Za-z0-9_-]+)", "make"), every(r"(?:npm|yarn|pnpm) +run +([A-Za-z0-9:_-]+)", "script")
    )
    return lines.select("path", "line", F.explode(F.array_distinct(found)).alias("r")).select("path", "line", "r.kind", "r.target")


def unresolved_references(refs: DataFrame, files: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """References to nothing: paths and links that are no file or folder, and commands that no table (kind, target) knows. Outside addresses are not looked at."""
    local = refs.where(~F.col("target").rlike("^([a-z]+:|//|#)"))
    own = local.where(F.col("kind").isin("link", "path"))
    beside = normal_path(F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat_ws("/", _folder(F.col("path")), "target")))
    tried = own.withColumn("tried", F.explode(F.array_distinct(F.array(beside, normal_path(F.col("target")))))).where("tried is not null")
    parts = F.split("path", "/")
    known = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("tried")).distinct()
    good = tried.join(known, "tried", "left_semi").select("path", "line", "kind", "target").distinct()
    lost = own.join(good, ["path", "line", "kind", "target"], "left_anti")
    if targets is None:
        return lost
    commands = local.where(F.col("kind").isin("make", "script")).join(targets, ["kind", "target"], "left_anti")
    return lost.unionByName(commands)


def command_targets(files: DataFrame) -> DataFrame:
    """(kind, target): make targets and npm scripts that the tree defines."""
    line = F.explode(F.split("text", "\n"))
    make = files.where(F.col("path").rlike(r"(^|/)[Mm]akefile$")).select(line.alias("t")).select(F.lit("make").alias("kind"), F.regexp_extract("t", r"^([A-Za-z0-9_-]+)\s*:([^=]|$)", 1).alias("target")).where("target <> ''")
    scripts = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select(F.explode(F.map_keys(F.from_json("text", "scripts map<string,string>")["scripts"])).alias("target")).select(F.lit("script").alias("kind"), "target")
    return make.unionByName(scripts).distinct()


def undocumented(targets: DataFrame, refs: DataFrame, wanted: tuple[str, ...] = ("build", "check", "dev", "fmt", "lint", "run", "start", "test")) -> DataFrame:
    """Commands of note that no document names."""
    return targets.where(F.col("target").isin(*wanted)).join(refs.select("kind", "target").distinct(), ["kind", "target"], "left_anti")


def unknown_imports(imports: DataFrame, edges: DataFrame, declared: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, module) of Python and script imports that are neither of the standard library, nor local, nor of a declared dependency (name)."""
    first = F.when(F.col("lang") == "py", F.split("module", "[.]")[0]).when(F.col("module").startswith("@"), F.array_join(F.slice(F.split("module", "/"), 1, 2), "/")).otherwise(F.split("module", "/")[0])
    own = imports.where((F.col("lang") == "py") & (F.col("level") == 0) | F.col("lang").isin("ts", "tsx", "js", "jsx", "mjs", "cjs") & ~F.col("module").rlike("^([./#]|node:)"))
    own = own.withColumn("package", first).where(~((F.col("lang") == "py") & F.col("package").isin(*sorted(sys.stdlib_module_names))) & ~F.col("package").isin(*NODE_MODULES))
    names = F.lower(F.regexp_replace("name", "[-_.]+", "_"))
    known = declared.select(names.alias("key")).union(files.select(F.explode(F.split(F.regexp_replace("path", r"\.py$", ""), "/"))).select(F.lower(F.col("col")))).distinct()
    local = edges.select(F.col("src").alias("path"), "line").distinct()
    return own.withColumn("key", F.lower(F.regexp_replace("package", "[-_.]+", "_"))).join(known, "key", "left_anti").join(local, ["path", "line"], "left_anti").select("path", "line", "module")


#: Modules that Node.js itself brings: fixed values.
NODE_MODULES = ("assert", "buffer", "child_process", "cluster", "crypto", "dns", "events", "fs", "http", "http2", "https", "net", "os", "path", "perf_hooks", "process", "querystring", "readline", "stream", "string_decoder", "timers", "tls", "tty", "url", "util", "v8", "vm", "worker_threads", "zlib")
