"""Functions, imports, calls and test blocks of source files, as tables.

Python goes through its own syntax tree; a file that does not parse, and the brace languages, go through the masked text:
headers are matched by pattern and bodies by their braces or indentation. One Arrow-batched pass gives all tables' rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mask import mask

FUNCTION_SCHEMA = "path string, lang string, name string, owner string, first int, last int, params array<string>, body string, raw string, complexity int, depth int, is_async boolean"
IMPORT_SCHEMA = "path string, lang string, module string, names array<string>, level int, line int"

BRACE_LANGS = ("go", "ts", "tsx", "js", "jsx", "mjs", "cjs", "java", "rs", "c", "cc", "cpp", "cxx", "h", "hh", "hpp", "cs", "kt", "swift", "scala")
# Headers of functions by family of language; the last group that matched is the name.
HEADERS = {
    "go": re.compile(r"^func\s*(?:\((?P<owner>[^)]*)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\((?P<params>[^)]*)\)", re.M),
    "script": re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?P<async>async\s+)?(?:function\s*\*?\s*(?P<name>\w+)|(?:(?:public|private|protected|static|readonly|override)\s+)*(?:const|let|var)?\s*(?P<name2>\w+)\s*(?:[:=]\s*(?:async\s*)?(?=\([^()]*\)\s*(?::[^={]+)?=>)|(?=\([^()]*\)\s*(?::[^={;]+)?\{)))\s*(?:<[^>]*>)?\((?P<params>[^()]*)\)", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?P<async>async\s+)?(?:unsafe\s+)?fn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<params>[^)]*)\)", re.M),
    "c": re.compile(r"^[ \t]*(?:[\w:<>,&*~\[\]]+[ \t*&]+)+(?P<name>[\w:~]+)\s*\((?P<params>[^();{}]*)\)\s*(?:const|noexcept|override|final|throws\s+[\w., ]+|\s)*(?=\{)", re.M),
}
FAMILY = {"go": "go", "rs": "rust", **{e: "script" for e in ("ts", "tsx", "js", "jsx", "mjs", "cjs")}}
NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "new", "function", "with", "match"}
BRANCHES = re.compile(r"\b(?:if|for|while|case|catch|except|elif|match)\b|&&|\|\||\?(?![.?:])")
IMPORTS = {
    "go": re.compile(r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"(?P<module>[^"\s]+)"\s*$', re.M),
    "script": re.compile(r"""(?:^|[;\n])\s*(?:import\s+(?:(?P<names>[^'";]+?)\s+from\s+)?|export\s+[^'";]+?\s+from\s+|(?:const|let|var)\s+(?P<names2>[^=]+?)\s*=\s*require\(\s*)['"](?P<module>[^'"]+)['"]"""),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?(?P<module>[\w.]+)(?:\.\*)?\s*;", re.M),
    "rust": re.compile(r"^\s*(?:pub\s+)?use\s+(?P<module>[^;]+);", re.M),
    "c": re.compile(r'^\s*#\s*include\s+["<](?P<module>[^">]+)[">]|^\s*(?:export\s+)?import\s+(?P<names>[\w.:]+)\s*;', re.M),
}


@dataclass
class Unit:
    name: str
    first: int
    last: int
    params: list[str]
    body: str
    raw: str
    owner: str = ""
    is_async: bool = False
    complexity: int = field(default=1)
    depth: int = 0


def _python_units(text: str, masked: str) -> list[Unit]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return _indented_units(text, masked)
    raw, plain = text.split("\n"), masked.split("\n")
    out: list[Unit] = []

    def visit(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                a = child.args
                params = [x.arg for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]
                first, last = child.lineno, child.end_lineno or child.lineno
                unit = Unit(child.name, first, last, params, "\n".join(plain[first - 1 : last]), "\n".join(raw[first - 1 : last]), owner, isinstance(child, ast.AsyncFunctionDef))
                inside = [n for n in ast.walk(child) if n is not child]
                unit.complexity = 1 + sum(isinstance(n, ast.If | ast.For | ast.AsyncFor | ast.While | ast.ExceptHandler | ast.IfExp | ast.comprehension | ast.match_case) for n in inside) + sum(len(n.values) - 1 for n in inside if isinstance(n, ast.BoolOp))
                unit.depth = _python_depth(child)
                out.append(unit)
                visit(child, owner)
            else:
                visit(child, child.name if isinstance(child, ast.ClassDef) else owner)

    visit(tree, "")
    return out


def _python_depth(node: ast.AST) -> int:
    nested = [_python_depth(c) for c in ast.iter_child_nodes(node)]
    return max(nested, default=0) + isinstance(node, ast.If | ast.For | ast.AsyncFor | ast.While | ast.With | ast.Try)


def _indented_units(text: str, masked: str) -> list[Unit]:
    raw, plain, out = text.split("\n"), masked.split("\n"), []
    for i, line in enumerate(plain):
        found = re.match(r"(\s*)(async\s+)?def\s+(\w+)\s*\(([^)]*)", line)
        if found:
            indent = len(found.group(1))
            last = i
            for k in range(i + 1, len(plain)):
                if plain[k].strip():
                    if len(plain[k]) - len(plain[k].lstrip()) <= indent:
                        break
                    last = k
            body = "\n".join(plain[i : last + 1])
            params = [p.split(":")[0].split("=")[0].strip(" *") for p in found.group(4).split(",") if p.strip()]
            depth = max([(len(x) - len(x.lstrip()) - indent) // 4 - 1 for x in plain[i + 1 : last + 1] if x.strip()], default=0)
            out.append(Unit(found.group(3), i + 1, last + 1, params, body, "\n".join(raw[i : last + 1]), "", bool(found.group(2)), 1 + len(BRANCHES.findall(body)), depth))
    return out


def close_of(text: str, at: int) -> int:
    """The place past the brace that closes the one at `at`; the text's end if none does."""
    depth = 0
    for found in re.compile("[{}]").finditer(text, at):
        depth += 1 if found.group() == "{" else -1
        if depth == 0:
            return found.end()
    return len(text)


def _param_names(params: str, family: str) -> list[str]:
    out = []
    for p in params.split(","):
        words = re.findall(r"[\w$]+", p.split("=")[0].split(":")[0] if family in ("script", "rust") else p.split("=")[0])
        if words and words[-1] != "void":
            out.append(words[0] if family == "go" else words[-1])
    return out


def _brace_units(text: str, masked: str, family: str) -> list[Unit]:
    out = []
    for found in HEADERS[family].finditer(masked):
        groups = found.groupdict()
        name = groups["name"] or groups.get("name2") or ""
        open_at = masked.find("{", found.end())
        if not name or name in NOT_NAMES or open_at < 0 or ";" in masked[found.end() : open_at] or "\n\n" in masked[found.end() : open_at]:
            continue
        end = close_of(masked, open_at)
        owner = re.findall(r"\w+", groups.get("owner") or "")
        if "::" in name:
            *held, name = name.split("::")
            owner = held
        begin = found.start() + len(found.group()) - len(found.group().lstrip())
        body = masked[open_at:end]
        depth = nested = 0
        for c in re.findall("[{}]", body):
            nested += 1 if c == "{" else -1
            depth = max(depth, nested)
        first = masked.count("\n", 0, begin) + 1
        out.append(Unit(name, first, masked.count("\n", 0, end) + 1, _param_names(groups["params"] or "", family), masked[begin:end], text[begin:end], owner[-1] if owner else "", bool(groups.get("async")), 1 + len(BRANCHES.findall(body)), max(0, depth - 1)))
    return out


def units_of(text: str | None, lang: str | None) -> list[Unit]:
    text, lang = text or "", (lang or "").lower()
    if lang == "py":
        return _python_units(text, mask(text, lang))
    if lang in BRACE_LANGS:
        return _brace_units(text, mask(text, lang), FAMILY.get(lang, "c"))
    return []


def imports_of(text: str | None, lang: str | None) -> list[tuple[str, list[str], int, int]]:
    """(module, names, level, line); the level counts the dots of a relative Python import."""
    text, lang = text or "", (lang or "").lower()
    if lang == "py":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return [(m.group(1) or m.group(2), [], 0, text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", text, re.M)]
        out = []
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                out += [(a.name, [], 0, node.lineno) for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                out.append((node.module or "", [a.name for a in node.names], node.level, node.lineno))
        return out
    family = {"java": "java", "kt": "java", "scala": "java"}.get(lang) or FAMILY.get(lang, "c")
    if lang not in BRACE_LANGS:
        return []
    if family == "go":
        blocks = re.finditer(r"^import\s*(?:\((?P<many>[^)]*)\)|(?P<one>[^\n]*))", text, re.M)
        return [(m.group("module"), [], 0, text.count("\n", 0, b.start() + b.group().find(m.group("module"))) + 1) for b in blocks for m in IMPORTS["go"].finditer(b.group("many") or b.group("one") or "")]
    out = []
    for m in IMPORTS[family].finditer(text):
        line = text.count("\n", 0, m.end()) + 1
        if family == "rust":
            out += [(p, [], 0, line) for p in expand_use(m.group("module"))]
        else:
            groups = m.groupdict()
            names = re.findall(r"[\w$]+", groups.get("names") or groups.get("names2") or "") if family == "script" else []
            out.append((groups.get("module") or groups.get("names") or "", names, 0, line))
    return out


def expand_use(tree: str) -> list[str]:
    """The paths of a Rust use tree: a::{b, c::{d, e as f}} gives a::b, a::c::d and a::c::e."""
    tree = re.sub(r"\s+as\s+\w+", "", re.sub(r"\s+", " ", tree)).strip()
    at = tree.find("{")
    if at < 0:
        return [tree.removesuffix("::*").removesuffix("::self")] if tree else []
    parts, depth, last = [], 0, at + 1
    for i in range(at, len(tree)):
        depth += {"{": 1, "}": -1}.get(tree[i], 0)
        if (tree[i] == "," and depth == 1) or depth == 0:
            parts.append(tree[last:i])
            last = i + 1
        if depth == 0:
            break
    return [(tree[:at] + p).removesuffix("::self") for part in parts for p in expand_use(part)]


def functions(files: DataFrame) -> DataFrame:
    """One row for each function of files (path, text, lang): its lines, parameters, masked and raw text, complexity and nesting."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, g, u.name, u.owner, u.first, u.last, u.params, u.body, u.raw, u.complexity, u.depth, u.is_async) for p, t, g in zip(frame["path"], frame["text"], frame["lang"], strict=True) for u in units_of(t, g)]
            yield pd.DataFrame(rows, columns=["path", "lang", "name", "owner", "first", "last", "params", "body", "raw", "complexity", "depth", "is_async"])

    return files.select("path", "text", "lang").mapInPandas(task, FUNCTION_SCHEMA)


def imports(files: DataFrame) -> DataFrame:
    """One row for each import of files (path, text, lang)."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, g, *i) for p, t, g in zip(frame["path"], frame["text"], frame["lang"], strict=True) for i in imports_of(t, g)]
            yield pd.DataFrame(rows, columns=["path", "lang", "module", "names", "level", "line"])

    return files.select("path", "text", "lang").mapInPandas(task, IMPORT_SCHEMA)


def test_blocks(units: DataFrame) -> DataFrame:
    """The functions that are tests, with what their assertions show (n_asserts, n_constant, n_conditional)."""
    is_test = F.col("name").rlike(r"^(test_?|Test|it$|should)") | F.col("path").rlike(r"(_test|\.test|\.spec)\.[a-z]+$") & F.col("name").rlike("(?i)^test")
    lines = F.split("body", "\n")
    asserts = r"\bassert|\bexpect\s*\(|\bEXPECT_|\bASSERT_|\bt\.(Error|Fatal|Fail)|\brequire\.|\bself\.assert|\bpytest\.raises"
    constant = r"\bassert\s+(True|\d+\s*==\s*\d+)\s*$|expect\s*\(\s*(true|\d+)\s*\)\s*\.\s*toBe(Truthy)?\s*\(\s*(true|\d+)?\s*\)|(EXPECT|ASSERT)_TRUE\s*\(\s*true\s*\)|self\.assertTrue\s*\(\s*True\s*\)"
    hit = F.filter(lines, lambda x: x.rlike(asserts))
    indent = lambda x: F.length(x) - F.length(F.ltrim(x))
    base = F.array_min(F.transform(F.filter(F.slice(lines, 2, 1_000_000), lambda x: F.trim(x) != ""), indent))
    guarded = F.col("body").rlike(r"\bif\b") & ~F.col("body").rlike(r"\belse\b")
    return units.where(is_test).select(
        "path", "name", "first", F.size(hit).alias("n_asserts"), F.size(F.filter(hit, lambda x: x.rlike(constant))).alias("n_constant"), F.when(guarded, F.size(F.filter(hit, lambda x: indent(x) > base))).otherwise(0).alias("n_conditional")
    )


def test_quality(blocks: DataFrame) -> DataFrame:
    """(rule_id, path, line, name): no assertion, only constant ones, or only conditional ones; the first that holds."""
    n = F.col("n_asserts")
    rule = F.when(n == 0, "ci.test-without-assertion").when(F.col("n_constant") == n, "ci.always-true-test-assertion").when(F.col("n_conditional") == n, "ci.conditional-assertion")
    return blocks.select(rule.alias("rule_id"), "path", F.col("first").alias("line"), "name").where("rule_id is not null")


def unreachable(units: DataFrame) -> DataFrame:
    """(path, name, line): a line of the same block that follows return, raise, throw, break or continue."""
    lines = F.transform(F.split("body", "\n"), lambda x, i: F.struct((F.col("first") + i).alias("line"), F.trim(x).alias("t"), (F.length(x) - F.length(F.ltrim(x))).alias("indent")))
    own = units.select("path", "name", F.filter(lines, lambda x: x["t"] != "").alias("l"))
    pairs = own.select("path", "name", F.explode(F.zip_with(F.slice("l", 1, 1_000_000), F.concat(F.slice("l", 2, 1_000_000), F.array(F.element_at("l", -1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    ends = F.col("p.a.t").rlike(r"^(return\b|raise\b|throw\b|break\b|continue\b)[^{(\[]*(\([^()]*\))?;?$")
    same = (F.col("p.b.line") > F.col("p.a.line")) & (F.col("p.b.indent") == F.col("p.a.indent")) & ~F.col("p.b.t").rlike(r"^(}|case\b|default\b|else\b|elif\b|except\b|finally\b|catch\b|\w+:$)")
    return pairs.where(ends & same).select("path", "name", F.col("p.b.line").alias("line"))


def size_findings(units: DataFrame, max_lines: int = 80, max_params: int = 5, max_complexity: int = 10) -> DataFrame:
    """(rule_id, path, line, name, value): functions over the limits of lines, parameters and complexity."""
    n = F.col("last") - F.col("first") + 1
    params = F.size(F.filter("params", lambda p: ~p.isin("self", "cls", "this")))
    over = lambda rule, value, limit: F.when(value > limit, F.struct(F.lit(rule).alias("rule_id"), value.cast("int").alias("value")))
    found = F.array_compact(F.array(over("quality.max-function-lines", n, max_lines), over("quality.max-parameters", params, max_params), over("quality.cyclomatic-complexity", F.col("complexity"), max_complexity)))
    return units.select("path", F.col("first").alias("line"), "name", F.explode(found).alias("x")).select("x.rule_id", "path", "line", "name", "x.value")


def data_clumps(units: DataFrame, least: int = 3, size: int = 3) -> DataFrame:
    """(path, params, functions): the first group of `size` parameters that `least` functions of one file share."""
    names = F.array_sort(F.array_distinct(F.filter("params", lambda p: ~p.isin("self", "cls", "this", "ctx"))))
    groups = units.select("path", "first", names.alias("p")).where(F.size("p") >= size).select("path", "first", F.concat_ws(",", "p").alias("params"))
    by = groups.groupBy("path", "params").agg(F.count(F.lit(1)).alias("functions")).where(F.col("functions") >= least)
    return by.groupBy("path").agg(F.min(F.struct("params", "functions")).alias("x")).select("path", "x.params", "x.functions")
