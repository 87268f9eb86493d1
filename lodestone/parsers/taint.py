"""Untrusted values that reach sinks: sources, sanitisers and sinks as data, statements in order, summaries of local functions.

Python goes through its syntax tree. The brace languages go statement by statement over the functions' raw text. Both repeat over a file's functions until
no function's summary changes, so a value is followed through calls within the file. One Arrow-batched pass over files.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .units import FAMILY, units_of

SCHEMA = "rule_id string, severity string, path string, line int, sink string, source string, message string"

# Where untrusted values come from, what makes them safe, and where they must not go: by language. Fixed values.
PY_SOURCES = {"input", "os.getenv", "os.environ.get", "sys.stdin.read", "sys.stdin.readline"}
PY_SOURCE_NAMES = {"sys.argv", "os.environ", "request.args", "request.form", "request.json", "request.data", "request.values", "request.cookies", "request.headers", "request.GET", "request.POST", "request.body", "request.query_params"}
PY_SAFE = {"int", "float", "bool", "len", "shlex.quote", "html.escape", "escape", "quote", "urllib.parse.quote", "re.escape", "bleach.clean", "markupsafe.escape", "hash", "uuid.UUID"}
PY_SINKS = {
    "os.system": "command", "os.popen": "command", "subprocess.run": "command", "subprocess.call": "command", "subprocess.Popen": "command", "subprocess.check_output": "command", "subprocess.check_call": "command",
    "eval": "code", "exec": "code", "compile": "code", "pickle.loads": "deserialisation", "yaml.load": "deserialisation", "open": "path", "render_template_string": "template",
    "requests.get": "url", "requests.post": "url", "requests.put": "url", "requests.delete": "url", "requests.request": "url", "urllib.request.urlopen": "url", "urlopen": "url", "httpx.get": "url", "httpx.post": "url",
}
PY_SINK_METHODS = {"execute": "sql", "executemany": "sql", "executescript": "sql", "raw": "sql"}
BRACE = {
    "go": {
        "source": r"r\.(URL\.Query\(\)|FormValue\(|PostFormValue\(|Header\.Get\(|Body\b)|os\.(Getenv\(|Args\b)|c\.(Query|Param|PostForm)\(|bufio\.NewReader\(os\.Stdin",
        "safe": r"strconv\.(Atoi|Parse\w+)\(|html\.EscapeString\(|url\.(Query|Path)Escape\(|filepath\.Base\(|template\.HTMLEscapeString\(",
        "sinks": {"command": r"exec\.Command(?:Context)?\(", "sql": r"\.(?:Query|QueryRow|Exec)(?:Context)?\(", "path": r"os\.(?:Open|ReadFile|Create|Remove)\(", "url": r"http\.(?:Get|Post|Head|PostForm|NewRequest)\("},
    },
    "script": {
        "source": r"(?:req|request|ctx)\.(?:query|params|body|headers|cookies)\b|process\.(?:argv|env)\b|location\.(?:hash|search|href)|document\.(?:URL|referrer|cookie)|window\.name",
        "safe": r"(?:parseInt|Number|encodeURIComponent|escapeHtml|sanitize\w*|DOMPurify\.sanitize)\(",
        "sinks": {"command": r"(?:exec|execSync|spawn)\(", "code": r"(?:\beval|new Function)\(", "sql": r"\.(?:query|raw)\(", "html": r"\.innerHTML\s*=|document\.write\(|insertAdjacentHTML\(", "url": r"(?:fetch|axios(?:\.\w+)?|got)\(", "path": r"fs\.\w+\("},
    },
    "c": {
        "source": r"\bgetenv\(|\bargv\[|std::cin\b|\bfgets\(|\bgets\(|\brecv\(|\bstd::getline\(",
        "safe": r"\b(?:atoi|stoi|std::stoi|strtol|escape\w*|sanitize\w*)\(",
        "sinks": {"command": r"\b(?:system|popen|execl\w*|execv\w*)\(", "path": r"\b(?:fopen|std::ifstream|open)\(", "sql": r"\b(?:sqlite3_exec|mysql_query|PQexec)\(", "format": r"\bprintf\(\s*\w+\s*\)", "url": r"CURLOPT_URL|cpr::Get\("},
    },
}
RULE = {"py": "python", "go": "go", **{e: "typescript" for e in ("ts", "tsx")}, **{e: "javascript" for e in ("js", "jsx", "mjs", "cjs")}, **{e: "cpp" for e in ("c", "cc", "cpp", "cxx", "h", "hh", "hpp")}}


def rule_id(lang: str, kind: str) -> str:
    name = RULE[lang]
    if name in ("typescript", "javascript"):
        return f"security.{name}.taint-flow"
    return f"security.ssrf.{name}" if kind == "url" else f"security.taint.{name}"


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else ""
    return node.id if isinstance(node, ast.Name) else ""


class _Python:
    """Taint is the set of what a value may come from: names of sources, and `param:NAME`."""

    def __init__(self, tree: ast.Module):
        self.functions = {n.name: n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)}
        self.returns: dict[str, frozenset[str]] = {f: frozenset() for f in self.functions}
        self.param_sinks: dict[str, frozenset[tuple[str, str, str]]] = {f: frozenset() for f in self.functions}
        self.found: set[tuple[int, str, str, str]] = set()
        while True:  # summaries only grow, and what they hold is bounded by the file
            before = dict(self.returns), dict(self.param_sinks)
            for name, node in self.functions.items():
                params = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
                self.owner, self.env = name, {p: frozenset({f"param:{p}"}) for p in params if p not in ("self", "cls")}
                self.block(node.body)
            if before == (self.returns, self.param_sinks):
                break
        self.owner, self.env = "", {}
        self.block([n for n in tree.body if not isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)])

    def block(self, body: list[ast.stmt]) -> None:
        for node in body:
            self.statement(node)

    def statement(self, node: ast.stmt) -> None:
        if isinstance(node, ast.Assign | ast.AnnAssign | ast.AugAssign):
            value = self.value(node.value) if node.value else frozenset()
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            for target in targets:
                for name in ast.walk(target):
                    if isinstance(name, ast.Name):
                        self.env[name.id] = value | (self.env.get(name.id, frozenset()) if isinstance(node, ast.AugAssign) else frozenset())
        elif isinstance(node, ast.Return):
            taint = self.value(node.value) if node.value else frozenset()
            if self.owner:
                self.returns[self.owner] |= taint
        elif isinstance(node, ast.If | ast.While):
            self.value(node.test)
            before = dict(self.env)
            self.block(node.body)
            then, self.env = self.env, before
            self.block(node.orelse)
            self.env = {k: then.get(k, frozenset()) | self.env.get(k, frozenset()) for k in {*then, *self.env}}
        elif isinstance(node, ast.For | ast.AsyncFor):
            value = self.value(node.iter)
            for name in ast.walk(node.target):
                if isinstance(name, ast.Name):
                    self.env[name.id] = value
            self.block(node.body)
            self.block(node.orelse)
        elif isinstance(node, ast.With | ast.AsyncWith):
            for item in node.items:
                value = self.value(item.context_expr)
                if isinstance(item.optional_vars, ast.Name):
                    self.env[item.optional_vars.id] = value
            self.block(node.body)
        elif isinstance(node, ast.Try):
            for part in (node.body, *(h.body for h in node.handlers), node.orelse, node.finalbody):
                self.block(part)
        elif isinstance(node, ast.ClassDef):
            self.block([n for n in node.body if not isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)])
        elif isinstance(node, ast.Expr):
            self.value(node.value)
        else:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.expr):
                    self.value(child)

    def value(self, node: ast.AST | None) -> frozenset[str]:
        if node is None or isinstance(node, ast.Constant | ast.Lambda):
            return frozenset()
        name = _dotted(node)
        if name in PY_SOURCE_NAMES:
            return frozenset({name})
        if isinstance(node, ast.Name):
            return self.env.get(node.id, frozenset())
        if isinstance(node, ast.Call):
            return self.call(node)
        if isinstance(node, ast.Compare):
            for child in ast.iter_child_nodes(node):
                self.value(child)
            return frozenset()
        taint: frozenset[str] = frozenset()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.expr | ast.comprehension | ast.keyword):
                if isinstance(child, ast.comprehension):
                    got = self.value(child.iter)
                    for n in ast.walk(child.target):
                        if isinstance(n, ast.Name):
                            self.env[n.id] = got
                else:
                    got = self.value(child)
                taint |= got
        return taint

    def call(self, node: ast.Call) -> frozenset[str]:
        name = _dotted(node.func)
        arguments = [*node.args, *(k.value for k in node.keywords)]
        taints = [self.value(a) for a in arguments]
        own = self.value(node.func.value) if isinstance(node.func, ast.Attribute) else frozenset()
        if name in PY_SAFE:
            return frozenset()
        method = node.func.attr if isinstance(node.func, ast.Attribute) else ""
        kind = PY_SINKS.get(name) or PY_SINK_METHODS.get(method)
        if kind and arguments:
            # of a statement with parameters only the text of the statement counts; of a command without a shell a list is safe
            checked = taints[:1] if kind in ("sql", "url", "path") else taints
            if not (kind == "command" and name.startswith("subprocess") and isinstance(arguments[0], ast.List) and not any(k.arg == "shell" for k in node.keywords)):
                for taint in checked:
                    self.sink(node.lineno, kind, name or method, taint)
        local = name if name in self.functions else method if method in self.functions and name.startswith("self.") else ""
        if local:
            target = self.functions[local]
            params = [a.arg for a in (*target.args.posonlyargs, *target.args.args) if a.arg not in ("self", "cls")]
            given = dict(zip(params, taints, strict=False)) | {k.arg: self.value(k.value) for k in node.keywords if k.arg}
            for kind, sink, param in self.param_sinks[local]:
                self.sink(node.lineno, kind, f"{local} -> {sink}", given.get(param, frozenset()))
            out: frozenset[str] = frozenset()
            for t in self.returns[local]:
                out |= given.get(t[6:], frozenset()) if t.startswith("param:") else frozenset({t})
            return out
        if name in PY_SOURCES:
            return frozenset({name})
        return own.union(*taints) if taints else own

    def sink(self, line: int, kind: str, sink: str, taint: frozenset[str]) -> None:
        for t in taint:
            if t.startswith("param:"):
                if self.owner and sink.count("->") < 8:
                    self.param_sinks[self.owner] |= {(kind, sink, t[6:])}
            else:
                self.found.add((line, kind, sink, t))


def python_taint(text: str) -> list[tuple[int, str, str, str]]:
    """(line, kind, sink, source) of every flow in a Python text; none if it does not parse."""
    try:
        return sorted(_Python(ast.parse(text)).found)
    except (SyntaxError, ValueError, RecursionError):
        return []


def brace_taint(text: str, lang: str) -> list[tuple[int, str, str, str]]:
    """The same for Go, TypeScript, JavaScript, C and C++, over assignments and calls of each function."""
    model = BRACE.get(FAMILY.get(lang, "c"))
    if model is None:
        return []
    units = units_of(text, lang)
    source, safe = re.compile(model["source"]), re.compile(model["safe"])
    sinks = {k: re.compile(p) for k, p in model["sinks"].items()}
    reaches: dict[str, set[tuple[int, str, str]]] = {u.name: set() for u in units}
    returns: dict[str, set[str]] = {u.name: set() for u in units}
    found: set[tuple[int, str, str, str]] = set()
    assign = re.compile(r"^\s*(?:const|let|var|auto|char\s*\*|std::string|[\w:<>*&]+\s+)?\s*([\w$]+)(?:\s*,\s*[\w$]+)*(?:\s*:\s*[\w<>\[\]]+)?\s*(?::=|=(?!=)|\+=)\s*(.*)$")
    while True:
        before = {k: set(v) for k, v in reaches.items()}, {k: set(v) for k, v in returns.items()}, len(found)
        for u in units:
            env = {p: {f"param:{i}"} for i, p in enumerate(u.params)}
            for offset, line in enumerate(u.raw.split("\n")):
                def taint(expr: str, env=env) -> set[str]:
                    if safe.search(expr):
                        return set()
                    out = {m.group().rstrip("(") for m in source.finditer(expr)}
                    for word in re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"\"[^\"]*\"|'[^']*'", "", expr)):
                        out |= env.get(word, set())
                    for name, given in _calls(expr, returns):
                        for t in returns[name]:
                            out |= taint(given[int(t[6:])]) if t.startswith("param:") and int(t[6:]) < len(given) else set() if t.startswith("param:") else {t}
                    return out

                at = u.first + offset
                if offset and (m := assign.match(line)):
                    env[m.group(1)] = taint(m.group(2)) | (env.get(m.group(1), set()) if "+=" in line else set())
                if m := re.match(r"^\s*return\s+(.*)", line):
                    returns[u.name] |= taint(m.group(1))
                for kind, pattern in sinks.items():
                    for m in pattern.finditer(line) if offset else ():
                        given = line[m.end() :]
                        checked = given.split(",")[0] if kind == "sql" else given
                        for t in taint(checked):
                            if t.startswith("param:"):
                                reaches[u.name].add((int(t[6:]), kind, m.group().rstrip("( =")))
                            else:
                                found.add((at, kind, m.group().rstrip("( ="), t))
                for name, given in _calls(line, reaches) if offset else ():
                    for k, kind, sink in list(reaches[name]):
                        for t in taint(given[k]) if k < len(given) else ():
                            if t.startswith("param:"):
                                reaches[u.name].add((int(t[6:]), kind, sink))
                            else:
                                found.add((at, kind, f"{name} -> {sink}", t))
        if before == (reaches, returns, len(found)):
            return sorted(found)


def _calls(expr: str, known: dict) -> list[tuple[str, list[str]]]:
    out = []
    for m in re.finditer(r"([A-Za-z_$][\w$]*)\(", expr):
        if m.group(1) in known:
            depth, last, given = 1, m.end(), []
            for i in range(m.end(), len(expr)):
                depth += {"(": 1, ")": -1}.get(expr[i], 0)
                if depth == 0 or (depth == 1 and expr[i] == ","):
                    given.append(expr[last:i])
                    last = i + 1
                if depth == 0:
                    break
            out.append((m.group(1), given))
    return out


def taint_of(text: str | None, lang: str | None) -> list[tuple[int, str, str, str]]:
    lang = (lang or "").lower()
    if lang not in RULE:
        return []
    return python_taint(text or "") if lang == "py" else brace_taint(text or "", lang)


def taint_findings(files: DataFrame) -> DataFrame:
    """(rule_id, severity, path, line, sink, source, message) of flows from untrusted sources to sinks in files (path, text, lang)."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text, lang in zip(frame["path"], frame["text"], frame["lang"], strict=True):
                for line, kind, sink, source in taint_of(text, lang):
                    rule = rule_id((lang or "").lower(), kind)
                    rows.append((rule, "warn" if rule.endswith("taint-flow") else "fail", path, line, sink, source, f"{source} reaches {sink} ({kind})"))
            yield pd.DataFrame(rows, columns=["rule_id", "severity", "path", "line", "sink", "source", "message"])

    return files.select("path", "text", "lang").mapInPandas(task, SCHEMA)
