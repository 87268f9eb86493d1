"""Dependency manifests as a table of dependencies, advisories, and version ranges.

Manifests are small texts of many syntaxes, so one Arrow-batched function reads them by file name; all matching, against advisories,
lock files and policies, is joins on the table of dependencies.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, ecosystem string, name string, requirement string, version string, scope string, line int"
Dep = tuple[str, str, str, str, int]  # name, requirement, version, scope, line


def pinned(requirement: str) -> str:
    """The version that a requirement fixes; empty for a range."""
    found = re.fullmatch(r"\s*(?:==?=?\s*)?v?(\d+(?:\.[0-9A-Za-z+-]+)*)\s*", requirement or "")
    return found.group(1) if found else ""


def _line_of(lines: list[str], name: str) -> int:
    return next((i for i, line in enumerate(lines, 1) if name in line), 1)


def go_mod(text: str) -> Iterator[Dep]:
    inside = False
    for i, raw in enumerate(text.split("\n"), 1):
        line, _, note = raw.partition("//")
        words = line.split()
        if words[:1] == ["require"]:
            inside, words = words[1:2] == ["("], words[1:]
        elif words[:1] == [")"]:
            inside = False
            continue
        elif not inside:
            continue
        if len(words) == 2 and words[1].startswith("v"):
            yield words[0], words[1], words[1].lstrip("v"), "indirect" if "indirect" in note else "direct", i


def package_json(text: str) -> Iterator[Dep]:
    held, lines = json.loads(text), text.split("\n")
    for key, scope in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
        for name, want in (held.get(key) or {}).items():
            yield name, str(want), pinned(str(want)), scope, _line_of(lines, f'"{name}"')


def _requirement(item: str) -> tuple[str, str] | None:
    found = re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*\(?([^;#)]*)", item)
    return (found.group(1), found.group(2).strip()) if found else None


def requirements_txt(text: str) -> Iterator[Dep]:
    for i, line in enumerate(text.split("\n"), 1):
        if line.strip() and not line.lstrip().startswith(("#", "-")) and (found := _requirement(line)):
            yield found[0], found[1], pinned(found[1]), "runtime", i


def pyproject(text: str) -> Iterator[Dep]:
    import tomllib

    held, lines = tomllib.loads(text), text.split("\n")
    project = held.get("project") or {}
    groups = {"runtime": project.get("dependencies") or []} | {k: v for k, v in (project.get("optional-dependencies") or {}).items()} | {k: v for k, v in (held.get("dependency-groups") or {}).items()}
    for scope, items in groups.items():
        for item in items:
            if isinstance(item, str) and (found := _requirement(item)):
                yield found[0], found[1], pinned(found[1]), scope, _line_of(lines, found[0])
    poetry = (held.get("tool") or {}).get("poetry") or {}
    tables = {"runtime": poetry.get("dependencies") or {}} | {k: v.get("dependencies") or {} for k, v in (poetry.get("group") or {}).items()}
    for scope, items in tables.items():
        for name, want in items.items():
            if name != "python":
                want = want.get("version", "") if isinstance(want, dict) else str(want)
                yield name, want, pinned(want), scope, _line_of(lines, name)


def cargo_toml(text: str) -> Iterator[Dep]:
    import tomllib

    held, lines = tomllib.loads(text), text.split("\n")
    tables = [held, *(held.get("target") or {}).values(), held.get("workspace") or {}]
    for table in tables:
        for key, scope in (("dependencies", "runtime"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
            for name, want in (table.get(key) or {}).items():
                want = want.get("version", "") if isinstance(want, dict) else str(want)
                yield name, want, pinned(want), scope, _line_of(lines, name)


def vcpkg_json(text: str) -> Iterator[Dep]:
    held, lines = json.loads(text), text.split("\n")
    fixed = {o.get("name"): str(o.get("version") or o.get("version-string") or "") for o in held.get("overrides") or []}
    for item in held.get("dependencies") or []:
        name = item if isinstance(item, str) else item.get("name", "")
        least = "" if isinstance(item, str) else item.get("version>=", "")
        if name:
            yield name, f">={least}" if least else "", fixed.get(name, ""), "runtime", _line_of(lines, f'"{name}"')


def conanfile_txt(text: str) -> Iterator[Dep]:
    scope = ""
    for i, raw in enumerate(text.split("\n"), 1):
        line = raw.partition("#")[0].strip()
        if line.startswith("["):
            scope = {"[requires]": "runtime", "[build_requires]": "build", "[tool_requires]": "build", "[test_requires]": "test"}.get(line, "")
        elif scope and "/" in line:
            name, _, want = line.partition("/")
            want = want.partition("@")[0]
            yield name, want, pinned(want), scope, i


def conanfile_py(text: str) -> Iterator[Dep]:
    """Literal requirements only: class attributes and self.requires("name/version") calls; nothing is run."""
    for node in ast.walk(ast.parse(text)):
        found: list[tuple[str, str, int]] = []
        if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name) and node.targets[0].id in ("requires", "build_requires", "tool_requires", "test_requires"):
            try:
                values = ast.literal_eval(node.value)
            except ValueError:
                continue
            found = [(v, node.targets[0].id, node.lineno) for v in ([values] if isinstance(values, str) else values) if isinstance(v, str)]
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("requires", "build_requires", "tool_requires", "test_requires") and node.args and isinstance(node.args[0], ast.Constant):
            found = [(str(node.args[0].value), node.func.attr, node.lineno)]
        for item, kind, line in found:
            name, _, want = item.partition("/")
            want = want.partition("@")[0]
            yield name, want, pinned(want), {"requires": "runtime", "test_requires": "test"}.get(kind, "build"), line


def cmake_lists(text: str) -> Iterator[Dep]:
    """find_package, FetchContent_Declare and CPMAddPackage, with ${variables} that set() gave a literal."""
    plain = re.sub(r"(?m)(^|\s)#[^\n]*", r"\1", text)
    values: dict[str, str] = {}
    resolve = lambda w: re.sub(r"\$\{(\w+)\}", lambda m: values.get(m.group(1), m.group(0)), w)
    for found in re.finditer(r"(\w+)\s*\(([^)]*)\)", plain):
        command, words = found.group(1).lower(), [resolve(w.strip('"')) for w in re.findall(r'"[^"]*"|\S+', found.group(2))]
        line = plain.count("\n", 0, found.start()) + 1
        if command == "set" and len(words) >= 2:
            values[words[0]] = words[1]
        elif command == "find_package" and words:
            want = words[1] if len(words) > 1 and re.match(r"[\d.]+", words[1]) else ""
            yield words[0], want, pinned(want) if "EXACT" in words else "", "runtime", line
        elif command == "fetchcontent_declare" and words:
            want = next((words[k + 1] for k, w in enumerate(words[:-1]) if w in ("GIT_TAG", "URL")), "")
            yield words[0], want, pinned(want), "runtime", line
        elif command == "cpmaddpackage" and words:
            item = re.match(r"(?:\w+:)?(?:[\w.-]+/)?([\w.-]+)[@#]([\w.-]+)", words[0])
            if item:
                yield item.group(1), item.group(2), pinned(item.group(2)), "runtime", line


#: Reader and ecosystem by file name.
READERS = {
    "go.mod": ("go", go_mod), "package.json": ("npm", package_json), "requirements.txt": ("python", requirements_txt), "requirements-dev.txt": ("python", requirements_txt), "pyproject.toml": ("python", pyproject),
    "Cargo.toml": ("cargo", cargo_toml), "vcpkg.json": ("vcpkg", vcpkg_json), "conanfile.txt": ("conan", conanfile_txt), "conanfile.py": ("conan", conanfile_py), "CMakeLists.txt": ("cmake", cmake_lists),
}
#: Lock files that belong to a manifest.
LOCKFILES = {"go.mod": ("go.sum",), "package.json": ("package-lock.json", "yarn.lock", "pnpm-lock.yaml"), "pyproject.toml": ("poetry.lock", "uv.lock", "pdm.lock"), "Cargo.toml": ("Cargo.lock",), "conanfile.txt": ("conan.lock",), "conanfile.py": ("conan.lock",)}


def read_manifest(name: str, text: str | None) -> list[Dep]:
    """A manifest that cannot be parsed gives no dependency, as does one of an unknown name."""
    try:
        return list(READERS[name][1](text or "")) if name in READERS else []
    except (ValueError, SyntaxError, TypeError, AttributeError):
        return []


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def manifests(files: DataFrame) -> DataFrame:
    return files.where(base_name(F.col("path")).isin(*READERS))


def dependencies(files: DataFrame) -> DataFrame:
    """(path, ecosystem, name, requirement, version, scope, line) of every dependency in the manifests among files (path, text)."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                name = path.rsplit("/", 1)[-1]
                rows += [(path, READERS[name][0], *d) for d in read_manifest(name, text)]
            yield pd.DataFrame(rows, columns=["path", "ecosystem", "name", "requirement", "version", "scope", "line"])

    return manifests(files).select("path", "text").mapInPandas(task, SCHEMA)


def without_lockfile(files: DataFrame) -> DataFrame:
    """(path) of manifests beside which none of their lock files lies."""
    names = F.create_map(*(x for k, v in LOCKFILES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    folder = F.regexp_replace("path", "[^/]*$", "")
    wanted = files.select("path", F.explode(F.element_at(names, base_name(F.col("path")))).alias("lock"), folder.alias("folder")).select("path", F.concat("folder", "lock").alias("lock"))
    held = wanted.join(files.select(F.col("path").alias("lock")), "lock", "left_semi").select("path").distinct()
    return wanted.select("path").distinct().join(held, "path", "left_anti")


def version_parts(version: Column) -> Column:
    """Up to three numbers of a version, what follows a - or + cut off; null if it is none."""
    plain = F.regexp_replace(F.trim(version), r"^[vV]|[-+].*$", "")
    parts = F.transform(F.split(plain, "[.]"), lambda x: x.try_cast("int"))
    good = plain.rlike(r"^[0-9]{1,9}([.][0-9]{1,9}){0,3}$")
    padded = F.slice(F.concat(parts, F.array(F.lit(0), F.lit(0))), 1, 3)
    return F.when(good, padded)


def in_range(version: Column, ranges: Column) -> Column:
    """Whether a version meets all of comma-separated bounds (< <= > >= =). What cannot be parsed is in no range."""
    parts = version_parts(version)

    def meets(item: Column) -> Column:
        sign = F.regexp_extract(item, r"^\s*(<=|>=|==|<|>|=)?", 1)
        bound = version_parts(F.regexp_replace(item, r"^\s*(<=|>=|==|<|>|=)?\s*", ""))
        test = F.when(sign == "<", parts < bound).when(sign == "<=", parts <= bound).when(sign == ">", parts > bound).when(sign == ">=", parts >= bound).otherwise(parts == bound)
        return F.coalesce(test, F.lit(False))

    return F.coalesce(F.forall(F.split(ranges, ","), meets), F.lit(False))


def advisories(spark: SparkSession, path: str, schema_version: int = 1) -> DataFrame:
    """(id, ecosystem, package, affected, fixed, severity, fetched) from an offline cache of a known schema version."""
    shape = "schema_version int, fetched string, advisories array<struct<id:string,ecosystem:string,package:string,affected:string,fixed:string,severity:string>>"
    held = spark.read.schema(shape).json(path, multiLine=True).where(F.col("schema_version") == schema_version)
    return held.select(F.to_date("fetched").alias("fetched"), F.explode("advisories").alias("a")).select("a.*", "fetched")


def vulnerable(deps: DataFrame, known: DataFrame) -> DataFrame:
    """(path, line, name, version, id, fixed, severity): dependencies of a fixed version in an advisory's range; ecosystem and package compare without case."""
    a = known.select(F.lower("ecosystem").alias("e"), F.lower("package").alias("p"), "id", "affected", "fixed", F.col("severity").alias("severity"))
    joined = deps.where("version <> ''").join(a, (F.lower("ecosystem") == F.col("e")) & (F.lower("name") == F.col("p")))
    return joined.where(in_range(F.col("version"), F.col("affected"))).select("path", "line", "name", "version", "id", "fixed", "severity")
