"""Blanking of comments and string contents that keeps every line and column where it was.

A state machine over characters, as no regular expression can tell a quote in a comment from one in code. One pass for each file,
Arrow-batched over many files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _blank(text: str) -> str:
    return "".join(c if c in "\n\r" else " " for c in text)


def mask_python(text: str, keep_strings: bool = False) -> str:
    """Comments and the inside of strings become spaces; what stands in the braces of an f-string is code and stays."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == "#":
            j = text.find("\n", i)
            j = n if j < 0 else j
            out.append(" " * (j - i))
            i = j
        elif c in "'\"":
            quote = text[i : i + 3] if text[i : i + 3] in ("'''", '"""') else c
            k = i - 1
            while k >= 0 and text[k] in "rRbBfFuU":
                k -= 1
            prefix = text[k + 1 : i].lower() if i - 1 - k <= 2 and (k < 0 or not (text[k].isalnum() or text[k] == "_")) else ""
            j = _python_string_end(text, i + len(quote), quote, "r" in prefix)
            body_end = j - len(quote) if text[j - len(quote) : j] == quote and j - len(quote) >= i + len(quote) else j
            body = text[i + len(quote) : body_end]
            out.append(quote + (body if keep_strings else _format_fields(body) if "f" in prefix else _blank(body)) + text[body_end:j])
            i = j
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _python_string_end(text: str, i: int, quote: str, raw: bool) -> int:
    """Past the closing quote; a single-quoted string that is not closed ends at its line."""
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif text.startswith(quote, i):
            return i + len(quote)
        elif text[i] == "\n" and len(quote) == 1:
            return i
        else:
            i += 1
    return len(text)


def _format_fields(body: str) -> str:
    out, depth, i = [], 0, 0
    while i < len(body):
        c = body[i]
        if depth == 0 and body[i : i + 2] in ("{{", "}}"):
            out.append("  ")
            i += 2
            continue
        if c == "{":
            depth += 1
        out.append(c if depth or c in "\n\r" else " ")
        if c == "}" and depth:
            depth -= 1
        i += 1
    return "".join(out)


#: One character in quotes; any other single quote is a lifetime, as in &'a, or a digit separator, as in 1'000.
CHARACTER = re.compile(r"(?<![0-9A-Za-z_])'(\\[^\n']+|\\'|[^'\\\n])'")


def mask_c_like(text: str, raw_backticks: bool = False, templates: bool = False) -> str:
    """For Go (raw_backticks), TypeScript and JavaScript (templates), Java, Rust, C, C++ and C#."""
    out, i, n = [], 0, len(text)
    while i < n:
        two = text[i : i + 2]
        c = text[i]
        if two == "//":
            j = text.find("\n", i)
            j = n if j < 0 else j
            out.append(" " * (j - i))
        elif two == "/*":
            j = text.find("*/", i + 2)
            j = n if j < 0 else j + 2
            out.append(_blank(text[i:j]))
        elif c == "`" and (raw_backticks or templates):
            j = i + 1
            while j < n and text[j] != "`":
                j += 2 if templates and text[j] == "\\" else 1
            out.append("`" + _blank(text[i + 1 : min(j, n)]) + text[j : j + 1])
            j = min(j + 1, n)
        elif c == '"' or (c == "'" and (templates or CHARACTER.match(text, i))):
            j = i + 1
            while j < n and text[j] != c and text[j] != "\n":
                j += 2 if text[j] == "\\" else 1
            j = min(j, n)
            closed = j < n and text[j] == c
            out.append(c + _blank(text[i + 1 : j]) + (c if closed else ""))
            j += closed
        else:
            out.append(c)
            j = i + 1
        i = j
    return "".join(out)


#: Masker by file extension.
MASKERS = {
    "py": mask_python, "go": lambda t: mask_c_like(t, raw_backticks=True), **{e: lambda t: mask_c_like(t, templates=True) for e in ("ts", "tsx", "js", "jsx", "mjs", "cjs")},
    **{e: mask_c_like for e in ("java", "rs", "c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx", "ixx", "cppm", "cs", "kt", "swift", "scala")},
}


def mask(text: str | None, lang: str | None) -> str:
    return MASKERS.get((lang or "").lower(), lambda t: t)(text or "")


def masked_files(files: DataFrame) -> DataFrame:
    """The files (path, text, lang, ...) with masked text; languages without a masker stay as they are."""
    place = files.columns.index("text"), files.columns.index("lang")

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            new = frame.copy()
            new.isetitem(place[0], [mask(t, g) for t, g in zip(frame.iloc[:, place[0]], frame.iloc[:, place[1]], strict=True)])
            yield new

    return files.mapInPandas(task, files.schema)
