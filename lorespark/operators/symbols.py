"""Symbols and call edges of source code, by the standard parser for Python and by masked text for other languages."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lorespark.functions.text import DEFINITION
from lorespark.operators.definitions import KEYWORDS, LANGUAGES, definitions, masked, parsed
from lorespark.sources.shared import frames, small_batches

_DEF = re.compile(DEFINITION)
_NOISE = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])'""", re.S)
_CALL = re.compile(r"([A-Za-z_]\w*)\s*(!?)\(")
_TYPE = re.compile(r"(?:->|[:&<,(]|\bnew\b|\bimpl\b|\bfor\b)\s*(?:&|mut\s+|dyn\s+)*([A-Z]\w*)")
_USE = re.compile(r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);")
_INCLUDE = re.compile(r"""(?m)^\s*#\s*include\s*[<"]([^>"]+)[>"]""")


def symbols(code: str | None, lang: str | None) -> list[str]:
    """Names of all definitions, nested ones too, as ``sym:`` entities, sorted."""
    if lang == "python" and (found := parsed(code or "")):
        kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
        return sorted({f"sym:{n.name}" for n in ast.walk(found) if isinstance(n, kinds)})
    if lang in LANGUAGES:
        return sorted({f"sym:{name}" for name, _ in definitions(code or "", lang)})
    return sorted({f"sym:{m}" for m in _DEF.findall(_NOISE.sub(" ", code or ""))})


def _imports(code: str, lang: str) -> set[str]:
    if lang != "rust":
        return {re.split(r"[\\/]", x)[-1].rsplit(".", 1)[0] for x in _INCLUDE.findall(code)}
    out = set()
    for path in _USE.findall(code):
        for part in re.split(r"[{},]", path):
            name = re.split(r"\s+as\s+|::", part.strip())[-1].strip()
            if name and name not in ("self", "*", "super", "crate"):
                out.add(name)
    return out


def edges(code: str | None, lang: str | None, least: float = 0.6) -> list[tuple[str, str, int, float]]:
    """(dst_sym, kind, line, confidence) of Rust, C and C++: calls, types and imports, each once with its best confidence.

    A name that the file defines has 1, one it imports 0.6, others 0.3; those below ``least`` go. An approximation
    by tokens: comments and strings are masked, then names before brackets and in places of types are read.
    """
    if lang not in ("rust", "c", "cpp") or not code:
        return []
    bare, defined = masked(code, lang), definitions(code, lang)
    own = {name.split("::")[-1] for name, _ in defined}
    heads = {at + len(name) - len(name.split("::")[-1]) for name, at in defined}
    imported = _imports(code, lang)
    found: dict[tuple[str, str], tuple[float, int]] = {}

    def add(name: str, kind: str, at: int) -> None:
        conf, line = (1.0 if name in own else 0.6 if name in imported else 0.3), bare.count("\n", 0, at) + 1
        if kind == "IMPORTS":
            conf = max(conf, 0.6)
        if conf >= least and (-conf, line) < (-found.get((name, kind), (0.0, 0))[0], found.get((name, kind), (0.0, 0))[1]):
            found[name, kind] = (conf, line)

    for m in _CALL.finditer(bare):
        before = bare[max(0, m.start() - 12) : m.start()].split()
        if m[1] not in KEYWORDS and m.start() not in heads and not m[2] and not (before and before[-1] in ("fn", "struct", "enum")):
            add(m[1], "CALLS", m.start())
    for m in _TYPE.finditer(bare):
        add(m[1], "USES_TYPE", m.start())
    for name in imported:
        add(name, "IMPORTS", max(0, code.find(name)))
    return sorted((f"sym:{n}", k, line, c) for (n, k), (c, line) in found.items())


def extract_edges(docs: DataFrame, id_col: str, code_col: str, lang_col: str, least: float = 0.6) -> DataFrame:
    """(id, dst_sym, edge_kind, src_line, confidence) of each document's code."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((i, *e) for p in parts for i, c, x in zip(p[id_col], p[code_col], p[lang_col], strict=True) for e in edges(c, x, least))
        return frames(rows, [id_col, "dst_sym", "edge_kind", "src_line", "confidence"])

    return docs.select(id_col, code_col, lang_col).mapInPandas(run, f"`{id_col}` {kind}, dst_sym string, edge_kind string, src_line int, confidence double")


def symbol_lists(code_col, lang_col):
    """UDF: the definitions in each text, as an array."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<string>")
    def run(code: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([symbols(c, x) for c, x in zip(code, lang, strict=True)], dtype=object)

    return run(code_col, lang_col)


def extract_symbols(docs: DataFrame, id_col: str, code_col: str, lang_col: str) -> DataFrame:
    """(id, symbol): every definition of each document."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((i, s) for p in parts for i, c, x in zip(p[id_col], p[code_col], p[lang_col], strict=True) for s in symbols(c, x))
        return frames(rows, [id_col, "symbol"])

    return docs.select(id_col, code_col, lang_col).mapInPandas(run, f"`{id_col}` {kind}, symbol string")
