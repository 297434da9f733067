"""Texts to chunks: prose by paragraphs, code by lines and definitions.

Each chunk depends on where the one before ended, so a text is cut by one pass in Python, one Arrow batch at a time.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lorespark.operators.definitions import LANGUAGES, parsed, top_spans
from lorespark.sources.shared import frames, small_batches

# Limits of a chunk, and the characters that count one token each.
PROSE_CHARS, CODE_CHARS, CODE_TOKENS, SPLIT_LINES = 800, 1500, 480, 4
CJK_RANGES = ((0x4E00, 0x9FFF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7AF))
_CJK = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES) + "]")

# Fixed value: the pattern of a line that starts a definition.
STARTS = re.compile(r"^\s*(?:export\s+)?(?:pub\s+)?(?:default\s+)?(?:async\s+)?(?:fn|def|class|struct|enum|interface|trait|type|func)\s+[A-Za-z_]")


def prose_chunks(content: str | None) -> list[str]:
    """Paragraphs packed up to a limit of characters; longer ones are cut. Null and blank texts have none."""
    out, room = [], 0  # room: what the last chunk can still take, 0 if it is closed
    for para in (content or "").split("\n\n"):
        p = para.strip()
        if not p:
            continue
        if len(p) > PROSE_CHARS:
            out += [p[i : i + PROSE_CHARS] for i in range(0, len(p), PROSE_CHARS)]
            room = 0
        elif room and len(p) + 1 <= room:
            out[-1] += "\n" + p
            room -= len(p) + 1
        else:
            out.append(p)
            room = PROSE_CHARS - len(p)
    return out


def _lines(content: str) -> list[str]:
    lines = content.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


class _Tokens:
    """A running estimate: CJK characters count one token, every four others one."""

    def __init__(self) -> None:
        self.cjk = self.other = 0

    def add(self, cjk: int, other: int) -> None:
        self.cjk, self.other = self.cjk + cjk, self.other + other

    def total(self, cjk: int = 0, other: int = 0) -> int:
        return self.cjk + cjk - (-(self.other + other) // 4)


def code_chunks(content: str | None, split: bool = True) -> list[tuple[str, int, int]]:
    """(text, first line, last line): lines packed within limits of characters and tokens, a new chunk at a definition.

    One line stays whole, unless it has CJK characters and more tokens than a chunk takes: then its pieces are
    chunks of their own with the same line.
    """
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    size, count, first = 0, _Tokens(), 1

    def close(last: int) -> None:
        nonlocal held, size, count
        if held:
            out.append(("".join(held), first, last))
        held, size, count = [], 0, _Tokens()

    for no, line in enumerate(_lines(content or ""), 1):
        cjk = len(_CJK.findall(line))
        other = len(line) - cjk
        tokens = cjk - (-other // 4)
        if cjk and tokens > CODE_TOKENS:
            close(no - 1)
            start, piece = 0, _Tokens()
            for i, ch in enumerate(line):
                is_cjk = bool(_CJK.match(ch))
                piece.add(is_cjk, not is_cjk)
                if piece.total() >= CODE_TOKENS:
                    out.append((line[start : i + 1], no, no))
                    start, piece = i + 1, _Tokens()
            if start < len(line):
                out.append((line[start:], no, no))
            continue
        full = size + len(line) + 1 > CODE_CHARS or count.total() + tokens > CODE_TOKENS
        if held and (full or split and len(held) >= SPLIT_LINES and STARTS.match(line)):
            close(no - 1)
        if not held:
            first = no
        held.append(line + "\n")
        size += len(line) + 1
        count.add(cjk, other + 1)
    close(len(_lines(content or "")))
    return out


def _top_level(content: str, lang: str | None) -> list[tuple[int, int]] | None:
    """First and last lines of definitions on the top level; None where they can't be told."""
    if lang == "python":
        found = parsed(content)
        defs = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
        return found and [(min([n.lineno, *(d.lineno for d in n.decorator_list)]), n.end_lineno) for n in found.body if isinstance(n, defs)]
    return top_spans(content, lang) if lang in LANGUAGES else None


def _tokens(text: str) -> int:
    cjk = len(_CJK.findall(text))
    return cjk - (-(len(text) - cjk) // 4)


def syntax_chunks(content: str | None, lang: str | None, pack: bool = False, budget: int = CODE_TOKENS) -> list[tuple[str, int, int]]:
    """Chunks by definitions on the top level, gaps between them too; by lines where the language or its syntax is unknown.

    Python is parsed, other languages are cut where the braces of a definition close. With ``pack``, for C and C++,
    neighbours are joined up to the budget of tokens.
    """
    found = _top_level(content or "", lang)
    if found is None:
        return code_chunks(content)
    lines, out, at = _lines(content or ""), [], 1
    spans: list[tuple[int, int]] = []
    for a, b in found:
        a, b = max(a, at), min(b, len(lines))
        if a > b:
            continue
        spans += [(at, a - 1)] * (a > at) + [(a, b)]
        at = b + 1
    spans += [(at, len(lines))] * (at <= len(lines))
    if pack and lang in ("c", "cpp"):
        joined: list[tuple[int, int]] = []
        room = 0
        for a, b in spans:
            n = _tokens("\n".join(lines[a - 1 : b]))
            if joined and n <= room:
                joined[-1] = (joined[-1][0], b)
                room -= n
            else:
                joined.append((a, b))
                room = max(0, budget - n)
        spans = joined
    for a, b in spans:
        text = "\n".join(lines[a - 1 : b])
        if text.strip():
            out += [(text, a, b)] if _tokens(text) <= budget else [(t, x + a - 1, y + a - 1) for t, x, y in code_chunks(text, False)]
    return out


def chunk(docs: DataFrame, id_col: str = "document_id", text_col: str = "content", kind_col: str | None = None, lang_col: str | None = None) -> DataFrame:
    """(id, seq, text, line_start, line_end): chunks of each document; with ``kind_col`` true it is code, else prose."""
    cols = [id_col, text_col, *([kind_col] if kind_col else []), *([lang_col] if lang_col else [])]
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for p in parts:
            for r in p.itertuples(index=False, name=None):
                row = dict(zip(cols, r, strict=True))
                if kind_col and row[kind_col]:
                    found = syntax_chunks(row[text_col], row[lang_col]) if lang_col else code_chunks(row[text_col])
                else:
                    found = [(t, None, None) for t in prose_chunks(row[text_col])]
                for i, x in enumerate(found):
                    yield (row[id_col], i, *x)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in frames(rows(parts), [id_col, "seq", "text", "line_start", "line_end"], text=2):
            yield out.astype({"line_start": "Int32", "line_end": "Int32"})

    return docs.select(*cols).mapInPandas(run, f"`{id_col}` {kind}, seq int, text string, line_start int, line_end int")
