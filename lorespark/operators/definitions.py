"""Names that source code defines, by language: from masked text, its brackets and what stands before them.

No grammar is at hand, so comments, strings and directives are blanked first; then words that open a definition are
read, and for methods and C-like functions the head before a brace (or, for declarations in Java, a semicolon).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

# Words before a bracket that are no names.
KEYWORDS = frozenset("if else for while match return loop switch sizeof fn struct enum impl trait pub let mut in as catch do static const function new throw delete typeof await yield synchronized try super this with alignof decltype assert when".split())
_TEXT = r'"""[\s\S]*?"""|"(?:\\[\s\S]|[^"\\\n])*"'
_MASKS = {
    "rust": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|r(#*)\"[\s\S]*?\"\1|\"(?:\\[\s\S]|[^\"\\])*\"|'(?:\\[^']+|[^'\\])'"),
    "c": re.compile(rf"//[^\n]*|/\*[\s\S]*?\*/|(?m:^)[ \t]*#(?:\\\n|[^\n])*|{_TEXT}|'(?:\\.|[^'\\\n])+'"),
    "script": re.compile(rf"//[^\n]*|/\*[\s\S]*?\*/|{_TEXT}|'(?:\\.|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`"),
}
_FAMILY = {"rust": "rust", "c": "c", "cpp": "c", "go": "script", "kotlin": "script", "java": "script", "javascript": "script", "typescript": "script", "tsx": "script"}
_START = r"(?:^|(?<=[;{}\n])|\b(?:export|default|declare|abstract|async)\b)[ \t]*"
_SCRIPT = [_START + r"function\s*\*?\s*([\w$]+)", _START + r"class\s+([\w$]+)"]
_TYPED = [*_SCRIPT, r"\binterface\s+([\w$]+)(?=\s*(?:[{<]|extends\b))", r"\benum\s+([\w$]+)(?=\s*\{)", _START + r"type\s+([\w$]+)\s*(?:<[^=;]*>)?\s*="]
_TAGGED = [r"\b(?:struct|union|enum)\b(?:\s+(?:class|struct)\b)?\s+((?:\w+::)*[A-Za-z_]\w*)"]
_NAMED = {
    lang: [re.compile(p, re.M) for p in ps]
    for lang, ps in {
        "rust": [r"\b(?:struct|enum|trait|mod)\s+(\w+)", r"\bunion\s+(\w+)\s*[{<]", r"\btype\s+(\w+)[^;{}]*=", r"\bmacro_rules!\s*(\w+)"],
        "go": [r"^func\s+(?:\([^)]*\)\s*)?(\w+)"],
        "kotlin": [r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>?*]+\.)?`?(\w+)`?\s*\(", r"(?<!::)\b(?:class|interface)\s+(\w+)", r"(?<!companion )\bobject\s+(\w+)"],
        "java": [r"\b(?:class|interface|enum)\s+(\w+)", r"\brecord\s+(\w+)\s*[<(]"],
        "javascript": _SCRIPT,
        "typescript": _TYPED,
        "tsx": _TYPED,
        "c": _TAGGED,
        "cpp": [*_TAGGED, r"(?<![<,])(?<![<,] )(?<!friend )(?<!enum )\bclass\s+((?:\w+::)*[A-Za-z_]\w*)", r"\bnamespace\s+([\w:]+)\s*\{"],
    }.items()
}
LANGUAGES = frozenset(_FAMILY)
_RUST_FN = re.compile(r"\bfn\s+(\w+)")
_HOLDER = re.compile(r"\b(?:class|struct|union|enum|interface|namespace|record|extern)\b[^()=]*(?:\([^()]*\)[^()=]*)?$")
_LAST = re.compile(r"((?:\w+\s*::\s*)*~?[A-Za-z_$#][\w$]*)\s*(?:<[^<>()]*>)?\s*$")


def parsed(code: str) -> ast.Module | None:
    """The syntax tree of Python code; None where it has none, or is too deep for the parser's stack (MemoryError)."""
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def masked(code: str, lang: str) -> str:
    """The code with comments, strings and directives blanked, every other character in its place."""
    return _MASKS[_FAMILY[lang]].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def _heads(bare: str) -> Iterator[tuple[str, int, str, str, str]]:
    """(head, its offset, what ends it, kind and name of the holder) for each brace and semicolon outside of brackets."""
    stack: list[tuple[str, str, int]] = [("top", "", 0)]
    start = depth = 0
    for m in re.finditer(r"[{}();]", bare):
        c = m[0]
        if c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif c == ";" and not depth:
            yield bare[start : m.start()], start, c, *stack[-1][:2]
            start = m.end()
        elif c == "{":
            head = bare[start : m.start()]
            yield head, start, c, *stack[-1][:2]
            named = re.search(r"\b(?:class|struct|interface|enum|record)\s+(\w+)", head)
            kind = "body" if _HOLDER.search(head) else "object" if re.search(r"(?:[=(,:?\[]|\breturn)\s*$", head) else "block"
            stack.append((kind, named[1] if named else "", depth))
            start, depth = m.end(), 0
        elif c == "}":
            if len(stack) > 1:
                depth = stack.pop()[2]
            start = m.end()


def _function(head: str, lang: str, holder: str) -> tuple[str, int] | None:
    """The name of the function that a head opens, and its place in the head."""
    text = re.sub(r"@\w[\w.]*(?:\s*\([^()]*\))?|\btemplate\s*<[^{}()]*?>(?=\s*[\w:~])|\b(?:public|private|protected)\s*:(?!:)", lambda m: " " * len(m[0]), head)
    at = text.find("(")
    before = text[:at]
    found = _LAST.search(before) if at > 0 else None
    if not found or "=" in before or "operator" in before or re.search(r"\b(?:function|return|new|throw|else|case|goto)\s", before):
        return None
    name, lead = re.sub(r"\s+", "", found[1]), before[: found.start(1)].strip()
    if name in KEYWORDS or name.startswith(("~", "#")) or lead.endswith((".", "->", "=>")):
        return None
    if lang == "java" and not lead and name != holder:  # no type before it, and no constructor
        return None
    return name, found.start(1)


def definitions(code: str, lang: str) -> list[tuple[str, int]]:
    """(name, offset) of each definition in code of one of LANGUAGES, nested ones too, in order of place."""
    bare = masked(code, lang)
    out = {(m.start(1), m[1]) for p in _NAMED[lang] for m in p.finditer(bare)}
    if lang == "rust":
        for m in _RUST_FN.finditer(bare):
            depth = 0
            for x in re.finditer(r"[\[\](){};]", bare[m.end() :]):
                depth += (x[0] in "[(") - (x[0] in "])")
                if not depth and x[0] in "{;":
                    if x[0] == "{":  # else a signature
                        out.add((m.start(1), m[1]))
                    break
    elif lang in ("c", "cpp", "java", "javascript", "typescript", "tsx"):
        places = {"c": ("top", "body"), "cpp": ("top", "body"), "java": ("body",)}.get(lang, ("body", "object"))
        for head, start, end, kind, holder in _heads(bare):
            if kind in places and (end == "{" or lang == "java") and not _HOLDER.search(re.sub(r"\btemplate\s*<[^{}()]*?>(?=\s*[\w:~])", "", head).split("(")[0]) and (f := _function(head, lang, holder)):
                out.add((start + f[1], f[0]))
    return [(name, at) for at, name in sorted(out) if name not in KEYWORDS]


# What opens a definition that has no name of its own to report.
_PLAIN = {
    "rust": re.compile(r"(?:unsafe\s+)?impl\b"),
    "go": re.compile(r"type\b"),
    "kotlin": re.compile(r"(?:\w+\s+)*(?:val|var)\s"),
    "c": re.compile(r"typedef\b|extern\s+\""),
    "cpp": re.compile(r"typedef\b|extern\s+\"|template\b"),
}


def top_spans(code: str, lang: str) -> list[tuple[int, int]] | None:
    """First and last line (from 1) of each definition on the top level; None where braces don't close."""
    bare = masked(code, lang)
    names = [at for _, at in definitions(code, lang)]
    ended = lang in ("rust", "c", "cpp", "java")  # statements end with a semicolon
    out: list[tuple[int, int]] = []
    start = braces = rounds = opened = 0

    def close(head_end: int, end: int) -> None:
        head = bare[start:head_end]
        lead = len(head) - len(head.lstrip())
        if lang == "rust":
            lead += len(re.match(r"(?:#!?\[[^\]]*\]\s*)*", head.lstrip())[0])
        inside = [at for at in names if start <= at < head_end]
        if inside or lang in _PLAIN and _PLAIN[lang].match(head[lead:]):
            at = start + lead if ended or not inside else bare.rfind("\n", 0, inside[-1]) + 1
            out.append((code.count("\n", 0, at) + 1, code.count("\n", 0, max(at, end - 1)) + 1))

    for m in re.finditer(r"[{}();]|\n(?=\S)", bare):
        c = m[0]
        if c in "()":
            rounds = max(0, rounds + (1 if c == "(" else -1))
        elif c == "{":
            if not braces:
                opened = m.start()
            braces += 1
        elif c == "}":
            braces -= 1
            if braces < 0:
                return None
            if not braces and not rounds:
                tail = re.match(r"[ \t]*(?:\w+[ \t]*)?;", bare[m.end() :]) if lang in ("c", "cpp") else None
                close(opened, m.end() + (tail.end() if tail else 0))
                start = m.end() + (tail.end() if tail else 0)
        elif not braces and not rounds and m.start() >= start and (c == ";" or not ended):
            close(m.start(), m.start() + (c == ";"))
            start = m.end()
    if braces:
        return None
    if bare[start:].strip() and not ended:
        close(len(bare), len(bare.rstrip()))
    return out
