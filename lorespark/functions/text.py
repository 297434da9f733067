"""Text functions as Column expressions: tokens, terms, entities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character ranges that count as one token each.
CJK = "[一-鿿぀-ゟ゠-ヿ가-힯]"

# Patterns of entities in prose.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
URL = r"https?://[^\s]+"
HANDLE = r"(?:^|[^\w@])@(\w+)"
HASHTAG = r"(?:^|[^\w#])#(\w+)"

# Patterns of definitions and imports in code.
DEFINITION = r"(?m)^\s*(?:pub\s+)?(?:async\s+)?(?:fn|def|class|struct|enum|interface|trait|type|func)\s+([A-Za-z_][A-Za-z0-9_]*)"
IMPORT = r"""(?m)^\s*(?:use|import|from|require|include|using)\s+([^\s;(){}'"]+)"""


def estimate_tokens(text: Column) -> Column:
    """CJK characters count one token each, every four others one."""
    others = F.char_length(F.regexp_replace(text, CJK, ""))
    return (F.char_length(text) - others + F.ceil(others / 4)).cast("long")


def approx_tokens(text: Column) -> Column:
    """Tokens as summary trees count them: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("long")


def words(query: str) -> list[str]:
    """Lower-case white-space terms of a query, repeats kept."""
    return query.lower().split()


def terms(query: str) -> list[str]:
    """Distinct lower-case alphanumeric terms of three bytes or more, in order."""
    found = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    return [t for t in dict.fromkeys(found) if len(t.encode()) >= 3]


def terms_of(text: Column) -> Column:
    """``terms`` of a column."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: F.octet_length(t) >= 3))


def overlap(query: str, text: Column) -> Column:
    """Share of the query's white-space terms that the text holds, as substrings; 0 without terms."""
    low, found = F.lower(text), words(query)
    if not found:
        return F.lit(0.0)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in found), F.lit(0)) / F.lit(float(len(found)))


def overlap_of(query: Column, text: Column) -> Column:
    """``overlap`` where the query is a column too."""
    low, found = F.lower(text), F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    return F.when(F.size(found) == 0, 0.0).otherwise(F.size(F.filter(found, lambda w: F.contains(low, w))) / F.size(found))


def identifiers(query: str) -> list[str]:
    """Identifier-like tokens: letters, digits and underscores, three bytes or more, a letter first, case kept."""
    found = "".join(c if c.isalnum() or c == "_" else " " for c in query).split()
    return [t for t in found if len(t.encode()) >= 3 and t[0].isalpha()]


def code_entities_of_query(query: Column) -> Column:
    """Each identifier of a query as a symbol and as an import."""
    found = F.filter(F.split(query, r"[^\p{IsAlphabetic}\p{N}_]+"), lambda t: (F.octet_length(t) >= 3) & t.rlike(r"^\p{IsAlphabetic}"))
    return F.flatten(F.transform(found, lambda t: F.array(F.concat(F.lit("sym:"), t), F.concat(F.lit("import:"), t))))


def _all(text: Column, pattern: str, group: int, prefix: str, lower: bool) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group))
    return F.transform(found, lambda x: F.concat(F.lit(prefix), F.lower(x) if lower else x))


def entities(text: Column) -> Column:
    """E-mails, URLs, handles and hashtags, sorted and distinct; what stands in a URL is no handle or hashtag."""
    masked = F.regexp_replace(text, "(?U)" + URL, " ")
    parts = [_all(text, EMAIL, 0, "email:", True), _all(text, URL, 0, "url:", False), _all(masked, HANDLE, 1, "handle:", True), _all(masked, HASHTAG, 1, "hashtag:", True)]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def entities_of(query: str) -> list[str]:
    """``entities`` of a query on the driver."""
    masked = re.sub(URL, " ", query)
    out = {f"email:{m.lower()}" for m in re.findall(EMAIL, query)} | {f"url:{m}" for m in re.findall(URL, query)}
    out |= {f"handle:{m.lower()}" for m in re.findall(HANDLE, masked)} | {f"hashtag:{m.lower()}" for m in re.findall(HASHTAG, masked)}
    return sorted(out)


def code_entities(text: Column) -> Column:
    """Symbols that are defined and names that are imported, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.concat(_all(text, DEFINITION, 1, "sym:", False), _all(text, IMPORT, 1, "import:", False))))
