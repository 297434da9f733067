"""Operator 2: main text of web pages by two-pass block rules."""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import small_batches

STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its
    just like more most my no not of on one only or other our out over said she so some than that the their them then there these they this to
    up was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ont ou par pas plus pour qu que
    qui sa se ses son sont sur un une vous à été être y
    aber als am an auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann
    man mit nach nicht noch nur oder sich sie sind so um und uns von vor war was wenn wie wir wird zu zum zur über
    al como con cual cuando de del desde donde el ella ellos en entre era es esta este ha hay la las le lo los más me mi muy no nos o para
    pero por que se ser si sin sobre son su sus también un una y ya
    """.split()
)
#: Whole elements that hold no text of a reader's.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
SKIP = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "svg", "canvas", "object", "dialog", "menu", "label", "fieldset", "head", "math", "audio", "video", "map"}
BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup",
    "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *SKIP,
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words in a class or id, or a role, that say what an element is for.
BAD_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|banner|breadcrumbs?|comments?|commentlist|respond|reply|replies|cookies?|consent|gdpr|disclaimer|dropdown|footer|foot|footnav|header|masthead|login|signin|signup|menu|menubar|modal|nav|navbar|navigation|newsletter|notices?|notification|alert|pager|pagination|popup|promo|promoted|related|recommended|share|sharing|shares|sidebar|side|skip|social|sponsor\w*|subscribe|subscription|tags?|toolbar|topbar|widget|complementary|contentinfo|search|disqus|legal|copyright|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
#: The same for article elements, which may stand for comments and teasers, as the start of a class.
BAD_ARTICLE = re.compile(r"(?:^|\s)(?:ads?|adverts?|advertis\w*|comments?|reply|replies|promo|promoted|related|recommended|sponsor\w*|teaser|widget)(?=$|[\s_-])", re.I)
GOOD_HINT = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body-?content|content|entry|main|post|story|text|blog|prose)(?=$|[\s_-])", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    linked: int
    scope: int  # 0: outside any article; else the article's number
    tag: str
    bad: bool
    good: bool
    label: str = ""
    words: list[str] = field(default_factory=list)
    stops: int = 0


def blocks(page: str) -> list[Block]:
    """Cut a page into blocks: text between block-level tags. Torn tags and missing ends are taken as browsers do, roughly."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool, str]] = []  # tag; bad, scope, good and block-level tag outside it
    at_block: list[int] = []  # places of block-level tags on the stack
    is_open: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0
    in_link = 0
    bad, scope, good, scopes = False, 0, False, 0
    tag_now = "body"

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            text = _SPACE.sub(" ", _html.unescape(raw)).strip()
            if text:
                out.append(Block(text, min(linked, len(text)), scope, tag_now, bad, good))
        parts, linked = [], 0

    def data(s: str) -> None:
        nonlocal linked
        if s:
            parts.append(s)
            if in_link:
                linked += len(_SPACE.sub(" ", s).strip())

    def leave(k: int) -> tuple[bool, int, bool, str]:
        """Close all from the k-th open tag on."""
        is_open.subtract(s[0] for s in stack[k:])
        before = stack[k][1:]
        del stack[k:]
        while at_block and at_block[-1] >= k:
            at_block.pop()
        return before

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            data(page[at:])
            break
        data(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            data(_html.escape(m[1]))
            continue
        if not m[3]:
            continue
        name, closing = m[3].lower(), bool(m[2])
        if name in RAW:
            if not closing:
                if name == "title":
                    flush()
                end = re.compile(rf"</{name}\s*>|</{name}(?=\s)[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name in VOID:
            if name in BLOCK:
                flush()
            elif name in ("img", "input", "wbr"):
                pass
            continue
        if closing:
            if name in BLOCK:
                flush()
                in_link = 0
            if is_open[name] > 0:
                k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                if any(s[1] != bad or s[2] != scope for s in stack[k:]):
                    flush()
                bad, scope, good, tag_now = leave(k)
            continue
        hints = ""
        role = ""
        hidden = False
        if m[4] and ("=" in m[4] or "hidden" in m[4]):
            for a in _ATTR.finditer(m[4]):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id"):
                    hints += " " + value
                elif key == "role":
                    role = value.lower()
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    hidden = True
        is_block = name in BLOCK
        worse = hidden or name in SKIP or role in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu") or bool(hints and (BAD_ARTICLE if name == "article" else BAD_HINT).search(hints) and name not in ("main", "body", "html"))
        if name == "header" and scope and not hints:  # an article's own head holds its heading
            worse = False
        if is_block or worse:
            flush()
            in_link = 0 if is_block else in_link
        inner = at_block[-1] if at_block else -1
        if name == "p" and inner >= 0 and stack[inner][0] == "p" or name in ("li", "dd", "dt", "tr", "td", "th", "option") and inner >= 0 and stack[inner][0] == name:
            bad, scope, good, tag_now = leave(inner)  # one that is open ends here
        elif is_block and any(s[0] == "p" for s in stack[-3:]):
            bad, scope, good, tag_now = leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"))
        if not m[4].rstrip().endswith("/") or is_block:
            if is_block:
                at_block.append(len(stack))
            stack.append((name, bad, scope, good, tag_now))
            is_open[name] += 1
        bad = bad or worse
        if (name in ("article", "main") or role in ("main", "article")) and not bad:
            if not scope:
                scopes += 1
                scope = scopes
            good = True
        elif is_block and hints and GOOD_HINT.search(hints) and not bad:
            good = True
        if is_block:
            tag_now = name
    flush()
    return out


def classify(
    found: list[Block], min_words: int = 10, long_words: int = 30, stop_low: float = 0.15, stop_high: float = 0.25, max_link: float = 0.3
) -> list[Block]:
    """Label blocks good or bad, in two passes.

    First pass, each block by itself: bad where its element says so (menus, notices, forms, ...), links hold over
    ``max_link`` of it, or a page with an article or main element (else with elements that are called content) has it
    outside; good where it is long and stop words are dense; headings and short blocks are undecided, and those of
    middling density are undecided but near good. Long blocks with next to no stop words are bad, or undecided within
    an article. A page in a language that the list doesn't know (English, French, German and Spanish are known) is
    judged by length and links alone.

    Second pass: undecided blocks inherit from the nearest decided neighbours within their own scope, the nearer of
    two that differ; within an article good wins, and where nothing of it is decided good, all that is undecided is.
    Headings take the label of what follows.
    """
    scoped = any(b.scope and not b.bad for b in found)
    hinted = not scoped and any(b.good and not b.bad for b in found)
    stops = total = 0
    for b in found:
        b.words = _WORD.findall(b.text.lower())
        b.stops = sum(w in STOP_WORDS for w in b.words)
        stops, total = stops + b.stops, total + len(b.words)
    known = stops >= 0.02 * total
    inside_ok: set[int] = set()  # scopes with a good block
    for b in found:
        n = len(b.words)
        stop = b.stops / n if n else 0.0
        link = b.linked / max(1, len(b.text))
        inside = b.scope > 0 if scoped else b.good if hinted else True
        if b.bad or not inside or (link > max_link and n > 0 and (b.tag != "p" or link > 0.8)):
            b.label = "bad"
        elif b.tag in HEADINGS:
            b.label = "heading"
        elif n < min_words:
            b.label = "short"
        elif not known or stop >= stop_high:
            b.label = "good" if n >= long_words or scoped or hinted else "near"
        elif stop >= stop_low:
            b.label = "good" if scoped or hinted else "near"
        else:
            b.label = "weak" if scoped or hinted else "bad"
        if b.label == "good":
            inside_ok.add(b.scope)
    n = len(found)
    prev: list[tuple[str, int]] = [("", 0)] * n
    nxt: list[tuple[str, int]] = [("", 0)] * n
    for order, into in ((range(n), prev), (range(n - 1, -1, -1), nxt)):
        seen: tuple[str, int] = ("", 0)
        scope = -1
        for i in order:
            b = found[i]
            if (scoped or hinted) and (b.bad or not (b.scope > 0 if scoped else b.good)):
                continue  # outside the article, or put into it: no neighbour of what is inside
            if b.scope != scope:
                seen, scope = ("", 0), b.scope
            into[i] = seen
            if b.label in ("good", "bad"):
                seen = (b.label, i)
    for i, b in enumerate(found):
        if b.label in ("good", "bad"):
            continue
        (p, pi), (q, qi) = prev[i], nxt[i]
        if (scoped or hinted) and b.scope not in inside_ok:
            b.label = "good"
        elif b.label == "heading" and q:
            b.label = q
        elif p and q and p != q:
            near = p if i - pi < qi - i else q if qi - i < i - pi else "good" if b.label == "near" else "bad"
            b.label = "good" if scoped or hinted else near
        elif p or q:
            b.label = (p or q) if b.label != "near" else "good" if "good" in (p, q) else "bad"
        else:
            b.label = "good" if scoped or hinted or b.label == "near" else "bad"
    return found


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by two line feeds; null and empty pages have an empty text."""
    return "\n\n".join(b.text for b in classify(blocks(page)) if b.label == "good") if page else ""


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keep..., text, n_chars): one row for each page, in one narrow pass. Nulls and torn markup give what text there is."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.col(html_col).cast("string")).mapInArrow(run, f"{kinds}{', ' if kinds else ''}text string, n_chars long")
