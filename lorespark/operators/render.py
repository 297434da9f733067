"""Results as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def place() -> Column:
    """path:first-last, or as much of it as is known."""
    return F.when(F.col("line_start").isNull(), F.col("path")).when(F.col("line_end").isNull(), F.concat("path", F.lit(":"), "line_start")).otherwise(F.concat("path", F.lit(":"), "line_start", F.lit("-"), "line_end"))


def _joined(text: Column, order: str, most: int) -> Column:
    """Texts in their order, blank lines between; callers bound the hits of a group by their limit."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return F.array_join(F.transform(F.slice(rows, 1, most), lambda x: x["t"]), "\n\n")


def hit_text(most: int = 100) -> Column:
    """Code hits (path, line_start, line_end, score, snippet) by rank."""
    return _joined(F.concat(place(), F.format_string("  (score %.2f)\n", F.bround("score", 2)), F.substring("snippet", 1, 400)), "rank", most)


def digest_text(most: int = 100) -> Column:
    """Tree hits (label, tree_key, score, body) by rank."""
    return _joined(F.concat(F.lit("["), F.coalesce("label", "tree_key"), F.format_string("]  (score %.2f)\n", F.bround("score", 2)), F.substring("body", 1, 600)), "rank", most)


def commit_text(most: int = 100) -> Column:
    """History hits (key, author, score, title) by rank."""
    return _joined(F.concat("key", F.lit("  by "), "author", F.format_string("  (score %.2f)\n", F.bround("score", 2)), "title"), "rank", most)


def trace_text(most: int = 1000) -> Column:
    """Graph hops by rank."""
    who = F.when(F.col("document_id") == "", F.concat("path", F.lit(" "), "sym")).otherwise(F.col("document_id"))
    return _joined(F.concat("path", F.lit("  "), "edge_kind", F.lit("  "), "sym", F.format_string("  conf=%.2f  depth=%d\n", F.bround("confidence", 2), F.col("depth")), who), "rank", most)
