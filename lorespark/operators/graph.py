"""Bounded traversals of the call graph, one join for each level, whose narrow result is kept for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.sources.shared import saved

# Fixed value: no traversal goes deeper.
MAX_DEPTH = 4
HOP = ["path", "document_id", "sym", "edge_kind", "confidence", "depth"]


def _calls(edges: DataFrame, namespace: str) -> DataFrame:
    return edges.where((F.col("namespace") == namespace) & (F.col("edge_kind") == "CALLS")).select("src_doc_id", "dst_sym", "confidence")


def callers(docs: DataFrame, edges: DataFrame, entities: DataFrame, namespace: str, symbol: str, depth: int = 2, limit: int = 20) -> DataFrame:
    """Documents that call a symbol, or a symbol defined in such a document, each once at its least depth.

    Within a level documents stand in the order of their ids, and a document is reported with the smallest of the
    symbols that reach it there; the limit cuts that order.
    """
    symbol = symbol if symbol.startswith("sym:") else f"sym:{symbol}"
    calls = _calls(edges, namespace)
    defines = entities.where((F.col("namespace") == namespace) & F.col("entity_id").startswith("sym:")).select("document_id", F.col("entity_id").alias("sym")).distinct()
    frontier = edges.sparkSession.createDataFrame([(symbol,)], "sym string")
    seen = None
    for level in range(1, min(depth, MAX_DEPTH) + 1):
        reached = calls.join(frontier, calls["dst_sym"] == frontier["sym"])
        best = F.min_by(F.struct("sym", "confidence"), F.struct("sym", -F.col("confidence")))
        hop = reached.groupBy(F.col("src_doc_id").alias("document_id")).agg(best.alias("b")).select("document_id", "b.sym", "b.confidence", F.lit(level).alias("depth"))
        if seen is not None:
            hop = hop.join(seen.select("document_id"), "document_id", "left_anti")
        hop = saved(hop)
        seen = hop if seen is None else seen.unionByName(hop)
        if level < min(depth, MAX_DEPTH):
            frontier = defines.join(hop.select("document_id"), "document_id").select("sym").distinct()
    top = seen.orderBy("depth", "document_id").limit(limit)
    keys = docs.where(F.col("namespace") == namespace).select("document_id", "key")
    out = top.join(keys, "document_id", "left").withColumn("path", F.coalesce("key", "document_id"))
    return out.withColumn("edge_kind", F.lit("CALLS")).select(*HOP)


def callees(docs: DataFrame, edges: DataFrame, entities: DataFrame, namespace: str, path: str, depth: int = 2, limit: int = 20) -> DataFrame:
    """What a file calls. Symbols that no document defines are hops without a document, neither followed, made unique nor limited."""
    calls = _calls(edges, namespace)
    home = entities.where((F.col("namespace") == namespace) & F.col("entity_id").startswith("sym:")).groupBy(F.col("entity_id").alias("dst_sym")).agg(F.min("document_id").alias("dst"))
    own = docs.where(F.col("namespace") == namespace).select("document_id", "key")
    frontier = own.where(F.col("key") == path).select("document_id")
    seen, open_ends = frontier.select("document_id", F.lit(None).cast("string").alias("sym"), F.lit(None).cast("double").alias("confidence"), F.lit(0).alias("depth")), None
    for level in range(1, min(depth, MAX_DEPTH) + 1):
        out = calls.join(frontier, calls["src_doc_id"] == frontier["document_id"]).select("dst_sym", "confidence").join(home, "dst_sym", "left")
        loose = out.where("dst is null").select(F.col("dst_sym").alias("path"), F.lit("").alias("document_id"), F.col("dst_sym").alias("sym"), "confidence", F.lit(level).alias("depth"))
        open_ends = loose if open_ends is None else open_ends.unionByName(loose)
        best = F.min_by(F.struct("dst_sym", "confidence"), F.struct("dst_sym", -F.col("confidence")))
        hop = out.where("dst is not null").groupBy(F.col("dst").alias("document_id")).agg(best.alias("b")).select("document_id", F.col("b.dst_sym").alias("sym"), "b.confidence", F.lit(level).alias("depth"))
        hop = saved(hop.join(seen.select("document_id"), "document_id", "left_anti"))
        seen, frontier = seen.unionByName(hop), hop.select("document_id")
    top = seen.where("depth > 0").orderBy("depth", "document_id").limit(limit)
    found = top.join(own, "document_id", "left").select(F.coalesce("key", "document_id").alias("path"), "document_id", "sym", "confidence", "depth")
    return found.unionByName(open_ends).withColumn("edge_kind", F.lit("CALLS")).select(*HOP)


def trace(docs: DataFrame, edges: DataFrame, entities: DataFrame, namespace: str, symbol: str | None = None, path: str | None = None, direction: str = "callers", depth: int = 2, limit: int = 20) -> DataFrame:
    """Who calls a symbol, or with the direction "callees" what a file calls."""
    if direction == "callees":
        return callees(docs, edges, entities, namespace, path or "", depth, limit)
    return callers(docs, edges, entities, namespace, symbol or "", depth, limit)


def dedup_edges(edges: DataFrame, by: list[str]) -> DataFrame:
    """The most confident edge of each symbol and kind; ties go to the first line."""
    best = F.min_by(F.struct("confidence", "src_line"), F.struct(-F.col("confidence"), F.coalesce("src_line", F.lit(0))))
    return edges.groupBy(*by, "dst_sym", "edge_kind").agg(best.alias("b")).select(*by, "dst_sym", "edge_kind", "b.confidence", "b.src_line")


def confidence(name, local, imported):
    """1 for a name of the same file, 0.6 for an imported one, else 0.3."""
    return F.when(F.array_contains(local, name), 1.0).when(F.array_contains(imported, name), 0.6).otherwise(0.3)
