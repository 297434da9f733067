"""Documents into the knowledge base: chunks, entities, vectors, edges and queued jobs, committed together."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lorespark.functions import paths, text
from lorespark.functions.vectors import hash_vectors
from lorespark.operators import chunking, jobs, symbols, tables
from lorespark.sources.shared import small_batches


class Embedder(Protocol):
    """Texts to vectors; may raise for a batch or a text. ``signature`` names the model."""

    signature: str

    def embed(self, texts: list[str]) -> list[np.ndarray]: ...


class HashEmbedder:
    """Counts of words by hash: deterministic, needs no model."""

    def __init__(self, dim: int = 64) -> None:
        self.dim, self.signature = dim, f"hash:{dim}"

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        return hash_vectors(texts, self.dim)


class Fallback:
    """The first embedder, or where it fails the second, under the first one's signature."""

    def __init__(self, first: Embedder, second: Embedder) -> None:
        self.first, self.second, self.signature = first, second, first.signature

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        try:
            return self.first.embed(texts)
        except Exception:  # noqa: BLE001 - any failure of a service
            return self.second.embed(texts)


def embed_with_skips(embedder: Embedder, texts: list[str]) -> list[np.ndarray | None]:
    """Vectors of a batch; if it fails, of each text alone, null for those that fail."""
    try:
        return list(embedder.embed(texts))
    except Exception:  # noqa: BLE001 - any failure of a service
        out: list[np.ndarray | None] = []
        for t in texts:
            try:
                out.append(embedder.embed([t])[0])
            except Exception:  # noqa: BLE001
                out.append(None)
        return out


def embedding(embedder: Embedder, column: Column, batch: int = 64) -> Column:
    """A column of vectors, asked for in batches; null where a text's embedding failed."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            texts = [t or "" for t in p]
            yield pd.Series([v for i in range(0, len(texts), batch) for v in embed_with_skips(embedder, texts[i : i + batch])], dtype=object)

    return run(column)


def ingest(docs: DataFrame, embedder: Embedder, now: float) -> dict[str, DataFrame]:
    """Rows that documents (namespace, document_id, key, content, meta, …) bring to each table.

    Chunks whose embedding fails are left out; a document that loses all of its chunks has none.
    """
    small_batches(docs.sparkSession)
    code = F.get_json_object("meta", "$.kind").eqNullSafe("file")
    known = docs.withColumns({"_code": code, "_lang": paths.lang_for_path(F.col("key"))})
    found = chunking.chunk(known, "document_id", "content", "_code", "_lang")
    about = known.select("namespace", "document_id", "key", "_code", "_lang")
    chunks = found.join(about, "document_id").withColumn("chunk_id", F.concat_ws("#", "document_id", F.col("seq")))
    chunks = chunks.withColumn("embedding", embedding(embedder, F.col("text"))).where("embedding is not null")
    chunks = chunks.withColumns({"model_signature": F.lit(embedder.signature), "dim": F.size("embedding"), "created_at": F.lit(float(now))})
    found = F.when(F.col("_code"), F.array_sort(F.array_distinct(F.concat(text.code_entities(F.col("text")), F.coalesce("_defs", F.array().cast("array<string>")), F.array(F.concat(F.lit("path:"), "key")))))).otherwise(text.entities(F.col("text")))
    # names that the language's own rules find, beside those of the general pattern
    defined = symbols.symbol_lists(F.when(F.col("_code") & F.col("_lang").isNotNull(), F.col("text")), F.col("_lang"))
    entities = chunks.withColumn("_defs", defined).select("namespace", "chunk_id", "document_id", F.explode(found).alias("entity_id")).distinct()
    edges = symbols.extract_edges(known.where("_code"), "document_id", "content", "_lang").join(about, "document_id")
    edges = edges.select("namespace", F.col("document_id").alias("src_doc_id"), "dst_sym", F.lit(None).cast("string").alias("dst_doc_id"), "edge_kind", "src_line", "confidence")
    return {"docs": docs, "chunks": chunks.drop("_code", "_lang", "key", "seq"), "entities": entities, "edges": edges}


def commit(store: tables.Snapshots, new: dict[str, DataFrame], namespace: str, now: float) -> int:
    """Merge what ``ingest`` gave into a store's snapshot: all tables change, or none."""
    base = store.version()
    old = {k: store.read(k, base) for k in ("docs", "chunks", "entities", "edges", "jobs")}
    touched = new["docs"].select("namespace", "document_id")
    out = {"docs": new["docs"] if old["docs"] is None else tables.upsert(old["docs"], new["docs"], ["namespace", "key"], ["document_id", "created_at"])}
    for name, by in (("chunks", "document_id"), ("entities", "document_id"), ("edges", "src_doc_id")):
        gone = touched.withColumnRenamed("document_id", by)
        out[name] = new[name] if old[name] is None else old[name].join(gone, ["namespace", by], "left_anti").select(*old[name].columns).unionByName(new[name])
    empty = touched.sparkSession.createDataFrame([], "job_id string, namespace string, document_id string, status string, attempts int, last_error string, created_at double, updated_at double")
    out["jobs"] = jobs.enqueue(empty if old["jobs"] is None else old["jobs"], namespace, touched.select("document_id"), now)
    return store.commit(out, base)
