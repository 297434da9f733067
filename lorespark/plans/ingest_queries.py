"""Queries of ingestion: chunkers, symbols, vectors, stores. SQL can't express most of them; tests hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.functions import paths, vectors
from lorespark.operators import chunking, ingest, symbols, tables
from lorespark.plans.base import NOW, query
from lorespark.sources import vcs
from lorespark.sources.shared import shared_dir


def _digest(c):
    return F.md5(F.col(c).cast("binary")).alias("digest")


@query()
def chunk_prose(t):
    return chunking.chunk(t.memory_docs).select("document_id", "seq", F.length("text").alias("n_chars"), _digest("text"))


@query()
def chunk_code(t):
    return chunking.chunk(t.memory_docs.withColumn("code", F.lit(True)), kind_col="code").select("document_id", "seq", "line_start", "line_end", _digest("text"))


def _code(t):
    return t.snippets.select("doc_id", "code", F.element_at(F.array(*map(F.lit, ["rust", "python", "typescript", "cpp"])), (F.col("doc_id") % 4 + 1).cast("int")).alias("lang"), F.lit(True).alias("is_code"))


@query()
def chunk_code_ast(t):
    return chunking.chunk(_code(t), "doc_id", "code", "is_code", "lang").select("doc_id", "seq", "line_start", "line_end", _digest("text"))


@query()
def extract_symbols(t):
    return symbols.extract_symbols(_code(t), "doc_id", "code", "lang")


@query()
def extract_edges(t):
    return symbols.extract_edges(_code(t), "doc_id", "code", "lang", least=0.3)


@query()
def hash_embed(t):
    return t.documents.select("doc_id", vectors.hash_embed(64)(F.col("text")).alias("embedding"))


@query("select vec_id, true as kept, len(embedding) as dim from embeddings")
def vec_roundtrip(t):
    back = vectors.vector_from_bytes(vectors.vector_to_bytes(F.col("embedding")))
    return t.embeddings.withColumn("back", back).select("vec_id", (F.col("back") == F.col("embedding")).alias("kept"), F.size("back").cast("long").alias("dim"))


@query("select page_id, list_reduce(list_transform(range(octet_length(encode(url))), lambda i: ('0x' || substr(hex(encode(url)), 2 * i + 1, 2))::hugeint), lambda h, x: (xor(h, x) * 1099511628211::hugeint) % 18446744073709551616::hugeint, 14695981039346656037::hugeint)::varchar as hash from pages")
def fnv1a(t):
    return t.pages.select("page_id", vectors.fnv1a_text(F.col("url")).alias("hash"))


class _Flaky(ingest.HashEmbedder):
    """Fails for batches with a text of an odd length that starts with E, and for those texts."""

    def embed(self, texts):
        if any(t.startswith("E") and len(t) % 2 for t in texts):
            raise RuntimeError("refused")
        return super().embed(texts)


@query("select doc_id from documents where not (text like 'E%' and length(text) % 2 = 1)")
def embed_skip(t):
    return t.documents.withColumn("v", ingest.embedding(_Flaky(), F.col("text"))).where("v is not null").select("doc_id")


@query()
def ingest_counts(t):
    out = ingest.ingest(t.memory_docs, ingest.HashEmbedder(), NOW)
    parts = [out[k].groupBy("namespace").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(k)) for k in ("docs", "chunks", "entities", "edges")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _store(t, name: str) -> tables.Snapshots:
    from uuid import uuid4

    return tables.Snapshots(t.spark, f"{shared_dir(t.spark)}/{name}-{uuid4().hex[:12]}")


@query()
def commit_ingest(t):
    """Two commits, the second over part of the documents; the rows of each table after both."""
    store, docs = _store(t, "store"), t.memory_docs
    ingest.commit(store, ingest.ingest(docs, ingest.HashEmbedder(), NOW), "repo", NOW)
    again = docs.where(F.col("document_id").endswith("7")).withColumn("content", F.concat("content", F.lit("\n\nmore @you")))
    ingest.commit(store, ingest.ingest(again, ingest.HashEmbedder(), NOW + 60), "repo", NOW + 60)
    parts = [store.read(k).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(k)) for k in ("docs", "chunks", "entities", "edges", "jobs")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("select key, 'x' as app, case when status = 'failed' then 'error' else 'ok' end as status from jobs, (select job_id as key) k")
def audit_rows(t):
    from lorespark.streaming.audit import audited

    return audited(t.jobs, "x").select(F.col("job_id").alias("key"), "app", "status")


@query("""with h as (select document_id, list_transform(range(octet_length(encode(key))), lambda i: substr(hex(encode(key)), 2 * i + 1, 2)) as bytes from memory_docs)
  select document_id, array_to_string(list_transform(bytes, lambda b: case when b between '30' and '39' or b between '41' and '5A' or b between '61' and '7A' then chr(('0x' || b)::int) else '%' || b end), '') as url from h""")
def by_key_url(t):
    return t.memory_docs.select("document_id", vectors.url_key(F.col("key")).alias("url"))


@query()
def source_files(t):
    """The files of the folder itself."""
    found = vcs.source_files(t.spark, t.sf_dir)
    return found.select(F.substring_index("path", "/", -1).alias("name"), "n_bytes", "indexable", paths.lang_for_path(F.col("path")).alias("lang"))
