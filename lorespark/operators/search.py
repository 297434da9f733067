"""Retrieval: hybrid search over prose, code search with weights of rare terms, recency, baselines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions import paths, text, vectors
from lorespark.operators.tables import code_chunks, docs_with_entities


@dataclass(frozen=True)
class Weights:
    """Fixed values of the blends."""

    vector: float = 0.65
    keyword: float = 0.35
    graph: float = 0.55
    graph_vector: float = 0.30
    graph_keyword: float = 0.15
    code_keyword: float = 0.50
    definition_boost: float = 0.10
    rare_idf: float = 3.0


def _vector(query: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query))


def scored_chunks(chunks: DataFrame, entities: DataFrame, namespace: str, signature: str, query: str, vector: list[float], weights: Weights = Weights()) -> DataFrame:
    """Every chunk of the namespace and signature with its vector, keyword and graph parts and their blend."""
    counts = docs_with_entities(entities, namespace, text.entities_of(query))
    top = counts.agg(F.max("n").alias("top"))
    found = chunks.where((F.col("namespace") == namespace) & (F.col("model_signature") == signature)).select(
        "document_id", "chunk_id", vectors.cosine(F.col("embedding"), _vector(vector)).alias("vector"), text.overlap(query, F.col("text")).alias("keyword")
    )
    found = found.join(counts, "document_id", "left").crossJoin(F.broadcast(top))  # top is one row
    graph = F.when(F.col("top").isNull(), 0.0).otherwise(F.coalesce(F.col("n"), F.lit(0)) / F.col("top"))
    w = weights
    blend = F.when(F.col("top").isNull(), w.vector * F.col("vector") + w.keyword * F.col("keyword")).otherwise(
        w.graph * F.col("graph") + w.graph_vector * F.col("vector") + w.graph_keyword * F.col("keyword")
    )
    return found.withColumn("graph", graph).withColumn("score", blend).drop("n", "top")


def best_chunks(scored: DataFrame) -> DataFrame:
    """Each document's best chunk with its parts; ties go to the smallest chunk id."""
    best = F.min_by(F.struct("chunk_id", "score", "vector", "keyword", "graph"), F.struct(-F.col("score"), F.col("chunk_id")))
    return scored.groupBy("document_id").agg(best.alias("b")).select("document_id", "b.*")


def hybrid(docs: DataFrame, chunks: DataFrame, entities: DataFrame, namespace: str, signature: str, query: str, vector: list[float], limit: int = 10) -> DataFrame:
    """The documents with the best chunks; whole rows are read for the top ones only."""
    top = best_chunks(scored_chunks(chunks, entities, namespace, signature, query, vector)).orderBy(F.desc("score"), "document_id").limit(limit)
    return docs.where(F.col("namespace") == namespace).join(F.broadcast(top), "document_id")  # top has ``limit`` rows


def term_stats(candidates: DataFrame, terms: list[str]) -> DataFrame:
    """One row: n chunks, and df_i, the chunks that hold term i."""
    low = F.lower("text")
    return candidates.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.contains(low, F.lit(t))).alias(f"df_{i}") for i, t in enumerate(terms)))


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1))


def term_weights(stats: DataFrame, terms: list[str]) -> DataFrame:
    """(term, n, df, idf): a row for each term."""
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"df_{i}").alias("df")) for i, t in enumerate(terms))))
    return stats.select("n", rows.alias("t")).select("t.term", "n", "t.df", idf(F.col("n"), F.col("t.df")).alias("idf"))


def search_code(docs: DataFrame, chunks: DataFrame, entities: DataFrame, namespace: str, signature: str, query: str, vector: list[float], limit: int = 10, floor: float = 0.0, prior: bool = True, graph: bool = False, weights: Weights = Weights()) -> DataFrame:
    """Code chunks by vector and weighted terms, times the path's weight, plus a boost for definitions of rare symbols.

    With ``graph``, and if any document holds an entity that the query names, these counts join the blend.
    """
    found = code_chunks(chunks, docs, namespace).where(F.col("model_signature") == signature)
    terms, w = text.terms(query), weights
    low = F.lower("text")
    if terms:
        found = found.crossJoin(F.broadcast(term_stats(found, terms)))  # one row
        each = [idf(F.col("n"), F.col(f"df_{i}")) for i in range(len(terms))]
        total = sum(each, F.lit(0.0))
        hit = sum((F.when(F.contains(low, F.lit(t)), x).otherwise(0.0) for t, x in zip(terms, each, strict=True)), F.lit(0.0))
        keyword = F.when(total > 1e-6, hit / total).otherwise(text.overlap(query, F.col("text")))
    else:
        keyword = text.overlap(query, F.col("text"))
    boost = F.lit(0.0)
    symbols = [t for t in dict.fromkeys(text.identifiers(query)) if t.lower() in terms]
    if symbols:
        defined = entities.where((F.col("namespace") == namespace) & F.col("entity_id").isin([f"sym:{s}" for s in symbols]))
        defined = defined.groupBy("document_id").agg(F.collect_set("entity_id").alias("defines"))
        found = found.join(defined, "document_id", "left")
        for s in symbols:
            rare = (each[terms.index(s.lower())] >= w.rare_idf) & F.coalesce(F.array_contains("defines", f"sym:{s}"), F.lit(False))
            boost = F.greatest(boost, F.when(rare, w.definition_boost).otherwise(0.0))
    found = found.withColumn("vector", vectors.cosine(F.col("embedding"), _vector(vector))).withColumn("keyword", keyword)
    base = (1 - w.code_keyword) * F.col("vector") + w.code_keyword * F.col("keyword")
    if graph:
        named = [f"{kind}:{t}" for t in dict.fromkeys(text.identifiers(query)) for kind in ("sym", "import")]
        counts = docs_with_entities(entities, namespace, named)
        found = found.join(counts.withColumnRenamed("n", "_held"), "document_id", "left").crossJoin(F.broadcast(counts.agg(F.max("n").alias("_top"))))  # one row
        blend = w.graph * F.coalesce(F.col("_held"), F.lit(0)) / F.col("_top") + w.graph_vector * F.col("vector") + w.graph_keyword * F.col("keyword")
        base = F.when(F.col("_top").isNull(), base).otherwise(blend)
    found = found.withColumn("score", base * (paths.path_prior(F.col("key")) if prior else 1.0) + boost)
    out = found.select(F.col("key").alias("path"), "document_id", "chunk_id", "line_start", "line_end", F.col("text").alias("snippet"), "score", "vector", "keyword")
    if floor > 0:
        out = out.where(F.col("score") >= floor)
    return out.orderBy(F.desc("score"), "path", "chunk_id").limit(limit)


def freshness(updated_at: Column, now: float) -> Column:
    """1 for now, a half after a day."""
    hours = F.greatest(F.lit(0.0), (F.lit(float(now)) - updated_at) / 3600.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 / (1.0 + hours / 24.0)))


def recall(docs: DataFrame, namespace: str, now: float, limit: int = 10, newest: int = 1000) -> DataFrame:
    """The newest documents by freshness."""
    found = docs.where(F.col("namespace") == namespace).orderBy(F.desc("updated_at"), "document_id").limit(newest)
    return found.withColumn("score", freshness(F.col("updated_at"), now)).orderBy(F.desc("score"), "document_id").limit(limit)


# Words of a question that carry no meaning.
STOP_WORDS = frozenset("the a an is are was how where what which when who why do does to of in on for and or with that this it its as by from into be used use using get set new make handle".split())


def plain_terms(query: str) -> list[str]:
    """Identifier-like words of a question, three letters or more, without stop words."""
    return [t for t in text.re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", query) if t.lower() not in STOP_WORDS]


def grep(docs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Files by how many of their lines hold a term, with the first such line. Lines are counted inside each row."""
    wanted = [t.lower() for t in plain_terms(query)]
    held = F.filter(F.transform(F.split(F.lower("content"), "\n"), lambda x, i: F.when(sum((F.contains(x, F.lit(t)).cast("int") for t in wanted), F.lit(0)) > 0, i + 1)), lambda i: i.isNotNull())
    found = docs.select(F.col("key").alias("path"), held.alias("lines")).where(F.size("lines") > 0)
    out = found.groupBy("path").agg(F.sum(F.size("lines")).alias("n_lines"), F.min(F.array_min("lines")).alias("first_line"))
    return out.orderBy(F.desc("n_lines"), "path").limit(limit)


def by_filename(docs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Files by how many terms their path holds."""
    low = F.lower("key")
    score = sum((F.contains(low, F.lit(t.lower())).cast("int") for t in plain_terms(query)), F.lit(0))
    return docs.select(F.col("key").alias("path"), score.alias("score")).where("score > 0").orderBy(F.desc("score"), "path").limit(limit)
