"""Documents about a namespace, kept in its ``:meta`` namespace: digests of the architecture and of modules, conventions."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions import paths
from lorespark.operators import tables, tree

# Bounds of what is read, and heads of the deterministic texts.
PER_FILE, BUDGET, FILES, CONFIGS, CONFIG_CHARS, LABEL_CHARS = 1200, 60_000, 5000, 1000, 1500, 120
DIGEST_HEAD = "Architecture digest (mechanical fallback — LLM unavailable):\n"
CONVENTIONS_HEAD = "Conventions (mechanical fallback — LLM unavailable):\n"


class Summarizer(Protocol):
    """A text in at most so many tokens; may raise, or answer with a blank."""

    def summarize(self, prompt: str, max_tokens: int) -> str: ...


def namespace_of(namespace: str) -> str:
    return f"{namespace}:meta"


def summary(summarizer: Summarizer | None, prompt: str, max_tokens: int, otherwise: str, audit: list[dict] | None = None) -> str:
    """The summarizer's text, or ``otherwise`` where there is none, it fails or its answer is blank. audit gets one entry."""
    status, body = "fallback", otherwise
    if summarizer is not None:
        try:
            status, answer = "ok", summarizer.summarize(prompt, max_tokens)
            body = answer if answer.strip() else otherwise
        except Exception:  # noqa: BLE001 - any failure of a service
            status = "error"
    if audit is not None:
        audit.append({"status": status, "prompt_chars": len(prompt), "answer_chars": len(body)})
    return body


def _document(docs: DataFrame, namespace: str, key: str, body: str, meta: dict, now: float) -> DataFrame:
    about = namespace_of(namespace)
    row = (f"{about}/{key}", about, key, key, body, "lorespark", "internal", float(now), float(now), json.dumps(meta))
    return docs.sparkSession.createDataFrame([row], "document_id string, namespace string, key string, title string, content string, author string, taint string, created_at double, updated_at double, meta string")


def rebuild_digest(docs: DataFrame, namespace: str, now: float, module: str | None = None, summarizer: Summarizer | None = None, max_tokens: int = 2000, audit: list[dict] | None = None) -> DataFrame:
    """One document for ``upsert``: a digest of the newest files, of a folder's with ``module``.

    The driver reads what the prompt holds: pieces up to BUDGET bytes, and the keys of at most FILES files.
    """
    module = module.rstrip("/") if module is not None else None
    pieces = tree.digest_corpus(docs, namespace, module, PER_FILE, BUDGET, FILES).orderBy("key").select("piece").collect()
    files = docs.where(F.col("namespace") == namespace).orderBy(F.desc("updated_at"), "document_id").limit(FILES).where(paths_of_files())
    if module is not None:
        files = files.where(F.col("key").startswith(f"{module}/"))
    keys = [r.key for r in files.select("key").orderBy("key").collect()]
    scope = f" of its folder {module}" if module else ""
    prompt = f"Describe the architecture of a software project{scope} for an engineer who will work on it: parts and their tasks, flow of data and control, invariants. Keep names. Use only these {len(keys)} files.\n" + "".join(r.piece for r in pieces)
    body = summary(summarizer, prompt, max_tokens, DIGEST_HEAD + "".join(f"- {k}\n" for k in keys), audit)
    return _document(docs, namespace, f"module:{module}" if module else "architecture", body, {"kind": "digest", "module": module}, now)


def paths_of_files():
    return F.get_json_object("meta", "$.kind").eqNullSafe("file")


def rebuild_conventions(docs: DataFrame, nodes: DataFrame, edges: DataFrame, namespace: str, now: float, summarizer: Summarizer | None = None, max_tokens: int = 2000, audit: list[dict] | None = None) -> DataFrame:
    """One document for ``upsert``: conventions from files of configuration and the labels of the tree's top."""
    newest = docs.where(F.col("namespace") == namespace).orderBy(F.desc("updated_at"), "document_id").limit(CONFIGS)
    configs = newest.where(paths.is_config_file(F.col("key"))).select("key", F.substring("content", 1, CONFIG_CHARS).alias("piece")).collect()
    top = tree.drill_down(nodes, edges, namespace, None, limit=12).select(F.coalesce("label", F.substring("body", 1, LABEL_CHARS)).alias("line")).collect()
    prompt = "List the conventions of a software project as bullets, each with its evidence, from these files and digests alone.\n"
    prompt += "".join(f"### {r.key}\n{r.piece}\n\n" for r in configs) + "".join(f"- {r.line}\n" for r in top)
    otherwise = CONVENTIONS_HEAD + "".join(f"- config present: {r.key} (evidence: {r.key})\n" for r in sorted(configs))
    return _document(docs, namespace, "conventions", summary(summarizer, prompt, max_tokens, otherwise, audit), {"kind": "conventions"}, now)


def upsert(docs: DataFrame, new: DataFrame) -> DataFrame:
    return tables.upsert(docs, new.select(*docs.columns), ["namespace", "key"], ["document_id", "created_at"])


def _digest(docs: DataFrame, namespace: str, key: str) -> DataFrame:
    found = docs.where((F.col("namespace") == namespace_of(namespace)) & (F.col("key") == key))
    return found.select(F.col("document_id").alias("node_id"), F.lit("digest").alias("tree_kind"), F.lit(key).alias("tree_key"), F.lit(0).alias("level"), F.lit(key).alias("label"), F.col("content").alias("body"), F.col("document_id").alias("doc_id"), F.lit(1.0).alias("score"))


def architecture(docs: DataFrame, nodes: DataFrame, edges: DataFrame, namespace: str, vector: list[float] | None = None, depth: int = 3, limit: int = 10) -> DataFrame:
    """The cached digest alone, or where there is none the drill-down of the global tree."""
    cached = _digest(docs, namespace, "architecture")
    return tree.drill_down(nodes, edges, namespace, vector, depth=depth, limit=limit) if cached.isEmpty() else cached


def module(docs: DataFrame, nodes: DataFrame, edges: DataFrame, namespace: str, path: str, vector: list[float] | None = None, depth: int = 3, limit: int = 10) -> DataFrame:
    """The same of one folder: its cached digest, or the drill-down of its tree."""
    cached = _digest(docs, namespace, f"module:{path.rstrip('/')}")
    return tree.drill_down(nodes, edges, namespace, vector, "module", path, depth, limit) if cached.isEmpty() else cached


def conventions(docs: DataFrame, namespace: str) -> DataFrame:
    """The conventions document, or no row."""
    return docs.where((F.col("namespace") == namespace_of(namespace)) & (F.col("key") == "conventions"))
