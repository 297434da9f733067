"""Summary trees: fan-out of chunks into leaves, sealing of full buffers, digests and drill-down."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import paths, text, vectors
from lorespark.sources.shared import saved

BUFFER = ["namespace", "tree_kind", "tree_key"]


@dataclass(frozen=True)
class Gates:
    """When a buffer is full: tokens of leaves, nodes above them, age in seconds."""

    tokens: int = 50_000
    fanout: int = 10
    age: float = 604_800.0
    summary_chars: int = 20_000
    max_level: int = 32


def fan_out(docs: DataFrame, chunks: DataFrame, entities: DataFrame, consolidate_code: bool = False) -> DataFrame:
    """Leaves: prose goes to its author's, the global and each entity's tree; code to its folder's, the global and those of symbols and imports."""
    code = F.get_json_object("meta", "$.kind").eqNullSafe("file")
    held = entities.groupBy("namespace", "chunk_id").agg(F.array_sort(F.collect_set("entity_id")).alias("held"))
    about = docs.select("namespace", "document_id", "key", "author", code.alias("code"))
    counted = chunks.withColumn("token_count", text.approx_tokens(F.col("text")))
    rows = counted.join(about, ["namespace", "document_id"]).join(held, ["namespace", "chunk_id"], "left")
    if not consolidate_code:
        rows = rows.where(~F.col("code"))
    held = F.coalesce("held", F.array().cast("array<string>"))
    topics = F.when(F.col("code"), F.filter(held, lambda e: e.startswith("sym:") | e.startswith("import:"))).otherwise(held)
    tree = lambda kind, key: F.struct(F.lit(kind).alias("tree_kind"), key.alias("tree_key"))
    own = F.when(F.col("code"), tree("module", paths.dir_key(F.col("key")))).otherwise(tree("source", F.col("author")))
    every = F.concat(F.array(own, tree("global", F.lit("global"))), F.transform(topics, lambda e: tree("topic", e)))
    out = rows.select("namespace", F.explode(every).alias("t"), "chunk_id", F.col("document_id").alias("doc_id"), "text", "token_count", "created_at")
    return out.select("namespace", "t.tree_kind", "t.tree_key", F.lit(0).alias("level"), "chunk_id", "doc_id", F.col("text").alias("body"), "token_count", "created_at")


def seal_gate(nodes: DataFrame, now: float, gates: Gates = Gates()) -> DataFrame:
    """Buffers of unsealed nodes with their size and whether they are to be sealed."""
    found = nodes.where(~F.col("sealed")).groupBy(*BUFFER, "level").agg(F.sum("token_count").alias("tokens"), F.count(F.lit(1)).alias("nodes"), F.min("created_at").alias("oldest"))
    size = F.when(F.col("level") == 0, F.col("tokens") >= gates.tokens).otherwise(F.col("nodes") >= gates.fanout)
    return found.withColumn("seal", size | (F.col("oldest") <= now - gates.age))


def first_line(body: Column) -> Column:
    return F.trim(F.substring_index(F.replace(body, F.lit("\r"), F.lit("")), "\n", 1))


def summaries(children: DataFrame, by: list[str], kind: str = "tree_kind", max_chars: int = 20_000) -> DataFrame:
    """A parent's body and label from its children (seq, body, label), for each group in ``by``.

    Body: the children's first lines that aren't blank, each followed by "; ", cut at ``max_chars``; groups are
    sealed buffers, whose size the gates bound. Children with a column ``line`` bring that line, and their bodies
    aren't read. Label: first line of the body in trees of sources and modules, the
    children's labels in the global tree, none in topics.
    """
    line = F.col("line") if "line" in children.columns else F.substring(first_line(F.col("body")), 1, max_chars)
    parts = F.array_sort(F.collect_list(F.when(line != "", F.struct("seq", line.alias("line")))))
    labels = F.array_join(F.array_sort(F.collect_set("label")), " · ")
    out = children.groupBy(*by).agg(parts.alias("p"), labels.alias("l"), F.count(F.lit(1)).alias("children"))
    body = F.substring(F.array_join(F.transform("p", lambda x: F.concat(x["line"], F.lit("; "))), ""), 1, max_chars)
    out = out.withColumn("body", body)
    own = F.when(F.col(kind).isin("source", "module"), F.substring(F.substring_index("body", "\n", 1), 1, 80)).when((F.col(kind) == "global") & (F.col("l") != ""), F.col("l"))
    return out.withColumn("label", own).drop("p", "l")


#: A buffer and the state before a piece of it: tokens since the last seal, seals so far.
_KEY = ", ".join(f"{c} string" for c in BUFFER)
_EXIT = f"piece int, place long, {_KEY}, alone boolean, need long, total long, seals long"


def _runs(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Buffers of a sorted piece with the tokens of their rows, as they come: a buffer in several batches comes several times."""
    for p in parts:
        keys = p[BUFFER]
        first = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy()).tolist()
        tokens = p["token_count"].to_numpy(np.int64)
        for a, b in zip(first, [*first[1:], len(p)], strict=True):
            yield tuple(keys.iloc[a]), tokens[a:b]


def _walk(tokens: np.ndarray, budget: int, total: int, seals: int) -> tuple[np.ndarray, int, int]:
    """Seals before each row, and the state after the last, from a state before the first."""
    upto, at, out = np.cumsum(tokens), 0, np.empty(len(tokens), np.int64)
    base = -total
    while at < len(tokens):
        end = max(at, int(np.searchsorted(upto, base + budget)))
        out[at : end + 1] = seals
        if end == len(tokens):
            break
        seals, base, at = seals + 1, int(upto[end]), end + 1
    return out, (int(upto[-1]) if len(upto) else 0) - base, seals


def _exits(budget: int):
    """What each piece does to a buffer that began before it.

    A piece with several buffers ends in a state that doesn't depend on what came before: one row. A piece within one
    buffer does depend on it, but only through the row of its first seal: one row for each that can be it, that is
    up to the first one with the whole budget before it, and one (need null) for no seal at all. Numbers of the
    piece's rows are held, 8 bytes each.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, first, last, total, seals, held = None, None, None, 0, 0, []

        def note(p: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            nonlocal piece
            for x in p:
                if len(x):
                    piece = int(x["piece"].iloc[0])
                    yield x

        for key, tokens in _runs(note(parts)):
            first = first or key
            if key != last:
                last, total, seals = key, 0, 0
            if key == first:
                held.append(tokens)
            _, total, seals = _walk(tokens, budget, total, seals)
        if piece is None:
            return
        row = {"piece": piece, **dict(zip(BUFFER, last, strict=True)), "alone": first == last}
        if first != last:
            yield pd.DataFrame([{**row, "place": 0, "need": None, "total": total, "seals": seals}]).astype({"need": "Int64"})
            return
        upto = np.cumsum(np.concatenate(held))
        n = len(upto)
        heads = np.arange(min(n, int(np.searchsorted(upto, budget)) + 1))
        following = np.maximum(np.searchsorted(upto, upto + budget), np.arange(1, n + 1))
        at, count = heads.copy(), np.ones(len(heads), np.int64)
        while (more := following[at] < n).any():
            at[more] = following[at[more]]
            count[more] += 1
        out = pd.DataFrame({"place": heads, "need": pd.array(upto[heads], "Int64"), "total": upto[-1] - upto[at], "seals": count})
        none = pd.DataFrame({"place": [n], "need": pd.array([None], "Int64"), "total": [upto[-1]], "seals": [0]})
        yield pd.concat([out, none]).assign(**row)

    return run


def _entries(budget: int):
    """The state before each piece, from rows of ``_exits`` in order of (piece, place); one row is held at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, state, after = None, (None, 0, 0), None
        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                key = tuple(getattr(r, c) for c in BUFFER)
                if r.piece != piece:
                    state, after, piece = after or state, None, r.piece
                    out.append((piece, *(state[0] or [None] * len(BUFFER)), state[1], state[2]))
                if after is None:
                    total, seals = (state[1], state[2]) if state[0] == key else (0, 0)
                    if not r.alone:
                        after = (key, r.total, r.seals)
                    elif pd.isna(r.need):
                        after = (key, total + r.total, seals)
                    elif total + r.need >= budget:
                        after = (key, r.total, seals + r.seals)
            yield pd.DataFrame(out, columns=["piece", *(f"_{c}" for c in BUFFER), "_total", "_seals"])

    return run


def _fold(budget: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total, seals = None, 0, 0
        for p in parts:
            if not len(p):
                continue
            if last is None:
                r = p.iloc[0]
                last, total, seals = tuple(r[f"_{c}"] for c in BUFFER), int(r["_total"]), int(r["_seals"])
            groups = []
            for key, tokens in _runs(iter([p])):
                if key != last:
                    last, total, seals = key, 0, 0
                out, total, seals = _walk(tokens, budget, total, seals)
                groups.append(out)
            yield pd.DataFrame({**{c: p[c] for c in BUFFER}, "node_id": p["node_id"], "group": np.concatenate(groups)})

    return run


def leaf_groups(leaves: DataFrame, budget: int) -> DataFrame:
    """(buffer, node_id, group): how many seals of its buffer came before each leaf, in order of (seq, node_id).

    A buffer is sealed as soon as its tokens reach the budget, so a leaf's group depends on all before it. Leaves are
    dealt by ranges of (buffer, seq), so that a tree with most of them is spread; each piece tells what it does to a
    buffer that began before it, one task passes the state from piece to piece, and the pieces number their leaves
    from there. Only ids and numbers are dealt. Null token counts are 0, buffers' keys null or not.
    """
    light = leaves.select(*BUFFER, "seq", "node_id", F.coalesce(F.col("token_count").cast("long"), F.lit(0)).alias("token_count"))
    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*BUFFER, "seq", "node_id"]
    dealt = light.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("piece", F.spark_partition_id())
    dealt = saved(dealt.select("piece", *BUFFER, "node_id", "token_count"))
    exits = dealt.select("piece", *BUFFER, "token_count").mapInPandas(_exits(budget), _EXIT)
    one = exits.repartition(1).sortWithinPartitions("piece", "place")
    states = one.mapInPandas(_entries(budget), f"piece int, {', '.join(f'_{c} string' for c in BUFFER)}, _total long, _seals long")
    states = F.broadcast(saved(states))  # one row for each piece
    return dealt.join(states, "piece").mapInPandas(_fold(budget), f"{_KEY}, node_id string, group long")


def seal_cascade(leaves: DataFrame, gates: Gates = Gates(), now: float | None = None) -> DataFrame:
    """All nodes of the trees after these leaves (node_id, seq, body, label, token_count, doc_id) came in order of seq.

    A buffer of leaves is sealed as soon as its tokens reach the gate (``leaf_groups``). With ``now``, what is left of a buffer is sealed too if its oldest leaf (created_at) is
    older than the gates' age; parents are new, so age seals leaves only. Above, parents come one by one, so every ``fanout`` of them make a full buffer; their
    groups follow from their numbers.
    """
    budget = gates.tokens
    groups = leaf_groups(leaves, budget)
    # the line is cut before leaves are dealt, so that parents are made without shuffling bodies
    line = F.substring(first_line(F.col("body")), 1, gates.summary_chars)
    level = leaves.withColumns({"level": F.lit(0), "line": line}).join(groups, [*BUFFER, "node_id"])
    columns = [*BUFFER, "level", "node_id", "seq", "body", "label", "doc_id", "token_count", "group", "full"]
    w = Window.partitionBy(*BUFFER, "group")
    stale = F.lit(False) if now is None else F.min("created_at").over(w) <= now - gates.age
    level = level.withColumn("full", (F.sum("token_count").over(w) >= budget) | stale).select(*columns, "line")
    out, fold = None, summaries
    for depth in range(1, gates.max_level):
        nodes = level.select(*BUFFER, "level", "node_id", "seq", "body", "label", "doc_id", "token_count", F.col("full").alias("sealed"), F.when(F.col("full"), F.concat_ws("/", *BUFFER, F.lit(str(depth)), "group")).alias("parent_id"))
        out = nodes if out is None else out.unionByName(nodes)
        parents = fold(level.where("full"), [*BUFFER, "group"], max_chars=gates.summary_chars)
        parents = parents.select(*BUFFER, F.lit(depth).alias("level"), F.concat_ws("/", *BUFFER, F.lit(str(depth)), "group").alias("node_id"), F.col("group").alias("seq"), "body", "label", F.lit(None).cast("string").alias("doc_id"), text.approx_tokens(F.col("body")).alias("token_count"))
        parents = parents.withColumn("group", F.floor(F.col("seq") / gates.fanout)).withColumn("full", F.count(F.lit(1)).over(w) >= gates.fanout).select(*columns)
        parents = saved(parents)
        if parents.isEmpty():
            break
        level = parents
    return out


def top_nodes(nodes: DataFrame, namespace: str, kind: str = "global", key: str = "global") -> DataFrame:
    """A tree's nodes on its highest level."""
    own = nodes.where((F.col("namespace") == namespace) & (F.col("tree_kind") == kind) & (F.col("tree_key") == key))
    return own.join(F.broadcast(own.agg(F.max("level").alias("level"))), "level")  # one row


def children(nodes: DataFrame, edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Nodes under those parents (node_id)."""
    ids = edges.join(parents.select(F.col("node_id").alias("parent_id")), "parent_id").select(F.col("child_id").alias("node_id"))
    return nodes.join(ids, "node_id")


def latest_leaves(nodes: DataFrame, position: list[str]) -> DataFrame:
    """Of each document the newest leaf, of equal ones the first by position; nodes without a document all stay."""
    rest = [c for c in nodes.columns if c != "doc_id"]
    best = F.max_by(F.struct(*rest), F.struct("created_at", *(-F.col(c) for c in position)))
    kept = nodes.where("doc_id is not null").groupBy("doc_id").agg(best.alias("r")).select("doc_id", *(F.col(f"r.{c}").alias(c) for c in rest))
    return nodes.where("doc_id is null").unionByName(kept)


def drill_down(nodes: DataFrame, edges: DataFrame, namespace: str, vector: list[float] | None = None, kind: str = "global", key: str = "global", depth: int = 3, limit: int = 10) -> DataFrame:
    """From a tree's top down to ``depth`` levels below, with fresh leaves, the latest of each document, by similarity or in tree order."""
    reached = frontier = saved(top_nodes(nodes, namespace, kind, key).select("node_id", F.lit(0).alias("at")))
    for level in range(1, depth + 1):  # ids alone
        frontier = saved(children(nodes.select("node_id"), edges, frontier).withColumn("at", F.lit(level)))
        reached = reached.unionByName(frontier)
    score = F.lit(0.0) if vector is None else vectors.cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in vector)))
    light = nodes.select("node_id", "namespace", "tree_kind", "tree_key", "level", "seq", "sealed", "label", "doc_id", "created_at", score.alias("score"))
    found = light.join(reached, "node_id").select(*light.columns, "at")
    own = (F.col("namespace") == namespace) & (F.col("tree_kind") == kind) & (F.col("tree_key") == key)
    top = F.broadcast(nodes.where(own).agg(F.max("level").alias("top")))  # one row
    fresh = light.where(own & ~F.col("sealed") & (F.col("level") == 0)).crossJoin(top).where("top > 0").drop("top").withColumn("at", F.lit(depth + 1))
    found = latest_leaves(found.unionByName(fresh), ["at", "seq"])
    order = [F.desc("score"), "at", "seq", "node_id"]
    best = F.broadcast(found.orderBy(*order).limit(limit))  # at most ``limit`` rows: their bodies are fetched without a shuffle
    out = nodes.select("node_id", "body").join(best, "node_id").orderBy(*order)
    return out.select("node_id", "tree_kind", "tree_key", "level", "label", "body", "doc_id", "score")


def digest_corpus(docs: DataFrame, namespace: str, module: str | None = None, per_file: int = 1200, budget: int = 60_000, newest: int = 5000) -> DataFrame:
    """The files that a digest reads: in order of their keys, until the budget of bytes is reached. At most ``newest`` files are looked at, so the window is bounded."""
    found = docs.where((F.col("namespace") == namespace)).orderBy(F.desc("updated_at"), "document_id").limit(newest)
    found = found.where(F.get_json_object("meta", "$.kind") == "file")
    if module is not None:
        found = found.where(F.col("key").startswith(module.rstrip("/") + "/"))
    found = found.withColumn("piece", F.concat(F.lit("### "), "key", F.lit("\n"), F.substring("content", 1, per_file), F.lit("\n\n")))
    before = F.coalesce(F.sum(F.octet_length("piece")).over(Window.partitionBy("namespace").orderBy("key", "document_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("before", before).where(F.col("before") < budget).select("key", "piece", "before")


def key_list(docs: DataFrame, head: str, line: Column) -> DataFrame:
    """One text: the head, then a line for each document in order of keys. Callers bound the documents."""
    lines = F.array_sort(F.collect_list(F.struct("key", line.alias("line"))))
    return docs.agg(F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["line"]), "")).alias("body"))
