"""The cold path as a stream: new documents are ingested and fanned out batch by batch.

Processing time only, as the reference has no event time. A batch is a snapshot commit with its number in it, so a
batch that runs again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorespark.operators import ingest, tables, tree


def consolidate(store: tables.Snapshots, embedder: ingest.Embedder, now: float, code: bool = False):
    """For ``foreachBatch``: documents (as in memory_docs) go into the store, then their leaves take the place of those they had; sealing is a batch job over that table (``tree.seal_cascade``)."""

    def step(batch: DataFrame, number: int) -> None:
        done = store.read("batches")
        if done is not None and not done.where(F.col("number") == number).isEmpty():
            return
        fresh = tables.last_of(batch, ["namespace", "key"], ["updated_at", "document_id"])
        ingest.commit(store, ingest.ingest(fresh, embedder, now), "queue", now)
        touched = store.read("docs").join(fresh.select("namespace", "key"), ["namespace", "key"], "left_semi")
        ids = touched.select("namespace", "document_id")
        chunks, entities = (store.read(k).join(ids, ["namespace", "document_id"], "left_semi") for k in ("chunks", "entities"))
        leaves = tree.fan_out(touched, chunks, entities, code)
        leaves = leaves.withColumns({"node_id": F.concat_ws("/", "tree_kind", "tree_key", "chunk_id"), "seq": F.struct("created_at", "doc_id", "chunk_id"), "label": F.lit(None).cast("string")})
        mark = batch.sparkSession.createDataFrame([(number,)], "number long")
        old = store.read("leaves")
        leaves = leaves.drop("seq")
        if old is not None:  # leaves of other documents stay as they are
            leaves = old.join(ids.withColumnRenamed("document_id", "doc_id"), ["namespace", "doc_id"], "left_anti").select(*leaves.columns).unionByName(leaves)
        store.commit({"leaves": leaves, "batches": mark if done is None else done.unionByName(mark)})

    return step


def start(docs: DataFrame, store: tables.Snapshots, embedder: ingest.Embedder, checkpoint: str, now: float) -> StreamingQuery:
    """Run over all that is there, then stop."""
    return docs.writeStream.foreachBatch(consolidate(store, embedder, now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
