"""Keyed tables: lookups, upserts, replacements, deletions, and snapshots that change several tables at once."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def newest(docs: DataFrame, namespace: str, limit: int) -> DataFrame:
    """The documents of a namespace that changed last; ties by id."""
    return docs.where(F.col("namespace") == namespace).orderBy(F.desc("updated_at"), "document_id").limit(limit)


def code_chunks(chunks: DataFrame, docs: DataFrame, namespace: str) -> DataFrame:
    """Chunks with lines, with the key of their document."""
    keys = docs.where(F.col("namespace") == namespace).select("document_id", "key")
    return chunks.where((F.col("namespace") == namespace) & F.col("line_start").isNotNull()).join(keys, "document_id")


def with_entities(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Chunks with their entities as a sorted array, empty where there are none."""
    found = entities.groupBy("namespace", "chunk_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))
    return chunks.join(found, ["namespace", "chunk_id"], "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def resolve_symbols(entities: DataFrame, namespace: str) -> DataFrame:
    """Each symbol's defining document; of several, the one with the smallest id."""
    found = entities.where((F.col("namespace") == namespace) & F.col("entity_id").startswith("sym:"))
    return found.groupBy("entity_id").agg(F.min("document_id").alias("document_id"))


def docs_with_entities(entities: DataFrame, namespace: str, ids: list[str]) -> DataFrame:
    """Documents with how many of the given entities they hold; none given, none found."""
    found = entities.where((F.col("namespace") == namespace) & F.col("entity_id").isin(ids) if ids else F.lit(False))
    return found.groupBy("document_id").agg(F.count_distinct("entity_id").alias("n"))


def last_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the last in this order. An aggregation with partial results, so a hot key is no problem."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of ``new`` (unique keys) replace or join those of ``old``; columns in ``keep`` stay as ``old`` has them."""
    was = old.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in keep), F.lit(True).alias("_was"))
    fresh = new.join(was, keys, "left")
    fresh = fresh.select(*(F.when(F.col("_was"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in old.columns))
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(fresh)


def replace(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """All rows of each group in ``new`` take the place of that group's rows in ``old``."""
    return old.join(new.select(*by).distinct(), by, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def add_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks join it, each key once."""
    fresh = new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return old.unionByName(fresh.select(*old.columns))


def forget(docs: DataFrame, chunks: DataFrame, entities: DataFrame, edges: DataFrame, leaves: DataFrame, jobs: DataFrame, namespace: str, key: str) -> dict[str, DataFrame]:
    """The six tables without one document and all that hangs on it; sealed tree nodes stay. Unknown keys change nothing."""
    gone = docs.where((F.col("namespace") == namespace) & (F.col("key") == key)).select(F.col("namespace").alias("_ns"), F.col("document_id").alias("_id"))

    def without(t: DataFrame, column: str, *also) -> DataFrame:
        cond = (t["namespace"] == gone["_ns"]) & (t[column] == gone["_id"])
        for x in also:
            cond = cond & x
        return t.join(gone, cond, "left_anti")

    return {
        "docs": without(docs, "document_id"), "chunks": without(chunks, "document_id"), "entities": without(entities, "document_id"),
        "edges": without(without(edges, "src_doc_id"), "dst_doc_id"), "leaves": without(leaves, "doc_id", ~leaves["sealed"], leaves["level"] == 0), "jobs": without(jobs, "document_id"),
    }


def append_leaves(nodes: DataFrame, leaves: DataFrame, order: list[str], slots: int = 64) -> DataFrame:
    """Leaves with the sequence numbers that follow those of their buffer (namespace, tree_kind, tree_key, level).

    ``order`` starts with a number. Its range is cut into slots of equal width; leaves are numbered within slots, and
    counts of earlier slots are added. So a buffer that holds most of the leaves is numbered by many tasks.
    """
    buffer = ["namespace", "tree_kind", "tree_key", "level"]
    first = F.col(order[0]).cast("double")
    span = leaves.agg(F.min(first).alias("_lo"), F.max(first).alias("_hi"))  # one row
    slot = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(slots - 1), F.floor((first - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * slots))).otherwise(0)
    parts = leaves.crossJoin(F.broadcast(span)).withColumn("_slot", slot.cast("int")).drop("_lo", "_hi")
    counts = parts.groupBy(*buffer, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*buffer).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*buffer, "_slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    last = nodes.groupBy(*buffer).agg(F.max("seq").alias("_last"))
    inner = F.row_number().over(Window.partitionBy(*buffer, "_slot").orderBy(*order)) - 1
    out = parts.withColumn("_in", inner).join(offsets, [*buffer, "_slot"]).join(last, buffer, "left")
    return out.withColumn("seq", F.coalesce("_last", F.lit(-1)) + 1 + F.col("_off") + F.col("_in")).drop("_slot", "_in", "_off", "_last")


class Snapshots:
    """Tables of one store as versions: a commit writes new versions of the changed tables, then one manifest file.

    Readers follow the manifest with the highest number, so they see all changed tables or none. Everything goes
    through Spark's own readers, writers and Hadoop's file system; a lost executor only repeats its tasks.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.base}/manifest"))

    def version(self) -> int:
        """The number of the newest commit, 0 before the first."""
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.base}/manifest"))]
        return max((int(n) for n in found if n.isdigit()), default=0)

    def manifest(self, at: int | None = None) -> dict[str, str]:
        at = self.version() if at is None else at
        return json.loads(self.spark.read.text(f"{self.base}/manifest/{at}", wholetext=True).first()[0]) if at else {}

    def read(self, name: str, at: int | None = None) -> DataFrame | None:
        """A table as of the newest commit, or of that number."""
        found = self.manifest(at).get(name)
        return None if found is None else self.spark.read.parquet(f"{self.base}/{found}")

    def commit(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """Write these tables and switch to them in one step.

        The new version follows ``base``, the one that the caller read (by default the newest now). If another writer
        has taken its number meanwhile, nothing changes and a RuntimeError says so: read again, and commit again. The
        manifest is written aside and renamed, which the file system refuses where the name is taken.
        """
        base = self.version() if base is None else base
        now, number = self.manifest(base), base + 1
        for name, df in tables.items():
            at = f"{name}/{number}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(f"{self.base}/{at}")
            now[name] = at
        draft, target = (self._path(f"{self.base}/manifest/{x}") for x in (f".draft-{uuid.uuid4().hex}", number))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.isUriPathAbsolute() and draft.toUri().getScheme() else self._fs.getUri(), self._conf).rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), options)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise RuntimeError(f"version {number} was committed by another writer") from e
            raise
        return number
