"""What the training-data operators share: scratch tables, row identities and connected components."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: whole texts go to Python, so batches are kept small.
ARROW_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode an own one where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lorespark-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless the user has set a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    ``save`` writes and rereads; ``drop`` deletes early. What is left goes when the driver ends, since a
    returned DataFrame may still read it.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self._end)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._scratch_path)

    def release(self) -> None:
        """Let Spark's cleaner remove shuffle files of finished steps."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _end(self) -> None:
        try:
            _delete(self.spark, self.base)
        except Exception:  # noqa: BLE001 - the session may be gone by now
            pass


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, rest): all other columns of docs in one struct, whatever their names are."""
    rest = F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != text_col))
    return docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"), rest.alias("rest"))


def unpack(packed: DataFrame, docs: DataFrame, text_col: str, *more) -> DataFrame:
    """The columns of docs again, in their order, from a packed frame, then ``more``."""
    return packed.select(*(F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns), *more)


def with_uid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unique: bool = True) -> DataFrame:
    """Add ``uid`` (long, not null): the order of documents as one number.

    Where ids are not null and unique (or needn't be) it is the id itself. Otherwise documents are numbered in the order of
    (id, null first; xxhash64 of the text); equal rows share a number.
    """
    kinds = [F.count(F.lit(1)), F.count(id_col), *[F.count_distinct(id_col)] * unique]
    if len(set(docs.agg(*kinds).first())) == 1:
        own = docs.withColumn("uid", F.col(id_col).cast("long"))
        own._uid_is_id = True
        return own
    tag = F.xxhash64(text_col)
    ranked = docs.select(F.col(id_col).cast("long").alias("_id"), tag.alias("_tag")).distinct().orderBy(F.col("_id").asc_nulls_first(), "_tag")
    numbers = docs.sparkSession.createDataFrame(ranked.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])), "_id long, _tag long, uid long")
    return docs.withColumn("_tag0", tag).join(numbers, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_tag0") == F.col("_tag"))).drop("_id", "_tag", "_tag0")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) of longs to (node, root): root is the smallest node that can be reached; roots have no row.

    Alternating large-star and small-star steps on pairs; every step is two aggregations and two joins whose
    skewed keys adaptive execution can split, and every result is written before the next step reads it.
    """
    a, b = F.col("a"), F.col("b")
    now = scratch.save(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(now)
    while before[0]:
        both = now.union(now.select(b.alias("a"), a.alias("b")))
        least = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = scratch.save(both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b), "large")
        least2 = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), "least2")
        j = large.join(least2, "a")
        small = j.select(b.alias("a"), F.col("m").alias("b")).union(least2.select("a", F.col("m").alias("b"))).where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
        nxt = scratch.save(small, "edges")
        scratch.drop(now, least, large, least2)
        after = mark(nxt)
        now, same = nxt, after == before
        before = after
        if same:
            break
    return now.select(a.alias("node"), b.alias("root"))
