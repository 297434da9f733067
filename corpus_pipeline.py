"""A training corpus in five stages: quality classifier, near-duplicates, decontamination, mixing, token tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and gives it to the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import decontaminate, mixing, quality, simhash, sstable
from lorespark.llm.common import Scratch, pack, unpack, with_uid


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go."""
    return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints stays."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item within its error budget go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, range-sorted by training position."""
    scratch = Scratch(spark, "mixing")
    # numbered by all columns, so that only rows equal in all of them share a number
    packed = with_uid(pack(docs, "doc_id", "text").withColumn("_all", F.struct("text", "rest")), text_col="_all")
    mixed = mixing.mix(packed.select(F.col("uid").alias("doc_id"), "text", F.col("rest.source").alias("source")))
    each = mixing.positions(mixed).select(F.col("doc_id").alias("uid"), "copy", "position")
    each = scratch.save(each, "copies")
    if not getattr(packed, "_uid_is_id", False):  # equal rows share a number; their copies are already one for each row
        packed = packed.dropDuplicates(["uid"])
    out = packed.join(each, "uid").repartitionByRange("position", "uid", "copy").sortWithinPartitions("position", "uid", "copy")
    return unpack(out, docs, "text")


def token_tables(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted-string-table shards, read back: doc_id, start, n_tokens, ids_crc32."""
    return sstable.token_table(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("token-ID / binary output", token_tables),
]

#: A fitted model and XXH64 fingerprints are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{i}")
        scratch.release()
    return docs
