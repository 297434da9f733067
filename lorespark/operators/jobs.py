"""The queue of documents that wait for consolidation, as projections and upserts of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators.tables import upsert

MAX_ATTEMPTS = 5


def enqueue(jobs: DataFrame, namespace: str, ids: DataFrame, now: float) -> DataFrame:
    """Queue documents (document_id); known ones start anew but keep when they were created."""
    new = ids.select(F.concat(F.lit(f"{namespace}:"), "document_id").alias("job_id"), F.lit(namespace).alias("namespace"), "document_id", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.lit(float(now)).alias("created_at"), F.lit(float(now)).alias("updated_at"))
    return upsert(jobs, new, ["job_id"], ["created_at"])


def claim(jobs: DataFrame, now: float, n: int = 1) -> DataFrame:
    """The oldest pending jobs as a worker takes them: running, one more attempt."""
    found = jobs.where("status = 'pending'").orderBy("created_at", "job_id").limit(n)
    return found.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "updated_at": F.lit(float(now))})


def fail(jobs: DataFrame, error: str, now: float, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Running jobs after an error: pending again, or failed after the last attempt."""
    status = F.when(F.col("attempts") >= most, "failed").otherwise("pending")
    return jobs.where("status = 'running'").withColumns({"status": status, "last_error": F.lit(error), "updated_at": F.lit(float(now))})


def requeue(jobs: DataFrame) -> DataFrame:
    """All jobs after a crash: what was running is pending."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))
