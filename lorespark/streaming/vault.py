"""Documents mirrored as Markdown files: only those whose body changed are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(c):
    """A value between double quotes, with quotes and backslashes escaped."""
    body = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), body, F.lit('"'))


def changed(docs: DataFrame, before: DataFrame) -> DataFrame:
    """Documents whose digest isn't the one that ``before`` (key, digest) has, with slug, digest and the file's text."""
    now = docs.withColumn("digest", F.sha2("content", 256)).join(before.select("key", "digest"), ["key", "digest"], "left_anti")
    head = F.concat(F.lit("---\nkey: "), quoted(F.col("key")), F.lit("\ntitle: "), quoted(F.col("title")), F.lit("\n---\n"), F.col("content"))
    return now.withColumn("slug", F.regexp_replace("key", "[^A-Za-z0-9]", "_")).withColumn("file", head)


def write(files: DataFrame, folder: str) -> None:
    """One text file for each slug, through Spark's writer: folder/slug=<slug>/part-*.txt."""
    files.select("slug", F.col("file").alias("value")).write.mode("append").partitionBy("slug").text(folder)
