"""Version control as a source: log records, diff lines, files, and changes applied to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import paths
from lorespark.operators.tables import last_of, upsert

# What separates records, fields and file lists in the log's format.
RECORD, FIELD, HEADER_END = "\x01", "\x1f", "\x1e"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_log(logs: DataFrame, column: str = "log") -> DataFrame:
    """Commits of log texts: sha, author, email, timestamp, subject, body, files; torn records are left out."""
    rec = logs.select(F.explode(F.split(column, RECORD)).alias("r")).where(F.contains("r", F.lit(HEADER_END)))
    at = F.locate(HEADER_END, F.col("r"))
    rec = rec.select(F.split(F.substring("r", F.lit(1), at - 1), FIELD).alias("f"), F.substring(F.col("r"), at + 1, F.length("r")).alias("files")).where("size(f) >= 6")
    files = F.filter(F.transform(F.split("files", "\n"), _strip), lambda x: x != "")
    names = ["sha", "author", "email", "timestamp", "subject", "body"]
    cut = [_strip(F.col("f")[i]) for i in range(6)]
    cut[3] = F.coalesce(cut[3].try_cast("long"), F.lit(0).cast("long"))
    return rec.select(*(c.alias(n) for c, n in zip(cut, names, strict=True)), files.alias("files"))


def commit_docs(commits: DataFrame) -> DataFrame:
    """Commits as documents: key, title, content, meta."""
    key = F.concat(F.lit("commit:"), "sha")
    title = F.when(F.col("subject") == "", key).otherwise(F.substring("subject", 1, 72))
    content = F.concat("subject", F.when(F.col("body") != "", F.concat(F.lit("\n\n"), "body")).otherwise(""), F.when(F.size("files") > 0, F.concat(F.lit("\n\nChanged files:\n"), F.array_join("files", "\n"))).otherwise(""))
    meta = F.to_json(F.struct(F.lit("commit").alias("kind"), "sha", F.col("timestamp").alias("ts"), "files"))
    return commits.select(key.alias("key"), title.alias("title"), content.alias("content"), F.col("author"), meta.alias("meta"))


def parse_diff(lines: DataFrame, column: str = "line") -> DataFrame:
    """Diff lines as (op, old, new): added, modified, deleted, renamed, copied; all else is left out."""
    # explode and inline keep the optimizer from copying the fields' expression into each of its many uses
    cut = lines.select(F.explode(F.array(F.split(F.regexp_replace(column, r"\r?\n?$", ""), "\t", 3))).alias("f"))
    n, s, one, two = F.size("f"), F.get("f", F.lit(0)), F.get("f", F.lit(1)), F.get("f", F.lit(2))
    simple = F.when(s == "A", "added").when(s == "M", "modified").when(s == "D", "deleted")
    op = F.when(n == 2, simple).when((n == 3) & s.startswith("R"), "renamed").when((n == 3) & s.startswith("C"), "copied")
    old = F.when(((n == 2) & (s == "D")) | ((n == 3) & s.startswith("R")), one)
    new = F.when((n == 2) & s.isin("A", "M"), one).when((n == 3) & F.substring(s, 1, 1).isin("R", "C"), two)
    return cut.select(F.inline(F.array(F.struct(op.alias("op"), old.alias("old"), new.alias("new"))))).where("op is not null")


def apply_diff(docs: DataFrame, changes: DataFrame, contents: DataFrame, namespace: str) -> DataFrame:
    """Documents (namespace, key, content, n_bytes) after changes: old paths go, new ones that may be indexed come or are replaced.

    A file that is no longer indexed but was is not deleted, as nothing says it went.
    """
    gone = changes.where("old is not null").select(F.col("old").alias("key")).distinct().withColumn("namespace", F.lit(namespace))
    come = changes.where("new is not null").select(F.col("new").alias("key")).distinct()
    fresh = contents.join(come, "key", "left_semi").where(paths.should_index(F.col("key"), F.col("n_bytes")))
    fresh = fresh.select(F.lit(namespace).alias("namespace"), "key", "content", "n_bytes")
    return upsert(docs.join(gone, ["namespace", "key"], "left_anti"), last_of(fresh, ["namespace", "key"], ["content"]), ["namespace", "key"])


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files under a folder: path, n_bytes, content, indexable; content is null where the bytes are no UTF-8 or too many."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    size = F.col("length")
    # both filters are decided from the listing: only files that may be indexed are opened
    small = found.where(size <= paths.MAX_BYTES).select("path", "length", F.col("content").cast("string").alias("content"))
    large = found.where(size > paths.MAX_BYTES).select("path", "length", F.lit(None).cast("string").alias("content"))
    text = F.when(F.is_valid_utf8("content"), F.col("content"))
    ok = paths.should_index(F.col("path"), size)
    return small.unionByName(large).select("path", size.alias("n_bytes"), F.when(ok, text).alias("content"), (ok & text.isNotNull()).alias("indexable"))


def read_marker(spark: SparkSession, path: str) -> str | None:
    """The revision that was read last, from its marker file; None before the first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return (spark.read.text(path, wholetext=True).first() or ("",))[0].strip() or None


def write_marker(spark: SparkSession, path: str, revision: str) -> None:
    """Replace the marker, after all that belongs to the revision is committed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(revision.encode()))
    out.close()
