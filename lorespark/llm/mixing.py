"""Operator 6: mix sources to target weights by a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: No source is read over this often.
MAX_EPOCHS = 3


def word_count(text: str | Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, cap: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) to the same with ``target``: shares of all sizes by weight, none above cap
    times its source, what is over dealt again by weight.

    With cap * size / weight ascending, the first k sources are capped, where k is the least for which the level
    (what is left over the weights left) is within the next source's bound: two running sums, no loop.
    """
    bound = (cap * F.col("source_size")) / F.col("weight")
    order = [bound.asc(), F.col("rank").asc()]
    ahead = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    s = sources.withColumn("_level", (F.sum("source_size").over(every) - cap * before("source_size")) / (F.sum("weight").over(every) - before("weight")))
    s = s.withColumn("_bound", bound)
    level = F.min(F.when(F.col("_level") <= F.col("_bound"), F.struct(F.col("_bound"), F.col("rank"), F.col("_level").alias("level")))).over(every)
    s = s.withColumn("_at", level)
    return s.withColumn("target", F.least(F.col("weight") * F.col("_at.level"), (cap * F.col("source_size")).cast("double"))).drop("_level", "_bound", "_at")


def weigh(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, size, order): all that the mix needs of a document; order is 60 bits of a hash of id and text that
    other engines know too."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(text)))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("_o"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cycle: tuple[int, ...] = (1, 2, 3), ramp: float = 0.5) -> DataFrame:
    """One row for each document: id, source, size, source_size, target, copies, taken, position.

    Sources in code point order (null last) weigh ``cycle`` repeated. Each source's documents stand in the order
    of a hash of id and text; its words, read over and over, are taken up to its target, the last document only if
    over half of it lies below the target. So copies differ by 1 within a source and none is over MAX_EPOCHS.

    A source's weight over the training time t in 0..1 is ``1 + r * (2 t - 1)``, r = ramp, 0 or -ramp by the
    source's place in the cycle: it starts low and ends high, or the other way, or stays. Its demand up to t is
    the integral ``target * ((1 - r) t + r t^2)``; inverted at the middle of a document's first copy that gives
    ``position`` (null where no copy is taken). ``positions`` has all copies.

    Running sums are taken in two steps: over buckets of the hash, as many as the square root of a source's documents,
    then within a bucket, which holds about as many; so no source meets in one task. Null and repeated ids are spread
    by their texts. Ties: rows equal in id and text are alike. Null or empty texts have size 0, are never taken, and
    cost nothing. One row for each source is ranked in one task. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    base = scratch.save(weigh(docs, id_col, source_col, text_col), "sizes")
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = sums.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))))
    ranked = ranked.withColumn("place", F.pmod(F.col("rank") - 1, F.lit(len(cycle)))).withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), F.col("place") + 1))
    targets = scratch.save(source_targets(ranked).withColumn("buckets", F.ceil(F.sqrt("n"))), "targets")
    same = base["source"].eqNullSafe(targets["source"])
    placed = base.join(targets.drop("n"), same).drop(targets["source"]).withColumn("_b", F.pmod("_o", F.col("buckets")))
    by_bucket = scratch.save(placed.groupBy("rank", "_b").agg(F.sum("size").alias("_s")), "buckets")
    ahead = W.partitionBy("rank").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = scratch.save(by_bucket.select("rank", "_b", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_start")), "starts")
    within = W.partitionBy("rank", "_b").orderBy("_o", F.col("id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    out = placed.join(starts, ["rank", "_b"]).withColumn("before", F.col("_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    left = F.col("target") - F.col("before") - F.col("size") / 2
    copies = F.when((F.col("size") > 0) & (left >= 0), F.least(F.lit(MAX_EPOCHS), F.floor(left / F.col("source_size")) + 1)).otherwise(0).cast("long")
    r = F.element_at(F.array(F.lit(ramp), F.lit(0.0), F.lit(-ramp)), F.pmod(F.col("place"), F.lit(3)) + 1)
    out = out.withColumn("copies", copies).withColumn("ramp", r).withColumn("position", F.when(copies > 0, position(F.lit(0))))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "position", "before", "ramp")


def position(copy: Column) -> Column:
    """Training time at which the middle of a document's copy (0, 1, ...) comes up: demand inverted, in 0..1."""
    share = F.least(F.lit(1.0), (copy * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.col("target"))
    r = F.col("ramp")
    root = F.sqrt((1 - r) * (1 - r) + 4 * r * share)
    return F.when(r == 0, share).otherwise(2 * share / ((1 - r) + root))


def positions(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each copy that is taken, with ``copy`` and ``position``, range-sorted by position."""
    each = mixed.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("position", position(F.col("copy")))
    keys = ["position", id_col, "copy"]
    return each.repartitionByRange(*keys).sortWithinPartitions(*keys)
