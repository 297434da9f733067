"""Retrieval quality: recall, line recall, ranks, sweeps, set measures, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_gold_rank(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, first_rank): the best rank of a gold path; null if none was found."""
    q = gold.select("query_id").distinct()
    found = hits.join(gold.select("query_id", "path").distinct(), ["query_id", "path"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return q.join(found, "query_id", "left")


def recall_at(gold: DataFrame, hits: DataFrame, ks: list[int], by: list[str] = ()) -> DataFrame:
    """Share of queries with a gold path among the first k, for each k."""
    ranks = first_gold_rank(gold, hits)
    if by:
        ranks = ranks.join(gold.select("query_id", *by).distinct(), "query_id")
    ranks = ranks.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.coalesce(F.col("first_rank") <= F.col("k"), F.lit(False)).cast("int")
    return ranks.groupBy(*by, "k").agg(F.round(F.avg(hit), 6).alias("recall"), F.count(F.lit(1)).alias("n_queries"))


def line_recall_at(gold: DataFrame, hits: DataFrame, ks: list[int]) -> DataFrame:
    """Share of queries with gold lines of which a hit among the first k overlaps one."""
    want = gold.where("line_lo is not null")
    over = (hits["query_id"] == want["query_id"]) & (hits["path"] == want["path"]) & (hits["line_start"] <= want["line_hi"]) & (hits["line_end"] >= want["line_lo"])
    best = hits.join(want, over).groupBy(want["query_id"]).agg(F.min("rank").alias("r"))
    q = want.select("query_id").distinct().join(best, "query_id", "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return q.groupBy("k").agg(F.round(F.avg(F.coalesce(F.col("r") <= F.col("k"), F.lit(False)).cast("int")), 6).alias("recall"), F.count(F.lit(1)).alias("n_queries"))


def floor_sweep(gold: DataFrame, hits: DataFrame, negatives: DataFrame, floors: list[float], k: int = 5) -> DataFrame:
    """Recall and false alarms on hard negatives (query_id, score of the first hit) for each floor of the score."""
    # scores fall with rank, so the first k above a floor are among the first k
    best = hits.where(F.col("rank") <= k).join(gold.select("query_id", "path").distinct(), ["query_id", "path"]).groupBy("query_id").agg(F.max("score").alias("best"))
    each = F.explode(F.array(*map(F.lit, floors))).alias("floor")
    q = gold.select("query_id").distinct().join(best, "query_id", "left").select("best", each)
    rec = q.groupBy("floor").agg(F.round(F.avg(F.coalesce(F.col("best") >= F.col("floor"), F.lit(False)).cast("int")), 6).alias("recall"))
    neg = negatives.select("score", each).groupBy("floor").agg(F.count_if(F.col("score") >= F.col("floor")).alias("false_alarms"), F.count(F.lit(1)).alias("n_negatives"))
    return rec.join(neg, "floor")


def normal_path(path):
    """Lower case, forward slashes, without leading dots and slashes."""
    return F.lower(F.replace(F.regexp_replace(F.trim(path), r"^[./]+", ""), F.lit("\\"), F.lit("/")))


def _matched(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs of a set whose paths are equal or end in one another, found by their common last segment."""
    base = lambda c: F.substring_index(c, "/", -1)
    g = gold.select("set_id", F.col("path").alias("g"), base(F.col("path")).alias("b"))
    p = pred.select("set_id", F.col("path").alias("p"), base(F.col("path")).alias("b"))
    same = (F.col("g") == F.col("p")) | F.endswith("g", F.concat(F.lit("/"), "p")) | F.endswith("p", F.concat(F.lit("/"), "g"))
    return g.join(p, ["set_id", "b"]).where(same)


def path_prf(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Precision, recall and F1 of path sets (set_id, path)."""
    g, p = (t.select("set_id", normal_path(F.col("path")).alias("path")) for t in (gold, pred))
    m = _matched(g, p)
    tp = m.select("set_id", "g").distinct().groupBy("set_id").agg(F.count(F.lit(1)).alias("tp"))
    mp = m.select("set_id", "p").distinct().groupBy("set_id").agg(F.count(F.lit(1)).alias("mp"))
    ng, np_ = g.distinct().groupBy("set_id").agg(F.count(F.lit(1)).alias("ng")), p.distinct().groupBy("set_id").agg(F.count(F.lit(1)).alias("np"))
    out = ng.join(np_, "set_id", "full").join(tp, "set_id", "left").join(mp, "set_id", "left").na.fill(0)
    precision = F.when(F.col("np") > 0, F.col("mp") / F.col("np")).otherwise(0.0)
    recall = F.when(F.col("ng") > 0, F.col("tp") / F.col("ng")).otherwise(0.0)
    out = out.withColumns({"precision": precision, "recall": recall})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.select("set_id", F.round("precision", 3).alias("precision"), F.round("recall", 3).alias("recall"), F.round(f1, 3).alias("f1"))


def layer_coverage(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Share of a set's layers of which a file was predicted; gold has (set_id, layer, path)."""
    g = gold.select("set_id", "layer", normal_path(F.col("path")).alias("path"))
    p = pred.select("set_id", normal_path(F.col("path")).alias("path"))
    hit = _matched(g, p).select("set_id", F.col("g").alias("path")).distinct().withColumn("hit", F.lit(1))
    layers = g.join(hit, ["set_id", "path"], "left").groupBy("set_id", "layer").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return layers.groupBy("set_id").agg(F.round(F.avg("hit"), 3).alias("coverage"), F.sum("hit").alias("covered"), F.count(F.lit(1)).alias("layers"))


def precision_recall_at(hits: DataFrame, expected: DataFrame, unexpected: DataFrame, k: int) -> DataFrame:
    """For each query of (query_id, path, rank): precision among the first k and recall; nothing returned: 0, nothing expected: 1."""
    top = hits.where(F.col("rank") <= k).select("query_id", "path")
    good = top.join(expected.select("query_id", "path").distinct(), ["query_id", "path"], "left_semi")
    right = good.join(unexpected.select("query_id", "path"), ["query_id", "path"], "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("right"))
    found = good.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    n = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    want = expected.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("want"))
    q = hits.select("query_id").union(expected.select("query_id")).union(unexpected.select("query_id")).distinct()
    for t in (right, found, n, want):
        q = q.join(t, "query_id", "left")
    q = q.na.fill(0)
    precision = F.when(F.col("n") > 0, F.col("right") / F.col("n")).otherwise(0.0)
    recall = F.when(F.col("want") > 0, F.col("found") / F.col("want")).otherwise(1.0)
    return q.select("query_id", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"))


def wins(scores: DataFrame, one: str, other: str, margin: float = 0.02) -> DataFrame:
    """(set_id, arm, value) to one row: means of two arms, and how often either is ahead by more than the margin."""
    two = scores.where(F.col("arm").isin(one, other)).groupBy("set_id").agg(F.max(F.when(F.col("arm") == one, F.col("value"))).alias("a"), F.max(F.when(F.col("arm") == other, F.col("value"))).alias("b"))
    d = F.col("a") - F.col("b")
    return two.agg(F.round(F.avg("a"), 6).alias("mean_one"), F.round(F.avg("b"), 6).alias("mean_other"), F.count_if(d > margin).alias("wins"), F.count_if(d < -margin).alias("losses"), F.count_if((d <= margin) & (d >= -margin)).alias("ties"))


# States of audited calls that count as errors.
FAILED = ["error", "err", "fail", "failed", "fallback"]


def fallback_rate(statuses: DataFrame, gate: float = 0.10) -> DataFrame:
    """Calls that fell back, of all; unknown states count as done."""
    err = F.count_if(F.lower("status").isin(FAILED))
    rate = err / F.count(F.lit(1))
    return statuses.agg((F.count(F.lit(1)) - err).alias("ok"), err.alias("err"), F.round(rate, 6).alias("rate"), (rate <= gate).alias("passed"))
