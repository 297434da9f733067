"""Operator 4: quality classifier by positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, pack, small_batches, unpack
from lorespark.llm.html import STOP_WORDS

#: The fit's bounded sample, by hash of the id: trusted positives and unlabelled texts.
MAX_POSITIVE, MAX_UNLABELLED = 6000, 12000
HIDDEN, EPOCHS, BATCHES, RATE, SEED = 24, 240, 12, 0.01, 7
SHAPES, SPAN = 64, 40
_FLAGS = 9  # what is known of a word: see _word
_WORDS = 1 << 18


def _shape(w: str) -> int:
    """The word's shape, runs of capitals, small letters and digits as one sign each, in SHAPES buckets."""
    shape, last = 0, ""
    for c in w:
        k = "X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c if c.isascii() else "u"
        if k != last:
            shape, last = (shape * 131 + ord(k)) % 2147483647, k
    return shape * 2654435761 % 2**32 % SHAPES


_PLAIN = {(cap, end): _shape(("Xx" if cap else "x") + end) for cap in (False, True) for end in ("", ".", ",", ";", ":")}


def _word(w: str) -> tuple[float, ...]:
    """Length, share of capitals, of digits, of signs; flags: rare signs, exclamation, final stop or comma, stop word; shape."""
    n = len(w)
    end = w[-1] if w[-1] in ".,;:" else ""
    core = w[:-1] if end else w
    if core.isalpha() and (core[1:].islower() or n == 1 and core.islower()):  # most words
        low = core.lower()
        return n, 0.0, 0.0, (1 / n if end else 0.0), 0.0, 0.0, float(end != ""), float(low in STOP_WORDS), float(_PLAIN[low != core, end])
    up = sum(c.isupper() for c in w)
    low = sum(c.islower() for c in w)
    dig = sum(c.isdigit() for c in w)
    rare = any(c in "#*$%&|<>{}[]=_^~@\\/+" for c in w)
    return n, up / n if up > 1 or n == 1 else 0.0, dig / n, (n - up - low - dig) / n, float(rare), float("!" in w or "?" in w), float(end != ""), float(w.lower().strip(".,;:!?") in STOP_WORDS), float(_shape(w))


class Featurizer:
    """Numbers of a text, whatever its length: rates over the whole text and the extreme rates over spans of words."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 12, _FLAGS), np.float32)

    def _id(self, w: str) -> int:
        i = self.known.get(w)
        if i is None:
            i = self.known[w] = len(self.known)
            if i >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[i] = _word(w)
        return i

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        n = len(words)
        if not n:
            return np.zeros(self.size(), np.float32)
        if len(self.known) > _WORDS:
            self._clear()
        get = self.known.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, n)
        for i in np.flatnonzero(ids < 0):
            ids[i] = self._id(words[i])
        f = self.table[ids]
        _, first, counts = np.unique(ids, return_index=True, return_counts=True)
        fresh = np.zeros(n, np.float32)
        fresh[first] = 1
        same = np.zeros(n, np.float32)
        same[1:] = ids[1:] == ids[:-1]
        again = np.zeros(n, np.float32)
        if n > 3:
            key = (ids[:-2] * 1000003 + ids[1:-1]) * 1000003 + ids[2:]
            _, inv, c = np.unique(key, return_inverse=True, return_counts=True)
            again[: n - 2] = c[inv] > 1
        rates = np.column_stack([f[:, :-1], fresh, same, again])
        mean = rates.mean(0)
        total = np.concatenate([np.zeros((1, rates.shape[1])), np.cumsum(rates, 0, dtype=np.float64)])
        width = min(SPAN, n)
        starts = np.append(np.arange(0, n - width, SPAN // 2), n - width)  # the last span ends at the last word
        spans = (total[starts + width] - total[starts]) / width
        lines = (text or "").split("\n")
        shapes = np.sqrt(np.bincount(f[:, -1].astype(np.int64), minlength=SHAPES) / n)
        p = counts / n
        extra = [np.log1p(n), np.log1p(n / len(lines)), len(lines) - len(set(lines)) > 0, len(set(lines)) / len(lines), -(p * np.log(p)).sum() / max(1.0, np.log(n)), f[:, 0].std(), n < 50]
        return np.concatenate([mean, spans.max(0), spans.min(0), extra, shapes]).astype(np.float32)

    @staticmethod
    def size() -> int:
        return 3 * (_FLAGS - 1 + 3) + 7 + SHAPES


@dataclass
class Model:
    """Standardised features, one hidden layer, logit; ``prior`` alone where nothing could be fitted."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.prior)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        logit = np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = SEED, moments: tuple[np.ndarray, np.ndarray] | None = None, epochs: int = EPOCHS) -> Model:
    """Minimise the non-negative unbiased risk  prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]).

    l is the logistic loss. Where a batch's estimate of the negative part falls below 0 the step goes against it,
    as the non-negative estimator prescribes, so the network cannot explain trusted positives by fitting noise.
    Features are standardised by ``moments`` (mean, deviation), else by those of the unlabelled sample. With a prior of
    None the loss is  E_p[l(g)] + E_u[l(-g)],  whose minimum is the log of p(x | positive) / p(x): see ``estimate_prior``.
    """
    if not len(positive) or not len(unlabelled):
        return Model(0.5 if prior is None else prior)
    rng = np.random.default_rng(seed)
    mean, scale = moments or (unlabelled.mean(0), unlabelled.std(0))
    scale = scale + 0.02
    prep = lambda x: np.clip((x - mean) / scale, -8, 8).astype(np.float64)
    xp, xu = prep(positive), prep(unlabelled)
    d = xp.shape[1]
    params = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)
    avg = [p.copy() for p in params]
    kept = 0
    for epoch in range(epochs):
        ps, us = np.array_split(rng.permutation(len(xp)), BATCHES), np.array_split(rng.permutation(len(xu)), BATCHES)
        for bp, bu in zip(ps, us, strict=True):
            if not len(bp) or not len(bu):
                continue
            x = np.concatenate([xp[bp], xu[bu]])
            h = np.tanh(x @ params[0] + params[1])
            g = h @ params[2] + params[3]
            gp, gu = g[: len(bp)], g[len(bp) :]
            if prior is None:
                dp, du = -sigmoid(-gp) / len(bp), sigmoid(gu) / len(bu)
            elif soft(gu).mean() - prior * soft(gp).mean() >= 0:
                dp = (prior * -sigmoid(-gp) - prior * sigmoid(gp)) / len(bp)
                du = sigmoid(gu) / len(bu)
            else:
                dp, du = prior * sigmoid(gp) / len(bp), -sigmoid(gu) / len(bu)
            dg = np.concatenate([dp, du])
            dh = np.outer(dg, params[2]) * (1 - h * h)
            grads = [x.T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ dg + 1e-4 * params[2], np.array([dg.sum()])]
            t += 1
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                params[i] = params[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if epoch >= epochs // 2:  # the mean of the later steps varies less than the last
            kept += 1
            avg = [a + (p - a) / kept for a, p in zip(avg, params, strict=True)]
    w1, b1, w2, b2 = avg
    return Model(0.5 if prior is None else prior, mean, scale, w1, b1, w2, float(b2[0]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, moments: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """Share of positives among unlabelled texts, from the two samples alone.

    A ranking of p(x | positive) / p(x) is fitted on either half of both samples and read at the other half. Of the
    unlabelled, a share q_u lies above a threshold, of the positives q_p; the prior is at most q_u / q_p, and equal to
    it where only positives lie above. So the least such ratio is taken, at the threshold where ratio and its margin
    of error (that of two empirical distributions at 90 %) are least together.
    """
    if len(positive) < 20 or len(unlabelled) < 20:
        return 0.5
    found = []
    for k in range(2):
        m = fit(positive[k::2], unlabelled[k::2], None, moments=moments, epochs=EPOCHS // 6)
        p, u = np.sort(m.score(positive[1 - k :: 2])), np.sort(m.score(unlabelled[1 - k :: 2]))
        qp = 1 - np.arange(len(p)) / len(p)  # share at or above each positive's score
        qu = 1 - np.searchsorted(u, p, "left") / len(u)
        margin = (np.sqrt(np.log(40) / 2 / len(p)) + np.sqrt(np.log(40) / 2 / len(u))) / qp
        found.append((qu / qp)[np.argmin(qu / qp + margin)])
    return float(np.clip(np.mean(found), 0.02, 0.98))


def held_out(id_col: str = "doc_id"):
    """True for the rows kept from the fit: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with ``_x``, the features of each whole text as float32 bytes: one narrow pass."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        feats = Featurizer()
        for texts in batches:
            yield pd.Series([feats(t).tobytes() for t in texts], dtype=object)

    return docs.withColumn("_x", read(F.col(text_col).cast("string")))


def moments_of(read: DataFrame, id_col: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and deviation of each feature over all rows that aren't held out: sums of batches, then of 32 groups of them."""
    d = Featurizer.size()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + 2 * d)
        for b in batches:
            if b.schema.names == ["_s"]:
                x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.float64).reshape(-1, 1 + 2 * d)
                total += x.sum(0)
            else:
                x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.float32).reshape(-1, d).astype(np.float64)
                total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["_s"])

    parts = read.where(~held_out(id_col)).select("_x").mapInArrow(add, "_s binary").repartition(32).mapInArrow(add, "_s binary").toArrow()
    total = sum((np.frombuffer(x, np.float64) for x in parts["_s"].to_pylist()), np.zeros(1 + 2 * d))
    if not total[0]:
        return None
    mean = total[1 : 1 + d] / total[0]
    return mean, np.sqrt(np.maximum(total[1 + d :] / total[0] - mean * mean, 0))


def train(read: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on a bounded sample of the rows of ``read`` (id_col, _x) that aren't held out.

    Trusted positives are documents labelled 1 (all labels, if several); unlabelled texts are any, their labels not
    looked at, and no label 0 is. The class prior is estimated from the two samples (``estimate_prior``); features are
    standardised by moments of all rows. Both samples are the first ids by hash, so reruns agree; an id on many rows
    counts once, as its least features, so at most the two given numbers of rows reach the driver, whatever the input.
    """
    spark = read.sparkSession
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"))
    order = F.xxhash64(F.lit(SEED), F.col("_id").cast("string"))
    pos = marks.where(~held_out("_id") & (F.col("_y") == 1)).select("_id", order.alias("_o")).orderBy("_o", "_id").limit(max_positive).select("_id", F.lit(True).alias("_pos"))
    ids = read.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).where(~held_out("_id")).distinct()
    unl = ids.select("_id", order.alias("_o")).orderBy("_o", "_id").limit(max_unlabelled).select("_id", F.lit(False).alias("_pos"))
    wanted = spark.createDataFrame(pos.union(unl).groupBy("_id").agg(F.max("_pos").alias("_p"), F.min("_pos").alias("_q")).toArrow())
    rows = read.join(F.broadcast(wanted), F.col(id_col) == F.col("_id"))  # a bounded list of ids, so a broadcast
    got = rows.groupBy(F.col("_id").cast("string").alias("_k"), "_p", "_q").agg(F.min("_x").alias("_x")).toArrow().combine_chunks().sort_by("_k")
    d = Featurizer.size()
    x = np.frombuffer(b"".join(got["_x"].to_pylist()), np.float32).reshape(-1, d)
    p, q = np.array(got["_p"].to_pylist(), bool), np.array(got["_q"].to_pylist(), bool)
    xp, xu = x[p], x[~q]
    if not len(xp):
        return Model(0.5)
    moments = moments_of(read, id_col)
    return fit(xp, xu, estimate_prior(xp, xu, moments), moments=moments)


def score(read: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """read with a score from 0 to 1 of its ``_x``; the model is a few dozen kB."""
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.frombuffer(b"".join(x), np.float32).reshape(-1, Featurizer.size())).astype(np.float64))

    return read.withColumn(out, run("_x"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id_col, held_out, score, predicted) of every document.

    A score depends on the text alone; equal texts score alike, null and empty ones as a text without words. Without
    usable labels every score is 0.5. Null ids and repeated rows are scored like any other row. Features are read once
    and written (some 400 bytes a document); fit, moments and scores all start from there.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    read = scratch.save(features(docs.select(id_col, text_col), text_col).select(id_col, "_x"), "features")
    scored = score(read, train(read, labels, id_col, label_col))
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Documents with a score of 0.5 or more, all columns: written once with their features, then scored without a shuffle."""
    scratch = Scratch(docs.sparkSession, "quality")
    read = scratch.save(features(pack(docs, id_col, text_col)), "features")
    model = train(read.select("doc_id", "_x"), labels.withColumnRenamed(id_col, "doc_id"), "doc_id", label_col)
    return unpack(score(read, model, "_score").where(F.col("_score") >= 0.5), docs, text_col)
