"""Operator 8: quality rules with thresholds that adapt to language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, small_batches

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MIN_WORDS, WINDOW = 50, 3
#: Measures, each with the scale on which its fence is set. Rates count one event and EXTRA words more than there are, so
#: that a short text's single event is no outlier, and groups in which most texts have no event still have a spread.
MEASURES = {"symbol_rate": "linear", "chars_per_word": "log", "dup_line_rate": "linear", "repeat_rate": "log"}
EXTRA = 20
#: A fence stands this many interquartile ranges beyond the quartile. Quartiles of a group are averaged with those of its
#: language, which count as many as PRIOR documents, and these likewise with those of all.
FENCE, PRIOR = 5.0, 100
#: Relative error of a sketch's values: buckets are powers of (1 + A) / (1 - A).
ACCURACY = 0.01


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more in the text, the first occurrence included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    key, top = ids[: n - WINDOW + 1], len(known)
    for k in range(1, WINDOW):
        key = key * top + ids[k : n - WINDOW + 1 + k]
        if k < WINDOW - 1 and top > 1 << 20:  # keep the next product within 64 bits
            key = np.unique(key, return_inverse=True)[1]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    mark = np.zeros(n, bool)
    for k in range(WINDOW):
        mark[k : n - WINDOW + 1 + k] |= again
    return int(mark.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """The counts of COUNTS for one text in UTF-8."""
    words = text.split()
    if not words:
        raw = np.frombuffer(text, np.uint8)
        return 0, 0, int(_SYMBOL[raw].sum()), 0, 0
    raw = np.frombuffer(text, np.uint8)
    space = int(((raw == 32) | (raw >= 9) & (raw <= 13)).sum())
    chars = int(((raw & 0xC0) != 0x80).sum()) - space
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.split(None, 1):
            seen.add(line)
    return len(words), chars, int(_SYMBOL[raw].sum()), dup, repeat_words(words)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id_col, keep..., COUNTS): one narrow pass over whole texts; null texts count 0."""
    small_batches(docs.sparkSession)
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measure(t.as_py() or b"") for t in b.column(len(names))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], names=[*names, *COUNTS])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, F.col(text_col).cast("binary").alias("_t")).mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} long" for c in COUNTS))


def measures() -> dict[str, Column]:
    rate = lambda c: (c.cast("double") + 1) / (F.col("n_words") + EXTRA)
    return {
        "symbol_rate": rate(F.col("n_symbols")),
        "chars_per_word": F.try_divide(F.col("word_chars").cast("double"), F.col("n_words")),
        "dup_line_rate": rate(F.col("n_dup_lines")),
        "repeat_rate": rate(F.col("n_repeat_words")),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketch(counted: DataFrame, by: list[str]) -> DataFrame:
    """Quantile sketches (by..., measure, bucket, n): counts of logarithmic buckets, relative error ACCURACY.

    Sketches merge by adding the counts of equal buckets, in any order with the same result, so groups are
    pre-aggregated before the shuffle and coarser sketches are made of finer ones (``merge``). A sketch holds a few
    hundred rows, whatever the group's size.
    """
    log_base = float(np.log((1 + ACCURACY) / (1 - ACCURACY)))
    # rounded, so that every run and machine puts a value in the same bucket
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.when(c > 0, F.ceil(F.round(F.log(c) / log_base, 6))).otherwise(F.lit(-(10**6))).cast("long").alias("bucket")) for k, c in measures().items())))
    return counted.select(*by, pairs.alias("_p")).groupBy(*by, F.col("_p.measure").alias("measure"), F.col("_p.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], qs: tuple[float, ...]) -> DataFrame:
    """(by..., measure, total, q0, q1, ...): the value at each share of qs."""
    from pyspark.sql import Window as W

    group = W.partitionBy(*by, "measure")
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    value = F.when(F.col("bucket") == -(10**6), 0.0).otherwise(2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1))
    s = sketches.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))).withColumn("value", value)
    return s.groupBy(*by, "measure").agg(F.max("total").alias("total"), *(F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("value"))).alias(f"q{i}") for i, q in enumerate(qs)))


def thresholds(counted: DataFrame, scratch: Scratch, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high): fences of every group that occurs.

    Quartiles come from sketches of the documents that pass the fixed base rules, blended by weight (PRIOR), so a small
    group leans on its language and no size switches between the two. High is q75 + FENCE * (q75 - q25), on a log scale
    q75 * (q75 / q25) ** FENCE; low is the same below q25.
    """
    fine = scratch.save(sketch(counted.where(~base_failed()), [lang_col, source_col]), "sketches")
    mid = scratch.save(merge(fine, [lang_col]), "by-language")
    qs = (0.25, 0.75)
    named = lambda d, tag: d.select(*(c for c in (lang_col, source_col) if c in d.columns), "measure", F.struct("total", "q0", "q1").alias(tag))
    a, b, c = named(quantiles(fine, [lang_col, source_col], qs), "a"), named(quantiles(mid, [lang_col], qs), "b"), named(quantiles(merge(mid, []), [], qs), "c")
    kinds = F.explode(F.array(*map(F.lit, MEASURES))).alias("measure")
    g = counted.select(lang_col, source_col).distinct().select(lang_col, source_col, kinds).alias("g")
    eq = lambda x, *cols: [F.col(f"g.{k}").eqNullSafe(F.col(f"{x}.{k}")) for k in (*cols, "measure")]
    j = g.join(a.alias("a"), eq("a", lang_col, source_col), "left").join(b.alias("b"), eq("b", lang_col), "left").join(c.alias("c"), eq("c"), "left")

    def blended(q: str) -> Column:
        at = F.col(f"c.c.{q}")
        for own in ("b.b", "a.a"):
            n = F.coalesce(F.col(f"{own}.total"), F.lit(0))
            at = (n * F.coalesce(F.col(f"{own}.{q}"), F.lit(0.0)) + PRIOR * at) / (n + PRIOR)
        return at

    j = j.select(F.col(f"g.{lang_col}").alias(lang_col), F.col(f"g.{source_col}").alias(source_col), F.col("g.measure").alias("measure"), blended("q0").alias("q0"), blended("q1").alias("q1"))
    log = F.element_at(F.create_map(*(x for k, v in MEASURES.items() for x in (F.lit(k), F.lit(v == "log")))), F.col("measure"))
    ratio = F.pow(F.col("q1") / F.col("q0"), F.lit(FENCE))
    reach = FENCE * (F.col("q1") - F.col("q0"))
    j = j.withColumn("low", F.when(log, F.col("q0") / ratio).otherwise(F.col("q0") - reach)).withColumn("high", F.when(log, F.col("q1") * ratio).otherwise(F.col("q1") + reach))
    return j.groupBy(lang_col, source_col).agg(*(F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{m}_{e}") for m in MEASURES for e in ("low", "high")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id_col, COUNTS, base_failed, kept) of every document.

    kept is false where the base rules fail (fewer than 50 words; over half of them in repeated 3-word windows), or a
    measure lies beyond the fences of the document's language and source. Null languages and sources are groups like
    any other; null or empty texts fail the base rules; an empty table gives an empty result. Where no document
    passes the base rules there are no fences and none is kept.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    counted = scratch.save(base_counts(docs, id_col, text_col, (lang_col, source_col)), "counts")
    fences = scratch.save(thresholds(counted, scratch, lang_col, source_col), "fences")
    f = fences.select(F.col(lang_col).alias("_l"), F.col(source_col).alias("_s"), *(F.col(c) for c in fences.columns[2:]))
    j = counted.join(f, F.col(lang_col).eqNullSafe(F.col("_l")) & F.col(source_col).eqNullSafe(F.col("_s")), "left")
    inside = F.lit(True)
    for m, c in measures().items():
        inside = inside & (c <= F.col(f"{m}_high"))
    inside = inside & (measures()["chars_per_word"] >= F.col("chars_per_word_low"))
    return j.select(id_col, *COUNTS, base_failed().alias("base_failed"), (~base_failed() & F.when(F.col("n_words") > 0, F.coalesce(inside, F.lit(True))).otherwise(False)).alias("kept"))
