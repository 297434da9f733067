"""Operator 9: benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, pack, small_batches, unpack, with_uid

#: Edits allowed for each character of a test item, after normalisation.
ERROR_RATE = 0.1
#: Characters of test items that one pass broadcasts; longer sets go in several passes, in blocks.
BLOCK_CHARS = 4_000_000
_NOISE = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower case, runs of anything but letters and digits as one blank, a blank at both ends."""
    return f" {_NOISE.sub(' ', (text or '').lower()).strip()} "


def budget(n: int, rate: float = ERROR_RATE) -> int:
    """Edits allowed for an item of n characters. Without any, it must stand at word borders."""
    return int(n * rate)


class Peq:
    """An item's bit masks for Myers' bit-parallel distance; Python's integers are the words, of any length."""

    def __init__(self, item: str) -> None:
        self.m, self.mask = len(item), {}
        for i, c in enumerate(item):
            self.mask[c] = self.mask.get(c, 0) | 1 << i

    def best(self, text: str, most: int) -> tuple[int, int]:
        """Least distance of the item to any substring of text, and that substring's end; gives up past ``most`` only at the end."""
        m, full, top = self.m, (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score = full, 0, self.m
        low, at, get = self.m, 0, self.mask.get
        n = len(text)
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph <<= 1
            mh <<= 1
            pv = (mh | ~(xv | ph)) & full
            mv = ph & xv & full
            if score < low:
                low, at = score, j
                if not low:
                    break
            elif score - (n - j) > most and low > most:
                break
        return low, at


class Matcher:
    """Find all items of a block in a text.

    An item with an error budget k is cut into pieces, at least k + 1 and an even number; of a substring within k
    edits some pair of neighbours holds at most 1 edit, so one piece of the pair occurs exactly and the other within
    1 edit, hence one of its halves exactly and within 1 of its place. Exact pieces come from one automaton; pairs
    that pass are verified with Myers' distance over the piece's surroundings.
    """

    def __init__(self, items: list[tuple[str, str]], rate: float = ERROR_RATE) -> None:
        import ahocorasick

        self.items, self.peq, self.k, where = [], [], [], {}
        for item, text in items:
            s = normalise(text)
            core = s[1:-1]
            if not core:
                continue
            k = budget(len(core), rate)
            if not k:
                core = s
            i = len(self.items)
            self.items.append((item, core))
            self.peq.append(Peq(core))
            self.k.append(k)
            if not k:
                where.setdefault(core, []).append((i, 0, "", 0, 0))
                continue
            n = k + 1 + (k + 1) % 2
            cuts = [round(j * len(core) / n) for j in range(n + 1)]
            for j in range(n):
                a, b = cuts[j], cuts[j + 1]
                o = j ^ 1
                where.setdefault(core[a:b], []).append((i, a, core[cuts[o] : cuts[o + 1]], cuts[o] - a, b - a))
        self.machine = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.machine.add_word(piece, (len(piece), uses))
        self.empty = not where
        if where:
            self.machine.make_automaton()

    def find(self, text: str | None) -> dict[str, int]:
        """Item ids to their least distance, for the items that occur within their budget."""
        if self.empty or not text:
            return {}
        t = normalise(text)
        best: dict[int, int] = {}
        tried: dict[int, int] = {}  # item to the last place that was verified: its pieces share it
        for end, (size, uses) in self.machine.iter(t):
            at = end + 1 - size
            for i, off, other, shift, _ in uses:
                k = self.k[i]
                if best.get(i) == 0:
                    continue
                if not k:
                    best[i] = 0
                    continue
                o = at + shift
                h = len(other) // 2
                x, y = other[:h], other[h:]
                if not (x in t[max(0, o - 1) : o + h + 1] or y in t[max(0, o + h - 1) : o + len(other) + 1]):
                    continue
                start, stop = max(0, at - off - k), at - off + len(self.items[i][1]) + k
                if tried.get(i) == at - off:
                    continue
                tried[i] = at - off
                got, _ = self.peq[i].best(t[start:stop], k)
                if got <= k:
                    best[i] = min(got, best.get(i, got))
        least: dict[str, int] = {}
        for i, d in best.items():  # several texts may share an id
            item = self.items[i][0]
            least[item] = min(d, least.get(item, d))
        return least


_matchers: dict[str, Matcher] = {}


def _matcher(token: str, items: list[tuple[str, str]], rate: float) -> Matcher:
    """One matcher for each worker process: that of the block at work."""
    if token not in _matchers:
        _matchers.clear()
        _matchers[token] = Matcher(items, rate)
    return _matchers[token]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, keep: bool = False) -> DataFrame:
    """(id_col, item_ids, distances): test items within rate * length edits in each whole document.

    With keep, docs' own columns and those two. Test items are read in blocks of a checked size: one block is one pass
    without a shuffle; of more blocks each is a pass of its own, whose few matches are written, and one join brings
    them together, so no worker holds more than one block. item_ids have the benchmark's type and order; where one id
    has several texts the least distance counts. Items that are null or hold no letter or digit match nothing; equal
    items all match; null texts hold none. Null item ids are left out. Repeated and null document ids keep their rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = benchmark.schema[item_col].dataType
    usable = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t")).distinct()
    total = usable.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    out = pack(docs, id_col, text_col)
    if not keep:
        out = out.drop("rest")
    block = lambda b: sorted((r.i, r.t) for r in usable.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).toLocalIterator())
    if n == 1:
        out = _find(out, block(0), "text", rate).withColumnRenamed("_m", "_all")
    else:
        scratch = Scratch(spark, "leaks")
        out = with_uid(out)
        found = None
        for b in range(n):
            part = _find(out.select("uid", "text"), block(b), "text", rate).where(F.size("_m") > 0).select("uid", F.explode("_m").alias("_e"))
            part = scratch.save(part.select("uid", F.col("_e.item").alias("item"), F.col("_e.distance").alias("distance")), "block")
            found = part if found is None else found.union(part)
        least = found.groupBy("uid", "item").agg(F.min("distance").alias("distance"))
        lists = scratch.save(least.groupBy("uid").agg(F.collect_list(F.struct("item", "distance")).alias("_all")), "found")
        out = out.join(lists, "uid", "left").drop("uid").withColumn("_all", F.coalesce("_all", F.array().cast("array<struct<item:string,distance:bigint>>")))
    ordered = F.array_sort(F.transform("_all", lambda x: F.struct(x["item"].cast(kind).alias("item"), x["distance"].alias("distance"))))
    out = out.withColumn("_all", ordered)
    ids, dist = F.col("_all.item").alias("item_ids"), F.col("_all.distance").alias("distances")
    return unpack(out, docs, text_col, ids, dist) if keep else out.select(F.col("doc_id").alias(id_col), ids, dist)


def _find(docs: DataFrame, items: list[tuple[str, str]], text_col: str, rate: float) -> DataFrame:
    from pyspark.sql import types as T

    kind = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("distance", T.LongType())]))
    arrow = pa.list_(pa.struct([("item", pa.string()), ("distance", pa.int64())]))
    sent, token = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(token, sent.value, rate)
        for b in batches:
            found = [[{"item": i, "distance": d} for i, d in m.find(t.as_py()).items()] for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, arrow)], names=[*b.schema.names[:-1], "_m"])

    return docs.withColumn("_t", F.col(text_col).cast("string")).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_m", kind)]))


def contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """(doc id, contaminated, n_items, item_ids, distances) of every document."""
    m = matches(docs, benchmark, **kw)
    return m.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", F.col("n_items") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Documents without any test item, all columns, in one pass."""
    found = matches(docs, benchmark, keep=True, **kw)
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = found.toDF(*names, "item_ids", "distances").where(F.size("item_ids") == 0)
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
