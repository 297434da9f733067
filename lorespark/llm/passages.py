"""Operator 10: byte passages that repeat, by suffix order and longest-previous-factor arrays.

A byte goes if a 100-byte string over it also starts earlier. One suffix array over a corpus can't be built in
parts, so the corpus is cut by content first, without losing a match:

1. Anchors. Of the 77 starts of 24-byte grams in a 100-byte string the one with the least hash is its anchor (the
   first, if equal). Equal strings have the same anchor at the same place, so all their occurrences meet under the
   anchor's hash. About one byte in 39 starts an anchor; only anchors that occur twice go on.
2. Contexts. All strings with this anchor lie within 76 bytes before and after it. Occurrences with equal contexts
   are one class: all but the first are repeats throughout. This is an aggregation with partial sums, so thousands
   of copies cost one row for each task.
3. Classes under one anchor are compared by a suffix array of their contexts (``later_windows``). An anchor with
   many classes (a passage in many documents has one for each document at its ends) is first split: strings that
   start in the same half of the range before the anchor share a longer core, which is a key of its own; at most 7
   such steps lead to single strings, where equality of keys decides. So no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, small_batches, with_uid

LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM  # bytes before or after an anchor that a string with it can hold
STARTS = REACH + 1
SPAN = LENGTH + REACH
#: Classes of one key that one suffix array takes; keys with more are split.
GROUP = 400
#: Bytes of text for which anchors are found at once.
STEP = 1 << 20

_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(1, 2**64, 256, np.uint64, endpoint=False)
_BASE = int(_rng.integers(1, 2**63, dtype=np.uint64)) * 2 + 1 & (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP = _powers(_BASE, STEP + 4 * SPAN)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), STEP + 4 * SPAN)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _grams(code: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    h, n, eight = code, 1, None
    while n < 16:
        h = h[:-n] * power(n) + h[n:]
        n *= 2
        eight = h if n == 8 else eight
    m = len(code) - GRAM + 1
    return _mix(h[:m] * power(8) + eight[16 : 16 + m])


def _least(h: np.ndarray) -> np.ndarray:
    """For each run of STARTS grams, the place of the least hash, the first if equal."""
    at, v, n = np.arange(len(h), dtype=np.int32), h, 1
    while n <= STARTS // 2:
        first = v[:-n] <= v[n:]
        at, v = np.where(first, at[:-n], at[n:]), np.where(first, v[:-n], v[n:])
        n *= 2
    k = STARTS - n
    return np.where(v[: len(v) - k] <= v[k:], at[: len(v) - k], at[k:]) if k else at


def anchors(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of texts laid end to end (bounds: n + 1 offsets), a step of the bytes at a time:
    text number, place in the text, gram hash, context hash, bytes of context before and after (at most REACH)."""
    end = bounds[-1]
    seen = -1
    for s in range(int(bounds[0]), int(end) - LENGTH + 1, STEP):
        e = min(s + STEP, end - LENGTH + 1)  # strings that start in s..e-1
        a, b = max(0, s - REACH), min(end, e + SPAN)
        code = _CODE[data[a:b]]
        h = _grams(code[s - a : e - a + LENGTH - 1])
        at = _least(h)[: e - s]
        ok = np.ones(e - s, bool)
        for x in bounds[np.searchsorted(bounds, s, "right") : np.searchsorted(bounds, e + LENGTH, "left")]:
            ok[max(0, x - LENGTH + 1 - s) : max(0, x - s)] = False  # strings over the end of a text
        at = at[ok]
        if not at.size:
            continue
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        place = at.astype(np.int64) + s
        keep = place > seen  # a step's first anchor may be the last of the step before
        at, place = at[keep], place[keep]
        if not at.size:
            continue
        seen = place[-1]
        text = np.searchsorted(bounds, place, "right") - 1
        left = np.minimum(place - bounds[text], REACH)
        right = np.minimum(bounds[text + 1] - place - GRAM, REACH)
        total = np.concatenate([[np.uint64(0)], np.cumsum(code * _UP[: len(code)])])
        i, j = place - left - a, place + GRAM + right - a
        c = _mix((total[j] - total[i]) * _DOWN[i] + left.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + right.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        yield text, place - bounds[text], h[at].view(np.int64), c.view(np.int64), left, right


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary column, nulls as empty, without a copy where it can be had."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def _gram_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, bounds = _buffers(b.column(1))
        for _, _, h, _, _, _ in anchors(data, bounds):
            yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, bounds = _buffers(b.column(1))
        uid = b.column(0).to_numpy(zero_copy_only=False)
        for text, at, h, c, left, right in anchors(data, bounds):
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(uid[text]), pa.array(at.astype(np.int32)), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16))], names=["h", "c", "uid", "at", "l", "r"])


def previous_smaller(pos: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place i of a suffix order, the nearest place before it with a smaller position (-1: none), and the
    length that suffix has in common with i: the least of lcp (lcp[i]: place i with i - 1) over (that place, i].

    All places jump at once: what lies between i and its candidate is never smaller, so a candidate that is too large
    hands on its own candidate, and chains halve with every round.
    """
    at = np.arange(-1, len(pos) - 1)
    common = lcp.copy()
    todo = np.flatnonzero(pos[at] > pos)
    todo = todo[todo > 0]
    while todo.size:
        j = at[todo]
        common[todo] = np.minimum(common[todo], common[j])
        at[todo] = at[j]
        j = at[todo]
        todo = todo[(j >= 0) & (pos[j] > pos[todo])]
    common[at < 0] = 0
    return at, common


def longest_previous(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array in suffix order: for each place, how long a prefix its suffix shares with one of a
    smaller position. The best lies at the previous or the next smaller position."""
    before = previous_smaller(pos, lcp)[1]
    after = previous_smaller(pos[::-1], np.concatenate([lcp[:1] * 0, lcp[:0:-1]]))[1][::-1]
    return np.maximum(before, after)


def later_windows(group: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, right: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """Which strings around aligned anchors also occur earlier: a mask of rows by starts (column REACH - d: d bytes
    before the anchor), for rows of a group in text order.

    The suffix order of all contexts, to a depth of LENGTH, by doubling ranks; a suffix is told apart by its group
    and column, so that only strings at the same place of the same group can have a prefix in common. Common prefixes
    of neighbours in that order are read off the ranks of 64, 32, ... 4 bytes, and a string goes where its longest
    previous factor (``longest_previous``) reaches LENGTH.
    """
    n = len(contexts)
    m = np.zeros((n, SPAN), np.uint8)
    for i, (x, k) in enumerate(zip(contexts, left.tolist(), strict=True)):
        m[i, REACH - k : REACH - k + len(x)] = np.frombuffer(x, np.uint8)
    cols = np.arange(STARTS)
    ok = (cols >= REACH - np.minimum(left, high)[:, None]) & (cols <= np.minimum(REACH - low, right)[:, None])
    four = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(m, 4, axis=1)).view("<u4")[:, :, 0].astype(np.int64)
    place = group.astype(np.int64)[:, None] * SPAN + np.arange(four.shape[1])
    rank = np.unique(place << 32 | four, return_inverse=True)[1].reshape(four.shape)
    size, levels = 4, []
    while size < LENGTH:
        levels.append((size, rank.astype(np.int32)))
        step = min(size, LENGTH - size)
        k = rank.shape[1] - step
        rank = np.unique(rank[:, :k] * (rank.max() + 1) + rank[:, step : step + k], return_inverse=True)[1].reshape(n, k)
        size += step
    rows, starts = np.nonzero(ok)  # row by row, so in text order within a rank
    key = rank[rows, starts]
    order = np.argsort(key, kind="stable")
    rows, starts, key = rows[order], starts[order], key[order]
    lcp = np.zeros(len(key), np.int32)
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    lcp[same] = LENGTH
    near = np.flatnonzero(~same[1:] & (starts[1:] == starts[:-1])) + 1  # neighbours that part before LENGTH
    for size, r in reversed(levels):
        fit = near[lcp[near] + size <= LENGTH]
        at = starts[fit] + lcp[fit]
        lcp[fit[r[rows[fit], at] == r[rows[fit - 1], at]]] += size
    out = np.zeros((n, STARTS), bool)
    again = longest_previous(rows, lcp) >= LENGTH  # a row's number is its position
    out[rows[again], starts[again]] = True
    return out


def _spans(mask: np.ndarray, uid: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    a = at[rows] - REACH
    return pa.RecordBatch.from_arrays([pa.array(uid[rows]), pa.array((a + first).astype(np.int32)), pa.array((a + last + LENGTH).astype(np.int32))], names=["uid", "s", "e"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, lo, hi, uid, at, l, r, ctx) sorted by key and position to repeated spans, 2000 rows or so at once."""
    held: list[pa.RecordBatch] = []

    def work(t: pa.Table) -> pa.RecordBatch:
        col = {k: t[k].to_numpy() for k in ("k1", "k2", "lo", "hi", "uid", "at", "l", "r")}
        new = np.ones(t.num_rows, bool)
        new[1:] = np.logical_or.reduce([col[k][1:] != col[k][:-1] for k in ("k1", "k2", "lo", "hi")])
        return _spans(later_windows(np.cumsum(new) - 1, col["lo"], col["hi"], col["l"], col["r"], t["ctx"].to_pylist()), col["uid"], col["at"].astype(np.int64))

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < 2000:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k1, k2 = t["k1"].to_numpy(), t["k2"].to_numpy()
        cut = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
        if cut.size:
            n = int(cut[-1]) + 1
            yield work(t.slice(0, n).combine_chunks())
            held = t.slice(n).combine_chunks().to_batches()
        else:
            held = t.to_batches()
    if held and (t := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield work(t)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, text, list of (h, at, l, r, n)) to one row for each context, with its bytes."""
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("h", "n", "uid", "at", "l", "r", "ctx")}
        for uid, text, want in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            raw = memoryview(text.as_buffer())
            for w in want:
                for k in ("h", "n", "at", "l", "r"):
                    out[k].append(w[k])
                out["uid"].append(uid)
                out["ctx"].append(bytes(raw[w["at"] - w["l"] : w["at"] + GRAM + w["r"]]))
        kinds = {"h": pa.int64(), "n": pa.int64(), "uid": pa.int64(), "at": pa.int32(), "l": pa.int16(), "r": pa.int16(), "ctx": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))


_ROW = ("k1", "k2", "lo", "hi", "uid", "at", "l", "r", "ctx")


def repeated_spans(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """texts (uid, t binary) to (uid, s, e): spans of repeated strings, which may overlap."""
    spark = texts.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    twice = scratch.save(texts.mapInArrow(_gram_hashes, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "anchors")
    scratch.release()
    found = texts.mapInArrow(_postings, "h long, c long, uid long, at int, l short, r short").join(twice, "h")
    found = scratch.save(found, "postings")
    scratch.drop(twice)
    scratch.release()
    kinds = scratch.save(found.groupBy("h", "c").agg(F.min(F.struct("uid", "at")).alias("first"), F.first("l").alias("l"), F.first("r").alias("r"), F.count(F.lit(1)).alias("n")), "classes")
    firsts = scratch.save(kinds.where("n > 1 and l + r >= 76").select("h", "c", "first"), "firsts")
    copies = found.join(firsts, ["h", "c"]).where(F.struct("uid", "at") != F.col("first"))
    parts = [scratch.save(copies.select("uid", (F.col("at") - F.col("l")).alias("s"), (F.col("at") + GRAM + F.col("r")).alias("e")), "copies")]
    scratch.drop(found)
    several = scratch.save(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    rows = kinds.where("l + r >= 76").drop("n").join(several, "h").select("h", "n", "first.uid", "first.at", "l", "r")
    wanted = scratch.save(rows.groupBy("uid").agg(F.collect_list(F.struct("h", "at", "l", "r", "n")).alias("want")), "wanted")
    scratch.release()
    fetched = texts.join(wanted, "uid").select("uid", "t", "want").mapInArrow(_fetch, "h long, n long, uid long, at int, l short, r short, ctx binary")
    now = scratch.save(fetched.select(F.col("h").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).alias("lo"), F.lit(REACH).alias("hi"), "n", *_ROW[4:]), "contexts")
    scratch.release()
    scratch.drop(wanted)
    cold = [now.where(F.col("n") <= GROUP).select(*_ROW)]
    hot = now.where(F.col("n") > GROUP).select(*_ROW)
    while not hot.isEmpty():
        more, done, hot = _split(hot, scratch)
        cold.append(more)
        parts.append(done)
    todo = cold[0]
    for x in cold[1:]:
        todo = todo.union(x)
    dealt = todo.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "lo", "hi", "uid", "at")
    spans = dealt.mapInArrow(_compare, "uid long, s int, e int")
    for x in parts:
        spans = spans.union(x)
    return spans


def _split(hot: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Halve the starts of keys with many classes. Returns rows for a suffix array, spans found, and rows still hot."""
    half = F.expr("(lo + hi) div 2").cast("int")
    halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), half.alias("hi")), F.struct((half + 1).alias("lo"), F.col("hi").alias("hi"))))
    rows = hot.withColumn("_h", halves).withColumn("lo", F.col("_h.lo")).withColumn("hi", F.col("_h.hi")).drop("_h")
    # some string of the half must fit within the text
    rows = rows.where(F.greatest(F.col("lo"), REACH - F.col("r")) <= F.least(F.col("hi"), F.col("l")))
    cut = lambda before, after: F.substring("ctx", F.col("l").cast("int") - before + 1, before + GRAM + after)
    core, whole = cut(F.col("lo"), REACH - F.col("hi")), cut(F.col("hi"), REACH - F.col("lo"))
    full = (F.col("l") >= F.col("hi")) & (F.col("r") >= REACH - F.col("lo"))
    rows = rows.withColumn("k1", F.xxhash64("lo", "hi", core)).withColumn("k2", F.xxhash64(F.lit(11), "lo", "hi", core))
    rows = rows.withColumn("w1", F.when(full, F.xxhash64("lo", "hi", whole))).withColumn("w2", F.when(full, F.xxhash64(F.lit(13), "lo", "hi", whole)))
    rows = scratch.save(rows, "halves")
    same = rows.where("w1 is not null").groupBy("w1", "w2").agg(F.min(F.struct("uid", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = scratch.save(same, "same")
    marked = scratch.save(rows.join(same, ["w1", "w2"], "left").withColumn("later", F.coalesce(F.struct("uid", "at") != F.col("first"), F.lit(False))).drop("first"), "marked")
    spans = marked.where("later").select("uid", (F.col("at") - F.col("hi")).alias("s"), (F.col("at") + LENGTH - F.col("lo")).alias("e"))
    rest = marked.where("not later and lo < hi")  # a single string that isn't later is the first
    sizes = scratch.save(rest.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    left = scratch.save(rest.join(sizes, ["k1", "k2"]).select(*_ROW, "n"), "left")
    scratch.drop(rows)
    return left.where(F.col("n") <= GROUP).select(*_ROW), spans, left.where(F.col("n") > GROUP).select(*_ROW)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept binary): every document without the bytes of repeated 100-byte strings.

    Judged on the input; overlaps count; matches never cross documents. What stays may cut a character, so it is
    bytes. Null and short texts lose nothing; equal rows (same id and text) are one document. Repeated ids with
    different texts and null ids: ordered as ``with_uid`` says. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    narrow = with_uid(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")), "id", "t")
    texts = narrow.select("uid", "t")
    spans = repeated_spans(texts, scratch)
    listed = scratch.save(spans.groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    scratch.release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, runs, kept = [], [], [], []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                t = t or b""
                mark = np.zeros(len(t) + 1, np.int32)
                if spans.is_valid:
                    v = spans.values
                    np.add.at(mark, v.field(0).to_numpy(zero_copy_only=False), 1)
                    np.add.at(mark, v.field(1).to_numpy(zero_copy_only=False), -1)
                off = np.cumsum(mark)[:-1] > 0
                size.append(len(t))
                gone.append(int(off.sum()))
                runs.append(int(np.count_nonzero(np.diff(np.concatenate([[0], off.view(np.int8)])) == 1)))
                kept.append(np.frombuffer(t, np.uint8)[~off].tobytes() if gone[-1] else t)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    joined = narrow.join(listed, "uid", "left").select("id", "t", "spans")
    return joined.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


