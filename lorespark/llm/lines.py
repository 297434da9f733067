"""Operator 7: line deduplication by pairwise alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, pack, small_batches, unpack, with_uid

#: A line in at most this many documents is rare: all pairs of them are compared. Lines in more are common: see
#: ``removed_lines`` for how they come to the same result without all pairs.
RARE = 8
#: Tasks that share the documents of one window of common lines.
SALTS = 16
#: Words an aligned block needs to be deleted.
MIN_WORDS = 5


def _lis(seq: list[int]) -> list[int]:
    """Places of a longest increasing subsequence (patience sorting with back links)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, x in enumerate(seq):
        k = bisect_left(tops, x)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(x)
            at.append(i)
        else:
            tops[k], at[k] = x, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], ascending: equal ends, then unique common lines in order, then between.

    Where no line is unique in both, equal ends alone are aligned. An explicit stack, so any length will do.
    """
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        one: dict[int, int] = {}
        for i in range(a0, a1):
            one[a[i]] = -1 if a[i] in one else i
        two: dict[int, int] = {}
        for j in range(b0, b1):
            two[b[j]] = -1 if b[j] in two else j
        common = [(i, j) for x, i in one.items() if i >= 0 and (j := two.get(x, -1)) >= 0]
        common.sort()
        anchors = [common[k] for k in _lis([j for _, j in common])]
        if not anchors:
            continue
        i0, j0 = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            if (i0, j0) != (a0, b0) or (i, j) != (a1, b1):
                work.append((i0, i, j0, j))
            if (i, j) != (a1, b1):
                out.append((i, j))
                i0, j0 = i + 1, j + 1
    return sorted(out)


def drop_blocks(early: dict[int, int], late: dict[int, int], words: dict[int, int], min_words: int) -> list[int]:
    """Places in the later document of aligned blocks with min_words or more. early and late: shared lines by place.

    A block is a run of aligned lines that follow each other in both documents.
    """
    pa_, pb = sorted(early), sorted(late)
    pairs = [(pa_[i], pb[j]) for i, j in patience([early[p] for p in pa_], [late[p] for p in pb])]
    gone: list[int] = []
    run: list[int] = []
    last = None
    for x, y in [*pairs, (None, None)]:
        if last is None or x is None or (x, y) != (last[0] + 1, last[1] + 1):
            if run and sum(words[late[p]] for p in run) >= min_words:
                gone += run
            run = []
        if x is not None:
            run.append(y)
        last = (x, y)
    return gone


def at_least(n: int) -> str:
    """A pattern that finds n words; it stops at the nth, however long the text."""
    return rf"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{n - 1}}}[^\x20\x09-\x0D]"


def postings(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(h1, h2, uid, at, words): each line with a word, as two hashes of its trimmed text, places counted from 0; words
    are counted up to min_words, as more make no difference."""
    lines = docs.select("uid", F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("at", "line"))
    cut = lines.select("uid", "at", F.btrim("line", F.lit(" \t\n\x0b\x0c\r")).alias("line")).where(F.col("line") != "")
    words = F.when(F.col("line").rlike(f"^{at_least(min_words)}"), min_words).otherwise(F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")))
    return cut.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "uid", "at", words.alias("words"))


def line_lists(found: DataFrame, scratch: Scratch, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """(uid, at, h, words, common): each document's lines that others have too, by place; and all pairs (a, b) that share a rare one."""
    line = ["h1", "h2"]
    per = scratch.save(found.groupBy(*line, "uid").agg(F.sort_array(F.collect_list("at")).alias("places"), F.max("words").alias("words")), "per-document")
    common = scratch.save(per.groupBy(*line).agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common")
    each = scratch.save(per.join(common, line), "shared")
    lists = each.where(F.col("df") <= rare).groupBy(*line).agg(F.sort_array(F.collect_list("uid")).alias("g"))  # at most `rare` each
    pairs = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, F.size("g")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    near = scratch.save(lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct(), "near")
    places = each.select("uid", F.explode("places").alias("at"), "h1", F.col("words").cast("int").alias("words"), (F.col("df") > rare).alias("common"))
    own = places.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", "h1", "words", "common"))).alias("x"))
    own = own.select("uid", F.col("x.at").alias("at"), F.col("x.h1").alias("h"), F.col("x.words").alias("words"), F.col("x.common").alias("common"))
    return scratch.save(own, "lists"), near


def windows(at: list[int], words: list[int], min_words: int) -> set[tuple[int, int]]:
    """(i, j), both included: the shortest runs of following places with min_words from each place on, and up to each.

    Every run with min_words is made up of such windows.
    """
    out: set[tuple[int, int]] = set()
    for i in range(len(at)):
        for step in (1, -1):
            j, n = i, words[i]
            while n < min_words and 0 <= j + step < len(at) and at[j + step] == at[j] + step:
                j += step
                n += words[j]
            if n >= min_words:
                out.add((min(i, j), max(i, j)))
    return out


def common_runs(lists: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(uid, kind, at, places, h, words, keys, spans): the common lines of each document that has a window of them.

    places keeps of at only which lines follow each other; documents of one kind have equal places and h. keys are
    hashes of the windows, spans their first and last line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for uid, at, h, words, common in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keep = [k for k, c in enumerate(common) if c]
                at, h, words = [at[k] for k in keep], [h[k] for k in keep], [words[k] for k in keep]
                found = sorted(windows(at, words, min_words))
                if not found:
                    continue
                places = [0] * len(at)
                for k in range(1, len(at)):
                    places[k] = places[k - 1] + (1 if at[k] == at[k - 1] + 1 else 2)
                raw = np.array(h, np.int64)
                keys = [xxhash.xxh64_intdigest(raw[i : j + 1].tobytes()) - (1 << 63) for i, j in found]
                kind = xxhash.xxh3_128_digest(np.array([h, places], np.int64).tobytes())
                rows.append((uid, kind, at, places, h, words, keys, [list(x) for x in found]))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = [pa.int64(), pa.binary(), ints, ints, longs, ints, longs, pa.list_(ints)]
    names = ["uid", "kind", "at", "places", "h", "words", "keys", "spans"]
    some = lists.where(F.array_contains("common", True)).select("uid", "at", "h", "words", "common")
    return some.mapInArrow(run, "uid long, kind binary, at array<int>, places array<int>, h array<long>, words array<int>, keys array<long>, spans array<array<int>>")


def align(pairs: DataFrame, lists: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(a, b, gone): lines of b in blocks aligned with a, from all lines that both have."""
    late = lists.select(F.col("uid").alias("b"), F.col("at").alias("pb"), F.col("h").alias("hb"), F.col("words").alias("wb"))
    early = lists.select(F.col("uid").alias("a"), F.col("at").alias("pa"), F.col("h").alias("ha"))
    rows = pairs.join(late.hint("merge"), "b").join(early.hint("merge"), "a").select("a", "b", "pa", "ha", "pb", "hb", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for x, y, pa_, ha, pb, hb, wb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = set(ha).intersection(hb)
                one, two = {p: h for p, h in zip(pa_, ha, strict=True) if h in both}, {p: h for p, h in zip(pb, hb, strict=True) if h in both}
                if gone := drop_blocks(one, two, dict(zip(hb, wb, strict=True)), min_words):
                    done.append((x, y, gone))
            yield _gone(done)

    return rows.mapInArrow(run, "a long, b long, gone array<int>")


def _gone(done: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    cols = list(zip(*done, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["a", "b", "gone"])


def align_kinds(left: DataFrame, runs: DataFrame, near: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(a, b, gone) for windows that the first holder has left: b meets every kind of document that holds such a window.

    Documents without a rare line in common share common lines alone, so all of a kind align with b alike, and one
    for each kind is enough: the first that is before b and not near it. left: (key, uid, had), had the lines gone so far.
    """
    who = left.select("uid").distinct()
    partners = near.join(who, F.col("b") == F.col("uid"), "left_semi").groupBy("b").agg(F.collect_list("a").alias("near"))
    late = left.join(runs.select("uid", "at", "places", "h", "words"), "uid").join(partners, F.col("uid") == F.col("b"), "left")
    late = late.select("key", (F.col("uid") % SALTS).cast("int").alias("salt"), "uid", "had", "at", "places", "h", "words", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
    most = (partners.agg(F.max(F.size("near"))).first()[0] or 0) + 1  # of so many members one at least isn't near
    held = runs.select("uid", "kind", "places", "h", F.array_distinct("keys").alias("keys"))
    few = lambda x: F.slice(F.sort_array(x), 1, most)
    rest = [F.any_value(c).alias(c) for c in ("places", "h", "keys")]
    part = held.groupBy("kind", F.col("uid") % 64).agg(few(F.collect_list("uid")).alias("members"), *rest)
    each = part.groupBy("kind").agg(few(F.flatten(F.collect_list("members"))).alias("members"), *rest)
    early = each.select("members", "places", "h", F.explode("keys").alias("key")).join(left.select("key").distinct(), "key", "left_semi")
    early = early.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "members", "places", "h")

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        kinds = list(zip(*(two[c].to_pylist() for c in ("members", "places", "h")), strict=True))
        alike: dict[tuple, list[tuple]] = {}
        for x in zip(*(one[c].to_pylist() for c in ("uid", "had", "at", "near", "places", "h", "words")), strict=True):
            alike.setdefault((tuple(x[4]), tuple(x[5])), []).append(x)
        done = []
        for (places, h), docs in alike.items():
            own, words, index = set(h), dict(zip(h, docs[0][6], strict=True)), {p: k for k, p in enumerate(places)}
            late = dict(zip(places, h, strict=True))
            had = [set(x[1]) for x in docs]
            near = [set(x[3]) for x in docs]
            known: dict[tuple, list[int]] = {}
            for members, p, g in kinds:
                seq = tuple((i, x) for i, x in zip(p, g, strict=True) if x in own)
                gone = known.get(seq)
                if gone is None:
                    both = {x for _, x in seq}
                    gone = known[seq] = [index[i] for i in drop_blocks(dict(seq), {i: x for i, x in late.items() if x in both}, words, min_words)]
                if not gone:
                    continue
                for k, x in enumerate(docs):
                    new = [x[2][i] for i in gone]
                    if not had[k].issuperset(new) and (a := next((m for m in members if m not in near[k]), x[0])) < x[0]:
                        had[k].update(new)
                        done.append((a, x[0], new))
        return pa.Table.from_batches([_gone(done)])

    return late.groupBy("key", "salt").cogroup(early.groupBy("key", "salt")).applyInArrow(meet, "a long, b long, gone array<int>")


def removed_lines(docs: DataFrame, scratch: Scratch, text_col: str = "text", min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """(uid, gone array<int>, n_partners): lines of each document to delete, places counted from 0.

    Documents with equal texts are not aligned: all lines of all but the first go, which is what an alignment with
    the first would give. What goes of others is what an alignment with every earlier document would take: pairs
    that share a rare line are all aligned; a window of common lines pairs its holders with the first of them, and
    where that leaves the window, with every kind of holder (``align_kinds``). Lists of shared lines alone are
    shuffled, not texts. n_partners counts the earlier documents looked at that lines went by; there may be more.
    """
    text = F.col(text_col)
    keyed = docs.where(text.isNotNull()).select("uid", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), text.rlike(at_least(min_words)).alias("long"))
    keyed = scratch.save(keyed, "texts")
    firsts = scratch.save(keyed.groupBy("t1", "t2").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    later = scratch.save(keyed.join(firsts, ["t1", "t2"]).where((F.col("uid") != F.col("first"))).select("uid", "long"), "later")
    found = postings(docs, text_col, min_words).join(later.select("uid"), "uid", "left_anti")
    small_batches(docs.sparkSession)
    lists, near = line_lists(found, scratch, rare)
    runs = scratch.save(common_runs(lists, min_words), "runs")
    spans = runs.select("uid", F.explode(F.arrays_zip("keys", "spans")).alias("x"), "at").select("uid", F.col("x.keys").alias("key"), F.transform("x.spans", lambda i: F.get("at", i)).alias("span"))
    heads = scratch.save(spans.groupBy("key").agg(F.min("uid").alias("first"), F.max("uid").alias("last")).where(F.col("first") < F.col("last")).select("key", "first"), "heads")
    held = scratch.save(spans.join(heads, "key").where(F.col("uid") != F.col("first")), "held")
    pairs = near.union(held.select(F.col("first").alias("a"), F.col("uid").alias("b"))).distinct()
    aligned = scratch.save(align(pairs, lists, min_words), "aligned")
    so_far = aligned.groupBy(F.col("b").alias("uid")).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("had"))
    had = F.coalesce("had", F.array().cast("array<int>"))
    whole = F.size(F.array_except(F.sequence(F.col("span")[0], F.col("span")[1]), had)) == 0
    left = scratch.save(held.join(so_far.hint("merge"), "uid", "left").where(~whole).select("key", "uid", had.alias("had")).dropDuplicates(["key", "uid"]), "left")
    if not left.isEmpty():
        aligned = aligned.union(align_kinds(left, runs, near, min_words))
    gone = aligned.groupBy(F.col("b").alias("uid")).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"), F.count_distinct("a").alias("n_partners"))
    copies = later.where("long").select("uid", F.array(F.lit(-1)).alias("gone"), F.lit(1).cast("long").alias("n_partners"))
    return gone.union(copies)


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """docs with text as left, n_lines, n_removed and n_partners.

    A later document (greater id) loses the lines that align with an earlier one in blocks of min_words or more;
    lines are compared trimmed of ASCII white space; lines without a word are never removed, but for a copy of an
    earlier text, of which nothing stays. Judged on the input, not on what is left. Null texts have no lines and
    stay null. Repeated or null ids: see ``with_uid``. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    numbered = with_uid(pack(docs, id_col, text_col))
    gone = scratch.save(removed_lines(numbered.select("uid", "text"), scratch, "text", min_words, rare), "gone")
    scratch.release()
    # what goes grows with the documents, so it is never broadcast: the same join at every size
    j = numbered.join(gone.hint("merge"), "uid", "left")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    removed = F.when(F.col("gone").isNull(), 0).when(F.element_at("gone", 1) == -1, n).otherwise(F.size("gone")).cast("long")
    pre = j.select("rest", n.alias("n_lines"), removed.alias("n_removed"), F.coalesce("n_partners", F.lit(0)).cast("long").alias("n_partners"), "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, g in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                if not g or t is None:
                    texts.append(t)
                elif g[0] == -1:
                    texts.append("")
                else:
                    drop = set(g)
                    texts.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(texts, pa.string())], names=[*b.schema.names[:4], "text"])

    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    out = pre.mapInArrow(run, T.StructType([*pre.schema.fields[:4], T.StructField("text", T.StringType())]))
    return unpack(out, docs, text_col, "n_lines", "n_removed", "n_partners")
