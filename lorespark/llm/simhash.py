"""Operator 1: SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, connected_components, pack, small_batches, unpack, with_uid

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Ids (8 bytes each) that deduplicate() broadcasts at most.
SENT_IDS = 2_000_000
_CHUNK = 1 << 16


def simhash64(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 text: ASCII lower case, words between ASCII white space, shingles with repeats.

    A bit is 1 if it is set in over half the shingles' XXH64. Fewer words than a shingle: the whole sequence is
    one shingle; no word: 0. Work is done in bounded chunks, so very long texts need no more memory.
    """
    w = text.lower().split()
    if not w:
        return 0
    grams = zip(*(w[i:] for i in range(shingle)), strict=False) if len(w) >= shingle else iter([w])
    hashes = map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, grams))
    n, ones = 0, np.zeros(64, np.int64)
    while (h := np.fromiter(islice(hashes, _CHUNK), "<u8")).size:
        n += h.size
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long): one row per document, fp the fingerprint's bits as a signed long; a null text has 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash64(t.as_py() or b"") for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[id_col, "fp"])

    return docs.select(id_col, F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def _parts(v, widths: tuple[int, ...]):
    """A 32-bit segment as parts of these widths, lowest first."""
    out, at = [], 0
    for n in widths:
        out.append(F.shiftrightunsigned(v, at).bitwiseAND(F.lit((1 << n) - 1)))
        at += n
    return out


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) to pairs (a, b), each once, that differ in 1 to 2 bits.

    Two segments of 32 bits: two fingerprints within 2 bits agree to 1 bit in the upper segment, or wholly in the
    lower. So the ball of radius 1 about the upper segment and the lower segment itself are looked up. Each
    lookup key also holds a part of the other segment, which by the same argument must agree in one of its
    parts; so a key holds 42 bits or more, and even a crowd of near copies shares few keys. Of two upper
    segments 1 bit apart the smaller sets a bit of its own, so only clear bits are flipped. Complete distances
    are then verified.
    """
    if radius != 2:
        raise ValueError("the segment tables are laid out for a radius of 2")
    up, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    three, two = (11, 11, 10), (16, 16)
    key = lambda kind, seg, part: F.xxhash64(F.lit(kind), seg, part)
    same = [key(i, up, p) for i, p in enumerate(_parts(low, three))] + [key(10 + i, low, p) for i, p in enumerate(_parts(up, three))]
    table = same + [key(20 + i, up, p) for i, p in enumerate(_parts(low, two))]
    clear = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(up, i) == 0)
    set_bit = lambda i: up.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))
    flip = lambda k, p: F.transform(clear, lambda i: key(20 + k, set_bit(i), p))
    flips = [flip(k, p) for k, p in enumerate(_parts(low, two))]
    # 1: an exact part, compared in one order; 2: a flipped bit, found from one side only
    left = classes.select(F.col("fp").alias("a"), F.explode(F.concat(F.array(*same), *flips)).alias("key"))
    right = classes.select(F.col("fp").alias("b"), F.explode(F.array(*table)).alias("key"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = left.join(right, "key").where((F.col("a") != F.col("b")) & (apart <= radius))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest id reachable over links of 2 bits or fewer.

    Copies share a fingerprint and are one node, so a group of any size costs one. Texts that are null, empty or
    white space have fingerprint 0 and link like any other. Null ids keep a row; they never are a component's
    id unless it holds nothing else. An empty table gives an empty result; other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fp = scratch.save(fingerprints(docs, id_col, text_col), "fp")
    classes = scratch.save(fp.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    roots = connected_components(links(classes), scratch)
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.save(rooted, "rooted")
    ids = scratch.save(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = scratch.save(rooted.join(ids, "root").select("fp", "component_id"), "named")
    return fp.join(named, "fp").select(id_col, "fp", "component_id")


def hex16(fp: str = "fp"):
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep the document with the smallest id of each group, all columns; of rows equal in id and text, one.

    The ids that go are sent to the documents while there are at most ``SENT_IDS`` of them, so whole texts aren't
    shuffled; beyond that, documents meet the ids that stay in a shuffled join. Where ids are null or repeated, rows are numbered
    by id and text (null ids last), and one number of each group stays, so unlike texts that share an id both do.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    found = scratch.save(near_duplicates(docs, id_col, text_col), "groups")
    stays = F.col(id_col).eqNullSafe(F.col("component_id"))
    n, known, distinct, gone = found.agg(F.count(F.lit(1)), F.count(id_col), F.count_distinct(id_col), F.count_if(~stays)).first()
    if n == known == distinct:
        if gone <= SENT_IDS:
            ids = scratch.save(found.where(~stays).select(F.col(id_col).alias("_goes")), "gone")
            return docs.join(F.broadcast(ids), docs[id_col] == ids["_goes"], "left_anti")
        ids = scratch.save(found.where(stays).select(F.col(id_col).alias("_stays")), "stay")
        return docs.join(ids, docs[id_col] == ids["_stays"], "left_semi")
    numbered = with_uid(pack(docs, id_col, text_col))
    order = F.when(F.col("doc_id").isNull(), F.col("uid") + (1 << 62)).otherwise(F.col("uid"))  # null ids last
    numbered = numbered.withColumn("uid", order)
    again = near_duplicates(numbered.select("uid", "text"), "uid", "text")
    ids = scratch.save(again.where(F.col("uid") == F.col("component_id")).select(F.col("uid").alias("_stays")).distinct(), "stay")
    return unpack(numbered.join(ids, F.col("uid") == F.col("_stays"), "left_semi").dropDuplicates(["uid"]), docs, text_col)
