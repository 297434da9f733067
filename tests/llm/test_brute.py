"""Every operator against a brute-force version, on small hand-made tables and on whole small tables."""

import collections
import hashlib
import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from lorespark.llm import decontaminate, html, lines, mixing, passages, quality, rules, simhash, sstable, tokens

SF = "/root/testdata/sf0.001"
TRICKY = [
    (0, "", "en", "a"), (1, None, "en", "a"), (2, "   \n\t ", None, "a"), (3, "One", "en", None), (4, "one two", "de", "b"), (5, "ONE two", "de", "b"),
    (6, "a b c d e f g", "fr", "b"), (7, "a b c d e f g", "fr", "b"), (8, "\x1c x\xa0y   z\x85 été \U0001f600 中文", "fr", "é"), (9, "x" * 5000, "en", "z"), (10, "ab " * 3000, "en", "z"),
    (11, "<|endoftext|> <|startoftext|>don't it's WE'LL 12345 á ẞİ", "en", "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def rand_docs(seed=3, n=120):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)]
    para = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [para(40) for _ in range(4)]
    out = []
    for i in range(n):
        kind = r.random()
        text = "\n".join(para(r.randint(3, 30)) for _ in range(r.randint(1, 6)))
        if kind < 0.2 and out:
            text = r.choice(out)[1]
        elif kind < 0.5 and out:
            w = (r.choice(out)[1] or "x").split(" ")
            w[r.randrange(len(w))] = r.choice(vocab)
            text = " ".join(w)
        elif kind < 0.7:
            text = text + "\n" + r.choice(shared) + "\n" + para(5)
        elif kind < 0.75:
            text = text + "ha" * 150 + text
        out.append((i * 3 % 113, text, r.choice(["en", "de"]), r.choice(["s1", "s2", None])))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1000 + i, *x[1:]) for i, x in enumerate(rand_docs())] + TRICKY
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


# ---- 1


def slow_simhash(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fp):
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("which", ["docs", "real"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    got = simhash.near_duplicates(df).select("doc_id", simhash.hex16().alias("fingerprint"), "component_id").collect()
    want = {i: slow_simhash(t) for i, t in texts(df).items()}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{v:016x}" for i, v in want.items()}
    assert {r.doc_id: r.component_id for r in got} == slow_components(want)


def test_links_are_complete(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = set()
    for b in base:
        fps.add(b)
        for _ in range(30):
            fps.add(b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 4))))
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    want = {tuple(sorted((signed(x), signed(y)))) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= 2}
    assert got == want and want


def test_components_of_a_long_chain(spark):
    from lorespark.llm.common import Scratch, connected_components

    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101)] + [(200, i) for i in range(201, 240)]
    random.Random(1).shuffle(edges)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect())
    assert got == {**dict.fromkeys(range(1, 61), 0), 101: 100, 103: 100, **dict.fromkeys(range(201, 240), 200)}


def test_dedup_keeps_columns(spark):
    rows = [(5, "a b c d", 1), (5, "a b c d", 1), (7, "a b c d", 2), (8, "q w e r t", 3), (None, "zz yy xx", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _stays int")
    out = simhash.deduplicate(df)
    assert out.columns == df.columns and sorted(x.doc_id or -1 for x in out.collect()) == [-1, 5, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_dedup_of_unlike_texts_that_share_an_id(spark):
    rows = [(5, "a b c d", 1), (5, "q w e r t", 2), (7, "a b c d", 3), (None, "zz yy xx", 4), (None, "uu vv ww", 5), (None, "q w e r t", 6)]
    out = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, source int"))
    assert sorted(x.source for x in out.collect()) == [1, 2, 4, 5]


def test_mixing_keeps_sources_of_equal_texts(spark):
    import corpus_pipeline

    rows = [(1, "w " * 10, "en", "a"), (1, "w " * 10, "en", "b"), (None, "v " * 10, "en", "a"), (None, "v " * 10, "en", "b")]
    taken = lambda d: collections.Counter(r.source for r in d.collect())
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.source: r.n for r in mixing.mix(df).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    assert taken(corpus_pipeline.mixing_sources(spark, df, "")) == want and set(want) == {"a", "b"}


# ---- 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="article-page">
<header><h1>Site of the name</h1><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies and this is a notice for all of the readers of it.</div>
{open}<h1>A title</h1><p>First paragraph &amp; the rest of it, with <b>bold</b> and <a href="x">a link</a> in the middle of the text.
More of the same.</p><p>Short.</p><div class="ad">Buy this now and it is the best of all.</div><form>Subscribe to the letter <input></form>
<p>Last one &lt;tag&gt; caf&eacute; of the day that was.</p>{close}
<section id="comments"><p>I think that this is a comment and it is not of the article at all, really.</p></section>
<aside><p>Related: the other of the things.</p></aside><footer>&copy; the owner of this</footer></body></html>"""
WANT = "A title\n\nFirst paragraph & the rest of it, with bold and a link in the middle of the text. More of the same.\n\nShort.\n\nLast one <tag> café of the day that was."


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ("<div role='main'>", "</div>")])
def test_html_layouts(tags):
    assert html.main_text(PAGE.format(open=tags[0], close=tags[1])) == WANT


def test_html_plain_page_by_density():
    body = "This is the story of a man who was in the house and it was the best that he had for all of his life, and there he would be with them. " * 2
    page = f"<body><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul><h2>Head of it</h2><p>{body}</p><p>Yes.</p><p>{body}</p><div><a href=c>More</a> <a href=d>Links</a></div></body>"
    assert html.main_text(page) == "\n\n".join(["Head of it", body.strip(), "Yes.", body.strip()])


PROSE = "This is the story of a man who was in the house and it was the best that he had for all of his life there. " * 2


@pytest.mark.parametrize(
    "body, want",
    [
        # no article: prose by density, a long list of names has none, short lines follow their neighbours
        (f"<p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p><div>{'Alpha Beta Gamma Delta ' * 6}</div><div>More</div>", [PROSE, "Yes.", PROSE]),
        # within an article: links make a list bad, and what stands between two such lists; a list of names at prose stays
        (f"<article><p>{PROSE}</p><p>{'Alpha Beta Gamma Delta ' * 6}</p><ul><li><a href=x>One thing</a></li></ul><p>Oslo Bergen</p><ul><li><a href=y>Two things</a></li></ul></article>", [PROSE, "Alpha Beta Gamma Delta " * 6]),
        # an article without stop words has nothing decided, and stays
        (f"<article><p>{'Qwe Rtz Uio ' * 9}</p><p>Asd</p></article><p>{PROSE}</p>", ["Qwe Rtz Uio " * 9, "Asd"]),
        # an unknown language is judged by length and links
        (f"<p>{'сегодня мы увидели новый город и старую реку ' * 6}</p><div><a href=x>дом</a></div>", ["сегодня мы увидели новый город и старую реку " * 6]),
        # comments in articles of their own
        (f"<main><article><p>{PROSE}</p></article><article class='comment by-me'><p>{PROSE}</p></article></main>", [PROSE]),
        # a notice put into an article says nothing about the line after it
        (f"<article><p>{PROSE}</p><div class=promo>Buy it now</div><p>The end of it.</p></article>", [PROSE, "The end of it."]),
    ],
)
def test_html_rules(body, want):
    assert html.main_text(f"<html><body><nav><a href=a>Home</a></nav>{body}<footer>All rights</footer></body></html>") == "\n\n".join(x.strip() for x in want)


def test_html_density_decides(monkeypatch):
    page = f"<body><p>{PROSE}</p><div>{'Alpha Beta Gamma Delta ' * 9}</div><p>{PROSE}</p></body>"
    with_words = html.main_text(page)
    monkeypatch.setattr(html, "STOP_WORDS", frozenset())
    assert "Alpha" not in with_words and "Alpha" in html.main_text(page)


def test_html_time_is_linear():
    import time

    def took(k):
        began = time.process_time()
        html.main_text("<b>" * k + "x</i>" * k + "<div>" * k + "</u>" * k + "<p>y" * k)
        return time.process_time() - began

    took(1000)
    assert took(32_000) < 40 * max(took(2000), 0.005)


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- x", "<article><p>a &am", "</p></div>", "<script>x", "<a href='", "&#0;&#xD800;", "<p>" * 3000 + "x"])
def test_html_torn(page):
    assert isinstance(html.main_text(page), str)


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Hi the\n you</p></article>", 3), (None, None, None, 4)], "page_id long, url string, html string, text int")
    assert [tuple(r) for r in html.extract(df).collect()] == [(1, "u", "Hi the you", 10), (None, None, "", 0)]
    again = df.union(df).union(spark.createDataFrame([(7, "v", f"<article><p>{'word and the ' * 100_000}</p></article>", 1)], df.schema))
    assert sorted(r.n_chars for r in html.extract(again).collect()) == [0, 0, 10, 10, 13 * 100_000 - 1]
    assert html.extract(df.limit(0)).count() == 0


# ---- 3, 5


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


@pytest.mark.parametrize("which", ["docs", "real"])
def test_tokens(which, request):
    df = request.getfixturevalue(which)
    lib, all_texts = library(), texts(df)
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in all_texts.items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df).collect()}
    assert got == {i: (len((all_texts[i] or "").encode()), len(v), len(v) > 2048) for i, v in ids.items()}
    start, want = 0, {}
    for i in sorted(ids):
        v = [*ids[i], 2]
        want[i] = (start, len(v), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in v)))
        start += len(v)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in sstable.token_table(df).collect()} == want


def test_proven_tokens_are_single():
    enc = tokens.encoder(tokens.tokenizer_path())
    assert enc.separable and len(enc.proven) > 20_000
    assert all(len(enc.lib.encode(s, add_special_tokens=False).ids) == 1 for s in random.Random(2).sample(sorted(enc.proven), 500))


def test_repeated_and_null_ids(spark):
    rows = [(3, "a"), (3, "b"), (3, "a"), (None, "zz"), (-5, "q")]
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in sstable.token_table(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, None, 2), (2, -5, 2), (4, 3, 2), (6, 3, 2), (8, 3, 2)]
    assert sstable.token_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block", [40, 1 << 16])
def test_shard_lookup(block):
    r = random.Random(4)
    keys = sorted({r.randint(-(10**12), 10**12) for _ in range(500)})
    pairs = [(sstable.pack_key(k), sstable.pack_ids(sstable.np.array([r.getrandbits(r.choice([9, 32])) for _ in range(r.randint(0, 9))], "u4"))) for k in keys]
    shard = sstable.Shard(b"".join(x + b"\n" for x in sstable.write_shard(pairs, block)))
    assert [(k, bytes(v)) for k, v in shard.scan()] == pairs and shard.entries == len(pairs)
    assert all(sstable.pack_ids(shard.get(k)) == v for k, v in pairs)
    missing = [sstable.pack_key(k + 1) for k in keys if k + 1 not in keys]
    assert all(shard.get(k) is None for k in missing) and sum(map(shard.maybe, missing)) < 0.05 * len(missing)
    torn = b"".join(x + b"\n" for x in sstable.write_shard(pairs, block))[:-3]
    with pytest.raises(ValueError):
        sstable.Shard(torn)


# ---- 4


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(d, lab).join(lab, "doc_id").where("held_out").collect()
    pos, neg = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.98 and sum((r.score >= 0.5) == (r.quality == 1) for r in got) / len(got) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_quality_edges(spark, docs):
    lab = spark.createDataFrame([(1000 + i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, lab).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[6].score == got[7].score
    assert {r.score for r in quality.classify(docs, lab.limit(0)).collect()} == {0.5}
    kept = quality.filter_quality(docs.withColumn("score", F.lit("x")).withColumn("rest", F.lit(1)), lab)
    assert kept.columns == [*docs.columns, "score", "rest"] and kept.count() == sum(r.predicted for r in got.values())
    assert quality.classify(docs.limit(0), lab).count() == 0


def test_quality_of_repeated_ids_and_long_texts(spark):
    """An id on many rows counts once in the sample, whatever its texts."""
    r = random.Random(1)
    prose = lambda: " ".join(r.choice(["the", "of", "and", "house", "river", "walked", "slowly", "to"]) for _ in range(r.randint(40, 90)))
    junk = lambda: " ".join(r.choice(["$$$", "a|b", "###", "99%"]) for _ in range(r.randint(40, 90)))
    rows = [(7, prose()) for _ in range(3000)] + [(100 + i, junk() if i % 4 == 0 else prose()) for i in range(400)] + [(None, junk()), (9, prose() * 3000), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(100 + i, int(i % 4 != 0), 0) for i in range(0, 400, 3)], "doc_id long, quality int, toxic int")
    out = quality.classify(df, lab).collect()
    assert len(out) == len(rows) and len({x.score for x in out if x.doc_id == 8}) == 1
    good = {x.doc_id: x.predicted for x in out}
    right = [good[100 + i] == (i % 4 != 0) for i in range(400)]
    assert sum(right) > 390 and good[9] == 1 and good[None] == 0


def test_prior_is_estimated():
    import numpy as np

    rng = np.random.default_rng(3)
    d = quality.Featurizer.size()
    for prior in (0.3, 0.6, 0.9):
        n = 4000
        is_pos = rng.random(n) < prior
        x = rng.normal(0, 1, (n, d)).astype(np.float32)
        x[:, :3] += np.where(is_pos, 2.5, -2.5)[:, None]
        p = rng.normal(0, 1, (1500, d)).astype(np.float32)
        p[:, :3] += 2.5
        assert abs(quality.estimate_prior(p, x) - prior) < 0.05


def test_last_words_are_in_a_span():
    import numpy as np

    f = quality.Featurizer()
    assert not np.array_equal(f("the house " * 20 + "of it " * 9 + "a")[11:33], f("the house " * 20 + "of it " * 4 + "$$$ " * 10 + "###")[11:33])


# ---- 6


def test_mix(spark, docs):
    m = mixing.mix(docs)
    rows = m.collect()
    assert len(rows) == docs.count()
    size = {i: len((t or "").encode().split()) for i, t in texts(docs).items()}
    assert {r.doc_id: r.size for r in rows} == size
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    total, target = sum(size.values()), dict.fromkeys(by, 0.0)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    cap = {s: 3 * sum(r.size for r in by[s]) for s in by}
    open_, left = set(by), float(total)
    while True:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > cap[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
        open_ -= over
    for s, part in by.items():
        assert part[0].target == pytest.approx(target[s]) and part[0].source_size == cap[s] / 3
        assert abs(sum(r.taken for r in part) - target[s]) <= max(r.size for r in part)
        assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) and max(0, r.copies) <= 3 for r in part)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)


def test_mix_spreads_null_and_repeated_ids(spark):
    rows = [(None, f"w{i} of it", "en", "a") for i in range(900)] + [(5, f"v{i} of it", "en", "a") for i in range(900)] + [(i, f"u{i} of it", "en", None) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("x"))
    assert mixing.weigh(df, "doc_id", "source", "text").select(F.pmod("_o", F.lit(43)).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0] < 120
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and abs(sum(r.taken for r in out) - 3 * len(rows)) <= 6


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a", "b", "c"] * 400)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    p = mixing.positions(m).collect()
    by = collections.defaultdict(list)
    for r in p:
        assert 0 <= r.position <= 1
        by[r.source].append(r.position)
    early = {s: sum(x < 0.5 for x in v) / len(v) for s, v in by.items()}
    # ramps +0.5, 0, -0.5: half time sees (1 - r) / 2 + r / 4 of the demand
    assert early["a"] == pytest.approx(0.375, abs=0.01) and early["b"] == pytest.approx(0.5, abs=0.01) and early["c"] == pytest.approx(0.625, abs=0.01)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


# ---- 7


def test_patience_aligns_common_lines():
    r = random.Random(8)
    for _ in range(300):
        a, b = [r.randint(0, 12) for _ in range(r.randint(0, 14))], [r.randint(0, 12) for _ in range(r.randint(0, 14))]
        got = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    assert len(lines.patience(list(range(50)), list(range(50)))) == 50


def slow_align(a, b):
    """Patience diff by recursion and a quadratic longest increasing subsequence."""
    head = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    out = [(k, k) for k in range(head)]
    a, b = a[head:], b[head:]
    tail = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
    out += [(head + len(a) - 1 - k, head + len(b) - 1 - k) for k in range(tail)]
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    both = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == b.count(x) == 1]
    best = []
    for i, (_, y) in enumerate(both):
        best.append(1 + max([best[k] for k in range(i) if both[k][1] < y], default=0))
    chain, need, last = [], max(best, default=0), len(both)
    while need:
        last = max(k for k in range(last) if best[k] == need)
        chain.append(both[last])
        need -= 1
    if chain:
        marks = [(-1, -1), *chain[::-1], (len(a), len(b))]
        out += [(head + i, head + j) for i, j in chain]
        for (i0, j0), (i1, j1) in zip(marks, marks[1:], strict=False):
            out += [(head + i0 + 1 + i, head + j0 + 1 + j) for i, j in slow_align(a[i0 + 1 : i1], b[j0 + 1 : j1])]
    return sorted(out)


def slow_lines(rows, min_words=5):
    """Every later text aligned with every earlier one, on the lines that both have."""
    cut = {i: [x.strip(" \t\n\r\x0b\x0c") for x in (t or "").split("\n")] for i, t in rows.items()}
    first, out = {}, {}
    for i, t in sorted(rows.items()):
        first.setdefault(t, i)
    unlike = sorted(i for i, t in rows.items() if t is not None and first[t] == i)
    sets = {i: set(cut[i]) - {""} for i in unlike}
    gone = collections.defaultdict(set)
    for k, b in enumerate(unlike):
        for a in unlike[:k]:
            both = sets[a] & sets[b]
            if not both:
                continue
            pa, pb = ([p for p, x in enumerate(cut[d]) if x in both] for d in (a, b))
            pairs = {pb[j]: pa[i] for i, j in slow_align([cut[a][p] for p in pa], [cut[b][p] for p in pb])}
            for start in pairs:
                if pairs.get(start - 1, -9) == pairs[start] - 1:
                    continue
                run = [start]
                while pairs.get(run[-1] + 1, -9) == pairs[run[-1]] + 1:
                    run.append(run[-1] + 1)
                if sum(len(cut[b][p].encode().split()) for p in run) >= min_words:
                    gone[b].update(run)
    for i, t in rows.items():
        if t is not None and first[t] != i:
            out[i] = (len(t.split("\n")), "") if len(t.encode().split()) >= min_words else (0, t)
        else:
            out[i] = (len(gone[i]), None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]))
    return out


@pytest.mark.parametrize("which", ["docs", "real"])
def test_lines(which, request):
    df = request.getfixturevalue(which).withColumn("uid", F.lit("mine")).withColumn("gone", F.lit(0))
    out = lines.deduplicate_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed", "n_partners"]
    got = {r.doc_id: (r.n_removed, r.text) for r in out.collect()}
    assert got == slow_lines(texts(df)) and any(n for n, _ in got.values())


def test_common_line_goes_from_all_but_the_first(spark):
    boiler = "all rights are reserved by the owner of this"
    rows = [(i, f"own line number {i} here it is\n{boiler}") for i in range(40)]
    got = {r.doc_id: r.text for r in lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t if not i else t.split("\n")[0] for i, t in rows}
    assert lines.deduplicate_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def removed(spark, rows, **kw):
    out = lines.deduplicate_lines(spark.createDataFrame(sorted(rows.items()), "doc_id long, text string"), **kw)
    return {r.doc_id: (r.n_removed, r.text) for r in out.collect()}


def test_a_crowded_line_between_rare_ones(spark):
    rows = {1: "alpha beta\nsee page two\ngamma delta\nown", 2: "hers\nalpha beta\nsee page two\ngamma delta", **{i: f"see page two\nof {i}" for i in range(10, 19)}}
    got = removed(spark, rows)
    assert got == slow_lines(rows) and got[2][0] == 3


def test_lines_with_odd_ids(spark):
    boiler = "all rights are reserved by the owner of this"
    rows = [(None, f"{boiler}\nx"), (None, f"y\n{boiler}"), (4, f"{boiler}\nz"), (4, f"{boiler}\nz"), (4, f"q\n{boiler}"), (9, None), (9, "")]
    out = lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 7 and sum(boiler in (r.text or "") for r in out if r.doc_id is None) == 1
    assert not any(boiler in (r.text or "") for r in out if r.doc_id == 4)


def test_block_of_common_lines_goes(spark):
    rows = {1: "a one two\nmine here", 2: "b one two\nhers here", **{i: f"a one two\nb one two\nown {i}" for i in range(10, 21)}}
    assert removed(spark, rows) == slow_lines(rows) and removed(spark, rows)[20][0] == 2
    near = {i: f"so it is\nhead of {i // 2} in full words\nso it is\nand {i}" for i in range(24)}
    assert removed(spark, near) == slow_lines(near) and removed(spark, near)[23][0] == 3
    # the first holder has the blocks in another order, a later one has each by itself
    p, q = "p one two\np three four five", "q one two\nq three four"
    cross = {0: f"{p}\n{q}", 1: f"{p}\nx", 2: f"{q}\ny", **{i: f"{q}\n{p}\n{i}" for i in range(3, 16)}}
    assert removed(spark, cross) == slow_lines(cross) and removed(spark, cross)[15][0] == 4


@pytest.mark.parametrize("rare, seed", [(1, 1), (3, 2), (8, 3)])
def test_lines_of_slow_lines(spark, rare, seed):
    r = random.Random(seed)
    stock = [" ".join(f"w{k}" for _ in range(r.randint(1, 6))) for k in range(14)]
    rows = {i: "\n".join(r.choice([*stock, *stock[:3], f"own {i}", f"near {i // 3} of it", ""]) for _ in range(r.randint(1, 9))) for i in range(90)}
    assert removed(spark, rows, rare=rare) == slow_lines(rows)


# ---- 8


def slow_counts(t):
    import re

    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    mark = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(mark)


@pytest.mark.parametrize("which", ["docs", "real"])
def test_rules(which, request):
    import math

    import numpy as np

    df = request.getfixturevalue(which)
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    rows = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(rows)
    counts = {i: slow_counts(r.text) for i, r in rows.items()}
    failed = {i: c[0] < 50 or 100 * c[4] > 50 * c[0] for i, c in counts.items()}
    measure = lambda c: ((c[2] + 1) / (c[0] + 20), c[1] / c[0], (c[3] + 1) / (c[0] + 20), (c[4] + 1) / (c[0] + 20))
    gamma = 1.01 / 0.99

    def quartiles(vals):
        b = sorted(math.ceil(round(math.log(v) / math.log(gamma), 6)) for v in vals)
        return [2 * gamma ** b[max(0, math.ceil(q * len(b)) - 1)] / (gamma + 1) for q in (0.25, 0.75)] if b else [0, 0]

    def fences(i):
        r = rows[i]
        sets = [list(rows), [j for j in rows if rows[j].lang == r.lang], [j for j in rows if (rows[j].lang, rows[j].source) == (r.lang, r.source)]]
        sets = [[j for j in s if not failed[j]] for s in sets]
        out = []
        for k in range(4):
            lo, hi = quartiles([measure(counts[j])[k] for j in sets[0]])
            for s in sets[1:]:
                a, b = quartiles([measure(counts[j])[k] for j in s])
                lo, hi = (len(s) * a + 100 * lo) / (len(s) + 100), (len(s) * b + 100 * hi) / (len(s) + 100)
            out.append((lo * (lo / hi) ** 5, hi * (hi / lo) ** 5) if k in (1, 3) else (lo - 5 * (hi - lo), hi + 5 * (hi - lo)))
        return out

    for i, r in got.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts[i]
        assert r.base_failed == failed[i]
        want = False
        if not failed[i]:
            f, m = fences(i), measure(counts[i])
            want = all(x <= hi + 1e-9 for x, (_, hi) in zip(m, f, strict=True)) and m[1] >= f[1][0] - 1e-9
        assert r.kept == want, i
    assert np.mean([r.kept for r in got.values() if not r.base_failed]) > 0.8


def test_rules_adapt_to_a_source(spark):
    """Formulas are the rule in one source, and an outlier in the other; a small source leans on its language."""
    r = random.Random(12)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    text = lambda share: " ".join(r.choice(vocab) + ("$" if r.random() < share else "") for _ in range(r.randint(60, 400)))
    rows = [(i, text(0.0), "en", "news") for i in range(600)] + [(1000 + i, text(r.uniform(0.1, 0.3)), "en", "maths") for i in range(600)]
    rows += [(2000, text(0.2), "en", "news"), (2001, text(0.2), "en", "maths"), (2002, "", "en", None), (2003, None, None, None), (None, text(0.0), "en", "news")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit("x"))
    out = rules.judge(df).collect()
    kept = {r.doc_id: r.kept for r in out}
    assert len(out) == len(rows) and kept[None] and not kept[2000] and kept[2001] and not kept[2002] and not kept[2003]
    assert sum(kept[i] for i in range(600)) > 590 and sum(kept[1000 + i] for i in range(600)) > 590
    assert rules.judge(df.limit(0)).count() == 0


# ---- 9


def edit_best(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        cur = [i]
        for j, d in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (c != d), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_myers_and_pieces():
    r = random.Random(6)
    for _ in range(150):
        item = "".join(r.choice("abcd ") for _ in range(r.randint(1, 90)))
        text = "".join(r.choice("abcd ") for _ in range(r.randint(0, 60))) + "".join(c for c in item if r.random() > 0.08) + "".join(r.choice("abcd ") for _ in range(r.randint(0, 60)))
        assert decontaminate.Peq(item).best(text, len(item))[0] == min(edit_best(item, text), len(item))


def test_decontamination_matches_brute_force(spark):
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.randint(5, 25)).capitalize() + ".") for i in range(12)] + [(50, "tiny one"), (51, None), (52, "..."), (53, ""), (54, "abcdefghij klm"), (55, "some short item of it")]
    rows = []
    for d in range(60):
        t = say(20)
        if r.random() < 0.7:
            x = list(r.choice(items[:12])[1])
            for _ in range(r.randint(0, int(len(x) * 0.15))):
                k = r.randrange(len(x))
                x[k : k + 1] = r.choice([[], [r.choice("abcdefghij")], [x[k], r.choice("abcdefghij")]])
            t += "\n" + "".join(x).upper() + " " + say(10)
        rows.append((d, t))
    rows += [(100, "A tiny\n one, here"), (101, "atiny one"), (102, None), (103, ""), (104, "say abcdefghj klm"), (105, "say abcdefgh klm"), (106, "so shrt item of itt"), (107, "sme shrt itm of itt")]
    got = {x.doc_id: dict(zip(x.item_ids, x.distances, strict=True)) for x in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in rows:
        n = decontaminate.normalise(t)
        want[d] = {}
        for i, s in items:
            c = decontaminate.normalise(s).strip()
            if not c or t is None:
                continue
            k = decontaminate.budget(len(c))
            dist = edit_best(c, n) if k else 0 if f" {c} " in n else 99
            if dist <= k:
                want[d][i] = dist
    assert got == want and sum(map(len, want.values())) > 20
    blocks = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=300)
    assert {x.doc_id: dict(zip(x.item_ids, x.distances, strict=True)) for x in blocks.collect()} == want


@pytest.mark.parametrize("block", [10**6, 60])
def test_decontamination_by_odd_ids(spark, block):
    say = "the capital of the land was moved to the old town on the river"
    items = [("x-1", "nothing like it in any of these texts at all"), ("x-2", say), ("x-2", say[:-5] + "rivor"), (None, say), ("x-10", say.replace("land", "lend"))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [(None, say), (None, f"so {say} so"), (3, "clean"), (3, say.upper()), (3, None), (9, "long " * 200_000 + say)]
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_ids", F.lit(0)).withColumn("uid", F.lit(0)), bench, keep=True, block_chars=block)
    assert found.columns == ["doc_id", "text", "item_ids", "uid", "item_ids", "distances"]
    got = sorted((len(r[1] or ""), r[4], r[5]) for r in found.collect())
    hit = (["x-10", "x-2"], [1, 0])
    assert got == [(0, [], []), (5, [], []), (len(say), *hit), (len(say), *hit), (len(say) + 6, *hit), (10**6 + len(say), *hit)]
    assert decontaminate.contaminated(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0


def test_decontaminate_keeps_columns(spark, real):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    df = real.withColumn("item_ids", F.lit(1)).withColumn("REST", F.lit(2))
    out = decontaminate.decontaminate(df, bench)
    flags = {r.doc_id: r.contaminated for r in decontaminate.contaminated(real, bench).collect()}
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {i for i, c in flags.items() if not c}
    assert any(flags.values()) and decontaminate.contaminated(real, bench.limit(0)).where("contaminated").count() == 0


# ---- 10


def slow_passages(rows):
    seen, out = {}, {}
    for i in sorted(rows):
        b = (rows[i] or "").encode()
        mark = bytearray(len(b) + 1)
        for s in range(len(b) - 99):
            x = b[s : s + 100]
            if x in seen:
                mark[s : s + 100] = b"\1" * 100
            else:
                seen[x] = (i, s)
        kept = bytes(c for c, m in zip(b, mark, strict=False) if not m)
        runs = sum(1 for k in range(len(b)) if mark[k] and (not k or not mark[k - 1]))
        out[i] = (len(b), sum(mark), runs, kept)
    return out


@pytest.mark.parametrize("group", [3, 400])
@pytest.mark.parametrize("which", ["docs", "real"])
def test_passages(which, group, request, monkeypatch):
    monkeypatch.setattr(passages, "GROUP", group)
    df = request.getfixturevalue(which)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in passages.remove_repeats(df).collect()}
    want = slow_passages(texts(df))
    assert {i: v[:3] for i, v in got.items()} == {i: v[:3] for i, v in want.items()}
    assert got == want and any(v[1] for v in want.values())


def test_anchor_steps_agree(monkeypatch):
    import numpy as np

    r = random.Random(7)
    parts = [bytes(r.choice(b"ab") for _ in range(r.choice([0, 5, 99, 100, 101, 700]))) for _ in range(40)]
    data, bounds = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    read = lambda: [tuple(int(c[i]) for c in x) for x in passages.anchors(data, bounds) for i in range(len(x[0]))]
    whole = read()
    monkeypatch.setattr(passages, "STEP", 333)
    assert read() == whole
    places = collections.defaultdict(list)
    for t, p, *_ in whole:
        places[t].append(p)
    for t, b in enumerate(parts):  # every string holds an anchor
        assert all(any(s <= p <= s + 76 for p in places[t]) for s in range(len(b) - 99))


def test_longest_previous_factors():
    """Of a plain text, by its suffix array and by definition."""
    import numpy as np

    r = random.Random(4)
    for n in (0, 1, 2, 7, 60):
        for _ in range(30):
            t = "".join(r.choice("ab") for _ in range(n))
            sa = sorted(range(n), key=lambda i: t[i:])
            pre = lambda i, j: next((k for k in range(n) if t[i + k : i + k + 1] != t[j + k : j + k + 1] or i + k >= n or j + k >= n), n)
            lcp = [0] + [pre(i, j) for i, j in zip(sa, sa[1:], strict=False)]
            got = passages.longest_previous(np.array(sa, np.int64), np.array(lcp[:n], np.int32))
            assert [int(x) for x in got] == [max((pre(i, j) for j in range(i)), default=0) for i in sa]


def test_passages_edges(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away from all of them in the night of the day 0123456789"
    rows = [(5, long + " end"), (5, long + " end"), (5, "start " + long), (None, long), (9, None)]
    got = sorted((r.doc_id or -1, r.n_removed) for r in passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [g for g in got if g[0] == 9] == [(9, 0)] and len(got) == 5 and got[0] == (-1, 0)
    assert passages.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([(1, long * 2000, 1, 2, 3), (2, long, 1, 2, 3)], "doc_id long, text string, uid int, t int, spans int")
    assert [r.n_removed for r in passages.remove_repeats(clash).orderBy("doc_id").collect()] == [len(long) * 1999, len(long)]
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_memo_may_be_small(monkeypatch, docs):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "MEMO", 5)
    enc = tokens.Encoder(tokens.tokenizer_path())
    some = [*texts(docs).values(), "ΑΣ ας Å e\u0301 \u212b ﬁ ǅ İstanbul naïve<|endoftext|>x \xad a\x1fb ªº ½ ²", "it's 'sort o'clock''s \"'ll", None, ""]
    want = [enc.lib.encode(t or "", add_special_tokens=False).ids for t in some]
    for part in (slice(None), slice(3, 9), slice(0, 0)):
        column = pa.array(some, pa.string())[part]
        flat, starts = enc.encode(column)
        assert [flat[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == want[part]
        assert enc.count(column).tolist() == [len(x) for x in want[part]]


def test_dedup_beyond_the_broadcast(spark, docs, monkeypatch):
    want = sorted(r.doc_id for r in simhash.deduplicate(docs).collect())
    monkeypatch.setattr(simhash, "SENT_IDS", 0)
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == want and len(want) < docs.count()


# ---- pipeline


def slow_pipeline(docs, good, items):
    """The five stages, document by document: (doc_id, start, n_tokens, ids_crc32) of the rows written."""
    left = {i: x for i, x in docs.items() if good[i]}
    comp = slow_components({i: slow_simhash(t) for i, (t, _) in left.items()})
    left = {i: x for i, x in left.items() if comp[i] == i}

    def leaks(t):
        n = decontaminate.normalise(t)
        return any(edit_best(c, n) <= len(c) // 10 for c in (decontaminate.normalise(x).strip() for x in items))

    left = {i: x for i, x in left.items() if x[0] is None or not leaks(x[0])}
    by = collections.defaultdict(list)
    for i, (t, s) in left.items():
        by[s].append((i, len((t or "").encode().split()), t or ""))
    names = sorted((s for s in by if s is not None), key=str.encode) + [None] * (None in by)
    size = {s: sum(x[1] for x in by[s]) for s in names}
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(size.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] if s in over else level * weight[s] for s in (over or open_)}
        rest -= sum(target[s] for s in over)
        open_ -= over or open_
    copies = collections.Counter()
    for s in names:
        digest = lambda x: int(hashlib.md5(f"{x[0]}|{hashlib.md5(x[2].encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
        n = next(k for k in range(1, 10**6) if k * k >= len(by[s]))
        upto = 0
        for x in sorted(by[s], key=lambda x: (digest(x) % n, digest(x))):
            room = target[s] - upto - x[1] / 2
            copies[x[0]] = min(3, int(room // size[s]) + 1) if x[1] and room >= 0 else 0
            upto += x[1]
    lib, start, out = library(), 0, []
    for i in sorted(left):
        for _ in range(copies[i]):
            ids = [*lib.encode(left[i][0] or "", add_special_tokens=False).ids, 2]
            out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
            start += len(ids)
    return out


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(21)
    rows = [(i, t, lang, s) for i, t, lang, s in {x[0]: x for x in rand_docs(17, 70)}.values()]
    junk = [(500 + i, " ".join(r.choice(["$$$", "a|b", "###", "9%"]) for _ in range(60)), "en", "s1") for i in range(20)]
    items = [" ".join(r.choice(["house", "river", "mountain", "letter", "winter", "garden"]) for _ in range(9)) for _ in range(4)]
    rows += [(600 + k, f"{rows[k][1]}\n{x[:30]}x{x[31:]}", "en", "s2") for k, x in enumerate(items)] + junk + [(700, "", "en", "s1"), (701, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    lab = spark.createDataFrame([(x[0], int(x[0] < 500), 0) for x in rows if x[0] < 600], "doc_id long, quality int, toxic int")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = {x.doc_id: x.predicted == 1 for x in quality.classify(df, lab).collect()}
    assert not any(good[x[0]] for x in junk) and sum(good.values()) > 40
    got = sorted(tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    want = slow_pipeline({x[0]: (x[1], x[3]) for x in rows}, good, items)
    assert got == sorted(want) and want and not {x[0] for x in want} & {600, 601, 602, 603}


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_tables(spark, tmp_path, k):
    """Null and repeated ids, null and empty and long texts, clashing columns, no rows."""
    import corpus_pipeline

    rows = [(1, "a plain text of some words " * 4, "en", "s"), (1, "a plain text of some words " * 4, "en", "s"), (1, "another one that is quite unlike it", "en", None), (None, "no id on this text at all", None, "s"), (None, None, "en", "s"), (3, "", "en", "s"), (4, "long " * 100_000, "en", "s")]
    clash = lambda d: d.select(*d.columns, *(F.lit(7).alias(c) for c in ("uid", "rest", "_x", "item_ids", "copy", "position", "size", "_stays")))
    df = clash(spark.createDataFrame(rows, SCHEMA))
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind in here"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out, none = stage(spark, df, str(tmp_path)), stage(spark, df.limit(0), str(tmp_path))
    if k < 4:
        assert out.columns == df.columns == none.columns
    assert none.count() == 0
    assert out.count() == {1: 5, 2: 7, 4: 7}.get(k, out.count()) and out.count() > 0
