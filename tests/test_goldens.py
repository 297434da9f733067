"""Small cases with known results for what SQL can't check, and queries against their oracles on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from lorespark.functions import paths, text, vectors
from lorespark.functions.vectors import fnv1a, hash_vector
from lorespark.operators import chunking, graph, ingest, jobs, symbols, tables, tree
from lorespark.plans import registry
from lorespark.sources.shared import frames

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_prose_chunks():
    got = chunking.prose_chunks("para one\n\npara two\n\n" + "x" * 900)
    assert len(got) == 3 and [len(x) for x in got[1:]] == [800, 100]
    assert len(chunking.prose_chunks("字" * 1000)) == 2 and chunking.prose_chunks("   ") == chunking.prose_chunks(None) == []
    assert chunking.prose_chunks("a" * 399 + "\n\n" + "b" * 400) == ["a" * 399 + "\n" + "b" * 400]
    assert len(chunking.prose_chunks("a" * 400 + "\n\n" + "b" * 400)) == 2


def test_code_chunks():
    assert [x[1:] for x in chunking.code_chunks("a" * 800 + "\n" + "b" * 800)] == [(1, 1), (2, 2)]
    assert len(chunking.code_chunks("head\n" + "x" * 2000 + "\ntail")) == 3
    cjk = chunking.code_chunks("字" * 2000)
    assert len(cjk) > 1 and all(x[1:] == (1, 1) and len(x[0]) <= 480 for x in cjk)
    two = "\n".join(f"interface A{i} {{\n a\n b\n c\n}}" for i in range(2))
    assert [x[1:] for x in chunking.code_chunks(two)] == [(1, 5), (6, 10)] and len(chunking.code_chunks(two, False)) == 1
    assert chunking.code_chunks("") == chunking.code_chunks(None) == []
    assert "".join(x[0] for x in chunking.code_chunks("a\r\nb\n")) == "a\nb\n"


def test_syntax_chunks():
    py = "import x\n\n\n@deco\ndef f():\n    return 1\n\nclass A:\n    def g(self): pass\n"
    assert [x[1:] for x in chunking.syntax_chunks(py, "python")] == [(1, 3), (4, 6), (8, 9)]
    rs = "use a::b;\n\npub fn f() {\n  if x { y }\n}\nstruct S;\n"
    assert [x[1:] for x in chunking.syntax_chunks(rs, "rust")] == [(1, 2), (3, 5), (6, 6)]
    assert chunking.syntax_chunks("fn torn( {", "rust") == chunking.code_chunks("fn torn( {")
    assert symbols.symbols(py, "python") == ["sym:A", "sym:f", "sym:g"]


@pytest.mark.parametrize("deep", ["-" * 10_000 + "1", "not " * 10_000 + "x", "(" * 500])
def test_python_too_deep_for_the_parser(deep):
    code = f"def f():\n    return 1\nx = {deep}\n"
    assert chunking.syntax_chunks(code, "python") == chunking.code_chunks(code) and symbols.symbols(code, "python") == ["sym:f"]


def test_texts_go_to_python_in_small_batches(spark):
    import pandas as pd

    # 2000 documents of 40 kB in one partition; the batches that reach Python after each operator
    docs = spark.range(0, 2000, 1, 1).selectExpr("id as doc_id", "repeat('fn a() { b(); }\n', 2500) as code", "'rust' as lang", "true as is_code")
    seen = lambda df: df.mapInPandas(lambda parts: (pd.DataFrame({"n": [len(p)], "size": [p["text"].str.len().sum()]}) for p in parts), "n long, size long").collect()
    chunks = seen(chunking.chunk(docs.where("doc_id < 200"), "doc_id", "code"))
    got = seen(docs.selectExpr("code as text"))
    assert sum(r.n for r in got) == 2000 and max(r.n for r in got) <= 512 and max(r.size for r in got) < 9 << 20
    assert sum(r.size for r in chunks) == 200 * len(("fn a() { b(); }\n" * 2500).strip()) and max(r.n for r in chunks) <= 512


def test_frames_hold_no_more_than_asked():
    drawn = []
    rows = ((drawn.append(i), (i, "x" * 10))[1] for i in range(95))
    found = frames(rows, ["i", "t"], text=1, most=200)
    assert len(next(found)) == 20 == len(drawn) and [len(f) for f in found] == [20, 20, 20, 15] and len(drawn) == 95
    assert [len(f) for f in frames(((i,) for i in range(7)), ["i"], count=3)] == [3, 3, 1] and not list(frames([], ["i"]))


def test_large_files_are_listed_but_not_opened(spark, tmp_path):
    from lorespark.sources import vcs

    (tmp_path / "a.rs").write_text("fn a() {}")
    (tmp_path / "b.rs").write_bytes(b"\xff\xfe")
    (tmp_path / "edge.rs").write_text("x" * paths.MAX_BYTES)
    (tmp_path / "large.rs").write_text("x" * (paths.MAX_BYTES + 1))
    (tmp_path / "yarn.lock").write_text("y")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", paths.MAX_BYTES)  # opening a longer file is an error
    try:
        got = {r.path.split("/")[-1]: (r.n_bytes, r.indexable, r.content and len(r.content)) for r in vcs.source_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    n = paths.MAX_BYTES
    assert got == {"a.rs": (9, True, 9), "b.rs": (2, False, None), "edge.rs": (n, True, n), "large.rs": (n + 1, False, None), "yarn.lock": (1, False, None)}


DEFINED = {
    "javascript": ("function foo() {}\nexport default class A { constructor(x) { this.x = x; } bar(a, b) { if (a) { return b(); } } static async *gen() {} }\nconst o = { m() { return 1; } };\nlet z = function inner() {};\n", "A bar constructor foo gen m"),
    "typescript": ("export interface I { f(): void }\ntype T<A> = A | null;\nenum E { A }\nexport abstract class C<T> extends B { protected get y(): number { return 1; } abstract q(): void; }\nexport async function go<T>(a: T): Promise<T> { return a; }\n", "C E I T go y"),
    "tsx": ("export function View() { return <div>{x}</div>; }\n", "View"),
    "kotlin": ("package x\nfun alpha(n: Int): Int { return n + 1 }\nclass Beta(val a: Int) { fun m() = a }\nobject O { }\nfun String.ext() {}\n", "Beta O alpha ext m"),
    "java": ("class Foo extends B {\n int alpha(int n) { return n + 1; }\n Foo() {}\n @Override\n public void beta() throws E { for (;;) { call(1); } }\n abstract int g(int a);\n int z = f(1);\n enum Q { A(1), B(2); Q(int i) {} }\n}\n", "Foo Q alpha beta g"),
    "c": ("#include <stdio.h>\nstruct Pixel { int r, g, b; };\nstatic int g(void) { return h(1); }\nint dewarp(int x) {\n  if (x) { return x * 2; }\n  return f(x);\n}\nint arr[] = { 1, 2 };\n", "Pixel dewarp g"),
    "cpp": ("namespace avm {\nclass Stitcher : public B {\npublic:\n  int blend(int a) const { return a; }\n  ~Stitcher() {}\n};\ntemplate <class T> T mx(T a) { return a; }\nvoid Stitcher::run(int q) { blend(q); }\n}\n", "Stitcher Stitcher::run avm blend mx"),
    "go": ("package m\nfunc A(x int) int { return x }\nfunc (r *T) B() {}\ntype S struct { a int }\n", "A B"),
    "rust": ("pub fn f(a: [u8; 4]) -> T { g() } // fn no() {}\ntrait Q { fn sig(&self); fn d(&self) { } }\nimpl X { fn m(&self) {} }\nmod z;\nmacro_rules! mm { () => {} }\ntype Al = u8;\n", "Al Q d f m mm z"),
    "python": ("def f(): pass\nclass A:\n  async def g(self): pass\n", "A f g"),
}


@pytest.mark.parametrize("lang", DEFINED)
def test_symbols_of_every_language(lang):
    code, want = DEFINED[lang]
    assert symbols.symbols(code, lang) == [f"sym:{x}" for x in want.split()]
    assert isinstance(symbols.symbols("class { void (( ; namespace }{", lang), list) and symbols.symbols(None, lang) == []


def test_chunks_of_every_language():
    kotlin = "package x\n\nimport y.Z\n\nfun alpha(n: Int): Int {\n    return n + 1\n}\n\nclass Beta(val a: Int) {\n    fun m() = a\n}\n"
    assert [x[1:] for x in chunking.syntax_chunks(kotlin, "kotlin")] == [(1, 4), (5, 7), (9, 11)]
    c = "#include <stdio.h>\n\nstruct Pixel { int r, g, b; };\n\nint dewarp(int x) {\n    return x * 2;\n}\n"
    assert [x[1:] for x in chunking.syntax_chunks(c, "c")] == [(1, 2), (3, 3), (5, 7)]
    js = "import a from 'a'\nfunction f() {\n  return 1\n}\nconst x = 1\nclass B {\n}\n"
    assert [x[1:] for x in chunking.syntax_chunks(js, "javascript")] == [(1, 1), (2, 4), (5, 5), (6, 7)]
    small = "".join(f"int f{i}() {{ return {i}; }}\n" for i in range(4))
    assert len(chunking.syntax_chunks(small, "c")) == 4 and len(chunking.syntax_chunks(small, "c", pack=True)) == 1


def test_calls_leave_definitions_out():
    got = symbols.edges("int h(int x) { return f(x); }\nint f(int x) { return 1; }\nint main() { h(2); return 0; }\n", "c", 0.3)
    assert got == [("sym:f", "CALLS", 1, 1.0), ("sym:h", "CALLS", 3, 1.0)]


def test_edges():
    code = "use crate::store::Store;\nfn helper() {}\nfn main(s: &Store) {\n  helper();\n  Store::open(1); // gone()\n  other();\n}\n"
    got = {(a, k): c for a, k, _, c in symbols.edges(code, "rust")}
    assert got["sym:helper", "CALLS"] == 1.0 and got["sym:Store", "IMPORTS"] >= 0.59 and got["sym:Store", "USES_TYPE"] == 0.6
    assert not {a for a, _ in got} & {"sym:gone", "sym:other"} and symbols.edges(code, "python") == []
    assert ("sym:x", "IMPORTS") in {x[:2] for x in symbols.edges('#include "lib/x.h"\nint f() { return 0; }', "cpp")}


def test_entities(spark):
    mixed = one(spark, text.entities(F.lit("Mail Alice@Example.com, ask @AliceH about #LaunchDay at https://x.com/@alice#sec")))
    assert mixed == ["email:alice@example.com", "handle:aliceh", "hashtag:launchday", "url:https://x.com/@alice#sec"]
    code = one(spark, text.code_entities(F.lit("use crate::store::Store;\npub async fn DoThing() {}\nstruct MyType;\nimport {\n")))
    assert code == ["import:crate::store::Store", "sym:DoThing", "sym:MyType"]
    assert one(spark, text.estimate_tokens(F.lit("漢字abcde"))) == 4 and text.terms("ab abc ABC 漢 x_yz") == ["abc", "漢"]


def test_vectors(spark):
    c = lambda a, b: one(spark, vectors.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert c([1.0, 2.0], [1.0, 2.0]) == pytest.approx(1) and c([1.0, 0.0], [0.0, 1.0]) == c([1.0], [1.0, 2.0]) == c([1.0, 1.0], [-1.0, -1.0]) == 0
    assert [fnv1a(w.encode()) % 64 for w in ("rust", "héllo", "memory")] == [39, 32, 46] and hash_vector("a A b", 8).sum() == 3
    assert one(spark, vectors.url_key(F.lit("a b/é.rs"))) == "a%20b%2F%C3%A9%2Ers"


def test_path_prior(spark):
    rows = spark.createDataFrame([(p,) for p in ("src/a.rs", "LICENSE", "x/README.md", "tests/a.rs", "a/b.test.ts", "Cargo.toml", ".env.x")], "p string")
    assert [r[0] for r in rows.select(paths.path_prior(F.col("p"))).collect()] == [1.0, 0.4, 0.5, 0.6, 0.6, 0.7, 0.7]


def test_upsert_keeps_identity(spark):
    old = spark.createDataFrame([("n", "k", "d1", "a", 1.0)], "namespace string, key string, document_id string, content string, created_at double")
    new = spark.createDataFrame([("n", "k", "d2", "b", 2.0), ("n", "j", "d3", "c", 2.0)], old.schema)
    once = tables.upsert(old, new, ["namespace", "key"], ["document_id", "created_at"])
    got = sorted(map(tuple, once.collect()))
    assert got == [("n", "j", "d3", "c", 2.0), ("n", "k", "d1", "b", 1.0)]
    assert sorted(map(tuple, tables.upsert(once, new, ["namespace", "key"], ["document_id", "created_at"]).collect())) == got


def test_cascade(spark):
    rows = [("n", "global", "global", f"l{i}", i, f"line {i}\nmore", f"lab{i}", f"d{i}", 5) for i in range(9)]
    leaves = spark.createDataFrame(rows, "namespace string, tree_kind string, tree_key string, node_id string, seq long, body string, label string, doc_id string, token_count long")
    got = tree.seal_cascade(leaves, tree.Gates(tokens=10, fanout=2)).collect()
    by = {lv: sorted((r.seq, r.sealed) for r in got if r.level == lv) for lv in range(4)}
    assert [len(by[k]) for k in range(4)] == [9, 4, 2, 1] and by[0][-1] == (8, False) and by[3] == [(0, False)] and all(s for _, s in by[1] + by[2])
    assert next(r for r in got if r.level == 1 and r.seq == 0).body == "line 0; line 1; "


@pytest.mark.parametrize("seed, budget, pieces", [(0, 30, 7), (1, 1, 3), (2, 200, 16), (3, 10_000, 5), (4, 0, 4)])
def test_groups_of_leaves_over_many_pieces(spark, seed, budget, pieces):
    import random

    r = random.Random(seed)
    keys = ["big"] * 12 + ["a", "b", None]
    rows = [("n", "topic", r.choice(keys), i, f"l{i}", r.choice([0, 1, 3, 9, 40, None])) for i in range(600)]
    leaves = spark.createDataFrame(rows, "namespace string, tree_kind string, tree_key string, seq long, node_id string, token_count long")
    want, state = {}, {}
    for _, _, key, _, node, tokens in rows:
        total, seals = state.get(key, (0, 0))
        want[node], total = seals, total + (tokens or 0)
        state[key] = (0, seals + 1) if total >= budget else (total, seals)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", pieces)
    try:
        got = tree.leaf_groups(leaves, budget).collect()
        assert tree.leaf_groups(leaves.where("seq < 0"), budget).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 600 and {x.node_id: x.group for x in got} == want


def test_callers_and_callees(spark):
    docs = spark.createDataFrame([("n", x, f"{x}.rs") for x in ("leaf", "middle", "top")], "namespace string, document_id string, key string")
    ent = spark.createDataFrame([("n", x, f"sym:{x}") for x in ("leaf", "middle", "top")], "namespace string, document_id string, entity_id string")
    edges = spark.createDataFrame([("n", "middle", "sym:leaf", "CALLS", 0.9), ("n", "top", "sym:middle", "CALLS", 0.9), ("n", "top", "sym:bar", "CALLS", 0.3), ("n", "top", "sym:baz", "CALLS", 0.3)], "namespace string, src_doc_id string, dst_sym string, edge_kind string, confidence double")
    up = graph.callers(docs, edges, ent, "n", "leaf")
    assert sorted((r.document_id, r.depth) for r in up.collect()) == [("middle", 1), ("top", 2)] and up.where("confidence >= 0.95").isEmpty()
    down = graph.callees(docs, edges, ent, "n", "top.rs").collect()
    assert sorted((r.path, r.depth) for r in down) == [("leaf.rs", 2), ("middle.rs", 1), ("sym:bar", 1), ("sym:baz", 1)]


def test_retry_until_the_last_attempt(spark):
    j = spark.createDataFrame([("a", "running", 4), ("b", "running", 5), ("c", "done", 1)], "job_id string, status string, attempts int")
    assert {r.job_id: r.status for r in jobs.fail(j, "boom", 1.0).collect()} == {"a": "pending", "b": "failed"}


def test_snapshots_and_stream(spark, tmp_path):
    from lorespark.streaming import cold_path

    cols = "document_id string, namespace string, key string, title string, content string, author string, taint string, created_at double, updated_at double, meta string"
    rows = [(f"d{i}", "n", f"k{i}", "t", f"hello @bob{i}", "me", "internal", 1.0, 1.0, None) for i in range(4)]
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/in")
    store = tables.Snapshots(spark, f"{tmp_path}/store")
    for _ in range(2):  # the second run finds nothing new
        q = cold_path.start(spark.readStream.schema(cols).parquet(f"{tmp_path}/in"), store, ingest.HashEmbedder(), f"{tmp_path}/check", 2.0)
        assert q.awaitTermination(180) and q.exception() is None
    assert store.read("docs").count() == 4 and store.read("entities").count() == 4 and store.read("jobs").where("status = 'pending'").count() == 4
    leaves = store.read("leaves").groupBy("tree_kind").count().collect()
    assert {r[0]: r[1] for r in leaves} == {"source": 4, "global": 4, "topic": 4}


SOME = ["hybrid_query", "search_code", "callers", "drill_down", "upsert_docs", "append_leaves", "apply_diff", "extract_entities", "parse_git_log", "abstain_sweep", "path_prf", "tree_fanout"]


@pytest.mark.parametrize("name", SOME)
def test_against_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "events", "benchmark", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    names, rows = want.columns, want.fetchall()
    df = registry.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    flat = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    assert sorted(repr(tuple(flat(r[c]) for c in names)) for r in df.collect()) == sorted(repr(tuple(map(flat, r))) for r in rows)


def test_names_are_unique():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 100


def test_rival_commits_are_refused(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "a int")
    store = tables.Snapshots(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.read("t") is None
    assert store.commit({"t": rows(1), "u": rows(7)}) == 1
    rival = tables.Snapshots(spark, str(tmp_path / "store"))
    base = rival.version()
    assert store.commit({"t": rows(1, 2)}) == 2
    with pytest.raises(RuntimeError, match="another writer"):
        rival.commit({"t": rows(9)}, base)
    assert sorted(r.a for r in store.read("t").collect()) == [1, 2] and store.read("u").count() == 1 and store.read("t", 1).count() == 1
    assert rival.commit({"t": rows(9)}) == 3 and store.read("t").first().a == 9
    left = [f for f in (tmp_path / "store" / "manifest").iterdir() if "draft" in f.name and not f.name.endswith(".crc")]
    assert not left


def test_hashes_of_a_batch_are_those_of_each():
    some = [b"", b"a", "h\u00e9llo".encode(), b"x" * 300, b"memory", b"rust"]
    assert vectors.fnv1a_all(some).tolist() == [fnv1a(x) for x in some] and vectors.fnv1a_all([]).tolist() == []
    texts = ["a A b", "", "one two one \u00e9"]
    assert [v.tolist() for v in vectors.hash_vectors(texts, 8)] == [[float(sum(fnv1a(w.encode()) % 8 == k for w in t.lower().split())) for k in range(8)] for t in texts]


def test_age_seals_what_is_left(spark):
    rows = [("n", "global", "global", i, f"l{i}", f"line {i}", None, f"d{i}", 40, float(i)) for i in range(5)]
    leaves = spark.createDataFrame(rows, "namespace string, tree_kind string, tree_key string, seq long, node_id string, body string, label string, doc_id string, token_count long, created_at double")
    gates = tree.Gates(tokens=80, fanout=10, age=100.0)
    sealed = lambda **kw: sorted(r.node_id for r in tree.seal_cascade(leaves, gates, **kw).where("sealed").collect())
    assert sealed() == ["l0", "l1", "l2", "l3"] == sealed(now=103.0) and sealed(now=104.0) == ["l0", "l1", "l2", "l3", "l4"]


def exchanged(df):
    """The columns that each shuffle of a plan moves."""
    import re

    found = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"(?m)^\(\d+\) Exchange\s*\nInput \[\d+\]: \[(.*)\]$", found)


NODES = "namespace string, tree_kind string, tree_key string, level int, seq long, sealed boolean, node_id string, body string, label string, doc_id string, token_count long, created_at double, embedding array<float>"


def test_bodies_of_leaves_are_not_shuffled_for_their_parents(spark, monkeypatch):
    rows = [("n", "global", "global", 0, i, False, f"l{i}", f" line {i} \nmore", None, f"d{i}", 40, 0.0, [1.0]) for i in range(6)]
    leaves, plans, keep = spark.createDataFrame(rows, NODES).drop("level", "sealed"), [], tree.saved
    monkeypatch.setattr(tree, "saved", lambda df: plans.append(exchanged(df)) or keep(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = tree.seal_cascade(leaves, tree.Gates(tokens=80, fanout=10))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    leaf = [x for p in plans for x in p if "node_id#" in x and "group#" not in x]  # parents have a group
    assert leaf and not [x for x in leaf if "body#" in x]
    got = {r.node_id: r.body for r in out.collect()}
    assert got["l0"] == " line 0 \nmore" and got["n/global/global/1/0"] == "line 0; line 1; " and len(got) == 9


@pytest.mark.parametrize("vector", [None, [1.0, 0.0]])
def test_drill_down_shuffles_no_bodies(spark, vector):
    rows = [("n", "global", "global", 0, i, i < 4, f"l{i}", f"body {i}", None, f"d{i % 5}", 40, float(i), [float(i), 1.0]) for i in range(6)]
    rows += [("n", "global", "global", 1, i, False, f"p{i}", f"parent {i}", "x", None, 40, 9.0, [1.0, 1.0]) for i in range(2)]
    edges = spark.createDataFrame([(f"p{i // 2}", f"l{i}") for i in range(4)], "parent_id string, child_id string")
    found = tree.drill_down(spark.createDataFrame(rows, NODES), edges, "n", vector, limit=5)
    want = ["p0", "p1", "l1", "l2", "l3"] if vector is None else ["l5", "l4", "l3", "l2", "p0"]
    assert [(r.node_id, r.body) for r in found.collect()] == [(x, ("parent " if x[0] == "p" else "body ") + x[1:]) for x in want]
    moved = exchanged(found.drop("body"))
    plan = found.drop("body")._jdf.queryExecution().optimizedPlan().toString()
    assert moved and not [x for x in moved if "body#" in x or "embedding#" in x] and "max_by" in plan and "body#" not in plan.split("max_by", 1)[1].split("\n")[0]


class Answers:
    def __init__(self, answer):
        self.answer = answer

    def summarize(self, prompt, max_tokens):
        if self.answer is None:
            raise RuntimeError("down")
        return self.answer


@pytest.mark.parametrize("answer, body", [("Words.", "Words."), ("  ", None), (None, None)])
def test_meta_verbs(spark, answer, body):
    from lorespark.operators import meta

    docs = spark.createDataFrame([(f"d{i}", "n", k, k, "text", "x", "internal", 1.0, 2.0, '{"kind":"file"}') for i, k in enumerate(["src/b.rs", "src/a.rs", "lib/c.rs", "tsconfig.json"])], "document_id string, namespace string, key string, title string, content string, author string, taint string, created_at double, updated_at double, meta string")
    audit: list = []
    new = meta.rebuild_digest(docs, "n", 5.0, "src/", Answers(answer), audit=audit)
    assert audit[0]["status"] == ("error" if answer is None else "ok")
    held = meta.upsert(docs, new)
    want = body or meta.DIGEST_HEAD + "- src/a.rs\n- src/b.rs\n"
    assert meta.module(held, None, None, "n", "src").first().body == want and held.count() == 5
    again = meta.upsert(held, meta.rebuild_digest(docs, "n", 6.0, "src", Answers("New.")))
    assert again.count() == 5 and meta.module(again, None, None, "n", "src/").first().body == "New."
    assert meta.conventions(held, "n").isEmpty()


def test_marker(spark, tmp_path):
    from lorespark.sources import vcs

    at = str(tmp_path / "marks" / "last")
    assert vcs.read_marker(spark, at) is None
    vcs.write_marker(spark, at, "abc")
    vcs.write_marker(spark, at, "def\n")
    assert vcs.read_marker(spark, at) == "def"
