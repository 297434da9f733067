"""Queries of retrieval: search, graph traversals, trees and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.functions import text, vectors
from lorespark.operators import graph, meta, search, tree
from lorespark.plans.base import CODE_QUESTION, NOW, NS, QUESTION, SIG, first_vector, query

_Q = "(select embedding::double[] from embeddings order by vec_id limit 1)"
_COS = f"greatest(0, least(1, list_cosine_similarity(embedding::double[], {_Q})))"
_OVERLAP = lambda q, col: "(" + " + ".join(f"contains(lower({col}), '{w}')::int" for w in text.words(q)) + f") / {float(len(text.words(q)))}"

_SCORED = f"""cnt as (select document_id, count(distinct entity_id) as n from chunk_entities where namespace = 'repo:en' and entity_id = 'handle:u3' group by 1),
  parts as (select c.document_id, chunk_id, {_COS} as vector, {_OVERLAP(QUESTION, "text")} as keyword, coalesce(n, 0) / (select max(n) from cnt) as graph from vector_chunks c left join cnt using (document_id) where namespace = 'repo:en' and model_signature = 'hash:64'),
  scored as (select *, 0.55 * graph + 0.30 * vector + 0.15 * keyword as score from parts),
  best as (select * from scored qualify row_number() over (partition by document_id order by score desc, chunk_id) = 1)"""


@query(f"with {_SCORED} select b.document_id, d.key, d.title, d.author, round(score, 5) as score, round(vector, 5) as vector, round(keyword, 6) as keyword, round(graph, 6) as graph from best b join memory_docs d on d.document_id = b.document_id order by b.score desc, b.document_id limit 10")
def hybrid_query(t):
    out = search.hybrid(t.memory_docs, t.vector_chunks, t.chunk_entities, NS, SIG, QUESTION, first_vector(t))
    return out.select("document_id", "key", "title", "author", *_parts())


def _parts(graph: bool = True):
    return [F.round("score", 5).alias("score"), F.round("vector", 5).alias("vector"), F.round("keyword", 6).alias("keyword"), *[F.round("graph", 6).alias("graph")] * graph]


@query(f"with {_SCORED} select document_id, chunk_id, round(score, 5) as score from best")
def query_best_chunk(t):
    scored = search.scored_chunks(t.vector_chunks, t.chunk_entities, NS, SIG, QUESTION, first_vector(t))
    return search.best_chunks(scored).select("document_id", "chunk_id", F.round("score", 5).alias("score"))


_TERMS = text.terms(CODE_QUESTION)
_CAND = "cand as (select c.*, d.key from vector_chunks c join memory_docs d on d.document_id = c.document_id and d.namespace = c.namespace where c.namespace = 'repo:en' and line_start is not null and model_signature = 'hash:64')"
_DF = "df as (select unnest([" + ", ".join(f"{{'term': '{w}', 'df': (select count(*) from cand where contains(lower(text), '{w}'))}}" for w in _TERMS) + "], recursive := true), (select count(*) from cand) as n), idf as (select *, ln((n + 1) / (df + 1)) as idf from df)"
_PRIOR = """case when regexp_matches(base, '^(license|copying)') or base in ('notice', 'authors', 'patents', 'copyright') then 0.4
  when ending in ('md', 'mdx', 'markdown', 'rst', 'txt') then 0.5
  when regexp_matches(low, '\\.test\\.|\\.spec\\.|_test\\.') or list_has_any(string_split(low, '/'), ['test', 'tests', '__tests__', 'spec', 'specs']) then 0.6
  when starts_with(base, '.env') or ending in ('json', 'yaml', 'yml', 'toml', 'lock', 'ini', 'cfg') or list_has_any(string_split(low, '/'), ['examples', 'example', 'fixtures', 'testdata', 'benchmark', 'benchmarks']) then 0.7 else 1.0 end::double"""
_PATHS = "select key, translate(key, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, regexp_extract(low, '[^/]*$') as base, regexp_extract(base, '[^.]*$') as ending"


def _code_sql(boost: bool = True, floor: float = 0.0, limit: int = 10) -> str:
    return f"""with {_CAND}, {_DF}, prior as (select key, {_PRIOR} as prior from ({_PATHS} from memory_docs where namespace = 'repo:en')),
  defs as (select distinct document_id from chunk_entities where namespace = 'repo:en' and entity_id in ('sym:F17') and (select idf from idf where term = 'f17') >= 3.0),
  s as (select c.key as path, c.document_id, c.chunk_id, c.line_start, c.line_end, {_COS} as vector, (select sum(case when contains(lower(c.text), term) then idf else 0 end) / sum(idf) from idf) as keyword, prior,
    case when c.document_id in (select document_id from defs) then 0.1 else 0 end as boost from cand c join prior p on p.key = c.key)
  select path, document_id, chunk_id, line_start, line_end, round((0.5 * vector + 0.5 * keyword) * prior + boost, 5) as score, round(vector, 5) as vector, round(keyword, 6) as keyword from s
  where (0.5 * vector + 0.5 * keyword) * prior + boost >= {floor} order by (0.5 * vector + 0.5 * keyword) * prior + boost desc, path, chunk_id limit {limit}"""


@query(_code_sql())
def search_code(t):
    out = search.search_code(t.memory_docs, t.vector_chunks, t.chunk_entities, NS, SIG, CODE_QUESTION, first_vector(t))
    return out.drop("snippet").select("path", "document_id", "chunk_id", "line_start", "line_end", *_parts(graph=False))


@query(_code_sql(floor=0.1, limit=100))
def search_code_floor(t):
    out = search.search_code(t.memory_docs, t.vector_chunks, t.chunk_entities, NS, SIG, CODE_QUESTION, first_vector(t), limit=100, floor=0.1)
    return out.select("path", "document_id", "chunk_id", "line_start", "line_end", *_parts(graph=False))


@query(f"with {_CAND}, defs as (select distinct document_id from chunk_entities where namespace = 'repo:en' and entity_id = 'sym:F17'), s as (select d.key as path, c.document_id, c.chunk_id, {_COS} as vector, contains(lower(c.text), 'f17')::int as hit, (select ln((count(*) + 1) / (count_if(contains(lower(text), 'f17')) + 1)) from cand) as idf, case when d.key like 'docs/%' then 0.5 when d.key like 'tests/%' then 0.6 when d.key like 'examples/%' or d.key like '%.toml' then 0.7 when d.key like '%LICENSE%' then 0.4 else 1.0 end as prior from cand c join memory_docs d on d.document_id = c.document_id) select path, document_id, chunk_id, round((0.5 * vector + 0.5 * hit) * prior + case when idf >= 3 and document_id in (select document_id from defs) then 0.1 else 0 end, 5) as score from s order by (0.5 * vector + 0.5 * hit) * prior + case when idf >= 3 and document_id in (select document_id from defs) then 0.1 else 0 end desc, path, chunk_id limit 10")
def find_symbol(t):
    out = search.search_code(t.memory_docs, t.vector_chunks, t.chunk_entities, NS, SIG, "F17", first_vector(t))
    return out.select("path", "document_id", "chunk_id", F.round("score", 5).alias("score"))


def _candidates(t):
    return search.code_chunks(t.vector_chunks, t.memory_docs, NS).where(F.col("model_signature") == SIG)


@query(f"with {_CAND}, {_DF} select term, df from df")
def term_df(t):
    return search.term_weights(search.term_stats(_candidates(t), _TERMS), _TERMS).select("term", "df")


@query(f"with {_CAND}, {_DF} select term, n, df, round(idf, 6) as idf from idf")
def term_idf(t):
    return search.term_weights(search.term_stats(_candidates(t), _TERMS), _TERMS).select("term", "n", "df", F.round("idf", 6).alias("idf"))


@query("with newest as (select * from memory_docs where namespace = 'repo:en' order by updated_at desc, document_id limit 1000) select document_id, key, round(1 / (1 + greatest(0, (1700900000 - updated_at) / 3600) / 24), 6) as score from newest order by score desc, document_id limit 10")
def recall(t):
    return search.recall(t.memory_docs, NS, NOW).select("document_id", "key", F.round("score", 6).alias("score"))


@query("select document_id, round(1 / (1 + greatest(0, (1700900000 - updated_at) / 3600) / 24), 6) as freshness from memory_docs")
def freshness(t):
    return t.memory_docs.select("document_id", F.round(search.freshness(F.col("updated_at"), NOW), 6).alias("freshness"))


@query(f"select vec_id, round({_COS}, 5) as score from embeddings order by {_COS} desc, vec_id limit 20")
def cosine_topk(t):
    q = F.array(*(F.lit(float(x)) for x in first_vector(t)))
    return t.embeddings.withColumn("s", vectors.cosine(F.col("embedding"), q)).orderBy(F.desc("s"), "vec_id").limit(20).select("vec_id", F.round("s", 5).alias("score"))


_WHY = "@user tion dans of un la"


@query(f"""with cnt as (select document_id, count(distinct entity_id) as n from history_entities where namespace = 'repo:en:history' and entity_id = 'handle:user' group by 1),
  s as (select c.document_id, chunk_id, 0.55 * (coalesce(n, 0) / (select max(n) from cnt)) + 0.30 * {_COS} + 0.15 * {_OVERLAP(_WHY, "text")} as score from history_chunks c left join cnt using (document_id) where namespace = 'repo:en:history' and model_signature = 'hash:64'),
  b as (select * from s qualify row_number() over (partition by document_id order by score desc, chunk_id) = 1)
  select d.key, d.title, d.author, round(b.score, 5) as score from b join history_docs d on d.document_id = b.document_id order by b.score desc, b.document_id limit 10""")
def why(t):
    """Hybrid search over the history."""
    out = search.hybrid(t.history_docs, t.history_chunks, t.history_entities, f"{NS}:history", SIG, _WHY, first_vector(t))
    return out.select("key", "title", "author", F.round("score", 5).alias("score"))


@query(f"""with {_CAND}, {_DF}, prior as (select key, {_PRIOR} as prior from ({_PATHS} from memory_docs where namespace = 'repo:en')),
  cnt as (select document_id, count(distinct entity_id) as n from chunk_entities where namespace = 'repo:en' and entity_id in ({", ".join(f"'{k}:{w}'" for w in text.identifiers(CODE_QUESTION) for k in ("sym", "import"))}) group by 1),
  s as (select c.key as path, c.document_id, c.chunk_id, {_COS} as vector, (select sum(case when contains(lower(c.text), term) then idf else 0 end) / sum(idf) from idf) as keyword, prior, coalesce(n, 0) / (select max(n) from cnt) as graph,
    case when n is not null and (select idf from idf where term = 'f17') >= 3.0 then 0.1 else 0 end as boost from cand c join prior p on p.key = c.key left join cnt on cnt.document_id = c.document_id)
  select path, document_id, chunk_id, round((0.55 * graph + 0.30 * vector + 0.15 * keyword) * prior + boost, 5) as score from s order by (0.55 * graph + 0.30 * vector + 0.15 * keyword) * prior + boost desc, path, chunk_id limit 10""")
def search_code_graph(t):
    out = search.search_code(t.memory_docs, t.vector_chunks, t.chunk_entities, NS, SIG, CODE_QUESTION, first_vector(t), graph=True)
    return out.select("path", "document_id", "chunk_id", F.round("score", 5).alias("score"))


def _meta(t):
    return t.meta_docs


@query("select key, content as body from meta_docs where namespace = 'repo:en:meta' and key = 'conventions'")
def get_conventions(t):
    return meta.conventions(_meta(t), NS).select("key", F.col("content").alias("body"))


@query("select document_id as node_id, 'digest' as tree_kind, 'architecture' as label, content as body from meta_docs where namespace = 'repo:en:meta' and key = 'architecture'")
def architecture_cached(t):
    return meta.architecture(_meta(t), t.tree_nodes, t.tree_edges, NS).select("node_id", "tree_kind", "label", "body")


@query("select document_id as node_id, 'digest' as tree_kind, 'module:src' as label, content as body from meta_docs where namespace = 'repo:en:meta' and key = 'module:src'")
def module_cached(t):
    return meta.module(_meta(t), t.tree_nodes, t.tree_edges, NS, "src/").select("node_id", "tree_kind", "label", "body")


@query("with newest as (select * from memory_docs where namespace = 'repo:en' order by updated_at desc, document_id limit 5000) select 'repo:en:meta' as namespace, 'module:src' as key, 'Architecture digest (mechanical fallback — LLM unavailable):' || chr(10) || string_agg('- ' || key || chr(10), '' order by key) as content from newest where meta is not null and key like 'src/%'")
def rebuild_module(t):
    return meta.rebuild_digest(t.memory_docs, NS, NOW, "src/").select("namespace", "key", "content")


@query("with newest as (select * from memory_docs where namespace = 'repo:en' order by updated_at desc, document_id limit 1000) select 'repo:en:meta' as namespace, 'conventions' as key, 'Conventions (mechanical fallback — LLM unavailable):' || chr(10) || string_agg('- config present: ' || key || ' (evidence: ' || key || ')' || chr(10), '' order by key) as content from newest where key like '%/rustfmt.toml'")
def rebuild_conventions(t):
    return meta.rebuild_conventions(t.memory_docs, t.tree_nodes, t.tree_edges, NS, NOW).select("namespace", "key", "content")


_CALLS = "calls as (select src_doc_id as doc, dst_sym, confidence from code_edges where namespace = 'repo:en' and edge_kind = 'CALLS'), defs as (select distinct document_id as doc, entity_id as sym from chunk_entities where namespace = 'repo:en' and entity_id like 'sym:%')"


def _callers_sql(tail: str) -> str:
    return f"""with {_CALLS},
  l1 as (select doc, min(dst_sym) as sym, arg_min(confidence, (dst_sym, -confidence)) as confidence, 1 as depth from calls where dst_sym = 'sym:F17' group by doc),
  l2 as (select c.doc, min(dst_sym) as sym, arg_min(c.confidence, (dst_sym, -c.confidence)) as confidence, 2 as depth from calls c where dst_sym in (select sym from defs where doc in (select doc from l1)) and c.doc not in (select doc from l1) group by c.doc),
  l3 as (select c.doc, min(dst_sym) as sym, arg_min(c.confidence, (dst_sym, -c.confidence)) as confidence, 3 as depth from calls c where dst_sym in (select sym from defs where doc in (select doc from l2)) and c.doc not in (select doc from l1 union select doc from l2) group by c.doc),
  hops as (select * from (select * from l1 union all select * from l2 union all select * from l3) order by depth, doc limit 20)
  select d.key as path, h.doc as document_id, sym, 'CALLS' as edge_kind, confidence, depth from hops h join memory_docs d on d.document_id = h.doc {tail}"""


@query(_callers_sql(""))
def callers(t):
    return graph.callers(t.memory_docs, t.code_edges, t.chunk_entities, NS, "F17", depth=3)


@query(_callers_sql("where confidence >= 0.6"))
def callers_min_conf(t):
    return graph.callers(t.memory_docs, t.code_edges, t.chunk_entities, NS, "sym:F17", depth=3).where("confidence >= 0.6")


@query(_callers_sql(""))
def trace_symbol(t):
    """Deeper than any traversal goes is cut, here at what the tables reach."""
    return graph.trace(t.memory_docs, t.code_edges, t.chunk_entities, NS, symbol="F17", direction="callers", depth=3)


START = "src/src1/f1.rs"


@query(f"""with {_CALLS}, home as (select sym, min(doc) as dst from defs group by 1), own as (select document_id as doc, key from memory_docs where namespace = 'repo:en'),
  s as (select doc from own where key = '{START}'),
  o1 as (select dst_sym, confidence, dst from calls left join home on sym = dst_sym where doc in (select doc from s)),
  l1 as (select dst as doc, min(dst_sym) as sym, arg_min(confidence, (dst_sym, -confidence)) as confidence, 1 as depth from o1 where dst is not null and dst not in (select doc from s) group by dst),
  o2 as (select dst_sym, confidence, dst from calls left join home on sym = dst_sym where doc in (select doc from l1)),
  l2 as (select dst as doc, min(dst_sym) as sym, arg_min(confidence, (dst_sym, -confidence)) as confidence, 2 as depth from o2 where dst is not null and dst not in (select doc from s union select doc from l1) group by dst),
  hops as (select * from (select * from l1 union all select * from l2) order by depth, doc limit 20)
  select key as path, h.doc as document_id, sym, 'CALLS' as edge_kind, confidence, depth from hops h join own on own.doc = h.doc
  union all select dst_sym, '', dst_sym, 'CALLS', confidence, 1 from o1 where dst is null union all select dst_sym, '', dst_sym, 'CALLS', confidence, 2 from o2 where dst is null""")
def callees(t):
    return graph.callees(t.memory_docs, t.code_edges, t.chunk_entities, NS, START)


_DRILL = """top as (select max(level) as level from tree_nodes), f0 as (select n.*, 0 as hop from tree_nodes n join top using (level)),
  f1 as (select n.*, 1 as hop from tree_nodes n join tree_edges e on e.child_id = n.node_id join f0 on f0.node_id = e.parent_id),
  f2 as (select n.*, 2 as hop from tree_nodes n join tree_edges e on e.child_id = n.node_id join f1 on f1.node_id = e.parent_id),
  alln as (select * from f0 union all select * from f1 union all select * from f2 union all select n.*, 4 from tree_nodes n where level = 0 and not sealed),
  kept as (select * from alln qualify doc_id is null or row_number() over (partition by doc_id order by created_at desc, hop, seq) = 1)"""


@query(f"with {_DRILL} select node_id, level, label, doc_id, round({_COS}, 5) as score from kept order by {_COS} desc, hop, seq, node_id limit 10")
def drill_down(t):
    out = tree.drill_down(t.tree_nodes, t.tree_edges, "repo:all", first_vector(t))
    return out.select("node_id", "level", "label", "doc_id", F.round("score", 5).alias("score"))


@query(f"with {_DRILL} select node_id, tree_key, level, label, 0.0::double as score from kept order by hop, seq, node_id limit 12")
def architecture(t):
    """No digest is cached for this namespace, so the tree's top answers, in tree order."""
    return tree.drill_down(t.tree_nodes, t.tree_edges, "repo:all", None, limit=12).select("node_id", "tree_key", "level", "label", "score")


@query("with l as (select node_id, coalesce(doc_id, null) as doc_id, created_at, seq from tree_nodes) select node_id, doc_id from l qualify doc_id is null or row_number() over (partition by doc_id order by created_at desc, seq) = 1")
def latest_leaf(t):
    return tree.latest_leaves(t.tree_nodes.select("node_id", "doc_id", "created_at", "seq"), ["seq"]).select("node_id", "doc_id")


@query("select parent_id, substring(coalesce(string_agg(case when line <> '' then line || '; ' else '' end, '' order by seq), ''), 1, 2000) as body from (select e.parent_id, seq, trim(string_split(body, chr(10))[1]) as line from tree_nodes n join tree_edges e on e.child_id = n.node_id) group by 1")
def fallback_summary(t):
    kids = t.tree_nodes.join(t.tree_edges, F.col("node_id") == F.col("child_id"))
    return tree.summaries(kids, ["parent_id", "tree_kind"], max_chars=2000).select("parent_id", "body")


@query("""select parent_id, kind as tree_kind, case kind when 'global' then string_agg(distinct label, ' · ' order by label) when 'module' then substring(string_split(string_agg(case when line <> '' then line || '; ' else '' end, '' order by seq), chr(10))[1], 1, 80) end as label
  from (select e.parent_id, seq, label, trim(string_split(body, chr(10))[1]) as line from tree_nodes n join tree_edges e on e.child_id = n.node_id), (select unnest(['global', 'module', 'topic']) as kind) group by 1, 2""")
def node_labels(t):
    kids = t.tree_nodes.drop("tree_kind").join(t.tree_edges, F.col("node_id") == F.col("child_id")).withColumn("tree_kind", F.explode(F.array(*map(F.lit, ["global", "module", "topic"]))))
    return tree.summaries(kids, ["parent_id", "tree_kind"]).select("parent_id", "tree_kind", "label")


_CORPUS = """newest as (select * from memory_docs where namespace = 'repo:en' order by updated_at desc, document_id limit 5000),
  piece as (select key, document_id, '### ' || key || chr(10) || substring(content, 1, 1200) || chr(10) || chr(10) as piece from newest where meta is not null),
  run as (select key, piece, coalesce(sum(octet_length(encode(piece))) over (order by key, document_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from piece)"""


@query(f"with {_CORPUS} select key, md5(piece) as digest, before from run where before < 60000")
def digest_corpus(t):
    return tree.digest_corpus(t.memory_docs, NS).select("key", F.md5(F.col("piece").cast("binary")).alias("digest"), "before")


@query(f"with {_CORPUS} select 'Files of this project:' || chr(10) || string_agg('- ' || key || chr(10), '' order by key) as body from piece where key like 'src/%'")
def digest_fallback(t):
    docs = t.memory_docs.where(F.col("namespace") == NS).orderBy(F.desc("updated_at"), "document_id").limit(5000).where(F.get_json_object("meta", "$.kind") == "file")
    return tree.key_list(docs.where(F.col("key").startswith("src/")), "Files of this project:\n", F.concat(F.lit("- "), "key", F.lit("\n")))


@query("with newest as (select * from memory_docs where namespace = 'repo:en' order by updated_at desc, document_id limit 1000) select 'Conventions found in files:' || chr(10) || string_agg('- config present: ' || key || ' (evidence: ' || key || ')' || chr(10), '' order by key) as body from newest where key like '%/rustfmt.toml'")
def conventions_fallback(t):
    from lorespark.functions import paths

    docs = t.memory_docs.where(F.col("namespace") == NS).orderBy(F.desc("updated_at"), "document_id").limit(1000).where(paths.is_config_file(F.col("key")))
    return tree.key_list(docs, "Conventions found in files:\n", F.concat(F.lit("- config present: "), "key", F.lit(" (evidence: "), "key", F.lit(")\n")))


@query("select 'digest' as tree_kind, key as tree_key, 0 as level, key as label, 1.0::double as score, length(content) as n_chars from memory_docs where namespace = 'repo:de'")
def digest_hits(t):
    own = t.memory_docs.where(F.col("namespace") == "repo:de")
    return own.select(F.lit("digest").alias("tree_kind"), F.col("key").alias("tree_key"), F.lit(0).alias("level"), F.col("key").alias("label"), F.lit(1.0).alias("score"), F.length("content").cast("long").alias("n_chars"))


@query("""select query_id, string_agg(case when line_end is not null then path || ':' || line_start || '-' || line_end else path end || '  (score ' || printf('%.2f', score) || ')' || chr(10) || substring(repeat(path, 60), 1, 400), chr(10) || chr(10) order by rank) as text from hits group by 1""")
def format_hits(t):
    from lorespark.operators.render import hit_text

    hits = t.hits.withColumn("snippet", F.repeat("path", F.lit(60)))
    return hits.groupBy("query_id").agg(hit_text().alias("text"))


@query("""with held as (select namespace, chunk_id, entity_id from chunk_entities), c as (select b.*, line_start is not null as code from chunk_base b),
  every as (select namespace, case when code then 'module' else 'source' end as tree_kind, case when not code then author when contains(key, '/') then regexp_extract(key, '^(.*)/[^/]*$', 1) else '.' end as tree_key, chunk_id, text from c
    union all select namespace, 'global', 'global', chunk_id, text from c
    union all select c.namespace, 'topic', h.entity_id, c.chunk_id, text from c join held h on h.namespace = c.namespace and h.chunk_id = c.chunk_id where not code or h.entity_id like 'sym:%' or h.entity_id like 'import:%')
  select namespace, tree_kind, tree_key, chunk_id, greatest(1, floor(length(text) / 4))::bigint as token_count from every""")
def tree_fanout(t):
    out = tree.fan_out(t.memory_docs, t.vector_chunks, t.chunk_entities, consolidate_code=True)
    return out.select("namespace", "tree_kind", "tree_key", "chunk_id", "token_count")


@query()
def seal_cascade(t):
    """All trees of the corpus with production gates scaled to its size: 20,000 tokens a buffer."""
    leaves = tree.fan_out(t.memory_docs, t.vector_chunks, t.chunk_entities, consolidate_code=True)
    leaves = leaves.withColumns({"node_id": F.concat_ws("/", "tree_kind", "tree_key", "chunk_id"), "seq": F.expr("cast(substring(doc_id, 2) as bigint) * 100 + cast(split_part(chunk_id, '#', 2) as bigint)"), "label": F.lit(None).cast("string")})
    return tree.seal_cascade(leaves, tree.Gates(tokens=20_000, fanout=4)).select(*tree.BUFFER, "level", "node_id", "seq", "label", "token_count", "sealed", "parent_id")
