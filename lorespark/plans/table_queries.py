"""Queries over tables: lookups, scans, mutations, jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.operators import graph, jobs, tables, tree
from lorespark.plans.base import NOW, NS, SIG, query

DOC = ["document_id", "namespace", "key", "title", "author", "taint", "created_at", "updated_at", "meta"]
_DOC = ", ".join(DOC)
CHUNK = ["document_id", "chunk_id", "line_start", "line_end", "n_chars"]


@query(f"select {_DOC}, length(content) as n_chars from memory_docs where namespace = 'repo:en' and document_id = 'd0000012'")
def doc_get_by_id(t):
    return t.memory_docs.where((F.col("namespace") == NS) & (F.col("document_id") == "d0000012")).select(*DOC, F.length("content").cast("long").alias("n_chars"))


@query(f"select {_DOC} from memory_docs where namespace = 'repo:en' and key = 'src/src1/f1.rs'")
def doc_get_by_key(t):
    return t.memory_docs.where((F.col("namespace") == NS) & (F.col("key") == "src/src1/f1.rs")).select(*DOC)


@query(f"select {_DOC} from memory_docs where namespace = 'repo:en' order by updated_at desc, document_id limit 100")
def docs_list(t):
    return tables.newest(t.memory_docs, NS, 100).select(*DOC)


@query("select document_id, chunk_id, length(text) as n_chars, len(embedding) as dim from vector_chunks where namespace = 'repo:en' and model_signature = 'hash:64'")
def chunks_scan(t):
    return t.vector_chunks.where((F.col("namespace") == NS) & (F.col("model_signature") == SIG)).select("document_id", "chunk_id", F.length("text").cast("long").alias("n_chars"), F.size("embedding").cast("long").alias("dim"))


@query("select c.document_id, chunk_id, key, line_start, line_end, length(text) as n_chars from vector_chunks c join memory_docs d on d.document_id = c.document_id and d.namespace = c.namespace where c.namespace = 'repo:en' and line_start is not null")
def code_chunks_scan(t):
    return tables.code_chunks(t.vector_chunks, t.memory_docs, NS).select("document_id", "chunk_id", "key", "line_start", "line_end", F.length("text").cast("long").alias("n_chars"))


@query("""select c.chunk_id, c.document_id, coalesce(string_agg(distinct e.entity_id, '|' order by e.entity_id), '') as entities
  from vector_chunks c left join chunk_entities e on e.namespace = c.namespace and e.chunk_id = c.chunk_id where c.namespace = 'repo:en' group by 1, 2""")
def chunks_with_entities(t):
    own = F.col("namespace") == NS
    out = tables.with_entities(t.vector_chunks.where(own), t.chunk_entities.where(own & ~F.col("entity_id").startswith("none:")))
    return out.select("chunk_id", "document_id", F.array_join("entities", "|").alias("entities")).orderBy("chunk_id")


@query("select dst_sym, edge_kind, src_line, confidence from code_edges where namespace = 'repo:en' and src_doc_id = 'd0000011'")
def edges_from(t):
    return t.code_edges.where((F.col("namespace") == NS) & (F.col("src_doc_id") == "d0000011")).select("dst_sym", "edge_kind", "src_line", "confidence")


@query("select src_doc_id, edge_kind, src_line, confidence from code_edges where namespace = 'repo:en' and dst_sym = 'sym:F17'")
def edges_to_sym(t):
    return t.code_edges.where((F.col("namespace") == NS) & (F.col("dst_sym") == "sym:F17")).select("src_doc_id", "edge_kind", "src_line", "confidence")


@query("select entity_id, min(document_id) as document_id from chunk_entities where namespace = 'repo:en' and entity_id like 'sym:%' group by 1")
def resolve_symbol(t):
    return tables.resolve_symbols(t.chunk_entities, NS)


@query("select distinct document_id, entity_id from chunk_entities where namespace = 'repo:en' and document_id in ('d0000011', 'd0000013') and entity_id like 'sym:%'")
def doc_symbols(t):
    return t.chunk_entities.where((F.col("namespace") == NS) & F.col("document_id").isin("d0000011", "d0000013") & F.col("entity_id").startswith("sym:")).select("document_id", "entity_id").distinct()


@query("select node_id, seq, token_count, doc_id from tree_nodes where namespace = 'repo:all' and tree_kind = 'global' and tree_key = 'global' and level = 0 and not sealed")
def tree_unsealed(t):
    return t.tree_nodes.where("namespace = 'repo:all' and tree_kind = 'global' and tree_key = 'global' and level = 0 and not sealed").select("node_id", "seq", "token_count", "doc_id").orderBy("seq")


@query("select n.node_id, n.seq, n.level from tree_nodes n join tree_edges e on e.child_id = n.node_id where e.parent_id = 'l1-00000007'")
def tree_children(t):
    parent = t.spark.createDataFrame([("l1-00000007",)], "node_id string")
    return tree.children(t.tree_nodes, t.tree_edges, parent).select("node_id", "seq", "level").orderBy("seq")


@query("select node_id, level, seq from tree_nodes where tree_kind = 'global' and level = (select coalesce(max(level), 0) from tree_nodes where tree_kind = 'global')")
def tree_top_nodes(t):
    return tree.top_nodes(t.tree_nodes, "repo:all").select("node_id", "level", "seq")


@query("select namespace, tree_kind, tree_key, level, min(created_at) as oldest from tree_nodes where not sealed group by 1, 2, 3, 4 having min(created_at) <= 1700010420")
def tree_stale_buffers(t):
    gates = tree.seal_gate(t.tree_nodes, NOW)
    return gates.where(F.col("oldest") <= 1700010420.0).select("namespace", "tree_kind", "tree_key", "level", "oldest")


@query("select tree_kind, level, cast(sum(token_count) as bigint) as tokens, count(*) as nodes, min(created_at) as oldest, (case when level = 0 then sum(token_count) >= 50000 else count(*) >= 10 end) or min(created_at) <= 1700900000 - 890000 as seal from tree_nodes where not sealed group by tree_kind, level")
def seal_gate(t):
    return tree.seal_gate(t.tree_nodes, NOW, tree.Gates(age=890000.0)).select("tree_kind", "level", "tokens", "nodes", "oldest", "seal")


@query("select count(*) as pending from jobs where status = 'pending'")
def jobs_pending(t):
    return t.jobs.where("status = 'pending'").agg(F.count(F.lit(1)).alias("pending"))


@query("select status, count(*) as n from jobs group by 1")
def jobs_by_status(t):
    return t.jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""with ids as (select document_id from jobs where cast(document_id as bigint) % 9 = 0 union select 'new' || document_id from jobs where cast(document_id as bigint) % 100 = 7)
  select 'ns:' || i.document_id as job_id, 'pending' as status, 0 as attempts, coalesce(j.created_at, 1700900000.0::double) as created_at, 1700900000.0::double as updated_at from ids i left join jobs j on j.job_id = 'ns:' || i.document_id
  union all select job_id, status, attempts, created_at, updated_at from jobs where job_id not in (select 'ns:' || document_id from ids)""")
def jobs_enqueue(t):
    n = F.col("document_id").cast("long")
    ids = t.jobs.where(n % 9 == 0).select("document_id").union(t.jobs.where(n % 100 == 7).select(F.concat(F.lit("new"), "document_id")))
    return jobs.enqueue(t.jobs, "ns", ids, NOW).select("job_id", "status", "attempts", "created_at", "updated_at")


@query("select job_id, 'running' as status, attempts + 1 as attempts, created_at from jobs where status = 'pending' order by created_at, job_id limit 5")
def jobs_claim(t):
    return jobs.claim(t.jobs, NOW, 5).select("job_id", "status", "attempts", "created_at")


@query("select job_id, case when attempts >= 5 then 'failed' else 'pending' end as status, attempts, 'boom' as last_error from jobs where status = 'running'")
def jobs_retry(t):
    return jobs.fail(t.jobs, "boom", NOW).select("job_id", "status", "attempts", "last_error")


@query("select job_id, case status when 'running' then 'pending' else status end as status, attempts from jobs")
def jobs_requeue(t):
    return jobs.requeue(t.jobs).select("job_id", "status", "attempts")


NEW_DOCS = """select 'n' || document_id as document_id, namespace, case when right(document_id, 1) = '4' then 'new/' || key else key end as key, 'T' || title as title, content, author, 'internal' as taint,
  cast(1700900000.0 as double) as created_at, cast(1700900000.0 as double) as updated_at, meta from {0} where right(document_id, 1) in ('3', '4')"""


@query(f"""with incoming as ({NEW_DOCS.format("memory_docs")})
  select coalesce(o.document_id, n.document_id) as document_id, n.namespace, n.key, n.title, coalesce(o.created_at, n.created_at) as created_at, n.updated_at from incoming n left join memory_docs o on o.namespace = n.namespace and o.key = n.key
  union all select document_id, o.namespace, o.key, title, created_at, updated_at from memory_docs o where not exists (select 1 from incoming n where n.namespace = o.namespace and n.key = o.key)""")
def upsert_docs(t):
    new = t.spark.sql(NEW_DOCS.format("{docs}"), docs=t.memory_docs)
    out = tables.upsert(t.memory_docs, new, ["namespace", "key"], ["document_id", "created_at"])
    return out.select("document_id", "namespace", "key", "title", "created_at", "updated_at")


@query("""with incoming as (select namespace, chunk_id, document_id, '!' || text as text from vector_chunks where chunk_id like '%7#1' union all select namespace, 'x' || chunk_id, document_id, text from vector_chunks where chunk_id like '%8#0')
  select namespace, chunk_id, document_id, md5(text) as digest from incoming
  union all select namespace, chunk_id, document_id, md5(text) from vector_chunks c where not exists (select 1 from incoming n where n.namespace = c.namespace and n.chunk_id = c.chunk_id)""")
def upsert_chunks(t):
    old = t.vector_chunks.select("namespace", "chunk_id", "document_id", "text")
    new = old.where(F.col("chunk_id").like("%7#1")).withColumn("text", F.concat(F.lit("!"), "text")).union(old.where(F.col("chunk_id").like("%8#0")).withColumn("chunk_id", F.concat(F.lit("x"), "chunk_id")))
    return tables.upsert(old, new, ["namespace", "chunk_id"]).select("namespace", "chunk_id", "document_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""select 'chunk' as kind, chunk_id, '' as entity_id from vector_chunks where not (namespace = 'repo:en' and document_id in ('d0000011', 'd0000013'))
  union all select 'entity', chunk_id, entity_id from chunk_entities where not (namespace = 'repo:en' and document_id in ('d0000011', 'd0000013'))""")
def delete_doc_chunks(t):
    gone = t.spark.createDataFrame([(NS, "d0000011"), (NS, "d0000013")], "namespace string, document_id string")
    c = t.vector_chunks.join(gone, ["namespace", "document_id"], "left_anti").select(F.lit("chunk").alias("kind"), "chunk_id", F.lit("").alias("entity_id"))
    e = t.chunk_entities.join(gone, ["namespace", "document_id"], "left_anti").select(F.lit("entity").alias("kind"), "chunk_id", "entity_id")
    return c.unionByName(e)


@query("""select distinct namespace, chunk_id, entity_id from (select namespace, chunk_id, entity_id from chunk_entities union all
  select namespace, chunk_id, 'hashtag:t' || cast(line_start % 7 as string) from vector_chunks where line_start is not null union all select namespace, chunk_id, 'email:a@b.c' from vector_chunks)""")
def record_entities(t):
    old = t.chunk_entities.select("namespace", "chunk_id", "entity_id")
    c = t.vector_chunks
    new = c.where("line_start is not null").select("namespace", "chunk_id", F.concat(F.lit("hashtag:t"), (F.col("line_start") % 7).cast("string")).alias("entity_id")).union(c.select("namespace", "chunk_id", F.lit("email:a@b.c")))
    return tables.add_missing(old, new, ["namespace", "chunk_id", "entity_id"])


@query("""with leaves as (select 'repo:en' as namespace, doc_id, node_id, level, sealed from tree_nodes)
  select 'docs' as part, document_id as id from memory_docs where not (namespace = 'repo:en' and document_id = 'd0000001')
  union all select 'chunks', chunk_id from vector_chunks where not (namespace = 'repo:en' and document_id = 'd0000001')
  union all select 'entities', chunk_id || entity_id from chunk_entities where not (namespace = 'repo:en' and document_id = 'd0000001')
  union all select 'edges', src_doc_id || dst_sym from code_edges where not (namespace = 'repo:en' and src_doc_id = 'd0000001')
  union all select 'leaves', node_id from leaves where not coalesce(doc_id = 'd0000001' and level = 0 and not sealed, false)
  union all select 'jobs', job_id from jobs where document_id <> 'd0000001'""")
def forget_doc(t):
    leaves = t.tree_nodes.select(F.lit(NS).alias("namespace"), "doc_id", "node_id", "level", "sealed")
    out = tables.forget(t.memory_docs, t.vector_chunks, t.chunk_entities, t.code_edges, leaves, t.jobs, NS, "src/src1/f1.rs")
    ids = {"docs": "document_id", "chunks": "chunk_id", "entities": "chunk_id || entity_id", "edges": "src_doc_id || dst_sym", "leaves": "node_id", "jobs": "job_id"}
    parts = [out[k].select(F.lit(k).alias("part"), F.expr(e).alias("id")) for k, e in ids.items()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


@query("""with leaves as (select 'repo:all' as namespace, 'global' as tree_kind, 'global' as tree_key, 0 as level, chunk_id, v from chunk_base where v % 3 = 0
    union all select namespace, 'source', author, 0, chunk_id, v from chunk_base)
  select l.namespace, l.tree_kind, l.tree_key, chunk_id, coalesce((select max(seq) from tree_nodes n where n.namespace = l.namespace and n.tree_kind = l.tree_kind and n.tree_key = l.tree_key and n.level = 0), -1)
    + row_number() over (partition by l.namespace, l.tree_kind, l.tree_key order by v) as seq from leaves l""")
def append_leaves(t):
    b = t.chunk_base
    leaves = b.where("v % 3 = 0").selectExpr("'repo:all' as namespace", "'global' as tree_kind", "'global' as tree_key", "0 as level", "chunk_id", "v").union(b.selectExpr("namespace", "'source'", "author", "0", "chunk_id", "v"))
    return tables.append_leaves(t.tree_nodes, leaves, ["v"]).select("namespace", "tree_kind", "tree_key", "chunk_id", "seq")


@query("select node_id, level from tree_nodes where not coalesce(level = 0 and not sealed and doc_id in ('d0000230', 'd0000100'), false)")
def delete_unsealed_leaves(t):
    gone = F.coalesce((F.col("level") == 0) & ~F.col("sealed") & F.col("doc_id").isin("d0000230", "d0000100"), F.lit(False))
    return t.tree_nodes.where(~gone).select("node_id", "level")


@query("""with incoming as (select namespace, src_doc_id, 'sym:Z' as dst_sym, edge_kind, max(confidence) as confidence from code_edges where src_doc_id like '%0' group by 1, 2, 3, 4)
  select namespace, src_doc_id, dst_sym, edge_kind, confidence from incoming union all
  select namespace, src_doc_id, dst_sym, edge_kind, confidence from code_edges o where not exists (select 1 from incoming n where n.namespace = o.namespace and n.src_doc_id = o.src_doc_id)""")
def replace_edges(t):
    old = t.code_edges.select("namespace", "src_doc_id", "dst_sym", "edge_kind", "confidence")
    new = tables.last_of(old.where(F.col("src_doc_id").like("%0")).withColumn("dst_sym", F.lit("sym:Z")), ["namespace", "src_doc_id", "dst_sym", "edge_kind"], ["confidence"])
    return tables.replace(old, new, ["namespace", "src_doc_id"])


@query("""select key, regexp_replace(key, '[^A-Za-z0-9]', '_', 'g') as slug, sha256(case when right(document_id, 1) = '3' then content || '!' else content end) as digest
  from memory_docs where namespace = 'repo:en' and right(document_id, 1) in ('3', '4')""")
def vault_changed(t):
    from lorespark.streaming.vault import changed

    docs = t.memory_docs.where(F.col("namespace") == NS)
    before = docs.where(F.right("document_id", F.lit(1)) != "4").select("key", F.sha2("content", 256).alias("digest"))
    now = docs.withColumn("content", F.when(F.right("document_id", F.lit(1)) == "3", F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return changed(now, before).select("key", "slug", "digest")


@query("select src_doc_id, dst_sym, edge_kind, max(confidence) as confidence from (select src_doc_id, 'sym:' || right(dst_sym, 1) as dst_sym, edge_kind, confidence from code_edges) group by 1, 2, 3")
def dedup_edges(t):
    short = t.code_edges.withColumn("dst_sym", F.concat(F.lit("sym:"), F.right("dst_sym", F.lit(1))))
    return graph.dedup_edges(short, ["src_doc_id"]).drop("src_line")


@query("select dst_sym, edge_kind, case when dst_sym in ('sym:F1', 'sym:F2') then 1.0::double when dst_sym in ('sym:X1', 'sym:F3') then 0.6::double else 0.3::double end as confidence, count(*) as n from code_edges group by 1, 2, 3")
def edge_confidence(t):
    value = graph.confidence(F.col("dst_sym"), F.array(F.lit("sym:F1"), F.lit("sym:F2")), F.array(F.lit("sym:X1"), F.lit("sym:F3")))
    return t.code_edges.withColumn("confidence", value).groupBy("dst_sym", "edge_kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("select document_id, count(distinct entity_id) as n from chunk_entities where namespace = 'repo:en' and entity_id in ('sym:F3', 'sym:F4', 'handle:u3') group by 1")
def docs_with_entities(t):
    return tables.docs_with_entities(t.chunk_entities, NS, ["sym:F3", "sym:F4", "handle:u3"])
