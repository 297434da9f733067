"""Logical tables of the knowledge base, derived from the driver's tables.

Each derivation is one SQL text in the subset that Spark and DuckDB share, so queries and their oracles start from
equal inputs. ``Tables`` resolves them as DataFrames on demand; ``oracle`` puts those a body names before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PAD = "'d' || lpad(cast({} as string), 7, '0')"

LOGICAL = {
    "memory_docs": f"""
      select {_PAD.format("doc_id")} as document_id, 'repo:' || lang as namespace,
        case when doc_id % 10 <= 4 then 'src/' || source || '/f' || cast(doc_id as string) || '.rs'
             when doc_id % 10 = 5 then 'docs/' || source || '/f' || cast(doc_id as string) || '.md'
             when doc_id % 10 = 6 then 'tests/' || source || '/f' || cast(doc_id as string) || '.py'
             when doc_id % 10 = 7 then 'examples/' || source || '/f' || cast(doc_id as string) || '.ts'
             when doc_id % 10 = 8 then source || '/f' || cast(doc_id as string) || '/rustfmt.toml'
             else source || '/LICENSE-' || cast(doc_id as string) end as key,
        substring(text, 1, 72) as title, text as content, source as author,
        case when doc_id % 5 = 0 then 'external_sync' else 'internal' end as taint,
        cast(1700000000 + 60 * doc_id as double) as created_at,
        cast(1700000000 + 60 * doc_id + 3600 * (doc_id % 7) as double) as updated_at,
        case when doc_id % 3 = 0 then null else '{{{{"kind":"file"}}}}' end as meta
      from {{documents}}""",
    "chunk_base": f"""
      select m.namespace, m.document_id, m.key, m.author, e.vec_id as v, m.document_id || '#' || cast(e.vec_id % 2 as string) as chunk_id,
        d.text, e.embedding, case when e.vec_id % 50 = 0 then 'hash:32' else 'hash:64' end as model_signature, 64 as dim, m.created_at,
        case when m.meta is null then null when e.vec_id % 2 = 0 then 1 else 41 end as line_start,
        case when m.meta is null then null when e.vec_id % 2 = 0 then 40 else 80 end as line_end
      from {{embeddings}} e join {{documents}} d on d.doc_id = e.vec_id
      join {{memory_docs}} m on m.document_id = {_PAD.format("cast(floor(e.vec_id / 2) as bigint)")}""",
    "vector_chunks": "select namespace, document_id, chunk_id, text, embedding, model_signature, dim, created_at, line_start, line_end from {chunk_base}",
    "chunk_entities": """
      select namespace, chunk_id, document_id, 'handle:u' || cast(v % 13 as string) as entity_id from {chunk_base}
      union all select namespace, chunk_id, document_id, 'hashtag:t' || cast(v % 7 as string) from {chunk_base}
      union all select namespace, chunk_id, document_id, 'sym:F' || cast(v % 37 as string) from {chunk_base} where line_start is not null
      union all select namespace, chunk_id, document_id, 'import:m' || cast(v % 11 as string) from {chunk_base} where line_start is not null
      union all select namespace, chunk_id, document_id, 'path:' || key from {chunk_base} where line_start is not null""",
    "code_edges": """
      select namespace, document_id as src_doc_id, 'sym:F' || cast((7 * v + 3) % 37 as string) as dst_sym, cast(null as string) as dst_doc_id,
        'CALLS' as edge_kind, cast(v % 40 + 1 as int) as src_line, case v % 3 when 0 then cast(1.0 as double) when 1 then cast(0.6 as double) else cast(0.3 as double) end as confidence
      from {chunk_base} where line_start is not null and v % 2 = 0
      union all select namespace, document_id, 'sym:X' || cast(v % 5 as string), cast(null as string), 'CALLS', cast(v % 40 + 1 as int), cast(0.3 as double)
      from {chunk_base} where line_start is not null and v % 2 = 0
      union all select namespace, document_id, 'sym:T' || cast(v % 9 as string), cast(null as string), 'USES_TYPE', cast(null as int), cast(0.6 as double)
      from {chunk_base} where line_start is not null and v % 2 = 0""",
    "jobs": """
      select 'ns:' || cast(event_id as string) as job_id, 'repo:en' as namespace, cast(event_id as string) as document_id,
        case event_type when 'view' then 'running' when 'click' then 'done' when 'error' then 'failed' else 'pending' end as status,
        cast(event_id % 6 as int) as attempts, case when event_type = 'error' then 'boom' else null end as last_error,
        cast(1700000000 + 13 * (event_id % 9973) as double) as created_at, cast(1700000000 + 13 * event_id as double) as updated_at
      from {events}""",
    "tree_nodes": """
      select 'l0-' || lpad(cast(v as string), 8, '0') as node_id, 'repo:all' as namespace, 'global' as tree_kind, 'global' as tree_key, 0 as level, v as seq,
        v < 450 as sealed, author as label, text as body, document_id as doc_id, cast(greatest(1, floor(length(text) / 4)) as bigint) as token_count, embedding, cast(1700000000 + v as double) as created_at
      from {chunk_base}
      union all select 'l1-' || lpad(cast(cast(floor(v / 10) as bigint) as string), 8, '0'), 'repo:all', 'global', 'global', 1, cast(floor(v / 10) as bigint), v < 400, author, title || chr(10) || 'more', null, cast(40 as bigint), embedding, cast(1700010000 + v as double)
      from (select b.*, substring(text, 1, 60) as title from {chunk_base} b where v % 10 = 0 and v < 450) x
      union all select 'l2-' || lpad(cast(cast(floor(v / 100) as bigint) as string), 8, '0'), 'repo:all', 'global', 'global', 2, cast(floor(v / 100) as bigint), false, author, title, null, cast(40 as bigint), embedding, cast(1700020000 + v as double)
      from (select b.*, substring(text, 1, 60) as title from {chunk_base} b where v % 100 = 0 and v < 400) y""",
    "tree_edges": """
      select 'l1-' || lpad(cast(cast(floor(v / 10) as bigint) as string), 8, '0') as parent_id, 'l0-' || lpad(cast(v as string), 8, '0') as child_id from {chunk_base} where v < 450
      union all select 'l2-' || lpad(cast(cast(floor(v / 100) as bigint) as string), 8, '0'), 'l1-' || lpad(cast(cast(floor(v / 10) as bigint) as string), 8, '0') from {chunk_base} where v % 10 = 0 and v < 400""",
    "history_docs": """
      select 'h' || cast(conv_id as string) || '-' || cast(turn as string) as document_id, 'repo:en:history' as namespace, 'commit:' || cast(conv_id as string) || '-' || cast(turn as string) as key,
        substring(text, 1, 72) as title, text as content, role as author, conv_id, turn from {conversations}""",
    "history_chunks": """
      select h.namespace, h.document_id, h.document_id || '#0' as chunk_id, h.content as text, e.embedding, 'hash:64' as model_signature, h.conv_id, h.turn
      from {history_docs} h cross join (select count(*) as m, min(vec_id) as low from {embeddings}) c join {embeddings} e on e.vec_id = c.low + (h.conv_id * 7 + h.turn) % c.m""",
    "history_entities": "select namespace, document_id || '#0' as chunk_id, document_id, 'handle:' || author as entity_id from {history_docs}",
    "meta_docs": """
      select 'm' || document_id as document_id, namespace || ':meta' as namespace, case when document_id like '%1' then 'architecture-' || document_id else 'module:' || key end as key, title, content
      from {memory_docs} union all select 'mconv', 'repo:en:meta', 'conventions', 'conventions', 'Use tabs.' union all select 'march', 'repo:en:meta', 'architecture', 'architecture', 'All of it.' union all select 'mmod', 'repo:en:meta', 'module:src', 'module:src', 'The sources.'""",
    "mentions": "select conv_id, turn, 'ping @' || role || ' #c' || cast(conv_id % 7 as string) || ' see https://x.com/@a#s mail A.b' || cast(turn as string) || '@ex-am.org ' || text as text from {conversations}",
    "snippets": """
      select doc_id, 'use crate::m' || cast(doc_id % 11 as string) || ';' || chr(10) || 'pub async fn F' || cast(doc_id % 37 as string) || '() {{ g(); }}' || chr(10) || '  struct S' || cast(doc_id % 5 as string) || chr(10) || 'import {{ a }}' || chr(10)
        || 'from pkg.' || source || ' import x' || chr(10) || 'let fn_x = 1' || chr(10) || text as code from {documents}""",
    "gold": """
      select b.item_id as query_id, case b.item_id % 3 when 0 then 'en' when 1 then 'de' else 'fr' end as lang, 'f' || cast((b.item_id * 7 + g.n) % 50 as string) || '.rs' as path,
        case when b.item_id % 2 = 0 then cast(10 * g.n + 1 as int) else null end as line_lo, case when b.item_id % 2 = 0 then cast(10 * g.n + 12 as int) else null end as line_hi
      from {benchmark} b cross join (select 0 as n union all select 1 union all select 2) g""",
    "hits": """
      select b.item_id as query_id, cast(r.n + 1 as int) as rank, 'f' || cast((b.item_id * 3 + r.n * 5) % 50 as string) || '.rs' as path, cast(r.n * 4 as int) as line_start, cast(r.n * 4 + 9 as int) as line_end,
        cast(1.0 as double) / (r.n + 1 + b.item_id % 4) as score, b.item_id % 4 in (0, 1, 3) as is_negative
      from {benchmark} b cross join (select 0 as n union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8 union all select 9 union all select 10 union all select 11) r""",
}


class Tables:
    """The driver's tables and the logical ones of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in LOGICAL:
            inner = {n: getattr(self, n) for n in dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}", LOGICAL[name]))}
            found = self.spark.sql(LOGICAL[name], **inner)
        else:
            found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, found)
        return found


def oracle(body: str) -> str:
    """The body in DuckDB's SQL, after the logical tables it names, directly or through others."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in LOGICAL:
            if re.search(rf"\b{n}\b", text) and n not in order:
                need(LOGICAL[n])
                order.append(n)

    need(body)
    names = re.compile(r"(?<!\{)\{(\w+)\}")
    parts = [f"{n} as ({names.sub(lambda m: m[1], LOGICAL[n]).replace('{{', '{').replace('}}', '}')})" for n in order]
    body = body.strip()
    if body.lower().startswith("with "):
        recursive, body = body.lower().startswith("with recursive"), re.sub(r"^with (recursive )?", "", body, flags=re.I)
        return f"with {'recursive ' if recursive else ''}" + ",\n".join([*parts, body])
    return (f"with {', '.join(parts)}\n" if parts else "") + body
