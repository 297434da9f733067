"""Queries of scalar functions: paths, terms, tokens, entities, version-control records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.functions import paths, text
from lorespark.plans.base import query
from lorespark.plans.search_queries import _PATHS, _PRIOR
from lorespark.sources import vcs

ODD = ["LICENSE", "src/COPYING.md", "a/b/Notice", "README", "x/.env.local", "pkg/foo.test.ts", "pkg/spec/a.rs", "lib/foo_test.go", "Cargo.toml", "a.MIN.js", "img/A.PNG", "dir.d/file", "fixtures/x.c", "m/.eslintrc.json", ".prettierrc", "CONTRIBUTING.md", "x/Cargo.lock", "a/t.h", "b/q.C++", "z.tsx", "noext"]
_ODD = ", ".join(f"'{x}'" for x in ODD)


def _every(t):
    odd = t.spark.createDataFrame([(x,) for x in ODD], "key string")
    return t.memory_docs.select("key").union(odd)


_EVERY = f"every as (select key from memory_docs union all select unnest([{_ODD}]) as key)"


@query(f"with {_EVERY}, p as ({_PATHS} from every) select key, {_PRIOR} as prior from p")
def path_prior(t):
    return _every(t).select("key", paths.path_prior(F.col("key")).alias("prior"))


@query(f"with {_EVERY}, p as ({_PATHS} from every) select key from p where base in ('.editorconfig', 'rustfmt.toml', '.rustfmt.toml', 'clippy.toml', 'contributing.md', 'pyproject.toml', 'setup.cfg', '.pylintrc', 'tsconfig.json', '.gitattributes') or starts_with(base, '.eslintrc') or starts_with(base, '.prettierrc')")
def config_files(t):
    return _every(t).where(paths.is_config_file(F.col("key")))


@query(f"with {_EVERY}, p as ({_PATHS} from every), s as (select *, regexp_extract(key, '[^/]*$') as name, length(key) * 14000 as n_bytes from p) select key, n_bytes::bigint as n_bytes, n_bytes <= 256000 and name not in ('package-lock.json', 'pnpm-lock.yaml', 'yarn.lock', 'Cargo.lock', 'bun.lockb') and not regexp_matches(low, '\\.(min\\.js|map|svg|png|gif|jpg|jpeg|ico|webp|woff|woff2|ttf|eot|pdf|mp3|mp4|wav)$') as indexable from s")
def should_index(t):
    n = (F.length("key") * 14000).cast("long")
    return _every(t).select("key", n.alias("n_bytes"), paths.should_index(F.col("key"), n).alias("indexable"))


@query("select document_id from memory_docs where json_extract_string(meta, '$.kind') = 'file'")
def source_docs(t):
    return t.memory_docs.where(F.get_json_object("meta", "$.kind") == "file").select("document_id")


@query("select json_extract_string(meta, '$.kind') as kind, count(*) as n from memory_docs group by 1")
def meta_kind_counts(t):
    return t.memory_docs.groupBy(F.get_json_object("meta", "$.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_EVERY} select key, case when contains(key, '/') then regexp_extract(key, '^(.*)/[^/]*$', 1) else '.' end as dir from every")
def dir_key(t):
    return _every(t).select("key", paths.dir_key(F.col("key")).alias("dir"))


@query(f"with {_EVERY}, p as (select key, lower(regexp_extract(key, '[^.]*$')) as e from every) select key, case when e = 'rs' then 'rust' when e in ('py', 'pyi') then 'python' when e in ('js', 'jsx', 'mjs', 'cjs') then 'javascript' when e in ('ts', 'mts', 'cts') then 'typescript' when e = 'tsx' then 'tsx' when e = 'go' then 'go' when e in ('kt', 'kts') then 'kotlin' when e = 'java' then 'java' when e = 'c' then 'c' when e in ('cc', 'cpp', 'cxx', 'c++', 'hpp', 'hh', 'hxx', 'h') then 'cpp' end as lang from p")
def lang_for_path(t):
    return _every(t).select("key", paths.lang_for_path(F.col("key")).alias("lang"))


@query("select doc_id, case when text is null then null else len(list_filter(['the', 'and', 'tion', 'the', 'zz9'], lambda w: contains(lower(text), w))) / 5.0 end::double as score from documents")
def keyword_overlap(t):
    return t.documents.select("doc_id", text.overlap("the AND tion The zz9", F.col("text")).alias("score"))


@query(r"select item_id, array_to_string(list_distinct_ordered, '|') as terms from (select item_id, list_filter(list_transform(range(1, len(w) + 1), lambda i: case when list_position(w, w[i]) = i then w[i] end), lambda x: x is not null) as list_distinct_ordered from (select item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: octet_length(encode(x)) >= 3) as w from benchmark))")
def query_terms(t):
    return t.benchmark.select("item_id", F.array_join(text.terms_of(F.col("text")), "|").alias("terms"))


@query(r"select item_id, array_to_string(flatten(list_transform(list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda x: octet_length(encode(x)) >= 3 and regexp_matches(x, '^\p{L}')), lambda x: ['sym:' || x, 'import:' || x])), '|') as entities from benchmark")
def query_code_entities(t):
    return t.benchmark.select("item_id", F.array_join(text.code_entities_of_query(F.col("text")), "|").alias("entities"))


@query(r"with x as (select doc_id, text || repeat('漢字かなカナ한', (doc_id % 4)::int) as text from documents where text is not null) select doc_id, (length(text) - length(regexp_replace(text, '[\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]', '', 'g')) + ceil(length(regexp_replace(text, '[\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]', '', 'g')) / 4.0))::bigint as tokens from x")
def estimate_tokens(t):
    some = F.concat("text", F.repeat(F.lit("漢字かなカナ한"), (F.col("doc_id") % 4).cast("int")))
    return t.documents.where("text is not null").select("doc_id", text.estimate_tokens(some).alias("tokens"))


@query("select doc_id, greatest(1, floor(length(text) / 4))::bigint as tokens from documents")
def approx_tokens(t):
    return t.documents.select("doc_id", text.approx_tokens(F.col("text")).alias("tokens"))


_W = r"\p{L}\p{M}\p{Nd}\p{Pc}"


@query(rf"""select conv_id, turn, array_to_string(list_sort(list_distinct(
    list_transform(regexp_extract_all(text, '[{_W}.+-]+@[{_W}-]+\.[{_W}.-]+'), lambda x: 'email:' || lower(x)) || list_transform(regexp_extract_all(text, 'https?://[^\s]+'), lambda x: 'url:' || x)
    || list_transform(regexp_extract_all(regexp_replace(text, 'https?://[^\s]+', ' ', 'g'), '(?:^|[^{_W}@])@([{_W}]+)', 1), lambda x: 'handle:' || lower(x))
    || list_transform(regexp_extract_all(regexp_replace(text, 'https?://[^\s]+', ' ', 'g'), '(?:^|[^{_W}#])#([{_W}]+)', 1), lambda x: 'hashtag:' || lower(x)))), '|') as entities from mentions""")
def extract_entities(t):
    return t.mentions.select("conv_id", "turn", F.array_join(text.entities(F.col("text")), "|").alias("entities"))


@query(r"""select doc_id, array_to_string(list_sort(list_distinct(
    list_transform(regexp_extract_all(code, '(?m)^\s*(?:pub\s+)?(?:async\s+)?(?:fn|def|class|struct|enum|interface|trait|type|func)\s+([A-Za-z_][A-Za-z0-9_]*)', 1), lambda x: 'sym:' || x)
    || list_transform(regexp_extract_all(code, '(?m)^\s*(?:use|import|from|require|include|using)\s+([^\s;(){}''"]+)', 1), lambda x: 'import:' || x))), '|') as entities from snippets""")
def extract_code_entities(t):
    return t.snippets.select("doc_id", F.array_join(text.code_entities(F.col("code")), "|").alias("entities"))


_LOGS = "select conv_id, string_agg(rec, '' order by turn) as log from (select conv_id, turn, chr(1) || case when turn % 5 = 4 then 'torn' else 'sha' || cast(conv_id as string) || '-' || cast(turn as string) || chr(31) || role || ' <' || role || '@x.org>' || chr(31) || role || '@x.org' || chr(31) || case when turn % 3 = 2 then 'soon' else cast(1700000000 + turn as string) end || chr(31) || ' ' || split_part(text, chr(10), 1) || ' ' || chr(31) || case when turn % 2 = 0 then '' else text || chr(10) end || chr(30) || chr(10) || 'src/a' || cast(turn as string) || '.rs' || chr(10) || chr(10) || ' b.md ' || chr(10) end as rec from conversations where text is not null) group by conv_id"


def _logs(t):
    rec = "chr(1) || case when turn % 5 = 4 then 'torn' else 'sha' || cast(conv_id as string) || '-' || cast(turn as string) || chr(31) || role || ' <' || role || '@x.org>' || chr(31) || role || '@x.org' || chr(31) || case when turn % 3 = 2 then 'soon' else cast(1700000000 + turn as string) end || chr(31) || ' ' || split_part(text, chr(10), 1) || ' ' || chr(31) || case when turn % 2 = 0 then '' else text || chr(10) end || chr(30) || chr(10) || 'src/a' || cast(turn as string) || '.rs' || chr(10) || chr(10) || ' b.md ' || chr(10) end"
    parts = t.conversations.where("text is not null").select("conv_id", F.struct("turn", F.expr(rec).alias("r")).alias("x"))
    return parts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]), "").alias("log"))


_COMMITS = rf"""logs as ({_LOGS}), rec as (select unnest(string_split(log, chr(1))) as r from logs), cut as (select string_split(string_split(r, chr(30))[1], chr(31)) as f, string_split(r, chr(30))[2] as blob from rec where contains(r, chr(30))),
  commits as (select regexp_replace(f[1], '^\s+|\s+$', '', 'g') as sha, regexp_replace(f[2], '^\s+|\s+$', '', 'g') as author, regexp_replace(f[3], '^\s+|\s+$', '', 'g') as email, coalesce(try_cast(trim(f[4]) as bigint), 0) as ts, regexp_replace(f[5], '^\s+|\s+$', '', 'g') as subject, regexp_replace(f[6], '^\s+|\s+$', '', 'g') as body, list_filter(list_transform(string_split(blob, chr(10)), lambda x: trim(x)), lambda x: x <> '') as files from cut where len(f) >= 6)"""


@query(f"with {_COMMITS} select sha, author, email, ts, subject, body, array_to_string(files, '|') as files from commits")
def parse_git_log(t):
    return vcs.parse_log(_logs(t)).select("sha", "author", "email", F.col("timestamp").alias("ts"), "subject", "body", F.array_join("files", "|").alias("files"))


@query(f"with {_COMMITS} select 'commit:' || sha as key, case when subject = '' then 'commit:' || sha else substring(subject, 1, 72) end as title, author, md5(subject || case when body <> '' then chr(10) || chr(10) || body else '' end || case when len(files) > 0 then chr(10) || chr(10) || 'Changed files:' || chr(10) || array_to_string(files, chr(10)) else '' end) as digest from commits")
def commit_docs(t):
    return vcs.commit_docs(vcs.parse_log(_logs(t))).select("key", "title", "author", F.md5(F.col("content").cast("binary")).alias("digest"))


_DIFF = """case doc_id % 8 when 0 then 'A' || chr(9) || key when 1 then 'M' || chr(9) || key when 2 then 'D' || chr(9) || key when 3 then 'R100' || chr(9) || key || chr(9) || 'moved/' || key
  when 4 then 'C75' || chr(9) || key || chr(9) || 'copied/' || key || chr(10) when 5 then 'T' || chr(9) || key when 6 then '' else 'A' || chr(9) || key || chr(9) || 'more' end"""
_DIFFS = f"lines as (select {_DIFF} as line from (select *, cast(substring(document_id, 2, 9) as bigint) as doc_id from memory_docs where namespace = 'repo:en') x), f as (select string_split(rtrim(line, chr(10)), chr(9)) as f from lines), changes as (select case when len(f) = 2 and f[1] = 'A' then 'added' when len(f) = 2 and f[1] = 'M' then 'modified' when len(f) = 2 and f[1] = 'D' then 'deleted' when len(f) = 3 and f[1] like 'R%' then 'renamed' when len(f) = 3 and f[1] like 'C%' then 'copied' end as op, case when op in ('deleted', 'renamed') then f[2] end as old, case when op in ('added', 'modified') then f[2] when op in ('renamed', 'copied') then f[3] end as new from f where op is not null)"


def _changes(t):
    docs = t.memory_docs.where("namespace = 'repo:en'").withColumn("doc_id", F.expr("cast(substring(document_id, 2, 9) as bigint)"))
    return vcs.parse_diff(docs.select(F.expr(_DIFF.replace("chr(9)", "char(9)").replace("chr(10)", "char(10)")).alias("line")))


@query(f"with {_DIFFS} select * from changes")
def parse_diff(t):
    return _changes(t)


@query(f"""with {_DIFFS}, held as (select namespace, key, 'old' as content, 1::bigint as n_bytes from memory_docs where namespace = 'repo:en' and not key like '%.ts'),
  come as (select distinct new as key from changes where new is not null), fresh as (select 'repo:en' as namespace, key, 'new' as content, (length(key) * 14000)::bigint as n_bytes from come where length(key) * 14000 <= 256000)
  select * from fresh union all select * from held h where key not in (select old from changes where old is not null) and key not in (select key from fresh)""")
def apply_diff(t):
    held = t.memory_docs.where("namespace = 'repo:en' and not key like '%.ts'").select("namespace", "key", F.lit("old").alias("content"), F.lit(1).cast("long").alias("n_bytes"))
    changes = _changes(t)
    contents = changes.where("new is not null").select(F.col("new").alias("key"), F.lit("new").alias("content"), (F.length("new") * 14000).cast("long").alias("n_bytes")).distinct()
    return vcs.apply_diff(held, changes, contents, "repo:en")
