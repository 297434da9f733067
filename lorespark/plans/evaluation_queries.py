"""Queries of retrieval quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.operators import evaluation as ev
from lorespark.operators import search
from lorespark.plans.base import NS, query

_RANKS = "ranks as (select q.query_id, min(h.rank) as first_rank from (select distinct query_id from gold) q left join (select distinct query_id, path from gold) g on g.query_id = q.query_id left join hits h on h.query_id = g.query_id and h.path = g.path group by 1)"
_KS = "(select unnest([1, 5, 10]) as k)"


@query(f"with {_RANKS} select query_id, first_rank from ranks")
def first_gold_rank(t):
    return ev.first_gold_rank(t.gold, t.hits)


@query(f"with {_RANKS} select k, round(avg(coalesce(first_rank <= k, false)::int), 6) as recall, count(*) as n_queries from ranks, {_KS} group by 1")
def recall_at_k(t):
    return ev.recall_at(t.gold, t.hits, [1, 5, 10])


@query(f"with {_RANKS} select lang, 5 as k, round(avg(coalesce(first_rank <= 5, false)::int), 6) as recall, count(*) as n_queries from ranks join (select distinct query_id, lang from gold) using (query_id) group by 1")
def recall_by_lang(t):
    return ev.recall_at(t.gold, t.hits, [5], ["lang"])


@query(f"with b as (select q.query_id, min(h.rank) as r from (select distinct query_id from gold where line_lo is not null) q left join gold g on g.query_id = q.query_id and line_lo is not null left join hits h on h.query_id = g.query_id and h.path = g.path and not (h.line_end < g.line_lo or h.line_start > g.line_hi) group by 1) select k, round(avg(coalesce(r <= k, false)::int), 6) as recall, count(*) as n_queries from b, {_KS} group by 1")
def line_recall_at_k(t):
    return ev.line_recall_at(t.gold, t.hits, [1, 5, 10])


@query("select round(avg((d.key is not null)::int), 6) as rate, count(*) as n from (select key from memory_docs union all select 'missing/' || item_id from benchmark) w left join memory_docs d using (key)")
def ingest_rate(t):
    wanted = t.memory_docs.select("key").union(t.benchmark.select(F.concat(F.lit("missing/"), F.col("item_id").cast("string"))))
    there = t.memory_docs.select("key", F.lit(1).alias("there"))
    return wanted.join(there, "key", "left").agg(F.round(F.avg(F.coalesce("there", F.lit(0))), 6).alias("rate"), F.count(F.lit(1)).alias("n"))


@query("select count_if(score >= 0.55)::bigint as false_alarms, count(*) as n from hits where rank = 1 and is_negative")
def hard_neg_fp(t):
    return t.hits.where("rank = 1 and is_negative").agg(F.count_if(F.col("score") >= 0.55).alias("false_alarms"), F.count(F.lit(1)).alias("n"))


@query("""with floors as (select unnest([0.0, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7])::double as floor),
  kept as (select floor, h.*, row_number() over (partition by floor, query_id order by rank) as r from hits h, floors where score >= floor),
  rec as (select f.floor, round(avg(exists (select 1 from kept k join gold g on g.query_id = k.query_id and g.path = k.path where k.r <= 5 and k.floor = f.floor and k.query_id = q.query_id)::int), 6) as recall from floors f, (select distinct query_id from gold) q group by 1)
  select floor, recall, (select count_if(score >= floor)::bigint from hits where rank = 1 and is_negative) as false_alarms, (select count(*) from hits where rank = 1 and is_negative) as n_negatives from rec""")
def abstain_sweep(t):
    return ev.floor_sweep(t.gold, t.hits, t.hits.where("rank = 1 and is_negative").select("query_id", "score"), [0.0, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70])


_SETS = "g as (select query_id as set_id, 'mod/' || path as path, 'layer' || (query_id + line_hi) % 2 as layer from gold), p as (select query_id as set_id, case when rank % 2 = 0 then './Mod/' || path when rank % 5 = 0 then 'other' || path else path end as path from hits), gn as (select set_id, layer, lower(path) as path from g), pn as (select set_id, lower(regexp_replace(path, '^[./]+', '')) as path from p), m as (select gn.set_id, gn.path as g, pn.path as p from gn join pn on gn.set_id = pn.set_id and (gn.path = pn.path or ends_with(gn.path, '/' || pn.path) or ends_with(pn.path, '/' || gn.path)))"


def _sets(t):
    g = t.gold.select(F.col("query_id").alias("set_id"), F.concat(F.lit("mod/"), "path").alias("path"), F.concat(F.lit("layer"), ((F.col("query_id") + F.col("line_hi")) % 2).cast("string")).alias("layer"))
    p = t.hits.select(F.col("query_id").alias("set_id"), F.when(F.col("rank") % 2 == 0, F.concat(F.lit("./Mod/"), "path")).when(F.col("rank") % 5 == 0, F.concat(F.lit("other"), "path")).otherwise(F.col("path")).alias("path"))
    return g, p


@query(f"""with {_SETS}, n as (select s.set_id, (select count(distinct path) from gn where gn.set_id = s.set_id) as ng, (select count(distinct path) from pn where pn.set_id = s.set_id) as np, (select count(distinct g) from m where m.set_id = s.set_id) as tp, (select count(distinct p) from m where m.set_id = s.set_id) as mp from (select distinct set_id from gn union select set_id from pn) s),
  pr as (select set_id, mp / np as p, tp / ng as r from n) select set_id, round(p, 3) as precision, round(r, 3) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 3) as f1 from pr""")
def path_prf(t):
    return ev.path_prf(*_sets(t))


@query(f"with {_SETS}, l as (select set_id, layer, max(case when exists (select 1 from m where m.set_id = gn.set_id and m.g = gn.path) then 1 else 0 end) as hit from gn where layer is not null group by 1, 2) select set_id, round(avg(hit), 3) as coverage, sum(hit)::bigint as covered, count(*) as layers from l group by 1")
def layer_coverage(t):
    g, p = _sets(t)
    return ev.layer_coverage(g.where("layer is not null"), p)


@query("""with top as (select query_id, path from hits where rank <= 10), q as (select distinct query_id from hits), bad as (select query_id, path from gold where line_hi = 12)
  select query_id, round((select count(*) from top t where t.query_id = q.query_id and path in (select path from gold g where g.query_id = q.query_id) and path not in (select path from bad b where b.query_id = q.query_id)) / 10.0, 6)::double as precision,
    round((select count(distinct path) from top t where t.query_id = q.query_id and path in (select path from gold g where g.query_id = q.query_id)) / (select count(distinct path) from gold g where g.query_id = q.query_id)::double, 6) as recall from q""")
def graph_precision(t):
    return ev.precision_recall_at(t.hits.select("query_id", "path", "rank"), t.gold.select("query_id", "path"), t.gold.where("line_hi = 12").select("query_id", "path"), 10)


@query(f"with {_RANKS}, m as (select 'recall@5' as metric, avg(coalesce(first_rank <= 5, false)::int) as value, 0.8::double as bar from ranks union all select 'recall@10', avg(coalesce(first_rank <= 10, false)::int), 0.1 from ranks) select metric, round(value, 6) as value, bar, value >= bar as passed from m")
def acceptance_bars(t):
    bars = t.spark.createDataFrame([(5, "recall@5", 0.8), (10, "recall@10", 0.1)], "k int, metric string, bar double")
    return ev.recall_at(t.gold, t.hits, [5, 10]).join(F.broadcast(bars), "k").select("metric", F.col("recall").alias("value"), "bar", (F.col("recall") >= F.col("bar")).alias("passed"))


_ARMS = "select query_id as set_id, case when rank % 2 = 0 then 'with' else 'without' end as arm, cast(((query_id * 7 + rank * 3) % 20) / 40.0 as double) as value from hits where rank in (1, 2)"


@query(f"with s as ({_ARMS}), w as (select a.set_id, a.value as a, b.value as b from s a join s b on a.set_id = b.set_id and a.arm = 'with' and b.arm = 'without') select round(avg(a), 6) as mean_one, round(avg(b), 6) as mean_other, count_if(a - b > 0.02)::bigint as wins, count_if(a - b < -0.02)::bigint as losses, count_if(a - b <= 0.02 and a - b >= -0.02)::bigint as ties from w")
def ab_wins(t):
    return ev.wins(t.spark.sql(_ARMS.replace("from hits", "from {hits}"), hits=t.hits), "with", "without")


_JUDGED = "select query_id, arm, judge, cast((query_id * arm_no + judge * 5) % 3 as double) as score from (select query_id, rank as judge from {0} where rank <= 3) h cross join (select 'A' as arm, 4 as arm_no union all select 'B', 7) a"


@query(f"with j as ({_JUDGED.format('hits')}), m as (select query_id, arm, median(score) as score from j group by 1, 2), a as (select round(avg(case when arm = 'A' then score end), 6) as mean_a, round(avg(case when arm = 'B' then score end), 6) as mean_b from m) select mean_a, mean_b, mean_a - mean_b >= 0.20 as passed from a")
def judge_gate(t):
    j = t.spark.sql(_JUDGED.format("{hits}"), hits=t.hits)
    m = j.groupBy("query_id", "arm").agg(F.median("score").alias("score"))
    of = lambda arm: F.round(F.avg(F.when(F.col("arm") == arm, F.col("score"))), 6)
    return m.agg(of("A").alias("mean_a"), of("B").alias("mean_b")).withColumn("passed", F.col("mean_a") - F.col("mean_b") >= 0.20)


@query("select count_if(not bad)::bigint as ok, count_if(bad)::bigint as err, round(count_if(bad) / count(*), 6) as rate, count_if(bad) / count(*) <= 0.10 as passed from (select status in ('failed', 'error') as bad from jobs)")
def fallback_rate(t):
    return ev.fallback_rate(t.jobs.select("status"))


@query("""with l as (select key as path, unnest(string_split(lower(content), chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as i from memory_docs where namespace = 'repo:en')
  select path, count(*) as n_lines, min(i)::int as first_line from l where contains(line, 'retitioning') or contains(line, 'blees') or contains(line, 'heention') group by 1 order by n_lines desc, path limit 10""")
def grep_baseline(t):
    return search.grep(t.memory_docs.where(F.col("namespace") == NS), "how is the retitioning used by blees heention")


@query("select key as path, contains(lower(key), 'src')::int + contains(lower(key), 'tests')::int + contains(lower(key), 'src1')::int as score from memory_docs where score > 0 order by score desc, path limit 10")
def filename_baseline(t):
    return search.by_filename(t.memory_docs, "where are the src tests of src1")


# Dollars for a million prompt and completion tokens in this fixture.
PRICES = {"small": (0.25, 1.0), "large": (3.0, 15.0)}


@query("select conv_id, turn, round(case conv_id % 3 when 0 then length(text) * 0.25 / 1e6 + turn * 1.0 / 1e6 when 1 then length(text) * 3.0 / 1e6 + turn * 15.0 / 1e6 else 0 end, 9)::double as cost from conversations")
def llm_cost(t):
    price = t.spark.createDataFrame([(k, *v) for k, v in PRICES.items()], "model string, p_in double, p_out double")
    calls = t.conversations.select("conv_id", "turn", F.length("text").alias("n_in"), F.when(F.col("conv_id") % 3 == 0, "small").when(F.col("conv_id") % 3 == 1, "large").otherwise("unknown").alias("model"))
    cost = F.coalesce(F.col("n_in") / 1e6 * F.col("p_in") + F.col("turn") / 1e6 * F.col("p_out"), F.lit(0.0))
    return calls.join(F.broadcast(price), "model", "left").select("conv_id", "turn", F.round(cost, 9).alias("cost"))


@query("select doc_id, case when strpos(lower(text), 'retitioning') > 0 then substring(text, greatest(1, strpos(lower(text), 'retitioning') - 300), 2000) when strpos(lower(text), 'heention') > 0 then substring(text, greatest(1, strpos(lower(text), 'heention') - 300), 2000) when strpos(lower(text), 'tion') > 0 then substring(text, greatest(1, strpos(lower(text), 'tion') - 300), 2000) else substring(text, 1, 2000) end as part from documents")
def context_window(t):
    from lorespark.functions.window import around

    return t.documents.select("doc_id", around(F.col("text"), "The tion heention retitioning").alias("part"))
