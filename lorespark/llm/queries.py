"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import decontaminate, html, lines, mixing, passages, quality, rules, simhash, sstable, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op3_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_table(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicate_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_partners", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_simhash_dedup, op2_html_extraction, op3_token_tables, op4_quality_classifier, op5_token_counts, op6_source_mixing, op7_line_dedup, op8_quality_rules, op9_decontamination, op10_repeated_passages, pipeline]
    return {f.__name__: f for f in found}


#: The mix in DuckDB; every other operator needs a hash, a model or an algorithm that SQL lacks and is tested by brute force.
OP6_SQL = r"""
with base as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 15))::bigint as hash_ord from documents),
s as (select source, sum(size)::bigint as source_size from base group by source),
r as (select *, row_number() over (order by source is null, encode(source)) as rk from s),
w as (select *, ((rk - 1) % 3 + 1)::bigint as weight, ((rk - 1) % 3)::bigint as place from r),
b as (select *, (3 * source_size) / weight::double as bound from w),
l as (select *,
    ((sum(source_size) over ())::double - 3 * coalesce((sum(source_size) over o)::double, 0)) / ((sum(weight) over ())::double - coalesce((sum(weight) over o)::double, 0)) as level
  from b window o as (order by bound, rk rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, place, least(weight * (select arg_min(level, (bound, rk)) from l where level <= bound), (3 * source_size)::double) as target from l),
p as (select base.doc_id, size, source_size, target, place,
    coalesce(sum(size) over (partition by rank_source, bucket order by ord, base.doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as inner_sum, rank_source, bucket
  from (select base.*, t.source_size, t.target, t.place, hash_ord as ord, coalesce(base.source, chr(0)) as rank_source, hash_ord % k.buckets as bucket
        from base join (select source, ceil(sqrt(count(*)))::bigint as buckets from base group by source) k on base.source is not distinct from k.source join t on base.source is not distinct from t.source) base),
u as (select rank_source, bucket, sum(size) as bucket_size from p group by all),
v as (select rank_source, bucket, coalesce(sum(bucket_size) over (partition by rank_source order by bucket rows between unbounded preceding and 1 preceding), 0) as start from u),
q as (select p.*, inner_sum + start as before from p join v on p.rank_source = v.rank_source and p.bucket = v.bucket),
c as (select *, case when size > 0 and target - before - size / 2.0 >= 0 then least(3, floor((target - before - size / 2.0) / source_size)::bigint + 1) else 0 end::bigint as copies from q),
z as (select *, least(1.0, (before + size / 2.0) / target) as share, case place when 0 then 0.5 when 1 then 0.0 else -0.5 end as ramp from c)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, copies,
  case when copies > 0 then case when ramp = 0 then share else 2 * share / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * share)) end end as position
from z
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mixing": OP6_SQL}
