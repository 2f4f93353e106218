"""Queries on prompts: fingerprints, duplicate evidence, clusters and splits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import text as tx
from switchyard.operators import deduplication as dd
from switchyard.operators import splits as sp
from switchyard.plans import views

QUERIES: dict = {}
SQL: dict[str, str] = {}

CONFIG = sp.SplitBuildConfig("documents", "generated", "canonical-v1")

_NORM = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))"
_SHINGLES = rf"""
norm as materialized (select cast(doc_id as varchar) as query_id, text, {_NORM} as n from documents),
tok as (select query_id, regexp_extract_all(n, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_ ]') as t from norm),
sh as materialized (
  select query_id, list_distinct(list_transform(
    case when len(t) = 0 then [''] when len(t) < 3 then t else list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], chr(31))) end,
    lambda g: substr(sha256(g), 1, 16))) as h
  from tok
)"""
_PAIRS = _SHINGLES + """,
copies as materialized (select query_id, min(query_id) over (partition by n) as a, count(*) over (partition by n) as size from norm),
classes as materialized (select query_id, size from copies where query_id = a),
sig as (select query_id, unnest(list_sort(h)[1:8]) as bucket from sh join classes using (query_id)),
cand as (select distinct a.query_id as a, b.query_id as b from sig a join sig b on a.bucket = b.bucket and a.query_id < b.query_id),
scored as (select a, b, len(list_intersect(x.h, y.h)) as i, len(x.h) as na, len(y.h) as nb from cand join sh x on x.query_id = a join sh y on y.query_id = b),
pairs as materialized (
  select a, b, i / (na + nb - i) as similarity from scored where i / (na + nb - i) >= 0.9
  union all select a, query_id, 1.0::double from copies where a <> query_id
)"""
_CLUSTERS = _PAIRS + """,
fp as (select query_id, sha256(text) as e, sha256(n) as m from norm),
edges as materialized (
  select a, b, 'near_duplicate' as reason from pairs
  union all select min(query_id) over (partition by e), query_id, 'exact_prompt' from fp
  union all select min(query_id) over (partition by m), query_id, 'normalized_prompt' from fp
),
both_ways as (select a, b from edges where a <> b union select b, a from edges where a <> b),
reach as (select query_id as id, query_id as low from norm union select e.b, r.low from reach r join both_ways e on e.a = r.id),
roots as materialized (select id as query_id, min(low) as root from reach group by 1),
named as (select root, 'dup-' || substr(sha256(string_agg(query_id, chr(31) order by query_id)), 1, 20) as cluster_id, count(*) as size from roots group by 1),
members as materialized (select query_id, cluster_id, size from roots join named using (root))"""


def _register(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return add


@_register("fp_exact_normalized", f"select cast(doc_id as varchar) as query_id, sha256(text) as exact_sha256, sha256({_NORM}) as normalized_sha256 from documents")
def fp_exact_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.fingerprints(views.queries(spark, sf_dir))


@_register("norm_collision_groups", f"select sha256({_NORM}) as normalized_sha256, count(*) as queries, count(distinct sha256(text)) as exact_forms from documents group by 1 having count(*) > 1")
def norm_collision_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = dd.fingerprints(views.queries(spark, sf_dir))
    return prints.groupBy("normalized_sha256").agg(F.count("*").alias("queries"), F.count_distinct("exact_sha256").alias("exact_forms")).where("queries > 1")


@_register("token_shingle_counts", f"with {_SHINGLES} select tok.query_id, cast(len(t) as bigint) as tokens, cast(len(h) as bigint) as shingles from tok join sh on sh.query_id = tok.query_id")
def token_shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = tx.normalize_prompt("prompt")
    return views.queries(spark, sf_dir).select("query_id", F.size(tx.tokens(norm)).cast("long").alias("tokens"), F.size(tx.shingle_hashes(norm)).cast("long").alias("shingles"))


@_register("signature_buckets", f"with {_SHINGLES}, sig as (select query_id, unnest(list_sort(h)[1:8]) as bucket from sh) select bucket, count(*) as n from sig group by 1 having count(*) > 1")
def signature_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.signature_buckets(dd.shingled(views.queries(spark, sf_dir)))[1].withColumn("bucket", tx.hash_digits("bucket"))


@_register("near_dup_pairs", f"with {_PAIRS} select a, b, round(similarity, 6) as similarity from pairs")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between distinct texts, and of every copy to the smallest id of its text."""
    pairs, _ = dd.near_duplicate_pairs(views.queries(spark, sf_dir))
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@_register("dup_clusters", f"with recursive {_CLUSTERS} select query_id, cluster_id from members")
def dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.deduplicate_queries(views.queries(spark, sf_dir)).members.select("query_id", "cluster_id")


@_register("cluster_reasons", f"with recursive {_CLUSTERS} select distinct cluster_id, reason from edges join members on query_id = a where a <> b")
def cluster_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.deduplicate_queries(views.queries(spark, sf_dir)).reasons.select("cluster_id", "reason")


@_register(
    "dedup_report_counts",
    f"""with recursive {_CLUSTERS}
select 'queries' as measure, count(*) as value from members
union all select 'clusters', count(distinct cluster_id) from members
union all select 'multi_query_clusters', count(distinct cluster_id) from members where size > 1
union all select 'near_duplicate_pairs', cast((select coalesce(sum(x.size * y.size), 0) from pairs join classes x on x.query_id = a join classes y on y.query_id = b) + (select sum(size * (size - 1) / 2) from classes) as bigint)
union all select 'reason:' || reason, count(distinct cluster_id) from edges join members on query_id = a where a <> b group by reason""",
)
def dedup_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.report_counts(dd.deduplicate_queries(views.queries(spark, sf_dir)))


_PROBES = _CLUSTERS + """,
probes as (select query_id from members where cluster_id in (select cluster_id from members where cast(query_id as bigint) % 50 = 0))"""


@_register("probe_closure", f"with recursive {_PROBES} select query_id from probes")
def probe_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = views.queries(spark, sf_dir)
    return sp.probe_closure(queries, dd.deduplicate_queries(queries).members)


def _walk(namespace: str, groups: str = "groups") -> str:
    """The ratio walk in SQL; the last two groups may be forced into what is still empty."""
    return f"""
ordered as (
  select *, row_number() over (order by o, group_id) - 1 as i, count(*) over () as n,
    coalesce(sum(size) over (order by o, group_id rows between unbounded preceding and 1 preceding), 0) as consumed, sum(size) over () as total
  from (select group_id, size, sha256('3407' || chr(31) || '{namespace}' || chr(31) || group_id) as o from {groups}) g
),
nat as (
  select *, case when consumed + size / 2 <= 0.8::double * total then 'train' when consumed + size / 2 <= (0.8::double + 0.1::double) * total then 'validation' else 'test' end as p from ordered
),
taken as (select distinct p from nat where i < n - 2),
empties as (select s, k from (values ('train', 1), ('validation', 2), ('test', 3)) v(s, k) where s not in (select p from taken)),
used as (select coalesce((select list(s order by k) from empties), cast([] as varchar[])) as e, (select p from nat where i = n - 2) as p2),
placed as (
  select group_id, size, case
    when n = 3 then ['train', 'validation', 'test'][i + 1]
    when i = n - 2 and len(e) = 2 then e[1]
    when i = n - 1 and len(e) = 2 then e[2]
    when i = n - 1 and len(list_filter(e, lambda s: s <> p2)) = 1 then list_filter(e, lambda s: s <> p2)[1]
    else p end as partition
  from nat, used
)"""


_SIMPLE_GROUPS = _PROBES + """,
eligible as (select m.query_id, m.cluster_id from members m where m.query_id not in (select query_id from probes)),
grouped as (
  select query_id, 'query-group-' || substr(sha256(string_agg(query_id, chr(31)) over (partition by cluster_id order by query_id rows between unbounded preceding and unbounded following)), 1, 20) as group_id
  from eligible
),
groups as (select group_id, count(*) as size from grouped group by 1)"""
_TASK_GROUPS = _PROBES + """,
eligible as (select m.query_id, 'c:' || m.cluster_id as c, 'k:' || lang || ':' || source as k from members m join documents d on cast(d.doc_id as varchar) = m.query_id where m.query_id not in (select query_id from probes)),
links as (select c as a, k as b from eligible union select k, c from eligible),
spread as (select a as id, a as low from links union select l.b, s.low from spread s join links l on l.a = s.id),
kin as (select id, min(low) as root from spread group by 1),
grouped as (
  select query_id, 'query-group-' || substr(sha256(string_agg(query_id, chr(31)) over (partition by root order by query_id rows between unbounded preceding and unbounded following)), 1, 20) as group_id
  from eligible join kin on kin.id = c
),
groups as (select group_id, count(*) as size from grouped group by 1)"""


def _split(name: str, strategy: str, groups: str) -> None:
    sql = f"with recursive {groups}, {_walk(strategy + ':queries')} select partition, count(*) as groups, cast(sum(size) as bigint) as queries from placed group by 1"

    @_register(name, sql)
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        queries = views.queries(spark, sf_dir)
        members = dd.deduplicate_queries(queries).members
        probes = sp.materialize(sp.probe_closure(queries, members), "probes")
        grouped = sp.atomic_query_groups(queries, members, probes, by_task=strategy in ("task_held_out", "joint_new_model_new_task"))
        sized = grouped.groupBy("group_id").agg(F.count("*").alias("size")).withColumn("_order", tx.sha256_hex(tx.joined(F.lit(str(CONFIG.seed)), F.lit(f"{strategy}:queries"), "group_id")))
        placed = sp.ratio_partition(sized, ["_order", "group_id"], CONFIG.ratios, f"{strategy}:queries")
        return placed.groupBy("partition").agg(F.count("*").alias("groups"), F.sum("size").alias("queries"))


_split("split_prompt_iid", "prompt_iid", _SIMPLE_GROUPS)
_split("split_task_held_out", "task_held_out", _TASK_GROUPS)
_split("split_joint", "joint_new_model_new_task", _TASK_GROUPS)

_MODEL_GROUPS = """
keyed as (select 'm-' || s_suppkey as model_id, {key} as k from supplier join nation on s_nationkey = n_nationkey),
grouped as (
  select model_id, 'model-group-' || substr(sha256(string_agg(model_id, chr(31)) over (partition by k order by model_id rows between unbounded preceding and unbounded following)), 1, 20) as group_id from keyed
),
groups as (select group_id, count(*) as size from grouped group by 1)"""


def _model_split(name: str, strategy: str, key: str) -> None:
    sql = f"with {_MODEL_GROUPS.format(key=key)}, {_walk(strategy + ':models')} select g.model_id, p.partition from grouped g join placed p using (group_id)"

    @_register(name, sql)
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        models = views.models(spark, sf_dir)
        sp.check_models(models)
        groups = sp.model_groups(models, by_family=strategy == "family_held_out")
        return sp._assign(groups, "model_id", f"{strategy}:models", CONFIG, None, None)


_model_split("split_model_held_out", "model_held_out", "s_suppkey")
_model_split("split_family_held_out", "family_held_out", "lower(n_name)")

_TEMPORAL = """
days as (select o_orderdate as o, count(*) as size from orders group by 1),
ordered as (
  select *, row_number() over (order by o) - 1 as i, count(*) over () as n,
    coalesce(sum(size) over (order by o rows between unbounded preceding and 1 preceding), 0) as consumed, sum(size) over () as total
  from days
),
placed as (
  select o, size, case when consumed + size / 2 <= 0.8::double * total then 'train' when consumed + size / 2 <= (0.8::double + 0.1::double) * total then 'validation' else 'test' end as partition from ordered
)
select partition, count(*) as groups, cast(sum(size) as bigint) as queries, min(o) as first_day, max(o) as last_day from placed group by 1"""


@_register("split_temporal", f"with {_TEMPORAL.strip()}")
def split_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated orders without duplicates: groups are days, and the walk is along time."""
    queries = views.dated_queries(spark, sf_dir)
    members = queries.select("query_id", F.col("query_id").alias("cluster_id"))
    probes = queries.where("is_probe").select("query_id")
    groups = sp.materialize(sp.atomic_query_groups(queries, members, probes, by_time=True), "groups")
    dated = groups.join(queries.select("query_id", "observed_at"), "query_id")
    sized = dated.groupBy("group_id").agg(F.count("*").alias("size"), F.max("observed_at").alias("_order"), F.min("observed_at").alias("first"))
    placed = sp.ratio_partition(sized, ["_order", "group_id"], CONFIG.ratios, "query")
    out = placed.groupBy("partition").agg(F.count("*").alias("groups"), F.sum("size").alias("queries"), F.min("first").alias("first_day"), F.max("_order").alias("last_day"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_day", "last_day")})


_LEAK = f"""with recursive {_SIMPLE_GROUPS}, {_walk('family_held_out:queries')},
honest as (select g.query_id, p.partition from grouped g join placed p using (group_id) union all select query_id, 'probe' from probes),
planted as (select query_id, case when partition <> 'probe' and cast(query_id as bigint) % 7 = 0 then 'test' else partition end as partition from honest),
torn as (select m.cluster_id from planted p join members m using (query_id) group by 1 having count(distinct p.partition) > 1)
select cast(6 as integer) as rule, 'duplicate cluster ' || cluster_id || ' crosses query partitions' as detail from torn"""


@_register("split_leak_audit", _LEAK)
def split_leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken promises of a family split into whose test queries every seventh id was planted."""
    queries, models = views.queries(spark, sf_dir), views.models(spark, sf_dir)
    found = dd.deduplicate_queries(queries)
    split = sp.build_split("family_held_out", queries, models, found, CONFIG, check=False)
    leaked = F.when((F.col("partition") != "probe") & (F.col("query_id").cast("long") % 7 == 0), "test").otherwise(F.col("partition"))
    planted = replace(split, queries=sp.materialize(split.queries.withColumn("partition", leaked), "planted"))
    return sp.split_violations(planted, queries, models, found)
