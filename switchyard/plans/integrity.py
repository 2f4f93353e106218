"""Queries on canonical tables: identifiers, derived columns, rules and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import prices as pr
from switchyard.functions import text as tx
from switchyard.operators import canonical as cn
from switchyard.operators import splits as sp
from switchyard.operators import validation as va
from switchyard.plans import views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return add


def _sql_id(prefix: str, *parts: str) -> str:
    return f"'{prefix}-' || substr(sha256({' || chr(31) || '.join(parts)}), 1, 24)"


@_register("canonical_ids", f"select doc_id, {_sql_id('qry', chr(39) + 'set' + chr(39), 'coalesce(lang, ' + chr(39) + 'None' + chr(39) + ')', 'cast(doc_id as varchar)')} as query_id from documents")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", tx.canonical_id("qry", F.lit("set"), "lang", "doc_id").alias("query_id"))


_FAMILY_CASES = " ".join(f"when starts_with(nm, '{p}') then '{p}'" for p in tx.FAMILY_PREFIXES)


@_register(
    "family_inference",
    f"""with raw as (select p_partkey, case p_partkey % 6 when 0 then 'Meta/Meta-Llama-3-' || p_size || 'B' when 1 then 'qwen/Qwen2.5-Coder-' || p_size || 'b'
  when 2 then 'llama3-' || p_size || 'b' when 3 then 'x/y/Mistral-Large-3-' || p_size when 4 then 'Org/' || p_brand else p_name end as ident from part),
base as (select *, lower(split_part(ident, '/', -1)) as n0 from raw),
one as (select *, case when starts_with(n0, 'meta-llama-') then substr(n0, 6) else n0 end as n1 from base),
two as (select *, case when starts_with(n1, 'llama3-') then 'llama-3-' || substr(n1, 8) else n1 end as nm from one)
select p_partkey, case when contains(ident, '/') then lower(split_part(ident, '/', 1)) else 'unknown' end as developer, case {_FAMILY_CASES} else nm end as family from two""",
)
def family_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 6
    ident = (
        F.when(kind == 0, F.concat(F.lit("Meta/Meta-Llama-3-"), "p_size", F.lit("B")))
        .when(kind == 1, F.concat(F.lit("qwen/Qwen2.5-Coder-"), "p_size", F.lit("b")))
        .when(kind == 2, F.concat(F.lit("llama3-"), "p_size", F.lit("b")))
        .when(kind == 3, F.concat(F.lit("x/y/Mistral-Large-3-"), "p_size"))
        .when(kind == 4, F.concat(F.lit("Org/"), "p_brand"))
        .otherwise(F.col("p_name"))
    )
    return part.select("p_partkey", tx.developer(ident).alias("developer"), tx.family(ident).alias("family"))


@_register(
    "size_label_parse",
    """with raw as (select p_partkey, case p_partkey % 4 when 0 then p_size || 'B' when 1 then p_size || '.5b' when 2 then p_brand else '.5B' end as label from part)
select p_partkey, case when regexp_full_match(label, '[0-9]+(\\.[0-9]+)?[bB]') then cast(label[:-2] as double) end as billions from raw""".replace("\\\\", "\\"),
)
def size_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 4
    label = F.when(kind == 0, F.concat("p_size", F.lit("B"))).when(kind == 1, F.concat("p_size", F.lit(".5b"))).when(kind == 2, F.col("p_brand")).otherwise(F.lit(".5B"))
    return views.table(spark, sf_dir, "part").select("p_partkey", tx.parameter_billions(label).alias("billions"))


@_register("slugs", r"select url, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '--', 'g'), '-.') as slug from pages")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("url", tx.slug("url").alias("slug"))


@_register("iso_timestamps", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when microsecond(ts) % 1000000 <> 0 then '.' || lpad(cast(microsecond(ts) % 1000000 as varchar), 6, '0') else '' end || '+00:00' as iso, ts as parsed from events")
def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = tx.isoformat(F.col("ts").cast("timestamp"))
    return views.table(spark, sf_dir, "events").select("event_id", iso.alias("iso"), tx.parse_iso8601(iso).cast("timestamp_ntz").alias("parsed"))


@_register(
    "pairwise_unpivot",
    """with t as (select conv_id, turn, role, text, lead(role) over w as r2, lead(text) over w as t2 from conversations window w as (partition by conv_id order by turn)),
p as (select conv_id, turn, text as answer_1, t2 as answer_2, 1 + (conv_id + turn) % 2 as judge from t where role = 'user' and r2 = 'assistant')
select conv_id, turn, 1 as position, 'user' as model, 'assistant' as paired_model, sha256(answer_1) as response_sha256, case when judge = 1 then 1.0::double else 0.0::double end as score from p
union all select conv_id, turn, 2, 'assistant', 'user', sha256(answer_2), case when judge = 2 then 1.0::double else 0.0::double end from p""",
)
def pairwise_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = views.table(spark, sf_dir, "conversations").withColumns({"r2": F.lead("role").over(w), "t2": F.lead("text").over(w)}).where("role = 'user' and r2 = 'assistant'")
    compared = turns.select("conv_id", "turn", F.lit("user").alias("model_1"), F.lit("assistant").alias("model_2"), F.col("text").alias("answer_1"), F.col("t2").alias("answer_2"), (1 + (F.col("conv_id") + F.col("turn")) % 2).alias("judge"))
    both = cn.unpivot_comparisons(compared)
    return both.select("conv_id", "turn", F.col("candidate_position").cast("int").alias("position"), "model", "paired_model", tx.sha256_hex("response").alias("response_sha256"), "score")


@_register("metadata_json_rest", """select doc_id, '{"n_chars":' || n_chars || ',"source":"' || source || '"}' as metadata_json from documents""")
def metadata_json_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", cn.metadata_rest(docs, {"doc_id", "text", "lang"}).alias("metadata_json"))


_CLASH = """aliased as (
  select s_suppkey as model_id, unnest([lower(s_name), 'alias-' || (s_suppkey // 3), 'supplier-' || s_suppkey]) as alias from supplier
)"""


@_register("alias_collisions", f"with {_CLASH} select alias, min(model_id) as first, max(model_id) as second, count(distinct model_id) as n from aliased group by 1 having count(distinct model_id) > 1")
def alias_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.floor(F.col("s_suppkey") / 3)
    aliases = F.array("s_name", F.concat(F.lit("  ALIAS-"), third, F.lit(" ")), F.concat(F.lit("supplier-"), "s_suppkey"))
    models = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model_id"), aliases.alias("aliases"))
    return va.shared_aliases(models)


@_register("fk_violations", "select l_suppkey as s_suppkey, count(*) as rows from lineitem where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 7 <> 0) group by 1")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose supplier is missing; every seventh supplier is left out so that there are some."""
    known = views.table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0")
    lost = va.orphans(views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", known, "s_suppkey")
    return lost.groupBy("s_suppkey").agg(F.count("*").alias("rows"))


@_register("duplicate_keys", "select l_orderkey || ':' || l_linenumber as item, count(*) as n from lineitem group by 1 having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("item"))
    return va.duplicate_keys(items, "item")


@_register("token_total_violations", f"with {views.OUTCOMES_SQL} select query_id, model_id from outcomes where input_tokens + output_tokens <> input_tokens + output_tokens + (query_id + model_id) % 2")
def token_total_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes whose total is off by one where the sum of the ids is odd."""
    rows = views.outcomes(spark, sf_dir).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens") + (F.col("query_id") + F.col("model_id")) % 2)
    return va.token_total_mismatches(rows).select("query_id", "model_id")


@_register("has_outcomes_drift", "select o_orderkey as query_id, o_orderkey % 5 <> 0 as has_outcomes from orders where (o_orderkey % 5 <> 0) <> (o_orderkey in (select l_orderkey from lineitem))")
def has_outcomes_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 5 != 0).alias("has_outcomes"))
    rows = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"))
    return va.has_outcomes_drift(queries, rows).select("query_id", "has_outcomes")


@_register("outcome_count_per_query", "select l_orderkey as query_id, count(*) as n from lineitem group by 1 having count(*) <> 4")
def outcome_count_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").select(F.lit("c").alias("source_config"), F.lit("train").alias("source_split"), F.col("l_orderkey").alias("query_id"))
    return va.outcome_counts_off(rows, 4).select("query_id", "n")


@_register("copied_field_differences", "select l_orderkey, l_linenumber, count(*) as rows from lineitem join orders on l_orderkey = o_orderkey where l_linestatus is distinct from o_orderstatus group by 1, 2")
def copied_field_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_linestatus").alias("status"))
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return va.copied_field_differences(items, orders, ["k"], ["status"]).groupBy(F.col("k").alias("l_orderkey"), "l_linenumber").agg(F.count("*").alias("rows"))


@_register(
    "model_registry_merge",
    """with reg as (select 'org/' || lower(s_name) as api, s_name as name from supplier where s_suppkey % 2 = 0),
known as (select lower(api) as alias, api from reg union select lower(name), api from reg),
seen as (select distinct s_name as alias from supplier where s_suppkey % 3 = 0),
extra as (select k.api, s.alias from seen s join known k on lower(s.alias) = k.alias),
fresh as (select alias from seen where lower(alias) not in (select alias from known)),
al as (select api, api as raw from reg union select api, name from reg union select api, alias from extra union select alias, alias from fresh)
select 'mdl-' || substr(sha256('set' || chr(31) || lower(api)), 1, 24) as model_id, string_agg(raw, '|' order by lower(raw), raw) as aliases from al group by api""",
)
def model_registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = views.table(spark, sf_dir, "supplier")
    registry = supplier.where("s_suppkey % 2 = 0").select(
        F.col("s_name").alias("model_name"), F.concat(F.lit("org/"), F.lower("s_name")).alias("api_model_id"), F.lit("svc").alias("service"), F.lit("8B").alias("size"), F.lit("").alias("description")
    )
    seen = supplier.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("alias"))
    merged = cn.build_models(registry, seen, dataset_id="set", revision="r1")
    return merged.select("model_id", F.array_join("aliases", "|").alias("aliases"))


@_register("price_snapshot", f"with {views.PRICES_SQL} select model_id, {_sql_id('price', chr(39) + 'snap' + chr(39), 'cast(model_id as varchar)')} as price_id, input_per_unit from prices qualify row_number() over (partition by model_id order by effective_at desc) = 1")
def price_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.prices(spark, sf_dir).groupBy("model_id").agg(F.max_by("input_per_unit", "effective_at").alias("input_per_unit"))
    return rows.select("model_id", tx.canonical_id("price", F.lit("snap"), "model_id").alias("price_id"), "input_per_unit")


@_register("cost_usd", "select l_orderkey, l_linenumber, l_suppkey, round(sum(((q - q // 5) * 1.0 + (q // 5) * 0.5 + t * 2.0) / 1e6), 9) as cost_usd from (select *, cast(round(l_quantity * 100) as bigint) as q, cast(round(l_tax * 1000) as bigint) as t from lineitem) group by 1, 2, 3")
def cost_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.round(F.col("l_quantity") * 100).cast("long"), F.round(F.col("l_tax") * 1000).cast("long")
    cost = pr.cost_usd(q, F.floor(q / 5), t, F.lit(1.0), F.lit(0.5), F.lit(2.0))
    return views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.round(F.sum(cost), 9).alias("cost_usd"))


@_register("model_identities", "select 'm-' || s_suppkey as model_id, r_name as provider, lower(n_name) as family, 'm-' || s_suppkey || '|supplier-' || s_suppkey as aliases from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def model_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.model_identities(views.models(spark, sf_dir)).select("model_id", "provider", "family", F.array_join("aliases", "|").alias("aliases"))


@_register("source_row_digest")
def source_row_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = sp.ordered_digest(views.queries(spark, sf_dir))
    return spark.createDataFrame([("queries", digest)], "table string, digest string")
