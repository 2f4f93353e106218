"""The driver tables seen as the routing data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows a task of tables that are grouped by nearly as many keys as they have rows; and of those that don't occupy all cores twice.
TASK_ROWS, LEAST_ROWS = 400_000, 50_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows`` by keys in as many tasks as ``n`` rows take.

    Grouping then finds each key in one place.  In the tasks that scan, a map
    of partial groups would shrink nothing and grow with the size of a split.
    """
    return rows.repartition(max(1, -(-n // TASK_ROWS), min(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS))), *keys)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompts; every fiftieth is a probe."""
    null = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("query_id"),
        F.col("text").alias("prompt"),
        F.concat_ws(":", "lang", "source").alias("task"),
        "source",
        null.alias("source_query_id"),
        null.alias("lineage_id"),
        F.lit(None).cast("timestamp").alias("observed_at"),
        (F.col("doc_id") % 50 == 0).alias("is_probe"),
    )


def dated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated queries."""
    null = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("query_id"),
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("prompt"),
        F.col("o_orderpriority").alias("task"),
        F.lit("orders").alias("source"),
        null.alias("source_query_id"),
        null.alias("lineage_id"),
        F.col("o_orderdate").cast("timestamp").alias("observed_at"),
        F.lit(False).alias("is_probe"),
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as models of nations as families and regions as providers."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        F.concat(F.lit("m-"), "s_suppkey").alias("model_id"),
        F.col("r_name").alias("provider"),
        F.lower("n_name").alias("family"),
        F.lit("v1").alias("version"),
        F.array(F.concat(F.lit("supplier-"), "s_suppkey")).alias("aliases"),
        F.timestamp_add("DAY", (F.col("s_suppkey") % 400).cast("int"), F.lit("1992-01-01").cast("timestamp")).alias("available_at"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as outcomes, one row a (query, model): scores in thousandths, tokens, latency in days, cost in micro-dollars."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = lines.count()
    items = dealt(lines, n, "l_orderkey").join(dealt(orders, n, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.abs(F.datediff("l_shipdate", "o_orderdate"))
    held = items.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("model_id"), F.col("o_orderpriority").alias("task")).agg(
        F.max(F.round(1000 - F.col("l_discount") * 10000).cast("int")).alias("score_milli"),
        F.sum(F.round(F.col("l_quantity") * 100).cast("long")).alias("input_tokens"),
        F.sum(F.round(F.col("l_tax") * 1000).cast("long") + F.col("l_linenumber")).alias("output_tokens"),
        F.max(days).alias("latency"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("failed"),
        F.min("l_shipdate").alias("at"),
    )
    micro = F.col("input_tokens") * (1 + F.col("model_id") % 7) + F.col("output_tokens") * (2 + F.col("model_id") % 5)
    return held.withColumns({"score": F.col("score_milli") / 1000.0, "cost_micro": micro, "cost": micro / 1e6, "succeeded": F.col("failed") == 0})


#: The same view as common table expressions.
OUTCOMES_SQL = """
held as (
  select l_orderkey as query_id, l_suppkey as model_id, o_orderpriority as task,
    max(cast(round(1000 - l_discount * 10000) as integer)) as score_milli,
    cast(sum(cast(round(l_quantity * 100) as bigint)) as bigint) as input_tokens,
    cast(sum(cast(round(l_tax * 1000) as bigint) + l_linenumber) as bigint) as output_tokens,
    max(abs(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)))) as latency,
    max(case when l_returnflag = 'R' then 1 else 0 end) as failed,
    min(l_shipdate) as "at"
  from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3
), outcomes as (
  select *, score_milli / 1000.0 as score, cast(input_tokens * (1 + model_id % 7) + output_tokens * (2 + model_id % 5) as bigint) as cost_micro,
    (input_tokens * (1 + model_id % 7) + output_tokens * (2 + model_id % 5)) / 1e6 as cost, failed = 0 as succeeded
  from held
)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price for every supplier and month: the least price of an item in it, from the month's start."""
    items = table(spark, sf_dir, "lineitem")
    month = F.date_trunc("month", F.col("l_shipdate")).cast("timestamp")
    unit = F.floor(F.min(F.col("l_extendedprice") / F.col("l_quantity")) * 100) / 100.0
    keyed = items.select(F.col("l_suppkey").alias("model_id"), month.alias("effective_at"), "l_extendedprice", "l_quantity")
    return dealt(keyed, items.count(), "model_id", "effective_at").groupBy("model_id", "effective_at").agg(unit.alias("input_per_unit")).withColumns(
        {"cached_input_per_unit": F.col("input_per_unit") / 2, "output_per_unit": F.col("input_per_unit") * 2}
    )


PRICES_SQL = """
prices as (
  select l_suppkey as model_id, date_trunc('month', l_shipdate) as effective_at, floor(min(l_extendedprice / l_quantity) * 100) / 100.0 as input_per_unit
  from lineitem group by 1, 2
)"""


def model_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point a model: mean cost, quality and latency, rounded."""
    return outcomes(spark, sf_dir).groupBy("model_id").agg(
        F.round(F.sum("cost_micro") / F.count("*"), 3).alias("cost"), F.round(F.sum("score_milli") / F.count("*"), 3).alias("quality"), F.round(F.sum("latency") / F.count("*"), 3).alias("latency")
    )


POINTS_SQL = OUTCOMES_SQL + """, points as (
  select model_id, round(sum(cost_micro) / count(*), 3) as cost, round(sum(score_milli) / count(*), 3) as quality, round(sum(latency) / count(*), 3) as latency
  from outcomes group by 1
)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score made of their length."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = F.least(F.lit(0.999), F.round(F.col("n_chars") / 8000, 3))
    return docs.join(labels, "doc_id").select("doc_id", F.col("quality").alias("label"), score.alias("score"), "n_chars", "toxic")


PREDICTIONS_SQL = """
predictions as (
  select d.doc_id, quality as label, least(0.999, round(n_chars / 8000, 3)) as score, n_chars, toxic from documents d join labels l on d.doc_id = l.doc_id
)"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a route log: the event type is the chosen model, the hour's share of a user its probability."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("route_id"),
        F.col("user_id").alias("stream"),
        F.col("ts").alias("event_time"),
        F.col("event_type").alias("model_id"),
        k.alias("k"),
        (F.col("event_id") % 1000).cast("int").alias("regret_milli"),
        ((1 + F.coalesce(k, F.lit(0)) % 4) / 8.0).alias("probability"),
    )


ROUTES_SQL = """
routes as (
  select event_id as route_id, user_id as stream, ts as event_time, event_type as model_id, cast(json_extract_string(props, '$.k') as integer) as k,
    cast(event_id % 1000 as integer) as regret_milli, (1 + coalesce(cast(json_extract_string(props, '$.k') as integer), 0) % 4) / 8.0 as probability
  from events
)"""
