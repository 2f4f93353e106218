"""Queries on routing: costs, baselines, frontiers, metrics, replay and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.operators import metrics as mt
from switchyard.operators import replay as rp
from switchyard.operators import routing as ro
from switchyard.plans import views

QUERIES: dict = {}
SQL: dict[str, str] = {}

_O, _P, _PT, _PR, _R = views.OUTCOMES_SQL, views.PRICES_SQL, views.POINTS_SQL, views.PREDICTIONS_SQL, views.ROUTES_SQL


def _register(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


# prices and utilities


@_register("price_asof_cost", f"""with {_O}, {_P}
select o.query_id, o.model_id, p.input_per_unit, round(o.input_tokens * p.input_per_unit / 1e6, 6) as cost_usd
from outcomes o asof left join prices p on o.model_id = p.model_id and o."at" >= p.effective_at""")
def price_asof_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.outcomes(spark, sf_dir).select("query_id", "model_id", "input_tokens", F.col("at").cast("timestamp").alias("at"))
    priced = ro.price_asof(rows, views.prices(spark, sf_dir), "at")
    return priced.select("query_id", "model_id", "input_per_unit", F.round(F.col("input_tokens") * F.col("input_per_unit") / 1e6, 6).alias("cost_usd"))


@_register("runtime_cost", f"""with {_R}, t as (select *, lag(model_id) over (partition by stream order by event_time, route_id) as previous from routes)
select route_id, round(k / 100.0 + case when previous is not null and previous <> model_id then 0.25 else 0 end + 0.01, 6) as cost from t""")
def runtime_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    previous = F.lag("model_id").over(Window.partitionBy("stream").orderBy("event_time", "route_id"))
    cost = ro.runtime_cost(F.col("k") / 100.0, F.col("model_id"), previous, switch_penalty=0.25, fixed_fee=0.01)
    return views.routes(spark, sf_dir).select("route_id", F.round(cost, 6).alias("cost"))


@_register("hard_filter", f"with {_O} select query_id, model_id from outcomes where cost <= 0.02 and latency <= 60")
def hard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ro.hard_filter(views.outcomes(spark, sf_dir), max_cost=0.02, max_latency=60).select("query_id", "model_id")


def _first(order: str, columns: str = "query_id, model_id, score_milli, cost_micro") -> str:
    return f"with {_O} select {columns} from outcomes qualify row_number() over (partition by query_id order by {order}) = 1"


def _baseline(name: str, kind: str, order: str) -> None:
    @_register(name, _first(order))
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ro.baseline(views.outcomes(spark, sf_dir), kind).select("query_id", "model_id", "score_milli", "cost_micro")


_baseline("baseline_cheapest", "cheapest", "cost, model_id")
_baseline("baseline_most_expensive", "most_expensive", "cost desc, model_id")
_baseline("baseline_random", "random", "sha256('0:' || query_id || ':' || model_id), model_id")
_baseline("oracle_best_quality", "oracle_quality", "score desc, cost, model_id")
_baseline("oracle_cheapest_success", "oracle_cheapest_success", "failed, case when failed = 0 then cost else -score end, model_id")


@_register("baseline_best_single", f"with {_O} select model_id, round(avg(score), 6) as mean_score from outcomes where query_id % 5 <> 0 group by 1 order by round(avg(score), 9) desc, model_id limit 1")
def baseline_best_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ro.best_single_model(views.outcomes(spark, sf_dir).where("query_id % 5 <> 0")))


@_register("baseline_per_domain", f"""with {_O}, m as (select task, model_id, round(avg(score), 9) as s from outcomes where query_id % 5 <> 0 group by 1, 2)
select task, model_id, round(s, 6) as mean_score from m qualify row_number() over (partition by task order by s desc, model_id) = 1""")
def baseline_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ro.best_single_model(views.outcomes(spark, sf_dir).where("query_id % 5 <> 0"), by="task")).select("task", "model_id", "mean_score")


@_register("oracle_gap", f"""with {_O}, o as (select query_id, max(score) as s from outcomes group by 1),
c as (select query_id, score from outcomes qualify row_number() over (partition by query_id order by cost, model_id) = 1)
select round(avg(o.s - c.score), 6) as oracle_gap from o join c using (query_id)""")
def oracle_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.outcomes(spark, sf_dir)
    return _rounded(mt.oracle_gap(ro.baseline(rows, "cheapest"), ro.baseline(rows, "oracle_quality")))


_UTILITY = "score - 0.3 * cost * 20 - 0.1 * latency / 120.0 - 0.5 * failed"


@_register("utility_route", f"with {_O}, u as (select *, round({_UTILITY}, 9) as u from outcomes) select query_id, model_id, round(u, 6) as utility from u qualify row_number() over (partition by query_id order by u desc, model_id) = 1")
def utility_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = ro.utility(F.col("score"), F.col("cost") * 20, F.col("latency") / 120.0, F.col("failed"))
    rows = views.outcomes(spark, sf_dir).withColumn("utility", F.round(value, 9))
    return ro.route_argmax(rows).select("query_id", "model_id", F.round("utility", 6).alias("utility"))


@_register("cost_mode_route", f"with {_O} select query_id, model_id, score >= 0.7 as met_threshold from outcomes qualify row_number() over (partition by query_id order by case when score >= 0.7 then 0 else 1 end, case when score >= 0.7 then cost else -score / (cost + 1e-9) end, model_id) = 1")
def cost_mode_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.outcomes(spark, sf_dir).withColumn("quality", F.col("score"))
    return ro.cost_mode(rows, 0.7).select("query_id", "model_id", "met_threshold")


@_register("preset_intelligence_route", f"with {_O} select query_id, model_id from outcomes qualify row_number() over (partition by query_id order by score desc, model_id) = 1")
def preset_intelligence_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.outcomes(spark, sf_dir).withColumn("quality", F.col("score"))
    return ro.preset_route(rows, "intelligence").select("query_id", "model_id")


@_register("preset_balanced_route", f"""with {_O} select query_id, model_id from outcomes
qualify row_number() over (partition by query_id order by 1.0::double * score - 0.3::double * cost - 0.1::double * latency desc, model_id) = 1""")
def preset_balanced_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.outcomes(spark, sf_dir).withColumn("quality", F.col("score"))
    return ro.preset_route(rows, "balanced").select("query_id", "model_id")


# quality and latency


@_register("quality_minmax", f"""with {_O}, s as (select task, min(score) lo, max(score) hi from outcomes group by 1)
select query_id, model_id, round(case when hi > lo then (score - lo) / (hi - lo) else 0 end, 6) as minmax, cast(score >= 0.5 as integer) as success from outcomes join s using (task)""")
def quality_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ro.normalized_quality(views.outcomes(spark, sf_dir)).select("query_id", "model_id", "minmax", "success"))


@_register("quality_zsigmoid", f"""with {_O}, s as (select task, avg(score) m, stddev_pop(score) sd from outcomes group by 1)
select query_id, model_id, round(1 / (1 + exp(-(score - m) / sd)), 6) as zsigmoid from outcomes join s using (task)""")
def quality_zsigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ro.normalized_quality(views.outcomes(spark, sf_dir)).select("query_id", "model_id", "zsigmoid"))


@_register("quality_percentile", f"with {_O} select query_id, model_id, round(percent_rank() over (partition by task order by score), 6) as percentile from outcomes")
def quality_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ro.quality_percentile(views.outcomes(spark, sf_dir)).select("query_id", "model_id", "percentile"))


@_register("latency_p50_p95", f"with {_O} select model_id, round(quantile_cont(latency, 0.5), 6) as p50, round(quantile_cont(latency, 0.95), 6) as p95, round(avg(ln(1 + latency)), 6) as mean_log1p from outcomes group by 1")
def latency_p50_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ro.latency_quantiles(views.outcomes(spark, sf_dir), "model_id"))


# frontiers

_FRONT = _PT + """, front as (
  select * from points p where not exists (select 1 from points o where o.cost <= p.cost and o.quality >= p.quality and (o.cost < p.cost or o.quality > p.quality))
)"""


@_register("pareto_frontier", f"with {_FRONT} select model_id, cost, quality from front")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ro.pareto_frontier(views.model_points(spark, sf_dir)).select("model_id", "cost", "quality")


@_register("pareto_frontier_3d", f"""with {_PT} select model_id, cost, quality, latency from points p where not exists (
  select 1 from points o where o.cost <= p.cost and o.quality >= p.quality and o.latency <= p.latency and (o.cost < p.cost or o.quality > p.quality or o.latency < p.latency))""")
def pareto_frontier_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ro.pareto_frontier_3d(views.model_points(spark, sf_dir)).select("model_id", "cost", "quality", "latency")


@_register("hypervolume", f"""with {_FRONT}, e as (select distinct cost, quality from front)
select round(sum(a), 3) as hypervolume from (select quality * (coalesce(lead(cost) over (order by cost), 100000) - cost) as a from e)""")
def hypervolume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ro.hypervolume(ro.pareto_frontier(views.model_points(spark, sf_dir)), 100000.0), 3)


@_register("pareto_distance", f"with {_FRONT} select p.model_id, round(min(sqrt((p.cost - f.cost) ** 2 + (p.quality - f.quality) ** 2)), 4) as pareto_distance from points p, front f group by 1")
def pareto_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.model_points(spark, sf_dir)
    return _rounded(mt.pareto_distance(points, ro.pareto_frontier(points)).select("model_id", "pareto_distance"), 4)


@_register("cost_at_quality", f"with {_PT} select min(cost) filter (quality >= 500) as cost_at_quality, max(quality) filter (cost <= 20000) as quality_at_cost from points")
def cost_at_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.model_points(spark, sf_dir)
    return mt.cost_at_quality(points, 500).join(mt.quality_at_cost(points, 20000))


# metrics


@_register("auroc", f"""with {_PR}, r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from predictions)
select round((sum(case when label = 1 then rk end) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) as auroc from r""")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.auroc(views.predictions(spark, sf_dir)))


@_register("pairwise_ranking_loss", f"""with {_PR}, n as (select score, sum(1 - label) as neg, sum(label) as pos from predictions group by 1),
c as (select pos, neg, sum(neg) over (order by score rows unbounded preceding) - neg as below, sum(neg) over () as negs, sum(pos) over () as poss from n)
select round(1 - sum(pos * (below + neg / 2.0)) / max(poss * negs), 6) as pairwise_loss from c""")
def pairwise_ranking_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.pairwise_ranking_loss(views.predictions(spark, sf_dir)))


@_register("auprc", f"""with {_PR}, s as (select score, sum(label) as pos, count(*) as n from predictions group by 1),
c as (select pos, sum(pos) over w as tp, sum(n) over w as k from s window w as (order by score desc rows unbounded preceding))
select round(sum(pos * tp / k) / sum(pos), 6) as auprc from c""")
def auprc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.auprc(views.predictions(spark, sf_dir)))


@_register("brier_ece", f"""with {_PR}, b as (select least(cast(floor(score * 10) as integer), 9) as bin, count(*) as n, avg(score) as s, avg(label) as l from predictions group by 1)
select (select round(avg((score - label) ** 2), 6) from predictions) as brier, round(sum(n * abs(s - l)) / sum(n), 6) as ece from b""")
def brier_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.predictions(spark, sf_dir)
    return _rounded(mt.brier(rows).join(mt.expected_calibration_error(rows)))


@_register("spearman", f"""with {_PR}, r as (
  select rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0 as a, rank() over (order by label) + (count(*) over (partition by label) - 1) / 2.0 as b from predictions)
select round(corr(a, b), 6) as spearman from r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.spearman(views.predictions(spark, sf_dir), "n_chars", "label"))


@_register("regression_errors", f"with {_O} select round(avg(abs(output_tokens - latency)), 6) as mae, round(avg(abs(ln(1 + output_tokens) - ln(1 + latency))), 6) as log_mae, round(quantile_cont(abs(output_tokens - latency), 0.95), 6) as p95_error from outcomes")
def regression_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.regression_errors(views.outcomes(spark, sf_dir), "output_tokens", "latency"))


@_register("losses", f"""with {_PR}, x as (select label, greatest(least(score, 1 - 1e-6), 1e-6) as p, abs(score - label) as e from predictions),
y as (select -(label * ln(p) + (1 - label) * ln(1 - p)) as c, e * e / 2 as h from x)
select round(avg(c), 6) as bce, round(avg(h), 6) as huber, round(avg(c + h), 6) as combined from y""")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.losses(views.predictions(spark, sf_dir)))


@_register("routing_summary", f"""with {_O}, c as (select * from outcomes qualify row_number() over (partition by query_id order by cost, model_id) = 1)
select count(*) as requests, round(avg(score), 6) as avg_quality, round(avg(cast(succeeded as integer)), 6) as success_rate, round(avg(cost), 6) as cost_per_request,
  round(avg(latency), 6) as avg_latency, round(quantile_cont(latency, 0.95), 6) as p95_latency from c""")
def routing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.routing_summary(ro.baseline(views.outcomes(spark, sf_dir), "cheapest")))


@_register("model_recall", f"""with {_O}, a as (select query_id, model_id from outcomes qualify row_number() over (partition by query_id order by cost, model_id) = 1),
b as (select query_id, model_id as m from outcomes qualify row_number() over (partition by query_id order by score desc, cost, model_id) = 1)
select round(avg(cast(model_id = m as integer)), 6) as model_recall from a join b using (query_id)""")
def model_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.outcomes(spark, sf_dir)
    return _rounded(mt.model_recall(ro.baseline(rows, "cheapest"), ro.baseline(rows, "oracle_quality")))


@_register("paired_difference", f"""with {_O}, a as (select query_id, score from outcomes qualify row_number() over (partition by query_id order by cost, model_id) = 1),
b as (select query_id, score as s from outcomes qualify row_number() over (partition by query_id order by score desc, cost, model_id) = 1), d as (select s - score as x from a join b using (query_id))
select count(*) as n, round(avg(x), 6) as mean_difference, round(stddev_samp(x) / sqrt(count(*)), 6) as standard_error, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 6) as t from d""")
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.outcomes(spark, sf_dir)
    return _rounded(mt.paired_difference(ro.baseline(rows, "oracle_quality"), ro.baseline(rows, "cheapest"), "query_id", "score"))


@_register("bootstrap_ci", f"""with {_PR}, d as (select range as sample, doc_id, label from predictions, range(20)),
w as (select sample, label, cast('0x' || substr(sha256('0:' || doc_id || ':' || sample), 1, 4) as integer) as bits from d),
v as (select sample, label, case when bits < 24109 then 0 when bits < 48218 then 1 when bits < 60273 then 2 when bits < 64291 then 3 else 4 end as w from w)
select cast(sample as integer) as sample, round(sum(w * label) / sum(w), 6) as mean from v group by 1""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.bootstrap_means(views.predictions(spark, sf_dir), "doc_id", "label", samples=20))


# replay


@_register("cumulative_regret", f"with {_R} select route_id, cast(sum(regret_milli) over (order by event_time, route_id rows unbounded preceding) as bigint) as cumulative_regret from routes")
def cumulative_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rp.cumulative_regret(views.routes(spark, sf_dir), ["event_time", "route_id"], "regret_milli")
    return rows.select("route_id", F.col("cumulative_regret").cast("long").alias("cumulative_regret"))


@_register("sliding_regret", f"with {_R} select route_id, round(avg(regret_milli) over (partition by stream order by event_time, route_id rows between 9 preceding and current row), 6) as sliding_regret from routes")
def sliding_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rp.sliding_regret(views.routes(spark, sf_dir), "stream", ["event_time", "route_id"], 10, "regret_milli").select("route_id", "sliding_regret"))


@_register("recovery_time", f"""with {_R}, t as (select stream, row_number() over w as n, avg(regret_milli) over (partition by stream order by event_time, route_id rows between 4 preceding and current row) as m
  from routes window w as (partition by stream order by event_time, route_id))
select stream, cast(min(n) - 10 as integer) as recovery from t where n > 10 and m <= 300 group by 1""")
def recovery_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.recovery_time(views.routes(spark, sf_dir), "stream", ["event_time", "route_id"], 10, 300, 5, "regret_milli")


@_register("replay_events", f"""with {_R}, shocks as (select stream, model_id as event, event_time as begins_at from routes where model_id = 'error' qualify row_number() over (partition by stream, event_time order by route_id) = 1)
select r.route_id, s.event, s.begins_at from routes r asof left join shocks s on r.stream = s.stream and r.event_time >= s.begins_at""")
def replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with the last error of their stream."""
    rows = views.routes(spark, sf_dir)
    shocks = rows.where("model_id = 'error'").select("stream", F.col("model_id").alias("event"), F.col("event_time").alias("begins_at")).distinct()
    return rp.replay_events(rows.select("route_id", "stream", "event_time"), shocks, "stream", "event_time").select("route_id", "event", "begins_at")


@_register("allocation_entropy", f"""with {_R}, c as (select date_trunc('day', event_time) as day, model_id, count(*) as n from routes group by 1, 2), p as (select day, n / sum(n) over (partition by day) as p from c)
select day, round(-sum(p * ln(p)), 6) as entropy from p group by 1""")
def allocation_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.routes(spark, sf_dir).withColumn("day", F.date_trunc("day", F.col("event_time").cast("timestamp")).cast("timestamp_ntz"))
    # adding zero turns the -0.0 of a day with one model into 0.0
    return mt.allocation_entropy(rows, "model_id", "day").select("day", (F.round("entropy", 6) + 0.0).alias("entropy"))


@_register("selection_churn", f"""with {_R}, t as (select stream, case when lag(model_id) over (partition by stream order by event_time, route_id) <> model_id then 1 else 0 end as s from routes)
select stream, count(*) as routes, cast(sum(s) as bigint) as switches, round(case when count(*) > 1 then sum(s) / (count(*) - 1) else 0 end, 6) as churn from t group by 1""")
def selection_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rp.selection_churn(views.routes(spark, sf_dir), "stream", ["event_time", "route_id"]))


@_register("adoption", f"""with {_R}, c as (select date_trunc('hour', event_time) as period, model_id, count(*) as n from routes group by 1, 2)
select period, model_id, round(n / sum(n) over (partition by period), 6) as share from c""")
def adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.routes(spark, sf_dir).withColumn("event_time", F.col("event_time").cast("timestamp"))
    return _rounded(rp.adoption(rows, "event_time").withColumn("period", F.col("period").cast("timestamp_ntz")))


@_register("regret_half_life", f"""with {_R}, t as (select stream, row_number() over w as n, sum(regret_milli) over (partition by stream order by event_time, route_id rows unbounded preceding) as s, sum(regret_milli) over (partition by stream) as total
  from routes window w as (partition by stream order by event_time, route_id))
select stream, cast(min(n) as integer) as half_life from t where 2 * s >= total group by 1""")
def regret_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.regret_half_life(views.routes(spark, sf_dir), "stream", ["event_time", "route_id"], "regret_milli")


@_register("budget_violations", f"with {_R} select date_trunc('day', event_time) as period, cast(sum(k) as bigint) as spent, round(sum(k) - 15000, 6) as excess from routes group by 1 having sum(k) > 15000")
def budget_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.routes(spark, sf_dir)
    found = rp.budget_violations(rows, F.date_trunc("day", F.col("event_time").cast("timestamp")).cast("timestamp_ntz"), "k", 15000)
    return found.select("period", "spent", F.round(F.col("excess").cast("double"), 6).alias("excess"))


@_register("budget_pacer", f"""with recursive {_R}, t as (select stream, row_number() over (partition by stream order by event_time, route_id) - 1 as n, route_id, cast(k as double) as c from routes),
f as (
  select stream, n, route_id, c as total, greatest(0.0, least(10.0, 0.1 * (c / 40 - 1))) as m from t where n = 0
  union all select t.stream, t.n, t.route_id, f.total + t.c, greatest(0.0, least(10.0, f.m + 0.1 * ((f.total + t.c) / (t.n + 1) / 40 - 1))) from f join t on t.stream = f.stream and t.n = f.n + 1
)
select stream, n, route_id, round(m, 6) as multiplier from f""")
def budget_pacer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stream has a budget of its own."""
    paced = rp.budget_pacer(views.routes(spark, sf_dir), "stream", ["event_time", "route_id"], "k", 40.0)
    return paced.select("stream", "n", "route_id", F.round("multiplier", 6).alias("multiplier"))


@_register("ips_value", f"""with {_R}, w as (select k / 100.0 as r, case when model_id = case when route_id % 2 = 0 then 'click' else 'view' end then 1 / probability else 0 end as w from routes)
select round(sum(w * r) / count(*), 6) as ips, round(sum(w * r) / sum(w), 6) as snips from w""")
def ips_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.routes(spark, sf_dir).withColumns({"selected_model_id": F.col("model_id"), "target_model_id": F.when(F.col("route_id") % 2 == 0, "click").otherwise("view"), "reward": F.col("k") / 100.0})
    return _rounded(mt.ips_value(log))


@_register("doubly_robust_value", f"""with {_R} select round(avg(0.5 + case when model_id = 'click' then (k / 100.0 - 0.4) / probability else 0 end), 6) as doubly_robust from routes""")
def doubly_robust_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.routes(spark, sf_dir).withColumns({"selected_model_id": F.col("model_id"), "target_model_id": F.lit("click"), "reward": F.col("k") / 100.0, "reward_hat": F.lit(0.4), "target_hat": F.lit(0.5)})
    return _rounded(mt.doubly_robust_value(log))


@_register("linucb_replay")
def linucb_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.routes(spark, sf_dir).withColumns({"reward": F.coalesce(F.col("k"), F.lit(0)) / 100.0, "hour": F.hour("event_time") / 24.0})
    return rp.bandit_replay(rows.select("stream", "event_time", "route_id", "model_id", "reward", "hour"), "stream", ["event_time", "route_id"], ["click", "error", "purchase", "signup", "view"], ["hour"])


@_register("thompson_replay")
def thompson_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.routes(spark, sf_dir).withColumn("reward", F.coalesce(F.col("k"), F.lit(0)) / 100.0)
    return rp.bandit_replay(rows.select("stream", "event_time", "route_id", "model_id", "reward"), "stream", ["event_time", "route_id"], ["click", "error", "purchase", "signup", "view"], [], policy="thompson", forced=1)


# probes


@_register("probe_profile", f"""with {_O}, probes as (select distinct query_id from outcomes order by sha256('0:' || query_id), query_id limit 20), grid as (select s_suppkey as model_id, query_id from supplier, probes)
select g.model_id, list(score_milli order by g.query_id) as scores, cast(count(*) filter (o.query_id is null) as integer) as n_missing
from grid g left join outcomes o on o.model_id = g.model_id and o.query_id = g.query_id group by 1""".replace("list(score_milli", "string_agg(coalesce(cast(score_milli as varchar), '-'), ','"))
def probe_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.outcomes(spark, sf_dir)
    probes = rp.random_probes(rows.select("query_id").distinct(), 20)
    models = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model_id"))
    profiles = rp.probe_profiles(rows, probes, models)
    listed = F.array_join(F.transform("scores", lambda s: F.coalesce(F.round(s * 1000).cast("int").cast("string"), F.lit("-"))), ",")
    return profiles.select("model_id", listed.alias("scores"), F.size(F.filter("missing", lambda m: m)).alias("n_missing"))


@_register("stratified_probes", """select o_orderpriority as task, o_orderkey as query_id from orders qualify row_number() over (partition by o_orderpriority order by sha256('0:' || o_orderkey), o_orderkey) <= 5""")
def stratified_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("query_id"))
    return rp.stratified_probes(rows, "task", 5)


@_register("active_probes", f"with {_O} select query_id, round(var_pop(score), 6) as spread from outcomes group by 1 order by round(var_pop(score), 9) desc, query_id limit 25")
def active_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rp.active_probes(views.outcomes(spark, sf_dir), 25))


@_register("farthest_point_probes")
def farthest_point_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.farthest_point_probes(views.table(spark, sf_dir, "embeddings"), 8)


@_register("medoid_probes")
def medoid_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.medoid_probes(views.table(spark, sf_dir, "embeddings"), 8)
