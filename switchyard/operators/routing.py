"""Routing: prices as of a time, costs, utilities, policies, baselines and frontiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchyard.functions.prices import cost_usd


def price_intervals(prices: DataFrame, key: str = "model_id", start: str = "effective_at") -> DataFrame:
    """``prices`` plus ``effective_to``, when the next price of the same key begins."""
    return prices.withColumn("effective_to", F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def price_asof(requests: DataFrame, prices: DataFrame, time: str, key: str = "model_id", start: str = "effective_at") -> DataFrame:
    """Every request with the price of its key in force at its time, or none.

    The price history becomes intervals, so this is an equi-join on the key
    with a range condition: a key with a third of all requests is split by
    adaptive execution, and only the price table is windowed.
    """
    spans = price_intervals(prices, key, start).withColumnRenamed(key, "_key")
    on = (requests[key] == spans["_key"]) & (spans[start] <= requests[time]) & (spans["effective_to"].isNull() | (requests[time] < spans["effective_to"]))
    return requests.join(spans, on, "left").drop("_key")


def request_cost(requests: DataFrame, out: str = "cost_usd") -> DataFrame:
    """Adds the cost of rows that carry token counts and prices per unit."""
    cached = F.col("cached_input_tokens") if "cached_input_tokens" in requests.columns else F.lit(0)
    return requests.withColumn(out, cost_usd(F.col("input_tokens"), cached, F.col("output_tokens"), F.col("input_per_unit"), F.col("cached_input_per_unit"), F.col("output_per_unit")))


def runtime_cost(cost: Column, model: Column, previous: Column, switch_penalty: float = 0.0, fixed_fee: float = 0.0) -> Column:
    """Token cost, plus a fee for every call and a penalty for a change of model."""
    switched = F.when(previous.isNotNull() & (previous != model), F.lit(switch_penalty)).otherwise(F.lit(0.0))
    return cost + switched + F.lit(fixed_fee)


def utility(quality: Column, cost: Column, latency: Column, p_fail: Column, *, w_quality: float = 1.0, w_cost: float = 0.3, w_latency: float = 0.1, failure_penalty: float = 0.5, bonus: Column | None = None) -> Column:
    """Weighted quality less normalised cost, latency and expected failure, plus a bonus."""
    value = w_quality * quality - w_cost * cost - w_latency * latency - failure_penalty * p_fail
    return value if bonus is None else value + bonus


def hard_filter(candidates: DataFrame, *, max_cost: float | None = None, max_latency: float | None = None, modality: str | None = None, tools: tuple[str, ...] = (), min_context: int | None = None, private_only: bool = False, at: Column | None = None) -> DataFrame:
    """Candidates that meet every hard constraint; unknown cost or latency does not."""
    keep = F.lit(True)
    if max_cost is not None:
        keep &= F.coalesce(F.col("cost") <= max_cost, F.lit(False))
    if max_latency is not None:
        keep &= F.coalesce(F.col("latency") <= max_latency, F.lit(False))
    if modality is not None:
        keep &= F.array_contains("modalities", modality)
    for tool in tools:
        keep &= F.array_contains("tools", tool)
    if min_context is not None:
        keep &= F.col("context_tokens") >= min_context
    if private_only:
        keep &= F.col("is_private")
    if at is not None:
        keep &= F.col("available_at").isNull() | (F.col("available_at") <= at)
    return candidates.where(keep)


def best_per(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, by aggregation that combines before the shuffle.

    The order must be total within a key.  A key is never gathered: each task
    keeps its best row and only these meet.
    """
    parts = [F.when(F.lit(True), c) for c in order]
    ranked = F.min_by(F.struct(*rows.columns), F.struct(*parts))
    return rows.groupBy(key).agg(ranked.alias("_row")).select("_row.*")


def route_argmax(candidates: DataFrame, value: str = "utility", query: str = "query_id", model: str = "model_id") -> DataFrame:
    """Each query's candidate of the highest value; ties go to the smaller model id."""
    return best_per(candidates, query, [-F.col(value), F.col(model)])


def cost_mode(candidates: DataFrame, threshold: float, query: str = "query_id", model: str = "model_id") -> DataFrame:
    """The cheapest candidate of at least the threshold quality; if none has it, the best quality for its cost."""
    enough = F.col("quality") >= threshold
    first = F.when(enough, F.lit(0)).otherwise(F.lit(1))
    second = F.when(enough, F.col("cost")).otherwise(-F.col("quality") / (F.col("cost") + F.lit(1e-9)))
    return best_per(candidates.withColumn("met_threshold", enough), query, [first, second, F.col(model)])


#: Weights of quality, cost and latency of the presets.
PRESETS = {"intelligence": (1.0, 0.0, 0.0), "balanced": (1.0, 0.3, 0.1), "cost": (0.3, 1.0, 0.1)}


def preset_route(candidates: DataFrame, preset: str, threshold: float = 0.7) -> DataFrame:
    """Route by a preset; ``cost`` takes the cheapest that is good enough."""
    if preset == "cost":
        return cost_mode(candidates, threshold)
    quality, cost, latency = PRESETS[preset]
    value = utility(F.col("quality"), F.col("cost"), F.col("latency"), F.lit(0.0), w_quality=quality, w_cost=cost, w_latency=latency, failure_penalty=0.0)
    return route_argmax(candidates.withColumn("utility", value)).drop("utility")


def baseline(outcomes: DataFrame, kind: str, seed: int = 0) -> DataFrame:
    """One outcome a query by a fixed policy.

    ``cheapest`` and ``most_expensive`` by cost, ``random`` by a hash of seed,
    query and model, ``oracle_quality`` by score and then cost,
    ``oracle_cheapest_success`` the cheapest that succeeded, else the best score.
    """
    order = {
        "cheapest": [F.col("cost"), F.col("model_id")],
        "most_expensive": [-F.col("cost"), F.col("model_id")],
        "random": [F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("model_id").cast("string")), 256), F.col("model_id")],
        "oracle_quality": [-F.col("score"), F.col("cost"), F.col("model_id")],
        "oracle_cheapest_success": [F.when(F.col("succeeded"), 0).otherwise(1), F.when(F.col("succeeded"), F.col("cost")).otherwise(-F.col("score")), F.col("model_id")],
    }[kind]
    return best_per(outcomes, "query_id", order)


def best_single_model(train: DataFrame, by: str | None = None) -> DataFrame:
    """The model of the highest mean score, overall or for each value of ``by``; ties to the smaller id."""
    keys = [by] if by else []
    means = train.groupBy(*keys, "model_id").agg(F.round(F.avg("score"), 9).alias("mean_score"))
    if by:
        return best_per(means, by, [-F.col("mean_score"), F.col("model_id")])
    return means.orderBy(F.desc("mean_score"), "model_id").limit(1)


def pareto_frontier(points: DataFrame, cost: str = "cost", quality: str = "quality") -> DataFrame:
    """Points that no other point beats in both cost and quality; equal points all stay.

    Points of equal cost keep their best quality by aggregation; along rising
    cost a point stays if its quality exceeds all before.  The running maximum
    is taken within cost ranges, above the maximum of cheaper ranges.
    """
    best = points.groupBy(cost).agg(F.max(quality).alias(quality))
    ranged = best.repartitionByRange(cost).withColumn("_part", F.spark_partition_id())
    from switchyard.plans.scratch import materialize

    ranged = materialize(ranged, "costs")
    tops = ranged.groupBy("_part").agg(F.max(quality).alias("_top"))
    earlier = tops.select("_part", F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    known = ranged.join(F.broadcast(earlier), "_part").withColumn("_best", F.greatest(F.col("_before"), F.max(quality).over(inside)))
    edge = known.where(F.col("_best").isNull() | (F.col(quality) > F.col("_best"))).select(cost, quality)
    return points.join(edge, [cost, quality], "left_semi")


#: Points that are held against others at a time.
SKYLINE_BLOCK = 20_000


def _unbeaten(rivals: np.ndarray | None):
    """Points of a task that none of the ``rivals``, or without any none of its own, beats.

    Columns are cost, negated quality and latency, so less is better in each.
    """

    def beaten(points: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), bool)
        for at in range(0, len(others), 256):
            some = others[at : at + 256]
            rest = np.flatnonzero(~out)
            no_worse = (some[None, :, :] <= points[rest, None, :]).all(axis=2)
            better = (some[None, :, :] < points[rest, None, :]).any(axis=2)
            out[rest] = (no_worse & better).any(axis=1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            for at in range(0, len(points), 1024):
                some = points[at : at + 1024]
                keep = ~beaten(some, some if rivals is None else rivals)
                yield batch.slice(at, 1024).filter(pa.array(keep))

    return run


def pareto_frontier_3d(points: DataFrame, cost: str = "cost", quality: str = "quality", latency: str = "latency") -> DataFrame:
    """Points that no other point beats in cost, quality and latency together; equal points all stay.

    Distinct points are sorted by a sum that whoever beats a point has less of,
    and thinned among neighbours.  The rest is held, block by block in that
    order, against those that are left; a block is bounded and what it beats is
    gone for the blocks after it.  Points with a null take no part.
    """
    from switchyard.plans.scratch import materialize, release

    shape = "c double, q double, l double"
    distinct = points.select(F.col(cost).cast("double").alias("c"), (-F.col(quality).cast("double")).alias("q"), F.col(latency).cast("double").alias("l")).where("c + q + l is not null").distinct()
    left = materialize(distinct.sortWithinPartitions((F.col("c") + F.col("q") + F.col("l"))).mapInArrow(_unbeaten(None), shape), "skyline")
    done: tuple | None = None
    while True:
        after = left if done is None else left.where(F.struct("c", "q", "l") > F.struct(*map(F.lit, done)))
        block = [tuple(r) for r in after.orderBy("c", "q", "l").limit(SKYLINE_BLOCK).collect()]
        if not block:
            break
        last, left = left, materialize(left.mapInArrow(_unbeaten(np.array(block)), shape), "skyline")
        release(last)
        done = block[-1]
    edge = left.select(F.col("c").alias("_c"), F.col("q").alias("_q"), F.col("l").alias("_l"))
    same = (F.col(cost).cast("double") == F.col("_c")) & (-F.col(quality).cast("double") == F.col("_q")) & (F.col(latency).cast("double") == F.col("_l"))
    return points.join(edge, same, "left_semi")


def hypervolume(frontier: DataFrame, worst_cost: float, cost: str = "cost", quality: str = "quality") -> DataFrame:
    """Area under a 2-D frontier up to ``worst_cost``, from quality zero; the frontier has one row a model at most."""
    edge = frontier.select(cost, quality).distinct()
    nxt = F.lead(cost).over(Window.orderBy(cost))
    return edge.select((F.col(quality) * (F.coalesce(nxt, F.lit(worst_cost)) - F.col(cost))).alias("a")).agg(F.sum("a").alias("hypervolume"))


def normalized_quality(outcomes: DataFrame, task: str = "task", score: str = "score") -> DataFrame:
    """Adds min-max, z-score through a sigmoid, and success of the score within its task.

    Tasks are summarised first and joined back, so a large task is not gathered.
    """
    stats = outcomes.groupBy(task).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.avg(score).alias("_mean"), F.stddev_pop(score).alias("_sd"))
    span = F.col("_hi") - F.col("_lo")
    z = F.when(F.col("_sd") > 0, (F.col(score) - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))
    return outcomes.join(stats, task).withColumns(
        {"minmax": F.when(span > 0, (F.col(score) - F.col("_lo")) / span).otherwise(F.lit(0.0)), "zsigmoid": 1 / (1 + F.exp(-z)), "success": (F.col(score) >= 0.5).cast("int")}
    ).drop("_lo", "_hi", "_mean", "_sd")


def quality_percentile(outcomes: DataFrame, task: str = "task", score: str = "score") -> DataFrame:
    """Adds ``percentile``: the share of other rows of the task with a smaller score.

    Rows are counted by distinct score, and only these counts are windowed.
    """
    counts = outcomes.groupBy(task, score).agg(F.count("*").alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(task).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(task))
    ranks = counts.select(task, score, F.when(total > 1, below / (total - 1)).otherwise(F.lit(0.0)).alias("percentile"))
    return outcomes.join(ranks, [task, score])


def latency_quantiles(outcomes: DataFrame, key: str, latency: str = "latency", exact: bool = True) -> DataFrame:
    """Median and 95th percentile by key, and the mean of log1p; ``exact=False`` uses a bounded sketch."""
    if exact:
        p50, p95 = F.percentile(latency, 0.5), F.percentile(latency, 0.95)
    else:
        p50, p95 = F.percentile_approx(latency, 0.5, 10_000), F.percentile_approx(latency, 0.95, 10_000)
    return outcomes.groupBy(key).agg(p50.alias("p50"), p95.alias("p95"), F.avg(F.log1p(latency)).alias("mean_log1p"))
