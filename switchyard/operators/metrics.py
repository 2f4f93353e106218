"""Metrics of predictions and of routing policies.

Rank statistics work on counts by distinct score; sums below or above a score
are taken in parallel over ranges of scores, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.operators.splits import running_before

#: Points of a frontier that are sent to every task.
MAX_FRONTIER = 100_000


def _by_score(rows: DataFrame, label: str, score: str) -> DataFrame:
    return rows.groupBy(score).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))


def auroc(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Probability that a positive outscores a negative; ties count half."""
    held = running_before(_by_score(rows, label, score), [score], "neg", "neg_below")
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return held.agg((wins / (F.sum("pos") * F.sum("neg"))).alias("auroc"))


def auprc(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Average precision: precision at each distinct score, weighted by the recall it adds."""
    held = _by_score(rows, label, score).select((-F.col(score)).alias("falling"), "pos", (F.col("pos") + F.col("neg")).alias("here"))
    held = running_before(running_before(held, ["falling"], "pos", "tp_before"), ["falling"], "here", "n_before")
    held = held.select("pos", (F.col("tp_before") + F.col("pos")).alias("tp"), (F.col("n_before") + F.col("here")).alias("n"))
    return held.agg((F.sum(F.col("pos") * F.col("tp") / F.col("n")) / F.sum("pos")).alias("auprc"))


def brier(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return rows.agg(F.avg((F.col(score) - F.col(label)) ** 2).alias("brier"))


def calibration_bins(rows: DataFrame, label: str = "label", score: str = "score", bins: int = 10) -> DataFrame:
    """``(bin, n, mean_score, mean_label)`` over equal ranges of the score."""
    bucket = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("mean_label"))


def expected_calibration_error(rows: DataFrame, label: str = "label", score: str = "score", bins: int = 10) -> DataFrame:
    held = calibration_bins(rows, label, score, bins)
    return held.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("mean_label"))) / F.sum("n")).alias("ece"))


def _average_ranks(rows: DataFrame, column: str, out: str) -> DataFrame:
    counts = running_before(rows.groupBy(column).agg(F.count("*").alias("_n")), [column], "_n", "_before")
    return counts.select(column, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks."""
    pairs = rows.groupBy(x, y).agg(F.count("*").alias("w"))
    ranked = pairs.join(_average_ranks(rows, x, "rx"), x).join(_average_ranks(rows, y, "ry"), y)
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    sums = ranked.agg(F.sum(w).alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"), F.sum(w * rx * ry).alias("sxy"), F.sum(w * rx * rx).alias("sxx"), F.sum(w * ry * ry).alias("syy"))
    top = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    return sums.select((top / F.sqrt((F.col("sxx") - F.col("sx") ** 2 / F.col("n")) * (F.col("syy") - F.col("sy") ** 2 / F.col("n")))).alias("spearman"))


def regression_errors(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean absolute error, the same of logarithms, and the 95th percentile of absolute errors."""
    error = F.abs(F.col(actual) - F.col(predicted))
    return rows.agg(F.avg(error).alias("mae"), F.avg(F.abs(F.log1p(actual) - F.log1p(predicted))).alias("log_mae"), F.percentile(error, 0.95).alias("p95_error"))


def losses(rows: DataFrame, label: str = "label", score: str = "score", delta: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """Binary cross-entropy, Huber loss and their sum, as means."""
    p = F.greatest(F.least(F.col(score), F.lit(1 - eps)), F.lit(eps))
    cross = -(F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p))
    error = F.abs(F.col(score) - F.col(label))
    huber = F.when(error <= delta, error * error / 2).otherwise(delta * (error - delta / 2))
    return rows.agg(F.avg(cross).alias("bce"), F.avg(huber).alias("huber"), F.avg(cross + huber).alias("combined"))


def pairwise_ranking_loss(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Share of (positive, negative) pairs in the wrong order; ties count half."""
    return auroc(rows, label, score).select((1 - F.col("auroc")).alias("pairwise_loss"))


def model_recall(routed: DataFrame, oracle: DataFrame) -> DataFrame:
    """Share of queries for which the policy took the model that the oracle takes."""
    both = routed.select("query_id", F.col("model_id").alias("_m")).join(oracle.select("query_id", "model_id"), "query_id")
    return both.agg(F.avg((F.col("_m") == F.col("model_id")).cast("double")).alias("model_recall"))


def routing_summary(routed: DataFrame) -> DataFrame:
    """Mean quality, success rate, cost a request, mean and p95 latency of the chosen outcomes."""
    return routed.agg(
        F.count("*").alias("requests"),
        F.avg("score").alias("avg_quality"),
        F.avg(F.col("succeeded").cast("double")).alias("success_rate"),
        F.avg("cost").alias("cost_per_request"),
        F.avg("latency").alias("avg_latency"),
        F.percentile("latency", 0.95).alias("p95_latency"),
    )


def oracle_gap(routed: DataFrame, oracle: DataFrame) -> DataFrame:
    """Mean score of the oracle less that of the policy, over queries that both have."""
    both = routed.select("query_id", F.col("score").alias("_s")).join(oracle.select("query_id", "score"), "query_id")
    return both.agg(F.avg(F.col("score") - F.col("_s")).alias("oracle_gap"))


def cost_at_quality(points: DataFrame, quality: float) -> DataFrame:
    """Least cost among points of at least that quality."""
    return points.where(F.col("quality") >= quality).agg(F.min("cost").alias("cost_at_quality"))


def quality_at_cost(points: DataFrame, cost: float) -> DataFrame:
    """Best quality among points of at most that cost."""
    return points.where(F.col("cost") <= cost).agg(F.max("quality").alias("quality_at_cost"))


def pareto_distance(points: DataFrame, frontier: DataFrame) -> DataFrame:
    """``points`` plus the smallest distance in cost and quality to the frontier (one row a model at most)."""
    distinct = frontier.select(F.col("cost").alias("_c"), F.col("quality").alias("_q")).distinct()
    if distinct.count() > MAX_FRONTIER:
        raise ValueError(f"a frontier of more than {MAX_FRONTIER} points; it should have one a model at most")
    edge = distinct.agg(F.collect_list(F.struct("_c", "_q")).alias("_edge"))
    gaps = F.transform("_edge", lambda e: F.sqrt((F.col("cost") - e["_c"]) ** 2 + (F.col("quality") - e["_q"]) ** 2))
    # the frontier is one row that holds at most one point a model
    return points.join(F.broadcast(edge)).withColumn("pareto_distance", F.array_min(gaps)).drop("_edge")


def allocation_entropy(routes: DataFrame, model: str = "model_id", window: str | None = None) -> DataFrame:
    """Entropy, in nats, of the models chosen, overall or within each value of ``window``."""
    keys = [window] if window else []
    counts = routes.groupBy(*keys, model).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("s"))
    return totals.select(*keys, (F.log("total") - F.col("s") / F.col("total")).alias("entropy"))


def ips_value(log: DataFrame, chosen: str = "selected_model_id", target: str = "target_model_id", reward: str = "reward", probability: str = "probability") -> DataFrame:
    """Inverse-propensity value of a target policy, plain and self-normalised."""
    weight = F.when(F.col(chosen) == F.col(target), 1 / F.col(probability)).otherwise(F.lit(0.0))
    sums = log.agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.sum(weight * F.col(reward)).alias("wr"))
    return sums.select((F.col("wr") / F.col("n")).alias("ips"), F.when(F.col("w") > 0, F.col("wr") / F.col("w")).alias("snips"))


def doubly_robust_value(log: DataFrame, reward_hat: str = "reward_hat", target_hat: str = "target_hat") -> DataFrame:
    """Model value of the target, corrected by the weighted error where the log took the target's choice."""
    match = F.when(F.col("selected_model_id") == F.col("target_model_id"), (F.col("reward") - F.col(reward_hat)) / F.col("probability")).otherwise(F.lit(0.0))
    return log.agg(F.avg(F.col(target_hat) + match).alias("doubly_robust"))


def bootstrap_means(rows: DataFrame, key: str, value: str, samples: int = 100, seed: int = 0) -> DataFrame:
    """``(sample, mean)`` of Poisson bootstrap samples; weights come from a hash of seed, row and sample.

    Rows are not resampled but weighted, all samples in one pass: each row is
    expanded to its weights and these are summed before the shuffle.
    """
    # weights of 0..4 at the Poisson(1) shares of a 16-bit hash
    bits = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("sample").cast("string")), 256), 1, 4), 16, 10).cast("int")
    weight = F.when(bits < 24109, 0).when(bits < 48218, 1).when(bits < 60273, 2).when(bits < 64291, 3).otherwise(4)
    drawn = rows.select(key, value).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("w", weight)
    return drawn.groupBy("sample").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))


def confidence_interval(means: DataFrame, level: float = 0.95) -> DataFrame:
    low = (1 - level) / 2
    return means.agg(F.percentile("mean", low).alias("low"), F.avg("mean").alias("mean"), F.percentile("mean", 1 - low).alias("high"))


def paired_difference(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Mean paired difference, its standard error and t statistic."""
    both = left.select(key, F.col(value).alias("_l")).join(right.select(key, F.col(value).alias("_r")), key)
    stats = both.agg(F.count("*").alias("n"), F.avg(F.col("_l") - F.col("_r")).alias("mean_difference"), F.stddev_samp(F.col("_l") - F.col("_r")).alias("sd"))
    error = F.col("sd") / F.sqrt("n")
    return stats.select("n", "mean_difference", error.alias("standard_error"), F.when(error > 0, F.col("mean_difference") / error).alias("t"))
