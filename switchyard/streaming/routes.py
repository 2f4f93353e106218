"""The route log as a stream: windows, feedback and duplicates with bounded state.

These extend the batch operators; the data model only fixes the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(routes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Routes once each by id, with state kept no longer than lateness allows."""
    return routes.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["route_id"])


def model_windows(routes: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``(window, model_id, routes, mean_reward, cost)`` over event time."""
    span = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return routes.withWatermark("event_time", late).groupBy(span, "model_id").agg(F.count("*").alias("routes"), F.avg("reward").alias("mean_reward"), F.sum("cost").alias("cost"))


def user_sessions(routes: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``(session_window, stream, routes)`` split where a stream pauses."""
    return routes.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap), "stream").agg(F.count("*").alias("routes"))


def with_feedback(routes: DataFrame, feedback: DataFrame, delay: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Routes with feedback that came within ``delay``; a stream-stream join with bounded state."""
    left = routes.withWatermark("event_time", late)
    right = feedback.withColumnRenamed("route_id", "_route").withWatermark("feedback_received_at", late)
    on = F.expr(f"route_id = _route and feedback_received_at >= event_time and feedback_received_at <= event_time + interval {delay}")
    return left.join(right, on, "leftOuter").drop("_route")
