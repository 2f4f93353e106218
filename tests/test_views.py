"""How the views deal rows to tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from switchyard.plans import views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("view", ["outcomes", "prices"])
def test_tasks_of_grouped_views_follow_the_rows(spark, view, monkeypatch):
    plain = getattr(views, view)(spark, SF)
    monkeypatch.setattr(views, "TASK_ROWS", 150)
    rows = getattr(views, view)(spark, SF)
    held = rows.groupBy(F.spark_partition_id().alias("p")).count()
    n = views.table(spark, SF, "lineitem").count()
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= n / 150 * 0.8
    assert held.agg(F.max("count")).first()[0] <= 2 * 150
    assert rows.exceptAll(plain).isEmpty() and plain.exceptAll(rows).isEmpty()
    # no map of groups in the tasks that scan: the only exchanges are those of whole rows by key
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") <= 2
