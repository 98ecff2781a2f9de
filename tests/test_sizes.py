"""Queries whose tables grow: what is broadcast, and what is worked out for each row."""

from __future__ import annotations

import datetime
import re

import pytest

from gridspark.operators import coords, extract, timeaxis
from gridspark.plans.extract import WORLD
from gridspark.plans.views import Views

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [None, "1"])
def test_points_of_lines_are_not_broadcast(spark, parts):
    v = Views(spark, SF)
    if parts:
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = extract.optimal_transect(coords.parse_linestring(v.lines), v.world_axes, WORLD, step=10, most=200)
        text = plan(found)
    finally:
        if parts:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    # axes alone, which have a row for each grid, may be broadcast; the tried points are made once
    assert "BroadcastHashJoin" not in text
    assert len(re.findall(r"Generate explode\(\[10,20", text)) == 1
    assert "REPARTITION_BY_NUM" in text
    counts = {r["line_id"]: (r["n"], r["points"]) for r in found.groupBy("line_id", "n").count().withColumnRenamed("count", "points").collect()}
    assert len(counts) == v.lines.count()
    assert all(n == points for n, points in counts.values())


def test_times_of_day_are_written_once_for_each_step(spark):
    day = datetime.datetime(2024, 3, 10)
    steps = spark.createDataFrame([("a", day + datetime.timedelta(minutes=7 * k)) for k in range(300)], "layer_id string, t timestamp").coalesce(1)
    days = spark.createDataFrame([(k, "a" if k % 10 else "b", (day + datetime.timedelta(days=k % 3)).date()) for k in range(600)], "request_id long, layer_id string, day date").coalesce(1)
    found = timeaxis.timesteps_on_day(steps, days)
    above = plan(found).split("Join", 1)[0]
    assert "date_format" in plan(found)
    assert "date_format" not in above
    rows = found.collect()
    on = {day.date(): 206, day.date() + datetime.timedelta(days=1): 94}  # of 300 steps, 1440 / 7 on the first day
    assert len(rows) == sum(on.get((day + datetime.timedelta(days=k % 3)).date(), 0) for k in range(600) if k % 10)
    assert len({(r["request_id"], r["t"]) for r in rows}) == len(rows)
    assert all(r["t"].date() == r["day"] and r["time"] == r["t"].strftime("%H:%M:%S.000Z") for r in rows)
    # one busy day is dealt to several tasks
    assert found.filter("layer_id = 'a'").select("request_id").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).filter(bool).count() > 1
