"""Time axes: indexing, lookups, thinning, compression (TIM)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.calendars import format_iso, format_period, format_time_only


DEALT = 8  # tasks that the requests of one layer and day are dealt to


def timestep_index(file_times: DataFrame, policy: str = "lowest_index") -> DataFrame:
    """(layer_id, t, t_index, filename, index_in_file): one row per layer and instant, ascending.

    Of files that hold the same instant, ``lowest_index`` takes the lowest position (then the file name) and
    ``first_seen`` the file that was read first (seen_order).
    """
    order = ["index_in_file", "filename", "seen_order"] if policy == "lowest_index" else ["seen_order"]
    if policy not in ("lowest_index", "first_seen"):
        raise ValueError(f"unknown policy: {policy}")
    best = F.min_by(F.struct("filename", "index_in_file"), F.struct(*order))
    steps = file_times.groupBy("layer_id", "t").agg(best.alias("b"))
    index = F.row_number().over(Window.partitionBy("layer_id").orderBy("t")) - 1
    return steps.select("layer_id", "t", index.alias("t_index"), "b.filename", "b.index_in_file")


def explode_file_times(files: DataFrame) -> DataFrame:
    """(layer_id, filename, t, index_in_file, seen_order) from files (layer_id, filename, seen_order, times)."""
    return files.select("layer_id", "filename", "seen_order", F.posexplode("times").alias("index_in_file", "t"))


def _as_of(steps: DataFrame, targets: DataFrame, at: str) -> DataFrame:
    """targets with before and after: the last step <= the target and the first step >= it.

    Steps and targets of a layer are put in one order and the last step seen is carried along.  A day is a window of its
    own, so that one busy layer is spread over many tasks; what a day can't see comes from the days' ends.
    """
    day = lambda c: F.to_date(c)
    s = steps.select("layer_id", day(F.col("t")).alias("day"), F.col("t").alias("at"), F.lit(0).alias("kind"), F.col("t").alias("step"), F.lit(None).cast("long").alias("request_id"))
    r = targets.select("layer_id", day(F.col(at)).alias("day"), F.col(at).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(dict(steps.dtypes)["t"]).alias("step"), F.col("request_id").cast("long"))
    rows = s.unionByName(r)
    w = Window.partitionBy("layer_id", "day").orderBy("at", "kind")
    back = Window.partitionBy("layer_id", "day").orderBy(F.desc("at"), "kind")
    rows = rows.withColumn("before", F.last("step", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.last("step", True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    days = rows.groupBy("layer_id", "day").agg(F.min("step").alias("first"), F.max("step").alias("last"))
    along = Window.partitionBy("layer_id").orderBy("day")
    days = days.select("layer_id", "day", F.last("last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("day_before"), F.first("first", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("day_after"))
    out = rows.filter("kind = 1").join(days, ["layer_id", "day"], "left")
    return out.select("request_id", "layer_id", F.col("at").alias(at), F.coalesce("before", "day_before").alias("before"), F.coalesce("after", "day_after").alias("after"))


def nearest_time(steps: DataFrame, targets: DataFrame, at: str = "ts") -> DataFrame:
    """(request_id, layer_id, at, t): the step nearest to each target, the earlier one at a tie; null without steps."""
    ms = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    near = F.when(F.col("after").isNull() | (ms(at) - ms("before") <= ms("after") - ms(at)), F.coalesce("before", "after")).otherwise(F.col("after"))
    return _as_of(steps, targets, at).select("request_id", "layer_id", at, near.alias("t"))


def current_time(steps: DataFrame, targets: DataFrame, at: str = "ts") -> DataFrame:
    """(request_id, layer_id, at, t): the latest step that isn't after the target, or else the earliest."""
    return _as_of(steps, targets, at).select("request_id", "layer_id", at, F.coalesce("before", "after").alias("t"))


def match_time(requests: DataFrame, index: DataFrame) -> DataFrame:
    """requests (layer_id, t) with t_index of the equal instant, those without one left out."""
    return requests.join(index.select("layer_id", "t", "t_index"), ["layer_id", "t"])


def unmatched_time(requests: DataFrame, index: DataFrame) -> DataFrame:
    """requests whose instant isn't on their layer's axis."""
    return requests.join(index.select("layer_id", "t"), ["layer_id", "t"], "left_anti")


def resolve_time_expr(requests: DataFrame, index: DataFrame, now: str, text: str = "time", form: str = "yyyy-MM-dd") -> tuple[DataFrame, DataFrame]:
    """(steps, errors) of requests (request_id, layer_id, time) such as "t1,t2/t3,current".

    steps: (request_id, seq, t_index, t); seq is the place in the list.  "a/b" means all steps from a to b, which must
    both be on the axis, a not after b; "current" is the latest step not after ``now``, or else the first; a null text
    takes the current step.  errors: (request_id, error), the first one of a request; it then has no steps.
    """
    kind = dict(index.dtypes)["t"]
    current = index.groupBy("layer_id").agg(F.coalesce(F.max(F.when(F.col("t") <= F.lit(now).cast(kind), F.col("t"))), F.min("t")).alias("current"))
    parts = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("current")), ",")).alias("seq", "part")
    rows = requests.select("request_id", "layer_id", parts).join(current, "layer_id", "left").withColumn("ends", F.split("part", "/"))
    value = lambda k: F.when(F.trim(F.element_at("ends", k)) == "current", F.col("current")).otherwise(F.try_to_timestamp(F.trim(F.element_at("ends", k)), F.lit(form)).cast(kind))
    rows = rows.withColumn("n", F.size("ends")).withColumn("a", value(1)).withColumn("b", F.when(F.col("n") == 2, value(-1)).otherwise(value(1)))
    find = lambda c: index.select("layer_id", F.col("t").alias(c), F.col("t_index").alias(c + "_index"))
    rows = rows.join(find("a"), ["layer_id", "a"], "left").join(find("b"), ["layer_id", "b"], "left")
    error = F.when(F.col("n") > 2, "more than one /").when(F.col("a_index").isNull() | F.col("b_index").isNull(), "no such time").when(F.col("a_index") > F.col("b_index"), "ends before it begins")
    rows = rows.withColumn("error", error)
    errors = rows.filter("error is not null").groupBy("request_id").agg(F.min_by("error", "seq").alias("error"))
    good = rows.join(errors.select("request_id"), "request_id", "left_anti").withColumn("t_index", F.explode(F.sequence("a_index", "b_index")))
    steps = good.join(index.select("layer_id", "t_index", "t"), ["layer_id", "t_index"]).select("request_id", "seq", "t_index", "t")
    return steps, errors


def dates_with_data(steps: DataFrame) -> DataFrame:
    """(layer_id, dates): year -> month (from 0) -> ascending days that have steps."""
    days = steps.select("layer_id", F.year("t").alias("y"), (F.month("t") - 1).alias("m"), F.dayofmonth("t").alias("d")).distinct()
    months = days.groupBy("layer_id", "y", "m").agg(F.sort_array(F.collect_list("d")).alias("days"))
    years = months.groupBy("layer_id", "y").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("m", "days")))).alias("months"), F.min("m"))
    return years.groupBy("layer_id").agg(F.map_from_arrays(F.transform(F.sort_array(F.collect_list("y")), lambda y: y), F.transform(F.array_sort(F.collect_list(F.struct("y", "months")), lambda a, b: a["y"] - b["y"]), lambda s: s["months"])).alias("dates"))


def timesteps_on_day(steps: DataFrame, days: DataFrame) -> DataFrame:
    """days (request_id, layer_id, day) with each step of that day as time of day.

    A time of day is written once for each step, not for each request that shows it.  A busy day has many times the rows of its
    requests and steps: requests are dealt to a fixed number of tasks, as their bytes don't tell the rows to come, and the
    requests of a day to several.
    """
    tasks = 2 * int(days.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = F.pmod(F.xxhash64("request_id"), F.lit(DEALT)).cast("int")
    shown = steps.select("layer_id", F.to_date("t").alias("day"), "t", format_time_only(F.col("t")).alias("time"))
    shown = shown.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))).repartition(tasks, "layer_id", "day", "_deal")
    dealt = days.withColumn("_deal", deal).repartition(tasks, "layer_id", "day", "_deal")
    return dealt.join(shown, ["layer_id", "day", "_deal"]).select("request_id", "layer_id", "day", "t", "time")


#: Label, months and days of the animations' periods.
PERIODS = {"Daily": (0, 1), "Weekly": (0, 7), "Monthly": (1, 0), "Bi-monthly": (2, 0), "Twice-yearly": (6, 0), "Yearly": (12, 0)}


def _later(ms: int, months: int, days: int) -> int:
    """An instant so many months and days later, in any year; a day that its month hasn't got becomes the last."""
    at = np.datetime64(ms, "ms")
    month, day = at.astype("datetime64[M]"), at.astype("datetime64[D]")
    to = month + months
    first, last = to.astype("datetime64[D]"), (to + 1).astype("datetime64[D]") - 1
    moved = min(first + (day - month.astype("datetime64[D]")), last) + days
    return ms + int((moved - day).astype("timedelta64[ms]").astype(np.int64))


def _thin(times: np.ndarray, months: int, days: int) -> list[int]:
    """Places that stay: the first, then always the next that isn't before the last kept plus the period."""
    kept, at = [0], 0
    while True:
        at = int(np.searchsorted(times, _later(int(times[at]), months, days)))
        if at >= len(times):
            return kept
        kept.append(at)


def animation_timesteps(steps: DataFrame) -> DataFrame:
    """(layer_id, label, frames, times): thinned time lists of steps (layer_id, t); those of one frame are dropped.

    steps holds the steps between the animation's start and end, in any year that Spark has.  The choice of a step
    depends on the last one kept, so a layer's axis is thinned by one task; an axis is one row per instant, far smaller
    than the cells.
    """
    def thin(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(frame["ms"].to_numpy().astype(np.int64))
        rows = []
        for label, (months, days) in PERIODS.items():
            kept = times[_thin(times, months, days)]
            if len(kept) > 1:
                rows.append((key[0], label, len(kept), ",".join(np.datetime_as_string(kept.astype("datetime64[ms]")) + "Z")))
        return pd.DataFrame(rows, columns=["layer_id", "label", "frames", "times"])

    instants = steps.select("layer_id", F.unix_millis(F.col("t").cast("timestamp")).alias("ms")).distinct()
    thinned = instants.groupBy("layer_id").applyInPandas(thin, "layer_id string, label string, frames int, times string")
    whole = steps.groupBy("layer_id").agg(F.lit("Full").alias("label"), F.count_distinct("t").cast("int").alias("frames"), F.concat(format_iso(F.min("t")), F.lit("/"), format_iso(F.max("t"))).alias("times"))
    return whole.unionByName(thinned)


def regular_runs(steps: DataFrame) -> DataFrame:
    """(layer_id, run, first, last, spacing, n): runs of equal steps of an axis; neighbours share the step at the border.

    A run ends where the step to the next instant differs from the one before (gaps and islands).
    """
    along = Window.partitionBy("layer_id").orderBy("t")
    ms = F.unix_millis(F.col("t").cast("timestamp"))
    rows = steps.select("layer_id", "t").distinct().withColumns({"k": F.row_number().over(along) - 1, "ms": ms})
    rows = rows.withColumn("gap", F.lead("ms").over(along) - F.col("ms"))
    n = F.count("*").over(Window.partitionBy("layer_id"))
    gaps = rows.withColumn("n", n).filter("gap is not null or n = 1")
    new = F.when(F.coalesce(F.col("gap") == F.lag("gap").over(along), F.lit(False)), 0).otherwise(1)
    gaps = gaps.withColumn("run", F.sum(new).over(along) - 1)
    return gaps.groupBy("layer_id", "run").agg(F.min("ms").alias("first"), F.max("gap").alias("spacing"), F.count("gap").alias("steps")).select("layer_id", "run", "first", (F.col("first") + F.col("steps") * F.coalesce("spacing", F.lit(0))).alias("last"), F.coalesce("spacing", F.lit(0)).alias("spacing"), (F.col("steps") + 1).cast("int").alias("n"))


def _claim(lengths: list[int]) -> tuple[list[int], list[int]]:
    """(cut at the start, cut at the end) of each run: the longest run still to choose keeps both its borders.

    The runs wait in a heap; one that loses a border is put in again with its new length, and old entries are passed over.
    """
    n = len(lengths)
    front, back, shared, size, waits = [0] * n, [0] * n, [True] * (n - 1), list(lengths), [True] * n
    heap = [(-x, k) for k, x in enumerate(lengths)]
    heapq.heapify(heap)
    open_ = n - 1
    while open_ > 0:
        x, i = heapq.heappop(heap)
        if not waits[i] or -x != size[i]:
            continue
        waits[i] = False
        for border, loser, cuts in ((i - 1, i - 1, back), (i, i + 1, front)):
            if 0 <= border < n - 1 and shared[border]:
                shared[border], cuts[loser], open_ = False, 1, open_ - 1
                size[loser] -= 1
                heapq.heappush(heap, (-size[loser], loser))
    return front, back


def settled_borders(runs: DataFrame) -> DataFrame:
    """runs with ``piece``, ``front`` and ``back``: stretches of an axis whose borders are free of one another.

    A run loses one border at most before it meets its other one, so a border goes to a run that is longer by two, or by one
    if it is the earlier, whatever the rest of the axis does.  There the axis is cut, and the shorter run loses the border.
    """
    along = Window.partitionBy("layer_id").orderBy("run")
    before, after = F.lag("n").over(along), F.lead("n").over(along)
    lost_front = F.coalesce(before - 1 >= F.col("n"), F.lit(False))
    lost_back = F.coalesce(after - 1 > F.col("n"), F.lit(False))
    own = F.coalesce(F.col("n") - 1 > before, F.lit(False))
    rows = runs.withColumns({"front": lost_front.cast("int"), "back": lost_back.cast("int"), "_cut": (lost_front | own).cast("int")})
    return rows.withColumn("piece", F.sum("_cut").over(along)).drop("_cut")


def time_ranges(steps: DataFrame) -> DataFrame:
    """(layer_id, times): an axis as "a", "a,b" or "a/b/period" joined by commas.

    The borders are dealt out on the runs alone, a table as short as the axis is regular, one stretch between settled
    borders at a time, so that an irregular axis is settled by many tasks.
    """
    def settle(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("run", ignore_index=True)
        front, back = _claim((frame["n"] - frame["front"] - frame["back"]).tolist())
        return frame.assign(front=frame["front"] + front, back=frame["back"] + back)

    runs = settled_borders(regular_runs(steps))
    kinds = "layer_id string, run long, first long, last long, spacing long, n int, front int, back int, piece long"
    dealt = runs.groupBy("layer_id", "piece").applyInPandas(settle, kinds)
    step = F.col("spacing")
    settled = dealt.select("layer_id", "run", (F.col("first") + F.col("front") * step).alias("first"), (F.col("last") - F.col("back") * step).alias("last"), "spacing", (F.col("n") - F.col("front") - F.col("back")).alias("n")).filter("n > 0")
    iso = lambda c: format_iso(F.timestamp_millis(F.col(c)))
    text = F.when(F.col("n") == 1, iso("first")).when(F.col("n") == 2, F.concat(iso("first"), F.lit(","), iso("last"))).otherwise(F.concat_ws("/", iso("first"), iso("last"), format_period(F.col("spacing"))))
    return settled.groupBy("layer_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", text.alias("text")))), lambda s: s["text"]), ",").alias("times"))
