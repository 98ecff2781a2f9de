"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

The documents' rates depart least from 1 in relative entropy while each source's words add up to its target and no rate
is above the bound: minimise sum(w log w - w + 1) subject to sum over the source of size * w = target, w <= most.  The
convex dual has one multiplier per source, and w = min(most, exp(multiplier * size)): documents are tilted exponentially
by their length.  Newton steps on the dual, held inside a bracket that every step narrows, use the sources' tilted word
sums, which are added up as whole numbers, so that reruns agree.  Rates become copies by systematic rounding along
descending sizes: every document gets the copies just below or above its rate and a source's error stays below its
largest document; a few single copies more or fewer then close most of what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm._shared import materialize, word_count
from gridspark.llm.numbering import number_within

WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, take the weights in turn and share all words by weight; a source takes at
    most ``most`` times its own, and what it can't take is shared out again by weight.  That ends where every open
    source takes level * weight, with one level for all: the first in the order of cap / weight whose level is below.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1, F.lit(len(weights)))
    cap = F.col("source_size") * most
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    w = w.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))).over(everything)["level"])
    return w.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def newton(goals: DataFrame, cells: DataFrame, most: float = 3.0, tolerance: float = 1e-10, most_rounds: int = 80) -> DataFrame:
    """(source, source_size, target, mean, dual): goals with the multiplier, in units of 1 / mean, that solves the dual.

    cells: (source, size, n), the documents counted by size.  A document's rate is least(most, exp(dual * size / mean)).
    Each round sums the tilted words of every source and their slope on the executors.  A bracket is known from the
    start, as sizes are 1 or more; a step that leaves the bracket is replaced by its middle.  A source whose target is
    all it can give is at the upper end.
    """
    tilt = F.exp(F.col("dual") * F.col("size") / F.col("mean"))
    whole = lambda c: F.sum(F.floor(c * 2**16).cast("decimal(38,0)")).cast("double") / 2**16  # noqa: E731  whole numbers add up alike in any order
    means = cells.groupBy("source").agg(F.try_divide(F.sum((F.col("size") * F.col("size") * F.col("n")).cast("decimal(38,0)")).cast("double"), F.sum(F.col("size") * F.col("n"))).alias("mean")).withColumnRenamed("source", "_s")
    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    base = goals.join(means, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("mean", F.when(live, F.col("mean")).otherwise(1.0))
    high = F.col("mean") * (F.log(F.lit(float(most))) + 1e-9)  # where even documents of one word are at the bound
    start = F.when(live, F.log(F.try_divide(F.col("target"), F.col("source_size")))).otherwise(0.0)
    full = ~live | (F.col("target") >= F.col("source_size") * most * (1 - 1e-12))
    dual = base.withColumn("low", F.col("mean") * F.least(F.lit(0.0), start)).withColumn("high", high).withColumn("dual", F.when(~live, 0.0).when(full, high).otherwise(F.greatest("low", F.least("high", start)))).withColumn("done", full)
    dual = materialize(dual, "dual")
    for _ in range(most_rounds):
        if not dual.filter("not done").limit(1).count():
            break
        now = dual.filter("not done").select(F.col("source").alias("_s"), "mean", "dual")
        words = F.col("size") * F.col("n") * F.least(F.lit(float(most)), tilt)
        slope = F.when(tilt < most, F.col("size") * F.col("n") * tilt * F.col("size") / F.col("mean")).otherwise(0.0)
        tilted = cells.join(now, F.col("source").eqNullSafe(F.col("_s"))).groupBy("_s").agg(whole(words).alias("words"), whole(slope).alias("slope"))
        low, high_ = F.when(F.col("words") <= F.col("target"), F.col("dual")).otherwise(F.col("low")), F.when(F.col("words") >= F.col("target"), F.col("dual")).otherwise(F.col("high"))
        # Newton on log(words): exact where all documents of a source have one size
        step = F.col("dual") + F.log(F.col("target") / F.greatest("words", F.lit(1e-300))) * F.try_divide(F.col("words"), F.col("slope"))
        moved = dual.join(tilted, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("low2", low).withColumn("high2", high_).withColumn("next", step)
        settled = (F.abs(F.col("words") - F.col("target")) <= F.greatest(tolerance * F.col("target"), F.lit(1e-3))) | (F.col("high2") - F.col("low2") <= 1e-13 * F.col("high"))
        inside = (F.col("next") > F.col("low2")) & (F.col("next") < F.col("high2"))
        to = F.when(F.col("done") | settled, F.col("dual")).when(inside, F.col("next")).otherwise((F.col("low2") + F.col("high2")) / 2)
        dual = materialize(moved.select("source", "source_size", "target", "mean", F.when(F.col("done"), F.col("low")).otherwise(F.col("low2")).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(F.col("high2")).alias("high"), to.alias("dual"), (F.col("done") | settled).alias("done")), "dual")
    return dual.select("source", "source_size", "target", "mean", "dual")


def _copies(first: Column, last: Column, rate: Column, base: Column) -> Column:
    """Copies of the documents first to last - 1 of a size by systematic rounding; base: the rates before this size, and the start."""
    return F.floor(last * rate + base) - F.floor(first * rate + base)


def _bounded(copies: Column, most: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(int(most)), copies))


def settle(cells: DataFrame, most: float, rounds: int = 4) -> DataFrame:
    """cells with change: -1, 0 or 1 copy for the first document of a size.

    Each round gives every source the one change that brings its words nearest to the target, if any does.
    """
    base = F.col("before") + F.col("start")
    had = _bounded(_copies(F.lit(0), F.lit(1), F.col("rate"), base), most)
    cells = cells.withColumn("had", had).withColumn("words", F.col("size") * _copies(F.lit(0), F.col("n"), F.col("rate"), base)).withColumn("change", F.lit(0))
    for _ in range(rounds):
        off = cells.groupBy("source").agg((F.first("target") - F.sum(F.col("words") + F.col("size") * F.col("change"))).alias("off")).select(F.col("source").alias("_s"), "off")
        tried = cells.join(off, F.col("source").eqNullSafe(F.col("_s"))).withColumn("step", F.signum("off").cast("int")).filter(F.col("had") + F.col("step") >= 0).filter((F.col("had") + F.col("step") <= int(most)) & (F.col("change") == 0) & (F.col("size") > 0) & (F.abs(F.abs("off") - F.col("size")) < F.abs("off")))
        best = tried.groupBy("source").agg(F.min(F.struct(F.abs(F.abs("off") - F.col("size")).alias("left"), "size", "step")).alias("best")).select(F.col("source").alias("_s"), F.col("best.size").alias("_z"), "best.step")
        cells = materialize(cells.join(best, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left").withColumn("change", F.col("change") + F.coalesce("step", F.lit(0))).drop("_s", "_z", "step"), "settled")
    return cells


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", starts: int = 64, row_col: str | None = None) -> DataFrame:
    """(doc_id, size, source, source_size, target, rate, copies, taken): one row per row of docs.

    size is the number of words; taken = copies * size; no document is taken more than ``most`` times.  rate is the
    tilted rate before rounding, whose start is the one of ``starts`` that brings the source's words nearest to its
    target.  Null and empty texts have size 0 and take no words; a null source is a source, the last.  Rows that repeat an id are rows of their own, and
    reruns agree: ties are ordered by id.  ``row_col`` names a column that tells rows apart; it is returned too, and orders
    rows that repeat an id.  An empty table gives an empty table.
    """
    row = [F.col(f"`{row_col}`")] if row_col else []
    base = materialize(docs.select(*row, F.col(f"`{id_col}`").alias("doc_id"), word_count(F.col(f"`{text_col}`")).alias("size"), F.col(f"`{source_col}`").alias("source")), "words")
    cells = materialize(base.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    goals = materialize(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most), "goals")
    solved = newton(goals, cells, most).withColumnRenamed("source", "_s")
    rate = F.when(F.col("target") > 0, F.least(F.lit(float(most)), F.exp(F.col("dual") * F.col("size") / F.col("mean")))).otherwise(0.0)
    # the sum of the rates of the source's larger documents
    before = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(solved, F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", rate).drop("_s", "dual", "mean")
    cells = materialize(cells.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0.0))), "rates")
    tries = F.explode(F.transform(F.sequence(F.lit(0), F.lit(starts - 1)), lambda k: (k + 0.5) / starts)).alias("start")
    tried = F.col("size") * _copies(F.lit(0), F.col("n"), F.col("rate"), F.col("before") + F.col("start"))
    sums = cells.select("*", tries).groupBy("source", "start").agg(F.sum(tried).alias("words"), F.first("target").alias("target"))
    chosen = sums.groupBy("source").agg(F.min(F.struct(F.abs(F.col("words") - F.col("target")).alias("off"), "start"))["start"].alias("start")).select(F.col("source").alias("_s"), "start")
    cells = cells.join(chosen, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    cells = materialize(settle(cells, most), "copies").select(F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "rate", (F.col("before") + F.col("start")).alias("_base"), "change")
    ranked = number_within(base, ["source", "size"], [F.col("doc_id"), *row], F.xxhash64("doc_id"), max(64, -(-base.count() // 1_000_000)), "tie")
    joined = ranked.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    change = F.when(F.col("tie") == 0, F.col("change")).otherwise(0)
    copies = (_bounded(_copies(F.col("tie"), F.col("tie") + 1, F.col("rate"), F.col("_base")), most) + change).cast("long")
    return joined.withColumn("copies", copies).select("doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *row)
