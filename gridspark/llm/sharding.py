"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Equal texts form a group that stays in one shard; only a group with more bytes than a shard's fair share, which fits no
shard, is cut (by id, into as few pieces as fit).  Every group goes to the shard where the dot product of its sizes
with the residual capacity is highest.  Large groups are placed first, by the driver: their number has a bound whatever
the input.  The capacity they leave is divided among batches of the other groups, dealt by hash, and every batch is
placed largest first by a task that keeps nothing but the shards' residuals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm._shared import materialize, word_count
from gridspark.llm.numbering import number_within


def place(share: np.ndarray, left: np.ndarray, weights: np.ndarray, turn: int = 0) -> np.ndarray:
    """A shard for each row of ``share`` (sizes as shares of a fair shard), in order; ``left`` (shards x dimensions) goes down.

    Equal dot products go to the first shard from ``turn`` on, so that batches don't all begin with the same shard.
    """
    out = np.zeros(len(share), np.int32)
    for i, s in enumerate(share):
        worth = left @ (weights * s)
        out[i] = (int(np.argmax(np.roll(worth, -turn))) + turn) % len(left)
        left[out[i]] -= s
    return out


def _place_batches(fair: np.ndarray, left: np.ndarray, weights: np.ndarray):
    """Rows (batch, grp, s, t, r) come sorted by batch, largest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, left
        for part in batches:
            batch, grp = part.column(0).to_numpy(), part.column(1)
            share = np.stack([part.column(i).to_numpy().astype(float) for i in (2, 3, 4)], axis=1) / fair
            at = np.empty(len(batch), np.int32)
            cuts = np.concatenate([[0], np.flatnonzero(batch[1:] != batch[:-1]) + 1, [len(batch)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if batch[a] != now:
                        now, own = batch[a], left.copy()
                    at[a:b] = place(share[a:b], own, weights, int(now) % len(left))
            yield pa.RecordBatch.from_arrays([grp, pa.array(at)], names=["grp", "shard"])

    return run


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, weights: tuple[float, float, float] = (4.0, 2.0, 0.1), large: int = 512, batch: int = 16_384) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, cut, shard, slot): one row per row of docs.

    size: UTF-8 bytes of the text plus ``overhead``; tokens: runs of anything but ASCII white space; slot counts the
    rows of a shard from 0; ``weights`` of bytes, tokens and rows say which balance counts most.  A group is large from
    a ``large``-th of a shard's fair share in some dimension, so 3 * shards * large groups at most are; a batch is about
    ``batch`` other groups.  cut: the row's group of equal texts has more bytes than a shard's fair share, so that no
    shard could hold it and all the others stay equal; it is dealt in pieces, each of which is in one shard.

    A null text has 0 bytes and 0 tokens and groups with empty texts.  Rows that repeat an id are rows of their own, in
    one shard if their texts are equal and the group isn't cut.  Null ids are placed like others.  An empty table gives
    an empty table.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = materialize(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text).cast("long") + overhead).alias("size"), word_count(text).alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("grp")), "sizes")
    groups = materialize(base.groupBy("grp").agg(F.sum("size").alias("s"), F.sum("tokens").alias("t"), F.count("*").alias("r")), "groups")
    total = groups.agg(F.sum("s"), F.sum("t"), F.sum("r"), F.count("*")).first()
    fair = np.array([max(float(x or 0), 1e-9) / shards for x in total[:3]])
    w = np.array(weights)
    weight = F.greatest(*[F.col(c) / float(f) for c, f in zip("str", fair, strict=True)])
    weighed = groups.withColumn("weight", weight)
    # a group that fits no shard is cut into pieces that do
    big = sorted(((r.grp, k, n, r.s / n, r.t / n, r.r / n) for r in weighed.filter(F.col("weight") > 1 / large).collect() for n in [min(r.r, -(-r.s // max(1, int(fair[0]))))] for k in range(n)), key=lambda x: (-(np.array(x[3:]) / fair @ w), x[:2]))
    left = np.ones((shards, 3))
    at = place(np.array([x[3:] for x in big], float).reshape(-1, 3) / fair, left, w)
    spark = docs.sparkSession
    to = spark.createDataFrame([(x[0], x[1], x[2], int(s)) for x, s in zip(big, at, strict=True)], "grp bigint, piece int, pieces int, to int")
    cut = F.broadcast(to.groupBy("grp").agg(F.first("pieces").alias("pieces"), F.map_from_entries(F.collect_list(F.struct("piece", "to"))).alias("to")))  # 3 * shards * (large + 1) entries at most
    batches = max(1, -(-(total[3] - len(big)) // batch))
    small = weighed.filter(F.col("weight") <= 1 / large).select(F.pmod(F.xxhash64("grp"), F.lit(batches)).cast("int").alias("batch"), "grp", "s", "t", "r", "weight")
    sorted_ = small.repartition("batch").sortWithinPartitions("batch", F.desc("weight"), "grp").select("batch", "grp", "s", "t", "r")
    homes = materialize(sorted_.mapInArrow(_place_batches(fair, left / batches, w), "grp bigint, shard int"), "homes")
    marked = base.join(cut, "grp", "left")
    cols = ["doc_id", "size", "tokens", "text_crc32", (F.coalesce(F.col("pieces"), F.lit(1)) > 1).alias("cut"), "shard"]
    tasks = max(64, -(-int(total[2] or 0) // (shards * 100_000)))
    order, spread = [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.xxhash64("doc_id", "text_crc32")
    turn = number_within(marked.filter("pieces > 1"), ["grp"], order, spread, tasks, "turn").withColumn("piece", F.pmod("turn", F.col("pieces")).cast("int"))
    placed = marked.filter("pieces = 1").withColumn("piece", F.lit(0)).unionByName(turn.drop("turn")).withColumn("shard", F.try_element_at("to", F.col("piece"))).select(cols)
    # the groups of this join are small, so no key is hot
    placed = placed.unionByName(marked.filter("to is null").select("doc_id", "size", "tokens", "text_crc32", "grp", "pieces").join(homes, "grp").select(cols))
    return number_within(placed, ["shard"], order, spread, tasks, "slot")
