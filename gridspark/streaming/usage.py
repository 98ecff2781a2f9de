"""The usage log as a stream (STR)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridspark.operators.catalogue import usage_entries


def stream_requests(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(format).load(path)


def stream_usage_log(requests: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the requests that have arrived to the log at ``out``, once each, and stop."""
    log = usage_entries(requests)
    return log.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def stream_usage_by(log: DataFrame, dim: str) -> DataFrame:
    """Running (dim, requests, cached, percent) of map requests; the state has a row per host or agent, not per request."""
    out = log.filter(F.col("wms_operation") == "GetMap").groupBy(dim).agg(F.count("*").alias("requests"), F.count_if("used_cache").alias("cached"))
    return out.withColumn("percent", F.col("cached") * 100.0 / F.col("requests"))


class _Folders:
    """The numbered folders below a place in any store that Spark reads: ``batch=7``, ``upto=15``."""

    def __init__(self, spark: SparkSession, out: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.out, self._root = out, self._path(out)
        self._store = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self, name: str) -> list[int]:
        """Numbers of the complete folders of a name, ascending; one that is still being written isn't complete."""
        if not self._store.exists(self._root):
            return []
        names = [x.getPath().getName() for x in self._store.listStatus(self._root)]
        found = sorted(int(x.split("=")[1]) for x in names if x.startswith(f"{name}="))
        return [n for n in found if self._store.exists(self._path(f"{self.out}/{name}={n}/_SUCCESS"))]

    def delete(self, name: str, numbers: list[int]) -> None:
        for n in numbers:
            self._store.delete(self._path(f"{self.out}/{name}={n}"), True)


def _latest(spark: SparkSession, dim: str, out: str, folders: _Folders) -> DataFrame | None:
    """(dim, batch, requests, cached, percent): the latest row of every value, over the newest snapshot and the batches since."""
    upto = folders.numbers("upto")[-1:]
    since = [n for n in folders.numbers("batch") if not upto or n > upto[0]]
    parts = [spark.read.parquet(f"{out}/upto={n}") for n in upto] + [spark.read.parquet(f"{out}/batch={n}").withColumn("batch", F.lit(n).cast("long")) for n in since]
    if not parts:
        return None
    rows = reduce(DataFrame.unionByName, parts)
    latest = rows.groupBy(dim).agg(F.max_by(F.struct("batch", "requests", "cached", "percent"), "batch").alias("r"))
    return latest.select(dim, "r.*")


def keep_usage_by(dim: str, out: str, every: int = 16) -> Callable[[DataFrame, int], None]:
    """What to do with the rows that a batch updates: keep them in a folder of the batch, and fold ``every`` folders into one.

    Each ``every``-th batch writes a snapshot of the latest rows of all values, named by the last batch in it, which takes
    over as soon as it is complete; then the folded batches go, and snapshots but this one and the one before, which a
    reader may still have open.  So there are at most 2 * ``every`` folders, and a reader opens ``every`` of them at most.
    A batch that is run again after a failure overwrites its own folder, or, if a complete snapshot has it, changes nothing.
    """
    def write(updated: DataFrame, batch: int) -> None:
        spark = updated.sparkSession
        folders = _Folders(spark, out)
        if any(n >= batch for n in folders.numbers("upto")):
            return
        updated.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if (batch + 1) % every == 0:
            _latest(spark, dim, out, folders).coalesce(1 + batch // 1000).write.mode("overwrite").parquet(f"{out}/upto={batch}")
            folders.delete("batch", [n for n in folders.numbers("batch") if n <= batch])
            folders.delete("upto", folders.numbers("upto")[:-2])

    return write


def start_usage_by(log: DataFrame, dim: str, out: str, checkpoint: str, every: int = 16) -> StreamingQuery:
    """Count until all that has arrived is counted; see keep_usage_by for what is below ``out``.

    read_usage_by gives the counts of now.
    """
    return stream_usage_by(log, dim).writeStream.foreachBatch(keep_usage_by(dim, out, every)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_usage_by(spark: SparkSession, dim: str, out: str) -> DataFrame:
    """(dim, requests, cached, percent): the latest row of every value, most frequent first; empty before the first batch."""
    found = _latest(spark, dim, out, _Folders(spark, out))
    if found is None:
        return spark.createDataFrame([], f"`{dim}` string, requests long, cached long, percent double")
    return found.select(dim, "requests", "cached", "percent").orderBy(F.desc("requests"), dim)
