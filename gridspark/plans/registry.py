"""All queries by name, each with the same query as SQL where SQL can say it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridspark.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a session of one process may do without spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/gridspark-{uuid.uuid4().hex}"


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Register a function of Views under a name; sql may use the views by name."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            body, head = sql.strip(), with_views(views)
            if head and (start := re.match(r"WITH (RECURSIVE )?", body)):
                head, body = head.rstrip().replace("WITH ", start[0], 1) + ",\n", body[start.end() :]
            ORACLE_SQL[name] = head + body
        return f

    return add
