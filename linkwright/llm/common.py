"""Helpers that every training-data operator shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import drop, drop_since, mark, materialise, shared_dir, write  # noqa: F401  used by the operators through here

#: Rows and bytes in one Arrow batch; texts can be long, so batches are bounded by both.
BATCH_ROWS = 1_000
BATCH_BYTES = 16 * 1024 * 1024


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HELD: dict = {}


def worker_cache(name: str, make: Callable):
    """What a Python worker keeps from task to task: one thing at a time, so that operators do not add up in a reused worker."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one where df has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
