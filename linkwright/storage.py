"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a folder of our own, in local mode only."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("linkwright.shared.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='linkwright-')}"
    spark.conf.set("linkwright.shared.dir", made)
    return made


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write(spark: SparkSession, df: DataFrame, tag: str) -> str:
    """Write df to a new path of the shared folder. The files go when the driver's JVM ends, or by drop().

    The driver's garbage is collected afterwards: Spark removes the shuffle files of what is done only then.
    """
    path = f"{shared_dir(spark)}/linkwright/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    _MADE.append(path)
    spark.sparkContext._jvm.System.gc()
    return path


def materialise(spark: SparkSession, df: DataFrame, tag: str, gather: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: it is computed once, and a lost executor costs no recomputation.

    gather deals the rows into files of the size that adaptive execution aims at: what a scan of many splits leaves is
    often much smaller than the splits, and every small file costs its writer and all its readers.
    """
    return spark.read.schema(df.schema).parquet(write(spark, df.hint("rebalance") if gather else df, tag))


def mark() -> int:
    """A point in time for drop_since()."""
    return len(_MADE)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        at, files = _path(spark, path)
        files.delete(at, True)
        if path in _MADE:
            _MADE.remove(path)


def drop_since(spark: SparkSession, since: int, but: DataFrame) -> None:
    """Delete what was written since a mark, except what but reads."""
    kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in but.inputFiles()}
    drop(spark, *(p for p in _MADE[since:] if p.rsplit("/", 1)[-1] not in kept))
