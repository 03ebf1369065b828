"""Dense candidates: exact cosine top k in blocks, recall reports, and merging into token-index candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..params import TYPES

#: Query vectors that go to every task at once: 200,000 of 384 floats are 300 MB, of 64 floats 50 MB.
SLICE_ROWS = 200_000
#: Cosines are rounded to this many digits before they are ranked, so that equal vectors tie.
DIGITS = 9


def hashed_encoder(dimension: int = 256):
    """A text encoder without a trained model: hashed character trigrams, unit length."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        import zlib

        def one(text: str | None) -> list[float]:
            v = np.zeros(dimension, np.float32)
            for w in (text or "").split():
                padded = f" {w} ".encode()
                for i in range(len(padded) - 2):
                    v[zlib.crc32(padded[i : i + 3]) % dimension] += 1
            n = float(np.linalg.norm(v))
            return (v / n if n else v).tolist()

        return texts.map(one)

    return run


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(len(rows), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def top_k(queries: DataFrame, pool: DataFrame, k: int = 5, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(q, pid, cos, rank): for every pool vector its k nearest query vectors; rank counts from 0, ties go to the lower q.

    The queries (q, v) are dealt out into slices of a bounded number of rows; each slice goes to all tasks once and meets
    the pool (pid, v) in matrix products. Each slice leaves k rows of a pool vector, and the best of these remain.
    """
    n = queries.count()
    slices = max(1, -(-n // slice_rows))
    spark = queries.sparkSession
    parts = []
    for s in range(slices):
        rows = queries.where(F.pmod(F.xxhash64("q"), F.lit(slices)) == s).select("q", "v").orderBy("q").toArrow()
        if not rows.num_rows:
            continue
        held = spark.sparkContext.broadcast((np.asarray(rows.column("q")), _unit(rows.column("v").to_pylist())))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, x = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                pid = batch.column(0).to_numpy()
                for at in range(0, len(pid), 256):
                    y = _unit(batch.column(1).slice(at, 256).to_pylist())
                    cos = np.round(y @ x.T, DIGITS)
                    # the k best, and all that tie with the last of them
                    m = min(k, len(ids))
                    floor = np.partition(cos, len(ids) - m, axis=1)[:, len(ids) - m]
                    row, col = np.nonzero(cos >= floor[:, None])
                    order = np.lexsort((ids[col], -cos[row, col], row))
                    row, col = row[order], col[order]
                    first = np.searchsorted(row, row)
                    best = np.arange(len(row)) - first < k
                    row, col = row[best], col[best]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[col]), pa.array(pid[at : at + 256][row]), pa.array(cos[row, col])], names=["q", "pid", "cos"])

        parts.append(pool.select("pid", "v").mapInArrow(run, "q bigint, pid bigint, cos double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("cos"), "q")) - 1
    return found.withColumn("rank", rank).where(F.col("rank") < k)


def recall_at(pairs: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(k, true_pairs, found): true pairs among the first k neighbours."""
    hit = truth.join(pairs.select("q", "pid", "rank"), ["q", "pid"], "left")
    return hit.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "rank").groupBy("k").agg(F.count("*").alias("true_pairs"), F.sum(F.when(F.col("rank") < F.col("k"), 1).otherwise(0)).alias("found"))


def gain_grid(pairs: DataFrame, candidates: DataFrame, truth: DataFrame, ks: list[int], cuts: list[float]) -> DataFrame:
    """(k, tau, added, recovered): what a neighbour channel would add to the candidates, and the true pairs among that."""
    new = pairs.join(candidates.select("q", "pid"), ["q", "pid"], "left_anti").join(truth.select("q", "pid", F.lit(1).alias("true")), ["q", "pid"], "left")
    grid = new.select("rank", "cos", "true", F.explode(F.array(*map(F.lit, ks))).alias("k")).select("*", F.explode(F.array(*map(F.lit, cuts))).alias("tau"))
    return grid.where((F.col("rank") < F.col("k")) & (F.col("cos") >= F.col("tau"))).groupBy("k", "tau").agg(F.count("*").alias("added"), F.coalesce(F.sum("true"), F.lit(0)).alias("recovered"))


def merge(candidates: DataFrame, pairs: DataFrame, k: int = 1, tau: float = 0.0, prefix: str = "emb", empty: DataFrame | None = None, k_empty: int = 3) -> DataFrame:
    """Candidates with <prefix>_cos and <prefix>_rank; neighbours that are no candidates join them with zero scores.

    A pool record of `empty` (pid), one without an address, may join up to rank k_empty. Merging twice changes nothing.
    """
    cos, rank = f"{prefix}_cos", f"{prefix}_rank"
    base = candidates.drop(cos, rank)
    p = pairs.where(F.col("cos") >= tau)
    if empty is not None:
        p = p.join(empty.select("pid", F.lit(True).alias("_e")).distinct(), "pid", "left")
        p = p.where((F.col("rank") < k) | (F.coalesce("_e", F.lit(False)) & (F.col("rank") < k_empty)))
    else:
        p = p.where(F.col("rank") < k)
    p = p.select("q", "pid", F.col("cos").alias(cos), F.col("rank").alias(rank))
    zero = [c for c in ("score", "ns", *(f"s_{t}" for t in TYPES)) if c in base.columns]
    return base.join(p, ["q", "pid"], "full").select(*(F.coalesce(c, F.lit(0)).alias(c) if c in zero else F.col(c) for c in base.columns), cos, rank)


def hard_negatives(candidates: DataFrame, truth: DataFrame, per_query: int = 1) -> DataFrame:
    """(q, pids): each query's best-scored candidates that are not true."""
    from pyspark.sql import Window

    wrong = candidates.join(truth.select("q", "pid"), ["q", "pid"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "pid"))
    top = wrong.withColumn("_rk", rank).where(F.col("_rk") <= per_query)
    return top.groupBy("q").agg(F.array_sort(F.collect_list("pid")).alias("pids"))
