"""Learned scorers and calibration: boosted trees out of fold, isotonic maps, expected-F selection."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType

from .decision import fold_hash

#: Rounds end when the held-out loss falls by less than this.
EARLY_GAIN = 0.001
KEYS = ("q", "pid", "label", "fold", "p")


def feature_columns(pairs: DataFrame) -> list[str]:
    """Every numeric column that is no key."""
    return sorted(f.name for f in pairs.schema.fields if f.name not in KEYS and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte"))


def _assembled(pairs: DataFrame, columns: list[str]) -> DataFrame:
    # the trees need a number: missing values become one that no feature takes
    filled = pairs.select(*(c for c in pairs.columns if c not in columns), *(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(-999.0)).alias(c) for c in columns))
    return VectorAssembler(inputCols=columns, outputCol="_x").transform(filled)


def fit(pairs: DataFrame, columns: list[str] | None = None, rounds: int = 20, depth: int = 5, seed: int = 13, held: int = 0) -> tuple[GBTClassificationModel, list[str]]:
    """Boosted trees and their columns. With held, every held-th query by hash is kept out, and rounds end early once its pairs gain no more."""
    columns = columns or feature_columns(pairs)
    trees = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    if held:
        # another hash than that of the folds, so that every fold has queries on either side
        pairs = pairs.withColumn("_held", F.pmod(F.xxhash64("q", F.lit("held")), F.lit(held)) == 0)
        trees = trees.setValidationIndicatorCol("_held").setParams(validationTol=EARLY_GAIN)
    return trees.fit(_assembled(pairs, columns)), columns


def predict(model: GBTClassificationModel, columns: list[str], pairs: DataFrame) -> DataFrame:
    out = model.transform(_assembled(pairs, columns))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction", "p1").select(*(c for c in pairs.columns if c not in columns and c != "p"), "p")


def out_of_fold(pairs: DataFrame, folds: int = 5, rounds: int = 20, depth: int = 5, held: int = 0) -> DataFrame:
    """Pairs with p from a model that saw none of their query's pairs: all pairs of a query share a fold."""
    d = pairs.withColumn("fold", fold_hash(F.col("q"), folds))
    columns = feature_columns(pairs)
    parts = []
    for f in range(folds):
        model, _ = fit(d.where(F.col("fold") != f), columns, rounds, depth, held=held)
        parts.append(predict(model, columns, d.where(F.col("fold") == f)))
    return reduce(DataFrame.unionByName, parts)


def prune(candidates: DataFrame, scored: DataFrame, k: int = 30) -> DataFrame:
    """The k best candidates of each query by a learned score p_block; the score stays out of later features."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("p_block"), "pid"))
    return candidates.join(scored.select("q", "pid", F.col("p").alias("p_block")), ["q", "pid"]).withColumn("_rk", rank).where(F.col("_rk") <= k).drop("_rk")


def fit_isotonic(pairs: DataFrame, bins: int = 2000) -> tuple[list[float], list[float]]:
    """Knots of a monotone map from p to the true share: quantile bins by Spark, their at most `bins` means pooled here."""
    edges = sorted(set(pairs.approxQuantile("p", [i / bins for i in range(1, bins)], 1 / (4 * bins))))

    @F.pandas_udf(IntegerType())
    def bin_of(p: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, p.to_numpy(), side="right").astype(np.int32))

    rows = pairs.groupBy(bin_of("p").alias("b")).agg(F.avg("p").alias("x"), F.avg("label").alias("y"), F.count("*").alias("w")).orderBy("b").collect()
    pools: list[list[float]] = []
    for r in rows:
        pools.append([r["x"] * r["w"], r["y"] * r["w"], float(r["w"])])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] > pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    return [p[0] / p[2] for p in pools], [p[1] / p[2] for p in pools]


def apply_isotonic(pairs: DataFrame, knots: tuple[list[float], list[float]]) -> DataFrame:
    """p mapped by linear interpolation, clamped at either end."""
    x, y = knots

    @F.pandas_udf(DoubleType())
    def run(p: pd.Series) -> pd.Series:
        return pd.Series(np.interp(p.to_numpy(), x, y))

    return pairs.withColumn("p", run("p")) if x else pairs


def expected_f(probabilities: np.ndarray, outside: np.ndarray, beta2: float = 0.25, tail: int = 24) -> np.ndarray:
    """Expected F-beta of keeping the first k of each row's probabilities, k = 0, 1, ...; (rows, J) descending.

    outside: Poisson means of true matches that are not listed; counts above `tail` fold into the last.
    """
    n, width = probabilities.shape

    def add(dist: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The distribution of a count after one more chance p."""
        return np.pad(dist, ((0, 0), (0, 1))) * (1 - p)[:, None] + np.pad(dist, ((0, 0), (1, 0))) * p[:, None]

    counts = np.arange(tail + 1)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, tail + 1)))])
    lam = np.maximum(outside, 1e-300)[:, None]
    missing = np.exp(counts * np.log(lam) - lam - log_factorial)
    missing[:, -1] += np.clip(1 - missing.sum(1), 0, None)
    # the distribution of matches beyond the first k, for k = width, ..., 0
    beyond = [missing]
    for j in range(width - 1, -1, -1):
        beyond.append(add(beyond[-1], probabilities[:, j]))
    beyond.reverse()
    out = np.empty((n, width + 1))
    out[:, 0] = beyond[0][:, 0]
    hits = np.ones((n, 1))
    for k in range(1, width + 1):
        hits = add(hits, probabilities[:, k - 1])
        tp, more = np.arange(k + 1)[:, None], np.arange(beyond[k].shape[1])[None, :]
        value = (1 + beta2) * tp / (beta2 * (tp + more) + k)
        out[:, k] = ((hits @ value) * beyond[k]).sum(1)
    return out


def select_expected(pairs: DataFrame, mu: float = 0.0, listed: int = 12, beta2: float = 0.25) -> DataFrame:
    """The pairs of the prefix of each query's list, best first, that maximises its expected F-beta.

    A query contributes one row of at most `listed` probabilities and the sum of the others, whatever its length.
    """
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("p"), "pid"))
    ranked = pairs.withColumn("_rk", rank)
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("_rk") <= listed, F.struct("_rk", "p")))), lambda s: s.p)
    rows = ranked.groupBy("q").agg(top.alias("ps"), F.coalesce(F.sum(F.when(F.col("_rk") > listed, F.col("p"))), F.lit(0.0)).alias("rest"))

    @F.pandas_udf(IntegerType())
    def best(ps: pd.Series, rest: pd.Series) -> pd.Series:
        table = np.zeros((len(ps), listed))
        for i, p in enumerate(ps):
            table[i, : len(p)] = p
        return pd.Series(expected_f(table, rest.to_numpy() + mu, beta2).argmax(1).astype(np.int32))

    keep = rows.select("q", best("ps", "rest").alias("_k"))
    return ranked.join(keep, "q").where(F.col("_rk") <= F.col("_k")).drop("_rk", "_k")
