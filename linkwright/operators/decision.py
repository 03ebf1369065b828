"""From scored pairs to match lists: ownership, thresholds, capacities, per-entity F-beta, calibration tables, blends.

Scored pairs are (q, pid, p) with p in [0, 1]; a pair's source is pid div PID_BASE.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..params import PID_BASE, DecisionParams

PRM = DecisionParams()


def source(pid: str = "pid") -> Column:
    return F.expr(f"{pid} div {PID_BASE}")


def assign_exclusive(pairs: DataFrame) -> DataFrame:
    """Every pool record keeps its best query; ties go to the lower q."""
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("p"), "q"))
    return pairs.withColumn("_rk", rank).where("_rk = 1").drop("_rk")


def shortlist(pairs: DataFrame, k: int | None = PRM.shortlist_k, pmin: float = PRM.shortlist_pmin) -> DataFrame:
    """A query's best pair always, and its other pairs of rank up to k with p of pmin or more. No k: all pairs."""
    if not k:
        return pairs
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("p"), "pid"))
    return pairs.withColumn("_rk", rank).where((F.col("_rk") == 1) | ((F.col("_rk") <= k) & (F.col("p") >= pmin))).drop("_rk")


def f_score(tp: Column, n_pred: Column, n_true: Column, beta2: float = PRM.beta2) -> Column:
    """F-beta of one entity: 1 if nothing is true and nothing predicted, 0 if either is empty or no prediction is true."""
    precision, recall = tp / n_pred, tp / n_true
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when((n_pred == 0) | (n_true == 0) | (tp == 0), 0.0).otherwise((1 + beta2) * precision * recall / (beta2 * precision + recall))


def entity_f(predicted: DataFrame, universe: DataFrame, beta2: float = PRM.beta2) -> DataFrame:
    """(q, n_true, n_pred, tp, f) of every entity of universe (q, n_true)."""
    got = predicted.groupBy("q").agg(F.count("*").alias("n_pred"), F.sum("label").alias("tp"))
    d = universe.join(got, "q", "left").select("q", "n_true", F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("tp", F.lit(0)).alias("tp"))
    return d.withColumn("f", f_score(F.col("tp"), F.col("n_pred"), F.col("n_true"), beta2))


def macro_f(predicted: DataFrame, universe: DataFrame, beta2: float = PRM.beta2) -> DataFrame:
    """One row: entities and their mean F. The mean is of whole billionths, so that no order of sums matters."""
    return entity_f(predicted, universe, beta2).agg(F.count("*").alias("entities"), (F.sum(F.round(F.col("f") * 1e9).cast("bigint")) / F.count("*") / 1e9).alias("macro_f"))


def threshold_sweep(pairs: DataFrame, universe: DataFrame, grid: list[float], exclusive: bool = True, beta2: float = PRM.beta2) -> DataFrame:
    """(threshold, macro_f) over a grid, in one pass.

    A pair counts for all thresholds up to its p. Entities change only where one of their pairs stops to count, so each
    entity contributes one row for each distinct count of its pairs, not for each threshold.
    """
    base = assign_exclusive(pairs) if exclusive else pairs
    # the number of grid points that a pair reaches; the grid ascends
    reach = reduce(lambda a, b: a + b, [(F.col("p") >= F.lit(t)).cast("int") for t in grid])
    w = Window.partitionBy("q").orderBy(F.desc("reach")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    steps = base.select("q", reach.alias("reach"), "label").where("reach > 0").select("q", "reach", F.count("*").over(w).alias("n_pred"), F.sum("label").over(w).alias("tp")).distinct()
    below = F.coalesce(F.lead("reach").over(Window.partitionBy("q").orderBy(F.desc("reach"))), F.lit(0))
    levels = steps.withColumn("below", below).join(universe, "q")
    whole = lambda f: F.round(f * 1e9).cast("bigint")
    gained = whole(f_score(F.col("tp"), F.col("n_pred"), F.col("n_true"), beta2))
    idle = whole(F.when(F.col("n_true") == 0, 1.0).otherwise(0.0))
    # an entity scores `gained` at grid points below+1 .. reach, and `idle` at all others
    change = levels.select(F.explode(F.array(F.struct((F.col("below") + 1).alias("at"), (gained - idle).alias("d")), F.struct((F.col("reach") + 1).alias("at"), (idle - gained).alias("d")))).alias("c")).groupBy("c.at").agg(F.sum("c.d").alias("d"))
    total = universe.agg(F.count("*").alias("n"), F.sum(idle).alias("idle"))
    points = base.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "at int, threshold double")
    # at most one row for each grid point on either side
    running = points.join(change.withColumnRenamed("at", "from"), F.col("from") <= F.col("at"), "left").groupBy("at", "threshold").agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d"))
    return running.crossJoin(total).select("threshold", ((F.col("d") + F.col("idle")) / F.col("n") / 1e9).alias("macro_f"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold of greatest macro F."""
    return sweep.orderBy(F.desc("macro_f"), "threshold").limit(1)


def capacity_cap(pairs: DataFrame, threshold: float, caps: dict[int, int] | None = None) -> DataFrame:
    """Owned pairs at or above the threshold, at most so many of each source for a query, the best first."""
    caps = caps or PRM.caps
    cap = reduce(lambda c, s: c.when(F.col("src") == s, caps[s]), caps, F.when(F.lit(False), 0))
    own = assign_exclusive(pairs).where(F.col("p") >= threshold).withColumn("src", source())
    rank = F.row_number().over(Window.partitionBy("q", "src").orderBy(F.desc("p"), "pid"))
    return own.withColumn("_rk", rank).where(F.col("_rk") <= F.coalesce(cap, F.lit(0))).drop("_rk")


def country_thresholds(pairs: DataFrame, thresholds: dict[str, float], threshold: float) -> DataFrame:
    """Probabilities clamped so that one global threshold acts as a country's own: pairs carry a column ctry."""
    own = reduce(lambda c, k: c.when(F.col("ctry") == k, thresholds[k]), thresholds, F.when(F.lit(False), 0.0))
    own = F.coalesce(own, F.lit(threshold))
    clamped = F.when(F.col("p") >= own, F.greatest("p", F.lit(threshold))).otherwise(F.least("p", F.lit(threshold - 1e-6)))
    return pairs.withColumn("p", clamped)


def lists(pairs: DataFrame, universe: DataFrame, name: str) -> DataFrame:
    """(q, <name>) for every entity: its pool records, ascending and joined by commas; empty without any."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("pid")), lambda x: x.cast("string")), ",")
    return universe.select("q").join(pairs.groupBy("q").agg(ids.alias(name)), "q", "left").select("q", F.coalesce(name, F.lit("")).alias(name))


def fold_hash(q: Column, folds: int = 5) -> Column:
    """A deterministic fold by multiplicative hashing; exact for q below 3.4e9."""
    return F.pmod(F.pmod(q * F.lit(2654435761), F.lit(4294967296)), F.lit(folds))


def holdout(universe: DataFrame, n: int, seed: int = 13) -> DataFrame:
    """n entities of least hash: a locked holdout that does not move when rows are added elsewhere."""
    return universe.select("q").orderBy(F.xxhash64("q", F.lit(seed)), "q").limit(n)


def calibration_bins(pairs: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, n, true_pairs, sum_p) over equal-width bins of p."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    return pairs.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("true_pairs"), F.sum("p").alias("sum_p"))


def ece(pairs: DataFrame, bins: int = 20) -> DataFrame:
    """Expected calibration error: the mean gap of mean p and true share, weighted by bin size."""
    b = calibration_bins(pairs, bins)
    gap = F.abs(F.col("sum_p") / F.col("n") - F.col("true_pairs") / F.col("n")) * F.col("n")
    return b.agg((F.sum(F.round(gap * 1e6).cast("bigint")) / F.sum("n") / 1e6).alias("ece"))


def logit(p: Column, eps: float = 1e-7) -> Column:
    p = F.greatest(F.lit(eps), F.least(p, F.lit(1 - eps)))
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def blend(models: list[DataFrame]) -> DataFrame:
    """(q, pid, p, n): the mean logit of several models' scores; n tells whether a pair lacks a model."""
    every = reduce(DataFrame.union, [m.select("q", "pid", logit(F.col("p")).alias("z")) for m in models])
    return every.groupBy("q", "pid").agg(sigmoid(F.avg("z")).alias("p"), F.count("*").alias("n"))


def average_two(a: DataFrame, b: DataFrame) -> DataFrame:
    """(q, pid, xs, xs_gap): two scorers' mean logit as a probability, and the distance of their logits."""
    d = a.select("q", "pid", logit(F.col("p")).alias("za")).join(b.select("q", "pid", logit(F.col("p")).alias("zb")), ["q", "pid"])
    return d.select("q", "pid", sigmoid((F.col("za") + F.col("zb")) / 2).alias("xs"), F.abs(F.col("za") - F.col("zb")).alias("xs_gap"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the probabilities of new where new has the pair."""
    return old.join(new.select("q", "pid", F.col("p").alias("_new")), ["q", "pid"], "left").withColumn("p", F.coalesce("_new", "p")).drop("_new")


def scorer_band(pairs: DataFrame, lo: float = 0.02, hi: float = 0.98, easy: int = 10) -> DataFrame:
    """Pairs for a second scorer: undecided ones, confident mistakes, and one in `easy` of the certain true ones."""
    p, label = F.col("p"), F.col("label")
    sure = (label == 1) & (p > hi) & (F.pmod(F.col("q") * 31 + F.col("pid"), F.lit(easy)) == 0)
    why = F.when((p >= lo) & (p <= hi), "band").when((label == 0) & (p > 0.9), "mistake").when(sure, "easy")
    return pairs.withColumn("why", why).where("why IS NOT NULL")


def paired_comparison(a: DataFrame, b: DataFrame, universe: DataFrame, threshold: float) -> DataFrame:
    """One row: entities, those where either model is better, and the mean difference in F."""
    f = lambda m, name: entity_f(assign_exclusive(m).where(F.col("p") >= threshold), universe).select("q", F.round(F.col("f") * 1e9).cast("bigint").alias(name))
    d = f(a, "fa").join(f(b, "fb"), "q")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return d.agg(F.count("*").alias("entities"), n(F.col("fb") > F.col("fa")).alias("b_better"), n(F.col("fb") < F.col("fa")).alias("a_better"), (F.sum(F.col("fb") - F.col("fa")) / F.count("*") / 1e9).alias("delta"))


#: The prime field of the resampling weights.
FIELD = 2_147_483_647
#: A uniform number of the field above the k-th of these has a Poisson(1) weight of more than k.
CUTS = [int(FIELD * c) for c in np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1))) for k in range(7)])]


def bootstrap(values: DataFrame, column: str, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """(mean, lo, hi): a 95% Poisson-bootstrap interval of a column's mean, in one distributed pass.

    Each row gets a Poisson(1) weight in every round by a polynomial of its q over a prime field, whose constants are the
    round's; only the rounds' sums leave the executors. Values are counted in whole billionths, so sums are exact.
    """
    field = F.lit(FIELD).cast("bigint")
    step = lambda x, y: (F.col(x) * F.col(x) + y) % field
    d = values.select(F.pmod(F.col("q").cast("bigint"), field).alias("_q"), F.round(F.col(column) * 1e9).cast("bigint").alias("_v"))
    d = d.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_x", (F.col("_r") + 1000 * seed) * 48_271 % field)
    for new, square, plus in (("_a", "_x", F.lit(69_621)), ("_b", "_a", F.col("_x"))):
        d = d.withColumn(new, step(square, plus))
    d = d.withColumn("_h", (F.col("_q") * F.col("_a") + F.col("_b")) % field).withColumn("_s", step("_h", F.col("_a"))).withColumn("_u", (F.col("_s") * F.col("_b") + F.col("_h")) % field)
    weight = reduce(lambda a, b: a + b, [(F.col("_u") >= c).cast("bigint") for c in CUTS])
    means = d.withColumn("_w", weight).groupBy("_r").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w") / 1e9).alias("m"))
    ends = means.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    return values.agg((F.sum(F.round(F.col(column) * 1e9).cast("bigint")) / F.count("*") / 1e9).alias("mean")).crossJoin(ends)
