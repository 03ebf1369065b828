import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from linkwright.operators import consensus as C, decision as D, models as M, pair_features as P


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_metric(spark):
    got = D.entity_f(frame(spark, [(1, 1), (1, 0), (1, 1)], "q long, label int"), frame(spark, [(1, 2)], "q long, n_true long")).first()
    assert abs(got["f"] - 0.714) < 1e-3
    m = D.macro_f(frame(spark, [(1, 0)], "q long, label int"), frame(spark, [(1, 0), (2, 0)], "q long, n_true long")).first()
    assert m["macro_f"] == 0.5 and m["entities"] == 2


def test_exclusive_and_shortlist(spark):
    p = frame(spark, [(1, 10, 0.5), (2, 10, 0.5), (3, 10, 0.4)], "q long, pid long, p double")
    assert [(r["q"], r["pid"]) for r in D.assign_exclusive(p).collect()] == [(1, 10)]
    p = frame(spark, [(1, 10, 0.9), (1, 11, 0.5), (1, 12, 0.3), (2, 20, 0.001), (2, 21, 0.0005), (3, 30, 0.2)], "q long, pid long, p double")
    assert {(r["q"], r["pid"]) for r in D.shortlist(p, 2, 0.005).collect()} == {(1, 10), (1, 11), (2, 20), (3, 30)}


def test_threshold_sweep_is_the_metric_at_each_threshold(spark):
    rng = np.random.default_rng(1)
    rows = list({(int(q), int(pid)): (int(q), int(pid), float(p), int(y)) for q, pid, p, y in zip(rng.integers(0, 30, 200), rng.integers(20_000_000, 20_000_050, 200), rng.integers(0, 64, 200) / 64, rng.integers(0, 2, 200), strict=True)}.values())
    pairs = frame(spark, rows, "q long, pid long, p double, label int")
    universe = frame(spark, [(q, sum(r[3] for r in rows if r[0] == q)) for q in range(32)], "q long, n_true long")
    grid = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = {r["threshold"]: r["macro_f"] for r in D.threshold_sweep(pairs, universe, grid).collect()}
    for t in grid:
        assert abs(got[t] - D.macro_f(D.assign_exclusive(pairs).where(F.col("p") >= t), universe).first()["macro_f"]) < 1e-12


def test_capacity(spark):
    rows = [(1, 20_000_000 + i, 0.9 - i / 100) for i in range(8)] + [(1, 30_000_000 + i, 0.9 - i / 100) for i in range(8)]
    kept = D.capacity_cap(frame(spark, rows, "q long, pid long, p double"), 0.1).collect()
    assert sum(r["src"] == 2 for r in kept) == 5 and sum(r["src"] == 3 for r in kept) == 6


def test_digits(spark):
    rows = [(1, 20_000_001, 0.9, "1223 main", "122 main"), (2, 20_000_002, 0.9, "1223 main", "12234 main"), (3, 20_000_003, 0.9, "x", "y")]
    r = {x["q"]: x for x in C.digit_relations(frame(spark, rows, "q long, pid long, p double, a_addr string, b_addr string")).collect()}
    assert r[1]["h_b_prefix_of_a"] == 1 and r[1]["h_a_prefix_of_b"] == 0 and r[2]["h_a_prefix_of_b"] == 1 and r[3]["has_h_a"] == 0 and r[3]["h_eq"] == 0


def test_decoys(spark):
    rows = [("jarlent labs", "jarleix labs"), ("jarlent labs", "jarlent lab"), ("acme", "acme corp"), (None, "")]
    r = P.decoy_features(frame(spark, rows, "a_core string, b_core string")).collect()
    assert (r[0]["dc_sub"], r[0]["dc_same_len"], r[0]["dc_ham"]) == (2, 1, 2) and r[1]["dc_sub"] == 0 and r[2]["dc_wordsym"] == 1 and r[3]["dc_lev"] == 0


def test_expected_f_by_enumeration():
    rng = np.random.default_rng(2)
    p = -np.sort(-rng.random((5, 4)), axis=1)
    lam = rng.random(5) * 0.4
    got = M.expected_f(p, lam)
    for i in range(5):
        for k in range(5):
            want = 0.0
            for outcome in itertools.product((0, 1), repeat=4):
                weight = math.prod(x if o else 1 - x for x, o in zip(p[i], outcome, strict=True))
                for m in range(40):
                    pois = math.exp(-lam[i]) * lam[i] ** m / math.factorial(m)
                    n_true, tp = sum(outcome) + m, sum(outcome[:k])
                    if k == 0:
                        f = 1.0 if n_true == 0 else 0.0
                    else:
                        f = 1.25 * tp / (0.25 * n_true + k)
                    want += weight * pois * f
            assert abs(got[i, k] - want) < 1e-6


def test_isotonic_reduces_the_error(spark):
    rng = np.random.default_rng(3)
    p = rng.random(4000)
    y = (rng.random(4000) < p**2).astype(int)
    d = frame(spark, [(i, i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y, strict=True))], "q long, pid long, p double, label int")
    knots = M.fit_isotonic(d, 100)
    assert all(a <= b for a, b in zip(knots[1], knots[1][1:], strict=False))
    assert D.ece(M.apply_isotonic(d, knots)).first()[0] < D.ece(d).first()[0] / 3


def test_bootstrap_holds_the_mean(spark):
    d = frame(spark, [(i, float(i % 7)) for i in range(700)], "q long, f double")
    r = D.bootstrap(d, "f", 100).first()
    assert r["lo"] < r["mean"] < r["hi"] and r["hi"] - r["lo"] < 1


def test_bootstrap_is_as_wide_as_the_theory_says(spark):
    rng = np.random.default_rng(3)
    for step in (1, 7, 1000):
        f = rng.random(2000)
        r = D.bootstrap(frame(spark, [(i * step, float(v)) for i, v in enumerate(f)], "q long, f double"), "f").first()
        wide = 2 * 1.96 * f.std() / np.sqrt(len(f))
        assert 0.85 < (r["hi"] - r["lo"]) / wide < 1.15 and abs(r["hi"] + r["lo"] - 2 * r["mean"]) < 0.2 * wide


def test_rounds_end_early_where_nothing_is_left_to_learn(spark):
    rng = np.random.default_rng(6)
    noise = frame(spark, [(i, i, float(rng.random()), int(rng.random() > 0.5)) for i in range(600)], "q long, pid long, x double, label int")
    model, columns = M.fit(noise, rounds=15, depth=3, held=4)
    assert columns == ["x"] and model.getNumTrees < 15 and M.fit(noise, rounds=15, depth=3)[0].getNumTrees == 15
    assert M.predict(model, columns, noise).count() == 600


def test_gbt_out_of_fold_scores_every_pair(spark):
    rng = np.random.default_rng(4)
    x = rng.random(400)
    d = frame(spark, [(i // 4, i, float(v), None if i % 50 == 0 else float(v * 2), int(v > 0.5)) for i, v in enumerate(x)], "q long, pid long, x double, y double, label int")
    out = M.out_of_fold(d, 2, 3, 3).collect()
    assert len(out) == 400 and np.mean([r["p"] for r in out if r["label"]]) > np.mean([r["p"] for r in out if not r["label"]]) + 0.3
