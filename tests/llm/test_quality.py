import random
import re
from collections import Counter

import numpy as np
import pytest

from linkwright.llm import quality as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = text.split("\n")
    doubled = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(hit)


@pytest.mark.parametrize("seed", range(20))
def test_counts(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "b ", "\n", "\t", " ", "a b\n", "é#", "||", "\u00a0", "\x85", "\x1c"]) for _ in range(rng.randint(0, 200)))
    assert Q.counts(text)[:5] == brute(text)


def test_edges():
    assert Q.counts(None) == Q.counts("") == (0, 0, 0, 0, 0, 0) and Q.counts("a a a a")[4] == 4 and Q.counts("a a a")[4] == 0
    assert Q.base_failed(Q.counts("x")) and not Q.base_failed(Q.counts(" ".join(f"w{i}" for i in range(50))))


def test_estimate_ignores_outliers():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 5)) * [1, 0.2, 0.1, 0.2, 0.2]
    x[:80] += 9
    mean, scatter = Q.minimum_determinant(x)
    assert np.abs(mean).max() < 0.5 and (Q.distances(x[:80], mean, scatter) > 60).all() and np.median(Q.distances(x[80:], mean, scatter)) < 8


def rows():
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "amet", "con") for b in ("em", "um", "or", "is", "ect", "a")]
    out = [(i, " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) + str(rng.randint(0, 99)) for _ in range(rng.randint(60, 400))), ("en", "de")[i % 2], "src0" if i % 3 else "src1") for i in range(600)]
    bad = [(1000 + i, " ".join(f"{rng.choice(words)}###$$$%%%" for _ in range(120 + i)), "en", "src0") for i in range(12)]
    return out, bad


def test_outliers_go_and_clean_rows_stay(spark, cluttered, monkeypatch):
    monkeypatch.setattr(Q, "CHUNK_ROWS", 100)
    good, bad = rows()
    edge = [(2000, None, None, None), (2001, "", "en", "src0"), (None, good[0][1], "en", "src0"), (2002, "word " * 60_000, "xx", "lone"), (2003, good[3][1], "xx", "alone"), good[5]]
    d = spark.createDataFrame([*good, *bad, *edge], "doc_id long, text string, lang string, source string")
    got = {}
    for r in Q.judge(spark, cluttered(d)).collect():
        got.setdefault(r["doc_id"], []).append(r)
        assert not (r["base_failed"] and r["kept"])
    assert all(x["kept"] for i, *_ in good for x in got[i]) and not any(got[i][0]["kept"] for i, *_ in bad) and len(got[good[5][0]]) == 2
    assert got[2000][0]["base_failed"] and got[2001][0]["n_words"] == 0 and got[2002][0]["base_failed"] and got[2003][0]["kept"] and got[None][0]["kept"]
    assert Q.judge(spark, d.limit(0)).collect() == []


def whole_group_estimate(x, rng, starts=200):
    """Plain FAST-MCD over all rows of a group: random starts of p + 1 rows, two steps each, the ten best to the end."""
    h = min(len(x), (len(x) + Q._P + 1) // 2)

    def step(mean, scatter):
        near = x[np.argsort(Q.distances(x, mean, scatter), kind="stable")[:h]]
        return near.mean(0), np.cov(near, rowvar=False, bias=True).reshape(Q._P, Q._P)

    def size(estimate):
        return np.linalg.slogdet(estimate[1] + np.diag(Q.RESOLUTION**2))[1]

    found = []
    for _ in range(starts):
        few = x[rng.choice(len(x), min(len(x), Q._P + 1), replace=False)]
        found.append(step(*step(few.mean(0), np.cov(few, rowvar=False, bias=True).reshape(Q._P, Q._P))))
    ends = []
    for estimate in sorted(found, key=size)[:10]:
        for _ in range(100):
            after = step(*estimate)
            if size(after) >= size(estimate) - 1e-12:
                break
            estimate = after
        ends.append(estimate)
    return (*min(ends, key=size), h)


def drawn_to_all(estimates):
    """Scatter of each group, drawn to that of all groups by its rows."""
    rows = sum(e[2] for e in estimates.values())
    pooled = sum((e[1] * e[2] for e in estimates.values()), np.zeros((Q._P, Q._P))) / max(rows, 1)
    return {g: (mean, (scatter * h + pooled * Q.PRIOR_ROWS) / (h + Q.PRIOR_ROWS)) for g, (mean, scatter, h) in estimates.items()}


def plain_distances(documents):
    """Distance of each (language, source, text) by whole-group estimates; None for rows that fail the base rules."""
    rng = np.random.default_rng(5)
    found = [Q.counts(t) for _, _, t in documents]
    groups = {}
    for k, (lang, source, _) in enumerate(documents):
        if not Q.base_failed(found[k]):
            groups.setdefault((lang or "", source or ""), []).append(k)
    x = {g: np.array([Q.vector(found[k]) for k in ks]) for g, ks in groups.items()}
    first = drawn_to_all({g: whole_group_estimate(x[g], rng) for g in groups})
    last = {}
    for g, (mean, scatter) in first.items():
        near = x[g][Q.distances(x[g], mean, scatter * 1.9122) <= 12.833]
        last[g] = (near.mean(0), np.cov(near, rowvar=False, bias=True).reshape(Q._P, Q._P), len(near))
    out = [None] * len(documents)
    for g, (mean, scatter) in drawn_to_all(last).items():
        for k, one in zip(groups[g], Q.distances(x[g], mean, scatter), strict=True):
            out[k] = float(one)
    return out


# 200 odd rows are over a quarter of a group, and by chance more in some of its chunks of 60
@pytest.mark.parametrize(("chunk_rows", "odd"), [(60, 80), (60, 200), (2_000, 200)])
def test_verdicts_are_those_of_whole_groups(spark, monkeypatch, chunk_rows, odd):
    monkeypatch.setattr(Q, "CHUNK_ROWS", chunk_rows)
    rng = random.Random(9)
    good, bad = rows()
    mixed = [(3000 + k, t + " ".join([" #"] * rng.randint(0, 120)) + "\nsame line here" * rng.randint(0, 12), lang, source) for k, (_, t, lang, source) in enumerate(good[:odd])]
    every = [*good, *bad, *mixed]
    want = dict(zip((r[0] for r in every), plain_distances([(lang, source, t) for _, t, lang, source in every]), strict=True))
    got = {r["doc_id"]: r for r in Q.judge(spark, spark.createDataFrame(every, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(every)
    # the estimates are not the same, so rows within a fifth of the limit may fall to either side
    sure = [i for i, d in want.items() if d is None or not 0.8 * Q.CUTOFF < d < 1.25 * Q.CUTOFF]
    assert len(sure) > 0.9 * len(every)
    assert [i for i in sure if got[i]["kept"] != (want[i] is not None and want[i] <= Q.CUTOFF)] == []
    assert 20 < sum(not r["kept"] for r in got.values()) < len(bad) + odd + 1
