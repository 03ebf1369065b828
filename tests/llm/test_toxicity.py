import random

import numpy as np

from linkwright.llm import toxicity as T


def corpus(n=600, seed=1):
    """Toxic texts hold some words with a bad stem; every tenth label is missing."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "tem", "con", "ad") for b in ("em", "um", "or", "is", "ect", "a", "ix")]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 12)):
                own[rng.randrange(len(own))] = "zorg" + rng.choice(["", "ab", "eki", "un"])
        docs.append((i, " ".join(own)))
        if i % 10:
            labels.append((i, 1, int(toxic)))
        elif i % 20 == 0:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_order(spark):
    docs, labels = corpus()
    d, l = frames(spark, docs, labels)
    model = T.train(spark, d, l)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == T.GRADES - 1
    fresh, _ = corpus(400, 2)
    got = {r["doc_id"]: r for r in T.score(d.sparkSession.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    assert all(got[i]["rejected"] == (i % 5 == 0) for i in range(400))
    few, many = model.scorer()("zorgab lorem " * 1), model.scorer()("zorgab zorgeki zorgun zorg " * 10)
    assert sum(few) < sum(many) and all(a >= b for a, b in zip(many, many[1:], strict=False))


def test_the_fit_finds_the_model():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 2))
    z = x @ [2.0, -1.0] + rng.logistic(size=4000)
    y = np.searchsorted([-1.0, 1.0, 2.5], z)
    w, cuts = T.fit_ordinal(x, y, 600)
    assert np.abs(w - [2, -1]).max() < 0.2 and np.abs(cuts - [-1, 1, 2.5]).max() < 0.25


def test_edges(spark, cluttered):
    docs, labels = corpus(300)
    d, l = frames(spark, [*docs, (9000, None), (9001, ""), (None, "zorg " * 30), (9002, "lorem " * 60_000), docs[0]], labels)
    model = T.train(spark, cluttered(d), cluttered(l))
    rows = T.score(cluttered(d), model).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 305 and not got[9000]["rejected"] and not got[9001]["rejected"] and got[None]["rejected"] and not got[9002]["rejected"]
    kept = T.reject(cluttered(d), model)
    assert kept.columns == cluttered(d).columns and kept.count() == sum(not r["rejected"] for r in rows)
    empty = T.train(spark, d, l.limit(0))
    assert not any(r["rejected"] or r["severity"] for r in T.score(d, empty).collect())
    assert T.train(spark, d.limit(0), l).thresholds == [] and T.score(d.limit(0), model).collect() == []
    only = spark.createDataFrame([(0, 1, 1), (5, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    assert T.train(spark, d, only).thresholds == []
