"""Cosines in chunks, buckets and rounds against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright import storage
from linkwright.operators import tfidf as W

WORDS = "the of ab cd ef gh ij kl mn op qr st uv wx yz".split()


def texts(n, step):
    return ["the " * (i % 4) + " ".join(WORDS[(i * step + j * j) % 15] for j in range(i % 9)) + f" w{i % 40} é{i * step % 7}" if i % 11 else "" for i in range(n)]


def plain_cosines(queries, pool, pairs):
    """queries, pool: lists of (key, text); rows of equal keys are one record."""

    def counts(rows):
        out = {}
        for key, text in rows:
            w = text.split()
            out.setdefault(key, Counter()).update(w + [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)])
        return out

    q, p = counts(queries), counts(pool)
    df = Counter(t for c in p.values() for t in c)
    weigh = lambda c: {t: n * (math.log((len(pool) + 1) / (df[t] + 1)) + 1) for t, n in c.items()}
    q, p = ({k: weigh(c) for k, c in x.items()} for x in (q, p))
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return {(a, b): sum(x * p[b].get(t, 0) for t, x in q[a].items()) / ((norm(q[a]) * norm(p[b])) or 1) for a, b in pairs}


@pytest.mark.parametrize("repeats", [False, True])
def test_cosines_of_chunks_and_rounds(spark, monkeypatch, repeats):
    monkeypatch.setattr(W, "OCCURRENCES", 150)
    monkeypatch.setattr(W, "BYTES_A_RECORD", 120)
    queries, pool = list(enumerate(texts(60, 3))), list(enumerate(texts(90, 5)))
    if repeats:
        queries, pool = queries + [(3, "ab cd the"), (3, "ab cd")], pool + [(7, "the of ab"), (7, "the of")]
    pairs = [(q, p) for q in range(60) for p in range(90) if (q * 7 + p) % 4 == 0]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, addr string").repartition(3)
    stored, plain = {}, storage.materialise

    def watched(session, df, tag, **more):
        stored[tag] = plain(session, df, tag, **more)
        if tag == "term-chunks":
            rows = stored[tag].groupBy("bucket").count().collect()
            chunks = sum(r["count"] for r in rows if r["bucket"] < 0)
            # a word of nearly all records comes to its bucket once a chunk
            assert (0 if repeats else 3) < chunks < 150 and max(r["count"] for r in rows if r["bucket"] >= 0) <= chunks
        return stored[tag]

    monkeypatch.setattr(storage, "materialise", watched)
    since = storage.mark()
    got = W.cosine(spark.createDataFrame(pairs, "q long, pid long"), frame(queries, "q"), frame(pool, "pid"), W.word_terms(F.col("addr")), "cos")
    rounds = [d for tag, d in stored.items() if tag.startswith("term-cosines")]
    assert len(rounds) > 3 and sum(d.select("q").distinct().count() for d in rounds) == 60
    assert storage.mark() - since == len(rounds)
    want = plain_cosines(queries, pool, pairs)
    found = {(r["q"], r["pid"]): r["cos"] for r in got.collect()}
    assert found.keys() == want.keys() and max(want.values()) > 0.5
    assert all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_packed_numbers_come_back():
    for x in ([], [0], [3, 3, 70_000], [0, 255, 256, 2**40]):
        assert np.cumsum(W.unpack(W._steps(np.array(x, np.int64)))).tolist() == x
