import random

import pytest
from pyspark.sql import functions as F

from linkwright.llm import components as C, minhash as M


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent=80):
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if s[i] else [doc]
        c = min(ids, default=None)
        out.append((doc, len(s[i]), c, doc == c))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def near_copies(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"w{rng.random()}"
    return " ".join(w)


def corpus(seed, n=220):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows, bases = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 or not bases:
            bases.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 250))))
            text = bases[-1]
        elif kind < 0.5:
            text = rng.choice(bases).upper()
        elif kind < 0.85:
            text = near_copies(rng, rng.choice(bases), rng.randint(0, 6))
        else:
            text = passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(20, 100)))
        rows.append((i * 3 % 1009, text))
    return rows


@pytest.mark.parametrize("seed, percent", [(0, 80), (1, M.QUERY_PERCENT)])
def test_against_brute_force(spark, documents, seed, percent):
    rows = corpus(seed)
    assert result(M.near_duplicates(spark, documents(rows).repartition(4), percent=percent)) == brute(rows, percent)


def test_long_lists_in_blocks(spark, documents, monkeypatch):
    """One large group of near copies, whose lists are dealt out as blocks; many of its pairs are no links."""
    rng = random.Random(7)
    base = " ".join(f"w{rng.randrange(300)}" for _ in range(200))
    rows = [(i, near_copies(rng, base, rng.randint(0, 8))) for i in range(160)]
    monkeypatch.setattr(M, "LONG_LIST", 8)
    monkeypatch.setattr(M, "BLOCK", 30)
    assert result(M.near_duplicates(spark, documents(rows))) == brute(rows)


def test_a_large_group_moves_rows_in_proportion(spark, monkeypatch):
    """Rows that meet across components: near copies are one component by then, strangers beside them meet its blocks once."""
    rng = random.Random(11)
    base, other = (" ".join(f"{p}{rng.randrange(300)}" for _ in range(150)) for p in "xy")
    seen = {}
    for n in (300, 600):
        texts = [near_copies(rng, base, rng.randint(1, 3)) for _ in range(n)] + [near_copies(rng, f"{base} {other}", 2) for _ in range(90)]
        monkeypatch.setattr(M, "LONG_LIST", 16)
        monkeypatch.setattr(M, "BLOCK", 40)
        moved, real = [], M.links_across_components

        def counted(spark, long, roots, sets):
            named = long.join(roots, F.col("class") == F.col("node"), "left")
            moved.append(named.count())
            moved.append(roots.select("root").distinct().count())
            return real(spark, long, roots, sets)

        monkeypatch.setattr(M, "links_across_components", counted)
        rows = list(enumerate(texts))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert result(M.near_duplicates(spark, docs)) == brute(rows)
        monkeypatch.setattr(M, "links_across_components", real)
        seen[n] = moved
    assert seen[600][0] < 2.6 * seen[300][0] and max(seen[300][1], seen[600][1]) <= 20


def test_edges(spark, documents, cluttered):
    long = " ".join(f"t{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO\n"), (6, "one two three four five"), (7, long), (8, long + " end"), (9, "x"), (None, "x"), (10, " x"), (11, "É é")]
    want = brute(rows)
    assert result(M.near_duplicates(spark, cluttered(documents(rows)))) == want
    assert result(M.near_duplicates(spark, documents([*rows, rows[3], rows[6]]))) == sorted([*want, *[w for w in want if w[0] in (4, 7)]], key=repr)
    assert result(M.near_duplicates(spark, documents([]))) == []
    assert result(M.near_duplicates(spark, documents([(5, None), (6, "")]))) == [(5, 0, 5, True), (6, 0, 6, True)]


def test_one_of_each_group_stays(spark, documents):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (2, "something else that is here"), (4, None), (5, "")]
    assert sorted(r["doc_id"] for r in M.first_of_each(spark, documents(rows)).collect()) == [1, 2, 4, 5]


def test_signatures_estimate_similarity():
    a = M.shingles(" ".join(f"x{i}" for i in range(1000)))
    b = M.shingles(" ".join(f"x{i}" for i in range(500, 1500)))
    sa, sb = M.signatures([a, b])
    assert abs((sa == sb).mean() - len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))) < 0.3


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in C.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[1000 + i] == 1000 for i in range(1, 200)) and 5000 not in got and 0 not in got
    assert C.components(spark, spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0
