import random

from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from linkwright.functions import similarity as S

small = st.text(alphabet="abc ", max_size=12)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@given(small, small)
def test_common_subsequence(a, b):
    assert S.common_subsequence(a, b) == lcs(a, b)
    assert S.indel_distance(a, b) == len(a) + len(b) - 2 * lcs(a, b)


@given(small, small)
def test_partial_ratio(a, b):
    got = S.partial_ratio(a, b)
    if not a or not b:
        assert got == (100 if a == b else 0)
        return
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    windows = [(short, long[i:j]) for i in range(len(long)) for j in range(i + 1, len(long) + 1) if j - i <= len(short) and (j - i == len(short) or i == 0 or j == len(long))]
    if len(a) == len(b):
        windows += [(long, short[i:j]) for i in range(len(short)) for j in range(i + 1, len(short) + 1) if i == 0 or j == len(short)]
    assert abs(got - max(S.ratio(x, y) for x, y in windows)) < 1e-9


def test_edges():
    assert S.ratio("", "") == 100 and S.token_set_ratio("", "a") == 0 and S.token_set_ratio("a b", "b a c") == 100
    assert S.token_sort_ratio("b a", "a b") == 100 and S.jaro_winkler("", "") == 1 and S.jaro_winkler("a", "") == 0
    assert abs(S.jaro_winkler("martha", "marhta") - 0.9611) < 1e-4 and abs(S.jaro_winkler("dixon", "dicksonx") - 0.8133) < 1e-4
    assert S.hamming("abc", "abd") == 1


def test_columns(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 9)))) for _ in range(200)] + [(None, "a")]
    d = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.measures(F.col("a"), F.col("b"), "ratio", "tset").alias("m"), S.levenshtein_similarity(F.col("a"), F.col("b")).alias("l"))
    for r in d.collect():
        assert r["m"]["ratio"] == S.ratio(r["a"] or "", r["b"] or "") and r["m"]["tset"] == S.token_set_ratio(r["a"] or "", r["b"] or "")
