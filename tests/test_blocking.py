"""Candidates in rounds over posting lists against all shared tokens at once."""

from pyspark.sql import functions as F

from linkwright.operators import blocking as B
from linkwright.params import BlockParams

WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz".split()


def records(spark, n, key, step):
    row = lambda i: (i, " ".join(WORDS[(i * step + j * j) % 13] for j in range(3)), "", " ".join([WORDS[(i + j * step) % 13] for j in range(4)] + [str(i % 7)]))
    return spark.createDataFrame([row(i) for i in range(n)], f"{key} long, core1 string, name2 string, addr string")


def test_rounds_find_what_one_pass_finds(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(B, "PAIRS_A_QUERY", 40)
    qry, pool, prm = records(spark, 60, "q", 3), records(spark, 90, "pid", 5), BlockParams(k=5)
    stored = {}

    def keep(name, df):
        df.write.parquet(f"{tmp_path}/{name}")
        stored[name] = spark.read.parquet(f"{tmp_path}/{name}")
        return stored[name]

    got = B.block(qry, pool, prm, keep)
    rounds = [d for name, d in stored.items() if name.startswith("best")]
    assert len(rounds) > 1
    assert sum(d.select("q").distinct().count() for d in rounds) == got.select("q").distinct().count() == 60
    postings, base_df, df = B.pool_index(pool, prm)
    every = B.score(B.shared_tokens(B.query_tokens(qry, base_df, df, pool.count(), prm), postings))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, B.top_k(every, prm.k).collect()))
    # a list for each token that a query asks for, and no second copy of the base tokens
    assert stored["lists"].agg(F.max(F.size("pids"))).first()[0] <= prm.cap_df
    assert stored["lists"].count() == stored["qtok"].select("tok").distinct().count()
    assert stored["pairs"].where("typ IN ('n', 'a', 'p')").count() == 0


def test_common_words_rank_as_in_one_exchange(spark, monkeypatch):
    """Words over the cap, with and without digits, all or some of them sent to the tasks."""
    pool = records(spark, 90, "pid", 5)
    rows = {}
    for cap, most in ((800, 20_000), (12, 20_000), (12, 3), (0, 20_000)):
        monkeypatch.setattr(B, "MOST_FREQUENT", most)
        prm = BlockParams(cap_df=cap)
        base = B.base_tokens(pool, "pid", prm)
        rows[cap, most] = sorted(map(tuple, B.composites(base, B.document_frequency(B.tagged(base)), prm).collect()))
    assert rows[800, 20_000] and all(r == rows[800, 20_000] for r in rows.values())
