import hashlib
import random
from collections import defaultdict

import pytest

from linkwright.llm import line_dedup as L

LONG = "This is a line that is clearly longer than forty characters."


def brute(rows, min_chars=40, min_docs=5):
    """(doc_id, n_lines, n_dropped, sha) of rows by a plain reading of the rules."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(fold)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= min_docs and i != max((d for d in holders[key(x)] if d is not None), default=None))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect()), key=repr)


def random_rows(seed, docs=300):
    rng = random.Random(seed)
    pool = [f"{'Line' if k % 2 else 'LINE'} number {k:03d} of the pool, made long enough to count {k}" for k in range(60)]
    rows = []
    for i in range(docs):
        lines = [rng.choice(pool[: 1 + rng.randint(0, 59)]) if rng.random() < 0.6 else f"own {rng.random()}" for _ in range(rng.randint(0, 8))]
        lines = [f" {x}\t" if rng.random() < 0.3 else x.upper() if rng.random() < 0.3 else x for x in lines]
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, documents, seed):
    rows = random_rows(seed)
    assert result(L.digests(spark, documents(rows).repartition(5))) == brute(rows)


def test_hot_line_over_many_partitions(spark, documents):
    rows = [(i, f"{LONG}\nown text {i}\n{LONG if i % 3 == 0 else ''}") for i in range(2000)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert result(L.digests(spark, documents(rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_edges(spark, documents, cluttered):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, f"{LONG}\nx"), (4, "short"), (5, "é" * 40), *((10 + i, f"{LONG}\r\n{'é' * 40}\nend") for i in range(5)), (14, f"{LONG}\nanother text with the same id"), (99, "word " * 60_000 + "\n" + LONG)]
    want = brute(rows)
    assert result(L.digests(spark, cluttered(documents(rows)))) == want
    assert sum(r[2] for r in want) > 5
    assert result(L.digests(spark, documents(rows + rows))) == sorted(want + want, key=repr)
    assert result(L.digests(spark, documents([]))) == []


def test_texts_come_back_without_the_lines(spark, documents):
    rows = [(i, f"{LONG}\nown {i}") for i in range(6)]
    out = {r["doc_id"]: r for r in L.dedup_lines(spark, documents(rows)).collect()}
    assert out[0]["text"] == "own 0" and out[0]["n_chars"] == 5 and out[5]["text"] == rows[5][1] and out[0]["lang"] == "en"


def test_bitmaps_are_small(spark, documents):
    rows = [(i, "\n".join([LONG] * 400 + [f"own {i}"])) for i in range(5)]
    maps = L.keep_bitmaps(spark, documents(rows)).collect()
    assert len(maps) == 4 and all(len(m["keep"]) < 30 and m["n_dropped"] == 400 for m in maps)
    assert L.kept_lines(rows[0][1], maps[0]["keep"])[0] == [rows[0][1].split("\n")[-1]]
