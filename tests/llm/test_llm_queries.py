"""The registered queries against their DuckDB SQL, and the pipeline against a plain Python version."""

import os
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from linkwright.llm import minhash, pii, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_all_ten_are_registered():
    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 11)) and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "pii", "packing"]


def test_pipeline_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    at_least = model.scorer()
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if not model.thresholds or at_least(t)[0] < toxicity.REJECT}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(fold)
    holders = defaultdict(set)
    for i, t in rows.items():
        for x in t.split("\n"):
            holders[key(x)].add(i)
    rows = {i: "\n".join(x for x in t.split("\n") if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and i != max(holders[key(x)]))) for i, t in rows.items()}
    sets = {i: set(minhash.shingles(t).tolist()) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in rows:
        for j in rows:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    rows = {i: t for i, t in rows.items() if find(i) == i}
    clean = pii.with_surrogates(spark, spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert any(r["text"] != rows[r["doc_id"]] for r in clean)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r["doc_id"], len(t.encode(r["text"], add_special_tokens=False).ids) + 1) for r in clean)
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] += r["length"]
    assert sorted(got.items()) == want


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "word " * 60_000 + "mail a@b.com"), (5, "Mr John Smith called +1 555 234 5678"), (5, "Mr John Smith called +1 555 234 5678"), (6, "Mr John Smith called +1 555 234 5678"), (None, None),
    (None, "a text without an id that is long enough for a line of its own"), (5, "another text of the same id"), *((20 + i, "a passage that stands in many documents, over forty signs\n" + f"own {i}") for i in range(8)),
]


def test_stages_take_awkward_rows_and_names(spark, documents, cluttered):
    """Nulls, empty and long texts, repeated rows and ids, an empty table, and columns with the stages' own names."""
    docs = cluttered(documents(AWKWARD))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == {i for i, _ in AWKWARD} and sum(r["length"] == 1 for r in rows) == 4
            continue
        assert out.columns == names and all(r["_found"] == r["_doc"] == r["_maps"] == r["_gone"] == "clash" for r in rows)
        texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in rows)
        if name == "toxicity":
            assert len(rows) == len(AWKWARD)
        if name == "line dedup":
            assert len(rows) == len(AWKWARD) and sum("a passage" in t for _, t in texts) == 1 and all(r["n_chars"] == len(r["text"]) for r in rows if r["text"])
        if name == "near dedup":
            assert sum(t.startswith("Mr John") for _, t in texts) == 2 and sum(t == "" for _, t in texts) == 3
        if name == "pii":
            assert len(rows) == len(AWKWARD) and len({t for _, t in texts if t.startswith("Mr ")}) == 1 and not any("Smith" in t or "a@b.com" in t for _, t in texts)


@pytest.mark.parametrize("k", range(5))
def test_stages_of_nothing(spark, documents, k):
    assert corpus_pipeline.STAGES[k][1](spark, documents([]), SF).collect() == []


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
