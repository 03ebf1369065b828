from pathlib import Path

from pyspark.sql import functions as F

from linkwright.functions import text as T
from linkwright.operators import blocking as B, decision as D, vectors as V
from linkwright.sources import runlog, synth, tsv, validate
from linkwright import params


def test_tsv_round_trip(spark, tmp_path):
    raw = tmp_path / "in.tsv"
    raw.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Quoted\t12 "x" st\tUS\nS1-2\t\t\tIndia\n', encoding="utf-8")
    d = tsv.read(spark, str(raw))
    assert [tuple(r) for r in d.orderBy("entity_id").collect()] == [("S1-1", '"Quoted', '12 "x" st', "US"), ("S1-2", "", "", "India")]
    tsv.write(spark.createDataFrame([("S1-1", "a,b"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string").coalesce(1), str(tmp_path / "out"))
    part = next(Path(tmp_path / "out").glob("part-*"))
    assert part.read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\ta,b\nS1-2\t\n"
    lines = tsv.read_lines(spark, str(tmp_path / "out")).orderBy("key").collect()
    assert [(r["key"], r["rest"]) for r in lines] == [("S1-1", "a,b"), ("S1-2", "")]
    assert validate.format_issues(spark, str(tmp_path / "out"), "source1_entity_id\tmatched_entity_ids", "m").collect() == []
    raw.write_text('﻿wrong\nS1-1\t"a"\r\nS1-2\n', encoding="utf-8")
    assert {r["issue"] for r in validate.format_issues(spark, str(raw), "source1_entity_id\tmatched_entity_ids", "m").collect()} == {"m: byte order mark", "m: carriage return", "m: not one tab", "m: quote", "m: header"}


def test_numbers_are_dense(spark):
    d = spark.createDataFrame([(f"e{i:04d}",) for i in range(500)], "entity_id string").repartition(7)
    rows = tsv.numbered(d).orderBy("rid").collect()
    assert [r["rid"] for r in rows] == list(range(500)) and [r["entity_id"] for r in rows] == [f"e{i:04d}" for i in range(500)]


def test_validation_finds_each_fault(spark):
    ids = spark.createDataFrame([("A",), ("B",), ("C",)], "entity_id string")
    known = spark.createDataFrame([("x",), ("y",), ("A",)], "entity_id string")
    m = spark.createDataFrame([("A", "x,x"), ("A", "y"), ("B", "x,zz,B"), ("D", "")], "source1_entity_id string, matched string")
    c = spark.createDataFrame([("A", "x,y"), ("B", "x"), ("C", "")], "source1_entity_id string, candidates string")
    n = {r["issue"]: r["n"] for r in validate.validate(m, c, ids, known).collect()}
    assert n["matched: entity with several rows"] == 1 and n["matched: entity without a row"] == 1 and n["matched: row of an unknown entity"] == 1 and n["matched: row that repeats an id"] == 1
    assert n["matched: unknown id"] == 2 and n["matched: entity matched with itself"] == 1 and n["matched but no candidate"] == 2 and n["record with several owners"] == 1
    assert not any(v for k, v in n.items() if k.startswith("candidates"))


def test_linkage_end_to_end(spark, tmp_path):
    sources, truth = synth.make(spark, 200)
    sources = {s: T.normalise(tsv.numbered(d)).cache() for s, d in sources.items()}
    labels = tsv.labels(truth, {2: sources[2], 3: sources[3]}, sources[1])
    assert labels.where("s1_rid IS NULL OR src IS NULL OR other_rid IS NULL").count() == 0
    queries, pool = sources[1].withColumn("q", F.col("rid")), tsv.pool_of({2: sources[2], 3: sources[3]})
    found = B.block(queries, pool).cache()
    assert found.groupBy("q").count().agg(F.max("count")).first()[0] <= 30
    true = labels.select(F.col("s1_rid").alias("q"), (F.col("src") * params.PID_BASE + F.col("other_rid")).alias("pid"), F.lit(1).alias("label"))
    assert true.join(found, ["q", "pid"]).count() / true.count() > 0.9
    scored = found.join(true, ["q", "pid"], "left").select("q", "pid", (F.col("score") / 1e8).alias("p"), F.coalesce("label", F.lit(0)).alias("label"))
    own = D.assign_exclusive(scored)
    n = queries.select("q").join(true.groupBy("q").agg(F.count("*").alias("n_true")), "q", "left").na.fill(0)
    assert D.best_threshold(D.threshold_sweep(scored, n, [0.1, 0.2, 0.3, 0.4])).first()["macro_f"] > 0.5
    one = queries.select("q", "entity_id")
    m, c = tsv.lists_of_pairs(own, one, pool, "matched"), tsv.lists_of_pairs(scored, one, pool, "candidates")
    assert m.count() == 200
    issues = validate.validate(m, c, one, pool)
    assert issues.where("n > 0").count() == 0
    back = tsv.pairs_of_lists(m, "matched", one, pool)
    assert back.exceptAll(own.select("q", "pid")).count() == 0 and back.count() == own.count()


def test_nearest_neighbours_and_merge(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    q = rng.standard_normal((40, 16))
    p = [q[i] + 0.01 * rng.standard_normal(16) for i in (3, 7, 11)]
    qs = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(q)], "q long, v array<double>")
    ps = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "pid long, v array<double>")
    for slice_rows in (200_000, 15):
        near = V.top_k(qs, ps, 3, slice_rows).cache()
        assert [r["q"] for r in near.where("rank = 0").orderBy("pid").collect()] == [103, 107, 111]
        assert near.count() == 9
    c = spark.createDataFrame([(103, 0, 5, 1), (1, 1, 4, 1)], "q long, pid long, score long, ns long")
    once = V.merge(c, near, 1, 0.0, "emb")
    twice = V.merge(once, near, 1, 0.0, "emb")
    assert once.count() == 4 and once.exceptAll(twice).count() == 0 and twice.count() == 4
    assert once.where("q = 107").first()["score"] == 0
    wide = V.merge(c, near, 1, 0.0, "emb", spark.createDataFrame([(2,)], "pid long"), 3)
    assert wide.where("pid = 2").count() == 3


def test_run_log(tmp_path):
    assert runlog.log_stage(str(tmp_path), "block", {"k": 30}, {"recall": 0.9}) and (tmp_path / "runs.jsonl").read_text().count("\n") == 1
    (tmp_path / "file").write_text("")
    assert not runlog.log_stage(str(tmp_path / "file"), "x", {}, {})
    assert runlog.params_hash({"a": 1, "b": 2}) == runlog.params_hash({"b": 2, "a": 1})


def test_parameters(tmp_path, monkeypatch):
    (tmp_path / "p.yaml").write_text("block:\n  k: 7\n")
    monkeypatch.setenv("LINKWRIGHT_PARAMS", str(tmp_path / "p.yaml"))
    assert params.block_params(params.load()["block"]).k == 7 and params.block_params().cap_df == 800
