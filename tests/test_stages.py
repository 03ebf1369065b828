"""The whole linkage over a small synthetic corpus, from raw files to checked lists."""

from pathlib import Path

import pytest

from linkwright import stages
from linkwright.sources import synth, tsv


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("linkage")
    for split, n, seed in (("train", 150, 0), ("test", 60, 9)):
        sources, truth = synth.make(spark, n, ("US", "India") if split == "train" else ("US", "India", "France"), seed)
        for i, d in sources.items():
            tsv.write(d.coalesce(1), f"{root}/data/{split}/{split}_source{i}.tsv")
        tsv.write(truth.coalesce(1), f"{root}/data/{split}/{split}_ground_truth.tsv")
    section = {"sample": {"n": 90, "holdout": 50}, "model": {"folds": 2, "rounds": 3, "depth": 3}, "prune": {"rounds": 2, "depth": 3}, "rules": {"spec": "legalx:1.01,thrpn:0.3,protect:0.2,cap"}, "expected_f": {"mu": [0.1], "shift": [0.0]}}
    return stages.Run(spark, f"{root}/data", f"{root}/work", section)


def test_candidates_and_report(run):
    report = run.report()
    assert report["recall"]["found_pairs"] / report["recall"]["true_pairs"] > 0.9 and len(report["country"]) == 2
    parts = run.splits().groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"holdout": 50, "train": 90}
    assert run.pruned("train").groupBy("q").count().agg({"count": "max"}).first()[0] <= 30


def test_linkage_of_both_splits(run):
    out = stages.final(run, "test")
    assert out["issues"] == {} and 0.1 <= out["threshold"] <= 0.95
    lists = tsv.read_lines(run.spark, f"{run.work}/output/final/matching_results")
    assert lists.count() == 60 and lists.where("rest <> ''").count() > 20
    scored = run.scored("train", "stack", run.stacked("train"))
    holdout = run.holdout_report(scored, run.threshold())
    assert holdout["lo"] <= holdout["mean"] <= holdout["hi"] and holdout["mean"] > 0.5
    assert run.tuned_expected_f(scored)[2] > 0.5


def test_finished_stages_do_not_run_again(run):
    path = run.path("source1", "train")
    before = max(f.stat().st_mtime_ns for f in Path(path).iterdir())
    run.source("train", 1).count()
    assert max(f.stat().st_mtime_ns for f in Path(path).iterdir()) == before
