"""The linkage as file-to-file stages over Parquet, each a function and a command:

    python -m linkwright.stages STAGE [--split train|test] [--params FILE] [--set section.key=value ...]

Paths hold a hash of a stage's parameters; a stage whose result is complete is not run again. LINKWRIGHT_DATA holds
{split}/{split}_source{1,2,3}.tsv and train/train_ground_truth.tsv, LINKWRIGHT_WORK the results.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import params
from .functions import text as T
from .operators import blocking as B, consensus as C, decision as D, models as M, pair_features as P, rules as E, tfidf as W, vectors as V
from .sources import runlog, tsv, validate

DEFAULTS = {
    "sample": {"n": 250_000, "folds": 5, "seed": 13, "holdout": 150_000},
    "prune": {"k_raw": 100, "k": 30, "rounds": 20, "depth": 5},
    "pairs": {"drop_frac": 0.0},
    "model": {"folds": 5, "rounds": 20, "depth": 5},
    "shortlist": {"k": 10, "pmin": 0.005},
    "dense": {"k": 5, "k_merge": 1, "k_merge_empty": 3, "tau": 0.0},
    "expected_f": {"mu": [0.0, 0.05, 0.1, 0.2, 0.3], "shift": [-0.4, -0.2, 0.0, 0.2], "listed": 12},
    "rules": {"spec": "", "threshold": 0.5},
}


class Run:
    """One work folder with its parameters."""

    def __init__(self, spark: SparkSession, data: str, work: str, section: dict[str, dict] | None = None):
        self.spark, self.data, self.work = spark, data, work
        self.params = {k: v | (section or {}).get(k, {}) for k, v in DEFAULTS.items()}
        self.block = params.block_params((section or {}).get("block"))

    def path(self, stage: str, split: str, *own: dict) -> str:
        """A stage's folder, named by its parameters."""
        return f"{self.work}/{split}/{stage}-{runlog.params_hash({str(i): o for i, o in enumerate(own)})}" if own else f"{self.work}/{split}/{stage}"

    def done(self, path: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def kept(self, path: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """What path holds; computed and written first if it is not complete. A failed job leaves no _SUCCESS."""
        if not self.done(path):
            began = time.time()
            tsv.write_parquet(make(), path, by)
            runlog.log_stage(self.work, path, {}, {"seconds": round(time.time() - began, 2)})
        return self.spark.read.parquet(path)

    # prepare

    def source(self, split: str, number: int) -> DataFrame:
        raw = lambda: T.normalise(tsv.numbered(tsv.read(self.spark, f"{self.data}/{split}/{split}_source{number}.tsv")))
        return self.kept(self.path(f"source{number}", split), raw, "rid")

    def queries(self, split: str) -> DataFrame:
        return self.source(split, 1).withColumn("q", F.col("rid"))

    def pool(self, split: str) -> DataFrame:
        return tsv.pool_of({2: self.source(split, 2), 3: self.source(split, 3)})

    def truth(self, split: str = "train") -> DataFrame:
        """(q, src, pid, ctry). Every id of the ground truth must resolve."""

        def make() -> DataFrame:
            raw = tsv.read(self.spark, f"{self.data}/{split}/{split}_ground_truth.tsv", tsv.TRUTH)
            labels = tsv.labels(raw, {2: self.source(split, 2), 3: self.source(split, 3)}, self.source(split, 1))
            if labels.where("s1_rid IS NULL OR src IS NULL OR other_rid IS NULL").limit(1).count():
                raise ValueError("the ground truth names records that no source holds")
            return labels.select(F.col("s1_rid").alias("q"), "src", (F.col("src") * params.PID_BASE + F.col("other_rid")).alias("pid"))

        return self.kept(self.path("labels", split), make).join(self.queries(split).select("q", "ctry"), "q")

    def universe(self, split: str = "train") -> DataFrame:
        n = self.truth(split).groupBy("q").agg(F.count("*").alias("n_true"))
        return self.queries(split).select("q").join(n, "q", "left").na.fill(0, ["n_true"])

    def splits(self, split: str = "train") -> DataFrame:
        """(q, part, fold): a locked holdout and a training sample, disjoint and settled by hashes."""
        p = self.params["sample"]
        u = self.universe(split)
        hold = D.holdout(u, p["holdout"] if p["holdout"] >= 1 else int(p["holdout"] * u.count()), p["seed"])
        rest = u.join(hold, "q", "left_anti")
        train = D.holdout(rest, p["n"], p["seed"] + 1)
        return hold.withColumn("part", F.lit("holdout")).union(train.withColumn("part", F.lit("train"))).withColumn("fold", D.fold_hash(F.col("q"), p["folds"]))

    # candidates

    def candidates(self, split: str) -> DataFrame:
        # the pool's index is stored by token, so that a token's postings lie together
        keep = lambda name, df: self.kept(self.path(f"index-{name}", split, asdict(self.block)), lambda: df, "tok" if "tok" in df.columns else None)
        return self.kept(self.path("candidates", split, asdict(self.block)), lambda: B.block(self.queries(split), self.pool(split), self.block, keep), "q")

    def report(self, split: str = "train") -> dict:
        """Recall of the candidates, by country and source, by token type, and why pairs are missed."""
        c, t = self.candidates(split), self.truth(split)
        found = B.found_pairs(t, c)
        out = {"recall": B.recall(found, c, self.queries(split)).first().asDict()}
        for name, d in (("country", B.recall_by(found, "ctry")), ("source", B.recall_by(found, "src")), ("type", B.coverage(found)), ("missed", B.miss_breakdown(found, B.diagnose(t, self.queries(split), self.pool(split), self.block), self.block.cap_df))):
            out[name] = [r.asDict() for r in d.collect()]
        return out

    def with_neighbours(self, split: str, candidates: DataFrame) -> DataFrame:
        """Candidates with the nearest records by hashed trigrams of name and address; records without address may add more."""
        p = self.params["dense"]
        encode = V.hashed_encoder()
        text = F.concat_ws(" | ", "name1", "addr")
        near = lambda: V.top_k(self.queries(split).select("q", encode(text).alias("v")), self.pool(split).select("pid", encode(text).alias("v")), p["k"])
        pairs = self.kept(self.path("neighbours", split, p), near)
        return V.merge(candidates, pairs, p["k_merge"], p["tau"], "dall", self.pool(split).where("addr = ''").select("pid"), p["k_merge_empty"])

    def pruned(self, split: str) -> DataFrame:
        """The best candidates by a model of the block features alone, fitted on the training sample without its fold 0."""
        p = self.params["prune"]
        d = B.local_features(self.candidates("train"))
        label = self.truth().select("q", "pid", F.lit(1).alias("label"))
        fit = d.join(self.splits().where("part = 'train' AND fold > 0").select("q"), "q", "left_semi").join(label, ["q", "pid"], "left").na.fill(0, ["label"])
        model, columns = M.fit(fit, rounds=p["rounds"], depth=p["depth"])
        c = B.local_features(self.candidates(split))
        return self.kept(self.path("pruned", split, p, asdict(self.block)), lambda: M.prune(self.candidates(split), M.predict(model, columns, c), p["k"]), "q")

    # features and scores

    def features(self, split: str) -> DataFrame:
        """All first-stage features of each candidate. Competition is measured over all queries of the universe."""

        def make() -> DataFrame:
            c = self.with_neighbours(split, self.candidates(split))
            if drop := self.params["pairs"]["drop_frac"]:  # a thinner universe, like that of the other split
                c = c.where(F.pmod(F.xxhash64("q", F.lit(5)), F.lit(10_000)) >= int(drop * 10_000))
            d = P.side_by_side(B.competition_features(c), self.queries(split), self.pool(split))
            d = P.string_features(d, self.queries(split), self.pool(split))
            text = [f"{s}_{x}" for s in "ab" for x in ("core", "name2", "addr", "legal", "ctry", "nl_name", "nl_addr", "core_rom", "addr_rom")]
            d = d.drop(*text)
            if split == "train":
                d = d.join(self.truth().select("q", "pid", F.lit(1).alias("label")), ["q", "pid"], "left").na.fill(0, ["label"])
            return d

        return self.kept(self.path("features", split, self.params["pairs"], self.params["dense"], asdict(self.block)), make, "q")

    def _fitted(self, name: str, pairs: DataFrame) -> tuple[GBTClassificationModel, list[str]]:
        p = self.params["model"]
        path = self.path(f"model-{name}", "train", p)
        if self.done(f"{path}/gbt/metadata"):
            return GBTClassificationModel.load(f"{path}/gbt"), self.spark.read.json(f"{path}/config").first()["features"]
        model, columns = M.fit(pairs, rounds=p["rounds"], depth=p["depth"], held=p.get("held", 0))
        model.write().overwrite().save(f"{path}/gbt")
        self.spark.createDataFrame([(columns,)], "features array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/config")
        return model, columns

    def scored(self, split: str, stage: str = "first", features: DataFrame | None = None) -> DataFrame:
        """(q, pid, p[, label]): out-of-fold scores of the training sample, the model's scores of everything else."""
        d = self.features(split) if features is None else features
        fit = self.features("train") if features is None or split == "test" and stage == "first" else features
        p = self.params["model"]

        def make() -> DataFrame:
            train = (fit if stage == "first" else self.stacked("train")).join(self.splits().where("part = 'train'").select("q"), "q", "left_semi")
            model, columns = self._fitted(stage, train)
            if split != "train":
                return M.predict(model, columns, d).select("q", "pid", "p")
            own = M.out_of_fold(train, p["folds"], p["rounds"], p["depth"], p.get("held", 0)).select("q", "pid", "p", "label")
            rest = M.predict(model, columns, d.join(self.splits().where("part = 'train'").select("q"), "q", "left_anti")).select("q", "pid", "p", "label")
            return own.unionByName(rest)

        return self.kept(self.path(f"scored-{stage}", split, p), make, "q")

    def stacked(self, split: str) -> DataFrame:
        """Shortlisted pairs with their first score and what it says about the query's and the record's other pairs."""

        def make() -> DataFrame:
            s = D.shortlist(self.scored(split), self.params["shortlist"]["k"], self.params["shortlist"]["pmin"])
            q, b = self.queries(split), self.pool(split)
            text = s.select("q", "pid", "p").join(q.select("q", F.col("core1").alias("a_core"), F.col("addr").alias("a_addr")), "q").join(b.select("pid", F.col("core1").alias("b_core"), F.col("addr").alias("b_addr")), "pid")
            n = lambda d, key, name: C.address_multiplicity(d.select(key, "addr")).select(key, F.col("addr_n").alias(name))
            blocks = [
                C.record_competition(C.entity_consensus(s)), C.digit_relations(text).drop("p", "a_addr", "b_addr"), P.decoy_features(text).drop("p", "a_core", "b_core", "a_addr", "b_addr"),
                C.address_group_features(text.select("q", "pid", "a_addr", "b_addr").join(n(q, "q", "a_addr_n"), "q").join(n(b, "pid", "b_addr_n"), "pid")).drop("a_addr", "b_addr"),
                W.cosine(s.select("q", "pid"), q, b, W.char_terms(F.col("core1")), "tf_name_cos"), W.cosine(s.select("q", "pid"), q, b, W.word_terms(F.col("addr")), "tf_addr_cos"),
                W.language_free(s, q, b), C.consensus_text(text), self.features(split).drop("label"),
            ]
            d = blocks[0].withColumnRenamed("p", "p_first")
            for x in blocks[1:]:
                d = d.join(x.drop(*(c for c in x.columns if c in d.columns and c not in ("q", "pid"))), ["q", "pid"])
            return d

        path = self.path("stacked", split, self.params["shortlist"], self.params["model"])
        d = self.kept(path, make, "q")
        if (n := d.count()) != (m := D.shortlist(self.scored(split), self.params["shortlist"]["k"], self.params["shortlist"]["pmin"]).count()):
            raise ValueError(f"{m} shortlisted pairs, but features of {n}")
        return d

    # decisions

    def threshold(self, scored: DataFrame | None = None) -> float:
        """The threshold of the best macro F of owned pairs over the training sample's out-of-fold scores."""
        part = self.splits().where("part = 'train'").select("q")
        s = (self.scored("train", "stack", self.stacked("train")) if scored is None else scored).join(part, "q", "left_semi")
        grid = [round(0.10 + 0.01 * i, 2) for i in range(86)]
        return D.best_threshold(D.threshold_sweep(s, self.universe().join(part, "q", "left_semi"), grid)).first()["threshold"]

    def tuned_expected_f(self, scored: DataFrame) -> tuple[float, float, float]:
        """(mu, shift, macro F): the best Poisson mean of unlisted matches and logit shift over a grid, for calibrated owned scores."""
        p = self.params["expected_f"]
        own = D.assign_exclusive(M.apply_isotonic(scored, M.fit_isotonic(scored)))
        best = (0.0, 0.0, -1.0)
        for shift in p["shift"]:
            moved = own.withColumn("p", D.sigmoid(D.logit(F.col("p")) + shift))
            for mu in p["mu"]:
                f = D.macro_f(M.select_expected(moved, mu, p["listed"]), self.universe()).first()["macro_f"]
                best = max(best, (mu, shift, f), key=lambda x: x[2])
        return best

    def holdout_report(self, scored: DataFrame, threshold: float) -> dict:
        """Macro F and its interval over the locked holdout."""
        part = self.splits().where("part = 'holdout'").select("q")
        own = D.assign_exclusive(scored).where(F.col("p") >= threshold).join(part, "q", "left_semi")
        return D.bootstrap(D.entity_f(own, self.universe().join(part, "q", "left_semi")), "f").first().asDict()

    def decoded(self, split: str, scored: DataFrame, threshold: float) -> DataFrame:
        """Scores after the rules of the parameters, if there are any."""
        if not (spec := self.params["rules"]["spec"]):
            return scored
        from .functions import relations as R

        q, b = self.queries(split), self.pool(split)
        f = self.features(split).select("q", "pid", "name_tset", "addr_tset", "house_eq", "legal_conflict")
        f = f.join(q.select("q", F.col("core1").alias("a_core"), T.legal_set(F.col("name1"), F.col("legal")).alias("a_forms")), "q").join(b.select("pid", F.col("core1").alias("b_core"), F.col("name1").alias("b_name"), F.col("name2").alias("b_alias"), T.legal_set(F.col("name1"), F.col("legal")).alias("b_forms")), "pid")
        df = R.word_frequency(q)
        f = R.name_relation(R.with_protection(R.swap_flag(f, df)))
        f = f.withColumn("core_eq", F.col("a_core") == F.col("b_core")).withColumn("src", D.source()).join(C.address_multiplicity(q.select("q", "addr")).select("q", "addr_n"), "q")
        own = D.assign_exclusive(scored.select("q", "pid", "p")).where(F.col("p") >= threshold).join(f, ["q", "pid"])
        exact = own.where(F.col("core_eq") & (F.col("p") >= 0.999)).groupBy("q").agg(F.count("*").alias("n_exact"))
        f = f.join(exact, "q", "left").na.fill(0, ["n_exact"])
        words = E.Vocabulary(E.learn_vocabulary(own, E.slots(own, q)), df)
        return E.decode(scored, f, spec, threshold, words=words)

    def emit(self, split: str, scored: DataFrame, candidates: DataFrame, threshold: float, name: str = "final") -> dict:
        """Write match and candidate lists of all entities, and check them."""
        own = D.assign_exclusive(scored).where(F.col("p") >= threshold)
        one, pool = self.queries(split).select("q", "entity_id"), self.pool(split).select("pid", "entity_id")
        folder = f"{self.work}/output/{name}"
        m, c = tsv.lists_of_pairs(own, one, pool, "matched_entity_ids"), tsv.lists_of_pairs(candidates, one, pool, "candidate_entity_ids")
        tsv.write(m, f"{folder}/matching_results")
        tsv.write(c, f"{folder}/candidate_pairs")
        issues = validate.validate(m.withColumnRenamed("matched_entity_ids", "matched"), c.withColumnRenamed("candidate_entity_ids", "candidates"), one, pool)
        return {"threshold": threshold, "issues": {r["issue"]: r["n"] for r in issues.where("n > 0").collect()}}


def final(run: Run, split: str) -> dict:
    """The whole linkage of a split: lists written, threshold and issues returned."""
    threshold = run.threshold()
    scored = run.scored(split, "stack", run.stacked(split))
    return run.emit(split, run.decoded(split, scored, threshold), run.stacked(split).select("q", "pid"), threshold)


STAGES: dict[str, Callable[[Run, str], object]] = {
    "prepare": lambda r, s: [r.source(s, i).count() for i in (1, 2, 3)],
    "block": lambda r, s: r.candidates(s).count(),
    "block_eval": lambda r, s: r.report(s),
    "prune": lambda r, s: r.pruned(s).count(),
    "pairs": lambda r, s: r.features(s).count(),
    "score": lambda r, s: r.scored(s).count(),
    "stack": lambda r, s: r.stacked(s).count(),
    "holdout": lambda r, s: r.holdout_report(r.scored("train", "stack", r.stacked("train")), r.threshold()),
    "expected_f": lambda r, s: r.tuned_expected_f(r.scored("train", "stack", r.stacked("train"))),
    "emit": final,
}


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="linkwright.stages")
    ap.add_argument("stage", choices=sorted(STAGES))
    ap.add_argument("--split", default="train")
    ap.add_argument("--params")
    ap.add_argument("--set", nargs="*", default=[])
    a = ap.parse_args(argv)
    section = params.load(a.params)
    for item in a.set:
        key, value = item.split("=", 1)
        name, option = key.split(".", 1)
        section.setdefault(name, {})[option] = json.loads(value)
    at = params.paths()
    spark = SparkSession.builder.appName(f"linkwright-{a.stage}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(json.dumps(STAGES[a.stage](Run(spark, at["data"], at["work"], section), a.split), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
