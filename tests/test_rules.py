import pytest
from pyspark.sql import functions as F

from linkwright.functions import relations as R
from linkwright.operators import augment as A, rules as E


def test_unknown_rule():
    with pytest.raises(ValueError, match="unknown rule"):
        E.parse("thr:0.5,nosuch:1")


def owned(spark, rows):
    return spark.createDataFrame(rows, "q long, pid long, src long, p double, a_core string, b_core string, b_alias string")


def test_protect_keeps_the_best_soft_drop(spark):
    rows = [(1, 20_000_001, 2, 0.8, "a b", "a c", ""), (1, 20_000_002, 2, 0.7, "a b", "a d", ""), (2, 20_000_003, 2, 0.99, "a b", "a b", ""), (2, 20_000_004, 2, 0.8, "a b", "a e", "")]
    d = R.with_protection(owned(spark, rows))
    judged = E.protect(E.fired(d, E.parse("thrp:0.95")), 0.75)
    assert {r["pid"]: r["dropped"] for r in judged.collect()} == {20_000_001: False, 20_000_002: True, 20_000_003: False, 20_000_004: True}


def test_alias_is_never_dropped(spark):
    d = owned(spark, [(1, 20_000_001, 2, 0.3, "rays office", "arcbrixx", "the rays office")])
    assert not E.fired(d, E.parse("thr:0.9")).first()["dropped"]


def test_restore_fills_free_slots_only(spark):
    pairs = spark.createDataFrame([(1, 20_000_000 + i, 0.9 - i / 100) for i in range(4)] + [(1, 20_000_010, 0.2), (1, 20_000_011, 0.3), (2, 20_000_011, 0.25)], "q long, pid long, p double")
    names = spark.createDataFrame([(q, p, "alpha", "alpha", 1, 95.0) for q, p in ((1, 20_000_010), (1, 20_000_011), (2, 20_000_011))], "q long, pid long, a_core string, b_core string, house_eq int, addr_tset double")
    out = {(r["q"], r["pid"]): r["p"] for r in E.restore(pairs, 0.5, ["exact"], 0.1, names).collect()}
    assert out[1, 20_000_011] > 0.5 and out[1, 20_000_010] == 0.2 and out[2, 20_000_011] == 0.25


def test_every_rule_is_a_column(spark):
    d = R.with_protection(owned(spark, [(1, 20_000_001, 2, 0.3, "alpha club", "alpha ecole", "")]))
    extra = {"swap": F.lit(True), "n_exact": F.lit(1), "xa": F.lit("club"), "xb": F.lit("ecole"), "name_tset": F.lit(50.0), "addr_tset": F.lit(95.0), "house_eq": F.lit(1), "addr_n": F.lit(2), "legal_conflict": F.lit(1), "core_eq": F.lit(False), "kind": F.lit("one_swap"), "glue": F.lit(0.1), "list_x": F.lit(True), "score_m": F.lit(0.1), "a_forms": F.array(F.lit("sas")), "b_forms": F.array(F.lit("sarl"))}
    d = d.withColumns(extra)
    spec = "swap_exact,swap_all:0.9,swapn,weak:60:0.9:shared,droplist:x,legalx:0.9,legal:0.9,legalhouse:0.9,thr:0.9,thrp:0.9,thrpn:0.9:0.1,thrpk:0.9:alias,thrx:0.9,exactfar:0.9:99,kind:one_swap:2:0.9,typeswap:1.01,typeconf:1.01,typeins:1.01,xfr:m:0.5,tiny:0.9"
    words = E.Vocabulary(spark.createDataFrame([("ecole", 200, 10, 0.9), ("club", 200, 10, 0.9)], "w string, n_full int, n_empty int, ratio double"))
    assert set(E.fired(d, E.parse(spec), words).first()["fired"]) == set(E.RULES) - {"legalhouse", "exactfar", "tiny", "typeins"}


def test_swapped_words_have_to_be_common(spark):
    rows = [(1, "club", "ecole", True), (2, "club", "rare", True), (3, "rare", "ecole", True), (4, "club", "ecole", False), (5, "ste", "ecole", True), (6, None, None, False), (7, "club", "fils", True)]
    d = spark.createDataFrame(rows, "pid long, xa string, xb string, swap boolean").withColumns({"q": F.lit(1), "p": F.lit(0.4), "a_core": F.lit("a"), "b_core": F.lit("b")})
    rates = spark.createDataFrame([(w, 200, 10, 0.9) for w in ("ecole", "rare", "fils")], "w string, n_full int, n_empty int, ratio double")
    frequency = spark.createDataFrame([("club", 60), ("ecole", 50), ("rare", 49), ("ste", 90), ("fils", 90)], "w string, df int")
    got = E.fired(d, E.parse("typeswap:0.9:0.75:100:50"), E.Vocabulary(rates, frequency))
    assert {r["pid"] for r in got.where("dropped").collect()} == {1} and got.count() == 7 and set(got.columns) == {*d.columns, "fired", "dropped"}
    assert E.fired(d, E.parse("typeswap:0.9:0.75:100:50"), E.Vocabulary(rates)).where("dropped").count() == 0


def test_relations(spark):
    rows = [("lille club", "lille club", "exact"), ("dupont sa", "dupont s a", "glued"), ("dupont", "dupont s a", "spelled_legal"), ("lille club", "lc", "initials"), ("lille club", "lilleclub", "glued"), ("alpha club", "alpha groupe", "noise_swap"), ("alpha", "alpha et fils", "noise_extra"), ("alpha", "beta", "other")]
    d = spark.createDataFrame(rows, "a_core string, b_core string, want string")
    assert all(r["want"] == r["k"] for r in d.withColumn("k", R.restore_kind()).collect())
    d = d.withColumn("b_name", F.col("b_core")).withColumn("is_domain", F.lit(False)).withColumn("has_alias", F.lit(False))
    assert {r["kind"] for r in R.name_relation(d).collect()} >= {"reordered", "no_common_word", "glued_fuzzy"}
    cells = R.cell_kind(d, spark.createDataFrame([("alpha",)], "w string")).collect()
    assert {r["kind"] for r in cells} >= {"exact", "glued", "noise_swap"}


def test_streets(spark):
    d = spark.createDataFrame([(["elm"], ["elm", "oak"]), (["elmwood"], ["elmwod"]), (["elm"], ["oak"]), ([], ["oak"]), (None, None)], "a_street array<string>, b_street array<string>")
    assert [r["st"] for r in R.street_relation(d).collect()] == [0, 0, 1, 2, 2]


def test_copies(spark):
    d = spark.createDataFrame([("acme builders llc", "acme builders", 1), ("ecole maternelle sarl", "ecole maternelle", 2), ("solo", "solo", 3)], "n string, c string, k long")
    r = d.select(A.initials(F.lit("lille club")).alias("i"), A.spell(F.col("n")).alias("s"), A.glue(F.col("n"), F.col("c"), F.col("k")).alias("g"), A.swap(F.col("n"), F.col("c"), ["acme", "ecole", "garage"], F.col("k")).alias("w"), A.noise_swap(F.col("n"), F.col("c"), ["acme", "ecole"], F.col("k")).alias("x")).collect()
    assert r[0]["i"] == "lc" and r[0]["s"] == "acme builders l l c" and r[1]["g"] == "ecolematernelle sarl" and r[2]["s"] is None and r[2]["g"] is None
    assert r[0]["w"] in ("ecole builders llc", "garage builders llc") and r[0]["x"].split()[0] in A.NOISE and r[2]["w"] is None


def test_french(spark):
    d = spark.createDataFrame([("Smith Bakery LLC", "12 Oak Street, North, TX")], "n string, a string")
    r = d.select(A.french_name(F.col("n"), {"bakery": "boulangerie"}).alias("n"), A.french_address(F.col("a"), {"tx": "nord"}).alias("a")).first()
    assert r["n"] == "boulangerie smith sarl" and r["a"] == "12 rue oak, nord, nord"
