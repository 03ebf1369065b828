import random
import re
import string

import pytest
from pyspark.sql import functions as F

from linkwright.functions import text as T


def parsed(spark, *names):
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", T.folded("n").alias("t"))
    rows = T.with_parsed_name(d, "t").orderBy("i").collect()
    return [r.asDict() for r in rows]


def test_names(spark):
    r = parsed(spark, "Elite &amp; Co", "ipower.com", "Arcbrixx dba Rays Office", "Lawrence Ventures Private Limited", "X Shop | www.x-shop.com", "C0mpany 3m", None, "  ", "Société Générale", "The Of")
    assert r[0]["name1"] == "elite and company"
    assert r[1]["is_domain"] and r[1]["name1"] == "ipower"
    assert (r[2]["name1"], r[2]["name2"], r[2]["has_alias"]) == ("arcbrixx", "rays office", True)
    assert (r[3]["core1"], r[3]["legal"]) == ("lawrence ventures", "limited private")
    assert (r[4]["name1"], r[4]["name2"], r[4]["is_domain"]) == ("x shop", "x shop", False)
    assert r[5]["name1"] == "company 3m"
    assert r[6]["name1"] == r[7]["name1"] == "" and not r[6]["has_alias"]
    assert r[8]["core1"] == "societe generale"
    assert r[9]["core1"] == "the of"  # never empty


def test_addresses_and_countries(spark):
    rows = [("1344 MCDONALD HILL RD, CHICAGOCDP, IL", "US"), ("12 r de la Paix, Cedex 9", "France"), ("12 r de la Paix, Cedex 9", "US"), ("Door No 5, MG Rd", "Bharat"), (None, None)]
    d = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(rows)], "i int, a string, c string").select("i", T.folded("a").alias("a"), T.norm_country(T.folded("c")).alias("c"))
    got = [(r["x"], r["c"]) for r in d.select("i", T.norm_address(F.col("a"), F.col("c")).alias("x"), "c").orderBy("i").collect()]
    assert got == [("1344 mcdonald hill road chicago il", "us"), ("12 rue de la paix 9", "france"), ("12 r de la paix cedex 9", "us"), ("5 mg road", "india"), ("", "")]


def test_romanised(spark):
    assert T.transliterate("राम मीडिया प्राइवेट लिमिटेड") == "ram midiya praivet limited"
    raw = spark.createDataFrame([(0, "S1", "राम मीडिया", "दिल्ली 12", "India")], "rid long, entity_id string, business_name string, business_address string, country string")
    r = T.normalise(raw).first()
    assert r["core1"] == "राम मीडिया" and r["core_rom"] == "ram midiya" and r["nl_name"] > 0.9 and r["ctry"] == "india"


def test_tokens_of_random_ascii(spark):
    rng = random.Random(5)
    rows = ["".join(rng.choice(string.printable[:95]) for _ in range(rng.randint(0, 30))) for _ in range(3000)]

    def plain(s):
        s = s.lower().replace("'", "").replace("`", "").replace("&", " and ")
        return "".join(" " if c in string.punctuation else c for c in s).split()

    d = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    got = {r["i"]: r["t"] for r in d.select("i", T.tokens(F.lower("s")).alias("t")).collect()}
    assert all(got[i] == plain(s) for i, s in enumerate(rows))


@pytest.mark.parametrize(("text", "want"), [("12 main 12345", "[N]12[/] main [P]12345[/]"), ("a1b", "a[N]1[/]b"), ("", "")])
def test_digit_tags(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.tag_digits(F.col("t"))).first()[0] == want


def test_small_functions(spark):
    d = spark.createDataFrame([("dupont s a r l", "sas", "0012 rue", "lille club sud")], "n string, l string, a string, c string")
    r = d.select(T.strip_spaced(F.col("n")).alias("s"), F.array_sort(T.legal_set(F.col("n"), F.col("l"))).alias("f"), T.house(F.col("a")).alias("h"), T.initials(F.col("c")).alias("i"), T.is_subsequence(F.lit("lu"), F.col("c")).alias("y"), T.is_subsequence(F.lit("zl"), F.col("c")).alias("z"), T.skeleton(F.col("c")).alias("k")).first()
    assert (r["s"], r["f"], r["h"], r["i"], r["y"], r["z"], r["k"]) == ("dupont", ["sa", "sarl", "sas"], "12", "lcs", True, False, re.sub("[ aeiouy]", "", "lille club sud"))
