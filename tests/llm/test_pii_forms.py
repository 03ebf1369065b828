"""Entities of every form are found in texts that hold nothing else."""

import pytest
from pyspark.sql import functions as F

from linkwright.llm import pii as P

from test_pii import done

DIGIT_FREE = [
    "sk-abcdefghijklmnopqrstuvwx", "xoxb-abcdefghijklmnop", "AKIA" + "ABCDEFGHIJKLMNOP", "ASIA" + "ABCDEFGHIJKLMNOP", "ghp_" + "abcdef" * 6, "AIza" + "abcde" * 7,
    "eyJabcdefghijkl.abcdefghijklm.abcdefghijklm", "aa:bb:cc:dd:ee:ff", "abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd",
]


@pytest.fixture(scope="module")
def out(spark):
    return done(spark, [*((i, f"it is {x}, they say") for i, x in enumerate(DIGIT_FREE)), *((100 + i, f"it is {x}, they say, 7 times") for i, x in enumerate(DIGIT_FREE)), (200, "task-abcdefghijklmnopqrstuvwx said a: bad")])


def test_entities_without_digits_go(out):
    for i, x in enumerate(DIGIT_FREE):
        assert x not in out[i] and out[100 + i] == f"{out[i]}, 7 times"
    assert out[200] == "task-abcdefghijklmnopqrstuvwx said a: bad"


def test_the_hint_fits_every_entity(spark):
    forms = [*DIGIT_FREE, "a@b.com", "0123456789abcdef" * 2, "1.2.3.4", "DE89 3704 0044 0532 0130 00", "+1 743 555 3824", "Mr Smith", "Sra. López", "госпожа Иванова"]
    texts = spark.createDataFrame([(x,) for x in forms], "t string")
    assert texts.where(~F.col("t").rlike(P.ENTITY) | ~F.col("t").rlike(P.HINT)).collect() == []


NAMES = [
    "Sr Juan Carlos García Hernández", "Mr Ronald McDonald", "Mr O'Brien", "Mr J. Smith", "Dr. J.R. Ewing", "Mr SMITH", "Frau Anna von der Leyen", "Monsieur d'Artagnan",
    "Mr al-Hassan", "Mr John Q. Public Junior Third Of That", "господин Иван А. Петров", "Mr X",
]
ADDRESSES = ["2001:db8::1", "::1", "fe80::", "fe80::1ff:fe23:4567:890a", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:192.0.2.1", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:1.2.3.4"]


def test_whole_names_go(spark):
    out = done(spark, [(i, f"then {n}, who left") for i, n in enumerate(NAMES)])
    for i, n in enumerate(NAMES):
        got = out[i].removeprefix("then ").removesuffix(", who left")
        same = {"von", "der", "Mr", "Dr.", "Sr", "Frau", "Monsieur", "господин"}
        assert got != n and len(got.split()) == len(n.split()) and not set(n.split()) & set(got.split()) - same, (n, got)
    assert out[3].split()[2].endswith(".") and out[6].split()[3:5] == ["von", "der"]


def test_a_name_ends_at_the_next_title_and_long_runs_are_fine(spark):
    out = done(spark, [(1, "Sr García y Sra López"), (2, "Mr " + "Ab " * 20_000), (3, "Sra López")])
    assert out[1].split()[2:] == ["y", *out[3].split()] and "Ab" not in out[2].split()


def test_short_addresses_go(spark):
    spelt = ["2001:0db8:0000:0000:0000:0000:0000:0001", "2001:DB8:0::1", "::ffff:c000:201"]
    out = done(spark, [(i, f"at {a}, there") for i, a in enumerate([*ADDRESSES, *spelt, "std::vector 10:30 :: 12:34:56"])])
    n = len(ADDRESSES)
    made = [out[i].removeprefix("at ").removesuffix(", there") for i in range(n + 3)]
    assert all(len(m) == 39 and m.count(":") == 7 for m in made) and len(set(made)) == n
    assert made[n] == made[n + 1] == made[0] and made[n + 2] == made[6]
    assert out[n + 3] == "at std::vector 10:30 :: 12:34:56, there"


def test_the_hint_and_kind_of_new_forms(spark):
    texts = spark.createDataFrame([(x, "name") for x in NAMES] + [(x, "ip6") for x in ADDRESSES], "t string, kind string")
    bad = texts.where(~F.col("t").rlike(P.HINT) | (F.regexp_extract("t", f"({P.ENTITY})", 1) != F.col("t")) | (P.kind_of(F.col("t")) != F.col("kind")))
    assert bad.collect() == []
