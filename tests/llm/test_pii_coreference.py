"""Spellings of one entity get one surrogate, and no surrogate is another's or an entity of the corpus."""

import re

import pytest
from pyspark.sql import functions as F

from linkwright.llm import pii as P

from test_pii import done, frame

TEXTS = [
    "Mr John Smith came. Then John Smith left; Smith said hi to Mr J. Smith, and SMITH-like Smithson stayed",
    "Господин Иван Петров Sr. García",
    "+1 555 123 4567, +15551234567, 555-123-4567, (555) 123-4567 and 5551234567; +44 (0)20 7946 0958 or +44 20 7946 0958",
    "josé@x.es and ::1 and fe80::1",
    "card 4111 1111 1111 1111 or 4111111111111111, iban DE89 3704 0044 0532 0130 00 or DE89370400440532013000",
    "signs \x01 and \x01\x02 stay, but Mrs O'Brien and O'Brien's go",
]


@pytest.fixture(scope="module")
def out(spark):
    return [done(spark, list(enumerate(TEXTS)))[i] for i in range(len(TEXTS))]


def test_names(out):
    full, given, last = re.match(r"Mr ((\w+) (\w+)) came", out[0]).groups()
    assert f"Then {full} left; {last} said hi to Mr " in out[0] and out[0].endswith("Smithson stayed") and out[0].count(last) == 4
    assert not re.search(r"John|Smith\b|\bJ\.", out[0].replace("SMITH", ""))
    assert not re.search("Иван|Петров|García", out[1]) and out[1].startswith("Господин ") and " Sr. " in out[1]
    assert "O'Brien" not in out[5] and out[5].startswith("signs \x01 and \x01\x02 stay, but Mrs ")


def test_numbers(out):
    us, uk = out[2].split("; ")
    assert re.match(r"\+1 \d{3} \d{3} \d{4}, \+1\d{10}, \d{3}-\d{3}-\d{4}, \(\d{3}\) \d{3}-\d{4} and \d{10}$", us)
    found = {re.sub(r"\D", "", x)[-10:] for x in re.split(", | and ", us)}
    assert len(found) == 1 and found != {"5551234567"}
    a, b = uk.split(" or ")
    assert a.startswith("+44 (0)") and re.sub(r"\D", "", a)[3:] == re.sub(r"\D", "", b)[2:] and "7946" not in uk
    cards = [re.sub(" ", "", x) for x in re.findall(r"\d{4} \d{4} \d{4} \d{4}(?= or)|\d{16}(?=,)", out[4])]
    digits = [int(c) for c in cards[0][::-1]]
    assert len(set(cards)) == 1 and (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0 and cards[0] != "4111111111111111"
    x, y = re.search(r"iban (DE89[ \d]+) or (\w+)$", out[4]).groups()
    assert x.replace(" ", "") == y and int(y[4:] + "1314" + y[2:4]) % 97 == 1 and "3704" not in x


def test_addresses(out):
    assert not re.search("josé|x\\.es|fe80", out[3]) and " and ::1 " not in out[3]


@pytest.mark.parametrize("n, digits", [(20_000, 6), (60_000, 6)])
def test_a_crowded_space(spark, n, digits):
    """n of 900,000 numbers: surrogates differ, and in a space that is not crowded none is an entity."""
    numbers = spark.range(n).select((F.lit(100_000) + F.pmod(F.col("id") * 7919, F.lit(900_000))).cast("string").alias("d"))
    mentions = numbers.select(F.concat(F.lit("+49 "), F.col("d")).alias("mention")).withColumn("parts", P.parts_of(F.col("mention"), F.lit("phone")))
    made = P.surrogates(spark, mentions)
    assert made.count() == n and made.select("made").distinct().count() == n
    assert made.where(~F.col("made").rlike("^[1-9][0-9]{5}$")).count() == 0
    assert made.join(numbers, F.col("made") == F.col("d")).count() == 0
    assert made.where(F.col("part") == F.concat(F.lit("phone:"), F.col("made"))).count() == 0


def test_a_full_space_is_permuted(spark):
    numbers = spark.range(10_000, 100_000).select(F.concat(F.lit("+49 "), F.col("id").cast("string")).alias("mention"))
    made = P.surrogates(spark, numbers.withColumn("parts", P.parts_of(F.col("mention"), F.lit("phone"))))
    assert made.select("made").distinct().count() == 90_000


def test_other_columns_stay(spark, cluttered):
    rows = P.with_surrogates(spark, cluttered(frame(spark, [(1, "a@b.com"), (2, None)]))).collect()
    assert len(rows) == 2 and all(r["_found"] == r["entity"] == r["_doc"] == "clash" for r in rows)
