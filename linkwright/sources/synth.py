"""A synthetic corpus of business records in three sources, made by hashing row numbers: any size, in parallel, repeatable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Names are a coined word of syllables, a trade and a legal form (long, short).
SYLLABLES = ["ba", "ce", "dor", "fin", "gal", "hu", "ki", "lem", "mo", "nar", "pel", "qui", "ros", "su", "tav", "vik", "wen", "zo"]
TRADES = ["bakery", "carpentry", "dental clinic", "electronics", "garage", "instruments", "nursery", "optics", "printing", "shipping", "software", "tiles"]
FORMS = [("", ""), ("limited", "ltd"), ("incorporated", "inc"), ("private limited", "pvt ltd"), ("corporation", "corp")]
ROADS = ["harbour road", "mill lane", "station street", "temple avenue", "willow drive"]
#: What a copy may have instead of what its entity has, and how often in a thousand: the changes fall independently.
SHORTER = {"road": "rd", "lane": "ln", "street": "st", "avenue": "ave", "drive": "dr"}
CHANGES = {"short form": 400, "swapped letters": 350, "trade first": 150, "upper case": 200, "short road": 500, "no town": 150}
#: Of a thousand entities, so many have one copy in a pool source, and so many of these have a second one.
COPIED, TWICE = 600, 250


def _hash(*key: Column | str | int) -> Column:
    return F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in key))


def _of(values: list[str], *key) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(_hash(*key), F.lit(len(values))).cast("int"))


def _happens(per_thousand: int, *key) -> Column:
    return F.pmod(_hash(*key, "happens"), F.lit(1000)) < per_thousand


def entities(spark: SparkSession, n: int, countries: tuple[str, ...] = ("US", "India"), seed: int = 0) -> DataFrame:
    """(k, entity_id, word, trade, form, road, town, country) of n entities."""
    k = F.col("id")
    word = F.concat(*(_of(SYLLABLES, k, seed, f"syllable {i}") for i in range(4)))
    road = F.concat_ws(" ", (F.pmod(_hash(k, seed, "house"), F.lit(400)) + 1).cast("string"), _of(ROADS, k, seed, "road"))
    town = F.concat_ws(" ", F.concat(_of(SYLLABLES, k, seed, "town 1"), _of(SYLLABLES, k, seed, "town 2"), F.lit("ville")), F.lpad(F.pmod(_hash(k, seed, "code"), F.lit(1_000_000)).cast("string"), 6, "0"))
    return spark.range(n).select(
        k.alias("k"), F.format_string("S1-%07d", k).alias("entity_id"), word.alias("word"), _of(TRADES, k, seed, "trade").alias("trade"),
        F.pmod(_hash(k, seed, "form"), F.lit(len(FORMS))).cast("int").alias("form"), road.alias("road"), town.alias("town"), _of(list(countries), k, seed, "country").alias("country"),
    )


def _record(changed: dict[str, Column]) -> tuple[Column, Column]:
    """Name and address of an entity's row; changed says which of CHANGES fall on it."""
    long, short = ([form[i] for form in FORMS] for i in (0, 1))
    form = F.when(changed["short form"], F.get(F.array(*map(F.lit, short)), "form")).otherwise(F.get(F.array(*map(F.lit, long)), "form"))
    word = F.when(changed["swapped letters"], F.regexp_replace("word", "^(.{3})(.)(.)", "$1$3$2")).otherwise(F.col("word"))
    own = F.when(changed["trade first"], F.concat_ws(" ", "trade", word)).otherwise(F.concat_ws(" ", word, "trade"))
    name = F.trim(F.concat_ws(" ", own, form))
    road = reduce(lambda c, x: F.regexp_replace(c, f" {x[0]}$", f" {x[1]}"), SHORTER.items(), F.col("road"))
    road = F.when(changed["short road"], road).otherwise(F.col("road"))
    return F.when(changed["upper case"], F.upper(name)).otherwise(F.initcap(name)), F.when(changed["no town"], road).otherwise(F.concat_ws(", ", road, "town"))


def make(spark: SparkSession, n: int, countries: tuple[str, ...] = ("US", "India"), seed: int = 0) -> tuple[dict[int, DataFrame], DataFrame]:
    """Three sources of (entity_id, business_name, business_address, country), and the truth.

    Each entity has up to two changed copies in each pool source, and a third as many records there match nothing.
    """
    base = entities(spark, n, countries, seed)
    columns = ["entity_id", "business_name", "business_address", "country"]
    rows = lambda d, pair: d.select("entity_id", pair[0].alias("business_name"), pair[1].alias("business_address"), "country")
    unchanged = dict.fromkeys(CHANGES, F.lit(False))
    sources, links = {1: rows(base, _record(unchanged))}, []
    for src in (2, 3):
        some = F.filter(F.array(F.when(_happens(COPIED, F.col("k"), src, seed), F.lit(0)), F.when(_happens(COPIED, F.col("k"), src, seed) & _happens(TWICE, F.col("k"), src, seed, "again"), F.lit(1))), lambda c: c.isNotNull())
        copies = base.withColumnRenamed("entity_id", "source1_entity_id").withColumn("c", F.explode(some)).withColumn("entity_id", F.format_string(f"S{src}-%08d", F.col("k") * 2 + F.col("c")))
        name, address = _record({what: _happens(p, F.col("k"), F.col("c"), src, seed, what) for what, p in CHANGES.items()})
        copied = copies.select("source1_entity_id", "entity_id", name.alias("business_name"), address.alias("business_address"), "country")
        strangers = entities(spark, n // 3, countries, seed + 1000 * src).withColumn("entity_id", F.format_string(f"S{src}-%08d", F.col("k") + 2 * n))
        sources[src] = copied.select(columns).union(rows(strangers, _record(unchanged)))
        links.append(copied.select("source1_entity_id", "entity_id"))
    lists = reduce(DataFrame.union, links).groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("matched_entity_ids"))
    truth = base.select(F.col("entity_id").alias("source1_entity_id")).join(lists, "source1_entity_id", "left")
    return sources, truth.na.fill("", ["matched_entity_ids"])
