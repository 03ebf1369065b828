"""Checks of match and candidate lists before they leave: format, keys, ids, subsets, shared owners, and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tsv import list_rows


def marked_files(spark: SparkSession, path: str) -> int:
    """How many files of a list begin with a byte order mark. Spark's line readers drop the mark, so three bytes of each are read."""
    hadoop, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for row in spark.read.format("binaryFile").load(path).where("length > 2").select("path").toLocalIterator():
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(row["path"])
        stream = at.getFileSystem(hadoop).open(at)
        try:
            n += [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]
        finally:
            stream.close()
    return n


def format_issues(spark: SparkSession, path: str, header: str, name: str) -> DataFrame:
    """(issue, n): files with a byte order mark, and raw lines with carriage returns, too many or few tabs, quotes; no header."""
    lines = spark.read.option("lineSep", "\n").text(path)
    head = lines.where(F.col("value") == header)
    checks = {"carriage return": F.col("value").contains("\r"), "not one tab": F.length(F.regexp_replace("value", "[^\t]", "")) != 1, "quote": F.col("value").contains('"')}
    body = lines.where(F.col("value") != "")
    counted = body.select(F.explode(F.array(*(F.when(c, F.lit(f"{name}: {k}")) for k, c in checks.items()))).alias("issue")).where("issue IS NOT NULL").groupBy("issue").agg(F.count("*").alias("n"))
    missing = head.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(f"{name}: header").alias("issue"), F.lit(1).cast("bigint").alias("n"))
    marks = spark.range(1).select(F.lit(f"{name}: byte order mark").alias("issue"), F.lit(marked_files(spark, path)).cast("bigint").alias("n")).where("n > 0")
    return counted.union(missing).union(marks)


def list_issues(lists: DataFrame, column: str, ids: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """(issue, n): rows that repeat an entity, entities without a row, rows of strangers, repeated and unknown ids, self-matches."""
    keys = lists.groupBy("source1_entity_id").agg(F.count("*").alias("c"))
    n = lambda d, issue: d.agg(F.count("*").alias("n")).select(F.lit(f"{name}: {issue}").alias("issue"), "n")
    s1 = ids.select(F.col("entity_id").alias("source1_entity_id"))
    rows = list_rows(lists, column)
    items = F.filter(F.split(column, ","), lambda x: x != "")
    found = [
        n(keys.where("c > 1"), "entity with several rows"), n(s1.join(keys, "source1_entity_id", "left_anti"), "entity without a row"), n(keys.join(s1, "source1_entity_id", "left_anti"), "row of an unknown entity"),
        n(lists.where(F.size(items) != F.size(F.array_distinct(items))), "row that repeats an id"), n(rows.join(known.select("entity_id"), "entity_id", "left_anti"), "unknown id"),
        n(rows.where(F.col("entity_id") == F.col("source1_entity_id")), "entity matched with itself"),
    ]
    return reduce(DataFrame.union, found)


def validate(matched: DataFrame, candidates: DataFrame, ids: DataFrame, known: DataFrame) -> DataFrame:
    """(issue, n) of both lists, every check with its count; zero everywhere means valid.

    matched (source1_entity_id, matched), candidates (source1_entity_id, candidates).
    """
    m, c = list_rows(matched, "matched"), list_rows(candidates, "candidates")
    beyond = m.join(c, ["source1_entity_id", "entity_id"], "left_anti").agg(F.count("*").alias("n")).select(F.lit("matched but no candidate").alias("issue"), "n")
    shared = m.groupBy("entity_id").agg(F.countDistinct("source1_entity_id").alias("c")).where("c > 1").agg(F.count("*").alias("n")).select(F.lit("record with several owners").alias("issue"), "n")
    return list_issues(matched, "matched", ids, known, "matched").union(list_issues(candidates, "candidates", ids, known, "candidates")).union(beyond).union(shared)


def statistics(matched: DataFrame, candidates: DataFrame, countries: DataFrame) -> DataFrame:
    """(country, n_rows, with_match, matches, candidates) of every country. countries: (source1_entity_id, country)."""
    size = lambda c: F.size(F.filter(F.split(c, ","), lambda x: x != ""))
    d = countries.join(matched.select("source1_entity_id", size("matched").alias("m")), "source1_entity_id").join(candidates.select("source1_entity_id", size("candidates").alias("c")), "source1_entity_id")
    return d.groupBy("country").agg(F.count("*").alias("n_rows"), F.sum((F.col("m") > 0).cast("int")).alias("with_match"), F.sum("m").cast("bigint").alias("matches"), F.sum("c").cast("bigint").alias("candidates"))
