"""The synthetic tables as inputs of the linkage operators, in Spark and as DuckDB common table expressions.

documents: records of three sources by doc_id; the name is the first NAME_WORDS words and the address all others.
lineitem: scored pairs (q, pid, p, label); p is a whole number of cents over 2^24, so that sums of p are exact.
part: names with a type word, brands as addresses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .params import PID_BASE

NAME_WORDS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt over all cores by its key, where its files have fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, src, ctry, core1, name2, addr, digest of every document."""
    words = F.split(F.trim(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z0-9]+", " "))), " ")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id").select(F.col("doc_id").alias("rid"), (F.pmod("doc_id", F.lit(3)) + 1).alias("src"), F.col("lang").alias("ctry"), words.alias("ws"), F.md5("text").alias("digest"))
    return docs.select("rid", "src", "ctry", F.array_join(F.slice("ws", 1, NAME_WORDS), " ").alias("core1"), F.lit("").alias("name2"), F.array_join(F.slice("ws", F.lit(NAME_WORDS + 1), F.greatest(F.size("ws"), F.lit(1))), " ").alias("addr"), "digest")


def queries_and_pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Query records (q) and pool records (pid)."""
    r = records(spark, sf_dir)
    return r.where("src = 1").withColumnRenamed("rid", "q"), r.where("src > 1").withColumn("pid", F.col("src") * PID_BASE + F.col("rid"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, src, pid, ctry): records of other sources with an equal text."""
    s1, pool = queries_and_pool(spark, sf_dir)
    return s1.select("q", "ctry", "digest").join(pool.select("pid", "src", "digest"), "digest").select("q", "src", "pid", "ctry")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, pid, src, p, label) of every order line, the best of equal pairs."""
    p = F.round(F.col("l_extendedprice") * 100).cast("bigint") / F.lit(16777216.0)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), ((F.pmod("l_suppkey", F.lit(2)) + 2) * PID_BASE + F.col("l_partkey")).alias("pid"), p.alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return lines.groupBy("q", "pid").agg(F.max("p").alias("p"), F.max("label").alias("label")).select("q", "pid", (F.col("pid") / PID_BASE).cast("bigint").alias("src"), "p", "label")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, n_true) of every order, with or without lines."""
    n = pairs(spark, sf_dir).groupBy("q").agg(F.sum("label").alias("n"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q")).join(n, "q", "left").select("q", F.coalesce("n", F.lit(0)).alias("n_true"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, core1, legal, addr, brand, house) of every part."""
    t = table(spark, sf_dir, "part")
    kind = F.element_at(F.split(F.lower("p_type"), " "), -1)
    return t.select(F.col("p_partkey").alias("rid"), F.lower("p_name").alias("core1"), kind.alias("legal"), F.concat_ws(" ", F.col("p_size").cast("string"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", " "))).alias("addr"), "p_brand", F.col("p_size").alias("house"))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of two distinct part names (a_core, b_core): the names are few, whatever the number of parts."""
    names = parts(spark, sf_dir).select("core1").distinct()
    return names.select(F.col("core1").alias("a_core")).join(names.select(F.col("core1").alias("b_core")), F.col("a_core") != F.col("b_core"))


def part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs with part records on both sides: a stands for the order's dearest part, b for the line's part."""
    p, x = pairs(spark, sf_dir), parts(spark, sf_dir)
    b = x.select(F.col("rid").alias("b_rid"), F.col("core1").alias("b_core"), F.col("legal").alias("b_legal"), F.col("addr").alias("b_addr"), F.col("house").alias("b_house"))
    a = x.select(F.col("rid").alias("a_rid"), F.col("core1").alias("a_core"), F.col("legal").alias("a_legal"), F.col("addr").alias("a_addr"), F.col("house").alias("a_house"))
    lead = p.groupBy("q").agg(F.max(F.struct("p", "pid")).alias("t")).select("q", F.pmod("t.pid", F.lit(PID_BASE)).alias("a_rid"))
    return p.withColumn("b_rid", F.pmod("pid", F.lit(PID_BASE))).join(b, "b_rid").join(lead, "q").join(a, "a_rid")


RECORDS = """
rec AS (
  SELECT rid, src, ctry, array_to_string(ws[1:4], ' ') AS core1, '' AS name2, array_to_string(ws[5:], ' ') AS addr, digest
  FROM (SELECT doc_id AS rid, doc_id % 3 + 1 AS src, lang AS ctry, md5(text) AS digest,
          string_split(trim(lower(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9]+', ' ', 'g'))), ' ') AS ws FROM documents)),
qry AS (SELECT rid AS q, * EXCLUDE (rid) FROM rec WHERE src = 1),
pool AS (SELECT src * 10000000 + rid AS pid, * FROM rec WHERE src > 1),
truth AS (SELECT a.q, b.src, b.pid, a.ctry FROM qry a JOIN pool b ON a.digest = b.digest)
"""
PAIRS = """
pairs AS (
  SELECT q, pid, pid // 10000000 AS src, max(p) AS p, max(label) AS label
  FROM (SELECT l_orderkey AS q, (2 + l_suppkey % 2) * 10000000 + l_partkey AS pid, CAST(round(l_extendedprice * 100) AS BIGINT) / 16777216::DOUBLE AS p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)
  GROUP BY q, pid),
universe AS (SELECT o_orderkey AS q, coalesce(n, 0) AS n_true FROM orders LEFT JOIN (SELECT q, sum(label)::BIGINT AS n FROM pairs GROUP BY q) t ON t.q = o_orderkey)
"""
PARTS = """
parts AS (
  SELECT p_partkey AS rid, lower(p_name) AS core1, string_split(lower(p_type), ' ')[-1] AS legal,
    p_size::VARCHAR || ' ' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g')) AS addr, p_brand, p_size AS house
  FROM part),
names AS (SELECT DISTINCT core1 FROM parts),
name_pairs AS (SELECT a.core1 AS a_core, b.core1 AS b_core FROM names a JOIN names b ON a.core1 <> b.core1)
"""
LINKS = """
lead AS (SELECT q, pid % 10000000 AS a_rid FROM pairs QUALIFY row_number() OVER (PARTITION BY q ORDER BY p DESC, pid DESC) = 1),
links AS (
  SELECT x.*, x.pid % 10000000 AS b_rid, l.a_rid, b.core1 AS b_core, b.legal AS b_legal, b.addr AS b_addr, b.house AS b_house, a.core1 AS a_core, a.legal AS a_legal, a.addr AS a_addr, a.house AS a_house
  FROM pairs x JOIN parts b ON b.rid = x.pid % 10000000 JOIN lead l ON l.q = x.q JOIN parts a ON a.rid = l.a_rid)
"""
