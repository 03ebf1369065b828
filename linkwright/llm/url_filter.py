"""URL filtering by hash prefixes of host-suffix and path-prefix expressions.

A url is expanded into every suffix of its host joined with every directory of its path, as deep as the rules go. The
expressions meet the rules in an equi-join on the first eight hex digits of their SHA-256; the full digest and the rest
of the rule's path confirm a hit, and the longest fitting rule wins. Urls that repeat are expanded once. A rule list of
any size works: Spark broadcasts it where it is small by its own threshold, and joins it by shuffle where it is not.

Defined results: a null url, or one without "://", has an empty host and path and fits no rule; a null page_id is kept;
repeated rows get a row each; rules with an equal host and path that differ in action block; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

#: action, host, path
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: The verdict on a url that fits no rule.
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(rules or RULES, "action string, host string, path string")


def keyed_rules(rules: DataFrame) -> DataFrame:
    """The rules with the digest of their host and directory."""
    digest = F.sha2(F.concat("host", F.regexp_extract("path", r"(?s)\A(.*/)?", 0)), 256)
    best = rules.groupBy("host", "path").agg(F.max("action").alias("action"))  # block comes after allow
    return best.select(F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"), digest.alias("rule_digest"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action")


def expressions(urls: DataFrame, labels: int, depth: int) -> DataFrame:
    """One row for each host suffix of at most so many labels and each directory of at most so many levels."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - labels + 1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    steps = F.split("path", "/")
    deepest = F.least(F.size(steps) - 1, F.lit(depth))
    directories = F.when(deepest > 0, F.transform(F.sequence(F.lit(1), deepest), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))).otherwise(F.array())
    whole = F.array_union(F.array(F.lit("")), directories)
    rows = urls.where("host <> ''").withColumn("suffix", F.explode(suffixes)).withColumn("directory", F.explode(whole))
    digest = F.sha2(F.concat("suffix", "directory"), 256)
    return rows.select("host", "path", digest.alias("digest"), F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # two numbers: how deep the rules go
    reach = rules.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.size(F.split("path", "/")) - 1)).first()
    hits = expressions(urls.select("host", "path").distinct(), reach[0] or 0, reach[1] or 0).join(keyed_rules(rules), "prefix")
    hits = hits.where((F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path")))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), "action")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE = r"""
WITH rules(action, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (
  SELECT row_number() OVER () AS id, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, u.host, u.path, r.host || r.path AS rule, coalesce(r.action, 'allow') AS verdict
FROM u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
QUALIFY row_number() OVER (PARTITION BY u.id ORDER BY length(r.host || r.path) DESC) = 1
"""
