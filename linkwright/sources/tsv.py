"""Tab-separated sources and list files, read and written without quoting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..params import PID_BASE

RECORD = StructType([StructField(c, StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read(spark: SparkSession, path: str, schema: StructType = RECORD, quoted: bool = False) -> DataFrame:
    """All columns as strings, nothing inferred; a missing value is an empty string. quoted: honour quotes, as helpers do."""
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", '"' if quoted else "").option("escape", "")
    return reader.schema(schema).csv(path).na.fill("")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(key, rest): each line after the header, cut at its first tab; blank lines are skipped."""
    lines = spark.read.text(path)
    first = F.col("value").startswith("source1_entity_id\t")
    parts = F.split("value", "\t", 2)
    return lines.where(~first & (F.trim("value") != "")).select(F.get(parts, F.lit(0)).alias("key"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("rest"), "value")


def write(df: DataFrame, path: str) -> None:
    """One header per file, no quotes; an empty value is an empty field."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "").csv(path)


def write_parquet(df: DataFrame, path: str, by: str | None = None, files: int | None = None) -> None:
    """Compressed Parquet; with `by`, rows are range-partitioned so that a range of keys reads few files."""
    if by:
        df = (df.repartitionByRange(files, by) if files else df.repartitionByRange(by)).sortWithinPartitions(by)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def numbered(records: DataFrame, key: str = "entity_id") -> DataFrame:
    """records with rid = 0, 1, ... in the order of their key.

    Ranks come from range partitions and the sums of the sizes of those before, so that no task sorts the whole table.
    """
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = records.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id())
    own = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    # one row for each partition
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return own.join(F.broadcast(before), "_part").withColumn("rid", F.col("_before") + F.col("_n") - 1).drop("_part", "_n", "_before")


def labels(truth: DataFrame, sources: dict[int, DataFrame], source1: DataFrame) -> DataFrame:
    """(s1_rid, src, other_rid) of every true pair; an id that no source holds is an error in the count of nulls."""
    ids = truth.select("source1_entity_id", F.explode(F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")).alias("entity_id"))
    other = None
    for src, d in sources.items():
        part = d.select("entity_id", F.lit(src).alias("src"), F.col("rid").alias("other_rid"))
        other = part if other is None else other.union(part)
    one = source1.select(F.col("entity_id").alias("source1_entity_id"), F.col("rid").alias("s1_rid"))
    return ids.join(one, "source1_entity_id", "left").join(other, "entity_id", "left").select("s1_rid", "src", "other_rid")


def list_rows(lists: DataFrame, column: str) -> DataFrame:
    """A list file's rows exploded: (source1_entity_id, entity_id)."""
    return lists.select("source1_entity_id", F.explode(F.filter(F.split(column, ","), lambda x: x != "")).alias("entity_id"))


def pairs_of_lists(lists: DataFrame, column: str, source1: DataFrame, pool: DataFrame) -> DataFrame:
    """List rows as (q, pid). source1: (entity_id, q); pool: (entity_id, pid)."""
    one = source1.select(F.col("entity_id").alias("source1_entity_id"), "q")
    return list_rows(lists, column).join(one, "source1_entity_id").join(pool.select("entity_id", "pid"), "entity_id").select("q", "pid")


def lists_of_pairs(pairs: DataFrame, source1: DataFrame, pool: DataFrame, column: str) -> DataFrame:
    """(source1_entity_id, <column>) for every entity: its records' ids, ascending and joined by commas."""
    ids = pairs.join(pool.select("pid", "entity_id"), "pid").groupBy("q").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias(column))
    return source1.join(ids, "q", "left").select(F.col("entity_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def pool_of(sources: dict[int, DataFrame]) -> DataFrame:
    """All pool records with src and pid."""
    out = None
    for src, d in sources.items():
        part = d.withColumn("src", F.lit(src)).withColumn("pid", F.lit(src) * PID_BASE + F.col("rid"))
        out = part if out is None else out.unionByName(part)
    return out
