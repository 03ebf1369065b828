"""Incremental matching: new pool records, as a stream, against a fixed token index of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking as B
from ..params import BlockParams


def query_index(queries: DataFrame, pool: DataFrame, prm: BlockParams = BlockParams()) -> DataFrame:
    """The queries' kept tokens with their IDF, from the pool known so far: the static side of the stream."""
    _, base_df, df = B.pool_index(pool, prm)
    # new records carry single-record tokens only, so composites of the index take no part
    single = BlockParams(**{**prm.__dict__, "types": ("n", "a", "p")})
    return B.query_tokens(queries, base_df, df, pool.count(), single).where(F.col("typ").isin("n", "a", "p"))


def arrivals(stream: DataFrame, index: DataFrame, prm: BlockParams = BlockParams()) -> DataFrame:
    """Scores of each arriving record (pid, core1, name2, addr, ts) per query: stateless until the sum, which a watermark bounds."""
    tokens = B.base_tokens(stream.select("pid", "ts", "core1", "name2", "addr"), "pid", prm)
    return B.tagged(tokens).select(F.col("id").alias("pid"), "tok").join(index.select("q", "tok", "idf"), "tok")


def match_stream(stream: DataFrame, index: DataFrame, path: str, checkpoint: str, k: int = 5, prm: BlockParams = BlockParams()) -> StreamingQuery:
    """Write each batch's k best queries of every new record to path. A batch that is replayed overwrites its own folder."""

    def best(batch: DataFrame, number: int) -> None:
        from pyspark.sql import Window

        tokens = B.tagged(B.base_tokens(batch, "pid", prm)).select(F.col("id").alias("pid"), "tok")
        scored = tokens.join(index.select("q", "tok", "idf"), "tok").groupBy("pid", "q").agg(F.sum("idf").alias("score"), F.count("*").alias("ns"))
        rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("score"), "q"))
        scored.withColumn("rank", rank).where(F.col("rank") <= k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(best).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Arrivals per window and type with a watermark: what a monitor of the stream shows."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
