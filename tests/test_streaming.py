from pyspark.sql import functions as F

from linkwright import adapters
from linkwright.streaming import incremental as I

SF = "/root/testdata/sf0.001"


def test_new_records_find_their_queries(spark, tmp_path):
    queries, pool = adapters.queries_and_pool(spark, SF)
    index = I.query_index(queries, pool).cache()
    pool.select("pid", "core1", "name2", "addr").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    I.match_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "cp"), 3).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.groupBy("pid").count().agg(F.max("count")).first()[0] <= 3
    best = got.where("rank = 1")
    assert best.count() == best.select("pid").distinct().count() > 0


def test_event_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = I.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()
