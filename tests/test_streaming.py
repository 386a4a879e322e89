from pyspark.sql import functions as F

from tidemill.operators import resample as R
from tidemill.schema import Columns
from tidemill.streaming.buckets import bucket_stream

COLS = Columns("ts", "user_id", "event_type", ("value",))


def test_stream_slots_equal_batch_slots(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(str(tmp_path / "in"))
    hour = 3_600_000
    stream = bucket_stream(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), COLS, 6 * hour)
    query = (stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = R.bucket_last(source, COLS, 6 * hour).select("user_id", (F.col("bucket") * 6 * hour * 1000).alias("slot_us"), "event_type", "value")
    newest = source.agg(F.max("ts")).first()[0].timestamp()
    closed = batch.filter(F.col("slot_us") / 1e6 + 6 * 3600 <= newest - 600)
    assert closed.count() > 0
    assert got.exceptAll(batch).count() == 0 and closed.exceptAll(got).count() == 0
