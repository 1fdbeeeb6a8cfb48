from pyspark.sql import functions as F

from gridtide.streaming.load import flagged_sessions, step_sums
from tests.conftest import DATA


def drained(stream, name, tmp_path):
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def source(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))


def test_streamed_sums_equal_the_batch(spark, tmp_path):
    events, stream = source(spark, tmp_path)
    batch = {(r[0], r[1]): (r[2], r[3]) for r in step_sums(events, ["event_type"], "ts", "value").collect()}
    got = {(r[0], r[1]): (r[2], r[3]) for r in drained(step_sums(stream, ["event_type"], "ts", "value"), "sums", tmp_path).collect()}
    assert got == batch and sum(n for _, n in got.values()) == events.count()


def test_streamed_sessions_equal_the_batch(spark, tmp_path):
    events, stream = source(spark, tmp_path)
    batch = sorted(flagged_sessions(events, ["event_type"], "ts", 7200).collect())
    q = flagged_sessions(stream, ["event_type"], "ts", 7200).writeStream.outputMode("complete").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("sessions").collect()) == batch
