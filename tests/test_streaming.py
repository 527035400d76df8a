"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from sievework.plans import queries
from sievework.streaming import sessions


def drained(frame, name, mode):
    run = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_key_sessions(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id < 20")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    got = drained(sessions.key_sessions(stream, "user_id", "ts", late="60 days"), "found_sessions", "complete")
    want = queries.session_stream(spark, sf).where("user_id < 20")
    text = lambda c: F.date_format(c, queries.TIME).alias(c)
    rows = got.select("user_id", text("session_start"), text("session_end"), "n").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want.collect())) and rows


def test_last_states(spark, tmp_path):
    events = spark.createDataFrame([(i, f"p{i % 3}", f"s{i}") for i in range(30)], "seq long, path string, arg string")
    events.repartition(4).write.parquet(str(tmp_path / "reviews"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "reviews"))
    got = drained(sessions.last_states(stream), "found_states", "complete").collect()
    assert {(r.path, r.status) for r in got} == {("p0", "s27"), ("p1", "s28"), ("p2", "s29")}
