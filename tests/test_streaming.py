"""Streams against the same work in one batch."""

import os

from pyspark.sql import functions as F

from newsloom.streaming import streams


def landed(spark, sf, tmp_path, parts=3):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(parts):
        lot = events.where((F.col("event_id") >= 1000 * k / parts) & (F.col("event_id") < 1000 * (k + 1) / parts))
        lot.coalesce(1).write.parquet(f"{tmp_path}/lot{k}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        for f in os.listdir(f"{tmp_path}/lot{k}"):
            if f.endswith(".parquet"):
                os.rename(f"{tmp_path}/lot{k}/{f}", f"{tmp_path}/in/{k}-{f}")
    return events, streams.source(spark, f"{tmp_path}/in", events.schema, 1)


def test_state_is_last_writer(spark, sf, tmp_path):
    events, stream = landed(spark, sf, tmp_path)
    log = lambda df: df.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"))
    state = streams.KeyedState(spark, f"{tmp_path}/state", "user_id", "user_id long, seq long")
    streams.drain(log(stream), f"{tmp_path}/checkpoint", state.merge)
    streams.drain(log(stream), f"{tmp_path}/checkpoint", state.merge)  # nothing new
    last = {}
    for r in events.orderBy("event_id").collect():
        last[r.user_id] = (r.event_id, r.event_type)
    got = {r.user_id: r.seq for r in state.read().collect()}
    # a delete only removes what is there; a later batch may bring the key back
    assert got == {k: e for k, (e, t) in last.items() if t != "error"}


def test_windows(spark, sf, tmp_path):
    events, stream = landed(spark, sf, tmp_path, 1)
    out = []
    counted = streams.rate_windows(stream, "ts", "event_type", "1 hour")
    q = counted.writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination()
    out = {(r.window.start, r.event_type): r.n for r in spark.table("rates").collect()}
    want = {(r.t, r.event_type): r.n for r in events.groupBy(F.date_trunc("hour", "ts").alias("t"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert out == want


def test_once(spark, sf, tmp_path):
    events, stream = landed(spark, sf, tmp_path, 1)
    keyed = stream.withColumn("k", F.col("user_id") % 5)
    q = streams.once(keyed, "ts", ["k"], "400 days").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == events.select(F.col("user_id") % 5).distinct().count()


def test_late_flag(spark):
    rows = spark.sql("select timestamp '2024-01-01 00:20:00' as ts, timestamp '2024-01-01 00:00:00' as seen union all select timestamp '2024-01-01 00:05:00', timestamp '2024-01-01 00:00:00'")
    assert sorted(r.future_suspect for r in streams.late_flag(rows, "ts", "seen").collect()) == [False, True]
