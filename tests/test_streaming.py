import time

from pyspark.sql import functions as F

from skein.operators import goroutines as G
from skein.streaming.state_times import state_times, type_counts
from traces import event as e, table

LIFE = [e(10, "GoCreate", a=(1,)), e(30, "GoStart", g=1), e(70, "GoBlockRecv", g=1), e(100, "GoUnblock", a=(1,)), e(120, "GoStart", g=1), e(130, "GoSysBlock", g=1), e(135, "GoSysExit", g=1, a=(1,)), e(150, "GoStart", g=1), e(160, "GoEnd", g=1)]


def run(spark, tmp_path, schema, name, delay="1 day"):
    """Runs the stream over the files of the folder, oldest first; the newest row of each goroutine and the progress of the batches."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = state_times(stream, delay).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    newest = {}
    for r in spark.table(name).collect():
        k = (r.trace_id, r.g)
        if k not in newest or (r.events, r.late) >= (newest[k].events, newest[k].late):
            newest[k] = r
    return newest, q.recentProgress


def batch(ev):
    spans = G.state_intervals(ev).where("counted and end_ts is not null").groupBy("trace_id", "g").agg(*(F.coalesce(F.sum(F.when(F.col("state") == s, F.col("end_ts") - F.col("ts"))), F.lit(0)).alias(s) for s in G.STATES))
    return {(r.trace_id, r.g): tuple(r)[2:] for r in spans.collect()}


def feed(tmp_path, ev, *parts):
    for i, (which, at) in enumerate(parts):
        ev.where(which).withColumn("loaded_at", F.expr(f"timestamp_ntz'{at}'")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # the order of files is that of their times


def test_stream_equals_batch_whatever_the_order_of_arrival(spark, tmp_path):
    ev = table(spark, LIFE, LIFE[:6])
    feed(tmp_path, ev, ("ord >= 4", "2026-01-01 00:00:00"), ("ord in (0, 2)", "2026-01-01 01:00:00"), ("ord in (1, 3)", "2026-01-01 02:00:00"), ("ord = 1 and trace_id = 't1'", "2026-01-01 03:00:00"))
    newest, _ = run(spark, tmp_path, ev.withColumn("loaded_at", F.expr("timestamp_ntz'2026-01-01'")).schema, "state_times_any_order")
    assert {k: tuple(r)[5:] for k, r in newest.items()} == batch(ev)
    assert newest["t0", 1].ended and newest["t0", 1].events == 9 and newest["t1", 1].late == 0


def test_events_behind_the_watermark_and_ended_goroutines(spark, tmp_path):
    ev = table(spark, LIFE, LIFE[:6], LIFE)
    feed(
        tmp_path, ev, ("trace_id < 't2' and ord <> 2", "2026-01-01 00:00:00"), ("trace_id = 't2' and ord < 3", "2026-01-05 00:00:00"), ("trace_id = 't2' and ord in (3, 4)", "2026-01-09 00:00:00"),
        ("trace_id = 't1' and ord = 2", "2026-01-10 00:00:00"), ("trace_id = 't2' and ord > 4", "2026-01-12 00:00:00"),
    )
    newest, progress = run(spark, tmp_path, ev.withColumn("loaded_at", F.expr("timestamp_ntz'2026-01-01'")).schema, "state_times_late", "1 hour")
    whole = batch(ev)
    assert tuple(newest["t2", 1])[5:] == whole["t2", 1]
    assert newest["t1", 1].late == 1 and newest["t1", 1].events == 5  # its block came too late
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(states) == 3 and states[-1] < 3  # the ended one is forgotten


def test_counts_by_window(spark, tmp_path):
    rows = spark.createDataFrame([(14, "2026-01-01 00:10:00"), (14, "2026-01-01 00:50:00"), (15, "2026-01-01 01:10:00"), (14, "2026-01-09 00:00:00")], "type_id int, at string").selectExpr("type_id", "to_timestamp_ntz(at) as loaded_at")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = type_counts(stream).writeStream.outputMode("append").format("memory").queryName("type_counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((str(r.start), r.type_id, r.n) for r in spark.table("type_counts").collect()) == [("2026-01-01 00:00:00", 14, 2), ("2026-01-01 01:00:00", 15, 1)]
