"""Streams give what the batch operators give, over several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.streaming import sessions

EVENTS = [(s, t, i, e) for s in (1, 2) for t in (0, 1) for i, e in enumerate(["turn_start", "scout_ready", "other", "patch_retry", "patch_ready", "other"], 10 * t)]


def drained(spark, stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}_state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_states(spark, tmp_path):
    kind = "session bigint, turn bigint, seq bigint, event string"
    spark.createDataFrame(EVENTS, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    got = drained(spark, sessions.stream_states(stream), tmp_path, "states").select("session", "turn", "seq", "state")
    want = sessions.states(spark.createDataFrame(EVENTS, kind)).select("session", "turn", "seq", "state")
    assert sorted(got.collect()) == sorted(want.collect())
    assert {r.seq: r.state for r in want.where('session = 1 and turn = 0').collect()} == {0: 'locate', 1: 'mutate', 2: 'mutate', 3: 'repair', 4: 'done', 5: 'done'}


def test_progress(spark, tmp_path):
    rows = [(1, 0, i, n) for i, n in enumerate([1, 0, 0, 2, 0, 0, 0])]
    kind = "session bigint, turn bigint, seq bigint, n_novel bigint"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    got = {r.seq: (r.streak, r.blocked) for r in drained(spark, sessions.stream_progress(stream), tmp_path, "progress").collect()}
    assert got == {0: (0, False), 1: (1, False), 2: (2, True), 3: (0, False), 4: (1, False), 5: (2, True), 6: (3, True)}
    batch = {r.seq: (r.streak, r.blocked) for r in sessions.progress(spark.createDataFrame(rows, kind)).collect()}
    assert batch == got


def test_first_usage(spark, tmp_path):
    kind = "session bigint, turn bigint, seq bigint, message_id string, ts timestamp"
    rows = spark.range(20).select(F.lit(1).cast("long").alias("session"), F.lit(0).cast("long").alias("turn"), F.col("id").alias("seq"), F.concat(F.lit("m"), F.col("id") % 4).alias("message_id"), F.current_timestamp().alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    assert drained(spark, sessions.stream_first_usage(stream), tmp_path, "usage").count() == 4


def test_handoffs(spark, tmp_path):
    from corvane.sources.corpus import read_snapshot

    kind = "session bigint, turn bigint, status string"
    out = str(tmp_path / "out")
    for rows in ([(1, 0, "blocked"), (1, 1, "ready"), (2, 0, "partial")], [(2, 1, "ready"), (3, 0, "ready")], [(3, 1, "blocked")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = sessions.upsert_handoffs(stream, out, str(tmp_path / "cp"), 2).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(tuple(r) for r in read_snapshot(spark, out, "1").select("session", "turn", "status").collect()) == [(1, 1, "ready"), (2, 1, "ready"), (3, 1, "blocked")]
    assert len(list((tmp_path / "out" / "pointers").glob("*.json"))) == 2  # older ones go


def test_trace(spark, tmp_path):
    from corvane.sources.corpus import append_trace

    for n in (2, 3):
        append_trace(spark.range(n), str(tmp_path / "trace"))
    assert spark.read.json(str(tmp_path / "trace")).count() == 5


def test_folds_keep_order(spark):
    kind = "session bigint, turn bigint, seq bigint, signature string, n_matches int, cacheable boolean"
    rows = [(1, 0, 1, "a", 5, True), (1, 0, 2, "a", 5, True), (1, 0, 3, "b", 99, True), (1, 0, 4, "b", 99, True), (1, 0, 5, "c", 1, False), (1, 0, 6, "c", 1, True), (1, 0, 7, "c", 1, True)]
    got = {r.seq: r.reused for r in sessions.reused_searches(spark.createDataFrame(rows, kind), matches=10).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False, 7: True}
    times = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 50, 101, 201, 202])], "session bigint, seq bigint, ms bigint")
    assert [r.refreshed for r in sessions.index_refreshes(times, 100).orderBy("seq").collect()] == [True, False, True, False, True]
