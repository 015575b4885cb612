"""Session state over event streams: execution state, ledgers, budgets, dedup.

Every operator has a batch form over a table of events in order (columns
session, turn, seq) and, where state is kept between micro-batches, a streaming
form with the same results. Rows of a session are dealt by (session, turn), so
a long session is split by its turns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The state an event leads to; other events keep the state.
NEXT_STATE = {
    "turn_start": "locate", "scout_ready": "mutate", "scout_needs_evidence": "locate", "patch_retry": "repair", "patch_rescout": "locate",
    "patch_ready": "done", "verification_repair": "repair", "verification_rescout": "locate", "fatal": "safe_fail",
}
# What one turn may use.
BUDGETS = {"model_call": 4, "search_attempt": 6, "search": 4, "patch": 2}
EVIDENCE_BYTES, WALL_MS, NO_PROGRESS = 8_192, 120_000, 2


def _upto(order: str = "seq"):
    return Window.partitionBy("session", "turn").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def next_state(event: Column) -> Column:
    out = F.lit(None).cast("string")
    for e, s in NEXT_STATE.items():
        out = F.when(event == e, s).otherwise(out)
    return out


def states(events: DataFrame) -> DataFrame:
    """Events with the state after each; a turn begins in ``locate``."""
    return events.withColumn("state", F.coalesce(F.last(next_state(F.col("event")), ignorenulls=True).over(_upto()), F.lit("locate")))


def frontier(state: Column, intent: Column, rename_ready: Column, replace_ready: Column, active: Column) -> Column:
    """The one tool that may be called next; null if none."""
    by_intent = F.when((intent == "rename_symbol") & rename_ready, "execute_rename_symbol").when((intent == "generic_edit") & replace_ready, "execute_replace_node")
    sticky = F.when((active == "execute_rename_symbol") & rename_ready, active).when((active == "execute_replace_node") & replace_ready, active)
    return F.when(state == "locate", "search").when((state == "repair") & active.isNotNull(), sticky).when(state.isin("mutate", "repair"), by_intent)


def first_usage(usage: DataFrame) -> DataFrame:
    """The first report of each message in a turn."""
    w = Window.partitionBy("session", "turn", "message_id").orderBy("seq")
    return usage.where("message_id is not null").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def latched(snapshots: DataFrame) -> DataFrame:
    """One row per turn: the first snapshot's hash, and whether a later one drifted."""
    first = F.min(F.struct("seq", "hash"))["hash"]
    drift = F.countDistinct("hash") > 1
    return snapshots.groupBy("session", "turn").agg(first.alias("hash"), F.count("*").alias("n_snapshots"), drift.alias("drifted"))


def novelty(facts: DataFrame) -> DataFrame:
    """Facts (session, turn, seq, key) with ``novel``: the first time the turn sees the key."""
    w = Window.partitionBy("session", "turn", "key").orderBy("seq")
    return facts.withColumn("novel", F.row_number().over(w) == 1)


def progress(calls: DataFrame) -> DataFrame:
    """Calls (session, turn, seq, n_novel) with the streak of calls without novelty, and whether it blocks."""
    island = F.sum((F.col("n_novel") > 0).cast("int")).over(_upto())
    rows = calls.withColumn("island", island)
    streak = F.sum((F.col("n_novel") < 1).cast("int")).over(Window.partitionBy("session", "turn", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("streak", streak).withColumn("blocked", F.col("streak") >= NO_PROGRESS).drop("island")


def spent(events: DataFrame) -> DataFrame:
    """Events (session, turn, seq, event, n_bytes, ms) with what the turn has used so far, and whether it is over a budget."""
    w = _upto()
    rows = events
    over = F.lit(False)
    for e, most in BUDGETS.items():
        rows = rows.withColumn(f"n_{e}", F.count_if(F.col("event") == e).over(w))
        over = over | (F.col(f"n_{e}") > most)
    rows = rows.withColumns({"evidence_bytes": F.sum("n_bytes").over(w), "elapsed_ms": F.col("ms") - F.min("ms").over(w)})
    return rows.withColumn("over_budget", over | (F.col("evidence_bytes") > EVIDENCE_BYTES) | (F.col("elapsed_ms") > WALL_MS))


def changed_files(prints: DataFrame) -> DataFrame:
    """(session, turn, file, sha256): files whose content changed within a turn."""
    return prints.groupBy("session", "turn", "file").agg(F.countDistinct("sha256").alias("n")).where("n > 1").select("session", "turn", "file")


def handoff(turns: DataFrame) -> DataFrame:
    """blocked, partial or ready, with the reasons (columns n_files, drifted, changed, scan_complete, unread, evidence_complete)."""

    def reasons(*pairs):
        return F.array_compact(F.array(*(F.when(c, n) for n, c in pairs)))

    blocking = reasons(("no_selected_files", F.col("n_files") < 1), ("task_context_drift", F.col("drifted")), ("file_changed_during_turn", F.col("changed")))
    partial = reasons(("scan_incomplete", ~F.col("scan_complete")), ("unread_files", F.col("unread") > 0), ("evidence_incomplete", ~F.col("evidence_complete")))
    rows = turns.withColumns({"blocking_reasons": blocking, "partial_reasons": partial})
    status = F.when(F.size("blocking_reasons") > 0, "blocked").when(F.size("partial_reasons") > 0, "partial").otherwise("ready")
    return rows.withColumn("status", status)


def first_searches(searches: DataFrame) -> DataFrame:
    """Searches (session, turn, seq, signature) with ``duplicate``: the turn has asked the same before."""
    w = Window.partitionBy("session", "turn", "signature").orderBy("seq")
    return searches.withColumn("duplicate", F.row_number().over(w) > 1)


# What a turn may keep of its searches, how long an index is fresh, and how many sessions are tracked for how long.
CACHE_ENTRIES, CACHE_MATCHES, INDEX_TTL_MS, MOST_SESSIONS, SESSION_TTL_MS = 16, 4_000, 120_000, 256, 7_200_000


def _folded(rows: DataFrame, key: list[str], out: str, columns: list[str], one) -> DataFrame:
    """``one`` on the columns of each group in order of seq, where a row depends on all choices before it; returns a list of values."""
    import pyarrow as pa

    def fold(table):
        table = table.sort_by("seq")
        got = one(*(table.column(c).to_pylist() for c in columns))
        return table.select([*key, "seq"]).append_column(out, pa.array(got, pa.bool_()))

    slim = rows.select(*dict.fromkeys([*key, "seq", *columns]))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in (*key, "seq"))
    names = [f.name for f in slim.schema if f.name in (*key, "seq")]
    return slim.groupBy(*key).applyInArrow(lambda t: fold(t).select([*names, out]), f"{kind}, `{out}` boolean")


def reused_searches(searches: DataFrame, entries: int = CACHE_ENTRIES, matches: int = CACHE_MATCHES) -> DataFrame:
    """(session, turn, seq, signature, n_matches, cacheable) -> session, turn, seq, reused.

    A turn remembers results that were not cut by time or error while there is
    room for them; a result too large is passed over and may be asked for again.
    """

    def one(signatures, sizes, cacheable):
        kept, total, out = set(), 0, []
        for s, n, ok in zip(signatures, sizes, cacheable):
            out.append(s in kept)
            if s not in kept and ok and len(kept) < entries and total + n <= matches:
                kept.add(s)
                total += n
        return out

    return _folded(searches, ["session", "turn"], "reused", ["signature", "n_matches", "cacheable"], one)


def index_refreshes(queries: DataFrame, ttl_ms: int = INDEX_TTL_MS) -> DataFrame:
    """(session, seq, ms) -> session, seq, refreshed: a query refreshes the index if there is none or it is older than ``ttl_ms``."""

    def one(times):
        made, out = None, []
        for t in times:
            due = made is None or t - made > ttl_ms
            made = t if due else made
            out.append(due)
        return out

    return _folded(queries, ["session"], "refreshed", ["ms"], one)


def tracked_sessions(events: DataFrame, most: int = MOST_SESSIONS, ttl_ms: int = SESSION_TTL_MS) -> DataFrame:
    """(session, ms) -> session, last_ms of the sessions still tracked after the last event: the most recent ones, none older than ``ttl_ms``."""
    last = events.groupBy("session").agg(F.max("ms").alias("last_ms"))
    now = last.agg(F.max("last_ms").alias("now"))
    live = last.crossJoin(F.broadcast(now)).where(F.col("now") - F.col("last_ms") <= ttl_ms).drop("now")  # one row
    return live.orderBy(F.desc("last_ms"), "session").limit(most)


def latch_states(snapshots: DataFrame) -> DataFrame:
    """(session, turn, seq, hash, action, intent) with ``latch``: the first snapshot of a turn holds; another text is drift,
    and an action that is not the intent leaves the task unknown."""
    first = F.first("hash").over(Window.partitionBy("session", "turn").orderBy("seq"))
    n = F.row_number().over(Window.partitionBy("session", "turn").orderBy("seq"))
    rows = snapshots.withColumns({"first": first, "n": n})
    state = F.when(F.col("hash") != F.col("first"), "task_text_drift_same_turn").when(F.col("action").isNotNull() & (F.col("action") != F.col("intent")), "task_action_intent_mismatch").when(F.col("n") == 1, "latched").otherwise("kept")
    return rows.withColumn("latch", state).drop("first", "n")


def unwrapped(raw: DataFrame) -> DataFrame:
    """Host events as JSON text (column value), direct or in an envelope with a payload -> session, turn, seq, event."""
    kind = "session bigint, turn bigint, seq bigint, event string"
    both = F.from_json("value", f"{kind}, payload struct<{kind.replace(' bigint', ':bigint').replace(' string', ':string')}>")
    return raw.select(both.alias("e")).select(F.coalesce("e.payload", F.struct("e.session", "e.turn", "e.seq", "e.event")).alias("x")).select("x.*")


# --- the same, with state between micro-batches


def _stateful(stream: DataFrame, step, state: str, out: str, timeout_ms: int | None) -> DataFrame:
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState):
        if held.hasTimedOut:
            held.remove()
            return
        now = held.get if held.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        now, result = step(key, rows, now)
        held.update(now)
        if timeout_ms:
            held.setTimeoutDuration(timeout_ms)
        yield result

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("session", "turn").applyInPandasWithState(run, out, state, "append", kind)


def stream_states(events: DataFrame, ttl_ms: int = 7_200_000) -> DataFrame:
    """states() over a stream; a session without events for ``ttl_ms`` is forgotten."""

    def step(key, rows, now):
        state, out = now[0] if now else "locate", []
        for e in rows["event"]:
            state = NEXT_STATE.get(e, state)
            out.append(state)
        return (state,), rows.assign(state=out)[["session", "turn", "seq", "event", "state"]]

    return _stateful(events.select("session", "turn", "seq", "event"), step, "state string", "session bigint, turn bigint, seq bigint, event string, state string", ttl_ms)


def stream_progress(calls: DataFrame, ttl_ms: int = 7_200_000) -> DataFrame:
    """progress() over a stream."""

    def step(key, rows, now):
        streak, out = now[0] if now else 0, []
        for n in rows["n_novel"]:
            streak = 0 if n > 0 else streak + 1
            out.append(streak)
        rows = rows.assign(streak=out)
        rows["blocked"] = rows["streak"] >= NO_PROGRESS
        return (streak,), rows[["session", "turn", "seq", "n_novel", "streak", "blocked"]]

    return _stateful(calls.select("session", "turn", "seq", "n_novel"), step, "streak bigint", "session bigint, turn bigint, seq bigint, n_novel bigint, streak bigint, blocked boolean", ttl_ms)


def stream_first_usage(usage: DataFrame, late: str = "2 hours") -> DataFrame:
    """first_usage() over a stream with event time ``ts``: keys older than the watermark are forgotten."""
    return usage.where("message_id is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "turn", "message_id"])


def upsert_handoffs(stream: DataFrame, path: str, checkpoint: str, buckets: int = 16):
    """Keep the newest handoff of each session in a table dealt into buckets by session.

    A batch rewrites only the buckets it has rows of, then points to the new
    version at once; a batch that comes again after a failure changes nothing.
    """
    from corvane.sources.corpus import latest, publish, read_parts

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = latest(spark, path, "1") or {"epoch": -1, "parts": {}}
        rows = batch.withColumn("__bucket", F.pmod(F.xxhash64("session"), F.lit(buckets)).cast("int"))
        touched = [str(r[0]) for r in rows.select("__bucket").distinct().collect()]  # ``buckets`` rows at most
        if now["epoch"] >= epoch or not touched:
            return
        old = read_parts(spark, path, {k: v for k, v in now["parts"].items() if k in touched})
        if old is not None:
            rows = rows.unionByName(old.select(*batch.columns, F.pmod(F.xxhash64("session"), F.lit(buckets)).cast("int").alias("__bucket")))
        newest = F.max(F.struct("turn", F.struct(*rows.columns).alias("row")))["row"]
        name = uuid.uuid4().hex
        rows.groupBy("session").agg(newest.alias("row")).select("row.*").write.partitionBy("__bucket").parquet(f"{path}/data/{name}")
        publish(spark, path, "1", now["parts"] | dict.fromkeys(touched, name), epoch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
