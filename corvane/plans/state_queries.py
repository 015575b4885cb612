"""Queries of ranges, graphs, sessions, checks and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import imports, paths, python_ast, tasks, text
from corvane.operators import evidence, graph, ranges, scoring, verify
from corvane.query import query, table
from corvane.streaming import sessions

# --- ranges: one per event, on a line of the user's file


def _ranges(spark, d):
    e = table(spark, d, "events")
    start = F.col("event_id") * 7 % 997 + 1
    return e.select(F.concat(F.lit("u"), "user_id").alias("file"), F.col("event_id").alias("id"), start.alias("start"), (start + F.col("event_id") % 9).alias("end"), "event_type")


_R = "(SELECT 'u' || user_id AS file, event_id AS id, event_id * 7 % 997 + 1 AS s, event_id * 7 % 997 + 1 + event_id % 9 AS e, event_type FROM events)"


def _merged(rows: str) -> str:
    return f"""(SELECT file, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM (SELECT *, sum((pe IS NULL OR s > pe + 1)::INT) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {rows})) GROUP BY file, island)"""


@query("range_merged", f"SELECT file, s AS start_line, e AS end_line FROM {_merged(_R)}")
def merged(spark, d):
    return ranges.merged(_ranges(spark, d)).select("file", F.col("start").alias("start_line"), F.col("end").alias("end_line"))


@query("range_from_lines", f"SELECT file, min(s)::BIGINT AS start_line, max(s)::BIGINT AS end_line FROM (SELECT file, s, s - row_number() OVER (PARTITION BY file ORDER BY s) AS island FROM (SELECT DISTINCT file, s FROM {_R})) GROUP BY file, island")
def from_lines(spark, d):
    return ranges.from_lines(_ranges(spark, d).withColumnRenamed("start", "line")).select("file", F.col("start").alias("start_line"), F.col("end").alias("end_line"))


@query("range_subtracted", f"""WITH a AS (SELECT DISTINCT file, unnest(range(s, e + 1)) AS line FROM {_R} WHERE event_type <> 'click'), b AS (SELECT DISTINCT file, unnest(range(s, e + 1)) AS line FROM {_R} WHERE event_type = 'click'),
    x AS (SELECT * FROM a EXCEPT SELECT * FROM b) SELECT file, min(line)::BIGINT AS start_line, max(line)::BIGINT AS end_line FROM (SELECT *, line - row_number() OVER (PARTITION BY file ORDER BY line) AS island FROM x) GROUP BY file, island""")
def subtracted(spark, d):
    r = _ranges(spark, d)
    return ranges.subtracted(r.where("event_type <> 'click'"), r.where("event_type = 'click'")).select("file", F.col("start").alias("start_line"), F.col("end").alias("end_line"))


@query("range_prefix_budget", "SELECT user_id, event_id FROM (SELECT *, sum(strlen(props) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent <= 900")
def prefix_budget(spark, d):
    return ranges.prefix_budget(table(spark, d, "events"), ["user_id"], ["event_id"], F.octet_length("props") + 1, 900).select("user_id", "event_id")


@query("range_greedy_budget", """WITH RECURSIVE o AS (SELECT user_id, event_id, event_id % 13 + 1 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f AS (SELECT user_id, event_id, rn, CASE WHEN cost <= 40 THEN cost ELSE 0 END AS spent, cost <= 40 AS kept FROM o WHERE rn = 1
    UNION ALL SELECT o.user_id, o.event_id, o.rn, CASE WHEN spent + cost <= 40 THEN spent + cost ELSE spent END, spent + cost <= 40 FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
    SELECT user_id, event_id FROM f WHERE kept""")
def greedy_budget(spark, d):
    return ranges.greedy_budget(table(spark, d, "events"), ["user_id"], ["event_id"], F.col("event_id") % 13 + 1, 40).select("user_id", "event_id")


@query("range_sampled", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i = 1 OR i = n OR i = (n - 1) // 2 + 1")
def sampled(spark, d):
    return ranges.sampled(table(spark, d, "events"), ["user_id"], "event_id").select("user_id", "event_id")


_OUT = f"(SELECT file, id AS o_id, s - 3 AS o_start, e + id % 5 AS o_end FROM {_R} WHERE event_type = 'view')"
_IN = f"(SELECT file, id AS i_id, s AS i_start, e AS i_end FROM {_R} WHERE event_type = 'click')"


def _inner_outer(spark, d):
    r = _ranges(spark, d)
    i = r.where("event_type = 'click'").select("file", F.col("id").alias("i_id"), F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    o = r.where("event_type = 'view'").select("file", F.col("id").alias("o_id"), (F.col("start") - 3).alias("o_start"), (F.col("end") + F.col("id") % 5).alias("o_end"), F.concat(F.lit("n"), "id").alias("name"))
    return i, o


@query("range_tightest", f"SELECT file, i_id, o_id FROM (SELECT *, row_number() OVER (PARTITION BY i_id ORDER BY o_end - o_start, o_id) AS rn FROM {_IN} JOIN {_OUT} USING (file) WHERE o_start <= i_start AND o_end >= i_end) WHERE rn = 1")
def tightest(spark, d):
    return ranges.tightest(*_inner_outer(spark, d)).select("file", "i_id", "o_id")


@query("range_owners", f"SELECT file, i_id, string_agg('n' || o_id, '::' ORDER BY o_start - o_end, o_start, 'n' || o_id) AS owner, count(*) AS depth FROM {_IN} JOIN {_OUT} USING (file) WHERE o_start <= i_start AND o_end >= i_end AND o_end - o_start > i_end - i_start GROUP BY file, i_id")
def owners(spark, d):
    return ranges.owners(*_inner_outer(spark, d))


@query("range_nearest", f"SELECT a.file, a.s AS line, min(abs(a.s - b.s))::BIGINT AS distance FROM (SELECT DISTINCT file, s FROM {_R} WHERE event_type = 'click') a JOIN (SELECT file, s FROM {_R} WHERE event_type = 'purchase') b USING (file) GROUP BY a.file, a.s HAVING min(abs(a.s - b.s)) <= 96")
def nearest(spark, d):
    r = _ranges(spark, d).withColumnRenamed("start", "line")
    return ranges.nearest(r.where("event_type = 'click'").select("file", "line").distinct(), r.where("event_type = 'purchase'"), 96)


@query("range_most_specific", f"SELECT file, id FROM {_R} a WHERE NOT EXISTS (SELECT 1 FROM {_R} b WHERE a.file = b.file AND a.s <= b.s AND a.e >= b.e AND a.e - a.s > b.e - b.s)")
def most_specific(spark, d):
    return ranges.most_specific(_ranges(spark, d)).select("file", "id")


_SC = f"(SELECT file, s // 100 * 100 + 1 AS start_line, s // 100 * 100 + 100 AS end_line, CASE WHEN id % 5 = 0 THEN '<module>' ELSE event_type END AS name, CASE id % 4 WHEN 0 THEN 'call' WHEN 1 THEN 'import' WHEN 2 THEN 'assignment' ELSE 'other' END AS role, id % 3 AS query, s AS line FROM {_R})"


@query("evidence_scopes", f"SELECT file, start_line, end_line, name, max(CASE role WHEN 'call' THEN 5 WHEN 'assignment' THEN 4 WHEN 'import' THEN 2 ELSE 0 END)::INT AS role_score, count(DISTINCT query)::INT AS n_queries, count(*) AS hit_count, count(DISTINCT line)::INT AS n_lines FROM {_SC} WHERE name <> '<module>' GROUP BY ALL")
def scopes(spark, d):
    r = _ranges(spark, d)
    role = F.when(F.col("id") % 4 == 0, "call").when(F.col("id") % 4 == 1, "import").when(F.col("id") % 4 == 2, "assignment").otherwise("other")
    first = F.floor((F.col("start")) / 100) * 100
    rows = r.select("file", (first + 1).alias("start_line"), (first + 100).alias("end_line"), F.lit("scope").alias("kind"), F.when(F.col("id") % 5 == 0, "<module>").otherwise(F.col("event_type")).alias("name"), role.alias("role"), (F.col("id") % 3).alias("query"), F.col("start").alias("line"))
    g = rows.groupBy("file", "start_line", "end_line", "kind", "name", "role").agg(F.count("*").alias("hit_count"), F.collect_set("query").alias("queries"), F.collect_set("line").alias("lines"))
    return evidence.scopes(g).drop("kind")


@query("evidence_distinct_spans", f"SELECT file, s AS start_byte, e AS end_byte, min(id % 4)::INT AS query FROM {_R} GROUP BY file, s, e")
def distinct_spans(spark, d):
    r = _ranges(spark, d).select("file", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), (F.col("id") % 4).cast("int").alias("query"))
    return evidence.distinct_spans(r)


# --- graph: suppliers point to the parts they ship

_E = "(SELECT DISTINCT 's' || l_suppkey AS f, 'p' || l_partkey AS t, l_returnflag AS kind, l_linenumber::BIGINT AS witness_line, '' AS spec FROM lineitem)"
_SEEDS = [("s3", 0), ("p5", 1), ("s1", 2), ("p77", 3)]


def _edges(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("from"), F.concat(F.lit("p"), "l_partkey").alias("to"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").cast("long").alias("witness_line"), F.lit("").alias("spec")).distinct()


@query("graph_neighbors", f"""WITH e AS (SELECT * FROM {_E}), s(seed, position) AS (VALUES ('s3', 0), ('p5', 1), ('s1', 2), ('p77', 3)),
    r AS (SELECT seed, position, 'forward' AS direction, t AS file, kind, witness_line FROM e JOIN s ON f = seed UNION ALL SELECT seed, position, 'reverse', f, kind, witness_line FROM e JOIN s ON t = seed),
    n AS (SELECT *, row_number() OVER (PARTITION BY seed, direction ORDER BY file, kind, witness_line) AS turn, count(*) OVER () AS total FROM r)
    SELECT seed, direction, file, kind, witness_line, total FROM n ORDER BY turn, position, direction LIMIT 24""")
def neighbors(spark, d):
    seeds = spark.createDataFrame(_SEEDS, "seed string, position int")
    return graph.neighbors(_edges(spark, d), F.broadcast(seeds)).select("seed", "direction", "file", "kind", "witness_line", "total")


@query("graph_refresh_plan", """WITH o AS (SELECT c_custkey AS id, c_nationkey AS b FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey AS id, c_nationkey + (c_custkey % 11 = 0)::INT AS b FROM customer WHERE c_custkey % 7 <> 0)
    SELECT 'c' || coalesce(o.id, n.id) AS file, CASE WHEN n.id IS NULL THEN 'remove' WHEN o.b = n.b THEN 'reuse' ELSE 'reindex' END AS action FROM o FULL JOIN n USING (id)""")
def refresh_plan(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("file"), "c_custkey", F.col("c_nationkey").alias("n_bytes"), F.lit(0).alias("mtime_ms"))
    new = c.where("c_custkey % 7 <> 0").withColumn("n_bytes", F.col("n_bytes") + (F.col("c_custkey") % 11 == 0).cast("int"))
    return graph.refresh_plan(c.where("c_custkey % 5 <> 0"), new)


@query("graph_lexical_misses", f"SELECT DISTINCT t AS file FROM {_E} WHERE t NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_size < 25)")
def lexical_misses(spark, d):
    lexical = table(spark, d, "part").where("p_size < 25").select(F.concat(F.lit("p"), "p_partkey").alias("file"))
    return graph.lexical_misses(_edges(spark, d).select(F.col("to").alias("file")).distinct(), lexical)


@query("graph_hypotheses", """WITH rel AS (SELECT 's' || l_suppkey AS seed, 'p' || l_partkey AS file, CASE WHEN l_linenumber % 2 = 0 THEN 'forward' ELSE 'reverse' END AS direction, 'n' || (l_partkey % 7) AS local, 'm' || (l_partkey % 5) AS source FROM lineitem WHERE l_returnflag <> 'N'),
    m AS (SELECT file, direction, 1 AS query, CASE WHEN direction = 'forward' THEN source ELSE local END AS symbol FROM rel WHERE seed IN ('s1', 's2') AND ((direction = 'forward' AND local IN ('n1', 'n2')) OR (direction = 'reverse' AND source IN ('m3'))))
    SELECT file, direction, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM m GROUP BY file, direction ORDER BY direction, count(DISTINCT symbol) DESC, file LIMIT 2""")
def hypotheses(spark, d):
    li = table(spark, d, "lineitem")
    rel = li.select(F.concat(F.lit("s"), "l_suppkey").alias("seed"), F.concat(F.lit("p"), "l_partkey").alias("file"), F.when(F.col("l_linenumber") % 2 == 0, "forward").otherwise("reverse").alias("direction"), F.concat(F.lit("n"), F.col("l_partkey") % 7).alias("local"), F.concat(F.lit("m"), F.col("l_partkey") % 5).alias("source"), F.when(F.col("l_returnflag") != "N", "exact_local").otherwise("loose").alias("confidence"))
    seeds = spark.createDataFrame([("s1", 1, ["n1", "n2"], ["m3"]), ("s2", 1, ["n1", "n2"], ["m3"])], "seed string, query int, identifiers array<string>, owners array<string>")
    none = spark.createDataFrame([], "file string")
    return graph.hypotheses(rel, F.broadcast(seeds), none).select("file", "direction", F.array_join("symbols", ",").alias("symbols"))


# --- sessions: a user is a session, an hour bucket a turn

EVENTS = list(sessions.NEXT_STATE) + ["other"]
_ev = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EVENTS)) + " END"
_st = "CASE ev " + " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in sessions.NEXT_STATE.items()) + " END"
_T = f"(SELECT user_id AS session, event_id // 700 AS turn, event_id AS seq, event_type, props, value, epoch_us(ts) // 1000 AS ms, {_ev} AS ev FROM events)"


def _events(spark, d):
    e = table(spark, d, "events")
    name = F.element_at(F.array(*map(F.lit, EVENTS)), (F.col("event_id") % 10 + 1).cast("int"))
    return e.select(F.col("user_id").alias("session"), F.expr("event_id div 700").alias("turn"), F.col("event_id").alias("seq"), "event_type", "props", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), name.alias("event"))


@query("session_states", f"SELECT session, turn, seq, coalesce(last_value({_st} IGNORE NULLS) OVER (PARTITION BY session, turn ORDER BY seq ROWS UNBOUNDED PRECEDING), 'locate') AS state FROM {_T}")
def session_states(spark, d):
    return sessions.states(_events(spark, d)).select("session", "turn", "seq", "state")


@query("session_first_usage", f"SELECT session, turn, min(seq) AS seq, event_type AS message_id FROM {_T} GROUP BY session, turn, event_type")
def first_usage(spark, d):
    return sessions.first_usage(_events(spark, d).withColumnRenamed("event_type", "message_id")).select("session", "turn", "seq", "message_id")


@query("session_latched", f"SELECT session, turn, arg_min(event_type, seq) AS hash, count(*) AS n_snapshots, count(DISTINCT event_type) > 1 AS drifted FROM {_T} GROUP BY session, turn")
def latched(spark, d):
    return sessions.latched(_events(spark, d).withColumnRenamed("event_type", "hash"))


@query("session_novelty", f"SELECT session, turn, seq, row_number() OVER (PARTITION BY session, turn, ev ORDER BY seq) = 1 AS novel FROM {_T}")
def novelty(spark, d):
    return sessions.novelty(_events(spark, d).withColumnRenamed("event", "key")).select("session", "turn", "seq", "novel")


@query("session_progress", f"""WITH c AS (SELECT session, turn, seq, (event_type IN ('purchase', 'signup'))::BIGINT AS n_novel FROM {_T}),
    i AS (SELECT *, sum(n_novel) OVER (PARTITION BY session, turn ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM c),
    s AS (SELECT *, sum((n_novel < 1)::BIGINT) OVER (PARTITION BY session, turn, island ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM i)
    SELECT session, turn, seq, streak, streak >= 2 AS blocked FROM s""")
def progress(spark, d):
    calls = _events(spark, d).withColumn("n_novel", F.col("event_type").isin("purchase", "signup").cast("long"))
    return sessions.progress(calls).select("session", "turn", "seq", "streak", "blocked")


@query("session_budgets", f"""WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'model_call' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'patch' ELSE 'search_attempt' END AS k, strlen(props) AS n FROM {_T}),
    w AS (SELECT session, turn, seq, count(*) FILTER (k = 'model_call') OVER r AS a, count(*) FILTER (k = 'search_attempt') OVER r AS b, count(*) FILTER (k = 'search') OVER r AS c, count(*) FILTER (k = 'patch') OVER r AS p,
    sum(n) OVER r AS bytes, ms - min(ms) OVER r AS elapsed FROM e WINDOW r AS (PARTITION BY session, turn ORDER BY seq ROWS UNBOUNDED PRECEDING))
    SELECT session, turn, seq, bytes::BIGINT AS evidence_bytes, elapsed::BIGINT AS elapsed_ms, (a > 4 OR b > 6 OR c > 4 OR p > 2 OR bytes > 8192 OR elapsed > 120000) AS over_budget FROM w""")
def budgets(spark, d):
    kind = F.when(F.col("event_type") == "view", "model_call").when(F.col("event_type") == "click", "search").when(F.col("event_type") == "purchase", "patch").otherwise("search_attempt")
    rows = _events(spark, d).withColumns({"event": kind, "n_bytes": F.octet_length("props").cast("long")})
    return sessions.spent(rows).select("session", "turn", "seq", "evidence_bytes", "elapsed_ms", "over_budget")


@query("session_changed_files", f"SELECT session, turn, event_type AS file FROM {_T} GROUP BY session, turn, event_type HAVING count(DISTINCT ev) > 1")
def changed_files(spark, d):
    return sessions.changed_files(_events(spark, d).withColumnRenamed("event_type", "file").withColumnRenamed("event", "sha256"))


@query("session_duplicate_searches", f"SELECT session, turn, seq, row_number() OVER (PARTITION BY session, turn, event_type ORDER BY seq) > 1 AS duplicate FROM {_T}")
def duplicate_searches(spark, d):
    sig = text.search_signature(F.array("event_type"), F.lit("."), F.lit(None).cast("string"))
    return sessions.first_searches(_events(spark, d).withColumn("signature", sig)).select("session", "turn", "seq", "duplicate")


@query("session_handoff", f"""WITH t AS (SELECT session, turn, count(DISTINCT event_type) - 1 AS n_files, count(*) > 12 AS drifted, bool_or(event_type = 'error') AS changed, bool_or(event_type = 'view') AS scan_complete, count(*) % 3 AS unread, count(*) % 2 = 0 AS evidence_complete FROM {_T} GROUP BY ALL)
    SELECT session, turn, CASE WHEN n_files < 1 OR drifted OR changed THEN 'blocked' WHEN NOT scan_complete OR unread > 0 OR NOT evidence_complete THEN 'partial' ELSE 'ready' END AS status,
    concat_ws(',', CASE WHEN n_files < 1 THEN 'no_selected_files' END, CASE WHEN drifted THEN 'task_context_drift' END, CASE WHEN changed THEN 'file_changed_during_turn' END) AS blocking,
    concat_ws(',', CASE WHEN NOT scan_complete THEN 'scan_incomplete' END, CASE WHEN unread > 0 THEN 'unread_files' END, CASE WHEN NOT evidence_complete THEN 'evidence_incomplete' END) AS partial FROM t""")
def handoff(spark, d):
    t = _events(spark, d).groupBy("session", "turn").agg(
        (F.countDistinct("event_type") - 1).alias("n_files"), (F.count("*") > 12).alias("drifted"), F.bool_or(F.col("event_type") == "error").alias("changed"),
        F.bool_or(F.col("event_type") == "view").alias("scan_complete"), (F.count("*") % 3).alias("unread"), (F.count("*") % 2 == 0).alias("evidence_complete"),
    )
    return sessions.handoff(t).select("session", "turn", "status", F.array_join("blocking_reasons", ",").alias("blocking"), F.array_join("partial_reasons", ",").alias("partial"))


_SEARCHES = "(SELECT session, turn, seq, event_type || (seq % 3) AS k, seq % 900 AS n, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY session, turn ORDER BY seq) AS rn FROM {t})".format(t=_T)


@query("session_reused_searches", f"""WITH RECURSIVE s AS MATERIALIZED {_SEARCHES}, f AS (SELECT session, turn, seq, rn, false AS reused, CASE WHEN ok AND n <= 1500 THEN [k] ELSE []::VARCHAR[] END AS kept, CASE WHEN ok AND n <= 1500 THEN n ELSE 0 END AS total FROM s WHERE rn = 1
    UNION ALL SELECT s.session, s.turn, s.seq, s.rn, list_contains(kept, k), CASE WHEN NOT list_contains(kept, k) AND ok AND len(kept) < 4 AND total + n <= 1500 THEN list_append(kept, k) ELSE kept END, CASE WHEN NOT list_contains(kept, k) AND ok AND len(kept) < 4 AND total + n <= 1500 THEN total + n ELSE total END
    FROM f JOIN s ON s.session = f.session AND s.turn = f.turn AND s.rn = f.rn + 1) SELECT session, turn, seq, reused FROM f""")
def reused_searches(spark, d):
    n = F.col("seq")
    rows = _events(spark, d).select("session", "turn", "seq", F.concat("event_type", n % 3).alias("signature"), (n % 900).alias("n_matches"), (F.col("event_type") != "error").alias("cacheable"))
    return sessions.reused_searches(rows, 4, 1500)


@query("session_index_refreshes", f"""WITH RECURSIVE s AS MATERIALIZED (SELECT session, seq, ms, row_number() OVER (PARTITION BY session ORDER BY seq) AS rn FROM {_T}), f AS (SELECT session, seq, rn, true AS refreshed, ms AS made FROM s WHERE rn = 1
    UNION ALL SELECT s.session, s.seq, s.rn, s.ms - made > 120000, CASE WHEN s.ms - made > 120000 THEN s.ms ELSE made END FROM f JOIN s ON s.session = f.session AND s.rn = f.rn + 1) SELECT session, seq, refreshed FROM f""")
def index_refreshes(spark, d):
    return sessions.index_refreshes(_events(spark, d))


@query("session_tracked", f"SELECT session, last_ms FROM (SELECT session, max(ms) AS last_ms FROM {_T} GROUP BY session) WHERE (SELECT max(ms) FROM {_T}) - last_ms <= 36000000 ORDER BY last_ms DESC, session LIMIT 25")
def tracked(spark, d):
    return sessions.tracked_sessions(_events(spark, d), 25, 36_000_000)


@query("session_latch_states", f"""SELECT session, turn, seq, CASE WHEN event_type <> first_value(event_type) OVER w THEN 'task_text_drift_same_turn' WHEN seq % 5 = 0 THEN 'task_action_intent_mismatch' WHEN row_number() OVER w = 1 THEN 'latched' ELSE 'kept' END AS latch FROM {_T} WINDOW w AS (PARTITION BY session, turn ORDER BY seq)""")
def latch_states(spark, d):
    rows = _events(spark, d).select("session", "turn", "seq", F.col("event_type").alias("hash"), F.when(F.col("seq") % 5 == 0, "rename_symbol").when(F.col("seq") % 5 == 1, "generic_edit").alias("action"), F.lit("generic_edit").alias("intent"))
    return sessions.latch_states(rows).select("session", "turn", "seq", "latch")


@query("session_host_events", f"SELECT session, turn, seq, ev AS event FROM {_T}")
def host_events(spark, d):
    """Every second event comes in an envelope."""
    rows = _events(spark, d).select("session", "turn", "seq", "event")
    whole = F.struct("session", "turn", "seq", "event")
    text_of = F.when(F.col("seq") % 2 == 0, F.to_json(whole)).otherwise(F.to_json(F.struct(F.lit("x").alias("type"), whole.alias("payload"))))
    return sessions.unwrapped(rows.select(text_of.alias("value")))


# --- checks


def _pairs(spark, d):
    """Candidate edits of documents: a rename, and for some a changed line end or a trailing blank."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("before"))
    after = F.replace("before", F.lit("that"), F.lit("that_new"))
    after = F.when(F.col("id") % 5 == 0, F.replace(after, F.lit("\n"), F.lit("\r\n"))).when(F.col("id") % 7 == 0, F.concat(after, F.lit("\nx  "))).otherwise(after)
    return docs.withColumn("after", after)


_P = "(SELECT doc_id AS id, text AS before, CASE WHEN doc_id % 5 = 0 THEN replace(replace(text, 'that', 'that_new'), chr(10), chr(13) || chr(10)) WHEN doc_id % 7 = 0 THEN replace(text, 'that', 'that_new') || chr(10) || 'x  ' ELSE replace(text, 'that', 'that_new') END AS after FROM documents)"


def _kind(c: str) -> str:
    n = f"(strlen({c}) - strlen(replace({c}, chr(10), '')))"
    crlf = f"((strlen({c}) - strlen(replace({c}, chr(13) || chr(10), ''))) // 2)"
    cr = f"(strlen({c}) - strlen(replace({c}, chr(13), '')) - {crlf})"
    return f"CASE WHEN {cr} > 0 THEN 'bare_cr' WHEN {crlf} > 0 AND {n} - {crlf} > 0 THEN 'mixed' WHEN {crlf} > 0 THEN 'crlf' WHEN {n} > 0 THEN 'lf' ELSE 'none' END"


@query("check_eol_kinds", f"SELECT id, {_kind('before')} AS before_eol, {_kind('after')} AS after_eol FROM {_P}")
def eol_kinds(spark, d):
    return _pairs(spark, d).select("id", text.eol_kind(F.col("before")).alias("before_eol"), text.eol_kind(F.col("after")).alias("after_eol"))


_blank = "len(list_filter(string_split({c}, chr(10)), lambda x: regexp_matches(x, '[ \\t]+\\r?$')))"


@query("check_hygiene", f"""WITH k AS (SELECT id, {_kind('before')} AS a, {_kind('after')} AS b, {_blank.format(c='after')} > {_blank.format(c='before')} AS more FROM {_P}), c AS (SELECT *, a = b OR (a = 'none' AND b IN ('lf', 'crlf')) AS ok FROM k)
    SELECT id, 'hygiene' AS kind, ok AND NOT more AS pass, CASE WHEN NOT ok THEN 'eol_changed' WHEN more THEN 'trailing_whitespace_added' END AS detail FROM c""")
def hygiene(spark, d):
    return verify.hygiene_checks(_pairs(spark, d))


_words = "len(list_filter(regexp_extract_all({c}, '[A-Za-z_$][A-Za-z0-9_$]*'), lambda x: x = '{w}'))"


@query("check_rename", f"""WITH c AS (SELECT id, {_words.format(c='before', w='that')} AS b_old, {_words.format(c='after', w='that')} AS a_old, {_words.format(c='before', w='that_new')} AS b_new, {_words.format(c='after', w='that_new')} AS a_new FROM {_P})
    SELECT id, (b_old - a_old)::BIGINT AS removed, (a_new - b_new)::BIGINT AS added, b_new = 0 AS destination_fresh, (b_old - a_old > 0 AND b_old - a_old = a_new - b_new AND a_old = 0) AS pass FROM c""")
def rename(spark, d):
    rows = _pairs(spark, d).withColumns({"file": F.lit("f"), "old_name": F.lit("that"), "new_name": F.lit("that_new")})
    return verify.rename_checks(rows)


@query("check_unique_text", "SELECT doc_id, least((length(text) - length(replace(text, 'MIT', ''))) // 3, 2)::INT AS n FROM documents")
def unique_text(spark, d):
    return table(spark, d, "documents").select("doc_id", verify.bounded_count(F.col("text"), F.lit("MIT")).alias("n"))


def _proof(spark, d):
    kinds = F.array(*map(F.lit, sorted(verify.OBLIGATIONS)))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.element_at(kinds, (F.col("l_partkey") % 8 + 1).cast("int")).alias("kind"), (F.col("l_suppkey") % 50 != 0).alias("pass"))


_obl = ", ".join(f"('{k}', '{v}')" for k, v in verify.OBLIGATIONS.items())
_kinds = "[" + ", ".join(f"'{k}'" for k in sorted(verify.OBLIGATIONS)) + "]"


@query("check_proof", f"""WITH g AS (SELECT l_orderkey AS id, {_kinds}[l_partkey % 8 + 1] AS kind, bool_and(l_suppkey % 50 <> 0) AS ok FROM lineitem GROUP BY ALL),
    e AS (SELECT i.id, o.kind, o.disposition FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem) i CROSS JOIN (VALUES {_obl}) o(kind, disposition)), r AS (SELECT e.*, coalesce(ok, false) AS ok FROM e LEFT JOIN g USING (id, kind))
    SELECT id, bool_and(ok) AS verified, coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (NOT ok), '') AS failed, CASE WHEN bool_or(NOT ok AND disposition = 'fatal') THEN 'fatal' WHEN bool_or(NOT ok AND disposition = 'rescout') THEN 'rescout' WHEN bool_or(NOT ok) THEN 'repair' END AS disposition FROM r GROUP BY id""")
def proof(spark, d):
    return verify.assessed(_proof(spark, d))


@query("check_receipts", "SELECT doc_id AS id, sha256(text) AS patch_sha256, sha256(doc_id || '|' || sha256(text) || '|' || (doc_id % 3 = 0)) AS receipt_sha256, doc_id % 3 = 0 AS verified FROM documents")
def receipts(spark, d):
    return verify.receipts(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("patch"), (F.col("doc_id") % 3 == 0).alias("verified")))


@query("check_authorized", """SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 OR doc_id % 4 = 0 OR doc_id % 5 = 0 THEN 'ABSTAIN' ELSE 'CERTIFY' END AS decision,
    CASE WHEN doc_id % 3 <> 0 THEN 'proof_incomplete' WHEN doc_id % 4 = 0 THEN 'receipt_missing' WHEN doc_id % 5 = 0 THEN 'receipt_mismatch' END AS reason FROM documents""")
def authorized(spark, d):
    r = receipts(spark, d)
    claimed = r.select("id", F.when(F.col("id") % 5 == 0, "0").otherwise(F.col("receipt_sha256")).alias("claimed_sha256"))
    return verify.authorized(r.select("id", "verified"), r.where("id % 4 <> 0").drop("verified"), claimed)


@query("check_live_candidates", "SELECT doc_id % 40 AS set_id, bool_and(doc_id % 9 <> 0 OR doc_id % 40 > 20) AS accepted, count(*) AS n FROM documents GROUP BY 1")
def live_candidates(spark, d):
    docs = table(spark, d, "documents").withColumn("file", F.col("doc_id").cast("string"))
    stale = (F.col("doc_id") % 9 == 0) & (F.col("doc_id") % 40 <= 20)
    cand = docs.select((F.col("doc_id") % 40).alias("set_id"), "file", F.when(stale, "0").otherwise(F.sha2("text", 256)).alias("sha256"), F.lit(1).alias("start"), F.lit(1).alias("end"))
    return verify.live_candidates(cand, docs.select("file", F.col("text").alias("source")), docs.select("file", F.size(F.split("text", "\n")).alias("n_lines")))


@query("set_same_files", "SELECT 'c' || c_custkey AS file, 'missing' AS side FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 <> 0 UNION ALL SELECT 'c' || c_custkey, 'extra' FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 = 0")
def same_files(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("file"), "c_custkey")
    return verify.same_files(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 4 = 0"))


@query("set_distinct_mutations", "SELECT file, kind, before, after FROM (SELECT DISTINCT 'p' || (p_partkey % 50) AS file, p_brand AS kind, p_type AS before, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'new' END AS after FROM part) WHERE before <> after")
def distinct_mutations(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.concat(F.lit("p"), F.col("p_partkey") % 50).alias("file"), F.col("p_brand").alias("kind"), F.col("p_type").alias("before"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("new").alias("after"))
    return verify.without_duplicates(rows).drop("key")


# --- scores: orders are cases of tasks, a priority is a system

_role = "CASE c_custkey % 3 WHEN 0 THEN 'product' WHEN 1 THEN 'safety' ELSE 'contract' END"
_out = "CASE (o_orderkey * 7) % 11 WHEN 0 THEN 'ENV_FAIL' WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'SAFE_FAIL' WHEN 3 THEN 'PASS' ELSE CASE o_custkey % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'SAFE_FAIL' ELSE 'PASS' END END"
_C = f"(SELECT o_orderpriority AS system, o_custkey AS id, {_out} AS outcome, o_orderkey % 97 = 0 AS fv, (o_orderkey % 50) / 10.0::DOUBLE AS cpu, o_orderkey % 4 AS calls FROM orders)"


def _cases(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("system"), F.col("o_custkey").alias("id"), F.expr(_out).alias("outcome"), (F.col("o_orderkey") % 97 == 0).alias("false_verified"), ((F.col("o_orderkey") % 50) / 10).alias("cpu_seconds"), ((F.col("o_orderkey") % 50) / 10).alias("wall_seconds"), (F.col("o_orderkey") % 4).alias("model_calls"))


def _tasks(spark, d):
    role = F.expr(_role)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), role.alias("role"))
    return c.withColumn("expected", F.expr("CASE role WHEN 'product' THEN 'VERIFIED' WHEN 'safety' THEN 'SAFE_FAIL' ELSE 'PASS' END"))


_TASKS = f"(SELECT c_custkey AS id, {_role} AS role, CASE c_custkey % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'SAFE_FAIL' ELSE 'PASS' END AS expected FROM customer)"
_SCORE = f"""(WITH r AS (SELECT *, fv OR (role = 'safety' AND outcome = 'VERIFIED') AS f FROM {_C} JOIN {_TASKS} USING (id)),
    s AS (SELECT system, count(*) AS tasks, count(*) FILTER (role = 'product') AS product_tasks, count(*) FILTER (role = 'product' AND outcome = 'VERIFIED' AND NOT f) AS verified_tasks, count(*) FILTER (role = 'safety') AS safety_tasks,
    count(*) FILTER (role = 'safety' AND outcome = 'SAFE_FAIL') AS safety_passed, count(*) FILTER (f) AS false_verified, count(*) FILTER (outcome <> expected) AS expectation_mismatches, count(*) FILTER (outcome = 'ENV_FAIL') AS incomplete, sum(cpu) AS cpu, sum(calls)::BIGINT AS model_calls FROM r GROUP BY system)
    SELECT *, CASE WHEN false_verified > 0 THEN 'FAIL_FALSE_VERIFIED' WHEN incomplete > 0 THEN 'INCOMPLETE' WHEN expectation_mismatches > 0 THEN 'FAIL_EXPECTATION' ELSE 'PASS' END AS status FROM s)"""


@query("score_corpus", f"SELECT system, tasks, product_tasks, verified_tasks, safety_tasks, safety_passed, false_verified, expectation_mismatches, incomplete, model_calls, round(cpu, 6) AS cpu_seconds, round(verified_tasks / product_tasks, 6) AS product_success_rate, status FROM {_SCORE}")
def corpus_score(spark, d):
    s = scoring.score(_tasks(spark, d), _cases(spark, d))
    return s.select("system", "tasks", "product_tasks", "verified_tasks", "safety_tasks", "safety_passed", "false_verified", "expectation_mismatches", "incomplete", "model_calls", F.round("cpu_seconds", 6).alias("cpu_seconds"), "product_success_rate", "status")


@query("score_ranking", f"SELECT row_number() OVER (ORDER BY false_verified, incomplete, expectation_mismatches, round(verified_tasks / cpu, 9) DESC NULLS LAST, verified_tasks DESC, system)::INT AS position, system FROM {_SCORE}")
def score_ranking(spark, d):
    rows = scoring.ranking(scoring.score(_tasks(spark, d), _cases(spark, d))).select("system", "false_verified", "incomplete", "expectation_mismatches", "solved_per_cpu", "verified_tasks")
    w = Window.orderBy("false_verified", "incomplete", "expectation_mismatches", F.desc_nulls_last("solved_per_cpu"), F.desc("verified_tasks"), "system")
    return rows.select(F.row_number().over(w).alias("position"), "system")  # a row per system


@query("score_coverage", f"WITH s AS (SELECT DISTINCT system FROM {_C}), due AS (SELECT system, id FROM s CROSS JOIN {_TASKS}), got AS (SELECT DISTINCT system, id FROM {_C}) SELECT system, id, 'missing' AS problem FROM (SELECT * FROM due EXCEPT SELECT * FROM got)")
def score_coverage(spark, d):
    return scoring.coverage(_tasks(spark, d), _cases(spark, d))


@query("score_loose", f"SELECT system, count(*) AS tasks, count(*) FILTER (outcome = 'VERIFIED') AS passed, round(sum(cpu), 6) AS cpu_seconds FROM {_C} GROUP BY system")
def loose_score(spark, d):
    s = scoring.loose_score(_cases(spark, d).withColumn("passed", F.lit(False)))
    return s.select("system", "tasks", "passed", F.round("cpu_seconds", 6).alias("cpu_seconds"))


@query("score_verdicts", "SELECT event_type AS engine, count(*) FILTER (event_id % 5 = 0) AS resolved, count(*) FILTER (event_id % 5 = 1) AS unresolved, count(*) FILTER (event_id % 5 = 2) AS ambiguous, count(*) FILTER (event_id % 5 = 3) AS unsupported, count(*) FILTER (event_id % 5 = 4) AS error, round(median(value), 6) AS median_ms FROM events GROUP BY event_type")
def verdicts(spark, d):
    names = F.array(*map(F.lit, ("resolved", "unresolved", "ambiguous", "unsupported", "error")))
    runs = table(spark, d, "events").select(F.col("event_type").alias("engine"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("verdict"), F.col("value").alias("elapsed_ms"))
    return scoring.verdicts(runs).withColumn("median_ms", F.round("median_ms", 6))
