"""Queries of targets, views and tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import evidence, graph, ranking, targets
from corvane.plans import search_queries as s
from corvane.plans import state_queries as st
from corvane.query import query, table
from corvane.scratch import kept
from corvane.streaming import sessions


@query("target_primary_scope", """WITH r AS (SELECT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, CASE WHEN o_orderkey % 3 = 0 THEN 'tests/t' || o_orderkey || '.py' ELSE 'src/f' || o_orderkey || '.py' END AS file, o_orderkey % 2 AS q FROM orders),
    f AS (SELECT *, first_value(q) OVER w AS fq, first_value(file) OVER w AS ff FROM r WINDOW w AS (PARTITION BY g ORDER BY rank))
    SELECT g, file FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY (starts_with(ff, 'tests/') AND NOT starts_with(file, 'tests/') AND q = fq) DESC, rank) AS pick FROM f) WHERE pick = 1""")
def primary_scope(spark, d):
    o = table(spark, d, "orders")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    file = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("tests/t"), "o_orderkey", F.lit(".py"))).otherwise(F.concat(F.lit("src/f"), "o_orderkey", F.lit(".py")))
    rows = o.select(F.col("o_custkey").alias("g"), rank.alias("rank"), file.alias("file"), F.array(F.col("o_orderkey") % 2).alias("queries"))
    return targets.primary_scope(rows, ["g"]).select("g", "file")


@query("select_round_robin", f"SELECT query::INT AS query, file, n_lines, turn::INT AS turn FROM (SELECT query, file, count(*) AS n_lines, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, file) AS turn FROM {s.KEPT_SQL} GROUP BY query, file) WHERE turn <= 5")
def round_robin(spark, d):
    per = s._hits(spark, d).groupBy("query", "file").agg(F.count("*").alias("n_lines"))
    return targets.round_robin(per, "query", [F.desc("n_lines"), F.asc("file")])


def _reordered(part):
    p = part.withColumn("file", F.concat(F.lit("p"), "p_partkey"))
    ranked = ranking.numbered(p.where("p_size > 25"), [F.desc("p_retailprice"), F.asc("p_partkey")], "rank")
    return targets.reordered(p.select("file", F.col("p_partkey").alias("lexical_rank")), ranked).select("file", "position")


@query("rank_reordered", "SELECT 'p' || a.p_partkey AS file, row_number() OVER (ORDER BY b.r IS NULL, b.r, a.p_partkey)::INT AS position FROM part a LEFT JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_size > 25) b USING (p_partkey)")
def reordered(spark, d):
    return _reordered(table(spark, d, "part"))


_V = "CASE o_orderkey % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'resolved' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'unresolved' ELSE 'error' END"


def _verdicts(spark, d, orders, status):
    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("file"))
    found = orders.select(F.col("o_custkey").alias("id"), F.expr(status).alias("status"), F.concat(F.lit("n"), F.col("o_orderkey") % 25).alias("file"))
    return targets.verdicts(expected, found)


# customers whose every order is an error have no verdict; of others, the first customers have no ambiguous order
_VW = "CASE WHEN o_custkey % 7 = 0 THEN 'error' WHEN o_custkey % 7 < 4 AND o_orderkey % 5 = 2 THEN 'error' WHEN o_custkey % 7 = 1 AND o_orderkey % 5 < 2 THEN 'error' ELSE " + _V + " END"


@query("semantic_verdicts", f"""WITH l AS (SELECT o_custkey AS id, {_VW} AS status, 'n' || (o_orderkey % 25) AS file FROM orders), j AS (SELECT c_custkey AS id, 'n' || c_nationkey AS want, l.* EXCLUDE (id) FROM customer LEFT JOIN l ON l.id = c_custkey),
    g AS (SELECT id, count(*) FILTER (status = 'resolved' AND file = want) AS a, count(*) FILTER (status = 'resolved') AS b, count(*) FILTER (status = 'ambiguous') AS c, count(*) FILTER (status = 'unresolved') AS u FROM j GROUP BY id)
    SELECT id, CASE WHEN a > 0 THEN 'confirmed' WHEN c > 0 THEN 'ambiguous' WHEN b > 0 THEN 'contradicted' WHEN u > 0 THEN 'unresolved' ELSE 'unavailable' END AS verdict FROM g""")
def semantic_verdicts(spark, d):
    return _verdicts(spark, d, table(spark, d, "orders"), _VW)


@query("semantic_locations", "SELECT id, file, start_byte, total <= 32 AS bounded_complete FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, start_byte) AS n, count(*) OVER (PARTITION BY id) AS total FROM (SELECT DISTINCT l_suppkey AS id, 'p' || l_partkey AS file, l_linenumber::BIGINT AS start_byte FROM lineitem)) WHERE n <= 32")
def semantic_locations(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.concat(F.lit("p"), "l_partkey").alias("file"), F.col("l_linenumber").cast("long").alias("start_byte"))
    return targets.bounded_locations(rows)


@query("target_rename_status", """WITH f AS (SELECT DISTINCT 's' || (p_partkey % 40) AS symbol, 'f' || p_size AS file FROM part), h AS (SELECT * FROM f WHERE file <> 'f7'), d AS (SELECT 's' || (p_partkey % 40) AS symbol, p_brand AS identity FROM part WHERE p_partkey % 97 = 0)
    SELECT symbol, CASE WHEN symbol IN (SELECT symbol FROM f WHERE file = 'f7') THEN 'files_outside_handoff' WHEN coalesce(n, 0) = 1 THEN 'unique' WHEN coalesce(n, 0) > 1 THEN 'ambiguous' ELSE 'no_definition' END AS status FROM (SELECT DISTINCT symbol FROM f) LEFT JOIN (SELECT symbol, count(DISTINCT identity) AS n FROM d GROUP BY symbol) USING (symbol)""")
def rename_status(spark, d):
    p = table(spark, d, "part").withColumn("symbol", F.concat(F.lit("s"), F.col("p_partkey") % 40)).withColumn("file", F.concat(F.lit("f"), "p_size"))
    return targets.rename_targets(p.where("p_partkey % 97 = 0").select("symbol", F.col("p_brand").alias("identity")), p, p.where("file <> 'f7'").select("symbol", "file").distinct())


@query("target_competitors", f"""WITH f AS MATERIALIZED {s.FOUND_SQL}, t AS (SELECT min(file) AS target FROM f WHERE query = 1), p AS (SELECT query, count(*) AS n FROM f GROUP BY query HAVING bool_or(file = (SELECT target FROM t))), b AS (SELECT query FROM p WHERE n = (SELECT min(n) FROM p)),
    r AS (SELECT DISTINCT file FROM f WHERE query IN (SELECT query FROM b) AND file <> (SELECT target FROM t) AND file IN (SELECT file FROM f WHERE query <> 2))
    SELECT count(*) AS n_rivals, CASE WHEN count(*) = 0 THEN 'confirmed' WHEN count(*) <= 4 THEN 'competing' ELSE 'too_many' END AS decision FROM r""")
def competitors(spark, d):
    from corvane.operators import scan

    # all files count, so none is left out of what is found
    found = kept(scan.discover(s._lines(spark, d), s.SEARCH, cap=None))
    target = found.where("query = 1").agg(F.min("file").alias("file")).head()["file"]
    rows, decision = targets.competitors(found, target or "", found.where("query <> 2"))
    return rows.agg(F.count("*").alias("n_rivals")).withColumn("decision", F.lit(decision))


@query("evidence_view", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'region' WHEN doc_id % 2 = 0 AND (doc_id % 3 = 0 OR n_chars % 100 <= 0.75 * 100) THEN 'hybrid' WHEN doc_id % 3 = 0 THEN 'index' ELSE 'raw' END AS view FROM documents")
def view(spark, d):
    t = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 100).alias("hybrid_bytes"), F.lit(100).alias("raw_bytes"), (F.col("doc_id") % 3 != 0).alias("raw_complete"), (F.col("doc_id") % 2 == 0).alias("under_pressure"), (F.col("doc_id") % 11 == 0).alias("dense"))
    return t.select("doc_id", evidence.chosen_view(t).alias("view"))


@query("session_frontier", f"""WITH x AS (SELECT session, turn, seq, coalesce(last_value({st._st} IGNORE NULLS) OVER (PARTITION BY session, turn ORDER BY seq ROWS UNBOUNDED PRECEDING), 'locate') AS state, seq % 2 = 0 AS ren, seq % 3 = 0 AS rep, CASE seq % 4 WHEN 0 THEN 'execute_rename_symbol' WHEN 1 THEN 'execute_replace_node' END AS act FROM {st._T})
    SELECT session, turn, seq, CASE WHEN state = 'locate' THEN 'search' WHEN state = 'repair' AND act IS NOT NULL THEN CASE WHEN act = 'execute_rename_symbol' AND ren THEN act WHEN act = 'execute_replace_node' AND rep THEN act END
    WHEN state IN ('mutate', 'repair') THEN CASE WHEN seq % 5 < 2 AND ren THEN 'execute_rename_symbol' WHEN seq % 5 >= 2 AND rep THEN 'execute_replace_node' END END AS tool FROM x""")
def frontier(spark, d):
    rows = sessions.states(st._events(spark, d))
    seq = F.col("seq")
    active = F.when(seq % 4 == 0, "execute_rename_symbol").when(seq % 4 == 1, "execute_replace_node")
    intent = F.when(seq % 5 < 2, "rename_symbol").otherwise("generic_edit")
    return rows.select("session", "turn", "seq", sessions.frontier(F.col("state"), intent, seq % 2 == 0, seq % 3 == 0, active).alias("tool"))


def _freshness(customer):
    c = customer.select(F.concat(F.lit("c"), "c_custkey").alias("file"), "c_custkey", F.col("c_nationkey").alias("n_bytes"), F.lit(0).alias("mtime_ms"))
    new = c.where("c_custkey % 7 <> 0").withColumn("n_bytes", F.col("n_bytes") + (F.col("c_custkey") % 11 == 0).cast("int"))
    return graph.fresh(c.select("file"), c.where("c_custkey % 5 <> 0"), new)


@query("graph_freshness", "SELECT 'c' || c_custkey AS file, c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AS fresh FROM customer")
def freshness(spark, d):
    return _freshness(table(spark, d, "customer"))
