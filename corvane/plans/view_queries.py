"""Queries of views: what reports show, as rows. A module is a report of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import evidence, ranking, scan, views
from corvane.plans import code_queries as c
from corvane.plans import search_queries as s
from corvane.query import query, table
from corvane.sources import corpus
from corvane.sources.modules import LINES_SQL

# --- scopes of modules with their hits

_END = f"(SELECT max(l.line) FROM {c._REAL} l WHERE l.file = sc.file AND l.line BETWEEN sc.start_line AND sc.end_line)"
_NAMED = f"(SELECT sc.file, sc.start_line, {_END} AS end_line, regexp_extract(h.text, '(?:def|class) (\\w+)', 1) AS name FROM {c.SCOPES_SQL} sc JOIN {LINES_SQL} h ON h.file = sc.file AND h.line = sc.start_line)"
_SCORE = "max(CASE role WHEN 'call' THEN 5 WHEN 'assignment' THEN 4 WHEN 'definition' THEN 3 WHEN 'import' THEN 2 ELSE 1 END)"
SCOPES_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, hit_count DESC, n_lines DESC, start_line, end_line) AS place FROM
    (SELECT r.file, start_line, end_line, name, {_SCORE} AS score, count(*) AS hit_count, count(DISTINCT line) AS n_lines, list_sort(list(DISTINCT line)) AS hit_lines FROM {c.ROLES_SQL} r JOIN {_NAMED} n ON n.file = r.file AND n.name = r.symbol_name GROUP BY r.file, start_line, end_line, name) QUALIFY place <= 3)"""


def _scopes(spark, d):
    rows = c._roles(spark, d).where("symbol_name <> '<module>'")
    return rows.groupBy("file", F.col("symbol_start").alias("start_line"), F.col("symbol_end").alias("end_line"), F.col("symbol_name").alias("name")).agg(
        F.max(evidence.role_score(F.col("role"))).alias("role_score"), F.lit(1).alias("n_queries"), F.count("*").alias("hit_count"), F.countDistinct("line").alias("n_lines"), F.array_sort(F.collect_set("line")).alias("hit_lines"),
    )


def _fit(rows: str, key: str, order: str, budget: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER w AS position, sum(strlen(text) + 1) OVER w AS spent FROM {rows} WINDOW w AS (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING)) WHERE spent <= {budget})"


def _head(word: str) -> str:
    return f"SELECT file, place, 0 AS line, '{word} ' || file || ':' || start_line || '-' || end_line || ' symbol=' || name || ' hits=' || hit_count AS text FROM sc"


@query("view_region", f"""WITH sc AS MATERIALIZED {SCOPES_SQL}, p AS (SELECT *, CASE WHEN len(hit_lines) <= 3 THEN hit_lines ELSE [hit_lines[1], hit_lines[(len(hit_lines) - 1) // 2 + 1], hit_lines[len(hit_lines)]] END AS picks FROM sc),
    n AS (SELECT DISTINCT file, place, line FROM (SELECT file, place, unnest(range(start_line, least(end_line, start_line + 2) + 1)) AS line FROM p UNION ALL SELECT file, place, unnest(range(greatest(start_line, x - 1), least(end_line, x + 1) + 1)) FROM (SELECT *, unnest(picks) AS x FROM p))),
    r AS ({_head("REGION_CONTEXT")} UNION ALL SELECT n.file, place, n.line, text FROM n JOIN {LINES_SQL} l ON l.file = n.file AND l.line = n.line)
    SELECT file, position::INT AS position, line, text FROM {_fit("r", "file", "place, line", "150")}""")
def region(spark, d):
    lines = corpus.plain_lines(c._modules(spark, d))
    return views.region(_scopes(spark, d), lines, ["file"], 150).select("file", "position", "line", "text")


def _form(i: int, spans: str) -> str:
    return f"SELECT DISTINCT file, place, {i} AS form, unnest(range(greatest(start_line, x.a), least(end_line, x.b) + 1)) AS line FROM (SELECT *, unnest({spans}) AS x FROM sc)"


def _around(r: int) -> str:
    return f"list_concat([{{'a': start_line, 'b': start_line + 2}}], list_transform(hit_lines, lambda h: {{'a': h - {r}, 'b': h + {r}}}))"


_forms = " UNION ALL ".join([_form(0, f"CASE WHEN end_line - start_line + 1 <= 96 THEN [{{'a': start_line, 'b': end_line}}] ELSE {_around(20)} END"), *(_form(i + 1, _around(r)) for i, r in enumerate(views.RADII))])


@query("view_focused", f"""WITH sc AS MATERIALIZED {SCOPES_SQL}, n AS ({_forms}), r AS MATERIALIZED (SELECT n.file, place, form, n.line, text FROM n JOIN {LINES_SQL} l ON l.file = n.file AND l.line = n.line UNION ALL SELECT file, place, unnest(range(5)), line, text FROM ({_head("SCOPE_CONTEXT")})),
    z AS (SELECT file, form FROM r GROUP BY file, form HAVING sum(strlen(text) + 1) BETWEEN 128 AND 330), b AS (SELECT file, min(form) AS form FROM z GROUP BY file)
    SELECT file, CASE form WHEN 1 THEN 20 WHEN 2 THEN 12 WHEN 3 THEN 6 WHEN 4 THEN 2 END AS radius, row_number() OVER (PARTITION BY file ORDER BY place, line)::INT AS position, line, text FROM r JOIN b USING (file, form)""")
def focused(spark, d):
    lines = corpus.plain_lines(c._modules(spark, d))
    return views.focused(_scopes(spark, d), lines, ["file"], 330).select("file", "radius", "position", "line", "text")


_ALLOWED = "o_orderkey % 3 <> 0 AND o_orderkey % 40 BETWEEN 1 AND 24 AND o_orderkey % 10 <= 8 AND o_orderkey % 50 BETWEEN 1 AND 32 AND o_custkey <= least(o_orderkey % 900 + 256, ceil((o_orderkey % 900) * 1.12))"


@query("view_focused_allowed", f"SELECT o_orderkey AS id, {_ALLOWED} AS allowed FROM orders")
def focused_allowed(spark, d):
    n = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(n.alias("id"), (n % 3 != 0).alias("scan_complete"), (n % 40).alias("hits"), (n % 10).alias("most_in_file"), (n % 50).alias("spans"), (n % 900).alias("raw_bytes"), F.col("o_custkey").alias("focused_bytes"))
    return rows.select("id", views.focused_allowed(rows).alias("allowed"))


_GR = f"(SELECT file, row_number() OVER (PARTITION BY file ORDER BY start_line, symbol_name, role, anchor) - 1 AS place, symbol_name || ' ' || role || ' ' || anchor || ' hits=' || hit_count AS header, symbol_name, role, anchor FROM {c._GROUPS})"
_VA = f"(SELECT file, place, v, line, text FROM (SELECT g.file, g.place, row_number() OVER (PARTITION BY g.file, g.place ORDER BY count(*) DESC, statement) - 1 AS v, min(line) AS line, '  x' || count(*) || ' ' || statement AS text FROM {c.ROLES_SQL} r JOIN {_GR} g USING (file, symbol_name, role, anchor) GROUP BY g.file, g.place, statement))"


@query("view_hybrid", f"""WITH RECURSIVE va AS MATERIALIZED {_VA}, co AS MATERIALIZED (SELECT file, place, -1 AS v, NULL::BIGINT AS line, header AS text FROM {_GR} UNION ALL SELECT file, place, v, line, text FROM va),
    t AS MATERIALIZED (SELECT file, sum(strlen(text) + 1)::BIGINT AS core FROM co GROUP BY file HAVING core <= 420), la AS (SELECT file, max(line) AS last FROM {LINES_SQL} GROUP BY file),
    sm AS MATERIALIZED (SELECT va.file, place, v, l.line, l.text FROM va JOIN t USING (file) JOIN la USING (file) JOIN {LINES_SQL} l ON l.file = va.file AND l.line BETWEEN greatest(1, va.line - 1) AND least(last, va.line + 1) WHERE v < 3),
    bl AS MATERIALIZED (SELECT file, place, v, sum(strlen(text) + 1)::BIGINT AS n, row_number() OVER (PARTITION BY file ORDER BY place, v) AS rn FROM sm GROUP BY file, place, v),
    f AS (SELECT b.file, b.place, b.v, rn, CASE WHEN core + n <= 420 THEN core + n ELSE core END AS spent, core + n <= 420 AS kept FROM bl b JOIN t USING (file) WHERE rn = 1
        UNION ALL SELECT b.file, b.place, b.v, b.rn, CASE WHEN spent + n <= 420 THEN spent + n ELSE spent END, spent + n <= 420 FROM f JOIN bl b ON b.file = f.file AND b.rn = f.rn + 1),
    a AS (SELECT file, 0 AS part, place, v, 'core' AS kind, line, text FROM co JOIN t USING (file) UNION ALL SELECT file, 1, place, v, 'context', line, text FROM sm JOIN f USING (file, place, v) WHERE kept)
    SELECT file, row_number() OVER (PARTITION BY file ORDER BY part, place, v, line NULLS FIRST)::INT AS position, kind, line, text FROM a""")
def hybrid(spark, d):
    hits = c._roles(spark, d)
    per = hits.groupBy("file", "symbol_name", "role", "anchor", "statement").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    one = F.struct((-F.col("n")).alias("order"), "statement", F.concat(F.lit("  x"), "n", F.lit(" "), "statement").alias("text"), "line")
    groups = per.groupBy("file", "symbol_name", "role", "anchor").agg(F.sum("n").alias("n"), F.min("line").alias("first"), F.array_sort(F.collect_list(one)).alias("variants"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("file").orderBy("first", "symbol_name", "role", "anchor")) - 1
    header = F.concat_ws(" ", "symbol_name", "role", "anchor", F.concat(F.lit("hits="), "n"))
    groups = groups.select("file", place.alias("place"), header.alias("header"), "variants")
    return views.hybrid(groups.withColumn("report", F.col("file")), corpus.plain_lines(c._modules(spark, d)), ["report"], 420).select("file", "position", "kind", "line", "text")


@query("view_novel", f"""SELECT file, line, marked, text FROM (SELECT n, file, line, regexp_matches(text, 'return') AS marked, text FROM {LINES_SQL}) WHERE line % 3 <> 0 OR (marked AND n % 2 <> 0)""")
def novel(spark, d):
    """Rows not shown before: every third line was, and the hits of every second module."""
    m = c._modules(spark, d)
    raw = corpus.plain_lines(m).select("file", "line", F.contains("text", F.lit("return")).alias("marked"), "text")
    hits = raw.join(m.where("n % 2 = 0").select("file"), "file", "left_semi").where("marked")
    return views.novel_rows(raw, raw.where("line % 3 = 0"), hits)


_CAND = "(SELECT o_orderkey AS report, 'src/f' || l_partkey || '.py' AS file, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank, [l_linenumber % 3, 3] AS queries, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) <= 2 AS selected FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query("view_route_map", f"""WITH c AS MATERIALIZED {_CAND}, t AS (SELECT report, count(*) FILTER (selected) AS n, count(*) AS a FROM c GROUP BY report), r AS (SELECT report, 0 AS part, 0 AS rank, 'ROUTE emitted=' || n || ' retained=' || (a - n) AS text FROM t
    UNION ALL SELECT report, 1, rank, '  ' || file || ' [' || array_to_string(list_transform(list_sort(queries), lambda q: 'Q' || (q + 1)), ',') || ']' FROM c WHERE selected UNION ALL SELECT report, 2, 0, '  +' || (a - n) || ' lexical candidates retained_unemitted' FROM t WHERE a > n)
    SELECT report, position::INT AS position, text FROM {_fit("r", "report", "part, rank", "90")}""")
def route_map(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = rows.withColumn("rank", rank).select(F.col("l_orderkey").alias("report"), F.concat(F.lit("src/f"), "l_partkey", F.lit(".py")).alias("file"), "rank", F.array(F.col("l_linenumber") % 3, F.lit(3)).alias("queries"), (F.col("rank") <= 2).alias("selected"))
    return views.route_map(rows, ["report"], 90)


@query("view_summary", f"""SELECT query::INT AS query, 'Q' || (query + 1) || ' probed_line_hits=' || CASE WHEN capped THEN '>={scan.LINE_CAP}' ELSE n::VARCHAR END || ' probe_scan=' || CASE WHEN capped THEN 'scan_cap' ELSE 'complete' END || CASE WHEN query = 1 THEN ' match=case_fold' ELSE '' END AS text
    FROM (SELECT query, count(*) AS n, bool_or(capped) AS capped FROM {s.KEPT_SQL} GROUP BY query)""")
def summary(spark, d):
    status = s._hits(spark, d).groupBy("query").agg(F.count("*").alias("n"), F.bool_or("capped").alias("capped"))
    return views.summary_lines(status.withColumn("match_mode", F.when(F.col("query") == 1, "case_fold").otherwise("exact")), scan.LINE_CAP)


_CH = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query("view_index", f"""WITH k AS MATERIALIZED {s.KEPT_SQL}, fa AS MATERIALIZED {s.FACETS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n_matches DESC, n_files DESC, facet) AS top FROM fa), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (top = 1)::INT, (n_matches < 2)::INT, n_matches, n_files, facet) AS rest FROM r),
    pf AS (SELECT query, file, count(*) AS nl, sum(n)::BIGINT AS nm, arg_min(text, line) AS t, min(line) AS l FROM k GROUP BY query, file), pq AS (SELECT query, count(*) AS nf, sum(nl)::BIGINT AS nl, sum(nm)::BIGINT AS nm FROM pf GROUP BY query),
    h AS (SELECT 0 AS turn, query, 'Q' || (query + 1) || ' index files=' || nf || ' collected_lines=' || nl || ' exact_matches=' || nm || coalesce((SELECT ' dominant=' || facet || ':' || n_matches FROM o WHERE o.query = pq.query AND top = 1), '')
        || coalesce((SELECT ' route=' || facet || ':' || n_matches || ' route_files=' || n_files || ' route_at=' || f.file || ':' || f.line FROM o WHERE o.query = pq.query AND rest = 1 AND top <> 1), '') AS text FROM pq),
    fl AS (SELECT row_number() OVER (PARTITION BY query ORDER BY nm DESC, nl DESC, file) AS turn, query, '  Q' || (query + 1) || ' ' || file || ' lines=' || nl || ' exact=' || nm || ' sample_line=' || l || ' sample=' || left({_CH.format(x="t")}, 120) AS text FROM pf QUALIFY turn <= 5),
    a AS (SELECT *, 0 AS one FROM (SELECT * FROM h UNION ALL SELECT * FROM fl)) SELECT position::INT AS position, text FROM {_fit("a", "one", "turn, query", "1400")}""")
def index(spark, d):
    hits = s._hits(spark, d)
    return views.index_rows(hits, scan.facets(hits))


# --- facts and ledgers

_FACT_ROWS = "(SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN './' ELSE '' END || 'src/' || p_brand || '.py' AS file, p_size AS line, p_size AS a, p_size + 9 AS b, p_type AS t, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name || ' \"q\" \\ é' END AS s, p_size > 20 AS yes FROM part)"
_file = "regexp_replace(file, '^\\./', '')"
_FACTS = {
    "hit": f"{_file}, line", "line": f"{_file}, line", "span": f"{_file}, a, b", "scope": f"{_file}, a, b, t, s", "group": f"{_file}, a, b, t, s, 'call', t, s", "witness": f"{_file}, a, b, t, s, 'call', t, s, t, [a, b]", "negative": "t, '.', s",
    "index_summary": "yes, NOT yes, a, b, a", "index_file": f"{_file}, a, b, line, s", "index_facet": f"'dominant', s, a, b, {_file}, line", "route_candidate": f"{_file}, [a, b], yes, '.', s", "route_summary": "yes, a, b",
}


@query("evidence_fact_formats", " UNION ALL ".join(f"SELECT id, '{k}' AS kind, json_array({parts})::VARCHAR AS parts FROM {_FACT_ROWS}" for k, parts in _FACTS.items()))
def fact_formats(spark, d):
    """The keys of all kinds of facts."""
    rows = table(spark, d, "part").selectExpr(
        "p_partkey id", "concat(case when p_partkey % 3 = 0 then './' else '' end, 'src/', p_brand, '.py') file", "p_size line", "p_size a", "p_size + 9 b", "p_type t", "case when p_partkey % 4 = 0 then null else concat(p_name, ' \"q\" ', chr(92), ' é') end s", "p_size > 20 yes",
    )
    names = {
        "start_byte": "a", "end_byte": "b", "start": "a", "end": "b", "start_line": "a", "end_line": "b", "symbol_kind": "t", "symbol_name": "s", "role": "'call'", "anchor": "t", "match_text": "s", "subject": "s", "statement": "t", "hit_lines": "array(b, a)", "query": "t", "target": "'.'", "glob": "s",
        "scan_complete": "yes", "scan_capped": "not yes", "n_files": "a", "n_lines": "b", "exact_matches": "a", "line_hits": "a", "first_line": "line", "sample": "s", "kind": "'dominant'", "facet": "s", "first_file": "file", "queries": "array(b, a)", "selected": "yes", "discovery_complete": "yes", "n_candidates": "a", "n_selected": "b",
    }
    other = {"index_summary": {"exact_matches": "a"}, "index_file": {"exact_matches": "b"}, "index_facet": {"n_files": "b"}}
    out = None
    for kind, parts in evidence.FACT_PARTS.items():
        mine = rows.selectExpr("id", *(f"{(names | other.get(kind, {})).get(x, x)} as `{x}`" for x in parts))
        one = evidence.facts_of(kind, mine).select("id", F.substring_index("key", "\0", 1).alias("kind"), F.substring_index("key", "\0", -1).alias("parts"))
        out = one if out is None else out.union(one)
    return out

@query("evidence_ledger", "SELECT key FROM (SELECT DISTINCT 'k' || (event_id % 400) AS key FROM events) ORDER BY CASE WHEN CAST(substr(key, 2) AS INT) % 2 = 0 THEN 0 ELSE 1 END, key LIMIT 300")
def ledger(spark, d):
    """Known facts stay before new ones when the ledger is full."""
    facts = table(spark, d, "events").select(F.concat(F.lit("k"), F.col("event_id") % 400).alias("key")).distinct()
    old = facts.where("cast(substr(key, 2) as int) % 2 = 0")
    return evidence.remembered(old, evidence.novel(facts, old), most=300)


@query("evidence_first_queries", f"SELECT file, line, min(query)::INT AS query FROM {s.KEPT_SQL} GROUP BY file, line")
def first_queries(spark, d):
    return evidence.first_queries(s._hits(spark, d))


@query("evidence_all_facts", f"""WITH k AS {s.KEPT_SQL} SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'positive' AS kind, file, line, '' AS a FROM k UNION ALL SELECT DISTINCT 'context', file, line, '' FROM k UNION ALL SELECT 'negative', q.query::VARCHAR, 0, '' FROM (VALUES {s._q}) AS q(query, rx) WHERE q.query NOT IN (SELECT query FROM k)
    UNION ALL SELECT DISTINCT 'routing', file, 0, '' FROM k UNION ALL SELECT DISTINCT 'structural', query::VARCHAR, 0, '' FROM k UNION ALL SELECT DISTINCT 'other', file, 0, '' FROM k) GROUP BY kind""")
def all_facts(spark, d):
    """Facts of all sorts, as the engine makes them and as others may, counted by what they say."""
    hits = s._hits(spark, d)
    at = lambda kind, *c: F.concat(F.lit(f"{kind}\0"), F.to_json(F.array(*(F.col(x).cast("string") for x in c))))
    facts = hits.select(F.explode(F.array(at("index_file", "file"), at("scope", "query"), at("route_candidate", "file"))).alias("key")).union(evidence.fact_keys(hits).select("key"))
    negative = evidence.negative_facts(scan.scan_status(spark, hits, s.SEARCH)).select("key")
    return evidence.fact_summary(facts.union(negative).distinct())


@query("range_distances", "SELECT o_orderkey AS id, greatest(o_custkey % 50 - o_orderkey % 60, o_orderkey % 60 - (o_custkey % 50 + 9), 0) AS distance FROM orders")
def distances(spark, d):
    from corvane.operators import ranges

    line, start = F.col("o_orderkey") % 60, F.col("o_custkey") % 50
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), ranges.distance_to_range(line, start, start + 9).alias("distance"))


@query("check_changed_lines", "SELECT doc_id AS id, (length(text) - length(replace(text, chr(10), '')) + 1 + 1) AS n FROM documents")
def changed_lines(spark, d):
    """Lines of a patch that adds a document and takes one line away."""
    from corvane.operators import verify

    patch = F.concat(F.lit("--- a/f\n+++ b/f\n@@ -1 +1,9 @@\n-x\n+"), F.replace("text", F.lit("\n"), F.lit("\n+")), F.lit("\n context"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), verify.changed_lines(patch).alias("n"))


@query("text_path_tokens", f"SELECT doc_id, array_to_string(({c._first_seen(c._path_words('file'))})[1:8], ',') AS tokens FROM (SELECT doc_id, source || '/' || lang || '/docFile_' || doc_id || '.txt' AS file FROM documents)")
def path_tokens(spark, d):
    file = F.concat_ws("/", "source", "lang", F.concat(F.lit("docFile_"), "doc_id", F.lit(".txt")))
    return table(spark, d, "documents").select("doc_id", F.array_join(text.path_tokens(file), ",").alias("tokens"))


@query("select_emitted", "SELECT o_custkey AS id, array_to_string(list_distinct_first, ',') AS files FROM (SELECT o_custkey, (list_concat(['r' || o_custkey % 3], CASE WHEN o_custkey % 2 = 0 THEN ['s'] ELSE [] END, CASE WHEN o_custkey % 5 = 0 THEN ['g'] ELSE [] END, list_filter(['r0', 'r1', 'r2', 'x', 'y'], lambda v: v <> 'r' || o_custkey % 3)))[1:4] AS list_distinct_first FROM orders GROUP BY o_custkey)")
def emitted(spark, d):
    """Reserved files, the best structural one, one of the graph, then the others by rank."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct()
    none, n = F.array().cast("array<string>"), F.col("id")
    lexical = F.array(*map(F.lit, ("r0", "r1", "r2", "x", "y")))
    out = ranking.emitted(lexical, F.array(F.concat(F.lit("r"), n % 3)), F.when(n % 2 == 0, F.array(F.lit("s"))).otherwise(none), F.when(n % 5 == 0, F.array(F.lit("g"), F.lit("h"))).otherwise(none))
    return rows.select("id", F.array_join(out, ",").alias("files"))


# --- places and targets


@query("text_byte_offsets", """WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS p, doc_id % 4 + 1 AS l, doc_id % 90 + 1 AS c FROM documents)
    SELECT doc_id, CASE WHEN l <= len(p) AND c <= length(p[l]) + 1 THEN (coalesce(list_sum(list_transform(p[1:l - 1], lambda x: strlen(x) + 1)), 0) + strlen(left(p[l], c - 1)))::BIGINT END AS offset_ FROM t""")
def byte_offsets(spark, d):
    n = F.col("doc_id")
    return table(spark, d, "documents").select(n, text.byte_offset(F.col("text"), (n % 4 + 1).cast("int"), (n % 90 + 1).cast("int")).alias("offset_"))


@query("text_offsets_of_positions", """WITH t AS (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN '🙂🙂é' ELSE '' END || text, chr(10)) AS p, doc_id % 3 + 1 AS l, doc_id * 7 % 70 AS c FROM documents),
    k AS (SELECT *, list_filter(range(0, length(p[l]) + 1), lambda i: i + len(regexp_extract_all(left(p[l], i), '[\\x{10000}-\\x{10FFFF}]')) = c) AS k FROM (SELECT doc_id, p, l, c FROM t) WHERE l <= len(p))
    SELECT doc_id, CASE WHEN len(k) > 0 THEN (coalesce(list_sum(list_transform(p[1:l - 1], lambda x: strlen(x) + 1)), 0) + strlen(left(p[l], k[1])))::BIGINT END AS offset_ FROM k UNION ALL SELECT doc_id, NULL FROM t WHERE l > len(p)""")
def offsets_of_positions(spark, d):
    from corvane.operators import targets

    n = F.col("doc_id")
    source = F.concat(F.when(n % 3 == 0, "🙂🙂é").otherwise(""), "text")
    return table(spark, d, "documents").select(n, targets.offset_of(source, (n % 3).cast("int"), (n * 7 % 70).cast("int")).alias("offset_"))


_FN = f"(SELECT * FROM {_NAMED} WHERE name NOT LIKE 'C%' AND file NOT IN (SELECT file FROM {LINES_SQL} WHERE n % 13 = 0))"


@query("target_symbols", f"""WITH f AS MATERIALIZED {_FN}, e AS (SELECT file, line FROM {LINES_SQL} WHERE regexp_matches(text, '^class ') AND n % 5 <> 0), x AS (SELECT f.*, (SELECT min(abs(e.line - f.start_line)) FROM e WHERE e.file = f.file) AS distance FROM f)
    SELECT file, name, CASE WHEN distance IS NULL THEN 'evidence_anchor_missing' WHEN distance > 6 THEN 'symbol_not_found' ELSE 'ok' END AS reason, CASE WHEN distance <= 6 THEN start_line END AS start_line, CASE WHEN distance <= 6 THEN end_line END AS end_line FROM x""")
def symbol_targets(spark, d):
    from corvane.operators import targets

    facts = c._facts(spark, d).where("role = 'declaration' and node_kind = 'function_definition'")
    m = c._modules(spark, d).where("n % 5 <> 0")
    evidence_lines = corpus.plain_lines(m).where(F.col("text").rlike("^class ")).select("file", "line")
    return targets.symbol_targets(facts.select("file", "name", "start_line", "end_line"), evidence_lines, 6)


@query("evidence_distilled", """SELECT o_orderkey AS id, o_orderkey % 4 > 0 AND o_orderkey % 5 <> 0 AS location_complete, o_orderkey % 4 > 0 AND o_orderkey % 7 <> 0 AS anchor_complete, o_orderkey % 4 > 0 AND o_orderkey % 7 <> 0 AS witness_complete, o_orderkey % 11 <> 0 AS distill_complete,
    o_orderkey % 4 > 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS ir_complete, CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE 'evidence_ir' END AS representation FROM orders""")
def distilled(spark, d):
    n = F.col("o_orderkey")
    raw = n % 4
    rows = table(spark, d, "orders").select(
        n.alias("id"), raw.alias("raw"), raw.alias("mapped"), F.when(n % 5 == 0, raw - 1).otherwise(raw).alias("exact_spans"), raw.alias("anchored"), raw.alias("witnessed"), (n % 7 == 0).cast("int").alias("lossy"),
        F.lit(0).alias("unsupported"), (n % 11 == 0).cast("int").alias("errors"), (n % 13 == 0).alias("truncated"), raw.alias("groups"), raw.alias("shown_groups"), raw.alias("variants"), raw.alias("shown_variants"),
    )
    return evidence.distilled(rows).select("id", "location_complete", "anchor_complete", "witness_complete", "distill_complete", "ir_complete", "representation")


@query("evidence_scope_order", f"SELECT file, name, place::INT AS place FROM {SCOPES_SQL}")
def scope_order(spark, d):
    return views.first_scopes(_scopes(spark, d), ["file"]).select("file", "name", "place")
