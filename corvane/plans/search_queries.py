"""Queries of the search side: scans, ranking, evidence, over the documents as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import evidence, ranges, ranking, scan
from corvane.query import query
from corvane.sources import corpus
from corvane.sources.corpus import FILES_SQL, LINES_SQL

#: the search of these queries: expressions, and the words that a path may hold
SEARCH = ["MIT License", "General Public License, version [23]", "th(?:at|is) (?:in|the|of)", "no such words at all"]
WORDS = [["mit", "src1"], ["doc_62", "en"], ["en"], []]
TERMS = ["license", "mit", "en", "src1", "general"]

_q = ", ".join(f"({i}, '{q}')" for i, q in enumerate(SEARCH))
HITS_SQL = f"""(SELECT query, file, line, text, len(regexp_extract_all(text, rx)) AS n, rx FROM {LINES_SQL} l,
    (VALUES {_q}) AS q(query, rx) WHERE regexp_matches(l.text, rx))"""
_cap = scan.LINE_CAP
KEPT_SQL = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY file, line) AS rn, count(*) OVER (PARTITION BY query) > {_cap} AS capped FROM {HITS_SQL}) WHERE rn <= {_cap})"
FOUND_SQL = f"(SELECT DISTINCT query, file FROM {HITS_SQL})"


def _files(spark, d):
    return corpus.document_files(spark, d)


def _lines(spark, d):
    return corpus.plain_lines(_files(spark, d))


def _hits(spark, d):
    return scan.scan_lines(_lines(spark, d), SEARCH)


@query("scan_file_lines", f"SELECT file, line, strlen(text) AS n_bytes, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte FROM {LINES_SQL}")
def file_lines(spark, d):
    return corpus.lines(_files(spark, d)).select("file", "line", F.octet_length("text").cast("long").alias("n_bytes"), "start_byte")


_named = "regexp_replace(file, '\\.txt$', CASE n % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.Md' WHEN 2 THEN '.tar.gz' ELSE '' END)"
_EXTS = f"(SELECT {_named} AS file, n_bytes FROM (SELECT *, CAST(regexp_extract(file, 'doc_(\\d+)', 1) AS BIGINT) AS n FROM {FILES_SQL}))"


@query("scan_extension_counts", f"SELECT lower(regexp_extract(regexp_extract(file, '([^/]*)$', 1), '^.+\\.([^.]+)$', 1)) AS extension, count(*) AS n_files, sum(n_bytes)::BIGINT AS n_bytes FROM {_EXTS} GROUP BY 1")
def extension_counts(spark, d):
    n = F.regexp_extract("file", r"doc_(\d+)", 1).cast("long") % 4
    end = F.when(n == 0, ".txt").when(n == 1, ".Md").when(n == 2, ".tar.gz").otherwise("")
    return corpus.extension_counts(_files(spark, d).withColumn("file", F.concat(F.regexp_replace("file", r"\.txt$", ""), end)))


@query("scan_context_lines", f"SELECT l.file, l.line, l.text FROM {LINES_SQL} l JOIN {FILES_SQL} f USING (file) WHERE n_bytes <= 3000 AND l.line BETWEEN 2 AND 3")
def context_lines(spark, d):
    """Lines of files that may be read: not too large, and inside the root; some names climb out of it."""
    files = _files(spark, d)
    outside = files.withColumn("file", F.concat(F.lit("../"), "file"))
    wanted = files.union(outside).select("file", F.lit(2).cast("long").alias("start"), F.lit(3).cast("long").alias("end"))
    return corpus.context_lines(files.union(outside), wanted, 3000)


@query("scan_discover_files", f"SELECT query::INT AS query, file FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY file) AS rn FROM {FOUND_SQL}) WHERE rn <= {scan.FILE_CAP}")
def discover_files(spark, d):
    # the SQL has no column for the flag; scan_discover_capped shows it
    return scan.discover(_lines(spark, d), SEARCH).select("query", "file")


@query("scan_discover_capped", f"SELECT query::INT AS query, least(n, {scan.FILE_CAP}) AS n_files, n > {scan.FILE_CAP} AS capped FROM (SELECT query, count(*) AS n FROM {FOUND_SQL} GROUP BY query)")
def discover_capped(spark, d):
    return scan.discover(_lines(spark, d), SEARCH).groupBy("query").agg(F.count("*").alias("n_files"), F.bool_or("capped").alias("capped"))


@query("scan_line_hits", f"SELECT query::INT AS query, file, line, text, n::BIGINT AS n_matches, capped FROM {KEPT_SQL}")
def line_hits(spark, d):
    return _hits(spark, d).select("query", "file", "line", "text", F.size("match_texts").cast("long").alias("n_matches"), "capped")


@query("scan_completeness", f"""SELECT q.query::INT AS query, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_files, 0)::BIGINT AS n_files, NOT coalesce(capped, false) AS scan_complete,
    (NOT coalesce(capped, false) AND coalesce(n_lines, 0) = 0) AS absent FROM (VALUES {_q}) AS q(query, rx)
    LEFT JOIN (SELECT query, count(*) AS n_lines, count(DISTINCT file) AS n_files, bool_or(capped) AS capped FROM {KEPT_SQL} GROUP BY query) h USING (query)""")
def completeness(spark, d):
    return scan.scan_status(spark, _hits(spark, d), SEARCH)


def _spans_sql() -> str:
    """Places of matches, one after the other: what is before each, from splitting the line at the matches."""
    return f"""WITH k AS {KEPT_SQL}, m AS (SELECT query, file, line, text, regexp_extract_all(text, rx) AS ms, string_split_regex(text, rx) AS parts FROM k WHERE n > 0), u AS (SELECT *, unnest(range(len(ms))) AS n FROM m)
        SELECT query::INT AS query, file, line, n::INT AS n, (strlen(array_to_string(parts[1:n + 1], '')) + strlen(array_to_string(ms[1:n], '')))::BIGINT AS start_byte, (strlen(array_to_string(parts[1:n + 1], '')) + strlen(array_to_string(ms[1:n + 1], '')))::BIGINT AS end_byte, left(trim(regexp_replace(ms[n + 1], '\\s+', ' ', 'g')), 160) AS match_text FROM u"""


@query("scan_byte_spans", _spans_sql())
def byte_spans(spark, d):
    return scan.byte_spans(_hits(spark, d), SEARCH)


@query("evidence_merged_hits", f"SELECT file, line, list_aggregate(list_sort(list(DISTINCT query)), 'string_agg', ',') AS queries, count(*) AS n_hits, sum(n)::BIGINT AS n_matches FROM {KEPT_SQL} GROUP BY file, line")
def merged_hits(spark, d):
    return scan.merge_hits(_hits(spark, d)).withColumn("queries", F.array_join(F.col("queries").cast("array<string>"), ","))


@query("evidence_pressure", f"SELECT sum(n)::BIGINT AS n_lines, count(*) AS n_files, max(n)::BIGINT AS most_in_file FROM (SELECT file, count(DISTINCT line) AS n FROM {KEPT_SQL} GROUP BY file)")
def pressure(spark, d):
    return scan.pressure(scan.merge_hits(_hits(spark, d)))


FACETS_SQL = f"""(SELECT query, facet, count(*) AS n_matches, count(DISTINCT file) AS n_files, min(struct_pack(file := file, line := line)) AS f
    FROM (SELECT query, file, line, trim(regexp_replace(unnest(regexp_extract_all(text, rx)), '\\s+', ' ', 'g')) AS facet FROM {KEPT_SQL}) WHERE facet <> '' GROUP BY query, facet)"""


@query("evidence_facets", f"SELECT query::INT AS query, facet, n_matches, n_files, f.file AS first_file, f.line AS first_line FROM {FACETS_SQL}")
def facets(spark, d):
    return scan.facets(_hits(spark, d))


@query("evidence_facet_choice", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n_matches DESC, n_files DESC, facet) AS top FROM {FACETS_SQL}),
    s AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (top = 1)::INT, (n_matches < 2)::INT, n_matches, n_files, facet) AS rest FROM r)
    SELECT query::INT AS query, max(CASE WHEN top = 1 THEN facet END) AS dominant, max(CASE WHEN rest = 1 AND top <> 1 THEN facet END) AS discriminative FROM s GROUP BY query""")
def facet_choice(spark, d):
    return scan.pick_facets(scan.facets(_hits(spark, d)))


_aff = " ".join(f"WHEN {i} THEN " + (" + ".join(f"CASE WHEN stem = '{w}' THEN 4 WHEN contains(stem, '{w}') THEN 2 WHEN contains(lower(file), '{w}') THEN 1 ELSE 0 END" for w in words) or "0") for i, words in enumerate(WORDS))
LEXICAL_SQL = f"""(SELECT file, list_aggregate(list_sort(list(DISTINCT query)), 'string_agg', ',') AS queries, count(DISTINCT query) AS coverage,
    sum(CASE query {_aff} END)::BIGINT AS path_affinity, sum(1.0::DOUBLE / n_files) AS rarity
    FROM (SELECT f.*, regexp_replace(regexp_extract(lower(file), '([^/]*)$', 1), '\\.[^.]+$', '') AS stem, count(*) OVER (PARTITION BY query) AS n_files FROM {FOUND_SQL} f) GROUP BY file)"""
LEXICAL_ORDER = "coverage DESC, path_affinity DESC, round(rarity, 12) DESC, file"


def _lexical(spark, d):
    return ranking.lexical_rank(scan.discover(_lines(spark, d), SEARCH, cap=None), WORDS)


@query("rank_lexical", f"SELECT row_number() OVER (ORDER BY {LEXICAL_ORDER})::INT AS rank, file, queries, coverage, path_affinity, round(rarity, 9) AS rarity FROM {LEXICAL_SQL} ORDER BY {LEXICAL_ORDER} LIMIT 32")
def lexical(spark, d):
    top = ranking.top_ranked(_lexical(spark, d), ranking.lexical_order(), 32)
    return top.select("rank", "file", F.array_join(F.col("queries").cast("array<string>"), ",").alias("queries"), "coverage", "path_affinity", F.round("rarity", 9).alias("rarity"))


def _probed(spark, d):
    top = ranking.top_ranked(_lexical(spark, d), ranking.lexical_order(), 32)
    return ranking.probe_rank(top, _hits(spark, d))


_hint = r"^(export\s+)?(async\s+)?(def|class|function|interface|type|enum|struct|trait|fn)\b"


@query("rank_probed", f"""WITH t AS (SELECT *, row_number() OVER (ORDER BY {LEXICAL_ORDER}) AS r FROM {LEXICAL_SQL} ORDER BY {LEXICAL_ORDER} LIMIT 32),
    p AS (SELECT file, count(*) AS line_hits, sum(n) AS exact_matches, sum(regexp_matches(trim(text), '{_hint}')::INT) AS hints FROM {KEPT_SQL} GROUP BY file),
    j AS (SELECT t.*, coalesce(line_hits, 0) AS line_hits, coalesce(exact_matches, 0) AS exact_matches, coalesce(hints, 0) AS hints FROM t LEFT JOIN p USING (file))
    SELECT row_number() OVER (ORDER BY coverage DESC, path_affinity DESC, hints DESC, least(3, exact_matches) DESC, r, file)::INT AS rank, file, line_hits::BIGINT AS line_hits, exact_matches::BIGINT AS exact_matches, hints::BIGINT AS definition_hints FROM j""")
def probed(spark, d):
    rows = ranking.top_ranked(_probed(spark, d).withColumnRenamed("rank", "initial"), ranking.probe_order("initial"), 32)
    return rows.select("rank", "file", "line_hits", "exact_matches", "definition_hints")


def _fair_sql() -> str:
    """The reservation written out, a step a query, then the best others."""
    steps = ["s0 AS (SELECT []::VARCHAR[] AS chosen, []::INT[] AS covered)"]
    for i in range(len(SEARCH)):
        turn = f"(SELECT query FROM turns WHERE t = {i + 1})"
        best = f"(SELECT {{c}} FROM r WHERE list_contains(r.qs, {turn}) AND NOT list_contains(s.chosen, r.file) ORDER BY r.place LIMIT 1)"
        go = f"({turn} IS NOT NULL AND NOT list_contains(s.covered, {turn}) AND {best.format(c='r.file')} IS NOT NULL)"
        steps.append(f"s{i + 1} AS (SELECT CASE WHEN {go} THEN list_append(s.chosen, {best.format(c='r.file')}) ELSE s.chosen END AS chosen, CASE WHEN {go} THEN list_concat(s.covered, {best.format(c='r.qs')}) ELSE s.covered END AS covered FROM s{i} s)")
    n = len(SEARCH)
    return f"""WITH x AS (SELECT *, list_sort(list_transform(string_split(queries, ','), lambda v: v::INT)) AS qs FROM {LEXICAL_SQL}), r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {LEXICAL_ORDER}) AS place FROM x),
    turns AS (SELECT query, row_number() OVER (ORDER BY count(*), query) AS t FROM {FOUND_SQL} GROUP BY query), {", ".join(steps)},
    f AS (SELECT file, place, list_contains((SELECT chosen FROM s{n}), file) AS taken FROM r), k AS (SELECT *, row_number() OVER (ORDER BY taken DESC, place) AS n FROM f)
    SELECT row_number() OVER (ORDER BY place)::INT AS position, file FROM k WHERE n <= 8"""


@query("select_fair_files", _fair_sql())
def fair_files(spark, d):
    found = scan.discover(_lines(spark, d), SEARCH, cap=None)
    files = ranking.reserve_and_fill(ranking.lexical_rank(found, WORDS), found, 8, by=ranking.lexical_order())
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(files)], "position int, file string")


@query("select_reserved_files", _fair_sql().replace("WHERE n <= 8", "WHERE taken"))
def reserved_files(spark, d):
    """Only what the queries reserve, nothing to fill up."""
    found = scan.discover(_lines(spark, d), SEARCH, cap=None)
    files = ranking.reserve_and_fill(ranking.lexical_rank(found, WORDS), found, 8, fill=False, by=ranking.lexical_order())
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(files)], "position int, file string")


def _fields(spark, d):
    files = _files(spark, d)
    first = F.regexp_extract("source", r"^([^\n]*)", 1)
    parts = F.array(*(F.struct(F.lit(f).alias("field"), c.alias("text")) for f, c in (("path", F.col("file")), ("code", F.col("source")), ("comments", first))))
    return files.select("file", F.explode(parts).alias("p")).select("file", "p.field", "p.text")


_raw = r"regexp_extract_all(text, '[\p{L}\p{N}_$\-./:]+')"
_ends = r"regexp_replace(regexp_replace(x, '^[^\p{L}\p{N}$]+', ''), '[^\p{L}\p{N}$]+$', '')"
FIELDS_SQL = f"(SELECT file, 'path' AS field, file AS text FROM {FILES_SQL} UNION ALL SELECT file, 'code', source FROM {FILES_SQL} UNION ALL SELECT file, 'comments', regexp_extract(source, '^([^\\n]*)', 1) FROM {FILES_SQL})"
TOKENS_SQL = rf"""(SELECT file, field, unnest(list_concat([w], CASE WHEN len(p) > 1 THEN list_filter(p, lambda y: len(y) >= 2 AND y <> w) ELSE [] END)) AS term FROM
    (SELECT file, field, lower(t) AS w, list_filter(string_split_regex(lower(regexp_replace(t, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g')), '[ _\-./:]+'), lambda y: y <> '') AS p FROM
        (SELECT file, field, unnest(list_filter(list_transform({_raw}, lambda x: {_ends}), lambda x: len(x) >= 2)) AS t FROM {FIELDS_SQL})))"""


@query("text_code_tokens", f"SELECT file, field, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, min(term) AS first_term, max(term) AS last_term FROM {TOKENS_SQL} GROUP BY file, field")
def code_tokens(spark, d):
    rows = ranking.field_tokens(_fields(spark, d))
    return rows.groupBy("file", "field").agg(F.count("*").alias("n_tokens"), F.countDistinct("term").alias("n_terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


_terms = ", ".join(f"('{t}')" for t in TERMS)
_cfg = ", ".join(f"('{f}', {w}, {b})" for f, (w, b) in ranking.FIELDS.items())
BM25_SQL = f"""(WITH tok AS (SELECT * FROM {TOKENS_SQL}), docs AS (SELECT file FROM {FILES_SQL}), nd AS (SELECT count(*)::DOUBLE AS n FROM docs),
    len AS (SELECT file, field, count(*) AS n FROM tok GROUP BY file, field), avg AS (SELECT field, greatest(sum(n) / (SELECT n FROM nd), 1.0) AS a FROM len GROUP BY field),
    tf AS (SELECT file, field, term, count(*) AS tf FROM tok WHERE term IN (SELECT * FROM (VALUES {_terms}) t(x)) GROUP BY file, field, term),
    df AS (SELECT term, count(DISTINCT file) AS df FROM tf GROUP BY term),
    w AS (SELECT tf.file, tf.term, sum(weight * tf / greatest(1 - b + b * (len.n / a), 0.01)) AS wtf FROM tf JOIN len USING (file, field) JOIN avg USING (field) JOIN (VALUES {_cfg}) c(field, weight, b) USING (field) GROUP BY tf.file, tf.term)
    SELECT docs.file, coalesce(s.score, 0.0) AS bm25f FROM docs LEFT JOIN (SELECT file, sum(ln(1 + ((SELECT n FROM nd) - df + 0.5) / (df + 0.5)) * (2.2 * wtf / (1.2 + wtf))) AS score FROM w JOIN df USING (term) GROUP BY file) s USING (file))"""


def _bm25(spark, d):
    return ranking.bm25f(_files(spark, d), ranking.field_counts(_fields(spark, d), TERMS), TERMS)


@query("rank_bm25f", f"SELECT file, round(bm25f, 6) AS bm25f FROM {BM25_SQL}")
def bm25f(spark, d):
    return _bm25(spark, d).select("file", F.round("bm25f", 6).alias("bm25f"))


@query("rank_matched_terms", f"SELECT file, field, list_aggregate(list_sort(list(DISTINCT term)), 'string_agg', ',') AS terms FROM {TOKENS_SQL} WHERE term IN (SELECT * FROM (VALUES {_terms}) t(x)) GROUP BY file, field")
def matched_terms(spark, d):
    return ranking.matched_terms(ranking.field_tokens(_fields(spark, d)), TERMS)


@query("rank_fused", f"""WITH lex AS (SELECT file, row_number() OVER (ORDER BY {LEXICAL_ORDER}) AS exact_rank FROM {LEXICAL_SQL} ORDER BY {LEXICAL_ORDER} LIMIT 32),
    s AS (SELECT b.file, bm25f, exact_rank FROM {BM25_SQL} b LEFT JOIN lex USING (file)), r AS (SELECT file, row_number() OVER (ORDER BY round(bm25f, 12) DESC, file) AS bm25_rank FROM s WHERE bm25f > 0),
    f AS (SELECT s.file, bm25f, exact_rank, bm25_rank, coalesce(1.0::DOUBLE / (60 + exact_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) AS rrf FROM s LEFT JOIN r USING (file))
    SELECT row_number() OVER (ORDER BY round(rrf, 12) DESC, round(bm25f, 12) DESC, file)::INT AS rank, file, round(rrf, 9) AS rrf, round(bm25f, 6) AS bm25f, exact_rank::INT AS exact_rank, bm25_rank::INT AS bm25_rank
    FROM f ORDER BY round(rrf, 12) DESC, round(bm25f, 12) DESC, file LIMIT 32""")
def fused(spark, d):
    top = ranking.top_ranked(_lexical(spark, d), ranking.lexical_order(), 32).select("file", F.col("rank").alias("exact_rank"))
    rows = ranking.fused(_bm25(spark, d).join(F.broadcast(top), "file", "left"))  # 32 rows
    return rows.select("rank", "file", F.round("rrf", 9).alias("rrf"), F.round("bm25f", 6).alias("bm25f"), "exact_rank", "bm25_rank")


@query("evidence_context_ranges", f"""WITH last AS (SELECT file, max(line) AS last FROM {LINES_SQL} GROUP BY file), h AS (SELECT DISTINCT file, line FROM {KEPT_SQL}),
    r AS (SELECT file, greatest(1, line - 2) AS s, least(last, line + 2) AS e FROM h JOIN last USING (file)),
    m AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM r),
    i AS (SELECT *, sum((pe IS NULL OR s > pe + 1)::INT) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT file, min(s)::BIGINT AS start_line, max(e)::BIGINT AS end_line FROM i GROUP BY file, island""")
def context_ranges(spark, d):
    last = _lines(spark, d).groupBy("file").agg(F.max("line").alias("last"))
    out = ranges.around(_hits(spark, d), last, 2)
    return out.select("file", F.col("start").alias("start_line"), F.col("end").alias("end_line"))


@query("evidence_raw_report", f"""WITH k AS MATERIALIZED {KEPT_SQL}, l AS (SELECT * FROM {LINES_SQL}), last AS (SELECT file, max(line) AS last FROM l GROUP BY file), a AS (SELECT DISTINCT file, unnest(range(greatest(1, line - 2), least(last, line + 2) + 1)) AS line FROM k JOIN last USING (file)),
    m AS (SELECT DISTINCT file, line, true AS marked FROM k), r AS (SELECT l.file, l.line, coalesce(marked, false) AS marked, l.text FROM a JOIN l ON l.file = a.file AND l.line = a.line LEFT JOIN m ON m.file = l.file AND m.line = l.line)
    SELECT file, line, marked, text FROM (SELECT *, sum(strlen(file || ':' || line || ':' || text) + 1) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS spent FROM r) WHERE spent <= 5000""")
def raw_report(spark, d):
    return evidence.raw_rows(_hits(spark, d), _lines(spark, d))


@query("evidence_fact_keys", f"SELECT 'hit' AS kind, count(*) AS n FROM (SELECT DISTINCT file, line FROM {KEPT_SQL}) UNION ALL SELECT 'line', count(*) FROM (SELECT DISTINCT file, line FROM {KEPT_SQL})")
def fact_keys(spark, d):
    return evidence.fact_kinds(evidence.fact_keys(_hits(spark, d)).select("key").distinct())


@query("evidence_negative_facts", f"SELECT q.query::INT AS query FROM (VALUES {_q}) AS q(query, rx) WHERE q.query NOT IN (SELECT query FROM {HITS_SQL})")
def negative_facts(spark, d):
    return evidence.negative_facts(scan.scan_status(spark, _hits(spark, d), SEARCH)).select("query")


@query("evidence_hit_novelty", f"SELECT query::INT AS query, file, line, line % 3 <> 0 AS novel FROM {KEPT_SQL}")
def hit_novelty(spark, d):
    """A hit is novel if any of its facts is; those of every third line are known."""
    hits = _hits(spark, d)
    facts = evidence.fact_keys(hits)
    known = facts.where("line % 3 = 0").union(evidence.fact_keys(hits.where("line % 3 = 1 and query = 0")).where("key like 'hit%'"))
    return evidence.novel_hits(hits.select("query", "file", "line"), facts, known)


@query("evidence_variant_order", f"SELECT query::INT AS query, file, text, row_number() OVER (PARTITION BY query, file ORDER BY count(*) DESC, text)::INT AS position FROM {KEPT_SQL} GROUP BY query, file, text")
def variant_order(spark, d):
    rows = evidence.grouped(_hits(spark, d).withColumn("asked", F.col("query")), ["asked", "file"], ["text"])
    return rows.select(F.col("asked").alias("query"), "file", F.posexplode("variants").alias("p", "v")).select("query", "file", "v.text", (F.col("p") + 1).alias("position"))


@query("evidence_grouped", f"""WITH v AS (SELECT query, file, text, count(*) AS n FROM {KEPT_SQL} GROUP BY ALL), g AS (SELECT query, file, count(*) AS n_variants, sum(n)::BIGINT AS hit_count FROM v GROUP BY ALL),
    l AS (SELECT query, file, list_sort(list(DISTINCT line)) AS ls FROM {KEPT_SQL} GROUP BY ALL)
    SELECT query::INT AS query_key, file, hit_count, n_variants, list_aggregate(ls[1:8], 'string_agg', ',') AS lines, len(ls) > 8 AS lines_truncated, round(n_variants / hit_count, 6) AS variant_diversity FROM g JOIN l USING (query, file)""")
def grouped(spark, d):
    hits = _hits(spark, d).withColumn("query_key", F.col("query"))
    rows = evidence.valid_groups(evidence.grouped(hits, ["query_key", "file"], ["text"]))
    return rows.select("query_key", "file", "hit_count", "n_variants", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), "lines_truncated", F.round("variant_diversity", 6).alias("variant_diversity"))


def _identifiers(spark, d, stop_words):
    ids = text.identifiers(F.col("text"), stop_words=stop_words)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(ids).cast("long").alias("n"), F.array_join(ids, ",").alias("names"))


@query("text_identifiers", r"""WITH s(w) AS (VALUES ('and'),('as'),('async'),('await'),('break'),('case'),('catch'),('class'),('const'),('continue'),('def'),('default'),('do'),('else'),('except'),('export'),('extends'),('false'),('finally'),('for'),('from'),('function'),('if'),('import'),('in'),('interface'),('let'),('new'),('none'),('null'),('of'),('pass'),('return'),('static'),('super'),('switch'),('this'),('throw'),('true'),('try'),('type'),('var'),('while'),('with'),('yield')),
    x AS (SELECT doc_id, u.i, u.w FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*') AS l FROM documents), LATERAL (SELECT unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i) u),
    f AS (SELECT doc_id, w, min(i) AS i FROM x WHERE lower(w) NOT IN (SELECT w FROM s) GROUP BY doc_id, w), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f)
    SELECT d.doc_id, count(rn) AS n, coalesce(string_agg(w, ',' ORDER BY i), '') AS names FROM documents d LEFT JOIN (SELECT * FROM r WHERE rn <= 160) r ON d.doc_id = r.doc_id GROUP BY d.doc_id""")
def identifiers(spark, d):
    return _identifiers(spark, d, text.STOP_WORDS)


@query("text_clips", r"""SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 80) AS clipped, CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 40 THEN left(trim(regexp_replace(text, '\s+', ' ', 'g')), 40) || '…' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS marked, length(text)::BIGINT AS n_chars_utf16 FROM documents""")
def clips(spark, d):
    t = F.col("text")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.compact(t, 80).alias("clipped"), text.compact(t, 40, True).alias("marked"), text.utf16_length(t).alias("n_chars_utf16"))


ASKED = ["MIT License", "mit LICENSE", "license released mit", "(?i)NoSuchThing at all"]
_WORDS_SQL = {"license released mit": ["license", "released", "mit"], "(?i)NoSuchThing at all": ["nosuchthing", "all"]}


def _relaxed_sql(q: str) -> str:
    words = " AND ".join(f"contains(lower(text), '{w}')" for w in _WORDS_SQL.get(q, [w.lower() for w in q.split()]))
    return f"""SELECT '{q}' AS query, file, line, text, match_mode FROM (SELECT *, regexp_matches(text, '{q}') AS a, regexp_matches(text, '(?i){q}') AS b, {words} AS c, bool_or(regexp_matches(text, '{q}')) OVER () AS any_a, bool_or(regexp_matches(text, '(?i){q}')) OVER () AS any_b FROM {LINES_SQL}) t,
        LATERAL (SELECT CASE WHEN any_a THEN 'exact' WHEN any_b THEN 'case_fold' ELSE 'all_words' END AS match_mode) WHERE CASE match_mode WHEN 'exact' THEN a WHEN 'case_fold' THEN b ELSE c END"""


@query("scan_relaxed", " UNION ALL ".join(map(_relaxed_sql, ASKED)))
def relaxed(spark, d):
    """Each query in the first way that finds something."""
    out = None
    for q in ASKED:
        rows = scan.relax(_lines(spark, d), q).withColumn("query", F.lit(q))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("scan_fallback_hits", f"SELECT query::INT AS query, file, line, CASE WHEN query % 2 = 0 THEN n ELSE 0 END::INT AS n_texts FROM {KEPT_SQL}")
def fallback_hits(spark, d):
    """Hits of a fallback keep their line and lose what only an exact match can claim."""
    hits = _hits(spark, d).withColumn("match_mode", F.when(F.col("query") % 2 == 0, "exact").otherwise("all_words"))
    return scan.without_exact(hits).select("query", "file", "line", F.size("match_texts").alias("n_texts"))


@query("scan_cooccurrence", f"""SELECT file, (a + b + c)::BIGINT AS n_atoms, (a + b + c) / 3.0::DOUBLE AS branch_ratio, 1::BIGINT AS n_branches FROM (SELECT file, max(contains(lower(text), 'mit')::INT) AS a, max(contains(lower(text), 'license')::INT) AS b, max(contains(lower(text), 'released')::INT) AS c FROM {LINES_SQL} GROUP BY file) WHERE a + b + c >= 2""")
def cooccurrence(spark, d):
    return scan.cooccurrence(_lines(spark, d), [["mit", "license", "released"]], most_files=0).withColumn("branch_ratio", F.col("branch_ratio").cast("double"))


def _quorum(words: list[str]) -> str:
    flags = ", ".join(f"max(contains(lower(text), '{w}')::INT) AS w{i}" for i, w in enumerate(words))
    n = " + ".join(f"w{i}" for i in range(len(words)))
    q = f"(SELECT file, ({n})::BIGINT AS n_atoms, ({n}) / {len(words)}.0::DOUBLE AS branch_ratio FROM (SELECT file, {flags} FROM {LINES_SQL} GROUP BY file) WHERE {n} >= {max(2, -(-len(words) // 2))})"
    return f"SELECT '{words[0]}' AS first_word, file, n_atoms, branch_ratio FROM {q} WHERE (SELECT count(*) FROM {q}) <= 24"


QUORUMS = [["mit", "license", "released"], ["warranty", "royalty", "patent"], ["doc", "zebra", "general", "public"]]


@query("scan_cooccurrence_capped", " UNION ALL ".join(map(_quorum, QUORUMS)))
def cooccurrence_capped(spark, d):
    """Words that too many files share choose none."""
    out = None
    for words in QUORUMS:
        rows = scan.cooccurrence(_lines(spark, d), [words]).select(F.lit(words[0]).alias("first_word"), "file", "n_atoms", F.col("branch_ratio").cast("double").alias("branch_ratio"))
        out = rows if out is None else out.union(rows)
    return out


@query("scan_whole_word", f"SELECT DISTINCT file FROM {LINES_SQL} WHERE regexp_matches(text, '\\bthe\\b')")
def whole_word(spark, d):
    return _lines(spark, d).where(text.whole_word(F.col("text"), F.lit("the"))).select("file").distinct()
