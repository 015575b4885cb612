"""Queries of imports, syntax and edits, over the modules made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import imports, paths, python_ast, queries, script_tokens, text
from corvane.functions.nodes import node_table
from corvane.operators import closure, evidence, graph, ranking, rename, syntax, targets, verify
from corvane.query import query, table
from corvane.scratch import dealt, kept, large
from corvane.sources import corpus, modules
from corvane.sources.modules import LINES_SQL, MODULES_SQL

# --- imports and the graph

_STATEMENTS = f"""(SELECT n, file, line, 'python_from' AS kind, regexp_extract(text, '^from (\\S+) import', 1) AS spec, regexp_extract(text, ' import (\\w+)', 1) AS source,
    coalesce(nullif(regexp_extract(text, ' as (\\w+)$', 1), ''), regexp_extract(text, ' import (\\w+)', 1)) AS local FROM {LINES_SQL} WHERE text LIKE 'from %'
    UNION ALL SELECT n, file, line, 'python_import', 'os', 'os', 'os' FROM {LINES_SQL} WHERE text = 'import os')"""
_TARGETS = f"(SELECT *, CASE WHEN spec LIKE '.%' THEN 'pkg/' || substr(spec, 2) || '.py' ELSE replace(spec, '.', '/') || '.py' END AS path FROM {_STATEMENTS})"
RESOLVED_SQL = f"""(SELECT s.*, m.file AS target, CASE WHEN m.file IS NOT NULL THEN 'resolved' WHEN spec LIKE '.%' THEN 'unresolved' ELSE 'external' END AS status
    FROM {_TARGETS} s LEFT JOIN (SELECT file FROM {MODULES_SQL}) m ON m.file = s.path)"""
EDGES_SQL = f"(SELECT DISTINCT file AS f, target AS t, kind, line AS witness_line, spec FROM {RESOLVED_SQL} WHERE status = 'resolved' AND file <> target)"


def _modules(spark, d):
    return modules.modules(spark, d)


def _lines(spark, d):
    return corpus.plain_lines(_modules(spark, d))


def _resolved(spark, d):
    files = _modules(spark, d)
    return graph.resolved(imports.all_imports(files, corpus.plain_lines(files)), files)


@query("import_resolution", f"SELECT file, line, kind, spec, local, source, target, status FROM {RESOLVED_SQL}")
def import_resolution(spark, d):
    return _resolved(spark, d).select("file", "line", "kind", "spec", F.array_join("local", ",").alias("local"), F.array_join("source", ",").alias("source"), "target", "status")


@query("import_edges", f"SELECT f AS \"from\", t AS \"to\", kind, witness_line, spec FROM {EDGES_SQL}")
def import_edges(spark, d):
    return graph.edges(_resolved(spark, d))


@query("import_statistics", f"SELECT count(*) FILTER (status = 'resolved' AND file <> target) AS local_resolved, count(*) FILTER (status = 'unresolved') AS local_unresolved, 0::BIGINT AS local_ambiguous, count(*) FILTER (status = 'external') AS external_package FROM {RESOLVED_SQL}")
def import_statistics(spark, d):
    return graph.import_stats(_resolved(spark, d))


def _bindings(spark, d):
    return _bound(kept(_resolved(spark, d)))


def _bound(rows):
    return rows.select(F.col("file").alias("importer"), "target", "status", F.explode(F.arrays_zip("local", "source")).alias("p")).select("importer", "target", "status", F.col("p.local").alias("local"), F.col("p.source").alias("source"))


@query("graph_symbol_closure", f"""WITH RECURSIVE b AS (SELECT DISTINCT file AS importer, target, source, local FROM {RESOLVED_SQL} WHERE status = 'resolved' AND file <> target),
    r(file, importer, target, source, local) AS (SELECT target, * FROM b WHERE source = 'shared' AND target IN (SELECT file FROM {MODULES_SQL} WHERE n % 32 = 0) UNION SELECT r.file, b.* FROM b JOIN r ON b.target = r.importer AND b.source = r.local AND r.local = r.source)
    SELECT file, 'shared' AS symbol, importer, target, source AS source_symbol, local AS local_symbol, local = source AS propagates FROM r""")
def symbol_closure(spark, d):
    """How far a name goes from the first module of each block."""
    sources = _modules(spark, d).where("n % 32 = 0").select("file", F.lit("shared").alias("symbol"))
    return closure.closures(_bindings(spark, d), sources)[0]


@query("graph_closure_guards", f"""WITH b AS (SELECT file AS importer, target, source, local, status FROM {RESOLVED_SQL}), a(file, symbol) AS (VALUES ('pkg/m0.py', 'shared'), ('pkg/m0.py', 'lost'), ('pkg/m3.py', 'C3'), ('pkg/m1.py', 'f1'))
    SELECT file, symbol, CASE WHEN EXISTS (SELECT 1 FROM b WHERE source = symbol AND status = 'unresolved') THEN 'closure_import_unresolved'
    WHEN (SELECT count(DISTINCT importer) FROM b WHERE b.target = a.file AND source = symbol AND local = source AND importer <> a.file) > 32 THEN 'closure_binding_budget_exceeded' END AS reason FROM a""")
def closure_guards(spark, d):
    asked = [("pkg/m0.py", "shared"), ("pkg/m0.py", "lost"), ("pkg/m3.py", "C3"), ("pkg/m1.py", "f1")]
    return closure.closures(_bindings(spark, d), spark.createDataFrame(asked, "file string, symbol string"))[1].select("file", "symbol", "reason")


_ASKED = f"(SELECT file, unnest(['f' || n, 'C' || n, 'K' || n, 'shared', 'lost']) AS symbol FROM {MODULES_SQL})"


CLOSURES_SQL = f"""WITH RECURSIVE m AS MATERIALIZED {MODULES_SQL}, e AS MATERIALIZED (SELECT file AS importer, target, line, source, local, status FROM {RESOLVED_SQL}), b AS MATERIALIZED (SELECT DISTINCT importer, target, source, local FROM e WHERE status = 'resolved' AND importer <> target), s AS MATERIALIZED {_ASKED},
    r(file, symbol, state, d) AS (SELECT file, symbol, file, 0 FROM s WHERE symbol <> 'lost' UNION SELECT r.file, r.symbol, b.importer, d + 1 FROM r JOIN b ON b.target = r.state AND b.source = r.symbol AND b.local = r.symbol WHERE d < 33),
    t AS MATERIALIZED (SELECT file, symbol, state, min(d) AS d FROM r GROUP BY ALL),
    u AS (SELECT DISTINCT t.file, t.symbol, d FROM t JOIN e ON e.target = t.state AND e.status = 'resolved' AND e.importer <> e.target AND e.source <> t.symbol JOIN m ON m.file = e.importer AND contains(m.source, t.symbol)),
    n AS (SELECT file, symbol, d, sum(k) OVER (PARTITION BY file, symbol ORDER BY d) AS bindings FROM (SELECT t.file, t.symbol, d, count(b.importer) AS k FROM t LEFT JOIN b ON b.target = t.state AND b.source = t.symbol GROUP BY ALL)),
    w AS (SELECT file, symbol, arg_min(reason, (d, p)) AS reason FROM (SELECT file, symbol, d, 0 AS p, 'closure_member_binding_unsupported' AS reason FROM u UNION ALL SELECT file, symbol, d, 1, 'closure_binding_budget_exceeded' FROM n WHERE bindings > 32) GROUP BY ALL)
    SELECT s.file, s.symbol, CASE WHEN s.symbol = 'lost' THEN 'closure_import_unresolved' ELSE w.reason END AS reason, CASE WHEN w.reason IS NULL AND s.symbol <> 'lost' THEN (SELECT count(*) FROM t WHERE t.file = s.file AND t.symbol = s.symbol) END AS n_states,
    CASE WHEN w.reason IS NULL AND s.symbol <> 'lost' THEN (SELECT max(bindings) FROM n WHERE n.file = s.file AND n.symbol = s.symbol)::BIGINT END AS n_bindings FROM s LEFT JOIN w ON w.file = s.file AND w.symbol = s.symbol"""


@query("graph_closures", CLOSURES_SQL)
def closures(spark, d):
    """The closures of all names of all modules, with all guards."""
    names = F.explode(F.array(*(F.concat(F.lit(x), "n") for x in "fCK"), F.lit("shared"), F.lit("lost")))
    return _closures(spark, d, _modules(spark, d).select("file", names.alias("symbol")))[1]


def _closures(spark, d, sources):
    files, rows = _modules(spark, d), kept(_resolved(spark, d))  # read by every step below, resolved once
    bindings = _bound(rows)
    return closure.closures(bindings, sources, indexed=files, members=closure.member_uses(_edges_of(rows), closure.mentions(files, sources)), current=bindings)


def _edges_of(rows):
    return rows.where("status = 'resolved' and file <> target").select(F.col("file").alias("importer"), "target", F.col("source").alias("sources"))


@query("graph_import_neighbors", f"""WITH s(seed, position) AS (VALUES ('pkg/m3.py', 0), ('pkg/m20.py', 1)), fw(seed, names) AS (VALUES ('pkg/m3.py', ['f1', 'C3']), ('pkg/m20.py', ['C0'])), rv(seed, names) AS (VALUES ('pkg/m3.py', ['f3']), ('pkg/m20.py', ['f20'])),
    r AS (SELECT seed, position, 'forward' AS direction, e.target AS file, e.line AS witness_line FROM {RESOLVED_SQL} e JOIN s ON e.file = seed JOIN fw USING (seed) WHERE status = 'resolved' AND e.file <> e.target AND list_contains(names, local)
    UNION ALL SELECT seed, position, 'reverse', e.file, e.line FROM {RESOLVED_SQL} e JOIN s ON e.target = seed JOIN rv USING (seed) WHERE status = 'resolved' AND e.file <> e.target AND list_contains(names, e.source))
    SELECT seed, direction, file, witness_line, count(*) OVER () AS total FROM r""")
def import_neighbors(spark, d):
    """Neighbours that share a symbol with the seed's filter; relevance comes before the cap."""
    files = _modules(spark, d)
    seeds = spark.createDataFrame([("pkg/m3.py", 0), ("pkg/m20.py", 1)], "seed string, position int")
    near = graph.touching(imports.all_imports(files, corpus.plain_lines(files)), seeds)
    rows = graph.resolved(near, files).where("status = 'resolved' and file <> target")
    edges = rows.select(F.col("file").alias("from"), F.col("target").alias("to"), "kind", F.col("line").alias("witness_line"), "spec", F.col("local").alias("bindings"), F.col("source").alias("source_symbols"))
    filters = spark.createDataFrame([("pkg/m3.py", ["f1", "C3"], ["f3"]), ("pkg/m20.py", ["C0"], ["f20"])], "seed string, forward array<string>, reverse array<string>")
    return graph.neighbors(edges, seeds, filters=filters).select("seed", "direction", "file", "witness_line", "total")


@query("graph_validated", f"""WITH g AS (SELECT 'pkg/m' || CAST(floor(p_partkey / 2) AS BIGINT) || '.py' AS file, 'forward' AS direction, 'f' || CAST(floor(p_partkey / 2) AS BIGINT) AS symbol FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT 'pkg/m' || p_partkey || '.py', 'reverse', 'f' || CAST(floor(p_partkey / 2) AS BIGINT) FROM part),
    h AS (SELECT l.file, l.line, l.text, direction, symbol FROM {LINES_SQL} l JOIN g ON l.file = g.file WHERE regexp_matches(l.text, '\\b' || symbol || '\\b'))
    SELECT file, direction, symbol AS symbols, min(line) AS first_line FROM h WHERE (direction = 'forward' AND starts_with(text, 'def ' || symbol || '(')) OR (direction = 'reverse' AND line <> 1) GROUP BY file, direction, symbol""")
def validated(spark, d):
    p = table(spark, d, "part").withColumn("half", F.floor(F.col("p_partkey") / 2))
    file, symbols = (lambda n: F.concat(F.lit("pkg/m"), n, F.lit(".py"))), F.array(F.concat(F.lit("f"), "half")).alias("symbols")
    forward = p.where("p_partkey % 2 = 0").select(file("half").alias("file"), F.lit("forward").alias("direction"), symbols)
    guesses = forward.union(p.select(file("p_partkey"), F.lit("reverse"), symbols))
    witness = p.select(file("p_partkey").alias("file"), F.lit(1).cast("long").alias("witness_line"))
    return graph.validated(guesses, _modules(spark, d), witness).withColumn("symbols", F.array_join("symbols", ","))


# --- facts

_FACT_LINES = f"(SELECT * FROM {LINES_SQL} WHERE n % 13 <> 0)"
FACTS_SQL = f"""(SELECT n, file, 'declaration' AS role, CASE WHEN text LIKE 'class %' THEN 'class_definition' ELSE 'function_definition' END AS node_kind, regexp_extract(text, '(?:def|class) (\\w+)', 1) AS name, trim(text) AS signature, line AS start_line,
        CASE WHEN text LIKE '    %' THEN 'C' || n END AS owner FROM {_FACT_LINES} WHERE regexp_matches(text, '^ *(def|class) ')
    UNION ALL SELECT n, file, 'import', CASE WHEN text LIKE 'from %' THEN 'import_from_statement' ELSE 'import_statement' END, NULL, text, line, NULL FROM {_FACT_LINES} WHERE regexp_matches(text, '^(from|import) ')
    UNION ALL SELECT n, file, 'comment', 'comment', NULL, text, line, NULL FROM {_FACT_LINES} WHERE text LIKE '# %'
    UNION ALL SELECT n, file, 'call', 'call', regexp_extract(text, '(\\w+)\\(', 1), regexp_extract(text, '(\\w+\\([^()]*\\))', 1), line, CASE WHEN text = '        return f' || n || '(1, 2)' THEN 'C' || n || '::run' ELSE 'f' || n END FROM {_FACT_LINES} WHERE regexp_matches(text, '\\w\\(') AND NOT regexp_matches(text, '^ *(def|class) '))"""


def _facts(spark, d):
    return python_ast.owned_facts(_modules(spark, d))


@query("python_facts", f"SELECT file, role, node_kind, name, signature, start_line, owner, CASE WHEN name IS NOT NULL THEN concat_ws('::', owner, name) END AS qualified_name FROM {FACTS_SQL}")
def python_facts(spark, d):
    return _facts(spark, d).select("file", "role", "node_kind", "name", "signature", "start_line", "owner", "qualified_name")


@query("python_test_facts", """SELECT o_orderkey AS id, 'test_declaration' AS role, 'test_k' || o_orderkey AS name FROM orders UNION ALL SELECT o_orderkey, 'test_call', CASE WHEN o_orderkey % 2 = 0 THEN 'it' ELSE 'suite.only' END FROM orders
    UNION ALL SELECT o_orderkey, 'call', 'check' FROM orders""")
def test_facts(spark, d):
    o = table(spark, d, "orders")
    call = F.when(F.col("o_orderkey") % 2 == 0, "it").otherwise("suite.only")
    source = F.concat(F.lit("def test_k"), "o_orderkey", F.lit("():\n    "), call, F.lit("(check(1))\n"))
    facts = python_ast.python_facts(o.select(F.col("o_orderkey").cast("string").alias("file"), source.alias("source")))
    return facts.select(F.col("file").cast("long").alias("id"), "role", "name")


@query("definition_unique", f"WITH f AS (SELECT name, start_line, file FROM {FACTS_SQL} WHERE role = 'declaration') SELECT name, count(*) AS n, CASE WHEN count(*) = 1 THEN min(start_line) END AS start_line, CASE WHEN count(*) = 1 THEN min(file) END AS file FROM f GROUP BY name")
def definition_unique(spark, d):
    rows = targets.unique_definitions(_facts(spark, d).where("role = 'declaration'"))
    return rows.select("name", "n", "start_line", "file")


_TOKENS = rf"""(SELECT file, field, unnest(list_concat([w], CASE WHEN len(p) > 1 THEN list_filter(p, lambda y: len(y) >= 2 AND y <> w) ELSE [] END)) AS term FROM
    (SELECT file, field, lower(t) AS w, list_filter(string_split_regex(lower(regexp_replace(t, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g')), '[ _\-./:]+'), lambda y: y <> '') AS p FROM
        (SELECT file, field, unnest(list_filter(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_$\-./:]+'), lambda x: regexp_replace(regexp_replace(x, '^[^\p{{L}}\p{{N}}$]+', ''), '[^\p{{L}}\p{{N}}$]+$', '')), lambda x: len(x) >= 2)) AS t FROM F)))"""
RANK_FIELDS_SQL = f"""(SELECT file, 'path' AS field, file AS text FROM {MODULES_SQL} UNION ALL SELECT file, 'code', source FROM {MODULES_SQL}
    UNION ALL SELECT file, 'symbols', name FROM {FACTS_SQL} WHERE role = 'declaration' UNION ALL SELECT file, 'symbols', concat_ws('::', owner, name) FROM {FACTS_SQL} WHERE role = 'declaration'
    UNION ALL SELECT file, 'signatures', signature FROM {FACTS_SQL} WHERE role = 'declaration' UNION ALL SELECT file, 'comments', signature FROM {FACTS_SQL} WHERE role = 'comment')"""
CODE_TERMS = ["f3", "run", "module", "c3"]


def _rank_texts(spark, d):
    files = _modules(spark, d)
    return python_ast.ranker_texts(files, python_ast.file_facts(files, python_ast.RANKED))


@query("rank_fields", f"SELECT file, field, count(*) AS n, min(text) AS first_text FROM {RANK_FIELDS_SQL} WHERE field <> 'code' GROUP BY file, field")
def rank_fields(spark, d):
    rows = _rank_texts(spark, d).where("field <> 'code'").select("file", "field", F.size("texts").alias("n"), F.array_min("texts").alias("first_text"))
    return rows.groupBy("file", "field").agg(F.sum("n").alias("n"), F.min("first_text").alias("first_text"))


_terms = ", ".join(f"('{t}')" for t in CODE_TERMS)
_cfg = ", ".join(f"('{f}', {w}, {b})" for f, (w, b) in ranking.FIELDS.items())


@query("rank_code", f"""WITH F AS (SELECT * FROM {RANK_FIELDS_SQL}), tok AS (SELECT * FROM {_TOKENS}), docs AS (SELECT file FROM {MODULES_SQL}), nd AS (SELECT count(*)::DOUBLE AS n FROM docs),
    len AS (SELECT file, field, count(*) AS n FROM tok GROUP BY file, field), avg AS (SELECT field, greatest(sum(n) / (SELECT n FROM nd), 1.0) AS a FROM len GROUP BY field),
    tf AS (SELECT file, field, term, count(*) AS tf FROM tok WHERE term IN (SELECT * FROM (VALUES {_terms}) t(x)) GROUP BY file, field, term), df AS (SELECT term, count(DISTINCT file) AS df FROM tf GROUP BY term),
    w AS (SELECT tf.file, tf.term, sum(weight * tf / greatest(1 - b + b * (len.n / a), 0.01)) AS wtf FROM tf JOIN len USING (file, field) JOIN avg USING (field) JOIN (VALUES {_cfg}) c(field, weight, b) USING (field) GROUP BY tf.file, tf.term)
    SELECT docs.file, round(coalesce(s.score, 0.0), 6) AS bm25f FROM docs LEFT JOIN (SELECT file, sum(ln(1 + ((SELECT n FROM nd) - df + 0.5) / (df + 0.5)) * (2.2 * wtf / (1.2 + wtf))) AS score FROM w JOIN df USING (term) GROUP BY file) s USING (file)""")
def rank_code(spark, d):
    """Field-weighted BM25 with the structural fields of the modules."""
    counted = ranking.field_counts(_rank_texts(spark, d), CODE_TERMS)
    counted = counted.groupBy("file", "field").agg(F.sum("n").alias("n"), *(F.sum(f"t{i}").alias(f"t{i}") for i in range(len(CODE_TERMS))))
    return ranking.bm25f(_modules(spark, d), kept(counted), CODE_TERMS).select("file", F.round("bm25f", 6).alias("bm25f"))


# --- hits and what they do

_HITS = f"(SELECT n, file, line, text, unnest(regexp_extract_all(text, '\\b[fgCK][0-9]+\\b')) AS match_text FROM {_FACT_LINES})"
ROLES_SQL = f"""(SELECT n, file, line, match_text,
    CASE WHEN text LIKE 'from %' THEN 'import' WHEN regexp_matches(text, '^(def|class) ') THEN 'definition' WHEN text LIKE 'K%' THEN 'assignment' ELSE 'call' END AS role,
    CASE WHEN text LIKE 'from %' THEN regexp_extract(text, 'import (.*)$', 1) ELSE match_text END AS anchor, trim(text) AS statement,
    CASE WHEN text LIKE 'from %' OR text LIKE 'K%' THEN '<module>' WHEN text LIKE 'class %' THEN 'C' || n WHEN text = '        return f' || n || '(1, 2)' THEN 'run' ELSE 'f' || n END AS symbol_name FROM {_HITS})"""


def _roles(spark, d):
    lines = corpus.lines(_modules(spark, d)).select("file", "line", "start_byte", "text")
    hits = lines.select("file", "line", "start_byte", "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"\b([fgCK][0-9]+)\b"), F.lit(1))).alias("k", "match_text"))
    # the place of the k-th match: what is before it, by splitting at the matches
    before = F.array_join(F.slice(F.split("text", r"\b[fgCK][0-9]+\b"), F.lit(1), F.col("k") + 1), "")
    earlier = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\b([fgCK][0-9]+)\b"), F.lit(1)), F.lit(1), F.col("k")), "")
    at = F.col("start_byte") + F.octet_length(before) + F.octet_length(earlier)
    hits = hits.select("file", "line", "match_text", at.alias("start"), (at + F.octet_length("match_text")).alias("end"))
    hits = hits.withColumn("id", F.xxhash64("file", "start"))
    files = _modules(spark, d)
    longest = files.agg(F.max("n_bytes")).head()[0] or 0
    return syntax.roles(hits, node_table(files, syntax.ROLE_COLUMNS, syntax.of_roles, "bound"), longest, ["file", "line", "match_text"])


@query("evidence_classified", f"SELECT file, line, match_text, role, anchor, statement, symbol_name FROM {ROLES_SQL}")
def classified(spark, d):
    return _roles(spark, d).select("file", "line", "match_text", "role", "anchor", "statement", "symbol_name")


_GROUPS = f"(SELECT file, symbol_name, role, anchor, count(*) AS hit_count, min(line) AS start_line, count(DISTINCT statement) AS n_variants FROM {ROLES_SQL} GROUP BY file, symbol_name, role, anchor)"


@query("evidence_by_role", f"SELECT file, symbol_name, role, anchor, hit_count::BIGINT AS hit_count, n_variants, row_number() OVER (ORDER BY hit_count DESC, file, start_line, role, anchor) AS position FROM {_GROUPS}")
def by_role(spark, d):
    """Evidence groups by symbol, role and anchor, in the order they are told."""
    hits = _roles(spark, d).withColumn("query", F.lit(0))
    rows = evidence.valid_groups(evidence.grouped(hits, ["file", "symbol_name", "role", "anchor"], ["statement"]))
    rows = kept(rows.select("file", "symbol_name", "role", "anchor", "hit_count", "n_variants", F.col("lines")[0].alias("start_line")))
    return evidence.in_order(rows).drop("start_line")


# --- lines: declarations, scopes, members

_DECLARED = "coalesce(nullif(regexp_extract(text, '^\\s*(?:async\\s+def|def|class)\\s+(\\w+)', 1), ''), nullif(regexp_extract(trim(text), '^([A-Za-z_]\\w*)\\s*(?::[^=]+)?=', 1), ''))"


@query("text_declared_symbols", f"SELECT file, line, {_DECLARED} AS symbol FROM {LINES_SQL} WHERE {_DECLARED} IS NOT NULL")
def declared_symbols(spark, d):
    rows = _lines(spark, d).select("file", "line", F.explode(text.declared_symbols(F.col("text"), "python")).alias("symbol"))
    return rows


_JS = "CASE o_orderkey % 6 WHEN 0 THEN 'export async function h' || o_orderkey || '(a) {' WHEN 1 THEN 'export default class K' || o_orderkey || ' {' WHEN 2 THEN 'const v' || o_orderkey || ' = 1' WHEN 3 THEN 'private static m' || o_orderkey || '(a: string): number {' WHEN 4 THEN 'if (x' || o_orderkey || ') {' ELSE 'interface I' || o_orderkey || ' {' END"


@query("text_declared_script_symbols", "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'h' WHEN 1 THEN 'K' WHEN 2 THEN 'v' WHEN 3 THEN 'm' WHEN 4 THEN NULL ELSE 'I' END || o_orderkey AS symbol FROM orders")
def declared_script_symbols(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_JS).alias("text"))
    return rows.select("id", text.declared_symbols(F.col("text"), "typescript").alias("s")).select("id", F.get("s", F.lit(0)).alias("symbol"))


@query("text_member_symbols", "SELECT o_orderkey AS id, 'run' || (o_orderkey % 7) || ',stop' AS members FROM orders")
def member_symbols(spark, d):
    line = F.concat(F.lit("api.run"), F.col("o_orderkey") % 7, F.lit("(x); other.go(); api?.stop; api . run"), F.col("o_orderkey") % 7)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), line.alias("text"))
    return rows.select("id", F.array_join(text.member_symbols(F.col("text"), "api"), ",").alias("members"))


_INDENT = "length(text) - length(ltrim(text))"
_REAL = f"(SELECT file, line, text, {_INDENT} AS indent FROM {LINES_SQL} WHERE trim(text) <> '')"
SCOPES_SQL = f"""(SELECT h.file, h.line AS start_line, least(h.line + 179, coalesce((SELECT min(l.line) - 1 FROM {_REAL} l WHERE l.file = h.file AND l.line > h.line AND l.indent <= h.indent AND NOT regexp_matches(ltrim(l.text), '^[#@]')), (SELECT max(l.line) FROM {LINES_SQL} l WHERE l.file = h.file))) AS end_line
    FROM {_REAL} h WHERE regexp_matches(trim(h.text), '^(def|class) '))"""


WHOLE_SCOPES_SQL = f"""(SELECT h.file, h.line AS start_line, coalesce((SELECT min(l.line) - 1 FROM {_REAL} l WHERE l.file = h.file AND l.line > h.line AND l.indent <= h.indent AND NOT regexp_matches(ltrim(l.text), '^[#@]')), (SELECT max(l.line) FROM {LINES_SQL} l WHERE l.file = h.file)) AS end_line
    FROM {_REAL} h WHERE regexp_matches(trim(h.text), '^(def|class) '))"""


@query("range_indented_scopes", f"SELECT * FROM {WHOLE_SCOPES_SQL}")
def indented_scopes(spark, d):
    return targets.whole_scopes(_modules(spark, d)).select("file", F.col("start").alias("start_line"), F.col("end").alias("end_line"))


@query("range_hit_scopes", f"""WITH l AS MATERIALIZED (SELECT file, line, text, {_INDENT} AS indent FROM {LINES_SQL}), n AS (SELECT file, max(line) AS n FROM l GROUP BY file), h AS (SELECT * FROM l WHERE line % 2 = 1), s AS MATERIALIZED {SCOPES_SQL},
    b AS (SELECT h.file, h.line, max(d.line) AS start_line FROM h JOIN l d ON d.file = h.file AND regexp_matches(trim(d.text), '^(def|class) ') AND d.line BETWEEN h.line - 180 AND h.line AND d.indent <= h.indent GROUP BY ALL)
    SELECT h.file, h.line, coalesce(b.start_line, greatest(1, h.line - 12)) AS start_line, coalesce(s.end_line, least(n, h.line + 12)) AS end_line FROM h JOIN n USING (file) LEFT JOIN b USING (file, line) LEFT JOIN s ON s.file = b.file AND s.start_line = b.start_line""")
def hit_scopes(spark, d):
    """The scopes around every second line."""
    files = _modules(spark, d)
    rows = targets.hit_scopes(_lines(spark, d).where("line % 2 = 1").select("file", "line"), files)
    return rows.select("file", "line", F.col("start").alias("start_line"), F.col("end").alias("end_line"))


_BRACES = "concat('function b', s_suppkey, '(x) { // }', chr(10), '  if (x) {', chr(10), CASE WHEN s_suppkey % 2 = 0 THEN concat('    go({a: 1}, `}${x}}`, /[}]/)', chr(10)) ELSE '' END, '  } /* { */', chr(10), '}', chr(10), 'const c = ', s_suppkey, chr(10))"


@query("range_brace_scopes", "SELECT 'b' || s_suppkey || '.ts' AS file, unnest([1, 2, 3, 6]) AS line, unnest([1, 2, 2, NULL])::BIGINT AS start_line, unnest([5, 4, 4, NULL])::BIGINT AS end_line FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'b' || s_suppkey || '.ts', unnest([1, 2, 3, 6]), unnest([1, 2, 2, NULL]), unnest([4, 3, 3, NULL]) FROM supplier WHERE s_suppkey % 2 = 1")
def brace_scopes(spark, d):
    """The braces around a line; none where it is outside all."""
    files = table(spark, d, "supplier").select(F.concat(F.lit("b"), "s_suppkey", F.lit(".ts")).alias("file"), F.expr(_BRACES).alias("source"), F.array(*map(F.lit, (1, 2, 3, 6))).alias("lines"))
    return targets.brace_scopes(files).select("file", "line", "start_line", "end_line")


_SCRIPT = """concat('import { a', s_suppkey, ' } from "', CASE s_suppkey % 5 WHEN 0 THEN '@/x' WHEN 1 THEN './x' WHEN 2 THEN 'react' WHEN 3 THEN '~/y' ELSE '../z.js' END, '"', chr(10), '// import b from "@/no"', chr(10), 'const t = "import(1)" + `import x from "#/no"`', chr(10),
    CASE WHEN s_suppkey % 3 = 0 THEN concat('const m = await import("./', s_suppkey, '")', chr(10)) ELSE '' END, CASE WHEN s_suppkey % 4 = 1 THEN concat('const q = require("', CASE WHEN s_suppkey % 8 = 1 THEN './' ELSE '' END, 'lib")', chr(10)) ELSE '' END, CASE WHEN s_suppkey % 7 = 0 THEN concat('export { z } from "@/z"', chr(10), 'import "./side.css"', chr(10)) ELSE '' END)"""
_script_specs = r"""(SELECT file, x LIKE '%await import(%' AS dynamic, regexp_extract(x, '"([^"]*)"', 1) AS spec FROM (SELECT 's' || s_suppkey || '.ts' AS file, unnest(string_split(SCRIPT, chr(10))) AS x FROM supplier) WHERE regexp_matches(x, '^import |^const (m|q) '))""".replace("SCRIPT", _SCRIPT)


@query("import_script_counts", f"""SELECT file, count(*) FILTER (spec LIKE '.%' AND NOT dynamic) AS n_local, count(*) FILTER (NOT regexp_matches(spec, '^([@~#]/|\\.)')) AS external_package, count(*) FILTER (regexp_matches(spec, '^[@~#]/')) AS unsupported_alias, count(*) FILTER (spec LIKE '.%' AND dynamic) AS unsupported_dynamic FROM {_script_specs} GROUP BY file""")
def script_counts(spark, d):
    """Imports of scripts by what can be read of them; none of those in comments, strings and templates."""
    files = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit(".ts")).alias("file"), F.expr(_SCRIPT).alias("source"))
    return script_tokens.import_counts(script_tokens.token_table(files))


_OTHERS = """CASE p_partkey % 6 WHEN 0 THEN concat('pub(crate) mod m', p_size, ';', chr(10), '  use crate::a::b', p_size, ';', chr(10), 'model x;') WHEN 1 THEN concat('#include "h', p_size, '.h"', chr(10), ' #  include "d/e.h"', chr(10), '#include <stdio.h>')
    WHEN 2 THEN concat('@import url("c', p_size, '.css");', chr(10), '@import ''d.css'';', chr(10), 'p { margin: 0 }') WHEN 3 THEN concat('<x><xsd:include schemaLocation="s', p_size, '.xsd"/>', chr(10), '<import file="https://far/x"/></x>')
    WHEN 4 THEN concat('FROM base', chr(10), 'COPY --chown=1 a', p_size, ' /b', chr(10), 'add c d') ELSE concat('\\\\i s', p_size, '.sql', chr(10), 'select 1;', chr(10), 'SOURCE t.sql') END"""
_other_file = "concat('f', p_partkey, CASE p_partkey % 6 WHEN 0 THEN '.rs' WHEN 1 THEN '.c' WHEN 2 THEN '.css' WHEN 3 THEN '.xml' WHEN 4 THEN '/Dockerfile' ELSE '.sql' END)"
_PAGE = """concat('<link rel="a" href="css/', page_id, '.css"><script src="', CASE WHEN page_id % 3 = 0 THEN '//far/x.js' ELSE concat('js/', page_id % 7, '.js') END, '"></script>', chr(10), html)"""


@query("import_line_rules", f"""WITH l AS (SELECT file, CAST(i AS BIGINT) AS line, r[i] AS text FROM (SELECT {_other_file} AS file, string_split({_OTHERS}, chr(10)) AS r FROM part), unnest(range(1, len(r) + 1)) AS t(i)),
    p AS (SELECT 'p' || page_id || '.html' AS file, CAST(i AS BIGINT) AS line, r[i] AS text FROM (SELECT page_id, string_split({_PAGE}, chr(10)) AS r FROM pages), unnest(range(1, len(r) + 1)) AS t(i)),
    f AS (SELECT file, line, 'rust_mod' AS kind, regexp_extract(text, '^pub\\(crate\\) mod (\\w+);$', 1) AS spec FROM l WHERE file LIKE '%.rs' UNION ALL SELECT file, line, 'rust_crate_use', regexp_extract(text, 'use crate::([a-z0-9:]+);$', 1) FROM l WHERE file LIKE '%.rs'
    UNION ALL SELECT file, line, 'c_quote_include', regexp_extract(text, '"(.*)"', 1) FROM l WHERE file LIKE '%.c' UNION ALL SELECT file, line, 'css_import', regexp_extract(text, '[a-z0-9]+\\.css', 0) FROM l WHERE file LIKE '%.css'
    UNION ALL SELECT file, line, 'xml_include', regexp_extract(text, '"([^":]*)"', 1) FROM l WHERE file LIKE '%.xml' UNION ALL SELECT file, line, 'docker_copy', regexp_extract(text, '^(?:COPY --chown=1|add) (\\w+)', 1) FROM l WHERE file LIKE '%file' UNION ALL SELECT file, line, 'sql_include', regexp_extract(text, '[a-z0-9]+\\.sql', 0) FROM l WHERE file LIKE '%.sql'
    UNION ALL SELECT file, line, 'html_script', unnest(regexp_extract_all(text, '(?i)<script\\b[^>]*\\bsrc="([^"/][^"]*)"', 1)) FROM p UNION ALL SELECT file, line, 'html_link', unnest(regexp_extract_all(text, '(?i)<link\\b[^>]*\\bhref="([^"]+)"', 1)) FROM p)
    SELECT * FROM f WHERE spec <> ''""")
def line_rules(spark, d):
    """Dependencies that stand on one line: pages with a script and a style sheet, and files of other languages."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("file"), F.expr(_PAGE).alias("source"))
    others = table(spark, d, "part").select(F.expr(_other_file).alias("file"), F.expr(_OTHERS).alias("source"))
    lines = corpus.plain_lines(pages.union(others))
    return imports.line_imports(lines, paths.language(F.col("file")))


# --- checks of edits

_EDIT = "CASE WHEN n % 13 = 0 THEN 0 ELSE n % 6 END"
_BEFORE = f"CASE {_EDIT} WHEN 0 THEN 'return C' || n % 10 || '(y)' WHEN 1 THEN 'return' WHEN 2 THEN 'x = i' WHEN 3 THEN 'y) if' WHEN 4 THEN 'for i in range(y):' || chr(10) || '        x = i' || chr(10) || '    return C' || n % 10 || '(y)' ELSE 'C' || n % 10 || '(' END"


def _nodes_by_id(rows):
    """All nodes, and functions alone, for which less is parsed."""
    files = rows.select(F.col("id").cast("string").alias("file"), "source")
    return node_table(files, syntax.SLICE_COLUMNS), node_table(files, ["file", "kind", "name", "start", "end"], syntax.of_functions, "none")


def _mutations(spark, d):
    m = _modules(spark, d)
    new = F.when(F.col("n") % 4 == 0, "pass").otherwise("y = 1\r\ny = 2")
    return m.select(F.col("n").alias("id"), "source", F.concat(F.lit("f"), "n").alias("symbol"), F.expr(_BEFORE).alias("before"), new.alias("replacement"))


_AT = f"(SELECT n, source, {_BEFORE} AS b, CASE WHEN n % 4 = 0 THEN 'pass' ELSE 'y = 1' || chr(10) || (CASE {_EDIT} WHEN 2 THEN '        ' ELSE '    ' END) || 'y = 2' END AS new FROM {MODULES_SQL})"
COMPILED_SQL = f"""(SELECT n AS id, CASE WHEN n % 13 = 0 THEN 'owner_unavailable' WHEN n % 6 = 1 THEN 'mutation_slice_ambiguous' WHEN n % 6 = 3 THEN 'mutation_slice_not_exact' WHEN n % 6 = 5 THEN 'mutation_slice_not_structural' ELSE 'ok' END AS reason,
    CASE WHEN n % 13 <> 0 AND n % 6 IN (0, 2, 4) THEN instr(source, b) - 1 END AS start_byte, CASE WHEN n % 13 <> 0 AND n % 6 IN (0, 2, 4) THEN instr(source, b) - 1 + strlen(b) END AS end_byte,
    CASE WHEN n % 13 <> 0 THEN CASE n % 6 WHEN 0 THEN 'node' WHEN 2 THEN 'node' WHEN 4 THEN 'siblings' END END AS envelope, CASE WHEN n % 13 <> 0 AND n % 6 IN (0, 2, 4) THEN replace(source, b, new) END AS after FROM {_AT})"""


@query("edit_replacements", f"SELECT id, reason, start_byte::BIGINT AS start_byte, end_byte::BIGINT AS end_byte, envelope, sha256(after) AS after_sha256 FROM {COMPILED_SQL}")
def replacements(spark, d):
    rows = _mutations(spark, d)
    out = syntax.replacements(rows, *_nodes_by_id(rows))
    return out.select("id", "reason", "start_byte", "end_byte", "envelope", F.sha2("after", 256).alias("after_sha256"))


_CHILDREN = f"(SELECT CAST(floor(n / 2) AS BIGINT) AS id, n AS child, n % 3 <> 0 AS keeps, n % 13 = 0 AS broken FROM {MODULES_SQL} WHERE n >= 2)"


@query("edit_renames", f"""WITH c AS MATERIALIZED ({CLOSURES_SQL}), k AS (SELECT id, count(*) AS links, sum(keeps::INT) AS uses, bool_or(broken) AS broken FROM {_CHILDREN} GROUP BY id),
    r AS (SELECT n AS id, source, coalesce(links, 0) AS links, coalesce(uses, 0) AS uses, CASE WHEN n % 11 = 1 THEN 'mutation_contract_invalid' WHEN n = 0 OR n % 13 = 0 THEN 'symbol_not_found' WHEN c.reason IS NOT NULL THEN 'rename_binding_unsupported' WHEN n % 5 = 0 AND links > 0 THEN 'rename_scope_incomplete'
        WHEN n % 7 = 0 THEN 'rename_destination_not_fresh' WHEN broken THEN 'rename_import_validation_failed' ELSE 'ok' END AS reason FROM {MODULES_SQL} m LEFT JOIN c ON c.file = m.file AND c.symbol = 'f' || n LEFT JOIN k ON k.id = n)
    SELECT id, reason, CASE WHEN reason = 'ok' THEN 2 + links + uses ELSE 0 END::BIGINT AS n_edits, CASE WHEN reason = 'ok' THEN sha256(replace(source, 'f' || id || '(', 'h' || id || '(')) END AS after_sha256 FROM r""")
def renames(spark, d):
    """A rename of every module's function with the imports that carry it; some names are taken, some files not handed over."""
    m, n = _modules(spark, d), F.col("n")
    file = lambda x: F.concat(F.lit("pkg/m"), x, F.lit(".py"))
    new = F.when(n % 11 == 1, "1bad").when(n % 7 == 0, F.concat(F.lit("C"), n)).otherwise(F.concat(F.lit("h"), n))
    allowed = F.when(n % 5 == 0, F.array("file")).otherwise(F.array("file", file(n * 2), file(n * 2 + 1)))
    requests = m.select(n.alias("id"), "file", F.when(n == 0, "none").otherwise(F.concat(F.lit("f"), n)).alias("symbol"), new.alias("new_name"), allowed.alias("allowed"))
    rows = kept(_resolved(spark, d))  # read by the closures and the renames
    bindings = _bound(rows)
    members = closure.member_uses_at(_edges_of(rows), m, closure.places(bindings, requests))
    found, verdicts = (kept(x) for x in closure.closures(bindings, requests, indexed=m, members=members, current=bindings))
    files = m.select("file", "source").join(rename.names_of(requests, found), "file")
    nodes = kept(node_table(files, rename.NODE_COLUMNS, rename.of_renames, among="names"))
    edits, reasons = rename.lowered(requests, nodes, found, verdicts, rows)
    after = rename.applied(edits, m).join(m.select("n", "file"), "file").where("id = n").select("id", F.sha2("after", 256).alias("after_sha256"))
    counts = edits.groupBy("id").agg(F.count("*").alias("n_edits"))
    return reasons.join(counts, "id", "left").join(after, "id", "left").select("id", "reason", F.coalesce("n_edits", F.lit(0).cast("bigint")).alias("n_edits"), "after_sha256")


@query("check_identifier_leaves", f"SELECT file, name, count(*) AS n FROM (SELECT file, unnest(regexp_extract_all(regexp_replace(text, '#.*', ''), '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM {_FACT_LINES}) WHERE name NOT IN ('from', 'import', 'as', 'def', 'if', 'return', 'for', 'in', 'class') GROUP BY file, name")
def identifier_leaves(spark, d):
    """How often each name stands in the syntax of each module."""
    return syntax.identifier_leaves(node_table(_modules(spark, d), ["file", "kind", "name"], syntax.of_names))


@query("check_confinement", f"SELECT id, reason IN ('ok', 'no_change') AND id % 5 <> 0 AND id % 7 <> 0 AS pass, CASE WHEN reason NOT IN ('ok', 'no_change') THEN reason WHEN id % 5 = 0 THEN 'slice_certificate_mismatch' WHEN id % 7 = 0 THEN 'compiled_replacement_mismatch' END AS detail FROM {COMPILED_SQL}")
def confinement(spark, d):
    """Claims of an edit against a compilation of its own; some claim another place or text."""
    rows = _mutations(spark, d)
    nodes, functions = _nodes_by_id(rows)
    functions = kept(functions)  # both compilations read them; Spark deals the nodes out once for both
    claimed = syntax.replacements(rows, nodes, functions)
    moved, other = F.col("id") % 5 == 0, F.col("id") % 7 == 0
    claimed = claimed.select("id", (F.col("start_byte") + moved.cast("int")).alias("start_byte"), "end_byte", "envelope", F.when(other, F.concat("after", F.lit("#"))).otherwise(F.col("after")).alias("after"))
    return syntax.confinement_checks(rows.join(large(claimed), "id"), nodes, functions).select("id", "pass", "detail")


@query("check_top_level", f"SELECT n AS id, n % 13 <> 0 AND n % 3 <> 1 AS pass FROM {MODULES_SQL}")
def top_level(spark, d):
    """An edit inside a function, one that also changes a constant, and one of a function renamed."""
    m = _modules(spark, d)
    body = F.replace("source", F.concat(F.lit("return C"), F.col("n") % 10), F.lit("return D0"))
    constant = F.regexp_replace(body, r"\nK(\d+) = \d+\n", "\nK$1 = None\n")
    after = F.when(F.col("n") % 3 == 1, constant).otherwise(body)
    at = F.octet_length(F.substring_index("source", "return C", 1))
    # the edited bytes are those of the body; an occurrence of the text is in every function
    rows = m.select(F.col("n").alias("id"), F.col("source").alias("before"), after.alias("after"), F.array(at).alias("starts"), F.array(at + 9).alias("ends"))
    return syntax.conservation_checks(rows, syntax.sides(rows, syntax.TOP_COLUMNS, syntax.of_top, "none")).select("id", "pass")


@query("check_target", f"SELECT n AS id, n % 13 <> 0 AND n % 4 <> 3 AS pass FROM {MODULES_SQL}")
def target(spark, d):
    """A rename of the definition, an edit that keeps it, one that drops it."""
    m = _modules(spark, d)
    kind = F.when(F.col("n") % 4 < 2, "rename_symbol").otherwise("replace_node")
    renamed = F.replace("source", F.concat(F.lit("def f"), "n", F.lit("(")), F.concat(F.lit("def h"), "n", F.lit("(")))
    after = F.when(F.col("n") % 4 == 2, F.replace("source", F.lit("x = i"), F.lit("x = 2"))).otherwise(renamed)
    rows = m.select(F.col("n").alias("id"), kind.alias("kind"), F.col("source").alias("before"), after.alias("after"), F.concat(F.lit("f"), "n").alias("symbol"), F.concat(F.lit("h"), "n").alias("new_name"))
    return syntax.target_checks(rows, syntax.sides(rows, ["file", "kind", "name"], syntax.of_functions, "none")).select("id", "pass")


@query("check_control_flow", f"""SELECT n AS id, CASE WHEN n % 13 = 0 OR n % 4 = 2 THEN 'skipped' ELSE 'observed' END AS status, CASE WHEN n % 13 <> 0 AND n % 4 <> 2 THEN a END::BIGINT AS before_points, CASE WHEN n % 13 <> 0 AND n % 4 <> 2 THEN a + (n % 4 = 0)::INT END::BIGINT AS after_points,
    CASE WHEN n % 13 <> 0 AND n % 4 <> 2 THEN (n % 4 = 0)::INT END::BIGINT AS delta, CASE WHEN n % 13 = 0 THEN 'source_syntax_invalid' WHEN n % 4 = 2 THEN 'candidate_owner_unavailable' END AS reason
    FROM (SELECT n, (SELECT count(*) FROM unnest(string_split(source, chr(10))) t(x) WHERE regexp_matches(x, '^ +(if|for) ')) AS a FROM {MODULES_SQL})""")
def control_flow(spark, d):
    m = _modules(spark, d)
    more = F.replace("source", F.lit("    return C"), F.lit("    while y:\n        y = 0\n    return C"))
    gone = F.replace("source", F.concat(F.lit("def f"), "n", F.lit("(")), F.concat(F.lit("def h"), "n", F.lit("(")))
    after = F.when(F.col("n") % 4 == 0, more).when(F.col("n") % 4 == 2, gone).otherwise(F.col("source"))
    rows = m.select(F.col("n").alias("id"), F.col("source").alias("before"), after.alias("after"), F.concat(F.lit("f"), "n").alias("symbol"))
    return syntax.control_flow_changes(rows, syntax.sides(rows, syntax.FLOW_COLUMNS, syntax.of_flow, "none"))


@query("check_python_validity", f"SELECT n AS id, CASE WHEN n % 7 = 0 THEN 'structural_only' ELSE 'native_enforced' END AS coverage, n % 7 = 0 OR NOT regexp_matches(source, 'def \\w+\\(:') AS pass FROM {MODULES_SQL}")
def python_validity(spark, d):
    m = _modules(spark, d)
    file = F.when(F.col("n") % 7 == 0, F.lit("a.rs")).otherwise(F.col("file"))
    return python_ast.python_validity(m.select(F.col("n").alias("id"), file.alias("file"), F.col("source").alias("after")))


@query("check_reflective_uses", "SELECT 'r' || p_partkey || '.py' AS file FROM part WHERE p_partkey % 3 = 0")
def reflective_uses(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, "handle").otherwise(F.concat(F.lit("handle"), "p_partkey"))
    source = F.concat(F.lit("def f(o):\n    return getattr(o, '"), name, F.lit("')\nhandle = 'handle'\n"))
    rows = dealt(table(spark, d, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("r"), "p_partkey", F.lit(".py")).alias("file"), source.alias("source"))
    return syntax.reflective_uses(node_table(rows, ["file", "node", "parent", "kind", "field", "nth", "name"], syntax.of_reflection, "none"), spark.createDataFrame([("handle",)], "symbol string")).select("file")


@query("set_closure_topology", f"""WITH b AS (SELECT file AS importer, target, source, local FROM {RESOLVED_SQL} WHERE status = 'resolved' AND source = 'shared')
    SELECT CASE WHEN target = 'pkg/m2.py' THEN 'missing' ELSE 'same' END AS side, importer, target FROM b UNION ALL SELECT 'extra', importer, target FROM b WHERE target = 'pkg/m2.py'""")
def closure_topology(spark, d):
    """Bindings before a rename and after it, where one file was renamed wrongly."""
    before = _bindings(spark, d).where("status = 'resolved' and source = 'shared'").select("importer", "target", "source", "local", (F.col("local") == F.col("source")).alias("propagates"))
    name = F.when(F.col("target") == "pkg/m2.py", "wrong").otherwise("common")
    after = before.select("importer", "target", name.alias("source"), F.when(F.col("propagates"), name).otherwise(F.col("local")).alias("local"), "propagates")
    return verify.closure_differences(before, after, "common").select("side", "importer", "target")


# --- paths, positions, globs

_EXT = {"py": "python", "pyi": "python", "js": "javascript", "tsx": "typescript", "html": "html", "css": "css", "xml": "xml", "sql": "sql", "rs": "rust", "hpp": "c_cpp", "txt": "other"}
_exts = "[" + ", ".join(f"'{e}'" for e in _EXT) + "]"
_map = ", ".join(f"('{e}', '{lang}')" for e, lang in _EXT.items())


@query("path_languages", f"""WITH p AS (SELECT p_partkey AS id, {_exts}[p_partkey % {len(_EXT)} + 1] AS e, CASE p_partkey % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'a/test_' WHEN 2 THEN 'web/' ELSE 'src/spec' END AS d FROM part)
    SELECT id, lang, d = 'tests/' OR (d = 'a/test_' AND e = 'py') OR (d = 'web/' AND e IN ('js', 'tsx')) AS is_test FROM p JOIN (VALUES {_map}) m(e, lang) USING (e)""")
def path_languages(spark, d):
    n = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (n % len(_EXT) + 1).cast("int"))
    folder = F.when(n % 5 == 0, "tests/").when(n % 5 == 1, "a/test_").when(n % 5 == 2, "web/").otherwise("src/spec")
    path = F.concat(folder, F.lit("m"), n, F.when(n % 5 == 2, ".test").otherwise(""), F.lit("."), ext)
    return table(spark, d, "part").select(n.alias("id"), paths.language(path).alias("lang"), paths.likely_test(path).alias("is_test"))


_PATH = "CASE p_partkey % 6 WHEN 0 THEN 'src/a' || p_partkey || '.py' WHEN 1 THEN './a//b' || p_partkey WHEN 2 THEN 'a' || p_partkey || '/../b' WHEN 3 THEN '../a' || p_partkey WHEN 4 THEN '/abs/' || p_partkey ELSE 'a/b' || p_partkey || '/../../c' END"


@query("path_safety", f"""SELECT path, CASE WHEN path LIKE '/%' OR list_contains(string_split(path, '/'), '..') THEN NULL ELSE array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), '/') END AS safe,
    CASE WHEN path LIKE '../%' THEN NULL ELSE array_to_string(list_filter(string_split(regexp_replace(regexp_replace(path, '[^/]+/\\.\\./', ''), '[^/]+/\\.\\./', ''), '/'), lambda x: x NOT IN ('', '.')), '/') END AS normal FROM (SELECT {_PATH} AS path FROM part)""")
def path_safety(spark, d):
    rows = table(spark, d, "part").select(F.expr(_PATH).alias("path"))
    return rows.select("path", paths.safe_relative(F.col("path")).alias("safe"), paths.normalize(F.col("path")).alias("normal"))


@query("path_scopes", "SELECT p_partkey AS id, p_partkey % 4 = 0 AS reserved, p_partkey % 4 IN (0, 2) AS in_scope FROM part")
def path_scopes(spark, d):
    n = F.col("p_partkey")
    path = F.when(n % 4 == 0, F.concat(F.lit(".corvane/src/"), n)).when(n % 4 == 1, F.concat(F.lit(".corvanes/"), n)).when(n % 4 == 2, F.concat(F.lit("src/"), n)).otherwise(F.concat(F.lit("srcs/"), n))
    scope = F.when(n % 4 == 0, ".corvane/src").otherwise("src")
    return table(spark, d, "part").select(n.alias("id"), paths.reserved(path).alias("reserved"), paths.scope_of(path, scope).alias("in_scope"))


@query("path_uris", "SELECT '/a b/' || source || '+' || doc_id || '/é' AS path, 'file://' || replace(url_encode('/a b/' || source || '+' || doc_id || '/é'), '%2F', '/') AS uri, '/a b/' || source || '+' || doc_id || '/é' AS back FROM documents")
def uris(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("/a b/"), "source", F.lit("+"), "doc_id", F.lit("/é")).alias("path")).withColumn("uri", targets.file_uri(F.col("path")))
    return rows.withColumn("back", targets.path_of_uri(F.col("uri")))


# of the character counts whose bytes may be the offset, the one whose bytes are
@query("text_positions", """WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN '🙂é' ELSE '' END AS text, doc_id * 37 % (strlen(text) + 9) AS o FROM documents), s AS (SELECT *, strlen(text) - length(text) AS more FROM t),
    k AS (SELECT doc_id, text, o, list_filter(range(greatest(0, o - more), least(length(text), o) + 1), lambda i: strlen(left(text, i)) = o) AS k FROM s), h AS (SELECT doc_id, o, CASE WHEN len(k) > 0 THEN left(text, k[1]) END AS head FROM k)
    SELECT doc_id, o AS offset_, length(head) - length(replace(head, chr(10), '')) AS line, length(regexp_extract(head, '([^\\n]*)$', 1)) + len(regexp_extract_all(regexp_extract(head, '([^\\n]*)$', 1), '[\\x{10000}-\\x{10FFFF}]')) AS character FROM h""")
def positions(spark, d):
    docs = table(spark, d, "documents")
    source = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "🙂é").otherwise(""))
    rows = docs.select("doc_id", source.alias("source"), (F.col("doc_id") * 37 % (F.octet_length("text") + 9)).cast("int").alias("offset_"))
    p = targets.position_of(F.col("source"), F.col("offset_"))
    return rows.select("doc_id", F.col("offset_").cast("long").alias("offset_"), p["line"].alias("line"), p["character"].alias("character"))


_TREE = "CASE p_partkey % 8 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'node_modules/x/a.py' WHEN 2 THEN 'web/dist/a.py' WHEN 3 THEN '.git/a.py' WHEN 4 THEN 'src/deep/b.ts' WHEN 5 THEN 'a.py' WHEN 6 THEN 'distance/a.py' ELSE 'x/.git/a.py' END"


@query("scan_globs", f"SELECT p_partkey AS id, p_partkey % 8 IN (0, 5, 6, 7) AS python, p_partkey % 8 IN (0, 4, 5, 6, 7) AS any_glob, p_partkey % 8 IN (0, 4) AS in_src FROM part WHERE {_TREE} IS NOT NULL")
def globs(spark, d):
    path = F.expr(_TREE)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), queries.searchable(path, "*.py").alias("python"), queries.searchable(path).alias("any_glob"), queries.searchable(path, "src/**/*.{py,ts}").alias("in_src"))


_LANG = "CASE WHEN c_custkey % 3 = 0 THEN 'py' WHEN c_custkey % 3 = 1 THEN 'css' ELSE 'txt' END"


@query("scan_language_glob", f"""WITH i AS (SELECT c_nationkey AS id, {_LANG} AS e, count(*) AS n FROM customer WHERE c_nationkey % 5 <> 0 OR c_custkey % 3 = 2 GROUP BY ALL), r AS (SELECT n_nationkey AS id, n_nationkey % 7 <> 0 AS complete, CASE WHEN n_nationkey % 2 = 0 THEN ['py'] ELSE ['ts', 'tsx'] END AS want FROM nation),
    t AS (SELECT r.*, list_sort(coalesce(list(e) FILTER (e <> 'txt'), [])) AS there FROM r LEFT JOIN i USING (id) GROUP BY ALL)
    SELECT id, reason = 'requested_language_absent' AS corrected, reason, CASE WHEN reason = 'requested_language_absent' THEN 'src/*' || CASE WHEN len(there) = 1 THEN '.' || there[1] ELSE '.{{' || array_to_string(there, ',') || '}}' END WHEN len(want) = 1 THEN 'src/*.py' ELSE 'src/*.{{ts,tsx}}' END AS glob
    FROM (SELECT *, CASE WHEN NOT complete THEN 'source_inventory_incomplete' WHEN list_has_any(there, want) THEN 'requested_language_present' WHEN len(there) = 0 THEN 'no_supported_source_files' ELSE 'requested_language_absent' END AS reason FROM t)""")
def language_glob(spark, d):
    c = table(spark, d, "customer").where("c_nationkey % 5 <> 0 or c_custkey % 3 = 2")
    inventory = c.groupBy(F.col("c_nationkey").alias("id"), F.expr(_LANG).alias("extension")).agg(F.count("*").alias("n_files"))
    (p, one), (_, two) = queries.language_glob("src/*.py"), queries.language_glob("src/*.{ts,tsx}")
    want = F.when(F.col("n_nationkey") % 2 == 0, F.array(*map(F.lit, one))).otherwise(F.array(*map(F.lit, two)))
    requests = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit(p).alias("prefix"), want.alias("extensions"), (F.col("n_nationkey") % 7 != 0).alias("complete"))
    return queries.corrected_glob(requests, inventory)


# --- words of queries

_STOP = ", ".join(f"'{w}'" for w in queries.QUERY_STOP_WORDS)


def _words_sql(source: str, pattern: str, least: int) -> str:
    return f"""list_filter(list_transform(flatten(list_transform(regexp_extract_all({source}, '{pattern}'), lambda c: string_split_regex(regexp_replace(c, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-\\s]+'))), lambda w: lower(w)), lambda w: len(w) BETWEEN {least} AND 32 AND w NOT IN ({_STOP}))"""


def _first_seen(words: str) -> str:
    return f"list_filter({words}, lambda w, i: list_position({words}, w) = i)"


_QUERY = "concat(p_name, ' with ', replace(p_type, ' ', '_'), CASE WHEN p_partkey % 3 = 0 THEN 'HTTPServer getValue 404' WHEN p_partkey % 3 = 1 THEN concat('|', p_brand, '-the_', p_partkey % 100) ELSE '' END)"


@query("query_tokens", f"WITH w AS (SELECT p_partkey AS id, {_words_sql(_QUERY, '[A-Za-z][A-Za-z0-9_-]{2,}', 3)} AS ws FROM part), f AS (SELECT id, {_first_seen('ws')} AS fs FROM w) SELECT id, array_to_string(fs[1:6], ',') AS tokens, len(fs) >= 2 AS compilable FROM f")
def query_tokens(spark, d):
    q = F.expr(_QUERY)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(queries.compiler_tokens(q), ",").alias("tokens"), queries.compilable(q).alias("compilable"))


@query("query_plans", f"""WITH b AS (SELECT p_partkey AS id, unnest(string_split({_QUERY}, '|')) AS b, unnest(range(len(string_split({_QUERY}, '|')))) AS k FROM part), w AS (SELECT id, k, {_words_sql('b', '[A-Za-z][A-Za-z0-9_-]{2,}|[0-9]{2,8}', 2)} AS ws FROM b),
    f AS (SELECT id, k, {_first_seen('ws')} AS fs FROM w), a AS (SELECT id, bool_and(len(fs) BETWEEN 1 AND 5) AS ok, flatten(list(fs ORDER BY k)) AS al FROM f GROUP BY id), g AS (SELECT id, ok, {_first_seen('al')} AS atoms FROM a)
    SELECT id, CASE WHEN ok AND len(atoms) BETWEEN 2 AND 8 AND len(list_filter(atoms, lambda x: regexp_matches(x, '[a-z]'))) > 0 THEN array_to_string(atoms, ',') END AS atoms FROM g""")
def query_plans(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_QUERY).alias("q"))
    plans = queries.with_plan(queries.branches_of(rows, "id", "q"), F.col("branches"))
    return plans.select("id", F.array_join("plan_atoms", ",").alias("atoms"))


def _path_words(source: str) -> str:
    parts = "string_split_regex(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-\\s]+')"
    return f"flatten(list_transform(regexp_extract_all({source}, '[A-Za-z_][A-Za-z0-9_-]{{2,}}'), lambda w: list_concat([lower(w)], list_filter(list_transform({parts}, lambda p: lower(p)), lambda p: len(p) >= 3))))"


@query("query_rank_terms", f"""WITH a AS (SELECT p_partkey AS id, {_path_words("p_name")} AS x, {_path_words("p_brand || ' ' || p_type")} AS y FROM part), b AS (SELECT id, list_concat(({_first_seen("x")})[1:8], ({_first_seen("y")})[1:8]) AS z FROM a)
    SELECT id, array_to_string(({_first_seen("z")})[1:32], ' ') AS terms FROM b""")
def query_rank_terms(spark, d):
    rows = table(spark, d, "part")
    return rows.select(F.col("p_partkey").alias("id"), F.array_join(queries.rank_terms(F.array("p_name", F.concat_ws(" ", "p_brand", "p_type"))), " ").alias("terms"))


@query("query_anchor", f"WITH w AS (SELECT p_partkey AS id, {_words_sql(_QUERY, '[A-Za-z][A-Za-z0-9_-]{2,}', 3)} AS ws FROM part), f AS (SELECT id, ({_first_seen('ws')})[1:6] AS fs FROM w) SELECT id, (SELECT x FROM unnest(fs) t(x) ORDER BY len(x) DESC, x LIMIT 1) AS anchor FROM f")
def query_anchor(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.anchor(queries.compiler_tokens(F.expr(_QUERY))).alias("anchor"))


_ODD = "CASE p_partkey % 5 WHEN 0 THEN 'a-b' WHEN 1 THEN '' WHEN 2 THEN repeat('x', 81) WHEN 3 THEN '$ok' ELSE '9a' END"


@query("query_symbols", f"SELECT p_partkey AS id, 'f' || p_partkey || CASE WHEN p_partkey % 5 = 3 THEN ',$ok' ELSE '' END || ',_z' AS symbols FROM part WHERE {_ODD} IS NOT NULL")
def query_symbols(spark, d):
    values = F.array(F.concat(F.lit("f"), "p_partkey"), F.expr(_ODD), F.lit("_z"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(queries.symbols(values), ",").alias("symbols"))


@query("text_quoted_strings", "SELECT p_partkey AS id, p_name || '|it''s ' || p_partkey || '|a\"b' AS strings FROM part")
def quoted_strings(spark, d):
    source = F.concat(F.lit('x = "'), "p_name", F.lit("\" + 'it\\'s "), "p_partkey", F.lit("' or \"a\\\"b\""))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(queries.quoted_strings(source), "|").alias("strings"))


@query("text_atoms_in_lines", "SELECT doc_id, contains(lower(text), 'license') AS word, regexp_matches(text, '(^|[^0-9])20([^0-9]|$)') AS number FROM documents")
def atoms_in_lines(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.atom_in_line(t, F.lit("License")).alias("word"), text.atom_in_line(t, F.lit("20")).alias("number"))


@query("query_search_plan", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN 'a' || c_custkey ELSE 'x,y' END AS queries, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN '*.{py,ts}' WHEN c_custkey % 5 <> 0 THEN '*.py' END AS glob, c_custkey % 3 = 0 AND c_custkey % 2 = 1 AS applied FROM customer")
def query_search_plan(spark, d):
    n = F.col("c_custkey")
    old = F.concat(F.lit("a"), n)
    new = F.when(n % 2 == 1, F.concat(F.lit("b"), n)).otherwise(old)
    rows = table(spark, d, "customer").select(n.alias("id"), F.when(n % 3 == 0, "exact").otherwise("unresolved").alias("status"), old.alias("old_name"), new.alias("new_name"), F.array(F.lit("x"), F.lit(""), F.lit("y"), F.lit("x")).alias("queries"), F.when(n % 5 != 0, "*.py").alias("glob"))
    return queries.search_plan(rows, "*.{py,ts}").withColumn("queries", F.array_join("queries", ","))


# --- scopes of evidence for the graph


@query("graph_seed_contexts", f"""WITH h AS (SELECT file, line FROM {LINES_SQL} WHERE text LIKE '        return %'), s AS (SELECT h.file, h.line, max(start_line) AS start_line FROM h JOIN {SCOPES_SQL} sc ON sc.file = h.file AND sc.start_line <= h.line AND sc.end_line >= h.line GROUP BY ALL),
    r AS (SELECT DISTINCT s.file, start_line, end_line FROM s JOIN {SCOPES_SQL} sc USING (file, start_line)), t AS (SELECT r.file, l.line, l.text FROM r JOIN {LINES_SQL} l ON l.file = r.file AND l.line BETWEEN start_line AND end_line)
    SELECT file, count(DISTINCT x) AS n_identifiers, max(owners) AS owners FROM (SELECT file, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS x FROM t) JOIN (SELECT file, string_agg(DISTINCT regexp_extract(l.text, '(?:def|class) (\\w+)', 1), ',' ORDER BY regexp_extract(l.text, '(?:def|class) (\\w+)', 1)) AS owners FROM r JOIN {LINES_SQL} l ON l.file = r.file AND l.line = start_line GROUP BY r.file) o USING (file)
    WHERE lower(x) NOT IN ({", ".join(f"'{w}'" for w in text.STOP_WORDS)}) GROUP BY file""".replace("(SELECT file, string_agg", "(SELECT r.file, string_agg"))
def seed_contexts(spark, d):
    """Identifiers and owners of the scopes around hit lines."""
    lines = _lines(spark, d)
    hits = lines.where(F.col("text").like("        return %")).select("file", "line")
    rows = graph.seed_contexts(hits, lines, targets.indented_scopes(_modules(spark, d)))
    return rows.select("file", F.size("identifiers").cast("long").alias("n_identifiers"), F.array_join("owners", ",").alias("owners"))


