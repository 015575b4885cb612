"""The search: queries over files -> ranked, fairly selected files with their evidence lines.

Discovery and the lexical rank cover all files. The few candidates they leave
are parsed and scored with field-weighted BM25, fused with the lexical rank,
probed for lines and selected fairly; each of these steps reads only the files
that the step before left. What is found is kept until the files are chosen.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import paths, python_ast
from corvane.operators import evidence, ranking, scan
from corvane.query import query
from corvane.sources import corpus

PROBE, EMIT = 8, 4


def search(files: DataFrame, queries: list[str], words: list[list[str]], terms: list[str], budget: int = 5_000, impact: list[str] | None = None) -> DataFrame:
    """(rank, file, line, marked, text) of the emitted files; ``impact``: files that the dependency graph adds, validated."""
    lines = corpus.plain_lines(files)
    found = scan.discover(lines, queries, cap=None).persist(StorageLevel.DISK_ONLY)
    lexical = ranking.top_ranked(ranking.lexical_rank(found, words), ranking.lexical_order(), ranking.MOST_RESULTS)
    exact = lexical.withColumnRenamed("rank", "exact_rank")
    kind, rows = exact.schema, exact.collect()  # MOST_RESULTS rows
    selective = ranking.by_selectivity(found)
    found.unpersist()
    spark = files.sparkSession
    exact, names = spark.createDataFrame(rows, kind), [r["file"] for r in rows] or [""]

    candidates = files.where(F.col("file").isin(names))
    facts = python_ast.file_facts(candidates.where(paths.language(F.col("file")) == "python"), python_ast.RANKED)
    counted = ranking.field_counts(python_ast.ranker_texts(candidates, facts), terms)
    counted = counted.groupBy("file", "field").agg(F.sum("n").alias("n"), *(F.sum(f"t{i}").alias(f"t{i}") for i in range(len(terms))))
    ranked = ranking.fused(ranking.bm25f(candidates, counted, terms).join(F.broadcast(exact), "file"))
    ranked = spark.createDataFrame(ranked.collect(), ranked.schema)  # MOST_RESULTS rows
    probes = ranking.reserve_and_fill(ranked, found, PROBE, order=selective)

    probe_lines = lines.where(F.col("file").isin(probes or [""]))
    hits = scan.scan_lines(probe_lines, queries)
    probed = ranking.probe_rank(ranked.where(F.col("file").isin(probes or [""])).withColumnRenamed("rank", "initial"), hits)
    probed = ranking.top_ranked(probed, ranking.probe_order("initial"), PROBE).collect()  # PROBE rows
    first = [{"file": r["file"], "queries": r["queries"], "place": r["rank"]} for r in probed]
    hinted = [r["file"] for r in probed if r["definition_hints"] > 0]
    emitted = ranking.emit_with_impact([r["file"] for r in probed], ranking.reserved(first, selective, EMIT), hinted, impact or [], EMIT)
    place = F.array_position(F.array(*map(F.lit, emitted or [""])), F.col("file")).cast("int")
    rows = evidence.raw_rows(hits.where(F.col("file").isin(emitted or [""])), probe_lines, budget=budget)
    return rows.select(place.alias("rank"), "file", "line", "marked", "text")


def search_sql(files: str, lines: str, fields: str, queries: list[str], words: list[list[str]], terms: list[str], budget: int = 5_000) -> str:
    """SQL of a search without impact; ``fields`` is a table (file, field, text) that may read the table ``top``."""
    q = ", ".join(f"({i}, '{x}')" for i, x in enumerate(queries))
    affinity = " ".join(f"WHEN {i} THEN " + (" + ".join(f"CASE WHEN stem = '{w}' THEN 4 WHEN contains(stem, '{w}') THEN 2 WHEN contains(lower(file), '{w}') THEN 1 ELSE 0 END" for w in some) or "0") for i, some in enumerate(words))
    hints = r"^(export\s+)?(async\s+)?(def|class|function|interface|type|enum|struct|trait|fn)\b"
    cfg = ", ".join(f"('{f}', {w}, {b})" for f, (w, b) in ranking.FIELDS.items())
    asked = ", ".join(f"('{t}')" for t in terms)
    raw = r"regexp_extract_all(text, '[\p{L}\p{N}_$\-./:]+')"
    trimmed = r"regexp_replace(regexp_replace(x, '^[^\p{L}\p{N}$]+', ''), '[^\p{L}\p{N}$]+$', '')"

    def fair(table: str, name: str, k: int) -> str:
        """Steps of the reservation: the files chosen and the queries covered after each query in turn."""
        steps = [f"{name}0 AS (SELECT []::VARCHAR[] AS chosen, []::INT[] AS covered)"]
        for i in range(len(queries)):
            turn = f"(SELECT query FROM turns WHERE t = {i + 1})"
            best = f"(SELECT {{c}} FROM {table} r WHERE list_contains(r.qs, {turn}) AND NOT list_contains(s.chosen, r.file) ORDER BY r.place LIMIT 1)"
            go = f"({turn} IS NOT NULL AND NOT list_contains(s.covered, {turn}) AND len(s.chosen) < {k} AND {best.format(c='r.file')} IS NOT NULL)"
            steps.append(f"{name}{i + 1} AS (SELECT CASE WHEN {go} THEN list_append(s.chosen, {best.format(c='r.file')}) ELSE s.chosen END AS chosen, CASE WHEN {go} THEN list_concat(s.covered, {best.format(c='r.qs')}) ELSE s.covered END AS covered FROM {name}{i} s)")
        return ", ".join(steps)

    last = len(queries)
    return f"""WITH l AS MATERIALIZED (SELECT file, line, text FROM {lines}), h AS MATERIALIZED (SELECT query, file, line, text, len(regexp_extract_all(text, rx)) AS n FROM l, (VALUES {q}) AS q(query, rx) WHERE regexp_matches(l.text, rx)),
    found AS MATERIALIZED (SELECT DISTINCT query, file FROM h), turns AS (SELECT query, row_number() OVER (ORDER BY count(*), query) AS t FROM found GROUP BY query),
    lex AS (SELECT file, list_sort(list(DISTINCT query)) AS qs, count(DISTINCT query) AS coverage, sum(CASE query {affinity} END)::BIGINT AS path_affinity, sum(1.0::DOUBLE / n_files) AS rarity
        FROM (SELECT f.*, regexp_replace(regexp_extract(lower(file), '([^/]*)$', 1), '\\.[^.]+$', '') AS stem, count(*) OVER (PARTITION BY query) AS n_files FROM found f) GROUP BY file),
    top AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY coverage DESC, path_affinity DESC, round(rarity, 12) DESC, file) AS exact_rank FROM lex QUALIFY exact_rank <= {ranking.MOST_RESULTS}),
    fld AS (SELECT * FROM {fields} WHERE file IN (SELECT file FROM top)),
    tok AS MATERIALIZED (SELECT file, field, unnest(list_concat([w], CASE WHEN len(p) > 1 THEN list_filter(p, lambda y: len(y) >= 2 AND y <> w) ELSE [] END)) AS term FROM
        (SELECT file, field, lower(t) AS w, list_filter(string_split_regex(lower(regexp_replace(t, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g')), '[ _\\-./:]+'), lambda y: y <> '') AS p FROM
            (SELECT file, field, unnest(list_filter(list_transform({raw}, lambda x: {trimmed}), lambda x: len(x) >= 2)) AS t FROM fld))),
    nd AS (SELECT count(*)::DOUBLE AS n FROM top), len AS (SELECT file, field, count(*) AS n FROM tok GROUP BY file, field), avg AS (SELECT field, greatest(sum(n) / (SELECT n FROM nd), 1.0) AS a FROM len GROUP BY field),
    tf AS (SELECT file, field, term, count(*) AS tf FROM tok WHERE term IN (SELECT * FROM (VALUES {asked}) t(x)) GROUP BY file, field, term), df AS (SELECT term, count(DISTINCT file) AS df FROM tf GROUP BY term),
    w AS (SELECT tf.file, tf.term, sum(weight * tf / greatest(1 - b + b * (len.n / a), 0.01)) AS wtf FROM tf JOIN len USING (file, field) JOIN avg USING (field) JOIN (VALUES {cfg}) c(field, weight, b) USING (field) GROUP BY tf.file, tf.term),
    sc AS (SELECT file, sum(ln(1 + ((SELECT n FROM nd) - df + 0.5) / (df + 0.5)) * (2.2 * wtf / (1.2 + wtf))) AS score FROM w JOIN df USING (term) GROUP BY file),
    b AS (SELECT top.*, coalesce(score, 0.0) AS bm25f FROM top LEFT JOIN sc USING (file)), br AS (SELECT file, row_number() OVER (ORDER BY round(bm25f, 12) DESC, file) AS bm25_rank FROM b WHERE bm25f > 0),
    fu AS (SELECT b.*, 1.0::DOUBLE / (60 + exact_rank) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) AS rrf FROM b LEFT JOIN br USING (file)),
    ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round(rrf, 12) DESC, round(bm25f, 12) DESC, file) AS place FROM fu),
    {fair("ranked", "p", PROBE)}, fill AS (SELECT file, row_number() OVER (ORDER BY place) AS x FROM ranked WHERE NOT list_contains((SELECT chosen FROM p{last}), file)),
    probes AS MATERIALIZED (SELECT file FROM ranked WHERE list_contains((SELECT chosen FROM p{last}), file) UNION ALL SELECT file FROM fill WHERE x <= {PROBE} - (SELECT len(chosen) FROM p{last})),
    kept AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY file, line) AS rn FROM h WHERE file IN (SELECT file FROM probes)) WHERE rn <= {scan.LINE_CAP}),
    st AS (SELECT file, sum(n) AS exact_matches, sum(regexp_matches(trim(text), '{hints}')::INT) AS hints FROM kept GROUP BY file),
    pr AS MATERIALIZED (SELECT r.file, r.qs, coalesce(hints, 0) AS hints, row_number() OVER (ORDER BY coverage DESC, path_affinity DESC, coalesce(hints, 0) DESC, least(3, coalesce(exact_matches, 0)) DESC, place, file) AS place FROM ranked r JOIN probes USING (file) LEFT JOIN st USING (file)),
    {fair("pr", "e", EMIT)}, one AS (SELECT file, 1 AS part, place FROM pr WHERE list_contains((SELECT chosen FROM e{last}), file)),
    two AS (SELECT * FROM one UNION ALL (SELECT file, 2, place FROM pr WHERE hints > 0 ORDER BY place LIMIT 1)),
    three AS (SELECT * FROM two UNION ALL SELECT file, 3, place FROM pr), firsts AS (SELECT file, min(struct_pack(part := part, place := place)) AS k FROM three GROUP BY file),
    em AS MATERIALIZED (SELECT file, row_number() OVER (ORDER BY k) AS rank FROM firsts QUALIFY rank <= {EMIT}),
    last AS (SELECT file, max(line) AS last FROM l WHERE file IN (SELECT file FROM em) GROUP BY file), around AS (SELECT DISTINCT file, unnest(range(greatest(1, line - 2), least(last, line + 2) + 1)) AS line FROM kept JOIN last USING (file)),
    rows AS (SELECT l.file, l.line, l.text, EXISTS (SELECT 1 FROM kept k WHERE k.file = l.file AND k.line = l.line) AS marked FROM around a JOIN l ON l.file = a.file AND l.line = a.line),
    cost AS (SELECT *, sum(strlen(file || ':' || line || ':' || text) + 1) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS spent FROM rows)
    SELECT rank::INT AS rank, file, line, marked, text FROM cost JOIN em USING (file) WHERE spent <= {budget}"""


def _documents_sql() -> str:
    from corvane.plans import search_queries as q
    from corvane.sources.corpus import FILES_SQL, LINES_SQL

    fields = f"(SELECT file, 'path' AS field, file AS text FROM {FILES_SQL} UNION ALL SELECT file, 'code', source FROM {FILES_SQL})"
    return search_sql(FILES_SQL, LINES_SQL, fields, q.SEARCH, q.WORDS, q.TERMS)


@query("search_documents", _documents_sql())
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.plans import search_queries as q

    return search(corpus.document_files(spark, sf_dir), q.SEARCH, q.WORDS, q.TERMS)


CODE = [r"return f1[0-9]\(x", "import shared", r"^class C3[05]:", "no such line"]
CODE_WORDS, CODE_TERMS = [["m20", "pkg"], ["m1"], ["m30"], []], ["f10", "run", "shared", "c30", "module"]


def _modules_sql() -> str:
    from corvane.plans.code_queries import RANK_FIELDS_SQL
    from corvane.sources.modules import LINES_SQL, MODULES_SQL

    return search_sql(MODULES_SQL, LINES_SQL, RANK_FIELDS_SQL, CODE, CODE_WORDS, CODE_TERMS, 400)


@query("search_modules", _modules_sql())
def search_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over source files, whose symbols, signatures and comments are scored too."""
    from corvane.sources.modules import modules

    return search(modules(spark, sf_dir), CODE, CODE_WORDS, CODE_TERMS, budget=400)
