"""What a report shows, as rows: novel, hybrid, focused, region, index and route views.

Every view takes the evidence of several reports at once; ``key`` columns tell
them apart. A row has its ``position`` in the report; what does not fit the
byte budget is left out by the rule of the view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.scratch import kept, large

from . import ranges

# Budgets in bytes, and how much of a scope is shown.
ROUTE_BYTES, INDEX_BYTES, REGION_BYTES, FOCUSED_BYTES, LEAST_BYTES = 700, 1400, 2200, 2600, 128
MOST_SCOPES, HEADER_LINES, FULL_LINES, SAMPLE_RADIUS, RADII = 3, 3, 96, 1, (20, 12, 6, 2)
SAMPLES, CONTEXT_RADIUS, MOST_INDEX_FILES = 3, 1, 5
FOCUSED_HITS, FOCUSED_PER_FILE, FOCUSED_SPANS, OVERHEAD_BYTES, OVERHEAD_RATIO = 24, 8, 32, 256, 1.12


def cost(text: Column) -> Column:
    """Bytes of a line and its end."""
    return (F.octet_length(text) + 1).cast("long")


def fitting(rows: DataFrame, key: list[str], order: list, budget: int | Column) -> DataFrame:
    """Rows (key, text) in order up to the first that does not fit, with their position."""
    w = Window.partitionBy(*key).orderBy(*order)
    spent = F.sum(cost(F.col("text"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"position": F.row_number().over(w), "spent": spent}).where(F.col("spent") <= budget).drop("spent")


def labels(queries: Column) -> Column:
    """Q1,Q3 of an array of query numbers from 0."""
    return F.array_join(F.transform(F.array_sort(queries), lambda q: F.concat(F.lit("Q"), q + 1)), ",")


def summary_lines(status: DataFrame, cap: int, what: str = "probed_line_hits", state: str = "probe_scan") -> DataFrame:
    """(query, n, capped, match_mode) -> (query, text): a count that was cut off says so."""
    count = F.when(F.col("capped"), F.concat(F.lit(">="), F.lit(cap))).otherwise(F.col("n").cast("string"))
    mode = F.when(F.col("match_mode") != "exact", F.concat(F.lit(" match="), F.col("match_mode"))).otherwise("")
    done = F.when(F.col("capped"), "scan_cap").otherwise("complete")
    return status.select("query", F.concat(F.lit("Q"), F.col("query") + 1, F.lit(f" {what}="), count, F.lit(f" {state}="), done, F.coalesce(mode, F.lit(""))).alias("text"))


def route_map(candidates: DataFrame, key: list[str], budget: int = ROUTE_BYTES) -> DataFrame:
    """(key, file, rank, queries, selected) -> (key, position, text): the files shown, and how many are kept back."""
    total = candidates.groupBy(*key).agg(F.count_if("selected").alias("n"), F.count("*").alias("all"))
    back = F.col("all") - F.col("n")
    head = total.select(*key, F.lit(0).alias("at"), F.lit(0).alias("rank"), F.concat(F.lit("ROUTE emitted="), F.col("n"), F.lit(" retained="), back).alias("text"))
    body = candidates.where("selected").select(*key, F.lit(1), "rank", F.concat(F.lit("  "), F.col("file"), F.lit(" ["), labels(F.col("queries")), F.lit("]")))
    foot = total.where(back > 0).select(*key, F.lit(2), F.lit(0), F.concat(F.lit("  +"), back, F.lit(" lexical candidates retained_unemitted")))
    return fitting(head.union(body).union(foot), key, ["at", "rank"], budget).select(*key, "position", "text")


def novel_rows(raw: DataFrame, seen_lines: DataFrame, seen_hits: DataFrame) -> DataFrame:
    """Rows (file, line, marked, text) of the raw view whose line or hit was not shown before."""
    rows = raw.join(seen_lines.select("file", "line").distinct().withColumn("l", F.lit(True)), ["file", "line"], "left")
    rows = rows.join(seen_hits.select("file", "line").distinct().withColumn("h", F.lit(True)), ["file", "line"], "left")
    return rows.where(F.col("l").isNull() | (F.col("marked") & F.col("h").isNull())).drop("l", "h")


def first_scopes(scopes: DataFrame, key: list[str], most: int = MOST_SCOPES) -> DataFrame:
    """The first scopes of a report, in the order of evidence.scopes, with their ``place``."""
    order = [F.desc("role_score"), F.desc("n_queries"), F.desc("hit_count"), F.desc("n_lines"), "file", "start_line", "end_line"]
    return scopes.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= most)


def _scope_lines(scopes: DataFrame, key: list[str], spans: Column) -> DataFrame:
    """(key, place, file, line): the distinct lines of the spans of each scope, inside it."""
    rows = scopes.select(*key, "place", "file", "start_line", "end_line", F.explode(spans).alias("s"))
    lines = F.sequence(F.greatest("start_line", "s.a"), F.least("end_line", "s.b"))
    return rows.where(F.greatest("start_line", "s.a") <= F.least("end_line", "s.b")).select(*key, "place", "file", F.explode(lines).alias("line")).distinct()


def _span(a: Column, b: Column) -> Column:
    return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))


def _head() -> Column:
    return _span(F.col("start_line"), F.col("start_line") + HEADER_LINES - 1)


def _headers(scopes: DataFrame, key: list[str], word: str) -> DataFrame:
    text = F.concat(F.lit(word + " "), F.col("file"), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line"), F.lit(" symbol="), F.col("name"), F.lit(" hits="), F.col("hit_count"))
    return scopes.select(*key, "place", "file", F.lit(0).cast("long").alias("line"), text.alias("text"))


def region(scopes: DataFrame, lines: DataFrame, key: list[str], budget: int = REGION_BYTES) -> DataFrame:
    """(key, file, start_line, end_line, name, hit_count, hit_lines, ...) -> (key, position, file, line, text).

    Of each of the first scopes a header, its first lines, and the first, middle
    and last hit with a line around; up to the first row that does not fit.
    """
    some = kept(first_scopes(scopes, key))
    hits = F.array_sort("hit_lines")
    n = F.size(hits)
    picks = F.when(n <= SAMPLES, hits).otherwise(F.array(hits[0], F.get(hits, F.floor((n - 1) / 2).cast("int")), F.get(hits, n - 1)))
    spans = F.concat(F.array(_head()), F.transform(picks, lambda x: _span(x - SAMPLE_RADIUS, x + SAMPLE_RADIUS)))
    shown = _scope_lines(some, key, spans).join(lines.select("file", "line", "text"), ["file", "line"]).select(*key, "place", "file", "line", "text")
    return fitting(_headers(some, key, "REGION_CONTEXT").union(shown), key, ["place", "line"], budget).select(*key, "position", "file", "line", "text")


def focused(scopes: DataFrame, lines: DataFrame, key: list[str], budget: int = FOCUSED_BYTES) -> DataFrame:
    """The whole of short scopes, or all hits with lines around, in the widest form that fits; nothing if none does.

    (key, radius, position, file, line, text); a null radius shows whole scopes.
    """
    some = kept(first_scopes(scopes, key))
    around = lambda r: F.transform("hit_lines", lambda x: _span(x - r, x + r))
    windows = lambda r: F.concat(F.array(_head()), around(r))
    whole = F.when(F.col("end_line") - F.col("start_line") + 1 <= FULL_LINES, F.array(_span(F.col("start_line"), F.col("end_line")))).otherwise(windows(RADII[0]))
    forms = None
    for i, spans in enumerate([whole, *(windows(r) for r in RADII)]):
        form = _scope_lines(some, key, spans).withColumn("form", F.lit(i))
        forms = form if forms is None else forms.union(form)
    shown = forms.join(lines.select("file", "line", "text"), ["file", "line"]).select(*key, "form", "place", "file", "line", "text")
    heads = _headers(some, key, "SCOPE_CONTEXT").withColumn("form", F.explode(F.sequence(F.lit(0), F.lit(len(RADII)))))
    rows = shown.union(heads.select(*key, "form", "place", "file", "line", "text"))
    sizes = rows.groupBy(*key, "form").agg(F.sum(cost(F.col("text"))).alias("n")).where(F.col("n").between(LEAST_BYTES, budget))
    best = large(sizes.groupBy(*key).agg(F.min("form").alias("form")))
    rows = rows.join(best, [*key, "form"])
    radius = F.when(F.col("form") > 0, F.get(F.array(*map(F.lit, RADII)), F.col("form") - 1))
    position = F.row_number().over(Window.partitionBy(*key).orderBy("place", "line"))
    return rows.select(*key, radius.alias("radius"), position.alias("position"), "file", "line", "text")


def focused_allowed(totals: DataFrame) -> Column:
    """Whether the focused form may be tried (columns scan_complete, hits, most_in_file, spans), and is not much longer than raw."""
    few = (F.col("hits") > 0) & (F.col("hits") <= FOCUSED_HITS) & (F.col("most_in_file") <= FOCUSED_PER_FILE) & (F.col("spans") > 0) & (F.col("spans") <= FOCUSED_SPANS)
    limit = F.least(F.col("raw_bytes") + OVERHEAD_BYTES, F.ceil(F.col("raw_bytes") * OVERHEAD_RATIO))
    return F.col("scan_complete") & few & (F.col("focused_bytes") <= limit)


def hybrid(groups: DataFrame, lines: DataFrame, key: list[str], budget: int) -> DataFrame:
    """(key, place, file, header, variants of (text, line)) -> (key, position, kind, file, line, text).

    All headers and variants, or nothing; then a few samples with a line around,
    each whole or passed over.
    """
    groups = kept(groups)
    heads = groups.select(*key, "place", F.lit(-1).alias("v"), "file", F.lit(None).cast("long").alias("line"), F.col("header").alias("text"))
    variants = groups.select(*key, "place", F.posexplode("variants").alias("v", "x"), "file").select(*key, "place", "v", "file", F.col("x.line").alias("line"), F.col("x.text").alias("text"))
    core = heads.union(variants)
    total = large(core.groupBy(*key).agg(F.sum(cost(F.col("text"))).alias("core")).where(F.col("core") <= budget))
    core = core.join(total, key)
    samples = variants.where(F.col("v") < SAMPLES).join(total, key)
    last = large(lines.groupBy("file").agg(F.max("line").alias("last")))
    samples = samples.join(last, "file").withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - CONTEXT_RADIUS), F.least("last", F.col("line") + CONTEXT_RADIUS))))
    shown = samples.drop("text").join(lines.select("file", F.col("line").alias("n"), "text"), ["file", "n"])
    block = shown.groupBy(*key, "place", "v", "core").agg(F.sum(cost(F.col("text"))).alias("bytes"))
    # what is left of the budget after the core: costs are shifted, so that one budget holds for all reports
    first = total.select(*key, F.lit(-1).alias("place"), F.lit(-1).alias("v"), F.col("core").alias("bytes"))
    fits = ranges.greedy_budget(block.select(*key, "place", "v", "bytes").union(first), key, ["place", "v"], F.col("bytes"), budget).where("place >= 0")
    shown = shown.join(large(fits.select(*key, "place", "v")), [*key, "place", "v"], "left_semi")
    rows = core.select(*key, F.lit(0).alias("part"), "place", "v", F.lit("core").alias("kind"), "file", "line", "text")
    rows = rows.union(shown.select(*key, F.lit(1), "place", "v", F.lit("context"), "file", F.col("n"), "text"))
    position = F.row_number().over(Window.partitionBy(*key).orderBy("part", "place", "v", F.col("line").asc_nulls_first()))
    return rows.select(*key, position.alias("position"), "kind", "file", "line", "text")


def index_rows(hits: DataFrame, facets: DataFrame, budget: int = INDEX_BYTES) -> DataFrame:
    """Hits (query, file, line, text, match_texts) -> (position, text): a line per query with its facets, then files by turns.

    ``facets`` is scan.facets() of the hits. No file is told before every query was.
    """
    from . import scan

    per_file = hits.groupBy("query", "file").agg(F.count("*").alias("n_lines"), F.sum(F.size("match_texts")).alias("n_matches"), F.min(F.struct("line", "text")).alias("f"))
    per = per_file.groupBy("query").agg(F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"), F.sum("n_matches").alias("n_matches"))
    chosen = scan.pick_facets(facets)
    known = facets.select("query", "facet", F.col("n_matches").alias("k"), F.col("n_files").alias("kf"), "first_file", "first_line")
    top = chosen.join(known.withColumnRenamed("facet", "dominant"), ["query", "dominant"]).select("query", F.concat(F.lit(" dominant="), "dominant", F.lit(":"), "k").alias("d"))
    route = chosen.join(known.withColumnRenamed("facet", "discriminative"), ["query", "discriminative"])
    route = route.select("query", F.concat(F.lit(" route="), "discriminative", F.lit(":"), "k", F.lit(" route_files="), "kf", F.lit(" route_at="), "first_file", F.lit(":"), "first_line").alias("r"))
    text = F.concat(F.lit("Q"), F.col("query") + 1, F.lit(" index files="), "n_files", F.lit(" collected_lines="), "n_lines", F.lit(" exact_matches="), "n_matches", F.coalesce("d", F.lit("")), F.coalesce("r", F.lit("")))
    heads = per.join(top, "query", "left").join(route, "query", "left").select(F.lit(0).alias("turn"), "query", text.alias("text"))
    turn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n_matches"), F.desc("n_lines"), "file"))
    sample = F.left(F.trim(F.regexp_replace("f.text", r"\s+", " ")), F.lit(120))
    told = F.concat(F.lit("  Q"), F.col("query") + 1, F.lit(" "), "file", F.lit(" lines="), "n_lines", F.lit(" exact="), "n_matches", F.lit(" sample_line="), "f.line", F.lit(" sample="), sample)
    files = per_file.withColumn("turn", turn).where(F.col("turn") <= MOST_INDEX_FILES).select("turn", "query", told.alias("text"))
    rows = heads.union(files).withColumn("all", F.lit(0))  # a few rows a query
    return fitting(rows, ["all"], ["turn", "query"], budget).select("position", "text")
