"""Choosing and confirming targets: scopes, candidates, competitors, semantic locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import paths, script_tokens, text
from corvane.operators import ranges, ranking
from corvane.scratch import large

MOST_COMPETITORS, MOST_LOCATIONS, MOST_SCOPE, MOST_DISTANCE = 4, 32, 180, 96
#: lines of a scope by indentation, and around a hit outside all scopes
MOST_LINES, RADIUS = 180, 12


def primary_scope(scopes: DataFrame, group: list[str]) -> DataFrame:
    """(group, rank, file, queries) -> the first scope, or, if that is a test, the first other one that shares a query."""
    by = Window.partitionBy(*group)
    test = paths.likely_test(F.col("file"))
    first = F.first(F.struct("queries", test.alias("test"))).over(by.orderBy("rank"))
    rows = scopes.withColumn("first", first).withColumn("n", F.row_number().over(by.orderBy("rank")))
    better = F.col("first.test") & ~test & F.arrays_overlap("queries", F.col("first.queries"))
    pick = F.row_number().over(by.orderBy(F.desc(better), "rank"))
    return rows.withColumn("pick", pick).where("pick = 1").drop("first", "n", "pick")


def round_robin(rows: DataFrame, lane: str, order: list[Column], most: int = 5) -> DataFrame:
    """The first ``most`` rows of each lane with their turn; lanes take turns."""
    turn = F.row_number().over(Window.partitionBy(lane).orderBy(*order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= most)


def reordered(candidates: DataFrame, ranked: DataFrame) -> DataFrame:
    """Candidates (file, lexical_rank): ranked ones first, the others in their order; with ``position``."""
    rows = candidates.join(ranked.select("file", "rank"), "file", "left")
    return ranking.numbered(rows, [F.col("rank").isNull(), F.col("rank"), F.col("lexical_rank")], "position")


def verdicts(expected: DataFrame, locations: DataFrame) -> DataFrame:
    """(id, file) and (id, status, file): whether the located file is the expected one."""
    want = expected.select("id", F.col("file").alias("want"))
    rows = want.join(locations, "id", "left").groupBy("id").agg(
        F.count_if((F.col("status") == "resolved") & (F.col("file") == F.col("want"))).alias("good"), F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), F.count_if(F.col("status") == "unresolved").alias("unresolved"),
    )
    verdict = F.when(F.col("good") > 0, "confirmed").when(F.col("ambiguous") > 0, "ambiguous").when(F.col("resolved") > 0, "contradicted").when(F.col("unresolved") > 0, "unresolved").otherwise("unavailable")
    return rows.select("id", verdict.alias("verdict"))


def bounded_locations(locations: DataFrame, most: int = MOST_LOCATIONS) -> DataFrame:
    """(id, file, start_byte) distinct, at most ``most`` an id in order; ``bounded_complete`` tells that none was left out."""
    rows = locations.select("id", "file", "start_byte").distinct()
    by = Window.partitionBy("id")
    rows = rows.withColumns({"n": F.row_number().over(by.orderBy("file", "start_byte")), "total": F.count("*").over(by)})
    return rows.where(F.col("n") <= most).select("id", "file", "start_byte", (F.col("total") <= most).alias("bounded_complete"))


def rename_targets(definitions: DataFrame, found: DataFrame, handoff: DataFrame) -> DataFrame:
    """(symbol, identity), (symbol, file), (symbol, file): unique only if one definition is known and every file found was handed off."""
    outside = found.select("symbol", "file").distinct().join(handoff.select("symbol", "file"), ["symbol", "file"], "left_anti").groupBy("symbol").agg(F.count("*").alias("outside"))
    rows = found.select("symbol").distinct().join(definitions.groupBy("symbol").agg(F.countDistinct("identity").alias("n")), "symbol", "left").join(outside, "symbol", "left")
    n, out = F.coalesce("n", F.lit(0)), F.coalesce("outside", F.lit(0))
    return rows.select("symbol", F.when(out > 0, "files_outside_handoff").when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("no_definition").alias("status"))


def competitors(found: DataFrame, target: str, scoped: DataFrame, complete: bool = True) -> tuple[DataFrame, str]:
    """Files that rival the target, and the decision: confirmed, competing, too_many or incomplete.

    Only the target's most selective queries count (those with fewest files).
    Tests do not rival a target that is no test; a file without a scope of its
    own is no rival. More candidates than can be read reject the target.
    """
    per = found.groupBy("query").agg(F.countDistinct("file").alias("n"), F.bool_or(F.col("file") == target).alias("hit")).where("hit")
    least = per.agg(F.min("n").alias("least"))
    best = per.crossJoin(F.broadcast(least)).where("n = least").select("query")  # one row
    rivals = found.join(F.broadcast(best), "query", "left_semi").where(F.col("file") != target).select("file").distinct()
    is_test = paths.likely_test(F.lit(target))
    rivals = rivals.where(is_test | ~paths.likely_test(F.col("file"))).join(scoped.select("file").distinct(), "file", "left_semi")
    n = rivals.limit(MOST_COMPETITORS + 1).count()
    return rivals, "incomplete" if not complete else "confirmed" if n == 0 else "competing" if n <= MOST_COMPETITORS else "too_many"


def unique_definitions(declarations: DataFrame) -> DataFrame:
    """(name, file, start_line, end_line) -> name, n and the range of the one definition, null if there are several."""
    one = F.min(F.struct("file", "start_line", "end_line"))
    rows = declarations.groupBy("name").agg(F.count("*").alias("n"), one.alias("d"))
    return rows.select("name", "n", *(F.when(F.col("n") == 1, F.col(f"d.{c}")).alias(c) for c in ("file", "start_line", "end_line")))


def _lines(files: DataFrame) -> DataFrame:
    rows = files.where("source is not null").select("file", F.posexplode(F.split("source", "\n")).alias("n", "text"))
    return rows.select("file", (F.col("n") + 1).cast("bigint").alias("line"), "text", text.indent_width(F.col("text")).alias("indent"))


def _near(rows: DataFrame) -> DataFrame:
    """Rows by stretches of MOST_LINES lines: of two rows at most so far apart one is in the stretch of the other or the next."""
    return rows.withColumn("stretch", F.floor(F.col("line") / MOST_LINES))


def whole_scopes(files: DataFrame) -> DataFrame:
    """(file, source) -> (file, start, end, indent) of definition lines of Python, however long a scope is.

    A scope ends before the next line that is not deeper, blank lines, comments
    and decorators aside. The lines of a file are sorted from its end, once for
    every depth of its definitions.
    """
    lines = _lines(files)
    heads = lines.where(text.python_definition(F.col("text")).isNotNull()).select("file", F.col("line").alias("start"), "indent")
    stops = lines.where(~F.col("text").rlike(r"^\s*(?:[#@]|$)")).select("file", "line", F.col("indent").alias("stop_indent"))
    depths = heads.select("file", "indent").distinct()
    stops = stops.join(depths, "file").where("stop_indent <= indent").select("file", "indent", "line", F.col("line").alias("stop"))
    rows = stops.union(heads.select("file", "indent", F.col("start").alias("line"), F.lit(None).cast("bigint")))
    # the head of a scope is a stop as well; what ends a scope is on a later line
    below = Window.partitionBy("file", "indent").orderBy(-F.col("line")).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.min("stop").over(below))
    length = lines.groupBy("file").agg(F.max("line").alias("n"))
    out = rows.where("stop is null").join(length, "file")
    return out.select("file", F.col("line").alias("start"), F.coalesce(F.col("next") - 1, F.col("n")).alias("end"), "indent")


def indented_scopes(files: DataFrame) -> DataFrame:
    """whole_scopes(), where a scope also ends MOST_LINES after its start.

    Lines meet only those at most so far away, so no file is read by one task alone.
    """
    lines = _lines(files)
    heads = lines.where(text.python_definition(F.col("text")).isNotNull()).select("file", F.col("line").alias("start"), "indent")
    stops = _near(lines.where(~F.col("text").rlike(r"^\s*(?:[#@]|$)"))).select("file", "stretch", "line", F.col("indent").alias("stop_indent"))
    at = F.floor(F.col("start") / MOST_LINES)
    pairs = heads.withColumn("stretch", F.explode(F.array(at, at + 1))).join(stops, ["file", "stretch"])
    pairs = pairs.where((F.col("line") > F.col("start")) & (F.col("line") <= F.col("start") + MOST_LINES) & (F.col("stop_indent") <= F.col("indent")))
    first = large(pairs.groupBy("file", "start").agg((F.min("line") - 1).alias("stop")))
    length = lines.groupBy("file").agg(F.max("line").alias("n"))
    out = heads.join(first, ["file", "start"], "left").join(large(length), "file")
    return out.select("file", "start", F.least(F.col("start") + (MOST_LINES - 1), F.coalesce("stop", "n")).alias("end"), "indent")


def hit_scopes(hits: DataFrame, files: DataFrame) -> DataFrame:
    """(file, line) -> (file, line, start, end): the scope around each hit of a Python file.

    That of the nearest definition line at or above the hit, at most MOST_LINES
    away, that is not deeper than it; else RADIUS lines around.
    """
    lines = _lines(files)
    hit = large(_near(hits.select("file", "line").distinct().join(lines.select("file", "line", "indent"), ["file", "line"])))
    scopes = indented_scopes(files).withColumnsRenamed({"indent": "scope_indent"})
    pairs = hit.withColumn("at", F.explode(F.array("stretch", F.col("stretch") - 1))).join(scopes.withColumn("at", F.floor(F.col("start") / MOST_LINES)), ["file", "at"])
    pairs = pairs.where((F.col("start") <= F.col("line")) & (F.col("start") >= F.col("line") - MOST_LINES) & (F.col("scope_indent") <= F.col("indent")))
    best = large(pairs.groupBy("file", "line").agg(F.max(F.struct("start", "end")).alias("s")))
    length = lines.groupBy("file").agg(F.max("line").alias("n"))
    rows = hit.select("file", "line").join(best, ["file", "line"], "left").join(large(length), "file")
    return rows.select("file", "line", F.coalesce("s.start", F.greatest(F.lit(1), F.col("line") - RADIUS)).alias("start"), F.coalesce("s.end", F.least(F.col("n"), F.col("line") + RADIUS)).alias("end"))


def brace_scopes(files: DataFrame, most_lines: int = MOST_SCOPE) -> DataFrame:
    """(file, source, lines) of scripts -> (file, line, start_line, end_line): the braces around the first character of
    each line or opened on it, at most ``most_lines`` long; null outside all. Braces in strings, comments, templates and
    regular expressions do not count. Lines meet only blocks that begin so near above them."""
    pairs = script_tokens.brace_pairs(script_tokens.token_table(files))
    length = files.select("file", F.size(F.split("source", "\n")).cast("bigint").alias("n"))
    blocks = pairs.join(length, "file").select("file", "start", F.coalesce("end", "n").alias("end")).where("end > start")
    hits = files.select("file", F.explode("lines").alias("line")).select("file", F.col("line").cast("bigint").alias("line"))
    at = F.floor(F.col("line") / most_lines)
    near = hits.withColumn("at", F.explode(F.array(at, at - 1))).join(blocks.withColumn("at", F.floor(F.col("start") / most_lines)), ["file", "at"])
    near = near.where((F.col("start") <= F.col("line")) & (F.col("end") >= F.col("line")) & (F.col("line") - F.col("start") <= most_lines))
    best = near.groupBy("file", "line").agg(F.max(F.struct("start", (-F.col("end")).alias("shut"))).alias("b"))
    end = F.least(-F.col("b.shut"), F.col("b.start") + most_lines - 1)
    return hits.join(best, ["file", "line"], "left").select("file", "line", F.col("b.start").alias("start_line"), end.alias("end_line"))


def position_of(source: Column, offset: Column) -> Column:
    """UTF-8 byte offset -> struct(line, character), both from 0, characters in UTF-16 units; null off a character's edge."""
    raw = F.encode(source, "UTF-8")
    head = F.substring(raw, F.lit(1), offset)
    ok = (offset >= 0) & (offset <= F.octet_length(raw)) & F.is_valid_utf8(head.cast("string"))
    line = F.regexp_count(head.cast("string"), F.lit("\n"))
    tail = F.regexp_extract(head.cast("string"), r"([^\n]*)\z", 1)
    return F.when(ok, F.struct(line.cast("long").alias("line"), text.utf16_length(tail).alias("character")))


def offset_of(source: Column, line: Column, character: Column) -> Column:
    """Line and UTF-16 character, both from 0 -> UTF-8 byte offset; null outside the source or inside a character."""
    rows = F.split(source, "\n")
    row = F.get(rows, line)
    before = F.aggregate(F.slice(rows, F.lit(1), F.greatest(line, F.lit(0))), F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 1)
    # characters beyond 16 bits count twice, so the number of characters lies between half and all
    some = F.sequence(F.greatest(F.lit(0), F.floor(character / 2).cast("int")), F.least(F.length(row), character))
    k = F.get(F.filter(some, lambda i: text.utf16_length(F.left(row, i)) == character), F.lit(0))
    ok = (line >= 0) & (character >= 0) & row.isNotNull() & (F.floor(character / 2) <= F.length(row))
    return F.when(ok & k.isNotNull(), before + F.octet_length(F.left(row, k)))


def symbol_targets(definitions: DataFrame, evidence: DataFrame, most: int = MOST_DISTANCE) -> DataFrame:
    """(file, name, start_line, end_line) of functions and evidence (file, line) -> file, name, reason, start_line, end_line.

    The one function of the name whose first line is at most ``most`` lines from evidence.
    """
    rows = ranges.distances(definitions.withColumn("line", F.col("start_line")), evidence)
    close = F.col("distance") <= most
    per = rows.groupBy("file", "name").agg(F.count_if(F.col("distance").isNull()).alias("bare"), F.count_if(close).alias("n"), F.min(F.when(close, F.struct("start_line", "end_line"))).alias("d"))
    reason = F.when(F.col("bare") > 0, "evidence_anchor_missing").when(F.col("n") > 1, "symbol_ambiguous").when(F.col("n") < 1, "symbol_not_found").otherwise("ok")
    return per.select("file", "name", reason.alias("reason"), *(F.when(reason == "ok", F.col(f"d.{c}")).alias(c) for c in ("start_line", "end_line")))


def file_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))


def path_of_uri(uri: Column) -> Column:
    return F.when(F.startswith(uri, F.lit("file://")), F.url_decode(F.replace(F.substr(uri, F.lit(8)), F.lit("+"), F.lit("%2B"))))
