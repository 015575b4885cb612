"""Regular-expression scans over files, with completeness as data.

A query that was cut off at a cap is not evidence of absence: every result says
whether its scan is complete, and negative facts come only from complete ones.
The few queries are parameters, so a scan is one pass over the files that
tests all of them; no join with the queries is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE_CAP, LINE_CAP, MOST_MATCH = 5_000, 1_000, 160
#: rows of a class of a query that are kept; up to so many, tasks drop the others before any shuffle
IN_CLASS = 1_000


def _matching(text: Column, queries: list[str]) -> Column:
    """Numbers of the queries that match."""
    hits = F.array(*(F.when(F.regexp_like(text, F.lit(q)), F.lit(i)) for i, q in enumerate(queries)))
    return F.array_compact(hits)


def first_rows(found: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each query with ``capped``, which says that more were found.

    Rows are first dealt to classes by a hash of their place and number, where
    each task already drops all but the first of a class; equal rows get classes
    of their own. A class holds an eighth of what it may at most on average, so
    that none overflows before the cap, and what is left to sort for a query is
    bounded. One row more than the cap proves that the scan was cut.
    """
    classes = max(8, -(-cap * 8 // IN_CLASS))
    numbered = found.withColumn("number", F.monotonically_increasing_id())
    mine = F.pmod(F.xxhash64(*order, "number"), F.lit(classes)).alias("class")
    top = Window.partitionBy("query", "class").orderBy(*order, "number")
    some = numbered.select("*", mine).withColumn("n", F.row_number().over(top)).where(F.col("n") <= IN_CLASS).drop("class", "n")
    by_query = Window.partitionBy("query")
    some = some.withColumn("n", F.row_number().over(by_query.orderBy(*order, "number"))).where(F.col("n") <= cap + 1)
    return some.withColumn("capped", F.max("n").over(by_query) > cap).where(F.col("n") <= cap).drop("n", "number")


def discover(lines: DataFrame, queries: list[str], cap: int | None = FILE_CAP) -> DataFrame:
    """(query, file, capped) of files with a matching line, at most ``cap`` files a query in path order; all if it is None.

    ``capped`` says of a query that files were left out.
    """
    found = lines.select("file", F.explode(_matching(F.col("text"), queries)).alias("query")).distinct()
    if cap is None:
        return found.select(F.col("query").cast("int"), "file", F.lit(False).alias("capped"))
    return first_rows(found.select("query", "file"), ["file"], cap).select(F.col("query").cast("int"), "file", "capped")


def scan_lines(lines: DataFrame, queries: list[str], cap: int = LINE_CAP) -> DataFrame:
    """(query, file, line, text, match_texts, capped): matching lines in path order; exactly ``cap`` is complete."""
    found = lines.select("file", "line", "text", F.explode(_matching(F.col("text"), queries)).alias("query"))
    texts = F.array().cast("array<string>")
    for i, q in enumerate(queries):
        texts = F.when(F.col("query") == i, F.regexp_extract_all("text", F.lit(f"({q})"), F.lit(1))).otherwise(texts)
    out = first_rows(found, ["file", "line"], cap)
    return out.select(F.col("query").cast("int"), "file", "line", "text", texts.alias("match_texts"), "capped")


def scan_status(spark, hits: DataFrame, queries: list[str]) -> DataFrame:
    """One row per query, also without hits: (query, n_lines, n_files, scan_complete, absent)."""
    every = spark.createDataFrame([(i,) for i in range(len(queries))], "query int")
    got = hits.groupBy("query").agg(F.count("*").alias("n_lines"), F.countDistinct("file").alias("n_files"), F.bool_or("capped").alias("capped"))
    out = every.join(got, "query", "left").na.fill(0, ["n_lines", "n_files"])
    complete = ~F.coalesce("capped", F.lit(False))
    return out.select("query", "n_lines", "n_files", complete.alias("scan_complete"), (complete & (F.col("n_lines") == 0)).alias("absent"))


def byte_spans(hits: DataFrame, queries: list[str]) -> DataFrame:
    """Every match with its half-open UTF-8 byte range in the line; its text with single spaces, at most MOST_MATCH characters."""
    import re

    import pandas as pd

    compiled = [re.compile(q) for q in queries]

    def spans(batches):
        for pdf in batches:
            rows = []
            for q, file, line, text in zip(pdf["query"], pdf["file"], pdf["line"], pdf["text"]):
                for k, m in enumerate(compiled[q].finditer(text)):
                    at = len(text[: m.start()].encode())
                    rows.append((q, file, line, k, at, at + len(m.group().encode()), " ".join(m.group().split())[:MOST_MATCH]))
            yield pd.DataFrame(rows, columns=["query", "file", "line", "n", "start_byte", "end_byte", "match_text"])

    return hits.select("query", "file", "line", "text").mapInPandas(spans, "query int, file string, line bigint, n int, start_byte bigint, end_byte bigint, match_text string")


def without_exact(hits: DataFrame) -> DataFrame:
    """Hits whose ``match_mode`` is not exact are evidence of a line, not of what matched: their match texts go."""
    return hits.withColumn("match_texts", F.when(F.col("match_mode") == "exact", F.col("match_texts")).otherwise(F.array().cast("array<string>")))


def merge_hits(hits: DataFrame) -> DataFrame:
    """One row per (file, line) with all its queries and match texts."""
    return hits.groupBy("file", "line").agg(
        F.array_sort(F.collect_set("query")).alias("queries"), F.count("*").alias("n_hits"), F.sum(F.size("match_texts")).cast("long").alias("n_matches")
    )


def pressure(merged: DataFrame) -> DataFrame:
    """The number of hit lines, files, and the most hit lines in one file."""
    per = merged.groupBy("file").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_files"), F.max("n").alias("most_in_file"))


def facets(hits: DataFrame) -> DataFrame:
    """Distinct match texts of a query: matches, files, and where it is first."""
    rows = hits.select("query", "file", "line", F.explode("match_texts").alias("facet"))
    rows = rows.withColumn("facet", F.trim(F.regexp_replace("facet", r"\s+", " "))).where("facet <> ''")
    return rows.groupBy("query", "facet").agg(
        F.count("*").alias("n_matches"), F.countDistinct("file").alias("n_files"), F.min(F.struct("file", "line")).alias("f")
    ).select("query", "facet", "n_matches", "n_files", F.col("f.file").alias("first_file"), F.col("f.line").alias("first_line"))


def pick_facets(facet_rows: DataFrame) -> DataFrame:
    """The dominant facet of each query, and of the others the most telling: repeated ones first, then rare ones."""
    by_query = Window.partitionBy("query")
    top = F.row_number().over(by_query.orderBy(F.desc("n_matches"), F.desc("n_files"), "facet"))
    rows = facet_rows.withColumn("top", top)
    single = (F.col("n_matches") < 2).cast("int")
    rest = F.row_number().over(by_query.orderBy((F.col("top") == 1).cast("int"), single, "n_matches", "n_files", "facet"))
    rows = rows.withColumn("rest", rest)
    dominant = F.max(F.when(F.col("top") == 1, F.col("facet")))
    telling = F.max(F.when((F.col("rest") == 1) & (F.col("top") != 1), F.col("facet")))
    return rows.groupBy("query").agg(dominant.alias("dominant"), telling.alias("discriminative"))


def relax(lines: DataFrame, query: str) -> DataFrame:
    """Matches of a query, relaxed only where a complete scan finds nothing: (file, line, text, match_mode).

    exact, then ignoring case, then all words of the query on one line, in any
    order. The longest word is tested first, as a cheap condition.
    """
    words = sorted({w.lower() for w in _words(query)}, key=lambda w: (-len(w), w))
    steps = [("exact", F.regexp_like("text", F.lit(query))), ("case_fold", F.regexp_like("text", F.lit(f"(?i){query}")))]
    if words:
        together = F.contains(F.lower("text"), F.lit(words[0]))
        for w in words[1:]:
            together = together & F.contains(F.lower("text"), F.lit(w))
        steps.append(("all_words", together))
    for mode, condition in steps:
        found = lines.where(condition)
        if mode == steps[-1][0] or found.limit(1).count():
            return found.select("file", "line", "text", F.lit(mode).alias("match_mode"))
    return lines.limit(0).select("file", "line", "text", F.lit("exact").alias("match_mode"))


def _words(query: str) -> list[str]:
    import re

    return [w for w in re.findall(r"[A-Za-z][A-Za-z0-9_]{2,}", query)]


def split_alternatives(query: str, most: int = 4) -> list[str] | None:
    """Branches of a top-level alternation; None if brackets do not balance or there are too many."""
    out, depth, in_class, skip, at = [], 0, False, False, 0
    for i, c in enumerate(query):
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                return None
        elif c == "|" and depth == 0:
            out.append(query[at:i])
            at = i + 1
    out.append(query[at:])
    if depth or in_class or skip or len(out) > most or not all(out):
        return None
    return out


def cooccurrence(lines: DataFrame, branches: list[list[str]], least: int = 2, most_files: int = 24) -> DataFrame:
    """Files that hold a quorum of the words of a branch: (file, n_atoms, branch_ratio, n_branches).

    Nothing is returned if more than ``most_files`` files qualify.
    """
    atoms = sorted({a for b in branches for a in b})
    seen = [F.max(F.contains(F.lower("text"), F.lit(a)).cast("int")).alias(f"a{i}") for i, a in enumerate(atoms)]
    per = lines.groupBy("file").agg(*seen)
    out = []
    for b in branches:
        got = sum((F.col(f"a{atoms.index(a)}") for a in b), F.lit(0))
        quorum = max(least, -(-len(b) // 2))
        out.append((got, F.when(got >= quorum, got / F.lit(len(b))).otherwise(F.lit(0.0)), (got >= quorum).cast("int")))
    n = sum((F.col(f"a{i}") for i in range(len(atoms))), F.lit(0))
    ratio = F.greatest(*(x[1] for x in out), F.lit(0.0))
    rows = per.select("file", n.cast("long").alias("n_atoms"), ratio.alias("branch_ratio"), sum((x[2] for x in out), F.lit(0)).cast("long").alias("n_branches"))
    rows = rows.where("n_branches > 0")
    if not most_files:
        return rows
    # one more than allowed proves that there are too many
    some = rows.limit(most_files + 1)
    n = some.agg(F.count("*").alias("all"))
    return some.crossJoin(F.broadcast(n)).where(F.col("all") <= most_files).drop("all")  # one row
