"""Relevance of files: lexical order, field-weighted BM25, rank fusion, fair selection."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corvane.functions import paths, text

# Weight and length share of each field, and the constants of the two scores.
FIELDS = {"path": (1.5, 0.20), "symbols": (3.0, 0.30), "signatures": (2.0, 0.50), "comments": (1.0, 0.75), "code": (0.5, 0.75), "tests": (2.5, 0.30)}
K1, RRF = 1.2, 60
MOST_RESULTS = 32


def lexical_rank(found: DataFrame, query_words: list[list[str]]) -> DataFrame:
    """(query, file) -> files in order of coverage, path affinity, rarity, path.

    A query word scores 4 if it is the file's stem, 2 if inside the stem, 1 if inside the path.
    """
    per_query = found.groupBy("query").agg(F.count("*").alias("n_files"))
    path, stem = F.lower("file"), F.lower(paths.stem(F.col("file")))

    def affinity(words: list[str]) -> Column:
        return sum((F.when(stem == w, 4).when(F.contains(stem, F.lit(w)), 2).when(F.contains(path, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))

    score = F.lit(0)
    for i, words in enumerate(query_words):
        score = F.when(F.col("query") == i, affinity(words)).otherwise(score)
    # at most one row per query: a handful, by the queries being parameters
    rows = found.join(F.broadcast(per_query), "query").withColumn("affinity", score)
    out = rows.groupBy("file").agg(
        F.array_sort(F.collect_set("query")).alias("queries"), F.countDistinct("query").alias("coverage"),
        F.sum("affinity").cast("long").alias("path_affinity"), F.sum(1 / F.col("n_files")).alias("rarity"),
    )
    return out


def lexical_order() -> list[Column]:
    return [F.desc("coverage"), F.desc("path_affinity"), F.desc(F.round("rarity", 12)), F.asc("file")]


def probe_rank(ranked: DataFrame, hits: DataFrame) -> DataFrame:
    """Add line hits, exact matches and declaration hints of a line scan, and the order they give."""
    stats = hits.groupBy("file").agg(
        F.count("*").alias("line_hits"), F.sum(F.size("match_texts")).cast("long").alias("exact_matches"),
        F.sum(text.declaration_hint(F.col("text"))).cast("long").alias("definition_hints"),
    )
    rows = ranked.join(stats, "file", "left").na.fill(0, ["line_hits", "exact_matches", "definition_hints"])
    return rows


def probe_order(initial: str = "rank") -> list[Column]:
    return [F.desc("coverage"), F.desc("path_affinity"), F.desc("definition_hints"), F.desc(F.least(F.lit(3), F.col("exact_matches"))), F.asc(initial), F.asc("file")]


def top_ranked(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their rank; a heap per task, never a global sort."""
    first = rows.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """All rows with their position from 1 in a total order, without a window over all rows.

    Rows are range-partitioned and sorted, and kept, so that their places are made
    once; a position is the place in the partition plus the rows of earlier ones.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).cache()
    part, place = F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part).agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))  # one row a partition
    out = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.withColumn(name, F.col("__before") + place + 1).drop("__id", "__part", "__before")


def field_tokens(fields: DataFrame) -> DataFrame:
    """(file, field, text) -> (file, field, term), repeats kept."""
    return fields.select("file", "field", F.explode(text.code_tokens(F.col("text"))).alias("term"))


def field_counts(fields: DataFrame, terms: list[str]) -> DataFrame:
    """(file, field, text), or texts in a list -> (file, field, n, t0, t1, ...): tokens, and how often each term stands among them.

    Tokens stay in their array: no row per token is made or shuffled. No token
    goes over a line's end, so texts of a list are read as lines of one.
    """
    whole = F.array_join("texts", "\n") if "texts" in fields.columns else F.col("text")
    rows = fields.select("file", "field", text.code_tokens(whole).alias("tokens"))
    counts = [F.size(F.filter("tokens", _equals(t))).alias(f"t{i}") for i, t in enumerate(terms)]
    return rows.select("file", "field", F.size("tokens").alias("n"), *counts)


def _equals(term: str):
    return lambda x: x == term


def bm25f(files: DataFrame, counted: DataFrame, terms: list[str], fields: dict | None = None) -> DataFrame:
    """(file, bm25f): every term once; counts of the documents, not deduplicated.

    ``counted`` is field_counts(). All that is joined is one row of averages and
    document frequencies.
    """
    fields = fields or FIELDS
    total = {f: F.when(F.col("field") == f, F.col("n")) for f in fields}
    sizes = [F.sum(c).alias(f"n_{f}") for f, c in total.items()]
    counts = [F.sum(F.when(F.col("field") == f, F.col(f"t{i}"))).alias(f"t{i}_{f}") for i in range(len(terms)) for f in fields]
    per = files.select("file").join(counted.groupBy("file").agg(*sizes, *counts), "file", "left")
    per = per.na.fill(0)
    with_term = [F.count_if(sum((F.col(f"t{i}_{f}") for f in fields), F.lit(0)) > 0).alias(f"df{i}") for i in range(len(terms))]
    means = [F.greatest(F.try_divide(F.sum(f"n_{f}"), F.count("*")), F.lit(1.0)).alias(f"avg_{f}") for f in fields]
    whole = per.agg(F.count("*").alias("docs"), *with_term, *means)
    rows = per.crossJoin(F.broadcast(whole))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        df = F.col(f"df{i}")
        idf = F.ln(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        weighted = F.lit(0.0)
        for f, (weight, b) in fields.items():
            scale = F.greatest(1 - b + b * (F.col(f"n_{f}") / F.col(f"avg_{f}")), F.lit(0.01))
            weighted = weighted + weight * F.col(f"t{i}_{f}") / scale
        score = score + F.when(weighted > 0, idf * ((K1 + 1) * weighted / (K1 + weighted))).otherwise(0.0)
    return rows.select("file", score.alias("bm25f"))


def matched_terms(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """Sorted distinct query terms of each file and field; fields without one are left out."""
    return tokens.where(F.col("term").isin(terms)).groupBy("file", "field").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))


def fused(scores: DataFrame, k: int = MOST_RESULTS) -> DataFrame:
    """(file, exact_rank, bm25f) -> the best k by reciprocal-rank fusion, then BM25F, then path.

    Exact ranks go from 1 to ``k`` at most. A file without one can only be among
    the best k if its BM25F rank is, so ranks are made for the first k and for
    the files with an exact rank, by counting what is ahead of them. The scores
    are kept while they are read and never sorted as a whole; 2 * k rows are left.
    """
    value = F.round("bm25f", 12)
    kept = scores.withColumn("s", value).persist(StorageLevel.DISK_ONLY)
    good = kept.where("bm25f > 0")
    first = good.orderBy(F.desc("s"), "file").limit(k).collect()
    exact = kept.where(F.col("exact_rank").between(1, k)).collect()
    ranks = {r["file"]: i + 1 for i, r in enumerate(first)}
    asked = [r for r in exact if r["bm25f"] > 0 and r["file"] not in ranks]
    if asked:
        ahead = [F.count_if((F.col("s") > r["s"]) | ((F.col("s") == r["s"]) & (F.col("file") <= r["file"]))) for r in asked]
        ranks |= dict(zip((r["file"] for r in asked), good.agg(*(c.alias(f"a{i}") for i, c in enumerate(ahead))).head()))
    kept.unpersist()
    rows = [(*(r[c] for c in scores.columns), ranks.get(r["file"])) for r in {r["file"]: r for r in [*exact, *first]}.values()]
    few = scores.sparkSession.createDataFrame(rows, StructType([*scores.schema, StructField("bm25_rank", IntegerType())]))

    def part(rank: str) -> Column:
        return F.coalesce(1 / (F.lit(RRF) + F.col(rank)), F.lit(0.0))

    few = few.withColumn("rrf", part("exact_rank") + part("bm25_rank"))
    return top_ranked(few, [F.desc(F.round("rrf", 12)), F.desc(F.round("bm25f", 12)), F.asc("file")], k)


def fair_candidates(ranked: DataFrame, k: int, by: list[Column] | None = None) -> list:
    """All rows (file, queries) that fair() can choose k from, in order ``by`` (default: rank), with their ``place``.

    No more than k files are chosen, so of each query only its first k files can
    be, and to fill up only the first 2 * k of all: a bounded number of rows.
    """
    by = by or [F.asc("rank"), F.asc("file")]
    per = ranked.select("*", F.explode("queries").alias("__q"))
    lane = F.row_number().over(Window.partitionBy("__q").orderBy(*by))
    some = per.withColumn("__n", lane).where(F.col("__n") <= k).drop("__q", "__n").union(ranked.orderBy(*by).limit(2 * k))
    some = some.dropDuplicates(["file"])
    return some.withColumn("place", F.row_number().over(Window.orderBy(*by))).select("file", "queries", "place").collect()


def reserved(candidates: list, order: list[int], k: int) -> list[str]:
    """Files of a fair top-k, in order: each query, those with fewest files first, that is not covered yet
    reserves its best file not taken, which covers all that file's queries."""
    rows = sorted(candidates, key=lambda r: r["place"])
    chosen: set[str] = set()
    covered: set[int] = set()
    for q in order:
        best = next((r for r in rows if q in r["queries"] and r["file"] not in chosen), None)
        if len(chosen) < k and q not in covered and best:
            chosen.add(best["file"])
            covered |= set(best["queries"])
    return [r["file"] for r in rows if r["file"] in chosen]


def by_selectivity(found: DataFrame) -> list[int]:
    """The queries, those with fewest files first."""
    return [r["query"] for r in found.groupBy("query").agg(F.countDistinct("file").alias("n")).orderBy("n", "query").collect()]


def reserve_and_fill(ranked: DataFrame, found: DataFrame, k: int, fill: bool = True, by: list[Column] | None = None, order: list[int] | None = None) -> list[str]:
    """Reserved files, then the best others up to k, all in the order ``by``."""
    rows = fair_candidates(ranked, k, by)
    chosen = reserved(rows, by_selectivity(found) if order is None else order, k)
    in_order = [r["file"] for r in sorted(rows, key=lambda r: r["place"])]
    if fill:
        chosen += [f for f in in_order if f not in chosen][: k - len(chosen)]
    return [f for f in in_order if f in chosen]


def emit_with_impact(lexical: list[str], reserved: list[str], structural: list[str], graph: list[str], k: int = 4) -> list[str]:
    """Reserved lexical files, the best structural one, at most one validated graph file, then lexical by rank."""
    out = list(dict.fromkeys(reserved))[:k]
    for pool in (structural[:1], graph[:1], lexical):
        for f in pool:
            if len(out) < k and f not in out:
                out.append(f)
    return out


def emitted(lexical: Column, reserved_files: Column, structural: Column, graph: Column, k: int = 4) -> Column:
    """emit_with_impact() of array columns, for many searches at once."""
    return F.slice(F.array_distinct(F.concat(F.slice(reserved_files, 1, k), F.slice(structural, 1, 1), F.slice(graph, 1, 1), lexical)), 1, k)
