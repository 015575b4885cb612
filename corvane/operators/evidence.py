"""Evidence: grouped statements, scopes, and the rows of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges, ranking

# How much a role says about a scope.
ROLE_SCORES = {"call": 5, "assignment": 4, "definition": 3, "import": 2, "reference": 1}
REPORTED_LINES = 8


def role_score(role: Column) -> Column:
    out = F.lit(0)
    for r, s in ROLE_SCORES.items():
        out = F.when(role == r, s).otherwise(out)
    return out


def distinct_spans(hits: DataFrame) -> DataFrame:
    """One row per (file, start_byte, end_byte) with its lowest query."""
    return hits.groupBy("file", "start_byte", "end_byte").agg(F.min("query").alias("query"))


def first_queries(hits: DataFrame) -> DataFrame:
    return hits.groupBy("file", "line").agg(F.min("query").alias("query"))


def grouped(hits: DataFrame, key: list[str], variant: list[str]) -> DataFrame:
    """Two levels of grouping: groups by ``key`` with their variants.

    ``hits`` has query and line besides. Per group: hit_count, query and line
    sets, the smallest REPORTED_LINES lines, whether lines were left out, the
    number of variants and their share of the hits.
    """
    low = hits.groupBy(*key, *variant).agg(F.count("*").alias("n"), F.collect_set("query").alias("q"), F.collect_set("line").alias("l"))
    one = F.struct((-F.col("n")).alias("order"), *variant, F.col("n").alias("hit_count"))
    out = low.groupBy(*key).agg(
        F.sum("n").alias("hit_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("q")))).alias("queries"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("l")))).alias("all_lines"), F.array_sort(F.collect_list(one)).alias("variants"),
    )
    return out.select(
        *key, "hit_count", "queries", F.slice("all_lines", 1, REPORTED_LINES).alias("lines"), (F.size("all_lines") > REPORTED_LINES).alias("lines_truncated"),
        F.size("variants").cast("long").alias("n_variants"), (F.size("variants") / F.col("hit_count")).alias("variant_diversity"), "variants",
    )


def valid_groups(groups: DataFrame) -> DataFrame:
    """Groups whose variants' hits add up."""
    total = F.aggregate("variants", F.lit(0).cast("long"), lambda a, v: a + v["hit_count"])
    return groups.where((total == F.col("hit_count")) & (F.size("queries") > 0) & (F.size("lines") > 0))


def in_order(groups: DataFrame) -> DataFrame:
    """Groups with their ``position``: most hits first, then file, line, role and anchor."""
    return ranking.numbered(groups, [F.desc("hit_count"), F.asc("file"), F.asc("start_line"), F.asc("role"), F.asc("anchor")], "position")


def distilled(counts: DataFrame) -> DataFrame:
    """Counts of a distillation -> which of its parts are complete; nothing is, of nothing.

    Columns raw, mapped, exact_spans, anchored, witnessed, lossy, unsupported, errors, truncated, groups, shown_groups, variants, shown_variants.
    """
    some, whole = F.col("raw") > 0, F.col("lossy") == 0
    flags = {
        "location_complete": some & (F.col("exact_spans") == F.col("raw")), "anchor_complete": some & (F.col("anchored") == F.col("raw")) & whole,
        "witness_complete": some & (F.col("witnessed") == F.col("raw")) & whole, "distill_complete": (F.col("unsupported") == 0) & (F.col("errors") == 0) & (F.col("mapped") >= F.col("raw")),
    }
    rows = counts.withColumns(flags)
    shown = ~F.col("truncated") & (F.col("shown_groups") == F.col("groups")) & (F.col("shown_variants") == F.col("variants"))
    ir = F.col("location_complete") & F.col("anchor_complete") & F.col("witness_complete") & F.col("distill_complete") & shown
    return rows.withColumns({"ir_complete": ir, "representation": F.when(F.col("shown_groups") < 1, "none").otherwise("evidence_ir")})


def scopes(groups: DataFrame) -> DataFrame:
    """(file, start_line, end_line, kind, name, role, hit_count, queries, lines) -> scopes in order, without the module."""
    rows = groups.where("name <> '<module>'").withColumn("role_score", role_score(F.col("role")))
    out = rows.groupBy("file", "start_line", "end_line", "kind", "name").agg(
        F.max("role_score").alias("role_score"), F.size(F.array_distinct(F.flatten(F.collect_list("queries")))).alias("n_queries"),
        F.sum("hit_count").alias("hit_count"), F.size(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("n_lines"),
    )
    order = [F.desc("role_score"), F.desc("n_queries"), F.desc("hit_count"), F.desc("n_lines"), "file", "start_line", "end_line"]
    return out.orderBy(*order)


def raw_rows(hits: DataFrame, lines: DataFrame, radius: int = 2, budget: int = 5_000) -> DataFrame:
    """The raw report: context lines of every file, cut at the byte budget: (file, line, marked, text)."""
    last = lines.groupBy("file").agg(F.max("line").alias("last"))
    context = ranges.around(hits, last, radius)
    wanted = context.select("file", F.explode(F.sequence("start", "end")).alias("line"))
    marks = hits.select("file", "line", F.lit(True).alias("marked")).distinct()
    rows = wanted.join(lines.select("file", "line", "text"), ["file", "line"]).join(marks, ["file", "line"], "left").na.fill(False, ["marked"])
    cost = F.octet_length(F.concat_ws(":", "file", "line", "text")) + 1
    return ranges.prefix_budget(rows, ["file"], ["line"], cost, budget).drop("spent")


def chosen_view(totals: DataFrame) -> Column:
    """raw, hybrid or region, from byte totals and completeness (columns raw_bytes, hybrid_bytes, raw_complete, under_pressure, dense)."""
    smaller = F.col("hybrid_bytes") <= 0.75 * F.col("raw_bytes")
    return F.when(F.col("dense"), "region").when(F.col("under_pressure") & (~F.col("raw_complete") | smaller), "hybrid").when(~F.col("raw_complete"), "index").otherwise("raw")


# What the key of each kind of fact is made of.
FACT_PARTS = {
    "hit": ["file", "line"], "line": ["file", "line"], "span": ["file", "start_byte", "end_byte"], "scope": ["file", "start", "end", "symbol_kind", "symbol_name"],
    "group": ["file", "start_line", "end_line", "symbol_kind", "symbol_name", "role", "anchor", "match_text"],
    "witness": ["file", "start_line", "end_line", "symbol_kind", "symbol_name", "role", "anchor", "subject", "statement", "hit_lines"],
    "negative": ["query", "target", "glob"], "index_summary": ["scan_complete", "scan_capped", "n_files", "n_lines", "exact_matches"],
    "index_file": ["file", "line_hits", "exact_matches", "first_line", "sample"], "index_facet": ["kind", "facet", "exact_matches", "n_files", "first_file", "first_line"],
    "route_candidate": ["file", "queries", "selected", "target", "glob"], "route_summary": ["discovery_complete", "n_candidates", "n_selected"],
}


def _json(df: DataFrame, name: str) -> Column:
    """A column's value as JSON; null where there is none, paths without a leading ``./``."""
    kind, x = df.schema[name].dataType.simpleString(), F.col(name)
    if name in ("file", "first_file"):
        x = F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), r"^\./", "")
    if kind.startswith("array"):
        text = F.to_json(F.array_sort(x))
    elif kind == "string":
        text = F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", "$1")
    else:
        text = x.cast("string")
    return F.coalesce(F.when(F.col(name).isNotNull(), text), F.lit("null"))


def facts_of(kind: str, rows: DataFrame) -> DataFrame:
    """(key) of one kind of fact: the kind, a zero character, and its parts as a JSON list. The parts are columns of ``rows``."""
    parts = F.concat(F.lit(f"{kind}\0["), F.array_join(F.array(*(_json(rows, x) for x in FACT_PARTS[kind])), ","), F.lit("]"))
    return rows.select("*", parts.alias("key"))


def fact_keys(hits: DataFrame) -> DataFrame:
    """Positive facts of hit lines: that the line was hit, and that it was shown."""
    lines = hits.select("file", "line").distinct()
    return facts_of("hit", lines).union(facts_of("line", lines))


def negative_facts(status: DataFrame, target: str = ".", glob: str | None = None) -> DataFrame:
    """A fact of absence for each query whose complete scan found nothing."""
    rows = status.where("absent").withColumn("asked", F.col("query"))
    rows = rows.select("asked", F.col("query").cast("string").alias("query"), F.lit(target).alias("target"), F.lit(glob).cast("string").alias("glob"))
    return facts_of("negative", rows).select(F.col("asked").alias("query"), "key")


def novel(facts: DataFrame, ledger: DataFrame) -> DataFrame:
    return facts.join(ledger.select("key").distinct(), "key", "left_anti")


def novel_hits(hits: DataFrame, facts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Hits (file, line, ...) with ``novel``: whether any fact (file, line, key) of their line is not in the ledger."""
    unseen = novel(facts, ledger).select("file", "line").distinct().withColumn("novel", F.lit(True))
    return hits.join(unseen, ["file", "line"], "left").na.fill(False, ["novel"])


def remembered(ledger: DataFrame, facts: DataFrame, most: int = 12_000) -> DataFrame:
    """The ledger with new facts, up to ``most``: older facts stay."""
    rows = ledger.select("key", F.lit(0).alias("age")).union(facts.select("key", F.lit(1))).groupBy("key").agg(F.min("age").alias("age"))
    return rows.orderBy("age", "key").limit(most).select("key")


def fact_kinds(facts: DataFrame) -> DataFrame:
    kind = F.substring_index("key", "\0", 1)
    return facts.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# The kinds of facts, by what they say.
FACT_GROUPS = {"positive": ["hit", "span"], "context": ["line"], "negative": ["negative"], "structural": ["scope", "group", "witness"], "routing": ["index_summary", "index_file"]}


def fact_summary(facts: DataFrame) -> DataFrame:
    """(key) -> (kind, n): facts counted by what they say; kinds not known are ``other``."""
    kind = F.substring_index("key", "\0", 1)
    out = F.lit("other")
    for group, kinds in FACT_GROUPS.items():
        out = F.when(kind.isin(*kinds), group).otherwise(out)
    return facts.groupBy(out.alias("kind")).agg(F.count("*").alias("n"))
