"""Words of queries: compiler tokens, formulation atoms and plans, rank queries, globs, quoted strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.ship import ship

# Words that say nothing about a query, and the bounds of tokens and plans.
QUERY_STOP_WORDS = ["the", "and", "for", "with", "from", "into", "when", "then", "this", "that"]
LEAST_TOKENS, MOST_TOKENS, LONGEST = 2, 6, 32
MOST_BRANCHES, MOST_ATOMS, MOST_BRANCH_ATOMS, LEAST_ATOMS = 4, 8, 5, 2
MOST_RANK_TERMS = 32
MOST_SYMBOL, MOST_SYMBOLS = 80, 16

# Extensions that a language glob may name, the most that may stand in for them, and what is never searched.
GLOB_EXTENSIONS = ["py", "pyi", "js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts", "html", "htm", "css", "scss", "sass", "less", "xml", "sql"]
MOST_FALLBACK = 12
EXCLUDED_TOP = [".git", ".corvane"]
EXCLUDED_ANYWHERE = ["node_modules", ".venv", "venv", "__pycache__", "dist", "build"]


def _parts(chunk: Column) -> Column:
    return F.split(F.lower(F.regexp_replace(chunk, "([a-z0-9])([A-Z])", "$1 $2")), r"[_\-\s]+")


def _words(query: Column, pattern: str, least: int) -> Column:
    chunks = F.regexp_extract_all(query, F.lit(f"({pattern})"), F.lit(1))
    stop = F.array(*map(F.lit, QUERY_STOP_WORDS))
    words = F.flatten(F.transform(chunks, _parts))
    return F.array_distinct(F.filter(words, lambda w: F.length(w).between(least, LONGEST) & ~F.array_contains(stop, w)))


def compiler_tokens(query: Column) -> Column:
    """First-seen distinct words of three characters or more, split at case and joints; at most MOST_TOKENS."""
    return F.slice(_words(query, "[A-Za-z][A-Za-z0-9_-]{2,}", 3), 1, MOST_TOKENS)


def compilable(query: Column) -> Column:
    return F.size(compiler_tokens(query)) >= LEAST_TOKENS


def formulation_atoms(fragment: Column) -> Column:
    """Words, their parts, and numbers of two to eight digits."""
    return _words(fragment, "[A-Za-z][A-Za-z0-9_-]{2,}|[0-9]{2,8}", 2)


def with_plan(queries: DataFrame, branches: Column) -> DataFrame:
    """Add ``plan_atoms``, or null where the query gives no plan.

    A plan has at most MOST_BRANCHES branches of one to MOST_BRANCH_ATOMS atoms,
    LEAST_ATOMS to MOST_ATOMS atoms in all, and a letter somewhere. ``branches``
    is null where the query's brackets do not balance.
    """
    per = F.transform(branches, formulation_atoms)
    atoms = F.array_distinct(F.flatten(per))
    each = F.forall(per, lambda a: F.size(a).between(1, MOST_BRANCH_ATOMS))
    ok = branches.isNotNull() & (F.size(branches) <= MOST_BRANCHES) & each & F.size(atoms).between(LEAST_ATOMS, MOST_ATOMS) & F.exists(atoms, lambda a: a.rlike("[a-z]"))
    return queries.withColumn("plan_atoms", F.when(ok, atoms))


def branches_of(queries: DataFrame, key: str, query: str) -> DataFrame:
    """(key, branches) of top-level alternatives; null where there are none to be had."""
    from corvane.operators.scan import split_alternatives

    import pandas as pd

    ship(queries.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "branches": [split_alternatives(q) for q in pdf[query]]})

    return queries.select(key, query).mapInPandas(run, f"{key} bigint, branches array<string>")


def rank_terms(queries: Column) -> Column:
    """Path tokens of all queries, first seen first, at most MOST_RANK_TERMS."""
    return F.slice(F.array_distinct(F.flatten(F.transform(queries, lambda q: text.path_tokens(q)))), 1, MOST_RANK_TERMS)


def symbols(values: Column, most: int = MOST_SYMBOLS) -> Column:
    """The values that are identifiers of at most MOST_SYMBOL characters; the first ``most``."""
    return F.slice(F.filter(values, lambda v: v.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$") & (F.length(v) <= MOST_SYMBOL)), 1, most)


def quoted_strings(source: Column) -> Column:
    """Contents of quoted strings, with escapes undone."""
    raw = F.regexp_extract_all(source, F.lit(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""), F.lit(1))
    return F.transform(raw, lambda x: F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))


def searchable(path: Column, glob: str | None = None) -> Column:
    """Whether a path passes the glob and none of the exclusions, which come last."""
    out = ~F.substring_index(path, "/", 1).isin(*EXCLUDED_TOP) | ~F.contains(path, F.lit("/"))
    for name in EXCLUDED_ANYWHERE:
        out = out & ~F.contains(F.concat(F.lit("/"), path), F.lit(f"/{name}/"))
    return out & F.regexp_like(path, F.lit(glob_expression(glob))) if glob else out


def glob_expression(glob: str) -> str:
    """A regular expression for a glob of * ** ? and {a,b}; without a slash it is looked for in every folder."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$" if "/" in glob else f"^(?:.*/)?{out}$"


def language_glob(glob: str | None) -> tuple[str, list[str]] | None:
    """(prefix, extensions) of a glob that ends in one extension or a list of them, all known."""
    m = re.fullmatch(r"(.*\*)\.(?:([a-z0-9]+)|\{([a-z0-9]+(?:,[a-z0-9]+)+)\})", glob or "")
    if not m or glob.startswith("!") or "\\" in glob:
        return None
    found = list(dict.fromkeys([m[2]] if m[2] else m[3].split(",")))
    return (m[1], found) if all(x in GLOB_EXTENSIONS for x in found) else None


def corrected_glob(requests: DataFrame, inventory: DataFrame) -> DataFrame:
    """(id, prefix, extensions, complete) and (id, extension, n_files) -> id, glob, corrected, reason.

    Where no file of the requested languages is there and the inventory is
    complete, the languages that are there stand in, if they are few.
    """
    known = inventory.where(F.col("extension").isin(GLOB_EXTENSIONS) & (F.col("n_files") > 0))
    there = known.groupBy("id").agg(F.array_sort(F.collect_set("extension")).alias("there"))
    rows = requests.join(there, "id", "left").withColumn("there", F.coalesce("there", F.array().cast("array<string>")))
    n = F.size("there")
    reason = (
        F.when(~F.col("complete"), "source_inventory_incomplete").when(F.arrays_overlap("there", "extensions"), "requested_language_present")
        .when(n < 1, "no_supported_source_files").when(n > MOST_FALLBACK, "fallback_extension_set_too_wide").otherwise("requested_language_absent")
    )

    def named(extensions: Column) -> Column:
        tail = F.when(F.size(extensions) == 1, F.concat(F.lit("."), extensions[0])).otherwise(F.concat(F.lit(".{"), F.array_join(extensions, ","), F.lit("}")))
        return F.concat(F.col("prefix"), tail)

    rows = rows.withColumn("reason", reason)
    fixed = F.col("reason") == "requested_language_absent"
    return rows.select("id", F.when(fixed, named(F.col("there"))).otherwise(named(F.col("extensions"))).alias("glob"), fixed.alias("corrected"), "reason")


def search_plan(tasks: DataFrame, all_sources: str) -> DataFrame:
    """(id, status, old_name, new_name, queries, glob) -> id, queries, glob, applied: an exact rename looks for the old name in all sources."""
    exact = F.coalesce((F.col("status") == "exact") & (F.col("old_name") != F.col("new_name")), F.lit(False))
    asked = F.array_distinct(F.filter("queries", lambda q: q.isNotNull() & (q != "")))
    return tasks.select("id", F.when(exact, F.array("old_name")).otherwise(asked).alias("queries"), F.when(exact, F.lit(all_sources)).otherwise(F.col("glob")).alias("glob"), exact.alias("applied"))
