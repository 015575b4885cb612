"""Dependency edges: resolution, neighbours, closure, hypotheses, refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import paths, text
from corvane.operators import closure
from corvane.scratch import kept, large

MOST_NEIGHBORS = 24


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (file, line, kind, spec) with ``target`` and ``status``.

    Of the files an import may mean, one that exists resolves it, none leaves
    it unresolved (or external, for an absolute Python module), several make it
    ambiguous.
    """
    rows = kept(imports.withColumn("__id", F.xxhash64("file", "line", "kind", "spec")))  # read twice, parsed once
    tries = rows.select("__id", F.explode(paths.targets(F.col("kind"), F.col("file"), F.col("spec"))).alias("target")).distinct()
    real = tries.join(files.select(F.col("file").alias("target")).distinct(), "target", "left_semi")
    per = large(real.groupBy("__id").agg(F.count("*").alias("__n"), F.min("target").alias("target")))
    outside = F.col("kind").isin("python_from", "python_import") & ~F.startswith("spec", F.lit("."))
    n = F.coalesce("__n", F.lit(0))
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").when(outside, "external").otherwise("unresolved")
    return rows.join(per, "__id", "left").withColumn("status", status).withColumn("target", F.when(F.col("__n") == 1, F.col("target"))).drop("__id", "__n")


def touching(imports: DataFrame, seeds: DataFrame) -> DataFrame:
    """Imports in the seeds (seed), and those that may mean one: all that their neighbours come from, before anything is resolved."""
    tries = imports.withColumn("__tries", paths.targets(F.col("kind"), F.col("file"), F.col("spec")))
    at = (F.col("file") == F.col("seed")) | F.array_contains("__tries", F.col("seed"))
    return tries.join(F.broadcast(seeds.select("seed")), at, "left_semi").drop("__tries")  # a handful of seeds


def edges(resolved_imports: DataFrame) -> DataFrame:
    """Distinct edges of resolved imports, without self-edges."""
    rows = resolved_imports.where("status = 'resolved' and file <> target")
    return rows.select(F.col("file").alias("from"), F.col("target").alias("to"), "kind", F.col("line").alias("witness_line"), "spec").distinct()


def import_stats(resolved_imports: DataFrame) -> DataFrame:
    """Counts by outcome; a self-edge is resolved to nothing and not counted."""
    other = F.col("file") != F.col("target")
    return resolved_imports.agg(
        F.count_if((F.col("status") == "resolved") & other).alias("local_resolved"), F.count_if(F.col("status") == "unresolved").alias("local_unresolved"),
        F.count_if(F.col("status") == "ambiguous").alias("local_ambiguous"), F.count_if(F.col("status") == "external").alias("external_package"),
    )


def neighbors(edge_rows: DataFrame, seeds: DataFrame, k: int = MOST_NEIGHBORS, filters: DataFrame | None = None) -> DataFrame:
    """Fair first neighbours of seeds (seed, position).

    Every seed has a forward and a reverse lane. Relevance is tested before the
    cap: with ``filters`` (seed, forward, reverse: arrays of symbols) an edge
    must share a symbol, and seeds without a filter have no neighbours. Lanes
    take turns, in seed order and forward first, until ``k`` are chosen; only
    the first k of a lane can be chosen, so that is all that is ever sorted.
    ``total`` counts all of them.
    """
    lanes = seeds.select("seed", "position")
    fwd = edge_rows.join(lanes.withColumnRenamed("seed", "from"), "from").select(F.col("from").alias("seed"), F.col("to").alias("file"), F.lit("forward").alias("direction"), "position", "kind", "witness_line", "spec", *_symbols(edge_rows, "bindings"))
    rev = edge_rows.join(lanes.withColumnRenamed("seed", "to"), "to").select(F.col("to").alias("seed"), F.col("from").alias("file"), F.lit("reverse").alias("direction"), "position", "kind", "witness_line", "spec", *_symbols(edge_rows, "source_symbols"))
    rows = fwd.union(rev)
    if filters is not None:
        wanted = F.when(F.col("direction") == "forward", F.col("forward")).otherwise(F.col("reverse"))
        rows = rows.join(filters, "seed").where(F.arrays_overlap("symbols", wanted)).drop("forward", "reverse")
    turn = F.row_number().over(Window.partitionBy("seed", "direction").orderBy("file", "kind", "witness_line", "spec"))
    rows = rows.withColumn("turn", turn)
    total = rows.groupBy().agg(F.count("*").alias("total"))
    order = ["turn", "position", F.desc(F.col("direction") == "forward")]
    first = rows.where(F.col("turn") <= k).orderBy(*order).limit(k)
    return first.crossJoin(F.broadcast(total)).select("seed", "position", "direction", "turn", "file", "kind", "witness_line", "spec", "total")


def _symbols(df: DataFrame, name: str) -> list[Column]:
    return [F.col(name).alias("symbols")] if name in df.columns else []


def lexical_misses(found: DataFrame, lexical: DataFrame) -> DataFrame:
    return found.join(lexical.select("file").distinct(), "file", "left_anti")


def hypotheses(relations: DataFrame, seeds: DataFrame, lexical: DataFrame, k: int = 2) -> DataFrame:
    """Files a change may reach, with the symbols that say so.

    ``relations``: seed, file, direction, local, source, confidence; ``seeds``:
    seed, query, identifiers, owners. Forward: a local name used at the seed
    points to its source; reverse: a source that the seed owns points to the
    local name. Only exact relations count and lexical files are left out.
    """
    rows = relations.where("confidence = 'exact_local'").join(seeds, "seed")
    forward = (F.col("direction") == "forward") & F.array_contains("identifiers", F.col("local"))
    reverse = (F.col("direction") == "reverse") & F.array_contains("owners", F.col("source"))
    rows = rows.where(forward | reverse).withColumn("symbol", F.when(forward, F.col("source")).otherwise(F.col("local")))
    rows = lexical_misses(rows, lexical)
    out = rows.groupBy("file", "direction").agg(F.countDistinct("query").alias("n_queries"), F.array_sort(F.collect_set("symbol")).alias("symbols"))
    return out.orderBy(F.desc(F.col("direction") == "forward"), F.desc("n_queries"), F.desc(F.size("symbols")), "file").limit(k)


def seed_contexts(hits: DataFrame, lines: DataFrame, scope_rows: DataFrame) -> DataFrame:
    """Hit lines (file, line) -> per file the identifiers of the innermost scopes around them and what these declare."""
    from corvane.operators import ranges

    inner = hits.select("file", F.col("line").alias("i_id"), F.col("line").alias("i_start"), F.col("line").alias("i_end"))
    outer = scope_rows.select("file", F.col("start").alias("o_id"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    mine = large(ranges.merged(ranges.tightest(inner, outer).select("file", F.col("o_start").alias("start"), F.col("o_end").alias("end"))))
    rows = mine.join(lines, "file").where("line between start and end")
    owners = F.flatten(F.collect_list(F.when(F.col("line") == F.col("start"), text.declared_symbols(F.col("text"), "python"))))
    per = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("rows"), F.array_sort(F.array_distinct(owners)).alias("owners"))
    whole = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    return per.select("file", text.identifiers(whole).alias("identifiers"), "owners")


def validated(guesses: DataFrame, files: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Hypotheses that the target's lines bear out: a definition (forward), or a use besides the import line (reverse).

    Guesses and import lines meet the file before it is cut into lines, so no
    line is shuffled or sorted: memory is that of a sort of files.
    """
    one = large(guesses.select("file", "direction", F.explode("symbols").alias("symbol")))
    known = large(witnesses.groupBy("file").agg(F.collect_set("witness_line").alias("imports")))
    asked = files.select("file", "source").join(one, "file").join(known, "file", "left").where(F.contains("source", F.col("symbol")))
    rows = asked.select("file", "direction", "symbol", "imports", F.posexplode(F.split("source", "\n")).alias("p", "raw"))
    rows = rows.where(F.contains("raw", F.col("symbol"))).withColumns({"line": (F.col("p") + 1).cast("long"), "text": F.regexp_replace("raw", r"\r$", "")})
    defines = (F.col("direction") == "forward") & text.declares(F.col("text"), F.col("symbol"))
    uses = (F.col("direction") == "reverse") & ~F.coalesce(F.array_contains("imports", F.col("line")), F.lit(False))
    good = rows.where(text.whole_word(F.col("text"), F.col("symbol"))).where(uses | defines)
    return good.groupBy("file", "direction").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"), F.min("line").alias("first_line"))


def refresh_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, n_bytes, mtime_ms) twice -> file, action: reuse, reindex or remove."""
    o = old.select("file", F.col("n_bytes").alias("o_bytes"), F.col("mtime_ms").alias("o_time"))
    both = o.join(new.select("file", "n_bytes", "mtime_ms"), "file", "full_outer")
    same = (F.col("o_bytes") == F.col("n_bytes")) & (F.col("o_time") == F.col("mtime_ms"))
    return both.select("file", F.when(F.col("n_bytes").isNull(), "remove").when(F.coalesce(same, F.lit(False)), "reuse").otherwise("reindex").alias("action"))


def fresh(names: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, fresh): whether a file of the snapshot is unchanged."""
    plan = refresh_plan(old, new)
    return names.join(plan, "file", "left").select("file", F.coalesce(F.col("action") == "reuse", F.lit(False)).alias("fresh"))


def symbol_closure(bindings: DataFrame, file: str, symbol: str, most: int = closure.MOST, most_states: int | None = None) -> tuple[DataFrame, str | None]:
    """All places one symbol reaches over imports, and why there are none; see closure.closures."""
    one = bindings.sparkSession.createDataFrame([(file, symbol)], "file string, symbol string")
    rows, verdict = closure.closures(bindings, one, most_bindings=most, most_states=most_states)
    return rows.drop("file", "symbol"), verdict.head()["reason"]
