"""Where symbols reach over imports, for many symbols at once.

A binding under the same name passes a symbol on to the importer, an alias ends
there, so all files that a symbol reaches know it under one name. A round joins
the files that were reached last with the bindings from them, for all symbols
together. Each symbol has a budget of its own, which bounds the rounds, and of
the bindings of one file and symbol no more are read than break it.

A closure fails closed: it has a reason and no rows if anything that it rests on
is not proved. Of several reasons the first in REASONS is told; of two that a
later round would find, that of the earlier round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.scratch import kept, large

MOST = 32
#: reasons before the first round, then those of a round
REASONS = [
    "closure_index_incomplete", "closure_import_ambiguous", "closure_import_unresolved", "closure_unsupported_import_syntax",
    "closure_member_binding_unsupported", "closure_source_validation_failed", "closure_binding_budget_exceeded", "closure_state_budget_exceeded",
]
KEY = ["file", "symbol"]
FOUND = ["file", "symbol", "importer", "target", "source_symbol", "local_symbol", "propagates"]


def mentions(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, source) and (symbol) -> (file, symbol) of names that stand anywhere in a text, also inside longer words.

    Words of a text are cut into the parts that a name may be, so that names
    and texts meet by equality.
    """
    symbols = symbols.select("symbol").distinct()
    lengths = [r[0] for r in symbols.select(F.length("symbol")).distinct().collect()]  # one number a length
    word = texts.select("file", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(r"([A-Za-z0-9_$]+)"), F.lit(1)))).alias("word"))

    def cuts(n: int) -> Column:
        at = F.sequence(F.lit(1), F.length("word") - n + 1)
        return F.when(F.length("word") >= n, F.transform(at, lambda i: F.substring(F.col("word"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    # a word is cut once, however many files hold it
    each = word.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(*map(cuts, lengths)))).alias("symbol")) if lengths else word.select("word", F.col("word").alias("symbol")).limit(0)
    return word.join(each.join(symbols, "symbol"), "word").select("file", "symbol").distinct()


def member_uses(edges: DataFrame, named: DataFrame) -> DataFrame:
    """Edges (importer, target, sources: names taken) and (file, symbol) mentions -> (file, symbol) that an importer
    may use as a member of the file, as it names it and does not import it."""
    rows = edges.join(named.select(F.col("file").alias("importer"), "symbol"), "importer").where(~F.array_contains("sources", F.col("symbol")))
    return rows.select(F.col("target").alias("file"), "symbol").distinct()


def places(bindings: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, symbol) that the closures of the sources can come to: the sources, and importers that keep one of their names."""
    keeps = bindings.where("status = 'resolved' and importer <> target and source = local").select(F.col("importer").alias("file"), F.col("source").alias("symbol"))
    return sources.select(*KEY).unionByName(keeps.join(large(sources.select("symbol").distinct()), "symbol", "left_semi")).distinct()


def member_uses_at(edges: DataFrame, texts: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of member_uses(edges, mentions(texts, places)) that are places (file, symbol).

    An importer's text (file, source) is asked for the names of the places it imports from and for no others, so no
    text is cut into words: for a few names a file.
    """
    asked = edges.join(large(places.withColumnRenamed("file", "target")), "target").where(~F.array_contains("sources", F.col("symbol")))
    asked = large(asked.select(F.col("importer").alias("file"), "target", "symbol").distinct())
    return asked.join(texts.select("file", "source"), "file").where(F.contains("source", F.col("symbol"))).select(F.col("target").alias("file"), "symbol").distinct()


def closures(
    bindings: DataFrame,
    sources: DataFrame,
    *,
    indexed: DataFrame | None = None,
    unsupported: DataFrame | None = None,
    members: DataFrame | None = None,
    current: DataFrame | None = None,
    most_bindings: int = MOST,
    most_states: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(file, symbol) -> (rows of FOUND, (file, symbol, reason, n_states, n_bindings)).

    ``bindings``: importer, target, source, local, status. ``indexed`` (file):
    what a complete index holds; ``unsupported`` (symbol): names in files with
    imports that cannot be read; ``members`` (file, symbol): see member_uses;
    ``current`` (importer, target, source, local): bindings of the sources as
    they are now. What is not given is not checked.
    """
    most_states = most_bindings if most_states is None else most_states
    asked = sources.select(*KEY).distinct()
    status = F.col("status")
    loose = bindings.where(status.isin("ambiguous", "unresolved")).groupBy(F.col("source").alias("symbol")).agg(F.min("status").alias("status"))
    guards = [asked.join(loose, "symbol").select(*KEY, F.concat(F.lit("closure_import_"), "status").alias("reason"))]
    if indexed is not None:
        guards.append(asked.join(indexed.select("file").distinct(), "file", "left_anti").select(*KEY, F.lit(REASONS[0]).alias("reason")))
    if unsupported is not None:
        guards.append(asked.join(unsupported.select("symbol").distinct(), "symbol", "left_semi").select(*KEY, F.lit(REASONS[3]).alias("reason")))
    links = bindings.where("status = 'resolved' and importer <> target").select("importer", "target", F.col("source").alias("symbol"), "local").distinct()
    if current is not None:
        now = current.select("importer", "target", F.col("source").alias("symbol"), "local").distinct().withColumn("now", F.lit(True))
        links = links.join(now, ["importer", "target", "symbol", "local"], "left").withColumn("stale", F.col("now").isNull()).drop("now")
    else:
        links = links.withColumn("stale", F.lit(False))
    # one binding more than the budget breaks it
    nth = F.row_number().over(Window.partitionBy("target", "symbol").orderBy("importer", "local"))
    links = kept(links.withColumn("nth", nth).where(F.col("nth") <= most_bindings + 1).drop("nth"))
    suspects = None if members is None else kept(members.select(F.col("file").alias("state"), "symbol").distinct())

    all_reasons = F.array(*map(F.lit, REASONS))
    place = F.array_position(all_reasons, F.col("reason")).cast("int")
    first = lambda rows: rows.groupBy(*KEY).agg(F.element_at(all_reasons, F.min(place)).alias("reason"))
    failed = [kept(first(reduce(DataFrame.union, guards)))]
    start = asked.join(failed[0].select(*KEY), KEY, "left_anti").withColumn("state", F.col("file"))
    frontier, states, found = kept(start), [], []
    while not frontier.isEmpty():
        states.append(frontier)
        step = frontier.join(links.withColumnRenamed("target", "state"), ["state", "symbol"])
        step = kept(step.select(*KEY, "importer", F.col("state").alias("target"), F.col("symbol").alias("source_symbol"), F.col("local").alias("local_symbol"), (F.col("local") == F.col("symbol")).alias("propagates"), "stale"))
        found.append(step)
        known = reduce(DataFrame.union, states)
        fresh = step.where("propagates").select(*KEY, F.col("importer").alias("state")).distinct().join(known, [*KEY, "state"], "left_anti")
        sizes = reduce(DataFrame.union, [x.select(*KEY, F.lit(1).alias("b"), F.lit(0).alias("s")) for x in found] + [x.select(*KEY, F.lit(0), F.lit(1)) for x in [*states, fresh]])
        sizes = sizes.join(frontier.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.sum("b").alias("b"), F.sum("s").alias("s"))
        over = F.when(F.col("b") > most_bindings, REASONS[6]).when(F.col("s") > most_states + 1, REASONS[7])
        bad = [sizes.select(*KEY, over.alias("reason")).where("reason is not null"), step.where("stale").select(*KEY, F.lit(REASONS[5]).alias("reason"))]
        if suspects is not None:
            bad.append(frontier.join(suspects, ["state", "symbol"], "left_semi").select(*KEY, F.lit(REASONS[4]).alias("reason")))
        failed.append(kept(first(reduce(DataFrame.union, bad))))
        # a symbol that has failed is not followed any further
        frontier = kept(fresh.join(failed[-1].select(*KEY), KEY, "left_anti"))
    every = reduce(DataFrame.union, failed)
    per = [x.select(*KEY, F.lit(0).alias("b"), F.lit(1).alias("s")) for x in states] + [x.select(*KEY, F.lit(1), F.lit(0)) for x in found]
    sizes = reduce(DataFrame.union, per).groupBy(*KEY).agg(F.sum("s").alias("n_states"), F.sum("b").alias("n_bindings")) if per else None
    out = asked.join(every, KEY, "left")
    out = out.join(sizes, KEY, "left") if sizes is not None else out.withColumns({"n_states": F.lit(0), "n_bindings": F.lit(0)})
    ready = F.col("reason").isNull()
    verdict = out.select(*KEY, "reason", *(F.when(ready, F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in ("n_states", "n_bindings")))
    if not found:
        return asked.limit(0).select(*KEY, *(F.lit(None).cast("boolean" if c == "propagates" else "string").alias(c) for c in FOUND[2:])), verdict
    rows = reduce(DataFrame.union, found).select(*FOUND).join(every.select(*KEY), KEY, "left_anti")
    return rows, verdict
