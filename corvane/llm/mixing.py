"""Mix sources to target weights by weighted fair queueing (DataFrame only).

Every source is a queue of its documents in a shuffled order that depends only
on the rows. A document's virtual finish time is the number of its source's
tokens up to and with it, divided by the source's target; a source that needs
more tokens than it has queues again, up to ``max_repeats`` times in all. The
entries of all queues, sorted globally by finish time, are taken until the
total budget is reached.

Defined cases: a null text has size 0; null sources form one source, last in
order; repeated rows are separate entries; with no tokens at all nothing is
taken; an empty table gives an empty result. Columns other than the three named
ones are not read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import free_name
from .order import PART, POS, before, ordered, ranked
from .store import stored

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """(source, source_size) -> with target.

    Weights repeat over the sources in code-point order, null last. Targets
    share the total by weight; one above ``max_repeats`` times its source is
    held there and the excess is shared again, until none is above.
    """
    ranks = ranked(ordered(sizes, [F.col("source").asc_nulls_last()], "sources"), "__rank")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int")).cast("double")
    table = stored(ranks.select("source", "source_size", w.alias("__w")), "source_weights")
    most = F.lit(max_repeats) * F.col("source_size")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0]
    level, held = 0.0, -1
    while True:
        full = most <= F.lit(level) * F.col("__w")
        n, kept, free = table.agg(
            F.count_if(full),
            F.coalesce(F.sum(F.when(full, most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("__w"))), F.lit(0.0)),
        ).head()
        if n == held or not free:
            break
        held, level = n, (total - kept) / free
    return table.select("source", "source_size", F.least(most.cast("double"), F.lit(level) * F.col("__w")).alias("target"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    seed: int = 7,
    keep: tuple[str, ...] = ("doc_id",),
    size: Column | None = None,
) -> DataFrame:
    """One row per document: ``keep``, size, source_size, target, taken."""
    slim = docs.select(
        *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)),
        F.col("source"),
        (word_count(F.col("text")) if size is None else size).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("__u"),
    )
    # the text is read once; ordering samples its input first
    queue = ordered(stored(slim, "sizes"), [F.col("source").asc_nulls_last(), F.col("__u"), F.col("size")], "queues")
    sizes = queue.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeats).withColumnRenamed("source", "__s")

    # tokens of the same source in earlier partitions: at most one row per partition and source
    earlier = Window.partitionBy("source").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offs = queue.groupBy(PART, "source").agg(F.sum("size").alias("__sum"))
    offs = offs.select(
        F.col(PART).alias("__p"), F.col("source").alias("__o"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__off")
    )
    offs = offs.join(targets, F.col("__o").eqNullSafe(F.col("__s"))).drop("__s")
    upto = Window.partitionBy(PART, "source").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    run = queue.withColumn("__run", F.sum("size").over(upto))
    run = run.join(offs, (F.col(PART) == F.col("__p")) & F.col("source").eqNullSafe(F.col("__o")))
    run = run.withColumn("__row", F.shiftleft(F.col(PART).cast("long"), 33) + F.col(POS))
    run = stored(run.withColumn("__cum", F.col("__off") + F.col("__run")).drop("__run", "__off", "__p", "__o", PART, POS, "source"), "finish")

    rounds = F.greatest(F.lit(1), F.least(F.lit(max_repeats), F.ceil(F.try_divide("target", "source_size")))).cast("int")

    def finish(e: Column) -> Column:
        return F.try_divide(e * F.col("source_size") + F.col("__cum"), F.col("target"))

    live = (F.col("size") > 0) & (F.col("target") > 0)
    entries = run.where(live).select("__row", "__u", "size", F.explode(F.sequence(F.lit(0), rounds - 1)).alias("__e"), "__cum", "source_size", "target")
    entries = entries.select(finish(F.col("__e")).alias("__f"), "__u", "__e", "__row", "size")
    line = ordered(entries, [F.col(c) for c in ("__f", "__u", "__e", "__row")], "line")
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0]

    # the one partition in which the budget ends, and the last entry taken there
    starts = before(line, F.col("size"))
    at = starts.where(F.col("__before") <= total).orderBy(F.col(PART).desc()).head()
    if at is None:
        taken = F.lit(0).cast("long")
    else:
        part = line.where(F.col(PART) == at[PART])
        sums = part.withColumn("__c", F.sum("size").over(Window.partitionBy(PART).orderBy(POS)) + F.lit(at["__before"]))
        last = sums.where(F.col("__c") <= total).orderBy(F.col(POS).desc()).head()
        if last is None:  # it ends between two partitions
            last = line.where(F.col(PART) < at[PART]).orderBy(F.col(PART).desc(), F.col(POS).desc()).head()
        if last is None:
            taken = F.lit(0).cast("long")
        else:
            cut = F.struct(*(F.lit(last[c]).cast(t).alias(c) for c, t in (("__f", "double"), ("__u", "long"), ("__e", "int"), ("__row", "long"))))
            times = F.lit(0)
            for e in range(max_repeats):
                mine = F.struct(finish(F.lit(e)).alias("__f"), F.col("__u"), F.lit(e).alias("__e"), F.col("__row"))
                times = times + F.when(live & (rounds > e) & (mine <= cut), 1).otherwise(0)
            taken = (times * F.col("size")).cast("long")
    out = [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    return run.select(*out, "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, with all their columns, as often as it takes them.

    Rows without words are never taken. Equal rows share what all of them got.
    """
    key, n, times, i, copy = (free_name(docs, x) for x in ("key", "n", "times", "i", "copy"))
    alike = F.xxhash64(F.lit(23), F.col("doc_id"), F.col("text"))
    taken = mix(docs.select("doc_id", "source", "text", alike.alias("key")), keep=("key",), **options)
    shares = taken.groupBy("key").agg(F.sum(F.coalesce(F.try_divide("taken", "size"), F.lit(0))).cast("int").alias(times), F.count("*").alias(n))
    shares = stored(shares.where(F.col(times) > 0).withColumnRenamed("key", key), "times")
    # the texts move once: join and window need them by the same key
    rows = docs.withColumn(key, alike).join(shares, key)
    rows = rows.withColumn(i, F.row_number().over(Window.partitionBy(key).orderBy("source")) - 1)
    mine = F.floor(F.col(times) / F.col(n)) + F.when(F.col(i) < F.col(times) % F.col(n), 1).otherwise(0)
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), mine.cast("int")))).select(*(f"`{c}`" for c in docs.columns))


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
