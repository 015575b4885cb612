"""Interval algebra on lines and bytes: merge, subtract, contain, budget, sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.ship import ship


def merged(ranges: DataFrame) -> DataFrame:
    """(file, start, end) -> maximal ranges; touching ones join. Ranges that are empty or start below 1 go."""
    ok = ranges.where("start > 0 and end >= start").select("file", "start", "end")
    order = Window.partitionBy("file").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = ok.withColumn("new", (before.isNull() | (F.col("start") > before + 1)).cast("int"))
    island = new.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("file", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("file", "start", "end")


def from_lines(numbers: DataFrame) -> DataFrame:
    """(file, line) -> ranges of consecutive lines."""
    rows = numbers.where("line > 0").select("file", "line").distinct()
    island = rows.withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy("file").orderBy("line")))
    return island.groupBy("file", "island").agg(F.min("line").alias("start"), F.max("line").alias("end")).select("file", "start", "end")


def subtracted(ranges: DataFrame, cuts: DataFrame) -> DataFrame:
    """What of the merged ranges no cut covers.

    Edges are swept in order: a place is left if it is inside a range and no
    cut. Works on edges, so long ranges cost no more than short ones.
    """
    a, b = merged(ranges), merged(cuts)
    edges = (
        a.select("file", F.col("start").alias("at"), F.lit(1).alias("r"), F.lit(0).alias("c"))
        .union(a.select("file", F.col("end") + 1, F.lit(-1), F.lit(0)))
        .union(b.select("file", F.col("start"), F.lit(0), F.lit(1)))
        .union(b.select("file", F.col("end") + 1, F.lit(0), F.lit(-1)))
    )
    steps = edges.groupBy("file", "at").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    order = Window.partitionBy("file").orderBy("at")
    state = steps.select(
        "file", "at", F.lead("at").over(order).alias("next"),
        F.sum("r").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("r"), F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("c"),
    )
    left = state.where("r > 0 and c <= 0 and next is not null").select("file", F.col("at").alias("start"), (F.col("next") - 1).alias("end"), F.lit(True).alias("x"))
    # pieces that touch belong to one range unless an edge of a range was between them; merged ranges never touch
    return merged(left)


def around(hits: DataFrame, last_lines: DataFrame, radius: int) -> DataFrame:
    """Merged context of ``radius`` lines around hits, inside the file."""
    rows = hits.select("file", "line").distinct().join(last_lines.select("file", "last"), "file")
    return merged(rows.select("file", F.greatest(F.lit(1), F.col("line") - radius).alias("start"), F.least("last", F.col("line") + radius).alias("end")))


def prefix_budget(rows: DataFrame, partition: list[str], order: list[str], cost: Column, budget: int) -> DataFrame:
    """Rows in order until the first that does not fit."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def greedy_budget(rows: DataFrame, partition: list[str], order: list[str], cost: Column, budget: int) -> DataFrame:
    """Rows in order that still fit; one that does not fit is passed over and later ones may.

    Each choice depends on all before it, so a partition is one fold. Spark sorts
    the slim rows, spilling if need be, and the fold sees them as they stream by
    with one number as its state, so a partition may have any number of rows.
    Rows that cost more than the whole budget never reach it.
    """
    import numpy as np
    import pyarrow as pa

    ship(rows.sparkSession)
    slim = rows.select(*partition, *order, cost.cast("long").alias("__cost")).where(F.col("__cost") <= budget)
    width = len(partition)

    def fold(batches):
        now, left = None, 0
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            keys = zip(*(batch.column(i).to_pylist() for i in range(width))) if width else iter(lambda: (), None)
            for i, (key, c) in enumerate(zip(keys, batch.column(batch.num_columns - 1).to_pylist())):
                if key != now:
                    now, left = key, budget
                if c <= left:
                    left, keep[i] = left - c, True
            yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(keep))

    placed = (slim.repartition(*partition) if width else slim.coalesce(1)).sortWithinPartitions(*partition, *order)
    kept = placed.mapInArrow(fold, slim.drop("__cost").schema)
    return rows.join(kept, [*partition, *order], "left_semi")


def sampled(rows: DataFrame, partition: list[str], order: str) -> DataFrame:
    """First, middle and last row of each partition."""
    by = Window.partitionBy(*partition)
    n, i = F.count("*").over(by), F.row_number().over(by.orderBy(order))
    rows = rows.withColumns({"__i": i, "__n": n})
    middle = F.floor((F.col("__n") - 1) / 2) + 1
    return rows.where((F.col("__i") == 1) | (F.col("__i") == F.col("__n")) | (F.col("__i") == middle)).drop("__i", "__n")


def containing(inner: DataFrame, outer: DataFrame, strict: bool = False, longest: int | None = None) -> DataFrame:
    """Pairs of an inner range and an outer one of the same file that covers it.

    ``inner``: file, i_id, i_start, i_end; ``outer``: file, o_id, o_start, o_end.
    An outer range lies in one or two stretches of the power of eight that is at
    least its length; an inner one asks, for every such length, the stretch it
    starts in. So ranges meet only near each other, however long the file is.
    ``longest``: no outer range is longer; where it is known, ``outer`` is not
    read once more for the lengths there are.
    """
    size = F.greatest(F.lit(1), F.col("o_end") - F.col("o_start") + 1)
    level = F.ceil(F.log2(size) / 3).cast("int")
    outer = outer.withColumn("__level", level)
    width = F.pow(F.lit(8.0), F.col("__level"))
    outer = outer.withColumn("__at", F.explode(F.sequence(F.floor(F.col("o_start") / width), F.floor(F.col("o_end") / width))))
    if longest is None:
        levels = [r[0] for r in outer.select("__level").distinct().collect()]  # logarithms of lengths: a handful
    else:
        levels = list(range(len(f"{longest + 1:o}") + 1))
    inner = inner.withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    inner = inner.withColumn("__at", F.floor(F.col("i_start") / F.pow(F.lit(8.0), F.col("__level"))))
    inside = (F.col("o_start") <= F.col("i_start")) & (F.col("o_end") >= F.col("i_end"))
    if strict:
        inside = inside & ((F.col("o_end") - F.col("o_start")) > (F.col("i_end") - F.col("i_start")))
    return inner.join(outer, ["file", "__level", "__at"]).where(inside).drop("__level", "__at")


def tightest(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """The smallest covering range of each inner range; of equal ones the first."""
    pairs = containing(inner, outer)
    best = F.min(F.struct((F.col("o_end") - F.col("o_start")).alias("size"), "o_id", "o_start", "o_end"))
    return pairs.groupBy("file", "i_id", "i_start", "i_end").agg(best.alias("b")).select("file", "i_id", "i_start", "i_end", F.col("b.o_id").alias("o_id"), F.col("b.o_start").alias("o_start"), F.col("b.o_end").alias("o_end"))


def owners(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Names of all strictly larger covering ranges, outermost first, joined with ``::``; outer has ``name``."""
    pairs = containing(inner, outer, strict=True)
    row = F.struct((F.col("o_start") - F.col("o_end")).alias("size"), F.col("o_start").alias("s"), F.col("name").alias("name"))
    names = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["name"])
    return pairs.groupBy("file", "i_id").agg(F.array_join(names, "::").alias("owner"), F.count("*").alias("depth"))


def nearest(points: DataFrame, evidence: DataFrame, most: int) -> DataFrame:
    """(file, line) with the least distance to an evidence line of the file, if at most ``most``."""
    rows = distances(points.select("file", "line"), evidence).where(F.col("distance") <= most)
    return rows.select("file", "line", "distance")


def distances(points: DataFrame, evidence: DataFrame) -> DataFrame:
    """Points (file, line, ...) with the least distance to an evidence line of the file; null if it has none.

    Only the evidence lines next above and below can be nearest: one sort of a file's lines.
    """
    rows = points.withColumn("p", F.lit(True)).unionByName(evidence.select("file", "line", F.lit(False).alias("p")), allowMissingColumns=True)
    order = Window.partitionBy("file").orderBy("line")
    mark = F.when(~F.col("p"), F.col("line"))
    below = F.last(mark, True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    above = F.first(mark, True).over(order.rangeBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"below": below, "above": above}).where("p")
    return rows.withColumn("distance", F.least(F.col("line") - F.col("below"), F.col("above") - F.col("line"))).drop("p", "below", "above")


def distance_to_range(line: Column, start: Column, end: Column) -> Column:
    """0 inside, else the gap."""
    return F.greatest(start - line, line - end, F.lit(0))


def most_specific(ranges: DataFrame) -> DataFrame:
    """Ranges (file, id, start, end) that strictly contain no other."""
    inner = ranges.select("file", F.col("id").alias("i_id"), F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    outer = ranges.select("file", F.col("id").alias("o_id"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    wide = containing(inner, outer, strict=True).select("file", F.col("o_id").alias("id")).distinct()
    return ranges.join(wide, ["file", "id"], "left_anti")
