"""Global order, ranks and running totals without a single-task window.

Rows are range-partitioned on a full sort key, sorted inside each partition and
written once with their partition number and position. A rank is then the
position plus the rows of earlier partitions; the only global step is a running
sum over one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import partitions, stored

PART, POS = "__part", "__pos"


def ordered(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` in global order of ``keys``, with PART and POS; written once."""
    out = (
        df.repartitionByRange(partitions(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__id", F.monotonically_increasing_id())
        .withColumn(PART, F.shiftright("__id", 33).cast("int"))
        .withColumn(POS, F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__id")
    )
    return stored(out, name)


def before(placed: DataFrame, value: Column, name: str = "__before") -> DataFrame:
    """(PART, name): the sum of ``value`` in earlier partitions. One row a partition."""
    w = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(PART).agg(F.sum(value).alias("__sum"))
    return sums.select(PART, F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias(name))


def ranked(placed: DataFrame, name: str) -> DataFrame:
    """Add the gapless global rank, from 0."""
    offs = before(placed, F.lit(1).cast("long"))
    return placed.join(offs, PART).withColumn(name, F.col("__before") + F.col(POS)).drop("__before")
