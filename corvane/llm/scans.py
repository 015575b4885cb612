"""Running sums by key over rows in global order, also where one key fills many tasks.

Rows are range-partitioned and sorted, scanned in numpy in the task that sorted
them, and written once. A key that goes on in the next partition hands over one
row, the end of its run; these rows, at most one a partition, are added up on
the driver and sent back.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.ship import ship

from .arrow import fields, free_name
from .rolling import powers
from .store import partitions, stored

SCAN = "at bigint, total bigint"
#: powers are looked up in two tables, for the low bits of an exponent and the others
LOW = 20


def weighted(base: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values * base**at modulo 2**64."""
    values = values.view(np.uint64)
    if base == 1 or not len(at):
        return values
    high = at >> LOW
    out = values * powers(base, 1 << LOW)[at & ((1 << LOW) - 1)]
    return out * powers(pow(base, 1 << LOW, 1 << 64), int(high.max()) + 1)[high] if high.any() else out


def raised(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def scanned(df: DataFrame, key: str, order: list[Column], value: str, name: str, base: int = 1) -> DataFrame:
    """``df`` with at, the place among the rows of its key from 0, and total, the sum of
    value * base**at up to it, modulo 2**64.

    ``key`` and ``value`` are bigint without nulls, and ``order`` begins with the key.
    """
    spark = df.sparkSession
    ship(spark)
    part, end = free_name(df, "part"), free_name(df, "end")
    inner = StructType(df.schema.fields + fields(f"{SCAN}, `{part}` int, whole boolean, `{end}` boolean"))

    def batch_of(cols, ends):
        """The rows; the last row of the task ends its run."""
        flags = np.zeros(len(cols[0]), bool)
        flags[-1] = ends
        return pa.RecordBatch.from_arrays([*cols, pa.array(flags)], names=inner.names)

    def scan(batches):
        from pyspark import TaskContext

        here, at0, total0, last, one, held = TaskContext.get().partitionId(), 0, np.uint64(0), None, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, v = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (key, value))
            new = np.concatenate(([k[0] != last], k[1:] != k[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            at = np.arange(len(k)) - first
            goes_on = first == 0 if not new[0] else np.zeros(len(k), bool)
            at[goes_on] += at0
            terms = np.cumsum(weighted(base, at, v))
            total = terms - np.where(first > 0, terms[first - 1], np.uint64(0))
            total[goes_on] += total0
            one = one and bool((last is None or not new[0]) and not new[1:].any())
            last, at0, total0 = k[-1], int(at[-1]) + 1, total[-1]
            if held is not None:
                yield batch_of(held, False)
            n = len(k)
            held = [*batch.columns, pa.array(at), pa.array(total.view(np.int64)), pa.array(np.full(n, here, np.int32)), pa.array(np.full(n, one))]
        if held is not None:
            yield batch_of(held, True)

    placed = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    table = stored(placed.mapInArrow(scan, inner), name)
    tails = table.where(F.col(end)).select(part, key, "at", "total", "whole").collect()
    before: dict[int, tuple[int, int, int]] = {}
    carry = None
    for t in sorted(tails, key=lambda t: t[part]):
        n, total = t["at"] + 1, t["total"] % (1 << 64)
        if carry is not None:
            before[t[part]] = carry
            if t["whole"] and t[key] == carry[0]:
                n, total = n + carry[1], (carry[2] + pow(base, carry[1], 1 << 64) * total) % (1 << 64)
        carry = (t[key], n, total)
    earlier = spark.sparkContext.broadcast(before)
    outer, width = StructType(df.schema.fields + fields(SCAN)), len(df.columns)

    def carried(batches):
        for batch in batches:
            k, at, total, where = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (key, "at", "total", part))
            at, total = at.copy(), total.view(np.uint64).copy()
            cut = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1), len(where)]
            for a, b in pairwise(cut):
                was = earlier.value.get(int(where[a])) if a < b else None
                if was is not None:
                    mine = np.flatnonzero(k[a:b] == was[0]) + a
                    at[mine] += was[1]
                    total[mine] = np.uint64(was[2]) + raised(base, was[1]) * total[mine]
            cols = [batch.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at), pa.array(total.view(np.int64))], names=outer.names)

    return table.drop(end, "whole").mapInArrow(carried, outer)
