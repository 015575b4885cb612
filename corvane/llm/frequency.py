"""How many sets hold a hash, exactly, without a row for every hash.

Hashes travel packed, one row per chunk of sets and bucket of hashes. What many
sets of a chunk hold is added up there and travels once, so a hash of a third of
all sets costs its bucket a few bytes per chunk. Buckets and chunks grow in
number with the input, not in size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import partitions

#: hashes of a chunk, and about as many of a bucket, worked on at once
CHUNK = 1 << 19
LOW48 = np.uint64((1 << 48) - 1)


def parts_for(spark, hashes: int, chunk: int) -> int:
    """Chunks or buckets of about ``chunk`` hashes, at least two a shuffle partition, so that partitions get alike."""
    return max(2 * partitions(spark), -(-hashes // chunk))


def packed48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def joined(column) -> bytes:
    return b"".join(x.as_buffer() for x in column if x.is_valid)


def starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


SENT = "bucket int, hashes binary, owners binary, known binary, counts binary"


def sent(hashes: list[np.ndarray], owners: list[int], buckets: int) -> pa.RecordBatch:
    """Rows of SENT for a chunk of sets; an owner is an even number below 2**48.

    A hash that several owners of the chunk hold is counted for each of them
    here; two of them travel, marked as counted, so that others learn of it.
    """
    h = np.concatenate(hashes) & LOW48
    o = np.repeat(np.array(owners, np.uint64), [len(x) for x in hashes])
    order = np.lexsort((o, h))
    h, o = h[order], o[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))
    h, o = h[new], o[new]
    first = starts(h)
    run = np.diff(np.append(first, len(h)))
    shared = np.repeat(run > 1, run)
    known, counts = np.unique(o[shared], return_counts=True)
    stay = ~shared | (np.arange(len(h)) - np.repeat(first, run) < 2)
    h, o = h[stay], o[stay] | shared[stay].astype(np.uint64)
    rows = {k: [] for k in ("bucket", "hashes", "owners", "known", "counts")}
    to, back = h % np.uint64(buckets), (known >> np.uint64(1)) % np.uint64(buckets)
    a, b = np.argsort(to, kind="stable"), np.argsort(back, kind="stable")
    h, o, known, counts = h[a], o[a], known[b], counts[b].astype(np.uint32)
    cut, cut_back = (np.searchsorted(x, np.arange(buckets + 1, dtype=np.uint64)) for x in (to[a], back[b]))
    for i in range(buckets):
        x, y = slice(cut[i], cut[i + 1]), slice(cut_back[i], cut_back[i + 1])
        if cut[i] < cut[i + 1] or cut_back[i] < cut_back[i + 1]:
            for k, v in zip(rows, (i, packed48(h[x]), packed48(o[x]), packed48(known[y]), counts[y].tobytes())):
                rows[k].append(v)
    kinds = (pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))


def repeated(sent_rows: DataFrame, buckets: int) -> DataFrame:
    """(owner, c): how many of its sent hashes another owner sent too; at least that where copies of a set were in several chunks.

    Counts travel packed as well, by buckets of owners.
    """

    def count(key, table):
        h, o = unpacked48(joined(table.column("hashes"))), unpacked48(joined(table.column("owners")))
        marked, o = (o & np.uint64(1)).astype(bool), o & ~np.uint64(1)
        order = np.lexsort((marked, o, h))
        h, o, marked = h[order], o[order], marked[order]
        first = starts(h)
        run = np.diff(np.append(first, len(h)))
        several = np.repeat(o[first] != o[first + run - 1], run) if len(h) else marked
        one = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))[: len(h)]
        mine = o[several & one & ~marked]
        owners = np.concatenate([mine, unpacked48(joined(table.column("known")))])
        counts = np.concatenate([np.ones(len(mine)), np.frombuffer(joined(table.column("counts")), np.uint32)])
        owners, counts = summed(owners, counts)
        order, cut = by_bucket(owners >> np.uint64(1), buckets)
        owners, counts = owners[order], counts[order].astype(np.uint32)
        some = [i for i in range(buckets) if cut[i] < cut[i + 1]]
        parts = [slice(cut[i], cut[i + 1]) for i in some]
        return pa.table({"bucket": pa.array(some, pa.int32()), "owners": pa.array([packed48(owners[x]) for x in parts], pa.binary()), "counts": pa.array([counts[x].tobytes() for x in parts], pa.binary())})

    def total(key, table):
        owners, counts = summed(unpacked48(joined(table.column("owners"))), np.frombuffer(joined(table.column("counts")), np.uint32))
        return pa.table({"owner": owners.astype(np.int64), "c": counts.astype(np.int64)})

    counts = sent_rows.groupBy("bucket").applyInArrow(count, "bucket int, owners binary, counts binary")
    return counts.groupBy("bucket").applyInArrow(total, "owner bigint, c bigint")


def summed(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, back = np.unique(names, return_inverse=True)
    return names, np.bincount(back, weights=counts, minlength=len(names)) if len(names) else np.zeros(0)


def by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes by bucket, and where each bucket begins there."""
    to = h % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))


def level(total: np.ndarray) -> np.ndarray:
    """One byte for a count: 0 for 1, else a logarithmic step of at least 1."""
    return np.where(total <= 1, 0, np.minimum(255, np.floor(np.log2(np.maximum(total, 1)) * 8))).astype(np.uint8)


def with_levels(sets: DataFrame, hashes: int, work, schema: str, chunk: int = CHUNK) -> DataFrame:
    """``work`` on each chunk of ``sets`` (id, members): gets the ids, their sorted hashes and the
    level of each hash's count over all sets, and returns a table of ``schema``."""
    spark = sets.sparkSession
    chunks = buckets = parts_for(spark, hashes, chunk)
    sets = sets.select(F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), "id", "members")

    def ask(key, table):
        h, n = np.unique(np.frombuffer(joined(table.column("members")), np.uint64), return_counts=True)
        order, cut = by_bucket(h, buckets)
        h, n = h[order], n[order].astype(np.uint32)
        some = [i for i in range(buckets) if cut[i] < cut[i + 1]]
        return pa.table({
            "bucket": pa.array(some, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(some), pa.int32()),
            "hashes": pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()), "counts": pa.array([n[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
        })

    def answer(key, table):
        h, n = np.frombuffer(joined(table.column("hashes")), np.uint64), np.frombuffer(joined(table.column("counts")), np.uint32)
        names, back = np.unique(h, return_inverse=True)
        levels = level(np.bincount(back, weights=n, minlength=len(names)))[back]
        ends = np.cumsum([x.as_buffer().size // 8 for x in table.column("hashes")])
        parts = [x.tobytes() for x in np.split(levels, ends[:-1])]
        return pa.table({"chunk": table.column("chunk"), "bucket": pa.array([key[0].as_py()] * len(parts), pa.int32()), "levels": pa.array(parts, pa.binary())})

    def use(key, mine, answers):
        if not mine.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in arrow_schema(schema)})
        ids = mine.column("id").to_numpy()
        lengths = np.array([x.as_buffer().size // 8 for x in mine.column("members")])
        members = np.frombuffer(joined(mine.column("members")), np.uint64)
        h, back = np.unique(members, return_inverse=True)
        order, _ = by_bucket(h, buckets)
        at = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
        got = np.frombuffer(joined(answers.column("levels").take(pa.array(at))), np.uint8)
        levels = np.empty(len(h), np.uint8)
        levels[order] = got
        cut = np.cumsum(lengths)[:-1]
        return work(ids, np.split(members, cut), np.split(levels[back], cut))

    asked = sets.groupBy("chunk").applyInArrow(ask, "bucket int, chunk int, hashes binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, levels binary")
    return sets.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(use, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))
