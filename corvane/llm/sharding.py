"""Shards cut from a Hilbert curve over document metadata (DataFrame only).

Several metadata dimensions are quantised to ``bits`` bits, joined to one
Hilbert index, and the rows sorted by it; equal runs of that order are the
shards. Neighbours on the curve agree in all dimensions, so a file's minimum
and maximum of each dimension prune it. Law ``rows``: shard sizes differ by one
row at most.

Strings are quantised by the share of rows with smaller values, sizes on a log
scale. Rows of one cell are ordered by a hash of the row, so a hot cell spreads
over as many tasks as its rows need.

Defined cases: null metadata sorts before any value; a null text has size 1 and
a null checksum; equal texts and repeated rows are separate rows; an empty
table gives an empty result. An input column named like an output column
(shard, slot, ...) is superseded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import PART, POS, before, ordered, ranked
from .store import stored

BITS = 10


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """State machine of the Hilbert curve, derived from its Gray-code rule.

    A state is an entry corner and a direction. For state s and the cell whose
    coordinate bits are c, entry s * 2**dims + c of the lists is the cell's
    place along the curve and the state inside the cell.
    """
    size = 1 << dims
    mask = size - 1

    def rot(x: int, k: int) -> int:
        k %= dims
        return ((x >> k) | (x << (dims - k))) & mask

    place, state = [], []
    for e in range(size):
        for d in range(dims):
            for cell in range(size):
                g = rot(cell ^ e, d + 1)
                w = 0
                for shift in range(dims):
                    w ^= g >> shift
                start = 0 if w == 0 else (2 * ((w - 1) // 2)) ^ ((2 * ((w - 1) // 2)) >> 1)
                low = w if w % 2 else w - 1  # trailing set bits of it give the direction
                turn = 0 if w == 0 else ((low ^ (low + 1)).bit_length() - 1) % dims
                place.append(w)
                state.append((e ^ rot(start, -(d + 1))) * dims + (d + turn + 1) % dims)
    return place, state


def hilbert_index(coords: list[Column], bits: int = BITS) -> Column:
    """Curve index (long) of coordinates in [0, 2**bits)."""
    dims = len(coords)
    place, state = (F.array(*map(F.lit, x)) for x in curve_tables(dims))
    point = F.array(*(c.cast("int") for c in coords))
    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))

    def step(acc: Column, level: Column) -> Column:
        cell = F.lit(0)
        for i in range(dims):
            cell = cell + F.call_function("shiftleft", F.call_function("shiftright", point[i], level).bitwiseAND(F.lit(1)), F.lit(i))
        at = acc["s"] * (1 << dims) + cell
        return F.struct(
            state[at].alias("s"), (F.shiftleft(acc["h"], dims) + place[at].cast("long")).alias("h")
        )

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["h"]


def ordinal(df: DataFrame, values: DataFrame, col: str, code: str, bits: int) -> DataFrame:
    """Add ``code``: the share of rows with a smaller ``col``, in ``bits`` bits.

    ``values`` has rows of ``col`` with their count ``n``, in any number.
    """
    counts = values.groupBy(F.col(col).alias("__v")).agg(F.sum("n").alias("__n"))
    placed = ordered(counts, [F.col("__v").asc_nulls_first()], f"values{code}")
    total = F.lit(max(1, placed.agg(F.coalesce(F.sum("__n"), F.lit(0))).head()[0]))
    inside = Window.partitionBy(PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    table = placed.join(before(placed, F.col("__n")), PART)
    table = table.select("__v", F.floor(smaller * (1 << bits) / total).cast("int").alias(code))
    return df.join(table, F.col(col).eqNullSafe(F.col("__v")), "left").drop("__v")


def shard(docs: DataFrame, *, shards: int = 8, keep: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """Rows with ``keep`` (default: all columns), size, text_crc32, shard and slot."""
    own = {"size", "text_crc32", "shard", "slot"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    df = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("__row"),
        F.col("source").alias("__source"),
        F.col("lang").alias("__lang"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("__u"),
    )
    values = stored(df.groupBy("__source", "__lang").agg(F.count("*").alias("n")), "metadata")
    df = ordinal(df, values, "__source", "__x", bits)
    df = ordinal(df, values, "__lang", "__y", bits)
    top = (1 << bits) - 1
    z = F.least(F.lit(top), F.floor(F.log2("size") * ((top + 1) / 32))).cast("int")
    df = df.withColumn("__h", hilbert_index([F.col("__x"), F.col("__y"), z], bits))
    df = df.select("__row", "size", "text_crc32", "__h", "__u")
    placed = ordered(df, [F.col(c) for c in ("__h", "__u", "text_crc32", "size")], "curve")
    n = placed.count()
    placed = ranked(placed, "__rank").withColumn("shard", F.expr(f"cast((__rank * {shards}L) div {max(1, n)}L as int)"))
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")  # first rank of the shard
    return placed.select("__row.*", "size", "text_crc32", "shard", (F.col("__rank") - first).alias("slot"))


def op1_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
