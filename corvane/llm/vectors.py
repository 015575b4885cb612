"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated at random and reduced to the signs of its coordinates.
With the stored factor f, the inner product of code and vector, the inner
product of the code with another rotated vector, divided by f, is an unbiased
estimate of the two vectors' cosine, and sqrt(1 - f*f) / f * CONFIDENCE /
sqrt(D - 1) bounds its error. Only pairs whose upper bound reaches the
threshold are recomputed from the vectors, in double precision.

Candidates share a band of sign bits in one of several tables. The number of
bits grows with the logarithm of the number of vectors and the number of tables
is set so that a pair at the threshold is missed with probability MISS; the
Hamming distance of the codes then rules pairs out before any vector is moved.
Equal vectors form one class. Components are found without listing all pairs of
a dense group (components.linked_groups). Links are counted afterwards
inside components, by blocks of vectors of a fixed size, so that a task holds
two blocks and emits one count per vector, however large a component is.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite
components, link with nothing; vectors of different lengths link with nothing;
repeated rows are copies and link with each other; a null id is never a
component's id unless all ids there are null; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import fields
from .components import dealt_in_blocks, linked_groups
from corvane.ship import ship
from .store import stored

COSINE, MISS, CONFIDENCE, BLOCK, SEED = 0.95, 1e-4, 5.0, 1024, 20
#: vectors of a block whose links are counted
LEAST_BLOCK, MOST_BLOCK = 256, 4096
CODES = "vec_id bigint, dim int, digest binary, vector binary, code binary, factor double, head bigint, bands array<bigint>"


def rotations(dim: int, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` random rotations of ``dim`` dimensions, one below the other."""
    rng = np.random.default_rng([seed, dim])
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out)


def plan(n: int, cosine: float, miss: float) -> tuple[int, int, int]:
    """Bits of a band, number of tables, most differing bits of 64, for n vectors."""
    same = 1 - math.acos(cosine) / math.pi
    bits = max(8, math.ceil(math.log2(max(n, 4) / 4)))
    tables = math.ceil(math.log(miss) / math.log(1 - same**bits))
    apart = 64 * (1 - same)
    return bits, tables, math.ceil(apart + 5.5 * math.sqrt(apart * same))


def unit(raw: list | None) -> np.ndarray | None:
    if not raw or any(x is None for x in raw):
        return None
    v = np.array(raw, np.float64)
    norm = np.sqrt(v @ v) if np.isfinite(v).all() else 0.0
    if not np.isfinite(norm) or norm == 0:
        # very large or very small components: scale first
        most = np.abs(v).max() if np.isfinite(v).all() else 0.0
        if most == 0:
            return None
        v = v / most
        norm = np.sqrt(v @ v)
    return v / norm


def encode(table: DataFrame, bits: int, tables: int) -> DataFrame:
    """Codes of the usable vectors; the others have a null digest."""
    ship(table.sparkSession)
    kind = StructType(fields(CODES))

    def bands_of(signs: np.ndarray) -> np.ndarray:
        weights = (1 << np.arange(bits, dtype=np.int64))[None, None, :]
        cut = signs[:, : bits * tables].reshape(len(signs), tables, bits)
        return (cut * weights).sum(axis=2) * tables + np.arange(tables)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, turned = to_arrow_schema(kind), {}
        for batch in batches:
            ids, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            units = [unit(r) for r in raws]
            rows: list = [[i, None, None, None, None, None, None, None] for i in ids]
            for dim in {len(u) for u in units if u is not None}:
                if dim not in turned:
                    turned[dim] = rotations(dim, -(-max(bits * tables, 64) // dim))
                at = [k for k, u in enumerate(units) if u is not None and len(u) == dim]
                x = np.stack([units[k] for k in at])
                spun = x @ turned[dim].T
                signs = spun >= 0
                factor = np.abs(spun[:, :dim]).sum(axis=1) / math.sqrt(dim)
                heads = np.packbits(signs[:, :64], axis=1).view(">i8")[:, 0]
                keys = bands_of(signs)
                for j, k in enumerate(at):
                    raw = x[j].tobytes()
                    digest = hashlib.blake2b(raw, digest_size=16).digest()
                    rows[k] = [ids[k], dim, digest, raw, np.packbits(signs[j, :dim]).tobytes(), float(factor[j]), int(heads[j]), keys[j]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return table.select("vec_id", "embedding").mapInArrow(run, kind)


def verified(pairs: DataFrame, reps: DataFrame, cosine: float) -> DataFrame:
    """Pairs (a, b) with a cosine of at least ``cosine``: estimates first, then exact."""
    codes = reps.select(F.col("id").alias("a"), "dim", "code", "factor")
    full = reps.select(F.col("id").alias("b"), "vector")
    asked = pairs.join(codes, "a").join(full, "b").select("a", "b", "dim", "code", "factor", "vector")

    def estimate(batches):
        turned = {}
        for batch in batches:
            dims = batch.column(2).to_numpy()
            stay = np.zeros(len(dims), bool)
            for dim in np.unique(dims).tolist():
                if dim not in turned:
                    turned[dim] = rotations(dim, 1)
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                signs = np.unpackbits(np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(len(at), -1), axis=1)[:, :dim]
                q = np.frombuffer(b"".join(part.column(5).to_pylist()), np.float64).reshape(len(at), dim) @ turned[dim].T
                f = part.column(4).to_numpy()
                guess = ((2.0 * signs - 1) * q).sum(axis=1) / math.sqrt(dim) / f
                bound = np.sqrt(np.maximum(0, 1 - f * f)) / f * CONFIDENCE / math.sqrt(max(1, dim - 1))
                stay[at] = guess + bound >= cosine
            yield batch.select([0, 1]).filter(pa.array(stay))

    left = asked.mapInArrow(estimate, "a bigint, b bigint")
    both = left.join(full, "b").join(full.select(F.col("b").alias("a"), F.col("vector").alias("other")), "a").select("a", "b", "vector", "other")

    def exact(batches):
        for batch in batches:
            stay = [np.frombuffer(x.as_buffer()) @ np.frombuffer(y.as_buffer()) >= cosine for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(stay, pa.bool_()))

    return both.mapInArrow(exact, "a bigint, b bigint")


def screened(rows: DataFrame, brief: DataFrame, apart: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of few differing sign bits, of ids that share a band: one outside the band's main component,
    the other in another component than the first; met in pairs of blocks, so a crowded band is no join on one key."""
    placed = dealt_in_blocks(stored(rows.select("main", "id", "component").distinct().join(brief, "id"), "screened"), block)

    def compare(key, table):
        main, ids, component, dim = (table.column(c).to_numpy().astype(np.int64) for c in ("main", "id", "component", "dim"))
        head = table.column("head").to_numpy().view(np.uint64)
        probe = np.array(table.column("probe").to_pylist(), bool)
        targets, found_a, found_b = np.flatnonzero(~probe), [], []
        for a in np.flatnonzero(probe):
            ok = (component[targets] != component[a]) & ((component[targets] == main[a]) | (ids[targets] < ids[a])) & (dim[targets] == dim[a])
            good = ids[targets[ok & (np.bitwise_count(head[targets] ^ head[a]) <= apart)]]
            found_a.append(np.full(len(good), ids[a]))
            found_b.append(good)
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (found_a, found_b))
        return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    return placed.groupBy("main", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def counted(members: DataFrame, cosine: float, block: int = LEAST_BLOCK) -> DataFrame:
    """(component, id, weight, vector) -> (id, n): weights of the other vectors of the component that link."""
    # blocks of a sixteenth of the component, but for bounds, so its work is spread and vectors are not copied too often
    n = F.count("*")
    sizes = members.groupBy("component").agg(F.ceil(n / F.least(F.lit(float(MOST_BLOCK)), F.greatest(F.lit(float(block)), n / 16))).cast("int").alias("blocks"))
    placed = members.join(sizes, "component").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # small components share groups; a large one has a group for each pair of its blocks
    packs = max(64, members.count() // 20_000)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pack = F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("component"), F.lit(packs))).otherwise(F.col("component"))
    placed = placed.select(pack.alias("pack"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "component", "id", "weight", "vector", "mine")

    def count(key, table):
        component = table.column("component").to_numpy()
        ids, weight, mine = (table.column(c).to_numpy() for c in ("id", "weight", "mine"))
        raw = table.column("vector").to_pylist()
        i, j = key[1].as_py(), key[2].as_py()
        order = np.argsort(component, kind="stable")
        n = np.zeros(len(ids), np.int64)
        for at in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            x = np.stack([np.frombuffer(raw[k]) for k in at])
            if i == j:
                for a in range(0, len(at), BLOCK):
                    near = x[a : a + BLOCK] @ x.T >= cosine
                    near[np.arange(len(near)), a + np.arange(len(near))] = False
                    n[at[a : a + BLOCK]] = near @ weight[at]
            else:
                left, right = at[mine[at] == i], at[mine[at] == j]
                x, y = x[mine[at] == i], x[mine[at] == j]
                for a in range(0, len(left), BLOCK):
                    near = x[a : a + BLOCK] @ y.T >= cosine
                    n[left[a : a + BLOCK]] = near @ weight[right]
                    n[right] += weight[left[a : a + BLOCK]] @ near
        return pa.table({"id": pa.array(ids), "n": pa.array(n)})

    return placed.groupBy("pack", "i", "j").applyInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def near_vectors(table: DataFrame, *, cosine: float = COSINE, miss: float = MISS, block: int = BLOCK, **limits) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``block`` and the ``limits`` of components.linked_groups bound what a task
    works on at once and change no result.
    """
    bits, tables, apart = plan(table.count(), cosine, miss)
    rows = stored(encode(table, bits, tables), "codes")
    usable = rows.where("digest is not null")
    reps = usable.groupBy("digest").agg(
        F.min("vec_id").alias("class_id"), F.count("*").alias("weight"), *(F.first(c).alias(c) for c in ("dim", "vector", "code", "factor", "head", "bands"))
    )
    reps = stored(reps.withColumn("id", F.monotonically_increasing_id()), "classes")
    posted = stored(reps.select(F.explode("bands").alias("band"), "dim", "id", "head").select(F.xxhash64("band", "dim").alias("key"), "id", "head", "dim"), "postings")

    def fits(a: str, b: str) -> Column:
        return (F.bit_count(F.col(f"{a}_head").bitwiseXOR(F.col(f"{b}_head"))) <= apart) & (F.col(f"{a}_dim") == F.col(f"{b}_dim"))

    brief = reps.select("id", "dim", "head")
    found = linked_groups(posted, None, fits, lambda p: verified(p, reps, cosine), ["head", "dim"], lambda r: screened(r, brief, apart, block), **limits)
    found = stored(found, "components")
    members = stored(found.join(reps.select("id", "class_id", "weight", "vector"), "id"), "members")
    named = members.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = members.select("id", "component").join(named, "component").select("id", "component_id")
    links = counted(members, cosine, min(block, LEAST_BLOCK))
    classes = reps.select("digest", "id", "class_id", "weight").join(named, "id", "left").join(links, "id", "left")
    classes = stored(classes.select(
        "digest", F.coalesce("component_id", "class_id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    ), "named")
    out = rows.select("vec_id", "digest").join(classes, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op3_rotation_codes(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
