"""Near-duplicate documents: grouped prefix join on word shingles.

A document is the set of its distinct 5-word shingles (the whole sequence if it
has fewer words); two link at a Jaccard similarity of ``similar`` percent.
Documents with equal sets form a class with one representative.

Most classes share too little with any other to link. A first exchange of
hashes finds them: of the leading shingles in hash order (about half of a set),
similar sets share a known number, so a class of which fewer are held by any
other class links with nothing (see ``needed``). The join works on the rest.

There, shingles are ordered by how many classes hold them, rarest first, from
exact counts, then by hash; similar sets share one of the first
n - ceil(similar * n) + 1 of that order. Classes with identical prefix and size
form a group, and only the group's smallest member is posted, under the prefix
shingles that others hold too. Group pairs are filtered by size and by the
places of the shared shingle; those that stay are expanded to pairs of members
and verified on whole sets. Only components are needed, so groups are compared
with pivots first (see components.linked_groups); pairs whose ends are already
connected are not listed.

Defined cases: a null text or one without words has an empty set and links with
nothing; repeated rows are copies; null ids never become a component's id
unless all ids of a component are null; an empty table gives an empty result;
other columns of the input may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.ship import ship

from .arrow import free_name, map_texts, slices
from .bits import bitmap, test
from .components import dealt_in_blocks, linked_groups
from .frequency import CHUNK, SENT, parts_for, repeated, sent, with_levels
from .rolling import windows, word_hashes
from .store import stored

SHINGLE, SIMILAR = 5, 75
#: rows of a key compared at once
BLOCK = 1024
#: of Spark's xxhash64 function
SPARK_SEED = 42
SETS = "n_shingles bigint, digest binary, owner bigint, need int"
PREFIXES = "id bigint, n int, own int, keys array<bigint>, prefix_digest binary, signature binary"


def at_least(n: int, similar: int) -> int:
    """The least intersection of a set of n members with a similar set."""
    return -(-similar * n // 100)


def prefix_length(n: int, similar: int = SIMILAR) -> int:
    return n - at_least(n, similar) + 1


def extra(n: int, similar: int) -> int:
    """How many shared shingles the leading part of a set of n is made to show."""
    return max(1, min(n // 4, at_least(n, similar)))


def leading(n: int, similar: int) -> int:
    """Length of the part, in hash order, of which similar sets share as many as the smaller one's ``extra``."""
    return min(n, n - at_least(n, similar) + extra(n, similar))


def needed(n: int, similar: int) -> int:
    """Shared shingles that the leading part of a set of n must have if it links: a linked set has at_least(n) members or more."""
    return extra(at_least(n, similar), similar)


def hashed(texts: list[bytes | None], width: int):
    """The sorted distinct shingle hashes of each text."""
    h, n = word_hashes(texts, lower=True)
    whole = windows(h, width)
    for end, k in zip(np.cumsum(n), n):
        s = whole[end - k : end - width + 1] if k >= width else windows(h[end - k : end], int(k)) if k else h[:0]
        s = np.sort(s)
        yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s


def digest_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def owner_of(digest: bytes) -> int:
    """An even number below 2**48 that names a class among those with a shingle."""
    return int.from_bytes(digest[:6], "little") & ~1


def signature(s: np.ndarray) -> bytes:
    """Members in each of m buckets, m from one to two times the set's size; two bits a bucket, 3 for three or more."""
    m = 1 << max(4, len(s).bit_length())
    few = np.minimum(3, np.bincount((s >> np.uint64(32)).astype(np.int64) & (m - 1), minlength=m)).reshape(-1, 4)
    return (few @ np.array([1, 4, 16, 64])).astype(np.uint8).tobytes()


def unpacked(raw: np.ndarray) -> np.ndarray:
    return ((raw[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & np.uint8(3)).astype(np.int64).reshape(-1)


def most_shared(x: np.ndarray, n: int, y: np.ndarray, k: int) -> int:
    """An upper bound of the intersection of two sets of n and k members, from their signatures.

    Members beyond three in a bucket are not seen; they may all be shared.
    """
    x, y = unpacked(x), unpacked(y)
    over = (n - int(x.sum()), k - int(y.sum()))
    if len(x) == len(y):
        return int(np.minimum(x, y).sum()) + min(over)
    m = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, m).sum(axis=0), y.reshape(-1, m).sum(axis=0)).sum()) + sum(over)


def sets(docs: DataFrame, width: int, similar: int) -> DataFrame:
    def make():
        def work(texts):
            rows = []
            for s in hashed(texts, width):
                d = digest_of(s) if len(s) else None
                rows.append((len(s), d, owner_of(d), needed(len(s), similar)) if d else (0, None, None, None))
            return [list(c) for c in zip(*rows)]

        return work

    return map_texts(docs, make, SETS, keep=["doc_id"])


def live_classes(docs: DataFrame, classes: DataFrame, hashes: int, width: int, similar: int, chunk: int = CHUNK) -> DataFrame:
    """The classes whose leading shingles are held by other classes often enough for a link."""
    spark = docs.sparkSession
    ship(spark)
    buckets = parts_for(spark, hashes // 2, 2 * chunk)

    def scan(batches):
        held, owners, size = [], [], 0
        for batch in batches:
            for _, texts in slices(batch, batch.column(0)):
                for s in hashed(texts, width):
                    if len(s):
                        held.append(s[: leading(len(s), similar)])
                        owners.append(owner_of(digest_of(s)))
                        size += len(held[-1])
                if size >= chunk:
                    yield sent(held, owners, buckets)
                    held, owners, size = [], [], 0
        if held:
            yield sent(held, owners, buckets)

    found = repeated(docs.select("text").mapInArrow(scan, SENT), buckets)
    return classes.join(found, "owner").where("c >= need").drop("c")


def sets_of(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(id, n, members) of the classes (id, digest, n), from the documents."""
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(classes, F.xxhash64("digest")))

    def run(batches):
        for batch in batches:
            for _, texts in slices(batch, batch.column(0)):
                some = {}
                for s in hashed(texts, width):
                    if len(s):
                        some[digest_of(s)] = s
                if some:
                    names, members = list(some), [s.tobytes() for s in some.values()]
                    keys = np.array([xxhash.xxh64_intdigest(x, SPARK_SEED) for x in names], np.uint64)
                    stay = pa.array(test(marks.value, keys))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(members, pa.binary())], names=["digest", "members"]).filter(stay)

    found = docs.select("text").mapInArrow(run, "digest binary, members binary").join(classes.select("digest", "id", "n"), "digest")
    return found.groupBy("id").agg(F.first("n").alias("n"), F.first("members").alias("members"))


def prefixes(members: DataFrame, hashes: int, similar: int, chunk: int = CHUNK) -> DataFrame:
    """Rows of PREFIXES of the sets that share a prefix shingle with another.

    ``own`` is how many shingles of the prefix no other set has; ``keys`` are
    those that follow, in order.
    """

    def work(ids, parts, levels):
        rows = []
        for i, s, level in zip(ids.tolist(), parts, levels):
            p = prefix_length(len(s), similar)
            own = int((level == 0).sum())
            if own >= p:
                continue
            keys = s[np.lexsort((s, level))[own:p]]
            # a prefix with a shingle of its own is like no other
            name = hashlib.blake2b(b"%d " % len(s) + (b"%d" % i if own else keys.tobytes()), digest_size=16, person=b"own" if own else b"all").digest()
            rows.append((i, len(s), own, keys.view(np.int64), name, signature(s)))
        columns = zip(*rows) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.table({k: pa.array(list(v), kind) for k, v, kind in zip(("id", "n", "own", "keys", "prefix_digest", "signature"), columns, kinds)})

    return with_levels(members, hashes, work, PREFIXES, chunk)


def could_link(a: str, b: str, similar: int) -> Column:
    """Size and position filter: whether sets that share the prefix shingle at these places may link."""
    n_a, n_b, at_a, at_b = (F.col(x) for x in (f"{a}_n", f"{b}_n", f"{a}_at", f"{b}_at"))
    need = F.ceil(F.lit(similar) * (n_a + n_b) / F.lit(100 + similar))
    by_size = (F.lit(100) * n_a >= F.lit(similar) * n_b) & (F.lit(100) * n_b >= F.lit(similar) * n_a)
    return by_size & (F.least(at_a, at_b) + F.least(n_a - at_a, n_b - at_b) >= need)


class Groups:
    """Groups under crowded keys, to find those that may link with one of them."""

    def __init__(self, size: np.ndarray, group: np.ndarray, keys: np.ndarray, at: np.ndarray):
        """``size`` of each group; group, key and place of each posting."""
        order = np.argsort(keys, kind="stable")
        self.size, self.group, self.keys, self.at = size, group[order], keys[order], at[order]

    def partners(self, size: int, keys: np.ndarray, at: np.ndarray, similar: int) -> np.ndarray:
        """Numbers of the groups that share a key with one of this size and these places, and pass by size and place."""
        a, b = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = b - a
        i = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        mine, other, their = np.repeat(at, n), self.at[i], self.size[self.group[i]]
        need = -(-similar * (size + their) // (100 + similar))
        ok = (100 * size >= similar * their) & (100 * their >= similar * size)
        ok &= np.minimum(mine, other) + np.minimum(size - mine, their - other) >= need
        return np.unique(self.group[i[ok]])


def screened(rows: DataFrame, brief: DataFrame, similar: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) that signatures allow, of members of groups that share a key and pass by size and place:
    one outside the key's main component, the other in another component than the first.

    ``rows`` has (main, id, component, lead, places), ``lead`` being the id's
    group and ``places`` its (key, n, at). All keys with the same main component
    are worked on together, so a pair is compared once and not under each key.
    Ids outside meet all ids in pairs of blocks of about ``block``; there group
    pairs are filtered first, and only the members of those that pass are
    expanded.
    """
    rows = rows.select("main", "id", "component", "lead", F.col("places.key").alias("keys"), F.col("places.at").alias("at")).join(brief, "id")
    placed = dealt_in_blocks(stored(rows, "screened"), block)

    def compare(key, table):
        main, ids, component, lead, n = (table.column(c).to_numpy().astype(np.int64) for c in ("main", "id", "component", "lead", "n"))
        probe = np.array(table.column("probe").to_pylist(), bool)
        bits = [unpacked(np.frombuffer(x.as_buffer(), np.uint8)) for x in table.column("signature")]
        over = n - np.array([int(x.sum()) for x in bits])
        size = np.array([len(x) for x in bits])
        targets = np.flatnonzero(~probe)
        leads, first, group = np.unique(lead, return_index=True, return_inverse=True)
        places = [tuple(np.asarray(table.column(c)[i].values.to_numpy(zero_copy_only=False), np.int64) for c in ("keys", "at")) for i in first.tolist()]
        here = np.unique(group[targets])
        posted = [np.concatenate([places[g][k] for g in here]) if len(here) else np.zeros(0, np.int64) for k in (0, 1)]
        groups = Groups(n[first], np.repeat(here, [len(places[g][0]) for g in here]), *posted)
        may: dict[int, np.ndarray] = {}
        matrices = {m: (at := targets[size[targets] == m], np.stack([bits[i] for i in at]).astype(np.uint8)) for m in np.unique(size[targets]).tolist()}
        found_a, found_b = [], []
        for a in np.flatnonzero(probe):
            need = -(-similar * (n[a] + n) // (100 + similar))
            ok = (100 * n[a] >= similar * n) & (100 * n >= similar * n[a])
            ok &= (component != component[a]) & ((component == main) | (ids < ids[a]))
            g = int(group[a])
            if g not in may:
                may[g] = np.zeros(len(leads), bool)
                may[g][groups.partners(int(n[a]), *places[g], similar)] = True
            ok &= may[g][group]
            for m, (at, matrix) in matrices.items():
                some = np.flatnonzero(ok[at])
                if not len(some):
                    continue
                other, own, small = matrix[some], bits[a], min(m, int(size[a]))
                some = at[some]
                if m > small:
                    other = other.reshape(len(some), -1, small).sum(axis=1)
                if size[a] > small:
                    own = own.reshape(-1, small).sum(axis=0)
                hidden = np.minimum(over[a], over[some]) if m == size[a] else over[a] + over[some]
                good = some[np.minimum(other, own).sum(axis=1) + hidden >= need[some]]
                found_a.append(np.full(len(good), ids[a]))
                found_b.append(ids[good])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (found_a, found_b))
        return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    return placed.groupBy("main", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def verified(pairs: DataFrame, brief: DataFrame, members: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of class numbers whose whole sets link; signatures rule most others out first."""
    left = brief.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("x"))
    right = brief.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("y"))

    def bounded(batches):
        for batch in batches:
            a, b, n, k, x, y = (batch.column(i) for i in range(6))
            x, y = ([np.frombuffer(v.as_buffer(), np.uint8) for v in c] for c in (x, y))
            n, k = n.to_pylist(), k.to_pylist()
            stay = [(100 + similar) * most_shared(*v) >= similar * (v[1] + v[3]) for v in zip(x, n, y, k)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(stay, pa.bool_()))

    pairs = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(bounded, "a bigint, b bigint")
    pairs = pairs.join(members.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    both = pairs.join(members.select(F.col("id").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            stay = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(s, t, assume_unique=True))
                stay.append(100 * same >= similar * (len(s) + len(t) - same))
            yield batch.select([0, 1]).filter(pa.array(stay, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def classes_of(docs: DataFrame, *, width: int = SHINGLE, similar: int = SIMILAR, chunk: int = CHUNK, block: int = BLOCK, **limits) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, digest) and classes (digest, copies, class_id, component, component_id, linked).

    ``class_id`` and ``component_id`` are the smallest doc_id of the class and of
    all classes linked with it; ``component`` numbers the components. ``chunk``,
    ``block`` and the ``limits`` of components.linked_groups bound what a task
    works on at once and change no result.
    """
    rows = stored(sets(docs, width, similar).withColumn("id", F.monotonically_increasing_id()), "sets")
    # a class has the number of its first row, so that null and repeated ids need no care
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("class_id"), F.min("id").alias("id"),
        F.first("n_shingles").alias("n"), F.first("owner").alias("owner"), F.first("need").alias("need"),
    )
    classes = stored(classes, "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    live = stored(live_classes(docs, classes.select("id", "digest", "n", "owner", "need"), total, width, similar, chunk), "live_classes")
    members = stored(sets_of(docs, live, width), "live_sets")
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    found = stored(prefixes(members, total, similar, chunk), "prefixes")
    # groups of identical prefix and size
    leads = found.where("own = 0").groupBy("prefix_digest").agg(F.min("id").alias("lead"), F.count("*").alias("k")).where("k > 1")
    grouped = stored(found.where("own = 0").select("id", "prefix_digest").join(leads, "prefix_digest").where("id <> lead").select("id", "lead"), "grouped")
    posted = found.join(grouped.select("id"), "id", "left_anti").select("id", "n", "own", F.posexplode("keys").alias("at", "key"))
    posted = stored(posted.select("key", "id", "n", (F.col("at") + F.col("own")).alias("at"), "own"), "postings")
    brief = found.select("id", "n", "signature")
    linked = linked_groups(
        posted, grouped, lambda a, b: could_link(a, b, similar), lambda p: verified(p, brief, members, similar), ["n", "at"],
        lambda r: screened(r, brief, similar, block), F.col("own"), **limits,
    )
    linked = stored(linked, "components")
    names = linked.join(classes.select("id", "class_id"), "id").groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = classes.select("digest", "copies", "id", "class_id").join(linked.join(names, "component"), "id", "left")
    component_id = F.when(F.col("component").isNull(), F.col("class_id")).otherwise(F.col("component_id"))
    named = named.select("digest", "copies", "class_id", F.coalesce("component", "id").alias("component"), component_id.alias("component_id"), F.col("component").isNotNull().alias("linked"))
    return rows.select("doc_id", "n_shingles", "digest"), named


def join_classes(docs: DataFrame, *, width: int = SHINGLE, similar: int = SIMILAR, **limits) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and class_id."""
    rows, classes = classes_of(docs, width=width, similar=similar, **limits)
    out = rows.join(classes, "digest", "left")
    none = F.col("digest").isNull()
    return out.select("doc_id", "n_shingles", *(F.when(none, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("component_id", "class_id")))


def one_of_each(docs: DataFrame, *, width: int = SHINGLE, similar: int = SIMILAR, **limits) -> DataFrame:
    """The documents with all their columns, one for each component: that of the smallest doc_id.

    Only rows whose class may have company pass through a join; a bitmap of
    fixed size lets all others through at once.
    """
    spark = docs.sparkSession
    _, classes = classes_of(docs, width=width, similar=similar, **limits)
    digest, maybe, tag = (free_name(docs, x) for x in ("digest", "maybe", "tag"))
    company = stored(classes.where("linked or copies > 1").select(F.col("digest").alias(digest), "component"), "company")
    marks = spark.sparkContext.broadcast(bitmap(company, F.xxhash64(digest)))
    columns = [f"`{c}`" for c in docs.columns]

    def make():
        def work(texts):
            digests = [digest_of(s) if len(s) else None for s in hashed(texts, width)]
            keys = np.array([xxhash.xxh64_intdigest(d, SPARK_SEED) if d else 0 for d in digests], np.uint64)
            return [digests, [bool(d) and bool(t) for d, t in zip(digests, test(marks.value, keys))]]

        return work

    tagged = map_texts(docs, make, f"`{digest}` binary, `{maybe}` boolean")
    alone = tagged.where(~F.col(maybe)).select(*columns)
    some = stored(tagged.where(F.col(maybe)).withColumn(tag, F.monotonically_increasing_id()), "company_rows")
    placed = some.select(digest, F.col("doc_id").alias("id"), tag).join(company, digest, "left")
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", tag))
    best = placed.where("component is not null").groupBy("component").agg(first.alias("f")).select(F.col("f")[tag].alias(tag))
    best = best.union(placed.where("component is null").select(tag))
    return alone.union(some.join(best, tag, "left_semi").select(*columns))


def op2_grouped_prefix_join(spark, sf_dir: str) -> DataFrame:
    return join_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_id")
