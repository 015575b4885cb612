"""Connected components of links, and joins of groups that only need components.

Components are found by alternating large-star and small-star steps on edges:
every step is two aggregations and two joins, the number of steps grows with
the logarithm of a component's width, and no step gathers a node's neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and none on a node that hangs itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not per.where("hangs > 1 or (hangs = 1 and holds = 1)").head(1)


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs -> (id, component) for every id in a link; component is its smallest id."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(edges):
        # large star: neighbours above a node hang on the smallest neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large_star")
        # small star: neighbours below a node, and the node, hang on the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small_star")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


#: pivots of a key with over BUSY ids; smaller keys have one
PIVOTS, BUSY = 6, 24


def _pivot_pairs(rows: DataFrame, fits, carry: list[str], first: Column, pivots: int, busy: int) -> DataFrame:
    """Pairs (a, b) of the rows' ids and a few pivots of their keys that may link.

    The first pivot has the lowest ``first``; the others are picked by hashes of
    the id alone, so that keys with much the same ids have much the same pivots.
    """

    def pick(j: int) -> Column:
        return F.min(F.struct((F.lit(0) if j else first).alias("s"), F.xxhash64(F.lit(j), "id").alias("h"), "id", *carry))

    table = rows.groupBy("key").agg(F.count("*").alias("k"), F.array(*(pick(j) for j in range(pivots))).alias("p")).where("k > 1")
    table = table.select("key", F.when(F.col("k") > busy, F.array_distinct(F.transform("p", lambda x: x.dropFields("s", "h")))).otherwise(F.array(F.col("p")[0].dropFields("s", "h"))).alias("p"))
    side = rows.select("key", F.col("id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in carry)).join(table, "key")
    side = side.withColumn("p", F.explode("p")).drop("key")
    pairs = side.select("a", *(f"a_{c}" for c in carry), F.col("p.id").alias("b"), *(F.col(f"p.{c}").alias(f"b_{c}") for c in carry))
    pairs = pairs.where((F.col("a") != F.col("b")) & fits("a", "b"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def dealt_in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows (main, id, component, ...) so dealt to (main, i, j) that each id outside its main component meets all
    ids of that main once: as ``probe`` in block i of those outside, with block j of all."""
    outside = F.col("component") != F.col("main")
    blocks = rows.groupBy("main").agg(*(F.ceil(n / F.lit(float(block))).cast("int").alias(x) for n, x in ((F.count("*"), "__all"), (F.count_if(outside), "__out"))))
    placed = rows.join(blocks.where("__out > 0"), "main")

    def mine(of: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(of)).cast("int")

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    probes = placed.where(outside).select(*rows.columns, mine("__out").alias("i"), every("__all").alias("j"), F.lit(True).alias("probe"))
    return probes.union(placed.select(*rows.columns, every("__out").alias("i"), mine("__all").alias("j"), F.lit(False).alias("probe")))


def linked_groups(
    postings: DataFrame,
    grouped: DataFrame | None,
    fits: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
    carry: list[str],
    screen: Callable[[DataFrame], DataFrame],
    first: Column | None = None,
    pivots: int = PIVOTS,
    busy: int = BUSY,
) -> DataFrame:
    """Components of all links between ids whose groups share a key, without listing the pairs of a key.

    ``postings`` has key, id and the ``carry`` columns that ``fits(left, right)``
    needs to rule a pair of groups out; its ids stand for their groups.
    ``grouped`` has (id, lead) of the other members, if any. ``verify`` keeps the
    pairs (a, b) of ids that link. The first pivot of a key has the lowest ``first``.

    1. Members are paired with the id that stands for them, and groups with a
       few pivots of their keys; the pairs that link give first components.
    2. Of each key, the component that holds most groups is its main one. A
       group pair is left out if both lie in it; the others under the key that
       ``fits`` allows are expanded to pairs of members in different components
       and verified, so no pair is missed whose ends are not yet connected.

    Keys with over ``busy`` groups outside one component are expanded by
    ``screen``: it gets rows (main, id, component, lead, places), ``places``
    being the key and ``carry`` columns of the group ``lead``, filters the group
    pairs by them and returns the pairs of members that may link.

    Both must be stored tables.
    """
    pairs = _pivot_pairs(postings, fits, carry, F.lit(0) if first is None else first, pivots, busy)
    if grouped is None:
        grouped = postings.sparkSession.createDataFrame([], "id bigint, lead bigint")
    pairs = pairs.union(grouped.select(F.greatest("id", "lead").alias("a"), F.least("id", "lead").alias("b")))
    known = stored(components(verify(stored(pairs, "pivot_pairs"))), "known")

    # the components of every group, from lowest to highest
    some = grouped.select("id", "lead").union(grouped.select("lead", "lead").distinct())
    members = stored(some.join(known, "id", "left").select("id", "lead", F.coalesce("component", "id").alias("component")), "members")
    spread = members.groupBy("lead").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    placed = postings.join(known, "id", "left").join(spread.withColumnRenamed("lead", "id"), "id", "left")
    own = F.coalesce("component", "id")
    placed = stored(placed.select("key", "id", F.coalesce("low", own).alias("low"), F.coalesce("high", own).alias("high"), *carry), "placed")
    per = placed.groupBy("key", F.col("low").alias("main")).agg(F.count("*").alias("n"), F.max("high").alias("high"))
    main = per.groupBy("key").agg(F.max(F.struct("n", "main")).alias("m"), F.sum("n").alias("n"), F.min("main").alias("lowest"), F.max("high").alias("highest"))
    main = main.where("lowest <> highest").select("key", F.col("m.main").alias("main"), F.col("n").alias("groups"))
    mixed = stored(placed.join(main, "key"), "mixed")
    inside = (F.col("low") == F.col("main")) & (F.col("high") == F.col("main"))

    few = mixed.where(F.col("groups") <= busy)
    a = few.where(~inside).select("key", F.col("id").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), *(F.col(c).alias(f"a_{c}") for c in carry))
    b = few.select("key", F.col("id").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), inside.alias("b_inside"), *(F.col(c).alias(f"b_{c}") for c in carry))
    apart = F.greatest("a_high", "b_high") != F.least("a_low", "b_low")
    group_pairs = a.join(b, "key").where(apart & (F.col("b_inside") | (F.col("a") >= F.col("b")))).where(fits("a", "b")).select("a", "b").distinct()
    left = members.select(F.col("lead").alias("a"), F.col("id").alias("a_id"), F.col("component").alias("a_component"))
    right = members.select(F.col("lead").alias("b"), F.col("id").alias("b_id"), F.col("component").alias("b_component"))
    expanded = group_pairs.join(left, "a", "left").join(right, "b", "left")
    expanded = expanded.select(F.coalesce("a_id", "a").alias("a"), F.coalesce("b_id", "b").alias("b"), "a_component", "b_component")
    expanded = expanded.where("a <> b and not (a_component <=> b_component and a_component is not null)")

    # a group with its places under crowded keys, at most the length of its prefix
    many = mixed.where(F.col("groups") > busy).groupBy("main", F.col("id").alias("lead")).agg(F.first("low").alias("low"), F.sort_array(F.collect_list(F.struct("key", *carry))).alias("places"))
    many = many.join(members, "lead", "left").select("main", F.coalesce("id", "lead").alias("id"), F.coalesce("component", "low").alias("component"), "lead", "places")
    rest = expanded.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(screen(many)).distinct()
    kept = known.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return components(kept.union(verify(stored(rest, "other_pairs"))))
