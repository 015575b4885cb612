"""The trie of conversation prefixes, from polynomial rolling fingerprints.

Conversations are rebuilt first: each begins with the first turns of an older
one. A turn's key is the 64-bit hash of role and text; turns with equal hashes
and other texts get a class number, so keys are exact. A prefix's fingerprint is
the sum of hash(turn) * BASE**place modulo 2**64, a running sum in numpy; a
prefix that is taken over from another conversation only shifts it. Depth and
fingerprint group candidates. In each group, every member's last turn and parent
group are held against those of its representative, the member with the smallest
id; with all shallower groups right, this proves the whole prefix, turn by turn.
Groups that differ are split: members that differ from the representative get
another branch from there on, until no group differs.

Rollup without a pass a level: a conversation owns the nodes whose smallest
member it is, and these are the lower end of its path, a chain. Sums over a
chain are running sums, and what a chain holds counts for each node above it on
its owner's path, one grouped sum. Only the top node of a chain has to look up
its parent's owner; parents of many chains are looked up in a table of their own.

Ids of the conversations that end at a node are hashed in order as they stream
by; an end of more than one block is hashed from blocks of ids, so that a node
where a third of all conversations end moves few rows to one task.

Defined cases: rows without conv_id belong to no conversation; null role and
text are empty; equal turns are ordered by role, then by the text's MD5, repeated
rows follow each other; a conversation may have any number of turns (it is cut
by range partitions), and an empty table has no nodes. Further columns are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.ship import ship

from .arrow import fields
from .rolling import BASE, INVERSE
from .scans import scanned
from .store import partitions, stored

#: conversations that share an older one's beginning, and the longest such beginning
SHARED, LONGEST = 20, 3
#: children of a node that are looked up in the table of busy parents
BUSY = 10_000
BLOCK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "fp", "branch"]
EMPTY = hashlib.sha256(b"").hexdigest()
HEAD = "struct<at:bigint,t:bigint,c:int,words:bigint,value:bigint>"
TURN = "struct<t:bigint,c:int,words:bigint,fp:bigint,up:bigint>"


def turns(conversations: DataFrame, bits: int) -> DataFrame:
    """conv_id, turn, role, md5, t, c, words, value: the turns with exact keys (t, c)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    t = F.xxhash64(role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        (t if bits == 64 else t.bitwiseAND(F.lit((1 << bits) - 1))).alias("t"),
    )
    texts = rows.select("t", "role", "text").distinct()
    several = texts.groupBy("t").count().where("count > 1").select("t")
    nth = F.row_number().over(Window.partitionBy("t").orderBy("role", "text")) - 1
    classes = stored(texts.join(several, "t").select("t", "role", "text", nth.cast("int").alias("c")).where("c > 0"), "turn_classes")
    rows = rows.withColumn("c", F.lit(0)) if classes.isEmpty() else rows.join(classes, ["t", "role", "text"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    words = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("bigint")
    return rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("md5"), "t", "c", words.alias("words"), F.xxhash64("t", "c").alias("value"))


def wrapped(x: int) -> int:
    """As a signed 64-bit number."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def openings(conversations: DataFrame, shared: Column, taken: Column) -> DataFrame:
    """How each conversation is rebuilt: h own turns go, hb turns of the older one come in front.

    begin is the older turns' fingerprint sum, gone that of the own turns that go.
    """
    rows = conversations.select("conv_id", "n", "heads", shared.alias("older"), taken.cast("int").alias("h"))
    older = conversations.select(F.col("conv_id").alias("older"), F.col("heads").alias("front"))
    both = rows.join(older, "older", "left").select("conv_id", "n", "h", "heads", F.slice(F.coalesce("front", F.array().cast(f"array<{HEAD}>")), F.lit(1), F.col("h")).alias("front"))
    new = fields(f"hb int, begin bigint, gone bigint, n_turns bigint, prefix array<{TURN}>")
    schema = StructType([both.schema[c] for c in ("conv_id", "h")] + new)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            out = []
            for n, h, heads, front in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                total, prefix = 0, []
                for j, x in enumerate(front):
                    up, total = total, (total + x["value"] * BASE**j) % (1 << 64)
                    prefix.append({"t": x["t"], "c": x["c"], "words": x["words"], "fp": wrapped(total), "up": wrapped(up)})
                gone = sum(x["value"] * BASE ** x["at"] for x in heads if x["at"] < h)
                out.append((len(front), wrapped(total), wrapped(gone), len(front) + max(0, n - h), prefix))
            cols = [pa.array(list(x), to_arrow_type(f.dataType)) for x, f in zip(zip(*out), new)]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], names=schema.names)

    return both.mapInArrow(run, schema)


def own_turns(rows: DataFrame) -> DataFrame:
    """Turns that stay, with the fingerprints of the rebuilt prefix that ends there and of its parent."""
    schema = StructType([rows.schema[c] for c in ("conv_id", "t", "c", "words")] + fields("depth bigint, fp bigint, up bigint, last boolean"))
    inverse = np.array([pow(INVERSE, i, 1 << 64) for i in range(LONGEST + 1)], np.uint64)

    def run(batches):
        from .scans import weighted

        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy()
            u = lambda c: col(c).view(np.uint64)
            at, h, hb = col("at"), col("h"), col("hb")
            shift = inverse[h - hb]
            fp = u("begin") + (u("total") - u("gone")) * shift
            up = fp - weighted(BASE, at, col("value")) * shift
            depth = hb + at - h + 1
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "t", "c", "words")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(depth), pa.array(fp.view(np.int64)), pa.array(up.view(np.int64)), pa.array(depth == col("n_turns"))], names=schema.names)

    return rows.mapInArrow(run, schema)


def members(conversations: DataFrame, shared: Column, taken: Column, bits: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, their rebuilt turns with fingerprints)."""
    rows = turns(conversations, bits)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("md5"), F.col("t"), F.col("c")]
    placed = scanned(rows, "conv_id", order, "value", "turns", BASE).drop("role", "md5", "turn")
    head = F.when(F.col("at") < LONGEST, F.struct("at", "t", "c", "words", "value"))
    each = placed.groupBy("conv_id").agg((F.max("at") + 1).alias("n"), F.sort_array(F.collect_list(head)).alias("heads"))
    convs = stored(openings(stored(each, "heads"), shared, taken), "conversations")
    own = own_turns(placed.join(convs.drop("prefix"), "conv_id").where("at >= h"))
    front = convs.select("conv_id", "n_turns", F.posexplode("prefix").alias("i", "x")).select(
        "conv_id", "x.t", "x.c", "x.words", (F.col("i") + 1).cast("bigint").alias("depth"), "x.fp", "x.up", (F.col("i") + 1 == F.col("n_turns")).alias("last")
    )
    rows = own.union(front).withColumn("branch", F.lit("")).withColumn("up_branch", F.lit(""))
    if bits < 64:
        mask = F.lit((1 << bits) - 1)
        rows = rows.withColumn("fp", F.col("fp").bitwiseAND(mask)).withColumn("up", F.when(F.col("depth") == 1, F.lit(0)).otherwise(F.col("up").bitwiseAND(mask)))
    return convs.select("conv_id", "n_turns"), stored(rows, "members")


def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) after all groups are proved, or split until they are."""
    seen = ["t", "c", "up", "up_branch"]
    while True:
        ends = [F.max(c).alias(f"{c}_max") for c in seen]
        nodes = stored(rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *(F.min(c).alias(c) for c in seen), *ends), "nodes")
        mixed = nodes.where(" or ".join(f"{c} <> {c}_max" for c in seen)).select(*NODE)
        if mixed.isEmpty():
            return nodes.select(*NODE, "conv_id", "n_convs", "words", "up", "up_branch"), rows
        # the class of the representative stays; the others branch off at this depth
        kinds = rows.join(mixed, NODE).groupBy(*NODE, *seen).agg(F.min("conv_id").alias("conv_id"))
        nth = F.row_number().over(Window.partitionBy(*NODE).orderBy("conv_id"))
        kinds = kinds.withColumn("kind", nth).where("kind > 1").drop("conv_id")
        moved = rows.join(kinds, [*NODE, *seen]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "kind"))).alias("moves"))
        rows = rows.join(moved, "conv_id", "left").withColumn("moves", F.coalesce("moves", F.array().cast("array<struct<depth:bigint,kind:int>>")))
        path = lambda to: F.concat_ws("", F.transform(F.filter("moves", lambda m: m["depth"] <= to), lambda m: F.concat(F.lit("/"), m["depth"].cast("string"), F.lit(":"), m["kind"].cast("string"))))
        rows = stored(rows.withColumn("branch", F.concat("branch", path(F.col("depth")))).withColumn("up_branch", F.concat("up_branch", path(F.col("depth") - 1))).drop("moves"), "split")


def digests(ends: DataFrame) -> DataFrame:
    """NODE, ends_sha256: SHA-256 of the conv_ids of each node, ascending, comma-joined."""
    spark = ends.sparkSession
    ship(spark)
    kinds = fields("depth bigint, fp bigint, branch string, first_id bigint, sha string, block binary")
    schema = StructType(kinds)

    def arrow(rows):
        from pyspark.sql.pandas.types import to_arrow_schema

        s = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), s)], schema=s)

    def blocks(batches):
        """Digests of nodes that lie inside a task whole; blocks of ids of the others."""
        rows, node, ids, size, first, outer = [], None, [], 0, None, True

        def closed(open_end):
            text = b",".join(ids)
            done = not (open_end or outer)
            rows.append((*node, first, hashlib.sha256(text).hexdigest() if done else None, None if done else text))

        for batch in batches:
            for key in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key[:3] != node:
                    if node is not None:
                        closed(False)
                        outer = False
                    node, ids, size, first = key[:3], [], 0, key[3]
                elif size >= BLOCK:
                    closed(True)
                    ids, size, first, outer = [], 0, key[3], True
                ids.append(b"%d" % key[3])
                size += len(ids[-1]) + 1
            if len(rows) > 1000 or sum(len(r[5] or b"") for r in rows) > 1 << 20:
                yield arrow(rows)
                rows.clear()
        if node is not None:
            closed(True)
            yield arrow(rows)

    def joined(batches):
        node, sha, out = None, None, []
        for batch in batches:
            for key in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5))):
                if key[:3] != node:
                    if node is not None:
                        out.append((*node, None, sha.hexdigest(), None))
                    node, sha = key[:3], hashlib.sha256(key[3])
                else:
                    sha.update(b"," + key[3])
        if node is not None:
            out.append((*node, None, sha.hexdigest(), None))
            yield arrow(out)

    order = [F.col(c) for c in (*NODE, "conv_id")]
    found = stored(ends.select(*order).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(blocks, schema), "end_blocks")
    rest = found.where("sha is null").repartition(*NODE).sortWithinPartitions(*NODE, "first_id").mapInArrow(joined, schema)
    return found.where("sha is not null").union(rest).select(*NODE, F.col("sha").alias("ends_sha256"))


def trie(conversations: DataFrame, *, shared: Column | None = None, taken: Column | None = None, bits: int = 64, busy: int = BUSY) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``shared`` names the conversation whose beginning a conversation takes over,
    ``taken`` how many turns of it, at most LONGEST. ``bits`` of hashes are kept
    (64; fewer only to see collisions).
    """
    shared = F.col("conv_id") - F.col("conv_id") % SHARED if shared is None else shared
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LONGEST + 1) if taken is None else taken
    convs, rows = members(conversations, shared, taken, bits)
    nodes, rows = grouped(rows)
    zero = [F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("fp"), F.lit("").alias("branch")]
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*zero, "conv_id", "n_convs", F.lit(0).cast("bigint").alias("words"), F.lit(None).cast("bigint").alias("up"), F.lit(None).cast("string").alias("up_branch"))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("fp"), F.col("up_branch").alias("branch")).agg(F.count("*").alias("n_children"))
    full = nodes.union(root).join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    full = full.withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    # chains: the nodes that a conversation owns, from the top
    chain = stored(scanned(full, "conv_id", [F.col("conv_id"), F.col("depth")], "saved", "chains"), "chained")
    owners = chain.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("chain_saved"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("bigint").alias("chain_leaves"))
    owners = stored(owners, "owners")
    below = owners.where("top > 0 and (chain_saved > 0 or chain_leaves > 0)")
    sums = [F.sum("chain_saved").alias("below_saved"), F.sum("chain_leaves").alias("below_leaves")]
    above = rows.join(below, "conv_id").where("depth < top").groupBy(*NODE).agg(*sums)
    above = above.union(below.agg(*sums).where("below_leaves is not null").select(*zero, "below_saved", "below_leaves"))
    # the top of a chain looks up its parent's owner
    tops = chain.where("at = 0 and depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up").alias("fp"), F.col("up_branch").alias("branch"), F.col("conv_id").alias("child"))
    parents = chain.select(*NODE, F.col("conv_id").alias("parent_conv_id"), "n_children")
    crowded = stored(parents.where(F.col("n_children") >= busy), "busy").drop("n_children")
    quiet = parents.where(F.col("n_children") < busy).drop("n_children")
    looked = tops.join(crowded, NODE).union(tops.join(crowded.select(*NODE), NODE, "left_anti").join(quiet, NODE)).select(F.col("child").alias("conv_id"), "parent_conv_id")
    ends = rows.where("last").select(*NODE, "conv_id").union(convs.where("n_turns = 0").select(*zero, "conv_id"))
    out = chain.join(owners, "conv_id").join(looked, "conv_id", "left").join(above, NODE, "left").join(digests(ends), NODE, "left")
    nothing = F.lit(0).cast("bigint")
    return out.select(
        "conv_id", "depth", F.when(F.col("at") > 0, F.col("conv_id")).when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("chain_leaves") + F.coalesce("below_leaves", nothing)).alias("n_leaves"),
        (F.col("chain_saved") - F.col("total") + F.col("saved") + F.coalesce("below_saved", nothing)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
