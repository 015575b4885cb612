"""Collocations: frequent phrases by hierarchical pair naming.

A frequent word gets an id. A phrase of k words is the pair of the ids of its
first and its last k - 1 words, so it is counted where both are frequent, and a
frequent pair gets an id in turn. The two halves of a pair are parent pointers:
all cuts of a phrase and all phrases inside it are reached through them.

Texts become chunks of word numbers of about ``chunk`` places in the task that
reads them; a long text is cut between pieces. At each level a chunk asks, packed
by bucket, for its different pairs with their counts; buckets add up, name what
is frequent and answer each chunk, which replaces pairs by their names. So
what travels is one entry a chunk for each different pair, however often it
occurs, and the chunk's numbers, which shrink as fewer pairs are frequent; both
compressed. A chunk numbers what it asks for by bucket, so an answer needs no
more than the place in the question. Buckets grow in number with the text, and
no table of phrases is broadcast.

Each language has words of its own and, through them, pairs of its own. Counts
are 64-bit, scores are integers of any size in Python.

Defined cases: null text is empty, null lang is ``und``; repeated rows count
each; a text without words counts nothing; an empty table has no phrases. Bytes
that are no UTF-8 cannot occur in a string column. Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.ship import ship

from .arrow import slices
from .frequency import starts
from .rolling import mixed
from .store import partitions, released, span, stored

LEAST, LONGEST, TOP = 100, 5, 2000
#: words of a chunk, and bytes of text for a bucket
CHUNK, BUCKET = 1 << 20, 1 << 25
#: text of one document taken at once, in bytes
PART = 1 << 22
#: lower case, tab to space, and every separator of pieces to a full stop
SPLIT = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
STOP = b"."
#: chunk rows hold the numbers of a chunk, ask rows (bucket set) different words or pairs with counts, numbered from ``first``
STATE = "chunk bigint, bucket int, lang string, seq binary, size int, first int, words binary, a binary, b binary, counts binary, total bigint"
ANSWER = "chunk bigint, places binary, names binary, id bigint, lang string, word binary, a bigint, b bigint, f bigint"


KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of plain columns, also where there is no session."""
    return pa.schema([(x.split()[0], KINDS[x.split()[1]]) for x in ddl.split(", ")])


def table(schema: str, rows: list[dict]) -> pa.Table:
    kinds = arrow_schema(schema)
    return pa.table({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in kinds})


def packed(x: np.ndarray | bytes, steps: bool = False) -> bytes:
    """Compressed, with its length in front; numbers by planes of bytes, rising ones (``steps``) by their differences."""
    if not isinstance(x, bytes):
        x = np.diff(x, prepend=x.dtype.type(0)) if steps else x
        x = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True)


def unpacked(x: pa.Scalar) -> bytes:
    x = x.as_py()
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)


def numbers(column, kind=np.int64, steps: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows in a row, and how many each has."""
    got = []
    for x in column:
        planes = np.frombuffer(unpacked(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
        one = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
        got.append(np.cumsum(one, dtype=kind) if steps else one)
    return np.concatenate(got) if got else np.zeros(0, kind), np.array([len(x) for x in got], np.int64)


def name(level: int, bucket: int, n: int) -> np.ndarray:
    """Ids of n phrases of a bucket: the level, the bucket and the place in it."""
    return np.int64(level << 59 | bucket << 32) + np.arange(n, dtype=np.int64)


def word_chunks(docs: DataFrame, buckets: int, chunk: int) -> DataFrame:
    """Chunk rows with numbers of words, -1 between pieces, and the questions for their words."""
    ship(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        nth = count(TaskContext.get().partitionId() << 32)
        fresh, langs, seqs, size = count(), {}, [], 0

        def done():
            seq = np.concatenate(seqs)
            n = np.bincount(seq[seq >= 0], minlength=sum(len(k) - 1 for k in langs.values()))
            asked = sorted((zlib.crc32(w) % buckets, lang, w, i) for lang, known in langs.items() for w, i in known.items() if i >= 0)
            order = np.array([x[3] for x in asked], np.int64)
            number = np.full(len(n) + 1, -1, np.int32)
            number[order] = np.arange(len(order))
            me = next(nth)
            rows = [{"chunk": me, "seq": packed(number[seq]), "size": len(n)}]
            for (bucket, lang), mine in groupby(enumerate(asked), lambda x: x[1][:2]):
                mine = list(mine)
                c = n[order[mine[0][0] : mine[-1][0] + 1]].astype(np.int64)
                rows.append({"chunk": me, "bucket": bucket, "lang": lang, "first": mine[0][0], "words": packed(b" ".join(x[1][2] for x in mine)), "counts": packed(c), "total": int(c.sum())})
            return table(STATE, rows).to_batches()

        for batch in batches:
            for rows, texts in slices(batch, batch.column(batch.schema.get_field_index("text"))):
                for lang, text in zip(rows.column(rows.schema.get_field_index("lang")).to_pylist(), texts):
                    for piece in pieces(text or b""):
                        if lang not in langs:
                            langs[lang] = defaultdict(fresh.__next__, {STOP: -1})
                        words = piece.replace(STOP, b" . ").split()
                        seqs += [np.fromiter(map(langs[lang].__getitem__, words), np.int32, len(words)), np.array([-1], np.int32)]
                        size += len(words) + 1
                        if size >= chunk:
                            yield from done()
                            fresh, langs, seqs, size = count(), {}, [], 0
        if size:
            yield from done()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, STATE)


def pieces(text: bytes):
    """The text with its separators, in parts that end at a separator, or whole if it has none."""
    text, at = text.translate(SPLIT), 0
    while at < len(text):
        cut = text.find(STOP, at + PART)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut


def answered(t: pa.Table, ids: np.ndarray, lengths: np.ndarray) -> list[dict]:
    """Answer rows: for each question the numbers that are frequent, with their ids."""
    rows, cut = [], np.cumsum(lengths)[:-1]
    for chunk, first, mine in zip(t.column("chunk").to_pylist(), t.column("first").to_pylist(), np.split(ids, cut)):
        good = np.flatnonzero(mine >= 0)
        if len(good):
            rows.append({"chunk": chunk, "places": packed((good + first).astype(np.int32), True), "names": packed(mine[good])})
    return rows


def named_words(asked: DataFrame, least: int) -> DataFrame:
    """Frequent words with ids, and each chunk's answers."""

    def run(key, t):
        total: dict = defaultdict(int)
        langs, words = t.column("lang").to_pylist(), [unpacked(x).split(b" ") for x in t.column("words")]
        counts, lengths = numbers(t.column("counts"))
        every = [(lang, w) for lang, mine in zip(langs, words) for w in mine]
        for k, n in zip(every, counts.tolist()):
            total[k] += n
        good = sorted(k for k, n in total.items() if n >= least)
        ids = dict(zip(good, name(1, key[0].as_py(), len(good)).tolist()))
        rows = [{"id": i, "lang": k[0], "word": k[1], "f": total[k]} for k, i in ids.items()]
        return table(ANSWER, rows + answered(t, np.fromiter((ids.get(k, -1) for k in every), np.int64, len(every)), lengths))

    return asked.select("chunk", "bucket", "lang", "first", "words", "counts").groupBy("bucket").applyInArrow(run, ANSWER)


def named_pairs(asked: DataFrame, level: int, least: int) -> DataFrame:
    """Frequent pairs with ids, and each chunk's answers."""

    def run(key, t):
        (a, lengths), (b, _), (n, _) = (numbers(t.column(c), steps=c == "a") for c in ("a", "b", "counts"))
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        first = starts_of(sa, sb)
        total = np.add.reduceat(n[order], first)
        good = total >= least
        ids = np.full(len(first), -1, np.int64)
        ids[good] = name(level, key[0].as_py(), int(good.sum()))
        of = np.empty(len(a), np.int64)
        of[order] = np.repeat(ids, np.diff(np.append(first, len(a))))
        g = first[good]
        found = {"id": ids[good], "a": sa[g], "b": sb[g], "f": total[good]}
        named = pa.table({f.name: pa.array(found[f.name], f.type) if f.name in found else pa.nulls(len(g), f.type) for f in arrow_schema(ANSWER)})
        return pa.concat_tables([table(ANSWER, answered(t, of, lengths)), named])

    return asked.select("chunk", "bucket", "first", "a", "b", "counts").groupBy("bucket").applyInArrow(run, ANSWER)


def starts_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where runs of equal pairs begin."""
    return starts(np.cumsum(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))) if len(a) else starts(a)


def next_pairs(state: DataFrame, answers: DataFrame, buckets: int, last: bool) -> DataFrame:
    """Each chunk's numbers replaced by their names, and the questions for pairs of neighbours."""

    def run(key, mine, got):
        if not mine.num_rows or not got.num_rows:
            return table(STATE, [])
        seq = numbers(mine.column("seq"), np.int32)[0]
        names = np.full(mine.column("size")[0].as_py(), -1, np.int64)
        names[numbers(got.column("places"), np.int32, True)[0]] = numbers(got.column("names"))[0]
        # only frequent ones stay
        kept = np.flatnonzero(names >= 0)
        short, ids = np.full(len(names) + 1, -1, np.int64), names[kept]
        short[kept] = np.arange(len(kept))
        good = short[seq]
        both = np.flatnonzero((good[:-1] >= 0) & (good[1:] >= 0))
        if not len(both):
            return table(STATE, [])
        pairs, back, n = np.unique(good[both] * len(ids) + good[both + 1], return_inverse=True, return_counts=True)
        a, b = ids[pairs // len(ids)], ids[pairs % len(ids)]
        to = (mixed(a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((b, a, to))
        cut = np.searchsorted(to[order], np.arange(buckets + 1))
        a, b, n = a[order], b[order], n[order].astype(np.int64)
        me, rows = key[0].as_py(), []
        if not last:
            number = np.empty(len(order), np.int32)
            number[order] = np.arange(len(order))
            # pairs at neighbouring places stay neighbours, all others are kept apart
            gap = np.concatenate(([False], both[1:] != both[:-1] + 1))
            out = np.full(len(both) + int(gap.sum()), -1, np.int32)
            out[np.arange(len(both)) + np.cumsum(gap)] = number[back]
            rows.append({"chunk": me, "seq": packed(out), "size": len(pairs)})
        for i in np.flatnonzero(cut[1:] > cut[:-1]):
            x = slice(cut[i], cut[i + 1])
            rows.append({"chunk": me, "bucket": int(i), "first": int(cut[i]), "a": packed(a[x], True), "b": packed(b[x]), "counts": packed(n[x])})
        return table(STATE, rows)

    replies = answers.where("chunk is not null").select("chunk", "places", "names")
    return state.where("bucket is null").select("chunk", "seq", "size").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, STATE)


def levels(docs: DataFrame, least: int, longest: int, chunk: int) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases by number of words, and (lang, n)."""
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).head()[0] or 0
    buckets = max(partitions(docs.sparkSession), size // BUCKET)
    spark, found = docs.sparkSession, []
    with span() as made:
        state = stored(word_chunks(docs, buckets, chunk), "words")
    totals = stored(state.where("bucket is not null").groupBy("lang").agg(F.sum("total").alias("n")), "totals")
    for level in range(1, longest + 1):
        asked = state.where("bucket is not null")
        answers = stored(named_words(asked, least) if level == 1 else named_pairs(asked, level, least), f"names_{level}")
        found.append(answers.where("id is not null").select("id", "lang", "word", "a", "b", "f"))
        before, made = made, []
        if level < longest:
            with span() as made:
                state = stored(next_pairs(state, answers, buckets, level + 1 == longest), f"pairs_{level + 1}")
        # the numbers of the level below are not read again
        released(spark, before)
    return found, totals


def with_cuts(found: list[DataFrame]) -> list[DataFrame]:
    """Phrases of two words and more with their text and the counts of all first and last parts.

    heads[i] counts the first i + 1 words, tails[i] the last i + 1, taken from
    the two parents.
    """
    one = found[0].select("id", "lang", F.col("word").cast("string").alias("phrase"), "f", F.array().cast("array<bigint>").alias("heads"), F.array().cast("array<bigint>").alias("tails"))
    out, below = [], one
    for level, pairs in enumerate(found[1:], 2):
        left = below.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("first"), F.concat("heads", F.array("f")).alias("heads"))
        right = below.select(F.col("id").alias("b"), F.substring_index("phrase", " ", -1).alias("final"), F.concat("tails", F.array("f")).alias("tails"))
        both = pairs.select("id", "a", "b", "f").join(left, "a").join(right, "b")
        below = stored(both.select("id", "lang", F.concat_ws(" ", "first", "final").alias("phrase"), "f", "heads", "tails", "a", "b"), f"phrases_{level}")
        out.append(below)
    return out


def scored(phrases: DataFrame) -> DataFrame:
    """l, r and score of the lowest-scoring cut; equal scores go to the earliest."""
    kinds = "l bigint, r bigint, score bigint"

    def best(batches):
        for batch in batches:
            f, n, heads, tails = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "n", "heads", "tails"))
            rows = []
            for x, m, h, t in zip(f, n, heads, tails):
                cuts = [(1000 * x * m // (p * q), i, p, q) for i, (p, q) in enumerate(zip(h, reversed(t)))]
                s, _, p, q = min(cuts)
                rows.append((p, q, s))
            cols = [pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("lang", "phrase", "a", "n")]
            yield pa.RecordBatch.from_arrays([*keep, *cols], names=["lang", "phrase", "a", "n", "l", "r", "score"])

    return phrases.mapInArrow(best, "lang string, phrase string, a bigint, n bigint, " + kinds)


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` phrases of 2 to ``longest`` words."""
    found, totals = levels(docs, least, longest, chunk)
    phrases = with_cuts(found)
    open_ones = []
    for level, mine in enumerate(phrases):
        if level + 1 < len(phrases):
            # a longer candidate that holds it as often shows in one a word longer, whose parent it is
            longer = phrases[level + 1]
            inside = longer.select(F.col("a").alias("id"), "f").union(longer.select(F.col("b").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("most"))
            mine = mine.join(inside, "id", "left").where("most is null or most < f")
        open_ones.append(mine.select("lang", "phrase", F.col("f").alias("a"), "heads", "tails"))
    every = open_ones[0]
    for x in open_ones[1:]:
        every = every.union(x)
    rows = scored(every.join(totals, "lang"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: first the best of each part of it
    salt = F.pmod(F.xxhash64("phrase"), F.lit(max(2, partitions(docs.sparkSession))))
    some = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_pair_naming(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
