"""Remove passages that repeat: Rabin-Karp windows counted in Spark.

A window is ``WIDTH`` consecutive words; it is repeated if its word sequence
starts anywhere else in the corpus. All words under repeated windows go.

Shuffling a hash for every word of the corpus would move more than the corpus.
Two exact reductions come first. (1) Every window is led by its minimiser, the
``GRAM``-word gram with the lowest hash in it; equal windows have equal leading
grams, so only windows whose leading gram occurs twice are candidates. The
grams that occur twice are broadcast as a bitmap of fixed size, which may let
through more windows and never fewer. (2) A window that occurs twice among the
texts a task works on at once is repeated, so one copy of it is sent as
evidence for others instead of all; a passage that a third of all documents
share costs a few rows a task.

Runs of windows are dealt by leading gram. A gram that leads windows of over
``hot`` classes would bring all of them to one task, so its windows are listed
before the shuffle and dealt by their own hash.

Windows are equal if leading gram and window have equal 64-bit hashes, made
from mixed 64-bit hashes of the words; the words are not compared. With p pairs
of different windows that share a leading gram, p / 2**64 false repeats are
expected: under one in ten thousand for a trillion windows with a thousand
others each.

Texts with the same words form a class; a class of two or more rows loses all
its words if it has a window at all. Results are joined back by the words'
SHA-256, so null and repeated ids need no care.

Defined cases: a null or wordless text has no words and keeps the empty string;
repeated rows are copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import fields, map_texts, slices
from .bits import bitmap, test
from .rolling import lowest, windows, word_hashes
from corvane.ship import ship
from .store import stored

WIDTH, GRAM = 35, 8
#: words of one text worked on at once; places must fit into 24 bits
LONG = 1 << 23
SEEN = 100_000
#: classes that a gram leads windows of before its windows are dealt one by one
HOT = 1000
EMPTY = hashlib.sha256(b"").hexdigest()
FIRST = "n_words bigint, words_sha binary, grams array<bigint>"
#: rows of two kinds: texts (words is set) and runs of windows with one leading gram
FOUND = "row bigint, words_sha binary, words binary, sure array<int>, gram bigint, first int, hashes array<bigint>, hot boolean"


def leads(h: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of word hashes: gram hashes, and for each window the place of its leading gram."""
    grams = windows(h, gram)
    packed = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
    low = lowest(packed, width - gram + 1)
    return grams, (low & np.uint64((1 << 24) - 1)).astype(np.int64)


def parts(n: int, width: int):
    """(first, end) word ranges of at most LONG windows that cover all windows of n words."""
    for a in range(0, n - width + 1, LONG):
        yield a, min(n, a + LONG + width - 1)


def each(texts: list[bytes | None]) -> list[np.ndarray]:
    """Word hashes of each text."""
    h, n = word_hashes(texts, lower=False)
    return np.split(h, np.cumsum(n)[:-1])


def first_pass(docs: DataFrame, width: int, gram: int) -> DataFrame:
    def make():
        def work(texts):
            rows = []
            for text, h in zip(texts, each(texts)):
                words = text.split() if text else []
                got = []
                if len(words) >= width:
                    for a, b in parts(len(h), width):
                        grams, place = leads(h[a:b], width, gram)
                        got.append(grams[np.unique(place)].view(np.int64))
                rows.append((len(words), hashlib.sha256(b" ".join(words)).digest(), np.concatenate(got) if got else None))
            return [list(c) for c in zip(*rows)]

        return work

    return map_texts(docs, make, FIRST, keep=["doc_id"])


def second_pass(docs: DataFrame, marks, hot_marks, width: int, gram: int) -> DataFrame:
    """Texts with candidate windows, numbered, and the runs of windows to be compared.

    A run is consecutive windows of one text with the same leading gram; runs
    without a row are evidence, one copy of windows repeated within a slice.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(docs.sparkSession)
    kind = StructType(fields(FOUND))

    def one_slice(texts, seen, row):
        """The texts with candidate windows, and all those windows."""
        out, windows_of = [], []
        for text, h in zip(texts, each(texts)):
            got = []
            for a, b in parts(len(h), width):
                grams, place = leads(h[a:b], width, gram)
                maybe = np.flatnonzero(test(marks.value, grams)[place])
                got.append((maybe + a, windows(h[a:b], width)[maybe], grams[place[maybe]], place[maybe] + a))
            if not any(len(x[0]) for x in got):
                continue
            at, hashes, lead, place = (np.concatenate(x) for x in zip(*got))
            joined = b" ".join(text.split())
            sha = hashlib.sha256(joined).digest()
            if sha in seen:
                continue
            if len(seen) < SEEN:
                seen.add(sha)
            out.append((row + len(out), sha, joined))
            windows_of.append((np.full(len(at), len(out) - 1), at, hashes, lead, place))
        return out, [np.concatenate(x) for x in zip(*windows_of)]

    def runs(keep, owner, at, hashes, lead, place):
        """Column arrays of the runs of the kept windows: first index of each, and lengths."""
        i = np.flatnonzero(keep)
        if not len(i):
            return i, i
        new = np.ones(len(i), bool)
        new[1:] = (owner[i][1:] != owner[i][:-1]) | (place[i][1:] != place[i][:-1]) | (at[i][1:] != at[i][:-1] + 1)
        return i, np.flatnonzero(new)

    def batch_of(schema, texts, win):
        owner, at, hashes, lead, place = win
        _, first, back, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        twice = times[back] > 1
        one = np.zeros(len(hashes), bool)
        one[first] = True
        sure = np.split(at[twice].astype(np.int32), np.searchsorted(owner[twice], np.arange(1, len(texts))))
        rows = pa.array([t[0] for t in texts], pa.int64())
        none = lambda n, f: pa.nulls(n, f.type)
        n = len(texts)
        cols = [rows, pa.array([t[1] for t in texts], pa.binary()), pa.array([t[2] for t in texts], pa.binary()), pa.array(sure, pa.list_(pa.int32())), *(none(n, f) for f in list(schema)[4:])]
        yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        for keep, asks in ((~twice, True), (twice & one, False)):
            i, start = runs(keep, *win)
            if not len(start):
                continue
            k = i[start]
            offsets = pa.array(np.append(start, len(i)).astype(np.int32))
            values = pa.ListArray.from_arrays(offsets, pa.array(hashes[i].view(np.int64)))
            mine = rows.take(pa.array(owner[k])) if asks else none(len(k), schema.field(0))
            hot = pa.array(test(hot_marks.value, lead[k]))
            cols = [mine, *(none(len(k), f) for f in list(schema)[1:4]), pa.array(lead[k].view(np.int64)), pa.array(at[k].astype(np.int32)), values, hot]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        schema, seen = to_arrow_schema(kind), set()
        for batch in batches:
            for _, texts in slices(batch, batch.column(0)):
                out, win = one_slice(texts, seen, row)
                row += len(out)
                if out:
                    for b in batch_of(schema, out, win):
                        yield b.cast(schema)

    return docs.select("text").mapInArrow(run, kind)


def cut(found: DataFrame, width: int) -> DataFrame:
    """(words, sure, more) -> what stays: the maximal intervals under repeated windows removed."""

    def make():
        def work(texts, sures, mores):
            rows = []
            for text, sure, more in zip(texts, sures, mores):
                words = text.split(b" ")
                starts = np.concatenate([np.array(sure or [], np.int64), np.array(more or [], np.int64)])
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + width, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone) if not g)
                rows.append((int(gone.sum()), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
            return [list(c) for c in zip(*rows)]

        return work

    return map_texts(found, make, "n_removed bigint, kept string, kept_sha256 string", text="words", keep=["words_sha"], extra=("sure", "more"))


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, kept_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with ``kept_text`` also the text's kept words
    where some were removed (null: all stay)."""
    first = stored(first_pass(docs, width, gram), "words")
    classes = first.where(F.col("n_words") >= width).groupBy("words_sha").agg(F.count("*").alias("n"), F.first("grams").alias("grams"), F.first("n_words").alias("n_words"))
    classes = stored(classes, "classes")
    twice = stored(classes.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    send = docs.sparkSession.sparkContext.broadcast
    marks, hot_marks = send(bitmap(twice, F.col("g"))), send(bitmap(twice.where(F.col("n") > hot), F.col("g")))
    found = stored(second_pass(docs, marks, hot_marks, width, gram), "windows")
    asked = found.where("gram is not null")
    listed = ["gram", "row", "first", F.posexplode("hashes").alias("i", "hash")]
    # the windows are only listed after the shuffle, but for those of hot grams
    cool = asked.where("not hot").select("gram", "row", "first", "hashes").repartition("gram").select(*listed)
    warm = asked.where("hot").select(*listed)
    cool = cool.withColumn("n", F.count("*").over(Window.partitionBy("gram", "hash"))).where("n > 1").drop("n")
    # a window may be on a third of all pages: its copies are counted where they are, and no task gets them all
    several = stored(warm.groupBy("gram", "hash").agg(F.count("*").alias("n")).where("n > 1").select("gram", "hash"), "hot_windows")
    again = cool.union(warm.where("row is not null").join(several, ["gram", "hash"], "left_semi").select(cool.columns)).where("row is not null")
    again = again.groupBy("row").agg(F.collect_list(F.col("first") + F.col("i")).alias("more"))
    copies = classes.where("n > 1").select("words_sha", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"), F.lit(EMPTY).alias("kept_sha256"))
    texts = found.where("words is not null").select("row", "words_sha", "words", "sure")
    some = texts.join(again, "row", "left").where("size(sure) > 0 or more is not null")
    wanted = ["words_sha", "n_removed", "kept_sha256", *(["kept"] if kept_text else [])]
    changed = stored(cut(some, width).select(wanted), "cut")
    changed = changed.join(copies.select("words_sha"), "words_sha", "left_anti").select(wanted).union(copies.select(wanted))
    out = first.select("doc_id", "n_words", "words_sha").join(changed, "words_sha", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", F.lower(F.hex("words_sha"))).alias("kept_sha256"), *(["kept"] if kept_text else []),
    )


def op7_rabin_karp(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
