"""Best-fit packing of tokenized documents into sequences, improved by swaps.

Documents of one length are interchangeable, so the packing is planned on the
number of pieces of each length, at most ``size`` numbers however large the
corpus is, and bins are held as patterns (how many pieces of which lengths)
with a count of equal bins. Best fit, longest pieces first, makes the first
plan. Local search then takes pairs of underfull bins and moves a piece, swaps
one for one, or two for one, wherever that increases the sum of squared fills;
bins that get empty go. It ends at the lower bound, where no exchange gains, or
after ``steps`` exchanges; every plan holds all pieces.

Spark tokenizes, cuts, counts and places: each task numbers its pieces within
their length, running sums over (task, length) make the numbers global, and the
plan, cut into ranges of these numbers, says where each piece goes. Pieces never
meet in one task; only the counts by length reach the driver and only the plan
is broadcast, a few rows a length.

Tokens are those of the ``tokenizers`` library. Pieces of text between white
space are tokenized once and looked up afterwards, in a table of bounded size;
texts with a special token's string, or that change when lower-cased before
normalization, take the library's whole path.

Defined cases: a null or empty text is the end token alone; a text of any length
is tokenized whole, in parts that end at white space; repeated rows are pieces of
their own; an empty table gives no sequences. An input column named like a
result is superseded by it.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.ship import ship

from .arrow import fields, slices
from .store import stored

SIZE, END, STEPS = 4096, 1, 4000
#: the setting that names the folder of public vocabularies, and its default
FOLDER, DEFAULT_FOLDER, FILE = "spark.corvane.tokenizers", "/opt/tokenizers", "word_bpe_49k.json"
#: words kept with their tokens, and the bytes of these; text tokenized at once, in bytes
CACHE_WORDS, CACHE_BYTES, PART_BYTES = 1 << 20, 32 << 20, 1 << 20
#: ASCII and the letters of Latin-1, and fixed by the file: what its pattern makes of them in lower case
SIMPLE = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"
PLACE = "sequence_id bigint, offset bigint"


class Numbers(dict):
    """Words to numbers in order of first sight; ``new`` lists those not yet tokenized."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class WordTokens:
    """Tokens of whole texts by a ``tokenizers`` file, looked up word by word.

    Needs a tokenizer that drops white space and never joins words across it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.at = Numbers()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.count, self.bytes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def by_file(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def by_pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of SIMPLE words in a row, and each word's number of them.

        They go through the model as the pieces that the file's pattern makes of
        them; each piece's last token ends a word.
        """
        found = [PIECES.findall(w.lower()) for w in words]
        text = " ".join(x for f in found for x in f)
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids])
        n = np.array([len(f) for f in found])
        if len(ends) != n.sum():
            return self.by_file(words)
        return ids, np.diff(np.concatenate(([0], ends + 1))[np.concatenate(([0], np.cumsum(n)))])

    def learn(self, have: int) -> None:
        """Tokens of the new words; ``have`` words were known before."""
        words, self.at.new = self.at.new, []
        n = len(words)
        texts = [w.decode("utf-8", "replace") for w in words]
        simple = np.array([SIMPLE.fullmatch(t) is not None for t in texts], bool)
        ids, count = [], np.zeros(n, np.int64)
        first = np.zeros(n, np.int64)
        for chosen, f in ((simple, self.by_pieces), (~simple, self.by_file)):
            mine = [t for t, c in zip(texts, chosen) if c]
            if mine:
                got, count[chosen] = f(mine)
                first[chosen] = self.used + sum(map(len, ids)) + np.cumsum(count[chosen]) - count[chosen]
                ids.append(got)
        ids = np.concatenate(ids)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while have + n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.first[have : have + n], self.count[have : have + n] = first, count
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.bytes += sum(map(len, words))

    def plain(self, raw: bytes) -> bool:
        """Whether words can be looked up in lower case."""
        if any(s in raw for s in self.special):
            return False
        return raw.isascii() or all(unicodedata.is_normalized("NFC", x.decode("utf-8", "replace")) for x in (raw, raw.translate(LOWER)))

    def texts(self, raws: list[bytes]) -> list[np.ndarray]:
        """Tokens of each text; together they should be a few megabytes."""
        if len(self.at) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self.forget()
        known = len(self.at)
        plain = [self.plain(x) for x in raws]
        words = [x.translate(LOWER).split() if p else [] for x, p in zip(raws, plain)]
        i = np.fromiter(map(self.at.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        if self.at.new:
            self.learn(known)
        n = self.count[i]
        ends = np.cumsum(n)
        flat = self.flat[np.repeat(self.first[i] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.concatenate(([0], ends))[np.cumsum([len(w) for w in words])]
        out = np.split(flat, cut[:-1])
        return [x if p else self.by_file([raw.decode("utf-8", "replace")])[0] for x, p, raw in zip(out, plain, raws)]

    def text(self, raw: bytes | None) -> np.ndarray:
        if len(raw or b"") <= PART_BYTES:
            return self.texts([raw or b""])[0]
        return np.concatenate([self.texts([x])[0] for x in parts(raw, PART_BYTES)])

    def all(self, raws: list[bytes | None]) -> list[np.ndarray]:
        """As ``texts``; null is empty and long texts are taken in parts."""
        short = [raw or b"" if len(raw or b"") <= PART_BYTES else b"" for raw in raws]
        return [x if len(raw or b"") <= PART_BYTES else self.text(raw) for x, raw in zip(self.texts(short), raws)]


def parts(raw: bytes, most: int) -> Iterator[bytes]:
    """The text in parts of about ``most`` bytes, cut before a space or line end."""
    at = 0
    while at < len(raw):
        space, line = raw.find(b" ", at + most), raw.find(b"\n", at + most)
        cut = min((x for x in (space, line) if x >= 0), default=len(raw))
        yield raw[at:cut]
        at = cut


_models: dict[str, WordTokens] = {}


def model(path: str) -> WordTokens:
    """One table of words a worker."""
    if path not in _models:
        _models.clear()
        _models[path] = WordTokens(path)
    return _models[path]


def vocabulary_path(spark, file: str = FILE) -> str:
    return os.path.join(spark.conf.get(FOLDER, DEFAULT_FOLDER), file)


def pieces(docs: DataFrame, *, path: str | None = None, end: int = END, size: int = SIZE, keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """One row a piece of at most ``size`` tokens: ``keep``, piece, start, length, ids_crc32, with ``ids`` also the tokens.

    ``part`` and ``nth`` number a piece among those of its length in its task.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path(spark)
    ship(spark)
    extra = PIECE + (", ids array<int>" if ids else "") + ", part int, nth bigint"
    new = fields(extra)
    names = {f.name for f in new} | {f.name for f in fields(PLACE)}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = StructType([docs.schema[c] for c in keep] + new)

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        tokens, part, seen = model(path), TaskContext.get().partitionId(), Counter()
        kinds = [to_arrow_type(f.dataType) for f in new]
        for batch in batches:
            for rows, texts in slices(batch, batch.column(batch.schema.get_field_index("text"))):
                owner, out = [], []
                for i, got in enumerate(tokens.all(texts)):
                    got = np.append(got, np.uint32(end)).astype("<u4")
                    for j, a in enumerate(range(0, len(got), size)):
                        x = got[a : a + size]
                        owner.append(i)
                        out.append((j, a, len(x), zlib.crc32(x.tobytes()), *([x.astype(np.int32)] if ids else []), part, seen[len(x)]))
                        seen[len(x)] += 1
                cols = [rows.column(rows.schema.get_field_index(c)).take(pa.array(owner)) for c in keep]
                cols += [pa.array(list(x), k) for x, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    need = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*(f"`{c}`" for c in need)).mapInArrow(run, schema)


# --- the plan: patterns of lengths, each with its number of bins ------------------------

Pattern = tuple[tuple[int, int], ...]  #: (length, pieces), longest first


def best_fit(counts: dict[int, int], size: int) -> Counter:
    """Best fit decreasing: the same bins as piece by piece, in batches of equal pieces and bins."""
    room: dict[int, Counter] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            r = min((x for x in room if x >= length), default=None)
            if r is None:
                bins, was = Counter({(): -(-left // (size // length))}), size
            else:
                bins, was = room.pop(r), r
            each = was // length
            for pattern, n in bins.items():
                full = min(n, left // each)
                put = [(full, each)]
                left -= full * each
                if full < n and left:
                    put.append((1, left))
                    left = 0
                put.append((n - sum(x for x, _ in put), 0))
                for many, k in put:
                    if many:
                        to = room.setdefault(was - k * length, Counter())
                        to[(*pattern, (length, k)) if k else pattern] += many
    out: Counter = Counter()
    for bins in room.values():
        out.update(bins)
    out.pop((), None)
    return out


def fill(pattern: Pattern) -> int:
    return sum(a * k for a, k in pattern)


def changed(pattern: Pattern, less: tuple[int, ...], more: tuple[int, ...]) -> Pattern:
    n = Counter(dict(pattern))
    n.update(more)
    n.subtract(Counter(less))
    return tuple(sorted(((a, k) for a, k in n.items() if k), reverse=True))


def exchanges(low: Pattern, high: Pattern, room: int) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
    """(gain of the fuller bin, pieces it gets, pieces it gives): moves, one for one and two for one, that fit."""
    one = [a for a, _ in low]
    two = [(a, b) for i, (a, k) in enumerate(low) for b in [a] * (k > 1) + [x for x, _ in low[i + 1 :]]]
    back = [a for a, _ in high]
    for a in one:
        if a <= room:
            yield a, (a,), ()
        for b in back:
            if 0 < a - b <= room:
                yield a - b, (a,), (b,)
    for a, b in two:
        for c in back:
            if 0 < a + b - c <= room:
                yield a + b - c, (a, b), (c,)


def local_search(bins: Counter, size: int, steps: int = STEPS) -> Counter:
    """Exchange pieces between underfull bins while the sum of squared fills grows."""
    total = sum(fill(p) * n for p, n in bins.items())
    bound, stuck = -(-total // size), set()
    bins = Counter(bins)
    for _ in range(steps):
        if sum(bins.values()) <= bound:
            break
        under = sorted((p for p in bins if fill(p) < size), key=lambda p: (fill(p), p))
        low = next((p for p in under if p not in stuck), None)
        if low is None:
            break
        have, best = fill(low), None
        for high in under:
            f = fill(high)
            if f < have or (high == low and bins[low] < 2):
                continue
            for gain, gets, gives in exchanges(low, high, size - f):
                worth = (gain * (f - have) + gain * gain, gets, gives)
                if best is None or worth > best[0]:
                    best = (worth, high, gets, gives)
        if best is None:
            stuck.add(low)
            continue
        _, high, gets, gives = best
        many = bins[low] // 2 if high == low else min(bins[low], bins[high])
        for p, q in ((low, changed(low, gets, gives)), (high, changed(high, gives, gets))):
            bins[p] -= many
            if not bins[p]:
                del bins[p]
            if q:
                bins[q] += many
        stuck.clear()
    return bins


def plan(counts: dict[int, int], size: int = SIZE, steps: int = STEPS) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, first sequence, pieces a sequence, offset) of every range of equal places."""
    if any(not 0 < a <= size for a in counts):
        raise ValueError("a piece is longer than a sequence")
    bins = local_search(best_fit({a: n for a, n in counts.items() if n}, size), size, steps)
    out, sequence, used = [], 0, Counter()
    for pattern, n in sorted(bins.items(), reverse=True):
        at = 0
        for a, k in pattern:
            out.append((a, used[a], sequence, k, at))
            used[a] += n * k
            at += a * k
        sequence += n
    return sorted(out)


def place(df: DataFrame, ranges: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """sequence_id and offset of pieces numbered (``number``) within their length."""
    schema = StructType(df.drop("number").schema.fields + fields(PLACE))
    table = df.sparkSession.sparkContext.broadcast(np.array(ranges, np.int64).reshape(-1, 5))

    def run(batches):
        length, first, sequence, each, offset = table.value.T
        key = length << 44 | first
        for batch in batches:
            a, i = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(key, a << 44 | i, "right") - 1
            nth = i - first[at]
            cols = [batch.column(j) for j, c in enumerate(batch.schema.names) if c != "number"]
            cols += [pa.array(sequence[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * a)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(run, schema)


def pack(docs: DataFrame, *, size: int = SIZE, path: str | None = None, end: int = END, keep: list[str] | None = None, ids: bool = False, steps: int = STEPS) -> DataFrame:
    """The pieces of all documents with their sequence and the place in it."""
    cut = stored(pieces(docs, path=path, end=end, size=size, keep=keep, ids=ids), "pieces")
    tasks = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = tasks.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    numbered = cut.join(before, ["part", "length"]).withColumn("number", F.col("before") + F.col("nth")).drop("part", "nth", "before")
    return place(numbered.select(*[c for c in cut.columns if c not in ("part", "nth")], "number"), plan(counts, size, steps))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences; a group is one sequence, at most ``size`` tokens."""
    got = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return got.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))


def op12_swap_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
