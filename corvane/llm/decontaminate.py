"""Benchmark passages in documents, by Wu-Manber search over words.

Test strings are the windows of ``window`` consecutive words of every item (an
item with fewer words is one window). For each window length there is a block
shift table: the distance the end of the window may move when the last two
words are not the end of any window. Where the shift is zero, the suffix block
selects a bucket, split by first word, and the words are compared with the
windows in it directly.

The windows are made and broadcast in chunks of about ``chunk_bytes`` of item
text, one at a time: each further chunk is one more pass over the documents,
and the last one's windows are dropped first, so driver and workers hold one
chunk however many items there are. A longer item is a chunk of its own.

Defined cases: a null or wordless text has no words and no hits; items without
words have no windows; an item id that is null counts as one item written as
an empty string; repeated item ids count once; empty tables give no hits.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from . import words
from .arrow import free_name, map_texts
from .store import stored

WINDOW = 13
CHUNK_BYTES = 4 << 20
REPORT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


class WuManber:
    """Occurrences of word sequences of one length."""

    def __init__(self, length: int, windows: dict[bytes, set]):
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.windows = windows
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, set[bytes]] = {}
        for joined in windows:
            w = joined.split()
            for end in range(self.block, length + 1):
                b = tuple(w[end - self.block : end])
                self.shift[b] = min(self.shift.get(b, self.far), length - end)
            self.buckets.setdefault(tuple(w[-self.block :]), set()).add(w[0])

    def scan(self, doc: list[bytes]):
        """(start, items) of every occurrence."""
        m, far, shift, n = self.length, self.far, self.shift.get, len(doc)
        end = m
        while end <= n:
            block = (doc[end - 2], doc[end - 1]) if self.block == 2 else (doc[end - 1],)
            step = shift(block, far)
            if step:
                end += step
                continue
            start = end - m
            if doc[start] in self.buckets[block]:
                items = self.windows.get(b" ".join(doc[start:end]))
                if items:
                    yield start, items
            end += 1


def windows_of(items: list[tuple], window: int) -> dict[int, dict[bytes, set]]:
    by_length: dict[int, dict[bytes, set]] = {}
    for item, text in items:
        doc = words.alnum(text.encode("utf-8", "surrogatepass") if text is not None else None)
        m = min(window, len(doc))
        name = "" if item is None else str(item)
        for i in range(len(doc) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(b" ".join(doc[i : i + m]), set()).add(name)
    return by_length


def chunks(benchmark: DataFrame, most: int):
    got, size = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        got.append((item, text))
        size += len((text or "").encode("utf-8", "surrogatepass"))
        if size >= most:
            yield got
            got, size = [], 0
    if got:
        yield got


def hits(engines: list[WuManber], doc: list[bytes], cover: bytearray, found: set) -> None:
    for e in engines:
        m, ones = e.length, b"\x01" * e.length
        for start, items in e.scan(doc):
            cover[start : start + m] = ones
            found |= items


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, keep=None, clean_only: bool = False) -> DataFrame:
    """``keep`` columns (default all) with the report; with ``clean_only``, only
    rows that are not contaminated, without the report."""
    spark = docs.sparkSession
    keep = list(docs.columns if keep is None else keep)
    cover, found = (free_name(docs, x) for x in ("cover", "found"))
    left = chunks(benchmark, chunk_bytes)
    df, first, chunk = docs, True, next(left, [])
    while True:
        following = next(left, None)
        load = spark.sparkContext.broadcast(windows_of(chunk, window))
        df = _one_pass(df, load, keep, first, following is None, clean_only, (cover, found))
        if following is None:
            return df
        df, first, chunk = stored(df, "windows_pass"), False, following
        load.destroy()


def _one_pass(df, load, keep, first, last, clean_only, state: tuple[str, str]):
    names = [n.split()[0] for n in REPORT.split(", ")]

    def make():
        engines = [WuManber(m, w) for m, w in sorted(load.value.items())]

        def one(text, cover, found):
            doc = words.alnum(text)
            cover = bytearray(cover or len(doc))
            found = set(found or ())
            hits(engines, doc, cover, found)
            return doc, cover, found

        def report(texts, *earlier):
            rows, stay = [], []
            for i, text in enumerate(texts):
                doc, cover, found = one(text, *(e[i] for e in earlier) if earlier else (None, None))
                n, hit = len(doc), sum(cover)
                bad = hit > 0 and 20 * hit >= n
                digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
                rows.append((n, hit, len(found), digest, bad))
                stay.append(not bad)
            cols = [list(c) for c in zip(*rows)] if rows else [[] for _ in names]
            return ([], stay) if clean_only else cols

        def carry(texts, *earlier):
            covers, all_found = [], []
            for i, text in enumerate(texts):
                _, cover, found = one(text, *(e[i] for e in earlier) if earlier else (None, None))
                covers.append(bytes(cover))
                all_found.append(sorted(found))
            return [covers, all_found]

        return report if last else carry

    extra = () if first else state
    if last:
        cols = [c for c in keep if clean_only or c not in names]
        return map_texts(df, make, "" if clean_only else REPORT, keep=cols, only=clean_only, extra=extra)
    cover, found = state
    return map_texts(df, make, f"`{cover}` binary, `{found}` array<string>", keep=list(dict.fromkeys([*keep, "text"])), extra=extra)


def op4_wu_manber(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return matches(docs, bench, keep=["doc_id"])
