"""Language identification with interpolated Kneser-Ney character models.

One model of character n-grams per language. Text is folded to lower-case
letters; any run of other characters is one space. The models are fitted on a
bounded sample of the labelled training rows (``per_language`` rows of at most
``most_bytes`` bytes a language, chosen by a hash of the row, and ``most_rows``
rows in all); a document belongs to the training rows if crc32 of its id modulo
4 is not 2. Every label is learned, from one row at least. The n-grams of all languages
lie in one sorted array of packed keys with one row of log probabilities, as
many as fit a table of fixed size; the others are scored through the sorted
arrays of each language. The language with the lowest cross-entropy per
character wins; ties go to the first by name.

Rejection is calibrated on sample rows that were not used to fit (those with
remainder 3, unless a language has no others). A language's ``limit`` lies
halfway between what its own texts reach, three deviations above their mean,
and the lowest mean that texts of another language have under its model, plus
five standard errors for the text's length. A document whose lowest
cross-entropy is above it, or that is ``und``, is rejected. The score is the posterior probability over at
most ``nats_over`` characters, times a logistic function of the distance to the
limit.

Defined cases: a null text or one without letters is ``und`` with score 0, and
so is every text if no row is labelled; a null id is neither held out nor
learned from; texts of over a million characters are scored in slices of a
million, each with the context of the one before; repeated rows get the same
answer; an empty table gives an empty result. An input column named like a
result is superseded by it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_texts

ORDER, BITS = 4, 15
PER_LANGUAGE, MOST_BYTES, MOST_ROWS = 400, 20_000, 4000
#: log probabilities kept ready, of all n-grams and languages together
CELLS = 1 << 24
SLICE = 1_000_000
#: characters worked on at once, over all texts
TOGETHER = 200_000
#: nats between a language's own texts and the limit where no other language is learned
ALONE = 1.2
REPORT = "lang_pred string, score double"


def fold_table(alphabet: dict[str, int]) -> np.ndarray:
    """Code point to id: 0 for all but letters, 1 for letters outside the alphabet."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = alphabet.get(low if len(low) == 1 else x, 1)
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def folded(texts: list[str], table: np.ndarray, heads: list[np.ndarray | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each after its head of ORDER - 1 ids (zeros if None), with the text's number (-1: the head)."""
    pad = ORDER - 1
    ids = [np.zeros(0, np.int64)]
    owner = [np.zeros(0, np.int64)]
    for i, t in enumerate(texts):
        p = table[code_points(t)]
        head = heads[i] if heads is not None else None
        ids += [np.zeros(pad, np.int64) if head is None else head, p]
        owner += [np.full(pad, -1), np.full(len(p), i)]
    ids, own = np.concatenate(ids), np.concatenate(owner)
    stay = (ids != 0) | (own < 0)
    stay[1:] |= (ids[1:] == 0) & (ids[:-1] != 0)
    return ids[stay], own[stay]


def keys_of(ids: np.ndarray) -> np.ndarray:
    """Packed ORDER-grams ending at each place from ORDER - 1 on."""
    n = max(0, len(ids) - ORDER + 1)
    key = np.zeros(n, np.int64)
    for k in range(ORDER):
        key = (key << BITS) | ids[k : k + n]
    return key


class KneserNey:
    """Sorted key arrays of one language, order 1 to ORDER."""

    def __init__(self, keys: np.ndarray, letters: int):
        self.letters = letters
        self.orders = []
        grams, counts = np.unique(keys, return_counts=True)
        for n in range(ORDER, 0, -1):
            ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.75
            context, first = np.unique(grams >> BITS, return_index=True)
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
            types = np.diff(np.append(first, len(grams)))
            self.orders.append((grams, counts, discount, context, total, types))
            # the next order counts the different characters seen before each shorter gram
            grams, counts = np.unique(grams & ((1 << (BITS * (n - 1))) - 1), return_counts=True)

    def probability(self, keys: np.ndarray, n: int = ORDER) -> np.ndarray:
        if n == 0:
            return np.full(len(keys), 1.0 / self.letters)
        lower = self.probability(keys & ((1 << (BITS * (n - 1))) - 1), n - 1)
        grams, counts, discount, context, total, types = self.orders[ORDER - n]
        if not len(grams):
            return lower
        c = find(context, keys >> BITS)
        g = find(grams, keys)
        known = c >= 0
        whole = np.where(known, total[c], 1)
        count = np.where(g >= 0, counts[g], 0)
        p = np.maximum(count - discount, 0) / whole + discount * types[c] / whole * lower
        return np.where(known, p, lower)


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Model:
    """Models of all languages; fit() sees (language, text) rows of the sample."""

    def __init__(self, rows: list[tuple[str, str]], calibration: list[tuple[str, str]], nats_over: int = 60, cells: int = CELLS):
        self.nats_over = nats_over
        self.languages = sorted({lang for lang, _ in rows})
        letters = sorted({c for _, t in rows for c in t.lower() if c.isalpha()})[: (1 << BITS) - 2]
        self.alphabet = {c: i + 2 for i, c in enumerate(letters)}
        table, self._table = fold_table(self.alphabet), None
        self.models = []
        for lang in self.languages:
            ids, own = folded([t for x, t in rows if x == lang], table)
            self.models.append(KneserNey(keys_of(ids)[own[ORDER - 1 :] >= 0], len(letters) + 2))
        if not self.languages:
            return
        self.grams, seen = np.unique(np.concatenate([m.orders[0][0] for m in self.models]), return_counts=True)
        most = max(1, cells // len(self.models))
        if len(self.grams) > most:  # those of most languages are asked for most
            self.grams = np.sort(self.grams[np.argsort(-seen, kind="stable")[:most]])
        self.logs = np.stack([np.log(m.probability(self.grams)) for m in self.models], axis=1)
        self._calibrate([(x, t) for x, t in calibration if x in self.languages] or rows, table)

    def _calibrate(self, rows: list[tuple[str, str]], table: np.ndarray) -> None:
        own = np.array([self.languages.index(x) for x, _ in rows])
        sums, n, squares = self.entropy([t for _, t in rows], table)
        mine, square = sums[np.arange(len(rows)), own], squares[np.arange(len(rows)), own]
        level, self.spread = [], []
        rates = sums / np.maximum(n, 1)[:, None]
        for k in range(len(self.languages)):
            at = (own == k) & (n > 0)
            at = at if at.any() else n > 0
            total = max(1, n[at].sum())
            mean = mine[at].sum() / total
            level.append(float(mean + 3 * np.std(rates[at, own[at]])))
            self.spread.append(float(math.sqrt(max(1e-6, square[at].sum() / total - mean * mean))))
        self.limit = []
        for k in range(len(self.languages)):
            foreign = [sums[at, k].sum() / n[at].sum() for x in range(len(self.languages)) if x != k and n[at := own == x].sum()]
            self.limit.append(level[k] + (max(0.0, min(foreign) - level[k]) / 2 if foreign else ALONE))

    def log_rows(self, keys: np.ndarray) -> np.ndarray:
        at = find(self.grams, keys)
        out = self.logs[at]
        if (at < 0).any():
            odd, back = np.unique(keys[at < 0], return_inverse=True)
            out[at < 0] = np.stack([np.log(m.probability(odd)) for m in self.models], axis=1)[back]
        return out

    def entropy(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums over characters of -log p and of its square, per text and language; characters scored."""
        k = len(self.languages)
        sums, squares, n = np.zeros((len(texts), k)), np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        pending, size = [], 0
        for i, t in enumerate(texts):
            head = None
            for a in range(0, len(t), SLICE):
                part = t[a : a + SLICE]
                pending.append((i, part, head))
                size += len(part)
                if a + SLICE < len(t):
                    head = folded([part], table, [head])[0][1 - ORDER :]
                if size >= TOGETHER:
                    self._add(pending, table, sums, squares, n)
                    pending, size = [], 0
        if pending:
            self._add(pending, table, sums, squares, n)
        return sums, n, squares

    def _add(self, pending, table, sums, squares, n) -> None:
        ids, own = folded([t for _, t, _ in pending], table, [h for _, _, h in pending])
        at = own[ORDER - 1 :]
        scored = at >= 0
        logs = -self.log_rows(keys_of(ids)[scored])
        to = np.array([i for i, _, _ in pending])[at[scored]]
        letters = np.bincount(to, weights=ids[ORDER - 1 :][scored] != 0, minlength=len(n))
        count = np.bincount(to, minlength=len(n))
        n += np.where(letters > 0, count, 0)
        for k in range(logs.shape[1]):
            sums[:, k] += np.bincount(to, weights=logs[:, k], minlength=len(n))
            squares[:, k] += np.bincount(to, weights=logs[:, k] ** 2, minlength=len(n))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Languages, scores, and which texts are not rejected."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        if self._table is None:
            self._table = fold_table(self.alphabet)
        sums, n, _ = self.entropy([t or "" for t in texts], self._table)
        rate = sums / np.maximum(n, 1)[:, None]
        best = rate.argmin(axis=1)
        seen = np.minimum(n, self.nats_over)[:, None]
        posterior = 1 / np.exp(-seen * (rate - rate.min(axis=1)[:, None])).sum(axis=1)
        limit = np.array(self.limit)[best] + 5 * np.array(self.spread)[best] / np.sqrt(np.maximum(n, 1))
        over = rate[np.arange(len(n)), best] - limit
        sure = 1 / (1 + np.exp(np.clip(4 * over, -50, 50)))
        ok = n > 0
        score = np.where(ok, np.clip(posterior * sure, 0, 1), 0.0)
        return [self.languages[b] if o else "und" for b, o in zip(best, ok)], score.tolist(), (ok & (over <= 0)).tolist()


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4


def sample(docs: DataFrame, per_language: int, most_bytes: int, most_rows: int = MOST_ROWS) -> list:
    """At most ``per_language`` rows (lang, text, fold) of each language, by a hash of the row, and ``most_rows``
    in all, but one of each language at least: every label is learned.

    Rows of at most ``most_bytes`` come first. Where a language has too few of
    them, longer rows fill up, by their first ``most_bytes`` / 4 characters.
    """
    rows = docs.where(F.col("lang").isNotNull() & (fold_of(F.col("doc_id")) != 2) & (F.octet_length("text") >= 1))
    rows = rows.select("lang", "text", fold_of(F.col("doc_id")).alias("fold"), "doc_id", (F.octet_length("text") > most_bytes).alias("__long"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("__long").alias("long")).collect()  # one row a label
    if not counts:
        return []
    per_language = max(1, min(per_language, most_rows // len(counts)))

    # twice as many as asked for are expected below this share; the window then sees bounded groups
    def share(n: int) -> float:
        return min(1.0, (2 * per_language + 50) / max(n, 1))

    shares = [(lang, share(n - long), share(long) if n - long < per_language else 0.0) for lang, n, long in counts]
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, __short_share double, __long_share double")), "lang")
    u = F.pmod(F.xxhash64(F.lit(11), "doc_id", F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.withColumn("__u", u).where(F.col("__u") < F.when(F.col("__long"), F.col("__long_share")).otherwise(F.col("__short_share")))
    picked = picked.withColumn("text", F.when(F.col("__long"), F.left("text", F.lit(max(1, most_bytes // 4)))).otherwise(F.col("text")))
    first = Window.partitionBy("lang").orderBy("__long", "__u", "doc_id", "text")
    return picked.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= per_language).select("lang", "text", "fold").collect()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_bytes: int = MOST_BYTES, most_rows: int = MOST_ROWS) -> Model:
    rows = sample(docs, per_language, most_bytes, most_rows)
    others = {lang for lang, _, fold in rows if fold != 3}
    return Model([(lang, t) for lang, t, fold in rows if fold != 3 or lang not in others], [(lang, t) for lang, t, fold in rows if fold == 3])


def identify(docs: DataFrame, model: Model, *, keep: list[str] | None = None, accepted_only: bool = False) -> DataFrame:
    """``keep`` columns (default all) with lang_pred and score, or only the rows that are accepted."""
    load = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = load.value

        def work(texts):
            langs, scores, accepted = m.predict([None if t is None else t.decode("utf-8", "replace") for t in texts])
            return ([], accepted) if accepted_only else [langs, scores]

        return work

    return map_texts(docs, make, "" if accepted_only else REPORT, keep=keep, only=accepted_only)


def op5_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit(docs), keep=["doc_id"])
    return out.withColumn("held_out", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)))
