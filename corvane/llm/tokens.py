"""Token counts of a unigram tokenizer, by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at
each character; dynamic programming keeps, for every end, the best score and
the number of pieces on the best way, and nothing else. Ties go to the way
found first when starts are tried from left to right, i.e. to the longer last
piece; scores are summed from left to right in double precision. A character
that no single piece covers costs the lowest score less 10 and counts as its
UTF-8 bytes, or as one unknown piece where the vocabulary has no byte pieces;
neighbouring unknown characters then form one piece. This is what the unigram model
of the ``tokenizers`` library does with byte fallback.

White space splits a text into words; each is prefixed with U+2581 and counted
alone, without any normalisation. Counts of words already seen are kept, up to
a fixed number of words of a bounded length. A vocabulary file of over 64 MB is
refused, as it is sent to every worker.

Vocabulary: the pieces of a public SentencePiece model, in its order. Where it
is a BPE model, whose scores are only ranks, piece r of n gets the logarithm of
Zipf's law, -ln(r + 1).

Defined cases: a null text and one without words have 0 tokens; a word of any
length is counted whole; repeated rows are counted each; an empty table gives an
empty result. An input column named like a count is superseded by it.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame

from .arrow import map_texts

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: words whose counts are kept, and their longest in bytes
CACHE_WORDS, CACHE_BYTES = 200_000, 64
REPORT = "n_chars bigint, n_words bigint, n_tokens bigint, n_fallback bigint"


def vocabulary(path: str = VOCABULARY) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) in the model's order, and whether all byte pieces are there."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i) for i in plain]
    scores = [model.get_score(i) for i in plain]
    ranks_only = all(s <= 0 and s == int(s) for s in scores)
    out = [(p, -math.log(r + 1) if ranks_only else s) for r, (p, s) in enumerate(zip(pieces, scores))]
    return out, all(f"<0x{b:02X}>" in set(pieces) for b in range(256))


class CountOnlyViterbi:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - 10.0
        self.byte_fallback = byte_fallback

    def count(self, word: str) -> tuple[int, int]:
        """Pieces of the best way, and those of them that stand for unknown characters."""
        n = len(word)
        if self.single.issuperset(word):
            # every end can be reached; at each, the automaton gives longer pieces first
            best, pieces = [0.0, *([-math.inf] * n)], [0] * (n + 1)
            for last, (length, score) in self.automaton.iter(word):
                at, end = last + 1 - length, last + 1
                if best[at] + score > best[end]:
                    best[end], pieces[end] = best[at] + score, pieces[at] + 1
            return pieces[n], 0
        best: list = [None] * (n + 1)
        best[0] = 0.0
        pieces, odd = [0] * (n + 1), [0] * (n + 1)
        open_unknown = [False] * (n + 1)
        ends: dict[int, list] = {}
        for last, (length, score) in self.automaton.iter(word):
            ends.setdefault(last + 1, []).append((length, score))
        for end in range(1, n + 1):
            for length, score in sorted(ends.get(end, ()), reverse=True):
                at = end - length
                total = best[at] + score
                if best[end] is None or total > best[end]:
                    best[end], pieces[end], odd[end], open_unknown[end] = total, pieces[at] + 1, odd[at], False
            char = word[end - 1]
            if char not in self.single:
                total = best[end - 1] + self.unknown
                if best[end] is None or total > best[end]:
                    cost = len(char.encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not open_unknown[end - 1])
                    best[end], pieces[end], odd[end], open_unknown[end] = total, pieces[end - 1] + cost, odd[end - 1] + cost, True
        return pieces[n], odd[n]


def count_tokens(docs: DataFrame, *, path: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    if os.path.getsize(path) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB is not broadcast")
    load = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make():
        model = CountOnlyViterbi(*load.value)
        known: dict[bytes, tuple[int, int]] = {}

        def work(texts):
            rows = []
            for text in texts:
                words = text.split() if text else []
                total = odd = 0
                for w in words:
                    got = known.get(w)
                    if got is None:
                        got = model.count(MARK + w.decode("utf-8", "replace"))
                        if len(w) <= CACHE_BYTES:
                            if len(known) >= CACHE_WORDS:
                                known.clear()
                            known[w] = got
                    total += got[0]
                    odd += got[1]
                rows.append((len(text.decode("utf-8", "replace")) if text else 0, len(words), total, odd))
            return [list(c) for c in zip(*rows)]

        return work

    return map_texts(docs, make, REPORT, keep=keep)


def op9_viterbi_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
