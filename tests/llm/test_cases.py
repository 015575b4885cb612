"""Odd cases: small limits, ties, empty tables, clashing names, long texts, hot keys, and plain versions of models."""

from __future__ import annotations

import collections
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import alnum_words, component_rows, counter, documents, texts  # noqa: F401

from corvane.llm import components, decontaminate, frequency, language, licenses, mixing, sharding, shingles, store, substrings, tokens, vectors, warc

CLASHES = ["digest", "maybe", "tag", "__digest", "__maybe", "__tag", "key", "n", "times", "i", "copy", "cover", "found", "__t0", "__d", "__copy", "component", "id"]


def with_clashes(df):
    return df.withColumns({c: F.lit(c) for c in CLASHES})


# --- sharding


def test_shards_of_ties_and_many_values(spark):
    same = spark.range(100).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("lang"), (F.col("id") * 7).cast("string").alias("source"))
    for df in (same, many, with_clashes(many)):
        rows = sharding.shard(df).collect()
        per = collections.defaultdict(list)
        for r in rows:
            per[r["shard"]].append(r["slot"])
        assert len(rows) == df.count() and max(map(len, per.values())) - min(map(len, per.values())) <= 1
        assert all(sorted(x) == list(range(len(x))) for x in per.values())


# --- shingles


def test_small_limits_change_nothing(spark, texts):  # noqa: F811
    r = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    near = []
    for k in range(40):  # a crowd of near copies, most of them linked through a few
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3])):
            w[r.randrange(len(w))] = f"n{k}_{r.randrange(9)}"
        near.append(" ".join(w))
    df = documents(spark, [*texts, *near])
    want = counter(shingles.join_classes(df), "doc_id", "n_shingles", "component_id")
    got = shingles.join_classes(df, chunk=256, block=4, busy=1, pivots=1)
    assert counter(got, "doc_id", "n_shingles", "component_id") == want
    rows = [tuple(x) for x in df.select("doc_id", "text").collect()]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    ids = component_rows([i for i, _ in rows], links)
    assert want == collections.Counter((rows[k][0], len(sets[k]), ids[k] if sets[k] else rows[k][0]) for k in range(len(rows)))


def test_groups_of_equal_prefix_and_size(spark):
    # sets of rows that share their rarest shingles and differ only in common ones
    r = random.Random(4)
    common = [f"c{i} " * 5 for i in range(40)]
    docs = []
    for g in range(3):
        rare = " ".join(f"g{g}r{i}" for i in range(30))
        for _ in range(4):
            docs.append(rare + " " + " ".join(r.sample(common, 20)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs * 2)], "doc_id bigint, text string").repartition(3)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in docs)]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    ids = component_rows(list(range(len(docs))), links)
    for limits in ({}, {"chunk": 50, "block": 2, "busy": 1, "pivots": 1}):
        got = {x["doc_id"]: x["component_id"] for x in shingles.join_classes(df, **limits).collect()}
        assert got == {i + k * len(docs): ids[i] for i in range(len(docs)) for k in (0, 1)}


def plain_links(groups, linked):
    def fits(a, b):
        return F.lit(True)

    def verify(pairs):
        return pairs.join(linked, ["a", "b"], "left_semi")

    return fits, verify


@pytest.mark.parametrize("busy", [1, 100])
def test_group_members_are_expanded(spark, busy):
    # groups under one key; links only between some members of different groups
    lead = {i: i - i % 4 for i in range(40)}
    links = {(b, a) for a, b in [(1, 6), (6, 11), (3, 17), (21, 22), (30, 38)]}
    linked = spark.createDataFrame(sorted(links), "a bigint, b bigint")
    posted = store.stored(spark.createDataFrame([(k, i) for i in lead if lead[i] == i for k in (1, 2)], "key bigint, id bigint"), "posted")
    grouped = store.stored(spark.createDataFrame([(i, x) for i, x in lead.items() if i != x], "id bigint, lead bigint"), "grouped")
    fits, verify = plain_links(lead, linked)

    def screen(rows):
        rows = rows.distinct()
        a = rows.where("component <> main").select("main", F.col("id").alias("a"), F.col("component").alias("c"))
        b = rows.select("main", F.col("id").alias("b"), F.col("component").alias("d"))
        pairs = a.join(b, "main").where("c <> d")
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    got = components.linked_groups(posted, grouped, fits, verify, [], screen, busy=busy)
    assert {(r["id"], r["component"]) for r in got.collect()} == {(1, 1), (6, 1), (11, 1), (3, 3), (17, 3), (21, 21), (22, 21), (30, 30), (38, 30)}


def test_components_of_chains_and_cycles(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 7) % 20) for i in range(20)] + [(200, 201), (201, 200), (300, 300)]
    r.shuffle(edges)
    got = {x["id"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 120), 100), 200: 200, 201: 200}


def test_repeated_hashes_are_counted_by_owner(spark):
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = {2 * i + 2: np.unique(np.concatenate([r.choice(pool, 12), pool[:2]])) for i in range(60)}
    chunks = [list(sets.items())[a : a + 7] for a in range(0, 60, 7)] + [list(sets.items())[:3]]  # three owners twice
    batches = [frequency.sent([s for _, s in c], [o for o, _ in c], 5) for c in chunks]
    import pandas as pd

    rows = spark.createDataFrame(pd.concat([b.to_pandas() for b in batches]), frequency.SENT)
    got = {x["owner"]: x["c"] for x in frequency.repeated(rows, 5).collect()}
    held = collections.Counter(h & ((1 << 48) - 1) for s in sets.values() for h in s.tolist())
    for o, s in sets.items():
        want = sum(held[h & ((1 << 48) - 1)] > 1 for h in s.tolist())
        assert got.get(o, 0) >= want and (o <= 6 or got.get(o, 0) == want)


def test_levels_are_exact(spark):
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.choice(pool, 9), pool[:1], r.integers(0, 1 << 63, 3, dtype=np.uint64)])) for _ in range(50)]
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id bigint, members binary").repartition(3)
    held = collections.Counter(h for s in sets for h in s.tolist())

    def work(ids, parts, levels):
        import pyarrow as pa

        return pa.table({"id": pa.array(np.repeat(ids, [len(p) for p in parts])), "h": np.concatenate(parts).view(np.int64), "level": np.concatenate(levels).astype(np.int32)})

    got = frequency.with_levels(df, sum(map(len, sets)), work, "id bigint, h bigint, level int", chunk=40).collect()
    assert len(got) == sum(map(len, sets))
    for x in got:
        n = held[x["h"] % (1 << 64)]
        assert x["level"] == (0 if n == 1 else min(255, math.floor(math.log2(n) * 8)))


def test_parts_that_similar_sets_share():
    r = random.Random(8)
    for _ in range(300):
        n = r.randint(1, 80)
        x = set(r.sample(range(10_000), n))
        y = set(r.sample(sorted(x), r.randint(max(1, n * 3 // 4), n))) | set(r.sample(range(10_000, 20_000), r.randint(0, n // 4)))
        if 100 * len(x & y) < 75 * len(x | y):
            continue
        order = {v: r.random() for v in x | y}
        for size, s, t in ((len(x), x, y), (len(y), y, x)):
            a, b = (set(sorted(v, key=order.get)[: shingles.leading(len(v), 75)]) for v in (s, t))
            assert len(a & b) >= shingles.needed(size, 75)
            a, b = (set(sorted(v, key=order.get)[: shingles.prefix_length(len(v), 75)]) for v in (s, t))
            assert a & b


def test_one_of_each_keeps_columns(spark, texts):  # noqa: F811
    df = with_clashes(documents(spark, texts))
    kept = shingles.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == shingles.one_of_each(documents(spark, texts)).count()
    assert all(r[c] == c for r in kept.collect() for c in CLASHES)
    assert shingles.one_of_each(df.limit(0)).count() == 0
    empty = df.withColumn("text", F.lit(None).cast("string"))
    assert shingles.one_of_each(empty).count() == empty.count()


# --- vectors


def planted_vectors(n, dim, clusters, seed):
    """Vectors around few directions, and for every tenth a partner at a cosine just above or below the threshold."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    x = centres[rng.integers(0, clusters, n)] * 1.6 + rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = rng.standard_normal((n // 10, dim))
    base = x[:: 10][: n // 10]
    noise -= (noise * base).sum(axis=1)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    cos = rng.uniform(0.94, 0.965, n // 10)[:, None]
    return np.concatenate([x, cos * base + np.sqrt(1 - cos**2) * noise])


@pytest.mark.parametrize("clusters, limits", [(2000, {}), (3, {"block": 64, "busy": 4, "pivots": 2})])
def test_vector_recall(spark, clusters, limits):
    x = planted_vectors(2000, 48, clusters, 7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df, **limits).collect()}
    ids = component_rows(list(range(len(x))), [(a, b) for a, b in np.argwhere(near) if a > b])
    want = {i: (int(near[i].sum()), ids[i]) for i in range(len(x))}
    assert near.sum() > 200 and all(got[i][0] <= want[i][0] for i in got)
    assert sum(got[i][0] for i in got) >= 0.99 * near.sum()
    assert sum(got[i] == want[i] for i in got) >= 0.99 * len(x)


def test_dense_component_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = np.ones(16) + rng.standard_normal((400, 16)) * 0.16
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df, block=16).collect()}
    assert near.sum() > 20_000 and abs(sum(got.values()) - near.sum()) <= 0.001 * near.sum()


def test_very_long_vectors(spark):
    v = [float(i % 7) for i in range(3000)]
    df = spark.createDataFrame([(1, v), (2, [x * 2 for x in v]), (3, [1.0] * 3000)], "vec_id bigint, embedding array<double>")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


# --- decontamination


def test_contamination_in_passes_and_slices(spark):
    item = [" ".join(f"i{k}w{j}" for j in range(30)) for k in range(20)]
    long = " ".join(f"x{i % 97}" for i in range(700_000)) + " " + item[3] + " tail"  # longer than a slice
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(item)] * 2, "item_id bigint, text string")
    docs = with_clashes(spark.createDataFrame([(1, long), (2, item[19]), (3, "a " + item[0][:60]), (4, None), (2, item[19])], "doc_id bigint, text string"))
    for chunk in (1 << 20, 100):
        got = decontaminate.matches(docs, bench, chunk_bytes=chunk).collect()
        assert sorted((r["doc_id"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got) == [(1, 30, 1, False), (2, 30, 1, True), (2, 30, 1, True), (3, 0, 0, False), (4, 0, 0, False)]
        assert all(r[c] == c for r in got for c in CLASHES)


# --- language


def naive_kneser_ney(texts_of, alphabet, order):
    """p(symbol | context) of interpolated Kneser-Ney, by dictionaries."""
    rows = []
    for t in texts_of:
        symbols = [0] * (order - 1)
        for c in t:
            s = alphabet.get(c.lower(), 1) if c.isalpha() else 0
            if s or symbols[-1] or len(symbols) == 0:
                symbols.append(s)
        rows.append(symbols)
    counts = [collections.Counter(tuple(s[i : i + order]) for s in rows for i in range(len(s) - order + 1))]
    for _ in range(order - 1):
        counts.append(collections.Counter(g[1:] for g in counts[-1]))
    letters = len(alphabet) + 2

    def p(gram):
        if not gram:
            return 1 / letters
        c = counts[order - len(gram)]
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = once / (once + 2 * twice) if once and twice else 0.75
        after = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        return max(c[gram] - d, 0) / sum(after) + d * len(after) / sum(after) * p(gram[1:])

    return p, rows


def test_models_equal_naive_ones():
    data = [("en", "The cat sat on the mat, the cat ran."), ("en", "a dog and a cat"), ("de", "die Katze saß auf der Matte"), ("de", "der Hund läuft")]
    m = language.Model(data, data)
    probe = ["the hund ran 99 away", "Matte", "日本 cat", "x", ""]
    table = language.fold_table(m.alphabet)
    sums, n, _ = m.entropy(probe, table)
    for k, lang in enumerate(m.languages):
        p, _ = naive_kneser_ney([t for x, t in data if x == lang], m.alphabet, language.ORDER)
        for i, t in enumerate(probe):
            _, rows = naive_kneser_ney([t], m.alphabet, language.ORDER)
            s = rows[0]
            want = -sum(math.log(p(tuple(s[j - language.ORDER + 1 : j + 1]))) for j in range(language.ORDER - 1, len(s)))
            assert math.isclose(sums[i, k], want, rel_tol=1e-9, abs_tol=1e-9) and n[i] == max(0, len(s) - language.ORDER + 1)
    # a small table of ready values changes nothing
    small = language.Model(data, data, cells=10)
    assert np.allclose(small.entropy(probe, table)[0], sums)


def test_slices_keep_their_context(monkeypatch):
    data = [("en", "the cat sat on the mat " * 3), ("fr", "le chat est sur la table " * 3)]
    m = language.Model(data, data)
    table = language.fold_table(m.alphabet)
    text = "the cat -- 12 sat, on le chat   the mat " * 5
    whole = m.entropy([text], table)
    monkeypatch.setattr(language, "SLICE", 7)
    cut = m.entropy([text], table)
    assert np.allclose(whole[0], cut[0]) and whole[1].tolist() == cut[1].tolist()


def test_rejection(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = language.fit(docs)
    r = random.Random(6)
    odd = ["".join(r.choice("bcdfghjklmnpqrstvwxz ") for _ in range(300)), "Съешь ещё этих мягких французских булок да выпей чаю " * 4, "これは日本語の文章です" * 9, "qzx jkv wqp " * 30]
    assert m.predict(odd)[2] == [False] * len(odd)
    # the share of held-out rows that are rejected
    rows = docs.where(language.fold_of(F.col("doc_id")) == 2).select("text").collect()
    accepted = m.predict([x["text"] for x in rows])[2]
    assert sum(accepted) >= 0.98 * len(rows)


def test_many_languages_and_one_of_the_last_fold(spark):
    import zlib

    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} word{chr(97 + i % 7)} " * 3, f"l{i % 30:03d}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    every = docs.withColumn("lang", F.concat(F.lit("x"), F.col("doc_id") % 550))
    assert len(language.fit(every, most_rows=40).languages) == len({i % 550 for i in range(600) if zlib.crc32(str(i).encode()) % 4 != 2})
    assert len(language.fit(docs, most_rows=10).languages) == 30
    last = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 == 3][:40]
    rows = [(i, "kuu päivä yö talvi " * 4, "fi") for i in last] + [(i, "the cat sat on the mat " * 3, "en") for i in range(5000, 5060)]
    m = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert m.languages == ["en", "fi"] and m.predict(["talvi yö kuu"])[0] == ["fi"]


def test_language_of_ties_repeats_and_nothing(spark):
    same = [("a", "one two three"), ("b", "one two three")]
    m = language.Model(same, same)
    langs, scores, _ = m.predict(["one two", "one two", None])
    assert langs == ["a", "a", "und"] and scores[0] == scores[1] <= 0.5 and scores[2] == 0
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string, score string")
    assert language.identify(df, language.fit(df)).count() == 0
    assert language.identify(df, m).columns == ["doc_id", "text", "lang", "lang_pred", "score"]


# --- mixing


def test_mix_of_one_large_row_and_ties(spark):
    rows = [(1, "w " * 1000, "a")] + [(i, "x y", "b") for i in range(2, 12)] + [(20, "x y", None)] * 4
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sum(r["taken"] for r in got) <= 1028 and all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in got)
    clash = with_clashes(df)
    out = mixing.mixed(clash)
    assert out.columns == clash.columns and sum(len(r["text"].split()) for r in out.collect()) == sum(r["taken"] for r in got)
    assert mixing.mixed(clash.limit(0)).count() == 0


# --- repeated passages


def test_hot_grams_change_nothing(spark, texts):  # noqa: F811
    df = documents(spark, [*texts, "same " * 80, " ".join(texts[13].split() * 4)] * 2)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert counter(substrings.remove_repeats(df, hot=0), *columns) == counter(substrings.remove_repeats(df), *columns)


def test_parts_cover_all_windows(monkeypatch):
    monkeypatch.setattr(substrings, "LONG", 10)
    for n in (0, 4, 5, 14, 15, 40):
        got = [a + i for a, b in substrings.parts(n, 5) for i in range(b - a - 4)]
        assert got == list(range(max(0, n - 4)))


# --- licenses


def test_base_phrases_by_plain_scan():
    r = random.Random(3)
    words = "cc by general public license all rights reserved the cc0 bye CC BY".split()
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for _ in range(400):
        text = "".join(r.choice(words) + r.choice([" ", "-", ", ", "\n"]) for _ in range(r.randrange(40)))
        w = alnum_words(text)
        places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        n, base, first, last, labels, more, score = licenses.scan(text.encode())
        starts = [i for i, _ in places]
        assert (n, base, first, last) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert labels == ",".join(sorted({x for _, x in places})) and set(filter(None, labels.split(","))) <= set(more.split(",")) and 0 <= score <= 1


def test_suppression_by_brute_force(monkeypatch):
    r = random.Random(1)
    for _ in range(200):
        rules = [(f"l{k}", ("",), ("",), r.randrange(3), 0.5, re.compile("".join(r.choice("ab") for _ in range(r.randint(1, 4))))) for k in range(6)]
        monkeypatch.setattr(licenses, "rules", lambda rules=rules: rules)
        text = "".join(r.choice("ab") for _ in range(30))
        found = sorted((-p, m.start() - m.end(), m.start(), m.end(), label) for label, _, _, p, _, x in rules for m in x.finditer(text))
        taken = []
        for _, _, a, b, label in found:
            if not any(x <= a and b <= y for x, y, _ in taken):
                taken.append((a, b, label))
        assert [x[:3] for x in licenses.detections(text.encode())] == taken


def test_long_notices_take_linear_time():
    notice = b"Redistribution and use in source and binary forms, with or without modification, under the Apache License 2.0. All rights reserved. Licensed under the MIT license. "

    def seconds(n):
        t = time.process_time()
        assert licenses.scan(notice * n)[1] == n
        return time.process_time() - t

    seconds(10)
    assert seconds(4000) <= 30 * max(0.02, seconds(400))


@pytest.mark.parametrize("text, label", [
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"), ("either version 2 of the License, or (at your option) any later version.", "gpl-2.0-or-later"),
    ("As a special exception, the copyright holders of this library give you permission to link", "gpl-classpath-exception"), ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"), ("No part of this book may be reproduced", "proprietary"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("Alle Rechte vorbehalten.", "reserved"),
])
def test_statements(text, label):
    assert label in licenses.scan(text.encode())[5].split(",")


# --- tokens


def test_tokens_of_odd_tables(spark):
    m = tokens.CountOnlyViterbi(*tokens.vocabulary())
    long = "ab" * 40_000
    df = documents(spark, [None, "", long, "x " + long, "a b"])
    got = tokens.count_tokens(df, keep=["doc_id", "text"]).collect()
    assert all(r["n_tokens"] == sum(m.count("▁" + w)[0] for w in (r["text"] or "").split()) for r in got)
    assert tokens.count_tokens(df.limit(0)).count() == 0


# --- archives


def read_pages(spark, pages, split="4096", **options):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = warc.new_folder(spark, "test")
        warc.write_archive(pages, path)
        return warc.read_archive(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_archive_of_nothing_repeats_and_large_records(spark, monkeypatch):
    kind = "page_id bigint, url string, html string, digest string, response string, maybe string"
    assert read_pages(spark, spark.createDataFrame([], kind)) == []
    magic = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    large = (magic + "q" * 900) * 30  # runs over several splits
    rows = [(1, "u", large), (2, "u", large + "z"), (3, None, "s"), (3, None, "s"), (5, "v", "e" * 2000), (5, "v", "e" * 2000), (4, "v", "e" * 2000)]
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], kind).coalesce(1)
    monkeypatch.setattr(warc._gather, "__defaults__", (5000,))
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in read_pages(spark, pages))
    assert got == collections.Counter({(1, len(large), "response", None): 1, (2, len(large) + 1, "response", None): 1, (3, 1, "response", None): 2, (5, 2000, "response", None): 2, (4, 2000, "revisit", 5): 1})


# --- scratch tables and the pipeline


def folders(spark):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(store.scratch_root(spark) + "/corvane")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {x.getPath().getName() for x in fs.listStatus(root)} if fs.exists(root) else set()


def test_scratch_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        store.scratch_root(Session())


def test_scratch_is_released(spark, sf_dir):
    from corvane.llm import registry

    before = folders(spark)
    out = registry.queries()["op2_grouped_prefix_join"](spark, sf_dir)
    left = folders(spark) - before
    assert out.count() > 0 and len(left) <= 3


def small_corpus(spark, path, rows):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, digest string, key string"
    spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], kind).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "the answer to this question is known by every child in the whole wide world today")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(12)
    words = "the cat dog ran over green hill and saw small river with old stone bridge near town".split()
    item = "the answer to this question is known by every child in the whole wide world today"
    texts_of = [" ".join(r.choice(words) for _ in range(40)) for _ in range(60)]
    rows = [(i, t, "en" if i % 5 else None, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts_of)]
    rows += [(100, texts_of[1], "en", "s1"), (100, texts_of[1], "en", "s1"), (None, texts_of[2] + " end", "en", "s2"), (101, None, None, None), (102, "", "en", "s0"), (103, item, "en", "s0"), (104, "9 9 9", None, "s1")]
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    small_corpus(spark, a, rows)
    small_corpus(spark, b, [])
    before = folders(spark)
    first = p.run(spark, a)
    assert p.run(spark, b).count() == 0
    second = p.run(spark, a)
    one, two = (sorted((x["doc_id"], x["shard"], x["slot"]) for x in df.select("doc_id", "shard", "slot").collect()) for df in (first, second))
    assert one == two and one
    ids = {x[0] for x in one}
    assert not ids & {100, 101, 102, 103, 104, None}  # copies, nothing to read, the benchmark's item
    assert ids <= set(range(60)) and len(ids) >= 20  # the mix takes few of the light sources
    assert {"digest", "key", "n_chars"} <= set(first.columns)
    assert len(folders(spark) - before) <= 12  # what three results still read


