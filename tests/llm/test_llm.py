"""Every operator against a plain version on small tables that hold the odd cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import decontaminate, language, licenses, mixing, registry, rolling, sharding, shingles, substrings, tokens, vectors, warc

DOC = "doc_id bigint, text string, lang string, source string, n_chars string, size string, shard string, n_words string"


def documents(spark, texts, start=0):
    """Documents with null and repeated ids and columns whose names clash with results."""
    rows = [(None if i % 11 == 5 else start + i, t, "en" if i % 2 else None, None if i % 7 == 3 else f"s{i % 4}", "x", "y", "z", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:3], DOC).repartition(3)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    base = [" ".join(r.choice(words) for _ in range(n)) for n in (1, 3, 20, 60, 150, 400)]
    out = [None, "", " \n\t", "word", "é" * 5000, "a b c d " * 3000]
    for _ in range(120):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 3])):
            w[r.randrange(len(w))] = f"E{r.randint(0, 30)}"
        if r.random() < 0.2:
            w += r.choice(base).split()
        out.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    return out


def counter(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_curve_is_adjacent():
    place, state = sharding.curve_tables(3)

    def index(p, bits=3):
        s = h = 0
        for level in range(bits - 1, -1, -1):
            c = sum(((v >> level) & 1) << i for i, v in enumerate(p))
            h, s = h << 3 | place[s * 8 + c], state[s * 8 + c]
        return h

    points = sorted((index((x, y, z)), (x, y, z)) for x in range(8) for y in range(8) for z in range(8))
    assert [h for h, _ in points] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(points, points[1:]))


def test_shards(spark, texts):
    df = documents(spark, texts)
    rows = sharding.shard(df, keep=["doc_id", "text"]).collect()
    n = len(texts) + 3
    assert len(rows) == n
    sizes = collections.Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(k)) for s, k in sizes.items())
    for r in rows:
        raw = None if r["text"] is None else r["text"].encode()
        assert r["size"] == len(raw or b"") + 1
        assert r["text_crc32"] == (None if raw is None else zlib.crc32(raw))
    assert sharding.shard(df.limit(0)).count() == 0
    assert sharding.shard(df).columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "size", "text_crc32", "shard", "slot"]


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((k for k in sizes if k is not None), key=lambda x: x.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        if not free:
            return held
        rest = total - sum(held.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return held | share
        held |= {s: most * sizes[s] for s in over}


def test_mix(spark, texts):
    df = documents(spark, texts)
    rows = mixing.mix(df, keep=("doc_id", "source", "text")).collect()
    assert len(rows) == len(texts) + 3
    sizes = collections.Counter()
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode().split())
        sizes[r["source"]] += r["size"]
    want, taken = targets(sizes), collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    largest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - want[s]) <= 2 * largest for s in want)
    assert sum(taken.values()) <= sum(sizes.values())
    assert counter(mixing.mix(df), "doc_id", "taken") == counter(mixing.mix(df.repartition(5)), "doc_id", "taken")
    assert mixing.mix(df.limit(0)).count() == 0
    empty = mixing.mix(df.where("text is null")).collect()
    assert empty and all(r["taken"] == 0 for r in empty)
    copies = mixing.mixed(df)
    assert copies.columns == df.columns
    assert sum(len((r["text"] or "").split()) for r in copies.collect()) == sum(taken.values())


def component_rows(rows, links):
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        top[find(a)] = find(b)
    least = {}
    for k, i in enumerate(rows):
        r = find(k)
        if i is not None and (least.get(r) is None or i < least[r]):
            least[r] = i
    return [least.get(find(k)) for k in range(len(rows))]


def test_shingle_join(spark, texts):
    df = documents(spark, texts)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    ids = component_rows([i for i, _ in rows], links)
    want = collections.Counter((rows[k][0], len(sets[k]), ids[k] if sets[k] else rows[k][0]) for k in range(len(rows)))
    assert counter(shingles.join_classes(df), "doc_id", "n_shingles", "component_id") == want
    kept = shingles.one_of_each(df)
    assert kept.columns == df.columns
    assert kept.count() == len(set(component_number(len(rows), links)))
    assert shingles.join_classes(df.limit(0)).count() == 0


def test_signatures_bound_the_intersection():
    r = np.random.default_rng(3)
    for n in (1, 5, 40, 300, 2000):
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0.0, 0.5, 0.9, 1.0):
            y = np.unique(np.concatenate([x[: int(len(x) * share)], r.integers(0, 1 << 63, 1 + n // 3, dtype=np.uint64)]))
            raw = [np.frombuffer(shingles.signature(s), np.uint8) for s in (x, y)]
            bound = shingles.most_shared(raw[0], len(x), raw[1], len(y))
            assert len(np.intersect1d(x, y)) <= bound <= len(x) + len(y)


def component_number(n, links):
    top = list(range(n))
    for a, b in links:
        x, y = top[a], top[b]
        top = [y if t == x else t for t in top]
    return top


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 24))
    rows = []
    for i in range(260):
        v = [float(x) for x in centres[i % 6] * (1 + i % 3) + rng.standard_normal(24) * 0.03 * (i % 13)]
        if i % 40 == 1:
            v = [0.0] * 24
        elif i % 41 == 1:
            v[2] = float("nan")
        elif i % 42 == 1:
            v[2] = None
        elif i % 43 == 1:
            v = None
        elif i % 44 == 1:
            v = v[:3]
        rows.append((i if i % 13 else None, v, "k"))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, kept string").repartition(3)
    rows = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    units = [np.array(v) / np.linalg.norm(v) if v and all(x is not None and math.isfinite(x) for x in v) and any(v) else None for _, v in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.95]
    degree = collections.Counter(x for pair in links for x in pair)
    ids = component_rows([i for i, _ in rows], links)
    want = collections.Counter((rows[k][0], degree[k], ids[k], ids[k] == rows[k][0]) for k in range(len(rows)))
    assert counter(vectors.near_vectors(df), "vec_id", "n_links", "component_id", "kept") == want
    assert vectors.near_vectors(df.limit(0)).count() == 0


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("chunk", [1 << 20, 200])
def test_contamination(spark, texts, chunk):
    items = [(1, " ".join(texts[10].split()[:15])), (2, "Word!"), (10, texts[12]), (3, None), (4, "--"), (1, texts[20]), (None, "a b c d a b c d a b c d a")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(spark, [*texts, "x " * 100 + items[0][1] + " y" * 50])
    windows = collections.defaultdict(set)
    for i, t in items:
        w = alnum_words(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k : k + m])].add("" if i is None else str(i))
    want = collections.Counter()
    for i, t in docs.select("doc_id", "text").collect():
        w = alnum_words(t)
        hit, found = [0] * len(w), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                got = windows.get(tuple(w[k : k + m]))
                if got:
                    found |= got
                    hit[k : k + m] = [1] * m
        n = sum(hit)
        want[(i, len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w))] += 1
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert counter(decontaminate.matches(docs, bench, keep=["doc_id"], chunk_bytes=chunk), *columns) == want
    clean = decontaminate.matches(docs, bench, clean_only=True, chunk_bytes=chunk)
    assert clean.columns == docs.columns
    assert clean.count() == sum(k for row, k in want.items() if not row[-1])
    assert decontaminate.matches(docs, bench.limit(0), keep=["doc_id"]).where("n_hit > 0").count() == 0
    assert decontaminate.matches(docs.limit(0), bench).count() == 0


def test_repeats(spark, texts):
    df = documents(spark, [*texts, "same " * 36, "same " * 35, " ".join(texts[13].split() * 4)])
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    split = [(t or "").encode().split() for _, t in rows]
    seen = collections.Counter(tuple(w[k : k + 35]) for w in split for k in range(len(w) - 34))
    want = collections.Counter()
    for (i, _), w in zip(rows, split):
        gone = [0] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [1] * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[(i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    assert counter(substrings.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_word_hashes():
    texts = [b"A b\tc ", None, b"", b"x" * 5000, "é ü".encode(), b"b c"]
    h, n = rolling.word_hashes(texts, lower=True)
    assert n.tolist() == [3, 0, 0, 1, 2, 2]
    assert h[1] == h[6] and h[2] == h[7] and len(set(h.tolist())) == 6
    for width in (1, 2, 3, 5):
        got = rolling.windows(h, width)
        want = []
        for i in range(len(h) - width + 1):
            v = 0
            for x in h[i : i + width].tolist():
                v = (v * rolling.BASE + x) % (1 << 64)
            want.append(v)
        assert (got == rolling.mixed(np.array(want, np.uint64))).all()


def test_licenses(spark):
    cases = {
        "Licensed under the CC BY 4.0. All rights reserved!": (10, 2, 3, 7, "cc-by,reserved", {"cc-by", "reserved"}),
        "cc by cc by": (4, 2, 0, 2, "cc-by", {"cc-by"}),
        "This is under the GNU Lesser General Public License v3.": (10, 1, 6, 6, "gpl", {"gpl", "lgpl-3.0"}),
        "SPDX-License-Identifier: Apache-2.0": (6, 0, None, None, "", {"apache-2.0"}),
        "Released under the MIT License.": (5, 0, None, None, "", {"mit"}),
        "the cc bye": (3, 0, None, None, "", set()),
        "": (0, 0, None, None, "", set()),
    }
    assert len(licenses.rules()) > 200
    df = documents(spark, [*cases, None])
    for r in licenses.licenses(df).collect():
        n, base, first, last, base_labels, labels = cases[r["text"] or ""]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, base, first, last, base_labels)
        assert set(filter(None, r["labels"].split(","))) == labels and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == bool(labels)
    assert licenses.licenses(df.limit(0)).count() == 0


def test_language_of_long_rows_only(spark):
    rows = [(i, f"the small cat {i} sat on the mat and the dog ran", "en") for i in range(60)]
    rows += [(100 + i, f"ein langer satz über große straßen und häuser {i} " * 20, "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language.sample(docs, 30, 200)
    of = {x: [r["text"] for r in got if r["lang"] == x] for x in ("en", "de")}
    assert len(of["en"]) == len(of["de"]) == 30 and all(len(t) == 50 for t in of["de"]) and all(len(t.encode()) <= 200 for x in of.values() for t in x)
    # short rows go before long ones, and long ones only fill up
    mixed = docs.withColumn("lang", F.lit("x"))
    assert not any("langer" in r["text"] for r in language.sample(mixed, 30, 200))
    assert sum("langer" in r["text"] for r in language.sample(mixed, 80, 200)) > 10
    model = language.fit(docs, 30, 200)
    assert set(model.predict([rows[70][1]])[0]) == {"de"} and set(model.languages) == {"de", "en"}


def branches(parsed) -> list[str]:
    """One text for every branch of a parsed expression, with and without what is optional."""
    out = [""]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(value)]
        elif name == "BRANCH":
            more = [x for p in value[1] for x in branches(p)]
        elif name == "SUBPATTERN":
            more = branches(value[-1])
        elif name == "MAX_REPEAT":
            more = list(dict.fromkeys([""] * (value[0] == 0) + branches(value[2])))
        elif name == "IN":
            more = [{"LITERAL": lambda v: chr(v), "CATEGORY": lambda v: "7" if "DIGIT" in str(v) else "w"}[str(value[0][0])](value[0][1])]
        else:
            raise ValueError(name)
        out = [a + b for a in out for b in more]
    return out


def test_license_gate_loses_nothing(monkeypatch):
    import re

    samples = [(label, x) for label, _, name in licenses.NAMES for x in branches(re._parser.parse(name))]
    assert {label for label, _ in samples} == {x[0] for x in licenses.NAMES} and len(samples) > 200
    uses = ("spdx license identifier {}", "licensed under the {} license", "subject to the {} license", "{} license", "license is {}")
    cases = [use.format(x).encode() for _, x in samples for use in uses]
    gated = [licenses.detections(x) for x in cases]
    assert all(gated)
    everything = [(label, ("",), ("",), *rest) for label, _, _, *rest in licenses.rules()]
    monkeypatch.setattr(licenses, "rules", lambda: everything)
    assert gated == [licenses.detections(x) for x in cases]


@pytest.mark.parametrize("text, label", [
    (b"Licensed under the EUPL 1.2", "eupl"), (b"released under the PSF license", "psf"), (b"under the PDDL", "pddl"), (b"licensed under ODC-BY", "odc-by"),
    (b"licensed under the do what the fun you want to public license", "wtfpl"),
    (b"licensed under the Creative Commons Attribution Non-Commercial No-Derivatives 4.0 license", "cc-by-nc-nd"), (b"licensed under cc by non commercial share alike 4.0", "cc-by-nc-sa"),
])
def test_licenses_by_their_other_names(text, label):
    assert label in licenses.scan(text)[5].split(",")


def test_tokens(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    pieces, byte_fallback = tokens.vocabulary()
    exact = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", -1e9), *pieces], unk_id=0, byte_fallback=byte_fallback))
    pre = tokenizers.pre_tokenizers
    exact.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.Metaspace(replacement="▁", prepend_scheme="always", split=True)])
    df = documents(spark, [*texts, "日本語 テキスト 𝔘𝔫𝔦 zzzzqqqq é中a😀😀b"])
    for r in tokens.count_tokens(df).collect():
        assert r["n_tokens"] == len(exact.encode(r["text"] or "").ids)
        assert r["n_chars"] == len(r["text"] or "")


def test_tokens_tie_and_unknown():
    m = tokens.CountOnlyViterbi([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0)], False)
    assert m.count("▁aa")[0] == 2  # equal scores: the longer last piece
    assert m.count("▁xy") == (2, 1)  # unknown neighbours are one piece
    assert m.count("▁xay") == (4, 2)


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs)
    out = language.identify(docs, model)
    held = out.where(language.fold_of(F.col("doc_id")) == 2).select("lang", "lang_pred").collect()
    assert sum(r[0] == r[1] for r in held) >= 0.95 * len(held)
    odd = documents(spark, [None, "", "123 --", "ok then"])
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, model).collect()}
    assert got[None] == got[""] == got["123 --"] == ("und", 0.0) and got["ok then"][0] in model.languages
    kept = language.identify(odd, model, accepted_only=True)
    assert kept.columns == odd.columns and {r["text"] for r in kept.collect()} <= {"ok then"}
    none = language.Model([], [])
    assert none.predict(["text", None]) == (["und", "und"], [0.0, 0.0], [False, False])
    m = model.models[0]
    context = m.orders[0][0][:50] >> language.BITS << language.BITS
    total = sum(m.probability(context + c) for c in range(m.letters))
    assert np.allclose(total, 1, atol=1e-6)  # a distribution over the alphabet


def test_archive(spark):
    magic = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    rows = [(i, f"u{i}", None if i % 5 == 0 else "x" * (i % 3 * 700) + magic * (i % 4) + "y" * (i % 7 * 500)) for i in range(50)]
    rows += [(100 + i, None, "z" * 1500) for i in range(4)] + [(200, "a\r\nb", "W" * 999), (201, "c", "W" * 999), (300, "big", (magic + "q" * 3000) * 6), (None, "n", "null id")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        path = warc.new_folder(spark, "test")
        warc.write_archive(pages, path)
        got = {r["page_id"]: r for r in warc.read_archive(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == len(rows)
    last = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        last[raw] = max(last.get(raw, -1), -1 if i is None else i)
    for i, _, html in rows:
        raw, r = (html or "").encode(), got[i]
        response = len(raw) < 1000 or last[raw] == i
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if response else ("revisit", last[raw]))
        assert not response or bytes(r["payload"]) == raw


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_registered(spark, sf_dir, name):
    table = {"op3_rotation_codes": "embeddings", "op10_warc_round_trip": "pages"}.get(name, "documents")
    df = registry.queries()[name](spark, sf_dir)
    assert df.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_sql(spark, sf_dir):
    import oracle

    con = oracle.connect(sf_dir)
    for name, sql in registry.oracle_sql().items():
        assert not oracle.difference(registry.queries()[name](spark, sf_dir), con, sql), name


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = p.run(spark, sf_dir)
    assert set(out.columns) == {*docs.columns, "size", "text_crc32", "shard", "slot"}
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    # the same stages, plainly
    kept = {r.doc_id: r.text for r in language.identify(docs, language.fit(docs), accepted_only=True).collect()}
    rows = sorted(kept.items())
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    first = {i for (i, _), c in zip(rows, component_rows([i for i, _ in rows], links)) if i == c}
    bad = {r.doc_id for r in decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"]).where("contaminated").collect()}
    assert ids <= first - bad
    # the mix takes as many words as there are, but for less than one document
    words = {r.doc_id: len(r.text.encode().split()) for r in docs.select("doc_id", "text").collect()}
    total, taken = sum(words[i] for i in first - bad), sum(words[r.doc_id] for r in out.select("doc_id").collect())
    assert total - max(words.values()) <= taken <= total
