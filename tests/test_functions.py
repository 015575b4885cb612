"""Small cases with known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import imports, paths, tasks, text
from corvane.operators import evidence, graph, ranges, ranking, scan, verify


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).head()[0]


def test_tokens(spark):
    assert one(spark, text.code_tokens(F.col("t")), t="shipping shipping shipping") == ["shipping"] * 3
    got = one(spark, text.code_tokens(F.col("t")), t="getNodeFromPath shipping_fee v2Foo getURL -x- $")
    assert got == ["getnodefrompath", "get", "node", "from", "path", "shipping_fee", "shipping", "fee", "v2foo", "geturl", "get", "url"]
    assert one(spark, text.query_terms(F.col("t")), t="b.c a1 a1") == ["a1", "b.c"]


def test_identifiers_stop_keywords_only(spark):
    t = "class That: def has_not(self): return not That and into(the, x) if x in this else const"
    assert one(spark, text.identifiers(F.col("t")), t=t) == ["That", "has_not", "self", "not", "into", "the", "x"]
    assert len(set(text.STOP_WORDS)) == 45
    padded = "class def return if import in of while " + " ".join(f"n{i}" for i in range(170))
    assert one(spark, text.identifiers(F.col("t")), t=padded) == [f"n{i}" for i in range(160)]


def test_discovery_says_where_it_was_cut(spark):
    lines = spark.createDataFrame([(f"f{i}", 1, "aa bb" if i < 3 else "aa") for i in range(4)], "file string, line bigint, text string")
    got = {(r["query"], r["file"], r["capped"]) for r in scan.discover(lines, ["aa", "bb"], cap=3).collect()}
    assert got == {(0, f"f{i}", True) for i in range(3)} | {(1, f"f{i}", False) for i in range(3)}
    whole = scan.discover(lines, ["aa", "bb"], cap=None).collect()
    assert len(whole) == 7 and not any(r["capped"] for r in whole)


def test_search_ranks_files_past_the_cap(spark):
    from corvane.plans import search

    n = scan.FILE_CAP + 1
    files = spark.range(n).select(F.format_string("a%05d.txt", "id").alias("file"), F.when(F.col("id") == n - 1, "aa bb").otherwise("aa").alias("source"))
    rows = search.search(files, ["aa", "bb"], [[], []], ["bb"]).collect()
    assert {r["file"] for r in rows if r["rank"] == 1} == {f"a{n - 1:05d}.txt"}
    # the last file has the only word of the path that the query looks for, and one query only
    named = files.select("file", F.lit("aa").alias("source")).withColumn("file", F.when(F.col("file") == f"a{n - 1:05d}.txt", "zz.txt").otherwise(F.col("file")))
    rows = search.search(named, ["aa"], [["zz"]], ["zz"]).collect()
    assert "zz.txt" in {r["file"] for r in rows}


def test_a_rare_query_keeps_its_place_behind_many_files(spark, tmp_path):
    from corvane.plans import search_queries

    # 1,100 files of two queries ahead of one file with a query of its own
    rows = [(i, "that of the MIT License", "en", "a") for i in range(1100)] + [(5000, "General Public License, version 3", "zz", "zz")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r["file"] for r in search_queries.fair_files(spark, str(tmp_path)).orderBy("position").collect()]
    assert len(got) == 8 and got[-1] == "zz/zz/doc_5000.txt"


def test_line_ends(spark):
    for t, kind in (("one\n", "lf"), ("one\r\n", "crlf"), ("one\r\ntwo\n", "mixed"), ("one\rtwo", "bare_cr"), ("one", "none")):
        assert one(spark, text.eol_kind(F.col("t")), t=t) == kind
    for a, b, ok in (("a\n", "b\n", True), ("a\r\n", "b\r\n", True), ("a\n", "b\r\n", False), ("a\r\n", "b\n", False), ("a", "b\r\n", True), ("a", "b\n\r\n", False)):
        assert one(spark, verify.eol_kept(F.col("a"), F.col("b")), a=a, b=b) is ok


def test_numbers_are_whole_atoms(spark):
    assert one(spark, text.atom_in_line(F.col("t"), F.col("a")), t="x 50 y", a="50") is True
    assert one(spark, text.atom_in_line(F.col("t"), F.col("a")), t="x 150 y", a="50") is False
    assert one(spark, text.atom_in_line(F.col("t"), F.col("a")), t="Threshold", a="thresh") is True


def test_utf16(spark):
    assert one(spark, text.utf16_length(F.col("t")), t='α = "🙂"') == 8


def test_module_targets(spark):
    def targets(kind, importer, spec):
        return one(spark, paths.targets(F.lit(kind), F.col("i"), F.col("s")), i=importer, s=spec)

    assert targets("python_from", "a/b/c.py", "..x.y") == ["a/x/y.py", "a/x/y/__init__.py"]
    assert targets("python_from", "c.py", "..x") == []
    assert targets("js_relative_import", "src/api.ts", "./service.js") == ["src/service.js", "src/service.ts", "src/service.tsx", "src/service.d.ts", "src/service.jsx"]
    assert len(targets("js_relative_import", "src/api.ts", "./service")) == 18
    assert targets("rust_mod", "src/lib.rs", "util") == ["src/util.rs", "src/util/mod.rs"]
    assert targets("rust_mod", "src/a.rs", "util") == ["src/a/util.rs", "src/a/util/mod.rs"]


def test_python_imports():
    assert imports.python_imports("from service import handle as h, other\n") == [(1, "python_from", "service", [("h", "handle"), ("other", "other")])]
    assert imports.python_imports("from m import (\n    Alpha as a,  # first\n    beta,\n)\n") == [(1, "python_from", "m", [("a", "Alpha"), ("beta", "beta")])]
    assert imports.python_imports("import a.b as c, d\n") == [(1, "python_import", "a.b", [("c", "a.b")]), (1, "python_import", "d", [("d", "d")])]


def test_script_imports():
    assert imports.script_imports("import { handle as h, other } from './service.js'\n") == [(1, "js_relative_import", "./service.js", [("h", "handle"), ("other", "other")])]
    assert imports.script_imports('import type {\n  Alpha,\n  Beta as LocalBeta,\n} from "./service.js"\n')[0][3] == [("Alpha", "Alpha"), ("LocalBeta", "Beta")]
    assert imports.script_imports('import * as ts from\n  "./_namespaces/ts.js"\n')[0][3] == [("ts", "*")]
    assert imports.script_imports("import { Zebra as alpha, Alpha as zebra } from './z'\n")[0][3] == [("alpha", "Zebra"), ("zebra", "Alpha")]
    assert imports.script_imports("import react from 'react'\n") == []


FREIGHT = [
    ("freight.py", "def quote(x):\n    return x\n"), ("desk.py", "from freight import quote\nimport sys\nfrom .nowhere import lost\n\ndef ask():\n    return quote(1)\n"),
    ("client.py", "from desk import (\n    quote,  # passed on\n    ask as go,\n)\nquote(2)\n"), ("nick.py", "from freight import quote as q\nq(3)\n"),
    ("tests/test_freight.py", "from freight import quote\n\ndef test_quote():\n    assert quote(0) == 0\n"),
    ("web/app.ts", "import { quote as q, other } from './freight.js'\n"), ("web/freight.ts", "export function quote() {}\n"),
]


def test_closure(spark):
    from corvane.sources.corpus import plain_lines

    files = spark.createDataFrame([(f, x, len(x)) for f, x in FREIGHT], "file string, source string, n_bytes bigint")
    resolved = graph.resolved(imports.all_imports(files, plain_lines(files)), files)
    rows = resolved.select(F.col("file").alias("importer"), "target", "status", F.explode(F.arrays_zip("local", "source")).alias("p")).select("importer", "target", "status", F.col("p.local").alias("local"), F.col("p.source").alias("source"))
    found, why = graph.symbol_closure(rows, "freight.py", "quote")
    assert why is None
    got = {(r.importer, r.local_symbol, r.propagates) for r in found.collect()}
    assert got == {("desk.py", "quote", True), ("client.py", "quote", True), ("tests/test_freight.py", "quote", True), ("nick.py", "q", False)}
    assert graph.symbol_closure(rows, "freight.py", "quote", most=2)[1] == "closure_binding_budget_exceeded"
    assert graph.symbol_closure(rows, "freight.py", "quote", most_states=2)[1] == "closure_state_budget_exceeded"
    assert graph.symbol_closure(rows, "missing.py", "lost")[1] == "closure_import_unresolved"
    loose = rows.unionByName(spark.createDataFrame([("z.ts", None, "ambiguous", "quote", "quote")], rows.schema))
    assert graph.symbol_closure(loose, "freight.py", "quote")[1] == "closure_import_ambiguous"


def test_rename_requests():
    for said, want in (
        ("Rename parcel to crate.", ("exact", "parcel", "crate")), ("please rename `parcel_box` -> 'crate$1'", ("exact", "parcel_box", "crate$1")), ("Change the identifier of parcel, please, to crate", ("exact", "parcel", "crate")),
        ("Пожалуйста, переименуйте parcel: на crate", ("exact", "parcel", "crate")), ("We saw it fail. rename parcel as crate!", ("exact", "parcel", "crate")), ("Rename parcel на crate", ("unresolved", None, None)),
        ("Переименуй parcel to crate", ("unresolved", None, None)), ("Never ever rename parcel to crate", ("unresolved", None, None)), ("Без переименования parcel в crate", ("unresolved", None, None)),
        ("rename parcel to crate. rename lid to cap", ("unresolved", None, None)), ("rename parcel to parcel", ("unresolved", None, None)), ("ｒｅｎａｍｅ parcel to crate", ("exact", "parcel", "crate")),
        ("They rename parcel to crate", ("unresolved", None, None)), (None, ("unresolved", None, None)),
    ):
        assert tasks.rename_action(said)[:3] == want, said
    assert tasks.rename_action("Avoid renaming parcel")[3] == "task_action_negative_rename"
    assert [tasks.intent_of(x) for x in ("Rename parcel", "Rename the parcel for good to crate", "Rename parcel на crate", "Do not rename parcel", "Speed it up", " ")] == ["unknown", "rename_symbol", "unknown", "generic_edit", "generic_edit", "unknown"]


def test_bm25_counts_repeats(spark):
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    fields = spark.createDataFrame([("a", "symbols", "fee xx yy"), ("b", "symbols", "fee fee fee")], "file string, field string, text string")
    got = dict(ranking.bm25f(files, ranking.field_counts(fields, ["fee"]), ["fee"]).collect())
    assert got["b"] > got["a"] > 0
    assert dict(ranking.bm25f(files, ranking.field_counts(fields, ["none"]), ["none"]).collect()) == {"a": 0.0, "b": 0.0}


def test_fair_selection(spark):
    ranked = spark.createDataFrame([("a", 1, [0]), ("b", 2, [0]), ("c", 3, [0]), ("d", 4, [1]), ("e", 5, [2])], "file string, rank int, queries array<int>")
    found = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "d"), (2, "e")], "query int, file string")
    assert ranking.reserve_and_fill(ranked, found, 3) == ["a", "d", "e"]
    assert ranking.reserve_and_fill(ranked, found, 4) == ["a", "b", "d", "e"]
    assert ranking.reserve_and_fill(ranked, found, 4, fill=False) == ["a", "d", "e"]
    assert ranking.emit_with_impact(["a", "b", "c"], ["a"], ["s"], ["g", "h"]) == ["a", "s", "g", "b"]


def test_exact_cap_is_complete(spark):
    lines = spark.createDataFrame([("f", i, "x") for i in range(1, 6)], "file string, line bigint, text string")
    for cap, capped in ((5, False), (4, True)):
        rows = scan.scan_lines(lines, ["x"], cap).collect()
        assert len(rows) == min(cap, 5) and {r.capped for r in rows} == {capped}
    status = {r.query: r for r in scan.scan_status(spark, scan.scan_lines(lines, ["x", "y"], 4), ["x", "y"]).collect()}
    assert (status[0].scan_complete, status[0].absent, status[1].absent) == (False, False, True)


def test_alternatives():
    assert scan.split_alternatives("a|b(c|d)|[|]") == ["a", "b(c|d)", "[|]"]
    assert scan.split_alternatives("a|(b") is None
    assert scan.split_alternatives("a|b|c|d|e") is None
    assert scan.split_alternatives(r"a\|b") == [r"a\|b"]


def test_groups_of_equal_calls(spark):
    hits = spark.createDataFrame([("f", "requests.get", a, 0, n) for n, a in enumerate(["x", "y", "z"], 1)], "file string, anchor string, statement string, query int, line int")
    g = evidence.valid_groups(evidence.grouped(hits, ["file", "anchor"], ["statement"])).collect()
    assert len(g) == 1 and g[0].hit_count == 3 and g[0].n_variants == 3 and g[0].variant_diversity == 1.0
    same = evidence.grouped(hits.withColumn("statement", F.lit("s")), ["file", "anchor"], ["statement"]).head()
    assert same.n_variants == 1 and same.variants[0].hit_count == 3


def test_greedy_and_prefix_budgets(spark):
    rows = spark.createDataFrame([("p", i, c) for i, c in enumerate([4, 9, 3, 5, 1])], "p string, i int, c int")
    assert [r.i for r in ranges.greedy_budget(rows, ["p"], ["i"], F.col("c"), 10).orderBy("i").collect()] == [0, 2, 4]
    assert [r.i for r in ranges.prefix_budget(rows, ["p"], ["i"], F.col("c"), 10).collect()] == [0]


def test_task_text(spark):
    event = F.struct(F.col("role"), F.col("content"), F.array(F.lit("b")).alias("parts"), F.lit("c").alias("text"))
    assert one(spark, tasks.task_text(event), role="user", content="a") == "a\nb\nc"
    assert one(spark, tasks.task_text(event), role="user", content='[{"type":"text","text":"q"},{"type":"text","text":"r"}]') == "q\nr\nb\nc"
    assert one(spark, tasks.task_text(event), role="assistant", content="a") is None


def test_snapshot(spark, tmp_path):
    from corvane.sources import corpus

    for n in (1, 2):
        corpus.write_snapshot(spark.range(n), str(tmp_path), "1")
    assert corpus.read_snapshot(spark, str(tmp_path), "1").count() == 2
    assert corpus.read_snapshot(spark, str(tmp_path), "2") is None


def test_tree(spark, tmp_path):
    from corvane.sources import corpus

    for p in ("a/b.py", "node_modules/c.js", "d.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x\n")
    assert sorted(r.file for r in corpus.read_tree(spark, str(tmp_path)).collect()) == ["a/b.py", "d.txt"]


def test_ranges_against_all_pairs(spark):
    import random

    r = random.Random(3)
    rows = [(f"f{i % 3}", i, a, a + r.choice([0, 1, 5, 40, 300])) for i in range(120) for a in [r.randrange(400)]]
    df = spark.createDataFrame(rows, "file string, id int, start int, end int")
    inner = df.select("file", F.col("id").alias("i_id"), F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    outer = df.select("file", F.col("id").alias("o_id"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    got = sorted((x.i_id, x.o_id) for x in ranges.containing(inner, outer).collect())
    assert got == sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and b[2] <= a[2] and b[3] >= a[3])
    points, marks = df.select("file", F.col("start").alias("line")).distinct(), df.where("id % 7 = 0").select("file", F.col("end").alias("line"))
    near = {(x.file, x.line): x.distance for x in ranges.nearest(points, marks, 50).collect()}
    want = {(f, s): min(abs(s - b[3]) for b in rows if b[0] == f and b[1] % 7 == 0) for f, _, s, _ in rows}
    assert near == {k: v for k, v in want.items() if v <= 50}


def test_globs():
    import re

    from corvane.functions import queries

    for glob, yes, no in (("*.py", "a/b/c.py", "a.pyc"), ("src/**/*.ts", "src/a/b.ts", "lib/a.ts"), ("src/*.{js,ts}", "src/a.js", "src/d/a.js"), ("a?.x", "d/ab.x", "abc.x")):
        assert re.match(queries.glob_expression(glob), yes) and not re.match(queries.glob_expression(glob), no)
    assert queries.language_glob("src/**/*.{py,pyi}") == ("src/**/*", ["py", "pyi"]) and queries.language_glob("*.rs") is None and queries.language_glob("!*.py") is None
