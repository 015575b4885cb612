"""Plans that stay in bounds: nothing large is sent to all tasks, files are parsed by all cores and as often as is said."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corvane.functions import imports, nodes, python_ast
from corvane.operators import closure, graph, rename, syntax, targets
from corvane.plans import code_queries
from corvane.scratch import kept
from corvane.sources import corpus, modules


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# joins of texts, nodes and lines, whose table looks small to Spark
LARGE = [
    "range_hit_scopes", "edit_replacements", "check_confinement", "check_top_level", "check_target", "check_control_flow", "evidence_by_role", "evidence_scope_order", "evidence_classified",
    "graph_validated", "graph_seed_contexts", "target_symbols", "rank_fields", "view_hybrid", "view_focused", "view_region", "graph_closures", "graph_symbol_closure",
]


@pytest.mark.parametrize("name", LARGE)
def test_nothing_large_is_broadcast(spark, sf_dir, name):
    text = physical(entry.queries()[name](spark, sf_dir))
    joins = [x for x in text.splitlines() if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]
    # places of range partitions are one row a partition
    assert all("__part" in x for x in joins), joins


@pytest.mark.parametrize(("name", "most"), [("check_top_level", 1), ("check_target", 1), ("check_control_flow", 1), ("python_facts", 1), ("rank_fields", 1), ("definition_unique", 1), ("target_symbols", 1), ("edit_replacements", 2)])
def test_files_are_parsed_once(spark, sf_dir, name, most):
    assert physical(entry.queries()[name](spark, sf_dir)).count("MapInArrow") <= most


@pytest.mark.parametrize("name", ["check_identifier_leaves", "check_reflective_uses"])
def test_all_cores_parse(spark, sf_dir, name):
    text = physical(entry.queries()[name](spark, sf_dir))
    below = text[text.index("MapInArrow") :]
    assert "REPARTITION_BY_NUM" in below


def test_wanted_nodes_are_those_of_the_whole_table():
    source = "# c\nimport a.b as c\n\n@d\nclass C(B):\n    def run(self, x):\n        y = getattr(x, 'k')\n        return [z for z in y if z]  # e\n"
    every = [dict(zip(nodes.COLUMNS, r)) for r in nodes.rows_of("f", source)]
    for only, names, columns in ((syntax.of_facts, "none", ["kind", "name", "head", "start"]), (syntax.of_roles, "bound", ["kind", "use", "name", "start"]), (syntax.of_names, "all", ["name", "use", "start"]), (syntax.of_top, "none", ["kind", "digest", "start"])):
        some = [dict(zip(nodes.COLUMNS, r)) for r in nodes.rows_of("f", source, columns, only, names)]
        def wanted(r):
            if only is syntax.of_facts:
                return r["kind"] in ("function_definition", "class_definition", "import_statement", "import_from_statement", "call", "comment")
            if only is syntax.of_names:
                return r["kind"] == "identifier"
            if only is syntax.of_top:
                return not r["parent"]
            return r["kind"] in ("module", *syntax.DEFINITIONS, *syntax.ACTS) or r["use"] == "definition" or r["statement"]
        assert [[r[c] for c in columns] for r in some] == [[r[c] for c in columns] for r in every if wanted(r)]


def test_parts_that_nobody_reads_are_not_made(monkeypatch):
    source = "# c\nimport a\n\ndef f(x):\n    if x > 0x1f:\n        return [g(y, 1.5) for y in x]\n\n    def g(z): return z\n"
    monkeypatch.setattr(nodes.tokenize, "generate_tokens", None)  # a text without strings needs no tokens
    kinds = lambda *x: [p.kind for p in nodes.parsed(source, *x)]
    assert kinds("none", syntax.of_functions) == ["function_definition"] * 2
    assert kinds("none", syntax.of_top) == ["module", "comment", "import_statement", "function_definition"]
    assert kinds("none", syntax.of_flow) == ["module", "function_definition", "If", "comprehension", "function_definition"]
    assert kinds("none", syntax.of_facts) == ["comment", "import_statement", "function_definition", "call", "function_definition"]
    assert [r[9] for r in nodes.rows_of("f", source, ["name"], syntax.of_names)] == ["a", "f", "x", "x", "g", "y", "y", "x", "g", "z", "z"]


@pytest.mark.parametrize("source", ["x = 1.0.real + 1..real + (0x1for 1j.imag)\n", "x = 1 if a else b # q 'x\n", "match x:\n    case C(a=1) as r:\n        type X = int\n", "x = f'{a!r:{w}} # {b}' # \u00e9\nclass \u00fc: pass\n", "a = 1\r\nb # c\r\n"])
def test_words_are_those_of_the_tokens(source, monkeypatch):
    fast = nodes.rows_of("f", source)
    names = [r[9] for r in nodes.rows_of("f", source, ["name"], syntax.of_names)]
    monkeypatch.setattr(nodes, "STRINGS", nodes.re.compile(""))  # every text is taken for one with strings
    assert fast and fast == nodes.rows_of("f", source) and names == [r[9] for r in fast if r[5] == "identifier"]


@pytest.mark.parametrize("name", ["evidence_classified", "evidence_scope_order"])
def test_lines_of_hits_are_read_once(spark, sf_dir, name):
    text = physical(entry.queries()[name](spark, sf_dir))
    assert text.count("posexplode(split(") == 1


def test_functions_alone_give_the_same_replacements(spark, sf_dir):
    rows = code_queries._mutations(spark, sf_dir).where("id < 40")
    every, functions = code_queries._nodes_by_id(rows)
    assert functions.where("kind <> 'function_definition'").isEmpty()
    told = lambda *x: sorted(map(repr, syntax.replacements(rows, *x).collect()))
    assert told(every, functions) == told(every)


def test_scopes_are_whole(spark):
    long = "def f():\n" + "    x = 1\n" * 400 + "    def g():\n        pass\n# c\n\n" + "    y = 2\n" + "@d\nclass C:\n\n    z = 3\n"
    got = {(r.start, r.end) for r in targets.whole_scopes(spark.createDataFrame([("a.py", long)], "file string, source string")).collect()}
    assert got == {(1, 407), (402, 405), (408, 411)}


def test_touching_imports_give_the_same_neighbours(spark, sf_dir):
    files = modules.modules(spark, sf_dir)
    rows = imports.all_imports(files, corpus.plain_lines(files))
    seeds = spark.createDataFrame([("pkg/m3.py", 0), ("pkg/m5.py", 1)], "seed string, position int")
    names = lambda x: sorted(map(tuple, graph.neighbors(graph.edges(graph.resolved(x, files)), seeds).select("seed", "direction", "file", "total").collect()))
    near = graph.touching(rows, seeds)
    assert names(near) == names(rows) and near.count() < rows.count()


def test_competitors_beyond_the_cap_of_a_scan(spark, tmp_path):
    docs = spark.range(5200).select(F.col("id").alias("doc_id"), F.lit("General Public License, version 2\nMIT License").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(1).alias("n_chars"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["target_competitors"]).fetchall()
    assert [tuple(r) for r in entry.queries()["target_competitors"](spark, str(tmp_path)).collect()] == want == [(5199, "too_many")]


def test_lines_of_guesses_are_cut_after_the_joins(spark, sf_dir):
    text = physical(entry.queries()["graph_validated"](spark, sf_dir))
    assert text.count("posexplode(split(") == 1 and text.index("posexplode(split(") < text.index("SortMergeJoin")


def test_guesses_by_line_end_and_import_line(spark):
    files = spark.createDataFrame([("a.py", "from b import f1\r\ndef f1(x):\r\n    return f12(x)\r\nf1\r"), ("b.py", "# f1\nimport c as f1"), ("c.py", None)], "file string, source string")
    guesses = spark.createDataFrame([("a.py", "forward", ["f1", "f12", "f1"]), ("a.py", "reverse", ["f1", "f12", "no"]), ("b.py", "reverse", ["f1"]), ("c.py", "reverse", ["f1"])], "file string, direction string, symbols array<string>")
    witnesses = spark.createDataFrame([("a.py", 1), ("a.py", 3), ("a.py", None), ("b.py", 2), ("b.py", 1)], "file string, witness_line long")
    got = sorted(map(tuple, graph.validated(guesses, files, witnesses).collect()))
    assert got == [("a.py", "forward", ["f1"], 2), ("a.py", "reverse", ["f1"], 2)]


@pytest.mark.parametrize("name", ["python_facts", "rank_fields"])
def test_facts_of_a_file_stay_together(spark, sf_dir, name):
    text = physical(entry.queries()[name](spark, sf_dir))
    above = text[: text.index("MapInArrow")]
    assert "Window" not in text and above.count("Exchange") == (name == "rank_fields")  # that of the counts


def test_facts_of_a_file_are_those_of_its_nodes(spark):
    deep = "class A:\n    class B:\n        # c\n        def test_f(self):\n            return [g(1), it(2)]\n    def h(self, x=(k(1))): pass\nimport os.path as p\n"
    files = spark.createDataFrame([("a.py", deep), ("b.py", "f(1)\n" * 600 + "def late(): pass\n"), ("c.py", "def ("), ("d.py", None), ("e.py", "")], "file string, source string")
    columns = ["file", *python_ast.FACTS]
    rows = python_ast.owned_facts(files)
    told = lambda df: sorted(map(repr, df.select(columns).collect()))
    assert told(rows) == told(python_ast.python_facts(files)) and rows.where("file = 'b.py'").count() == syntax.MOST_FACTS
    names = {(r.role, r["name"]): (r.owner, r.qualified_name) for r in rows.where("file = 'a.py'").collect()}
    assert names == {
        ("declaration", "A"): (None, "A"), ("declaration", "B"): ("A", "A::B"), ("comment", None): ("A::B", None), ("test_declaration", "test_f"): ("A::B", "A::B::test_f"), ("call", "g"): ("A::B::test_f", "A::B::test_f::g"),
        ("test_call", "it"): ("A::B::test_f", "A::B::test_f::it"), ("declaration", "h"): ("A", "A::h"), ("call", "k"): ("A::h", "A::h::k"), ("import", None): (None, None),
    }
    some = python_ast.file_facts(files, python_ast.RANKED)
    fields = {(r.file, r.field): sorted(r.texts) for r in python_ast.ranker_texts(files, some).collect()}
    assert fields["a.py", "symbols"] == ["A", "A", "A::B", "A::h", "B", "h", "test_f"] and fields["a.py", "tests"] == ["A::B::test_f", "it", "test_f"] and fields["a.py", "comments"] == ["# c"]
    assert len(fields["a.py", "signatures"]) == 4 and {k for k in fields if k[0] != "a.py"} == {("b.py", "path"), ("c.py", "path"), ("d.py", "path"), ("e.py", "path"), ("b.py", "code"), ("c.py", "code"), ("e.py", "code")}


def test_imports_of_renames_are_resolved_once(spark, sf_dir, monkeypatch):
    resolved, resolve = [], graph.resolved
    monkeypatch.setattr(graph, "resolved", lambda *x: resolved.append(x) or resolve(*x))
    entry.queries()["edit_renames"](spark, sf_dir)
    assert len(resolved) == 1


def test_member_uses_of_places_are_those_of_all_mentions(spark, sf_dir):
    files = modules.modules(spark, sf_dir)
    rows = kept(graph.resolved(imports.all_imports(files, corpus.plain_lines(files)), files))
    bindings, edges = code_queries._bound(rows), code_queries._edges_of(rows)
    sources = files.select("file", F.explode(F.array(F.concat(F.lit("f"), "n"), F.lit("shared"))).alias("symbol"))
    places = kept(closure.places(bindings, sources))
    every = closure.member_uses(edges, closure.mentions(files, sources)).join(places, ["file", "symbol"], "left_semi").select("file", "symbol")
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(closure.member_uses_at(edges, files, places)) == told(every) != []


def test_leaves_among_names_lower_the_same_renames(spark):
    a = "def f(x):\n    return [f(y) for y in x] if x else getattr(x, 'g')\n\nclass C:\n    def g(self):\n        return self.g() or f(1)\n"
    files = spark.createDataFrame([("a.py", a), ("b.py", "from a import f, h as k\n\ndef u():\n    f(1)\n    return lambda f: f\n"), ("c.py", "import a\n"), ("d.py", None), ("e.py", "(")], "file string, source string")
    requests = spark.createDataFrame([(0, "a.py", "f", "z", ["a.py", "b.py"]), (1, "a.py", "f", "k", ["a.py", "b.py"]), (2, "a.py", "g", "y", ["a.py"]), (3, "a.py", "f", "w", None), (4, "e.py", "f", "w", ["e.py"])], "id long, file string, symbol string, new_name string, allowed array<string>")
    rows = kept(graph.resolved(imports.all_imports(files, corpus.plain_lines(files)), files))
    found, verdicts = (kept(x) for x in closure.closures(code_queries._bound(rows), requests))
    told = lambda x: [sorted(map(repr, df.collect())) for df in x]
    asked = files.join(rename.names_of(requests, found), "file")
    some = kept(nodes.node_table(asked, rename.NODE_COLUMNS, rename.of_renames, among="names"))
    every = kept(nodes.node_table(files))
    got = told(rename.lowered(requests, some, found, verdicts, rows))
    assert got == told(rename.lowered(requests, every, found, verdicts, rows)) and got[0] and some.count() < every.count()
