"""The node table, structural joins, closures of many symbols and renames."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from corvane.functions import imports, nodes
from corvane.functions.nodes import node_table
from corvane.operators import closure, graph, rename, syntax
from corvane.sources.corpus import plain_lines

BOX = "import a.b as c\n\n# kept\n@c.mark\nclass Box:\n    size = limit(2)  # é\n    def open(self):\n        self.n += 1\n        return lid\n"
ODD = [
    "", "x = 1\n", "é = 'ü'; f(é)\n", "\ufeffx = 1\n", "def f(a, *b, k=g(2), **z) -> t: pass\n", "match x:\n    case [y, *r]: pass\n", "a = f'{x!r} {y:>{w}}'\n", "if 1:\n\tx = lambda q=z: q\n\x0cy = 2\n",
    "try:\n    pass\nexcept E as err:\n    del err\n", "async def f():\n    async for i in [j async for j in k]: await i\n", "from . import a\nimport os, sys as s\n", "x = (\n  # c\n  1)\r\ny = 2\r\n", "class A(B, k=C):\n    @property\n    def a(self): return self.a\n",
]


def test_numbers_nest():
    for source in [BOX, *ODD]:
        parts = nodes.parsed(source.lstrip("\ufeff"))
        assert [p.node for p in parts] == list(range(len(parts))) and sorted(p.post for p in parts) == list(range(len(parts)))
        up = {p.node: p.parent for p in parts}
        for a in parts:
            inside = {b.node for b in parts if a.node < b.node <= a.last}
            assert inside == {b.node for b in parts if a.node < b.node and b.post < a.post}
            for b in parts:
                chain, x = set(), up[b.node]
                while x is not None:
                    chain.add(x)
                    x = up[x]
                assert (a.node in chain) == (b.node in inside)
                assert b.node not in inside or (a.start <= b.start and b.end <= a.end)
        raw = source.lstrip("\ufeff").encode()
        for p in parts:
            if p.kind == "identifier":
                assert raw[p.start : p.end].decode() == p.name
    assert nodes.rows_of("f", "def (:") == [] and nodes.rows_of("f", "x = '\\ud800'\n")


def uses(source):
    return [(p.name, p.use) for p in nodes.parsed(source) if p.kind == "identifier"]


def test_uses_of_names():
    assert uses("import os.path, a.b as c\n") == [("os", "import"), ("path", "imported"), ("a", "imported"), ("b", "imported"), ("c", "import")]
    assert uses("from m.n import x as y, z\n") == [("m", "imported"), ("n", "imported"), ("x", "imported"), ("y", "import"), ("z", "import")]
    assert uses("def f(a, *b):\n    global g\n    a.c = self.d(k=b)\n    del a\n") == [("f", "definition"), ("a", "parameter"), ("b", "parameter"), ("g", "global"), ("a", "load"), ("c", "member"), ("self", "load"), ("d", "own_member"), ("k", "keyword"), ("b", "load"), ("a", "delete")]
    assert uses("match x:\n    case [y, *r]: pass\n") == [("x", "load"), ("y", "store"), ("r", "store")]
    assert uses("print(f'{x!r}')\n") == [("print", "load"), ("x", "load")]


def table(spark, files):
    return node_table(spark.createDataFrame(list(files.items()), "file string, source string"))


def test_sql_on_the_node_table(spark):
    """The same joins in DuckDB over the same rows."""
    rows = table(spark, {f"f{i}.py": x for i, x in enumerate([BOX, *ODD])})
    n = rows.toPandas()  # noqa: F841  (read by DuckDB)
    con = duckdb.connect()
    got = sorted(map(tuple, syntax.identifier_leaves(rows).collect()))
    assert got == sorted(con.sql("SELECT file, name, count(*) FROM n WHERE kind = 'identifier' GROUP BY ALL").fetchall())
    top = sorted(tuple(r) for r in syntax.top_level(rows).select("file", "place", "kind", "digest").collect())
    assert top == sorted(con.sql("SELECT file, row_number() OVER (PARTITION BY file ORDER BY node)::INT, kind, digest FROM n WHERE parent = 0").fetchall())
    places = rows.where("kind = 'identifier'").select("file", F.xxhash64("file", "node").alias("id"), F.col("node").alias("at"), "start", "end")
    covered = syntax.around(places, rows.where("kind = 'call' or statement")).join(places.select("id", "at"), "id").select("file", "at", "node")
    assert sorted(map(tuple, covered.collect())) == sorted(con.sql("SELECT a.file, a.node, b.node FROM n a JOIN n b ON a.file = b.file AND b.start <= a.start AND b.\"end\" >= a.\"end\" WHERE a.kind = 'identifier' AND (b.kind = 'call' OR b.statement)").fetchall())


def test_facts(spark):
    assert table(spark, {"a": "def broken(:\n"}).count() == 0
    rows = syntax.facts(table(spark, {"a": "import os\ndef helper():\n    pass\ndef test_helper():\n    helper()\n"})).orderBy("start_byte").collect()
    assert [(r.role, r.name, r.signature) for r in rows] == [("import", None, "import os"), ("declaration", "helper", "def helper():"), ("test_declaration", "test_helper", "def test_helper():"), ("call", "helper", "helper()")]


def test_control_flow(spark):
    cases = [("def f(x):\n    return x\n", 0, None), ("def f(x):\n    if x:\n        return [i for i in x if i]\n", 2, None), ("def f():\n    def g(): pass\n", None, "nested_definition"), ("def h(): pass\n", None, "baseline_owner_unavailable"), ("def (", None, "source_syntax_invalid")]
    rows = spark.createDataFrame([(i, a, a, "f") for i, (a, _, _) in enumerate(cases)], "id bigint, before string, after string, symbol string")
    got = {r.id: (r.before_points, r.reason) for r in syntax.control_flow_changes(rows, syntax.sides(rows)).collect()}
    assert got == {i: (n, why) for i, (_, n, why) in enumerate(cases)}


def test_reflection(spark):
    rows = table(spark, {"a.py": 'getattr(m, "alpha")\n', "b.py": 'x = "alpha"\n', "c.py": 'getattr("alpha", x)\n'})
    assert [tuple(r) for r in syntax.reflective_uses(rows, spark.createDataFrame([("alpha",), ("beta",)], "symbol string")).collect()] == [("a.py", "alpha")]


def test_roles_of_places(spark):
    words = [("a.b", 0), ("Box", 0), ("open", 0), ("limit", 0), ("size", 0), ("self", 1), ("lid", 0)]
    hits = []
    for i, (word, nth) in enumerate(words):
        at = -1
        for _ in range(nth + 1):
            at = BOX.index(word, at + 1)
        at = len(BOX[:at].encode())
        hits.append(("box.py", i, at, at + len(word), word))
    df = spark.createDataFrame([*hits, ("bad.py", 99, 0, 3, "def")], "file string, id bigint, start bigint, end bigint, match_text string")
    got = {r.id: r for r in syntax.roles(df, table(spark, {"box.py": BOX, "bad.py": "def (:"})).collect()}
    assert set(got) == set(range(len(words)))
    assert (got[0].role, got[0].anchor, got[0].symbol_kind, got[0].symbol_name, got[0].symbol_start, got[0].symbol_end) == ("import", "a.b as c", "module", "<module>", 1, 9)
    assert [(got[i].role, got[i].anchor) for i in (1, 2, 4)] == [("definition", "Box"), ("definition", "open"), ("assignment", "size")]
    assert (got[3].role, got[3].anchor, got[3].subject, got[3].statement, got[3].symbol_name) == ("call", "limit", "limit(2)", "size = limit(2)", "Box")
    assert (got[5].role, got[5].anchor) == ("assignment", "self.n")
    assert (got[6].role, got[6].anchor, got[6].subject, got[6].statement, got[6].symbol_name) == ("reference", "lid", "lid", "return lid", "open")


def test_replacements(spark):
    text = "def f(a):\r\n    if a:\r\n        b = 1\r\n        c = 2\r\n    return a\r\n"
    many = "def f():\n" + "".join(f"    v{i} = {i}\n" for i in range(20))
    cases = [
        (text, "f", "b = 1\n        c = 2", "d = 3\ne = 4"), (text, "f", text.strip(), "x"), (text, "f", "return a", "return a"), (text, "g", "a", "b"), (text, "f", "= 1\n        c", "b"),
        (text + "x\n", "f", "b = 1", "z\nz"), (many, "f", "\n".join(f"    v{i} = {i}" for i in range(17)), "pass"), (text, "f", "a", "b"), (text, "f", "none", "b"), (text, "f", " ", "b"), (text, "f", "b = 1", "x\ry"),
        ("é = 'ü'\ndef f():\n    é = 1\n    return é\n", "f", "é = 1", "ö = 2\nä = 3"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id bigint, source string, symbol string, before string, replacement string")
    files = node_table(df.select(F.col("id").cast("string").alias("file"), "source"))
    got = {r.id: r for r in syntax.replacements(df, files).collect()}
    assert [got[i].reason for i in range(len(cases))] == [
        "ok", "ok", "no_change", "owner_unavailable", "mutation_slice_not_structural", "mutation_source_eol_mixed", "mutation_slice_too_wide", "mutation_slice_ambiguous", "mutation_slice_not_exact", "mutation_before_empty", "mutation_fragment_invalid", "ok",
    ]
    assert (got[0].envelope, got[0].after) == ("siblings", text.replace("b = 1\r\n        c = 2", "d = 3\r\n        e = 4")) and got[1].envelope == "owner"
    assert got[11].after == "é = 'ü'\ndef f():\n    ö = 2\n    ä = 3\n    return é\n" and got[11].start_byte == len("é = 'ü'\ndef f():\n    ".encode())


def test_top_level_conservation(spark):
    a = "a = 1\n@mark\ndef f():\n    return 1\n# note\n"
    edit = (a.index("return"), a.index("return") + 8)
    cases = [(a.replace("return 1", "return 2"), True), (a.replace("a = 1", "a = 2"), False), (a.replace("# note", "# other"), False), (a.replace("# note\n", ""), False), (a.replace("a = 1", "import a"), False), ("def (:", False)]
    rows = [(i, a, b, [edit[0]], [edit[1]]) for i, (b, _) in enumerate(cases)]
    # a decorator that no edit touches
    c = "@a\ndef g():\n    pass\n" + a
    rows.append((90, c, c.replace("@a", "@b"), [len(c) - 5], [len(c) - 1]))
    df = spark.createDataFrame(rows, "id bigint, before string, after string, starts array<int>, ends array<int>")
    got = {r.id: r["pass"] for r in syntax.conservation_checks(df, syntax.sides(df)).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(cases)} | {90: False}


# --- closures ---------------------------------------------------------------------------


def links(spark, files):
    df = spark.createDataFrame([(f, x, len(x)) for f, x in files.items()], "file string, source string, n_bytes bigint")
    rows = graph.resolved(imports.all_imports(df, plain_lines(df)), df)
    pairs = F.explode(F.arrays_zip("local", "source")).alias("p")
    return df, rows, rows.select(F.col("file").alias("importer"), "target", "status", pairs).select("importer", "target", "status", F.col("p.local").alias("local"), F.col("p.source").alias("source"))


def verdicts(spark, files, asked, **options):
    df, rows, bindings = links(spark, files)
    sources = spark.createDataFrame(asked, "file string, symbol string")
    edges = rows.where("status = 'resolved' and file <> target").select(F.col("file").alias("importer"), "target", F.col("source").alias("sources"))
    found, verdict = closure.closures(bindings, sources, members=closure.member_uses(edges, closure.mentions(df, sources)), **options)
    return {(r.file, r.symbol, r.importer) for r in found.collect()}, {(r.file, r.symbol): r.reason for r in verdict.collect()}


def test_closures_of_many_symbols(spark):
    files = {"m.py": "def f(): pass\ndef g(): pass\n", "n.py": "from m import f, g as h\n", "o.py": "from n import f\n", "p.py": "import m\nm.g()\n", "q.py": "from .gone import lost\n", "r.py": "from r import f\n"}
    found, why = verdicts(spark, files, [("m.py", "f"), ("n.py", "f"), ("m.py", "g"), ("m.py", "lost"), ("x.py", "f"), ("m.py", "none")], indexed=spark.createDataFrame([(f,) for f in files], "file string"))
    assert why == {("m.py", "f"): None, ("n.py", "f"): None, ("m.py", "g"): "closure_member_binding_unsupported", ("m.py", "lost"): "closure_import_unresolved", ("x.py", "f"): "closure_index_incomplete", ("m.py", "none"): None}
    assert found == {("m.py", "f", "n.py"), ("m.py", "f", "o.py"), ("n.py", "f", "o.py")}
    # a name inside a longer word counts, as it cannot be told apart
    _, why = verdicts(spark, files | {"p.py": "import m\nm.gee()\n"}, [("m.py", "g")])
    assert why == {("m.py", "g"): "closure_member_binding_unsupported"}


def test_closure_guards(spark):
    files = {"m.py": "def f(): pass\n", **{f"u{i}.py": "from m import f\n" for i in range(4)}}
    df, rows, bindings = links(spark, files)
    one = spark.createDataFrame([("m.py", "f")], "file string, symbol string")
    reason = lambda **o: closure.closures(bindings, one, **o)[1].head().reason
    assert reason() is None and reason(most_bindings=4) is None
    assert reason(most_bindings=3) == "closure_binding_budget_exceeded"
    assert reason(most_bindings=32, most_states=3) == "closure_state_budget_exceeded"
    assert reason(current=bindings) is None and reason(current=bindings.where("importer <> 'u2.py'")) == "closure_source_validation_failed"
    assert reason(unsupported=spark.createDataFrame([("f",)], "symbol string")) == "closure_unsupported_import_syntax"
    loose = bindings.unionByName(spark.createDataFrame([("z.ts", None, "ambiguous", "f", "f")], bindings.schema))
    assert closure.closures(loose, one)[1].head().reason == "closure_import_ambiguous"
    # a circle ends
    ring = {"a.py": "from c import f\n", "b.py": "from a import f\n", "c.py": "from b import f\ndef f(): pass\n"}
    found, why = verdicts(spark, ring, [("c.py", "f")])
    assert why == {("c.py", "f"): None} and {x[2] for x in found} == {"a.py", "b.py", "c.py"}


# --- renames ----------------------------------------------------------------------------

FREIGHT = {
    "freight.py": "def quote(x):\n    return x\n\ndef twice(x):\n    return quote(quote(x))\n", "desk.py": "from freight import (\n    quote,\n)\n\ndef ask(quote_all):\n    return quote(1).quote\n",
    "nick.py": "from freight import quote as q\n\ndef go():\n    return q(3)\n", "far.py": "def quote(y):\n    return y\n",
}


def renames(spark, cases, **options):
    """All cases at once, each in a folder and with names of its own: [(files, request fields)] -> [(reason, files after)]."""
    files, requests, seen = {}, [], []
    for i, (texts, o) in enumerate(cases):
        own = lambda x, i=i: x.replace("quote", f"quote_{i}_").replace("from freight", "from .freight").replace("freight.quote", f"c{i}.freight.quote").replace("import freight", f"import c{i}.freight")
        files |= {f"c{i}/{f}": own(x) for f, x in texts.items()}
        allowed = [f"c{i}/{f}" for f in o.get("allowed", texts)]
        requests.append((i, f"c{i}/{o.get('file', 'freight.py')}", own(o.get("symbol", "quote")), own(o.get("new", "price")), allowed))
        seen += [(i, n) for n in o.get("evidence", [1])]
    df, rows, bindings = links(spark, files)
    rows = rows.cache()
    request = spark.createDataFrame(requests, "id bigint, file string, symbol string, new_name string, allowed array<string>")
    edges = rows.where("status = 'resolved' and file <> target").select(F.col("file").alias("importer"), "target", F.col("source").alias("sources"))
    found, verdict = closure.closures(bindings.cache(), request, members=closure.member_uses(edges, closure.mentions(df, request)))
    all_nodes = node_table(df).cache()
    edits, why = rename.lowered(request, all_nodes, found, verdict, rows, evidence=spark.createDataFrame(seen, "id bigint, line bigint"), **options)
    after = {(r.id, r.file): r.after for r in rename.applied(edits, df).collect()}
    text = {f: after.get((int(f[1 : f.index("/")]), f), x) for f, x in files.items()}
    leaves = lambda n: syntax.identifier_leaves(n).withColumn("id", F.regexp_extract("file", r"^c(\d+)/", 1).cast("bigint"))
    new_nodes = node_table(spark.createDataFrame(list(text.items()), "file string, source string"))
    assert all(r["pass"] for r in rename.conservation(request, edits, leaves(all_nodes), leaves(new_nodes)).collect())
    reasons = {r.id: r.reason for r in why.collect()}
    plain = lambda i, x: x.replace(f"quote_{i}_", "quote").replace("from .freight", "from freight").replace(f"c{i}.freight", "freight")
    return [(reasons[i], {f.split("/")[1]: plain(i, x) for (k, f), x in after.items() if k == i}) for i in range(len(cases))], text


TARGET = FREIGHT["freight.py"]
BOXES = {"box.py": "class Box:\n    def lid(self):\n        return 1\n    def shut(self):\n        return self.lid()\n\nclass Other:\n    def lid2(self):\n        return self.lid\n"}


def test_renames(spark):
    inner = FREIGHT | {"desk.py": "from freight import quote\n\ndef ask(quote):\n    return quote\n\ndef go(x=1):\n    return [quote(i) for i in x]\n"}
    got, text = renames(spark, [(FREIGHT, {"evidence": [1, 60]}), (inner, {}), (BOXES, {"symbol": "lid", "new": "top", "file": "box.py"}), (FREIGHT, {"new": "quote"})])
    assert got[0] == ("ok", {
        "freight.py": TARGET.replace("quote", "price"), "desk.py": "from freight import (\n    price,\n)\n\ndef ask(quote_all):\n    return price(1).quote\n", "nick.py": FREIGHT["nick.py"].replace("import quote", "import price"),
    })
    # an inner scope of an importer that binds the name keeps its own
    assert got[1][0] == "ok" and got[1][1]["desk.py"] == "from freight import price\n\ndef ask(quote):\n    return quote\n\ndef go(x=1):\n    return [price(i) for i in x]\n"
    assert got[2] == ("ok", {"box.py": BOXES["box.py"].replace("def lid(", "def top(").replace("self.lid()", "self.top()")})
    assert got[3] == ("no_change", {})
    # the closure of the new name is the old one, renamed
    found, why = verdicts(spark, {f: x for f, x in text.items() if f.startswith("c0/")}, [("c0/freight.py", "price")])
    assert why == {("c0/freight.py", "price"): None} and {x[2] for x in found} == {"c0/desk.py", "c0/nick.py"}


REJECTED = [
    ("mutation_contract_invalid", {}, {"new": "1x"}), ("symbol_not_found", {}, {"symbol": "none"}), ("symbol_not_found", {"freight.py": "quote = 1\n"}, {}), ("symbol_ambiguous", {"freight.py": TARGET + "def quote(z):\n    pass\n"}, {}),
    ("rename_binding_unsupported", {"freight.py": TARGET + "def g():\n    global quote\n"}, {}), ("rename_binding_ambiguous", {"freight.py": TARGET + "def g(quote):\n    pass\n"}, {}), ("rename_binding_ambiguous", {"freight.py": TARGET + "def g():\n    quote = 1\n"}, {}),
    ("rename_binding_ambiguous", {"desk.py": "from freight import quote\n\ndef go():\n    return quote\n\nquote = 1\n"}, {}), ("rename_scope_incomplete", {}, {"allowed": ["freight.py", "desk.py"]}), ("rename_scope_incomplete", {"z.py": "from .gone import quote\n"}, {}),
    ("rename_binding_unsupported", {"z.py": "import freight\nfreight.quote(1)\n"}, {}), ("rename_destination_not_fresh", {}, {"new": "go"}), ("rename_reflective_builtin_unsupported", {"far.py": "def g(o):\n    return getattr(o, 'quote')\n"}, {}),
    ("rename_scope_too_large", {"freight.py": TARGET + "def g():\n" + "    quote(1)\n" * 12}, {}), ("rename_scope_too_large", {f"v{i}.py": "from freight import quote\n" for i in range(33)}, {}), ("evidence_anchor_missing", {}, {"evidence": []}),
    ("rename_scope_incomplete", {}, {"evidence": [200]}), ("rename_import_validation_failed", {"nick.py": "from freight import quote as q\ndef (:\n"}, {}), ("rename_context_unsupported", {"freight.py": TARGET + "quote(2)\n"}, {}), ("rename_context_unsupported", {"desk.py": "from freight import quote\nquote(2)\n"}, {}),
    ("rename_binding_ambiguous", {"freight.py": "class A:\n    def quote(self):\n        return x.quote\n", "desk.py": "", "nick.py": ""}, {}),
]


def test_rename_rejections(spark):
    got, _ = renames(spark, [(FREIGHT | change, options) for _, change, options in REJECTED])
    assert [r for r, _ in got] == [r for r, _, _ in REJECTED]
    assert not any(after for _, after in got)
    got, _ = renames(spark, [(FREIGHT | {"desk.py": "from freight import quote\nquote(2)\n"}, {})], module_level=True)
    assert got[0][0] == "ok" and got[0][1]["desk.py"] == "from freight import price\nprice(2)\n"
