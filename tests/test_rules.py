"""Rules of words, declarations, scopes, facts and caps on lines of our own."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from corvane.functions import queries, text
from corvane.operators import evidence, ranges, scan, targets

LINES = [
    # (line, name, defines it in any language, declared in Python, declared in a language with braces, hint)
    ("export default class Parcel {", "Parcel", True, [], ["Parcel"], 0), ("pub(crate) fn parcel(x: u8) {", "parcel", True, [], [], 0), ("static PARCEL: u8 = 1;", "PARCEL", True, [], [], 0), ("export class Parcel {", "Parcel", True, [], ["Parcel"], 1),
    ("async def parcel(self):", "parcel", True, ["parcel"], [], 1), ("    def parcel(self):", "parcel", True, ["parcel"], [], 1), ("export const parcel = 1", "parcel", True, [], ["parcel"], 0), ("async const parcel = 1", "parcel", True, [], [], 0),
    ("let parcels = parcel", "parcel", False, [], ["parcels"], 0), ("return parcel(1)", "parcel", False, [], [], 0), ("parcel: int = 3", "parcel", False, ["parcel"], [], 0), ("parcel = 3", "parcel", False, ["parcel"], [], 0), ("parcel += 3", "parcel", False, [], [], 0),
    ("private static async parcel(a: string): number {", "parcel", False, [], ["parcel"], 0), ("get(key) {", "get", False, [], ["get"], 0), ("get size() {", "size", False, [], ["size"], 0), ("if (parcel) {", "parcel", False, [], [], 0),
    ("export async function parcel(a) {", "parcel", True, [], ["parcel"], 1), ("interface Parcel {", "Parcel", True, [], ["Parcel"], 1), ("pub struct Parcel {", "Parcel", True, [], [], 0), ("trait Parcel {", "Parcel", True, [], [], 1), ("enum Parcel {", "Parcel", True, [], ["Parcel"], 1),
    ("parcel(a; b)", "parcel", False, [], [], 0), ("", "parcel", False, [], [], 0), ("classic = 1", "classic", False, ["classic"], [], 0),
]


def test_declarations(spark):
    df = spark.createDataFrame([(i, x, n) for i, (x, n, *_) in enumerate(LINES)], "i int, line string, name string")
    line = F.col("line")
    rows = df.select("i", text.declares(line, F.col("name")), text.declared_symbols(line, "python"), text.declared_symbols(line, "typescript"), text.declaration_hint(line)).collect()
    got = {r[0]: tuple(r[1:]) for r in rows}
    for i, (line, _, *want) in enumerate(LINES):
        want[0] = want[0] or line == "async const parcel = 1"
        assert got[i] == tuple(want), line


def test_path_words(spark):
    df = spark.createDataFrame([("http_server getValue 404", "a/fooBar-baz.py x1 ab")], "a string, b string")
    assert df.select(text.path_tokens(F.col("a"))).head()[0] == ["http_server", "http", "server", "getvalue", "get", "value"]
    assert df.select(text.path_tokens(F.col("b"))).head()[0] == ["foobar-baz", "foo", "bar", "baz"]
    assert df.select(queries.rank_terms(F.array("a", "a", "b"))).head()[0] == ["http_server", "http", "server", "getvalue", "get", "value", "foobar-baz", "foo", "bar", "baz"]


def test_caps_on_equal_rows(spark):
    for n, cap, capped in ((1001, 1000, True), (3000, 1000, True), (1000, 1000, False), (30, 50, False)):
        rows = scan.scan_lines(spark.createDataFrame([("f", 1, "x")] * n, "file string, line bigint, text string"), ["x"], cap).collect()
        assert len(rows) == min(n, cap) and {r.capped for r in rows} == {capped}


def test_facts_are_counted_by_their_own_kinds(spark):
    hits = spark.createDataFrame([("f", 1, 0), ("f", 1, 1), ("f", 2, 0)], "file string, line bigint, query int")
    absent = spark.createDataFrame([(2, True)], "query int, absent boolean")
    facts = evidence.fact_keys(hits).select("key").union(evidence.negative_facts(absent).select("key"))
    assert {r.kind: r.n for r in evidence.fact_summary(facts).collect()} == {"positive": 2, "context": 2, "negative": 1}


def naive_scope(lines, n):
    """The scope around line n (from 1), by a walk up and a walk down."""
    indent = lambda x: len(re.match(r"[ \t]*", x)[0].replace("\t", "    "))
    start = next((i for i in range(n, max(0, n - 181), -1) if re.match(r"\s*(async +def|def|class) +\w", lines[i - 1]) and indent(lines[i - 1]) <= indent(lines[n - 1])), None)
    if start is None:
        return max(1, n - 12), min(len(lines), n + 12)
    last = min(len(lines), start + 179)
    for i in range(start + 1, last + 1):
        x = lines[i - 1]
        if x.strip() and not x.strip().startswith(("#", "@")) and indent(x) <= indent(lines[start - 1]):
            return start, i - 1
    return start, last


def test_scopes_against_a_walk(spark):
    r, files = random.Random(8), {}
    for f in range(4):
        rows, depth = [], 0
        for _ in range(r.choice([40, 500])):
            depth = max(0, min(5, depth + r.choice([-2, -1, 0, 0, 0, 1])))
            rows.append(" " * (4 * depth) + r.choice(["x = 1"] * 12 + ["def f(a):", "class A:", "async def g():", "# note", "@mark", "return"]) if r.random() < 0.9 else r.choice(["", "# far left", "\t"]))
        files[f"f{f}.py"] = "\n".join(rows)
    files["long.py"] = "def f():\n" + "    x = 1\n" * 400 + "y = 2"
    files["plain.py"] = "x = 1\n" * 30
    df = spark.createDataFrame(list(files.items()), "file string, source string")
    hits = [(f, n) for f, x in files.items() for n in range(1, x.count("\n") + 2)]
    got = {(x.file, x.line): (x.start, x.end) for x in targets.hit_scopes(spark.createDataFrame(hits, "file string, line bigint"), df).collect()}
    assert got == {(f, n): naive_scope(files[f].split("\n"), n) for f, n in hits}


def test_greedy_budget_of_a_large_group(spark):
    """Equal to the fold over one group of many rows and many small ones; costs over the budget are passed over."""
    r = random.Random(5)
    rows = [(0, i, r.choice([1, 3, 50, 400, 2000])) for i in range(60_000)] + [(1 + i % 50, i, r.choice([0, 5, 700, 900])) for i in range(2000)]
    want = set()
    for g in range(51):
        left = 1000
        for _, i, c in sorted(x for x in rows if x[0] == g):
            if c <= left:
                left -= c
                want.add((g, i))
    df = spark.createDataFrame(rows, "g int, i int, c int").repartition(5)
    assert {(x.g, x.i) for x in ranges.greedy_budget(df, ["g"], ["i"], F.col("c"), 1000).collect()} == want
    one = df.where("g = 0")
    assert {x.i for x in ranges.greedy_budget(one, [], ["i"], F.col("c"), 1000).collect()} == {i for g, i in want if g == 0}
