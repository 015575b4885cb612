"""Tokens of scripts, and what is read of them."""

from __future__ import annotations

from corvane.functions import script_tokens
from corvane.operators import closure, targets


def kinds(source):
    return [(k, t) for k, t, _ in script_tokens.tokens(source)]


def test_tokens():
    assert kinds("a // }\nb = '}' + \"{\" /* { */") == [("name", "a"), ("comment", "// }"), ("name", "b"), ("punct", "="), ("string", "'}'"), ("punct", "+"), ("string", '"{"'), ("comment", "/* { */")]
    assert kinds("`a ${b + `c${d}`} e` / 2") == [("template", "a "), ("punct", "${"), ("name", "b"), ("punct", "+"), ("template", "c"), ("punct", "${"), ("name", "d"), ("punct", "}"), ("template", ""), ("punct", "}"), ("template", " e"), ("punct", "/"), ("number", "2")]
    assert kinds("x = a / b / c; y = /[/}]{2}\\//g.test(z)")[9:12] == [("punct", "="), ("regex", "/[/}]{2}\\//g"), ("punct", ".")]
    assert kinds("return /}/") == [("name", "return"), ("regex", "/}/")] and kinds("f(a) / 2 / 1")[4] == ("punct", "/")
    assert kinds("`${ {a: 1}.a }`") == [("template", ""), ("punct", "${"), ("punct", "{"), ("name", "a"), ("punct", ":"), ("number", "1"), ("punct", "}"), ("punct", "."), ("name", "a"), ("punct", "}"), ("template", "")]
    assert kinds("'open\nnext }") == [("string", "'open"), ("name", "next"), ("punct", "}")] and kinds("`open") == [("template", "open")] and kinds("/* open") == [("comment", "/* open")] and kinds("") == []
    assert kinds("\x00\ud800é") == [("punct", "\x00"), ("punct", "\ud800"), ("name", "é")]
    for source in ("a?.b => {}", "x = `${`${`a`}`}`", "'\\'' + /\\//", "</div>"):
        at = 0
        for _, text, start in script_tokens.tokens(source):
            assert start >= at and source[start : start + len(text)] == text
            at = start


SCRIPT = """import { a } from './a'
// import b from '@/b'
const t = 'import("./c")' + `import d from "#/d"`
import e from "@/e"
const f = await import('./f'), g = require('./g'), h = require("h")
import './side.css'
export { z } from '@/z'
const u = `${await import('~/u')}`
"""


def test_imports_that_cannot_be_read(spark):
    rows = script_tokens.token_table(spark.createDataFrame([("a.ts", SCRIPT), ("b.ts", "import x from './x'\n"), ("c.ts", None), ("d.ts", "")], "file string, source string"))
    got = sorted((r.file, r.line, r.form, r.spec) for r in script_tokens.specifiers(rows).collect())
    assert got == [("a.ts", 1, "import", "./a"), ("a.ts", 4, "import", "@/e"), ("a.ts", 5, "dynamic", "./f"), ("a.ts", 5, "require", "./g"), ("a.ts", 5, "require", "h"), ("a.ts", 6, "import", "./side.css"), ("a.ts", 8, "dynamic", "~/u"), ("b.ts", 1, "import", "./x")]
    counts = {r.file: tuple(r)[1:] for r in script_tokens.import_counts(rows).collect()}
    assert counts == {"a.ts": (3, 1, 2, 1), "b.ts": (1, 0, 0, 0)}
    odd = script_tokens.unsupported_files(rows)
    assert [r.file for r in odd.collect()] == ["a.ts"]
    texts = spark.createDataFrame([("a.ts", SCRIPT)], "file string, source string").join(odd, "file", "left_semi")
    named = closure.mentions(texts, spark.createDataFrame([("side",), ("mport",), ("absent",)], "symbol string"))
    assert sorted(r.symbol for r in named.collect()) == ["mport", "side"]


def test_brace_scopes(spark):
    source = "function f() { // }\n  const s = '}'\n  if (s) {\n    g(`}${ {a: 1}.a }`, /[}]/)\n  }\n}\nconst c = 1\nclass D {\n  m() {\n"
    lines = list(range(1, 11))
    rows = targets.brace_scopes(spark.createDataFrame([("a.ts", source, lines), ("long.ts", "a {\n" + "x\n" * 400 + "}\n", [1, 100, 180, 182, 300])], "file string, source string, lines array<int>")).collect()
    got = {(r.file[0], r.line): (r.start_line, r.end_line) for r in rows}
    assert [got["a", n] for n in lines] == [(1, 6), (1, 6), (3, 5), (3, 5), (3, 5), (1, 6), (None, None), (8, 10), (9, 10), (9, 10)]
    assert [got["l", n] for n in (1, 100, 180, 182, 300)] == [(1, 180), (1, 180), (1, 180), (None, None), (None, None)]
