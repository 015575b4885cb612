"""Imports of source files: one row per statement (file, line, kind, spec, local, source)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.ship import ship

MOST_BINDINGS, MOST_IMPORTS, MOST_LINES = 16, 192, 64
REMOTE = r"^(?:https?:|//|data:|javascript:|#)|\{\{|\$\{|<%"

# Line patterns of dependency statements; kind, language, expression with the target as group 1.
LINE_RULES = [
    ("rust_mod", "rust", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z_][A-Za-z0-9_]*)\s*;"),
    ("rust_crate_use", "rust", r"^\s*(?:pub\s+)?use\s+crate::([A-Za-z0-9_:]+)"),
    ("c_quote_include", "c_cpp", r'^\s*#\s*include\s+"([^"]+)"'),
    ("html_script", "html", r"""(?i)<script\b[^>]*\bsrc\s*=\s*["']([^"']+)["']"""),
    ("html_link", "html", r"""(?i)<link\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""),
    ("css_import", "css", r"""@import\s+(?:url\(\s*)?["']?([^"')\s;]+)"""),
    ("xml_include", "xml", r"""(?i)<(?:[a-z]+:)?(?:include|import)\b[^>]*\b(?:href|schemaLocation|file|src)\s*=\s*["']([^"']+)["']"""),
    ("docker_copy", "docker", r"(?i)^\s*(?:COPY|ADD)\s+(?:--\S+\s+)*(\S+)\s+\S+"),
    ("sql_include", "sql", r"""(?i)^\s*(?:\\ir?|\.read|source)\s+["']?([^"'\s;]+)"""),
]


def line_imports(lines: DataFrame, language: Column) -> DataFrame:
    """Statements that stand on one line, in all languages but Python and scripts; native."""
    parts, none = [], F.array().cast("array<struct<kind:string,spec:string>>")
    lines = lines.where(language.isin(*{lang for _, lang, _ in LINE_RULES}))  # asked of a file, before it is cut into lines
    for kind, lang, x in LINE_RULES:
        specs = F.regexp_extract_all("text", F.lit(x), F.lit(1))
        named = F.transform(specs, _named(kind))
        parts.append(F.when(language == lang, named).otherwise(none))
    rows = lines.select("file", "line", F.explode(F.concat(*parts)).alias("i")).select("file", "line", F.col("i.kind").alias("kind"), F.col("i.spec").alias("spec"))
    return rows.where(~F.col("spec").rlike(REMOTE) & (F.col("spec") != ""))


def _named(kind: str):
    return lambda spec: F.struct(F.lit(kind).alias("kind"), spec.alias("spec"))


def python_statements(source: str):
    """(line, statement) of imports; brackets and backslashes continue a line."""
    rows = source.splitlines()
    i = 0
    while i < len(rows):
        m = re.match(r"\s*(?:from\s+\S+\s+import\b|import\s+\w)", rows[i])
        if not m:
            i += 1
            continue
        first, stmt = i, re.sub(r"#.*", "", rows[i])
        while (stmt.count("(") > stmt.count(")") or stmt.rstrip().endswith("\\")) and i + 1 < len(rows) and i - first < MOST_LINES - 1:
            i += 1
            stmt = stmt.rstrip().removesuffix("\\") + " " + re.sub(r"#.*", "", rows[i])
        yield first + 1, re.sub(r"[()\s]+", " ", stmt).strip()
        i += 1


def pairs_of(names: str, word: str = "as") -> list[tuple[str, str]]:
    """``a as b, c`` -> (local, source) pairs."""
    out = []
    for item in names.split(","):
        m = re.fullmatch(rf"(?:type\s+)?([A-Za-z_$][\w$]*)(?:\s+{word}\s+([A-Za-z_$][\w$]*))?", item.strip())
        if m:
            out.append((m[2] or m[1], m[1]))
    return out[:MOST_BINDINGS]


def python_imports(source: str) -> list[tuple]:
    out = []
    for line, stmt in python_statements(source):
        m = re.match(r"from (\S+) import (.*)", stmt)
        if m:
            out.append((line, "python_from", m[1], pairs_of(m[2])))
            continue
        for item in stmt.removeprefix("import ").split(","):
            m = re.fullmatch(r"\s*([\w.]+)(?:\s+as\s+(\w+))?\s*", item)
            if m:
                out.append((line, "python_import", m[1], [(m[2] or m[1].split(".")[0], m[1])]))
    return out[:MOST_IMPORTS]


SCRIPT_IMPORT = re.compile(r"""(?m)^[ \t]*(?:import|export)\s+(?:type\s+)?((?:[\w$*\s{},]|\bas\b)+?)\s*from\s*["']([^"']+)["']|^[ \t]*import\s*["']([^"']+)["']""")
SCRIPT_REQUIRE = re.compile(r"""(?m)(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*require\(\s*["']([^"']+)["']\s*\)""")


def script_imports(source: str) -> list[tuple]:
    """Relative imports of JavaScript and TypeScript."""
    found = [(m.start(), "js_relative_import", m[2] or m[3], m[1] or "", "as") for m in SCRIPT_IMPORT.finditer(source)]
    found += [(m.start(), "js_require", m[2], m[1], ":") for m in SCRIPT_REQUIRE.finditer(source)]
    out = []
    for at, kind, spec, names, word in sorted(found):
        if not spec.startswith("."):
            continue
        pairs = []
        star = re.search(r"\*\s+as\s+([\w$]+)", names)
        braces = re.search(r"\{([^}]*)\}", names, re.S)
        if star:
            pairs.append((star[1], "*"))
        if braces:
            pairs += pairs_of(re.sub(r"\s+", " ", braces[1]).replace(":", " : ") if word == ":" else re.sub(r"\s+", " ", braces[1]), word)
        lead = re.match(r"\s*([A-Za-z_$][\w$]*)\s*(?:,|$)", names)
        if lead and not star:
            pairs.insert(0, (lead[1], "default" if kind == "js_relative_import" else lead[1]))
        out.append((source.count("\n", 0, at) + 1, kind, spec, pairs[:MOST_BINDINGS]))
    return out[:MOST_IMPORTS]


def statement_imports(files: DataFrame, language: Column) -> DataFrame:
    """Python and script imports, which may run over lines: a fold over each file's text."""
    import pandas as pd

    ship(files.sparkSession)
    kind = "file string, line bigint, kind string, spec string, local array<string>, source array<string>"

    def run(batches):
        for pdf in batches:
            rows = []
            for file, lang, source in zip(pdf["file"], pdf["lang"], pdf["source"]):
                for line, k, spec, pairs in python_imports(source) if lang == "python" else script_imports(source):
                    rows.append((file, line, k, spec, [p[0] for p in pairs], [p[1] for p in pairs]))
            yield pd.DataFrame(rows, columns=["file", "line", "kind", "spec", "local", "source"])

    wanted = files.select("file", language.alias("lang"), "source").where("lang in ('python', 'javascript', 'typescript') and source is not null")
    return wanted.mapInPandas(run, kind)


def all_imports(files: DataFrame, lines: DataFrame) -> DataFrame:
    from corvane.functions import paths

    some = line_imports(lines, paths.language(F.col("file")))
    none = F.array().cast("array<string>")
    return statement_imports(files, paths.language(F.col("file"))).unionByName(some.withColumns({"local": none, "source": none}))


def bindings(imports: DataFrame) -> DataFrame:
    """One row per imported name: (file, line, kind, spec, local_name, source_name)."""
    return imports.select("file", "line", "kind", "spec", F.explode(F.arrays_zip("local", "source")).alias("p")).select("file", "line", "kind", "spec", F.col("p.local").alias("local_name"), F.col("p.source").alias("source_name"))
