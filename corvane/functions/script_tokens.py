"""Tokens of JavaScript and TypeScript as rows: what stands in strings, comments, templates and regular expressions is not code.

One automaton pass a file; statements, braces and counts are joins and windows
over the rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.ship import ship

TOKEN = "file string, n int, kind string, text string, start bigint, line bigint, end_line bigint"
ROWS = 100_000
MOST_TEXT = 500
PART = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))"""
    r"""|(?P<number>\.?\d[\w.]*)|(?P<name>[^\W\d][\w$]*|[$#@][\w$]*)|(?P<template>`)|(?P<slash>/)|(?P<punct>\?\.|=>|[^\s\w])""", re.S,
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
#: names after which a slash begins a regular expression, as after most signs
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}


def tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, place) without white space; a template gives its parts, and what stands in ``${}`` as code."""
    out: list[tuple[str, str, int]] = []
    at, last, open_templates = 0, None, []

    def template(i: int) -> int:
        """The text of a template from i, up to its end or the next piece of code."""
        m = TEMPLATE.match(source, i)
        end = m.end()
        out.append(("template", source[i:end], i))
        if source.startswith("${", end):
            out.append(("punct", "${", end))
            open_templates.append(0)
            return end + 2
        return end + 1

    while at < len(source):
        m = PART.match(source, at)
        if m is None:
            at += 1
            continue
        kind, text = m.lastgroup, m.group()
        if kind == "template":
            at = template(at + 1)
            last = ("string", "`")
            continue
        if kind == "slash":
            divides = last is not None and (last[0] in ("number", "string") or (last[0] == "name" and last[1] not in BEFORE_REGEX) or last[1] in (")", "]", "}"))
            r = None if divides else REGEX.match(source, at)
            kind, text = ("regex", r.group()) if r else ("punct", "/")
        if kind == "punct" and open_templates and text in "{}":
            if text == "}" and open_templates[-1] == 0:
                open_templates.pop()
                out.append(("punct", "}", at))
                at = template(at + 1)
                last = ("string", "`")
                continue
            open_templates[-1] += 1 if text == "{" else -1
        if kind != "space":
            out.append((kind, text, at))
            if kind != "comment":
                last = ("string" if kind == "regex" else kind, text)
        at += len(text)
    return out


def token_table(files: DataFrame) -> DataFrame:
    """(file, source) -> rows of TOKEN; long texts of tokens are clipped."""
    ship(files.sparkSession)
    names = [x.split()[0] for x in TOKEN.split(", ")]

    def run(batches):
        rows = []
        for pdf in batches:
            for file, source in zip(pdf["file"], pdf["source"]):
                line, seen = 1, 0
                for n, (kind, text, start) in enumerate(tokens(source)):
                    line += source.count("\n", seen, start)
                    seen = start
                    rows.append((file, n, kind, text[:MOST_TEXT], start, line, line + text.count("\n")))
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return files.where("source is not null").select("file", "source").mapInPandas(run, TOKEN)


def specifiers(rows: DataFrame) -> DataFrame:
    """(file, line, form, spec) of module names: import, require or dynamic."""
    code = rows.where("kind not in ('comment', 'template')")
    order = Window.partitionBy("file").orderBy("n")
    word = F.when(F.col("kind") == "name", F.col("text"))
    before = lambda i: F.lag("text", i).over(order)
    opened = F.last(F.when(word.isin("import", "export"), F.col("text")), ignorenulls=True).over(order)
    seen = code.withColumns({"one": before(1), "two": before(2), "opened": opened}).where("kind = 'string'")
    form = (
        F.when((F.col("one") == "(") & (F.col("two") == "import"), "dynamic").when((F.col("one") == "(") & (F.col("two") == "require"), "require")
        .when((F.col("one") == "import") | ((F.col("one") == "from") & (F.col("opened") == "import")), "import")
    )
    spec = F.substring(F.col("text"), F.lit(2), F.length("text") - 2)
    return seen.select("file", "line", form.alias("form"), spec.alias("spec")).where("form is not null")


def import_counts(rows: DataFrame) -> DataFrame:
    """(file, n_local, external_package, unsupported_alias, unsupported_dynamic): imports by what can be read of them."""
    spec = F.col("spec")
    local, alias = F.startswith(spec, F.lit(".")), spec.rlike("^[@~#]/")
    dynamic = F.col("form") == "dynamic"
    return specifiers(rows).groupBy("file").agg(
        F.count_if(local & ~dynamic).alias("n_local"), F.count_if(~local & ~alias).alias("external_package"), F.count_if(alias).alias("unsupported_alias"), F.count_if(local & dynamic).alias("unsupported_dynamic")
    )


def unsupported_files(rows: DataFrame) -> DataFrame:
    """Files with imports that cannot be followed: a name in them is no proof of absence."""
    return import_counts(rows).where("unsupported_alias + unsupported_dynamic > 0").select("file")


def brace_pairs(rows: DataFrame) -> DataFrame:
    """(file, start, end, depth): lines of each block of braces; one that is never closed ends with the file.

    Depth is a running sum, and an opening brace closes at the next closing one of its depth.
    """
    order = Window.partitionBy("file").orderBy("n")
    opens = F.col("text").isin("{", "${")
    braces = rows.where("kind = 'punct' and text in ('{', '${', '}')")
    level = F.sum(F.when(opens, 1).otherwise(-1)).over(order)
    braces = braces.withColumn("depth", F.when(opens, level).otherwise(level + 1))
    shut = F.first(F.when(~opens, F.col("line")), ignorenulls=True).over(Window.partitionBy("file", "depth").orderBy("n").rowsBetween(1, Window.unboundedFollowing))
    return braces.withColumn("end", shut).where(opens).select("file", F.col("line").alias("start"), "end", "depth")
