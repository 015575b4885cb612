"""Facts of Python files with their owners, as fields for ranking, and validity.

Facts come from the node table; a file that does not parse has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.nodes import node_lists, node_table
from corvane.operators import syntax
from corvane.scratch import large
from corvane.ship import ship


def frame(df: DataFrame, columns: list[str], kind: str, one) -> DataFrame:
    """Rows that ``one`` makes of each row's values; schema ``kind``."""
    import pandas as pd

    ship(df.sparkSession)
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [r for values in zip(*(pdf[c] for c in columns)) for r in one(*values)]
            yield pd.DataFrame(rows, columns=names)

    return df.select(*columns).mapInPandas(run, kind)


def python_facts(files: DataFrame) -> DataFrame:
    return syntax.facts(node_table(files, syntax.FACT_COLUMNS, syntax.of_facts, "none"))


def file_facts(files: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """(file, facts): the facts of each file that parses, in one list, with ``owner`` and ``qualified_name``.

    ``roles``: of the facts, those that are wanted; declarations among them.

    The owner is the names of the declarations strictly around a fact, outermost
    first. A file has at most syntax.MOST_FACTS facts, so each is tested against
    the declarations among them; they stay together, so nothing is shuffled.
    """
    every = syntax.fact_list(F.col("nodes"))
    wanted = every if roles is None else F.filter(every, lambda f: f["role"].isin(*roles))
    rows = node_lists(files, syntax.FACT_COLUMNS, syntax.of_facts, "none").select("file", wanted.alias("facts"))

    def declared(facts):
        named = F.filter(facts, lambda f: f["role"].isin("declaration", "test_declaration") & f["name"].isNotNull())
        return F.transform(named, lambda f: F.struct((f["start_byte"] - f["end_byte"]).alias("size"), f["start_byte"].alias("s"), f["name"].alias("name"), f["end_byte"].alias("e")))

    def owner(f, outer):
        start, end = f["start_byte"], f["end_byte"]
        around = F.filter(outer, lambda o: (o["s"] <= start) & (o["e"] >= end) & (o["size"] < start - end))
        names = lambda some: F.array_join(F.transform(F.array_sort(some), lambda o: o["name"]), "::")
        return bound(around, lambda some: F.when(F.size(some) > 1, names(some)).otherwise(F.get(some, F.lit(0))["name"]))

    def owned(f, name):
        whole = F.when(f["name"].isNotNull(), F.concat_ws("::", name, f["name"]))
        return F.struct(*(f[c].alias(c) for c in FACTS), name.alias("owner"), whole.alias("qualified_name"))

    # names of lambdas are made once, so lists are bound by them
    with_names = lambda facts, outer: F.transform(facts, lambda f: bound(owner(f, outer), lambda name: owned(f, name)))
    return large(rows.select("file", bound(F.col("facts"), lambda facts: bound(declared(facts), lambda outer: with_names(facts, outer))).alias("facts")))


#: roles that feed a field of the ranker
RANKED = ["declaration", "test_declaration", "test_call", "comment"]
FACTS = ["role", "node_kind", "name", "signature", "start_line", "end_line", "start_byte", "end_byte"]


def bound(value: Column, then) -> Column:
    """``then`` of a value that is made once, however often it is read."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def owned_facts(files: DataFrame) -> DataFrame:
    """The facts of files with ``owner`` and ``qualified_name``, see file_facts()."""
    return large(file_facts(files).select("file", F.explode("facts").alias("f")).select("file", "f.*"))


def ranker_texts(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(file, field, texts): a declaration feeds symbols twice, a test feeds tests and symbols. ``facts``: file_facts()."""
    def texts(field, *parts):
        lists = (F.transform(F.filter("facts", lambda f: f["role"].isin(*roles)), lambda f: f[text]) for roles, text in parts)
        return F.struct(F.lit(field).alias("field"), F.array_compact(F.concat(*lists)).alias("texts"))

    declared, test = "declaration", "test_declaration"
    fed = F.array(
        texts("symbols", ([declared, test], "name"), ([declared], "qualified_name")), texts("signatures", ([declared, test], "signature")),
        texts("tests", ([test, "test_call"], "name"), ([test], "qualified_name")), texts("comments", (["comment"], "signature")),
    )
    made = facts.select("file", F.explode(fed).alias("f")).select("file", "f.field", "f.texts").where(F.size("texts") > 0)
    path, code = files.select("file", F.lit("path"), F.array("file")), files.where("source is not null").select("file", F.lit("code"), F.array("source"))
    return made.union(path).union(code)  # apart, so that nobody makes a text that is not read


def ranker_fields(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(file, field, text): the texts of ranker_texts(), one by one."""
    return ranker_texts(files, facts).select("file", "field", F.explode("texts").alias("text"))


def python_validity(candidates: DataFrame) -> DataFrame:
    """(id, file, after): Python compiles (it is never run); other languages are only checked for structure."""

    def one(i, file, source):
        if not file.endswith((".py", ".pyi")):
            return [(i, "structural_only", True)]
        try:
            compile(source, file, "exec", dont_inherit=True)
        except (SyntaxError, ValueError):
            return [(i, "native_enforced", False)]
        return [(i, "native_enforced", True)]

    return frame(candidates, ["id", "file", "after"], "id bigint, coverage string, pass boolean", one)
