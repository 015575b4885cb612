"""Structural joins over the node table: facts, roles of hits, checks and edits of Python files.

Nothing here parses; see corvane/functions/nodes.py for the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.nodes import COLUMNS, Part, Wanted, node_table
from corvane.operators import ranges
from corvane.scratch import kept, large

DEFINITIONS = ["function_definition", "class_definition"]
ACTS = ["import_statement", "import_from_statement", "call", "assignment"]
# Clips of what is told, the widest run of siblings, syntax that adds one point of control flow each,
# and calls that reach a name through a string.
MOST_FACTS, MOST_SIGNATURE, MOST_ANCHOR, MOST_SUBJECT, MOST_SIBLINGS = 512, 320, 200, 320, 16
BRANCHES = ["If", "For", "AsyncFor", "While", "ExceptHandler", "IfExp", "match_case", "comprehension"]
REFLECTIVE = ["getattr", "setattr", "hasattr", "delattr"]
TEST_CALLS = ["test", "it", "describe", "suite"]


# What the joins below read of the node table: parsing makes no more than that if it is told so.
FACT_COLUMNS = ["file", "node", "kind", "name", "head", "start_line", "end_line", "start", "end"]
ROLE_COLUMNS = ["file", "node", "parent", "kind", "statement", "name", "use", "head", "first_line", "start", "end", "start_line", "end_line"]
TOP_COLUMNS = ["file", "node", "parent", "kind", "digest", "start", "end"]
FLOW_COLUMNS = ["file", "node", "last", "kind", "name"]
SLICE_COLUMNS = ["file", "parent", "kind", "field", "nth", "name", "start", "end"]


# Parts of the node table that the joins below read: of the others parsing makes none if it is told so.
of_facts = Wanted("function_definition", "class_definition", "import_statement", "import_from_statement", "call", "comment")
of_roles = Wanted("module", *DEFINITIONS, *ACTS, statements=True, do=("definition",))
of_top = Wanted(within="top")
of_flow = Wanted("module", *DEFINITIONS, *BRANCHES)
of_functions = Wanted("function_definition", within="statements")
of_reflection = Wanted("call", "string")
of_names = Wanted("identifier")


FACT_KINDS = [*DEFINITIONS, "import_statement", "import_from_statement", "call", "comment"]


def _fact(get: Callable[[str], Column]) -> list[Column]:
    """The columns of a fact of a node, whose parts ``get`` gives."""
    kind, name = get("kind"), get("name")
    test = F.startswith(name, F.lit("test_")) | F.startswith(name, F.lit("Test"))
    role = (
        F.when(kind.isin(*DEFINITIONS), F.when(test, "test_declaration").otherwise("declaration")).when(kind.isin("import_statement", "import_from_statement"), "import")
        .when(kind == "call", F.when(F.substring_index(name, ".", 1).isin(*TEST_CALLS), "test_call").otherwise("call")).when(kind == "comment", "comment")
    )
    return [
        role.alias("role"), kind.alias("node_kind"), F.when(kind.isin(*DEFINITIONS, "call"), F.left(name, F.lit(160))).alias("name"), F.left(get("head"), F.lit(MOST_SIGNATURE)).alias("signature"),
        get("start_line").alias("start_line"), get("end_line").alias("end_line"), get("start").alias("start_byte"), get("end").alias("end_byte"),
    ]


def facts(nodes: DataFrame) -> DataFrame:
    """(file, role, node_kind, name, signature, start_line, end_line, start_byte, end_byte): each file's first MOST_FACTS."""
    rows = nodes.where(F.col("kind").isin(*FACT_KINDS) & (F.col("head") != ""))
    first = F.row_number().over(Window.partitionBy("file").orderBy("node"))
    return rows.withColumn("first", first).where(F.col("first") <= MOST_FACTS).select("file", *_fact(F.col))


def fact_list(nodes: Column) -> Column:
    """The same of the list of a file's nodes, in their order."""
    first = F.slice(F.filter(nodes, lambda n: n["kind"].isin(*FACT_KINDS) & (n["head"] != "")), 1, MOST_FACTS)
    return F.transform(first, lambda n: F.struct(*_fact(lambda c: n[c])))


def around(places: DataFrame, nodes: DataFrame, longest: int | None = None, more: Sequence[str] = ()) -> DataFrame:
    """Places (file, id, start, end, and what ``more`` names) with every node of the file that covers them."""
    inner = places.select("file", F.col("id").alias("i_id"), F.col("start").alias("i_start"), F.col("end").alias("i_end"), *more)
    outer = nodes.withColumnsRenamed({"start": "o_start", "end": "o_end"}).withColumn("o_id", F.col("node"))
    return ranges.containing(inner, outer, longest=longest).withColumnsRenamed({"i_id": "id", "i_start": "start", "i_end": "end"}).drop("o_id")


def roles(hits: DataFrame, nodes: DataFrame, longest: int | None = None, more: Sequence[str] = ()) -> DataFrame:
    """(file, id, start, end, match_text) -> id, role, anchor, subject, statement, symbol_kind, symbol_name, symbol_start, symbol_end.

    The innermost definition is the symbol; the innermost import, call or
    assignment inside it is what the hit does. Hits of files that do not parse
    have no row. ``longest``: bytes that no file exceeds, if known. Columns of
    the hits in ``more`` go along, so that hits are read once.
    """
    kind = F.col("kind")
    of_use = nodes.where(kind.isin("module", *DEFINITIONS, *ACTS) | F.col("statement") | (F.col("use") == "definition"))
    row = F.struct("node", "kind", "name", "head", "first_line", "start_line", "end_line", "parent")
    inmost = lambda c: F.max(F.when(c, row))
    per = around(hits, of_use, longest, ["match_text", *(c for c in more if c not in ("file", "match_text"))]).groupBy("id", "match_text", *(c for c in more if c != "match_text")).agg(
        inmost(kind == "module").alias("module"), inmost(kind.isin(*DEFINITIONS)).alias("symbol"), inmost(kind.isin(*ACTS)).alias("act"),
        inmost(F.col("statement")).alias("inner"), inmost(F.col("use") == "definition").alias("named"),
    )
    rows = per.withColumn("match", F.left(F.trim(F.regexp_replace("match_text", r"(?U)\s+", " ")), F.lit(MOST_ANCHOR))).where("match <> ''")
    defines = F.coalesce(F.col("named.parent") == F.col("symbol.node"), F.lit(False))
    acts = F.coalesce(F.col("act.node") > F.coalesce(F.col("symbol.node"), F.lit(-1)), F.lit(False))
    role = F.when(defines, "definition").when(acts, F.when(F.startswith("act.kind", F.lit("import")), "import").otherwise(F.col("act.kind"))).otherwise("reference")
    subject = F.left(F.when(defines, F.col("symbol.first_line")).when(acts, F.col("act.head")).otherwise(F.col("match")), F.lit(MOST_SUBJECT))
    other = F.col("inner.node").isNotNull() & ~F.col("inner.node").eqNullSafe(F.col("symbol.node"))
    told = lambda c, module: F.coalesce(F.col(f"symbol.{c}"), module)
    return rows.select(
        "id", *more, role.alias("role"), F.left(F.when(defines, F.col("symbol.name")).when(acts, F.col("act.name")).otherwise(F.col("match")), F.lit(MOST_ANCHOR)).alias("anchor"), subject.alias("subject"),
        F.when(defines | ~other, subject).otherwise(F.col("inner.head")).alias("statement"), told("kind", F.lit("module")).alias("symbol_kind"), told("name", F.lit("<module>")).alias("symbol_name"),
        told("start_line", F.lit(1)).alias("symbol_start"), told("end_line", F.col("module.end_line")).alias("symbol_end"),
    )


def top_level(nodes: DataFrame, key: str = "file") -> DataFrame:
    """(key, place, kind, digest, start, end) of the parts right below the module: statements, decorated definitions and comments."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("node"))
    return nodes.where("parent = 0").select(key, place.alias("place"), "kind", "digest", "start", "end")


def sides(candidates: DataFrame, columns: list[str] | None = None, only: Callable[[Part], bool] | None = None, names: str = "all") -> DataFrame:
    """The node table of both sources of candidates (id, before, after), with ``id`` and ``side`` in place of the file; see node_table."""
    side = F.explode(F.array(F.struct(F.lit("b").alias("side"), F.col("before").alias("source")), F.struct(F.lit("a").alias("side"), F.col("after").alias("source"))))
    files = candidates.select("id", side.alias("s")).select(F.concat("s.side", F.col("id").cast("string")).alias("file"), "s.source")
    return node_table(files, columns or COLUMNS, only, names).withColumn("side", F.left("file", F.lit(1))).withColumn("id", F.substr("file", F.lit(2)).cast("bigint"))


def conservation_checks(candidates: DataFrame, both: DataFrame) -> DataFrame:
    """(id, before, after, starts, ends) of edited byte ranges -> id, kind, pass.

    Both files have the same top-level parts in kind and number, and those that
    no edit touches are equal in every byte, comments and decorators included.
    """
    # both sides are read once: the module is the first part of a side, those right below it follow, and meet by place
    place = F.row_number().over(Window.partitionBy("id", "side").orderBy("node"))
    parts = both.where("node = 0 or parent = 0").repartition("id").select("id", "side", place.alias("place"), F.struct("kind", "digest", "start", "end").alias("part"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("part")))
    rows = parts.groupBy("id", "place").agg(of("b").alias("old"), of("a").alias("new")).join(candidates.select("id", F.arrays_zip("starts", "ends").alias("edits")), "id")
    touched = F.exists("edits", lambda e: (e["starts"] < F.col("old.end")) & (e["ends"] > F.col("old.start")))
    good = F.coalesce((F.col("old.kind") == F.col("new.kind")) & (touched | (F.col("old.digest") == F.col("new.digest"))), F.lit(False))
    module = F.col("place") == 1
    both_parsed = F.bool_and(F.when(module, F.col("old").isNotNull() & F.col("new").isNotNull()))
    per = rows.groupBy("id").agg(both_parsed.alias("parsed"), F.count_if(~module & ~good).alias("bad"))
    out = candidates.select("id").join(per, "id", "left")
    return out.select("id", F.lit("top_level_conservation").alias("kind"), F.coalesce(F.col("parsed") & (F.col("bad") == 0), F.lit(False)).alias("pass"))


def target_checks(candidates: DataFrame, both: DataFrame) -> DataFrame:
    """(id, kind, symbol, new_name): one function stays one, or becomes that of the new name."""
    rows = both.where("kind = 'function_definition'").select("id", "side", "name").join(candidates.select("id", "symbol", "new_name"), "id")
    count = lambda side, name: F.count_if((F.col("side") == side) & (F.col("name") == F.col(name)))
    per = rows.groupBy("id").agg(count("b", "symbol").alias("before_n"), count("a", "symbol").alias("after_n"), count("a", "new_name").alias("new_n"))
    stays = (F.col("before_n") == 1) & (F.col("after_n") == 1)
    renamed = (F.col("before_n") == 1) & (F.col("after_n") == 0) & (F.col("new_n") == 1)
    ok = F.when(F.col("kind") == "rename_symbol", renamed).otherwise(stays)
    return candidates.select("id", "kind").join(per, "id", "left").select("id", F.lit("target_cardinality").alias("kind"), F.coalesce(ok, F.lit(False)).alias("pass"))


def control_points(nodes: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """(key, symbol) -> key, n, nested, points, of files that parse: the definitions of the symbol, and what lies in the first."""
    definition, branch = F.col("kind").isin(*DEFINITIONS), F.col("kind").isin(*BRANCHES)
    rows = nodes.where((F.col("node") == 0) | definition | branch).select(*key, "node", "last", "kind", "name").join(asked.select(*key, "symbol"), key)
    own, by = definition & (F.col("name") == F.col("symbol")), Window.partitionBy(*key)
    # a file has one such range, so this is one pass over its nodes
    rows = rows.withColumns({"own": F.count_if(own).over(by), "d": F.min(F.when(own, F.struct("node", "last"))).over(by)})
    inside = F.coalesce((F.col("node") > F.col("d.node")) & (F.col("node") <= F.col("d.last")), F.lit(False))
    return rows.groupBy(*key).agg(F.max("own").alias("n"), F.bool_or(inside & definition).alias("nested"), F.count_if(inside & branch).alias("points"))


def control_flow_changes(candidates: DataFrame, both: DataFrame) -> DataFrame:
    """(id, symbol) -> points before and after, or the reason there are none."""
    asked = candidates.select("id", "symbol", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("side"))
    rows = asked.join(control_points(both, asked, ["id", "side"]), ["id", "side"], "left")
    owner = F.when(F.col("side") == "b", "baseline_owner_unavailable").otherwise("candidate_owner_unavailable")
    why = F.when(F.col("n").isNull(), "source_syntax_invalid").when(F.col("n") != 1, owner).when(F.col("nested"), "nested_definition")
    rows = rows.select("id", "side", "points", why.alias("why"))
    side = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    per = rows.groupBy("id").agg(side("points", "b").alias("before_points"), side("points", "a").alias("after_points"), F.coalesce(side("why", "b"), side("why", "a")).alias("reason"))
    seen = lambda c: F.when(F.col("reason").isNull(), c)
    return per.select("id", F.when(F.col("reason").isNull(), "observed").otherwise("skipped").alias("status"), seen(F.col("before_points")).alias("before_points"), seen(F.col("after_points")).alias("after_points"), seen(F.col("after_points") - F.col("before_points")).alias("delta"), "reason")


def reflective_uses(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol) -> (file, symbol) of files that reach the name through getattr and the like, by the exact string."""
    calls = nodes.where((F.col("kind") == "call") & F.col("name").isin(*REFLECTIVE)).select("file", F.col("node").alias("parent"))
    strings = nodes.where("kind = 'string' and field = 'args' and nth = 1").select("file", "parent", F.col("name").alias("symbol"))
    return strings.join(symbols.select("symbol").distinct(), "symbol").join(calls, ["file", "parent"]).select("file", "symbol").distinct()


def identifier_leaves(nodes: DataFrame) -> DataFrame:
    """(file, name, n): how often each name stands in a file's syntax; strings and comments do not count."""
    return nodes.where("kind = 'identifier'").groupBy("file", "name").agg(F.count("*").alias("n"))


# --- exact replacements ------------------------------------------------------------------


def line_end(source: Column) -> Column:
    """The line end of a text; null if it has several."""
    crlf = F.contains(source, F.lit("\r\n"))
    lone = F.contains(F.replace(source, F.lit("\r\n"), F.lit("")), F.lit("\n"))
    return F.when(crlf & lone, F.lit(None)).when(crlf, F.lit("\r\n")).otherwise(F.lit("\n"))


def fitted(source: Column, fragment: Column) -> tuple[Column, Column]:
    """A fragment trimmed and with the source's line ends, and why that cannot be (null if it can)."""
    flat = F.replace(F.regexp_replace(fragment, r"(?U)\A\s+|\s+\z", ""), F.lit("\r\n"), F.lit("\n"))
    why = F.when(F.contains(flat, F.lit("\r")), "mutation_fragment_invalid").when(line_end(source).isNull(), "mutation_source_eol_mixed")
    return F.replace(flat, F.lit("\n"), line_end(source)), why


def piece(source: Column, start: Column, end: Column) -> Column:
    """Bytes start to end of a text."""
    return F.decode(F.substring(F.encode(source, "UTF-8"), start + 1, end - start), "UTF-8")


def indented(source: Column, at: Column, fragment: Column) -> Column:
    """Further lines of a fragment take the blanks that the line at byte ``at`` begins with."""
    blanks = F.regexp_extract(F.regexp_extract(piece(source, F.lit(0), at), r"([^\n]*)\z", 1), r"\A([ \t]*)", 1)
    rows = F.transform(F.split(F.replace(fragment, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))
    return F.replace(F.array_join(rows, "\n"), F.lit("\n"), F.concat(F.coalesce(line_end(source), F.lit("\n")), blanks))


def envelopes(slices: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, id, owner_start, owner_end, start, end) -> id, envelope, envelope_why.

    What of the owner's syntax a slice is: the owner, one node, or a run of
    siblings, whose ends are nodes of one list at most MOST_SIBLINGS apart.
    """
    # the nodes are read once: those that begin or end with a slice, by the list they stand in
    near = nodes.select("file", "parent", "field", "nth", F.col("start").alias("n_start"), F.col("end").alias("n_end")).join(slices.select("file", "id", "start", "end"), "file")
    first, last = F.col("n_start") == F.col("start"), F.col("n_end") == F.col("end")
    lists = near.where(first | last).groupBy("id", "parent", "field").agg(
        F.bool_or(first & last).alias("node_is"), F.collect_set(F.when(first, F.col("nth"))).alias("a"), F.collect_set(F.when(last, F.col("nth"))).alias("b")
    )
    apart = F.array_min(F.flatten(F.transform("a", lambda a: F.transform(F.filter("b", lambda b: b >= a), lambda b: b - a))))
    per = lists.groupBy("id").agg(F.bool_or("node_is").alias("node_is"), F.min(apart).alias("apart"))
    rows = slices.join(large(per), "id", "left")
    inside = (F.col("start") >= F.col("owner_start")) & (F.col("end") <= F.col("owner_end")) & (F.col("start") < F.col("end"))
    whole = (F.col("start") == F.col("owner_start")) & (F.col("end") == F.col("owner_end"))
    envelope = F.when(inside, F.when(whole, "owner").when(F.col("node_is"), "node").when(F.col("apart") < MOST_SIBLINGS, "siblings"))
    why = F.when(envelope.isNull(), F.when(inside & (F.col("apart") >= MOST_SIBLINGS), "mutation_slice_too_wide").otherwise("mutation_slice_not_structural"))
    return rows.select("id", envelope.alias("envelope"), why.alias("envelope_why"))


def replacements(mutations: DataFrame, nodes: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """(id, source, symbol, before, replacement), nodes by file = id -> id, reason, start_byte, end_byte, envelope, after.

    An exact slice of the symbol's one function is replaced; the slice must be
    there once and be whole syntax. ``functions``: those of the nodes, where they
    can be had for less than the whole table.
    """
    asked = mutations.select(F.col("id").cast("string").alias("file"), "symbol")
    owner = (nodes if functions is None else functions).where("kind = 'function_definition'").join(asked, "file").where("name = symbol").groupBy("file").agg(F.count("*").alias("n"), F.min(F.struct("start", "end")).alias("o"))
    owner = kept(owner)  # a few numbers a file, read three times
    rows = mutations.withColumn("file", F.col("id").cast("string")).join(owner, "file", "left")
    want, why = fitted(F.col("source"), F.col("before"))
    rows = rows.withColumns({"want": want, "want_why": why, "body": piece(F.col("source"), F.col("o.start"), F.col("o.end"))})
    times = (F.octet_length("body") - F.octet_length(F.replace("body", F.col("want"), F.lit("")))) / F.octet_length("want")
    rows = rows.withColumn("times", F.when(F.octet_length("want") > 0, times))
    start = F.col("o.start") + F.octet_length(F.call_function("substring_index", F.col("body"), F.col("want"), F.lit(1)))
    early = (
        F.when(~F.coalesce(F.col("n") == 1, F.lit(False)), "owner_unavailable").when(F.col("want_why").isNotNull(), F.col("want_why")).when(F.col("want") == "", "mutation_before_empty")
        .when(F.col("times") > 1, "mutation_slice_ambiguous").when(F.col("times") < 1, "mutation_slice_not_exact")
    )
    rows = rows.withColumn("early", early).withColumn("start", F.when(F.col("early").isNull(), start))
    rows = rows.withColumn("end", F.col("start") + F.octet_length("want"))
    found = envelopes(rows.where("early is null").select("file", "id", F.col("o.start").alias("owner_start"), F.col("o.end").alias("owner_end"), "start", "end"), nodes)
    rows = rows.join(large(found), "id", "left")
    new, new_why = fitted(F.col("source"), F.col("replacement"))
    after = F.concat(piece(F.col("source"), F.lit(0), F.col("start")), indented(F.col("source"), F.col("start"), new), piece(F.col("source"), F.col("end"), F.octet_length("source")))
    rows = rows.withColumns({"new_why": new_why, "after": F.when(F.col("early").isNull(), after)})
    reason = F.coalesce("early", "envelope_why", "new_why", F.when(F.col("after") == F.col("source"), "no_change").otherwise("ok"))
    done = lambda c: F.when(F.col("reason").isin("ok", "no_change"), F.col(c)).alias
    rows = rows.withColumn("reason", reason)
    return rows.select("id", "reason", done("start")("start_byte"), done("end")("end_byte"), done("envelope")("envelope"), done("after")("after"))


def confinement_checks(edits: DataFrame, nodes: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """(id, source, symbol, before, replacement, start_byte, end_byte, envelope, after): whether the claims are what a new compilation gives."""
    again = replacements(edits.select("id", "source", "symbol", "before", "replacement"), nodes, functions).select("id", "reason", *(F.col(c).alias(f"own_{c}") for c in ("start_byte", "end_byte", "envelope", "after")))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"own_{c}"))
    detail = (
        F.when(~F.col("reason").isin("ok", "no_change"), F.col("reason")).when(~(same("start_byte") & same("end_byte") & same("envelope")), "slice_certificate_mismatch")
        .when(~same("after"), "compiled_replacement_mismatch")
    )
    return edits.join(large(again), "id").select("id", F.lit("replace_node_confinement").alias("kind"), detail.isNull().alias("pass"), detail.alias("detail"))
