"""Renames lowered to exact edits, for all requests at once, over the node table.

A use of a name is joined with the scopes around it, and of those that bind the
name the innermost is the one it means; a class binds only for what stands right
in it. A request renames the uses that mean its definition, and the imports that
carry it, with their uses where the importer keeps the name. Whatever cannot be
proved rejects the whole request.
"""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.nodes import Part
from corvane.operators import ranges, syntax
from corvane.scratch import kept, large

# The most occurrences of a rename, and the most lines between one and evidence of it.
MOST_OCCURRENCES, MOST_DISTANCE = 16, 96
SCOPES = ["module", "function_definition", "class_definition", "lambda", "comprehension_scope"]
PARTS = {*SCOPES, "identifier", "import_from_statement", "alias"}
BINDS = ["store", "delete", "parameter", "definition", "import"]
#: names that are no uses of a binding of the file
OTHER = ["member", "own_member", "keyword", "imported"]
REASONS = [
    "mutation_contract_invalid", "symbol_not_found", "symbol_ambiguous", "rename_binding_unsupported", "rename_binding_ambiguous", "rename_scope_incomplete",
    "rename_dependency_evidence_invalid", "rename_destination_not_fresh", "rename_reflective_builtin_unsupported", "rename_scope_too_large", "evidence_anchor_missing",
    "rename_import_validation_failed", "rename_context_unsupported",
]
CLOSURE_REASONS = {
    "closure_import_ambiguous": "rename_binding_ambiguous", "closure_import_unresolved": "rename_scope_incomplete", "closure_index_incomplete": "rename_dependency_evidence_invalid",
    "closure_source_validation_failed": "rename_dependency_evidence_invalid", "closure_binding_budget_exceeded": "rename_scope_too_large", "closure_state_budget_exceeded": "rename_scope_too_large",
}


# What lowered() reads of the node table: parsing needs to tell no more than that.
NODE_COLUMNS = ["file", "node", "parent", "last", "kind", "field", "nth", "name", "use", "start", "end", "start_line"]


def of_renames(p: Part) -> bool:
    """Scopes and where their bodies begin, names, imports by name, and calls that reach a name through a string."""
    if p.kind == "call":
        return isinstance(p.x.func, ast.Name) and p.x.func.id in syntax.REFLECTIVE
    return p.kind in PARTS or (p.field == "body" and not p.nth) or (p.kind == "string" and p.field == "args" and p.nth == 1)


def names_of(requests: DataFrame, closure_rows: DataFrame) -> DataFrame:
    """(file, names): what lowered() asks of the names of a file; of other files it asks nothing."""
    asked = requests.select("id", "file", "symbol", "new_name", "allowed")
    links = large(closure_rows.select("file", "symbol", "importer", "local_symbol")).join(asked.select("file", "symbol", "new_name"), ["file", "symbol"])
    own = asked.select(F.explode(F.concat(F.array("file"), F.coalesce("allowed", F.array().cast("array<string>")))).alias("file"), F.array("symbol", "new_name").alias("names"))
    rows = own.union(links.select(F.col("importer").alias("file"), F.array("symbol", "local_symbol", "new_name").alias("names")))
    return large(rows.groupBy("file").agg(F.array_distinct(F.flatten(F.collect_set("names"))).alias("names")))


def scope_chains(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaves (file, node, ...) with each scope around them: scope, scope_kind, and ``own`` for the innermost.

    What stands in the head of a definition belongs to the scope around it, but
    for parameters.
    """
    body = nodes.where("field = 'body'").groupBy("file", F.col("parent").alias("scope")).agg(F.min("node").alias("body"))
    scopes = nodes.where(F.col("kind").isin(*SCOPES)).select("file", F.col("node").alias("scope"), "last", F.col("kind").alias("scope_kind")).join(body, ["file", "scope"], "left")
    inner = leaves.select("file", F.col("node").alias("i_id"), F.col("node").alias("i_start"), F.col("node").alias("i_end")).distinct()
    outer = scopes.select("file", F.col("scope").alias("o_id"), F.col("scope").alias("o_start"), F.col("last").alias("o_end"), "scope_kind", "body")
    # read off the scopes alone, not off their join with the bodies
    longest = nodes.where(F.col("kind").isin(*SCOPES)).agg(F.max(F.col("last") - F.col("node") + 1)).head()[0] or 0
    pairs = ranges.containing(inner, outer, longest=longest).select("file", F.col("i_id").alias("node"), F.col("o_id").alias("scope"), "scope_kind", "body")
    rows = leaves.join(pairs, ["file", "node"])
    head = (F.col("node") < F.col("body")) & (F.col("use") != "parameter") & F.col("scope_kind").isin("function_definition", "class_definition", "lambda")
    rows = rows.where(~F.coalesce(head, F.lit(False))).drop("body")
    return rows.withColumn("own", F.col("scope") == F.max("scope").over(Window.partitionBy("file", "node")))


def resolved(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaves (file, node, name, use, ...) with ``scope``, where they stand, and ``binding``, the scope that binds the name they mean; null if none of the file does."""
    leaves = kept(leaves)  # both are read several times; what makes them would be in the plan as often
    chains = kept(scope_chains(leaves, nodes))
    binders = chains.where(F.col("use").isin(*BINDS) & F.col("own")).select("file", "name", "scope").distinct().withColumn("binds", F.lit(True))
    seen = chains.join(binders, ["file", "name", "scope"], "left")
    counts = F.col("binds") & (F.col("own") | (F.col("scope_kind") != "class_definition")) & ~F.col("use").isin(*OTHER)
    per = seen.groupBy("file", "node").agg(F.max(F.when(F.col("own"), F.col("scope"))).alias("scope"), F.max(F.when(F.col("own"), F.struct("scope", "scope_kind"))["scope_kind"]).alias("scope_kind"), F.max(F.when(counts, F.col("scope"))).alias("binding"))
    return leaves.join(per, ["file", "node"])


def _failed(rows: DataFrame, reason: str | Column) -> DataFrame:
    # the least reason of an id is taken at the end, so nothing is shuffled here
    return rows.select("id", (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def lowered(
    requests: DataFrame,
    nodes: DataFrame,
    closure_rows: DataFrame,
    closure_verdicts: DataFrame,
    imports: DataFrame,
    *,
    evidence: DataFrame | None = None,
    most: int = MOST_OCCURRENCES,
    module_level: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(id, file, symbol, new_name, allowed: array of files) -> ((id, file, start, end, line, new_name), (id, reason)).

    ``closure_rows``, ``closure_verdicts``: of (file, symbol), see closure.closures;
    ``imports``: resolved imports (file, line, kind, target, source). ``evidence``
    (id, line): lines of the target file that speak for the rename. References
    at module level are rejected unless ``module_level``; nothing is edited
    where the name stays. ``nodes`` and the closures are read many times: keep
    them first.
    """
    ident = F.col("new_name").rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")
    bad = [_failed(requests.where(~F.coalesce(ident, F.lit(False))), REASONS[0])]
    live = requests.where(ident & (F.col("symbol") != F.col("new_name")))
    # the definition, and all leaves of the name in its file
    asked = live.select("id", "file", "symbol", "new_name")
    names = asked.select("file", F.col("symbol").alias("name")).union(closure_rows.select(F.col("importer").alias("file"), F.col("local_symbol").alias("name"))).distinct()
    leaves = nodes.where("kind = 'identifier'").join(names, ["file", "name"], "left_semi").select("file", "node", "parent", "name", "use", "start", "end", "start_line")
    known = kept(resolved(leaves, nodes))
    mine = asked.join(known.withColumnRenamed("name", "symbol"), ["file", "symbol"])
    functions = nodes.where("kind = 'function_definition'").select("file", F.col("node").alias("parent"), F.lit(True).alias("function"))
    targets = mine.where("use = 'definition'").join(functions, ["file", "parent"])
    per = kept(targets.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("node").alias("target"), F.col("scope").alias("home"), F.col("scope_kind").alias("home_kind"))).alias("one")))
    bad.append(_failed(live.join(per, "id", "left").where("n is null"), REASONS[1]))
    bad.append(_failed(per.where("n > 1"), REASONS[2]))
    rows = mine.join(per.where("n = 1").select("id", "one.*"), "id")
    bad.append(_failed(rows.where("use in ('global', 'nonlocal')"), REASONS[3]))
    homes = nodes.where(F.col("kind").isin(*SCOPES)).select("file", F.col("node").alias("home"), F.col("last").alias("home_last"))
    rows = rows.join(homes, ["file", "home"]).withColumn("within", (F.col("node") >= F.col("home")) & (F.col("node") <= F.col("home_last")))
    rows = kept(rows)
    method = F.col("home_kind") == "class_definition"
    bad.append(_failed(rows.where(~method & F.col("within") & F.col("use").isin(*BINDS) & (F.col("node") != F.col("target"))), REASONS[4]))
    bad.append(_failed(rows.where(method & F.col("within") & (F.col("use") == "member")), REASONS[4]))
    uses = rows.where((F.col("node") == F.col("target")) | F.when(method, F.col("within") & (F.col("use") == "own_member")).otherwise(F.col("binding").eqNullSafe(F.col("home")) & ~F.col("use").isin(*OTHER)))
    # what the closure proves, and what it may touch
    verdict = live.join(closure_verdicts.select("file", "symbol", F.col("reason").alias("why")), ["file", "symbol"], "left")
    told = F.lit(None)
    for k, v in CLOSURE_REASONS.items():
        told = F.when(F.col("why") == k, v).otherwise(told)
    bad.append(_failed(verdict.where("why is not null"), F.coalesce(told, F.lit(REASONS[3]))))
    links = kept(asked.join(closure_rows, ["file", "symbol"]).select("id", "importer", "target", "symbol", "local_symbol", "propagates", "new_name"))
    allowed = live.select("id", F.explode("allowed").alias("importer"))
    touched = links.select("id", "importer").union(asked.select("id", F.col("file").alias("importer"))).distinct()
    bad.append(_failed(touched.join(allowed, ["id", "importer"], "left_anti"), REASONS[5]))
    fresh = nodes.where("kind = 'identifier'").select(F.col("file").alias("importer"), F.col("name").alias("new_name")).distinct()
    bad.append(_failed(touched.join(asked.select("id", "new_name"), "id").join(fresh, ["importer", "new_name"], "left_semi"), REASONS[7]))
    reflected = syntax.reflective_uses(nodes, asked).select(F.col("file").alias("importer"), "symbol")
    bad.append(_failed(allowed.join(asked.select("id", "symbol"), "id").join(reflected, ["importer", "symbol"], "left_semi"), REASONS[8]))
    size = rows.select("id").union(links.select("id")).groupBy("id").agg(F.count("*").alias("n"))
    bad.append(_failed(size.where(F.col("n") > most), REASONS[9]))
    if evidence is not None:
        lines = evidence.select("id", F.col("line").alias("seen"))
        near = uses.select("id", "start_line").join(lines, "id", "left").groupBy("id", "start_line").agg(F.min(F.abs(F.col("seen") - F.col("start_line"))).alias("far"))
        bad.append(_failed(near.where("far is null"), REASONS[10]))
        bad.append(_failed(near.where(F.col("far") > MOST_DISTANCE), REASONS[5]))
    # imports that carry the name: the leaf below the alias, in the statement at the import's line
    where = imports.select(F.col("file").alias("importer"), "target", F.col("line").alias("at_line"), "kind", F.explode("source").alias("symbol")).distinct()
    carried = kept(links.join(where, ["importer", "target", "symbol"]))
    bad.append(_failed(carried.where("kind <> 'python_from'"), REASONS[3]))
    statements = nodes.where("kind = 'import_from_statement'").select("file", "node", F.col("start_line").alias("at_line"))
    aliases = nodes.where("kind = 'alias'").select("file", F.col("node").alias("alias"), F.col("parent").alias("node")).join(statements, ["file", "node"]).select(F.col("file").alias("importer"), "alias", "at_line")
    taken = nodes.where("kind = 'identifier' and use in ('import', 'imported')").select(F.col("file").alias("importer"), F.col("parent").alias("alias"), F.col("name").alias("symbol"), F.col("node").alias("leaf"), "start", "end", "start_line")
    found = kept(carried.join(aliases, ["importer", "at_line"]).join(taken, ["importer", "alias", "symbol"]))
    bad.append(_failed(carried.join(found.select("id", "importer", "at_line"), ["id", "importer", "at_line"], "left_anti"), REASONS[11]))
    # uses of an import that keeps the name
    carriers = found.where("propagates").select("id", F.col("importer").alias("file"), F.col("local_symbol").alias("name"), "leaf", "new_name")
    at = known.select("file", F.col("node").alias("leaf"), F.col("scope").alias("home"))
    carriers = kept(carriers.join(at, ["file", "leaf"]))
    there = kept(known.join(carriers.select("id", "file", "name", "home", "new_name").distinct(), ["file", "name"]))
    bad.append(_failed(there.where("use in ('global', 'nonlocal')"), REASONS[3]))
    rivals = there.where(F.col("use").isin(*BINDS) & (F.col("scope") == F.col("home"))).join(carriers.select("id", "file", F.col("leaf").alias("node")), ["id", "file", "node"], "left_anti")
    bad.append(_failed(rivals, REASONS[4]))
    passed = there.where((F.col("binding") == F.col("home")) & ~F.col("use").isin(*OTHER, "import"))
    if not module_level:
        module = F.col("scope") == 0
        bad.append(_failed(uses.where(module & (F.col("node") != F.col("target"))), REASONS[12]))
        bad.append(_failed(passed.where(module), REASONS[12]))
    all_reasons = F.array(*map(F.lit, REASONS))
    first = F.min(F.array_position(all_reasons, F.col("reason")).cast("int"))
    why = kept(reduce(DataFrame.union, bad).groupBy("id").agg(F.element_at(all_reasons, first).alias("reason")))
    columns = ["id", "file", "start", "end", F.col("start_line").alias("line"), "new_name"]
    edits = uses.select(*columns).union(found.withColumnRenamed("importer", "file").select(*columns)).union(passed.select(*columns)).distinct()
    verdicts = requests.select("id", F.when(F.col("symbol") == F.col("new_name"), "no_change").otherwise("ok").alias("none")).join(why, "id", "left").select("id", F.coalesce("reason", "none").alias("reason"))
    return kept(edits.join(why.select("id"), "id", "left_anti")), verdicts


def applied(edits: DataFrame, files: DataFrame) -> DataFrame:
    """(id, file, start, end, new_name) and (file, source) -> (id, file, source, after); edits of a file must not overlap."""
    per = edits.groupBy("id", "file").agg(F.sort_array(F.collect_list(F.struct("start", "end", "new_name"))).alias("edits"))
    rows = per.join(files.select("file", "source"), "file")
    step = lambda acc, e: F.struct(e["end"].alias("at"), F.concat(acc["text"], syntax.piece(F.col("source"), acc["at"], e["start"]), e["new_name"]).alias("text"))
    done = F.aggregate("edits", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("text")), step)
    rows = rows.withColumn("done", done)
    return rows.select("id", "file", "source", F.concat("done.text", syntax.piece(F.col("source"), F.col("done.at"), F.octet_length("source").cast("bigint"))).alias("after"))


def conservation(requests: DataFrame, edits: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether names moved as the edits say: (id, file, pass) from leaf counts (id, file, name, n) before and after.

    As many leaves of the old name go as there are edits, and as many of the new one come.
    """
    n = edits.groupBy("id", "file").agg(F.count("*").alias("n_edits")).join(requests.select("id", "symbol", "new_name"), "id")
    count = lambda df, name, to: df.select("id", "file", F.col("name").alias(name), F.col("n").alias(to))
    for df, name, to in ((before, "symbol", "old_before"), (after, "symbol", "old_after"), (before, "new_name", "new_before"), (after, "new_name", "new_after")):
        n = n.join(count(df, name, to), ["id", "file", name], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    ok = (z("old_before") - z("old_after") == F.col("n_edits")) & (z("new_before") == 0) & (z("new_after") == F.col("n_edits"))
    return n.select("id", "file", ok.alias("pass"))
