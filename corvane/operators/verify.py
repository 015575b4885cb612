"""Checks of candidate edits, over many candidates at once: before and after columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text

# Kinds of checks that a proof needs, and what a failed one leads to.
OBLIGATIONS = {
    "ast_parse": "fatal", "candidate_validity_barrier": "fatal", "changed_file_set": "fatal", "rename_global_closure": "rescout",
    "rename_identifier_delta": "repair", "replay_exact": "fatal", "target_cardinality": "repair", "top_level_conservation": "repair",
}
#: kinds that a completed rename needs besides
COMPLETION = [*OBLIGATIONS, "candidate_hygiene", "rename_destination_fresh", "rename_reflective_builtin_safe"]
DISPOSITIONS = ["fatal", "rescout", "repair"]


def bounded_count(source: Column, needle: Column, most: int = 2) -> Column:
    """0, 1 or many (2) places of a literal that do not overlap."""
    n = (F.length(source) - F.length(F.replace(source, needle, F.lit("")))) / F.length(needle)
    return F.when(F.length(needle) > 0, F.least(n, F.lit(most))).otherwise(0).cast("int")


def replayed(before: Column, edits: Column) -> Column:
    """Edits (array of structs before, after) applied in order; null once one is not unique."""

    def step(acc: Column, e: Column) -> Column:
        return F.when(bounded_count(acc, e["before"]) == 1, F.replace(acc, e["before"], e["after"]))

    return F.aggregate(edits, before, step)


def replay_checks(candidates: DataFrame) -> DataFrame:
    """(id, before, edits, after) -> id, pass, detail."""
    got = replayed(F.col("before"), F.col("edits"))
    ok = got.isNotNull() & (got == F.col("after"))
    detail = F.when(got.isNull(), "edit_precondition_not_unique").when(got != F.col("after"), "replay_mismatch")
    return candidates.select("id", F.lit("replay").alias("kind"), F.coalesce(ok, F.lit(False)).alias("pass"), detail.alias("detail"))


def eol_kept(before: Column, after: Column) -> Column:
    """A file without line ends may get LF or CRLF; else the kind of line end stays."""
    a, b = text.eol_kind(before), text.eol_kind(after)
    return (a == b) | ((a == "none") & b.isin("lf", "crlf"))


def trailing_blanks(source: Column) -> Column:
    """Lines that end in blanks."""
    return F.regexp_count(source, F.lit(r"(?m)[ \t]+\r?$")).cast("long")


def hygiene_checks(candidates: DataFrame) -> DataFrame:
    """Line ends are kept and no line with trailing blanks is added."""
    eol = eol_kept(F.col("before"), F.col("after"))
    more = trailing_blanks(F.col("after")) > trailing_blanks(F.col("before"))
    detail = F.when(~eol, "eol_changed").when(more, "trailing_whitespace_added")
    return candidates.select("id", F.lit("hygiene").alias("kind"), (eol & ~more).alias("pass"), detail.alias("detail"))


def changed_lines(patch: Column) -> Column:
    """Added and removed lines of a unified diff, without its file headers."""
    rows = F.split(patch, "\n")
    return F.size(F.filter(rows, lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(?:\+\+\+|---)"))).cast("long")


def identifier_count(source: Column, symbol: Column) -> Column:
    return F.size(F.filter(F.regexp_extract_all(source, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1)), lambda x: x == symbol)).cast("long")


def rename_checks(candidates: DataFrame) -> DataFrame:
    """(id, file, before, after, old_name, new_name), several files an id: removed > 0, removed = added, and the new name is fresh."""
    counts = {f"{s}_{n}": F.sum(identifier_count(F.col(s), F.col(n))) for s in ("before", "after") for n in ("old_name", "new_name")}
    rows = candidates.groupBy("id").agg(*(c.alias(k) for k, c in counts.items()))
    removed, added = F.col("before_old_name") - F.col("after_old_name"), F.col("after_new_name") - F.col("before_new_name")
    return rows.select(
        "id", removed.alias("removed"), added.alias("added"), (F.col("before_new_name") == 0).alias("destination_fresh"),
        ((removed > 0) & (removed == added) & (F.col("after_old_name") == 0)).alias("pass"),
    )


def same_files(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files only on one side: an empty result is set equality."""
    a, b = expected.select("file").distinct(), actual.select("file").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("missing")).union(b.exceptAll(a).withColumn("side", F.lit("extra")))


def closure_differences(before: DataFrame, after: DataFrame, new_name: str) -> DataFrame:
    """(importer, target, source, local, propagates) before and after a rename: bindings that are the same, missing or extra.

    A binding is expected under the new name, and passes it on where it passed on the old one.
    """
    key = ["importer", "target", "source", "local", "propagates"]
    want = before.select("importer", "target", F.lit(new_name).alias("source"), F.when(F.col("propagates"), new_name).otherwise(F.col("local")).alias("local"), "propagates").distinct()
    both = want.withColumn("w", F.lit(1)).join(after.select(*key).distinct().withColumn("g", F.lit(1)), key, "full_outer")
    return both.select(F.when(F.col("w").isNull(), "extra").when(F.col("g").isNull(), "missing").otherwise("same").alias("side"), *key)


def without_duplicates(mutations: DataFrame) -> DataFrame:
    """Mutations that change something, each once: equal canonical JSON is equal."""
    key = F.sha2(F.to_json(F.struct("file", "kind", "before", "after"), {"ignoreNullFields": "false"}), 256)
    return mutations.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("key", key).dropDuplicates(["key"])


def assessed(checks: DataFrame) -> DataFrame:
    """(id, kind, pass) -> one row per id: whether all obligations hold, and what to do if not.

    An obligation holds if it has a check and all its checks pass; of several
    failures the gravest decides.
    """
    spark = checks.sparkSession
    rules = spark.createDataFrame(list(OBLIGATIONS.items()), "kind string, disposition string")
    got = checks.groupBy("id", "kind").agg(F.bool_and("pass").alias("ok"))
    every = checks.select("id").distinct().crossJoin(F.broadcast(rules))  # a handful of fixed rules
    rows = every.join(got, ["id", "kind"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("kind"))))
    worst = F.lit(None).cast("string")
    for d in reversed(DISPOSITIONS):
        worst = F.when(F.max(F.when(~F.col("ok"), F.col("disposition") == d).otherwise(False)), d).otherwise(worst)
    return rows.groupBy("id").agg(F.bool_and("ok").alias("verified"), F.array_join(failed, ",").alias("failed"), worst.alias("disposition"))


def receipts(rows: DataFrame) -> DataFrame:
    """(id, patch, verified) -> receipt with hashes; the receipt's hash covers the patch's."""
    patch = F.sha2(F.col("patch"), 256)
    return rows.select("id", patch.alias("patch_sha256"), F.sha2(F.concat_ws("|", F.col("id").cast("string"), patch, F.col("verified").cast("string")), 256).alias("receipt_sha256"), "verified")


def authorized(assessment: DataFrame, receipt_rows: DataFrame, claimed: DataFrame) -> DataFrame:
    """CERTIFY if the proof holds and the claimed hash is the receipt's; else ABSTAIN with the first reason."""
    rows = assessment.select("id", F.col("verified").alias("proof")).join(receipt_rows, "id", "left").join(claimed.select("id", "claimed_sha256"), "id", "left")
    reason = F.when(~F.col("proof"), "proof_incomplete").when(F.col("receipt_sha256").isNull(), "receipt_missing").when(~F.col("claimed_sha256").eqNullSafe(F.col("receipt_sha256")), "receipt_mismatch")
    return rows.select("id", F.when(reason.isNull(), "CERTIFY").otherwise("ABSTAIN").alias("decision"), reason.alias("reason"))


def live_candidates(candidates: DataFrame, files: DataFrame, line_counts: DataFrame) -> DataFrame:
    """(set_id, file, sha256, start, end): a set is rejected if any file changed or any span is out of range."""
    now = files.select("file", F.sha2("source", 256).alias("now"))
    rows = candidates.join(now, "file", "left").join(line_counts.select("file", "n_lines"), "file", "left")
    ok = F.coalesce((F.col("sha256") == F.col("now")) & (F.col("start") >= 1) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("n_lines")), F.lit(False))
    return rows.groupBy("set_id").agg(F.bool_and(ok).alias("accepted"), F.count("*").alias("n"))
