"""Decisions about edits, over many at once: shapes, capabilities, commits and their claims, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.verify import COMPLETION, OBLIGATIONS

# What each kind of mutation needs and must not have.
REQUIRED = {"replace_node": ["before", "replacement"], "rename_symbol": ["new_name"]}
MAY_BE_EMPTY = ["replacement"]
FORBIDDEN = {"replace_node": ["after", "body", "new_name", "scope"], "rename_symbol": ["after", "before", "body", "replacement", "scope"]}
TARGET_FIELDS = ["file", "symbol"]
SHA256 = "^[0-9a-f]{64}$"


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The name of the first condition that holds; null if none does. A condition that is null holds."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(True)), name).otherwise(out)
    return out


def shape_failure(mutation: str = "mutation") -> Column:
    """Why a mutation (a map of its fields) has not the shape of its kind; null if it has.

    Its target comes from a capability, so it must not name one.
    """
    field = F.col(mutation)
    has = lambda k: F.map_contains_key(field, k)
    kind = field["kind"]
    out = F.lit("mutation_kind_unknown")
    for name in REQUIRED:
        missing = F.filter(F.array(*(F.when(field[k].isNull() | ((F.length(field[k]) < 1) & F.lit(k not in MAY_BE_EMPTY)), k) for k in REQUIRED[name])), lambda x: x.isNotNull())
        extra = F.filter(F.array(*(F.when(has(k), k) for k in FORBIDDEN[name])), lambda x: x.isNotNull())
        failure = F.when(F.size(missing) > 0, F.concat(F.lit(f"{name}_requires_"), F.array_join(missing, "_"))).when(F.size(extra) > 0, F.concat(F.lit(f"{name}_forbids_"), F.array_join(extra, "_")))
        out = F.when(kind == name, failure).otherwise(out)
    target = has(TARGET_FIELDS[0]) | has(TARGET_FIELDS[1])
    return F.when(field.isNull(), "input_not_object").when(target, "target_fields_forbidden_capability_bound").otherwise(out)


def hashed(*columns: str) -> Column:
    """SHA-256 of the columns as canonical JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def is_sha(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(SHA256), F.lit(False))


def rename_capability(handoffs: DataFrame) -> DataFrame:
    """(id, status, found_files, handed_files, n_definitions, destination_used, reflective) -> id, ready, reason."""
    reason = first_reason(
        (F.col("status") != "ready", "handoff_not_ready"), (F.col("n_definitions") < 1, "no_definition"), (F.col("n_definitions") > 1, "ambiguous"),
        (F.size(F.array_except("found_files", "handed_files")) > 0, "files_outside_handoff"), (F.col("destination_used"), "destination_not_fresh"), (F.col("reflective"), "reflective_use"),
    )
    return handoffs.select("id", reason.isNull().alias("ready"), reason.alias("reason"))


def action_commits(states: DataFrame) -> DataFrame:
    """Turns with their task action, capability and capsule -> id, reason, commit_sha256: only an exact rename, at the
    first attempt, with hashes that agree, is committed."""
    reason = first_reason(
        (F.col("state") != "mutate", "action_commit_not_initial_mutate"), (F.col("drifted"), "action_commit_task_drift"), (F.col("accepted"), "action_commit_patch_already_accepted"),
        (F.col("rescout"), "action_commit_rescout_pending"), (F.col("attempts") != 0, "action_commit_not_first_attempt"),
        ((F.col("status") != "exact") | ~is_sha("task_sha256") | (F.col("task_sha256") != F.col("turn_sha256")) | (F.col("old_name") == F.col("new_name")), "action_commit_task_not_exact_rename"),
        (F.col("tool") != "execute_rename_symbol", "action_commit_frontier_mismatch"),
        (~F.col("capable") | (F.col("target") != F.col("old_name")) | ~is_sha("source_sha256"), "action_commit_rename_capability_mismatch"),
        (~is_sha("capsule_sha256"), "action_commit_capsule_unavailable"),
    )
    commit = hashed("task_sha256", "old_name", "new_name", "target", "source_sha256", "capsule_sha256")
    rows = states.withColumn("reason", reason)
    return rows.select("id", F.coalesce("reason", F.lit("exact_rename_committed")).alias("reason"), F.when(F.col("reason").isNull(), commit).alias("commit_sha256"))


def claims(attempts: DataFrame, replay_ok: bool) -> DataFrame:
    """(id, seq, commit_sha256) -> id, seq, ok, reason: the first valid commit of an id is claimed; the same one again
    is a duplicate (``ok`` if replays are), another one a conflict."""
    valid = is_sha("commit_sha256")
    first = F.min(F.when(valid, F.struct("seq", "commit_sha256"))).over(Window.partitionBy("id"))
    rows = attempts.withColumn("first", first)
    mine, same = F.col("seq") == F.col("first.seq"), F.col("commit_sha256") == F.col("first.commit_sha256")
    reason = F.when(~valid, "invalid").when(mine, "claimed").when(same, "duplicate").otherwise("conflict")
    return rows.select("id", "seq", (reason.isin("claimed", "duplicate") if replay_ok else reason == "claimed").alias("ok"), reason.alias("reason"))


def terminal_commits(turns: DataFrame) -> DataFrame:
    """Finished turns with their receipts -> id, reason, commit_sha256: only a verified patch whose receipts refer to each other ends a task."""
    reason = first_reason(
        (~F.col("accepted") | (F.col("state") != "done") | (F.col("event") != "patch_ready"), "terminal_commit_not_verified_terminal"),
        (~F.col("latched") | F.col("drifted") | ~is_sha("task_sha256"), "terminal_commit_task_identity_invalid"),
        (F.col("receipt_path") != F.col("claimed_path"), "terminal_commit_artifact_path_invalid"),
        (F.col("verification_refers") != F.col("receipt_path"), "terminal_commit_receipt_protocol_mismatch"),
        (F.col("disposition") != "pass", "terminal_commit_proof_not_pass"), (~F.col("verified") | ~is_sha("patch_sha256"), "terminal_commit_artifact_identity_invalid"),
        (F.col("patch_sha256") != F.col("verified_sha256"), "terminal_commit_patch_identity_mismatch"),
    )
    rows = turns.withColumn("reason", reason)
    commit = hashed("task_sha256", "receipt_path", "patch_sha256")
    return rows.select("id", F.coalesce("reason", F.lit("verified_terminal_committed")).alias("reason"), F.when(F.col("reason").isNull(), commit).alias("commit_sha256"))


def task_match(commits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(id, turn, task_sha256) of commits and of the latest task -> id, reason: whether a commit still is about the task."""
    now = snapshots.select("id", F.col("turn").alias("now_turn"), F.col("task_sha256").alias("now_sha256"))
    rows = commits.join(now, "id", "left")
    reason = F.when(~is_sha("task_sha256"), "invalid").when(F.col("now_turn").isNull() | ~is_sha("now_sha256"), "task_snapshot_invalid").when(F.col("turn") != F.col("now_turn"), "task_turn_changed").when(F.col("task_sha256") != F.col("now_sha256"), "task_text_drift").otherwise("task_match")
    return rows.select("id", reason.alias("reason"))


def artifacts_fresh(commits: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(id, kind, path, sha256) and (path, body) -> id, reason: the first artifact whose bytes are not those committed to."""
    now = artifacts.select("path", F.sha2("body", 256).alias("now"))
    rows = commits.join(now, "path", "left").withColumn("stale", ~F.col("sha256").eqNullSafe(F.col("now")))
    per = rows.groupBy("id").agg(*(F.bool_or((F.col("kind") == k) & F.col("stale")).alias(k) for k in ("patch_receipt", "verification_receipt", "patch")))
    reason = first_reason(*((F.col(k), f"terminal_{k}_stale") for k in ("patch_receipt", "verification_receipt", "patch")))
    return per.select("id", F.coalesce(reason, F.lit("terminal_artifacts_match")).alias("reason"))


def verifications(checks: DataFrame, runs: DataFrame) -> DataFrame:
    """Checks (id, kind, pass, coverage) and runs (id, reason, cleaned) -> id, ok, total, failed, coverage.

    A run holds if it has no reason against it, no failed check, a clean work
    tree, and a check of hygiene. ``coverage`` tells whether the language itself
    judged the files.
    """
    native, other = F.col("coverage") == "native_enforced", F.col("coverage") == "structural_only"
    per = checks.groupBy("id").agg(
        F.count("*").alias("total"), F.count_if(~F.col("pass")).alias("failed"), F.count_if(F.col("kind") == "candidate_hygiene").alias("hygiene"),
        F.count_if(native).alias("native"), F.count_if(other).alias("structural"),
    )
    coverage = F.when((F.col("native") > 0) & (F.col("structural") > 0), "mixed").when(F.col("native") > 0, "native_enforced").when(F.col("structural") > 0, "structural_only").otherwise("none")
    rows = runs.join(per, "id", "left").na.fill(0, ["total", "failed", "hygiene", "native", "structural"])
    ok = F.col("reason").isNull() & (F.col("failed") == 0) & F.col("cleaned") & (F.col("hygiene") > 0)
    return rows.select("id", ok.alias("ok"), "total", "failed", coverage.alias("coverage"))


def completions(checks: DataFrame, requests: DataFrame) -> DataFrame:
    """Checks (id, kind, pass) and requests (id, status, old_name, new_name, task_sha256, obligations) -> id, decision, reason.

    CERTIFY needs an exact rename, exactly the obligations of a proof, and every
    kind of check at least once and always passed.
    """
    passed = checks.groupBy("id", "kind").agg(F.bool_and("pass").alias("ok")).where("ok").groupBy("id").agg(F.collect_set("kind").alias("kinds"), F.count("*").alias("n"))
    failed = checks.groupBy("id").agg(F.count_if(~F.col("pass")).alias("failed"))
    rows = requests.join(passed, "id", "left").join(failed, "id", "left")
    need = F.array(*map(F.lit, sorted(COMPLETION)))
    lacking = F.size(F.array_except(need, F.coalesce("kinds", F.array().cast("array<string>"))))
    proof = F.array(*map(F.lit, sorted(OBLIGATIONS)))
    reason = first_reason(
        (F.col("status") != "exact", "unsupported_task_class"), ((F.col("old_name") == F.col("new_name")) | ~is_sha("task_sha256"), "task_action_invalid"),
        (F.array_sort("obligations") != proof, "proof_obligations_mismatch"), (F.col("failed") > 0, "verifier_completion_evidence_invalid"), (lacking > 0, "verifier_completion_check_missing_or_failed"),
    )
    return rows.select("id", F.when(reason.isNull(), "CERTIFY").otherwise("ABSTAIN").alias("decision"), reason.alias("reason"))


def safe_fails(turns: DataFrame) -> DataFrame:
    """Turns whose completion was asked for -> id, reason, commit_sha256: what was not certified ends in a bounded failure of its own."""
    reason = first_reason(
        (~F.col("applicable"), "completion_safe_fail_not_applicable"), (F.col("decision") == "CERTIFY", "completion_safe_fail_already_certified"),
        (~is_sha("task_sha256") | ~is_sha("patch_sha256"), "completion_safe_fail_identity_invalid"),
    )
    rows = turns.withColumn("reason", reason)
    return rows.select("id", F.coalesce("reason", F.lit("completion_safe_fail_ready")).alias("reason"), F.when(F.col("reason").isNull(), hashed("decision", "task_sha256", "patch_sha256")).alias("commit_sha256"))


def runtime_identity(manifest: DataFrame, components: DataFrame) -> DataFrame:
    """(id, name, sha256) and (id, name, body) -> id, same, first_difference: whether every part of a stack is the one listed."""
    now = components.select("id", "name", F.sha2("body", 256).alias("now"))
    both = manifest.join(now, ["id", "name"], "full_outer").withColumn("differs", ~F.col("sha256").eqNullSafe(F.col("now")))
    return both.groupBy("id").agg((~F.bool_or("differs")).alias("same"), F.min(F.when(F.col("differs"), F.col("name"))).alias("first_difference"))


def exact_owner(candidates: DataFrame, wanted: DataFrame) -> DataFrame:
    """Candidates (id, name, start, end, source, bound) and (id, before) -> id, reason, name.

    The candidate that holds the text; of several, the one most specific. A
    candidate already bound must hold it itself.
    """
    flat = lambda c: F.trim(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    rows = candidates.join(wanted.select("id", flat(F.col("before")).alias("want")), "id")
    rows = rows.withColumn("holds", (F.length("want") > 0) & F.contains(flat(F.col("source")), F.col("want")))
    exact = F.filter(F.collect_list(F.when(F.col("holds"), F.struct("name", "start", "end"))), lambda x: x.isNotNull())
    per = rows.groupBy("id").agg(exact.alias("exact"), F.max(F.when(F.col("bound"), F.struct("name", "holds"))).alias("b"))

    def outer(a: Column, b: Column) -> Column:
        return (a["start"] <= b["start"]) & (a["end"] >= b["end"]) & ((a["start"] < b["start"]) | (a["end"] > b["end"]))

    least = F.filter("exact", lambda a: ~F.exists(F.col("exact"), lambda b: outer(a, b)))
    per = per.withColumn("least", least)
    free = F.when(F.size("exact") < 1, "mutation_owner_no_exact_match").when(F.size("least") != 1, "mutation_owner_ambiguous_exact_match").otherwise("mutation_owner_unique_exact_match")
    reason = F.when(F.col("b").isNull(), free).when(F.col("b.holds"), "mutation_owner_sticky_exact_match").otherwise("mutation_owner_repair_target_mismatch")
    name = F.when(reason == "mutation_owner_sticky_exact_match", F.col("b.name")).when(reason == "mutation_owner_unique_exact_match", F.get(F.col("least"), F.lit(0))["name"])
    return per.select("id", reason.alias("reason"), name.alias("name"))


def capsules(scopes: DataFrame, budget: int = 4600, most: int = 4) -> DataFrame:
    """(id, name, phase, rank, n_bytes) -> (id, name, position): scopes of a capsule, by phase and rank, each whole or passed over, at most ``most``."""
    from . import ranges

    fits = ranges.greedy_budget(scopes, ["id"], ["phase", "rank"], F.col("n_bytes"), budget)
    position = F.row_number().over(Window.partitionBy("id").orderBy("phase", "rank"))
    return fits.withColumn("position", position).where(F.col("position") <= most).select("id", "name", "position")


def recovered_owners(groups: DataFrame, responses: DataFrame) -> DataFrame:
    """Groups (id, name) of validated graph files whose distillation (id, raw, mapped, exact_spans, anchors, witnesses, truncated) may be trusted."""
    safe = (F.col("raw") == F.col("mapped")) & (F.col("exact_spans") == 0) & F.col("anchors") & F.col("witnesses") & ~F.col("truncated")
    return groups.where("name <> '<module>'").join(responses.where(safe).select("id"), "id", "left_semi")


def run_completeness(files: DataFrame) -> DataFrame:
    """(id, requested, parsed, error, unsupported, truncated) of files -> id, complete: an index run is complete if every file was parsed whole."""
    bad = F.col("error") | F.col("unsupported") | F.col("truncated") | ~F.col("parsed")
    return files.groupBy("id").agg((~F.bool_or(bad)).alias("complete"), F.count_if("parsed").alias("parsed"), F.count("*").alias("requested"))
