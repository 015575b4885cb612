"""Queries of decisions about edits: orders are turns, customers tasks, lines of an order its checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import commits, verify
from corvane.query import query, table

_KINDS = sorted(verify.COMPLETION)
_kinds = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"


def _key():
    return F.col("o_orderkey")


def _orders(spark, d):
    return table(spark, d, "orders")


def _sha(c):
    return F.sha2(F.concat(F.lit("t"), c), 256)


@query("check_mutation_shape", """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'replace_node_requires_before' WHEN 2 THEN 'replace_node_requires_before_replacement' WHEN 3 THEN 'replace_node_forbids_body_scope'
    WHEN 4 THEN NULL WHEN 5 THEN 'rename_symbol_requires_new_name' WHEN 6 THEN 'target_fields_forbidden_capability_bound' ELSE 'mutation_kind_unknown' END AS failure FROM orders""")
def mutation_shape(spark, d):
    n = _key() % 8
    kind = F.when(n < 4, "replace_node").when(n < 7, "rename_symbol").otherwise("move")
    fields = [("kind", F.lit(True), kind), ("before", n.isin(0, 3), "x"), ("replacement", n.isin(0, 1, 3), ""), ("body", n == 3, "x"), ("scope", n == 3, "x"), ("new_name", n.isin(4, 6), "y"), ("file", n == 6, "f")]
    pairs = F.array(*(F.struct(F.when(there, k).otherwise("-").alias("key"), (F.lit(v) if isinstance(v, str) else v).alias("value")) for k, there, v in fields))
    mutation = F.map_from_entries(F.filter(pairs, lambda p: p["key"] != "-"))
    return _orders(spark, d).select(_key().alias("id"), mutation.alias("mutation")).select("id", commits.shape_failure().alias("failure"))


@query("check_rename_capability", """SELECT o_orderkey AS id, r IS NULL AS ready, r AS reason FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'handoff_not_ready' WHEN o_orderkey % 4 = 0 THEN 'no_definition' WHEN o_orderkey % 4 = 2 THEN 'ambiguous' WHEN o_orderkey % 5 = 0 THEN 'files_outside_handoff' WHEN o_orderkey % 7 = 0 THEN 'destination_not_fresh' WHEN o_orderkey % 11 = 0 THEN 'reflective_use' END AS r FROM orders)""")
def rename_capability(spark, d):
    files = F.array(F.lit("a"), F.when(_key() % 5 == 0, "c").otherwise("b"))
    rows = _orders(spark, d).select(
        _key().alias("id"), F.when(_key() % 9 == 0, "partial").otherwise("ready").alias("status"), files.alias("found_files"), F.array(F.lit("a"), F.lit("b")).alias("handed_files"),
        F.when(_key() % 4 == 3, 1).otherwise(_key() % 4).alias("n_definitions"), (_key() % 7 == 0).alias("destination_used"), (_key() % 11 == 0).alias("reflective"),
    )
    return commits.rename_capability(rows)


def _states(spark, d):
    """Turns that could commit a rename, most with one thing amiss."""
    task, old = _sha(F.col("o_custkey")), F.concat(F.lit("a"), "o_custkey")
    return _orders(spark, d).select(
        _key().alias("id"), F.when(_key() % 17 == 0, "repair").otherwise("mutate").alias("state"), (_key() % 19 == 0).alias("drifted"), (_key() % 23 == 0).alias("accepted"), (_key() % 29 == 0).alias("rescout"), F.when(_key() % 5 == 0, 1).otherwise(0).alias("attempts"),
        F.when(_key() % 7 == 0, "unresolved").otherwise("exact").alias("status"), task.alias("task_sha256"), F.when(_key() % 31 == 0, "0").otherwise(task).alias("turn_sha256"), old.alias("old_name"), F.concat(F.lit("b"), "o_custkey").alias("new_name"),
        F.when(_key() % 37 == 0, "execute_replace_node").otherwise("execute_rename_symbol").alias("tool"), (_key() % 41 != 0).alias("capable"), old.alias("target"), _sha(_key()).alias("source_sha256"), F.when(_key() % 43 == 0, "none").otherwise(_sha(_key() + 1)).alias("capsule_sha256"),
    )


_COMMIT = """CASE WHEN o_orderkey % 17 = 0 THEN 'action_commit_not_initial_mutate' WHEN o_orderkey % 19 = 0 THEN 'action_commit_task_drift' WHEN o_orderkey % 23 = 0 THEN 'action_commit_patch_already_accepted' WHEN o_orderkey % 29 = 0 THEN 'action_commit_rescout_pending' WHEN o_orderkey % 5 = 0 THEN 'action_commit_not_first_attempt'
    WHEN o_orderkey % 7 = 0 OR o_orderkey % 31 = 0 THEN 'action_commit_task_not_exact_rename' WHEN o_orderkey % 37 = 0 THEN 'action_commit_frontier_mismatch' WHEN o_orderkey % 41 = 0 THEN 'action_commit_rename_capability_mismatch' WHEN o_orderkey % 43 = 0 THEN 'action_commit_capsule_unavailable' ELSE 'exact_rename_committed' END"""
_CANON = """'{"task_sha256":"' || sha256('t' || o_custkey) || '","old_name":"a' || o_custkey || '","new_name":"b' || o_custkey || '","target":"a' || o_custkey || '","source_sha256":"' || sha256('t' || o_orderkey) || '","capsule_sha256":"' || sha256('t' || (o_orderkey + 1)) || '"}'"""


@query("commit_actions", f"SELECT o_orderkey AS id, {_COMMIT} AS reason, CASE WHEN {_COMMIT} = 'exact_rename_committed' THEN sha256({_CANON}) END AS commit_sha256 FROM orders")
def action_commits(spark, d):
    return commits.action_commits(_states(spark, d))


_CL = "(SELECT o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 6 = 0 THEN 'bad' ELSE sha256('t' || (o_orderkey % 2)) END AS c FROM orders)"


def _claims(spark, d):
    return _orders(spark, d).select(F.col("o_custkey").alias("id"), _key().alias("seq"), F.when(_key() % 6 == 0, "bad").otherwise(_sha(_key() % 2)).alias("commit_sha256"))


def _claims_sql(ok: str) -> str:
    return f"""WITH f AS (SELECT id, min(seq) AS s, arg_min(c, seq) AS c FROM {_CL} WHERE c <> 'bad' GROUP BY id), r AS (SELECT x.id, seq, CASE WHEN x.c = 'bad' THEN 'invalid' WHEN seq = s THEN 'claimed' WHEN x.c = f.c THEN 'duplicate' ELSE 'conflict' END AS reason FROM {_CL} x LEFT JOIN f USING (id))
        SELECT id, seq, reason IN ({ok}) AS ok, reason FROM r"""


@query("commit_action_claims", _claims_sql("'claimed'"))
def action_claims(spark, d):
    return commits.claims(_claims(spark, d), replay_ok=False)


@query("commit_terminal_claims", _claims_sql("'claimed', 'duplicate'"))
def terminal_claims(spark, d):
    return commits.claims(_claims(spark, d), replay_ok=True)


@query("commit_terminals", """WITH r AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'terminal_commit_not_verified_terminal' WHEN o_orderkey % 7 = 0 THEN 'terminal_commit_task_identity_invalid' WHEN o_orderkey % 11 = 0 THEN 'terminal_commit_artifact_path_invalid' WHEN o_orderkey % 13 = 0 THEN 'terminal_commit_receipt_protocol_mismatch'
    WHEN o_orderkey % 17 = 0 THEN 'terminal_commit_proof_not_pass' WHEN o_orderkey % 19 = 0 THEN 'terminal_commit_artifact_identity_invalid' WHEN o_orderkey % 23 = 0 THEN 'terminal_commit_patch_identity_mismatch' ELSE 'verified_terminal_committed' END AS reason FROM orders)
    SELECT o_orderkey AS id, reason, CASE WHEN reason = 'verified_terminal_committed' THEN sha256('{"task_sha256":"' || sha256('t' || o_custkey) || '","receipt_path":"r/' || o_orderkey || '","patch_sha256":"' || sha256('t' || o_orderkey) || '"}') END AS commit_sha256 FROM r""")
def terminal_commits(spark, d):
    path = F.concat(F.lit("r/"), _key())
    rows = _orders(spark, d).select(
        _key().alias("id"), (_key() % 5 != 0).alias("accepted"), F.lit("done").alias("state"), F.lit("patch_ready").alias("event"), F.lit(True).alias("latched"), (_key() % 7 == 0).alias("drifted"), _sha(F.col("o_custkey")).alias("task_sha256"),
        path.alias("receipt_path"), F.when(_key() % 11 == 0, "x").otherwise(path).alias("claimed_path"), F.when(_key() % 13 == 0, "x").otherwise(path).alias("verification_refers"), F.when(_key() % 17 == 0, "repair").otherwise("pass").alias("disposition"),
        (_key() % 19 != 0).alias("verified"), _sha(_key()).alias("patch_sha256"), F.when(_key() % 23 == 0, "0").otherwise(_sha(_key())).alias("verified_sha256"),
    )
    return commits.terminal_commits(rows)


@query("commit_task_match", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'invalid' WHEN o_orderkey % 5 = 0 THEN 'task_snapshot_invalid' WHEN o_orderkey % 7 = 0 THEN 'task_turn_changed' WHEN o_orderkey % 11 = 0 THEN 'task_text_drift' ELSE 'task_match' END AS reason FROM orders")
def task_match(spark, d):
    o = _orders(spark, d)
    made = o.select(_key().alias("id"), F.lit(1).alias("turn"), F.when(_key() % 3 == 0, "").otherwise(_sha(_key())).alias("task_sha256"))
    now = o.where("o_orderkey % 5 <> 0").select(_key().alias("id"), F.when(_key() % 7 == 0, 2).otherwise(1).alias("turn"), F.when(_key() % 11 == 0, _sha(_key() + 1)).otherwise(_sha(_key())).alias("task_sha256"))
    return commits.task_match(made, now)


@query("commit_artifacts", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'terminal_patch_receipt_stale' WHEN doc_id % 5 = 0 THEN 'terminal_verification_receipt_stale' WHEN doc_id % 7 = 0 THEN 'terminal_patch_stale' ELSE 'terminal_artifacts_match' END AS reason FROM documents")
def artifacts_fresh(spark, d):
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    body = lambda k: F.concat(F.lit(f"{k} "), n, F.lit(" "), "text")
    kinds = [("patch_receipt", 3), ("verification_receipt", 5), ("patch", 7)]
    made = F.array(*(F.struct(F.lit(k).alias("kind"), F.concat(F.lit(f"{k}/"), n).alias("path"), F.sha2(body(k), 256).alias("sha256")) for k, _ in kinds))
    # a changed body, or none at all
    now = F.array(*(F.struct(F.concat(F.lit(f"{k}/"), n).alias("path"), F.when(n % m == 0, F.when(n % 2 == 0, F.concat(body(k), F.lit("!")))).otherwise(body(k)).alias("body")) for k, m in kinds))
    return commits.artifacts_fresh(docs.select(n.alias("id"), F.explode(made).alias("a")).select("id", "a.*"), docs.select(F.explode(now).alias("a")).select("a.*"))


def _checks(spark, d):
    """A line is a check of its order."""
    kinds = F.array(*map(F.lit, _KINDS))
    n = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(n.alias("id"), F.element_at(kinds, (F.col("l_linenumber") % len(_KINDS) + 1).cast("int")).alias("kind"), (F.col("l_suppkey") % 9 != 0).alias("pass"), F.when(F.col("l_partkey") % 3 == 0, "native_enforced").when(F.col("l_partkey") % 3 == 1, "structural_only").alias("coverage"))


_CH = f"(SELECT l_orderkey AS id, {_kinds}[l_linenumber % {len(_KINDS)} + 1] AS kind, l_suppkey % 9 <> 0 AS pass, l_partkey % 3 AS c FROM lineitem)"


@query("check_verifications", f"""WITH g AS (SELECT id, count(*) AS total, count(*) FILTER (NOT pass) AS failed, count(*) FILTER (kind = 'candidate_hygiene') AS h, count(*) FILTER (c = 0) AS a, count(*) FILTER (c = 1) AS b FROM {_CH} GROUP BY id)
    SELECT o_orderkey AS id, o_orderkey % 8 <> 0 AND o_orderkey % 5 <> 0 AND coalesce(failed, 0) = 0 AND coalesce(h, 0) > 0 AS ok, coalesce(total, 0) AS total, coalesce(failed, 0) AS failed, CASE WHEN coalesce(a, 0) > 0 AND b > 0 THEN 'mixed' WHEN coalesce(a, 0) > 0 THEN 'native_enforced' WHEN coalesce(b, 0) > 0 THEN 'structural_only' ELSE 'none' END AS coverage FROM orders LEFT JOIN g ON g.id = o_orderkey""")
def verifications(spark, d):
    runs = _orders(spark, d).select(_key().alias("id"), F.when(_key() % 8 == 0, "timeout").alias("reason"), (_key() % 5 != 0).alias("cleaned"))
    return commits.verifications(_checks(spark, d), runs)


@query("check_completions", f"""WITH c AS (SELECT o_orderkey AS id, unnest({_kinds}) AS kind FROM orders), x AS (SELECT id, kind FROM c WHERE NOT (id % 7 = 0 AND kind = 'candidate_hygiene')), f AS (SELECT DISTINCT id FROM x WHERE id % 11 = 0 AND kind = 'replay_exact')
    SELECT o_orderkey AS id, CASE WHEN r IS NULL THEN 'CERTIFY' ELSE 'ABSTAIN' END AS decision, r AS reason FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unsupported_task_class' WHEN o_orderkey % 5 = 0 THEN 'task_action_invalid' WHEN o_orderkey % 13 = 0 THEN 'proof_obligations_mismatch' WHEN f.id IS NOT NULL THEN 'verifier_completion_evidence_invalid'
    WHEN (SELECT count(*) FROM x WHERE x.id = o_orderkey) < {len(_KINDS)} THEN 'verifier_completion_check_missing_or_failed' END AS r FROM orders LEFT JOIN f ON f.id = o_orderkey)""")
def completions(spark, d):
    o = _orders(spark, d)
    rows = o.select(_key().alias("id"), F.explode(F.array(*map(F.lit, _KINDS))).alias("kind")).where("not (id % 7 = 0 and kind = 'candidate_hygiene')")
    checks = rows.withColumn("pass", ~((F.col("id") % 11 == 0) & (F.col("kind") == "replay_exact")))
    duties = sorted(verify.OBLIGATIONS)
    asked = F.when(_key() % 13 == 0, F.array(*map(F.lit, duties[1:]))).otherwise(F.array(*map(F.lit, duties[::-1])))
    requests = o.select(_key().alias("id"), F.when(_key() % 3 == 0, "unresolved").otherwise("exact").alias("status"), F.lit("a").alias("old_name"), F.when(_key() % 5 == 0, "a").otherwise("b").alias("new_name"), _sha(_key()).alias("task_sha256"), asked.alias("obligations"))
    return commits.completions(checks, requests)


@query("commit_safe_fails", """WITH r AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 'completion_safe_fail_not_applicable' WHEN o_orderkey % 3 = 0 THEN 'completion_safe_fail_already_certified' WHEN o_orderkey % 5 = 0 THEN 'completion_safe_fail_identity_invalid' ELSE 'completion_safe_fail_ready' END AS reason FROM orders)
    SELECT o_orderkey AS id, reason, CASE WHEN reason = 'completion_safe_fail_ready' THEN sha256('{"decision":"ABSTAIN","task_sha256":"' || sha256('t' || o_custkey) || '","patch_sha256":"' || sha256('t' || o_orderkey) || '"}') END AS commit_sha256 FROM r""")
def safe_fails(spark, d):
    rows = _orders(spark, d).select(_key().alias("id"), (_key() % 4 != 0).alias("applicable"), F.when(_key() % 3 == 0, "CERTIFY").otherwise("ABSTAIN").alias("decision"), _sha(F.col("o_custkey")).alias("task_sha256"), F.when(_key() % 5 == 0, "").otherwise(_sha(_key())).alias("patch_sha256"))
    return commits.safe_fails(rows)


@query("check_runtime_identity", "SELECT o_custkey AS id, count(*) FILTER (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0) = 0 AS same, min(CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'n' || o_orderkey END) AS first_difference FROM orders GROUP BY o_custkey")
def runtime_identity(spark, d):
    o = _orders(spark, d).select(F.col("o_custkey").alias("id"), F.concat(F.lit("n"), _key()).alias("name"), "o_orderkey", "o_orderstatus")
    manifest = o.select("id", "name", F.sha2("o_orderstatus", 256).alias("sha256"))
    return commits.runtime_identity(manifest, o.where("o_orderkey % 5 <> 0").select("id", "name", F.when(_key() % 7 == 0, "x").otherwise(F.col("o_orderstatus")).alias("body")))


@query("target_exact_owner", """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'mutation_owner_unique_exact_match' WHEN 1 THEN 'mutation_owner_no_exact_match' WHEN 2 THEN 'mutation_owner_ambiguous_exact_match' WHEN 3 THEN 'mutation_owner_sticky_exact_match' ELSE 'mutation_owner_repair_target_mismatch' END AS reason,
    CASE o_orderkey % 5 WHEN 0 THEN 'inner' WHEN 3 THEN 'outer' END AS name FROM orders""")
def exact_owner(spark, d):
    n = _key() % 5
    names = F.array(*(F.struct(F.lit(x).alias("name"), F.lit(a).alias("start"), F.lit(b).alias("end")) for x, a, b in (("outer", 1, 9), ("inner", 3, 5), ("other", 7, 8))))
    c = _orders(spark, d).select(_key().alias("id"), n.alias("n"), F.explode(names).alias("c")).select("id", "n", "c.*")
    holds = (F.col("name") == "outer") | ((F.col("name") == "inner") & F.col("n").isin(0, 2, 4)) | ((F.col("name") == "other") & (F.col("n") == 2))
    source = F.concat(F.lit("def f\r\n"), F.when(holds & (F.col("n") != 1), F.concat(F.lit("  return k"), "id")).otherwise("pass"), F.lit("\r\n"))
    bound = ((F.col("n") == 3) & (F.col("name") == "outer")) | ((F.col("n") == 4) & (F.col("name") == "other"))
    before = F.concat(F.lit(" return k"), _key(), F.lit("\r"))
    return commits.exact_owner(c.select("id", "name", "start", "end", source.alias("source"), bound.alias("bound")), _orders(spark, d).select(_key().alias("id"), before.alias("before")))


@query("select_capsules", """WITH RECURSIVE o AS (SELECT o_custkey AS id, 's' || o_orderkey AS name, o_orderkey % 3 AS phase, o_orderkey AS rank, 700 + o_orderkey * 37 % 1900 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderkey) AS rn FROM orders),
    f AS (SELECT id, name, rn, CASE WHEN n <= 4600 THEN n ELSE 0 END AS spent, n <= 4600 AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.id, o.name, o.rn, CASE WHEN spent + n <= 4600 THEN spent + n ELSE spent END, spent + n <= 4600 FROM f JOIN o ON o.id = f.id AND o.rn = f.rn + 1)
    SELECT id, name, position::INT AS position FROM (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY rn) AS position FROM f WHERE kept) WHERE position <= 4""")
def capsules(spark, d):
    rows = _orders(spark, d).select(F.col("o_custkey").alias("id"), F.concat(F.lit("s"), _key()).alias("name"), (_key() % 3).alias("phase"), _key().alias("rank"), (700 + _key() * 37 % 1900).alias("n_bytes"))
    return commits.capsules(rows)


@query("evidence_recovered_owners", "SELECT o_orderkey AS id, 'o' || o_custkey AS name FROM orders WHERE o_custkey % 4 <> 0 AND o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0")
def recovered_owners(spark, d):
    o = _orders(spark, d)
    groups = o.select(_key().alias("id"), F.when(F.col("o_custkey") % 4 == 0, "<module>").otherwise(F.concat(F.lit("o"), "o_custkey")).alias("name"))
    told = o.select(_key().alias("id"), F.lit(5).alias("raw"), F.when(_key() % 3 == 0, 5).otherwise(4).alias("mapped"), F.lit(0).alias("exact_spans"), F.lit(True).alias("anchors"), F.lit(True).alias("witnesses"), (_key() % 7 == 0).alias("truncated"))
    return commits.recovered_owners(groups, told)


@query("check_index_runs", "SELECT o_custkey AS id, bool_and(o_orderkey % 9 <> 0 AND o_orderkey % 13 <> 0) AS complete, count(*) FILTER (o_orderkey % 13 <> 0) AS parsed, count(*) AS requested FROM orders GROUP BY o_custkey")
def index_runs(spark, d):
    rows = _orders(spark, d).select(F.col("o_custkey").alias("id"), (_key() % 13 != 0).alias("parsed"), (_key() % 9 == 0).alias("error"), F.lit(False).alias("unsupported"), F.lit(False).alias("truncated"))
    return commits.run_completeness(rows)


# --- replay and tasks


_T1 = "(length(text) - length(replace(text, 'MIT License', ''))) / 11"


@query("check_replay", f"""WITH t AS (SELECT doc_id AS id, text, {_T1} AS n, replace(text, 'MIT License', 'A License') AS one FROM documents), u AS (SELECT *, (length(one) - length(replace(one, 'A License', ''))) / 9 AS m FROM t)
    SELECT id, n = 1 AND m = 1 AND id % 4 <> 0 AS pass, CASE WHEN n <> 1 OR m <> 1 THEN 'edit_precondition_not_unique' WHEN id % 4 = 0 THEN 'replay_mismatch' END AS detail FROM u""")
def replay(spark, d):
    docs = table(spark, d, "documents")
    edit = lambda a, b: F.struct(F.lit(a).alias("before"), F.lit(b).alias("after"))
    after = F.replace(F.replace("text", F.lit("MIT License"), F.lit("A License")), F.lit("A License"), F.lit("B"))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("before"), F.array(edit("MIT License", "A License"), edit("A License", "B")).alias("edits"), F.when(F.col("doc_id") % 4 == 0, F.concat(after, F.lit("!"))).otherwise(after).alias("after"))
    return verify.replay_checks(rows).select("id", "pass", "detail")


_TASK = """CASE c_custkey % 12 WHEN 0 THEN concat('Rename helper a', c_custkey, ' to b', c_custkey, '.') WHEN 1 THEN concat('Please rename c', c_custkey, ' as d', c_custkey, '.') WHEN 2 THEN concat('Change the name of a', c_custkey, ' to b', c_custkey % 7, '.')
    WHEN 3 THEN concat('Переименуй a', c_custkey, ' в b', c_custkey, '.') WHEN 4 THEN concat('Rename helper a', c_custkey, '.') WHEN 5 THEN concat('Raise the limit to ', c_custkey, ' without renaming a', c_custkey, '.') WHEN 6 THEN concat('Fix the rename bug in a', c_custkey, '.')
    WHEN 7 THEN '' WHEN 8 THEN concat('Rename a', c_custkey, ' to b. Rename c to d', c_custkey, '.') WHEN 9 THEN concat('Rename a', c_custkey, ' to a', c_custkey, '.') WHEN 10 THEN concat('Не переименовывай a', c_custkey, ' в b.') ELSE concat(c_mktsegment, ' first. rename x', c_custkey, ' -> y') END"""
_PAIRS = f"(SELECT c_custkey AS id, t, regexp_extract_all(t, '(?:[Rr]ename|Переименуй|name of)(?: helper)? (\\w+) (?:to|as|в|->) (\\w+)', 1) AS a, regexp_extract_all(t, '(?:[Rr]ename|Переименуй|name of)(?: helper)? (\\w+) (?:to|as|в|->) (\\w+)', 2) AS b FROM (SELECT *, {_TASK} AS t FROM customer))"


def _tasks(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(_TASK).alias("text"))


@query("task_intents", f"SELECT id, CASE WHEN t = '' THEN 'unknown' WHEN len(a) > 0 THEN 'rename_symbol' WHEN regexp_matches(t, '^Rename') THEN 'unknown' ELSE 'generic_edit' END AS intent FROM {_PAIRS}")
def task_intents(spark, d):
    from corvane.functions import tasks

    return tasks.intents(_tasks(spark, d), ["id"])


@query("task_rename_actions", f"""SELECT id, CASE WHEN len(a) = 1 AND a[1] <> b[1] THEN 'exact' ELSE 'unresolved' END AS status, CASE WHEN len(a) = 1 AND a[1] <> b[1] THEN a[1] END AS old_name, CASE WHEN len(a) = 1 AND a[1] <> b[1] THEN b[1] END AS new_name,
    CASE WHEN t = '' THEN 'task_action_text_empty' WHEN regexp_matches(t, 'without renaming|Не переимен') THEN 'task_action_negative_rename' WHEN len(a) > 1 THEN 'task_action_multiple_rename_pairs' WHEN len(a) = 1 AND a[1] <> b[1] THEN 'exact_rename_pair' ELSE 'task_action_not_exact' END AS reason FROM {_PAIRS}""")
def rename_actions(spark, d):
    from corvane.functions import tasks

    return tasks.rename_actions(_tasks(spark, d))


@query("task_conversation_intents", "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'rename_symbol' WHEN conv_id % 3 = 1 AND turn % 2 = 0 THEN 'unknown' WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'unknown' ELSE 'generic_edit' END AS intent FROM conversations WHERE role = 'user'")
def conversation_intents(spark, d):
    """Messages of three shapes: parts in JSON, a list of parts, plain text."""
    from corvane.functions import tasks

    rows = table(spark, d, "conversations").where("role = 'user'")
    n = F.col("conv_id")
    json = F.concat(F.lit('[{"type":"text","text":"Rename a'), n, F.lit(' to b"},{"type":"image"},{"type":"text","text":"now"}]'))
    parts = F.when((n % 3 == 1) & (F.col("turn") % 2 == 0), F.array(F.lit("Change the identifier"), F.lit("please")))
    event = F.struct("role", F.when(n % 3 == 0, json).when(n % 3 == 2, F.col("text")).alias("content"), parts.alias("parts"), F.when((n % 3 == 1) & (F.col("turn") % 2 == 1), F.col("text")).alias("text"))
    return tasks.intents(rows.select("conv_id", "turn", tasks.task_text(event).alias("text")), ["conv_id", "turn"])
