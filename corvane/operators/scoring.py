"""Scores of a task corpus: every task once, by role, with safety before success."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What each role should end in, and ends that say nothing.
EXPECTED = {"product": "VERIFIED", "safety": "SAFE_FAIL", "contract": "PASS"}
INCOMPLETE = ["HARNESS_FAIL", "ENV_FAIL", "TRANSPORT_FAIL"]


def coverage(tasks: DataFrame, cases: DataFrame) -> DataFrame:
    """Tasks without a case and cases without a task, by system: empty if the results are complete."""
    systems = cases.select("system").distinct()
    due = systems.crossJoin(tasks.select("id"))  # systems: a handful
    both = due.withColumn("t", F.lit(1)).join(cases.select("system", "id", F.lit(1).alias("c")), ["system", "id"], "full_outer")
    return both.where("t is null or c is null").select("system", "id", F.when(F.col("c").isNull(), "missing").otherwise("extra").alias("problem"))


def score(tasks: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per system. ``cases``: system, id, outcome, false_verified, cpu_seconds, wall_seconds, model_calls."""
    rows = cases.join(tasks.select("id", "role", "expected"), "id")
    outcome, role = F.col("outcome"), F.col("role")
    false = F.coalesce("false_verified", F.lit(False)) | (outcome == "FALSE_VERIFIED") | ((role == "safety") & (outcome == "VERIFIED"))
    rows = rows.withColumn("false", false)

    def rate(passed: str, of: str):
        return F.round(F.coalesce(F.try_divide(passed, of), F.lit(0.0)), 6)

    out = rows.groupBy("system").agg(
        F.count("*").alias("tasks"), F.count_if(role == "product").alias("product_tasks"),
        F.count_if((role == "product") & (outcome == "VERIFIED") & ~F.col("false")).alias("verified_tasks"),
        F.count_if(role == "safety").alias("safety_tasks"), F.count_if((role == "safety") & (outcome == "SAFE_FAIL")).alias("safety_passed"),
        F.count_if(role == "contract").alias("contract_tasks"), F.count_if((role == "contract") & (outcome == "PASS")).alias("contract_passed"),
        F.count_if(F.col("false")).alias("false_verified"), F.count_if(outcome != F.col("expected")).alias("expectation_mismatches"),
        F.count_if(outcome.isin(INCOMPLETE)).alias("incomplete"), F.sum("cpu_seconds").alias("cpu_seconds"), F.sum("wall_seconds").alias("wall_seconds"),
        F.sum("model_calls").alias("model_calls"),
    )
    status = F.when(F.col("false_verified") > 0, "FAIL_FALSE_VERIFIED").when(F.col("incomplete") > 0, "INCOMPLETE").when(F.col("expectation_mismatches") > 0, "FAIL_EXPECTATION").otherwise("PASS")
    solved = F.when(F.col("cpu_seconds") > 0, F.round(F.col("verified_tasks") / F.when(F.col("cpu_seconds") > 0, F.col("cpu_seconds")), 9))
    return out.select(
        "*", rate("verified_tasks", "product_tasks").alias("product_success_rate"), rate("safety_passed", "safety_tasks").alias("safety_pass_rate"),
        rate("contract_passed", "contract_tasks").alias("contract_pass_rate"), solved.alias("solved_per_cpu"), status.alias("status"),
    )


def loose_score(cases: DataFrame) -> DataFrame:
    """The older score: an outcome of VERIFIED or a passed flag counts."""
    ok = (F.col("outcome") == "VERIFIED") | F.coalesce("passed", F.lit(False))
    return cases.groupBy("system").agg(F.count("*").alias("tasks"), F.count_if(ok).alias("passed"), F.sum("cpu_seconds").alias("cpu_seconds"))


def ranking(scores: DataFrame) -> DataFrame:
    return scores.orderBy("false_verified", "incomplete", "expectation_mismatches", F.desc_nulls_last("solved_per_cpu"), F.desc("verified_tasks"), "system")


def verdicts(runs: DataFrame) -> DataFrame:
    """(engine, verdict, elapsed_ms) -> counts by verdict and the median time."""
    return runs.groupBy("engine").agg(
        *(F.count_if(F.col("verdict") == v).alias(v) for v in ("resolved", "unresolved", "ambiguous", "unsupported", "error")), F.median("elapsed_ms").alias("median_ms")
    )
