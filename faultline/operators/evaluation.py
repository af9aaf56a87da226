"""Evaluation of recorded runs: trace metrics, verdicts, correctness against expectations, matrices and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trace_metrics(events: DataFrame) -> DataFrame:
    """``events(run_id, event, kind, status, stage, name, request_count, invalid_count, malformed)`` to a row of metrics a run."""
    e = F.coalesce("event", F.lit(""))
    outcome = F.col("kind").isin("tool", "action") & e.rlike(r"\.(finished|success|failed)$")
    parsed = e == "agent.context_requests_parsed"
    total = lambda c: F.sum(F.when(parsed, F.coalesce(c, F.lit(0))).otherwise(0))
    rollback = ((F.col("name") == "rollback") | (F.col("stage") == "rollback")) & F.col("status").isin("success", "completed")
    by = events.groupBy("run_id").agg(
        F.count("*").alias("event_count"),
        total("request_count").alias("context_requests"),
        total("invalid_count").alias("invalid_requests"),
        F.count_if((e == "tool.policy") & (F.col("status") == "denied")).alias("policy_denials"),
        F.count_if(outcome & (F.col("status") == "success")).alias("tool_successes"),
        F.count_if(outcome & F.col("status").isin("failed", "error")).alias("tool_failures"),
        F.coalesce(F.bool_or(rollback), F.lit(False)).alias("rollback_triggered"),
        F.count_if((e == "schema_violation") | F.coalesce("malformed", F.lit(False))).alias("malformed_outputs"),
    )
    rate = lambda good, bad: F.when(F.col(good) + F.col(bad) > 0, F.col(good) / (F.col(good) + F.col(bad))).otherwise(1.0)
    return by.withColumn("context_valid_rate", rate("context_requests", "invalid_requests")).withColumn("tool_success_rate", rate("tool_successes", "tool_failures"))


def _match(actual: Column, expected: Column) -> Column:
    return F.when(expected.isNull() | (expected == ""), "unknown").when(F.coalesce(F.lower(actual), F.lit("")) == F.lower(expected), "correct").otherwise("incorrect")


def evaluate_cases(runs: DataFrame, manifest: DataFrame, dimensions: Sequence[str] = ("category", "fault_mode", "file", "function")) -> DataFrame:
    """Each case of the manifest (``case_id, expected_*``) against its run: correct, incorrect or unknown per dimension, and the
    status ``missing_report`` where there is no run."""
    have = runs.withColumn("_run", F.lit(True))
    rows = manifest.join(have, "case_id", "left")
    return rows.select("case_id", F.when(F.col("_run"), "ok").otherwise("missing_report").alias("status"), *[F.when(F.col("_run"), _match(F.col(d), F.col(f"expected_{d}"))).otherwise("unknown").alias(f"{d}_match") for d in dimensions])


def summarize_matrix(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``results(diagnosis, patch_valid, runtime_clean, evidence_items, decide, judge, decision_match, judge_match, valid_rate)``:
    totals and rates; match rates are over what was expected, null when nothing was."""
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    expected = lambda c: F.when(F.count_if(F.col(c) != "unknown") > 0, F.count_if(F.col(c) == "correct") / F.count_if(F.col(c) != "unknown"))
    return results.groupBy(*by).agg(
        F.count("*").alias("total_cases"),
        F.count_if(F.col("diagnosis") == "correct").alias("diagnosis_correct"),
        F.count_if("patch_valid").alias("repair_valid"),
        F.count_if("runtime_clean").alias("runtime_clean"),
        F.coalesce(rate(F.col("evidence_items") > 0), F.lit(0.0)).alias("evidence_coverage"),
        F.coalesce(rate(F.col("decide") == "accept"), F.lit(0.0)).alias("decide_accept_rate"),
        F.coalesce(rate(F.col("judge") == "accept"), F.lit(0.0)).alias("judge_accept_rate"),
        expected("decision_match").alias("decision_match_rate"),
        expected("judge_match").alias("judge_match_rate"),
        F.coalesce(F.avg(F.coalesce("valid_rate", F.lit(1.0))), F.lit(1.0)).alias("context_valid_rate"),
    )


def trial_stability(trials: DataFrame) -> DataFrame:
    """``trials(case_id, trial, plan, success)``: different plans (white space aside) and outcomes over a case's trials."""
    print_ = F.sha2(F.regexp_replace(F.trim("plan"), r"\s+", " "), 256)
    return trials.groupBy("case_id").agg(F.count("*").alias("trials"), F.countDistinct(print_).alias("plans"), F.countDistinct("success").alias("outcomes")).withColumn("stable", (F.col("plans") == 1) & (F.col("outcomes") == 1))


def compare_runs(before: DataFrame, after: DataFrame, key: str = "case_id") -> DataFrame:
    """Crash rates before and after a change (counts over iterations where not given), the difference, and a final status."""
    side = lambda df, p: df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key])
    rows = side(before, "b").join(side(after, "a"), key)
    rate = lambda p: F.coalesce(F.col(f"{p}_crash_rate"), F.when(F.col(f"{p}_iterations") > 0, F.col(f"{p}_crash_count") / F.col(f"{p}_iterations")))
    same = F.coalesce(F.col("b_plan_fingerprint") == F.col("a_plan_fingerprint"), F.lit(False))
    level = F.upper(F.coalesce("a_verification_level", "b_verification_level", F.lit("L3")))
    verified = F.when(level == "L2", "compile_verified").when(level == "L3", "native_verified").when(level == "L4", "integration_verified").otherwise("strongly_supported")
    b, a = F.coalesce("b_crash_count", F.lit(0)), F.coalesce("a_crash_count", F.lit(0))
    status = F.when(same & (b > 0) & (a == 0), verified).when(same & (b > 0) & (a > 0), "contradicted").when((b == 0) & ~F.coalesce("b_target_path_reached", F.lit(True)), "harness_invalid").when(b == 0, "not_triggered").otherwise("inconclusive")
    return rows.select(key, same.alias("same_plan"), rate("b").alias("rate_before"), rate("a").alias("rate_after"), (rate("a") - rate("b")).alias("rate_delta"), status.alias("status"))


def score_decisions(runs: DataFrame) -> DataFrame:
    """``runs(run_status, pipeline_skipped, has_patch, patch_success, applied_count, schema_violation, exact_only, diff_status,
    verification, regression, post_fix_status)`` with ``patch_valid``, ``diff_review_passed``, ``verification_passed``,
    ``diagnosis_stable`` and ``decision`` (accept, reject, pending or partial) added.

    A repair needs terminal feedback: where verification did not run it holds only for patches that replace text exactly.
    Without patch and verification a finished run is accepted as an analysis.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    flag = lambda c: F.coalesce(c, F.lit(False))
    status, verification, post = text("run_status"), text("verification"), text("post_fix_status")
    patch = flag("has_patch")
    patch_ok = patch & flag("patch_success") & (F.coalesce("applied_count", F.lit(0)) > 0) & ~flag("schema_violation")
    diff_ok = text("diff_status") != "failed"
    # no verification at all counts as skipped, which suffices for an analysis only
    not_run = patch & verification.isin("", "skipped", "unavailable", "not_configured", "configured_but_unavailable", "not_triggered", "unknown")
    passed = verification.isin("passed", "repair_applied", "issue_verified", "regression_verified", "verified", "inconclusive", "skipped", "")
    verify_ok = F.when(not_run, flag("exact_only")).otherwise(passed)
    stable = ~flag("regression") & post.isin("passed", "skipped", "")
    partial = ~not_run & verification.isin("repair_applied", "issue_verified", "regression_verified", "inconclusive")
    analysis = ~patch & F.col("verification").isNull() & ~flag("pipeline_skipped") & status.isin("success", "done", "")
    decision = (
        F.when(analysis, "accept")
        .when(flag("pipeline_skipped"), "partial")
        .when(status.isin("verification_pending", "approval_required") | (verification == "pending"), "pending")
        .when(status.isin("error", "failed") | ~(patch_ok & diff_ok & verify_ok & stable), "reject")
        .when(status.isin("success", "done", ""), F.when(partial, "partial").otherwise("accept"))
        .otherwise("reject")
    )
    return runs.withColumns({"patch_valid": analysis | patch_ok, "diff_review_passed": analysis | diff_ok, "verification_passed": analysis | verify_ok, "diagnosis_stable": analysis | stable, "decision": decision})


def judge_runs(runs: DataFrame, gates: Sequence[str] = ("evidence_gate", "patch_gate", "build_gate", "verification_gate", "safety_gate")) -> DataFrame:
    """A verdict over five gates: reject if one fails, pending if one is open, accept if all hold; with the failed ones."""
    failed = F.filter(F.array(*[F.when(~F.col(g), F.lit(g)) for g in gates]), lambda x: x.isNotNull())
    open_ = F.lit(False)
    for g in gates:
        open_ |= F.col(g).isNull()
    return runs.withColumn("failed_gates", failed).withColumn("verdict", F.when(F.size("failed_gates") > 0, "reject").when(open_, "pending").otherwise("accept"))


def unauthorised_files(runs: DataFrame) -> DataFrame:
    """Changed files that were not allowed."""
    return runs.withColumn("unauthorised", F.array_except("changed_files", "allowed_files"))


def validate_submissions(subs: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required fields that a submission's map lacks."""
    return subs.withColumn("missing_fields", F.array_except(F.array(*map(F.lit, required)), F.map_keys("fields")))
