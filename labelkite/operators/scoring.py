"""Weighted compliance score, evidence coverage, verdict and decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 85.0
COVERAGE_FLOOR = 70.0


def effective_weight(weight: Column, critical: Column) -> Column:
    """The declared weight where it is positive, else 2 for critical rules and 1 for others."""
    return F.coalesce(F.when(weight > 0, weight), F.when(critical, 2.0).otherwise(1.0))


def effective_kind(kind: Column, reason: Column) -> Column:
    """How a rule applies; rows without it are told by their reason."""
    text = F.lower(F.coalesce(reason, F.lit("")))
    missing = text.contains("no import evidence") | text.contains("cannot be established")
    return F.coalesce(F.nullif(F.upper(kind), F.lit("")), F.when(missing, "EVIDENCE_MISSING").otherwise("INAPPLICABLE"))


def scores(evaluations: DataFrame) -> DataFrame:
    """One row for each inspection: weights, score over decided rules, coverage over applicable ones.

    Both are percentages with one decimal, rounded half to even; 0 where nothing is decided or applicable.
    """
    w = effective_weight(F.col("weight"), F.col("critical"))
    scored = (F.col("check_type") != "manual_only") & ~((F.col("status") == "NOT_APPLICABLE") & (F.col("applicability_kind") != "EVIDENCE_MISSING"))
    decided = scored & F.col("status").isin("PASS", "FAIL")
    summed = evaluations.groupBy("inspection_id").agg(
        F.sum(F.when(decided, w).otherwise(0.0)).alias("decided_weight"),
        F.sum(F.when(scored, w).otherwise(0.0)).alias("applicable_weight"),
        F.sum(F.when(scored & (F.col("status") == "PASS"), w).otherwise(0.0)).alias("earned"),
        F.count(F.when(scored & (F.col("status") == "FAIL"), 1)).alias("n_failed"),
    )
    share = lambda a, b: F.coalesce(F.bround(100 * F.try_divide(a, b), 1), F.lit(0.0))
    return summed.select(
        "inspection_id", "decided_weight", "applicable_weight",
        share(F.col("earned"), F.col("decided_weight")).alias("score"),
        share(F.col("decided_weight"), F.col("applicable_weight")).alias("coverage"),
        "n_failed",
    )


def verdict(score: Column, coverage: Column, n_failed: Column, decided_weight: Column, *, threshold: float = THRESHOLD, floor: float = COVERAGE_FLOOR) -> Column:
    """A failure decides; else too little decided, a low score or low coverage ask for a review."""
    return (
        F.when(n_failed > 0, "NON_COMPLIANT")
        .when(decided_weight <= 0, "NEEDS_MANUAL_REVIEW")
        .when(score < threshold, "NEEDS_MANUAL_REVIEW")
        .when(coverage < floor, "NEEDS_MANUAL_REVIEW")
        .otherwise("COMPLIANT")
    )


def with_verdicts(scored: DataFrame) -> DataFrame:
    return scored.withColumn("verdict", verdict(F.col("score"), F.col("coverage"), F.col("n_failed"), F.col("decided_weight")))


def decisions(evaluations: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """The decision of each inspection from its rule outcomes.

    ``contexts``: inspection_id, classification_state, n_conflicts. Any failure decides; conflicts, an unsure class, an
    undecided rule or a scope without evidence ask for a review; rules that can only be checked by hand do not.
    """
    status = F.col("status")
    facts = evaluations.groupBy("inspection_id").agg(
        F.bool_or(status == "FAIL").alias("failed"),
        F.bool_or((status == "UNCERTAIN") & (F.col("check_type") != "manual_only")).alias("unsure"),
        F.bool_or((status == "NOT_APPLICABLE") & (F.col("applicability_kind") == "EVIDENCE_MISSING")).alias("scope_unsure"),
        F.bool_or(status != "NOT_APPLICABLE").alias("any_applies"),
    )
    ask = F.col("unsure") | F.col("scope_unsure")
    if contexts is not None:
        facts = facts.join(contexts, "inspection_id", "left")
        ask = ask | F.coalesce(F.col("n_conflicts") > 0, F.lit(False)) | F.coalesce(F.col("classification_state").isin("UNCERTAIN", "CONFLICTING"), F.lit(False))
    decision = F.when(F.col("failed"), "NON_COMPLIANT").when(ask, "NEEDS_MANUAL_REVIEW").when(F.col("any_applies"), "COMPLIANT").otherwise("NEEDS_MANUAL_REVIEW")
    return facts.select("inspection_id", decision.alias("decision"))


def violations(evaluations: DataFrame) -> DataFrame:
    """Failures (HIGH if critical, else MEDIUM) and undecided rules that a machine could decide (LOW)."""
    status = F.col("status")
    kept = evaluations.filter((status == "FAIL") | ((status == "UNCERTAIN") & (F.col("check_type") != "manual_only")))
    severity = F.when(status == "UNCERTAIN", "LOW").when(F.col("critical"), "HIGH").otherwise("MEDIUM")
    return kept.select("inspection_id", "rule_number", "status", severity.alias("severity"))


def review_counts(evaluations: DataFrame, *, digits: int = 3) -> DataFrame:
    """Counts of each status for an inspection, and the mean confidence of the rules that apply."""
    status = F.col("status")
    return evaluations.groupBy("inspection_id").agg(
        F.count_if(status == "PASS").alias("n_pass"),
        F.count_if(status == "FAIL").alias("n_fail"),
        F.count_if((status == "UNCERTAIN") & (F.col("check_type") != "manual_only")).alias("n_uncertain"),
        F.count_if(status == "NOT_APPLICABLE").alias("n_not_applicable"),
        F.bround(F.avg(F.when(status != "NOT_APPLICABLE", F.col("confidence"))), digits).alias("mean_confidence"),
    )
