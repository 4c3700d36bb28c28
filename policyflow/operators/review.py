"""Confidence gate, review queue, decisions, transfer states, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import names
from ..functions import text as tx
from .ordered import first_per_key


def gate_status(confidence: Column, limit: float = names.AUTO_CONFIRM_LIMIT) -> Column:
    return F.when(F.coalesce(confidence, F.lit(0.0)) >= limit, "auto_confirmed").otherwise("review_needed")


def gate(results: DataFrame, limit: float = names.AUTO_CONFIRM_LIMIT) -> DataFrame:
    """``verification_status`` and the audit text of every result."""
    shown = F.format_string("confidence=%.3f, status=%s", F.coalesce("confidence", F.lit(0.0)), gate_status(F.col("confidence"), limit))
    return results.withColumns(
        {"verification_status": gate_status(F.col("confidence"), limit), "audit_details": shown}
    )


def new_queue(gated: DataFrame) -> DataFrame:
    """Pending review rows for the results that were not confirmed."""
    return gated.filter(F.col("verification_status") == "review_needed").select(
        F.xxhash64("id").alias("id"), F.col("id").alias("result_id"), F.lit("pending").alias("status")
    )


def gate_counts(gated: DataFrame) -> DataFrame:
    status = F.col("verification_status")
    return gated.agg(
        F.count_if(status == "auto_confirmed").alias("auto_confirmed"),
        F.count_if(status == "review_needed").alias("review_needed"),
    )


def check_decisions(decisions: DataFrame, queue: DataFrame) -> DataFrame:
    """Decisions with ``error``: unknown id, not pending, unknown action; '' when applicable.

    The first decision of an id in arrival order closes the item, later ones find it not pending.
    """
    firsts = decisions.filter(F.col("action").isin("approve", "reject")).groupBy("review_id").agg(F.min("pos").alias("__first"))
    known = queue.select(F.col("id").alias("review_id"), F.col("status").alias("__status"))
    # one row per review first: the decisions, which may crowd on one review, are joined once
    joined = decisions.join(known.join(firsts, "review_id", "left"), "review_id", "left")
    error = (
        F.when(F.col("__status").isNull(), "Review not found")
        .when(F.col("__status") != "pending", "not pending")
        .when(~F.col("action").isin("approve", "reject"), "unknown action")
        .when(F.col("pos") > F.col("__first"), "not pending")
        .otherwise("")
    )
    closed_before = F.col("__first").isNotNull() & (F.col("pos") > F.col("__first")) & (F.col("__status") == "pending")
    error = F.when(closed_before, "not pending").otherwise(error)
    return joined.select(*decisions.columns, error.alias("error"))


def decided_queue(queue: DataFrame, good: DataFrame) -> DataFrame:
    """Queue after the applicable decisions (one per id)."""
    d = good.select(
        F.col("review_id").alias("id"), "action", F.col("reviewer").alias("__reviewer"), F.col("comment").alias("__comment"),
        F.col("corrected_code").alias("__corrected"), F.col("decided_at").alias("__at"),
    )
    joined = queue.join(d, "id", "left")
    done = F.col("action").isNotNull()
    approved = F.col("action") == "approve"
    return joined.select(
        "id", "result_id",
        F.when(approved, "approved").when(done, "rejected").otherwise(F.col("status")).alias("status"),
        F.when(done, F.col("__reviewer")).alias("reviewer"),
        F.when(done, F.col("__comment")).alias("review_comment"),
        F.when(approved, tx.non_blank(F.col("__corrected"))).alias("corrected_code"),
        F.when(done, F.col("__at")).alias("reviewed_at"),
    )


def apply_to_results(results: DataFrame, queue_after: DataFrame, attribute: str = "diagnosis_code") -> DataFrame:
    """Results take the decision's status; a corrected code of an approval replaces the reviewed attribute."""
    done = queue_after.filter(F.col("status").isin("approved", "rejected")).select(
        F.col("result_id").alias("id"), F.col("status").alias("__status"), F.col("corrected_code").alias("__code")
    )
    joined = results.join(done, "id", "left")
    return joined.select(
        *[
            F.coalesce("__code", F.col(attribute)).alias(attribute) if c == attribute
            else F.coalesce("__status", F.col(c)).alias(c) if c == "verification_status"
            else F.col(c)
            for c in results.columns
        ]
    )


def decision_audit(good: DataFrame, queue: DataFrame) -> DataFrame:
    """Audit rows of the applied decisions."""
    result = queue.select(F.col("id").alias("review_id"), "result_id")
    say = lambda c: F.coalesce(F.col(c), F.lit("None"))
    details = F.when(
        F.col("action") == "approve",
        F.concat(F.lit("corrected="), say("corrected_code"), F.lit(", comment="), say("comment")),
    ).otherwise(F.concat(F.lit("reason="), say("comment")))
    word = F.when(F.col("action") == "approve", "approved").otherwise("rejected")
    return good.join(result, "review_id").select(
        F.lit("review").alias("event_type"), F.lit("result").alias("entity_type"),
        F.col("result_id").alias("entity_id"), F.col("reviewer").alias("actor"), word.alias("action"),
        details.alias("details"),
    )


def status_counts(queue: DataFrame) -> DataFrame:
    """Pending, approved, rejected and their total."""
    counts = {s: F.count_if(F.col("status") == s).alias(s) for s in ("pending", "approved", "rejected")}
    row = queue.agg(*counts.values())
    return row.withColumn("total", F.col("pending") + F.col("approved") + F.col("rejected"))


def transfer_state(success: Column, retries: Column, limit: int = 3) -> dict[str, Column]:
    """Next (status, retry_count) of a transfer attempt."""
    after = F.when(success, retries).otherwise(retries + 1)
    status = F.when(success, "completed").when(after >= limit, "failed").otherwise("pending")
    return {"status": status, "retry_count": after}


def pending_transfers(logs: DataFrame, files: DataFrame) -> DataFrame:
    """Outbound pending transfers whose file exists."""
    waiting = logs.filter((F.col("direction") == "outbound") & (F.col("status") == "pending"))
    return waiting.join(files.select("filename").distinct(), "filename", "left_semi")


def audit(event_type: str, entity_type: str, entity_id: Column, actor: Column, action: Column, details: Column) -> list[Column]:
    """Columns of an audit row; ``details`` is a struct written as JSON or a text."""
    return [
        F.lit(event_type).alias("event_type"), F.lit(entity_type).alias("entity_type"), entity_id.alias("entity_id"),
        actor.alias("actor"), action.alias("action"), details.alias("details"),
    ]


def first_decisions(decisions: DataFrame) -> DataFrame:
    return first_per_key(decisions, ["review_id"], "pos")
