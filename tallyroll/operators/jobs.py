"""Job states, task results and retries as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FIELDS

SCORE = "struct<precision:double,recall:double,f1:double,n_pred:bigint,n_gt:bigint>"
SCORES = f"struct<{','.join(f'{f}:{SCORE}' for f in FIELDS)}>"


def public_status(state: Column) -> Column:
    """Queue state to the polled status."""
    return (
        F.when(state == "PENDING", "pending")
        .when(state == "SUCCESS", "done")
        .when(state == "FAILURE", "failed")
        .otherwise(F.lower(state))
    )


def public_result(state: Column, result: Column) -> Column:
    """Only finished jobs show a result; a failure shows its text."""
    return F.when(state.isin("SUCCESS", "FAILURE"), result.cast("string"))


def latest_state(events: DataFrame) -> DataFrame:
    """R2: last state per job by ``(ts, event_id)``; same expression in batch and stream."""
    last = F.max_by(F.struct("state", "result"), F.struct("ts", "event_id"))
    return events.groupBy("job_id").agg(last.alias("_l")).select(
        "job_id",
        public_status(F.col("_l.state")).alias("status"),
        public_result(F.col("_l.state"), F.col("_l.result")).alias("result"),
    )


def first_result(results: DataFrame) -> DataFrame:
    """R3 in batch: at-least-once delivery down to one row per task, the earliest."""
    return results.groupBy("task_id").agg(F.min("ts").alias("first_ts"))


def collect(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Every task with its result; ``collected`` is ok, failed or pending."""
    status = (
        F.when(F.col("state") == "SUCCESS", "ok")
        .when(F.col("state") == "FAILURE", "failed")
        .otherwise("pending")
    )
    return tasks.join(results, "task_id", "left").withColumn("collected", status)


def tally(collected: DataFrame) -> DataFrame:
    """How many tasks are ok, failed and pending (zero counts included)."""
    counts = collected.agg(
        *[F.count_if(F.col("collected") == s).alias(s) for s in ("ok", "failed", "pending")]
    )
    rows = [F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in ("ok", "failed", "pending")]
    return counts.select(F.inline(F.array(*rows)))


def restore_scores(json: Column) -> Column:
    """Stored score records; absent fields and counts are zero."""
    parsed = F.from_json(json, SCORES)

    def field(name: str) -> Column:
        cell = parsed[name]
        return F.struct(
            *[F.coalesce(cell[p], F.lit(0.0)).alias(p) for p in ("precision", "recall", "f1")],
            *[F.coalesce(cell[n], F.lit(0)).cast("bigint").alias(n) for n in ("n_pred", "n_gt")],
        )

    return F.struct(*[field(f).alias(f) for f in FIELDS])


def retry_fallback(attempts: DataFrame, *keys: str) -> DataFrame:
    """P10 over attempt rows ``(keys, attempt, status, payload)``: first ok payload, else ``{}``.

    ``retried`` tells whether any attempt failed before it.
    """
    ok = F.col("status") == "ok"
    return attempts.groupBy(*keys).agg(
        F.coalesce(
            F.min_by(F.when(ok, F.col("payload")), F.when(ok, F.col("attempt"))), F.lit("{}")
        ).alias("payload"),
        F.when(F.count_if(ok) > 0, "ok").otherwise("failed").alias("parse_status"),
        F.coalesce(F.min(F.when(ok, F.col("attempt"))) > 1, F.lit(True)).alias("retried"),
    )
