"""Run history: status folds, outcomes, attempts, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses that end a run, page defaults and limits.
TERMINAL = ("completed", "failed", "canceled")
DEFAULT_PER_PAGE = 50
MAX_PER_PAGE = 200


def status_fold(reports: DataFrame) -> DataFrame:
    """Fold ``(run_id, seq, status, ts)`` reports into one status per run.

    The first terminal status wins and a different later one is ignored; ``finished_at`` is
    the last stamp that carries the winning status. Without a terminal status the latest
    one holds. Plain aggregates, so they combine on the map side and also run on a stream.
    """
    status, seq, ts = F.col("status"), F.col("seq"), F.col("ts")
    ended = F.lower(status).isin(*TERMINAL)
    parts = [
        F.min_by(F.when(ended, status), F.when(ended, seq)).alias("__first"),
        F.max_by(status, seq).alias("__latest"),
    ]
    for name in TERMINAL:
        here = (F.lower(status) == name) & ts.isNotNull()
        parts.append(F.max_by(F.when(here, ts), F.when(here, seq)).alias(f"__{name}"))
    finished = F.lit(None).cast("timestamp")
    for name in TERMINAL:
        finished = F.when(F.lower("__first") == name, F.col(f"__{name}")).otherwise(finished)
    return (
        reports.groupBy("run_id")
        .agg(*parts)
        .select(
            "run_id",
            F.coalesce("__first", "__latest").alias("status"),
            finished.alias("finished_at"),
        )
    )


def run_outcome(steps: DataFrame) -> DataFrame:
    """Final status from ``(run_id, exit_code, error BOOLEAN, canceled BOOLEAN)`` step rows."""
    folded = steps.groupBy("run_id").agg(
        F.coalesce(F.bool_or("error"), F.lit(False)).alias("error"),
        F.coalesce(F.bool_or(F.col("exit_code") != 0), F.lit(False)).alias("nonzero"),
        F.coalesce(F.bool_or("canceled"), F.lit(False)).alias("canceled"),
    )
    status = (
        F.when(F.col("canceled"), "canceled")
        .when(F.col("error") | F.col("nonzero"), "failed")
        .otherwise("completed")
    )
    return folded.select("run_id", status.alias("status"))


def step_finish_status(exit_code: Column, error: Column) -> tuple[Column, Column]:
    """(console form, stream form): the stream form looks at the error alone."""
    failed = F.coalesce(error != "", F.lit(False))
    console = F.when((exit_code != 0) | failed, "failed").otherwise("completed")
    stream = F.when(failed, "failed").otherwise("completed")
    return console, stream


def step_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts, final exit and recovery per step of ``(run_id, step, attempt, exit_code)``."""
    return (
        attempts.groupBy("run_id", "step")
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.max_by("exit_code", "attempt").alias("final_exit"),
        )
        .withColumn("recovered", (F.col("final_exit") == 0) & (F.col("attempts") > 1))
    )


def check_page(page: int, per_page: int, max_per_page: int = MAX_PER_PAGE) -> None:
    if page < 1:
        raise ValueError(f"page must be a positive integer (got {page})")
    if not 1 <= per_page <= max_per_page:
        raise ValueError(f"per_page must be between 1 and {max_per_page} (got {per_page})")


def runs_page(runs: DataFrame, page: int = 1, per_page: int = DEFAULT_PER_PAGE) -> DataFrame:
    """Newest runs first; run id breaks ties. Only ``page * per_page`` rows leave a task."""
    check_page(page, per_page)
    ordered = runs.orderBy(F.col("started_at").desc(), F.col("run_id"))
    return ordered.offset((page - 1) * per_page).limit(per_page)
