"""Step logs: line assembly from output chunks, redaction, event envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.payload import global_envelope, redact_line
from runlens.operators.running import BUCKET_ROWS, running


def assemble_lines(
    chunks: DataFrame,
    keys: list[str],
    *,
    order: str = "seq",
    text: str = "chunk",
    console: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Join the chunks of every stream in order and split them into numbered lines.

    A line's number is the count of line breaks before it, which a running sum gives without
    joining any stream's text. Lines that lie inside one chunk are final at once; only the first
    and last piece of a chunk are grouped by line number and put together. What follows the last
    break is flushed as a line unless it is empty. The console form drops blank lines.
    """
    breaks = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    counted = running(
        chunks.select(*keys, order, text, breaks.cast("long").alias("__n")),
        keys,
        order,
        {"__before": ("sum", F.col("__n"))},
        before=True,
        bucket_rows=bucket_rows,
    )
    pieces = counted.select(
        *keys, order, "__n", "__before", F.posexplode(F.split(text, "\n")).alias("__pos", "line")
    ).withColumn("line_no", F.col("__before") + F.col("__pos"))
    edge = (F.col("__pos") == 0) | (F.col("__pos") == F.col("__n"))
    inner = pieces.filter(~edge).select(*keys, "line_no", "line")
    joined = (
        pieces.filter(edge)
        .groupBy(*keys, "line_no")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "line"))).alias("parts"),
            F.bool_or(F.col("__pos") < F.col("__n")).alias("ended"),
        )
        .select(
            *keys,
            "line_no",
            F.array_join(F.col("parts.line"), "").alias("line"),
            "ended",
        )
        .filter(F.col("ended") | (F.col("line") != ""))
        .drop("ended")
    )
    lines = inner.unionByName(joined)
    return lines.filter(F.col("line") != "") if console else lines


def secrets_by_run(secrets: DataFrame, run: str = "run_id", order: str = "ord") -> DataFrame:
    """Secret values per run as a list in declaration order (a run's own arguments)."""
    return secrets.groupBy(run).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "value"))).alias("__s")
    ).select(run, F.col("__s.value").alias("secrets"))


def redact_lines(lines: DataFrame, secrets: DataFrame, run: str = "run_id") -> DataFrame:
    """Replace every secret of a line's run, in list order."""
    return (
        lines.join(secrets, run, "left")
        .withColumn("line", redact_line("line", "secrets"))
        .drop("secrets")
    )


def with_envelope(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Global feed: every payload carries its run id."""
    return events.withColumn(payload, global_envelope("run_id", payload))


def event_matches(run_id: str | None) -> Column:
    """Optional run filter of the global feed."""
    return F.lit(True) if not run_id else F.col("run_id") == run_id
