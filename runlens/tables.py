"""The input tables, seen in the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_space(spark: SparkSession, sf_dir: str, name: str, column: str, share: str = "1") -> Column:
    """The largest key of a table times ``share``, plus 1, as a subquery.

    Queries spread rows over another table's keys by it, so they use all of them at every size.
    """
    top = F.expr(f"cast(max({column}) * {share} as bigint) + 1")
    return load(spark, sf_dir, name).agg(top).scalar()


def journal_view(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("run_id"),
        "event_type",
        F.col("props").alias("payload"),
        "ts",
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the run journal."""
    return journal_view(load(spark, sf_dir, "events"))


def run_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as status reports: a customer's job run reports one status per order."""
    status = (
        F.when(F.col("o_orderstatus") == "P", "running")
        .when(F.col("o_orderstatus") == "F", "completed")
        .otherwise("failed")
    )
    return load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("seq"),
        status.alias("status"),
        F.col("o_orderdate").alias("ts"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as runs."""
    status = (
        F.when(F.col("o_orderstatus") == "P", "running")
        .when(F.col("o_orderstatus") == "F", "completed")
        .otherwise("failed")
    )
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit("job-"), F.col("o_custkey").cast("string")).alias("job_id"),
        status.alias("status"),
        F.col("o_orderdate").alias("started_at"),
    )


def kv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as key/value writes: namespace = lang, key = source:doc_id."""
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        F.col("lang").alias("namespace"),
        F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("k"),
        F.col("text").alias("v"),
        F.lit("put").alias("op"),
    )


def kv_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a key/value change log: namespace = event type, key = user.

    ``error`` events of low value delete the user's key, everything else writes ``props``.
    """
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        F.concat(F.lit("ns"), (F.col("user_id") % 4).cast("string")).alias("namespace"),
        F.col("user_id").cast("string").alias("k"),
        F.col("props").alias("v"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
    )


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as step output chunks: run = conv_id, channel = role."""
    return load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"),
        F.col("role").alias("channel"),
        F.col("turn").alias("seq"),
        F.col("text").alias("chunk"),
    )
