"""Queries over run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import tables
from runlens.operators import runs as R


def run_status(spark: SparkSession, sf: str) -> DataFrame:
    """Sticky-terminal fold of each customer's status reports."""
    return R.status_fold(tables.run_statuses(spark, sf))


RUN_STATUS_SQL = """
WITH reports AS (
  SELECT o_custkey AS run_id, o_orderkey AS seq, o_orderdate AS ts,
         CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status
  FROM orders
), won AS (
  SELECT run_id,
         min_by(status, seq) FILTER (WHERE status IN ('completed', 'failed', 'canceled')) AS winner,
         max_by(status, seq) AS latest
  FROM reports GROUP BY run_id
)
SELECT w.run_id, coalesce(winner, latest) AS status,
       max_by(r.ts, r.seq) FILTER (WHERE r.status = winner) AS finished_at
FROM won w JOIN reports r ON r.run_id = w.run_id
GROUP BY w.run_id, winner, latest
"""


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` as step results: returned lines exit with 1."""
    return tables.load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("step"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("exit_code"),
        ((F.col("l_returnflag") == "A") & (F.col("l_discount") > 0.09)).alias("error"),
        ((F.col("l_linestatus") == "O") & (F.col("l_tax") > 0.07)).alias("canceled"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("attempt"),
    )


def run_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return R.run_outcome(_steps(spark, sf))


def runs_page(spark: SparkSession, sf: str) -> DataFrame:
    page = R.runs_page(tables.runs(spark, sf), page=3, per_page=50)
    return page.select("run_id", "job_id", "status", "started_at")


def step_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return R.step_attempts(_steps(spark, sf))


def step_status(spark: SparkSession, sf: str) -> DataFrame:
    """Console and stream form of a finished step's status."""
    error = F.when(F.col("error"), "boom").otherwise("")
    console, stream = R.step_finish_status(F.col("exit_code"), error)
    marked = _steps(spark, sf).select(console.alias("console"), stream.alias("stream"))
    return marked.groupBy("console", "stream").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f for f in (run_status, run_outcome, runs_page, step_attempts, step_status)
}

SQL = {
    "run_status": RUN_STATUS_SQL,
    "run_outcome": """
        SELECT l_orderkey AS run_id,
               CASE WHEN bool_or(l_linestatus = 'O' AND l_tax > 0.07) THEN 'canceled'
                    WHEN bool_or(l_returnflag = 'R') OR bool_or(l_returnflag = 'A' AND l_discount > 0.09)
                    THEN 'failed' ELSE 'completed' END AS status
        FROM lineitem GROUP BY 1""",
    "runs_page": """
        SELECT o_orderkey AS run_id, 'job-' || o_custkey AS job_id,
               CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status,
               o_orderdate AS started_at
        FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100""",
    "step_attempts": """
        SELECT run_id, step, count(*) AS attempts, max_by(exit_code, attempt) AS final_exit,
               max_by(exit_code, attempt) = 0 AND count(*) > 1 AS recovered
        FROM (SELECT l_orderkey AS run_id, l_linenumber AS step,
                     CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS exit_code,
                     row(l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS attempt
              FROM lineitem)
        GROUP BY run_id, step""",
    "step_status": """
        SELECT CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'A' AND l_discount > 0.09)
                    THEN 'failed' ELSE 'completed' END AS console,
               CASE WHEN l_returnflag = 'A' AND l_discount > 0.09 THEN 'failed' ELSE 'completed' END AS stream,
               count(*) AS n
        FROM lineitem GROUP BY ALL""",
}
