"""Queries over step logs, redaction and event envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import tables
from runlens.functions.payload import redact_args
from runlens.operators import logs as L

BUCKET = 1 << 16


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as output chunks of (run, channel)."""
    return L.assemble_lines(tables.step_log(spark, sf), ["run_id", "channel"], bucket_rows=BUCKET)


def source_lines(spark: SparkSession, sf: str) -> DataFrame:
    """All documents of a source as one long stream, in console form."""
    chunks = tables.load(spark, sf, "documents").select(
        "source", F.col("doc_id").alias("seq"), F.col("text").alias("chunk")
    )
    return L.assemble_lines(chunks, ["source"], console=True, bucket_rows=BUCKET)


_LINES = """
SELECT {keys}, i - 1 AS line_no, lines[i] AS line FROM (
  SELECT {keys}, lines, unnest(generate_series(1, len(lines))) AS i FROM (
    SELECT {keys}, string_split(string_agg(text, '' ORDER BY {ord}), chr(10)) AS lines
    FROM {table} GROUP BY {group}
  )
) WHERE {keep}
"""


SET_SIZE = 10


def _secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as the secret values of argument sets, ten to a set."""
    return tables.load(spark, sf, "benchmark").select(
        F.expr(f"item_id div {SET_SIZE}").alias("set_id"), F.col("item_id").alias("ord"), F.col("text").alias("value")
    )


def redacted_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as log messages with the secrets of their argument set hidden."""
    secrets = _secrets(spark, sf)
    sets = secrets.agg((F.max("set_id") + 1).alias("n")).scalar()
    lines = tables.load(spark, sf, "documents").select("doc_id", "text").select(
        "doc_id", (F.col("doc_id") % sets).alias("set_id"), F.col("text").alias("line")
    )
    hidden = L.redact_lines(lines, L.secrets_by_run(secrets, "set_id"), "set_id")
    return hidden.select("doc_id", F.md5("line").alias("digest"), F.octet_length("line").alias("size"))


def redacted_args(spark: SparkSession, sf: str) -> DataFrame:
    args = F.create_map(
        F.lit("priority"), F.col("o_orderpriority"),
        F.lit("status"), F.col("o_orderstatus"),
        F.lit("total"), F.format_string("%.2f", "o_totalprice"),
    )
    names = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("total"))).otherwise(
        F.array(F.lit("status"), F.lit("priority"))
    )
    shown = redact_args(args, names)
    return tables.load(spark, sf, "orders").select(
        "o_orderkey", *[F.element_at(shown, k).alias(k) for k in ("priority", "status", "total")]
    )


def global_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """Event payloads with their run id; error events carry plain text and are wrapped.

    Some payloads have numbers with an exponent, beyond 53 bits or out of range, and repeated keys.
    """
    seq = F.col("seq").cast("string")
    payload = (
        F.when(F.col("event_type") == "error", F.col("event_type"))
        .when(F.col("seq") % 7 == 1, F.concat(F.lit('{"x": '), seq, F.lit("e3, \"a\":1, \"a\": 2.50}")))
        .when(F.col("seq") % 7 == 2, F.concat(F.lit('{"big": 9007199254740993, "small": '), seq, F.lit("e-1}")))
        .when(F.col("seq") % 7 == 3, F.concat(F.lit('{"over": 1e400, "seq": '), seq, F.lit("}")))
        .otherwise(F.col("payload"))
    )
    log = tables.journal(spark, sf).drop("ts").withColumn("payload", payload)
    return L.with_envelope(log).select("seq", "payload")


QUERIES = {
    f.__name__: f
    for f in (log_lines, source_lines, redacted_lines, redacted_args, global_envelope)
}

SQL = {
    "log_lines": _LINES.format(
        keys="run_id, channel", ord="turn",
        table="(SELECT conv_id AS run_id, role AS channel, turn, text FROM conversations)",
        group="run_id, channel", keep="NOT (i = len(lines) AND lines[i] = '')",
    ),
    "source_lines": _LINES.format(
        keys="source", ord="doc_id", table="documents", group="source", keep="lines[i] <> ''",
    ),
    "redacted_lines": """
        WITH sets AS (
          SELECT item_id // 10 AS set_id, list(text ORDER BY item_id) AS secrets FROM benchmark GROUP BY 1
        ), hidden AS (
          SELECT doc_id, list_reduce(list_concat([text], secrets), lambda acc, s: replace(acc, s, '[secret]')) AS line
          FROM documents JOIN sets ON set_id = doc_id % (SELECT max(item_id) // 10 + 1 FROM benchmark)
        )
        SELECT doc_id, md5(line) AS digest, CAST(strlen(line) AS INTEGER) AS size FROM hidden""",
    "redacted_args": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 2 = 1 THEN '[secret]' ELSE o_orderpriority END AS priority,
               CASE WHEN o_orderkey % 2 = 1 THEN '[secret]' ELSE o_orderstatus END AS status,
               CASE WHEN o_orderkey % 2 = 0 THEN '[secret]' ELSE printf('%.2f', o_totalprice) END AS total
        FROM orders""",
    "global_envelope": """
        SELECT event_id AS seq,
               CASE WHEN event_type = 'error' THEN '{"data":"error","run_id":"' || user_id || '"}'
                    WHEN event_id % 7 = 1 THEN '{"a":2.5,"run_id":"' || user_id || '","x":' || event_id * 1000 || '}'
                    WHEN event_id % 7 = 2 THEN '{"big":9007199254740992,"run_id":"' || user_id || '","small":'
                         || event_id // 10 || CASE WHEN event_id % 10 = 0 THEN '' ELSE '.' || event_id % 10 END || '}'
                    WHEN event_id % 7 = 3 THEN '{"data":"{\\"over\\": 1e400, \\"seq\\": ' || event_id
                         || '}","run_id":"' || user_id || '"}'
                    ELSE '{"k":' || json_extract_string(props, '$.k') || ',"run_id":"' || user_id || '"}'
               END AS payload
        FROM events""",
}
