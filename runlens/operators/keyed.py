"""Keyed state: key/value change log, quota admission, prefix pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.access import kv_check
from runlens.operators.folds import CHUNK_ROWS, chunked_fold
from runlens.operators.running import BUCKET_ROWS, running
from runlens.session import written

# Quota per namespace and page limit.
NAMESPACE_MAX_BYTES = 32 * 1024 * 1024
SCAN_LIMIT = 256


def latest(changes: DataFrame, keys: list[str], order: str, *, op: str | None = None) -> DataFrame:
    """Newest whole row per key; with ``op`` keys whose newest change is a delete are gone."""
    rest = [c for c in changes.columns if c not in keys]
    newest = (
        changes.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
        .select(*keys, "__row.*")
    )
    return newest.filter(F.col(op) != "delete") if op else newest


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Replace whole rows of ``current`` by the newest change per key; ``created`` tells new keys."""
    newest = latest(changes, keys, order)
    kept = current.join(newest.select(*keys), keys, "left_anti").withColumn(
        "created", F.lit(None).cast("boolean")
    )
    known = current.select(*keys, F.lit(True).alias("__known"))
    new = newest.join(known, keys, "left").withColumn("created", F.col("__known").isNull())
    return kept.unionByName(new.drop("__known", order), allowMissingColumns=True)


def entry_bytes(k: str = "k", v: str = "v"):
    return (F.octet_length(k) + F.octet_length(v)).cast("long")


def namespace_sizes(live: DataFrame) -> DataFrame:
    """Bytes (keys and values) per namespace of live rows."""
    return live.groupBy("namespace").agg(F.sum(entry_bytes()).alias("bytes"))


def with_previous(
    changes: DataFrame, keys: list[str], order: str, *, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Add ``previous_op`` and ``previous_size``: the change of the key before this one."""
    size = F.when(F.col("op") == "delete", F.lit(0).cast("long")).otherwise(entry_bytes())
    before = running(
        changes,
        keys,
        order,
        {"__prev": ("max", F.struct(F.col(order).alias("ord"), F.col("op").alias("op"), size.alias("size")))},
        before=True,
        bucket_rows=bucket_rows,
    )
    return before.select(
        *changes.columns,
        F.col("__prev.op").alias("previous_op"),
        F.coalesce(F.col("__prev.size"), F.lit(0).cast("long")).alias("previous_size"),
    )


def deletes(changes: DataFrame, *, order: str = "ord", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every delete with ``existed``: whether the key was live just before."""
    keys = ["namespace", "k"]
    small = changes.select(*keys, order, "op", F.lit("").alias("v"))
    return (
        with_previous(small, keys, order, bucket_rows=bucket_rows)
        .filter(F.col("op") == "delete")
        .select(*keys, order, F.coalesce(F.col("previous_op") == "put", F.lit(False)).alias("existed"))
    )


def prefix_page(
    live: DataFrame, namespace: str, prefix: str = "", cursor: str = "", limit: int = SCAN_LIMIT
) -> DataFrame:
    """One page of keys with a prefix, in byte order after ``cursor``.

    ``next_cursor`` (same on every row) is the last key when more keys follow, else null. Both
    key bounds reach the scan and only ``limit + 1`` rows leave a task.
    """
    if not 1 <= limit <= SCAN_LIMIT:
        limit = SCAN_LIMIT
    rows = live.filter((F.col("namespace") == namespace) & F.col("k").startswith(prefix))
    if cursor:
        rows = rows.filter(F.col("k") > cursor)
    page = rows.orderBy("k").limit(limit + 1)
    # at most limit + 1 rows from here on
    held = page.agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in ["k", *[c for c in live.columns if c != "k"]]]))).alias("rows"))
    more = F.size("rows") > limit
    return (
        held.select(
            F.when(more, F.element_at("rows", limit)["k"]).alias("next_cursor"),
            F.slice("rows", 1, limit).alias("rows"),
        )
        .select(F.explode("rows").alias("row"), "next_cursor")
        .select(*[F.col(f"row.{c}").alias(c) for c in live.columns], "next_cursor")
    )


def change_check() -> Column:
    """Row checks of a change; a delete has no value to check."""
    value = F.when(F.col("op") == "delete", "").otherwise(F.col("v"))
    return kv_check("namespace", "k", value)


def _quota_fold(limit: int):
    def fold(key, rows: pd.DataFrame, state: pd.DataFrame):
        held = dict(zip(state["k"], state["size"]))
        used = sum(held.values())
        decisions = []
        for k, op, size in zip(rows["k"], rows["op"], rows["size"]):
            if op == "delete":
                used -= held.pop(k, 0)
                decisions.append("ok")
                continue
            grown = used + size - held.get(k, 0)
            if grown > limit:
                decisions.append("quota_exceeded")
                continue
            used, held[k] = grown, size
            decisions.append("ok")
        out = pd.DataFrame({"ord": rows["ord"].to_numpy(), "decision": decisions})
        kept = pd.DataFrame({"k": list(held), "size": list(held.values())})
        return out, kept

    return fold


def admission(
    changes: DataFrame,
    limit: int = NAMESPACE_MAX_BYTES,
    *,
    bucket_rows: int = BUCKET_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Decision per key/value change ``(namespace, ord, k, v, op)`` under the byte quota.

    A put is refused when it would lift its namespace above ``limit``; deletes free bytes.
    Row checks come first. Up to the first overflow of a namespace every change is accepted,
    which running sums settle without a fold. What follows an overflow depends on each refusal
    before it, so only those tails are folded, chunk by chunk; the state is the live keys,
    which the quota itself bounds.
    """
    checked = changes.withColumn(
        "check",
        change_check(),
    )
    refused = checked.filter(F.col("check") != "ok").select(
        "namespace", "ord", F.col("check").alias("decision")
    )
    sized = checked.filter(F.col("check") == "ok").select(
        "namespace",
        "ord",
        "k",
        "op",
        F.when(F.col("op") == "delete", F.lit(0).cast("long")).otherwise(entry_bytes()).alias("size"),
    )
    previous = running(
        sized, ["namespace", "k"], "ord",
        {"__prev": ("max", F.struct("ord", "size"))}, before=True, bucket_rows=bucket_rows,
    ).withColumn("old", F.coalesce("__prev.size", F.lit(0).cast("long")))
    totals = running(
        previous, ["namespace"], "ord", {"used": ("sum", F.col("size") - F.col("old"))},
        bucket_rows=bucket_rows,
    )
    # read several times below: slim rows without values, written once
    totals = written(totals.select("namespace", "ord", "k", "op", "size", "used"), "quota")
    overflow = (
        totals.filter((F.col("op") == "put") & (F.col("used") > limit))
        .groupBy("namespace")
        .agg(F.min("ord").alias("first_over"))
    )
    if overflow.isEmpty():
        return totals.select("namespace", "ord", F.lit("ok").alias("decision")).unionByName(refused)
    marked = totals.join(overflow, "namespace", "left")
    head = F.col("first_over").isNull() | (F.col("ord") < F.col("first_over"))
    accepted = marked.filter(head)
    tail = marked.filter(~head).select("namespace", "ord", "k", "op", "size")
    # live keys of overflowing namespaces when their tail begins
    seed = (
        accepted.filter(F.col("first_over").isNotNull())
        .groupBy("namespace", "k")
        .agg(F.max_by(F.struct("op", "size"), "ord").alias("last"))
        .filter(F.col("last.op") == "put")
        .select("namespace", "k", "last.size")
    )
    folded = chunked_fold(
        tail,
        ["namespace"],
        "ord",
        _quota_fold(limit),
        "k string, size long",
        "ord long, decision string",
        initial=seed,
        chunk_rows=chunk_rows,
    )
    return (
        accepted.select("namespace", "ord", F.lit("ok").alias("decision"))
        .unionByName(folded)
        .unionByName(refused)
    )
