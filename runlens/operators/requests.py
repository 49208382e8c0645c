"""Idempotent requests: stored-response lookup and admission with expiry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import whole_match
from runlens.functions.payload import canonical_hash

# How long a stored response answers repeats, and the declared-hash pattern.
TTL_MS = 10 * 60 * 1000
HASH_PATTERN = "^[a-f0-9]{64}$"

_KEY = ["key", "endpoint"]
_NO_ENTRY = -(1 << 62)


def with_body_hash(requests: DataFrame, body: str = "body") -> DataFrame:
    """Add the canonical body hash."""
    return requests.withColumn("hash", canonical_hash(body))


def declared_hash_check(declared: Column, computed: Column) -> Column:
    """A declared hash is optional; it must be 64 hex digits and equal the computed one."""
    text = F.lower(F.coalesce(F.trim(declared), F.lit("")))
    return (
        F.when(text == "", "ok")
        .when(~whole_match(text, HASH_PATTERN), "invalid_hash")
        .when(text != computed, "conflict")
        .otherwise("ok")
    )


def lookup(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Outcome per request ``(key, endpoint, hash, now_ms)`` against stored responses.

    A stored response expires strictly after ``ttl_expires_at`` (0 = never); the hash is only
    compared while it is live.
    """
    held = store.select(
        *_KEY, "body_sha256", "status", F.col("body").alias("stored_body"), "ttl_expires_at"
    )
    expired = (F.col("ttl_expires_at") > 0) & (F.col("now_ms") > F.col("ttl_expires_at"))
    outcome = (
        F.when(F.col("body_sha256").isNull(), "miss")
        .when(expired, "expired")
        .when(F.col("body_sha256") != F.col("hash"), "conflict")
        .otherwise("replay")
    )
    joined = requests.join(held, _KEY, "left").withColumn("outcome", outcome)
    answer = F.col("outcome") == "replay"
    return joined.withColumn("status", F.when(answer, F.col("status"))).withColumn(
        "stored_body", F.when(answer, F.col("stored_body"))
    )


def _next(times: np.ndarray, ttl: int) -> np.ndarray:
    """Index of the first time strictly more than ``ttl`` later."""
    return np.searchsorted(times, times + ttl, side="right")


def _transfer(ttl: int, span: int):
    """Per slice: which last anchor follows from each possible first admissible time."""

    def per_slice(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(rows["ms"].to_numpy())
        n, start = len(times), int(key[2]) * span
        step = _next(times, ttl)
        last = np.where(step < n, step, np.arange(n))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        # an anchor of an earlier slice lies before ``start``, so the first admissible time is
        # at most ``start + ttl``
        reach = min(n, int(np.searchsorted(times, start + ttl, side="left")) + 1)
        exits = times[last[:reach]]
        ends = np.append(exits[1:] != exits[:-1], True)
        return pd.DataFrame(
            {"key": key[0], "endpoint": key[1], "slice": key[2],
             "upto": times[:reach][ends], "exit": exits[ends]}
        )

    return per_slice


def _entries(ttl: int):
    """Per key: walk the slices and note the first admissible time of each."""

    def per_key(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["slice", "upto"])
        found, anchor = [], None
        for part, steps in rows.groupby("slice", sort=True):
            entry = _NO_ENTRY if anchor is None else anchor + ttl + 1
            found.append((part, entry))
            at = int(np.searchsorted(steps["upto"].to_numpy(), entry, side="left"))
            if at < len(steps):
                anchor = int(steps["exit"].iloc[at])
        out = pd.DataFrame(found, columns=["slice", "entry"])
        return out.assign(key=key[0], endpoint=key[1])[["key", "endpoint", "slice", "entry"]]

    return per_key


def _anchors_in_slice(ttl: int):
    def per_slice(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(rows["ms"].to_numpy())
        step, at = _next(times, ttl), int(np.searchsorted(times, rows["entry"].iloc[0]))
        marks = []
        while at < len(times):
            marks.append(times[at])
            at = step[at]
        return pd.DataFrame({"key": key[0], "endpoint": key[1], "ms": np.array(marks, dtype="int64")})

    return per_slice


def anchors(candidates: DataFrame, ttl_ms: int = TTL_MS, *, slice_ttls: int = 64) -> DataFrame:
    """Requests that open a new stored response: (key, endpoint, ms).

    ``candidates`` holds distinct (key, endpoint, ms). The first one is an anchor, the next
    anchor is the first candidate strictly later than the expiry of the one before. Keys whose
    candidates all lie inside one expiry (the normal case) need a minimum only. For the others
    time is cut into slices: every slice works out, for each first admissible time, the last
    anchor it leads to; a walk over these short tables gives the admissible time that really
    enters each slice; then all slices mark their anchors at once. A slice holds at most
    ``slice_ttls * ttl_ms`` distinct milliseconds of a key, however hot the key is.
    """
    span = ttl_ms * slice_ttls
    extent = candidates.groupBy(*_KEY).agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    short = F.col("hi") - F.col("lo") <= ttl_ms
    single = extent.filter(short).select(*_KEY, F.col("lo").alias("ms"))
    long_keys = extent.filter(~short).select(*_KEY)
    sliced = candidates.join(long_keys, _KEY, "left_semi").withColumn(
        "slice", F.expr(f"ms div {int(span)}L")
    )
    transfer = sliced.groupBy(*_KEY, "slice").applyInPandas(
        _transfer(ttl_ms, span), "key string, endpoint string, slice long, upto long, exit long"
    )
    entries = transfer.groupBy(*_KEY).applyInPandas(
        _entries(ttl_ms), "key string, endpoint string, slice long, entry long"
    )
    chained = (
        sliced.join(entries, [*_KEY, "slice"])
        .groupBy(*_KEY, "slice")
        .applyInPandas(_anchors_in_slice(ttl_ms), "key string, endpoint string, ms long")
    )
    return single.unionByName(chained)


def admission(requests: DataFrame, ttl_ms: int = TTL_MS, *, slice_ttls: int = 64) -> DataFrame:
    """Decide ``(key, endpoint, seq, ts, hash, valid)`` requests in sequence order.

    ``accepted`` opens a stored response that answers until ``ttl_ms`` after it; within that
    time the same hash is a ``replay`` and another one a ``conflict``, and neither moves the
    expiry. Invalid requests store nothing: they are ``rejected`` unless a stored response
    answers them. ``ts`` must not decrease with ``seq``.
    """
    rows = requests.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    first = (
        rows.filter("valid")
        .groupBy(*_KEY, "ms")
        .agg(F.min(F.struct("seq", "hash")).alias("first"))
    )
    opened = anchors(first.select(*_KEY, "ms"), ttl_ms, slice_ttls=slice_ttls).join(
        first, [*_KEY, "ms"]
    )
    bucket = F.expr(f"ms div {int(ttl_ms)}L")
    # an anchor answers within its own and the following expiry-wide bucket
    reach = opened.select(
        *_KEY,
        F.explode(F.array(bucket, bucket + 1)).alias("bucket"),
        F.col("ms").alias("anchor_ms"),
        F.col("first.seq").alias("anchor_seq"),
        F.col("first.hash").alias("anchor_hash"),
    )
    r, a = rows.withColumn("bucket", bucket).alias("r"), reach.alias("a")
    answered = (
        (F.col("r.key") == F.col("a.key"))
        & (F.col("r.endpoint") == F.col("a.endpoint"))
        & (F.col("r.bucket") == F.col("a.bucket"))
        & (F.col("r.ms") <= F.col("a.anchor_ms") + ttl_ms)
        & (F.col("r.seq") >= F.col("a.anchor_seq"))
    )
    decision = (
        F.when(F.col("anchor_seq").isNull(), "rejected")
        .when(F.col("r.seq") == F.col("anchor_seq"), "accepted")
        .when(F.col("r.hash") == F.col("anchor_hash"), "replay")
        .otherwise("conflict")
    )
    return r.join(a, answered, "left").select(
        *[F.col(f"r.{c}") for c in requests.columns],
        decision.alias("decision"),
        F.col("anchor_seq"),
    )
