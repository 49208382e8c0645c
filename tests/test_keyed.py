import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runlens.functions.access import kv_check, scoped_request_key
from runlens.operators import keyed as K
from runlens.operators import requests as Q

CHANGES = "namespace string, ord long, k string, v string, op string"


def test_quota_scenario(spark):
    rows = [("n", 1, "a", "x" * 10, "put"), ("n", 2, "b", "x" * 10, "put")]
    got = K.admission(spark.createDataFrame(rows, CHANGES), 20).collect()
    assert {r.ord: r.decision for r in got} == {1: "ok", 2: "quota_exceeded"}


@pytest.mark.parametrize("chunk,bucket", [(1 << 18, 1 << 18), (7, 5), (1, 1)])
def test_admission_equals_the_fold(spark, chunk, bucket):
    rnd = random.Random(chunk)
    rows = []
    for i in range(60):
        ns = "hot" if rnd.random() < 0.6 else "cold"
        op = "delete" if rnd.random() < 0.2 else "put"
        size = 9000 if rnd.random() < 0.05 else rnd.randrange(0, 12)
        rows.append((ns, i, f"k{rnd.randrange(6)}", "x" * size, op))
    limit, live, want = 25, {}, {}
    for ns, i, k, v, op in rows:
        held = live.setdefault(ns, {})
        if op == "delete":
            held.pop(k, None)
            want[i] = "ok"
        elif len(v) > 8192:
            want[i] = "value_too_large"
        elif sum(held.values()) - held.get(k, 0) + len(k) + len(v) > limit:
            want[i] = "quota_exceeded"
        else:
            held[k] = len(k) + len(v)
            want[i] = "ok"
    df = spark.createDataFrame(rows, CHANGES)
    got = K.admission(df, limit, bucket_rows=bucket, chunk_rows=chunk).collect()
    assert {r.ord: r.decision for r in got} == want


def test_row_checks(spark):
    rows = [("n", "", "v"), ("n", "k" * 257, "v"), ("n", "k", "v" * 8193), ("n-1", "k", "v"), ("n", "k" * 256, "v" * 8192)]
    df = spark.createDataFrame(rows, "ns string, k string, v string")
    got = [r[0] for r in df.select(kv_check("ns", "k", "v")).collect()]
    assert got == ["key_required", "key_too_large", "value_too_large", "namespace_invalid", "ok"]
    coded = spark.createDataFrame([("n", "k", "!!"), ("n", "k", "YQ==")], "ns string, k string, v string")
    assert [r[0] for r in coded.select(kv_check("ns", "k", "v", base64=True)).collect()] == ["value_not_base64", "ok"]


def test_prefix_pages(spark):
    keys = ["app:one", "app:two", "app:three", "bee:one"]
    live = spark.createDataFrame([("n", k, "v") for k in keys], "namespace string, k string, v string")
    first = K.prefix_page(live, "n", "app:", limit=2).collect()
    assert [r.k for r in first] == ["app:one", "app:three"]
    cursor = first[0].next_cursor
    assert cursor == "app:three"
    second = K.prefix_page(live, "n", "app:", cursor, 2).collect()
    assert [(r.k, r.next_cursor) for r in second] == [("app:two", None)]


def test_deletes_report_whether_the_key_was_live(spark):
    rows = [("n", 1, "a", "x", "put"), ("n", 2, "a", "", "delete"), ("n", 3, "a", "", "delete"), ("n", 4, "b", "", "delete")]
    got = K.deletes(spark.createDataFrame(rows, CHANGES), bucket_rows=1).collect()
    assert {r.ord: r.existed for r in got} == {2: True, 3: False, 4: False}


def test_upsert_reports_created(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 3)], "name string, v int, ord long")
    got = {r.name: (r.v, r.created) for r in K.upsert(now, new, ["name"], "ord").collect()}
    assert got == {"a": (1, None), "b": (4, False), "c": (5, True)}


T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("seed,slice_ttls", [(0, 1), (1, 2), (2, 64), (3, 3)])
def test_expiring_admission_equals_the_loop(spark, seed, slice_ttls):
    rnd = random.Random(seed)
    rows, now = [], 0
    for seq in range(150):
        now += rnd.choice([0, 1, 3, 40, 100, 400])
        rows.append((rnd.choice(["a", "b"]), "POST /runs", seq, T0 + timedelta(milliseconds=now),
                     rnd.choice(["h1", "h2"]), rnd.random() > 0.2))
    ttl, held, want = 100, {}, {}
    for key, _, seq, ts, digest, valid in rows:
        stored = held.get(key)
        if stored and not ts > stored[0] + timedelta(milliseconds=ttl):
            want[seq] = "replay" if stored[1] == digest else "conflict"
        elif valid:
            held[key] = (ts, digest)
            want[seq] = "accepted"
        else:
            want[seq] = "rejected"
    df = spark.createDataFrame(rows, "key string, endpoint string, seq long, ts timestamp, hash string, valid boolean")
    got = Q.admission(df, ttl, slice_ttls=slice_ttls).collect()
    assert {r.seq: r.decision for r in got} == want


def test_lookup_boundaries(spark):
    store = spark.createDataFrame(
        [("k", "e", "h", 201, "body", 1000), ("z", "e", "h", 201, "body", 0)],
        "key string, endpoint string, body_sha256 string, status int, body string, ttl_expires_at long",
    )
    asked = spark.createDataFrame(
        [("k", "e", "h", 1000), ("k", "e", "h", 1001), ("k", "e", "x", 999), ("m", "e", "h", 1), ("z", "e", "h", 10**12)],
        "key string, endpoint string, hash string, now_ms long",
    )
    got = {(r.key, r.now_ms): r.outcome for r in Q.lookup(asked, store).collect()}
    assert got == {("k", 1000): "replay", ("k", 1001): "expired", ("k", 999): "conflict", ("m", 1): "miss", ("z", 10**12): "replay"}


def test_principals_do_not_share_keys(spark):
    df = spark.createDataFrame([("p1",), ("p2",), ("",)], "p string")
    keys = [r[0] for r in df.select(scoped_request_key("p", F.lit("k"))).collect()]
    assert len(set(keys)) == 3 and keys[2] == "k"
