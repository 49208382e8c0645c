"""Bucketed running aggregates against plain Python, with buckets of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import quantiles
from runlens.operators.quantiles import nearest_rank
from runlens.operators.running import clamped_gauge, numbered, running


def _data(seed, n=200, hot=0.5):
    rnd = random.Random(seed)
    seqs = sorted(rnd.sample(range(3 * n), n))
    return [("hot" if rnd.random() < hot else f"k{rnd.randrange(5)}", s, rnd.randrange(-9, 10)) for s in seqs]


@pytest.mark.parametrize("bucket", [1, 7, 64, 10_000])
def test_running_sum_and_max(spark, bucket):
    data = _data(bucket)
    df = spark.createDataFrame(data, "k string, seq long, v long")
    specs = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "lo": ("min", F.col("v")), "n": ("count", F.lit(1))}
    got = {r.seq: r for r in running(df, ["k"], "seq", specs, bucket_rows=bucket).collect()}
    excl = {r.seq: r for r in running(df, ["k"], "seq", specs, before=True, bucket_rows=bucket).collect()}
    seen = {}
    for k, seq, v in data:
        old = list(seen.get(k, []))
        now = seen.setdefault(k, [])
        now.append(v)
        assert (got[seq].s, got[seq].m, got[seq].lo, got[seq].n) == (sum(now), max(now), min(now), len(now))
        assert (excl[seq].s, excl[seq].n) == (sum(old), len(old))
        assert excl[seq].m == (max(old) if old else None)


def test_running_in_reverse(spark):
    data = _data(3)
    df = spark.createDataFrame(data, "k string, seq long, v long")
    got = running(df, ["k"], "seq", {"s": ("sum", F.col("v"))}, reverse=True, bucket_rows=16).collect()
    for r in got:
        assert r.s == sum(v for k, s, v in data if k == r.k and s >= r.seq)


def test_numbered_whole_table(spark):
    df = spark.createDataFrame([(s,) for s in (5, 900, 12, 77)], "seq long")
    got = {r.seq: r.n for r in numbered(df, [], "seq", "n", start=10, bucket_rows=10).collect()}
    assert got == {5: 10, 12: 11, 77: 12, 900: 13}


@pytest.mark.parametrize("bucket", [1, 9, 10_000])
def test_clamped_gauge(spark, bucket):
    data = _data(100 + bucket)
    df = spark.createDataFrame(data, "k string, seq long, v long")
    got = {r.seq: r.g for r in clamped_gauge(df, ["k"], "seq", F.col("v"), "g", bucket_rows=bucket).collect()}
    level = {}
    for k, seq, v in data:
        level[k] = max(0, level.get(k, 0) + v)
        assert got[seq] == level[k]


@pytest.mark.parametrize("accuracy", [2, 10, 10_000])
def test_nearest_rank_is_exact_for_any_sketch(spark, accuracy):
    rnd = random.Random(accuracy)
    data = [(rnd.choice("aab"), rnd.choice([rnd.random(), 0.5, 7.0])) for _ in range(500)] + [("c", 1.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {(r.k, r.q): (r.value, r.n) for r in nearest_rank(df, ["k"], "v", [0.0, 0.5, 0.95, 0.99, 1.0], accuracy=accuracy).collect()}
    for k in "abc":
        values = sorted(v for kk, v in data if kk == k)
        for q in (0.0, 0.5, 0.95, 0.99, 1.0):
            rank = min(len(values), max(1, -(-int(q * 100) * len(values) // 100)))
            assert got[(k, q)] == (values[rank - 1], len(values))


def test_nearest_rank_without_keys(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 1201)], "v double")
    got = {r.q: r.value for r in nearest_rank(df, [], "v", [0.5, 0.95, 0.99]).collect()}
    assert got == {0.5: 600.0, 0.95: 1140.0, 0.99: 1188.0}


def test_nearest_rank_narrows_in_one_round(spark, monkeypatch):
    rounds, parts = [], quantiles._parts
    monkeypatch.setattr(quantiles, "_parts", lambda *a: rounds.append(a) or parts(*a))
    df = spark.range(200_000).selectExpr("id * 7919 % 200000 AS v")
    got = {r.q: r.value for r in nearest_rank(df, [], "v", [0.5, 0.95, 0.99], bound=500).collect()}
    assert got == {0.5: 99_999, 0.95: 189_999, 0.99: 197_999}
    assert len(rounds) == 1
