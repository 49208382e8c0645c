import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runlens.operators import journal as J
from runlens.sources.export import export_status, ndjson_lines, write_ndjson

SCHEMA = "seq long, run_id string, event_type string, payload string, ts timestamp"
T0 = datetime(2024, 1, 1)


def _journal(spark, entries):
    rows = [(s, r, "step.log", p, T0 + timedelta(seconds=s)) for s, r, p in entries]
    return spark.createDataFrame(rows, SCHEMA)


def test_append_checks_in_order(spark):
    log = _journal(spark, [(1, "", ""), (2, "r", ""), (3, "r", "x" * 17), (4, "r", "ok")])
    got = {r.seq: r.o for r in log.select("seq", J.append_outcome(8).alias("o")).collect()}
    assert got == {1: "run_id_required", 2: "payload_required", 3: "quota_exceeded", 4: "ok"}


def test_eviction_keeps_the_newest(spark):
    log = _journal(spark, [(1, "run-1", "p" * 19), (2, "run-1", "q" * 19)])
    assert [r.seq for r in J.retained(log, 30).collect()] == [2]
    assert [tuple(r) for r in J.bounds(J.retained(log, 30)).collect()] == [("run-1", 2, 2)]
    assert tuple(J.evictions(log, 30).first()) == ("journal", 1, 19)


@pytest.mark.parametrize("bucket", [1, 5, 1000])
def test_retention_equals_the_append_loop(spark, bucket):
    rnd = random.Random(bucket)
    entries = [(s, f"r{rnd.randrange(3)}", "x" * rnd.choice([0, 1, 5, 9, 40])) for s in range(1, 120)]
    budget = 37
    held = []
    for s, r, p in entries:
        if not p or len(p) > budget:
            continue
        while sum(len(x[2]) for x in held) + len(p) > budget:
            held.pop(0)
        held.append((s, r, p))
    got = J.retained(_journal(spark, entries), budget, bucket_rows=bucket).collect()
    assert sorted(r.seq for r in got) == [s for s, _, _ in held]


def test_retention_of_an_empty_journal(spark):
    empty = _journal(spark, [(1, "", "")])
    assert J.retained(empty, 10).count() == 0
    assert J.total_bytes(empty.filter("seq > 1")).first()[0] == 0


def test_resume_classes(spark):
    log = _journal(spark, [(5, "a", "x"), (9, "a", "x")])
    cursors = spark.createDataFrame(
        [("a", ""), ("a", " 5 "), ("a", "4"), ("a", "9"), ("a", "10"), ("a", "abc"), ("b", "7"), ("a", "-3")],
        "run_id string, cursor string",
    )
    got = {(r.run_id, r.cursor): r.outcome for r in J.resume_classes(cursors, log).collect()}
    assert got == {
        ("a", ""): "ok", ("a", " 5 "): "ok", ("a", "4"): "expired", ("a", "9"): "ok",
        ("a", "10"): "expired", ("a", "abc"): "invalid", ("b", "7"): "ok", ("a", "-3"): "ok",
    }


def test_range_scan_reaches_the_scan(spark, tmp_path):
    _journal(spark, [(1, "a", "x"), (2, "b", "x"), (3, "a", "y")]).write.parquet(str(tmp_path / "j"))
    scan = J.range_scan(spark.read.parquet(str(tmp_path / "j")), "a", 1)
    assert [r.seq for r in scan.collect()] == [3]


@pytest.mark.parametrize("seed", range(3))
def test_replay_buffer_equals_the_add_loop(spark, seed):
    rnd = random.Random(seed)
    entries = [(s, rnd.choice("ab"), T0 + timedelta(seconds=rnd.randrange(60))) for s in range(1, 80)]
    keep, seconds = 6, 20
    held = {"a": [], "b": []}
    for i, (s, r, ts) in enumerate(entries):
        # the clock of an add is the newest stamp of the run; cutoffs never move back
        events = held[r] + [(s, ts)]
        cutoff = ts - timedelta(seconds=seconds)
        while events and events[0][1] < cutoff:
            events.pop(0)
        held[r] = events[-keep:]
    ordered = all(a[2] <= b[2] for a, b in zip(entries, entries[1:]))
    if not ordered:  # the closed form is for clocks that do not run back
        entries = sorted(entries, key=lambda e: e[2])
        entries = [(i + 1, r, ts) for i, (_, r, ts) in enumerate(entries)]
        held = {"a": [], "b": []}
        for s, r, ts in entries:
            events = held[r] + [(s, ts)]
            cutoff = ts - timedelta(seconds=seconds)
            while events[0][1] < cutoff:
                events.pop(0)
            held[r] = events[-keep:]
    df = spark.createDataFrame([(r, s, ts) for s, r, ts in entries], "run_id string, seq long, ts timestamp")
    got = J.replay_buffer(df, max_events=keep, retention_seconds=seconds, bucket_rows=4)
    assert sorted((r.run_id, r.seq) for r in got.collect()) == sorted(
        (k, s) for k, v in held.items() for s, _ in v
    )


def test_replay_from_known_and_unknown_ids(spark):
    held = spark.createDataFrame([("r", 3), ("r", 4), ("r", 5)], "run_id string, seq long")
    asked = spark.createDataFrame(
        [("s1", "r", "4"), ("s2", "r", "99"), ("s3", "r", "")], "subscriber string, run_id string, last_id string"
    )
    got = J.replay_from(held, asked).groupBy("subscriber").count().collect()
    assert {r.subscriber: r["count"] for r in got} == {"s1": 1, "s2": 3, "s3": 3}


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_monotone_delivery(spark, bucket):
    rnd = random.Random(bucket)
    messages = [(rnd.choice("ab"), i, rnd.randrange(40)) for i in range(60)]
    df = spark.createDataFrame(messages, "subscriber string, arrival long, seq long")
    cursors = spark.createDataFrame([("a", 5)], "subscriber string, after_seq long")
    sent, top = [], {"a": 5, "b": 0}
    for who, arrival, seq in messages:
        if seq > top[who]:
            sent.append((who, arrival, seq))
            top[who] = seq
    got = J.monotone_delivery(df, cursors, bucket_rows=bucket)
    assert sorted(tuple(r) for r in got.collect()) == sorted(sent)


def test_ndjson_keeps_number_text_and_stops_at_bad_rows(spark, tmp_path):
    rows = [
        (1, "r", "step.log", '{"v": 1.50, "t": "a b<"}', datetime(2024, 1, 1, 0, 0, 0, 120999)),
        (2, "r", "step.log", '[1e3]', datetime(2024, 1, 1)),
        (3, "r", "step.log", "{broken", datetime(2024, 1, 1)),
        (4, "r", "step.log", "{}", datetime(2024, 1, 1)),
    ]
    log = spark.createDataFrame(rows, SCHEMA)
    lines = [r.line for r in ndjson_lines(log).orderBy("seq").collect()]
    assert lines == [
        '{"sequence":1,"timestamp":"2024-01-01T00:00:00.12Z","event":"step.log","data":{"v":1.50,"t":"a b\\u003c"}}',
        '{"sequence":2,"timestamp":"2024-01-01T00:00:00Z","event":"step.log","data":[1e3]}',
    ]
    write_ndjson(log, str(tmp_path / "out"), 2)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(lines)
    asked = spark.createDataFrame([("r",), ("gone",)], "run_id string")
    assert {r.run_id: r.status for r in export_status(asked, log).collect()} == {"r": "ok", "gone": "expired"}


def test_point_lookup(spark):
    table = spark.createDataFrame([("a", 1)], "k string, v int")
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    got = {r.k: (r.v, r.found) for r in J.point_lookup(keys, table, ["k"]).collect()}
    assert got == {"a": (1, True), "b": (None, False)}
