"""Streams of several batches give what the batch operators give."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from runlens.operators import journal as J
from runlens.operators import keyed as K
from runlens.operators import logs as L
from runlens.operators import requests as Q
from runlens.operators import runs as R
from runlens.session import scratch_path
from runlens.streaming import jobs as S

T0 = datetime(2024, 1, 1)


@pytest.fixture
def batches(spark):
    """Write rows as several files and read them as a stream, one file per batch, in order."""

    def make(rows, schema, parts=3):
        path = scratch_path(spark, "input")
        size = -(-len(rows) // parts)
        for i in range(parts):
            spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
        table = spark.read.parquet(path)
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
        return table, stream

    return make


def _set(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_live_run_state(spark, batches):
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), i, rnd.choice(["running", "completed", "failed"]), T0 + timedelta(seconds=i)) for i in range(30)]
    table, stream = batches(rows, "run_id string, seq long, status string, ts timestamp")
    path = S.drain(S.live_run_state(stream), "state", mode="update")
    got = S.newest_per_key(spark, path, ["run_id"])
    columns = ("run_id", "status", "finished_at")
    assert _set(got, *columns) == _set(R.status_fold(table), *columns)


def test_ingest_numbers_on_and_replays_the_same(spark, batches):
    rows = [(i, "" if i % 5 == 0 else "r", "step.log", "x" * (i % 4), T0 + timedelta(microseconds=i * 1500)) for i in range(24)]
    table, stream = batches(rows, "arrival long, run_id string, event_type string, payload string, ts timestamp")
    base, seen = scratch_path(spark, "journal"), []
    sink = S.journal_sink(base, arrival="arrival", max_bytes=2, downstream=[None, lambda b, i: seen.append((i, b.count()))])
    S.start(stream, sink).awaitTermination()
    kept = sorted(tuple(r) for r in spark.read.parquet(f"{base}/events").select("seq", "arrival").collect())
    good = [r[0] for r in rows if r[1] and 0 < len(r[3]) <= 2]
    assert kept == [(i + 1, a) for i, a in enumerate(good)]
    assert sum(n for _, n in seen) == len(good)
    refused = spark.read.parquet(f"{base}/refused").groupBy("outcome").count().collect()
    assert sum(r["count"] for r in refused) == len(rows) - len(good)
    # a replayed batch rewrites its own rows with the same numbers
    again = table.filter((F.col("arrival") >= 8) & (F.col("arrival") < 16))
    sink(again, 1)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{base}/events").select("seq", "arrival").collect()) == kept
    stamps = spark.read.parquet(f"{base}/events").selectExpr("max(unix_micros(ts) % 1000)").first()[0]
    assert stamps == 0


def test_failed_journal_write_stops_the_fan_out(spark, tmp_path):
    seen = []
    blocker = tmp_path / "file"
    blocker.write_text("x")
    sink = S.journal_sink(f"{blocker}/j", arrival="arrival", max_bytes=9, downstream=[lambda b, i: seen.append(i)])
    rows = spark.createDataFrame([(1, "r", "e", "x", T0)], "arrival long, run_id string, event_type string, payload string, ts timestamp")
    with pytest.raises(Exception):
        sink(rows, 0)
    assert seen == []


def test_requests(spark, batches):
    rnd, rows, now = random.Random(2), [], 0
    for seq in range(60):
        now += rnd.choice([0, 3, 50, 200])
        rows.append((rnd.choice("ab"), "e", seq, T0 + timedelta(milliseconds=now), rnd.choice(["x", "y"]), rnd.random() > 0.2))
    table, stream = batches(rows, "key string, endpoint string, seq long, ts timestamp, hash string, valid boolean")
    got = spark.read.parquet(S.drain(S.admit_requests(stream, 100), "req"))
    columns = ("key", "seq", "decision", "anchor_seq")
    assert _set(got, *columns) == _set(Q.admission(table, 100, slice_ttls=2), *columns)


def test_kv_quota(spark, batches):
    rnd = random.Random(3)
    rows = [(rnd.choice(["n", "m"]), i, f"k{rnd.randrange(5)}", "x" * rnd.randrange(12), "delete" if rnd.random() < 0.2 else "put") for i in range(45)]
    table, stream = batches(rows, "namespace string, ord long, k string, v string, op string")
    got = spark.read.parquet(S.drain(S.admit_changes(stream, 25), "kv"))
    columns = ("namespace", "ord", "decision")
    assert _set(got, *columns) == _set(K.admission(table, 25), *columns)


def test_lines(spark, batches):
    rnd = random.Random(4)
    rows = [(rnd.randrange(2), "stdout", i, "".join(rnd.choice(["x", "\n", "yz"]) for _ in range(3)), False) for i in range(30)]
    rows += [(r, "stdout", 30 + r, "end", True) for r in (0, 1)]
    rows = [(7, "stderr", 0, "no line yet, ", False), *rows, (7, "stderr", 1, "now\n", True)]
    table, stream = batches(rows, "run_id long, channel string, seq long, chunk string, last boolean")
    got = spark.read.parquet(S.drain(S.lines(stream), "lines"))
    columns = ("run_id", "channel", "line_no", "line")
    assert _set(got, *columns) == _set(L.assemble_lines(table, ["run_id", "channel"]), *columns)


def test_delivery_resumes_after_the_cursor(spark, batches):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), i, rnd.randrange(40)) for i in range(45)]
    table, stream = batches(rows, "run_id string, arrival long, seq long")
    cursors = spark.createDataFrame([(1, "a", 5), (2, "a", 0), (3, "b", 30)], "subscriber long, run_id string, after_seq long")
    got = spark.read.parquet(S.drain(S.deliver(stream, cursors), "sent"))
    fanned = table.join(cursors, "run_id").select("subscriber", "run_id", "arrival", "seq")
    want = J.monotone_delivery(fanned, cursors, keys=("subscriber", "run_id"), bucket_rows=7)
    columns = ("subscriber", "run_id", "arrival", "seq")
    assert _set(got, *columns) == _set(want, *columns)


def test_recent_events(spark, batches):
    rows = [("ab"[i % 3 == 0], i, T0 + timedelta(seconds=i * i)) for i in range(40)]
    table, stream = batches(rows, "run_id string, seq long, ts timestamp")
    out = spark.read.parquet(S.drain(S.recent_events(stream, 8, 300), "recent"))
    newest = out.groupBy("run_id").agg(F.max("newest").alias("newest"))
    got = out.join(newest, ["run_id", "newest"], "left_semi")
    want = J.replay_buffer(table, max_events=8, retention_seconds=300, bucket_rows=5)
    assert _set(got, "run_id", "seq") == _set(want, "run_id", "seq")


def test_many_small_keys_share_calls(spark, batches, monkeypatch, tmp_path):
    """Calls are by slots of keys, not by keys or subscribers; few slots change no row."""

    class Calls(StatefulProcessor):  # here, so that it travels with its code

        def __init__(self, processor, log):
            self.processor, self.log = processor, log

        def init(self, handle):
            self.processor.init(handle)

        def handleInputRows(self, key, rows, timerValues):
            with open(self.log, "a") as log:
                log.write("x")
            yield from self.processor.handleInputRows(key, rows, timerValues)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield from self.processor.handleExpiredTimer(key, timerValues, expiredTimerInfo)

        def close(self):
            pass

    rnd = random.Random(8)
    for name in ("Delivery", "LineAssembly"):
        made = getattr(S.P, name)
        monkeypatch.setattr(S.P, name, lambda *a, made=made, name=name: Calls(made(*a), str(tmp_path / name)))

    rows = [(f"r{rnd.randrange(60)}", i, rnd.randrange(400)) for i in range(300)]
    table, stream = batches(rows, "run_id string, arrival long, seq long")
    cursors = spark.range(180).selectExpr("id AS subscriber", "concat('r', id % 60) AS run_id", "id AS after_seq")
    got = spark.read.parquet(S.drain(S.deliver(stream, cursors, slots=2), "sent"))
    fanned = table.join(cursors, "run_id").select("subscriber", "run_id", "arrival", "seq")
    want = J.monotone_delivery(fanned, cursors, keys=("subscriber", "run_id"), bucket_rows=50)
    columns = ("subscriber", "run_id", "arrival", "seq")
    assert _set(got, *columns) == _set(want, *columns)

    rows = [(rnd.randrange(60), "out", i, rnd.choice(["x", "y\n", "\nz"]), False) for i in range(240)]
    rows += [(r, "out", 240 + r, ".", True) for r in range(60)]
    table, stream = batches(rows, "run_id long, channel string, seq long, chunk string, last boolean")
    got = spark.read.parquet(S.drain(S.lines(stream, slots=2), "lines"))
    columns = ("run_id", "channel", "line_no", "line")
    assert _set(got, *columns) == _set(L.assemble_lines(table, ["run_id", "channel"]), *columns)

    for name in ("Delivery", "LineAssembly"):
        assert 0 < len((tmp_path / name).read_text()) <= 3 * 2
