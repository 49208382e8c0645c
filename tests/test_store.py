"""Journal store, resumed streams, expiring state, snapshots and pages."""

import os
import random
from datetime import datetime, timedelta
from glob import glob

import pytest
from pyspark.sql import functions as F

from runlens import tables
from runlens.operators import journal as J
from runlens.operators import keyed as K
from runlens.operators import metrics as M
from runlens.operators import requests as Q
from runlens.operators import snapshots as SN
from runlens.session import scratch_path
from runlens.streaming import commits as C
from runlens.streaming import jobs as S
from test_streaming import T0, _set, batches  # noqa: F401

EVENTS = "arrival long, run_id string, event_type string, payload string, ts timestamp"


def arrivals(n, seed=1):
    rnd = random.Random(seed)
    return [
        (i, rnd.choice(["a", "b", "", None]) if i % 7 == 0 else "r", "step.log", "x" * rnd.randrange(6), T0 + timedelta(seconds=i))
        for i in range(n)
    ]


def admitted(rows, most):
    good = [r for r in rows if r[1] and 0 < len(r[3]) <= most]
    return [(i + 1, r[0]) for i, r in enumerate(good)]


def seqs(spark, base):
    return sorted(tuple(r) for r in C.events(spark, base).select("seq", "arrival").collect())


def test_ingest_after_a_lost_checkpoint(spark, batches):  # noqa: F811
    """A stream that starts anew after batch 2 adds what is missing, once, and numbers on."""
    rows = arrivals(60)
    _, stream = batches(rows, EVENTS, parts=4)
    base, feed = scratch_path(spark, "store"), scratch_path(spark, "feed")
    inner = S.journal_sink(base, arrival="arrival", max_bytes=4, downstream=[S.table_sink(feed)], zone_rows=8)
    calls = []

    def dies(batch, batch_id):
        if batch_id == 2:
            raise RuntimeError("lost")
        inner(batch, batch_id)

    with pytest.raises(Exception):
        S.start(stream, dies).awaitTermination()
    done = len(seqs(spark, base))
    assert 0 < done < len(admitted(rows, 4))

    def again(batch, batch_id):
        calls.append(batch_id)
        inner(batch, batch_id)

    S.start(stream, again).awaitTermination()  # a new checkpoint: batches 0 and 1 come again
    assert len(calls) == 4
    assert seqs(spark, base) == admitted(rows, 4)
    assert sorted(tuple(r) for r in spark.read.parquet(feed).select("seq", "arrival").collect()) == admitted(rows, 4)
    zones = C.zones(spark, base)
    assert zones.agg(F.sum("rows")).first()[0] == len(admitted(rows, 4))
    assert zones.filter("commit > 1").count() > 0 and zones.agg(F.countDistinct("commit")).first()[0] == 4
    assert C.refused(spark, base).count() == len(rows) - len(admitted(rows, 4))


def test_uncommitted_files_are_not_seen(spark):
    base = scratch_path(spark, "store")
    rows = arrivals(20)
    frame = spark.createDataFrame(rows, EVENTS)
    C.commit(frame.filter("arrival < 10"), base, arrival="arrival", max_bytes=4)
    before = seqs(spark, base)
    # what an attempt leaves behind that dies before its manifest
    C.events(spark, base).drop("commit").write.partitionBy("zone").parquet(f"{base}/events/commit=1")
    assert seqs(spark, base) == before
    C.commit(frame, base, arrival="arrival", max_bytes=4)
    assert seqs(spark, base) == admitted(rows, 4)


def test_partial_fan_out_is_finished(spark):
    """A sink that failed gets its commits later; the others don't get theirs twice."""
    base, seen, broken = scratch_path(spark, "store"), [], [True]
    frame = spark.createDataFrame(arrivals(30), EVENTS)

    def first(batch, commit):
        seen.append(("first", commit, batch.count()))

    def second(batch, commit):
        if broken[0]:
            raise RuntimeError("down")
        seen.append(("second", commit, batch.count()))

    def ingest(low, high):
        part = frame.filter((F.col("arrival") >= low) & (F.col("arrival") < high))
        C.commit(part, base, arrival="arrival", max_bytes=4, downstream=[first, None, second])

    with pytest.raises(RuntimeError):
        ingest(0, 15)
    broken[0] = False
    ingest(0, 15)  # the batch again
    ingest(15, 30)
    assert [s[:2] for s in seen] == [("first", 0), ("second", 0), ("first", 1), ("second", 1)]
    assert seen[0][2] == seen[1][2]


def test_commits_without_admitted_rows(spark):
    base = scratch_path(spark, "store")
    bad = spark.createDataFrame([(1, "", "e", "x", T0), (2, "r", "e", "", T0)], EVENTS)
    C.commit(bad, base, arrival="arrival", max_bytes=4)
    C.commit(bad, base, arrival="arrival", max_bytes=4)
    C.commit(spark.createDataFrame([(3, "r", "e", "y", T0)], EVENTS), base, arrival="arrival", max_bytes=4)
    assert seqs(spark, base) == [(1, 3)]
    assert C.refused(spark, base).count() == 2


@pytest.mark.parametrize("budget", [5, 17, 60, 10_000])
def test_zone_retention(spark, budget):
    """Equal to retention over the rows; the plan reads only the newest zones' folders."""
    base = scratch_path(spark, "store")
    rows = arrivals(80, seed=3)
    frame = spark.createDataFrame(rows, EVENTS)
    for low in range(0, 80, 25):
        C.commit(frame.filter((F.col("arrival") >= low) & (F.col("arrival") < low + 25)), base, arrival="arrival", max_bytes=5, zone_rows=10)
    kept = C.retained(spark, base, budget)
    everything = C.events(spark, base).drop("zone", "commit", "bytes")
    assert _set(kept, "seq") == _set(J.retained(everything, budget, bucket_rows=7), "seq")
    columns = ("evictions", "evicted_bytes")
    assert _set(C.evictions(spark, base, budget), *columns) == _set(J.evictions(everything, budget, bucket_rows=7), *columns)
    zone, _ = C.retention_cut(spark, base, budget)
    read = {int(r[0].split("zone=")[1].split("/")[0]) for r in kept.select("_metadata.file_path").collect()}
    assert read and min(read) >= zone and (budget > 50 or zone > 3)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert "isnotnull(zone#" in filters  # the rest of a long list is cut off
    with pytest.raises(ValueError):
        C.retained(spark, base, 1)


def test_expired_responses_leave_the_state(spark, batches):  # noqa: F811
    rnd, rows, now = random.Random(6), [], 0
    for seq in range(80):
        now += rnd.choice([0, 3, 50, 200])
        rows.append((f"k{seq // 8}", "e", seq, T0 + timedelta(milliseconds=now), rnd.choice("xy"), rnd.random() > 0.2))
    table, stream = batches(rows, "key string, endpoint string, seq long, ts timestamp, hash string, valid boolean", parts=5)
    place = scratch_path(spark, "state")
    got = spark.read.parquet(S.drain(S.admit_requests(stream, 100, lateness="0 seconds"), "req", checkpoint=place))
    columns = ("key", "seq", "decision", "anchor_seq")
    assert _set(got, *columns) == _set(Q.admission(table, 100, slice_ttls=2), *columns)
    state = spark.read.format("statestore").option("stateVarName", "anchor").load(place)
    held = {r["key"][0] for r in state.select("key").collect()}
    accepted = {}
    for r in got.filter("decision = 'accepted'").join(table.select("seq", "ts"), "seq").collect():
        accepted[r["key"]] = max(accepted.get(r["key"], T0), r["ts"])
    last = max(r[3] for r in rows)
    live = {k for k, ts in accepted.items() if last <= ts + timedelta(milliseconds=100)}
    assert len(accepted) >= 8 and held == live


def test_resume_then_tail(spark, batches):  # noqa: F811
    rnd = random.Random(8)
    rows = [(rnd.choice("abc"), i, i + 1) for i in range(90)]
    table, stream = batches(rows, "run_id string, arrival long, seq long", parts=4)
    stored = table.filter("seq <= 50")
    cursors = [(1, "a", ""), (2, "a", "20"), (3, "b", "-4"), (4, "b", "80"), (5, "c", "x"), (6, "d", "7"), (7, "c", "33")]
    asked = spark.createDataFrame(cursors, "subscriber long, run_id string, cursor string")
    out = scratch_path(spark, "followed")
    got = S.resume_and_tail(stored, stream.filter("seq > 30"), asked, out)
    want = set()
    for who, run, text in cursors:
        mine = [r[2] for r in rows if r[0] == run]
        old = [s for s in mine if s <= 50]
        try:
            after = int(text or 0)
        except ValueError:
            continue
        if after > 0 and old and not min(old) <= after <= max(old):
            continue
        want |= {(who, run, s, "replay" if s <= 50 else "live") for s in mine if s > after}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_resume_grid(spark):
    rnd = random.Random(9)
    log = [("hot" if i % 3 else f"r{i % 11}", i + 1) for i in range(400)]
    journal = spark.createDataFrame(log, "run_id string, seq long")
    asked = [(n, rnd.choice(["hot", "hot", "r3", "none"]), str(rnd.randrange(-3, 420))) for n in range(60)]
    cursors = spark.createDataFrame(asked, "subscriber long, run_id string, cursor string")
    good = {(r["subscriber"], r["run_id"], r["after_seq"]) for r in J.resume_classes(cursors, journal).filter("outcome = 'ok'").collect()}
    want = sorted((s, run, q) for s, run, after in good for r, q in log if r == run and q > after)
    rows = J.resume_rows(cursors, journal, bucket_rows=16)
    assert _set(rows, "subscriber", "run_id", "seq") == want
    grid = J.resume_grid(cursors, journal, 16)
    formed = journal.withColumn("__b", F.expr("seq div 16")).join(grid, ["run_id", "__b"]).count()
    assert formed <= len(want) + 16 * len(good)
    counts = {}
    for s, run, q in want:
        n, lo, hi = counts.get((s, run), (0, q, q))
        counts[s, run] = (n + 1, min(lo, q), max(hi, q))
    got = J.resume_counts(cursors, journal, bucket_rows=16)
    assert _set(got, "subscriber", "run_id", "n", "first_seq", "last_seq") == sorted((*k, *v) for k, v in counts.items())


def test_snapshot_rewrites_touched_slots_only(spark):
    rnd = random.Random(11)
    rows = [("n", f"k{rnd.randrange(60)}", f"v{i}", i, "delete" if rnd.random() < 0.2 else "put") for i in range(200)]
    changes = spark.createDataFrame(rows, "namespace string, k string, v string, ord long, op string")
    snapshot = SN.Snapshot(spark, ["namespace", "k"], "ord", slots=8, buckets=2)
    files = lambda: {f: os.path.getmtime(f) for f in glob(f"{snapshot.path.removeprefix('file:')}/slot=*/part-*")}
    assert len(snapshot.apply(changes.filter("ord < 120"))) == 8
    for low, high in ((120, 180), (180, 200)):
        snapshot.apply(changes.filter((F.col("ord") >= low) & (F.col("ord") < high)))
    before = files()
    one = spark.createDataFrame([("n", "k1", "new", 500, "put")], changes.schema)
    touched = snapshot.apply(one)
    after = files()
    assert len(touched) == 1
    same = {f for f in before if f in after and before[f] == after[f]}
    assert {f for f in before if f not in same} == {f for f in before if f"/slot={touched[0]}/" in f} != set()
    columns = ("namespace", "k", "v", "ord")
    want = K.latest(changes.unionByName(one), ["namespace", "k"], "ord", op="op")
    assert _set(snapshot.live(), *columns) == _set(want, *columns)
    assert snapshot.apply(changes.filter("ord < 50")) and _set(snapshot.live(), *columns) == _set(want, *columns)
    assert snapshot.apply(changes.limit(0)) == []


def test_snapshot_side_has_no_exchange(spark):
    rows = [("n", f"k{i}", "v", i, "put") for i in range(50)]
    changes = spark.createDataFrame(rows, "namespace string, k string, v string, ord long, op string")
    snapshot = SN.Snapshot(spark, ["namespace", "k"], "ord", slots=4)
    snapshot.apply(changes)
    newest = K.latest(changes, ["namespace", "k"], "ord")
    joined = SN.merge(snapshot.rows().drop("slot"), newest, ["namespace", "k"], "ord")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    # the way from the scan up to the join
    way = plan[plan.index("SortMergeJoin") : plan.index("FileScan parquet")]
    assert "Exchange" not in way


def test_next_prefix(spark):
    cases = [b"", b"a", b"az", b"a\xff", b"\xff\xff", b"\x00", b"a\xfe\xff", b"\x0f\xff", b"\xf0", b"\xff\x0f"]
    got = spark.createDataFrame([(c,) for c in cases], "p binary").select("p", SN.next_prefix(F.col("p")).alias("n"))

    def want(p):
        p = p.rstrip(b"\xff")
        return p[:-1] + bytes([p[-1] + 1]) if p else None

    assert {bytes(r["p"]): r["n"] and bytes(r["n"]) for r in got.collect()} == {c: want(c) for c in cases}


def test_prefix_pages(spark):
    rnd = random.Random(13)
    keys = {("nm"[rnd.randrange(2)], "".join(rnd.choices("ab\x7fé", k=rnd.randint(1, 4)))) for _ in range(150)}
    live = spark.createDataFrame([(n, k, i) for i, (n, k) in enumerate(sorted(keys))], "namespace string, k string, size long").repartition(5)
    asked = []
    for i in range(120):
        prefix = "".join(rnd.choices("ab\x7fé", k=rnd.randint(0, 2)))
        cursor = rnd.choice(["", None, "a", prefix + "a", "b\x7f", "zz"])
        asked.append((i, rnd.choice("nmq"), prefix, cursor, rnd.choice([0, 1, 2, 5, 300, -1, 20])))
    requests = spark.createDataFrame(asked, "request long, namespace string, prefix string, cursor string, limit int")
    want = []
    for i, n, prefix, cursor, limit in asked:
        limit = limit if 1 <= limit <= 9 else 9
        found = sorted((k.encode() for m, k in keys if m == n and k.startswith(prefix) and k.encode() > (cursor or "").encode()))
        after = found[limit - 1].decode() if len(found) > limit else None
        want += [(i, p + 1, n, k.decode(), after) for p, k in enumerate(found[:limit])]
    got = SN.prefix_pages(live, requests, max_limit=9)
    assert sorted(tuple(r) for r in got.select("request", "place", "namespace", "k", "next_cursor").collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert SN.prefix_pages(live, requests.limit(0)).count() == 0


def test_prefix_pages_broadcast_no_ranks(spark):
    """The files of the requests say nothing of the ranks that come of them."""
    live = spark.range(40).selectExpr("'n' AS namespace", "concat('k', id) AS k", "id AS size")
    requests = spark.range(9).selectExpr("id AS request", "'n' AS namespace", "'k' AS prefix", "'' AS cursor", "5 AS limit")
    got = SN.prefix_pages(live, requests)
    assert got.count() == 45
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_storage_health_from_files(spark):
    sf = "/root/testdata/sf0.001"
    files = M.table_files(tables.load(spark, sf, "documents"))
    want = [(os.path.getsize(f"{sf}/documents.parquet"),)]
    assert _set(files, "size") == want
    row = M.storage_health(files, J.total_bytes(tables.journal(spark, sf)), max_bytes=want[0][0], journal_max_bytes=0, schema_version=1).first()
    assert row["bytes_used"] == want[0][0] and not row["ok"] and row["eviction_active"]
