import random

import pytest

from runlens.operators import logs as L
from runlens.operators import metrics as M
from runlens.operators import runs as R

CHUNKS = "run_id string, channel string, seq long, chunk string"


def _assemble(chunks, console=False):
    streams = {}
    for run, channel, seq, text in sorted(chunks, key=lambda c: c[2]):
        streams.setdefault((run, channel), []).append(text)
    out = []
    for (run, channel), texts in streams.items():
        lines = "".join(texts).split("\n")
        if lines[-1] == "":
            lines.pop()
        out += [(run, channel, i, line) for i, line in enumerate(lines) if line or not console]
    return sorted(out)


@pytest.mark.parametrize("console", [False, True])
@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_lines_equal_the_joined_stream(spark, bucket, console):
    rnd = random.Random(bucket)
    chunks = [
        (rnd.choice("ab"), rnd.choice(["stdout", "stderr"]), i,
         "".join(rnd.choice(["x", "yz", "\n", "\n", ""]) for _ in range(rnd.randrange(5))))
        for i in range(80)
    ]
    df = spark.createDataFrame(chunks, CHUNKS)
    got = L.assemble_lines(df, ["run_id", "channel"], console=console, bucket_rows=bucket)
    assert sorted(tuple(r) for r in got.select("run_id", "channel", "line_no", "line").collect()) == _assemble(chunks, console)


def test_secrets_apply_to_their_run_only(spark):
    lines = spark.createDataFrame([("r1", "key abc"), ("r2", "key abc")], "run_id string, line string")
    secrets = spark.createDataFrame([("r1", 1, "abc"), ("r1", 0, "key abc")], "run_id string, ord long, value string")
    got = {r.run_id: r.line for r in L.redact_lines(lines, L.secrets_by_run(secrets)).collect()}
    assert got == {"r1": "[secret]", "r2": "key abc"}


REPORTS = "run_id string, seq long, status string, ts long"


@pytest.mark.parametrize("seed", range(3))
def test_status_fold_equals_the_loop(spark, seed):
    rnd = random.Random(seed)
    reports = [
        (rnd.choice("abc"), i, rnd.choice(["queued", "running", "completed", "failed", "canceled"]), rnd.choice([None, i * 10]))
        for i in range(25)
    ]
    state = {}
    for run, _, status, ts in reports:
        current, finished = state.get(run, (None, None))
        terminal = current in R.TERMINAL
        if terminal and current != status:
            continue
        state[run] = (status, ts if ts is not None and status in R.TERMINAL else finished)
    df = spark.createDataFrame(reports, REPORTS).selectExpr("run_id", "seq", "status", "timestamp_seconds(ts) ts")
    got = R.status_fold(df).selectExpr("run_id", "status", "unix_seconds(finished_at) f").collect()
    assert {r.run_id: (r.status, r.f) for r in got} == state


def test_run_outcome(spark):
    rows = [
        ("ok", 0, False, False), ("bad", 0, False, False), ("bad", 3, False, False), ("err", 0, True, False),
        ("stop", 0, True, True), ("null", None, None, None),
    ]
    df = spark.createDataFrame(rows, "run_id string, exit_code int, error boolean, canceled boolean")
    got = {r.run_id: r.status for r in R.run_outcome(df).collect()}
    assert got == {"ok": "completed", "bad": "failed", "err": "failed", "stop": "canceled", "null": "completed"}


def test_attempts_and_pages(spark):
    df = spark.createDataFrame(
        [("r", 1, 1, 5), ("r", 1, 2, 0), ("r", 2, 1, 0), ("r", 3, 1, 1)], "run_id string, step int, attempt int, exit_code int"
    )
    got = {r.step: (r.attempts, r.final_exit, r.recovered) for r in R.step_attempts(df).collect()}
    assert got == {1: (2, 0, True), 2: (1, 0, False), 3: (1, 1, False)}
    runs = spark.createDataFrame([(f"r{i}", i // 2) for i in range(7)], "run_id string, started_at long")
    assert [r.run_id for r in R.runs_page(runs, 2, 3).collect()] == ["r2", "r3", "r0"]
    assert R.runs_page(runs, 9, 3).count() == 0
    for page, per_page in ((0, 5), (1, 0), (1, 201)):
        with pytest.raises(ValueError):
            R.runs_page(runs, page, per_page)


def test_latency_buckets_and_exposition(spark, tmp_path):
    obs = spark.createDataFrame(
        [("Idempotency_Lookup", " hit ", 5.0), ("journal_append", "quota_exceeded", 12.0), ("journal_read", "", 1.0), ("x", "ok", -1.0)],
        "operation string, outcome string, value_ms double",
    )
    wide = M.latency_histogram(obs)
    by = {(r.operation, r.outcome): r for r in wide.collect()}
    assert len(by) == len(M.LATENCY_LABELS)
    assert by[("idempotency_lookup", "hit")].buckets == [0, 0] + [1] * 10
    assert by[("journal_append", "quota_exceeded")].buckets == [0, 0, 0, 0] + [1] * 8
    assert by[("journal_read", "ok")]["count"] == 1 and by[("journal_read", "error")]["count"] == 0
    lines = M.expose_histogram(wide, "latency_ms", ["operation", "outcome"], M.LATENCY_BUCKETS)
    text = [r.line for r in lines.filter("series = 'idempotency_lookup\\u0001hit'").orderBy("pos").collect()]
    assert text[2] == 'latency_ms_bucket{le="5",operation="idempotency_lookup",outcome="hit"} 1'
    assert text[-3:] == [
        'latency_ms_bucket{le="+Inf",operation="idempotency_lookup",outcome="hit"} 1',
        'latency_ms_sum{operation="idempotency_lookup",outcome="hit"} 5',
        'latency_ms_count{operation="idempotency_lookup",outcome="hit"} 1',
    ]
    evictions = spark.createDataFrame([("journal", 512), ("idempotency", 128), ("", -5)], "kind string, bytes long")
    totals = M.eviction_counters(evictions)
    assert {r.kind: (r["count"], r.amount) for r in totals.collect()} == {
        "journal": (1, 512), "idempotency": (1, 128), "unknown": (1, 0),
    }
    parts = [M.expose_header(totals, "evictions_total", "Evictions", "counter"), M.expose_counter(totals, "evictions_total", ["kind"])]
    M.write_exposition(parts, str(tmp_path / "m"))
    written = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert sorted(written) == sorted([
        "# HELP evictions_total Evictions", "# TYPE evictions_total counter",
        'evictions_total{kind="idempotency"} 1', 'evictions_total{kind="journal"} 1', 'evictions_total{kind="unknown"} 1',
    ])


def test_gauge_per_transport(spark):
    df = spark.createDataFrame([("sse", 1, 2), ("SSE ", 2, -1), ("websocket", 3, 3), ("sse", 4, -5)], "transport string, ord long, delta long")
    got = {r.ord: r.value for r in M.gauge_clamped(df, "transport", "ord", "delta").collect()}
    assert got == {1: 2, 2: 1, 3: 3, 4: 0}


def test_storage_health_limits(spark):
    def state(used, limit, journal, journal_limit):
        files = spark.createDataFrame([("f", used)], "path string, size long")
        size = spark.createDataFrame([(journal,)], "journal_bytes long")
        r = M.storage_health(files, size, max_bytes=limit, journal_max_bytes=journal_limit, schema_version=1).first()
        return r.ok, r.eviction_active

    assert state(89, 100, 0, 10) == (True, False)
    assert state(90, 100, 0, 10) == (True, True)
    assert state(100, 100, 0, 10) == (False, True)
    assert state(1, 0, 10, 10) == (True, True)
    assert state(1, 0, 10, 0) == (True, False)


def test_access_rules(spark):
    log = spark.createDataFrame(
        [("GET", "/runs/a/events", ["runs:read"]), ("POST", "/runs/a:cancel", None), ("PUT", "/kv/n/k", ["kv:write"]), ("GET", "/healthz", [])],
        "method string, path string, granted array<string>",
    )
    got = {(r.method, r.path): (r.allowed, r.missing) for r in M.access_audit(log).collect()}
    assert got == {
        ("GET", "/runs/a/events"): (False, ["events:read"]), ("POST", "/runs/a:cancel"): (True, []),
        ("PUT", "/kv/n/k"): (True, []), ("GET", "/healthz"): (True, []),
    }
