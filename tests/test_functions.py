import hashlib
import json

import pytest
from pyspark.sql import functions as F

from runlens.functions import payload as Y
from runlens.functions import quantities as Q
from runlens.functions import text as X


def _map(spark, fn, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn("v")).collect()]


CASES = [
    (X.parse_cursor, {"": 0, " 42 ": 42, "abc": None, "-1": -1, "1.5": None, "99999999999999999999": None}),
    (X.route_template, {
        "": "/", "/runs": "/runs", "/runs/a": "/runs/{id}", "/runs/a/events": "/runs/{id}/events",
        "/runs/a/events.ndjson": "/runs/{id}/events.ndjson", "/runs/a:cancel": "/runs/{id}:cancel",
        "/sources/x": "/sources/{name}", "/kv/ns/k": "/kv/ns/k", "/healthz": "/healthz",
    }),
    (X.alias_target_path, {
        " a:b/c ": "a/b/c", "a\\b": "a/b", "a..b": "a.b", "a b": "ab", "//a//b/": "a/b", "...": "..", ":": "",
    }),
    (Q.cpu_millicores, {"500m": 500, "2": 2000, "0.0005": 1, "1.5": 1500, "-1": None, "m": None, "1.5m": None, "x": None, "": None, "1e1": 10000}),
    (Q.memory_bytes, {"1k": 1024, "1.5Mi": 1572864, "2GiB": 2147483648, "10": 10, "-1m": None, "gi": None, "1 Ki": 1024, "1t": None}),
    (Q.image_registry, {"alpine": "docker.io", "alpine:3": "alpine:3", "GHCR.io/x": "ghcr.io", "localhost/x": "localhost", "/x": None, "http://x": None, "a/b": "docker.io"}),
    (X.clean_path, {"/a/./b/../c": "/a/c", "a//b/": "a/b", "": ".", "/..": "/", "../a/..": "..", "/": "/", "a/../..": ".."}),
    (X.local_source_name, {"/a/my dir/": "my-dir", ".": "local", "/": "local", "x": "x"}),
    (X.git_source_name, {"https://h.io/a/b.git": "b", "https://h.io/": "git-h-io", "https://h.io:80": "git-h-io", "/srv/repo.git/": "repo"}),
    (X.image_source_name, {"ghcr.io/a/B c:1@sha256:x": "b-c", "": "oci", "x--y": "x-y", "reg:5000/app": "app", "__.": "oci"}),
    (X.normalize_profile, {" Secure": "secure", "x": None}),
    (X.normalize_pull_policy, {"On-Add": "always", "": "always", "if_not_present": "ifNotPresent", "zzz": None}),
    (X.arg_env_name, {"max-level": "ARG_MAX_LEVEL"}),
    (lambda v: X.float_text(F.col(v).cast("double")), {
        "0": "0", "12.5": "12.5", "1000000": "1e+06", "1234567.5": "1.2345675e+06", "0.0001": "0.0001",
        "0.00001": "1e-05", "123456": "123456", "-0.5": "-0.5", "1e21": "1e+21", "100": "100", "0.001234": "0.001234",
        "999999.5": "999999.5", "12345678": "1.2345678e+07", "1e100": "1e+100",
    }),
    (lambda v: X.job_id_from_path("/root", v), {
        "/root/a/b/config.d/config.yaml": "a.b", "/root/config.d/Config.YAML": ".",
    }),
    (lambda v: X.is_sub_path(F.col(v), F.lit("/srv/x/")), {"/srv/x": True, "/srv/x/a": True, "/srv/xy": False, "/srv/x/../y": False}),
]


@pytest.mark.parametrize("fn,table", CASES, ids=range(len(CASES)))
def test_scalar_tables(spark, fn, table):
    assert dict(zip(table, _map(spark, fn, list(table)))) == table


def test_memory_text(spark):
    df = spark.createDataFrame([(1048576,), (1048577,)], "b long")
    assert [r[0] for r in df.select(Q.memory_text("b")).collect()] == ["1Mi", "1048577 bytes"]


def test_canonical_json(spark):
    bodies = ['{"b": 1.50, "a": [1e3, {"z": null, "y": "<&>"}]}', " [ ] ", "{bad", '"x"', '{"k":"\\u2028é"}', None]
    want = ['{"a":[1e3,{"y":"\\u003c\\u0026\\u003e","z":null}],"b":1.50}', "[]", None, '"x"', '{"k":"\\u2028é"}', None]
    assert _map(spark, Y.canonical_json, bodies) == want
    assert _map(spark, Y.canonical_hash, bodies[1:2]) == [hashlib.sha256(b"[]").hexdigest()]


def test_global_envelope(spark):
    bodies = ['{"b":1.50,"a":{"y":1,"x":[true,null]}}', "plain", "[1]", '{"run_id":"old"}', '{"k":null,"h":"<"}']
    got = _map(spark, lambda v: Y.global_envelope(F.lit("r1"), v), bodies)
    assert [json.loads(g) for g in got] == [
        {"b": 1.5, "a": {"y": 1, "x": [True, None]}, "run_id": "r1"},
        {"data": "plain", "run_id": "r1"}, {"data": "[1]", "run_id": "r1"}, {"run_id": "r1"},
        {"k": None, "h": "<", "run_id": "r1"},
    ]
    assert got[0] == '{"a":{"x":[true,null],"y":1},"b":1.5,"run_id":"r1"}'
    assert "\\u003c" in got[4]


def test_redaction_in_list_order(spark):
    df = spark.createDataFrame([("token=abcd ab", ["ab", "", "[secret]cd"])], "line string, s array<string>")
    assert df.select(Y.redact_line("line", "s")).first()[0] == "token=[secret] [secret]"
    args = spark.createDataFrame([({"a": "1", "b": "2"}, ["b"])], "m map<string,string>, n array<string>")
    assert args.select(Y.redact_args("m", "n")).first()[0] == {"a": "1", "b": "[secret]"}


def test_effective_profile(spark):
    def one(r, e, c):
        return spark.range(1).select(X.effective_profile(F.lit(r), F.lit(e), F.lit(c))).first()[0]

    assert one("", "", "") == "secure"
    assert one("", "Permissive", "disabled") == "permissive"
    assert one("bad", "permissive", "") is None
