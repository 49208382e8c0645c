import json

import pytest
from pyspark.sql import functions as F

from runlens.operators import binding as B
from runlens.operators import manifests as N
from runlens.operators import policy as P


def _check(spark, spec, args):
    df = spark.createDataFrame([(json.dumps(args), json.dumps(spec))], "args string, s string")
    df = df.withColumn("spec", F.from_json("s", f"array<{N.ARG}>")).drop("s")
    row = B.with_binding(B.with_argument_check(df)).first()
    return row


def arg(name, kind="string", **more):
    return {"name": name, "type": kind, **more}


FAULTS = [
    ([arg("a", required=True)], {}, ("a", "required")),
    ([arg("a", required=True)], {"a": ""}, ("a", "required")),
    ([arg("a", enum=["x"])], {"a": "y"}, ("a", 'value "y" not in enum')),
    ([arg("a", secret=True, default="x")], {}, ("a", "default forbidden for secret")),
    ([arg("a", format="secret", default="x")], {"a": "s"}, ("a", "default forbidden for secret")),
    ([arg("a", "array", items_enum=["x"])], {"a": ["x", "y"]}, ("a", 'item "y" not in items_enum')),
    ([arg("a", "array", required=True)], {"a": []}, ("a", "required")),
    ([arg("a", "array", items_type="integer")], {}, ("a", "items_type not supported in Phase 1")),
    ([arg("a", "object", value_type="integer")], {}, ("a", "value_type not supported in Phase 1")),
    ([arg("a", "object")], {"a": {" ": "v"}}, ("a", "empty key")),
    ([arg("a", "boolean", required=True)], {}, ("a", "required")),
    ([arg("a", "number")], {}, (None, "unsupported arg type: number")),
    ([arg("a")], {"a": 1}, (None, "argument a must be a string")),
    ([arg("a")], {"a": None}, (None, "argument a must be a string")),
    ([arg("a", "integer")], {"a": "1"}, (None, "argument a must be an integer")),
    ([arg("a", "boolean")], {"a": "true"}, (None, "argument a must be a boolean")),
    ([arg("a", "array")], {"a": ["x", 1]}, (None, "argument a array items must be strings")),
    ([arg("a", "array")], {"a": "x"}, (None, "argument a must be an array of strings")),
    ([arg("a", "object")], {"a": {"k": 1}}, (None, "argument a values must be strings")),
    ([arg("a"), arg("b", required=True)], {"z": 1, "y": 2}, (None, "unknown argument: y")),
    ([arg("a", required=True), arg("b", required=True)], {}, ("a", "required")),
    ([arg("b", required=True), arg("a", enum=["x"])], {"a": "y"}, ("b", "required")),
    ([], {"a": 1}, (None, "job does not accept arguments")),
]


@pytest.mark.parametrize("spec,args,want", FAULTS, ids=range(len(FAULTS)))
def test_argument_faults(spark, spec, args, want):
    assert tuple(_check(spark, spec, args).arg_error) == want


def test_binding(spark):
    spec = [
        arg("name", default="n"), arg("count", "integer", default=3.9), arg("on", "boolean"),
        arg("tags", "array", default="a,b"), arg("list", "array", default=["x", 1, "y"]),
        arg("env", "object"), arg("pass-word", secret=True),
    ]
    row = _check(spark, spec, {"count": -2.7, "env": {"k ": "a=b", "j": ""}, "pass-word": "s3"})
    assert row.arg_error is None
    assert row.bound == {
        "name": "n", "count": "-2", "on": "false", "tags": '["a","b"]', "list": '["x","y"]',
        "env": '{"j":"","k":"a=b"}', "pass-word": "s3",
    }
    assert row.env == {"ARG_NAME": "n", "ARG_COUNT": "-2", "ARG_ON": "false"}
    assert (row.secret_names, row.secret_values, row.resolved["pass-word"]) == (["pass-word"], ["s3"], "[secret]")


def _overrides(spark, profile, policy, **settings):
    row = {"profile": profile, "network": "", "rootfs_writable": False, "capabilities": [], "env_inheritance": False, **settings}
    schema = "profile string, network string, rootfs_writable boolean, capabilities array<string>, env_inheritance boolean"
    out = P.override_verdicts(spark.createDataFrame([row], schema), policy).first()
    return [(d.subject, d.decision) for d in out.decisions], out.problem, [f.level for f in out.findings]


def test_override_profiles(spark):
    wanted = {"network": "Host", "rootfs_writable": True, "capabilities": ["net_raw"], "env_inheritance": True}
    decisions, problem, _ = _overrides(spark, "secure", P.Policy(), **wanted)
    assert decisions == [("container.network", "denied")]
    assert problem.detail == 'network override "host" not permitted in secure profile'
    decisions, problem, levels = _overrides(spark, "disabled", P.Policy(), **wanted)
    assert [d for _, d in decisions] == ["allowed"] * 4 and problem is None and levels == ["warning"] * 4
    some = P.Policy(networks=["HOST"], rootfs_writable=True)
    decisions, problem, levels = _overrides(spark, "permissive", some, **wanted)
    assert [d for _, d in decisions] == ["allowed", "allowed", "denied"] and levels == ["info", "info"]
    assert problem.detail == "policy does not allow adding capabilities"
    assert _overrides(spark, "secure", P.Policy(), network=" None ") == ([], None, [])


def test_allow_lists(spark):
    one = spark.range(1)
    assert one.select(P.registry_allowed(F.lit("x"), [])).first()[0] is True
    assert one.select(P.registry_allowed(F.lit("GHCR.io"), [" ghcr.io "])).first()[0] is True
    assert one.select(P.namespace_allowed(F.lit("x"), [])).first()[0] is False


def test_manifest_that_is_no_object(spark):
    docs = spark.createDataFrame([("[]",), ("{",), ('{"metadata": null, "jobs": {}}',)], "doc string")
    linted = N.lint(docs, api_version="v1", runner_key="runner").collect()
    assert linted[0].errors == linted[1].errors == ["manifest must be an object"]
    assert "metadata must be an object per manifest schema" in linted[2].errors
    assert "jobs must be an array per manifest schema" in linted[2].errors


def test_manifests_of_one_file_are_checked_by_many_tasks(spark, tmp_path):
    from runlens.queries import checks

    parts = spark.range(400).coalesce(1).selectExpr("id p_partkey", "'n' p_name", "'b' p_brand", "1 p_size")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    linted = checks._manifests(spark, str(tmp_path)).select("p_partkey", F.spark_partition_id().alias("p"))
    assert linted.select("p").distinct().count() > 1 and linted.count() == 400


def test_plans_look_in_the_named_source_first(spark):
    from runlens.operators import catalog as C
    from runlens.plans.plan_table import plan_table
    from runlens.sources.discovery import CONFIG

    jobs = spark.createDataFrame(
        [("", "build", 0, "root"), ("s1", "build", 1, "one"), ("", "only.root", 2, "root"), ("s1", "deep", 3, "one")],
        "scope string, id string, ord long, source_ref string",
    )
    none = F.lit("{}")
    jobs = jobs.select(
        "scope", "id", "ord", F.col("scope").alias("source_name"), "source_ref",
        F.lit(None).cast(f"array<{N.ARG}>").alias("spec"), F.from_json(none, CONFIG).alias("c"),
    ).select("scope", "id", "ord", "source_name", "source_ref", "spec", "c.interpreter", "c.executor",
             "c.container", "c.env_inheritance", "c.composition", "c.steps")
    declared = spark.createDataFrame(
        [("s1", "s1", 0, "deep", "go", ""), ("", "", 1, "build", "go", ""), ("", "", 2, "deep", "lost", "")],
        "scope string, source string, ord long, from string, to string, description string",
    )
    checked = C.check_aliases(declared, jobs, scope="scope")
    sources = spark.createDataFrame([("s1", "/srv/s1"), ("s2", "")], "name string, local_path string")
    asked = [
        (1, "build", "s1"), (2, "build", None), (3, "only.root", "s1"), (4, "go", "s1"), (5, "go", ""),
        (6, "build", "s2"), (7, "build", "s9"), (8, "deep", ""), (9, "lost", ""),
    ]
    requests = spark.createDataFrame(asked, "request long, name string, source string").withColumns(
        {"args": none, "requested_profile": F.lit("secure"), "verified": F.lit(True), "reason": F.lit("")}
    )
    plans = plan_table(requests, jobs, checked, P.Policy(), sources=sources).collect()
    got = {r.request: (r.effective_id, r.stage, r.code, (r.provenance or {}).get("source_ref")) for r in plans}
    assert got == {
        1: ("build", None, None, "one"), 2: ("build", None, None, "root"), 3: ("only.root", None, None, "root"),
        4: ("deep", None, None, "one"), 5: ("build", None, None, "root"),
        6: (None, "source", "source_not_materialized", None), 7: (None, "source", "source_not_found", None),
        8: (None, "resolve", "job.not_found", None), 9: (None, "resolve", "alias.invalid", None),
    }
