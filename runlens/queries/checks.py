"""Queries that validate arguments, manifests, step graphs, sources and policy."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import tables
from runlens.functions import quantities as Q
from runlens.functions import text as X
from runlens.operators import admission as A
from runlens.operators import binding as B
from runlens.operators import graphs as G
from runlens.operators import manifests as N
from runlens.operators import metrics as M
from runlens.operators import policy as P
from runlens.operators import catalog as C
from runlens.plans import plan_table as PT
from runlens.sources.discovery import CONFIG


def _pick(selector: Column, *choices: Column | str | None) -> Column:
    """``choices[selector]``."""
    out = F.lit(None)
    for i, choice in reversed(list(enumerate(choices))):
        value = choice if isinstance(choice, Column) else F.lit(choice)
        out = F.when(selector == i, value).otherwise(out)
    return out


def _part(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["p_partkey", "p_name", "p_brand", "p_size"]
    return tables.load(spark, sf, "part").select(*columns)


# --- quantities and images --------------------------------------------------------------


def quantity_parse(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    rows = _part(spark, sf).select(
        "p_partkey",
        _pick(
            F.col("p_partkey") % 6,
            F.concat(size, F.lit("m")), F.concat(F.lit(" "), size, F.lit(".2505 ")),
            F.concat(F.lit("-"), size), "abc", "", F.concat(size, F.lit(".5M")),
        ).alias("cpu"),
        _pick(
            F.col("p_partkey") % 7,
            F.concat(size, F.lit("Mi")), F.concat(size, F.lit(".5GiB")), F.concat(size, F.lit(" k")),
            size, F.concat(F.lit("-"), size, F.lit("m")), "mi", "x",
        ).alias("memory"),
    )
    return rows.select(
        "p_partkey",
        Q.cpu_millicores("cpu").alias("millicores"),
        Q.cpu_error("cpu").alias("cpu_error"),
        Q.memory_bytes("memory").alias("bytes"),
        Q.memory_error("memory").alias("memory_error"),
        Q.memory_text(Q.memory_bytes("memory")).alias("shown"),
    )


def _image() -> Column:
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    return _pick(
        F.col("p_partkey") % 7,
        "alpine:3", F.concat(F.lit("Registry.Example.com/"), name, F.lit(":1")), F.concat(F.lit("library/"), name),
        F.concat(F.lit("localhost/"), name), F.concat(F.lit("/"), name), F.concat(F.lit("http://x/"), name), " ",
    )


_IMAGE = """CASE p_partkey % 7 WHEN 0 THEN 'alpine:3'
    WHEN 1 THEN 'Registry.Example.com/' || replace(p_name, ' ', '-') || ':1'
    WHEN 2 THEN 'library/' || replace(p_name, ' ', '-') WHEN 3 THEN 'localhost/' || replace(p_name, ' ', '-')
    WHEN 4 THEN '/' || replace(p_name, ' ', '-') WHEN 5 THEN 'http://x/' || replace(p_name, ' ', '-')
    ELSE ' ' END"""
_REGISTRY = """CASE p_partkey % 7 WHEN 0 THEN 'alpine:3' WHEN 1 THEN 'registry.example.com'
    WHEN 2 THEN 'docker.io' WHEN 3 THEN 'localhost' END"""
_IMAGE_ERROR = """CASE p_partkey % 7 WHEN 4 THEN 'image reference must not start with slash'
    WHEN 5 THEN 'image reference must not include scheme' WHEN 6 THEN 'empty image reference' END"""

REGISTRIES = ["docker.io", " Registry.example.com"]


def registry_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = _part(spark, sf).withColumn("image", _image())
    registry = Q.image_registry("image")
    return rows.select(
        "p_partkey",
        registry.alias("registry"),
        Q.image_error("image").alias("error"),
        P.registry_allowed(registry, REGISTRIES).alias("allowed"),
        Q.pin_digest(F.concat("image", F.lit("@old")), F.lit("sha256:new")).alias("pinned"),
    )


IMAGE_POLICY = P.Policy(allowed_registries=REGISTRIES, cpu_ceiling="20", memory_ceiling="30Mi")


def image_policy(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    rows = _part(spark, sf).select(
        "p_partkey",
        _pick(F.col("p_partkey") % 3, "secure", "permissive", "disabled").alias("profile"),
        _image().alias("image"),
        (F.col("p_size") % 4 != 0).alias("verified"),
        F.when(F.col("p_size") % 8 == 0, "bad key").otherwise("").alias("reason"),
        F.when(F.col("p_size") % 5 == 0, "").otherwise(size).alias("cpu"),
        F.concat(size, F.lit("Mi")).alias("memory"),
    )
    return P.image_verdicts(rows, IMAGE_POLICY).select(
        "p_partkey", "problem.code", "problem.detail",
        F.array_join(F.transform("findings", lambda f: f["message"]), ";").alias("findings"),
    )


# --- overrides --------------------------------------------------------------------------

OVERRIDES = P.Policy(networks=["Bridge"], capabilities=["net_raw"], rootfs_writable=True)


def _overrides(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return _part(spark, sf).select(
        "p_partkey",
        _pick(F.col("p_partkey") % 3, "secure", " Permissive", "disabled").alias("profile"),
        _pick(F.col("p_size") % 4, "", "None", "BRIDGE", "host").alias("network"),
        (F.col("p_size") % 3 == 0).alias("rootfs_writable"),
        _pick(
            F.expr("p_partkey div 3") % 4,
            none, F.array(F.lit("net_raw")), F.array(F.lit("net_raw"), F.lit("sys_admin ")), none,
        ).alias("capabilities"),
        (F.col("p_size") % 5 == 0).alias("env_inheritance"),
    )


def policy_decisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.decision_rows(P.override_verdicts(_overrides(spark, sf), OVERRIDES), ["p_partkey"])
    return rows.withColumn("pos", F.col("pos").cast("long"))


def policy_rollup(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = P.override_verdicts(_overrides(spark, sf), OVERRIDES)
    rows = P.decision_rows(verdicts.withColumn("profile", F.lower(F.trim("profile"))), ["profile"])
    return M.policy_rollup(rows)


_DECISIONS = """
WITH c AS (
  SELECT p_partkey, ['secure', 'permissive', 'disabled'][p_partkey % 3 + 1] AS profile,
         ['', 'none', 'bridge', 'host'][p_size % 4 + 1] AS net, p_size % 3 = 0 AS rootfs,
         p_partkey // 3 % 4 AS caps, p_size % 5 = 0 AS env
  FROM part
), d AS (
  SELECT p_partkey, profile, 0 AS ord, 'container.network' AS subject,
         profile = 'disabled' OR (profile = 'permissive' AND net = 'bridge') AS ok,
         'network override "' || net || CASE
            WHEN profile = 'secure' THEN '" not permitted in secure profile'
            WHEN profile = 'disabled' THEN '" allowed (profile disabled)'
            WHEN net = 'bridge' THEN '" allowed by policy' ELSE '" not allowed by policy' END AS reason
  FROM c WHERE net NOT IN ('', 'none')
  UNION ALL
  SELECT p_partkey, profile, 1, 'container.rootfs', profile <> 'secure',
         'writable rootfs ' || CASE profile WHEN 'secure' THEN 'not permitted in secure profile'
            WHEN 'disabled' THEN 'allowed (profile disabled)' ELSE 'allowed by policy' END
  FROM c WHERE rootfs
  UNION ALL
  SELECT p_partkey, profile, 2, 'container.capabilities',
         profile = 'disabled' OR (profile = 'permissive' AND caps = 1),
         CASE WHEN profile = 'secure' THEN 'adding capabilities not permitted in secure profile'
              WHEN profile = 'permissive' AND caps = 2 THEN 'capability "SYS_ADMIN" not allowed by policy'
              ELSE 'capabilities ' || CASE caps WHEN 1 THEN '[NET_RAW]' ELSE '[NET_RAW SYS_ADMIN]' END
                   || CASE profile WHEN 'disabled' THEN ' allowed (profile disabled)' ELSE ' allowed by policy' END END
  FROM c WHERE caps IN (1, 2)
  UNION ALL
  SELECT p_partkey, profile, 3, 'env.inheritance', profile = 'disabled',
         'environment inheritance ' || CASE profile WHEN 'secure' THEN 'not permitted in secure profile'
            WHEN 'permissive' THEN 'not allowed by policy' ELSE 'allowed (profile disabled)' END
  FROM c WHERE env
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY ord) - 1 AS pos,
         count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY p_partkey ORDER BY ord
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS denials
  FROM d
), decisions AS (
  SELECT p_partkey, profile, pos, subject, CASE WHEN ok THEN 'allowed' ELSE 'denied' END AS decision,
         CASE WHEN ok THEN 'policy.override.allowed' ELSE 'policy.denied' END AS code, reason
  FROM kept WHERE denials = 0
)
"""


def container_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Step settings over job settings; every fifth part has no step block."""
    size, key = F.col("p_size"), F.col("p_partkey")
    block = (
        "struct<image:string,resources:struct<cpu:string,memory:string>,network:string,"
        "rootfs_writable:boolean,capabilities:array<string>,extra_args:array<string>,entrypoint:array<string>>"
    )
    job = F.from_json(
        F.concat(
            F.lit('{"image":" base ","resources":{"cpu":"1","memory":"1Gi"},"network":"none","rootfs_writable":true,'
                  '"capabilities":["A"],"extra_args":["-x"],"tag":"'), key.cast("string"), F.lit('"}'),
        ),
        block,
    )
    step = F.from_json(
        F.concat(
            F.lit('{"image":"'), F.when(size % 2 == 0, " ").otherwise(F.col("p_brand")),
            F.lit('","network":"'), F.when(size % 3 == 0, "host").otherwise(""),
            F.lit('","capabilities":['), F.when(size % 4 == 0, '"B","C"').otherwise(""),
            F.lit("]"), F.when(size % 7 == 0, ',"resources":{"cpu":" 2 "}').otherwise(""), F.lit("}"),
        ),
        block,
    )
    rows = _part(spark, sf).select("p_partkey", job.alias("job"), F.when(key % 5 != 0, step).alias("step"))
    merged = P.overlay_container(F.col("job"), F.col("step"))
    return rows.select("p_partkey", merged.alias("m")).select(
        "p_partkey", "m.image", "m.network", "m.rootfs_writable",
        F.array_join("m.capabilities", ",").alias("capabilities"),
        F.array_join("m.extra_args", ",").alias("extra_args"),
        F.col("m.resources.cpu").alias("cpu"), F.col("m.resources.memory").alias("memory"),
    )


def effective_profiles(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    requested = _pick(key % 4, "", " Secure", "wild", "")
    environment = _pick(F.expr("p_partkey div 4") % 3, "", "PERMISSIVE", "odd")
    return _part(spark, sf).select(
        "p_partkey",
        X.effective_profile(requested, environment, F.lit("disabled")).alias("profile"),
        X.normalize_pull_policy(_pick(key % 5, "On-Add", "if_not_present", "", "never", "later")).alias("pull"),
        X.normalize_expose(_pick(key % 3, "", "ReadWrite", "all")).alias("expose"),
        X.normalize_verify_mode(_pick(key % 3, "Required", "off", "disabled")).alias("verify"),
        X.arg_env_name(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("env"),
        Q.executor_mode(
            _pick(key % 3, "", "Proc", ""), _pick(key % 3, "container:x", "", "bash")
        ).alias("executor"),
    )


# --- arguments --------------------------------------------------------------------------

_SPECS = [
    [
        {"name": "priority", "type": "string", "required": True, "enum": ["1-URGENT", "2-HIGH", "3-MEDIUM"]},
        {"name": "count", "type": "integer", "required": True},
        {"name": "note", "type": "string", "default": "none"},
    ],
    [
        {"name": "tags", "type": "array", "required": True, "items_enum": ["a", "F", "O"]},
        {"name": "flag", "type": "boolean", "default": True},
        {"name": "env", "type": "object"},
    ],
    [
        {"name": "token", "type": "string", "secret": True},
        {"name": "max-level", "type": "integer", "default": 3.9},
    ],
    [],
    [{"name": "a-b", "type": "string"}, {"name": "a_b", "type": "string"}],
    [{"name": "x", "type": "string"}, {"name": "x", "type": "integer"}],
]


def _argument_requests(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    specs = [F.from_json(F.lit(json.dumps(s)), f"array<{N.ARG}>") for s in _SPECS]
    args = _pick(
        F.col("o_custkey") % 8,
        F.concat(F.lit('{"priority":"'), "o_orderpriority", F.lit('","count":'), F.col("o_totalprice").cast("string"), F.lit("}")),
        F.concat(F.lit('{"tags":["a","'), "o_orderstatus", F.lit('"],"env":{" k ":"v='), key, F.lit('"}}')),
        F.concat(F.lit('{"token":"t'), key, F.lit('"}')),
        "{}",
        '{"count":"x","priority":"2-HIGH"}',
        '{"zzz":1,"flag":true}',
        "{not json",
        F.concat(F.lit('{"a_b":"y'), key, F.lit('","a-b":"x0","a-b":"x1"}')),
    )
    columns = ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]
    return tables.load(spark, sf, "orders").select(*columns).select(
        "o_orderkey", args.alias("args"), _pick(F.col("o_orderkey") % 6, *specs).alias("spec")
    )


def arg_errors(spark: SparkSession, sf: str) -> DataFrame:
    checked = B.with_argument_check(_argument_requests(spark, sf))
    return checked.select("o_orderkey", "arg_error.arg", "arg_error.message")


_ARGS = """a AS (
  SELECT o_orderkey, o_orderkey % 6 AS job, o_custkey % 8 AS kind, o_orderpriority AS priority,
         o_orderstatus AS status, o_totalprice AS total
  FROM orders
), e AS (
  SELECT *, CASE
    WHEN kind = 6 THEN row(NULL, 'arguments are not a JSON object')
    WHEN job = 5 THEN row(NULL, 'argument declared twice: x')
    WHEN job <> 4 AND job <> 3 AND kind = 7 THEN row(NULL, 'unknown argument: a-b')
    WHEN job = 4 THEN CASE kind WHEN 1 THEN row(NULL, 'unknown argument: env') WHEN 2 THEN row(NULL, 'unknown argument: token')
      WHEN 3 THEN NULL WHEN 5 THEN row(NULL, 'unknown argument: flag') WHEN 7 THEN NULL
      ELSE row(NULL, 'unknown argument: count') END
    WHEN job = 3 THEN CASE WHEN kind <> 3 THEN row(NULL, 'job does not accept arguments') END
    WHEN job = 0 THEN CASE kind
      WHEN 0 THEN CASE WHEN priority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
                       THEN row('priority', 'value "' || priority || '" not in enum') END
      WHEN 1 THEN row(NULL, 'unknown argument: env') WHEN 2 THEN row(NULL, 'unknown argument: token')
      WHEN 3 THEN row('priority', 'required') WHEN 4 THEN row(NULL, 'argument count must be an integer')
      ELSE row(NULL, 'unknown argument: flag') END
    WHEN job = 1 THEN CASE kind
      WHEN 1 THEN CASE WHEN status = 'P' THEN row('tags', 'item "P" not in items_enum') END
      WHEN 2 THEN row(NULL, 'unknown argument: token') WHEN 3 THEN row('tags', 'required')
      WHEN 5 THEN row(NULL, 'unknown argument: zzz') ELSE row(NULL, 'unknown argument: count') END
    ELSE CASE kind WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 1 THEN row(NULL, 'unknown argument: env')
      WHEN 5 THEN row(NULL, 'unknown argument: flag') ELSE row(NULL, 'unknown argument: count') END
    END AS err
  FROM a
)"""


def arg_bindings(spark: SparkSession, sf: str) -> DataFrame:
    bound = B.with_binding(B.with_argument_check(_argument_requests(spark, sf)))

    def pairs(name: str) -> Column:
        return F.array_join(
            F.array_sort(F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"
        )

    return bound.filter("bound IS NOT NULL").select(
        "o_orderkey", pairs("resolved").alias("resolved"), pairs("env").alias("env"),
        F.array_join("secret_values", ",").alias("secrets"),
    )


# --- step graphs ------------------------------------------------------------------------


def _graph_config(fault: int) -> str:
    steps = [
        {"id": "s1", "script": "a.sh"},
        {"id": "s2", "script": "b.sh", "needs": ["s1", " "]},
        {"id": "s3", "script": "c.sh", "needs": ["s1", " s2 "]},
    ]
    config: dict = {"composition": " Steps", "executor": "proc", "interpreter": "bash", "steps": steps}
    if fault == 1:
        config["interpreter"] = " Container:x"
    elif fault in (2, 3):
        config["executor"] = {2: " ", 3: "shell"}[fault]
    elif fault == 4:
        steps[0]["script"] = " "
    elif fault == 5:
        steps[1]["executor"] = "proc"
    elif fault == 6:
        steps[2]["id"] = " s1"
    elif fault == 7:
        steps[1]["container"] = {"network": "host"}
    elif fault in (8, 9):
        config["executor"] = "Container"
        steps[0]["container"] = {"image": "one"}
        if fault == 9:
            config["container"] = {"image": "base"}
    elif fault == 10:
        steps[1]["needs"] = ["s9"]
    elif fault == 11:
        config["composition"] = ""
    return json.dumps(config)


def _configs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as job configs with one of twelve shapes, typed from their JSON text."""
    text = _pick(F.col("p_partkey") % 12, *[_graph_config(i) for i in range(12)])
    return _part(spark, sf).select("p_partkey", F.from_json(text, CONFIG).alias("c")).select("p_partkey", "c.*")


def graph_lint(spark: SparkSession, sf: str) -> DataFrame:
    problem = G.graph_problem(
        F.col("interpreter"), F.col("executor"), F.col("composition"), F.col("container"), F.col("steps")
    )
    return _configs(spark, sf).select("p_partkey", problem.alias("p")).select("p_partkey", "p.code", "p.detail")


def step_needs_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Every line needs the line two before it in its order."""
    steps = tables.load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("step")
    )
    needs = steps.select("job", "step", (F.col("step") - 2).alias("need")).filter("need > 0").distinct()
    return G.missing_needs(needs, steps, ["job"])


# --- manifests --------------------------------------------------------------------------

API_VERSION = "addon/v1"
SCHEMA_REF = "schema"


def _manifest(fault: int) -> str:
    arg = {"name": "target", "type": "string", "format": "path"}
    job = {
        "id": "build-@KEY@", "name": "Build", "summary": "builds",
        "argspec": {"args": [arg]}, "requirements": {"tools": [{"name": "make"}]},
    }
    doc: dict = {
        "apiVersion": API_VERSION, "kind": "AddOn",
        "metadata": {"name": "@NAME@", "id": "part-@KEY@", "version": "1.2.@KEY@", "maintainers": [{"name": "x"}]},
        "requires": {"containers": [{"image": "a", "verify_signatures": "Required"}], "permissions": ["net"]},
        "jobs": [job],
    }
    if fault == 1:
        doc["apiVersion"], doc["kind"] = "v2", "Other"
        doc["extra"] = doc["also"] = 1
    elif fault == 2:
        doc["metadata"] = {"name": "ab", "id": "X", "version": "1.2", "summary": "é" * 121}
    elif fault == 3:
        del doc["metadata"], doc["requires"]
        doc["jobs"] = []
    elif fault == 4:
        doc["requires"]["containers"] = [{"image": " ", "verify_signatures": "maybe", "os": "x"}]
        doc["requires"]["permissions"] = ["ok", 5]
    elif fault == 5:
        job["id"], job["name"], job["summary"] = "B", "", "é" * 241
        del job["argspec"]
    elif fault == 6:
        arg.update({"name": "", "type": "date", "format": "url", "hint": 1})
        job["requirements"]["tools"][0]["os"] = "linux"
    elif fault == 7:
        doc["metadata"]["maintainers"] = [{"name": " "}, {"email": "e", "age": 3}]
        job["requirements"]["cpu"] = 1
    return json.dumps(doc, ensure_ascii=False)


def _manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as add-on manifests, one of eight shapes, with the part's own key and name."""
    text = _pick(F.col("p_partkey") % 8, *[_manifest(i) for i in range(8)])
    filled = F.replace(F.replace(text, F.lit("@KEY@"), F.col("p_partkey").cast("string")), F.lit("@NAME@"), F.col("p_name"))
    # checking costs far more than the rows' bytes tell, so they are spread over all cores by number
    parts = _part(spark, sf).repartition(2 * spark.sparkContext.defaultParallelism)
    documents = parts.select("p_partkey", "p_brand", filled.alias("doc"))
    return N.lint(documents, api_version=API_VERSION, schema_ref=SCHEMA_REF)


def manifest_lint(spark: SparkSession, sf: str) -> DataFrame:
    return N.lint_rows(_manifests(spark, sf), ["p_partkey"])


_MANIFEST_ERRORS = {
    1: [
        "apiVersion must be addon/v1", "kind must be AddOn",
        "manifest.also is not allowed per schema", "manifest.extra is not allowed per schema",
    ],
    2: [
        "metadata.name must be at least 3 characters per schema",
        "metadata.id must match ^[a-z0-9](?:[a-z0-9_.-]{1,62}[a-z0-9])$",
        "metadata.version must be a SemVer string (e.g., 1.2.3)",
        "metadata.summary must be <=240 characters per schema",
    ],
    3: ["metadata is required", "requires section is required", "jobs must contain at least one entry"],
    4: [
        "requires.containers[0].image is required",
        "requires.containers[0].verify_signatures must be required|permissive|disabled",
        "requires.permissions[1] must be a string per schema",
        "requires.containers[0].os is not allowed per schema",
        "requires.containers[0].image is required per schema",
        "requires.containers[0].verify_signatures must be required|permissive|disabled per schema",
    ],
    5: [
        "jobs[0].id must match ^[a-z][a-z0-9_.:-]{2,}$", "jobs[0].name is required",
        "jobs[0].summary must be <=240 characters per schema", "jobs[0].argspec is required",
    ],
    6: [
        "jobs[0].args[0].name is required", 'jobs[0].args[0].type "date" is invalid',
        'jobs[0].args[0].format "url" is invalid',
        "jobs[0].requirements.tools[0].os is not allowed per schema",
        "jobs[0].argspec.args[0].hint is not allowed per schema",
    ],
    7: [
        "metadata.maintainers[0].name is required", "metadata.maintainers[1].name is required",
        "metadata.maintainers[0].name is required per schema",
        "metadata.maintainers[1].age is not allowed per schema",
        "jobs[0].requirements.cpu is not allowed per schema",
    ],
}


def manifest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return N.summary(_manifests(spark, sf), ["p_partkey"])


def addon_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Orders ask for the add-on job of a part; brands are the image sources. Only valid manifests
    offer their job, other requests find none."""
    linted = _manifests(spark, sf)
    jobs = N.manifest_jobs(linted, ["p_brand"]).withColumnRenamed("p_brand", "source_name")
    sources = _part(spark, sf).select(
        F.col("p_brand").alias("name"),
        F.concat(F.lit("registry.example.com/"), F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("ref"),
        F.when(F.col("p_brand").endswith("1"), F.concat(F.lit("sha256:"), "p_brand")).otherwise("").alias("digest"),
        F.lit("on-run").alias("pull_policy"),
    ).distinct()
    brand = _part(spark, sf).select(F.col("p_partkey").alias("key"), "p_brand")
    requests = (
        tables.load(spark, sf, "orders")
        .withColumn("key", F.col("o_orderkey") % tables.key_space(spark, sf, "part", "p_partkey"))
        .join(brand, "key")
        .select(
            F.col("o_orderkey").alias("request"),
            F.concat("p_brand", F.lit("/build-"), F.col("key").cast("string")).alias("name"),
            F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit('{"target":"'), "o_orderstatus", F.lit('"}')))
            .otherwise('{"other":1}').alias("args"),
            _pick(F.col("o_custkey") % 3, "", "permissive", "none").alias("requested_profile"),
            (F.col("o_custkey") % 5 != 0).alias("verified"),
            F.lit("").alias("reason"),
        )
    )
    plans = PT.addon_plans(requests, jobs, sources, P.Policy())
    return plans.select(
        "request", "job_id", "stage", "detail", "verified_image",
        F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("findings"),
        F.element_at("resolved", "target").alias("target"),
        F.array_join(F.transform("tools", lambda t: F.concat(t["name"], F.lit(":"), t["status"])), ",").alias("tools"),
    )


# --- sources ----------------------------------------------------------------------------

SOURCE_RULES = A.SourceRules(
    local_roots=["/srv/jobs", "/opt/x/"], git_hosts=["Git.example.com"], profile="secure",
    policy=P.Policy(allowed_registries=["docker.io"]),
)


def source_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as requests to add a source, one of twenty shapes; suppliers exist already."""
    key, name = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("-"))
    case = key % 20
    n = key.cast("string")
    kind = _pick(
        case, "local", "local", "local", "local", "git", "git", "git", "git", "git", "oci", "oci", "oci", "oci",
        "oci", "oci", "oci", "svn", "", "local", "oci",
    )
    ref = _pick(
        case, F.concat(F.lit("a/./"), name), F.concat(F.lit("/opt/x/b/"), n), "/etc/x", "",
        "", "", F.lit("/srv/jobs/../other"), "", "",
        F.concat(F.lit("library/"), name, F.lit(":1")), "http://x/y", F.concat(F.lit("library/"), name), F.concat(F.lit("library/"), name),
        F.concat(F.lit("ghcr.io/"), name), F.concat(F.lit("library/"), name), F.concat(F.lit("library/"), name),
        "x", "x", "../up", "",
    )
    url = F.when(case == 4, F.concat(F.lit("https://git.example.com/team/"), name, F.lit(".git"))).when(
        case == 5, "https://evil.example.com/a"
    ).when(case == 7, "file:///srv/jobs/repo.git").otherwise("")
    asked_name = F.when(case == 1, F.concat(F.lit("Supplier#"), F.lpad((key % tables.key_space(spark, sf, "supplier", "s_suppkey", "2")).cast("string"), 9, "0"))).when(
        (case == 0) & (key % 40 == 20), "a/b"
    ).otherwise("")
    requests = _part(spark, sf).select(
        key.alias("seq"), kind.alias("type"), asked_name.alias("name"), ref.alias("ref"), url.alias("url"),
        (case != 11).alias("trusted"),
        F.when(case == 12, "later").when(case == 9, "If_Not_Present").otherwise("").alias("pull_policy"),
        F.when(case == 8, "x").otherwise(" Read ").alias("expose"),
        (case == 15).alias("verify_signatures"),
        (~case.isin(14, 15)).alias("verified"),
        F.when(case == 15, "no key").otherwise("").alias("reason"),
    )
    existing = tables.load(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    checked = A.with_created(A.check_sources(requests, SOURCE_RULES), existing)
    return checked.select(
        "seq", F.col("problem.code").alias("code"), F.col("problem.detail").alias("detail"),
        F.when(F.col("problem").isNull(), F.col("source_name")).alias("source_name"),
        F.when(F.col("problem").isNull(), F.col("resolved_path")).alias("resolved_path"),
        F.when(F.col("problem").isNull(), F.col("stored_pull_policy")).alias("pull_policy"), "created",
    )


# --- plan table -------------------------------------------------------------------------

PLAN_POLICY = P.Policy(allowed_registries=["docker.io"], networks=["bridge"], cpu_ceiling="500m")

_JOB_CONFIGS = [
    {"interpreter": "bash"},
    {"interpreter": "container:library/app", "env_inheritance": True},
    {"executor": "container", "container": {"image": "ghcr.io/app"}},
    {"executor": "container", "container": {"image": "library/app", "resources": {"cpu": "2"}}},
    {"executor": "container", "container": {"image": "library/app", "network": "Bridge"}},
    {
        "executor": "container", "composition": "steps", "container": {"image": "library/app"},
        "steps": [{"id": "a", "script": "x"}, {"id": "b", "script": "y", "needs": ["a"], "container": {"network": "bridge"}}],
    },
    {"executor": "proc", "composition": "steps", "steps": [{"id": "a", "script": "x", "needs": ["z"]}]},
]


def _plans(spark: SparkSession, sf: str, preview: bool) -> DataFrame:
    """Orders as plan requests for customer jobs, by id or by alias."""
    key = F.col("c_custkey")
    config = F.from_json(_pick(key % 7, *[json.dumps(c) for c in _JOB_CONFIGS]), CONFIG)
    spec = F.from_json(F.lit(json.dumps(_SPECS[2])), f"array<{N.ARG}>")
    jobs = tables.load(spark, sf, "customer").select(
        F.concat(F.lit("job."), key.cast("string")).alias("id"), key.alias("ord"),
        F.lit("local").alias("source_name"), F.col("c_mktsegment").alias("source_ref"),
        F.when(key % 2 == 0, spec).alias("spec"), config.alias("c"),
    ).select("id", "ord", "source_name", "source_ref", "spec", "c.interpreter", "c.executor", "c.container",
             "c.env_inheritance", "c.composition", "c.steps")
    declared = tables.load(spark, sf, "customer").select(
        F.lit("").alias("source"), key.alias("ord"),
        F.concat(F.lit("job/"), key.cast("string")).alias("from"),
        F.concat(F.lit("go-"), F.expr("c_custkey div 2 * 2 + if(c_custkey % 4 < 2, 0, c_custkey % 2)").cast("string")).alias("to"),
        F.lit("").alias("description"),
    )
    checked = C.check_aliases(declared, jobs.select("id", "ord"))
    order = F.col("o_orderkey")
    asked = tables.load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    requests = asked.select(
        order.alias("request"),
        F.when(order % 3 == 0, F.concat(F.lit("go-"), F.col("o_custkey").cast("string")))
        .otherwise(F.concat(F.lit("job."), F.col("o_custkey").cast("string"))).alias("name"),
        F.when(order % 5 == 0, '{"token":"t"}').otherwise("{}").alias("args"),
        _pick(order % 4, "secure", "permissive", "disabled", "").alias("requested_profile"),
        (order % 11 != 0).alias("verified"), F.lit("").alias("reason"),
    )
    plans = PT.plan_table(
        requests, jobs, checked, PLAN_POLICY, configured_profile="permissive", preview=preview
    )
    return plans.select(
        "request", "effective_id", "stage", "code", "profile", "executor", "image",
        F.array_join(F.transform("findings", lambda f: F.concat(f["code"], F.lit("|"), f["message"])), ";").alias("findings"),
        F.array_join("step_ids", ",").alias("step_ids"),
        F.element_at("resolved_args", "token").alias("token"),
        F.element_at("provenance", "canonical_path").alias("canonical_path"),
        F.element_at("provenance", "invoked_path").alias("invoked_path"),
    )


def plan_table(spark: SparkSession, sf: str) -> DataFrame:
    return _plans(spark, sf, True)


def submit_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same requests submitted: step graphs are not looked at."""
    return _plans(spark, sf, False)


def source_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that name a source: its own jobs first, then the root's; every second job is in one."""
    key = F.col("c_custkey")
    jobs = tables.load(spark, sf, "customer").select(
        F.concat(F.lit("job."), key.cast("string")).alias("id"), key.alias("ord"),
        F.when(key % 2 == 0, "").otherwise("here").alias("scope"),
        F.lit("local").alias("source_name"), F.lit("").alias("source_ref"),
        F.from_json(F.lit("[]"), f"array<{N.ARG}>").alias("spec"),
        F.from_json(F.lit(json.dumps(_JOB_CONFIGS[0])), CONFIG).alias("c"),
    ).select("id", "ord", "scope", "source_name", "source_ref", "spec", "c.interpreter", "c.executor", "c.container",
             "c.env_inheritance", "c.composition", "c.steps")
    declared = tables.load(spark, sf, "customer").select(
        F.when(key % 3 == 0, "here").otherwise("").alias("scope"), F.lit("").alias("source"), key.alias("ord"),
        F.concat(F.lit("job/"), key.cast("string")).alias("from"), F.concat(F.lit("go-"), key.cast("string")).alias("to"),
        F.lit("").alias("description"),
    )
    checked = C.check_aliases(declared, jobs.select("id", "ord", "scope"), scope="scope")
    sources = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("local_path")) for n, p in (("here", "/srv"), ("remote", ""))]))
    )
    order = F.col("o_orderkey")
    requests = tables.load(spark, sf, "orders").select(
        order.alias("request"),
        F.concat(F.when(order % 3 == 0, "go-").otherwise("job."), F.col("o_custkey").cast("string")).alias("name"),
        _pick(F.expr("o_orderkey div 4") % 4, "", "here", "remote", "lost").alias("source"),
        F.lit("{}").alias("args"), F.lit("").alias("requested_profile"),
        F.lit(True).alias("verified"), F.lit("").alias("reason"),
    )
    plans = PT.plan_table(requests, jobs, checked, PLAN_POLICY, configured_profile="permissive", sources=sources)
    return plans.select("request", "effective_id", "stage", "code", "detail")


def addon_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of add-on jobs are refused; all other requests are none of this check's."""
    jobs = N.manifest_jobs(_manifests(spark, sf), ["p_brand"]).withColumnRenamed("p_brand", "source_name")
    parts = _part(spark, sf).select(F.col("p_partkey").alias("key"), "p_brand")
    requests = (
        tables.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        .join(parts, F.col("l_partkey") == F.col("key"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("request"),
            F.concat("p_brand", F.lit("/build-"), F.col("key").cast("string")).alias("name"),
        )
    )
    return PT.addon_run_refusals(requests, jobs)


QUERIES = {
    f.__name__: f
    for f in (
        quantity_parse, registry_check, image_policy, policy_decisions, policy_rollup, container_overlay,
        effective_profiles, arg_errors, arg_bindings, graph_lint, step_needs_missing, manifest_lint,
        manifest_summary, addon_plans, addon_refusals, source_admission, plan_table, submit_table, source_plans,
    )
}


def _values(rows) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_PLAN_SQL = """
WITH alias AS (
  SELECT key, count(*) AS n, min_by(c_custkey, c_custkey) AS target FROM (
    SELECT c_custkey, c_custkey // 2 * 2 + CASE WHEN c_custkey % 4 < 2 THEN 0 ELSE c_custkey % 2 END AS key FROM customer
  ) GROUP BY key
), asked AS (
  SELECT o_orderkey AS request, o_custkey, o_orderkey % 3 = 0 AS by_alias, o_orderkey % 5 = 0 AS token,
         CASE o_orderkey % 4 WHEN 0 THEN 'secure' WHEN 2 THEN 'disabled' ELSE 'permissive' END AS profile,
         o_orderkey % 11 <> 0 AS verified
  FROM orders
), found AS (
  SELECT a.*, CASE WHEN by_alias THEN CASE WHEN al.n = 1 THEN al.target END ELSE c.c_custkey END AS job,
         CASE WHEN by_alias AND al.n > 1 THEN 'alias.collision'
              WHEN by_alias AND al.n IS NULL THEN 'job.not_found'
              WHEN NOT by_alias AND c.c_custkey IS NULL THEN 'job.not_found' END AS lost
  FROM asked a LEFT JOIN alias al ON by_alias AND al.key = o_custkey
  LEFT JOIN customer c ON NOT by_alias AND c.c_custkey = o_custkey
), judged AS (
  SELECT *, job % 7 AS cfg, CASE
    WHEN lost IS NOT NULL THEN row('resolve', lost)
    WHEN job % 7 = 6 THEN row('graph', 'E_CONFIG')
    WHEN token AND job % 2 = 1 THEN row('arguments', '')
    WHEN job % 7 = 2 THEN row('image', 'image.registry.not.allowed')
    WHEN job % 7 IN (1, 3, 4) AND profile = 'secure' AND NOT verified THEN row('image', 'image.signature.required')
    WHEN job % 7 = 3 THEN row('image', 'E_IMAGE_POLICY')
    WHEN job % 7 = 1 AND profile <> 'disabled' THEN row('override', 'policy.denied')
    WHEN job % 7 = 4 AND profile = 'secure' THEN row('override', 'policy.denied')
    WHEN job % 7 = 5 AND profile = 'secure' AND NOT verified THEN row('step', 'image.signature.required')
    WHEN job % 7 = 5 AND profile = 'secure' THEN row('step', 'policy.denied') END AS stop
  FROM found
), texts AS (
  SELECT *, stop IS NULL AS fine,
         CASE WHEN profile = 'permissive' AND NOT verified
              THEN 'image.signature.permissive|signature verification failed under permissive policy' END AS unsigned,
         'policy.override.allowed|network override "bridge" allowed '
           || CASE profile WHEN 'disabled' THEN '(profile disabled)' ELSE 'by policy' END AS net
  FROM judged
)
SELECT request, CASE WHEN job IS NOT NULL THEN 'job.' || job END AS effective_id,
       stop[1] AS stage, stop[2] AS code, profile,
       CASE WHEN cfg = 6 THEN 'proc' WHEN cfg IN (1, 2, 3, 4, 5) THEN 'container' ELSE 'shell' END AS executor,
       CASE WHEN cfg = 2 THEN 'ghcr.io/app' WHEN cfg IN (1, 3, 4, 5) THEN 'library/app' END AS image,
       CASE WHEN fine THEN CASE cfg
         WHEN 0 THEN ''
         WHEN 1 THEN concat_ws(';', unsigned, 'policy.override.allowed|environment inheritance allowed (profile disabled)')
         WHEN 4 THEN concat_ws(';', unsigned, net)
         WHEN 5 THEN concat_ws(';', replace(unsigned, '|', '|step 0: '), replace(unsigned, '|', '|step 1: '),
                               replace(net, '|', '|step 1: ')) END END AS findings,
       CASE WHEN fine AND cfg = 5 THEN 'a,b' END AS step_ids,
       CASE WHEN fine AND job % 2 = 0 THEN '[secret]' END AS token,
       CASE WHEN fine THEN 'job/' || job END AS canonical_path,
       CASE WHEN fine AND by_alias THEN 'go-' || o_custkey END AS invoked_path
FROM texts
"""

_SUBMIT_SQL = _PLAN_SQL
for _preview, _submitted in (
    ("    WHEN job % 7 = 6 THEN row('graph', 'E_CONFIG')\n", ""),
    ("WHEN job % 7 IN (1, 3, 4) AND", "WHEN job % 7 IN (1, 3, 4, 5) AND"),
    (
        "\n    WHEN job % 7 = 5 AND profile = 'secure' AND NOT verified THEN row('step', 'image.signature.required')"
        "\n    WHEN job % 7 = 5 AND profile = 'secure' THEN row('step', 'policy.denied') END",
        " END",
    ),
    ("         WHEN 0 THEN ''\n", "         WHEN 0 THEN '' WHEN 6 THEN ''\n"),
    (
        "concat_ws(';', replace(unsigned, '|', '|step 0: '), replace(unsigned, '|', '|step 1: '),\n"
        "                               replace(net, '|', '|step 1: '))",
        "concat_ws(';', unsigned)",
    ),
    ("CASE WHEN fine AND cfg = 5 THEN 'a,b' END", "CAST(NULL AS VARCHAR)"),
):
    assert _preview in _SUBMIT_SQL
    _SUBMIT_SQL = _SUBMIT_SQL.replace(_preview, _submitted)

SQL = {
    "submit_table": _SUBMIT_SQL,
    "source_plans": """
        WITH r AS (
          SELECT o_orderkey AS request, ['', 'here', 'remote', 'lost'][o_orderkey // 4 % 4 + 1] AS source,
                 CASE WHEN o_orderkey % 3 = 0 THEN 'go-' ELSE 'job.' END || o_custkey AS name,
                 o_orderkey % 3 = 0 AS by_alias, c_custkey AS key,
                 c_custkey % 2 = 1 AS job_here, c_custkey % 3 = 0 AS alias_here
          FROM orders LEFT JOIN customer ON c_custkey = o_custkey
        ), v AS (
          SELECT *, key IS NOT NULL AND CASE
              -- an alias finds jobs of its own scope only
              WHEN by_alias THEN job_here = alias_here AND (source = 'here' OR NOT alias_here)
              ELSE source = 'here' OR NOT job_here END AS found,
            by_alias AND key IS NOT NULL AND job_here <> alias_here AND (source = 'here' OR NOT alias_here) AS bad
          FROM r
        )
        SELECT request, CASE WHEN source IN ('', 'here') AND found THEN 'job.' || key END AS effective_id,
               CASE WHEN source IN ('remote', 'lost') THEN 'source' WHEN NOT found THEN 'resolve' END AS stage,
               CASE WHEN source = 'remote' THEN 'source_not_materialized' WHEN source = 'lost' THEN 'source_not_found'
                    WHEN bad THEN 'alias.invalid' WHEN NOT found THEN 'job.not_found' END AS code,
               CASE WHEN source IN ('remote', 'lost') THEN name
                    WHEN bad THEN 'alias "' || name || '" target "job/' || key || '" not found'
                    WHEN NOT found THEN name END AS detail
        FROM v""",
    "addon_refusals": """
        SELECT l_orderkey || '-' || l_linenumber AS request, 'E_OCI_RUN_UNSUPPORTED' AS code,
               'OCI add-on job ' || p_brand || '/build-' || p_partkey || ' from source ' || p_brand
               || ' cannot be executed in this phase.' AS detail
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 8 = 0""",
    "quantity_parse": """
        SELECT p_partkey,
               CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN CAST(round(CAST(p_size || '.2505' AS DOUBLE) * 1000) AS BIGINT) END AS millicores,
               CASE p_partkey % 6 WHEN 2 THEN 'cpu value must be positive' WHEN 3 THEN 'parse cores "abc"'
                    WHEN 4 THEN 'empty cpu value' WHEN 5 THEN 'parse millicores "' || p_size || '.5M"' END AS cpu_error,
               b AS bytes,
               CASE p_partkey % 7 WHEN 4 THEN 'memory value must be positive' WHEN 5 THEN 'invalid memory value "mi"'
                    WHEN 6 THEN 'parse memory "x"' END AS memory_error,
               CASE WHEN b % 1048576 = 0 THEN b // 1048576 || 'Mi' ELSE b || ' bytes' END AS shown
        FROM (SELECT *, CASE p_partkey % 7 WHEN 0 THEN p_size * 1048576 WHEN 1 THEN CAST(p_size * 1073741824 AS BIGINT) + 536870912
                             WHEN 2 THEN p_size * 1024 WHEN 3 THEN p_size END AS b
              FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part))""",
    "registry_check": f"""
        SELECT p_partkey, {_REGISTRY} AS registry, {_IMAGE_ERROR} AS error,
               {_REGISTRY} IN ('docker.io', 'registry.example.com') AS allowed,
               trim({_IMAGE}) || '@sha256:new' AS pinned
        FROM part""",
    "image_policy": f"""
        WITH r AS (
          SELECT p_partkey, p_size, {_REGISTRY} AS registry, {_IMAGE_ERROR} AS err,
                 ['required', 'permissive', 'disabled'][p_partkey % 3 + 1] AS mode, p_size % 4 <> 0 AS verified,
                 CASE WHEN p_size % 8 = 0 THEN 'bad key' END AS reason
          FROM part
        ), v AS (
          SELECT *, CASE
            WHEN err IS NOT NULL THEN row('E_IMAGE_POLICY', err)
            WHEN registry NOT IN ('docker.io', 'registry.example.com')
              THEN row('image.registry.not.allowed', 'registry ' || registry || ' not allowed')
            WHEN mode = 'required' AND NOT verified
              THEN row('image.signature.required', coalesce(reason, 'signature verification failed'))
            WHEN p_size % 5 <> 0 AND p_size > 20
              THEN row('E_IMAGE_POLICY', 'requested cpu ' || p_size || '000m exceeds ceiling 20000m')
            WHEN p_size > 30
              THEN row('E_IMAGE_POLICY', 'requested memory ' || p_size || 'Mi exceeds ceiling 30Mi') END AS p
          FROM r
        )
        SELECT p_partkey, p[1] AS code, p[2] AS detail,
               CASE WHEN mode = 'permissive' AND NOT verified
                    THEN coalesce(reason, 'signature verification failed under permissive policy') ELSE '' END AS findings
        FROM v""",
    "policy_decisions": _DECISIONS + "SELECT p_partkey, pos, subject, decision, code, reason FROM decisions",
    "policy_rollup": _DECISIONS + "SELECT profile, subject, decision, code, count(*) AS count FROM decisions GROUP BY ALL",
    "container_overlay": """
        SELECT p_partkey,
               CASE WHEN s AND p_size % 2 = 1 THEN p_brand ELSE 'base' END AS image,
               CASE WHEN s AND p_size % 3 = 0 THEN 'host' ELSE 'none' END AS network,
               NOT s AS rootfs_writable,
               CASE WHEN s AND p_size % 4 = 0 THEN 'B,C' ELSE 'A' END AS capabilities,
               '-x' AS extra_args,
               CASE WHEN s AND p_size % 7 = 0 THEN '2' ELSE '1' END AS cpu,
               CASE WHEN s AND p_size % 7 = 0 THEN '' ELSE '1Gi' END AS memory
        FROM (SELECT *, p_partkey % 5 <> 0 AS s FROM part)""",
    "effective_profiles": """
        SELECT p_partkey,
               CASE p_partkey % 4 WHEN 1 THEN 'secure' WHEN 2 THEN NULL
                 ELSE CASE p_partkey // 4 % 3 WHEN 0 THEN 'disabled' WHEN 1 THEN 'permissive' END END AS profile,
               ['always', 'ifNotPresent', 'always', 'never', NULL][p_partkey % 5 + 1] AS pull,
               ['read', 'readwrite', NULL][p_partkey % 3 + 1] AS expose,
               ['required', NULL, 'disabled'][p_partkey % 3 + 1] AS verify,
               'ARG_' || upper(replace(p_name, ' ', '_')) AS env,
               ['container', 'proc', 'shell'][p_partkey % 3 + 1] AS executor
        FROM part""",
    "arg_errors": f"WITH {_ARGS} SELECT o_orderkey, err[1] AS arg, err[2] AS message FROM e",
    "arg_bindings": f"""
        WITH {_ARGS}
        SELECT o_orderkey,
               CASE job WHEN 0 THEN 'count=' || CAST(floor(total) AS BIGINT) || ';note=none;priority=' || priority
                        WHEN 1 THEN 'env={{"k":"v=' || o_orderkey || '"}};flag=true;tags=["a","' || status || '"]'
                        WHEN 4 THEN CASE kind WHEN 7 THEN 'a-b=x1;a_b=y' || o_orderkey ELSE 'a-b=;a_b=' END
                        ELSE 'max-level=3;token=[secret]' END AS resolved,
               CASE job WHEN 0 THEN 'ARG_COUNT=' || CAST(floor(total) AS BIGINT) || ';ARG_NOTE=none;ARG_PRIORITY=' || priority
                        WHEN 4 THEN 'ARG_A_B=' || CASE kind WHEN 7 THEN 'y' || o_orderkey ELSE '' END
                        WHEN 1 THEN 'ARG_FLAG=true' ELSE 'ARG_MAX_LEVEL=3' END AS env,
               CASE WHEN job = 2 AND kind = 2 THEN 't' || o_orderkey ELSE '' END AS secrets
        FROM e WHERE err IS NULL AND job <> 3""",
    "graph_lint": f"""
        SELECT p_partkey, code, detail FROM part LEFT JOIN (VALUES {_values([
            (1, "E_CONFIG", "interpreter container form is not allowed in DAG composition"),
            (2, "E_CONFIG", "executor is required for DAG jobs"),
            (3, "E_CONFIG", "executor must be proc or container for DAG jobs"),
            (4, "E_CONFIG", "steps[0]: script is required"),
            (5, "E_POLICY", "steps[1]: step-level executor is not permitted; set executor on job"),
            (6, "E_CONFIG", "steps[2]: duplicate step id"),
            (7, "E_CONFIG", "steps[1]: container settings are not allowed when executor is proc"),
            (8, "E_CONFIG", "steps[1]: container image must be specified at job or step level"),
            (10, "E_CONFIG", "steps[1]: needs references unknown step: s9"),
        ])}) AS f(fault, code, detail) ON fault = p_partkey % 12""",
    "step_needs_missing": """
        SELECT DISTINCT l_orderkey AS job, l_linenumber AS step, l_linenumber - 2 AS need
        FROM lineitem l
        WHERE l_linenumber > 2 AND NOT EXISTS (
          SELECT 1 FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_linenumber = l.l_linenumber - 2)""",
    "manifest_lint": f"""
        SELECT p_partkey, pos, error FROM part JOIN (VALUES {_values([
            (fault, pos, error) for fault, errors in _MANIFEST_ERRORS.items() for pos, error in enumerate(errors)
        ])}) AS f(fault, pos, error) ON fault = p_partkey % 8""",
    "manifest_summary": """
        SELECT p_partkey,
               CASE p_partkey % 8 WHEN 2 THEN 'X' WHEN 3 THEN NULL ELSE 'part-' || p_partkey END AS id,
               CASE p_partkey % 8 WHEN 2 THEN 'ab' WHEN 3 THEN NULL ELSE p_name END AS name,
               CASE p_partkey % 8 WHEN 2 THEN '1.2' WHEN 3 THEN NULL ELSE '1.2.' || p_partkey END AS version,
               CASE WHEN p_partkey % 8 = 3 THEN 0 ELSE 1 END AS jobs
        FROM part""",
    "addon_plans": """
        WITH r AS (
          SELECT o_orderkey AS request, p_brand, p_brand || '/build-' || p_partkey AS job_id, o_custkey, o_orderstatus,
                 CASE o_custkey % 3 WHEN 0 THEN 'secure' WHEN 1 THEN 'permissive' END AS profile,
                 o_custkey % 2 = 0 AS good_args, o_custkey % 5 <> 0 AS verified,
                 'registry.example.com/' || replace(p_brand, '#', '-') AS ref, suffix(p_brand, '1') AS pinned
                           , p_partkey % 8 = 0 AS offered
          FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT max(p_partkey) + 1 FROM part)
        )
        SELECT request, job_id,
               CASE WHEN NOT offered THEN 'resolve' WHEN profile IS NULL THEN 'profile' WHEN NOT good_args THEN 'arguments'
                    WHEN profile = 'secure' AND NOT verified THEN 'image' END AS stage,
               CASE WHEN NOT offered THEN job_id WHEN profile IS NULL THEN 'invalid security profile' WHEN NOT good_args THEN 'unknown argument: other'
                    WHEN profile = 'secure' AND NOT verified THEN 'signature verification failed' END AS detail,
               CASE WHEN offered THEN CASE WHEN pinned THEN ref || '@sha256:' || p_brand ELSE ref END END AS verified_image,
               CASE WHEN offered THEN concat_ws(',', CASE WHEN profile = 'permissive' AND NOT verified THEN 'image.signature.permissive' END,
                         CASE WHEN NOT pinned THEN 'oci.digest.missing' END) END AS findings,
               CASE WHEN offered AND good_args THEN o_orderstatus END AS target,
               CASE WHEN offered THEN 'make:unknown' END AS tools
        FROM r""",
    "source_admission": """
        WITH r AS (
          SELECT p_partkey AS seq, p_partkey % 20 AS c, replace(p_name, ' ', '-') AS n, p_partkey % 40 = 20 AS slash FROM part
        ), v AS (
          SELECT *, CASE
            WHEN slash THEN row('invalid_name', 'name must not contain path separators')
            WHEN c IN (2, 18) THEN row('source.not.allowed', 'local path outside allow-list')
            WHEN c = 3 THEN row('ref_required', 'ref is required for local sources')
            WHEN c = 5 THEN row('source.not.allowed', 'git host evil.example.com not allowed')
            WHEN c = 6 THEN row('source.not.allowed', 'git path outside allow-list')
            WHEN c = 8 THEN row('url_required', 'url is required for git sources')
            WHEN c = 10 THEN row('invalid_image', 'image reference must not include scheme')
            WHEN c = 11 THEN row('source.trust.required', 'oci sources require trusted=true')
            WHEN c = 12 THEN row('invalid_pull_policy', 'invalid pull policy "later"')
            WHEN c = 13 THEN row('image.registry.not.allowed', 'registry ghcr.io not allowed')
            WHEN c = 14 THEN row('image.signature.required', 'signature verification failed')
            WHEN c = 15 THEN row('source-signature-invalid', 'no key')
            WHEN c = 16 THEN row('unsupported_type', 'svn')
            WHEN c = 17 THEN row('type_required', 'type is required')
            WHEN c = 19 THEN row('ref_required', 'ref is required for oci sources') END AS p,
            CASE c WHEN 0 THEN n WHEN 1 THEN 'Supplier#' || lpad(CAST(seq % (SELECT CAST(max(s_suppkey) * 2 AS BIGINT) + 1 FROM supplier) AS VARCHAR), 9, '0')
                   WHEN 4 THEN n WHEN 7 THEN 'repo' WHEN 9 THEN n END AS name
          FROM r
        ), firsts AS (SELECT name, min(seq) AS seq FROM v WHERE p IS NULL GROUP BY name)
        SELECT v.seq, p[1] AS code, p[2] AS detail, CASE WHEN p IS NULL THEN v.name END AS source_name,
               CASE WHEN p IS NULL THEN CASE c WHEN 0 THEN '/srv/jobs/a/' || n WHEN 1 THEN '/opt/x/b/' || v.seq END END AS resolved_path,
               CASE WHEN p IS NULL AND c = 9 THEN 'ifNotPresent' END AS pull_policy,
               p IS NULL AND f.seq IS NOT NULL AND s_name IS NULL AS created
        FROM v LEFT JOIN firsts f ON f.name = v.name AND f.seq = v.seq LEFT JOIN supplier ON s_name = v.name""",
    "plan_table": _PLAN_SQL,
}
