"""Plan table: one row per request from resolution to findings and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import quantities as Q
from runlens.functions.text import compute_once, effective_profile, trim_ws
from runlens.operators import graphs as G
from runlens.operators import policy as P
from runlens.operators.binding import with_argument_check, with_binding
from runlens.operators.catalog import provenance, resolve, resolve_from_source

_NO_FINDINGS = f"array<{P.FINDING}>"


def _stop(stage: str, code: str | Column, detail: str | Column) -> Column:
    def col(x):
        return F.lit(x) if isinstance(x, str) else x

    return F.struct(F.lit(stage).alias("stage"), col(code).alias("code"), col(detail).alias("detail"))


def _from_problem(stage: str, name: str) -> Column:
    problem = F.col(name)
    return F.when(problem.isNotNull(), _stop(stage, problem["code"], problem["detail"]))


def _at_step(i: Column, findings: Column) -> Column:
    return F.transform(
        findings,
        lambda f: F.struct(
            f["code"].alias("code"),
            f["level"].alias("level"),
            F.concat(F.lit("step "), i.cast("string"), F.lit(": "), f["message"]).alias("message"),
        ),
    )


def _job_steps(policy: P.Policy) -> Column:
    """Per step of a job: merged settings and the problems that no request can change."""
    container = F.col("container")

    def facts(s: Column) -> Column:
        merged = P.overlay_container(container, s["container"])
        return F.struct(trim_ws(s["id"]).alias("id"), trim_ws(s["name"]).alias("name"), merged.alias("merged"))

    def checked(r: Column) -> Column:
        m = r["merged"]
        return F.struct(
            r["id"].alias("id"),
            r["name"].alias("name"),
            m["image"].alias("image"),
            m["network"].alias("network"),
            m["rootfs_writable"].alias("rootfs_writable"),
            m["capabilities"].alias("capabilities"),
            P.registry_problem(Q.image_facts(m["image"]), policy).alias("registry"),
            P.ceiling_problem(Q.quantity_facts(m["resources"]["cpu"], m["resources"]["memory"]), policy).alias("ceiling"),
        )

    return F.transform(F.transform("steps", facts), checked)


def _step_rows(policy: P.Policy) -> Column:
    """Per step of a request's job: decisions for its profile, the first problem, findings."""
    run_by = F.lower(trim_ws(F.coalesce("executor", F.lit(""))))
    mode, verified, reason = F.col("mode"), F.col("verified"), F.col("reason")
    in_container = run_by == "container"

    def decide(s: Column) -> Column:
        settings = P.override_settings(
            F.col("profile"), network=s["network"], rootfs_writable=s["rootfs_writable"],
            capabilities=s["capabilities"], env_inheritance=F.lit(False),
        )
        return P.override_decisions(settings, policy)

    def row(both: Column) -> Column:
        s, d = both["step"], both["decisions"]
        problem = F.coalesce(
            F.when(
                in_container,
                F.coalesce(s["registry"], P.signature_problem(mode, verified, reason), s["ceiling"]),
            ),
            P.decision_problem(d),
        )
        signed = F.when(in_container, P.signature_findings(mode, verified, reason)).otherwise(
            F.array().cast(_NO_FINDINGS)
        )
        return F.struct(
            s["id"].alias("id"),
            s["name"].alias("name"),
            run_by.alias("executor"),
            F.when(in_container, s["image"]).alias("container_image"),
            problem.alias("problem"),
            F.concat(signed, P.decision_findings(F.col("profile"), d)).alias("findings"),
        )

    decided = F.transform("job_steps", lambda s: F.struct(s.alias("step"), decide(s).alias("decisions")))
    return F.transform(decided, row)


def _job_facts(jobs: DataFrame, by: list[str], policy: P.Policy, preview: bool) -> DataFrame:
    """The last job of each id with all that does not depend on a request, worked out once."""
    settings = [c for c in jobs.columns if c not in ("ord", "id", "name", *by)]
    newest = jobs.groupBy(*by, F.lower("id").alias("__key")).agg(
        F.max_by(F.struct(*settings), "ord").alias("job")
    )
    rows = compute_once(
        newest.select(*by, "__key", "job.*"),
        {
            "graph": G.is_step_graph(F.col("composition"), F.col("steps")),
            "image": Q.container_image(F.col("container.image"), F.coalesce("interpreter", F.lit(""))),
        },
    )
    lint = G.graph_problem(
        F.col("interpreter"), F.col("executor"), F.col("composition"), F.col("container"), F.col("steps")
    )
    asked = Q.quantity_facts(F.col("container.resources.cpu"), F.col("container.resources.memory"))
    return compute_once(
        rows,
        {
            "p_graph": lint if preview else F.lit(None).cast(P.PROBLEM),
            "p_registry": P.registry_problem(Q.image_facts(F.col("image")), policy),
            "p_ceiling": P.ceiling_problem(asked, policy),
            "job_steps": F.when(F.col("graph") & F.lit(preview), _job_steps(policy)),
        },
    ).drop("steps", "composition")


def plan_table(
    requests: DataFrame,
    jobs: DataFrame,
    checked_aliases: DataFrame,
    policy: P.Policy,
    *,
    environment_profile: str = "",
    configured_profile: str = "",
    preview: bool = True,
    sources: DataFrame | None = None,
) -> DataFrame:
    """One plan per ``(request, name, args, requested_profile, verified, reason)`` request.

    ``jobs`` carry id, ord, source_name, source_ref and the config columns (interpreter,
    executor, container, env_inheritance, composition, steps, spec). The columns ``stage``,
    ``code`` and ``detail`` tell where a request stopped; they are null for an accepted plan.
    A preview checks step graphs before arguments; a submission (``preview=False``) does not
    check them at all. Jobs are joined by id; everything after is a projection. With ``sources``
    a request may name one in ``source``; jobs and aliases then carry their ``scope``.
    """
    by = ["scope"] if sources is not None else []
    facts = _job_facts(jobs, by, policy, preview)
    if sources is None:
        found = resolve(requests, jobs, checked_aliases)
    else:
        found = resolve_from_source(requests, jobs, checked_aliases, sources)
    rows = found.withColumn("__key", F.lower("effective_id")).join(facts, [*by, "__key"], "left")
    rows = with_binding(with_argument_check(rows.drop("__key")))
    rows = compute_once(
        rows,
        {
            "profile": effective_profile(
                F.col("requested_profile"), F.lit(environment_profile), F.lit(configured_profile)
            ),
        },
    )
    graph, mode = F.col("graph"), F.col("mode")
    rows = compute_once(rows, {"mode": P.verify_mode(F.col("profile"), policy)})
    settings = P.override_settings(
        F.col("profile"), network=F.col("container.network"),
        rootfs_writable=F.col("container.rootfs_writable"),
        capabilities=F.col("container.capabilities"), env_inheritance=F.col("env_inheritance"),
    )
    rows = P.with_override_decisions(rows, policy, settings)
    rows = compute_once(rows, {"plan_steps": F.when(F.col("job_steps").isNotNull(), _step_rows(policy))})
    verified, reason = F.col("verified"), F.col("reason")
    rows = compute_once(
        rows,
        {
            "p_signature": P.signature_problem(mode, verified, reason),
            "p_override": P.decision_problem(F.col("decisions")),
            "p_step": F.get(F.filter("plan_steps", lambda s: s["problem"].isNotNull()), F.lit(0))["problem"],
        },
    )

    resolution = F.col("resolution")
    unresolved = F.coalesce(
        F.when(resolution.startswith("source_"), _stop("source", resolution, F.col("name"))),
        F.when(resolution == "not_found", _stop("resolve", "job.not_found", F.col("name"))),
        F.when(resolution == "collision", _stop("resolve", "alias.collision", F.col("name"))),
        F.when(resolution == "invalid", _stop("resolve", "alias.invalid", F.col("detail"))),
    )
    argument = F.when(
        F.col("arg_error").isNotNull(),
        _stop("arguments", F.coalesce(F.col("arg_error.arg"), F.lit("")), F.col("arg_error.message")),
    )
    profile = F.when(F.col("profile").isNull(), _stop("profile", P.POLICY_ERROR, "invalid security profile"))
    verify = F.when(mode.isNull(), _stop("image", P.POLICY_ERROR, "invalid verify mode"))
    has_image = F.col("image") != ""
    single = F.coalesce(
        F.when(
            has_image,
            F.coalesce(
                _from_problem("image", "p_registry"),
                verify,
                _from_problem("image", "p_signature"),
                _from_problem("image", "p_ceiling"),
            ),
        ),
        _from_problem("override", "p_override"),
    )
    by_step = F.coalesce(verify, _from_problem("step", "p_step"))
    stop = F.coalesce(
        unresolved, _from_problem("graph", "p_graph"), argument, profile,
        F.when(graph & F.lit(preview), by_step).otherwise(single),
    )
    rows = compute_once(rows, {"stop": stop})
    fine = F.col("stop").isNull()
    signed = F.when(
        has_image, P.signature_findings(mode, verified, reason)
    ).otherwise(F.array().cast(_NO_FINDINGS))
    findings = F.when(
        graph & F.lit(preview),
        F.flatten(F.transform("plan_steps", lambda s, i: _at_step(i, s["findings"]))),
    ).otherwise(F.concat(signed, P.decision_findings(F.col("profile"), F.col("decisions"))))
    by_alias = resolution == "alias"
    canonical = F.when(by_alias, F.col("alias_path")).otherwise(
        F.replace("effective_id", F.lit("."), F.lit("/"))
    )
    origin = provenance(
        {
            "canonical_id": F.col("effective_id"),
            "canonical_path": canonical,
            "invoked_path": F.when(by_alias, F.col("name")),
            "alias_source": F.when(by_alias, F.col("alias_source")),
            "alias_description": F.when(by_alias, F.col("alias_description")),
            "source": F.col("source_name"),
            "source_ref": F.col("source_ref"),
        }
    )
    names = F.transform("plan_steps", lambda s: s["id"])
    return rows.select(
        "request",
        "effective_id",
        F.col("stop.stage").alias("stage"),
        F.col("stop.code").alias("code"),
        F.col("stop.detail").alias("detail"),
        "profile",
        Q.executor_mode(F.coalesce("executor", F.lit("")), F.coalesce("interpreter", F.lit(""))).alias("executor"),
        F.when(has_image, F.col("image")).alias("image"),
        F.when(fine & has_image & (mode != "disabled"), mode).alias("trust_mode"),
        F.when(fine, F.col("resolved")).alias("resolved_args"),
        F.when(fine, findings).alias("findings"),
        F.when(fine & graph, names).alias("step_ids"),
        F.when(fine, origin).alias("provenance"),
    )


def addon_plans(
    requests: DataFrame, addon_jobs: DataFrame, sources: DataFrame, policy: P.Policy, *, profile: str = "secure"
) -> DataFrame:
    """Plans for add-on jobs named ``source/job``: image pinned by digest, tools unknown.

    One row per request and job of that name; stage ``resolve`` where there is none.

    ``addon_jobs(source_name, job_id, spec, tools)``; ``sources(name, ref, digest, pull_policy)``.
    """
    meta = sources.select(
        F.col("name").alias("source_name"), trim_ws("ref").alias("image"),
        trim_ws(F.coalesce("digest", F.lit(""))).alias("digest"), "pull_policy",
    )
    jobs = (
        addon_jobs.join(meta, "source_name")
        .withColumn("name", F.concat_ws("/", trim_ws("source_name"), trim_ws("job_id")))
    )
    # a request for a job that nobody offers gets its row too
    rows = with_binding(with_argument_check(requests.join(jobs, "name", "left")))
    rows = compute_once(
        rows, {"profile": effective_profile(F.col("requested_profile"), F.lit(""), F.lit(profile))}
    )
    rows = compute_once(
        rows,
        {"mode": P.verify_mode(F.col("profile"), policy), "image_facts": Q.image_facts(F.col("image"))},
    )
    mode, verified, reason = F.col("mode"), F.col("verified"), F.col("reason")
    pinned = F.when(F.col("digest") != "", Q.pin_digest("image", "digest")).otherwise(F.col("image"))
    rows = compute_once(
        rows,
        {
            "p_registry": P.registry_problem(F.col("image_facts"), policy),
            "p_signature": P.signature_problem(mode, verified, reason),
        },
    )
    missing = F.col("job_id").isNull()
    stop = F.coalesce(
        F.when(missing, _stop("resolve", "job.not_found", F.col("name"))),
        F.when(F.col("profile").isNull(), _stop("profile", P.POLICY_ERROR, "invalid security profile")),
        F.when(
            F.col("arg_error").isNotNull(),
            _stop("arguments", F.coalesce(F.col("arg_error.arg"), F.lit("")), F.col("arg_error.message")),
        ),
        F.when(F.col("image") == "", _stop("image", "ref_missing", "oci source ref missing")),
        _from_problem("image", "p_registry"),
        F.when(mode.isNull(), _stop("image", P.POLICY_ERROR, "invalid verify mode")),
        _from_problem("image", "p_signature"),
    )
    undigested = F.struct(
        F.lit("oci.digest.missing").alias("code"), F.lit("warning").alias("level"),
        F.lit("resolved digest unavailable; pull_policy=on-run").alias("message"),
    )
    on_run = F.lower(trim_ws("pull_policy")) == "on-run"
    findings = F.concat(
        P.signature_findings(mode, verified, reason),
        F.when((F.col("digest") == "") & F.coalesce(on_run, F.lit(False)), F.array(undigested)).otherwise(
            F.array().cast(_NO_FINDINGS)
        ),
    )
    return compute_once(rows, {"stop": stop}).select(
        "request", F.col("name").alias("job_id"),
        F.col("stop.stage").alias("stage"), F.col("stop.code").alias("code"), F.col("stop.detail").alias("detail"),
        "image", pinned.alias("verified_image"), F.when(~missing, findings).alias("findings"), "resolved",
        F.transform("tools", lambda t: F.struct(t["name"].alias("name"), t["version"].alias("version"), F.lit("unknown").alias("status"))).alias("tools"),
    )


def addon_run_refusals(requests: DataFrame, addon_jobs: DataFrame) -> DataFrame:
    """Runs of add-on jobs are refused."""
    jobs = addon_jobs.select(
        "source_name", F.concat_ws("/", trim_ws("source_name"), trim_ws("job_id")).alias("name")
    )
    return requests.join(jobs, "name").select(
        "request",
        F.lit("E_OCI_RUN_UNSUPPORTED").alias("code"),
        F.concat(
            F.lit("OCI add-on job "), "name", F.lit(" from source "), "source_name",
            F.lit(" cannot be executed in this phase."),
        ).alias("detail"),
    )
