"""Security policy over tables of job configs: overrides, images, ceilings, allow-lists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import quantities as Q
from runlens.functions.text import VERIFY_MODES, bind, compute_once, non_blank, quoted, trim_ws

# Decision and finding codes.
DENIED = "policy.denied"
ALLOWED = "policy.override.allowed"
IMAGE_POLICY = "E_IMAGE_POLICY"
POLICY_ERROR = "E_POLICY"
REGISTRY_DENIED = "image.registry.not.allowed"
SIGNATURE_REQUIRED = "image.signature.required"
SIGNATURE_WARNING = "image.signature.permissive"
DEFAULT_MODES = {"secure": "required", "permissive": "permissive", "disabled": "disabled"}

DECISION = "struct<subject:string,decision:string,code:string,reason:string>"
FINDING = "struct<code:string,level:string,message:string>"
PROBLEM = "struct<code:string,detail:string>"


@dataclass(frozen=True)
class Policy:
    """One policy bundle. Empty lists and ``None`` mean the bundle does not say."""

    verify_signatures: str | None = None
    allowed_registries: list[str] = field(default_factory=list)
    cpu_ceiling: str | None = None
    memory_ceiling: str | None = None
    networks: list[str] = field(default_factory=list)
    capabilities: list[str] = field(default_factory=list)
    rootfs_writable: bool = False
    env_inheritance: bool = False


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _problem(code: str, detail: Column | str) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(code).alias("code"), text.alias("detail"))


def registry_allowed(registry: Column, allowed: list[str]) -> Column:
    """Case-insensitive registry list; an empty list allows everything."""
    if not allowed:
        return F.lit(True)
    return F.lower(trim_ws(registry)).isin(*[a.strip().lower() for a in allowed])


def namespace_allowed(namespace: Column, allowed: list[str]) -> Column:
    return F.lower(namespace).isin(*[a.lower() for a in allowed]) if allowed else F.lit(False)


def verify_mode(profile: Column, policy: Policy) -> Column:
    """Signature mode: the bundle's word, else the profile's default; null when invalid."""
    if policy.verify_signatures is not None:
        mode = policy.verify_signatures.lower()
        return F.lit(mode if mode in VERIFY_MODES else None).cast("string")
    mode = F.lit(None).cast("string")
    for name, default in DEFAULT_MODES.items():
        mode = F.when(F.lower(profile) == name, default).otherwise(mode)
    return mode


def registry_problem(image: Column, policy: Policy) -> Column:
    """Registry refusal from :func:`image_facts`."""
    if not policy.allowed_registries:
        return F.lit(None).cast(PROBLEM)
    return F.when(image["error"].isNotNull(), _problem(IMAGE_POLICY, image["error"])).when(
        ~registry_allowed(image["registry"], policy.allowed_registries),
        _problem(REGISTRY_DENIED, _text("registry ", image["registry"], " not allowed")),
    )


def signature_problem(mode: Column, verified: Column, reason: Column) -> Column:
    """Denial for an unverified image when signatures are required."""
    detail = F.coalesce(F.nullif(reason, F.lit("")), F.lit("signature verification failed"))
    return F.when(
        (mode == "required") & ~F.coalesce(verified, F.lit(False)),
        _problem(SIGNATURE_REQUIRED, detail),
    )


def signature_findings(mode: Column, verified: Column, reason: Column) -> Column:
    """Warning for an unverified image under the permissive mode."""
    text = F.coalesce(
        F.nullif(reason, F.lit("")), F.lit("signature verification failed under permissive policy")
    )
    warning = F.struct(
        F.lit(SIGNATURE_WARNING).alias("code"), F.lit("warning").alias("level"), text.alias("message")
    )
    unverified = (mode == "permissive") & ~F.coalesce(verified, F.lit(False))
    return F.when(unverified, F.array(warning)).otherwise(F.array().cast(f"array<{FINDING}>"))


def ceiling_problem(asked: Column, policy: Policy) -> Column:
    """Ceiling refusal from :func:`quantity_facts`: cpu before memory; blank requests pass."""
    rules = [F.lit(None).cast(PROBLEM)]
    if policy.cpu_ceiling and policy.cpu_ceiling.strip():
        limit = Q.cpu_millicores(F.lit(policy.cpu_ceiling))
        over = _text(
            "requested cpu ", asked["cpu"].cast("string"), "m exceeds ceiling ", limit.cast("string"), "m"
        )
        rules.append(
            F.when(~asked["cpu_asked"], None)
            .when(asked["cpu"].isNull(), _problem(IMAGE_POLICY, asked["cpu_error"]))
            .when(asked["cpu"] > limit, _problem(IMAGE_POLICY, over))
        )
    if policy.memory_ceiling and policy.memory_ceiling.strip():
        limit = Q.memory_bytes(F.lit(policy.memory_ceiling))
        over = _text(
            "requested memory ", Q.memory_text(asked["memory"]), " exceeds ceiling ", Q.memory_text(limit)
        )
        rules.append(
            F.when(~asked["memory_asked"], None)
            .when(asked["memory"].isNull(), _problem(IMAGE_POLICY, asked["memory_error"]))
            .when(asked["memory"] > limit, _problem(IMAGE_POLICY, over))
        )
    return F.coalesce(*rules)


def override_settings(
    profile: Column,
    *,
    network: Column,
    rootfs_writable: Column,
    capabilities: Column,
    env_inheritance: Column,
) -> Column:
    """Normalised settings the override rules look at."""
    return F.struct(
        F.lower(trim_ws(profile)).alias("profile"),
        F.lower(trim_ws(F.coalesce(network, F.lit("")))).alias("network"),
        F.coalesce(rootfs_writable, F.lit(False)).alias("rootfs"),
        F.transform(
            F.coalesce(capabilities, F.array().cast("array<string>")), lambda c: F.upper(trim_ws(c))
        ).alias("caps"),
        F.coalesce(env_inheritance, F.lit(False)).alias("env"),
    )


def override_decisions(settings: Column, policy: Policy) -> Column:
    """ARRAY of decisions in subject order, ending with the first denial."""
    return bind(bind(settings, lambda s: all_decisions(s, policy)), until_denied)


def with_override_decisions(df: DataFrame, policy: Policy, settings: Column) -> DataFrame:
    """Add ``decisions``, each stage computed once."""
    staged = compute_once(df, {"__settings": settings})
    staged = compute_once(staged, {"__all": all_decisions(F.col("__settings"), policy)})
    return compute_once(staged, {"decisions": until_denied(F.col("__all"))}).drop("__settings", "__all")


def all_decisions(settings: Column, policy: Policy) -> Column:
    prof, net, caps = settings["profile"], settings["network"], settings["caps"]

    def decide(subject: str, asked: Column, secure: Column, refused: Column, listed: Column, fine: Column, off: Column) -> Column:
        def row(decision: str, code: str, reason: Column) -> Column:
            return F.struct(
                F.lit(subject).alias("subject"), F.lit(decision).alias("decision"),
                F.lit(code).alias("code"), reason.alias("reason"),
            )

        return F.when(
            asked,
            F.when(prof == "secure", row("denied", DENIED, secure))
            .when((prof == "permissive") & ~listed, row("denied", DENIED, refused))
            .when(prof == "permissive", row("allowed", ALLOWED, fine))
            .when(prof == "disabled", row("allowed", ALLOWED, off)),
        )

    net_text = quoted(net)
    allowed_caps = sorted({c.strip().upper() for c in policy.capabilities})
    unlisted = F.filter(caps, lambda c: ~c.isin(*allowed_caps)) if allowed_caps else caps
    cap_list = _text("[", F.array_join(caps, " "), "]")
    cap_refusal = (
        _text("capability ", quoted(F.get(unlisted, F.lit(0))), " not allowed by policy")
        if allowed_caps
        else F.lit("policy does not allow adding capabilities")
    )
    steps = F.array(
        decide(
            "container.network",
            ~net.isin("", "none"),
            _text("network override ", net_text, " not permitted in secure profile"),
            _text("network override ", net_text, " not allowed by policy"),
            net.isin(*[n.lower() for n in policy.networks]) if policy.networks else F.lit(False),
            _text("network override ", net_text, " allowed by policy"),
            _text("network override ", net_text, " allowed (profile disabled)"),
        ),
        decide(
            "container.rootfs",
            settings["rootfs"],
            F.lit("writable rootfs not permitted in secure profile"),
            F.lit("writable rootfs not allowed by policy"),
            F.lit(bool(policy.rootfs_writable)),
            F.lit("writable rootfs allowed by policy"),
            F.lit("writable rootfs allowed (profile disabled)"),
        ),
        decide(
            "container.capabilities",
            F.size(caps) > 0,
            F.lit("adding capabilities not permitted in secure profile"),
            cap_refusal,
            (F.size(unlisted) == 0) if allowed_caps else F.lit(False),
            _text("capabilities ", cap_list, " allowed by policy"),
            _text("capabilities ", cap_list, " allowed (profile disabled)"),
        ),
        decide(
            "env.inheritance",
            settings["env"],
            F.lit("environment inheritance not permitted in secure profile"),
            F.lit("environment inheritance not allowed by policy"),
            F.lit(bool(policy.env_inheritance)),
            F.lit("environment inheritance allowed by policy"),
            F.lit("environment inheritance allowed (profile disabled)"),
        ),
    )
    return F.array_compact(steps)


def until_denied(decisions: Column) -> Column:
    denied = F.array_position(F.transform(decisions, lambda d: d["decision"]), F.lit("denied"))
    return F.when(denied > 0, F.slice(decisions, F.lit(1), denied.cast("int"))).otherwise(decisions)


def decision_problem(decisions: Column) -> Column:
    """The denial at the end of a decision list, if any."""
    last = F.try_element_at(decisions, F.lit(-1))
    return F.when(last["decision"] == "denied", _problem(DENIED, last["reason"]))


def decision_findings(profile: Column, decisions: Column) -> Column:
    """Findings of the allowed decisions; a warning when the profile is disabled."""
    level = F.when(F.lower(trim_ws(profile)) == "disabled", "warning").otherwise("info")
    return F.transform(
        F.filter(decisions, lambda d: d["decision"] == "allowed"),
        lambda d: F.struct(
            F.lit(ALLOWED).alias("code"), level.alias("level"), d["reason"].alias("message")
        ),
    )


def overlay_container(job: Column, step: Column) -> Column:
    """Container settings of a step laid over its job's.

    Non-blank step text wins, lists and resources are replaced as a whole, and
    ``rootfs_writable`` always comes from a step block when there is one.
    """

    def text(name: str) -> Column:
        return F.coalesce(non_blank(step[name]), trim_ws(job[name]), F.lit("")).alias(name)

    def items(name: str) -> Column:
        empty = F.array().cast("array<string>")
        return F.when(F.coalesce(F.size(step[name]), F.lit(0)) > 0, step[name]).otherwise(
            F.coalesce(job[name], empty)
        ).alias(name)

    def cleaned(resources: Column) -> Column:
        return F.when(
            resources.isNotNull(),
            F.struct(
                F.coalesce(trim_ws(resources["cpu"]), F.lit("")).alias("cpu"),
                F.coalesce(trim_ws(resources["memory"]), F.lit("")).alias("memory"),
            ),
        )

    rootfs = F.when(step.isNotNull(), F.coalesce(step["rootfs_writable"], F.lit(False))).otherwise(
        F.coalesce(job["rootfs_writable"], F.lit(False))
    )
    return F.struct(
        text("image"),
        F.coalesce(cleaned(step["resources"]), cleaned(job["resources"])).alias("resources"),
        text("network"),
        rootfs.alias("rootfs_writable"),
        items("capabilities"),
        items("extra_args"),
        items("entrypoint"),
    )


def image_verdicts(rows: DataFrame, policy: Policy) -> DataFrame:
    """Image policy for ``(profile, image, verified, reason, cpu, memory)`` rows.

    Registry, then signature, then cpu, then memory; the first refusal is the problem.
    """
    staged = compute_once(
        rows,
        {
            "mode": verify_mode(F.col("profile"), policy),
            "__image": Q.image_facts(F.col("image")),
            "__asked": Q.quantity_facts(F.col("cpu"), F.col("memory")),
        },
    )
    mode, verified, reason = F.col("mode"), F.col("verified"), F.col("reason")
    problem = F.coalesce(
        registry_problem(F.col("__image"), policy),
        F.when(mode.isNull(), _problem(POLICY_ERROR, "invalid verify mode")),
        signature_problem(mode, verified, reason),
        ceiling_problem(F.col("__asked"), policy),
    )
    return (
        staged.withColumn("problem", problem)
        .withColumn("findings", signature_findings(mode, verified, reason))
        .drop("__image", "__asked")
    )


def override_verdicts(rows: DataFrame, policy: Policy) -> DataFrame:
    """Decisions for ``(profile, network, rootfs_writable, capabilities, env_inheritance)``."""
    settings = override_settings(
        F.col("profile"),
        network=F.col("network"),
        rootfs_writable=F.col("rootfs_writable"),
        capabilities=F.col("capabilities"),
        env_inheritance=F.col("env_inheritance"),
    )
    decided = with_override_decisions(rows, policy, settings)
    return decided.withColumn("problem", decision_problem(F.col("decisions"))).withColumn(
        "findings", decision_findings(F.col("profile"), F.col("decisions"))
    )


def decision_rows(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per decision, in order."""
    return verdicts.select(
        *keys, F.posexplode("decisions").alias("pos", "d")
    ).select(*keys, "pos", "d.*")


