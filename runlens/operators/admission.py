"""Source admission: verdict and stored form per request to add a source."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import quantities as Q
from runlens.functions import text as X
from runlens.operators import policy as P

NOT_ALLOWED = "source.not.allowed"
TRUST_REQUIRED = "source.trust.required"
SIGNATURE_INVALID = "source-signature-invalid"


@dataclass(frozen=True)
class SourceRules:
    """Where sources may come from, and the profile and policy images are held against."""

    local_roots: list[str] = field(default_factory=list)
    git_hosts: list[str] = field(default_factory=list)
    profile: str = "secure"
    policy: P.Policy = field(default_factory=P.Policy)


def _refuse(code: str, detail: str | Column) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(code).alias("code"), text.alias("detail"))


def _below(path: Column, root: str) -> Column:
    """Whether an already cleaned path is ``root`` or lies inside it."""
    base = posixpath.normpath(root)
    inside = path.startswith("/") if base == "/" else path.startswith(base + "/")
    return inside | (path == base)


def check_sources(requests: DataFrame, rules: SourceRules) -> DataFrame:
    """Verdict per ``(seq, type, name, ref, url, trusted, pull_policy, expose,
    verify_signatures, verified, reason)`` request; the first failed check is the problem.

    ``verified`` and ``reason`` are the outcome of the signature check done elsewhere.
    """
    text = lambda c: F.coalesce(X.trim_ws(c), F.lit(""))
    kind, given = F.col("type"), F.coalesce(F.col("name"), F.lit(""))
    staged = X.compute_once(
        requests,
        {
            "__repo": F.when(text("url") != "", text("url")).otherwise(text("ref")),
            "__image": F.when(text("ref") != "", text("ref")).otherwise(text("url")),
            "__clean": X.clean_path("ref"),
            "__expose": X.normalize_expose("expose"),
            "__pull": X.normalize_pull_policy("pull_policy"),
            "__mode": P.verify_mode(F.lit(rules.profile), rules.policy),
        },
    )
    clean, repo, image = F.col("__clean"), F.col("__repo"), F.col("__image")

    # relative local paths are taken below each allowed root in turn
    roots = [r for r in rules.local_roots if r]
    staged = X.compute_once(
        staged,
        {
            f"__full{i}": F.when(clean.startswith("/"), clean).otherwise(
                X.clean_path(F.concat(F.lit(root.rstrip("/") + "/"), clean))
            )
            for i, root in enumerate(roots)
        }
        | {
            "__scheme": F.lower(F.regexp_extract(repo, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
            "__disk": X.clean_path(F.regexp_replace(repo, "^(?i:file)://", "")),
            "__host": X.url_host(repo),
            "__image_facts": Q.image_facts(image),
        },
    )
    inside, resolved = F.lit(False), F.lit(None).cast("string")
    for i, root in reversed(list(enumerate(roots))):
        full = F.col(f"__full{i}")
        inside = inside | _below(full, root)
        resolved = F.when(_below(full, root), full).otherwise(resolved)
    disk_inside = F.lit(False)
    for root in roots:
        disk_inside = disk_inside | _below(F.col("__disk"), root)

    bad_expose = F.when(
        F.col("__expose").isNull(), _refuse("invalid_expose", F.concat(F.lit("invalid expose value "), X.quoted("expose")))
    )
    local = F.coalesce(
        F.when(F.coalesce(F.col("ref"), F.lit("")) == "", _refuse("ref_required", "ref is required for local sources")),
        F.when(~inside, _refuse(NOT_ALLOWED, "local path outside allow-list")),
        bad_expose,
    )
    on_disk, host = F.col("__scheme").isin("file", ""), F.col("__host")
    git = F.coalesce(
        F.when(repo == "", _refuse("url_required", "url is required for git sources")),
        F.when(on_disk & ~disk_inside, _refuse(NOT_ALLOWED, "git path outside allow-list")),
        F.when(
            ~on_disk & ~X.host_allowed(host, rules.git_hosts),
            _refuse(NOT_ALLOWED, F.concat(F.lit("git host "), host, F.lit(" not allowed"))),
        ),
        bad_expose,
    )
    mode, verified = F.col("__mode"), F.coalesce(F.col("verified"), F.lit(False))
    passes = verified | (mode == "disabled")
    reason = F.coalesce(F.nullif("reason", F.lit("")), F.lit("signature verification failed"))
    wants = F.coalesce(F.col("verify_signatures"), F.lit(False))
    oci = F.coalesce(
        F.when(image == "", _refuse("ref_required", "ref is required for oci sources")),
        F.when(image.contains("://"), _refuse("invalid_image", "image reference must not include scheme")),
        F.when(~F.coalesce(F.col("trusted"), F.lit(False)), _refuse(TRUST_REQUIRED, "oci sources require trusted=true")),
        F.when(
            F.col("__pull").isNull(),
            _refuse("invalid_pull_policy", F.concat(F.lit("invalid pull policy "), X.quoted("pull_policy"))),
        ),
        bad_expose,
        P.registry_problem(F.col("__image_facts"), rules.policy),
        F.when(mode.isNull(), _refuse(P.POLICY_ERROR, "invalid verify mode")),
        F.when(
            wants & (mode == "disabled"),
            _refuse(SIGNATURE_INVALID, "signature verification is disabled for the current profile"),
        ),
        F.when(wants & ~passes, _refuse(SIGNATURE_INVALID, reason)),
        F.when(~wants, P.signature_problem(mode, verified, F.col("reason"))),
    )
    problem = (
        F.when(F.coalesce(kind, F.lit("")) == "", _refuse("type_required", "type is required"))
        .when(given.rlike(r"[/\\]"), _refuse("invalid_name", "name must not contain path separators"))
        .when(kind == "local", local)
        .when(kind == "git", git)
        .when(kind == "oci", oci)
        .otherwise(_refuse("unsupported_type", kind))
    )
    derived = (
        F.when(kind == "local", X.local_source_name(clean))
        .when(kind == "git", X.git_source_name(repo))
        .otherwise(X.image_source_name(image))
    )
    return (
        X.compute_once(staged, {"problem": problem})
        .withColumns(
            {
                "source_name": F.when(given != "", given).otherwise(derived),
                "resolved_path": F.when(kind == "local", resolved),
                "stored_expose": F.col("__expose"),
                "stored_pull_policy": F.when(kind == "oci", F.col("__pull")),
            }
        )
        .select(*requests.columns, "problem", "source_name", "resolved_path", "stored_expose", "stored_pull_policy")
    )


def with_created(checked: DataFrame, existing: DataFrame, order: str = "seq") -> DataFrame:
    """Add ``created``: the first accepted request of a name no source had before."""
    first = (
        checked.groupBy("source_name")
        .agg(F.min(F.when(F.col("problem").isNull(), F.col(order))).alias(order))
        .filter(F.col(order).isNotNull())
        .join(existing.select(F.col("name").alias("source_name")), "source_name", "left_anti")
        .withColumn("__new", F.lit(True))
    )
    return checked.join(first, ["source_name", order], "left").withColumn(
        "created", F.coalesce("__new", F.lit(False)) & F.col("problem").isNull()
    ).drop("__new")
