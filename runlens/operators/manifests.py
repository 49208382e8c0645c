"""Add-on manifests: lint over a table of documents, summaries, argument lists.

A manifest is one row, so every rule is an expression on that row; errors are exploded to one
row each at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import bind, compute_once, is_blank, quoted, trim_ws, whole_match
from runlens.operators.binding import _as, _kind

# Patterns, sets, limits and allowed keys of a manifest.
ID_PATTERN = r"^[a-z0-9](?:[a-z0-9_.-]{1,62}[a-z0-9])$"
JOB_ID_PATTERN = r"^[a-z][a-z0-9_.:-]{2,}$"
SEMVER_PATTERN = r"^\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$"
ARG_TYPES = ("string", "integer", "number", "boolean", "array", "object")
ARG_FORMATS = ("", "path", "file", "directory", "secret")
VERIFY_MODES = ("required", "permissive", "disabled")
SUMMARY_LIMIT = 240
NAME_MINIMUM = 3
ALLOWED_KEYS = {
    "manifest": ("apiVersion", "kind", "metadata", "requires", "jobs"),
    "metadata": (
        "name", "id", "version", "summary", "description", "homepage", "maintainers", "license",
    ),
    "maintainer": ("name", "email", "url"),
    "requires": ("permissions", "containers"),
    "container": ("image", "platform", "verify_signatures"),
    "job": ("id", "name", "summary", "description", "argspec", "extends", "requirements"),
    "requirements": ("tools",),
    "tool": ("name", "version"),
    "argspec": ("args",),
    "arg": (
        "name", "title", "description", "type", "format", "secret", "required", "default", "enum",
        "minLength", "maxLength", "minimum", "maximum", "multipleOf", "items_type", "items_enum",
        "minItems", "maxItems", "value_type", "deprecated",
    ),
}

ARG = (
    "struct<name:string,type:string,format:string,secret:boolean,required:boolean,"
    "default:variant,description:string,enum:array<string>,items_type:string,"
    "items_enum:array<string>,value_type:string>"
)
MANIFEST = (
    "struct<apiVersion:string,kind:string,"
    "metadata:struct<name:string,id:string,version:string,summary:string,"
    "maintainers:array<struct<name:string,email:string,url:string>>>,"
    "requires:struct<containers:array<struct<image:string,verify_signatures:string>>>,"
    "jobs:array<struct<id:string,name:string,summary:string,"
    f"argspec:struct<args:array<{ARG}>>,"
    "requirements:struct<tools:array<struct<name:string,version:string>>>>>>"
)

_MESSAGES = "array<string>"


def _msg(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _none() -> Column:
    return F.array().cast(_MESSAGES)


def _rules(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def _each(items: Column, check: Callable[[Column, Column], Column]) -> Column:
    """Messages of every item, in order; nothing for a missing list."""
    return F.coalesce(F.flatten(F.transform(items, check)), _none())


def _at(name: str | Column, i: Column) -> Column:
    return _msg(name, "[", i.cast("string"), "]")


def _typed_errors(m: Column, api_version: str, kind: str, ref: str) -> Column:
    meta, needs, jobs = m["metadata"], m["requires"], m["jobs"]
    name = trim_ws(F.coalesce(meta["name"], F.lit("")))

    def missing(text: Column) -> Column:
        return is_blank(text)

    def maintainer(p: Column, i: Column) -> Column:
        return _rules(F.when(missing(p["name"]), _msg(_at("metadata.maintainers", i), ".name is required")))

    def container(c: Column, i: Column) -> Column:
        at = _at("requires.containers", i)
        mode = F.lower(trim_ws(c["verify_signatures"]))
        return _rules(
            F.when(missing(c["image"]), _msg(at, ".image is required")),
            F.when(
                mode.isNotNull() & ~mode.isin("", *VERIFY_MODES),
                _msg(at, ".verify_signatures must be required|permissive|disabled"),
            ),
        )

    def argument(prefix: Column):
        def check(a: Column, j: Column) -> Column:
            at = _at(_msg(prefix, ".args"), j)
            kind_text = F.coalesce(a["type"], F.lit(""))
            form = F.coalesce(a["format"], F.lit(""))
            return _rules(
                F.when(missing(a["name"]), _msg(at, ".name is required")),
                F.when(~kind_text.isin(*ARG_TYPES), _msg(at, ".type ", quoted(kind_text), " is invalid")),
                F.when(~form.isin(*ARG_FORMATS), _msg(at, ".format ", quoted(form), " is invalid")),
            )

        return check

    def job(j: Column, i: Column) -> Column:
        at = _at("jobs", i)
        own = _rules(
            F.when(
                ~F.coalesce(whole_match(j["id"], JOB_ID_PATTERN), F.lit(False)),
                _msg(at, f".id must match {JOB_ID_PATTERN}"),
            ),
            F.when(missing(j["name"]), _msg(at, ".name is required")),
            F.when(missing(j["summary"]), _msg(at, ".summary is required")).when(
                F.length(j["summary"]) > SUMMARY_LIMIT,
                _msg(at, f".summary must be <={SUMMARY_LIMIT} characters per {ref}"),
            ),
            F.when(j["argspec"].isNull(), _msg(at, ".argspec is required")),
        )
        return F.concat(own, _each(j["argspec"]["args"], argument(at)))

    head = _rules(
        F.when(F.coalesce(m["apiVersion"], F.lit("")) != api_version, F.lit(f"apiVersion must be {api_version}")),
        F.when(F.coalesce(m["kind"], F.lit("")) != kind, F.lit(f"kind must be {kind}")),
        F.when(meta.isNull(), F.lit("metadata is required")),
    )
    about = _rules(
        F.when(name == "", F.lit("metadata.name is required")).when(
            F.length(name) < NAME_MINIMUM,
            F.lit(f"metadata.name must be at least {NAME_MINIMUM} characters per {ref}"),
        ),
        F.when(
            ~F.coalesce(whole_match(meta["id"], ID_PATTERN), F.lit(False)),
            F.lit(f"metadata.id must match {ID_PATTERN}"),
        ),
        F.when(
            ~F.coalesce(whole_match(meta["version"], SEMVER_PATTERN), F.lit(False)),
            F.lit("metadata.version must be a SemVer string (e.g., 1.2.3)"),
        ),
        F.when(
            F.octet_length(meta["summary"]) > SUMMARY_LIMIT,
            F.lit(f"metadata.summary must be <={SUMMARY_LIMIT} characters per {ref}"),
        ),
    )
    return F.concat(
        head,
        F.when(meta.isNotNull(), F.concat(about, _each(meta["maintainers"], maintainer))).otherwise(_none()),
        F.when(needs.isNull(), F.array(F.lit("requires section is required"))).otherwise(
            _each(needs["containers"], container)
        ),
        F.when(
            F.coalesce(F.size(jobs), F.lit(0)) <= 0,
            F.array(F.lit("jobs must contain at least one entry")),
        ).otherwise(_each(jobs, job)),
    )


def _schema_errors(raw: Column, ref: str, runner_key: str | None) -> Column:
    """Shape and allowed-key checks on the untyped document; keys are reported in order."""

    def unknown(fields: Column, level: str, path: str | Column) -> Column:
        allowed = list(ALLOWED_KEYS[level])
        if level == "requires" and runner_key:
            allowed.append(runner_key)
        odd = F.array_sort(F.array_except(F.map_keys(fields), F.array(*[F.lit(k) for k in allowed])))
        return F.transform(odd, lambda k: _msg(path, ".", k, f" is not allowed per {ref}"))

    def read(value: Column, kind: str, label: Column, check) -> Column:
        """Check a value that must be an object (its fields) or an array (its items)."""
        form, article = {
            "object": ("map<string,variant>", "an object"), "array": ("array<variant>", "an array"),
        }[kind]
        return bind(
            _as(value, form),
            lambda content: F.when(
                content.isNull(), F.array(_msg(label, f" must be {article} per {ref}"))
            ).otherwise(check(content, label)),
        )

    def part(fields: Column, key: str, kind: str, path: str | Column, check) -> Column:
        """Check the value under ``key`` when the key is there."""
        label = _msg(path, f".{key}") if isinstance(path, Column) else F.lit(key)
        return F.when(
            F.map_contains_key(fields, F.lit(key)),
            read(F.element_at(fields, key), kind, label, check),
        ).otherwise(_none())

    def members(check):
        """Check array items that must be objects."""
        return lambda items, label: _each(
            items, lambda v, i: read(v, "object", _at(label, i), check)
        )

    def blank_text(fields: Column, key: str, at: Column) -> Column:
        text = _as(F.element_at(fields, key), "string")
        return F.when(text.isNotNull() & is_blank(text), _msg(at, f".{key} is required per {ref}"))

    def maintainer(v: Column, at: Column) -> Column:
        return F.concat(unknown(v, "maintainer", at), _rules(blank_text(v, "name", at)))

    def metadata(v: Column, at: Column) -> Column:
        return F.concat(
            unknown(v, "metadata", at), part(v, "maintainers", "array", at, members(maintainer))
        )

    def permission_list(items: Column, label: Column) -> Column:
        return _each(
            items,
            lambda v, i: _rules(F.when(_kind(v) != "string", _msg(_at(label, i), f" must be a string per {ref}"))),
        )

    def container(v: Column, at: Column) -> Column:
        mode = F.element_at(v, "verify_signatures")
        text = F.lower(trim_ws(_as(mode, "string")))
        wrong = (
            F.when(_kind(mode) == "null", F.lit(None).cast("string"))
            .when(_kind(mode) != "string", _msg(at, f".verify_signatures must be a string or null per {ref}"))
            .when(
                ~text.isin(*VERIFY_MODES),
                _msg(at, f".verify_signatures must be required|permissive|disabled per {ref}"),
            )
        )
        return F.concat(unknown(v, "container", at), _rules(blank_text(v, "image", at), wrong))

    def requires(v: Column, at: Column) -> Column:
        return F.concat(
            unknown(v, "requires", at),
            part(v, "permissions", "array", at, permission_list),
            part(v, "containers", "array", at, members(container)),
        )

    def tool(v: Column, at: Column) -> Column:
        return F.concat(unknown(v, "tool", at), _rules(blank_text(v, "name", at)))

    def requirements(v: Column, at: Column) -> Column:
        return F.concat(unknown(v, "requirements", at), part(v, "tools", "array", at, members(tool)))

    def argspec(v: Column, at: Column) -> Column:
        return F.concat(
            unknown(v, "argspec", at),
            part(v, "args", "array", at, members(lambda a, p: unknown(a, "arg", p))),
        )

    def job(v: Column, at: Column) -> Column:
        return F.concat(
            unknown(v, "job", at),
            part(v, "requirements", "object", at, requirements),
            part(v, "argspec", "object", at, argspec),
        )

    return F.concat(
        unknown(raw, "manifest", "manifest"),
        part(raw, "metadata", "object", "", metadata),
        part(raw, "requires", "object", "", requires),
        part(raw, "jobs", "array", "", members(job)),
    )


def parsed(documents: DataFrame, doc: str = "doc") -> DataFrame:
    """Add the typed ``manifest`` and the untyped top-level fields ``raw`` of JSON documents."""
    return compute_once(
        documents,
        {
            "manifest": F.from_json(doc, MANIFEST),
            "raw": _as(F.try_parse_json(F.col(doc)), "map<string,variant>"),
        },
    )


def lint(
    documents: DataFrame,
    *,
    api_version: str,
    kind: str = "AddOn",
    schema_ref: str = "manifest schema",
    runner_key: str | None = None,
    doc: str = "doc",
) -> DataFrame:
    """Add ``errors ARRAY<STRING>`` to manifest documents; empty when the manifest is valid."""
    staged = parsed(documents, doc)
    errors = F.when(F.col("raw").isNotNull(), F.concat(
        _typed_errors(F.col("manifest"), api_version, kind, schema_ref),
        _schema_errors(F.col("raw"), schema_ref, runner_key),
    )).otherwise(F.array(F.lit("manifest must be an object")))
    return compute_once(staged, {"errors": errors})


def lint_rows(linted: DataFrame, keys: list[str]) -> DataFrame:
    """One row per error."""
    return linted.select(*keys, F.posexplode("errors").alias("pos", "error"))


def summary(linted: DataFrame, keys: list[str]) -> DataFrame:
    """Id, name, version and number of jobs per manifest."""
    meta = F.col("manifest.metadata")
    return linted.select(
        *keys, meta["id"].alias("id"), meta["name"].alias("name"), meta["version"].alias("version"),
        F.greatest(F.coalesce(F.size("manifest.jobs"), F.lit(0)), F.lit(0)).alias("jobs"),
    )


def manifest_jobs(linted: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs of valid manifests with their argument list; blank ids are skipped.

    Length, item and number bounds, titles and deprecation marks are not carried over.
    """
    fine = linted.filter(F.size("errors") == 0).select(*keys, F.explode("manifest.jobs").alias("j"))
    return fine.filter(~is_blank("j.id")).select(
        *keys, F.col("j.id").alias("job_id"), F.col("j.name").alias("name"), F.col("j.summary").alias("summary"),
        F.col("j.argspec.args").alias("spec"), F.col("j.requirements.tools").alias("tools"),
    )
