"""Argument validation and binding for tables of requests.

A request carries its arguments as a JSON object and the argument list of its job; both belong
to one row, so the whole check is a projection: no explode, no regrouping, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.payload import redact_args
from runlens.functions.text import arg_env_name, bind, compute_once, quoted, trim_ws

# Supported argument types.
TYPES = ("string", "boolean", "integer", "array", "object")

_NONE = "array<string>"


# VARIANT type names and the JSON kind they stand for; all others are numbers.
_KINDS = {"VOID": "null", "STRING": "string", "BOOLEAN": "boolean", "ARRAY": "array", "OBJECT": "object"}


def _kind(value: Column) -> Column:
    """JSON kind of a VARIANT: string, boolean, number, array, object or null."""
    pairs = [F.lit(x) for pair in _KINDS.items() for x in pair]
    name = F.regexp_extract(F.coalesce(F.schema_of_variant(value), F.lit("VOID")), "^[A-Z]+", 0)
    return F.coalesce(F.element_at(F.create_map(*pairs), name), F.lit("number"))


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _truthy(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def _list(values: Column) -> Column:
    return F.coalesce(values, F.array().cast(_NONE))


def _facts(arg: Column, given: Column) -> Column:
    """What a rule needs to know about one argument, worked out once.

    ``given`` is the MAP of sent arguments.
    """
    value = F.element_at(given, arg["name"])
    return F.struct(
        *[arg[n].alias(n) for n in ("name", "type", "default")],
        _truthy(arg["required"]).alias("required"),
        (_truthy(arg["secret"]) | _truthy(arg["format"] == "secret")).alias("secret"),
        _list(arg["enum"]).alias("enum"),
        _list(arg["items_enum"]).alias("items_enum"),
        F.coalesce(arg["items_type"], F.lit("")).alias("items_type"),
        F.coalesce(arg["value_type"], F.lit("")).alias("value_type"),
        F.map_contains_key(given, arg["name"]).alias("sent"),
        value.alias("value"),
        _kind(value).alias("kind"),
        _kind(arg["default"]).alias("default_kind"),
    )


def _typed(f: Column) -> Column:
    """Facts with the value read as the argument's type."""
    sent, value, default = f["sent"], f["value"], f["default"]

    def chosen(kind: str, read) -> Column:
        fallback = F.when(f["default_kind"] == kind, read(default))
        return F.when(f["type"] == _SCALARS[kind], F.when(sent, read(value)).otherwise(fallback))

    def whole(v: Column) -> Column:
        number = _as(v, "double")
        return F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("bigint")

    listed = F.transform(
        F.filter(_as(default, "array<variant>"), lambda i: _kind(i) == "string"),
        lambda i: _as(i, "string"),
    )
    text = _as(default, "string")
    fallback = F.when(f["default_kind"] == "array", listed).when(
        (f["default_kind"] == "string") & (text != ""), F.split(text, ",")
    )
    items = F.when(sent, F.nullif(_as(value, _NONE), F.array().cast(_NONE)))
    return F.struct(
        *[f[n].alias(n) for n in _FACTS],
        F.coalesce(chosen("string", lambda v: _as(v, "string")), F.lit("")).alias("text"),
        F.coalesce(chosen("boolean", lambda v: _as(v, "boolean")), F.lit(False)).alias("flag"),
        F.coalesce(chosen("number", whole), F.lit(0).cast("bigint")).alias("number"),
        F.when(f["type"] == "array", _list(F.coalesce(items, fallback))).alias("items"),
        F.when((f["type"] == "object") & sent, _pairs(value)).alias("pairs"),
    )


_SCALARS = {"string": "string", "boolean": "boolean", "number": "integer"}
_FACTS = (
    "name", "type", "required", "secret", "enum", "items_enum", "items_type", "value_type", "sent",
    "value", "kind", "default_kind",
)


def _pairs(value: Column) -> Column:
    """Key=value pairs; a key is cut at its first ``=`` and trimmed, the last of equal keys stays."""
    members = _as(value, "map<string,string>")
    pairs = F.transform(
        F.array_sort(F.map_keys(members)),
        lambda k: F.concat(k, F.lit("="), F.element_at(members, k)),
    )

    def split(p: Column) -> Column:
        return F.struct(
            trim_ws(F.substring_index(p, "=", 1)).alias("k"),
            F.regexp_replace(p, "(?s)^[^=]*=", "").alias("v"),
        )

    def last_only(cut: Column) -> Column:
        def later(i: Column) -> Column:
            return F.transform(F.slice(cut, i + 2, F.size(cut) + 1), lambda o: o["k"])

        return F.filter(cut, lambda p, i: ~F.array_contains(later(i), p["k"]))

    return bind(F.transform(pairs, split), last_only)


def _type_error(f: Column) -> Column:
    """Why a sent value does not have the type of its argument."""
    kind, name = f["kind"], f["type"]
    wrong = (
        F.when((name == "string") & (kind != "string"), " must be a string")
        .when((name == "boolean") & (kind != "boolean"), " must be a boolean")
        .when((name == "integer") & (kind != "number"), " must be an integer")
        .when((name == "array") & (kind != "array"), " must be an array of strings")
        .when(
            (name == "array")
            & _truthy(F.exists(_as(f["value"], "array<variant>"), lambda i: _kind(i) != "string")),
            " array items must be strings",
        )
        .when((name == "object") & (kind != "object"), " must be an object")
        .when(
            (name == "object")
            & _truthy(
                F.exists(
                    F.map_values(_as(f["value"], "map<string,variant>")), lambda i: _kind(i) != "string"
                )
            ),
            " values must be strings",
        )
    )
    return F.when(f["sent"], F.concat(F.lit("argument "), f["name"], wrong))


def _rule_error(f: Column) -> Column:
    """First broken rule of one argument, in checking order (null when fine)."""
    kind, required = f["type"], f["required"]
    has_default = f["default_kind"] != "null"
    odd = F.filter(f["items"], lambda i: ~F.array_contains(f["items_enum"], i))
    no_pairs = F.coalesce(F.size(f["pairs"]), F.lit(0)) <= 0
    return (
        F.when(f["secret"] & has_default, "default forbidden for secret")
        .when((kind == "string") & required & (f["text"] == ""), "required")
        .when(
            (kind == "string") & (F.size(f["enum"]) > 0) & (f["text"] != "")
            & ~F.array_contains(f["enum"], f["text"]),
            F.concat(F.lit("value "), quoted(f["text"]), F.lit(" not in enum")),
        )
        .when(kind.isin("boolean", "integer") & required & ~f["sent"] & ~has_default, "required")
        .when((kind == "array") & required & (F.size(f["items"]) == 0), "required")
        .when(
            (kind == "array") & ~f["items_type"].isin("", "string"), "items_type not supported in Phase 1"
        )
        .when(
            (kind == "array") & (F.size(f["items_enum"]) > 0) & (F.size(odd) > 0),
            F.concat(F.lit("item "), quoted(F.get(odd, F.lit(0))), F.lit(" not in items_enum")),
        )
        .when((kind == "object") & _truthy(F.exists(f["pairs"], lambda p: p["k"] == "")), "empty key")
        .when((kind == "object") & required & no_pairs, "required")
        .when(
            (kind == "object") & ~f["value_type"].isin("", "string"), "value_type not supported in Phase 1"
        )
    )


def _value_text(f: Column) -> Column:
    """Bound value as text: scalars plain, arrays and objects as JSON."""
    none = F.create_map().cast("map<string,string>")
    return (
        F.when(f["type"] == "string", f["text"])
        .when(f["type"] == "boolean", f["flag"].cast("string"))
        .when(f["type"] == "integer", f["number"].cast("string"))
        .when(f["type"] == "array", F.to_json(f["items"]))
        .otherwise(F.to_json(F.coalesce(F.map_from_entries(f["pairs"]), none)))
    )


def _given(args: str) -> Column:
    sent = F.try_variant_get(F.try_parse_json(args), "$", "map<string,variant>")
    none = F.create_map().cast("map<string,variant>")
    return F.when(F.col(args).isNull() | (F.btrim(args, F.lit(" \t\r\n")) == "null"), none).otherwise(sent)


def _argument_facts(spec: str) -> Column:
    facts = F.transform(spec, lambda a: _facts(a, F.col("__given")))
    return F.transform(facts, _typed)


def with_argument_check(requests: DataFrame, args: str = "args", spec: str = "spec") -> DataFrame:
    """Add ``arg_error STRUCT<arg, message>``, null when the arguments bind.

    Checked in this order: text that is no JSON object, unsupported types, arguments declared
    twice, unknown arguments (first by name), value types in list order, then the rules of each
    argument in list order. ``__facts`` carries what is known
    about each argument on to :func:`with_binding`.
    """
    null = F.lit(None).cast("string")

    def error(arg: Column, message: Column) -> Column:
        return F.struct(arg.alias("arg"), message.alias("message"))

    def first(found: Column) -> Column:
        return F.get(F.filter(found, lambda e: e["message"].isNotNull()), F.lit(0))

    # null where text is given that is no object
    sent = compute_once(requests, {"__given": _given(args)})
    unread = F.when(F.col("__given").isNull(), error(null, F.lit("arguments are not a JSON object")))
    staged = compute_once(
        sent, {"__names": F.array_sort(F.map_keys("__given")), "__facts": _argument_facts(spec)}
    )
    unsupported = first(
        F.transform(
            spec,
            lambda a: error(
                null,
                F.when(
                    ~F.coalesce(a["type"], F.lit("")).isin(*TYPES),
                    F.concat(F.lit("unsupported arg type: "), F.coalesce(a["type"], F.lit(""))),
                ),
            ),
        )
    )
    names = F.transform(spec, lambda a: a["name"])
    again = F.get(F.filter(names, lambda n, i: F.array_position(names, n) < i + 1), F.lit(0))
    repeated = F.when(again.isNotNull(), error(null, F.concat(F.lit("argument declared twice: "), again)))
    unknown = F.get(F.array_except("__names", F.transform(spec, lambda a: a["name"])), F.lit(0))
    unknown_error = bind(
        unknown,
        lambda n: F.when(n.isNotNull(), error(null, F.concat(F.lit("unknown argument: "), n))),
    )
    typed = first(F.transform("__facts", lambda f: error(null, _type_error(f))))
    ruled = first(F.transform("__facts", lambda f: error(f["name"], _rule_error(f))))
    # a job without an argument list takes no arguments at all
    bare = F.coalesce(F.size(spec), F.lit(0)) <= 0
    none_allowed = F.when(
        F.size("__names") > 0, error(null, F.lit("job does not accept arguments"))
    )
    checked = F.coalesce(
        unread,
        F.when(bare, none_allowed).otherwise(
            F.coalesce(unsupported, repeated, unknown_error, typed, ruled)
        ),
    )
    return compute_once(staged, {"arg_error": checked}).drop("__given", "__names")


def _last_by_name(entries: Column) -> Column:
    """Of entries with the same ``k`` the last one: two names may give one variable."""
    return bind(
        entries,
        lambda all_: F.filter(
            all_,
            lambda e, i: ~F.exists(
                F.slice(all_, i + 2, F.greatest(F.size(all_) - i - 1, F.lit(0))), lambda x: x["k"] == e["k"]
            ),
        ),
    )


def with_binding(checked: DataFrame) -> DataFrame:
    """Add bound values, environment, secret names and values to checked requests.

    ``bound`` maps names to value text (null when the arguments do not bind or the job takes
    none), ``resolved`` hides secrets, ``env`` holds the scalars that are no secrets.
    """
    fine = F.col("arg_error").isNull() & (F.coalesce(F.size("__facts"), F.lit(0)) > 0)
    rows = F.transform(
        "__facts",
        lambda f: F.struct(
            f["name"].alias("name"),
            _value_text(f).alias("value"),
            (f["secret"] & (f["type"] == "string")).alias("secret"),
            f["type"].isin("string", "boolean", "integer").alias("scalar"),
        ),
    )
    staged = compute_once(checked, {"__bound": F.when(fine, rows)})
    secrets = F.filter("__bound", lambda b: b["secret"])
    plain = F.filter("__bound", lambda b: b["scalar"] & ~b["secret"])
    return (
        staged.withColumns(
            {
                "bound": F.map_from_entries(
                    F.transform("__bound", lambda b: F.struct(b["name"], b["value"]))
                ),
                "env": F.map_from_entries(_last_by_name(
                    F.transform(
                        plain,
                        lambda b: F.struct(arg_env_name(b["name"]).alias("k"), b["value"].alias("v")),
                    )
                )),
                "secret_names": F.transform(secrets, lambda b: b["name"]),
                "secret_values": F.transform(
                    F.filter(secrets, lambda b: b["value"] != ""), lambda b: b["value"]
                ),
            }
        )
        .withColumn("resolved", redact_args("bound", "secret_names"))
        .drop("__facts", "__bound")
    )
