"""Cursors, routes, labels, names, paths and enum spellings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = " \t\n\r\x0b\x0c\x85\xa0"

# Accepted spellings and what they are stored as.
PULL_POLICIES = {
    "": "always",
    "on-add": "always",
    "always": "always",
    "on-run": "ifNotPresent",
    "ifnotpresent": "ifNotPresent",
    "if-not-present": "ifNotPresent",
    "if_not_present": "ifNotPresent",
    "never": "never",
}
EXPOSE_VALUES = {"": "read", "none": "none", "read": "read", "readwrite": "readwrite"}
PROFILES = ("secure", "permissive", "disabled")
VERIFY_MODES = ("required", "permissive", "disabled")
PLAIN_ROUTES = ("/metrics", "/healthz", "/health/storage", "/plans", "/runs", "/jobs", "/sources", "/events")


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row however often they are used.

    A plain ``withColumn`` may be copied into every later expression and pushed-down filter that
    mentions it. Here the projection computes the columns and a one-row generator hands them
    on, which later expressions are not pushed through.
    """
    held = df.withColumns({f"__once_{name}": column for name, column in columns.items()})
    row = F.struct(*[F.col(f"__once_{name}").alias(name) for name in columns])
    return held.select(*df.columns, F.inline(F.array(row)))


def trim_ws(value: str | Column) -> Column:
    return F.btrim(as_col(value), F.lit(_SPACE))


def is_blank(value: str | Column) -> Column:
    return F.coalesce(trim_ws(value), F.lit("")) == ""


def non_blank(value: str | Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    trimmed = trim_ws(value)
    return F.when(trimmed != "", trimmed)


def quoted(value: str | Column) -> Column:
    """Text in double quotes with backslash escapes, as used in messages and labels."""
    text = F.replace(F.replace(as_col(value), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    text = F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.concat(F.lit('"'), text, F.lit('"'))


def whole_match(value: str | Column, pattern: str) -> Column:
    """Whether a text matches a pattern written ``^...$``, a final line break not being passed over."""
    return as_col(value).rlike(pattern.removesuffix("$") + r"\z")


def parse_cursor(value: str | Column) -> Column:
    """Cursor text to LONG: empty is 0, anything that is no integer is null."""
    text = F.coalesce(trim_ws(value), F.lit(""))
    return F.when(text == "", F.lit(0).cast("long")).when(
        whole_match(text, "^[+-]?[0-9]+$"), text.try_cast("bigint")
    )


def route_template(path: str | Column) -> Column:
    """Collapse request paths to their route; unknown paths stay as they are."""
    p = as_col(path)
    run = (
        F.when(p.endswith(":cancel"), "/runs/{id}:cancel")
        .when(p.endswith("/events.ndjson"), "/runs/{id}/events.ndjson")
        .when(p.endswith("/events"), "/runs/{id}/events")
        .otherwise("/runs/{id}")
    )
    return (
        F.when(p == "", "/")
        .when(p.isin(*PLAIN_ROUTES), p)
        .when(p.startswith("/runs/"), run)
        .when(p.startswith("/sources/"), "/sources/{name}")
        .otherwise(p)
    )


def normalize_label(value: str | Column, blank: str | None = None) -> Column:
    label = trim_ws(F.lower(as_col(value)))
    if blank is None:
        return label
    return F.coalesce(F.when(label != "", label), F.lit(blank))


def alias_target_path(source: str | Column) -> Column:
    """Alias target text to a slash path; each replacement is a single pass, in order."""
    text = trim_ws(source)
    for old, new in (("\\", "/"), (":", "/"), ("..", "."), (" ", ""), ("//", "/")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.btrim(text, F.lit("/"))


def path_to_id(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("."))


def job_id_from_path(root: str | Column, config_path: str | Column) -> Column:
    """Dotted job id of a ``<dir>/config.d/config.yaml`` path relative to ``root``."""
    root_col = F.rtrim(as_col(root) if isinstance(root, Column) else F.lit(root), F.lit("/"))
    job_dir = F.regexp_replace(as_col(config_path), r"/config\.d/[^/]*$", "")
    relative = F.btrim(F.substr(job_dir, F.length(root_col) + 1), F.lit("/"))
    return F.when(relative == "", ".").otherwise(path_to_id(relative))


def _lookup(value: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*pairs), value)


def normalize_pull_policy(value: str | Column) -> Column:
    """Stored pull policy; null when the spelling is unknown."""
    return _lookup(F.lower(trim_ws(F.coalesce(as_col(value), F.lit("")))), PULL_POLICIES)


def normalize_expose(value: str | Column) -> Column:
    return _lookup(F.lower(trim_ws(F.coalesce(as_col(value), F.lit("")))), EXPOSE_VALUES)


def normalize_profile(value: str | Column) -> Column:
    text = F.lower(trim_ws(value))
    return F.when(text.isin(*PROFILES), text)


def normalize_verify_mode(value: str | Column) -> Column:
    text = F.lower(as_col(value))
    return F.when(text.isin(*VERIFY_MODES), text)


def effective_profile(requested: Column, environment: Column, configured: Column) -> Column:
    """First non-empty of the three, else ``secure``; null when that one is invalid."""
    first = F.coalesce(
        *[F.when(c != "", c) for c in (requested, environment, configured)], F.lit("secure")
    )
    return normalize_profile(first)


def local_source_name(ref: str | Column) -> Column:
    stripped = F.regexp_replace(as_col(ref), "/$", "")
    base = F.regexp_extract(F.rtrim(stripped, F.lit("/")), "([^/]*)$", 1)
    named = F.replace(base, F.lit(" "), F.lit("-"))
    return F.when(base.isin("", "."), "local").otherwise(named)


def git_source_name(url: str | Column) -> Column:
    u = as_col(url)
    path = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    last = F.regexp_replace(F.regexp_replace(path, "/$", ""), "^.*/", "")
    name = F.regexp_replace(last, r"\.git$", "")
    host = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/:?#]*)", 1)
    fallback = F.concat(F.lit("git-"), F.replace(host, F.lit("."), F.lit("-")))
    return F.when(name == "", fallback).otherwise(name)


def image_source_name(ref: str | Column) -> Column:
    text = F.regexp_replace(trim_ws(ref), "@.*$", "")
    last = F.regexp_extract(text, "/([^/]+)$", 1)
    segment = F.when(last != "", last).otherwise(text)
    untagged = F.btrim(F.regexp_replace(segment, "(.):[^:]*$", "$1"), F.lit("/"))
    squeezed = F.regexp_replace(
        F.regexp_replace(F.lower(untagged), "[^a-z0-9_.-]", "-"), "-+", "-"
    )
    name = F.btrim(squeezed, F.lit("-_."))
    return F.when(name == "", "oci").otherwise(name)


def url_host(url: str | Column) -> Column:
    """Host with port, lower-cased; empty when there is no scheme."""
    return F.lower(
        F.regexp_extract(as_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/?#]*)", 1)
    )


def clean_path(path: str | Column) -> Column:
    """Lexical path cleaning: ``//``, ``.`` and ``..`` are resolved."""
    p = as_col(path)
    rooted = p.startswith("/")

    def step(kept: Column, part: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        climb = (
            F.when((F.size(kept) > 0) & (last != ".."), F.slice(kept, 1, F.size(kept) - 1))
            .when(rooted, kept)
            .otherwise(F.array_append(kept, part))
        )
        return (
            F.when(part.isin("", "."), kept)
            .when(part == "..", climb)
            .otherwise(F.array_append(kept, part))
        )

    empty = F.array().cast("array<string>")
    parts = F.aggregate(F.split(p, "/"), empty, step)

    def joined(kept: Column) -> Column:
        body = F.array_join(kept, "/")
        return F.when(rooted, F.concat(F.lit("/"), body)).when(F.size(kept) == 0, ".").otherwise(body)

    return bind(parts, joined)


def is_sub_path(path: str | Column, root: str | Column) -> Column:
    def inside(both: Column) -> Column:
        p, r = both["p"], both["r"]
        below = F.when(r == "/", p.startswith("/")).otherwise(p.startswith(F.concat(r, F.lit("/"))))
        return (p == r) | below

    return bind(F.struct(clean_path(path).alias("p"), clean_path(root).alias("r")), inside)


def host_allowed(host: Column, allow: list[str]) -> Column:
    """Case-insensitive host list; an empty list allows nothing."""
    if not allow:
        return F.lit(False)
    return F.lower(host).isin(*[h.lower() for h in allow])


def arg_env_name(name: str | Column) -> Column:
    return F.concat(F.lit("ARG_"), F.upper(F.replace(as_col(name), F.lit("-"), F.lit("_"))))


def namespaced_job_id(source: str | Column, job: str | Column) -> Column:
    return F.concat_ws("/", non_blank(source), non_blank(job))


def rfc3339_ms(ts: str | Column) -> Column:
    """UTC timestamp text in whole milliseconds with trailing zeros dropped."""
    text = F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z"))


def float_text(value: str | Column) -> Column:
    """Shortest decimal text; exponent form below 1e-4 and from 1e6 up (``1e+06``)."""
    v = as_col(value).cast("double")

    def parts(text: Column) -> Column:
        mantissa = F.substring_index(text, "E", 1)
        shift = F.when(text.contains("E"), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
        whole = F.substring_index(mantissa, ".", 1)
        fraction = F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise("")
        lead = F.length(fraction) - F.length(F.ltrim(fraction, F.lit("0")))
        return F.struct(
            F.rtrim(F.ltrim(F.concat(whole, fraction), F.lit("0")), F.lit("0")).alias("digits"),
            (shift + F.when(whole != "0", F.length(whole) - 1).otherwise(-lead - 1)).alias("exp"),
        )

    def render(p: Column) -> Column:
        digits, exponent = p["digits"], p["exp"]
        power = F.abs(exponent).cast("string")
        scientific = F.concat(
            F.substring(digits, 1, 1),
            F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""),
            F.when(exponent < 0, "e-").otherwise("e+"),
            F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power),
        )
        whole = F.rpad(F.substr(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))
        rest = F.substr(digits, exponent + 2)
        big = F.when(rest != "", F.concat(whole, F.lit("."), rest)).otherwise(whole)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        plain = F.when(exponent < 0, small).otherwise(big)
        return F.when((exponent < -4) | (exponent >= 6), scientific).otherwise(plain)

    body = bind(bind(F.abs(v).cast("string"), parts), render)
    sign = F.when(v < 0, "-").otherwise("")
    return F.when(v == 0, "0").otherwise(F.concat(sign, body))
