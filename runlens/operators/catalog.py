"""Job catalogue: alias checks and resolution, union listing, suggestions, sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import (
    alias_target_path, clean_path, normalize_expose, path_to_id, quoted, trim_ws,
)
from runlens.operators.running import BUCKET_ROWS, numbered
from runlens.operators.runs import check_page

# Alias verdict codes.
RESERVED = "alias.reserved"
TARGET_INVALID = "alias.target.invalid"
NAME_CONFLICT = "alias.name.conflict"
MALFORMED = "alias.malformed"


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def check_aliases(
    declarations: DataFrame, jobs: DataFrame, *, scope: str | None = None
) -> DataFrame:
    """Verdict per alias declaration ``(source, ord, from, to, description)``.

    ``jobs(id, ord)`` are matched without regard to case; of equal ids the last one counts. With
    ``scope`` (a column of both sides) an alias only finds jobs of its own scope.
    Output: source, ord, name, target_path, target_id, description, code (null when fine),
    detail and error text.
    """
    by = [scope] if scope else []
    known = (
        jobs.groupBy(*by, F.lower("id").alias("__key"))
        .agg(F.max_by("id", "ord").alias("job_id"))
    )
    from_text, name = trim_ws("from"), trim_ws("to")
    path = alias_target_path("from")
    staged = (
        declarations.withColumns(
            {"__from": F.coalesce(from_text, F.lit("")), "name": F.coalesce(name, F.lit("")),
             "target_path": F.coalesce(path, F.lit(""))}
        )
        .withColumn("__key", F.lower(path_to_id(F.col("target_path"))))
        .join(known, [*by, "__key"], "left")
    )
    alias, origin = quoted("name"), quoted("__from")
    rules = [
        (
            (F.col("__from") == "") | (F.col("name") == ""),
            MALFORMED, F.lit(""), F.lit("alias entries must include from and to"),
        ),
        (F.col("target_path") == "", MALFORMED, F.lit(""), _text("invalid alias target ", origin)),
        (
            F.col("name").contains("/"),
            MALFORMED, F.lit(""), _text("alias name ", alias, " must be single-level (no '/')"),
        ),
        (
            F.col("name").startswith(":"),
            RESERVED, _text("alias name ", alias, " uses reserved prefix"),
            _text("alias name ", alias, " cannot start with ':'"),
        ),
        (
            F.col("job_id").isNull(),
            TARGET_INVALID, _text("alias ", alias, " target ", origin, " not found"),
            _text("alias target ", origin, " not found"),
        ),
        (
            F.lower("name") == F.lower("job_id"),
            NAME_CONFLICT, _text("alias name ", alias, " conflicts with job id"),
            _text("alias name ", alias, " conflicts with job id"),
        ),
    ]
    verdict = F.coalesce(
        *[
            F.when(test, F.struct(F.lit(code).alias("code"), detail.alias("detail"), error.alias("error")))
            for test, code, detail, error in rules
        ]
    )
    return staged.withColumn("__v", verdict).select(
        *by, "source", "ord", "name", "target_path", F.col("job_id").alias("target_id"), "description",
        F.col("__v.code").alias("code"), F.col("__v.detail").alias("detail"), F.col("__v.error").alias("error"),
    )


def alias_entries(checked: DataFrame, *, scope: str | None = None) -> DataFrame:
    """First declaration per name (any case) with the number of contenders."""
    by = [scope] if scope else []
    return (
        checked.filter("code IS NULL")
        .groupBy(*by, F.lower("name").alias("alias_key"))
        .agg(
            F.min_by(F.struct("name", "source", "target_path", "target_id", "description"), "ord").alias("e"),
            F.count(F.lit(1)).alias("contenders"),
        )
        .select(*by, "alias_key", "e.*", "contenders")
    )


def alias_collisions(checked: DataFrame, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every contender of a name declared more than once, numbered in declaration order.

    Contenders stay rows, so a name that everybody declares needs no huge array.
    """
    fine = checked.filter("code IS NULL").withColumn("alias_key", F.lower("name"))
    many = fine.groupBy("alias_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = fine.join(many.select("alias_key"), "alias_key", "left_semi")
    return numbered(rows, ["alias_key"], "ord", "position", bucket_rows=bucket_rows).select(
        "alias_key", "position", "name", "source", "target_path", "target_id"
    )


def alias_invalid(checked: DataFrame, *, scope: str | None = None) -> DataFrame:
    """Verdict per name of invalid aliases; the last one declared stands."""
    by = [scope] if scope else []
    coded = checked.filter(F.col("code").isin(RESERVED, TARGET_INVALID, NAME_CONFLICT))
    return (
        coded.groupBy(*by, F.lower("name").alias("alias_key"))
        .agg(F.max_by(F.struct("code", "detail"), "ord").alias("v"))
        .select(*by, "alias_key", "v.code", "v.detail")
    )


def alias_errors(checked: DataFrame, file_name: str) -> DataFrame:
    """Error rows of a check, labelled with the declaring file and source."""
    return checked.filter("error IS NOT NULL").select(
        _text(f"{file_name} (", F.col("source"), ")").alias("path"), "error"
    )


def resolve(
    requests: DataFrame,
    jobs: DataFrame,
    checked: DataFrame,
    name: str = "name",
    *,
    scope: str | None = None,
) -> DataFrame:
    """Resolve requested names: a job id wins, then invalid, collision, alias.

    Adds ``resolution``, ``effective_id``, ``alias_path`` and ``detail``. With ``scope`` (a
    column of all three inputs) names are only looked up in the scope of the request.
    """
    by = [scope] if scope else []
    known = (
        jobs.select(*by, F.lower("id").alias("__key")).distinct().withColumn("__job", F.lit(True))
    )
    aliases = (
        alias_entries(checked, scope=scope)
        .join(alias_invalid(checked, scope=scope), [*by, "alias_key"], "full")
        .select(
            *by, F.col("alias_key").alias("__key"), "contenders", "target_id", "target_path",
            F.col("source").alias("alias_source"), F.col("description").alias("alias_description"),
            F.col("code").alias("invalid_code"), F.col("detail").alias("invalid_detail"),
        )
    )
    resolution = (
        F.when(F.col("__job"), "job")
        .when(F.col("invalid_code").isNotNull(), "invalid")
        .when(F.col("contenders") > 1, "collision")
        .when(F.col("contenders") == 1, "alias")
        .otherwise("not_found")
    )
    return (
        requests.withColumn("__key", F.lower(name))
        .join(known, [*by, "__key"], "left")
        .join(aliases, [*by, "__key"], "left")
        .withColumn("resolution", resolution)
        .withColumns(
            {
                "effective_id": F.when(F.col("resolution") == "job", F.col(name)).when(
                    F.col("resolution") == "alias", F.col("target_id")
                ),
                "alias_path": F.when(F.col("resolution") == "alias", F.col("target_path")),
                "detail": F.when(F.col("resolution") == "invalid", F.col("invalid_detail")),
            }
        )
        .drop("__key", "__job", "contenders", "target_id", "target_path", "invalid_detail", "invalid_code")
    )


def resolve_from_source(
    requests: DataFrame, jobs: DataFrame, checked: DataFrame, sources: DataFrame
) -> DataFrame:
    """Resolve requests that may name a source: its own jobs and aliases first, then the root's.

    ``requests(request, name, source)``; jobs and checked aliases carry ``scope``, the name of
    their source or empty for the root. A source that is unknown, or has no local path, stops
    the request (``source_not_found``, ``source_not_materialized``).
    """
    meta = sources.select(
        F.col("name").alias("source"), (F.coalesce("local_path", F.lit("")) != "").alias("__there")
    )
    named = requests.withColumn("source", F.coalesce("source", F.lit(""))).join(meta, "source", "left")
    found = ("scope", "resolution", "effective_id", "alias_path", "detail", "alias_source", "alias_description")
    own = resolve(named.withColumn("scope", F.col("source")), jobs, checked, scope="scope")
    held = own.withColumn("__own", F.struct(*found)).drop(*found)
    root = resolve(held.withColumn("scope", F.lit("")), jobs, checked, scope="scope")
    # the root only counts where the source has nothing, so no request has to be regrouped
    keep = (F.col("__own.resolution") != "not_found") | (F.col("resolution") == "not_found")
    best = root.withColumns({c: F.when(keep, F.col(f"__own.{c}")).otherwise(F.col(c)) for c in found}).drop("__own")
    stop = F.when(F.col("source") == "", None).when(
        F.col("__there").isNull(), "source_not_found"
    ).when(~F.col("__there"), "source_not_materialized")
    return (
        best.withColumn("resolution", F.coalesce(stop, F.col("resolution")))
        .withColumn("effective_id", F.when(stop.isNull(), F.col("effective_id")))
        .drop("__there")
    )


def catalog(
    jobs: DataFrame, addon_jobs: DataFrame | None, checked: DataFrame, *, expose_aliases: bool = True
) -> DataFrame:
    """Listing of jobs ``(id, name, summary, source_name, source_type)`` and visible aliases."""
    null = F.lit(None).cast("string")

    def view(df: DataFrame) -> DataFrame:
        return df.select(
            "id", "name", F.col("summary").alias("description"), null.alias("alias_of"),
            null.alias("alias_detail"), "source_name", "source_type",
        )

    listing = view(jobs)
    if addon_jobs is not None:
        listing = listing.unionByName(view(addon_jobs))
    if not expose_aliases:
        return listing
    collides = F.col("contenders") > 1
    label = _text("[alias] ", F.col("target_path"))
    aliases = alias_entries(checked).select(
        F.col("name").alias("id"),
        "name",
        F.when(collides, F.concat(label, F.lit(" (collision)")))
        .when(F.col("description") != "", F.col("description"))
        .otherwise(label).alias("description"),
        F.col("target_path").alias("alias_of"),
        F.when(collides, "collision").otherwise(F.col("target_path")).alias("alias_detail"),
        F.when(F.col("source") != "", F.col("source")).alias("source_name"),
        F.when(F.col("source") != "", "alias").alias("source_type"),
    )
    return listing.unionByName(aliases)


def catalog_page(listing: DataFrame, page: int = 1, per_page: int = 50, max_per_page: int = 200) -> DataFrame:
    check_page(page, per_page, max_per_page)
    ordered = listing.orderBy("id", F.coalesce("source_name", F.lit("")), "name")
    return ordered.offset((page - 1) * per_page).limit(per_page)


def discovery_error_count(errors: DataFrame, checked: DataFrame) -> DataFrame:
    """File errors, alias errors and colliding names, added up."""
    alias_errors_only = checked.filter("error IS NOT NULL").select(F.lit(1).alias("n"))
    groups = alias_entries(checked).filter("contenders > 1").select(F.lit(1).alias("n"))
    every = errors.select(F.lit(1).alias("n")).unionByName(alias_errors_only).unionByName(groups)
    return every.agg(F.count("n").alias("discovery_errors"))


def scan_roots(default_root: str, sources: DataFrame) -> DataFrame:
    """Distinct scan roots: the default one, then sources by name; the first per path stays."""
    own = sources.sparkSession.createDataFrame([(default_root, None)], "root string, source_name string")
    listed = sources.filter(F.coalesce(F.col("local_path"), F.lit("")) != "").select(
        F.col("local_path").alias("root"), F.col("name").alias("source_name")
    )
    every = own.unionByName(listed).withColumn("path", clean_path("root"))
    rank = F.coalesce(F.concat(F.lit("1"), F.col("source_name")), F.lit("0"))
    return every.groupBy("path").agg(F.min_by(F.struct("root", "source_name"), rank).alias("r")).select(
        "path", "r.root", "r.source_name"
    )


def with_source(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs with the name and type of their source; root jobs carry none."""
    meta = sources.select(F.col("name").alias("source_name"), F.col("type").alias("source_type"))
    return jobs.join(meta, "source_name", "left")


def listed_sources(sources: DataFrame, *, include_aliases: bool) -> DataFrame:
    """Sources by name; aliases are hidden without the right to see them or when not exposed."""
    shown = F.lit(include_aliases) & F.coalesce(normalize_expose("expose") != "none", F.lit(False))
    return sources.withColumn("aliases", F.when(shown, F.col("aliases"))).orderBy("name")


def provenance(fields: dict[str, Column], digest: Column | None = None) -> Column:
    """Sparse MAP of the non-empty fields; ``resolved_ref`` falls back to the digest."""
    if digest is not None:
        current = fields.get("resolved_ref", F.lit(""))
        fields = {**fields, "resolved_ref": F.coalesce(F.nullif(current, F.lit("")), digest)}
    pairs = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.coalesce(v != "", F.lit(False)))


# --- suggestions -----------------------------------------------------------------------


def segment_candidates(commands: DataFrame, *keys: str) -> DataFrame:
    """Candidates from ``(name, short, hidden, alias_target, alias_description)`` commands, with
    their ``keys``."""
    target, text = F.coalesce("alias_target", F.lit("")), F.coalesce("alias_description", F.lit(""))
    plain = F.coalesce(F.nullif("short", F.lit("")), F.col("name"))
    display = (
        F.when((target != "") & (text != ""), _text(F.col("name"), " (alias -> ", target, ", ", text, ")"))
        .when(target != "", _text(F.col("name"), " (alias -> ", target, ")"))
        .otherwise(plain)
    )
    return commands.filter(~F.coalesce("hidden", F.lit(False)) & (F.col("name") != "")).select(
        *keys, F.col("name").alias("insert"), display.alias("display")
    )


def flag_candidates(flags: DataFrame, *keys: str) -> DataFrame:
    """``--name`` and ``-s`` candidates from ``(name, usage, shorthand, hidden)`` flags, per ``keys``.

    Forms that differ in case only count once; the first flag by name keeps the form.
    """
    display = F.coalesce(F.nullif("usage", F.lit("")), F.col("name"))
    forms = F.array_compact(
        F.array(
            F.concat(F.lit("--"), F.col("name")),
            F.when(F.coalesce(F.col("shorthand"), F.lit("")) != "", F.concat(F.lit("-"), F.col("shorthand"))),
        )
    )
    shown = flags.filter(~F.coalesce("hidden", F.lit(False))).select(
        *keys, "name", F.explode(forms).alias("insert"), display.alias("display")
    )
    return (
        shown.groupBy(*keys, F.lower("insert").alias("__form"))
        .agg(F.min_by(F.struct("insert", "display"), "name").alias("f"))
        .select(*keys, "f.*")
    )


def value_hints(arg: str | Column) -> Column:
    """Value choices of an argument, in declaration order."""
    a = F.col(arg) if isinstance(arg, str) else arg
    none = F.array().cast("array<string>")
    return (
        F.when(a["type"] == "boolean", F.array(F.lit("true"), F.lit("false")))
        .when(a["type"].isin("string", "integer", "object"), F.coalesce(a["enum"], none))
        .when(a["type"] == "array", F.coalesce(a["items_enum"], none))
        .otherwise(none)
    )


def prefix_suggest(
    candidates: DataFrame, queries: DataFrame, query: str = "query", *, on: Sequence[str] = ()
) -> DataFrame:
    """Candidates ``(insert, display)`` whose name starts with each query, without regard to case;
    those with the same ``on`` columns only, where given.

    Names starting with ``:`` only show for queries that do. The prefix test runs as an equi
    join: candidates are cut to the lengths that occur among the queries (at most the longest
    query's length) and met on the cut text, so no pair is formed that does not match.
    """
    wanted = queries.withColumn("__p", F.lower(F.coalesce(F.col(query), F.lit(""))))
    lengths = wanted.agg(F.collect_set(F.length("__p")).alias("l")).scalar()
    low = F.lower("insert")
    cut = (
        candidates.withColumn("__low", low)
        .withColumn("__n", F.explode(lengths))
        .filter(F.col("__n") <= F.length("__low"))
        .withColumn("__p", F.substr(F.col("__low"), F.lit(1), F.col("__n")))
        .drop("__low", "__n")
    )
    internal = F.col("insert").startswith(":") & ~F.col("__p").startswith(":")
    return wanted.join(cut, [*on, "__p"]).filter(~internal).drop("__p")
