"""Counters, histograms, gauges, storage health, access audit and text exposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.access import missing_scopes, required_scopes
from runlens.functions.text import float_text, normalize_label, quoted, route_template, trim_ws
from runlens.operators.quantiles import nearest_rank
from runlens.operators.running import BUCKET_ROWS, clamped_gauge

# Histogram bounds and label sets that always appear.
HTTP_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)
CONTAINER_BUCKETS = (0.5, 1, 2, 5, 10, 20, 60, 120, 300)
LATENCY_BUCKETS = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)
LATENCY_LABELS = (
    ("idempotency_lookup", "hit"),
    ("idempotency_lookup", "miss"),
    ("idempotency_lookup", "expired"),
    ("idempotency_lookup", "error"),
    ("idempotency_store", "ok"),
    ("idempotency_store", "error"),
    ("journal_append", "ok"),
    ("journal_append", "quota_exceeded"),
    ("journal_append", "error"),
    ("journal_read", "ok"),
    ("journal_read", "error"),
)
EVICTION_KINDS = (("journal",), ("idempotency",))

# Durations are whole nanoseconds, so their sums are exact in this type and do not depend
# on the order in which tasks finish.
_EXACT = "decimal(28,9)"


def _exact_sum(v: Column) -> Column:
    """Sum of durations, the same whatever the order of the tasks; what is no duration in range
    (infinite, not a number, above 10**19) is added as it is."""
    exact = v.try_cast(_EXACT)
    odd = F.sum(F.when(exact.isNull(), v))
    return F.coalesce(F.sum(exact).cast("double"), F.lit(0.0)) + F.coalesce(odd, F.lit(0.0))


def _zero_rows(df: DataFrame, labels: Sequence[str], known: Sequence[Sequence[str]]) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in labels)
    return df.sparkSession.createDataFrame([tuple(k) for k in known], schema)


def counters(
    df: DataFrame,
    labels: Sequence[str],
    *,
    amount: Column | None = None,
    known: Sequence[Sequence[str]] = (),
) -> DataFrame:
    """Count (and optionally add up) observations per label set; known sets appear as zero."""
    rows = df.select(
        *labels,
        F.lit(1).cast("long").alias("__n"),
        (amount if amount is not None else F.lit(0)).cast("long").alias("__a"),
    )
    if known:
        zero = _zero_rows(df, labels, known).select(
            *labels, F.lit(0).cast("long").alias("__n"), F.lit(0).cast("long").alias("__a")
        )
        rows = rows.unionByName(zero)
    out = rows.groupBy(*labels).agg(F.sum("__n").alias("count"), F.sum("__a").alias("amount"))
    return out if amount is not None else out.drop("amount")


def http_counters(log: DataFrame) -> DataFrame:
    """Requests per (route, method, code) of an access log ``(path, method, code)``."""
    routed = log.filter(F.col("method") != "").withColumn("route", route_template("path"))
    return counters(routed, ["route", "method", "code"])


def eviction_counters(df: DataFrame) -> DataFrame:
    """Evictions and bytes per kind of ``(kind, bytes)``."""
    labelled = df.select(
        normalize_label("kind", "unknown").alias("kind"),
        F.greatest(F.col("bytes"), F.lit(0)).alias("bytes"),
    )
    return counters(labelled, ["kind"], amount=F.col("bytes"), known=EVICTION_KINDS)


def denial_counters(df: DataFrame) -> DataFrame:
    return counters(df.filter(F.col("reason") != ""), ["reason"])


def cursor_counters(resumed: DataFrame) -> DataFrame:
    """One row: resume attempts, and those whose cursor had expired, of resume outcomes."""
    return resumed.agg(
        F.count(F.lit(1)).alias("resumes"), F.count_if(F.col("outcome") == "expired").alias("expired")
    )


def container_counters(runs: DataFrame, pulls: DataFrame) -> DataFrame:
    """One row: container runs and image pulls."""
    both = runs.select(F.lit(1).alias("r"), F.lit(0).alias("p")).unionAll(
        pulls.select(F.lit(0).alias("r"), F.lit(1).alias("p"))
    )
    return both.agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("runs"), F.coalesce(F.sum("p"), F.lit(0)).alias("pulls")
    )


def invalid_manifests(lint: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: manifests with at least one error."""
    return lint.select(*keys).distinct().agg(F.count(F.lit(1)).alias("invalid"))


def source_counters(df: DataFrame) -> DataFrame:
    kinds = df.select(F.lower(trim_ws("type")).alias("type")).filter(F.col("type") != "")
    return counters(kinds, ["type"])


def bucket_label(upper: float) -> str:
    return f"{upper:g}"


def histogram(
    df: DataFrame,
    labels: Sequence[str],
    value: str,
    buckets: Sequence[float],
    *,
    known: Sequence[Sequence[str]] = (),
) -> DataFrame:
    """Cumulative histogram, wide: labels, ``buckets`` ARRAY<LONG>, count, sum.

    One pass with map-side combine: a row per label set leaves each task.
    """
    rows = df.select(*labels, F.col(value).cast("double").alias("__v"))
    if known:
        zero = _zero_rows(df, labels, known).withColumn("__v", F.lit(None).cast("double"))
        rows = rows.unionByName(zero)
    v = F.col("__v")
    return (
        rows.groupBy(*labels)
        .agg(
            *[F.count_if(v <= float(b)).alias(f"__b{i}") for i, b in enumerate(buckets)],
            F.count(v).alias("count"),
            _exact_sum(v).alias("sum"),
        )
        .select(
            *labels,
            F.array(*[F.col(f"__b{i}") for i in range(len(buckets))]).alias("buckets"),
            "count",
            "sum",
        )
    )


def latency_histogram(df: DataFrame) -> DataFrame:
    """Persistence latency (operation, outcome, value_ms); negative durations are dropped."""
    rows = df.select(
        normalize_label("operation").alias("operation"),
        normalize_label("outcome", "ok").alias("outcome"),
        "value_ms",
    ).filter((F.col("operation") != "") & (F.col("value_ms") >= 0))
    return histogram(
        rows, ["operation", "outcome"], "value_ms", LATENCY_BUCKETS, known=LATENCY_LABELS
    )


def histogram_rows(wide: DataFrame, labels: Sequence[str], buckets: Sequence[float]) -> DataFrame:
    """One row per bucket: labels, le, cumulative count (``+Inf`` equals the count)."""
    les = F.array(*[F.lit(bucket_label(b)) for b in buckets], F.lit("+Inf"))
    counts = F.array_append("buckets", F.col("count"))
    return wide.select(
        *labels, F.posexplode(F.arrays_zip(les.alias("le"), counts.alias("n"))).alias("pos", "b")
    ).select(*labels, "pos", "b.le", "b.n")


def gauge_clamped(
    df: DataFrame, label: str, order: str, delta: str, *, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Gauge after every delta, never below zero."""
    rows = df.withColumn(label, normalize_label(label, "unknown"))
    return clamped_gauge(
        rows, [label], order, F.col(delta).cast("long"), "value", bucket_rows=bucket_rows
    )


def span_rollup(spans: DataFrame, quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Count, total duration and percentiles per (span, outcome)."""
    keys = ["span", "outcome"]
    totals = spans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        _exact_sum(F.col("duration_ms").cast("double")).alias("total_ms"),
    )
    ranks = nearest_rank(spans, keys, "duration_ms", quantiles)
    wide = ranks.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(f"p{round(q * 100)}_ms")
            for q in quantiles
        ]
    )
    return totals.join(wide, keys)


def policy_rollup(decisions: DataFrame) -> DataFrame:
    return counters(decisions, ["profile", "subject", "decision", "code"])


def table_files(table: DataFrame) -> DataFrame:
    """(path, size) of the files a table is read from.

    The file's own metadata stands beside every row; no column is read, and a task hands on one
    row per file.
    """
    meta = F.col("_metadata")
    return table.select(meta["file_path"].alias("path"), meta["file_size"].alias("size")).distinct()


def storage_health(
    files: DataFrame,
    journal_bytes: DataFrame,
    *,
    max_bytes: int,
    journal_max_bytes: int,
    schema_version: int,
    driver: str = "parquet",
) -> DataFrame:
    """One row of storage state from ``files(path, size)`` and the journal byte total."""
    used = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_used"))
    limit, journal_limit = F.lit(max_bytes).cast("long"), F.lit(journal_max_bytes).cast("long")
    evicting = ((journal_limit > 0) & (F.col("journal_bytes") >= journal_limit)) | (
        (limit > 0) & (F.col("bytes_used") >= F.lit(max_bytes * 9 // 10))
    )
    return (
        used.withColumn("journal_bytes", journal_bytes.select("journal_bytes").scalar())
        .select(
            F.lit(driver).alias("driver"),
            ((limit == 0) | (F.col("bytes_used") < limit)).alias("ok"),
            "bytes_used",
            limit.alias("max_bytes"),
            "journal_bytes",
            journal_limit.alias("journal_max_bytes"),
            evicting.alias("eviction_active"),
            F.lit(schema_version).alias("schema_version"),
        )
    )


def access_audit(log: DataFrame, **scope_names: str) -> DataFrame:
    """Add required scopes, what is missing, and the verdict to ``(method, path, granted)``."""
    return (
        log.withColumn("required", required_scopes("method", "path", **scope_names))
        .withColumn("missing", missing_scopes(F.col("required"), F.col("granted")))
        .withColumn("allowed", F.size("missing") == 0)
    )


# --- text exposition -------------------------------------------------------------------


def _label_text(labels: Sequence[tuple[str, Column]]) -> Column:
    if not labels:
        return F.lit("")
    parts = [F.concat(F.lit(f"{k}="), quoted(v.cast("string"))) for k, v in labels]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _series(labels: Sequence[str]) -> Column:
    """Sort key of a series: its label values in order."""
    return F.concat_ws("\u0001", *[F.col(c) for c in labels]) if labels else F.lit("")


def expose_counter(
    df: DataFrame,
    name: str,
    labels: Sequence[str],
    value: str = "count",
    *,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """(metric, series, pos, line) rows of a counter or gauge, labels as given."""
    text = _label_text([(c, F.col(c)) for c in labels])
    order = _series(order_by or labels)
    return df.select(
        F.lit(name).alias("metric"),
        order.alias("series"),
        F.lit(0).alias("pos"),
        F.concat(F.lit(name), text, F.lit(" "), F.col(value).cast("string")).alias("line"),
    )


def expose_info(df: DataFrame, name: str, labels: dict[str, str], value: int = 1) -> DataFrame:
    """The one line of an information gauge, its labels by name."""
    text = _label_text([(k, F.lit(labels[k])) for k in sorted(labels)])
    return df.sparkSession.range(1).select(
        F.lit(name).alias("metric"), F.lit("").alias("series"), F.lit(0).alias("pos"),
        F.concat(F.lit(name), text if labels else F.lit("{}"), F.lit(f" {value}")).alias("line"),
    )


def expose_profile(df: DataFrame, name: str, profile: str) -> DataFrame:
    """The active security profile: 1 with its name, 0 while there is none."""
    return expose_info(df, name, {"profile": profile}, 1 if profile else 0)


def expose_histogram(
    wide: DataFrame, name: str, labels: Sequence[str], buckets: Sequence[float]
) -> DataFrame:
    """(metric, series, pos, line) rows of a histogram, ``le`` merged into the labels."""
    plain = _label_text([(c, F.col(c)) for c in sorted(labels)])

    def with_le(text: str) -> Column:
        return _label_text(
            [(c, F.lit(text) if c == "le" else F.col(c)) for c in sorted([*labels, "le"])]
        )

    def line(suffix: str, text: Column, value: Column) -> Column:
        return F.concat(F.lit(f"{name}{suffix}"), text, F.lit(" "), value)

    lines = [
        line("_bucket", with_le(bucket_label(b)), F.get("buckets", F.lit(i)).cast("string"))
        for i, b in enumerate(buckets)
    ]
    lines += [
        line("_bucket", with_le("+Inf"), F.col("count").cast("string")),
        line("_sum", plain, float_text("sum")),
        line("_count", plain, F.col("count").cast("string")),
    ]
    return wide.select(
        F.lit(name).alias("metric"), _series(labels).alias("series"), F.posexplode(F.array(*lines)).alias("pos", "line")
    )


def expose_header(df: DataFrame, name: str, help_text: str, kind: str) -> DataFrame:
    """HELP and TYPE lines; they sort before every series of the metric."""
    texts = [f"# TYPE {name} {kind}"]
    if help_text:
        texts.insert(0, "# HELP {} {}".format(name, help_text.replace("\\", "\\\\")))
    rows = [(name, "", i - len(texts), t) for i, t in enumerate(texts)]
    return df.sparkSession.createDataFrame(rows, "metric string, series string, pos int, line string")


def write_exposition(parts: Sequence[DataFrame], path: str) -> None:
    """Write exposition rows as text in (metric, series, position) order."""
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    ordered = lines.repartitionByRange("metric", "series", "pos")
    ordered.sortWithinPartitions("metric", "series", "pos").select("line").write.text(path)
