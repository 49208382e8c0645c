"""Running aggregates that never put one whole group into one task.

A plain ``sum(x) OVER (PARTITION BY key ORDER BY seq)`` sends every row of a key to one
task. Here keys with more than ``bucket_rows`` rows (at most ``rows / bucket_rows`` of them) are
cut into buckets of the integer order column: partial results per (key, bucket) are combined on
the map side, a window over that small table gives the value carried into each bucket, and the
row-level window runs per (key, bucket). All other keys are one bucket and carry nothing. Rows
are shuffled once, and no task sees much more than ``bucket_rows`` rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 1 << 18

_BUCKET, _HOT = "__bucket", "__hot"

_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_CARRY = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def _combine(fn: str, carried: Column, local: Column) -> Column:
    if fn in ("sum", "count"):
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    return F.greatest(carried, local) if fn == "max" else F.least(carried, local)


def with_bucket(df: DataFrame, order: str, bucket_rows: int, name: str = _BUCKET) -> DataFrame:
    return df.withColumn(name, F.expr(f"`{order}` div {int(bucket_rows)}L"))


def _cut(df: DataFrame, keys: list[str], order: str, bucket_rows: int) -> DataFrame:
    """Rows with their bucket; only keys with more than ``bucket_rows`` rows get several."""
    if not keys:
        return with_bucket(df, order, bucket_rows).withColumn(_HOT, F.lit(True))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    hot = sizes.filter(F.col("__size") > bucket_rows).select(*keys, F.lit(True).alias(_HOT))
    marked = df.join(hot, keys, "left")
    bucket = F.expr(f"`{order}` div {int(bucket_rows)}L")
    return marked.withColumn(_BUCKET, F.when(F.col(_HOT), bucket).otherwise(F.lit(0).cast("long")))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    specs: dict[str, tuple[str, Column]],
    *,
    before: bool = False,
    reverse: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add running aggregates per ``keys`` in the order of the unique LONG ``order``.

    ``specs`` maps an output column to (sum | count | max | min, expression). With ``before``
    the current row is left out (first row: null, or 0 for sum and count); ``reverse`` runs
    from the highest order value down.
    """
    keys = list(keys)
    args = {f"__in_{out}": expr for out, (_, expr) in specs.items()}
    rows = _cut(df, keys, order, bucket_rows).withColumns(args)

    totals = rows.filter(_HOT).groupBy(*keys, _BUCKET).agg(
        *[_AGG[fn](f"__in_{out}").alias(f"__t_{out}") for out, (fn, _) in specs.items()]
    )
    step = F.col(_BUCKET).desc() if reverse else F.col(_BUCKET).asc()
    across = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        _BUCKET,
        *[
            _CARRY[fn](f"__t_{out}").over(across).alias(f"__c_{out}")
            for out, (fn, _) in specs.items()
        ],
    )
    row_step = F.col(order).desc() if reverse else F.col(order).asc()
    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(row_step)
        .rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    )
    joined = rows.join(carried, [*keys, _BUCKET], "left")
    result = {
        out: _combine(fn, F.col(f"__c_{out}"), _AGG[fn](f"__in_{out}").over(inside))
        for out, (fn, _) in specs.items()
    }
    return joined.withColumns(result).select(*df.columns, *specs)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str,
    *,
    start: int | Column = 1,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Dense 1-based position of each row per ``keys`` (whole table when empty)."""
    ranked = running(
        df, keys, order, {out: ("count", F.lit(1))}, before=True, bucket_rows=bucket_rows
    )
    return ranked.withColumn(out, F.col(out) + (F.lit(start) if isinstance(start, int) else start))


def clamped_gauge(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    delta: Column,
    out: str,
    *,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Gauge that is set back to 0 whenever a delta would make it negative.

    With running sum ``s`` the value is ``s - min(0, lowest s so far)``. A bucket passes on its
    sum and its lowest inner running sum, so rows are shuffled once, by (key, bucket).
    """
    keys = list(keys)
    by = [*keys, _BUCKET]
    inside = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        _cut(df, keys, order, bucket_rows)
        .withColumn("__d", delta)
        .withColumn("__s", F.sum("__d").over(inside))
        .withColumn("__m", F.min("__s").over(inside))
    )
    totals = (
        rows.filter(_HOT).groupBy(*by).agg(F.sum("__d").alias("__t"), F.min("__s").alias("__l"))
    )
    across = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        totals.withColumn("__o", F.coalesce(F.sum("__t").over(across), F.lit(0)))
        .withColumn("__g", F.min(F.col("__o") + F.col("__l")).over(across))
        .select(*by, "__o", "__g")
    )
    offset = F.coalesce(F.col("__o"), F.lit(0))
    value = (
        offset + F.col("__s")
        - F.least(F.lit(0).cast("long"), F.col("__g"), offset + F.col("__m"))
    )
    return rows.join(carried, by, "left").withColumn(out, value).select(*df.columns, out)
