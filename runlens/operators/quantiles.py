"""Exact nearest-rank percentiles without holding a group's values in one buffer.

Every wanted rank lies in a window of values, at first all of its key. A round cuts the windows that
are still too large at values a sketch proposes, in the first round just below and above the wanted
ranks, and counts rows between them; the counts are sums, so they are combined per task, and they tell into which part a rank falls and how many
rows lie below. Windows of at most ``bound`` rows, or of one value, are ranked directly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import written

ACCURACY = 10_000
# Rows of a window that is ranked by sorting its distinct values.
BOUND = 1 << 16
# Points at which a round after the first cuts a window.
CUTS = 64
EVEN = [i / CUTS for i in range(CUTS + 1)]
# Cuts up to which a row's comparisons are written out one by one, which Spark compiles.
WRITTEN_OUT = 16


def _near(quantiles: Sequence[float], accuracy: int) -> list[float]:
    """Points around each quantile, further off than the sketch errs, and both ends."""
    off = 2 / accuracy
    around = {min(1.0, max(0.0, q + d)) for q in quantiles for d in (-off, off)}
    return sorted(around | {0.0, 1.0})


def _parts(inside: DataFrame, by: list[str], accuracy: int, points: list[float] = EVEN) -> DataFrame:
    """(by, __part, __n, __plo, __phi) of the parts of all windows: rows, lowest and highest value.

    A proposed value is a part of its own, so a value with many rows is settled by one round; the parts
    between hold the window's rows between two ``points``, a share of 0 to 1 each.
    """
    # a row per large window; written, Spark knows that it is few and need not shuffle the rows to them
    cuts = written(inside.groupBy(*by).agg(F.percentile_approx("__v", points, accuracy).alias("__s")), "cuts")
    value = F.col("__v")
    if len(points) <= WRITTEN_OUT:
        at = [F.get("__s", F.lit(i)) for i in range(len(points))]
        below = reduce(add, [c.cast("int") for s in at for c in (s < value, s <= value)])
    else:
        below = F.size(F.filter("__s", lambda s: s < value)) + F.size(F.filter("__s", lambda s: s <= value))
    cut = inside.join(cuts, by).withColumn("__part", below)
    return cut.groupBy(*by, "__part").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__plo"), F.max("__v").alias("__phi")
    )


def _rank(total: Column) -> Column:
    return F.least(total, F.greatest(F.lit(1), F.ceil(F.col("q") * total)))


def nearest_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Sequence[float],
    *,
    accuracy: int = ACCURACY,
    bound: int = BOUND,
) -> DataFrame:
    """Value at rank ``ceil(q * n)`` per key and quantile: (keys, q, n, value); nulls don't count.

    The answer is exact: a sketch only proposes where to cut. No sort sees more than ``bound`` distinct
    values of a key's window. The first round leaves about ``4 / accuracy`` of a key's rows, and a later one
    about a ``CUTS``-th of a larger window, so the number of rounds is logarithmic in the largest key.
    """
    if not keys:
        one = df.withColumn("__all", F.lit(0))
        return nearest_rank(one, ["__all"], value, quantiles, accuracy=accuracy, bound=bound).drop("__all")
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL")
    # a window: the key's __size rows from __lo to __hi, with __below rows before them
    wanted = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        .withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
        .select(
            *keys, "q", "n", _rank(F.col("n")).alias("__rank"), "__lo", "__hi",
            F.lit(0).cast("long").alias("__below"), F.col("n").alias("__size"),
        )
    )
    wanted = written(wanted, "ranks")
    large = (F.col("__size") > bound) & (F.col("__lo") < F.col("__hi"))
    by = [*keys, "__lo", "__hi"]
    points = _near(quantiles, accuracy)
    while not wanted.filter(large).isEmpty():
        open_ = wanted.filter(large)
        window = open_.select(*by).distinct()
        inside = rows.join(window, keys).filter(F.col("__v").between(F.col("__lo"), F.col("__hi")))
        parts, points = _parts(inside, by, accuracy, points), EVEN
        before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        start = F.col("__below") + F.col("__before")
        found = (
            open_.join(parts, by)
            .filter((F.col("__rank") > start) & (F.col("__rank") <= start + F.col("__n")))
            .select(
                *keys, "q", "n", "__rank", F.col("__plo").alias("__lo"), F.col("__phi").alias("__hi"),
                start.alias("__below"), F.col("__n").alias("__size"),
            )
        )
        wanted = written(wanted.filter(~large).unionByName(found), "ranks")
    single = wanted.filter(F.col("__lo") == F.col("__hi")).select(*keys, "q", "n", F.col("__lo").alias("value"))
    several = wanted.filter(F.col("__lo") < F.col("__hi"))
    window = several.select(*by).distinct()
    up_to = Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        rows.join(window, keys)
        .filter(F.col("__v").between(F.col("__lo"), F.col("__hi")))
        .groupBy(*by, "__v")
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__cum", F.sum("__c").over(up_to))
    )
    ranked = (
        counted.join(several, by)
        .filter(F.col("__below") + F.col("__cum") >= F.col("__rank"))
        .groupBy(*keys, "q", "n")
        .agg(F.min("__v").alias("value"))
    )
    return single.unionByName(ranked)
