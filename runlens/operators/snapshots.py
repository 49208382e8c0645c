"""Keyed snapshots kept up to date by change sets, and pages for tables of requests.

A snapshot is a Parquet table of one row per key, partitioned by ``slot`` (a hash of the key) and
bucketed by the key inside. Compaction looks at the slots that a change set touches, reads those
only, and replaces only their folders; a bucketed scan needs no exchange to join or group by the
key. Deleted keys stay as tombstones, so a slot never loses its last row.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.operators.keyed import SCAN_LIMIT, latest
from runlens.session import scratch_path, setting, written

SLOTS = 64


def _slot(keys: Sequence[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


class Snapshot:
    """A table ``(keys, values, ord, op)`` of the newest change per key.

    ``keys`` identify a row, ``order`` is a long that tells newer changes. The table is registered
    in the session's catalog, with its files below ``path``; open it there again with ``name``.
    ``buckets`` are as many as the session's shuffle partitions unless given: with fewer, Spark
    would rather shuffle both sides of a join.
    """

    def __init__(
        self,
        spark: SparkSession,
        keys: Sequence[str],
        order: str,
        *,
        path: str | None = None,
        name: str | None = None,
        slots: int = SLOTS,
        buckets: int | None = None,
    ) -> None:
        self.spark, self.keys, self.order = spark, list(keys), order
        self.path = path or scratch_path(spark, "snapshot")
        self.name = name or f"snapshot_{uuid.uuid4().hex}"
        self.slots = slots
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        """Newest change per key, tombstones included."""
        return self.spark.table(self.name)

    def live(self) -> DataFrame:
        return self.rows().filter(F.col("op") != "delete").drop("slot")

    def apply(self, changes: DataFrame) -> list[int]:
        """Fold a change set into the snapshot; returns the slots that were rewritten.

        Changes come in any order and may be applied again: a stored row gives way to newer ones
        only. The slots touched are at most ``slots`` numbers; the stored rows of other slots are
        not read.
        """
        newest = latest(changes, self.keys, self.order).withColumn("slot", _slot(self.keys, self.slots))
        columns = [*changes.columns, "slot"]
        newest = written(newest.select(*columns), "changes")
        touched = sorted(r["slot"] for r in newest.select("slot").distinct().collect())
        if not touched:
            return []
        if not self.exists():
            (
                newest.repartition(self.buckets, *self.keys)
                .write.partitionBy("slot")
                .bucketBy(self.buckets, *self.keys)
                .sortBy(*self.keys)
                .option("path", self.path)
                .saveAsTable(self.name)
            )
            return touched
        columns = self.rows().columns  # the partition column comes last
        merged = merge(self.rows().filter(F.col("slot").isin(touched)), newest, self.keys, self.order)
        # a table can't be read and overwritten in one job
        ready = written(merged.select(*columns), "merged").repartition(self.buckets, *self.keys)
        with setting(self.spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            ready.write.mode("overwrite").insertInto(self.name)
        return touched


def merge(stored: DataFrame, newest: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the row with the larger ``order``; both sides have one row per key."""
    rest = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, F.struct(*rest).alias("__old"))
    new = newest.select(*keys, F.struct(*rest).alias("__new"))
    joined = old.join(new, keys, "full")
    newer = F.col("__old").isNull() | (F.col(f"__new.{order}") > F.col(f"__old.{order}"))
    row = F.when(F.col("__new").isNotNull() & newer, F.col("__new")).otherwise(F.col("__old"))
    return joined.select(*keys, row.alias("__row")).select(*keys, "__row.*")


# --- pages -------------------------------------------------------------------------------


def next_prefix(prefix: Column) -> Column:
    """The first binary key after all those that start with ``prefix``; null when there is none.

    Trailing FF bytes are cut off and the last byte left is raised by one.
    """
    pairs = F.regexp_extract(F.hex(prefix), "^((?:..)*?)(?:FF)*$", 1)
    last = F.conv(F.right(pairs, F.lit(2)), 16, 10).cast("int") + 1
    raised = F.concat(
        F.substring(pairs, F.lit(1), F.length(pairs) - 2), F.lpad(F.hex(last.cast("long")), 2, "0")
    )
    return F.when(pairs != "", F.unhex(raised))


def _ranks(keys: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys with their dense rank, and marks with the number of keys before them.

    Both are sorted together in one range partitioning by (namespace, end, text, side); a count per part,
    carried over from the parts before, and a count inside the part give the ranks.
    """
    order = ["namespace", "end", "text", "side"]
    none = F.lit(None).cast("long")
    both = keys.select(
        "namespace", F.lit(0).alias("end"), F.col("k").alias("text"), F.lit(1).alias("side"),
        none.alias("request"), none.alias("bound"),
    ).unionByName(marks.select(*order, "request", "bound"))
    ranged = both.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    parts = written(ranged, "ranks")
    is_key = F.col("request").isNull()
    sizes = parts.groupBy("part").agg(F.count_if(is_key).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = parts.join(base, "part").withColumn(
        "rank", F.col("base") + F.sum(is_key.cast("long")).over(inside)
    )
    ranked = written(ranked.select("namespace", "text", "request", "bound", "rank"), "ranked")
    return (
        ranked.filter(is_key).select("namespace", F.col("text").alias("k"), "rank"),
        ranked.filter(~is_key).select("request", "bound", "rank"),
    )


def prefix_pages(live: DataFrame, requests: DataFrame, *, max_limit: int = SCAN_LIMIT) -> DataFrame:
    """One page of keys per request (request, namespace, prefix, cursor, limit), any number of them.

    A page has the keys with the prefix, in byte order, after the cursor (null or empty: from the
    start); a limit outside 1 to ``max_limit`` counts as ``max_limit``. ``live`` has one row per
    (namespace, k), text or binary, and more columns. Every request becomes a range of key ranks:
    its bounds are sorted in among the keys, so no key is compared with requests one by one; the
    ranks of a page, ``limit + 1`` at most, are met by an equi-join. No side of a join is sent whole through
    the driver: Spark sees the files of the requests, not how many ranks come of them, so the joins are
    told to sort and merge. Returns the request, place (from 1), the
    rows, and next_cursor (on every row the page's last key when more follow, else null);
    a request without keys has no row.
    """
    binary = live.withColumn("k", F.col("k").cast("binary"))
    asked = requests.select(
        F.col("request").cast("long").alias("request"), "namespace",
        F.coalesce(F.col("prefix").cast("binary"), F.lit(b"")).alias("prefix"),
        F.coalesce(F.col("cursor").cast("binary"), F.lit(b"")).alias("cursor"),
        F.when(F.col("limit").between(1, max_limit), F.col("limit")).otherwise(max_limit).alias("limit"),
    )
    asked = written(asked.filter(F.col("request").isNotNull() & F.col("namespace").isNotNull()), "page-requests")
    resumed = (F.octet_length("cursor") > 0) & (F.col("cursor") >= F.col("prefix"))
    after = next_prefix(F.col("prefix"))
    # side 0 lies before an equal key, side 2 behind it; end 1 is the end of a namespace
    low = asked.select(
        "namespace", F.lit(0).alias("end"), F.when(resumed, F.col("cursor")).otherwise(F.col("prefix")).alias("text"),
        F.when(resumed, 2).otherwise(0).alias("side"), "request", F.lit(0).cast("long").alias("bound"),
    )
    high = asked.select(
        "namespace", F.when(after.isNull(), 1).otherwise(0).alias("end"), after.alias("text"),
        F.lit(0).alias("side"), "request", F.lit(1).cast("long").alias("bound"),
    )
    keys, marks = _ranks(binary.select("namespace", "k"), low.unionByName(high))
    ranges = marks.groupBy("request").agg(
        F.max(F.when(F.col("bound") == 0, F.col("rank"))).alias("low"),
        F.max(F.when(F.col("bound") == 1, F.col("rank"))).alias("high"),
    )
    pages = asked.select("request", "limit").join(ranges.hint("merge"), "request").filter("high > low")
    stop = F.least(F.col("high"), F.col("low") + F.col("limit") + 1)
    wanted = pages.select(
        "request", "limit", "low", F.explode(F.sequence(F.col("low") + 1, stop)).alias("rank")
    )
    met = wanted.hint("merge").join(keys, "rank").withColumn("place", F.col("rank") - F.col("low"))
    # limit + 1 rows of a request at most
    whole = Window.partitionBy("request")
    more = F.max("place").over(whole) > F.col("limit")
    last = F.max(F.when(F.col("place") == F.col("limit"), F.col("k"))).over(whole)
    page = met.withColumn("next_cursor", F.when(more, last)).filter(F.col("place") <= F.col("limit"))
    kind = live.schema["k"].dataType
    page = page.select("request", "place", "namespace", "k", "next_cursor")
    found = page.hint("merge").join(binary, ["namespace", "k"])
    return found.withColumns({"k": F.col("k").cast(kind), "next_cursor": F.col("next_cursor").cast(kind)})
