"""Exact duplicates: 128-bit content hash, then a comparison of the bytes inside each group.

Rows are grouped by the MD5 of their normalised text; that shuffles fixed-width values only, and
Spark combines them per task first, so a group holding a third of all rows costs one row per task.
Texts travel only for hashes that occur twice: a second aggregation has (hash, text) as its key,
which compares whole texts byte by byte, again combined per task. Rows then take their group's
result by hash; the rows of a hash that stands for several texts (a collision) by hash and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import ascii_lower, fresh, read_columns
from runlens.session import written

KEEP = {"smallest": F.min, "largest": F.max}


def normalised(text: Column) -> Column:
    """Text as compared: null is empty, A-Z are lower-cased."""
    return F.coalesce(ascii_lower(text), F.lit(""))


def _groups(hashed: DataFrame, keep: str) -> DataFrame:
    """One row per text that occurs more than once: hash, body (collisions only), id, size.

    ``hashed`` has __hash, __body and __id.
    """
    pick = KEEP[keep]
    twice = (
        hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    ).select("__hash")
    texts = (
        hashed.join(twice, "__hash", "left_semi")
        .groupBy("__hash", "__body")
        .agg(pick("__id").alias("__keep"), F.count(F.lit(1)).alias("__size"))
    )
    texts = written(
        texts.select("__hash", "__body", "__keep", "__size"), "exact-groups"
    )
    bodies = texts.groupBy("__hash").agg(F.count(F.lit(1)).alias("__bodies"))
    return texts.join(bodies, "__hash")


def duplicates(
    docs: DataFrame,
    *,
    keep: str = "smallest",
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_of=F.md5,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` tells which id of a group of equal texts stays. A null text is an empty one. Null
    ids never win against others; a group with null ids only has a null keep_id and keeps its
    rows. Repeated rows with the winning id are all marked kept (``deduplicate`` returns one).
    An empty table gives no rows; other input columns are ignored. ``hash_of`` is the 128-bit
    hash; with a weaker one results stay the same and more texts are compared.
    """
    rows = read_columns(docs, id_col, text_col).toDF("__id", "__text")
    hashed = rows.select("__id", normalised(F.col("__text")).alias("__body"))
    hashed = hashed.withColumn("__hash", hash_of(F.col("__body")))
    groups = _groups(hashed, keep)
    single = groups.filter("__bodies = 1").select("__hash", "__keep", "__size")
    several = groups.filter("__bodies > 1").select(
        F.col("__hash").alias("__chash"),
        F.sha2("__body", 256).alias("__csha"),
        F.col("__keep").alias("__ckeep"),
        F.col("__size").alias("__csize"),
    )
    out = (
        hashed.select("__id", "__hash", F.sha2("__body", 256).alias("__sha"))
        .join(single, "__hash", "left")
        .join(several, (F.col("__hash") == F.col("__chash")) & (F.col("__sha") == F.col("__csha")), "left")
    )
    size = F.coalesce("__size", "__csize", F.lit(1).cast("long"))
    keep_id = F.when(size > 1, F.coalesce("__keep", "__ckeep")).otherwise(F.col("__id"))
    return out.select(
        F.col("__id").alias(id_col),
        keep_id.alias("keep_id"),
        size.alias("group_size"),
        F.coalesce(F.col("__id") == keep_id, keep_id.isNull()).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def deduplicate(
    docs: DataFrame,
    *,
    keep: str = "smallest",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows that stay, with all their columns: exactly one per text.

    Rows take their group's winner by hash (and by the bytes' SHA-256 where a hash stands for
    several texts). Where rows repeat with one id and text, one of them is returned.
    """
    key, sha = fresh(docs, "hash"), fresh(docs, "sha")
    body = normalised(F.col(f"`{text_col}`"))
    hashed = docs.select(F.col(f"`{id_col}`").alias("__id"), body.alias("__body"))
    hashed = hashed.withColumn("__hash", F.md5("__body"))
    groups = _groups(hashed, keep).select(
        F.col("__hash").alias("__ghash"),
        F.sha2("__body", 256).alias("__gsha"),
        "__keep",
        "__bodies",
    )
    marked = docs.withColumns({key: F.md5(body), sha: F.sha2(body, 256)})
    hit = (F.col(key) == F.col("__ghash")) & (
        (F.col("__bodies") == 1) | (F.col(sha) == F.col("__gsha"))
    )
    stay = marked.join(groups, hit, "left").filter(
        F.col("__ghash").isNull() | F.col(f"`{id_col}`").eqNullSafe(F.col("__keep"))
    )
    repeated = hashed.groupBy("__id", "__hash").agg(F.count(F.lit(1)).alias("__n"))
    if not repeated.filter("__n > 1").isEmpty():
        stay = stay.dropDuplicates([key, sha])
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
