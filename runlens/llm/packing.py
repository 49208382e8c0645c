"""Packing into padded batches with optimal length buckets.

Texts are measured in tokens and cut into pieces of at most ``max_tokens``. Spark counts the
pieces by length; that histogram has ``max_tokens`` rows at most, and dynamic programming over it
finds the bucket boundaries with the least padding. Within a bucket the pieces, in order of id,
fill batches of as many rows as the token budget holds at the bucket's padded length. Places are
given by a range partitioning and per-task counts, so no bucket has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.bpe import word_coder
from runlens.llm.common import WORD_BYTES, as_texts, read_columns, slices
from runlens.session import written

MAX_TOKENS = 4096
BUCKETS = 16
TOKEN_BUDGET = 1 << 16
# A packed text ends with one further token.
END_TOKENS = 1


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_coder(path, ids=False)
        for batch in slices(batches, most=WORD_BYTES):
            counts = codec.counts(as_texts(batch.column("text"))) + END_TOKENS
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts)], ["id", "tokens"])

    return run


def lengths(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id and tokens of each text, end token included; a null text has that alone.

    A text is counted whole, in the task that reads it; bytes that are no UTF-8 count as U+FFFD.
    Repeated rows are counted each, an empty table gives no rows, other columns are ignored.
    """
    rows = read_columns(docs, id_col, text_col).toDF("id", "text")
    rows = rows.withColumns({"id": F.col("id").cast("long"), "text": F.col("text").cast("binary")})
    return rows.mapInArrow(_counted(tokenizer), "id long, tokens long").withColumnRenamed("id", id_col)


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Padded lengths of at most ``buckets`` buckets with the least padding, ascending.

    The longest length is always one; of equally good choices the one with the shorter lower
    buckets is taken.
    """
    length = np.array(sorted(histogram), np.int64)
    if not len(length):
        return []
    rows = np.concatenate([[0], np.cumsum([histogram[x] for x in length.tolist()])]).astype(np.float64)
    # cost[j]: least tokens, padding included, of the lengths before j in the buckets so far
    cost = np.concatenate([[0.0], np.full(len(length), np.inf)])
    choices = []
    for _ in range(min(buckets, len(length))):
        best, choice = np.full(len(length) + 1, np.inf), np.zeros(len(length) + 1, np.int64)
        best[0] = 0.0
        for j in range(1, len(length) + 1):
            total = cost[:j] + length[j - 1] * (rows[j] - rows[:j])
            choice[j] = int(total.argmin())
            best[j] = total[choice[j]]
        cost = best
        choices.append(choice)
    found, j = [], len(length)
    for choice in reversed(choices):
        if not j:
            break
        found.append(int(length[j - 1]))
        j = int(choice[j])
    return found[::-1]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each bucket within the task, from 0."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        bucket = batch.column("padded").to_numpy()
        place = np.zeros(len(bucket), np.int64)
        for b in np.unique(bucket).tolist():
            mine = bucket == b
            before = seen.get(b, 0)
            place[mine] = before + np.arange(mine.sum())
            seen[b] = before + int(mine.sum())
        columns = [*batch.columns, pa.array(np.full(len(bucket), part, np.int32)), pa.array(place)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "n_tokens", "padded", "part", "place"])


def pack(
    measured: DataFrame,
    *,
    max_tokens: int = MAX_TOKENS,
    buckets: int = BUCKETS,
    token_budget: int = TOKEN_BUDGET,
    id_col: str = "doc_id",
    tokens_col: str = "tokens",
) -> DataFrame:
    """One row per piece: id, piece (from 0), first_token, n_tokens, bucket (from 0), padded,
    batch (from 0 in its bucket), slot (from 0 in its batch).

    ``measured`` has an id and a number of tokens. Texts longer than ``max_tokens`` become pieces
    of that length and a rest. A null or negative number counts as 0 and gives one empty piece,
    padded like the shortest bucket. Within a bucket, pieces stand in ascending order of id (nulls
    first) and piece; repeated rows are packed each. A batch has
    max(1, token_budget div padded) slots; only the last of a bucket may have empty ones. An empty
    table gives no rows; other columns are ignored.
    """
    rows = read_columns(measured, id_col, tokens_col).toDF("id", "tokens")
    tokens = F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(0)), F.lit(0))
    last = F.greatest(F.ceil(F.col("tokens") / max_tokens) - 1, F.lit(0)).cast("long")
    rows = rows.withColumn("tokens", tokens).withColumn("id", F.col("id").cast("long"))
    pieces = rows.select(
        "id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")
    ).withColumn("n_tokens", F.least(F.col("tokens") - F.col("piece") * max_tokens, F.lit(max_tokens)))
    pieces = written(pieces.select("id", "piece", "n_tokens"), "pieces")
    histogram = pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    ends = boundaries({int(r["n_tokens"]): int(r["n"]) for r in histogram}, buckets)
    padded = F.lit(ends[-1] if ends else 0)
    for end in reversed(ends):
        padded = F.when(F.col("n_tokens") <= end, F.lit(end)).otherwise(padded)
    number = F.array_position(F.array(*[F.lit(e) for e in ends]) if ends else F.array(F.lit(0)), F.col("padded"))
    by = ["padded", "id", "piece"]
    ordered = (
        pieces.withColumn("padded", padded.cast("long"))
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .select("id", "piece", "n_tokens", "padded")
    )
    schema = "id long, piece long, n_tokens long, padded long, part int, place long"
    placed = written(ordered.mapInArrow(_placed, schema), "placed")
    sizes = placed.groupBy("padded", "part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("padded").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("padded", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    slots = F.greatest(F.lit(1), F.expr(f"{int(token_budget)}L div greatest(padded, 1)"))
    full = placed.join(base, ["padded", "part"]).withColumns(
        {"slots": slots, "rank": F.col("base") + F.col("place")}
    )
    return full.select(
        F.col("id").alias(id_col),
        "piece",
        (F.col("piece") * max_tokens).alias("first_token"),
        "n_tokens",
        (number - 1).cast("int").alias("bucket"),
        "padded",
        F.expr("rank div slots").alias("batch"),
        (F.col("rank") % F.col("slots")).alias("slot"),
    )
