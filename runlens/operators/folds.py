"""Sequential folds over bounded chunks.

Some rules are sequential per key: each decision depends on the ones before it. Here the rows of
every key are cut into chunks of consecutive rows, all keys advance one chunk at a time in
parallel, and only the (bounded) state travels between chunks. A task never holds more than one
chunk of a key, and finished chunks are written to the shared folder, so a lost executor costs
one chunk at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators.running import numbered
from runlens.session import written

CHUNK_ROWS = 1 << 18

Fold = Callable[[tuple, pd.DataFrame, pd.DataFrame], tuple[pd.DataFrame, pd.DataFrame]]


def _prefixed(schema: T.StructType, prefix: str) -> list[T.StructField]:
    return [T.StructField(prefix + f.name, f.dataType, True) for f in schema.fields]


def chunked_fold(
    df: DataFrame,
    keys: list[str],
    order: str,
    fold: Fold,
    state_schema: str,
    out_schema: str,
    *,
    initial: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Fold rows per key in ``order``, at most ``chunk_rows`` of a key at a time.

    ``fold(key, rows, state)`` gets rows sorted by ``order`` and returns (output, new state).
    Both schemas are DDL without the key columns; the keys are added in front of the output.
    ``initial`` holds the state (keys and state columns) before the first row.
    """
    spark = df.sparkSession
    key_fields = [df.schema[k] for k in keys]
    out_type, state_type = T.StructType.fromDDL(out_schema), T.StructType.fromDDL(state_schema)
    # one result schema carries both: output rows and the state for the next chunk
    both = T.StructType(
        [*key_fields, T.StructField("__state", T.BooleanType()),
         *_prefixed(out_type, "o_"), *_prefixed(state_type, "s_")]
    )
    names = [f.name for f in both.fields]
    out_names = [f.name for f in out_type.fields]
    state_names = [f.name for f in state_type.fields]

    def step(key: tuple, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            out, kept = pd.DataFrame(columns=out_names), state[state_names]
        else:
            out, kept = fold(key, rows.sort_values(order, kind="stable"), state[state_names])
        parts = [
            out[out_names].add_prefix("o_").assign(__state=False),
            kept[state_names].add_prefix("s_").assign(__state=True),
        ]
        merged = pd.concat([p.astype(object) for p in parts if len(p)] or [parts[0].astype(object)])
        for name, value in zip(keys, key):
            merged[name] = value
        return merged.reindex(columns=names).astype(object).where(lambda x: x.notna(), None)

    ranked = numbered(df, keys, order, "__rank", start=0).withColumn(
        "__chunk", F.expr(f"__rank div {int(chunk_rows)}L")
    )
    rounds = ranked.agg(F.max("__chunk")).first()[0]
    if rounds is None:
        return spark.createDataFrame([], T.StructType([*key_fields, *out_type.fields]))
    if rounds:
        ranked = written(ranked, "fold-input")
    state = (
        initial.select(*[F.col(c).alias(c) for c in [*keys, *state_names]])
        if initial is not None
        else spark.createDataFrame([], T.StructType([*key_fields, *state_type.fields]))
    )
    outputs = []
    for chunk in range(rounds + 1):
        rows = ranked.filter(F.col("__chunk") == chunk).drop("__rank", "__chunk")
        result = (
            rows.groupBy(*keys)
            .cogroup(state.groupBy(*keys))
            .applyInPandas(step, both)
        )
        if rounds:
            result = written(result, f"fold-{chunk}")
        outputs.append(
            result.filter(~F.col("__state")).select(*keys, *[F.col(f"o_{n}").alias(n) for n in out_names])
        )
        state = result.filter("__state").select(*keys, *[F.col(f"s_{n}").alias(n) for n in state_names])
    return reduce(DataFrame.unionByName, outputs)
