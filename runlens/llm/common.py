"""Helpers shared by the corpus operators."""

from __future__ import annotations

import pickle
import sys
import types
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import configure

# ASCII white space, as in the class [\x20\x09-\x0D]
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Text rows handed to Python at a time; long texts make batches of a few MB either way.
BATCH_ROWS = 2000
BATCH_BYTES = 2 << 20
# Text whose words are numbered together.
WORD_BYTES = 8 << 20
# Rows of a few longs that may be broadcast: some ten MB.
BROADCAST_ROWS = 1 << 18


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def ascii_lower(value: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.octet_length(value) == F.char_length(value)
    return F.when(plain, F.lower(value)).otherwise(F.translate(value, UPPER, UPPER.lower()))


def fresh(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{base}", 0
    while name.lower() in taken:
        n += 1
        name = f"__{base}{n}"
    return name


def read_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: other input columns never clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has ``BROADCAST_ROWS`` rows or fewer; else left to a shuffle.

    For narrow rows that are cheap to read twice. They are counted first, so what is broadcast is
    bounded.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives ``value`` in any worker, which needs no copy of this package.

    A broadcast refers to classes by their module's name; here they travel with their code.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most`` bytes at most."""
    for batch in batches:
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        step = max(1, batch.num_rows * most // max(size, 1))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def as_texts(column: pa.Array) -> pa.StringArray:
    """A binary column as texts: null is empty, bytes that are no UTF-8 become U+FFFD."""
    try:
        return column.cast(pa.string()).fill_null("")
    except pa.ArrowInvalid:
        return pa.array([(v or b"").decode("utf-8", "replace") for v in column.to_pylist()], pa.string())


def per_process(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gave when this Python worker first asked for ``key``.

    Functions reach the workers with their module's code, so module variables start anew with
    each task; what is costly to load is kept in a module of its own.
    """
    held = sys.modules.setdefault("runlens_worker_state", types.ModuleType("runlens_worker_state"))
    if key not in held.__dict__:
        held.__dict__[key] = make()
    return held.__dict__[key]
