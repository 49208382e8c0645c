"""Near-duplicate embeddings: sorted projection passes.

Every pass draws 64 random hyperplanes. The signs of a vector's projections, one after another,
are its key, and a pass sorts all vectors by (label, key): the closer two vectors are, the longer
the prefix they share and the nearer they stand. Each vector is compared with the next ``WINDOW``
in the order, in double precision, and what is similar enough becomes one component, over all passes.

All passes are sorted in one range partitioning. A task walks its rows in tiles; the first and
last rows of each task, which have neighbours in other tasks, are written and met once more by rank. A tile
gives at most one row per vector (the vector and its tile's component), however many pairs it
holds, so a group with a third of all rows costs as much as any others.

Equal vectors are one row from the start, with their number. The links themselves are counted
inside the components, in blocks: each pair of blocks of a component is one small matrix product, so a large
component spreads over many tasks and no pair is ever written.

The number of passes follows the size: a pair at the threshold, in the largest label, is a window
apart in some pass with probability ``RECALL`` at least, at any number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import read_columns, slices
from runlens.llm.near_dedup import connected
from runlens.session import written

MIN_COSINE = 0.93
# Following rows of the order that a vector is compared with.
WINDOW = 64
BITS = 64
# Probability that a pair at the threshold is compared, by which the passes are chosen.
RECALL = 0.999
# Vectors of a component in a block.
BLOCK = 1024
TILE = 256


def passes_for(vectors: int, cosine: float, window: int, recall: float) -> int:
    """Passes needed for ``vectors`` in one label: a prefix that ``window`` vectors share, of
    signs that agree with probability 1 - angle / pi each, has to agree in one of them."""
    agree = 1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    prefix = max(0.0, math.log2(max(vectors, 1) / window))
    hit = agree ** (prefix + 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit))) if hit < 1 else 1


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Unit vectors in double precision of a list column whose lists are equally long."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(passes: int) -> Callable:
    """(group, pass, key, cid, v) of every vector and pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "v"):
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes).tolist():
                rows = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                x = _matrix(rows.column("v"))
                for number in range(passes):
                    planes = np.random.default_rng((17, number, dim)).standard_normal((dim, BITS))
                    bits = np.packbits(x @ planes > 0, axis=1)
                    key = bits.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column("grp"),
                            pa.array(np.full(len(x), number, np.int32)),
                            pa.array(key.view(np.int64)),
                            rows.column("cid"),
                            rows.column("v"),
                        ],
                        ["grp", "pass", "key", "cid", "v"],
                    )

    return run


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is connected with by the pairs (a, b)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if np.array_equal(low, before):
            return low


def _compared(
    order: np.ndarray, cid: np.ndarray, x: np.ndarray, fits: np.ndarray, cosine: float, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """(cid, smallest cid of its component) of rows connected by similar pairs in the window.

    ``order`` ascends and tells how far rows are apart; ``fits`` is equal for rows that may be
    compared.
    """
    left, right = [], []
    for start in range(0, len(x), TILE):
        stop = min(start + TILE, len(x))
        reach = int(np.searchsorted(order, order[stop - 1] + window, "right"))
        near = x[start:stop] @ x[start:reach].T >= cosine
        apart = order[None, start:reach] - order[start:stop, None]
        near &= (apart > 0) & (apart <= window) & (fits[None, start:reach] == fits[start:stop, None])
        a, b = np.nonzero(near)
        if len(a):
            low = _least(reach - start, a, b)
            moved = np.flatnonzero(low != np.arange(reach - start))
            left.append(cid[start + moved])
            right.append(cid[start + low[moved]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


LINKS = "a long, b long, part int, place long, grp long, pass int, cid long"


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """The columns given, the others null."""
    n = len(next(iter(columns.values())))
    held = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}
    arrays = [held[f.name].cast(f.type) if f.name in held else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _fits(grp: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Numbers that differ between neighbouring groups and passes of sorted rows."""
    new = np.ones(len(grp), np.int64)
    new[1:] = (grp[1:] != grp[:-1]) | (number[1:] != number[:-1])
    return np.cumsum(new)


def _walk(cosine: float, window: int, kind: pa.DataType):
    """Compares sorted rows within a task; gives connected rows and the rows near both ends.

    The last ``window`` rows are kept back and stand before the next batch's, so memory is bounded by a batch.
    """
    names = ["a", "b", "part", "place", "grp", "pass", "cid"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    schema = pa.schema([*zip(names, types, strict=True), ("v", kind)])

    def edge(part: int, first: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        own = {c: rows.column(c) for c in ("grp", "pass", "cid", "v")}
        n = rows.num_rows
        return _batch(schema, part=np.full(n, part), place=np.arange(first, first + n), **own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, held = TaskContext.get().partitionId(), 0, None
        for batch in slices(batches, "v"):
            if not batch.num_rows:
                continue
            if seen < window:
                yield edge(part, seen, batch.slice(0, window - seen))
            both = pa.Table.from_batches([held, batch] if held else [batch]).combine_chunks().to_batches()[0]
            grp, number = both.column("grp").to_numpy(), both.column("pass").to_numpy()
            a, b = _walked(both, _fits(grp, number), cosine, window)
            if len(a):
                yield _batch(schema, a=a, b=b)
            seen += batch.num_rows
            held = both.slice(max(0, both.num_rows - window))
        if held is not None and seen > window:  # rows that aren't among the first ones
            last = held.slice(max(0, held.num_rows - (seen - window)))
            yield edge(part, seen - last.num_rows, last)

    return run


def _walked(rows: pa.RecordBatch, fits: np.ndarray, cosine: float, window: int):
    """``_compared`` for rows side by side, by runs of vectors of one length."""
    order = np.arange(rows.num_rows)
    edges = np.flatnonzero(np.diff(fits)) + 1
    column, cid = rows.column("v"), rows.column("cid").to_numpy()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    cut = [0, *[e for e in edges.tolist() if lengths[e] != lengths[e - 1]], rows.num_rows]
    left, right = [], []
    for lo, hi in zip(cut, cut[1:], strict=False):
        x = _matrix(column.slice(lo, hi - lo))
        a, b = _compared(order[lo:hi], cid[lo:hi], x, fits[lo:hi], cosine, window)
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _groups(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[pa.Table]:
    """Whole groups of a stream of rows sorted by the columns ``key``."""
    parts: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in key], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(edges, edges[1:], strict=False) if len(keys) else ():
            if parts and (keys[lo] != last).any():
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(batch.slice(lo, hi - lo))
            last = keys[lo]
    if parts:
        yield pa.Table.from_batches(parts)


def _across(cosine: float, window: int):
    """Compares the edge rows of two neighbouring buckets of ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "bucket"):
            group = group.sort_by("rank")
            grp, number = group.column("grp").to_numpy(), group.column("pass").to_numpy()
            rank, fits = group.column("rank").to_numpy(), _fits(grp, number)
            column, cid = group.column("v").combine_chunks(), group.column("cid").to_numpy()
            for f in np.unique(fits).tolist():
                lo, hi = np.searchsorted(fits, [f, f + 1])
                if hi - lo > 1:
                    x = _matrix(column.slice(lo, hi - lo))
                    a, b = _compared(rank[lo:hi], cid[lo:hi], x, fits[lo:hi], cosine, window)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _counted(cosine: float):
    """(cid, links) of the rows of two blocks of a component: for each row, the number of vectors
    of the other block that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, links, held = [], [], 0
        for group in _groups(batches, "comp", "one", "two"):
            x = _matrix(group.column("v").combine_chunks())
            cid, weight = group.column("cid").to_numpy(), group.column("weight").to_numpy()
            low, high = (np.flatnonzero(group.column(c).to_numpy()) for c in ("low", "high"))
            near = x[low] @ x[high].T >= cosine
            if len(low) and len(high):
                if low[0] == high[0]:  # a block with itself
                    np.fill_diagonal(near, False)
                    cids.append(cid[low])
                    links.append(near @ weight[high])
                else:
                    cids += [cid[low], cid[high]]
                    links += [near @ weight[high], weight[low] @ near]
                held += len(cid)
            if held > 20_000:
                yield pa.record_batch({"cid": np.concatenate(cids), "links": np.concatenate(links)})
                cids, links, held = [], [], 0
        if cids:
            yield pa.record_batch({"cid": np.concatenate(cids), "links": np.concatenate(links)})

    return run


def _links(classes: DataFrame, components: DataFrame, cosine: float) -> DataFrame:
    """(cid, links): the rows of other vectors that each one is similar enough to."""
    sizes = components.groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = (
        classes.select("cid", "v", "weight")
        .join(components, "cid")
        .join(sizes, "comp")
        .select("cid", "comp", "v", "weight", blocks.alias("blocks"))
        .withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = placed.select("cid", "comp", "v", "weight", "block", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    pair = ["comp", "one", "two"]
    keyed = met.select(
        "comp",
        low.alias("one"),
        high.alias("two"),
        "cid",
        "weight",
        (F.col("block") == low).alias("low"),
        (F.col("block") == high).alias("high"),
        "v",
    )
    together = keyed.repartition(*pair).sortWithinPartitions(*pair)
    return (
        together.mapInArrow(_counted(cosine), "cid long, links long")
        .groupBy("cid")
        .agg(F.sum("links").alias("links"))
    )


def _usable(v: Column) -> Column:
    """Vectors with a direction: no null or non-finite components, and not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def members(
    vectors: DataFrame,
    *,
    min_cosine: float = MIN_COSINE,
    window: int = WINDOW,
    recall: float = RECALL,
    passes: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors are linked when their labels are equal and not null, they are equally long, and their
    cosine in double precision is ``min_cosine`` or more. ``n_links`` counts the other rows
    linked with a row, ``component_id`` is the smallest id reachable, null ids left aside; rows
    with that id are kept, as are rows of groups without any id. Vectors that are null, empty,
    zero or hold null or non-finite components are linked with nothing.

    Candidates come from ``passes`` sorted passes, or as many as ``recall`` needs at the number of
    vectors; links between the vectors of one component are all counted. Repeated rows are other
    rows with an equal vector. Vectors of any length fit as long as a window of them fits a task.
    Ties in the order are settled by the vectors' numbers and change no link. An empty table gives
    no rows; other input columns are ignored, whatever their names.
    """
    rows = read_columns(vectors, id_col, vector_col, label_col).toDF("id", "v", "label")
    rows = rows.withColumn("id", F.col("id").cast("long"))
    usable = F.col("label").isNotNull() & _usable(F.col("v"))
    # min() and count() have fixed-width buffers and are combined per task
    classes = written(
        rows.filter(usable)
        .groupBy("label", "v")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("weight"))
        .withColumns({"cid": F.monotonically_increasing_id(), "dim": F.size("v")}),
        "vector-classes",
    )
    grp = F.xxhash64("label", "dim")
    if passes is None:
        largest = classes.groupBy(grp).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        passes = passes_for(largest or 1, min_cosine, window, recall)
    v_type = rows.schema["v"].dataType.simpleString()
    kind = pa.list_(pa.float32() if v_type == "array<float>" else pa.float64())
    if v_type not in ("array<float>", "array<double>"):
        raise ValueError("vectors are array<float> or array<double>")
    keyed = classes.select(grp.alias("grp"), "cid", "dim", "v").mapInArrow(
        _keys(passes), f"grp long, pass int, key long, cid long, v {v_type}"
    )
    by = ["pass", "grp", "key", "cid"]
    ordered = keyed.repartitionByRange(*by).sortWithinPartitions(*by)
    walked = written(ordered.mapInArrow(_walk(min_cosine, window, kind), f"{LINKS}, v {v_type}"), "vector-walk")

    edges = walked.filter("part is not null")
    # rows of a task before its first edge row are counted by the largest place
    sizes = edges.groupBy("part").agg((F.max("place") + 1).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("place")
    bucket = F.expr(f"rank div {window}")
    met = (
        edges.join(base, "part")
        .select(rank.alias("rank"), "grp", "pass", "cid", "v")
        .select("*", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    )
    crossing = (
        met.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_across(min_cosine, window), "a long, b long")
    )
    pairs = walked.filter("a is not null").select(F.col("a").alias("x"), F.col("b").alias("y"))
    components = written(
        connected(pairs.unionByName(crossing.toDF("x", "y"))).select(F.col("node").alias("cid"), "comp"),
        "vector-components",
    )

    links = _links(classes, components, min_cosine)
    first = (
        components.join(classes.select("cid", "first"), "cid")
        .groupBy("comp")
        .agg(F.min("first").alias("component"))
    )
    of_class = (
        classes.select("cid", "label", "v", "weight", "first")
        .join(components.join(first, "comp").select("cid", "component"), "cid", "left")
        .join(links, "cid", "left")
        .select(
            "label",
            "v",
            F.coalesce("component", "first").alias("component"),
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    key = F.when(usable, F.col("label"))
    found = rows.withColumn("label", key).join(of_class, ["label", "v"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component"))
    return found.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )
