"""Lines found in many documents, dropped everywhere.

Line keys become 128-bit hashes. (hash, document) is range-partitioned and sorted, with the
position as the last key, and each task streams its rows once: the first row of a document within
a run counts, and as soon as a run has enough documents its rows are marked. A line that a third
of all rows share simply spans many ranges. Only the first and the last run of a task can go on
elsewhere; their counts (two rows per task) are added up and settle what the task left open. What
comes back is a compressed keep bitmap per document, no text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import slices
from runlens.session import written

_ROWS = "h1 long, h2 long, k1 long, k2 long, pos int"
_FOUND = "kind int, h1 long, h2 long, k1 long, k2 long, pos int, n long"
_DROP, _COUNT, _OPEN = 0, 1, 2


def _document_key(id_col: str, text_col: str) -> dict[str, Column]:
    """A document is its id and text: repeated rows count once and get the same bitmap."""
    doc_id = F.col(f"`{id_col}`")
    return {
        "k1": F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")),
        "k2": F.xxhash64(F.col(f"`{text_col}`"), doc_id.isNull()),
    }


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return line.strip().lower()


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, ks, positions = [], ([], []), []
            columns = (batch.column(name).to_pylist() for name in ("k1", "k2", "text"))
            for k1, k2, text in zip(*columns, strict=True):
                for pos, line in enumerate((text or "").encode().split(b"\n")):
                    key = line_key(line)
                    if len(key) < min_chars or (min_chars > 1 and len(key.decode()) < min_chars):
                        continue
                    digests.append(hashlib.blake2b(key, digest_size=16).digest())
                    ks[0].append(k1)
                    ks[1].append(k2)
                    positions.append(pos)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.record_batch(
                {
                    "h1": pa.array(np.ascontiguousarray(h[:, 0])),
                    "h2": pa.array(np.ascontiguousarray(h[:, 1])),
                    "k1": pa.array(ks[0], pa.int64()),
                    "k2": pa.array(ks[1], pa.int64()),
                    "pos": pa.array(positions, pa.int32()),
                }
            )

    return run


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True at rows that differ from the row before (row 0: True)."""
    out = np.ones(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def _stream_runs(min_docs: int):
    """Rows sorted by hash, document and position to marks, open rows and edge counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the run at the end of what has been read

        def rows(kind: int, a: np.ndarray, n: int = 0) -> pa.RecordBatch:
            size = a.shape[1]
            columns = [pa.array(np.full(size, kind, np.int32))]
            columns += [pa.array(np.ascontiguousarray(a[i])) for i in range(4)]
            columns += [pa.array(a[4].astype(np.int32)), pa.array(np.full(size, n, np.int64))]
            names = ["kind", "h1", "h2", "k1", "k2", "pos", "n"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def extend(a: np.ndarray) -> list[pa.RecordBatch]:
            new = int(_changes(a[2], a[3]).sum())
            if held["last"] == (a[2, 0], a[3, 0]):
                new -= 1
            held["n"] += new
            held["last"] = (a[2, -1], a[3, -1])
            if held["n"] < min_docs:
                held["rows"].append(a)
                return []
            ready, held["rows"] = [*held["rows"], a], []
            return [rows(_DROP, x) for x in ready]

        def close(edge: bool) -> list[pa.RecordBatch]:
            if not edge:
                return []
            own = np.array([[held["hash"][0]], [held["hash"][1]], [0], [0], [0]], np.int64)
            return [rows(_OPEN, x) for x in held["rows"]] + [rows(_COUNT, own, held["n"])]

        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)])
            starts = np.flatnonzero(_changes(a[0], a[1]))
            ends = np.append(starts[1:], a.shape[1])
            # runs that begin and end inside the batch are settled at once
            docs = np.add.reduceat(_changes(a[0], a[1], a[2], a[3]).astype(np.int64), starts)
            whole = np.zeros(len(starts), bool)
            whole[1:-1] = docs[1:-1] >= min_docs
            marked = a[:, np.repeat(whole, ends - starts)]
            if marked.shape[1]:
                yield rows(_DROP, marked)
            for i in sorted({0, len(starts) - 1}):
                part = a[:, starts[i] : ends[i]]
                key = (part[0, 0], part[1, 0])
                if held is None or held["hash"] != key:
                    if held is not None:
                        yield from close(held["first"])
                    held = {"hash": key, "n": 0, "last": None, "rows": [], "first": first}
                first = False
                yield from extend(part)
        if held is not None:
            yield from close(True)

    return run


def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    out = []
    for n, gone in zip(n_lines, dropped, strict=True):
        keep = np.ones(n, bool)
        if gone is not None:
            keep[np.asarray(gone, np.int64)] = False
        out.append(zlib.compress(np.packbits(keep).tobytes()))
    return pd.Series(out)


def _kept_text(text: pd.Series, n_lines: pd.Series, keep: pd.Series) -> pd.Series:
    out = []
    for t, n, bits in zip(text, n_lines, keep, strict=True):
        if t is None or bits is None:
            out.append(None)
            continue
        flags = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[: int(n)]
        out.append("\n".join(x for x, f in zip(t.split("\n"), flags, strict=True) if f))
    return pd.Series(out, dtype=object)


def keep_bitmaps(
    docs: DataFrame,
    *,
    min_docs: int = 10,
    min_chars: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per distinct (id, text): k1, k2 (its key), n_lines, n_dropped, keep.

    ``keep`` is a zlib-compressed bit per line, the highest bit of a byte first, 1 for lines that
    stay. A key of at least ``min_chars`` code points found in at least ``min_docs`` documents
    drops all its lines. A null or empty text is one empty line. Documents are told apart by id
    and text, a null id included; repeated rows count once. An empty table gives no rows.
    """
    source = docs.select(F.col(f"`{text_col}`").alias("text"), *[
        c.alias(k) for k, c in _document_key(id_col, text_col).items()
    ])
    by = ["h1", "h2", "k1", "k2"]
    lines = source.mapInArrow(_hash_lines(min_chars), _ROWS)
    ordered = lines.repartitionByRange(*by).sortWithinPartitions(*by, "pos")
    found = written(ordered.mapInArrow(_stream_runs(min_docs), _FOUND), "line-runs")
    many = (
        found.filter(F.col("kind") == _COUNT)
        .groupBy("h1", "h2")
        .agg(F.sum("n").alias("docs"))
        .filter(F.col("docs") >= min_docs)
    )
    settled = found.filter(F.col("kind") == _OPEN).join(many, ["h1", "h2"], "left_semi")
    dropped = (
        found.filter(F.col("kind") == _DROP)
        .unionByName(settled)
        .groupBy("k1", "k2")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    sizes = source.groupBy("k1", "k2").agg(
        F.max(F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("n_lines")
    )
    bitmap = F.pandas_udf(_bitmap, "binary")
    gone = F.coalesce(F.size("dropped"), F.lit(0))
    return sizes.join(dropped, ["k1", "k2"], "left").select(
        "k1",
        "k2",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(gone).cast("long").alias("n_dropped"),
        bitmap("n_lines", "dropped").alias("keep"),
    )


def apply_bitmaps(
    docs: DataFrame,
    bitmaps: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents with n_lines, n_dropped and kept_text beside their id.

    Texts go through Python only where a line is dropped.
    """
    key = {k: c.alias(f"__{k}") for k, c in _document_key(id_col, text_col).items()}
    left = docs.select(
        F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), *key.values()
    )
    kept = F.pandas_udf(_kept_text, "string")
    joined = left.join(
        bitmaps, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2"))
    )
    some = F.col("n_dropped") > 0
    cut = kept(F.when(some, F.col("__text")), F.col("n_lines"), F.when(some, F.col("keep")))
    return joined.select(
        F.col("__id").alias(id_col),
        "n_lines",
        "n_dropped",
        F.coalesce(cut, F.col("__text"), F.lit("")).alias("kept_text"),
    )
