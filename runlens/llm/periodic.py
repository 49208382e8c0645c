"""Periodic runs of words: seed and extend on diagonals.

A run is a maximal stretch of words that repeats with a period ``q`` at least four times. Its words
agree with those ``q`` places on over at least ``3 * q`` consecutive places, so for the periods from
``2**j`` to below ``2**(j+1)`` every run holds two occurrences, ``q`` apart, of a k-gram of
``k = 3 * 2**j`` words: the overlap that is guaranteed. These k-grams are the index of level ``j``; their
hashes come from those of the level below, two at a time, and only places whose shorter k-gram
occurs twice in their document are looked at again.

Each k-gram is paired with its next occurrence in the document only. That loses no run: ``k >= q``,
so an occurrence less than ``q`` further on, inside the run, would give the whole run that smaller
period. For the same reason a pair that is found has the run's smallest period as its lag. A document of n
words has at most n pairs per level. Pairs are extended both ways on the words themselves, which
settles hash collisions, and a table of how far each lag is covered suppresses repeated extensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import read_columns, slices

MIN_WORDS = 6
MIN_EXPONENT = 4
# Words of the shortest k-gram; it grows with the period.
SEED = MIN_EXPONENT - 1

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def _agreeing(x: np.ndarray, at: int, lag: int, end: int) -> int:
    """The first place from ``at`` on whose word differs from that ``lag`` on, or ``end``."""
    step = 32
    while at < end:
        stop = min(at + step, end)
        differ = x[at:stop] != x[at + lag : stop + lag]
        if differ.any():
            return at + int(differ.argmax())
        at, step = stop, step * 2
    return end


def _agreeing_before(x: np.ndarray, at: int, lag: int, end: int) -> int:
    """The first place of the agreeing ones that end before ``at``; ``end`` is the lowest."""
    step = 32
    while at > end:
        stop = max(at - step, end)
        differ = x[stop:at] != x[stop + lag : at + lag]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, step = stop, step * 2
    return end


def _pairs(x: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per level, the places of k-grams and the lags of their next occurrence, by lag and place."""
    place = np.arange(len(x))
    gram = _mixed(x.astype(np.uint64) + (doc.astype(np.uint64) << np.uint64(32)))
    one = gram
    for _ in range(SEED - 1):
        one = one[1:]
        gram = _joined(gram[: len(one)], one)
    # grams that reach into the next document hold words of both and so occur once
    k, lag, look = SEED, 1, np.arange(len(gram))
    while len(look):
        order = look[np.argsort(gram[look], kind="stable")]
        same = gram[order[1:]] == gram[order[:-1]]
        first, following = order[:-1][same], order[1:][same]
        lags = following - first
        fits = (lags >= lag) & (lags < 2 * lag)
        if fits.any():
            at, lags = place[first[fits]], lags[fits]
            by = np.lexsort((at, lags))
            yield at[by], lags[by]
        # the next level: documents and places that still have a k-gram twice
        twice = np.zeros(len(doc), bool)
        twice[first] = twice[following] = True
        alive = np.zeros(int(doc[-1]) + 1, bool)
        alive[doc[twice]] = True
        stay = alive[doc]
        padded = np.concatenate([gram, np.zeros(len(doc) - len(gram), np.uint64)])
        short = np.arange(len(doc)) >= len(gram)
        gram, doc, place, twice, short = (a[stay] for a in (padded, doc, place, twice, short))
        usable = max(0, len(gram) - k)
        cut = short[:usable] | short[k : k + usable]
        gram = _joined(gram[:usable], gram[k : k + usable])
        look = np.flatnonzero(twice[:usable] & ~cut)
        k, lag = 2 * k, 2 * lag


def find(x: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start and period.

    ``x`` has the words of all documents as numbers below 2**32, ``starts`` each document's first
    place and, last, the number of words.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(starts) - 1)]
    if not len(x):
        return found
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    covered: dict[int, int] = {}
    for places, lags in _pairs(x, doc):
        # of pairs side by side on one diagonal the first one is enough
        head = np.ones(len(places), bool)
        head[1:] = (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + 1)
        for at, lag in zip(places[head].tolist(), lags[head].tolist(), strict=True):
            if at < covered.get(lag, 0):
                continue
            d = int(doc[at])
            low, high = int(starts[d]), int(starts[d + 1])
            end = _agreeing(x, at, lag, high - lag)
            begin = _agreeing_before(x, at, lag, low)
            covered[lag] = max(end, at + 1)
            length = end + lag - begin
            if end > at and length >= max(MIN_WORDS, MIN_EXPONENT * lag):
                found[d].append((begin - low, length, lag))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [(t or b"").split() for t in batch.column("text").to_pylist()]
        starts = np.cumsum([0] + [len(t) for t in texts])
        words = pa.array([w for t in texts for w in t], pa.binary())
        numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        runs = find(numbers, starts)
        ends = pa.array(np.cumsum([0] + [len(r) for r in runs]), pa.int32())
        flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
        names = ["start", "length", "period"]
        rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names)
        yield pa.record_batch(
            {
                "id": batch.column("id"),
                "n_words": pa.array(np.diff(starts).astype(np.int64)),
                "runs": pa.ListArray.from_arrays(ends, rows),
                "collapsed": pa.array(
                    [_collapsed(t, r) for t, r in zip(texts, runs, strict=True)], pa.binary()
                ),
            }
        )


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, runs, collapsed.

    Words lie between ASCII white space and are numbered from 0. ``runs`` has (start, length,
    period) of every maximal stretch whose smallest period fits at least four times into it and
    that has six words or more, by start and period. ``collapsed`` joins the words by one space,
    without those that a run contains after its first period; without runs it is the text with
    single spaces.

    A null or blank text has no words, no runs and an empty ``collapsed``. A text is always looked
    at whole, in the task that reads it, in time n log n for n words; bytes that are no UTF-8 are
    compared as they stand. Repeated rows and null ids get a row each, an empty table gives none;
    other input columns are ignored, whatever their names.
    """
    rows = read_columns(docs, id_col, text_col).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(
        _scan, f"id {kind}, n_words long, runs {RUNS}, collapsed binary"
    )
    return found.select(
        F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed")
    )


def runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run: id, start, length, period. Documents without runs have no row."""
    return scan(docs, id_col=id_col, text_col=text_col).select(f"`{id_col}`", F.inline("runs"))


def digests(scanned: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, n_runs, the longest run's start, length, period and exponent_milli (1000 * length / period,
    rounded down), SHA-256 of the list of runs and of the collapsed text.

    Of equally long runs that with the smallest start, then period, counts; without runs its four
    columns are null. The list has a line ``start,length,period`` per run.
    """
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    key = lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))
    best = F.array_min(F.transform("runs", key))
    return scanned.withColumn("__best", best).select(
        F.col(f"`{id_col}`"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("__best.s").alias("start"),
        (-F.col("__best.n")).alias("length"),
        F.col("__best.p").alias("period"),
        F.expr("-1000 * __best.n div __best.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
