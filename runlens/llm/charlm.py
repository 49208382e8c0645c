"""Character models: n-grams as packed integers, counted by Spark over all texts.

A character is a code of 9 bits: 0 for anything that is no letter (runs count once), the code
point itself below U+0180, a hash into the rest above. An n-gram of up to 7 codes fits into a long,
newest character in the lowest bits, so its context is a shift and its suffix a mask. Each text is
preceded by zeros that fill the first context.

A model stores each order as a sorted array of n-gram hashes with one interpolated log probability
per label, and its contexts with their back-off logs; it is built where all counts fit into one
place. Larger ones stay tables in Spark, whose joins give the same log probabilities.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import as_texts, per_process, slices
from runlens.session import written

BITS = 9
CODES = 1 << BITS
# A task hands on its counts when it holds so many n-grams.
HELD_GRAMS = 2_000_000
# Text whose n-grams are formed together: some hundred bytes are held for each of its characters.
GRAM_BYTES = 1 << 19


def _letter_codes() -> np.ndarray:
    """Codes of the first 65,536 code points."""
    out = np.zeros(1 << 16, np.int64)
    for c in range(1 << 16):
        if unicodedata.category(chr(c))[0] in "LM":
            out[c] = c if c < 0x180 else _hashed(c)
    return out


def _hashed(c: int) -> int:
    return 0x180 + (c * 2654435761 >> 8) % (CODES - 0x180)


def letter_codes(texts: list[str]) -> np.ndarray:
    """The codes of all characters of the texts, one after another."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    table = per_process("letter codes", _letter_codes)
    codes = table[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        codes[high] = [
            _hashed(int(c)) if unicodedata.category(chr(c))[0] in "LM" else 0 for c in points[high]
        ]
    return codes


def any_codes(texts: list[str]) -> np.ndarray:
    """Codes for text in which every character counts, as in URLs; 0 stays free."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(points < 0x180, np.maximum(points, 1), 0x180 + (points * 2654435761 >> 8) % (CODES - 0x180))


def grams(texts: list[str], order: int, codes_of=letter_codes) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``order`` that end at each code of the texts, and how many each text has."""
    codes = codes_of(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    before = np.concatenate([[0], codes[:-1]]) if len(codes) else codes
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    before[starts[lengths > 0]] = 0
    keep = (codes > 0) | (before > 0)
    sums = np.concatenate([[0], np.cumsum(keep)])
    counts = sums[starts + lengths] - sums[starts]
    text_no = np.repeat(np.arange(len(texts)), counts)
    pad = order - 1
    at = np.arange(int(counts.sum())) + (text_no + 1) * pad
    laid = np.zeros(len(at) + len(texts) * pad, np.int64)
    laid[at] = codes[keep]
    key = np.zeros(len(at), np.int64)
    for k in range(order):
        key |= laid[at - k] << (BITS * k)
    return key, counts


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else by
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count_grams(texts: DataFrame, order: int, codes_of=letter_codes, lower: bool = True) -> DataFrame:
    """(label, gram, n) over all rows of (label string, text string), neither of them null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merged() -> int:
            for label, parts in held.items():
                held[label] = [summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
            return sum(len(parts[0][0]) for parts in held.values())

        def flush():
            merged()
            for label, ((keys, counts),) in held.items():
                for i in range(0, len(keys), 1 << 18):
                    piece = slice(i, i + (1 << 18))
                    yield pa.record_batch(
                        {
                            "label": pa.array([label] * len(keys[piece])),
                            "gram": pa.array(keys[piece]),
                            "n": pa.array(counts[piece].astype(np.int64)),
                        }
                    )
            held.clear()

        for batch in slices(batches, most=GRAM_BYTES):
            labels = np.array(batch.column("label").to_pylist(), object)
            rows = np.array(as_texts(batch.column("text").cast(pa.binary())).to_pylist(), object)
            for label in set(labels):
                mine = [t.lower() if lower else t for t in rows[labels == label]]
                key, _ = grams(mine, order, codes_of)
                found = np.unique(key, return_counts=True)
                held.setdefault(label, []).append(found)
                size += len(found[0])
            if size > HELD_GRAMS:
                size = merged()
                if size > HELD_GRAMS // 2:
                    yield from flush()
                    size = 0
        yield from flush()

    counted = texts.select("label", "text").mapInArrow(run, "label string, gram long, n long")
    return counted.groupBy("label", "gram").agg(F.sum("n").alias("n"))


def suffix(gram: Column, order: int) -> Column:
    """The n-gram without its oldest character."""
    return gram.bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))


def all_orders(top: DataFrame, order: int, counted: Column) -> DataFrame:
    """(label, gram, n, level) of every order; ``counted`` makes each out of the one above."""
    levels, lower = top.withColumn("level", F.lit(order)), top
    for n in range(order - 1, 0, -1):
        lower = lower.groupBy("label", suffix(F.col("gram"), n + 1).alias("gram")).agg(counted.alias("n"))
        levels = levels.unionByName(lower.withColumn("level", F.lit(n)))
    return written(levels, "gram-levels")


def joined_logs(wanted: DataFrame, levels: DataFrame, order: int, smoothing: Callable) -> DataFrame:
    """(label, gram, logp) of the distinct (label, gram) of ``wanted``, out of all counts.

    What ``build`` and ``_logs`` work out in arrays, by joins on the n-gram and on its context.
    ``smoothing(n, total, types, once, twice)`` gives an n-gram's own probability and the mass its
    context leaves to the lower order; once and twice are the n-grams of the label and order with
    these counts. The broadcast has a row per label.
    """
    low = None
    for n in range(1, order + 1):
        context = F.shiftright("gram", BITS).alias("context")
        here = levels.filter(F.col("level") == n).select("label", "gram", "n", context)
        few = here.groupBy("label").agg(
            F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")
        )
        sums = here.groupBy("label", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
        asked = wanted.select("label", suffix(F.col("gram"), n + 1).alias("gram")).distinct()
        found = (
            asked.select("label", "gram", context, suffix(F.col("gram"), n).alias("rest"))
            .join(here.drop("context"), ["label", "gram"], "left")
            .join(sums.join(F.broadcast(few), "label"), ["label", "context"], "left")
        )
        if low is None:
            found = found.withColumn("low", F.lit(1 / CODES))
        else:
            found = found.join(low, ["label", "rest"])
        own, left = smoothing(*(F.col(c) for c in ("n", "total", "types", "once", "twice")))
        p = F.coalesce(own, F.lit(0.0)) + F.coalesce(left, F.lit(1.0)) * F.col("low")
        low = written(found.select("label", F.col("gram").alias("rest"), p.alias("low")), "gram-logs")
    return low.select("label", F.col("rest").alias("gram"), F.log("low").alias("logp"))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text in joins."""
    return F.unhex(F.md5(text.cast("binary")))


def joined_scores(
    texts: DataFrame, levels: DataFrame, order: int, smoothing: Callable, codes_of: Callable, clean: Callable
) -> DataFrame:
    """(key, label, logp, chars) per distinct text of (text): mean log probability of a character.

    ``clean`` is applied to each text, None included; texts without a character give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=GRAM_BYTES):
            rows = [clean(t) for t in as_texts(batch.column("text").cast(pa.binary())).to_pylist()]
            key, counts = grams(rows, order, codes_of)
            found = [np.unique(k, return_counts=True) for k in np.split(key, np.cumsum(counts)[:-1])]
            number = np.repeat(np.arange(len(rows)), [len(k) for k, _ in found])
            yield pa.record_batch(
                {
                    "key": batch.column("key").take(pa.array(number)),
                    "gram": pa.array(np.concatenate([k for k, _ in found])),
                    "n": pa.array(np.concatenate([n for _, n in found]).astype(np.int64)),
                    "chars": pa.array(counts[number]),
                }
            )

    keyed = texts.select(text_key(F.col("text")).alias("key"), "text")
    held = written(keyed.mapInArrow(run, "key binary, gram long, n long, chars long"), "text-grams")
    wanted = held.select("gram").distinct().crossJoin(F.broadcast(levels.select("label").distinct()))
    logs = joined_logs(wanted, levels, order, smoothing)
    # copies of a text add to both sums
    mean = F.sum(F.col("n") * F.col("logp")) / F.sum("n")
    return held.join(logs, "gram").groupBy("key", "label").agg(mean.alias("logp"), F.max("chars").alias("chars"))


@dataclass
class Order:
    """N-grams of one order, sorted, with their log probabilities; contexts with back-off logs."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


@dataclass
class Model:
    labels: list[str]
    orders: list[Order]
    floor: np.ndarray  # log probability of any code below order 1
    expected: np.ndarray  # cross-entropy per character in learning texts
    spread: np.ndarray  # standard deviation of a character's log probability

    def logs_of(self, texts: list[str], codes_of: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text under each label, and the characters it covers."""
        key, counts = grams(texts, len(self.orders), codes_of)
        out = np.zeros((len(texts), len(self.labels)))
        some = np.flatnonzero(counts)
        if len(some):
            starts = np.cumsum(counts)[some] - counts[some]
            each = _logs(self.orders, self.floor, key, len(self.orders))
            out[some] = np.add.reduceat(each, starts, axis=0, dtype=np.float64)
        return out, counts


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the wanted hashes in a sorted array, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _logs(orders: list[Order], floor: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Log probability of each n-gram's newest character, one column per label.

    What an order does not hold comes from the next lower one with the context's back-off.
    """
    if n == 0:
        return np.broadcast_to(floor, (len(keys), len(floor)))
    order = orders[n - 1]
    at, there = _find(order.keys, keys)
    out = order.logp[at] if len(order.keys) else np.zeros((len(keys), len(floor)), np.float32)
    missing = np.flatnonzero(~there)
    if len(missing):
        rest = keys[missing]
        low = _logs(orders, floor, rest & ((1 << (BITS * (n - 1))) - 1), n - 1)
        at, known = _find(order.contexts, rest >> BITS)
        out[missing] = low
        known = np.flatnonzero(known)
        out[missing[known]] += order.backoff[at[known]]
    return out


def build(rows: pd.DataFrame, order: int, smoothing: Callable) -> Model:
    """The model of counts (label, level, gram, n).

    ``smoothing(count, cell, number, total, types, size)`` gives each n-gram's own probability and
    the mass that each (context, label) leaves to the lower order; ``cell`` is the n-gram's place
    in the flattened (context, label) tables, ``number`` its label.
    """
    labels = sorted(rows["label"].unique())
    size = len(labels)
    numbers = rows["label"].map({x: i for i, x in enumerate(labels)}).to_numpy()
    floor = np.full(size, -np.log(CODES), np.float32)
    orders: list[Order] = []
    expected, spread = np.zeros(size), np.ones(size)
    for n in range(1, order + 1):
        here = (rows["level"] == n).to_numpy()
        number, gram = numbers[here], rows["gram"].to_numpy()[here]
        count = rows["n"].to_numpy()[here].astype(np.float64)
        keys = np.unique(gram)
        contexts = np.unique(keys >> BITS)
        cell = np.searchsorted(contexts, gram >> BITS) * size + number
        total = np.bincount(cell, count, len(contexts) * size).reshape(-1, size)
        types = np.bincount(cell, minlength=len(contexts) * size).reshape(-1, size)
        own, left = smoothing(count, cell, number, total, types, size)
        low = _logs(orders, floor, keys & ((1 << (BITS * (n - 1))) - 1), n - 1)
        p = left[np.searchsorted(contexts, keys >> BITS)] * np.exp(low.astype(np.float64))
        at = np.searchsorted(keys, gram)
        p[at, number] += own
        logp = np.log(p)
        orders.append(Order(keys, logp.astype(np.float32), contexts, np.log(left).astype(np.float32)))
        if n == order:
            mine, weight = logp[at, number], np.bincount(number, count, size)
            expected = -np.bincount(number, count * mine, size) / weight
            square = np.bincount(number, count * (mine + expected[number]) ** 2, size)
            spread = np.sqrt(square / weight)
    return Model(labels, orders, floor, expected, spread)
