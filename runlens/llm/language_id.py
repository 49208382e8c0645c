"""Language identification by interpolated Kneser-Ney character models.

Spark counts the highest-order n-grams per language over all learning documents; each lower order
is counted by its distinct continuations, out of the order above. All counts enter the model. While
they fit into one place, each order is a sorted array of n-gram hashes with one log probability per
language, which is broadcast; beyond that the counts stay tables in Spark, and the n-grams of the
texts are joined with them. A text's score in a language is its cross-entropy per character, and
the lowest wins.

A prediction is rejected when the cross-entropy exceeds what is expected of the winning language for
that length. The texts are halved by their hash for that: each half's characters are scored by the
counts of the other half, so n-grams that a model has not seen enter the expectation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runlens.llm.charlm import (
    GRAM_BYTES, Model, _logs, all_orders, build, count_grams, joined_logs, joined_scores, letter_codes,
    text_key,
)
from runlens.llm.common import as_texts, broadcast_if_small, fresh, share, slices
from runlens.session import written

ORDER = 5
# Log probabilities that a model in arrays may hold: languages times n-grams of all orders.
CELLS = 1 << 23
MAX_LANGUAGES = 1000
UNKNOWN = "und"
# Characters that count towards the confidence; longer texts are no surer.
SURE_CHARS = 64


def kneser_ney(count, cell, number, total, types, size):
    """Absolute discounts, one per language, spread over the next lower order."""
    once = np.bincount(number[count == 1], minlength=size)
    twice = np.bincount(number[count == 2], minlength=size)
    discount = np.clip(once / np.maximum(once + 2.0 * twice, 1), 0.1, 0.95)
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(total > 0, discount * types / total, 1.0)
    return (count - discount[number]).clip(0) / total.ravel()[cell], left


def kneser_ney_columns(n, total, types, once, twice):
    """The same in Spark."""
    discount = F.greatest(F.lit(0.1), F.least(F.lit(0.95), once / F.greatest(once + 2 * twice, F.lit(1))))
    return F.greatest(n - discount, F.lit(0.0)) / total, discount * types / total


@dataclass
class Tables:
    """A model whose counts (label, gram, n, level) stay in Spark."""

    levels: DataFrame
    order: int
    expected: DataFrame  # (label, expected, spread), a row per language


def _sums(grams: DataFrame, logs: DataFrame) -> DataFrame:
    """(label, weight, total, square) of the log probabilities of (label, gram, n)."""
    log = F.col("logp")
    return (
        grams.join(logs, ["label", "gram"])
        .groupBy("label")
        .agg(
            F.sum("n").cast("double").alias("weight"),
            F.sum(F.col("n") * log).alias("total"),
            F.sum(F.col("n") * log * log).alias("square"),
        )
    )


def _array_sums(grams: pd.DataFrame, model: Model) -> pd.DataFrame:
    """The same for a model in arrays."""
    number = grams["label"].map({x: i for i, x in enumerate(model.labels)}).to_numpy()
    keys, at = np.unique(grams["gram"].to_numpy(), return_inverse=True)
    logs = _logs(model.orders, model.floor, keys, len(model.orders))[at, number].astype(np.float64)
    n = grams["n"].to_numpy().astype(np.float64)
    sums = pd.DataFrame({"label": grams["label"], "weight": n, "total": n * logs, "square": n * logs**2})
    return sums.groupby("label", as_index=False).sum()


def _per_char(sums: pd.DataFrame) -> pd.DataFrame:
    """Cross-entropy of a character and its deviation, a row (expected, spread) per label."""
    of = sums.groupby("label")[["weight", "total", "square"]].sum()
    mean = of["total"] / of["weight"]
    spread = np.sqrt((of["square"] / of["weight"] - mean**2).clip(lower=0))
    return pd.DataFrame({"expected": -mean, "spread": spread})


def learn(texts: DataFrame, *, order: int = ORDER, cells: int = CELLS) -> Model | Tables | None:
    """A model of the rows (label, text); rows with a null in either are left out.

    None when there is nothing to learn from. With more than ``cells`` numbers it is one of tables.
    A language whose texts all lie in one half has its expectation from its own counts.
    """
    given = texts.filter(F.col("label").isNotNull() & F.col("text").isNotNull())
    side = F.pmod(F.xxhash64("text"), F.lit(2)).cast("string")
    sided = given.select(F.concat(side, "label").alias("label"), "text")
    counted = written(count_grams(sided, order), "language-grams")
    name = F.expr("substring(label, 2)").alias("label")
    halves = [counted.filter(F.col("label").startswith(x)).select(name, "gram", "n") for x in "01"]
    top = counted.groupBy(name, "gram").agg(F.sum("n").alias("n"))
    languages = top.select("label").distinct().limit(MAX_LANGUAGES + 1).count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return None
    levels = all_orders(top, order, F.count(F.lit(1)))
    small = levels.count() * languages <= cells

    def array_model(counts: DataFrame) -> Model:
        return build(counts.select("label", "level", "gram", "n").toPandas(), order, kneser_ney)

    sums = []
    for half, other in (halves, halves[::-1]):
        known = [r["label"] for r in other.select("label").distinct().collect()]
        mine = half.filter(F.col("label").isin(known))
        if not known or mine.isEmpty():
            continue
        rest = all_orders(other, order, F.count(F.lit(1)))
        if small:
            sums.append(_array_sums(mine.toPandas(), array_model(rest)))
        else:
            logs = joined_logs(mine.select("label", "gram"), rest, order, kneser_ney_columns)
            sums.append(_sums(mine, logs).toPandas())
    found = [_per_char(pd.concat(sums))] if sums else []
    if small:
        model = array_model(levels)
        own = pd.DataFrame({"expected": model.expected, "spread": model.spread}, index=model.labels)
    else:
        logs = joined_logs(top.select("label", "gram"), levels, order, kneser_ney_columns)
        own = _per_char(_sums(top, logs).toPandas())
    left_out = pd.concat([*found, own])
    limits = left_out[~left_out.index.duplicated()]
    if small:
        model.expected, model.spread = limits.loc[model.labels].to_numpy().T
        return model
    rows = [(str(x), float(e), float(d)) for x, e, d in limits.itertuples()]
    expected = top.sparkSession.createDataFrame(rows, "label string, expected double, spread double")
    return Tables(levels, order, expected)


def predictions(
    texts: list[str | None], model: Model | None, margin: float, deviations: float
) -> tuple[list[str], list[float], list[bool]]:
    """Language, confidence and rejection of each text."""
    names = [UNKNOWN] * len(texts)
    scores, rejected = [0.0] * len(texts), [True] * len(texts)
    lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if model is None or not lettered:
        return names, scores, rejected
    logs, chars = model.logs_of([texts[i].lower() for i in lettered], letter_codes)
    entropy = -logs / chars[:, None]
    best = entropy.argmin(1)
    lowest = entropy.min(1)
    weight = np.minimum(chars, SURE_CHARS)[:, None]
    sure = 1 / np.exp(-(entropy - lowest[:, None]) * weight).sum(1)
    allowed = model.expected[best] + margin + deviations * model.spread[best] / np.sqrt(chars)
    for i, b, s, bad in zip(lettered, best, sure, lowest > allowed, strict=True):
        names[i], scores[i], rejected[i] = model.labels[b], float(s), bool(bad)
    return names, scores, rejected


def _cleaned(text: str | None) -> str:
    return text.lower() if text and any(map(str.isalpha, text)) else ""


def _joined(docs: DataFrame, model: Tables, text: Column, margin: float, deviations: float, new: list[str]) -> DataFrame:
    """``docs`` with what ``predictions`` gives, by joins with a model of tables."""
    scores = joined_scores(
        docs.select(text.alias("text")), model.levels, model.order, kneser_ney_columns, letter_codes, _cleaned
    )
    # sums in another order must not decide a tie
    entropy = F.round(-F.col("logp"), 9)
    best = scores.groupBy("key").agg(
        F.min(F.struct(entropy.alias("entropy"), "label")).alias("best"),
        F.collect_list(entropy).alias("each"),  # a number per language
        F.max("chars").alias("chars"),
    )
    lowest, chars = F.col("best.entropy"), F.col("chars")
    others = F.transform("each", lambda e: F.exp(-(e - lowest) * F.least(chars, F.lit(SURE_CHARS))))
    sure = 1 / F.aggregate(others, F.lit(0.0), lambda a, b: a + b)
    allowed = F.col("expected") + margin + deviations * F.col("spread") / F.sqrt(chars)
    name, score, bad = new
    key = fresh(docs, "key")
    found = written(
        best.join(F.broadcast(model.expected), F.col("best.label") == F.col("label")).select(
            F.col("key").alias(key), F.col("label").alias(name), sure.alias(score), (lowest > allowed).alias(bad)
        ),
        "languages",
    )
    out = docs.withColumn(key, text_key(text)).join(broadcast_if_small(found), key, "left")
    other = {name: F.lit(UNKNOWN), score: F.lit(0.0), bad: F.lit(True)}
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        *[F.coalesce(F.col(f"`{c}`"), x).alias(c) for c, x in other.items()],
    )


def identify(
    docs: DataFrame,
    learn_from: Column,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    margin: float = 1.0,
    deviations: float = 6.0,
    prefix: str = "",
    cells: int = CELLS,
) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected, each name after ``prefix``.

    The model learns from the text and non-null language of the rows for which ``learn_from``
    holds; only the text enters a prediction. A text that is null or has no letter, and every text
    when there is nothing to learn from, gives ``und`` with score 0 and is rejected. Otherwise the
    language with the lowest cross-entropy per character wins (ties: the first by name), and the
    row is rejected when that exceeds the expected one by ``margin`` nats and ``deviations``
    standard deviations for its length. Repeated rows get the same answer; an empty table gives
    no rows. Input columns stay as they are: where one has an output's name the call fails, and
    ``prefix`` avoids the clash. A text is scored whole, however long; in the array form, bytes that
    are no UTF-8 count as U+FFFD, no letter. A model of more than ``cells`` numbers is not broadcast
    but joined, with the same answers.
    """
    label, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`")
    new = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}rejected"]
    clash = sorted({c.lower() for c in docs.columns}.intersection(n.lower() for n in new))
    if clash:
        raise ValueError(f"columns {clash} are outputs too; choose a prefix")
    model = learn(docs.filter(learn_from).select(label.alias("label"), text.alias("text")), cells=cells)
    if isinstance(model, Tables):
        return _joined(docs, model, text, margin, deviations, new)
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared()
        for batch in slices(batches, text_col, GRAM_BYTES):
            column = batch.column(batch.schema.get_field_index(text_col))
            texts = as_texts(column.cast(pa.binary())).to_pylist()
            names, scores, rejected = predictions(texts, held, margin, deviations)
            added = [pa.array(names), pa.array(scores), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], [*batch.schema.names, *new]
            )

    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(new, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def kept(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """The documents not rejected, with all their columns and the language found.

    Learns from all rows that have a language.
    """
    prefix = fresh(docs, "found_")
    found = identify(
        docs, F.lit(True), text_col=text_col, lang_col=lang_col, prefix=prefix, **limits
    ).filter(~F.col(f"{prefix}rejected"))
    kind = docs.schema[lang_col].dataType
    return found.withColumn(lang_col, F.col(f"{prefix}lang_pred").cast(kind)).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
