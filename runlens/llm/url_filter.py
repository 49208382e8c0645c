"""URL filter: host and path rules first, a character model ratio for all other URLs.

URLs that a rule allows and URLs that a rule blocks train one variable-order Markov model each
(Witten-Bell smoothing; a context seen too rarely gives way to a shorter one). A URL without a
rule is judged by its log-likelihood difference per character. The threshold is calibrated on all
URLs with a rule: Spark counts their scores in fine bins per verdict, and the cut with the lowest
balanced error wins. All counts enter the models, which are broadcast as arrays while they fit into
one place; beyond that the counts stay tables in Spark, and the n-grams of the URLs are joined with
them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.charlm import Model, all_orders, any_codes, build, count_grams, joined_scores, text_key
from runlens.llm.common import as_texts, ascii_lower, broadcast_if_small, read_columns, share, slices
from runlens.session import written

ORDER = 5
# Log probabilities that a model in arrays may hold, two labels together.
CELLS = 1 << 23
# A context seen less often passes on to the shorter one.
MIN_CONTEXT = 3
BINS_PER_NAT = 256
MAX_SCORE = 16

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def rule(verdict: str, place: str) -> Rule:
    """A rule from its verdict and ``host/path``."""
    host, slash, path = place.partition("/")
    return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ?, # or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _first_fit(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest ends up outermost
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def witten_bell(count, cell, number, total, types, size):
    """Mass by the number of different successors; rare contexts leave everything below."""
    used = total >= MIN_CONTEXT
    left = np.where(used, types / np.maximum(total + types, 1), 1.0)
    own = np.where(used, 1 / np.maximum(total + types, 1), 0.0)
    return count * own.ravel()[cell], left


def witten_bell_columns(n, total, types, once, twice):
    """The same in Spark."""
    used = total >= MIN_CONTEXT
    return F.when(used, n / (total + types)), F.when(used, types / (total + types))


def learn(urls: DataFrame, *, order: int = ORDER, cells: int = CELLS) -> Model | DataFrame | None:
    """A model of (label, text); None unless both verdicts are there.

    With more than ``cells`` numbers it is the table of all counts (label, gram, n, level).
    """
    top = written(count_grams(urls, order, any_codes, lower=False), "url-grams")
    if top.select("label").distinct().count() < 2:
        return None
    levels = all_orders(top, order, F.sum("n"))
    if levels.count() * 2 > cells:
        return levels
    return build(levels.select("label", "level", "gram", "n").toPandas(), order, witten_bell)


def _given(url: str | None) -> str:
    return url or ""


def _joined(urls: DataFrame, levels: DataFrame, order: int) -> DataFrame:
    """What ``_scored`` gives, by joins with all counts."""
    texts = urls.select(F.col("url").alias("text"))
    scores = joined_scores(texts, levels, order, witten_bell_columns, any_codes, _given)
    sign = F.when(F.col("label") == ALLOW, F.col("logp")).otherwise(-F.col("logp"))
    found = written(scores.groupBy("key").agg(F.sum(sign).alias("score")), "url-signs")
    return urls.withColumn("key", text_key(F.col("url"))).join(broadcast_if_small(found), "key", "left").drop("key")


def _scored(urls: DataFrame, model: Model | DataFrame | None, order: int) -> DataFrame:
    """Adds ``score``: log-likelihood, allowed less blocked, per character; null without any."""
    if isinstance(model, DataFrame):
        return _joined(urls, model, order)
    shared = share(urls.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared()
        for batch in slices(batches, "url"):
            texts = as_texts(batch.column("url").cast(pa.binary())).to_pylist()
            scores = [None] * len(texts)
            if held is not None:
                logs, chars = held.logs_of(texts, any_codes)
                sign = logs[:, 0] - logs[:, 1]  # labels in order: allow, block
                scores = [float(s / n) if n else None for s, n in zip(sign, chars, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"]
            )

    kind = urls.schema["id"].dataType.simpleString()
    return urls.mapInArrow(run, f"id {kind}, url string, rule string, given string, score double")


def _threshold(scored: DataFrame) -> float:
    """The cut between bins with the lowest balanced error, the middle one of several."""
    size = 2 * MAX_SCORE * BINS_PER_NAT
    place = F.floor((F.col("score") + MAX_SCORE) * BINS_PER_NAT)
    bins = F.greatest(F.lit(0), F.least(F.lit(size - 1), place)).cast("int")
    rows = (
        scored.filter(F.col("given").isNotNull() & F.col("score").isNotNull())
        .groupBy("given", bins.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # at most two rows per bin
    )
    counts = {ALLOW: np.zeros(size + 1), BLOCK: np.zeros(size + 1)}
    for r in rows:
        counts[r["given"]][r["bin"] + 1] = r["n"]
    below = {k: np.cumsum(v) for k, v in counts.items()}
    if not all(v[-1] for v in below.values()):
        return 0.0
    error = below[ALLOW] / below[ALLOW][-1] + 1 - below[BLOCK] / below[BLOCK][-1]
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(best[len(best) // 2] / BINS_PER_NAT - MAX_SCORE)


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    order: int = ORDER,
    cells: int = CELLS,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score.

    A rule fits its host and all subdomains when the path starts with the rule's; the longest
    rule wins. A null URL, or one without ``://``, has an empty host and path and fits no rule.
    ``score`` is the model's difference per character, null for an empty or null URL. URLs
    without a rule are allowed from the calibrated threshold on; those without a score, and all
    of them when the rules allow or block nothing here, are allowed. Repeated rows get the same
    answer, an empty table gives no rows, other columns are ignored. Models of more than ``cells``
    numbers are not broadcast but joined, with the same scores.
    """
    rows = read_columns(pages, id_col, url_col).toDF("id", "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    ruled = rows.withColumns({"host": host, "path": path})
    fit = {"rule": lambda r: r.name, "given": lambda r: r.verdict}
    ruled = ruled.select(
        "id", "url", *[_first_fit(rules, F.col("host"), F.col("path"), v).alias(k) for k, v in fit.items()]
    )
    known = ruled.filter(F.col("given").isNotNull())
    taught = known.select(F.col("given").alias("label"), F.col("url").alias("text"))
    model = learn(taught, order=order, cells=cells)
    scored = written(_scored(ruled, model, order), "url-scores")
    own = F.when(F.col("score") < F.lit(_threshold(scored)), BLOCK).otherwise(ALLOW)
    return scored.select(
        F.col("id").alias(id_col),
        host.alias("host"),
        path.alias("path"),
        "rule",
        F.coalesce("given", own).alias("verdict"),
        "score",
    )
