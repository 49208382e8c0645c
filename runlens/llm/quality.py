"""Quality rules, line first, as DataFrame expressions only.

Every line is judged by itself: navigation (mostly separators), noise (symbols or shouted marks
after most words), punctuation (a long line without any) and boilerplate (fixed phrases in a short
line). Failing lines are removed; a document that loses too many of its words, or that fails the
base rules on words and repetition, is rejected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import bind, compute_once
from runlens.llm.common import SPACE, SPACE_CLASS, fresh, read_columns

WINDOW = 5

# Phrases of page furniture in English; a short line that holds one is boilerplate.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "forgot your password",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "terms of service",
    "terms of use",
)
BOILERPLATE_WORDS = 20
# A line of so many words without any punctuation fails.
UNPUNCTUATED_WORDS = 8

OUTPUTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines",
    "n_lost_words", "clean_text", "base_failed", "kept",
)

SYMBOLS = "[#*$%&|<>]"
_MARKS = "[.!?:;,\\u2026\\u3002\\uFF01\\uFF1F\\u0964]"
_SEPARATOR = "[|/>\\-\\u2022\\u00B7\\u00BB\\u203A]"
_SEPARATORS = "(?<![^\\x20\\x09-\\x0D])[|/>\\-\\u2022\\u00B7\\u00BB\\u203A]+(?![^\\x20\\x09-\\x0D])"
# a separator at a word's start; the class comes first, as it fails fastest
_LONE = f"{_SEPARATOR}(?<=(?<![^\\x20\\x09-\\x0D]){_SEPARATOR})"
_WORD = "[^\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, f"{SPACE_CLASS}+"))


def line_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(_WORD))


def may_fail(text: Column, boilerplate: Sequence[str] = BOILERPLATE) -> Column:
    """Whether a text holds anything for which one of its lines can fail, but for a line without
    punctuation. One look at the whole text spares most lines all rules but that."""
    return text.contains("!!") | text.rlike(SYMBOLS) | text.rlike(_LONE) | bind(F.lower(text), _phrase(boilerplate))


def _phrase(boilerplate: Sequence[str]):
    return lambda low: reduce(or_, [low.contains(p) for p in boilerplate], F.lit(False))


def line_fails(line: Column, boilerplate: Sequence[str] = BOILERPLATE, odd: Column | None = None) -> Column:
    """Whether one line with words breaks a line rule; ``odd`` is what ``may_fail`` gives for the
    text that holds it."""
    odd = F.lit(True) if odd is None else odd

    def breaks(n: Column) -> Column:
        navigation = line.rlike(_SEPARATOR) & (F.regexp_count(line, F.lit(_SEPARATORS)) * 4 >= n)
        noise = (line.rlike(SYMBOLS) & (F.regexp_count(line, F.lit(SYMBOLS)) * 3 >= n)) | (
            line.contains("!!") & (F.regexp_count(line, F.lit("!!+")) * 3 >= n)
        )
        punctuation = (n >= UNPUNCTUATED_WORDS) & ~line.rlike(_MARKS)
        furniture = (n <= BOILERPLATE_WORDS) & bind(F.lower(line), _phrase(boilerplate))
        return (n > 0) & (punctuation | (odd & (navigation | noise | furniture)))

    return (odd | ~line.rlike(_MARKS)) & bind(line_words(line), breaks)


def judged(
    docs: DataFrame,
    *,
    text_col: str = "text",
    min_words: int = 10,
    max_repeat_pct: int = 20,
    max_lost_pct: int = 50,
    boilerplate: Sequence[str] = BOILERPLATE,
    prefix: str = "",
) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines,
    n_lost_words (longs), base_failed, kept and clean_text (each name after ``prefix``).

    Words lie between ASCII white space. A null text has no words and fails; its clean_text is
    empty. ``n_repeat_words`` counts the words covered by 5-word windows found twice or more;
    windows are compared by 64-bit hashes within the document. A document is kept when the base
    rules pass and at most ``max_lost_pct`` percent of its words stand in failing lines;
    clean_text is the text without those lines. ``boilerplate`` are lower-case phrases that make
    a short line fail. A text is judged whole, however long, within its row. Repeated rows get the
    same verdict, an empty table gives no rows. Input columns stay as they are: where one has an
    output's name the call fails, and ``prefix`` avoids the clash.
    """
    names = [f"{prefix}{name}".lower() for name in OUTPUTS]
    clash = sorted({c.lower() for c in docs.columns}.intersection(names))
    if clash:
        raise ValueError(f"columns {clash} are outputs too; choose a prefix")
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    n = {k: fresh(docs, f"q_{k}") for k in ("words", "hashes", "lines", "fine", "sorted", "at", "odd")}
    words = compute_once(docs, {n["words"]: words_of(t), n["lines"]: F.split(t, "\n"), n["odd"]: may_fail(t, boilerplate)})
    size = F.size(n["words"])

    def window_hash(i: Column) -> Column:
        return F.xxhash64(*[F.get(F.col(n["words"]), i + k) for k in range(WINDOW)])

    starts = F.sequence(F.lit(0), size - WINDOW)
    no_longs = F.array().cast("array<bigint>")
    hashed = compute_once(
        words,
        {
            n["hashes"]: F.when(size >= WINDOW, F.transform(starts, window_hash)).otherwise(no_longs),
            n["fine"]: F.filter(n["lines"], lambda line: ~line_fails(line, boilerplate, F.col(n["odd"]))),
        },
    )
    # only documents with a window found twice sort their windows
    twice = F.size(F.array_distinct(n["hashes"])) < F.size(n["hashes"])
    pairs = F.transform(n["hashes"], lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    no_pairs = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = compute_once(hashed, {n["sorted"]: F.when(twice, F.array_sort(pairs)).otherwise(no_pairs)})

    def place(x: Column, k: Column) -> Column:
        before = F.get(F.col(n["sorted"]), k - 1)["h"]
        after = F.get(F.col(n["sorted"]), k + 1)["h"]
        return F.when((x["h"] == before) | (x["h"] == after), x["i"])

    at = F.array_sort(F.array_compact(F.transform(n["sorted"], place)))
    placed = compute_once(ordered, {n["at"]: at})
    covered = F.aggregate(
        F.transform(
            n["at"],
            lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(n["at"]), k + 1) - p, F.lit(WINDOW))),
        ),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    with_words = F.filter(n["lines"], lambda line: line.rlike(_WORD))
    stays = F.array_join(n["fine"], "\n")
    p = lambda name: f"{prefix}{name}"
    facts = placed.withColumns(
        {
            p("n_words"): size.cast("long"),
            p("word_chars"): F.char_length(F.regexp_replace(t, f"{SPACE_CLASS}+", "")).cast("long"),
            p("n_symbols"): F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            p("n_dup_lines"): (F.size(with_words) - F.size(F.array_distinct(with_words))).cast("long"),
            p("n_repeat_words"): covered,
            p("n_failed_lines"): (F.size(n["lines"]) - F.size(n["fine"])).cast("long"),
            p("n_lost_words"): (size - line_words(stays)).cast("long"),
            p("clean_text"): stays,
        }
    )
    base_failed = (F.col(p("n_words")) < min_words) | (
        F.col(p("n_repeat_words")) * 100 > F.col(p("n_words")) * max_repeat_pct
    )
    lost = F.col(p("n_lost_words")) * 100 > F.col(p("n_words")) * max_lost_pct
    return facts.withColumns({p("base_failed"): base_failed, p("kept"): ~base_failed & ~lost}).drop(
        *n.values()
    )


def verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """One row per document: its id, the facts and the verdict, without the texts."""
    rows = read_columns(docs, id_col, text_col).toDF("doc_id", "text")
    return judged(rows, **rules).drop("text", "clean_text")


def cleaned(docs: DataFrame, *, text_col: str = "text", **rules) -> DataFrame:
    """The documents kept, with all their columns; the text without its failing lines."""
    prefix = fresh(docs, "verdict_")
    marked = judged(docs, text_col=text_col, prefix=prefix, **rules)
    kept = marked.filter(F.col(f"{prefix}kept"))
    return kept.withColumn(text_col, F.col(f"{prefix}clean_text")).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
