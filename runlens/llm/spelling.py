"""Spelling variants: PartEnum signatures of letter multisets.

A word's letters, each with its number among equal ones, are the dimensions of a binary vector,
folded into 64 bits. One replaced letter moves two words' vectors apart by a Hamming distance of
two at most, one letter more or less by one. The bits are dealt to a few parts of equal weight; as a distance of
``d`` touches ``d`` parts at most, two near words agree on all parts but some ``d`` of them. Every
choice of ``d`` parts to leave out gives a signature: the vector's other bits. Signatures are
exact, so an equi-join on them finds every near pair; each is verified by its edit distance, in
the join, so no other pair leaves it.

Signatures carry the length to be met, and the first or the last two letters: an edit of a word of five
letters or more leaves one of these ends alone. That keeps groups of equal signatures small in a
large vocabulary.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import compute_once
from runlens.llm.common import ascii_lower, read_columns
from runlens.session import written

MIN_LENGTH = 5
MIN_COUNT = 3
# A form has so many times the occurrences of a word at least.
MIN_RATIO = 2
# Parts of the bits for words of one length (distance 2), and for lengths one apart (distance 1).
SAME_PARTS = 4
NEXT_PARTS = 3
# Letters at either end that go into the signatures.
EDGE = 2
BITS = 64

# Letters as they are compared: A-Z are lower-cased, À-ÿ stay as they are.
_OTHERS = "[^a-z\\u00C0-\\u00FF]+"


def runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, word) per maximal run of letters A-Z, a-z and À-ÿ, A-Z lower-cased.

    A null or empty text has none; a text is split whole, however long. Repeated rows give their
    runs again.
    """
    rows = read_columns(docs, id_col, text_col).toDF("id", "text")
    pieces = F.split(ascii_lower(F.col("text")), _OTHERS)
    found = rows.select(F.col("id").alias(id_col), F.explode(pieces).alias("word"))
    return found.filter("word <> ''")


def vocabulary(
    words: DataFrame, *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, word_col: str = "word"
) -> DataFrame:
    """word and n, its number of rows, for words of ``min_length`` code points and ``min_count``
    rows at least. Null words count nowhere. Counts are combined per task before the shuffle."""
    rows = read_columns(words, word_col).toDF("word").filter(F.char_length("word") >= min_length)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _vector(word: Column) -> Column:
    """The letter multiset as 64 bits: each (letter, number among equal ones) flips one."""

    def dimensions(letter: Column) -> Column:
        times = (F.char_length(word) - F.char_length(F.replace(word, letter))).cast("int")
        return F.transform(F.sequence(F.lit(1), times), lambda number: F.pmod(F.xxhash64(letter, number), F.lit(BITS)))

    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bits = F.flatten(F.transform(F.array_distinct(F.split(word, "")), dimensions))
    return F.aggregate(bits, none, lambda acc, b: acc.bitwiseXOR(F.call_function("shiftleft", one, b.cast("int"))))


def _masks(parts: int) -> list[int]:
    """Bits dealt to so many parts, as signed longs."""
    masks = [sum(1 << b for b in range(BITS) if b % parts == p) for p in range(parts)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def _signatures(vector: Column, edge: Column, length: Column, parts: int, distance: int) -> list[Column]:
    """A 64-bit key per choice of ``distance`` parts to leave out; equal keys are verified."""
    masks = _masks(parts)
    keys = []
    for number, out in enumerate(combinations(range(parts), distance)):
        kept = F.lit(sum(m for p, m in enumerate(masks) if p not in out)).cast("long")
        keys.append(F.xxhash64(vector.bitwiseAND(kept), edge, length, F.lit(distance * 100 + number)))
    return keys


def near_pairs(vocab: DataFrame, *, edge: int = EDGE) -> DataFrame:
    """The pairs (a, b) of words one inserted, deleted or replaced code point apart, with their
    counts an and bn; each pair once.

    ``vocab`` has distinct words, with n. Words shorter than 2 * ``edge`` + 1 need a smaller ``edge``.
    """
    known = compute_once(
        vocab.select("word", "n"), {"vector": _vector(F.col("word")), "length": F.char_length("word")}
    )
    ends = [
        F.concat(F.lit("<"), F.substring("word", 1, edge)),
        F.concat(F.lit(">"), F.substring("word", -edge, edge)),
    ]
    vector, length = F.col("vector"), F.col("length")
    shorter, longer = [], []
    for end in ends:
        same = _signatures(vector, end, length, SAME_PARTS, 2)
        shorter += same + _signatures(vector, end, length, NEXT_PARTS, 1)
        longer += same + _signatures(vector, end, length - 1, NEXT_PARTS, 1)
    left = known.select(F.col("word").alias("a"), F.col("n").alias("an"), F.explode(F.array(*shorter)).alias("key"))
    right = known.select(F.col("word").alias("b"), F.col("n").alias("bn"), F.explode(F.array(*longer)).alias("key"))
    ordered = (F.char_length("a") < F.char_length("b")) | (
        (F.char_length("a") == F.char_length("b")) & (F.col("a") < F.col("b"))
    )
    near = F.levenshtein("a", "b", 1) == 1
    return left.join(right, (left["key"] == right["key"]) & ordered & near).select("a", "an", "b", "bn").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form) with a form: the end of the chain of forms.

    Every round doubles the steps taken, and counts at least double with each step, so a few
    rounds are enough.
    """
    hops = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = hops.select("word", "root").join(ahead, "root", "left")
        hops = written(
            moved.select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        if hops.filter("moved").isEmpty():
            return hops.select("word", "root")


def grouped(vocab: DataFrame, *, min_ratio: float = MIN_RATIO, edge: int = EDGE) -> DataFrame:
    """word, n, n_near, form, form_n, root for every row of ``vocab`` (distinct words and n).

    A word's form is its near word of largest n (of equal ones the first in code-point order),
    if that n is ``min_ratio`` times its own at least; else null. The root follows forms to the
    last one and is the word itself where it has none. An empty vocabulary gives no rows; other
    columns are ignored.
    """
    vocab = written(read_columns(vocab, "word", "n"), "spelling-words")
    pairs = written(near_pairs(vocab, edge=edge), "spelling-pairs")
    both = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("near_n")),
                F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("near_n")),
            )
        ).alias("r")
    ).select("r.*")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    of_word = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= F.col("n") * min_ratio
    rows = written(
        vocab.join(of_word, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.form")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(
    docs: DataFrame,
    *,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    min_ratio: float = MIN_RATIO,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``grouped`` over the words of ``docs``. Null and empty texts have no words, repeated rows
    count again, other columns are ignored, an empty table gives no rows."""
    words = vocabulary(runs(docs, id_col=id_col, text_col=text_col), min_length=min_length, min_count=min_count)
    return grouped(words, min_ratio=min_ratio, edge=min(EDGE, (min_length - 1) // 2))
