"""License notices in texts, as DataFrame expressions only.

Words are runs of letters and digits, lower-cased; shingles are five words. A template of m words is
looked for in overlapping windows of 2 * m words, a new one every m words, so each occurrence lies
in some window. A window is retrieved for a template when one of 64 bands agrees, a band being one
minhash; then the template's shingles that the window contains are counted exactly.

A band can only agree where the window holds the template's minimal shingle of that band. These
anchor shingles are known beforehand, so windows are formed around anchors only: the same windows
are retrieved, and texts without an anchor are passed over with one look at each shingle.

A window with at least 80 % of the shingles of a template of m words has a similarity of
0.8 * (m - 4) / (2 * m - 4 + 0.2 * (m - 4)) or more: 0.16 for five words (where all of the one
shingle is needed), 0.23 for seven, 0.36 for many. All 64 bands miss with probability 1e-5, 5e-8
and 4e-13.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.text import compute_once
from runlens.llm.common import read_columns

WORDS = 5
BANDS = 64
SIMILAR_PCT = 80

# Notices by which works are put under public licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0 notice",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "BSD notice",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation",
    ),
    ("MIT", "Released under the MIT License"),
    (
        "MIT notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
)

_NOT_WORD = "[^\\p{L}\\p{N}]+"


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; none for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def _shingle(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)])


def _starts(words: Column) -> Column:
    none = F.array().cast("array<int>")
    return F.when(
        F.size(words) >= WORDS, F.sequence(F.lit(0), F.size(words) - WORDS)
    ).otherwise(none)


def _band(hashes: Column, band: int) -> Column:
    """The minhash of a band."""
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))


def _least(hashes: Column, band: int) -> Column:
    """The minhash of a band and the shingle that it comes from."""
    both = F.transform(
        hashes, lambda h: F.struct(F.xxhash64(h, F.lit(band)).alias("low"), h.alias("anchor"))
    )
    return F.array_min(both)


def templates(spark: SparkSession, notices: Sequence[tuple[str, str]]) -> DataFrame:
    """license, size in words, shingles (distinct), one row per notice of five words or more."""
    if not notices:
        notices = [("", "")]
    rows = F.array(*[
        F.struct(F.lit(n).alias("license"), F.lit(t).alias("notice")) for n, t in notices
    ])
    given = spark.range(1).select(F.inline(rows)).withColumn("words", words_of(F.col("notice")))
    hashes = F.array_distinct(F.transform(_starts(F.col("words")), lambda i: _shingle(F.col("words"), i)))
    shingled = given.select("license", F.size("words").alias("size"), hashes.alias("shingles"))
    return shingled.filter(F.size("shingles") > 0)


def scan(
    docs: DataFrame,
    *,
    notices: Sequence[tuple[str, str]] = TEMPLATES,
    similar_pct: int = SIMILAR_PCT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document and license found: id, license, n_shared, n_shingles, first_word.

    A license is found when a window holds at least ``similar_pct`` percent of its notice's
    distinct shingles. The window with the most of them (ties: the first) gives n_shared and
    first_word, the place of its first shared shingle, counted in words from 0. Null and empty
    texts hold none. Repeated rows, null ids included, give one row; texts that share an id count
    as one document each, told apart by a hash of their texts. Other columns are ignored; an empty
    table, or no notices of five words, gives no rows.
    """
    spark = docs.sparkSession
    known = templates(spark, notices)
    # constant size: one anchor per template and band at most
    bands = [
        r.asDict()
        for r in known.select(
            "license",
            "size",
            F.posexplode(
                F.array(*[_least(F.col("shingles"), b) for b in range(BANDS)])
            ).alias("band", "least"),
        ).select("license", "size", "band", "least.low", "least.anchor").collect()
    ]
    rows = read_columns(docs, id_col, text_col).toDF("id", "text")
    rows = rows.select("id", F.xxhash64("text").alias("tx"), words_of(F.col("text")).alias("words"))
    rows = compute_once(rows.select("id", "tx", "words"), {"w": F.col("words")}).drop("words")
    anchors = sorted({b["anchor"] for b in bands})
    near = F.array_compact(
        F.transform(
            _starts(F.col("w")),
            lambda i: F.when(_shingle(F.col("w"), i).isin(*anchors), i),
        )
    )
    hit = compute_once(rows, {"hits": near}).filter(F.size("hits") > 0)
    hashed = compute_once(
        hit, {"h": F.transform(_starts(F.col("w")), lambda i: _shingle(F.col("w"), i))}
    )
    windows = F.flatten(F.array(*[
        _windows(size, sorted({b["anchor"] for b in bands if b["size"] == size}))
        for size in sorted({b["size"] for b in bands})
    ])) if bands else F.array().cast("array<struct<size:int,place:int>>")
    placed = hashed.select("id", "tx", "h", F.inline(windows)).select(
        "id", "tx", "size", "place",
        F.slice("h", F.col("place") * F.col("size") + 1, 2 * F.col("size") - (WORDS - 1)).alias("inside"),
    )
    lows = F.array(*[_band(F.col("inside"), b) for b in range(BANDS)])
    banded = placed.select("*", F.posexplode(lows).alias("band", "low"))
    table = F.array(*[
        F.struct(
            F.lit(b["license"]).alias("license"), F.lit(b["size"]).alias("size"),
            F.lit(b["band"]).alias("band"), F.lit(b["low"]).alias("low"),
        )
        for b in bands
    ]) if bands else F.array().cast("array<struct<license:string,size:int,band:int,low:bigint>>")
    keys = spark.range(1).select(F.inline(table))
    one = ["id", "tx", "size", "place", "license"]
    found = banded.join(keys, ["size", "band", "low"]).groupBy(*one).agg(F.first("inside").alias("inside"))
    checked = found.join(known.select("license", "shingles"), "license").withColumns(
        {
            "shared": F.size(F.array_intersect("shingles", "inside")).cast("long"),
            "total": F.size("shingles").cast("long"),
            "first": F.col("place") * F.col("size") + F.array_min(F.array_compact(
                F.transform("inside", lambda h, i: F.when(F.array_contains("shingles", h), i))
            )),
        }
    )
    best = (
        checked.filter(F.col("shared") * 100 >= F.col("total") * similar_pct)
        .groupBy("id", "tx", "license")
        .agg(F.min(F.struct((-F.col("shared")).alias("s"), "place", "first", "total")).alias("b"))
    )
    return best.select(
        F.col("id").alias(id_col),
        "license",
        (-F.col("b.s")).alias("n_shared"),
        F.col("b.total").alias("n_shingles"),
        F.col("b.first").cast("long").alias("first_word"),
    )


def _windows(size: int, anchors: list[int]) -> Column:
    """The windows of one template size that hold one of its anchors."""
    last = 2 * size - WORDS  # the last shingle of a window, from its start
    mine = F.filter("hits", lambda i: F.get(F.col("h"), i).isin(*anchors))
    places = F.flatten(
        F.transform(
            mine,
            lambda i: F.sequence(
                F.greatest(F.lit(0), F.ceil((i - last) / size)).cast("int"),
                F.floor(i / size).cast("int"),
            ),
        )
    )
    return F.transform(
        F.array_distinct(places), lambda k: F.struct(F.lit(size).alias("size"), k.alias("place"))
    )
