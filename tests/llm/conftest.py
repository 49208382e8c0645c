import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from runlens.llm.common import prepared  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """A documents table of (id, text) or (id, text, lang) rows."""
    prepared(spark)

    def build(rows, schema=DOCS, partitions=3):
        full = [(*r, *[None] * (5 - len(r))) for r in rows] if schema == DOCS else rows
        return spark.createDataFrame(full, schema).repartition(partitions)

    return build


@pytest.fixture
def corpus(spark):
    """The smallest documents as (id, text) pairs, and their DataFrame."""
    docs = prepared(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], docs


# Rows that every operator has to take: nulls, empty and blank texts, long ones, repeated rows.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r"),
    (None, "null id"),
    (None, None),
    (4, "same same"),
    (4, "same same"),
    (4, "other text of the same id"),
    (5, "é́   x\x1cy <|endoftext|>z \U0001f600\nΣΑΣ don't 1234 ..."),
    (6, "word " * 30_000),
    (7, "x" * 100_000),
]
