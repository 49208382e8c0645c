import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runlens.llm import bpe, packing, queries, token_files
from runlens.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_chunks_put_together_give_the_text():
    raw = "".join(f"äöü{i} word " for i in range(4000)).encode() + bytes(range(33, 127)) * 200
    parts = bpe.chunks(raw)
    assert b"".join(parts) == raw and len(parts) > 3
    assert all(p.decode() for p in parts)


def test_chunks_of_a_passage_are_the_same_elsewhere():
    rng = np.random.default_rng(3)
    passage = " ".join(map(str, rng.integers(0, 10**6, 3000))).encode()
    here, there = set(bpe.chunks(passage)), set(bpe.chunks(b"some other start " + passage))
    assert len(here & there) >= len(here) - 2


def test_encode_agrees_with_the_library(make, library):
    got = {}
    for r in bpe.encode(make(ODD), PATH).collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids"]))
    want = {}
    for i, t in ODD:
        ids = ids_of(library, t)
        want.setdefault(i, []).append((len(ids), ids))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_decode_agrees_with_the_library(spark, make, library):
    encoded = bpe.encode(make(ODD), PATH)
    for r in bpe.decode(encoded, PATH).collect():
        assert r["text"] == library.decode(r["ids"], skip_special_tokens=False)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [49407, 60000, -1, 320])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(odd, PATH).collect()}
    assert got[1] == got[2] == "" and got[3] == library.decode([49407, 320], skip_special_tokens=False)


def test_a_disagreeing_join_encodes_the_whole_text(library, monkeypatch):
    codec = bpe.Encoder(PATH)
    raw = ("thing and another " * 900).encode()
    codec.learn([raw])
    monkeypatch.setattr(codec, "_repair", lambda *a: None)
    assert np.frombuffer(codec.document(raw), "<u4").tolist() == ids_of(library, raw.decode())


def test_full_tables_are_emptied(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORD_TABLE_BYTES", 1000)
    monkeypatch.setattr(bpe, "MAX_CHUNK_TABLE_BYTES", 1000)
    codec = bpe.Encoder(PATH)
    for k in range(4):
        raw = " ".join(f"Word{k}x{i}, and" for i in range(900)).encode()
        codec.learn([raw])
        assert np.frombuffer(codec.document(raw), "<u4").tolist() == ids_of(library, raw.decode())


def test_empty_table(make, spark):
    assert bpe.encode(make([]), PATH).count() == 0
    path = scratch_path(spark, "empty")
    token_files.write(make([]), path, PATH)
    assert token_files.checksums(token_files.with_start(spark, path)).count() == 0


def test_clashing_columns_are_ignored(spark, make):
    docs = make([(1, "a b")]).withColumns({"ids": F.lit(1), "n_tokens": F.lit(2), "route": F.lit(3)})
    assert bpe.encode(docs, PATH).first()["n_tokens"] == 2


def test_codec_query(spark, corpus, library):
    want = {}
    for i, t in corpus[0]:
        ids = ids_of(library, t)
        text = library.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), text.encode())]
        want[i] = (len(ids), *sha)
    got = {r[0]: tuple(r[1:]) for r in queries.op1_bpe_codec(spark, SF).collect()}
    assert got == want


def test_files_query(spark, corpus, library):
    want, start = {}, 0
    for i, t in sorted(corpus[0]):
        ids = np.array([*ids_of(library, t), 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r[0]: tuple(r[1:]) for r in queries.op2_token_files(spark, SF).collect()}
    assert got == want


def test_files_take_odd_rows_and_read_selectively(spark, make, library):
    path = scratch_path(spark, "odd")
    token_files.write(make(ODD), path, PATH, end_id=None)
    rows = token_files.with_start(spark, path).orderBy("start", "n_tokens").collect()
    assert len(rows) == len(ODD) and sum(r["n_tokens"] for r in rows) == sum(len(r["ids"]) for r in rows)
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert ids == sorted(ids)
    plan = token_files.read(spark, path).filter("doc_id = 5").select("n_tokens")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in text.split("ReadSchema")[1] and "EqualTo(doc_id,5)" in text


def test_word_coder_equals_the_library(library):
    """Columns of odd texts: ids and counts of each text as the library gives them."""
    rng = random.Random(8)
    pool = ["abc", "ABC!", "don't", "x9", "\u0130x", "\u0149a", "\u017f\u00c9", "e\u0301", "<|endoftext|>", "a.b", "!!", "\u4e2d\u6587", "\x1c", "\u00a0y", "z"]
    texts = ["", " ", "\t a", *(" ".join(rng.choices(pool, k=rng.randint(0, 30))) + rng.choice(["", "\n"]) for _ in range(300))]
    column = pa.array(texts).slice(1)
    ids, counts = bpe.WordCoder(queries.TOKENIZER, ids=True), bpe.WordCoder(queries.TOKENIZER, ids=False)
    want = [ids_of(library, t) for t in texts[1:]]
    assert ids.lists(column).to_pylist() == want
    assert ids.lists(column, 2).to_pylist() == [[*w, 2] for w in want]
    assert counts.counts(column).tolist() == ids.counts(column).tolist() == [len(w) for w in want]
    assert counts.counts(column.slice(0, 0)).tolist() == []


def test_bytes_that_are_no_text(spark, library, tmp_path):
    """Such bytes are encoded as U+FFFD."""
    docs = spark.range(3).selectExpr("id AS doc_id", "cast(unhex('61ff62') AS string) AS text")
    n = len(ids_of(library, "a\ufffdb"))
    assert [tuple(r) for r in packing.lengths(docs, queries.TOKENIZER).orderBy("doc_id").collect()] == [(i, n + 1) for i in range(3)]
    token_files.write(docs, f"{tmp_path}/t", queries.TOKENIZER)
    assert [len(r["ids"]) for r in token_files.read(spark, f"{tmp_path}/t").collect()] == [n + 1] * 3
