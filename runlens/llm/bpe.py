"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 bytes cuts every text into chunks of about a KB, so a passage gives the
same inner chunks wherever it stands. Documents are range-partitioned and sorted by the smallest
hash of their chunks: documents with common chunks meet in one task, next to each other, while a
very large group of copies spreads over several ranges. A task encodes each chunk once and takes
it from there on from a bounded table. Cuts fall anywhere, also inside words, so each join is
repaired: the broken word is encoded again between its neighbours, and the outcome counts only
when the neighbours come out exactly as they stand; else the whole document is encoded.

Texts are shuffled once; everything else stays within its task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from runlens.llm.common import per_process, read_columns, slices

# Cut after a byte whose rolling hash starts with so many zero bits: chunks of 2**10 bytes.
CUT_BITS = 10
# Bounds of the tables that a Python worker keeps; a full one is emptied.
MAX_WORD_TABLE_BYTES = 96 << 20
MAX_CHUNK_TABLE_BYTES = 24 << 20
MAX_PIECE_TABLE_BYTES = 128 << 20

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(raw: bytes) -> np.ndarray:
    """Offsets between the content-defined chunks of ``raw``, always between code points."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) < 17:
        return np.zeros(0, np.int64)
    h = _GEAR[data]
    for age in (1, 2, 4, 8):  # windows of 2, 4, 8 and 16 bytes
        h[age:] = h[age:] + (h[:-age] << np.uint32(age))
    at = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    at = at[(at >= 16) & (at < len(data))]
    return at[(data[at] & 0xC0) != 0x80]


def chunks(raw: bytes) -> list[bytes]:
    edges = [0, *cuts(raw).tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


# Words made of these letters with a run of ASCII symbols behind them are two pieces at most.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_SYMBOLS = "[!-/:-@\\[-`{-~]"
_SIMPLE = re.compile(f"([{_LETTERS}]+)({_SYMBOLS}*)")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids.

    The vocabulary drops white space and never joins over ASCII white space, so ids are kept by
    word, and by chunk. ``learn`` has to see the texts of a batch first; it empties the table of
    words when that is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain = self._plain()
        self.words: dict[bytes, bytes] = {}
        self.word_bytes = 0
        self.table: dict[bytes, tuple | None] = {}
        self.table_bytes = 0

    def _plain(self) -> Tokenizer | None:
        """The tokenizer without normalising and splitting, for pieces that these leave alone;
        None unless its own steps show that simple words are such pieces."""
        letters = "".join(chr(c) for c in range(0x180) if _SIMPLE.fullmatch(chr(c)))
        steps = json.loads(self.tokenizer.to_str())
        split = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
        full = self.tokenizer
        if not full.normalizer or not full.pre_tokenizer:
            return None
        if full.normalizer.normalize_str(letters) != letters.lower():
            return None
        marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
        pieces = full.pre_tokenizer.pre_tokenize_str
        if [at for _, at in pieces("abc" + marks)] != [(0, 3), (3, 3 + len(marks))]:
            return None
        if len(pieces(letters.lower())) != 1:
            return None
        steps["normalizer"] = None
        steps["added_tokens"] = []
        steps["pre_tokenizer"]["pretokenizers"] = [x for x in split if x["type"] != "Split"]
        return Tokenizer.from_str(json.dumps(steps))

    def _ids(self, texts: list[str], plain: bool = False) -> list[bytes]:
        tokenizer = self.plain if plain else self.tokenizer
        return [_packed(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, texts: list[bytes]) -> None:
        """Encode the words of ``texts`` that are not known yet, each once."""
        words: set[bytes] = set()
        for raw in texts:
            words.update(raw.split())
        if self.word_bytes > MAX_WORD_TABLE_BYTES:
            self.words.clear()
            self.word_bytes = 0
        known = self.words
        new = [w for w in words if w not in known]
        parts, other = {}, []
        for w in new:
            if w.isalpha() and self.plain:  # ASCII letters only
                parts[w] = w.lower(), b""
                continue
            simple = _SIMPLE.fullmatch(w.decode()) if self.plain else None
            if simple:
                parts[w] = simple[1].lower().encode(), simple[2].encode()
            else:
                other.append(w)
        cores = list({core for core, _ in parts.values() if core not in known})
        other += {tail for _, tail in parts.values() if tail and tail not in known}
        found = dict(zip(cores, self._ids([c.decode() for c in cores], plain=True), strict=True))
        found.update(zip(other, self._ids([w.decode() for w in other]), strict=True))
        known.update(found)
        for w, (core, tail) in parts.items():
            known[w] = found[w] = known[core] + (known[tail] if tail else b"")
        self.word_bytes += sum(200 + len(w) + len(i) for w, i in found.items())

    def text(self, raw: bytes) -> bytes:
        """Ids of a learnt text, word by word."""
        return b"".join(map(self.words.__getitem__, raw.split()))

    def _chunk(self, chunk: bytes) -> tuple | None:
        """(broken word at the start, ids, first and last word, broken word at the end), or None
        when the chunk has no white space."""
        words = chunk.split()
        if not words:
            return b"", b"", b"", b"", b""
        opens, ends = not chunk[:1].isspace(), not chunk[-1:].isspace()
        if len(words) == 1 and opens and ends:
            return None
        head = words.pop(0) if opens else b""
        tail = words.pop() if ends else b""
        ids = b"".join(map(self.words.__getitem__, words))
        return head, ids, words[0] if words else b"", words[-1] if words else b"", tail

    def _known(self, chunk: bytes) -> tuple | None:
        if chunk not in self.table:
            if self.table_bytes > MAX_CHUNK_TABLE_BYTES:
                self.table.clear()
                self.table_bytes = 0
            self.table[chunk] = self._chunk(chunk)
            self.table_bytes += 200 + 3 * len(chunk)
        return self.table[chunk]

    def _repair(self, left: bytes, word: bytes, right: bytes) -> bytes | None:
        """Ids of a word broken by a cut, or None if its neighbours come out differently."""
        window = self._ids([b" ".join((left, word, right)).decode()])[0]
        before = self.words[left] if left else b""
        after = self.words[right] if right else b""
        end = len(window) - len(after)
        agrees = len(before) <= end and window.startswith(before) and window.endswith(after)
        return window[len(before) : end] if agrees else None

    def document(self, raw: bytes) -> bytes:
        """Ids of a learnt text from its chunks, joins repaired."""
        out, carry, left = [], b"", b""
        for chunk in [*chunks(raw), b" "]:  # the space ends a last open word
            known = self._known(chunk)
            if known is None:
                carry += chunk
                continue
            head, ids, first, last, tail = known
            if carry or head:
                repaired = self._repair(left, carry + head, first)
                if repaired is None:
                    return self._ids([raw.decode()])[0]
                out.append(repaired)
                left = carry + head
            out.append(ids)
            left, carry = last or left, tail
        return b"".join(out)


class WordCoder:
    """Encodes whole columns of texts by their distinct words.

    The words of a batch are split, numbered and cut into letters and the symbols behind them in
    Arrow; only distinct pieces come to Python, where a bounded table keeps what the tokenizer
    made of them (ids, or their number alone). Ids of texts are put together by taking pieces in order.
    """

    def __init__(self, path: str, ids: bool):
        self.encoder = Encoder(path)
        self.ids = ids
        self.table: dict[str, bytes | int] = {}
        self.table_bytes = 0

    def _encoded(self, pieces: pa.StringArray, plain: np.ndarray) -> list:
        """What stands in the table for each piece; ``plain`` marks those of simple letters."""
        if self.table_bytes > MAX_PIECE_TABLE_BYTES:
            self.table.clear()
            self.table_bytes = 0
        texts, table = pieces.to_pylist(), self.table
        for kind in (True, False):
            new = [t for t, p in zip(texts, plain.tolist(), strict=True) if p == kind and t not in table]
            tokenizer = self.encoder.plain if kind else self.encoder.tokenizer
            if not new:
                continue
            found = tokenizer.encode_batch_fast(new, add_special_tokens=False)
            if self.ids:
                table.update(zip(new, [array("I", e.ids).tobytes() for e in found], strict=True))
            else:
                table.update(zip(new, map(len, found), strict=True))
            self.table_bytes += (220 if self.ids else 150) * len(new) + sum(map(len, new))
        return [table[t] for t in texts]

    def _pieces(self, texts: pa.StringArray):
        """Offsets of the texts in the words, the words' two pieces, and the pieces' encodings."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False)
        whole, tail = words.dictionary, pa.array([""] * len(words.dictionary), pa.string())
        if self.encoder.plain:
            cut = pc.extract_regex(whole, f"^(?P<core>[{_LETTERS}]+)(?P<tail>{_SYMBOLS}*)$")
            whole = pc.if_else(cut.is_valid(), pc.utf8_lower(pc.struct_field(cut, "core")), whole)
            tail = pc.struct_field(cut, "tail").fill_null("")
        first, second = whole.dictionary_encode(), tail.dictionary_encode()
        simple = np.zeros(len(first.dictionary), bool)
        if self.encoder.plain and len(simple):
            simple = pc.match_substring_regex(first.dictionary, f"^[{_LETTERS}]+$").to_numpy(zero_copy_only=False)
        one = self._encoded(first.dictionary, simple)
        two = self._encoded(second.dictionary, np.zeros(len(second.dictionary), bool))
        a = first.indices.to_numpy(zero_copy_only=False)[at]
        b = second.indices.to_numpy(zero_copy_only=False)[at]
        return lists.offsets.to_numpy(), a, b, one, two

    def counts(self, texts: pa.StringArray) -> np.ndarray:
        """Number of ids of each text."""
        offsets, a, b, one, two = self._pieces(texts)
        size = (lambda x: len(x) // 4) if self.ids else (lambda x: x)
        one, two = (np.array([size(x) for x in y], np.int64) for y in (one, two))
        ends = np.concatenate([[0], np.cumsum(one[a] + two[b])])
        return ends[offsets[1:]] - ends[offsets[:-1]]

    def lists(self, texts: pa.StringArray, end: int | None = None) -> pa.ListArray:
        """The ids of each text as a list<int> array, with the id ``end`` behind each."""
        offsets, a, b, one, two = self._pieces(texts)
        last = len(one) + len(two)
        held = [*one, *two, b"" if end is None else np.array([end], "<u4").tobytes()]
        sizes = np.array([len(x) // 4 for x in held], np.int64)
        stops = np.concatenate([[0], np.cumsum(sizes)])
        values = pa.array(np.frombuffer(b"".join(held), "<i4"))
        pieces = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), values)
        # two pieces a word, and a last one behind each text
        order = np.stack([a, b + len(one)], axis=1).ravel()
        order = np.insert(order, 2 * offsets[1:], last)
        ends = np.concatenate([[0], np.cumsum(sizes[order])])
        stop = 2 * offsets.astype(np.int64) + np.arange(len(offsets))
        flat = pieces.take(pa.array(order)).flatten()
        return pa.ListArray.from_arrays(pa.array(ends[stop], pa.int32()), flat)


def word_coder(path: str, ids: bool) -> WordCoder:
    """The process's coder of columns; tasks that run in one Python worker share its table."""
    return per_process(("words", path, ids), lambda: WordCoder(path, ids))


def encoder(path: str) -> Encoder:
    """The process's encoder: tasks that run in one Python worker share its bounded tables."""
    return per_process(("encoder", path), lambda: Encoder(path))


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest chunk hash of each text."""
    for batch in slices(batches):
        keys = []
        for text in batch.column("text").to_pylist():
            found = [xxhash.xxh3_64_intdigest(c) >> 1 for c in chunks((text or "").encode())]
            keys.append(min(found))
        yield pa.record_batch([*batch.columns, pa.array(keys, pa.int64())], ["id", "text", "route"])


def ids_column(encoded: list[bytes], end: int | None = None) -> pa.ListArray:
    """A list<int> array of the ids of many texts."""
    if end is not None:
        last = np.array([end], "<u4").tobytes()
        encoded = [e + last for e in encoded]
    ends = np.cumsum([0] + [len(e) // 4 for e in encoded])
    values = np.frombuffer(b"".join(encoded), "<i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in slices(batches):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            codec.learn(texts)
            found = [codec.document(t) for t in texts]
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "n_tokens": pa.array([len(f) // 4 for f in found], pa.int64()),
                    "ids": ids_column(found),
                }
            )

    return run


def encode(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, n_tokens, ids (array<int>) as the tokenizer gives them for the
    whole text without special tokens added.

    ``tokenizer`` is the path of a tokenizers file whose words never span ASCII white space, on
    every machine. A null text is an empty one and has no ids; rows with a null id or a repeated
    id are encoded like all others; an empty table gives no rows; other columns are ignored.
    """
    rows = read_columns(docs, id_col, text_col).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    routed = rows.mapInArrow(_route, f"id {kind}, text string, route long")
    together = routed.repartitionByRange("route", "id").sortWithinPartitions("route", "id")
    encoded = together.select("id", "text").mapInArrow(
        _encode(tokenizer), f"id {kind}, n_tokens long, ids array<int>"
    )
    return encoded.withColumnRenamed("id", id_col)


class Decoder:
    """Ids back to text: the tokens with a space between them, unknown ids left out."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        if tokenizer.decoder is not None:
            raise ValueError("only vocabularies without a decoder step are supported")
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [tokenizer.id_to_token(i) for i in range(size)]

    def text(self, ids: np.ndarray) -> str:
        tokens, size = self.tokens, len(self.tokens)
        try:
            return " ".join([tokens[i] for i in ids.tolist()])
        except (IndexError, TypeError):
            found = [tokens[i] for i in ids.tolist() if i is not None and 0 <= i < size]
            return " ".join([t for t in found if t is not None])


def lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a list<int> column without copies; null is empty."""
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for a, b, v in zip(offsets, offsets[1:], valid, strict=False):
        yield values[a:b] if v else values[:0]


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = per_process(("decoder", path), lambda: Decoder(path))
        for batch in slices(batches, "ids"):
            texts = [decoder.text(ids) for ids in lists(batch.column("ids"))]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], ["id", "ids", "text"])

    return run


def decode(
    encoded: DataFrame, tokenizer: str, *, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """One row per document: id, ids, text, special tokens kept. Null ids give an empty text."""
    rows = read_columns(encoded, id_col, ids_col).toDF("id", "ids")
    kind = rows.schema["id"].dataType.simpleString()
    texts = rows.mapInArrow(_decode(tokenizer), f"id {kind}, ids array<int>, text string")
    return texts.withColumnsRenamed({"id": id_col, "ids": ids_col})


def digests(encoded: DataFrame, tokenizer: str, *, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, SHA-256 of the ids (little-endian 32 bits) and of the decoded text.

    Decodes and digests in one pass, so that the texts stay in the Python worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = per_process(("decoder", tokenizer), lambda: Decoder(tokenizer))
        for batch in slices(batches, "ids"):
            found = list(lists(batch.column("ids")))
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "n_tokens": pa.array([len(x) for x in found], pa.int64()),
                    "ids_sha256": pa.array([_sha256(x.astype("<u4").tobytes()) for x in found]),
                    "decoded_sha256": pa.array([_sha256(decoder.text(x).encode()) for x in found]),
                }
            )

    rows = read_columns(encoded, id_col, "ids").toDF("id", "ids")
    kind = rows.schema["id"].dataType.simpleString()
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, f"id {kind}, {out}").withColumnRenamed("id", id_col)


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
