"""Token ids as Parquet files, readable by column, row group and page.

Documents are range-partitioned by id, so the files hold ids in ascending order. Each row has its
document's id and token count (delta encoded), its offset within its file, and the token ids as a
list column (dictionary encoded). Row groups and pages are small, and Spark's writer adds the page
index, so a reader can take the counts alone, or the tokens of a few documents, without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.llm.bpe import lists, word_coder
from runlens.llm.common import WORD_BYTES, as_texts, read_columns, slices

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 2000

# Version 2 pages: the counters fall to delta encoding, the ids keep their dictionary.
WRITER = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#file_start": "false",
    "compression": "zstd",
}
SCHEMA = "doc_id long, file_no int, file_start long, n_tokens long, ids array<int>"


def _encode(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, file_no, start = word_coder(path, ids=True), TaskContext.get().partitionId(), 0
        for batch in slices(batches, most=WORD_BYTES):
            ids = codec.lists(as_texts(batch.column("text")), end_id)
            counts = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            ends = start + np.cumsum(counts)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "file_no": pa.array(np.full(len(counts), file_no, np.int32)),
                    "file_start": pa.array(ends - counts),
                    "n_tokens": pa.array(counts),
                    "ids": ids,
                }
            )
            start = int(ends[-1]) if len(ends) else start

    return run


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every text, append ``end_id`` and write the files below ``path``.

    Files hold documents in ascending order of their long id, null ids first; rows with the same
    id stand in the order of a hash of their texts. A null text is an empty one and has the end
    id only; bytes that are no UTF-8 are encoded as U+FFFD. A text is encoded whole, however long,
    and is one row. An empty table gives an empty file set; other columns are ignored.
    """
    rows = read_columns(docs, id_col, text_col).toDF("doc_id", "text")
    rows = rows.withColumns({"doc_id": F.col("doc_id").cast("long"), "tie": F.xxhash64("text")})
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    texts = ordered.select("doc_id", F.col("text").cast("binary").alias("text"))
    ids = texts.mapInArrow(_encode(tokenizer, end_id), SCHEMA)
    ids.write.options(**WRITER).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the files; Spark reads only those that are used."""
    return spark.read.schema(SCHEMA).parquet(path)


def with_start(spark: SparkSession, path: str) -> DataFrame:
    """The rows with ``start``, the ids of all documents before them.

    Only the counters are read for the files' totals. The window and the broadcast see one row
    per file, and there are no more files than range partitions.
    """
    rows = read(spark, path)
    totals = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("file_tokens"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        "file_no", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("file_base")
    )
    joined = rows.join(F.broadcast(base), "file_no")
    return joined.withColumn("start", F.col("file_base") + F.col("file_start"))


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids (little-endian 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in lists(batch.column("ids"))]
            columns = [batch.column(i) for i in range(3)]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(crc, pa.int64())], names)

    picked = rows.select("doc_id", "start", "n_tokens", "ids")
    return picked.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
