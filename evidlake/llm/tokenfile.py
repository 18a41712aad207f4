"""Token-id files: Parquet with a list column of ids, in ascending doc_id order."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidlake.llm import bpe
from evidlake.llm.common import new_folder, pieces, texts

# Ids are few and repeat: they are dictionary encoded, at most 17 bits each before compression. Numbers that ascend
# are delta encoded, and every page has its range in the page index, so a reader of some documents or of the
# metadata alone leaves the other pages and the ids untouched.
FORMAT = {
    "compression": "zstd",
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "20000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(4 << 20),
    "parquet.enable.dictionary#nr": "false",
    "parquet.enable.dictionary#doc_id": "false",
}


def encode(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """nr, doc_id, n_tokens and ids of every whole text (null: empty), with ``end`` after each, in the rows' order.

    nr counts the rows of a partition.
    """
    schema = pa.schema([("nr", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(encoder: bpe.Encoder, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nr = 0
        for batch in batches:
            for data, offsets, rows in pieces(batch, size=bpe.RUN):
                ids, count = encoder.encode(data, offsets)
                bounds = np.append(0, np.cumsum(count))
                out = np.insert(ids, bounds[1:], end)
                edges = bounds + np.arange(len(bounds))
                n = len(count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(nr, nr + n)), batch.column("doc_id")[rows], pa.array((count + 1).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(out)),
                    ],
                    schema=schema,
                )
                nr += n

    return docs.mapInArrow(bpe.encoding(path, run), "nr long, doc_id long, n_tokens int, ids array<int>")


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = 0) -> None:
    """Write the documents' ids to ``folder``, one file a range of doc_ids.

    Rows are in the order of doc_id, null first, then text; ``part`` numbers the ranges in that order, nr the rows of
    a range. A document's ids are in one row whatever its length. No documents: files without rows.
    """
    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encode(ordered, path or bpe.standard_path(), end).select(
        F.spark_partition_id().alias("part"), "nr", "doc_id", "n_tokens", "ids"
    ).write.options(**FORMAT).parquet(folder)


def read(spark, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def starts(rows: DataFrame) -> DataFrame:
    """Adds start: the ids of all rows before, over all ranges. Sums of the ranges come first, then those within."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    return inside.join(base, F.col("part") == F.col("p")).withColumn("start", F.col("start") + F.col("base")).drop("p", "base")


def checksums(rows: DataFrame) -> DataFrame:
    """part, nr, doc_id, n_tokens and ids_crc32: the CRC of a row's ids as little-endian unsigned 32-bit integers."""
    schema = pa.schema(
        [("part", pa.int32()), ("nr", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            edges = ids.offsets.to_numpy().astype(np.int64)
            raw = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            edges = (edges - edges[0]) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("nr"), batch.column("doc_id"), pa.array(np.diff(edges) // 4), pa.array(crc, pa.int64())],
                schema=schema,
            )

    return rows.select("part", "nr", "doc_id", "ids").mapInArrow(run, "part int, nr long, doc_id long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, path: str | None = None, end: int = 0) -> DataFrame:
    """Write the files and tell from them per document: doc_id, start, n_tokens, ids_crc32."""
    folder = new_folder(docs.sparkSession, "tokens")
    write(docs, folder, path, end)
    return starts(checksums(read(docs.sparkSession, folder))).select("doc_id", "start", "n_tokens", "ids_crc32")
