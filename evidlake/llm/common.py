"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.session import shared_dir

# What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
# Texts are worked through in pieces of about so many bytes, which stay in a core's cache.
PIECE = 1 << 21
#: What a task does with the Arrow batches of its rows.
Run = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def new_folder(spark, name: str) -> str:
    """A fresh folder below the cluster's shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and there for every executor."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id (long) and text (null: empty) of a table of documents, whatever its other columns are."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), *more
    )


def boxed(docs: DataFrame, *more: Column) -> DataFrame:
    """Each row as one struct ``row``, so that its columns can't clash with others; ``select("row.*")`` gives them back."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *more)


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Cut a batch by rows into runs of about ``size`` bytes of text.

    Gives the bytes of a run, the row offsets in them (one more than rows) and the rows. A text that is
    longer than ``size`` comes alone and whole.
    """
    text = batch.column(column)
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(text))
        yield data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], slice(first, last)
        first = last


def release() -> None:
    """Give freed memory back to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run: Run) -> Run:
    """``run`` for a task that leaves its worker as small as it found it: workers live on for the stages that follow."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def batch_of(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in columns.items()], schema=schema
    )


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Of batches sorted by ``key``: each key with its rows. Only for keys whose rows have a bounded size."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(values)], strict=True):
            if held and values[lo] != at:
                yield at, held
                held = []
            at = values[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield at, held
