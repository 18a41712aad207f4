"""Packing token sequences by minimum bin slack over the multiset of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidlake.llm import bpe
from evidlake.llm.common import pieces as runs_of_text
from evidlake.llm.common import texts, written

CAPACITY = 2048
# Pieces that are numbered in one task, about.
CHUNK = 50_000
PIECE = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
)


@dataclass(frozen=True)
class Pattern:
    """Lengths that share a sequence, with their counts, and how many sequences are filled so."""

    counts: tuple[tuple[int, int], ...]
    times: int

    @property
    def total(self) -> int:
        return sum(length * n for length, n in self.counts)


def fill(left: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of ``left`` (length: count) whose sum is closest to ``room``, by a bitset of reachable sums.

    Counts are split into powers of two; bit s of the set after a step says that the sum s can be reached with
    the steps so far. Going back from the highest sum, a step was taken if the sum wasn't there before it.
    """
    whole = (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    reach = 1
    for length in sorted((n for n in left if n <= room), reverse=True):
        most, part = min(left[length], room // length), 1
        while most:
            part = min(part, most)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & whole
            most, part = most - part, part * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + part
            at -= length * part
    return taken


def patterns(lengths: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Minimum bin slack for a histogram of lengths: each sequence starts with the longest piece left.

    What fills it is used again for as many sequences as the counts allow, so each pattern at least halves what is
    left of one length: there are at most ``capacity`` times the binary logarithm of the number of pieces.
    """
    left = {length: n for length, n in lengths.items() if n}
    out = []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        taken = fill({length: n for length, n in rest.items() if n}, capacity - longest)
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[length] // n for length, n in taken.items())
        out.append(Pattern(tuple(sorted(taken.items(), reverse=True)), times))
        for length, n in taken.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return out


def cut(docs: DataFrame, path: str, end: int, capacity: int) -> DataFrame:
    """Pieces of every document's ids: runs of ``capacity`` from its start on, and what remains."""

    def run(encoder: bpe.Encoder, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, rows in runs_of_text(batch, size=bpe.RUN):
                ids, count = encoder.encode(data, offsets)
                bounds = np.append(0, np.cumsum(count))
                raw = memoryview(np.insert(ids, bounds[1:], end).astype("<u4")).cast("B")
                edges = bounds + np.arange(len(bounds))
                total = count + 1
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(n)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(total[row] - start, capacity)
                lo = (edges[row] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), (lo + length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[rows].take(pa.array(row)), pa.array(start), pa.array(length.astype(np.int32)),
                        pa.array(crc, pa.int64()), pa.array(total[row].astype(np.int64)),
                    ],
                    schema=PIECE,
                )

    return texts(docs).mapInArrow(bpe.encoding(path, run), "doc_id long, start long, length int, ids_crc32 long, doc_tokens long")


def numbered(cut_pieces: DataFrame) -> DataFrame:
    """Adds nr: the number of each piece among those of its length, from 0. A length's pieces are counted in chunks."""
    chunks = max(1, -(-cut_pieces.count() // CHUNK))
    dealt = cut_pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(chunks)))
    before = Window.partitionBy("l").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(F.col("length").alias("l"), F.col("chunk").alias("c")).agg(F.count(F.lit(1)).alias("n")).select(
        "l", "c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    own = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    inside = dealt.withColumn("nr", F.row_number().over(own) - 1)
    found = inside.join(base, (F.col("length") == F.col("l")) & (F.col("chunk") == F.col("c")))
    return found.withColumn("nr", F.col("nr") + F.col("base")).drop("chunk", "l", "c", "base")


def places(found: list[Pattern]) -> np.ndarray:
    """For each length and pattern: length, first nr, copies in a sequence, first sequence, offset of the first copy."""
    rows, used, sequence = [], {}, 0
    for p in found:
        offset = 0
        for length, n in p.counts:
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * p.times
            offset += n * length
        sequence += p.times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str | None = None, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Where every piece of every document goes: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids (null text: empty) end with ``end``. It is cut into runs of ``capacity`` ids, which fill a
    sequence each, and a rest. The driver gets the histogram of lengths, ``capacity`` rows at most, finds the
    patterns, and sends them out (see ``patterns`` for their bound; each has 63 lengths at most). Pieces are numbered
    within their length, in chunks, and a piece's number tells its sequence and offset.

    Pieces in a sequence have no gaps. A shorter sequence is padded to ``capacity`` by its reader, unless it has a power
    of two. Rows with the same doc_id, or a null one, are documents of their own. No documents: no rows.
    """
    spark = docs.sparkSession
    cut_pieces = written(cut(docs, path or bpe.standard_path(), end, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(patterns(histogram, capacity)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = pa.schema([*PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by length, then first nr: both in one number.
        key = (table.value[:, 0] << 48) + table.value[:, 1]
        for batch in batches:
            length, nr = batch.column("length").to_numpy().astype(np.int64), batch.column("nr").to_numpy().astype(np.int64)
            at = table.value[np.searchsorted(key, (length << 48) + nr, "right") - 1]
            turn, copy = np.divmod(nr - at[:, 1], at[:, 2])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(at[:, 3] + turn), pa.array(at[:, 4] + copy * length)], schema=schema
            )

    return numbered(cut_pieces).select(*names, "nr").mapInArrow(
        run, "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    ).withColumn("length", F.col("length").cast("long"))
