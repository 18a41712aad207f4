"""Where documents repeat runs of units (bytes or words) of documents with smaller doc_ids: the shared parts.

A window is a run of ``window`` units of one document. Equal windows have the same anchors: the positions in them whose
gram (``gram`` units) has the smallest hash. So two documents that share a window share the gram of an anchor in it, and

1. each document sends the hashes of its anchors' grams, about one for ten to twenty units, to a bucket by hash,
2. a bucket tells which of them are live: in at least two documents with different texts,
3. each document sends the surroundings of its live anchors, all windows that hold the gram, to the gram's bucket,
4. there a matcher finds which of these windows a document with a smaller doc_id has too.

Hashes only choose what meets; what the matcher compares are the units. A document whose whole text is that of a smaller
doc_id needs no matcher, and counts once in a bucket. What meets documents (places, windows) goes to the documents' group,
and so do their texts. Buckets and groups are many enough to hold a bounded share of the text each; a task takes one after
another. All that is sent is compressed by bucket, as near copies hold much the same bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import Run, partitions, pieces, runs, trimmed, written

# Text that is worked through at once; text, anchors and surroundings behind one bucket; what a task gathers before it sends.
RUN, BUCKET_BYTES, ANCHORS_AT_ONCE, BYTES_AT_ONCE = 1 << 18, 16 << 20, 1 << 20, 16 << 20
# Tasks that share the buckets, at most; what is sent: a bucket, 0 for numbers and 1 for texts, and several arrays' bytes.
TASKS, LETTER = 60_000, "bucket long, kind int, body binary"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTE = (np.arange(1, 257, dtype=np.uint64) * _A) ^ ((np.arange(1, 257, dtype=np.uint64) * _B) >> np.uint64(17))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_BACK = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Units:
    """What windows are made of: ``split`` gives the hash of every unit of some rows, and each row's first unit."""

    split: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    window: int
    gram: int

    @property
    def reach(self) -> int:
        """Units on either side of a gram that a window with it can hold."""
        return self.window - self.gram


def bytes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _BYTE[data], offsets


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    inside = ~BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    begin = np.flatnonzero(begins)
    first = np.searchsorted(begin, offsets)
    if not len(begin):
        return np.zeros(0, np.uint64), first
    power = np.cumprod(np.append(np.uint64(1), np.full(n, _STEP)), dtype=np.uint64)[:n]
    back = np.cumprod(np.append(np.uint64(1), np.full(n, _BACK)), dtype=np.uint64)
    h = np.add.reduceat(np.where(inside, _BYTE[data], 0) * power, begin) * back[begin]
    return (h ^ (h >> np.uint64(31))) * _B, first


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    x += b
    x ^= x >> np.uint64(29)
    x *= _B
    return x


def gram_hashes(unit: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q units from each place on, by doubling; q is a power of two."""
    size = 1
    while size < q:
        unit = mix(unit[:-size], unit[size:])
        size *= 2
    return unit ^ (unit >> np.uint64(32))


def slide(x: np.ndarray, w: int, least: Callable) -> np.ndarray:
    """Minimum (or maximum) of every w neighbours."""
    size = 1
    while size * 2 <= w:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def anchors(unit: np.ndarray, first: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place (among all units), row and gram hash of every anchor: a place with the smallest gram of some window."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n, w = len(unit), units.reach + 1
    if n < units.window:
        return none
    h = gram_hashes(unit, units.gram)
    key = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    end = np.repeat(first[1:], np.diff(first))
    low = slide(key, w, np.minimum)  # of the window from each place on
    low[np.arange(len(low)) + units.window > end[: len(low)]] = 0
    # A place is an anchor if a whole window over it has its key as the minimum.
    padded = np.concatenate([np.zeros(w - 1, np.uint32), low, np.zeros(w - 1, np.uint32)])
    place = np.flatnonzero(slide(padded, w, np.maximum)[: len(key)] == key)
    if not len(place):
        return none
    return place, np.searchsorted(first, place, "right") - 1, h[place]


def planes(x: np.ndarray) -> bytes:
    """Bytes of numbers, first all lowest ones: small numbers compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def shut(*parts: bytes) -> bytes:
    """Several arrays' bytes as one compressed body."""
    sizes = np.array([len(parts), *map(len, parts)], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(b"".join((sizes.tobytes(), *parts)))


def opened(body: bytes) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(body))
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw[8 : 8 * (n + 1)], np.int64))
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


def letter(bucket: int, kind: int, *parts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int64()), pa.array([kind], pa.int32()), pa.array([shut(*parts)], pa.binary())], ["bucket", "kind", "body"]
    )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text: tells rows with the same doc_id apart) and text of documents with a doc_id."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.where(docs["doc_id"].isNotNull()).select(
        docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")
    )


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """By the low bits: the high ones of an anchor are small, and tell grams of one bucket apart."""
    return ((gram & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def group_of(doc: np.ndarray, th: np.ndarray, groups: int) -> np.ndarray:
    return ((((doc.view(np.uint64) ^ th.view(np.uint64)) * _B) >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)


def send_anchors(units: Units, buckets: int) -> Run:
    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, th, row, place, gram = (np.concatenate([h[i] for h in held]) for i in range(5))
        bucket = bucket_of(gram, buckets)
        order = np.argsort(bucket, kind="stable")
        row, place, gram, bucket = row[order], place[order], gram[order], bucket[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
            own = np.flatnonzero(np.append(True, row[lo + 1 : hi] != row[lo : hi - 1]))
            delta = np.diff(place[lo:hi], prepend=0)
            delta[own] = place[lo:hi][own]
            high = np.ascontiguousarray(gram[lo:hi].view(np.uint8).reshape(-1, 8)[:, 2:])
            which = row[lo:hi][own]
            yield letter(
                int(bucket[lo]), 0, planes(doc[which]), th[which].tobytes(), planes(np.diff(np.append(own, hi - lo)).astype(np.uint32)),
                high.tobytes(), planes(delta.astype(np.uint32)),
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, known = [], 0, 0
        for batch in batches:
            doc, th = batch.column("doc_id").to_numpy(), batch.column("th").to_numpy()
            for data, offsets, rows in pieces(batch, size=RUN):
                unit, first = units.split(data, offsets)
                place, row, gram = anchors(unit, first, units)
                held.append((doc[rows], th[rows], row + known, place - first[row], gram))
                n += len(place)
                known += rows.stop - rows.start
                if n >= ANCHORS_AT_ONCE:
                    yield from flush(held)
                    held, n, known = [], 0, 0
        if n:
            yield from flush(held)

    return run


def find_live(groups: int) -> Run:
    """Places of live anchors, by document. Of copies of a text only that with the smallest doc_id comes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in runs(batches, "bucket"):
            yield from to_documents(*live_places(bodies(held)), groups)

    return run


def bodies(held: list[pa.RecordBatch]) -> list[list[memoryview]]:
    return [opened(body.as_buffer()) for b in held for body in b.column("body")]


def live_places(rows: list[list[memoryview]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, th and place of each live anchor of one bucket."""
    doc, th = np.concatenate([unplanes(r[0], np.int64) for r in rows]), np.concatenate([np.frombuffer(r[1], np.int64) for r in rows])
    counts = [unplanes(r[2], np.uint32) for r in rows]
    places = []
    for r, c in zip(rows, counts, strict=True):
        delta = unplanes(r[4], np.uint32).astype(np.int64)
        total, at = np.cumsum(delta), np.cumsum(c) - c
        places.append(total - np.repeat(total[at] - delta[at], c))
    raw = np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows]).reshape(-1, 6)
    gram = np.zeros((len(raw), 8), np.uint8)
    gram[:, :6] = raw
    gram = gram.view(np.uint64).ravel()
    owner = np.repeat(np.arange(len(doc)), np.concatenate(counts))
    order = np.argsort(gram)
    owner, gram, place = owner[order], gram[order], np.concatenate(places)[order]
    at = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    size = np.diff(np.append(at, len(gram)))
    live = np.ones(len(at), bool)
    for x in (doc[owner], th[owner]):
        live &= np.minimum.reduceat(x, at) != np.maximum.reduceat(x, at)
    live = np.repeat(live, size)
    owner, gram, place = owner[live], gram[live], place[live]
    order = np.lexsort((doc[owner], th[owner], gram))
    owner, gram, place = owner[order], gram[order], place[order]
    at = np.flatnonzero(np.append(len(gram) > 0, (gram[1:] != gram[:-1]) | (th[owner[1:]] != th[owner[:-1]])))
    least = np.repeat(doc[owner[at]], np.diff(np.append(at, len(gram))))
    first = doc[owner] == least
    return doc[owner[first]], th[owner[first]], place[first]


def to_documents(doc: np.ndarray, th: np.ndarray, values: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """Send numbers (one row or several for each document) to the groups of their documents."""
    if not len(doc):
        return
    group = group_of(doc, th, groups)
    order = np.lexsort((th, doc, group))
    doc, th, values, group = doc[order], th[order], values[order], group[order]
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(doc)), strict=True):
        own = np.flatnonzero(np.append(True, (doc[lo + 1 : hi] != doc[lo : hi - 1]) | (th[lo + 1 : hi] != th[lo : hi - 1])))
        yield letter(
            int(group[lo]), 0, planes(doc[lo:hi][own]), th[lo:hi][own].tobytes(), planes(np.diff(np.append(own, hi - lo)).astype(np.uint32)),
            planes(np.ascontiguousarray(values[lo:hi], np.uint32).ravel()),
        )


def send_texts(groups: int) -> Run:
    """Texts to the groups of their documents."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, th = (np.concatenate([h[i] for h in held]) for i in range(2))
        text = pa.concat_arrays([h[2] for h in held])
        group = group_of(doc, th, groups)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.append(len(order) > 0, np.diff(group[order]) > 0))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            some = order[lo:hi]
            own = text.take(pa.array(some))
            ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
            raw = own.buffers()[2]
            yield letter(
                int(group[some[0]]), 1, planes(doc[some]), th[some].tobytes(), planes(np.diff(ends)), memoryview(raw)[ends[0] : ends[-1]] if raw else b""
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            held.append((batch.column("doc_id").to_numpy(), batch.column("th").to_numpy(), text))
            n += text.nbytes
            if n >= BYTES_AT_ONCE:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return run


def at_documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, th, text and all numbers that were sent to it, for each document of a group that got any."""
    for _, held in runs(batches, "bucket"):
        rows = [(k.as_py(), body) for b in held for k, body in zip(b.column("kind"), b.column("body"), strict=True)]
        held.clear()
        sent = [opened(body.as_buffer()) for k, body in rows if k == 0]
        if not sent:
            continue
        doc, th = np.concatenate([unplanes(r[0], np.int64) for r in sent]), np.concatenate([np.frombuffer(r[1], np.int64) for r in sent])
        counts = np.concatenate([unplanes(r[2], np.uint32) for r in sent]).astype(np.int64)
        values = np.concatenate([unplanes(r[3], np.uint32) for r in sent])
        values = values.reshape(int(counts.sum()), -1).astype(np.int32)
        owner = np.repeat(np.arange(len(doc)), counts)
        order = np.lexsort((th[owner], doc[owner]))
        owner, values = owner[order], values[order]
        at = np.flatnonzero(np.append(True, (doc[owner[1:]] != doc[owner[:-1]]) | (th[owner[1:]] != th[owner[:-1]])))
        known = dict(zip(zip(doc[owner[at]].tolist(), th[owner[at]].tolist(), strict=True), zip(at.tolist(), [*at[1:].tolist(), len(owner)], strict=True), strict=True))
        for _, body in (r for r in rows if r[0] == 1):
            docs, ths, sizes, text = opened(body.as_buffer())
            docs, ths, sizes = unplanes(docs, np.int64), np.frombuffer(ths, np.int64), unplanes(sizes, np.int64)
            spans = [known.get(pair) for pair in zip(docs.tolist(), ths.tolist(), strict=True)]
            some = [i for i, span in enumerate(spans) if span]
            if not some:
                continue
            ends = np.cumsum(sizes)
            got = [values[slice(*spans[i])].ravel() for i in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs[some]), pa.array(ths[some]), pa.array([str(text[ends[i] - sizes[i] : ends[i]], "utf-8") for i in some], pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, got)]), pa.int32()), pa.array(np.concatenate(got))),
                ],
                ["doc_id", "th", "text", "values"],
            )


#: Of one document: its text's bytes and its live places; gives for each place the gram's hash, the units there are on its
#: left and on its right within reach, and the bytes of all of them.
Surround = Callable[[np.ndarray, np.ndarray, Units], tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]
#: Of one bucket: doc_id, gram hash, left, right and bytes of surroundings; gives rows of them with the first and the last
#: of windows (0: the leftmost that holds the gram) that are in a smaller doc_id.
Match = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def send_surroundings(units: Units, surround: Surround, buckets: int) -> Run:
    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, th, place, gram, left, right = (np.concatenate([h[i] for h in held]) for i in range(6))
        raw = pa.concat_arrays([h[6] for h in held])
        bucket = bucket_of(gram, buckets)
        order = np.lexsort((gram, bucket))
        cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            some = order[lo:hi]
            around = raw.take(pa.array(some))
            ends = np.frombuffer(around.buffers()[1], np.int32)[: len(some) + 1]
            yield letter(
                int(bucket[some[0]]), 0, planes(doc[some]), th[some].tobytes(), planes(place[some].astype(np.uint32)), gram[some].tobytes(),
                left[some].astype(np.uint8).tobytes(), right[some].astype(np.uint8).tobytes(), planes(np.diff(ends)),
                memoryview(around.buffers()[2])[: ends[-1]],
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, ths, found = (batch.column(c) for c in ("doc_id", "th", "values"))
            ids, ths = ids.to_numpy(), ths.to_numpy()
            for i in range(batch.num_rows):
                place = np.unique(found[i].values.to_numpy())
                data = np.frombuffer(batch.column("text")[i].as_buffer(), np.uint8)
                gram, left, right, around = surround(data, place, units)
                held.append((np.full(len(place), ids[i]), np.full(len(place), ths[i]), place, gram, left, right, around))
                n += around.nbytes
                if n >= BYTES_AT_ONCE:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return run


def match_buckets(units: Units, match: Match, groups: int) -> Run:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in runs(batches, "bucket"):
            rows = bodies(held)
            held.clear()
            doc, place = np.concatenate([unplanes(r[0], np.int64) for r in rows]), np.concatenate([unplanes(r[2], np.uint32) for r in rows]).astype(np.int64)
            th, gram = np.concatenate([np.frombuffer(r[1], np.int64) for r in rows]), np.concatenate([np.frombuffer(r[3], np.uint64) for r in rows])
            left, right = (np.concatenate([np.frombuffer(r[i], np.uint8) for r in rows]).astype(np.int64) for i in (4, 5))
            ends = np.cumsum(np.append(0, np.concatenate([unplanes(r[6], np.int32) for r in rows]))).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(r[7] for r in rows))])
            rows.clear()
            row, lo, hi = match(doc, gram, left, right, raw)
            # Windows by the number of their first unit in the document.
            windows = np.stack([place[row] - units.reach + lo, place[row] - units.reach + hi], axis=1)
            yield from to_documents(doc[row], th[row], windows, groups)

    return run


def covered(windows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of units (first, one past the last) under windows given as pairs of first and last window."""
    pairs = windows.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    lo, hi = pairs[:, 0].astype(np.int64), np.maximum.accumulate(pairs[:, 1]).astype(np.int64) + window
    new = np.append(True, lo[1:] > hi[:-1])
    return lo[new], np.append(hi[:-1][new[1:]], hi[-1:])


def repeated_windows(docs: DataFrame, units: Units, surround: Surround, match: Match) -> DataFrame:
    """doc_id, th, text and windows (flat pairs of first and last) of documents that repeat windows of smaller doc_ids.

    Only the first of several documents with one text is looked at. Null doc_ids take no part.
    Rows that agree in doc_id and text may come more than once.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET_BYTES))
    tasks = min(TASKS, buckets)

    def sorted_by(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "bucket").sortWithinPartitions("bucket")

    def send(rows: DataFrame, run: Run) -> DataFrame:
        return rows.mapInArrow(trimmed(run), LETTER)

    def meet(numbers: DataFrame, texts: DataFrame) -> DataFrame:
        both = sorted_by(numbers.unionByName(send(texts, send_texts(buckets))))
        return both.mapInArrow(trimmed(at_documents), "doc_id long, th long, text string, values array<int>")

    live = send(sorted_by(send(rows, send_anchors(units, buckets))), find_live(buckets))
    known = written(meet(live, rows), "live", compression="zstd")
    met = sorted_by(send(known, send_surroundings(units, surround, buckets)))
    found = send(met, match_buckets(units, match, buckets))
    return meet(found, known.select("doc_id", "th", "text")).withColumnRenamed("values", "windows")


def copies(docs: DataFrame, *measures: Column) -> DataFrame:
    """doc_id, th, sha (SHA-256 of the text) and the measures of every row, and is_copy: a smaller doc_id has the same text."""
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")
    ).select("doc_id", F.xxhash64("text").alias("th"), F.sha2("text", 256).alias("sha"), *measures)
    rows = written(rows, "texts")
    first = rows.groupBy(F.col("sha").alias("s")).agg(F.min("doc_id").alias("least"))
    return rows.join(first, F.col("sha") == F.col("s")).withColumn("is_copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("s", "least")
