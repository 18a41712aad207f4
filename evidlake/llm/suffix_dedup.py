"""Exact substring dedup of bytes by bucket-pointer refinement of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import trimmed
from evidlake.llm.repeats import Units, bytes_of, copies, covered, gram_hashes, repeated_windows

WINDOW, GRAM, START = 50, 16, 8
# Bytes of a surrounding: all windows that hold the gram in the middle.
WIDTH = 2 * WINDOW - GRAM


def surround(data: np.ndarray, place: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Bytes around each live gram; beyond the document's ends they are zero, and ``left`` and ``right`` say so."""
    reach, q = units.reach, units.gram
    padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(reach, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + q)[place]
    inner = np.ascontiguousarray(around[:, reach : reach + q])
    unit = bytes_of(inner.ravel(), None)[0]
    gram = gram_hashes(unit, q)[:: q] if len(place) else np.zeros(0, np.uint64)
    ends = np.arange(len(place) + 1, dtype=np.int32) * (2 * reach + q)
    rows = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(ends), pa.py_buffer(around.tobytes())])
    return gram, np.minimum(place, reach), np.minimum(len(data) - q - place, reach), rows


def refine(bucket: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Split buckets by the bucket pointers of a later offset: members of a bucket stay together if those agree."""
    return np.unique((bucket.astype(np.uint64) << np.uint64(32)) | later, return_inverse=True)[1].astype(np.uint32)


def window_buckets(around: np.ndarray) -> Iterator[np.ndarray]:
    """For each offset the bucket of every row's window from there on: equal numbers for equal windows.

    Suffixes at an offset start in the buckets of their first START bytes. These are refined by the pointers of the
    suffixes START bytes on; the new pointers, which stand for twice as many bytes, refine again what lies before them,
    until the next step would go past the window; the last takes the pointer at the offset that ends with it. All
    pointers are used again for the offsets that follow, and dropped behind them.
    """
    known: dict[tuple[int, int], np.ndarray] = {}

    def pointer(depth: int, at: int) -> np.ndarray:
        if (depth, at) not in known:
            if depth == START:
                first = np.ascontiguousarray(around[:, at : at + START]).view(np.uint64)[:, 0]
                known[depth, at] = np.unique(first, return_inverse=True)[1].astype(np.uint32)
            else:
                before = START
                while before * 2 < depth:
                    before *= 2
                known[depth, at] = refine(pointer(before, at), pointer(before, at + depth - before))
        return known[depth, at]

    for at in range(around.shape[1] - WINDOW + 1):
        yield pointer(WINDOW, at)
        for key in [k for k in known if k[1] <= at]:
            del known[key]


def classes(gram: np.ndarray, doc: np.ndarray, around: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by gram, surroundings and doc_id, and where a new class of equal surroundings begins in it."""
    sides = (left.astype(np.uint64) << np.uint64(8)) | right.astype(np.uint64)
    weights = np.random.default_rng(3).integers(1, 1 << 63, around.shape[1], np.uint64, endpoint=True) | np.uint64(1)
    digest = sides * np.uint64(0x9E3779B97F4A7C15)
    for i in range(around.shape[1]):
        digest += (around[:, i].astype(np.uint64) + np.uint64(7)) * weights[i]
    digest ^= digest >> np.uint64(31)
    order = np.lexsort((doc, digest, gram))
    same = (gram[order][1:] == gram[order][:-1]) & (digest[order][1:] == digest[order][:-1])
    # Equal digests must be equal bytes; else they stay apart.
    at = np.flatnonzero(same)
    a, b = order[at], order[at + 1]
    same[at] = (around[a] == around[b]).all(axis=1) & (sides[a] == sides[b])
    return order, np.flatnonzero(np.append(True, ~same))


def match(doc: np.ndarray, gram: np.ndarray, left: np.ndarray, right: np.ndarray, raw: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """See ``repeats.Match``. Equal surroundings of one gram are sorted once, under their smallest doc_id."""
    reach = WINDOW - GRAM
    around = np.frombuffer(raw.buffers()[2], np.uint8)[raw.offset * WIDTH : (raw.offset + len(raw)) * WIDTH].reshape(-1, WIDTH)
    order, begin = classes(gram, doc, around, left, right)
    size = np.diff(np.append(begin, len(order)))
    head = order[begin]
    # Windows that lie in the document: from reach - left on, up to right.
    low, high = reach - left, right
    least = np.repeat(doc[head], size)
    later = order[doc[order] > least]
    later = later[low[later] <= high[later]]
    out = [(later, low[later], high[later])]
    # Grams with several classes: their windows are compared one by one.
    several = np.append(gram[head][1:] == gram[head][:-1], False)
    several[1:] |= several[:-1].copy()
    some = np.flatnonzero(several)
    if len(some):
        own = head[some]
        hit = np.zeros((len(own), reach + 1), bool)
        for at, bucket in enumerate(window_buckets(around[own])):
            valid = np.flatnonzero((low[own] <= at) & (at <= high[own]))
            first = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, bucket[valid], doc[own[valid]])
            hit[valid, at] = first[bucket[valid]] < doc[own[valid]]
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        which, lo = np.nonzero(edge == 1)
        hi = np.nonzero(edge == -1)[1] - 1
        # All rows of the class with its smallest doc_id have them; the others have all their windows already.
        rank = np.repeat(np.arange(len(head)), size)
        equal = np.flatnonzero(doc[order] == least)
        members = order[equal][np.argsort(rank[equal], kind="stable")]
        bounds = np.searchsorted(np.sort(rank[equal]), [some[which], some[which] + 1])
        n = bounds[1] - bounds[0]
        row = members[np.repeat(bounds[0] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        out.append((row, np.repeat(lo, n), np.repeat(hi, n)))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def dedup(docs: DataFrame) -> DataFrame:
    """What is left of every document when repeated bytes go: doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256.

    A byte goes if it is in a run of 50 bytes of its document's UTF-8 text that also starts in a document with a
    smaller doc_id, judged on the input. spans are the maximal runs that go (first, one past the last), null for the
    whole text of a document that has 50 bytes or more and is equal to one with a smaller doc_id.

    A null text is empty. Rows with the same doc_id don't take from each other. A null doc_id neither gives nor
    takes. No rows: no rows.
    """
    units = Units(bytes_of, WINDOW, GRAM)
    found = repeated_windows(docs, units, surround, match)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n": [], "spans": [], "sha": []}
            for text, windows in zip(batch.column("text"), batch.column("windows"), strict=True):
                data = text.as_buffer().to_pybytes()
                lo, hi = covered(windows.values.to_numpy(), WINDOW)
                kept = b"".join(data[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(data)], strict=True))
                out["n"].append(int((hi - lo).sum()))
                out["spans"].append(np.stack([lo, hi], axis=1).tolist())
                out["sha"].append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("th"), pa.array(out["n"], pa.int64()),
                    pa.array(out["spans"], pa.list_(pa.list_(pa.int64()))), pa.array(out["sha"], pa.string()),
                ],
                ["d", "t", "gone", "spans", "kept"],
            )

    gone = found.mapInArrow(trimmed(cut), "d long, t long, gone long, spans array<array<long>>, kept string").dropDuplicates(["d", "t"])
    all_docs = copies(docs, F.octet_length("text").cast("long").alias("n_bytes"))
    joined = all_docs.join(gone, (F.col("doc_id") == F.col("d")) & (F.col("th") == F.col("t")), "left")
    whole = F.col("is_copy") & (F.col("n_bytes") >= WINDOW)
    return joined.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(~whole, F.coalesce("spans", F.array().cast("array<array<long>>"))).alias("spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
