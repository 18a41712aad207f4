"""Runs of words that repeat with a period, found by block convolution over dyadic scales."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import WORD, pieces, texts

# A run is at least FOLD periods and LEAST words long.
FOLD, LEAST = 4, 6
# Sums of squared differences are taken modulo the Fermat prime 2^16 + 1, whose residues reduce by shifts; its roots of
# unity go up to order 2^16. Blocks below 16 words have fewer terms in a sum than a transform has passes.
PRIME, GENERATOR, LONGEST, PLAIN = 65537, 3, 1 << 15, 16
AT_ONCE = 1 << 15
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("text", pa.large_string())]
)


def reduced(x: np.ndarray) -> np.ndarray:
    """A small representative modulo 2^16 + 1, of either sign: 2^16 is -1."""
    return (x & 0xFFFF) - (x >> 16)


@cache
def twiddles(size: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Powers of the root of unity of order ``size`` and of its inverse for each pass, and the inverse of ``size``."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    inverse = pow(root, PRIME - 2, PRIME)

    def passes(base: int) -> list[np.ndarray]:
        powers = np.array([pow(base, i, PRIME) for i in range(size // 2)], np.int64)
        powers[powers > PRIME // 2] -= PRIME
        return [powers[:: size // 2 // half] for half in (1 << k for k in range(size.bit_length() - 1))]

    return passes(root), passes(inverse), pow(size, PRIME - 2, PRIME)


def forward(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform down the first axis, in bit-reversed order; the columns are independent."""
    size, rows = x.shape
    powers, _, _ = twiddles(size)
    for w in reversed(powers):
        parts = x.reshape(-1, 2, len(w), rows)
        out = np.empty_like(parts)
        np.add(parts[:, 0], parts[:, 1], out=out[:, 0])
        out[:, 1] = reduced((parts[:, 0] - parts[:, 1]) * w[:, None])
        x = out.reshape(size, rows)
    return reduced(x)


def backward(x: np.ndarray) -> np.ndarray:
    """The inverse of ``forward``, times the size."""
    size, rows = x.shape
    _, powers, _ = twiddles(size)
    for w in powers:
        parts = x.reshape(-1, 2, len(w), rows)
        turned = reduced(parts[:, 1] * w[:, None])
        out = np.empty_like(parts)
        np.add(parts[:, 0], turned, out=out[:, 0])
        np.subtract(parts[:, 0], turned, out=out[:, 1])
        x = out.reshape(size, rows)
    return x


def occurrences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Where each block's sum of squared differences from its window is 0 (modulo the prime).

    ``blocks`` is (b, rows), ``windows`` (2b, rows); gives (b, rows), by offset into the window. No true occurrence is
    missed; a false one (one in 65537 of the others) fails when it is compared word by word.
    """
    b, rows = blocks.shape
    turned = np.zeros((2 * b, rows), np.int64)
    turned[0] = blocks[0]
    turned[b + 1 :] = blocks[:0:-1]
    product = backward(reduced(forward(turned) * forward(windows)))[:b]
    _, _, inverse = twiddles(2 * b)
    squares = np.zeros((2 * b + 1, rows), np.int64)
    np.cumsum(windows * windows, axis=0, out=squares[1:])
    total = squares[b : 2 * b] - squares[:b] + (blocks * blocks).sum(axis=0)
    return (total - 2 * (reduced(reduced(product)) * inverse)) % PRIME == 0


def stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of consecutive numbers in an ascending array."""
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1])) if len(at) else at
    return at[first], np.diff(np.append(first, len(at)))


def same_ahead(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words agree from a and b on, ahead (step 1) or back from them (step -1); a < b."""
    most = len(words) - b if step > 0 else a + 1
    done, width = 0, 32
    while done < most:
        width = min(2 * width, most - done)
        x, y = (
            (words[a + done : a + done + width], words[b + done : b + done + width])
            if step > 0
            else (words[a - done - width + 1 : a - done + 1][::-1], words[b - done - width + 1 : b - done + 1][::-1])
        )
        unlike = x != y
        at = int(unlike.argmax())
        if unlike[at]:
            return done + at
        done += width
    return done


def seeds(words: np.ndarray, scale: int) -> Iterator[tuple[int, int]]:
    """Places s and distances d in [scale, 2 scale), such that the blocks at s and s + scale occur again d words on, and the one before s doesn't.

    A run of period d has 3 d >= 3 scale words in a row that are equal to those d words on, and so two blocks in a row.
    """
    width = min(scale, LONGEST)
    count = len(words) // scale
    spread = (words * 0x9E3779B1 >> 13) & 0xFFFF  # the values that are squared; equal words have equal ones
    padded = np.concatenate([spread, -1 - (np.arange(3 * scale) * 40503 & 0xFFFF)])
    rows = max(1, AT_ONCE // (2 * width))
    before = np.zeros((scale, 1), bool)
    earlier = before
    for first in range(0, count, rows):
        at = scale * np.arange(first, min(count, first + rows))
        blocks = padded[at[None, :] + np.arange(width)[:, None]]
        found = np.concatenate(
            [
                occurrences(blocks, padded[np.minimum(at[None, :] + scale + cut + np.arange(2 * width)[:, None], len(padded) - 1)])
                for cut in range(0, scale, width)
            ]
        )
        # Column c: block first - 1 + c; a chain begins where its block and the next are there, and the one before isn't.
        line = np.concatenate([earlier, before, found], axis=1)
        begins = line[:, 1:-1] & line[:, 2:] & ~line[:, :-2]
        for d, c in np.argwhere(begins):
            yield scale * (first - 1 + int(c)), scale + int(d)
        earlier, before = line[:, -2:-1], line[:, -1:]


def run_table(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs of ``words``, sorted; words of different documents (``bounds``) are never equal."""
    found: list[np.ndarray] = []
    for period in range(1, min(PLAIN, len(words))):
        start, length = stretches(np.flatnonzero(words[period:] == words[:-period]))
        keep = length >= max((FOLD - 1) * period, LEAST - period)
        start, length = start[keep], length[keep]
        found.append(np.stack([start, start + length + period, np.full(len(start), period)], axis=1))
    scale = PLAIN
    sizes = np.diff(bounds)
    while (long := np.flatnonzero(sizes >= FOLD * scale)).size:
        own = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in long])
        taken = words[own]
        # Inside a run of a period q up to the scale, only multiples of q recur: those stretches are that run again.
        known = np.concatenate(found)
        known = known[known[:, 2] <= scale]
        known = known[np.argsort(known[:, 0], kind="stable")]
        reach = np.maximum.accumulate(known[:, 1]) if len(known) else known[:, 1]
        rows: dict[tuple[int, int, int], None] = {}
        for s, d in seeds(taken, scale):
            lo = int(own[s])
            k = int(np.searchsorted(known[:, 0], lo, "right"))
            if k and reach[k - 1] >= lo + d + scale:
                continue
            if s + d >= len(taken) or taken[s] != taken[s + d]:
                continue
            ahead = same_ahead(taken, s, s + d, 1)
            back = same_ahead(taken, s - 1, s - 1 + d, -1) if s else 0
            if ahead + back >= (FOLD - 1) * d:
                rows[lo - back, lo + ahead + d, d] = None
        found.append(np.array(list(rows), np.int64).reshape(-1, 3))
        scale *= 2
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    # A stretch found with several periods: the smallest is its own.
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    again = np.zeros(len(every), bool)
    again[1:] = (every[1:, :2] == every[:-1, :2]).all(axis=1)
    every = every[~again]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as bytes: a number for each word (equal where the words of one text are), first and last byte, and words by text."""
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = ~blank
    begins = solid.copy()
    begins[1:] &= blank[:-1] | edge[1:-1]
    first = np.flatnonzero(begins)
    ends = solid.copy()
    ends[:-1] &= blank[1:] | edge[1:-1]
    last = np.flatnonzero(ends)
    kept = np.ascontiguousarray(data[solid])
    cuts = np.concatenate([[0], np.cumsum(last - first + 1)]).astype(np.int64)
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(kept)])
    numbers = spelled.dictionary_encode().indices.to_numpy().astype(np.int64)
    bounds = np.searchsorted(first, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return numbers + owner * (int(numbers.max(initial=0)) + 1), first, last, bounds


def collapsed(data: np.ndarray, first: np.ndarray, last: np.ndarray, bounds: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words, joined by one space within each text, and the texts' offsets in them."""
    change = np.zeros(len(data) + 1, np.int8)
    change[first[kept]] = 1
    change[last[kept] + 1] -= 1
    shown = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    chosen = np.flatnonzero(kept)
    owner = np.searchsorted(bounds, chosen, "right")
    followed = np.concatenate([owner[1:] == owner[:-1], [False]]) if len(chosen) else np.zeros(0, bool)
    blanks = last[chosen[followed]] + 1
    data = data.copy()
    data[blanks] = 0x20
    shown[blanks] = True
    sizes = np.concatenate([[0], np.cumsum(shown)])
    # A text begins with its first word; none of its bytes before that is shown.
    starts = np.append(first, len(data))[np.minimum(bounds, len(first))]
    return data[shown], sizes[starts]


def batches_of_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, offsets, rows in pieces(batch):
            numbers, first, last, bounds = word_numbers(data, offsets)
            table = run_table(numbers, bounds)
            # Words after a run's first period go.
            depth = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(depth, table[:, 0] + table[:, 2], 1)
            np.add.at(depth, table[:, 1], -1)
            out, cuts = collapsed(data, first, last, bounds, np.cumsum(depth[:-1]) == 0)
            owner = np.searchsorted(bounds, table[:, 0], "right") - 1
            lists = np.searchsorted(owner, np.arange(len(bounds))).astype(np.int32)
            runs = pa.StructArray.from_arrays(
                [
                    pa.array(table[:, 0] - bounds[owner]),
                    pa.array(table[:, 1] - table[:, 0]),
                    pa.array(table[:, 2]),
                ],
                fields=list(RUN),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(rows.start, rows.stop - rows.start),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(lists), runs),
                    pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))),
                ],
                schema=OUT,
            )


def collapse(docs: DataFrame) -> DataFrame:
    """Each text's periodic runs, and the text without their repetitions: doc_id, n_words, runs, text.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with smallest period q (words q apart are
    identical) of at least 6 and 4 q words that no neighbouring word extends; ``runs`` lists (start, length, period) by
    start, then period. Words that lie in a run after its first q go; the others are joined by one space.

    Each document is judged alone and whole, in the task that reads it: nothing is shuffled. Periods are looked for
    scale by scale: of each block of 2^k words, one number-theoretic transform of squared differences gives the places in
    the window after it where the whole block recurs; two blocks in a row that recur at one distance seed a run, which is then
    extended word by word. The windows of many documents are transformed together.

    Null texts and texts without words: no runs, an empty text. Null and repeated doc_ids are rows of their own. Other
    columns are ignored. An empty table gives no rows.
    """
    return texts(docs).mapInArrow(
        batches_of_runs, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document (by the crc32 of its doc_id) is made periodic from some word on.

    With h that checksum, g = floor(h / 10) and n words: if h % 10 = 0, each word from a = g % n on is the one at
    a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8)). The words are then joined by one space.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    found = texts(docs).withColumn("h", h).withColumn("g", g)
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    found = found.withColumn("w", words).withColumn("n", F.size("w").cast("long"))
    found = found.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    found = found.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    cut = lambda c, start, length: F.slice(c, start.cast("int"), length.cast("int"))
    rest = F.col("n") - F.col("a")
    times = F.ceil(rest / F.col("p")).cast("int")
    again = cut(F.flatten(F.array_repeat(cut(F.col("w"), F.col("a") + 1, F.col("p")), times)), F.lit(1), rest)
    text = F.array_join(F.concat(cut(F.col("w"), F.lit(1), F.col("a")), again), " ")
    return found.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and hashes of what ``collapse`` gives, and its longest run (ties: smallest start, then period)."""
    longest: Column = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.l") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
