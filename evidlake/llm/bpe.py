"""Token ids of whole texts with a byte-level BPE of the tokenizers library, many rows at once.

Byte-level BPE cuts a text into pre-tokens by a fixed pattern and merges inside each of them alone. So the cuts are
found here for all rows together by array operations, and the library's model is asked once for each distinct
pre-token; a worker keeps the answers in a hash table of bounded size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from evidlake.llm.common import Run, trimmed

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0
# What the pattern's \s matches.
BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Bytes of text that are encoded at once, and pre-tokens that a task remembers at most: some 100 MB together.
RUN, KNOWN = 1 << 19, 1 << 20
# Bytes of what a worker still remembers after a task.
KEPT = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@cache
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[BLANKS] = BLANK
    return table


@cache
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it is printable Latin-1, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def cuts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. points: code points of all rows; first: True where a row begins."""
    kind = classes()[points]
    n = len(points)
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    # A single U+0020 before a run of another kind belongs to it.
    joined = np.zeros(n, bool)
    joined[1:] = (points[:-1] == 32) & ~blank[1:] & ~first[1:]
    begin &= ~joined
    # The last blank of several before another character stands alone, or with it.
    begin[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:]
    # Contractions: 's 't 'm 'd and 're 've 'll.
    quote = np.flatnonzero((points[:-1] == 39) & begin[:-1] & ~first[1:])
    if len(quote):
        padded = np.append(points, [0, 0])
        one, two = padded[quote + 1], np.where(np.append(first, [True, True])[quote + 2], 0, padded[quote + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((two == ord("l")) & (one == ord("l")))
        ends = np.where(short, quote + 2, quote + 3)[short | long]
        begin[quote[short | long] + 1] = False
        begin[ends[ends < n]] = True
    return np.flatnonzero(begin)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.power = self.inverse = np.ones(1, np.uint64)
        self.forget(16)

    def forget(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.at = np.zeros(1 << bits, np.int64)
        self.count = np.zeros(1 << bits, np.int32)
        self.ids = np.zeros(1 << bits, np.int32)
        self.used = 0

    def shrink(self) -> None:
        """Keep a small memory for the worker's next task, and none of one that grew."""
        held = (self.keys, self.at, self.count, self.ids, self.power, self.inverse)
        if sum(x.nbytes for x in held) > KEPT:
            self.power = self.inverse = np.ones(1, np.uint64)
            self.forget(16)

    def powers(self, n: int) -> None:
        if len(self.power) < n:
            step, back = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
            self.power = np.cumprod(np.append(np.uint64(1), np.full(n, step, np.uint64)), dtype=np.uint64)
            self.inverse = np.cumprod(np.append(np.uint64(1), np.full(n, back, np.uint64)), dtype=np.uint64)

    def hashes(self, points: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """64 bits of each pre-token, never 0."""
        self.powers(len(points))
        x = (points.astype(np.uint64) + np.uint64(1)) * _ODD
        x ^= x >> np.uint64(31)
        x *= self.power[: len(x)]
        h = np.add.reduceat(x, begin) * self.inverse[begin]
        h ^= np.diff(np.append(begin, len(points))).astype(np.uint64) * _MIX
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        return h | np.uint64(1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of the hashes; -1 for unknown ones."""
        mask = np.int64((1 << self.bits) - 1)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        slot[held == 0] = -1
        look = np.flatnonzero((held != h) & (held != 0))
        while len(look):
            slot[look] = (slot[look] + 1) & mask
            held = self.keys[slot[look]]
            slot[look[held == 0]] = -1
            look = look[(held != h[look]) & (held != 0)]
        return slot

    def put(self, h: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        """Add distinct hashes that are not there yet."""
        while (self.n + len(h)) * 2 > 1 << self.bits:
            full = np.flatnonzero(self.keys)
            old = self.keys[full], self.at[full], self.count[full]
            self.bits += 1
            self.keys = np.zeros(1 << self.bits, np.uint64)
            self.at, self.count = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int32)
            self._place(*old)
        self._place(h, at, count)
        self.n += len(h)

    def _place(self, h: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        mask = np.int64((1 << self.bits) - 1)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            s = slot[todo]
            free = self.keys[s] == 0
            self.keys[s[free]] = h[todo[free]]  # of several for one slot the last stays
            mine = self.keys[s] == h[todo]
            self.at[s[mine]], self.count[s[mine]] = at[todo[mine]], count[todo[mine]]
            todo = todo[~mine]
            slot[todo] = (slot[todo] + 1) & mask

    def learn(self, h: np.ndarray, words: list[str]) -> None:
        if self.n + len(h) > KNOWN:
            self.forget(16)
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        found = [[t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))] for w in words]
        count = np.array([len(f) for f in found], np.int32)
        flat = np.array([i for f in found for i in f], np.int32)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids[: self.used], np.zeros(self.used + 2 * len(flat), np.int32))
        self.ids[self.used : self.used + len(flat)] = flat
        self.put(h, self.used + np.cumsum(count, dtype=np.int64) - count, count)
        self.used += len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and how many each row has, as ``encode(..., add_special_tokens=False)``."""
        raw = data.tobytes()
        rows = len(offsets) - 1
        if any(s in raw for s in self.special):
            # A special token's string is cut out before the pattern applies: these rows go through the library alone.
            parts = [
                np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, np.int32)
                if any(s in t for s in self.special)
                else self.encode(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
                for t in (raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))
            ]
            return np.concatenate(parts), np.array([len(p) for p in parts])
        if not raw:
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        text = raw.decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(points) == len(data):
            edges = offsets
        else:
            edges = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
        first = np.zeros(len(points), bool)
        first[edges[:-1][edges[:-1] < len(points)]] = True
        begin = cuts(points, first)
        h = self.hashes(points, begin)
        slot = self.find(h)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, where = np.unique(h[missing], return_index=True)
            lo, hi = begin[missing[where]], np.append(begin, len(points))[missing[where] + 1]
            before = self.n
            self.learn(new, [text[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            if self.n < before + len(new):  # what was known is forgotten: learn this run's pre-tokens anew
                new, where = np.unique(h, return_index=True)
                lost = self.find(new) < 0
                new, where = new[lost], where[lost]
                ends = np.append(begin, len(points))
                for i in range(0, len(new), KNOWN // 2):
                    some = where[i : i + KNOWN // 2]
                    self.learn(new[i : i + KNOWN // 2], [text[a:b] for a, b in zip(begin[some], ends[some + 1], strict=True)])
            slot = self.find(h)
        count = self.count[slot].astype(np.int64)
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.at[slot] - (ends - count), count) + np.arange(ends[-1])]
        return ids, np.diff(np.append(0, ends)[np.searchsorted(begin, edges)])


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, which keeps it from task to task."""
    return Encoder(path)


def encoding(path: str, run: Callable[[Encoder, Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Run:
    """``run`` with the worker's encoder, which is small again when the task ends."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        try:
            yield from run(own, batches)
        finally:
            own.shrink()

    return trimmed(task)


def standard_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
