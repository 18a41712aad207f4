"""Substring dedup of words by suffix automata of reference shards.

A shard holds the surroundings of one live gram, in the documents that share it. Its automaton grows in the order of
doc_ids, and every document streams past that of all smaller ones: the matching statistic at a word is the length of
the longest run ending there that the automaton knows. Broadcasting every shard to every document would be
quadratic, so a document goes to the shards alone whose gram it has.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import WORD, boxed, trimmed
from evidlake.llm.repeats import Units, copies, covered, gram_hashes, repeated_windows, words_of

WINDOW, GRAM = 50, 16
# A shard of more different surroundings is split by longer grams before an automaton is built.
SHARD = 48


class Automaton:
    """Suffix automaton of several sequences: states by number, with transitions, suffix link and length."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, p: int, q: int, c: object) -> int:
        new = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence: Iterable) -> None:
        last = 0
        for c in sequence:
            known = self.next[last].get(c)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._clone(last, known, c)
                continue
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
            last = new

    def statistics(self, sequence: Iterable) -> list[int]:
        """For each place the length of the longest run that ends there and is in the automaton."""
        state = size = 0
        out = []
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            else:
                size = 0
            out.append(size)
        return out


def surround(data: np.ndarray, place: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    words = data.tobytes().split()
    unit = words_of(data, np.array([0, len(data)]))[0]
    gram = gram_hashes(unit, units.gram)[place]
    left = np.minimum(place, units.reach)
    right = np.minimum(len(words) - units.gram - place, units.reach)
    lo, hi = (place - left).tolist(), (place + units.gram + right).tolist()
    return gram, left, right, pa.array([b" ".join(words[a:b]) for a, b in zip(lo, hi, strict=True)], pa.binary())


#: A member of a shard: doc_id, words (as numbers), place of its first window, and the rows that have them.
Member = tuple[int, tuple[int, ...], int, list[int]]


def search(members: list[Member], at: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(row, first window, last window) of runs of the members' windows that a member of a smaller doc_id has too.

    All members have the same ``size`` words from place ``at`` on in common, counted in the windows of a member:
    a window w of a member is words w - first to w - first + 49 of it. Members with the same words count once,
    under the smallest doc_id.
    """
    same: dict[tuple, Member] = {}
    for m in sorted(members, key=lambda m: m[0]):
        known = same.setdefault((m[2], m[1]), m)
        if known is not m and known[0] == m[0]:
            same[m[2], m[1]] = (*m[:3], known[3] + m[3])
        elif known is not m:
            yield from ((row, m[2], m[2] + len(m[1]) - WINDOW) for row in m[3])
    heads = list(same.values())
    if len(heads) < 2:
        return
    if len(heads) > SHARD and size < WINDOW:
        yield from split(heads, at, size)
        return
    automaton = Automaton()
    i = 0
    while i < len(heads):
        j = i
        while j < len(heads) and heads[j][0] == heads[i][0]:
            j += 1
        if i:
            for _, words, first, rows in heads[i:j]:
                for lo, hi in long_runs(automaton.statistics(words)):
                    yield from ((row, first + lo, first + hi) for row in rows)
        for head in heads[i:j]:
            automaton.add(head[1])
        i = j


def long_runs(statistics: list[int]) -> Iterator[tuple[int, int]]:
    """First and last start of runs of windows that matching statistics of WINDOW or more end."""
    begin = None
    for end, length in enumerate([*statistics, 0]):
        if length >= WINDOW and begin is None:
            begin = end
        elif length < WINDOW and begin is not None:
            yield begin - WINDOW + 1, end - WINDOW
            begin = None


def split(members: list[Member], at: int, size: int) -> Iterator[tuple[int, int, int]]:
    """Search a large shard in parts by longer common runs.

    A window with the common run has, of the words it holds besides, at least half on one side: it is in the part of
    those members that agree in that many words more on the left, or in the part of those that agree on the right.
    Members are cut down to the windows that a part is about.
    """
    half = -(-(WINDOW - size) // 2)
    for begin in (at - half, at):
        parts: dict[tuple[int, ...], list[int]] = {}
        for i, (_, words, first, _) in enumerate(members):
            lo = begin - first
            if lo >= 0 and lo + size + half <= len(words):
                parts.setdefault(words[lo : lo + size + half], []).append(i)
        while parts:
            _, part = parts.popitem()
            if len({members[i][0] for i in part}) < 2:
                continue
            some = []
            for doc, words, first, rows in (members[i] for i in part):
                # Windows that hold the longer run start from its end - 50 to its begin.
                a, b = max(first, begin + size + half - WINDOW), min(first + len(words) - WINDOW, begin)
                if a <= b:
                    some.append((doc, words[a - first : b - first + WINDOW], a, rows))
            yield from search(some, begin, size + half)


def match(doc: np.ndarray, gram: np.ndarray, left: np.ndarray, right: np.ndarray, raw: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """See ``repeats.Match``: a shard for each gram of the bucket, one after another.

    Equal surroundings enter a shard once, with the smallest doc_id that has them; all windows of the others are
    in that document.
    """
    reach = WINDOW - GRAM
    order = np.lexsort((doc, gram))
    cuts = np.flatnonzero(np.append(True, gram[order][1:] != gram[order][:-1]))
    found = array("q")
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        heads: dict[tuple[int, bytes], tuple[int, list[int]]] = {}
        for i in order[lo:hi].tolist():
            least, rows = heads.setdefault((int(left[i]), raw[i].as_py()), (int(doc[i]), []))
            if doc[i] == least:
                rows.append(i)
            elif left[i] + GRAM + right[i] >= WINDOW:
                found.extend((i, reach - int(left[i]), int(right[i])))
        if len(heads) < 2:
            continue
        numbers: dict[bytes, int] = {}
        members = []
        for (before, text), (least, rows) in heads.items():
            words = tuple(numbers.setdefault(w, len(numbers)) for w in text.split(b" "))
            if len(words) >= WINDOW:
                members.append((least, words, reach - before, rows))
        for hit in search(members, reach, GRAM):
            found.extend(hit)
    return tuple(np.frombuffer(found, np.int64).reshape(-1, 3).T) if found else (np.zeros(0, np.int64),) * 3


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_removed, kept (words left, joined by one blank) of documents that repeat some words."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept = [], []
            for text, windows in zip(batch.column("text"), batch.column("windows"), strict=True):
                words = text.as_buffer().to_pybytes().split()
                lo, hi = covered(windows.values.to_numpy(), WINDOW)
                gone.append(int((hi - lo).sum()))
                left = [w for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(words)], strict=True) for w in words[a:b]]
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                ["d", "t", "gone", "kept"],
            )

    units = Units(words_of, WINDOW, GRAM)
    return repeated_windows(docs, units, surround, match).mapInArrow(trimmed(cut), "d long, t long, gone long, kept string")


def joined_words() -> Column:
    """The words of ``text``, joined by one blank."""
    return F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document when repeated words go.

    A word ([^\\x20\\x09-\\x0D]+) goes if it is in a run of 50 words of its document that also starts in a document with
    a smaller doc_id, judged on the input. Words that stay are joined by one blank. A null text has no words. Rows with
    the same doc_id don't take from each other. A null doc_id neither gives nor takes. No rows: no rows.
    """
    gone = repeats(docs).select("d", "t", "gone", F.sha2("kept", 256).alias("kept")).dropDuplicates(["d", "t"])
    words = F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words")
    all_docs = copies(docs, words, F.sha2(joined_words(), 256).alias("joined"))
    joined = all_docs.join(gone, (F.col("doc_id") == F.col("d")) & (F.col("th") == F.col("t")), "left")
    whole = F.col("is_copy") & (F.col("n_words") >= WINDOW)
    return joined.select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "joined")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated words, with their columns and n_chars of the new text.

    Texts that lose nothing stay as they are; others are their remaining words joined by one blank. A document of
    which no word is left goes; one that had none before stays.
    """
    gone = repeats(docs).select("d", "t", "kept").dropDuplicates(["d", "t"])
    whole = copies(docs, F.regexp_count("text", F.lit(WORD)).alias("n")).where("is_copy").where(F.col("n") >= WINDOW)
    whole = whole.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct().withColumn("kept", F.lit(""))
    rows = boxed(docs, docs["doc_id"].cast("long").alias("id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("th"))
    found = rows.join(gone.unionByName(whole), (F.col("id") == F.col("d")) & (F.col("th") == F.col("t")), "left")
    new = {"text": F.coalesce("kept", "row.text")}
    if "n_chars" in docs.columns:
        length = F.length("kept").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(length)
    return found.where("kept is null or kept <> ''").select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
