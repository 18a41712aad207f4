"""Spelling variants: words one edit apart, found through an index of variable-length grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidlake.llm.common import pieces, written

# Words are at least LEAST code points long and occur at least OFTEN times.
LEAST, OFTEN = 6, 5
# Grams have SHORT to LONG code points (LONG at most LEAST, so that an edit always leaves one gram of a word untouched).
SHORT, LONG = 2, 5
# A gram that more words hold than this is heavy and is lengthened; the limit grows with the words where more than HEAVY grams
# would be heavy otherwise, so the dictionary of heavy grams is bounded.
FEW, HEAVY = 64, 1 << 17
# Lists of an index key that are longer than this go another way.
LISTED = 256
# Marks before and after a word.
BEGIN, END = "<", ">"
COUNTS = pa.schema([("word", pa.large_string()), ("n", pa.int64())])
GRAMS = "word string, size int, at int, gram string, prefix int"

_POLYNOMIAL = 0xEDB88320


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


def crc32_of(data: np.ndarray, first: np.ndarray, last: np.ndarray, start: np.ndarray) -> np.ndarray:
    """crc32 of each stretch of bytes (``last`` excluded), carried on from a crc32 of what comes before it."""
    table = crc_table()
    out = ~start.astype(np.uint32)
    order = np.argsort(last - first, kind="stable")
    sizes = (last - first)[order]
    at = first[order]
    crc = out[order]
    done = 0
    for k in range(int(sizes.max(initial=0))):
        done = int(np.searchsorted(sizes, k, "right"))
        crc[done:] = table[(crc[done:] ^ data[at[done:] + k]) & 0xFF] ^ crc[done:] >> 8
    out[order] = crc
    return ~out


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text): the words of each piece of text and how often they occur there."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for data, offsets, rows in pieces(batch):
            words, n = words_of(data, offsets, ids[rows])
            yield pa.RecordBatch.from_arrays([words, n], schema=COUNTS)


def words_of(data: np.ndarray, offsets: np.ndarray, ids: list[int | None]) -> tuple[pa.Array, pa.Array]:
    """Maximal runs of letters, A-Z lower-cased, one letter in 199 runs of a document deleted; those of LEAST code points."""
    lead = data == 0xC3  # U+00C0 to U+00FF are C3 and one byte more
    upper = (data >= 0x41) & (data <= 0x5A)
    letter = lead | upper | ((data >= 0x61) & (data <= 0x7A))
    letter[1:] |= lead[:-1]
    data = np.where(upper, data | 0x20, data).astype(np.uint8)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1:-1]
    ends[:-1] &= ~letter[1:] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    size = last - first - (leads[last] - leads[first])
    first, last = first[size >= LEAST], last[size >= LEAST]
    owner = np.searchsorted(offsets, first, "right") - 1
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    marked = crc32_of(data, first, last, before[owner])
    hit = marked % 199 == 0
    changed = []
    for lo, hi, h in zip(first[hit], last[hit], marked[hit], strict=True):
        run = data[lo:hi].tobytes().decode()
        at = int(h) % len(run)
        if len(run) > LEAST:
            changed.append(run[:at] + run[at + 1 :])
    first, last = first[~hit], last[~hit]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[first] = 1
    inside[last] -= 1
    kept = np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)])
    cuts = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
    plain = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(cuts), pa.py_buffer(kept))
    every = pa.concat_arrays([plain, pa.array(changed, pa.large_string())])
    found = every.value_counts()
    return found.field("values"), found.field("counts")


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: every word of LEAST code points and its occurrences over all documents, if OFTEN or more."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).where("text is not null")
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def grams_of(word: str, heavy: set[str]) -> list[str]:
    """One gram for each place of a word: the shortest from there that is not heavy, or the longest there is."""
    marked = BEGIN + word + END
    out = []
    for i in range(len(marked) - SHORT + 1):
        q = SHORT
        while q < LONG and i + q < len(marked) and marked[i : i + q] in heavy:
            q += 1
        out.append(marked[i : i + q])
    return out


def affected(grams: list[str], size: int) -> int:
    """The most grams of a word that one edit can touch: those over one code point, or over one gap."""
    over = [0] * (size + 3)
    for i, g in enumerate(grams):
        # A gram over places i to i + q - 1 is touched by edits of those places; gaps lie between two of them.
        over[i] += 1
        over[min(i + len(g), size + 2)] -= 1
    most = running = 0
    for k in range(size + 2):
        running += over[k]
        most = max(most, running)
    return most


def frequencies(words: DataFrame) -> DataFrame:
    """gram, held: how often each gram of SHORT to LONG code points occurs in the words."""
    marked = F.concat(F.lit(BEGIN), F.col("word"), F.lit(END))
    size = F.length("word") + 2

    def of(q: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(size - q + 1, F.lit(1))), lambda i: F.substring(marked, i, F.lit(q)))

    every = F.flatten(F.array(*[of(q) for q in range(SHORT, LONG + 1)]))
    return words.select(F.explode(every).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("held"))


def heavy_grams(held: DataFrame) -> set[str]:
    """Grams that are lengthened: few enough for every task, as each is held by more than its share of all gram places."""
    places = held.agg(F.sum("held")).first()[0] or 0
    limit = max(FEW, -(-places // HEAVY))
    return {r.gram for r in held.where((F.col("held") > limit) & (F.length("gram") < LONG)).select("gram").collect()}


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of words that differ by exactly one inserted, deleted or replaced code point.

    A word is cut into one gram for each place: the shortest one there that is not heavy (few words hold it). An edit
    touches at most NAG of them, so two near words have all but NAG in common, each at the same distance from
    the begin or from the end, and one of the NAG + 1 rarest of both is such a gram. These make the keys (gram, distance) of the
    index, and the lists of equal keys are merged to candidates, which are then verified. Words of keys whose lists are
    too long (all of their grams are common) meet by what is left of them without one code point instead; such a list holds
    only words that are one insertion from the same string, so it is bounded.
    """
    spark = words.sparkSession
    held = written(frequencies(words), "grams")
    heavy = spark.sparkContext.broadcast(heavy_grams(held))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, int, int, str, int]] = []
            for word in batch.column("word").to_pylist():
                grams = grams_of(word, heavy.value)
                prefix = affected(grams, len(word)) + 1
                rows += [(word, len(word), i, g, prefix) for i, g in enumerate(grams)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()))],
                names=["word", "size", "at", "gram", "prefix"],
            )

    rarest = Window.partitionBy("word").orderBy("held", "gram", "at")
    cuts = words.select("word").mapInArrow(cut, GRAMS).join(held, "gram")
    firsts = cuts.withColumn("place", F.row_number().over(rarest)).where("place <= prefix")
    # Distance from the begin, or from the end of the marked word.
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.col("at").alias("far")),
        F.struct(F.lit(1).alias("side"), (F.col("size") + 2 - F.col("at")).alias("far")),
    )
    keys = written(firsts.select("word", "size", "gram", F.explode(ends).alias("e")).select("word", "size", "gram", "e.side", "e.far"), "keys")
    lists = keys.groupBy("gram", "side", "far").agg(F.count(F.lit(1)).alias("listed")).where("listed > 1")
    placed = keys.join(lists, ["gram", "side", "far"])
    short = placed.where(F.col("listed") <= LISTED)
    other = short.select("gram", "side", "far", F.col("word").alias("b"), F.col("size").alias("b_size"))
    merged = (
        short.withColumnRenamed("word", "a").join(other, ["gram", "side", "far"])
        .where("a < b and abs(size - b_size) <= 1").select("a", "b")
    )
    crowded = placed.where(F.col("listed") > LISTED).select("word").distinct()
    left = F.array_distinct(
        F.concat(
            F.array("word"),
            F.transform(
                F.sequence(F.lit(1), F.length("word")),
                lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))),
            ),
        )
    )
    variants = crowded.select("word", F.explode(left).alias("rest"))
    by_rest = variants.withColumnRenamed("word", "a").join(variants.withColumnRenamed("word", "b"), "rest").where("a < b").select("a", "b")
    return merged.unionByName(by_rest).distinct().where(F.levenshtein("a", "b", 1) == 1)


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``words`` (word, n; each word once).

    Near words differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts a word's. Its form is its near word of
    largest n (ties: smallest in code-point order) if that n is at least 5 times its own, else null; ``root`` follows forms to the
    last one. Counts grow fivefold with each step, so a few rounds of pointer doubling reach all roots. Near pairs are
    kept as rows and only ever counted and compared by aggregates. No words: no rows.
    """
    words = written(words.select("word", "n"), "words")
    pairs = written(near_pairs(words), "pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = both.join(counts, "near").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("b")
    )
    found = words.join(best, "word", "left").withColumn("takes", -F.col("b.m") >= 5 * F.col("n"))
    found = written(
        found.select(
            "word", F.when(F.col("takes"), F.col("b.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("takes"), -F.col("b.m")).alias("form_n"),
        ),
        "forms",
    )
    links = found.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")), "roots")
        if not links.where("moved").limit(1).count():
            break
        links = links.select("word", "root")
    return found.join(links, "word").select("word", "form", "root", "n", "n_near", "form_n")


def groups(docs: DataFrame) -> DataFrame:
    """Variants of the words of a table of documents (doc_id, text): see ``variants``.

    Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts with only A-Z lower-cased; with h the crc32 of
    ``<doc_id>:<run>``, runs with h % 199 = 0 lose the code point h % length. Words count from 6 code points and 5 occurrences.

    Null texts have no words; a null doc_id is spelled as nothing. Repeated rows count each. Other columns are ignored. Texts are
    counted in pieces of whole rows, so a very long text is held once. An empty table gives no rows.
    """
    return variants(vocabulary(docs))
