"""SimHash fingerprints of documents, and their near-duplicate groups by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidlake.llm.common import boxed, texts, written
from evidlake.llm.components import components

BITS, BLOCKS = 64, 4
WIDTH = BITS // BLOCKS
# Node pairs that are taken a level down at once.
PAIRS = 1 << 18
# Fingerprints whose tries are walked together.
ROWS = 1 << 15
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def simhash(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the XXH64 of all word shingles, repeats included."""
    own = text.lower().split()  # of bytes: A-Z alone, and the six ASCII blanks
    if not own:
        return 0
    joined = b" ".join(own)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(own) - words + 1)
    last = ends[words - 1 :] if len(own) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64
    )
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 8192):
        bits = np.unpackbits(hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text; null or wordless texts have 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(t.as_py().encode(), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], schema=FINGERPRINTS
            )

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(values: np.ndarray, fixed: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Self-join of the binary trie over sorted, distinct 64-bit values.

    A node is a run of values with a common prefix. Pairs of nodes go down the trie together, bit by bit, and
    carry the bits they differ in; a pair with more than ``budget`` is dropped. The first ``fixed`` bits must be equal.
    Gives index pairs (i < j) that link; where a pair of nodes can't exceed the budget any more, or a node is
    alone, only a star over its values, which connects the same.
    """
    n = len(values)
    # ones[d][i]: how many of the first i values have bit d (from the top) set.
    ones: dict[int, np.ndarray] = {}

    def count(depth: int) -> np.ndarray:
        if depth not in ones:
            bit = (values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        return ones[depth]

    top = values >> np.uint64(BITS - fixed)
    starts = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
    ends = np.append(starts[1:], n)
    many = ends - starts > 1
    a = np.stack([starts[many], ends[many], starts[many], ends[many], np.zeros(many.sum(), np.int64)])
    stack = [(fixed, a)]
    while stack:
        depth, p = stack.pop()
        if p.shape[1] > PAIRS:
            half = p.shape[1] // 2
            stack += [(depth, p[:, :half]), (depth, p[:, half:])]
            continue
        sizes = (p[1] - p[0], p[3] - p[2])
        self_pair = p[0] == p[2]
        alone = (sizes[0] == 1) & (sizes[1] == 1)
        if alone.any():
            i, j = p[0][alone & ~self_pair], p[2][alone & ~self_pair]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            yield i[near], j[near]
        sure = ~alone & (p[4] + (BITS - depth) <= budget)
        if sure.any():
            q = p[:, sure]
            yield spread(q[0], q[0], q[1])
            yield spread(q[0], q[2], q[3])
        p, self_pair = p[:, ~alone & ~sure], self_pair[~alone & ~sure]
        if not p.shape[1]:
            continue
        c = count(depth)
        mid_a, mid_b = p[1] - (c[p[1]] - c[p[0]]), p[3] - (c[p[3]] - c[p[2]])
        down = [
            np.stack([p[0], mid_a, p[2], mid_b, p[4]]),
            np.stack([mid_a, p[1], mid_b, p[3], p[4]]),
            np.stack([p[0], mid_a, mid_b, p[3], p[4] + 1]),
            np.stack([mid_a, p[1], p[2], mid_b, p[4] + 1])[:, ~self_pair],
        ]
        below = np.concatenate(down, axis=1)
        below = below[:, (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= budget)]
        lone = (below[0] == below[2]) & (below[1] - below[0] == 1)
        if (below := below[:, ~lone]).shape[1]:
            stack.append((depth + 1, below))


def spread(head: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each head with every index from lo to below hi, but itself."""
    n = hi - lo
    heads = np.repeat(head, n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return heads[at != heads], at[at != heads]


def join_roots(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the index of a root) after linking the pairs."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def links(nodes: DataFrame, budget: int = 3) -> DataFrame:
    """Edges (u, v) that connect all fingerprints which differ in at most ``budget`` bits.

    Takes distinct fingerprints (fp, node). With four blocks of 16 bits, two fingerprints within three bits have
    a block in common: each fingerprint goes to four tries, rotated so that one of its blocks is on top, and
    the rows of a block value meet. A task walks its tries a few thousand fingerprints at a time and gives a
    spanning forest of what it links, so a group of n fingerprints gives less than n edges a trie, not n * n.
    """
    if budget >= BLOCKS:
        raise ValueError(f"at most {BLOCKS - 1} bits")
    turned = nodes.select(
        "node",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(r).alias("r"),
                        (F.shiftleft("fp", r * WIDTH).bitwiseOR(F.shiftrightunsigned("fp", BITS - r * WIDTH)) if r else F.col("fp")).alias("value"),
                    )
                    for r in range(BLOCKS)
                ]
            )
        ).alias("t"),
    ).select("node", F.col("t.r").alias("r"), F.col("t.value").alias("value"))
    block = F.shiftrightunsigned("value", BITS - WIDTH)
    dealt = turned.withColumn("block", block * BLOCKS + F.col("r")).repartition("block").sortWithinPartitions("block", "value")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_blocks(batches, ROWS):
            keys, values, node = (part.column(c).to_numpy() for c in ("block", "value", "node"))
            for r in range(BLOCKS):
                own = np.flatnonzero(keys % BLOCKS == r)
                if len(own) < 2:
                    continue
                v, ids = values[own].view(np.uint64), node[own]
                order = np.argsort(v)
                v, ids = v[order], ids[order]
                labels = np.arange(len(v))
                for i, j in trie_pairs(v, WIDTH, budget):
                    labels = join_roots(labels, i, j)
                linked = np.flatnonzero(labels != np.arange(len(v)))
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[labels[linked]])], schema=EDGES)

    return dealt.mapInArrow(run, "u long, v long")


def whole_blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``rows`` rows that end where a block ends."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("block").to_numpy()
        if n >= rows:
            last = held[-1].column("block")[-1].as_py()
            end = int(np.searchsorted(keys != last, True)) if keys[-1] != last else len(keys)
            held.append(batch.slice(0, end))
            if end == len(keys):
                continue
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, batch = [], 0, batch.slice(end)
        held.append(batch)
        n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def groups(docs: DataFrame, words: int = 3, budget: int = 3) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that links reach, itself included.

    Fingerprints of documents with no words are 0 and link like any other. Equal fingerprints count once in the
    tries, under their smallest doc_id. Rows with the same doc_id are one node; if their texts differ, the group
    holds the groups of all of them. Rows with a null doc_id stay alone: their component_id is null.
    """
    fps = written(fingerprints(docs, words), "simhash")
    known = fps.where("doc_id is not null").distinct()
    nodes = written(known.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    # A doc_id with several fingerprints links them.
    several = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    own = known.join(several, "doc_id", "left_semi").join(nodes, "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    found = components(links(nodes, budget).unionByName(own))
    classes = nodes.join(found, "node", "left").select(
        F.col("fp").alias("f"), F.coalesce("component", "node").alias("component_id")
    )
    return fps.join(classes, F.col("fp") == F.col("f"), "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of one document of each group (doc_id, component_id): that with its smallest doc_id; the columns stay as they are.

    Of repeated rows with that doc_id the first by text and source stays. Rows with a null doc_id all stay.
    """
    best = found.where("doc_id = component_id").select(F.col("doc_id").alias("best")).distinct()
    rows = boxed(docs, docs["doc_id"].cast("long").alias("id"))
    first = Window.partitionBy("id").orderBy("row.text", "row.source")
    kept = rows.join(best, F.col("id") == F.col("best"), "left_semi").withColumn("nr", F.row_number().over(first))
    return kept.where("nr = 1").select("row.*").unionByName(docs.where(docs["doc_id"].isNull()))


def near_dedup(docs: DataFrame, words: int = 3, budget: int = 3) -> DataFrame:
    """One document of each group of fingerprints stays: see ``keep_first``."""
    return keep_first(docs, groups(docs, words, budget))
