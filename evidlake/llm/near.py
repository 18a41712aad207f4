"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and their groups.

The binary tries of ``simhash`` come first: what they link within three bits is checked on the shingles of both. Most pairs at
0.8 differ in more bits, so min-hash bands choose what else meets. In buckets of a few rows each meets the one of the smallest sid,
and is checked with what the tries link. In the others the groups left apart meet, a few bands at a time. A sketch of 200 bytes
drops most that are too far apart, 32 bits of each shingle all others but for collisions (never a near pair), and the shingles
decide. A pair at 0.8 misses all bands with probability 1e-7, and the sketch drops it with about as much.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidlake.llm import simhash
from evidlake.llm.common import pieces, runs, texts, trimmed, written
from evidlake.llm.components import components
from evidlake.llm.repeats import mix, words_of

WORDS, BANDS, ROWS = 5, 40, 5
HASHES = BANDS * ROWS
# Equal bytes of two sketches from which a pair is looked at: 5 standard deviations below what 0.8 gives.
LOW = 130
# Pairs of one bucket that are listed at once, for each of its rows; rows that meet one copy of a set.
AT_ONCE, SIDE_ROWS = 16, 256
# Bands whose buckets are looked at together: what they link leaves the others.
STEP = 20
# Buckets of so many rows are looked at first, before any group is known.
FEW = 4
# Sets of more shingles go without their 32 bits.
LONG = 1 << 14
# Buckets of so many rows are looked at pair by pair, if few of their pairs may be near.
SMALL = 512
_random = np.random.default_rng(5)
_TIMES = _random.integers(0, 1 << 31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _random.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)
NODES = pa.schema([("sid", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("sid", pa.int64()), ("shingles", pa.binary()), ("sketch", pa.binary()), ("low", pa.binary())])
PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("bucket", pa.int64())])


def shingles(unit: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted, distinct 64-bit hashes of all runs of ``words`` words; of shorter texts the one of all their words."""
    n = min(words, len(unit))
    if not n:
        return np.zeros(1, np.uint64)
    h = unit[: len(unit) - n + 1]
    for k in range(1, n):
        h = mix(h, unit[k : len(unit) - n + 1 + k])
    return np.unique(h ^ (h >> np.uint64(32)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over a set."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    small = hashes.astype(np.uint32)
    for i in range(0, len(small), 1024):
        np.minimum(low, (small[None, i : i + 1024] * _TIMES + _PLUS).min(axis=1), out=low)
    return low


def cut(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[np.ndarray], pa.Array]]:
    """Of some rows at once: their shingles and sids (digests of these)."""
    lower = pa.RecordBatch.from_arrays([pc.ascii_lower(batch.column("text"))], ["text"])
    for data, offsets, rows in pieces(lower):
        unit, first = words_of(data, offsets)
        own = [shingles(unit[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield rows, own, pa.array(np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in own], np.uint64).view(np.int64))


def send_nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, own, sid in cut(batch):
            low = np.stack([minima(h) for h in own])
            bucket = np.tile(np.arange(BANDS, dtype=np.uint64), (len(own), 1))
            for r in range(ROWS):
                bucket = mix(bucket, low[:, r::ROWS].astype(np.uint64))
            bands = pa.array(list((bucket ^ (bucket >> np.uint64(32))).view(np.int64)), pa.list_(pa.int64()))
            part = batch.slice(rows.start, rows.stop - rows.start)
            fps = np.array([simhash.simhash(t.as_py().encode(), WORDS) for t in part.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([sid, part.column("doc_id"), pa.array(fps.view(np.int64)), bands], schema=NODES)


def send_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, own, sid in cut(batch):
            sketch = [minima(h).astype(np.uint8).tobytes() for h in own]
            low = [h.astype(np.uint32).tobytes() if len(h) <= LONG else b"" for h in own]
            sent = [pa.array(c, pa.binary()) for c in ([h.tobytes() for h in own], sketch, low)]
            yield pa.RecordBatch.from_arrays([sid, *sent], schema=SETS)


def nodes(docs: DataFrame) -> DataFrame:
    """sid (digest of the set), doc_id, fp (SimHash) and bands (buckets) of every whole text with a doc_id."""
    return texts(docs).where("doc_id is not null").mapInArrow(trimmed(send_nodes), "sid long, doc_id long, fp long, bands array<long>")


def sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """sid, shingles, sketch and low, each sid once, of the texts that have one of the doc_ids and a sid named with it."""
    own = texts(docs).hint("merge").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    own = own.mapInArrow(trimmed(send_sets), "sid long, shingles binary, sketch binary, low binary")
    return own.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("shingles", "sketch", "low")])


def by_tries(own: DataFrame) -> DataFrame:
    """Pairs (u > v) of sids which the tries of ``simhash.links`` link, and of sids with equal fingerprints."""
    fps = own.groupBy("sid").agg(F.min("fp").alias("fp"))
    least = fps.groupBy("fp").agg(F.min("sid").alias("node"))
    equal = fps.join(least, "fp").where("sid <> node").select(F.col("sid").alias("u"), F.col("node").alias("v"))
    both = simhash.links(least).unionByName(equal)
    return both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


def agree(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.count_nonzero(sketches == one, axis=1)


class Shorts:
    """The lowest 16 bits of all shingles of a bucket's rows."""

    def __init__(self, short: list[bytes]) -> None:
        self.size = np.array([len(x) // 2 for x in short])
        self.start = np.append(0, np.cumsum(self.size))
        self.values = np.frombuffer(b"".join(short), np.uint16)
        self.seen = np.zeros(1 << 16, bool)

    def central(self) -> np.ndarray:
        """The rows, those first whose values most rows hold: edits of one text are nearer to it than to each other."""
        held = np.bincount(self.values, minlength=len(self.seen))[self.values]
        total = np.append(0, np.cumsum(held))
        return np.argsort(-(total[self.start[1:]] - total[self.start[:-1]]) / np.maximum(self.size, 1), kind="stable")

    def may(self, one: int, rows: np.ndarray) -> np.ndarray:
        """Whether rows may be near to one. Values in common are at least the shingles in common, so no near one is dropped."""
        own, n = self.values[self.start[one] : self.start[one] + self.size[one]], self.size[rows]
        if not len(own) or not len(rows):
            return np.ones(len(rows), bool)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[rows], n)
        self.seen[own] = True
        both = np.append(0, np.cumsum(self.seen[self.values[at]]))
        self.seen[own] = False
        both = both[np.cumsum(n)] - both[np.cumsum(n) - n]
        return (n == 0) | (9 * both >= 4 * (n + len(own)))


class Lows(Shorts):
    """The same by the lowest 32 bits, numbered: two shingles of a bucket hardly ever have them in common."""

    def __init__(self, low: list[bytes]) -> None:
        self.size = np.array([len(x) // 4 for x in low])
        self.start = np.append(0, np.cumsum(self.size))
        distinct, self.values = np.unique(np.frombuffer(b"".join(low), np.uint32), return_inverse=True)
        self.seen = np.zeros(len(distinct), bool)

    def take(self, order: np.ndarray) -> None:
        """From now on the rows come in this order."""
        self.size, self.start = self.size[order], self.start[order]


def near_to(one: int, rows: np.ndarray, sketch: np.ndarray, shorts: Shorts | None) -> np.ndarray:
    """Which of the rows may be near to one."""
    rows = rows[agree(sketch[rows], sketch[one]) >= LOW]
    return rows[shorts.may(one, rows)] if shorts else rows


def candidates(
    sid: np.ndarray, component: np.ndarray, sketch: np.ndarray, apart: set[tuple[int, int]], shorts: Shorts | None = None
) -> list[tuple[int, int]]:
    """Pairs (u > v) of a bucket's rows to look at next; none if no more of them can link two components.

    First each row meets one head that it may be near to, so that a large group gives a row each. When that
    is settled, all others across components. ``apart``: pairs that are known not to be near.
    """
    pair = lambda i, j: (max(int(sid[i]), int(sid[j])), min(int(sid[i]), int(sid[j])))
    found = []
    left = np.arange(len(sid))
    while len(left):
        head = left[0]
        met = [k for k in near_to(head, left[1:], sketch, shorts) if component[k] == component[head] or pair(k, head) not in apart]
        found += [pair(k, head) for k in met if component[k] != component[head]]
        left = np.setdiff1d(left[1:], met, assume_unique=True)
    if found:
        return found
    names, size = np.unique(component, return_counts=True)
    rest = np.flatnonzero(component != names[np.argmax(size)])
    some: set[tuple[int, int]] = set()
    for i in rest:
        others = np.flatnonzero(component != component[i])
        for j in near_to(i, others, sketch, shorts):
            if pair(i, j) not in apart:
                some.add(pair(i, j))
        if len(some) >= AT_ONCE * len(sid):
            break
    return sorted(some)


def few_pairs(
    sid: np.ndarray, component: np.ndarray, sketch: np.ndarray, apart: set[tuple[int, int]], shorts: Shorts | None = None
) -> list[tuple[int, int]] | None:
    """All pairs across components of a small bucket that may be near; None if they are too many to list at once."""
    if len(sid) > SMALL:
        return None
    found: list[tuple[int, int]] = []
    for i in range(1, len(sid)):
        for j in near_to(i, np.flatnonzero(component[:i] != component[i]), sketch, shorts):
            pair = (max(int(sid[i]), int(sid[j])), min(int(sid[i]), int(sid[j])))
            if pair not in apart:
                found.append(pair)
        if len(found) > AT_ONCE * len(sid):
            return None
    return found


def forest(sid: np.ndarray, component: np.ndarray, sketch: np.ndarray, apart: set[tuple[int, int]], shorts: Shorts) -> list[tuple[int, int]]:
    """Pairs that link all that may be near across a bucket's components: if all of them are near, the bucket is done."""
    row, found = {int(x): k for k, x in enumerate(sid)}, []
    while True:
        more = few_pairs(sid, component, sketch, apart, shorts)
        if not (more := candidates(sid, component, sketch, apart, shorts) if more is None else more):
            return found
        for u, v in more:
            a, b = component[row[u]], component[row[v]]
            if a != b:
                found.append((u, v))
                component = np.where(component == b, a, component)


def in_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, held in runs(batches, "bucket"):
        table = pa.Table.from_batches(held)
        lows = Lows(table.column("low").to_pylist())
        table = table.drop_columns(["low"]).take(pa.array(order := lows.central()))
        lows.take(order)
        sid, component = (table.column(c).to_numpy() for c in ("sid", "component"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
        apart = {(u, v) for u, own in zip(sid.tolist(), table.column("apart").to_pylist(), strict=True) for v in own or ()}
        if found := forest(sid, component, sketch, apart, lows):
            # The one of more pairs is second: ``beside`` spreads its rows.
            many = Counter(x for p in found for x in p)
            found = [(u, v) if many[u] <= many[v] else (v, u) for u, v in found]
            at = [pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*at, pa.array([bucket] * len(found), pa.int64())], schema=PAIRS)


def beside(pairs: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Pairs (u, v) with the column of both. A v of many pairs is dealt over tasks with a copy of its value for each."""
    parts = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / SIDE_ROWS).alias("parts"))
    dealt = pairs.join(parts, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("parts")).alias("part"))
    right = known.select(F.col("sid").alias("v"), F.col(column).alias("b")).join(parts, "v")
    right = right.select("v", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    left = known.select(F.col("sid").alias("u"), F.col(column).alias("a"))
    return dealt.join(right, ["v", "part"]).select("u", "v", "b").join(left, "u").select("u", "v", "a", "b")


def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """near: whether the sets a and b of hashes have a Jaccard similarity of 0.8 or more."""
    for batch in batches:
        near = []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
            both = len(a) + len(b) - len(np.union1d(a, b))
            near.append(5 * both >= 4 * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(near, pa.bool_())], ["u", "v", "near"])


def links(docs: DataFrame, own: DataFrame) -> DataFrame:
    """Edges (u, v) between sids that connect all near pairs; every edge is a near pair. Takes the documents and their ``nodes``."""
    return joined(docs, own, own.select(F.col("sid").alias("u"), F.col("sid").alias("v")).limit(0))[0]


def joined(docs: DataFrame, own: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``links``, and the components (node, component) of these and the given edges.

    What the tries link and what buckets of a few rows give is judged first, then the larger buckets of some bands at a time.
    Only those with several components are looked at. A bucket is done when all pairs that it gives are near, and looked at again
    when the shingles refute one: 32 bits of each leave that to collisions and to sets of more than ``LONG``.
    """
    one = own.groupBy("sid").agg(F.first("bands").alias("bands"))
    rows = one.select("sid", F.posexplode("bands").alias("band", "bucket"))
    inside = Window.partitionBy("bucket")
    rows = rows.withColumn("least", F.min("sid").over(inside)).withColumn("n", F.count(F.lit(1)).over(inside))
    rows = rows.where("n > 1").select("sid", "bucket", "least", "n", F.floor(F.col("band") / STEP).cast("int").alias("step"))
    rows = written(rows, "near-rows")
    few = rows.where((F.col("n") <= FEW) & (F.col("sid") > F.col("least"))).select(F.col("sid").alias("u"), F.col("least").alias("v"))
    pairs = written(by_tries(own).union(few).distinct(), "near-pairs")
    # The shingles are made again, of one document for each sid that may meet another: of all they would be more than the texts.
    some = rows.select("sid").union(pairs.select("u")).union(pairs.select("v")).distinct()
    ids = own.groupBy("sid").agg(F.min("doc_id").alias("doc_id")).join(some, "sid", "left_semi")
    met = written(sets(docs, ids), "near-sets")

    def judge(pairs: DataFrame) -> DataFrame:
        return written(beside(pairs, met, "shingles").mapInArrow(trimmed(compare), "u long, v long, near boolean"), "near")

    def labels(judged: DataFrame) -> DataFrame:
        return components(judged.where("near").select("u", "v").unionByName(given))

    judged = judge(pairs)
    label = labels(judged)
    for step in range(-(-BANDS // STEP)):
        # The one pair of a bucket of two is judged.
        left = rows.where((F.col("step") == step) & (F.col("n") > 2)).select("sid", "bucket")
        while True:
            known = left.join(label, F.col("sid") == F.col("node"), "left").select("sid", "bucket", F.coalesce("component", "sid").alias("component"))
            known = known.withColumn("a", F.min("component").over(inside)).withColumn("b", F.max("component").over(inside)).where("a < b")
            known = known.select("sid", "bucket", "component")
            apart = judged.where("not near").groupBy(F.greatest("u", "v").alias("sid")).agg(F.collect_set(F.least("u", "v")).alias("apart"))
            side = met.select("sid", "sketch", "low").join(apart, "sid", "left")
            found = known.join(side, "sid").repartition("bucket").sortWithinPartitions("bucket", "sid")
            found = written(found.mapInArrow(trimmed(in_buckets), "u long, v long, bucket long"), "near-found")
            if found.isEmpty():
                break
            new = judge(found.groupBy(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).agg(F.first("u").alias("u"), F.first("v").alias("v")).select("u", "v"))
            judged = judged.unionByName(new)
            if not new.where("near").isEmpty():
                label = labels(judged)
            ends = [F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")]
            wrong = new.where("not near").select(*ends)
            again = written(found.select("bucket", *ends).join(wrong, ["x", "y"], "left_semi").select("bucket").distinct(), "near-again")
            if again.isEmpty():
                break
            left = left.join(again, "bucket", "left_semi")
    return judged.where("near").select("u", "v"), label


def groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that near pairs reach, itself included) of documents with a doc_id.

    Texts with the same shingles are one node, texts with no words too. Rows with the same doc_id are in one group.
    """
    own = written(nodes(docs), "near-all")
    ids = own.select("doc_id", "sid").distinct()
    first = ids.groupBy("doc_id").agg(F.min("sid").alias("v"), F.max("sid").alias("most")).where("v < most")
    several = ids.join(first, "doc_id").select(F.col("sid").alias("u"), "v")
    _, found = joined(docs, own, several)
    named = written(ids.join(found, F.col("sid") == F.col("node"), "left").select("doc_id", F.coalesce("component", "sid").alias("c")), "near-groups")
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "c").select("doc_id", "component_id").distinct()


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each group stays: see ``simhash.keep_first``."""
    return simhash.keep_first(docs, groups(docs))
