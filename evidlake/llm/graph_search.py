"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard, and beam search in all of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidlake.llm.common import written
from evidlake.llm.topk import meetings, whole

# Out-degree after pruning and before, list length of the searches that propose neighbours, slack of the pruning rule, list
# length of a query.
DEGREE, ROOM, PROPOSED, SLACK, WIDTH = 24, 40, 48, 1.2, 240
# Vector components of one shard (16384 vectors of 64): what a task holds, and the unit a query is copied to.
COMPONENTS = 1 << 20
AT_ONCE, EXPANDED = 256, 4
# Every so many'th place is a gate; walks start at the entry and the nearest gates, so that no far cluster is missed.
GATE, STARTS = 32, 8
# Places a walk went through first, proposed as neighbours besides those it ended at.
PATH = 16
INDEX = "block int, place int, node long, vector array<double>, ids array<long>, near array<int>, entry boolean"
HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Graph:
    """Vectors of a shard with directed edges. Place ``n`` stands for no place; its row is far from everything."""

    def __init__(self, vectors: np.ndarray):
        self.n = len(vectors)
        # Searches run on 4-byte numbers, scaled so that squares can't overflow; answers are measured on the originals.
        top = np.abs(vectors).max(initial=0)
        scale = 2.0 ** -np.ceil(np.log2(top)) if top > 0 else 1.0
        self.x = np.zeros((self.n + 1, vectors.shape[1]), np.float32)
        self.x[: self.n] = vectors * scale
        self.scale = scale
        self.near = np.full((self.n + 1, ROOM), self.n, np.int32)
        self.entry = 0
        if self.n:
            self.entry = int(np.argmin(((self.x[: self.n] - self.x[: self.n].mean(axis=0)) ** 2).sum(axis=1)))
        self.gates = np.arange(0, self.n, GATE)

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """The ``width`` nearest places that greedy walks meet, nearest first."""
        out = np.full((len(queries), width), self.n, np.int64)
        for lo in range(0, len(queries), AT_ONCE):
            out[lo : lo + AT_ONCE] = self._walk(queries[lo : lo + AT_ONCE], width, self.gates)[0]
        return out

    def _walk(self, queries: np.ndarray, width: int, gates: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places met, nearest first, and the places expanded first; ``own`` places are passed over."""
        count, n = len(queries), self.n
        out = np.full((count, width), n, np.int64)
        path = np.full((count, PATH), n, np.int64)
        alive, step = np.arange(count), 0
        seen = np.zeros((count, n + 1), bool)
        seen[:, n] = True
        if own is not None:
            seen[alive, own] = True
        beam = np.full((count, width), n, np.int64)
        far = np.full((count, width), np.inf, np.float32)
        done = np.ones((count, width), bool)
        gates = gates[gates != self.entry]
        starts = np.full((count, 1 + min(STARTS, len(gates), width - 1)), self.entry)
        if starts.shape[1] > 1:
            span = (self.x[gates] ** 2).sum(axis=1) - 2 * (queries @ self.x[gates].T)
            starts[:, 1:] = gates[np.argpartition(span, starts.shape[1] - 2, axis=1)[:, : starts.shape[1] - 1]]
        seen[alive[:, None], starts] = True
        span = ((self.x[starts] - queries[:, None]) ** 2).sum(axis=2)
        order = np.argsort(span, axis=1, kind="stable")
        k = starts.shape[1]
        beam[:, :k], far[:, :k] = starts[alive[:, None], order], span[alive[:, None], order]
        done[:, :k] = False
        slots = np.arange(width)
        while True:
            # The nearest few of each list that were not expanded yet.
            first = np.where(done, width, slots)
            first = np.partition(first, EXPANDED - 1, axis=1)[:, :EXPANDED] if width > EXPANDED else first
            ended = first.min(axis=1) == width
            if ended.any():
                out[alive[ended]] = beam[ended]
                stay = ~ended
                alive, seen, beam, far, done, first, queries = (
                    a[stay] for a in (alive, seen, beam, far, done, first, queries)
                )
                if not len(alive):
                    break
            rows = np.arange(len(alive))[:, None]
            padded = np.concatenate([beam, np.full((len(alive), 1), n)], axis=1)
            at = padded[rows, first]
            real = first < width
            done[np.broadcast_to(rows, first.shape)[real], first[real]] = True
            if step < PATH:
                path[alive, step : step + at.shape[1]] = at[:, : PATH - step]
                step += at.shape[1]
            met = np.sort(self.near[at].reshape(len(alive), -1), axis=1).astype(np.int64)
            fresh = ~seen[rows, met]
            fresh[:, 1:] &= met[:, 1:] != met[:, :-1]
            r, c = np.nonzero(fresh)
            places = met[r, c]
            seen[r, places] = True
            span = np.full(met.shape, np.inf, np.float32)
            apart = self.x[places] - queries[r]
            span[r, c] = np.einsum("md,md->m", apart, apart)
            span = np.concatenate([far, span], axis=1)
            order = np.argsort(span, axis=1, kind="stable")[:, :width]
            far = span[rows, order]
            beam = np.concatenate([beam, met], axis=1)[rows, order]
            done = np.concatenate([done, ~fresh], axis=1)[rows, order] | np.isinf(far)
        if own is not None:
            # The entry may be its own place.
            out[out == own[:, None]] = n
        return out, path

    def pruned(self, places: np.ndarray, proposed: np.ndarray) -> np.ndarray:
        """For each place, of the proposed neighbours the nearest first, without those nearer to one already kept (by the slack)."""
        rows = np.arange(len(places))[:, None]
        x = self.x[proposed] - self.x[places][:, None]
        span = np.einsum("nkd,nkd->nk", x, x)
        span[(proposed == self.n) | (proposed == places[:, None])] = np.inf
        order = np.argsort(span, axis=1, kind="stable")
        proposed, span, x = proposed[rows, order], span[rows, order], x[rows, order]
        # A place proposed twice counts once.
        twice = np.zeros(proposed.shape, bool)
        by_place = np.argsort(proposed, axis=1, kind="stable")
        ranked = proposed[rows, by_place]
        twice[rows, by_place[:, 1:]] = ranked[:, 1:] == ranked[:, :-1]
        open_ = np.isfinite(span) & ~twice
        size = np.einsum("nkd,nkd->nk", x, x)
        between = size[:, :, None] + size[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
        kept = np.full((len(places), ROOM), self.n, np.int32)
        for slot in range(DEGREE):
            some = open_.any(axis=1)
            if not some.any():
                break
            first = open_.argmax(axis=1)
            kept[some, slot] = proposed[np.arange(len(places)), first][some]
            open_ &= SLACK**2 * between[np.arange(len(places)), first] > span
            open_[np.arange(len(places)), first] = False
        return kept

    def build(self) -> None:
        """Insert all places, in batches that are at most as large as what is there already."""
        order = np.delete(np.arange(self.n), self.entry) if self.n else np.arange(0)
        done = 1
        while done <= len(order):
            batch = order[done - 1 : done - 1 + min(done, AT_ONCE)]
            met, path = self._walk(self.x[batch], PROPOSED, self.gates[self.gates < batch[0]], batch)
            self.near[batch] = self.pruned(batch, np.concatenate([met, path], axis=1))
            self._link_back(batch)
            done += len(batch)
        self._reach_all()

    def _link_back(self, batch: np.ndarray) -> None:
        """Each new edge also backwards; lists that would overflow are pruned anew."""
        source = np.repeat(batch, ROOM)
        target = self.near[batch].ravel().astype(np.int64)
        real = target < self.n
        source, target = source[real], target[real]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        places, first, counts = np.unique(target, return_index=True, return_counts=True)
        degree = (self.near[places] < self.n).sum(axis=1)
        fits = degree + counts <= ROOM
        slot = np.arange(len(target)) - np.repeat(first, counts) + np.repeat(degree, counts)
        easy = np.repeat(fits, counts)
        self.near[target[easy], slot[easy]] = source[easy]
        hard = np.flatnonzero(~fits)
        hard = hard[np.argsort(counts[hard], kind="stable")]
        for lo in range(0, len(hard), 64):
            some = hard[lo : lo + 64]
            most = int(counts[some].max())
            proposed = np.full((len(some), ROOM + most), self.n, np.int64)
            proposed[:, :ROOM] = self.near[places[some]]
            for i, h in enumerate(some):
                proposed[i, ROOM : ROOM + counts[h]] = source[first[h] : first[h] + counts[h]]
            self.near[places[some]] = self.pruned(places[some], proposed)

    def _reach_all(self) -> None:
        """Places that no walk can reach get an edge from one that walks can: lists may become longer than the degree."""
        extra: list[tuple[int, int]] = []
        reached = np.zeros(self.n + 1, bool)
        front = np.array([self.entry]) if self.n else np.arange(0)
        reached[[self.entry, self.n]] = True
        while True:
            while len(front):
                met = np.unique(self.near[front])
                front = met[~reached[met]]
                reached[front] = True
            lost = np.flatnonzero(~reached)
            if not len(lost):
                break
            # This walk meets reached places only; the nearest of them is as good a way in as any.
            at = lost[:1]
            gates = self.gates[reached[self.gates]]
            extra.append((int(self._walk(self.x[at], PROPOSED, gates, at)[0][0, 0]), int(at[0])))
            reached[at] = True
            front = at
        if extra:
            source = np.array([s for s, _ in extra])
            _, counts = np.unique(source, return_counts=True)
            more = np.full((self.n + 1, int(counts.max())), self.n, np.int32)
            used = np.zeros(self.n + 1, int)
            for s, t in extra:
                more[s, used[s]] = t
                used[s] += 1
            self.near = np.concatenate([self.near, more], axis=1)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = vectors.flatten().to_numpy()
    return out


def usable(embedding: Column) -> Column:
    """Vectors that are there, with finite components that are not all zero."""
    return whole(embedding) & F.exists(embedding, lambda x: x != 0)


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """Equal vectors as one node: node (its smallest vec_id), vector and ids, its k + 1 smallest vec_ids.

    With k + 1 ids at the same distance, none of them the query's own but one, no other copy can be among a query's k
    nearest. Ids beyond that rank leave before the shuffle, so a hot vector never gathers.
    """
    order = Window.partitionBy("vector").orderBy("vec_id")
    first = vectors.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k + 1)
    return first.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(
        F.col("ids")[0].alias("node"), "vector", "ids"
    )


def index(vectors: DataFrame, k: int = 10, components: int = COMPONENTS) -> DataFrame:
    """The written graph index of all rows (vec_id, vector: array of double): INDEX, one row for each different vector.

    Vectors are dealt to shards by their hash, each of about ``components`` numbers in all, and one task builds a shard's
    graph: each vector is searched for among those inserted before it, what its walk met is pruned to at most DEGREE
    neighbours in unlike directions, and edges are added backwards. Every vector can be reached from the shard's
    entry. Larger shards mean fewer copies of each query. ``k`` is the most neighbours a search may ask for.
    """
    nodes = written(classes(vectors, k), "nodes")
    total = nodes.agg(F.sum(F.size("vector").cast("long"))).first()[0] or 0
    shards = max(1, -(-total // components))
    # Vectors that differ only in trailing zeros meet in different classes; both are nodes.
    dealt = nodes.select(
        F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("block"), F.lit(0).alias("kind"), "node", "vector", "ids"
    ).repartition(int(shards), "block")
    sorted_ = dealt.sortWithinPartitions("block", F.xxhash64("node"), "node")
    schema = pa.schema(
        [
            ("block", pa.int32()), ("place", pa.int32()), ("node", pa.int64()), ("vector", pa.list_(pa.float64())),
            ("ids", pa.list_(pa.int64())), ("near", pa.list_(pa.int32())), ("entry", pa.bool_()),
        ]
    )

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in shards_of(batches):
            graph = Graph(matrix(rows.column("vector")))
            graph.build()
            near = graph.near[: graph.n]
            real = near < graph.n
            ends = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
            yield from pa.Table.from_arrays(
                [
                    pa.array(np.full(graph.n, block, np.int32)), pa.array(np.arange(graph.n, dtype=np.int32)),
                    rows.column("node"), rows.column("vector"), rows.column("ids"),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(near[real])),
                    pa.array(np.arange(graph.n) == graph.entry),
                ],
                schema=schema,
            ).to_batches(4096)

    return written(sorted_.mapInArrow(build, INDEX), "graph")


def shards_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Of batches sorted by ``block``: each shard, whose size is bounded, with all its rows."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        keys = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi == lo:
                continue
            if held and keys[lo] != at:
                yield at, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            at = int(keys[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield at, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def loaded(rows: pa.RecordBatch) -> tuple[Graph, np.ndarray]:
    vectors = matrix(rows.column("vector"))
    graph = Graph(vectors)
    near = rows.column("near")
    lengths = np.diff(near.offsets.to_numpy())
    graph.near = np.full((graph.n + 1, max(1, int(lengths.max(initial=1)))), graph.n, np.int32)
    owner = np.repeat(np.arange(graph.n), lengths)
    graph.near[owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = near.flatten().to_numpy()
    graph.entry = int(np.flatnonzero(rows.column("entry").to_numpy(zero_copy_only=False))[0])
    return graph, vectors


def search(graphs: DataFrame, queries: DataFrame, k: int = 10, width: int = WIDTH) -> DataFrame:
    """The k nearest rows that beam searches of every shard find for each query: query_id, rank, vec_id, score.

    ``graphs`` is an ``index`` built for k or more, ``queries`` has (vec_id, vector). Each query goes to each shard, walks from the
    entry with a list of ``width`` and keeps its k best there; a window over those ranks them. Distances of answers are
    Euclidean, in double precision on the original vectors; ties go to the smaller vec_id. A shard of at most ``width`` vectors is
    scanned whole, so small tables are answered exactly. A query's own vec_id is no answer of its.
    """
    blocks = graphs.agg(F.max("block")).first()[0]
    blocks = 0 if blocks is None else blocks + 1
    none = lambda kind: F.lit(None).cast(kind)
    candidates = graphs.select(
        "block", F.lit(0).alias("kind"), F.col("node").alias("vec_id"), "place", "vector", "ids", "near", "entry"
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)) if blocks else F.array().cast("array<int>")).alias("block"),
        F.lit(1).alias("kind"), "vec_id", F.lit(0).alias("place"), "vector",
        none("array<long>").alias("ids"), none("array<int>").alias("near"), none("boolean").alias("entry"),
    )
    dealt = candidates.unionByName(asked).repartition(max(1, blocks), "block").sortWithinPartitions("block", "kind", "place", "vec_id")

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, vectors, ids = None, None, None
        for held, parts in meetings(batches, AT_ONCE):
            if held is not None:
                graph, vectors = loaded(held)
                ids = held.column("ids")
            for batch in parts:
                own = batch.column("vec_id").to_numpy()
                asked = matrix(batch.column("vector"))
                least = np.zeros((len(asked), max(asked.shape[1], vectors.shape[1])))
                least[:, : asked.shape[1]] = asked
                rest = (least[:, vectors.shape[1] :] ** 2).sum(axis=1)
                least = least[:, : vectors.shape[1]]
                if graph.n <= width:
                    met = np.broadcast_to(np.arange(graph.n), (len(own), graph.n))
                else:
                    met = graph.search((least * graph.scale).astype(np.float32), width)
                yield best(own, least, rest, met, vectors, ids, k)

    hits = dealt.mapInArrow(answer, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def best(own: np.ndarray, asked: np.ndarray, rest: np.ndarray, met: np.ndarray, vectors: np.ndarray, ids: pa.ListArray, k: int) -> pa.RecordBatch:
    """Of the nodes each query met, the k nearest rows by exact distance."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    offsets, flat = ids.offsets.to_numpy(), ids.flatten().to_numpy()
    offsets = offsets - offsets[0]
    for query, vector, more, places in zip(own, asked, rest, met, strict=True):
        places = places[places < len(vectors)]
        span = np.sqrt(((vectors[places] - vector) ** 2).sum(axis=1) + more)
        if len(places) > k + 1:
            near = span <= np.partition(span, k)[k]
            places, span = places[near], span[near]
        counts = offsets[places + 1] - offsets[places]
        rows = np.repeat(offsets[places] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        members, span = flat[rows], np.repeat(span, counts)
        keep = members != query
        members, span = members[keep], span[keep]
        order = np.lexsort((members, span))[:k]
        found.append((np.full(len(order), query), members[order], span[order]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=HITS)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, width: int = WIDTH, components: int = COMPONENTS) -> DataFrame:
    """The k nearest rows found for each row of ``vectors`` (vec_id, embedding) that is a query: query_id, rank, vec_id, score.

    Null, zero and empty vectors, those with null or non-finite components, and null ids take no part. Shorter vectors end in
    zeros. Rows that are equal in id and vector are one; rows of one id with different vectors are candidates each, and that
    id is asked once, with its least vector. Equal vectors are one node of the graph. Other columns are ignored. A table
    without usable vectors gives no rows.
    """
    rows = vectors.where(usable(vectors["embedding"]) & vectors["vec_id"].isNotNull()).select(
        vectors["vec_id"].cast("long").alias("vec_id"),
        # -0.0 is 0.0, so that equal vectors group together.
        F.transform(vectors["embedding"], lambda x: x.cast("double") + F.lit(0.0)).alias("vector"),
    )
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return search(index(rows, k, components), asked, k, width)
