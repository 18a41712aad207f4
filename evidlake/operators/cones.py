"""An index of cones for exact similarity search: k nearest, and all above a threshold.

References hang in a tree of cones around pivot directions: about one leaf for each ``leaf_rows`` references, in about as many
inner cones as each of these has leaves. The tree is small (at most 65,536 pivots, whatever the table), so every task
walks it; the references are written once, by leaf. A query first scores the leaf it points at, which gives it a k-th best
similarity, and then only those leaves that can hold a better one by the triangle inequality on angles. Leaves side by side
are a group, of which there are about sixteen: a query is sent once to each group that holds one of its leaves and passes over
the others there, so what is sent grows with the tables and not with pairs of them, until groups reach a bounded size.
Groups and the queries that visit them are blocks of bounded size, and only k rows of a query leave a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidlake.session import stored

LEAVES = 1 << 16
LEAF_ROWS = BLOCK_ROWS = 2048
SLACK = 1e-6
AT_ONCE = 512
# Groups of leaves, rows of one at most; products at once, pairs scored at once.
GROUPS, MOST_ROWS = 16, 1 << 16
TILE, AT_A_TIME = 1 << 21, 1 << 16
_HITS = "query_id bigint, ref_id bigint, similarity double"


def unit_rows(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    m = np.array(column.tolist(), dtype=float)
    size = np.linalg.norm(m, axis=1)
    return m / np.maximum(size, 1e-300)[:, None], size


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _best(angle: np.ndarray, radius: np.ndarray, high: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The greatest inner product queries of ``size`` can have with any member of a cone at these angles."""
    cos = np.cos(np.maximum(0.0, angle - radius))
    return size[:, None] * np.where(cos >= 0, cos * high, cos * low)


def _least(angle: np.ndarray, radius: np.ndarray, high: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The smallest such product."""
    cos = np.cos(np.minimum(np.pi, angle + radius))
    return size[:, None] * np.where(cos >= 0, cos * low, cos * high)


@dataclass
class Tree:
    """Inner pivots, leaf pivots sorted by inner cone (``bounds`` cuts them), and what the references of each cone span."""

    inner: np.ndarray
    leaves: np.ndarray
    bounds: np.ndarray
    count: np.ndarray | None = None
    radius: np.ndarray | None = None
    high: np.ndarray | None = None
    low: np.ndarray | None = None
    inner_radius: np.ndarray | None = None

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf, angle to its pivot and angle to the inner pivot of each row."""
        near = _angles(unit, self.inner)
        cone = near.argmin(axis=1)
        leaf, angle = np.zeros(len(unit), int), np.zeros(len(unit))
        for c in np.unique(cone):
            rows = np.flatnonzero(cone == c)
            lo, hi = self.bounds[c : c + 2]
            own = _angles(unit[rows], self.leaves[lo:hi])
            leaf[rows] = lo + own.argmin(axis=1)
            angle[rows] = own.min(axis=1)
        return leaf, angle, near[np.arange(len(unit)), cone]

    def first(self, unit: np.ndarray, need: int) -> list[np.ndarray]:
        """For each query the leaves it points at, nearest first, as many as hold ``need`` references."""
        near = _angles(unit, self.inner)
        out = []
        for row, order in zip(unit, near.argsort(axis=1), strict=True):
            picked, seen = [], 0
            for c in order:
                lo, hi = self.bounds[c : c + 2]
                for leaf in lo + _angles(row[None], self.leaves[lo:hi])[0].argsort():
                    if self.count[leaf]:
                        picked.append(leaf)
                        seen += self.count[leaf]
                    if seen >= need:
                        break
                if seen >= need:
                    break
            out.append(np.array(picked, int))
        return out

    def reach(
        self, unit: np.ndarray, size: np.ndarray, floor: np.ndarray, spread: np.ndarray | None = None, over: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf) of all leaves that can hold a reference as similar as the query's floor: from cone to cone.

        With ``spread`` a query stands for all directions up to that angle from it. Leaves whose references are all more
        similar than ``over`` are left out; the third array counts their references for each query.
        """
        tops = np.maximum.reduceat(self.high, self.bounds[:-1])
        bottoms = np.minimum.reduceat(self.low, self.bounds[:-1])
        wide = (np.zeros(len(unit)) if spread is None else spread)[:, None]
        open_ = _best(_angles(unit, self.inner), self.inner_radius + wide, tops, bottoms, size) >= floor[:, None]
        rows, leaves, above = [], [], np.zeros(len(unit), int)
        for c in np.flatnonzero(open_.any(axis=0)):
            lo, hi = self.bounds[c : c + 2]
            some = np.flatnonzero(open_[:, c])
            angle, span = _angles(unit[some], self.leaves[lo:hi]), self.radius[lo:hi] + wide[some]
            bound = _best(angle, span, self.high[lo:hi], self.low[lo:hi], size[some])
            met = (bound >= floor[some, None]) & (self.count[lo:hi] > 0)
            if over is not None:
                whole = met & (_least(angle, span, self.high[lo:hi], self.low[lo:hi], size[some]) > over[some, None])
                above[some] += whole @ self.count[lo:hi]
                met &= ~whole
            r, leaf = np.nonzero(met)
            rows.append(some[r])
            leaves.append(lo + leaf)
        none = np.zeros(0, int)
        return np.concatenate([none, *rows]), np.concatenate([none, *leaves]), above


def plant(sample: np.ndarray, leaves: int) -> Tree:
    """A tree over a bounded sample of unit vectors: inner pivots are means of the samples around them."""
    inner = sample[: max(1, round(len(sample) ** 0.5))].copy()
    for _ in range(3):
        cone = (sample @ inner.T).argmax(axis=1)
        for c in range(len(inner)):
            middle = sample[cone == c].sum(axis=0)
            if np.linalg.norm(middle) > 1e-12:
                inner[c] = middle / np.linalg.norm(middle)
    cone = (sample @ inner.T).argmax(axis=1)
    used = np.unique(cone)
    order = np.argsort(cone, kind="stable")
    return Tree(inner[used], sample[order], np.append(np.searchsorted(cone[order], used), len(sample)))


@dataclass
class Cones:
    """The written index: references by leaf (``ref_id, cell, vec``), and the tree."""

    tree: Tree | None
    placed: DataFrame
    total: int
    cosine: bool


def _sample(refs: DataFrame, count: int) -> np.ndarray:
    rows = refs.select("vec").orderBy(F.md5(F.col("ref_id").cast("string"))).limit(count).collect()
    m = np.array([r[0] for r in rows], dtype=float).reshape(len(rows), -1)
    size = np.linalg.norm(m, axis=1)
    return m[size > 1e-12] / size[size > 1e-12, None]


def build(refs: DataFrame, metric: str = "cosine", leaf_rows: int = LEAF_ROWS, keep: bool = False) -> Cones:
    """Index of ``refs(ref_id, vec)``. The driver gets a sample of one direction for each leaf and, for each leaf, four
    numbers: at most 65,536 rows of both. A table of one leaf is left as it is unless it is to be kept."""
    cosine = metric == "cosine"
    refs = refs.select("ref_id", "vec")
    total = refs.count()
    leaves = min(LEAVES, -(-total // leaf_rows))
    sample = _sample(refs, leaves) if leaves > 1 else np.zeros((0, 0))
    tree = plant(sample, leaves) if len(sample) > 1 else None

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            unit, size = unit_rows(pdf["vec"])
            leaf, angle, wide = tree.place(unit) if tree else (np.zeros(len(pdf), int), np.zeros(len(pdf)), np.zeros(len(pdf)))
            yield pd.DataFrame(
                {
                    "ref_id": pdf["ref_id"], "cell": leaf, "angle": angle, "wide": wide, "size": np.ones(len(pdf)) if cosine else size,
                    "vec": list(unit if cosine else unit * size[:, None]),
                }
            )

    placed = refs.mapInPandas(place, "ref_id bigint, cell int, angle double, wide double, size double, vec array<double>")
    if tree is None:
        return Cones(None, stored(placed, "cones") if keep else placed, total, cosine)
    placed = stored(placed, "cones")
    spans = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"), F.max("wide").alias("wide"), F.max("size").alias("high"), F.min("size").alias("low")
    ).collect()
    count = len(tree.leaves)
    tree.count, tree.radius, tree.high = np.zeros(count, int), np.zeros(count), np.full(count, -np.inf)
    tree.low, wide = np.full(count, np.inf), np.zeros(count)
    for r in spans:
        tree.count[r.cell], tree.radius[r.cell], tree.high[r.cell], tree.low[r.cell], wide[r.cell] = r.n, r.radius, r.high, r.low, r.wide
    # Empty leaves are never visited; neutral numbers keep their cones' bounds those of the others.
    empty = tree.count == 0
    tree.high[empty], tree.low[empty] = 0.0, tree.low[~empty].min(initial=0.0)
    tree.inner_radius = np.maximum.reduceat(wide, tree.bounds[:-1])
    return Cones(tree, placed, total, cosine)


def _groups(cones: Cones, block_rows: int) -> tuple[np.ndarray, int]:
    """The group of each leaf, and about how many references a group has: leaves side by side, about ``GROUPS`` groups of
    them until these would hold more than ``MOST_ROWS``."""
    rows = min(MOST_ROWS, max(block_rows, -(-cones.total // GROUPS)))
    count = np.array([cones.total]) if cones.tree is None else cones.tree.count
    return np.unique((np.cumsum(count) - count) // rows, return_inverse=True)[1].astype(np.int32), rows


def _aimed(queries: DataFrame, cones: Cones, group: np.ndarray, pick: Callable, listed: bool) -> DataFrame:
    """A row for each query: ``query_id, vec, floor``, the ``groups`` that hold the leaves ``pick`` chooses and, if ``listed``, these ``cells``."""
    cosine, many, floors = cones.cosine, int(group.max(initial=0)) + 1, "floor" in queries.columns

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[lo : lo + AT_ONCE]
                unit, size = unit_rows(part["vec"])
                size = np.ones(len(part)) if cosine else size
                floor = part["floor"].to_numpy() if floors else np.full(len(part), -np.inf)
                rows, cells = pick(unit, size, floor)
                owner, to = np.divmod(np.unique(rows * many + group[cells]), many)
                ends = np.arange(1, len(part))
                order = np.argsort(rows, kind="stable")
                own = np.split(cells[order], np.searchsorted(rows[order], ends)) if listed else [None] * len(part)
                yield pd.DataFrame(
                    {
                        "query_id": part["query_id"].to_numpy(), "vec": list(unit * size[:, None]), "floor": floor,
                        "cells": own, "groups": np.split(to, np.searchsorted(owner, ends)),
                    }
                )

    columns = ["query_id", "vec", *(["floor"] if floors else [])]
    return queries.select(*columns).mapInPandas(aim, "query_id bigint, vec array<double>, floor double, cells array<int>, groups array<int>")


class _Block:
    """Queries of one task that meet the references of a group as these come, leaf by leaf.

    A product in single precision drops all pairs that can't reach a query's floor; the others are scored in double
    precision. With ``k`` the floor rises with the k best so far; without, all pairs from the floor on are given.
    """

    def __init__(self, cones: Cones, k: int | None, exclude_self: bool):
        self.tree, self.cosine, self.k, self.exclude_self = cones.tree, cones.cosine, k, exclude_self
        self.parts: list[pa.RecordBatch] = []
        self.vec: np.ndarray | None = None

    def take(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def begin(self) -> None:
        table = pa.Table.from_batches(self.parts).combine_chunks()
        self.parts = []
        self.ids, self.floor = table["id"].to_numpy(), table["floor"].to_numpy().copy()
        self.vec = _matrix(table["vec"].combine_chunks())
        self.size = np.linalg.norm(self.vec, axis=1)
        self.unit = self.vec / np.maximum(self.size, 1e-300)[:, None] if self.tree else None
        self.single = self.vec.astype(np.float32)
        if self.k:
            self.floor -= 1e-11
            self.best, self.best_id = np.full((len(self.ids), self.k), -np.inf), np.full((len(self.ids), self.k), np.iinfo(np.int64).max)
        cells = table["cells"].combine_chunks()
        self.listed = None
        if cells.null_count == 0:
            rows, cells = np.repeat(np.arange(len(self.ids)), cells.value_lengths().to_numpy()), cells.flatten().to_numpy()
            order = np.argsort(cells, kind="stable")
            self.listed, self.listed_rows = cells[order], rows[order]

    def visitors(self, cell: int) -> np.ndarray:
        """Queries that must meet a leaf."""
        if self.tree is None:
            return np.arange(len(self.ids))
        if self.listed is not None:
            lo, hi = np.searchsorted(self.listed, [cell, cell + 1])
            return self.listed_rows[lo:hi]
        t, one = self.tree, slice(cell, cell + 1)
        size = np.ones(len(self.ids)) if self.cosine else self.size
        return np.flatnonzero(_best(_angles(self.unit, t.leaves[one]), t.radius[one], t.high[one], t.low[one], size)[:, 0] >= self.floor - SLACK)

    def meet(self, batch: pa.RecordBatch, cell: int) -> Iterator[pa.RecordBatch]:
        if self.vec is None:
            self.begin()
        rows = self.visitors(cell)
        if not len(rows):
            return
        ids, vec = batch.column("id").to_numpy(), _matrix(batch.column("vec"))
        most = np.linalg.norm(vec, axis=1).max()
        # Products of single numbers would overflow beyond; below, their error is bounded by this share of both sizes.
        wide = max(most, self.size[rows].max()) > 1e15
        left, right = (self.vec, vec) if wide else (self.single, vec.astype(np.float32))
        error = (vec.shape[1] + 4) * 2.0**-23 * most * self.size
        tall = max(1, TILE // len(ids))
        for at in range(0, len(rows), tall):
            own, start = rows[at : at + tall], 0
            while start < len(ids):
                # A query without a floor gets one from a few references first.
                open_ = self.k and np.isneginf(self.floor[own]).any()
                end = min(len(ids), start + max(64, self.k)) if open_ else len(ids)
                low = (self.floor[own] - error[own] - 1e-11).astype(left.dtype)
                found = np.flatnonzero(left[own] @ right[start:end].T >= low[:, None])
                for some in range(0, len(found), AT_A_TIME):
                    i, j = np.divmod(found[some : some + AT_A_TIME], end - start)
                    hits = self.judge(own[i], ids[start + j], np.einsum("ij,ij->i", self.vec[own[i]], vec[start + j]))
                    if hits is not None:
                        yield hits
                start = end

    def judge(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch | None:
        score = np.round(score, 12)
        if self.cosine:
            np.clip(score, -1.0, 1.0, out=score)
        keep = np.isfinite(score) & (score >= self.floor[rows])
        if self.exclude_self:
            keep &= self.ids[rows] != ids
        if self.k:
            last = self.best[rows, -1]
            keep &= (score > last) | ((score == last) & (ids < self.best_id[rows, -1]))
        rows, ids, score = rows[keep], ids[keep], score[keep]
        if not self.k:
            return _hits(self.ids[rows], ids, score)
        touched, at = np.unique(rows, return_inverse=True)
        at = np.concatenate([at, np.repeat(np.arange(len(touched)), self.k)])
        score, ids = np.concatenate([score, self.best[touched].ravel()]), np.concatenate([ids, self.best_id[touched].ravel()])
        order = np.lexsort((ids, -score, at))
        first = order[np.searchsorted(at[order], np.arange(len(touched)))[:, None] + np.arange(self.k)]
        self.best[touched], self.best_id[touched] = score[first], ids[first]
        self.floor[touched] = np.maximum(self.floor[touched], self.best[touched, -1])
        return None

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.k and self.vec is not None:
            rows, at = np.nonzero(self.best > -np.inf)
            for lo in range(0, len(rows), AT_A_TIME):
                i, j = rows[lo : lo + AT_A_TIME], at[lo : lo + AT_A_TIME]
                yield _hits(self.ids[i], self.best_id[i, j], self.best[i, j])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _hits(query: np.ndarray, ref: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ref), pa.array(score)], ["query_id", "ref_id", "similarity"])


def _dealt(visits: DataFrame, cones: Cones, group: np.ndarray, rows: int) -> DataFrame:
    """Queries and references of each group, both in blocks, with the queries of a block before its references.

    A query is sent to a group once, however many of its leaves it meets.
    """
    spark = visits.sparkSession
    count = np.array([cones.total]) if cones.tree is None else cones.tree.count
    held = np.bincount(group, count)
    leaves = [(i, int(g), max(1, int(-(-held[g] // (2 * rows))))) for i, g in enumerate(group)]
    # At most LEAVES rows, as the tree that every task holds.
    leaves = F.broadcast(spark.createDataFrame(leaves, "cell int, group int, ref_blocks int"))
    asked = visits.select(F.explode("groups").alias("group")).groupBy("group").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("query_blocks"))
    asked = F.broadcast(leaves.select("group", "ref_blocks").distinct().join(asked, "group"))
    part = lambda name, of: F.pmod(F.xxhash64(name), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = visits.select("query_id", "vec", "floor", "cells", F.explode("groups").alias("group")).join(asked, "group").select(
        "group", part("query_id", "query_blocks").alias("qb"), every("ref_blocks").alias("rb"), F.lit(False).alias("ref"),
        F.col("query_id").alias("id"), F.lit(-1).alias("cell"), "vec", "floor", "cells",
    )
    right = cones.placed.select("ref_id", "cell", "vec").join(leaves.drop("ref_blocks"), "cell").join(asked, "group").select(
        "group", every("query_blocks").alias("qb"), part("ref_id", "ref_blocks").alias("rb"), F.lit(True).alias("ref"),
        F.col("ref_id").alias("id"), "cell", "vec", F.lit(None).cast("double").alias("floor"), F.lit(None).cast("array<int>").alias("cells"),
    )
    key = ["group", "rb", "qb"]
    return left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "ref", "cell", "id")


def _walked(visits: DataFrame, cones: Cones, group: np.ndarray, rows: int, k: int | None, exclude_self: bool) -> DataFrame:
    """``query_id, ref_id, similarity`` of the k best of each query in each block, or of all pairs from the floor on."""
    tree = Cones(cones.tree, None, cones.total, cones.cosine)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            of = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("group", "rb", "qb", "ref", "cell")])
            cuts = np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if hi == lo:
                    continue
                if block is None or key != tuple(of[:3, lo]):
                    if block is not None:
                        yield from block.rest()
                    key, block = tuple(of[:3, lo]), _Block(tree, k, exclude_self)
                if not of[3, lo]:
                    block.take(batch.slice(lo, hi - lo))
                elif block.parts or block.vec is not None:
                    yield from block.meet(batch.slice(lo, hi - lo), int(of[4, lo]))
        if block is not None:
            yield from block.rest()

    return _dealt(visits, cones, group, rows).mapInArrow(walk, _HITS)


def _met(visits: DataFrame, cones: Cones, block_rows: int, score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``score`` of the visits of a leaf and the leaf's references, both in blocks of bounded size."""
    sizes = cones.placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    asked = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
    blocks = sizes.join(asked, "cell").select(
        "cell", F.ceil(F.col("n") / block_rows).cast("int").alias("ref_blocks"), F.ceil(F.col("asked") / block_rows).cast("int").alias("query_blocks")
    )
    # At most one row for each leaf, and there are at most LEAVES of them.
    blocks = F.broadcast(blocks)
    part = lambda name, of: F.pmod(F.xxhash64(name), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = visits.join(blocks, "cell").select(*visits.columns, part("query_id", "query_blocks").alias("qb"), every("ref_blocks").alias("rb"))
    right = cones.placed.select("ref_id", "cell", "vec").join(blocks, "cell").select(
        "ref_id", "cell", "vec", part("ref_id", "ref_blocks").alias("rb"), every("query_blocks").alias("qb")
    )
    key = ["cell", "rb", "qb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(score, schema)


def _similarities(q: pd.DataFrame, r: pd.DataFrame) -> np.ndarray:
    return np.round(np.array(q["vec"].tolist()) @ np.array(r["vec"].tolist()).T, 12)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("ref_id"))
    return hits.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def _first(cones: Cones, k: int, exclude_self: bool) -> Callable:
    tree, need = cones.tree, k + 1 if exclude_self else k

    def first(unit: np.ndarray, size: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = tree.first(unit, need)
        return np.repeat(np.arange(len(unit)), [len(f) for f in found]), np.concatenate([np.zeros(0, int), *found])

    return first


def _floored(queries: DataFrame, cones: Cones, k: int, exclude_self: bool, block_rows: int) -> DataFrame:
    """Queries with a floor: their k-th best similarity in the leaves they point at."""
    group, rows = _groups(cones, block_rows)
    begun = stored(_aimed(queries, cones, group, _first(cones, k, exclude_self), True), "visits")
    hits = _ranked(_walked(begun, cones, group, rows, k, exclude_self), k).where(F.col("rank") == k)
    floors = hits.select(F.col("query_id").alias("__q"), F.col("similarity").alias("floor"))
    asked = queries.select("query_id", "vec").join(floors, F.col("query_id") == F.col("__q"), "left")
    return asked.withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))


def nearest(queries: DataFrame, cones: Cones, k: int, exclude_self: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k most similar references of every query, exactly: ``query_id, ref_id, similarity, rank``; ties go to the smaller
    ``ref_id``. ``queries(query_id, vec)``, each id once. Queries whose k-th best is beaten by a whole leaf never meet its members."""
    tree = cones.tree
    group, rows = _groups(cones, block_rows)

    def pick(unit: np.ndarray, size: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if tree is None:
            return np.arange(len(unit)), np.zeros(len(unit), int)
        return tree.reach(unit, size, floor - SLACK)[:2]

    asked = queries.select("query_id", "vec") if tree is None else _floored(queries, cones, k, exclude_self, block_rows)
    visits = stored(_aimed(asked, cones, group, pick, False), "visits")
    return _ranked(_walked(visits, cones, group, rows, k, exclude_self), k)


def cost(queries: DataFrame, cones: Cones, k: int, exclude_self: bool = True) -> DataFrame:
    """How many references each query is scored against, and which share of all that is: ``query_id, leaves, scored, share``."""
    tree, total = cones.tree, cones.total
    if tree is None:
        return queries.select("query_id", F.lit(1).cast("bigint").alias("leaves"), F.lit(total).cast("bigint").alias("scored"), F.lit(1.0).alias("share"))
    first, cosine = _first(cones, k, exclude_self), cones.cosine

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[lo : lo + AT_ONCE]
                unit, size = unit_rows(part["vec"])
                size = np.ones(len(part)) if cosine else size
                chosen = [first(unit, size, None), tree.reach(unit, size, part["floor"].to_numpy() - SLACK)[:2]]
                met = np.unique(np.concatenate([r * len(tree.count) + c for r, c in chosen]))
                rows, cells = np.divmod(met, len(tree.count))
                n = len(part)
                scored = np.bincount(rows, tree.count[cells], n)
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy(), "leaves": np.bincount(rows, minlength=n), "scored": scored.astype(int), "share": scored / total})

    return _floored(queries, cones, k, exclude_self, BLOCK_ROWS).mapInPandas(count, "query_id bigint, leaves bigint, scored bigint, share double")


def within(queries: DataFrame, cones: Cones, floor: float, exclude_self: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All pairs of a query and a reference that are at least as similar as ``floor``: ``query_id, ref_id, similarity``."""
    tree = cones.tree
    group, rows = _groups(cones, block_rows)

    def pick(unit: np.ndarray, size: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if tree is None:
            return np.arange(len(unit)), np.zeros(len(unit), int)
        return tree.reach(unit, size, low - SLACK)[:2]

    asked = queries.select("query_id", "vec", F.lit(float(floor)).alias("floor"))
    visits = stored(_aimed(asked, cones, group, pick, False), "visits")
    return _walked(visits, cones, group, rows, None, exclude_self)


def rivals(queries: DataFrame, cones: Cones, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (``query_id, ref_id``) of a cone of directions and a reference that may be as similar to some of them as the
    cone's floor. ``queries(query_id, vec, spread, floor)``: ``vec`` the middle, ``spread`` the angle around it."""
    tree = cones.tree

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[lo : lo + AT_ONCE]
                unit, _ = unit_rows(part["vec"])
                rows, cells = np.arange(len(part)), np.zeros(len(part), int)
                if tree:
                    rows, cells, _ = tree.reach(unit, np.ones(len(part)), part["floor"].to_numpy() - SLACK, part["spread"].to_numpy())
                if len(rows):
                    yield part.iloc[rows].assign(vec=list(unit[rows]), cell=cells)

    def choose(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "ref_id": []})
        to, size = unit_rows(r["vec"])
        angle = np.maximum(0.0, _angles(np.array(q["vec"].tolist()), to) - q["spread"].to_numpy()[:, None])
        may = np.cos(angle) * size >= q["floor"].to_numpy()[:, None] - SLACK
        rows, columns = np.nonzero(may & (q["query_id"].to_numpy()[:, None] != r["ref_id"].to_numpy()))
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[rows], "ref_id": r["ref_id"].to_numpy()[columns]})

    asked = queries.select("query_id", "vec", "spread", "floor")
    visits = asked.mapInPandas(aim, "query_id bigint, vec array<double>, spread double, floor double, cell int")
    return _met(stored(visits, "visits") if tree else visits, cones, block_rows, choose, "query_id bigint, ref_id bigint")


def banded(queries: DataFrame, cones: Cones, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All references whose similarity to a query lies in its band, and how many lie above it.

    ``queries(query_id, vec, lo, hi)`` gives ``query_id, ref_id, similarity, above, scored``: a row for each reference in the
    band; rows without ``ref_id`` count those ``above`` and those ``scored`` one by one (sum them over the query). A leaf
    wholly below the band is not met, a leaf wholly above is only counted.
    """
    tree, cosine = cones.tree, cones.cosine

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[start : start + AT_ONCE]
                unit, size = unit_rows(part["vec"])
                size = np.ones(len(part)) if cosine else size
                rows, cells, above = np.arange(len(part)), np.zeros(len(part), int), np.zeros(len(part), int)
                if tree:
                    rows, cells, above = tree.reach(unit, size, part["lo"].to_numpy() - SLACK, over=part["hi"].to_numpy() + SLACK)
                if len(rows):
                    yield part.iloc[rows].assign(vec=list(unit[rows] * size[rows, None]), cell=cells, above=0)
                if above.any():
                    yield part[above > 0].assign(vec=None, cell=-1, above=above[above > 0])

    def choose(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "ref_id": [], "similarity": [], "above": [], "scored": []})
        sims, qid = _similarities(q, r), q["query_id"].to_numpy()
        over = sims > q["hi"].to_numpy()[:, None]
        rows, columns = np.nonzero((sims >= q["lo"].to_numpy()[:, None]) & ~over)
        counts = pd.DataFrame({"query_id": qid, "ref_id": pd.array([None] * len(q), "Int64"), "similarity": np.nan, "above": over.sum(axis=1), "scored": len(r)})
        found = pd.DataFrame({"query_id": qid[rows], "ref_id": pd.array(r["ref_id"].to_numpy()[columns], "Int64"), "similarity": sims[rows, columns], "above": 0, "scored": 0})
        return pd.concat([counts, found])

    asked = queries.select("query_id", "vec", "lo", "hi")
    visits = asked.mapInPandas(aim, "query_id bigint, vec array<double>, lo double, hi double, cell int, above bigint")
    visits = stored(visits, "visits") if tree else visits
    met = _met(visits.where("cell >= 0").drop("above"), cones, block_rows, choose, "query_id bigint, ref_id bigint, similarity double, above bigint, scored bigint")
    if tree is None:
        return met
    whole = visits.where("cell < 0").selectExpr("query_id", "cast(null as bigint) as ref_id", "cast(null as double) as similarity", "above", "0L as scored")
    return met.unionByName(whole)
