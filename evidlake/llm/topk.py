"""Exact top-k inner products by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rows of one block of candidates (a dense score array holds one number for each), and queries scored at once.
BLOCK, AT_ONCE = 8192, 64
HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def scaled(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as a double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def whole(embedding: Column) -> Column:
    """True if the vector and all its components are there and finite."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return embedding.isNotNull() & ~F.exists(embedding, odd)


class Postings:
    """A block's non-zero components by term: rows and their weights."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, rows: np.ndarray, weights: np.ndarray):
        self.ids = ids
        keep = weights != 0
        order = np.argsort(terms[keep], kind="stable")
        terms, self.rows, self.weights = terms[keep][order], rows[keep][order], weights[keep][order]
        self.terms, first = np.unique(terms, return_index=True)
        self.bounds = np.append(first, len(terms))

    def scores(self, terms: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """Dense scores of n queries: the terms one after another, each scattered over its postings."""
        out = np.zeros((n, len(self.ids)), np.int64)
        order = np.argsort(terms, kind="stable")
        terms, rows, weights = terms[order], rows[order], weights[order]
        own, first = np.unique(terms, return_index=True)
        bounds = np.append(first, len(terms))
        for at, lo, hi in zip(np.searchsorted(self.terms, own), bounds[:-1], bounds[1:], strict=True):
            if at == len(self.terms) or self.terms[at] != terms[lo]:
                continue
            part = slice(self.bounds[at], self.bounds[at + 1])
            added = np.multiply.outer(weights[lo:hi], self.weights[part])
            if part.stop - part.start == len(self.ids):
                out[rows[lo:hi]] += added
            else:
                out[rows[lo:hi, None], self.rows[None, part]] += added
        return out


def postings_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids and, for each component, term, row and weight."""
    vectors = batch.column("vector")
    lengths = np.diff(vectors.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lengths)), lengths)
    terms = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return batch.column("vec_id").to_numpy(), terms, rows, vectors.flatten().to_numpy(zero_copy_only=False)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ``ids`` ascend. Rows of the own id don't count."""
    if k < len(ids):
        bar = np.partition(scores, len(ids) - k)[len(ids) - k :].min()
        lo, hi = np.searchsorted(ids, [own, own + 1])
        if hi > lo:  # leave the query's own rows out, then cut anew
            rest = np.delete(np.arange(len(ids)), np.s_[lo:hi])
            return rest[best(scores[rest], ids[rest], own, k)] if len(rest) else rest
        above = np.flatnonzero(scores > bar)
        return np.concatenate([above, np.flatnonzero(scores == bar)[: k - len(above)]])
    return np.flatnonzero(ids != own)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The k highest inner products of each query row with all rows but its own: query_id, rank, vec_id, score.

    Takes rows (vec_id, vector: array of long). Candidates are cut into blocks by a hash of their id; each block
    meets all queries, which stream past its postings in batches, and keeps k for each; a window over those
    (k a block and query) gives the ranks, ties to the smaller vec_id. Neither side is broadcast or held whole: a task
    holds one block and one batch of queries.

    Vectors that are null or hold null components take no part, nor do null ids. Missing components of shorter vectors
    are 0. Rows of a query's own vec_id are its own; repeated rows of other ids are candidates each, and repeated
    queries are answered once. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    found = vectors.where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    )
    blocks = max(1, -(-found.count() // block))
    salted = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")
    candidates = found.select(salted.alias("block"), F.lit(0).alias("kind"), "vec_id", "vector")
    asked = found.where(is_query).dropDuplicates(["vec_id"]).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "vector"
    )
    dealt = candidates.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind", "vec_id")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings = None
        for held, queries in meetings(batches, AT_ONCE):
            if held is not None:
                postings = Postings(*postings_of(held))
            ids = postings.ids
            for batch in queries:
                own, terms, rows, weights = postings_of(batch)
                scores = postings.scores(terms, rows, weights, len(own))
                picks = [best(s, ids, q, k) for s, q in zip(scores, own, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(own, [len(p) for p in picks])),
                        pa.array(ids[np.concatenate(picks)] if picks else ids[:0]),
                        pa.array(np.concatenate([s[p] for s, p in zip(scores, picks, strict=True)])),
                    ],
                    schema=HITS,
                )

    hits = dealt.mapInArrow(score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def meetings(
    batches: Iterable[pa.RecordBatch], at_once: int
) -> Iterator[tuple[pa.RecordBatch | None, Iterator[pa.RecordBatch]]]:
    """Small batches of queries, with the candidates of their block where a new block begins (else None)."""
    held: list[pa.RecordBatch] = []
    at, ready = None, False
    for batch in batches:
        for key, kind, part in cut(batch):
            if key != at:
                at, held, ready = key, [], False
            if kind == 0:
                held.append(part)
            elif held or ready:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else None
                held, ready = [], True
                yield whole, (part.slice(i, at_once) for i in range(0, part.num_rows, at_once))


def cut(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    key, kind = (batch.column(c).to_numpy() for c in ("block", "kind"))
    ends = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1
    for lo, hi in zip([0, *ends], [*ends, batch.num_rows], strict=True):
        if hi > lo:
            yield int(key[lo]), int(kind[lo]), batch.slice(lo, hi - lo)
