"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import written


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest one (itself included)."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. In ``edges`` u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    lower = edges.join(least, F.col("u") == F.col("w")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select(F.col("w").alias("u"), F.col("m").alias("v")).union(lower).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node that has an edge to another.

    Takes edges (u, v) of longs in any direction, loops and repeats allowed. Every round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path. Hubs are met by aggregates and
    joins alone, so none of them is gathered in a task. No edges: no rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    before = None
    while True:
        digest = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if digest == before or not digest[0]:
            # All nodes now hang on the smallest node of their component.
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        before = digest
        edges = written(_small(_large(edges)), "edges")
