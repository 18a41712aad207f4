"""Point-support operators: occupancy, dense support patches, strongest links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidlake.functions.expr import cascade, r6
from evidlake.functions.running import medians

GRID = 4
MAX_PATCHES = 4
PAD, MIN_SPAN = 0.025, 0.07


def cell(x: Column, g: int = GRID) -> Column:
    return F.least(F.greatest(F.floor(x * g), F.lit(0)), F.lit(g - 1)).cast("bigint")


def grid_cells(points: DataFrame, key: str, g: int = GRID) -> DataFrame:
    """Number of distinct grid cells that hold a point."""
    return points.groupBy(key).agg(F.count_distinct(cell(F.col("y"), g) * g + cell(F.col("x"), g)).alias("cells"))


def _edge(lo: Column, hi: Column, lower: bool) -> Column:
    mid = (lo + hi) / 2.0
    half = F.greatest((hi - lo) / 2.0 + PAD, F.lit(MIN_SPAN / 2.0))
    return r6(F.greatest(F.lit(0.0), mid - half) if lower else F.least(F.lit(1.0), mid + half))


def support_patches(points: DataFrame, key: str, g: int = GRID, top: int = MAX_PATCHES) -> DataFrame:
    """The densest cells with enough support, their padded boxes and median error.

    Points are reduced to one row per (key, cell) before anything is ranked; at most g*g rows per key
    reach the window. Medians come from value counts, so a crowded cell is not collected.
    """
    p = points.withColumn("gx", cell(F.col("x"), g)).withColumn("gy", cell(F.col("y"), g))
    cells = p.groupBy(key, "gx", "gy").agg(
        F.count(F.lit(1)).alias("support"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
    )
    errors = medians(p, [key, "gx", "gy"], "err", "median_error")
    whole = Window.partitionBy(key)
    n = F.sum("support").over(whole)
    need = F.greatest(F.lit(3), F.least(F.lit(6), F.ceil(n * F.lit(0.06))))
    order = Window.partitionBy(key).orderBy(F.col("support").desc(), "median_error", "gy", "gx")
    return (
        cells.join(errors, [key, "gx", "gy"])
        .withColumn("__n", n)
        .withColumn("__need", need)
        .where(F.col("support") >= F.col("__need"))
        .withColumn("patch", F.row_number().over(order).cast("bigint"))
        .where(F.col("patch") <= top)
        .select(
            key, "patch", "gx", "gy", "support",
            r6(F.col("support") / F.col("__n")).alias("support_fraction"),
            r6(F.col("median_error")).alias("median_error"),
            _edge(F.col("x0"), F.col("x1"), True).alias("left"),
            _edge(F.col("x0"), F.col("x1"), False).alias("right"),
            _edge(F.col("y0"), F.col("y1"), True).alias("top"),
            _edge(F.col("y0"), F.col("y1"), False).alias("bottom"),
        )
    )


def top_links(links: DataFrame, key: str, n: int = 64) -> DataFrame:
    """The n strongest links per key: least error, then distance, then id."""
    w = Window.partitionBy(key).orderBy("err", "distance", "link_id")
    return links.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def histogram(vec: Column, bins: int, lo: float, hi: float) -> Column:
    """L1-normalized histogram of an array's values."""
    at = F.transform(
        vec, lambda x: F.least(F.floor((x.cast("double") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    )
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(at, lambda x: x == b)).cast("double")
    )
    return F.transform(counts, lambda c: c / F.size(vec))


def intersection(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def top_shares(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values with their share of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return (
        df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("share", r6(F.col("rows") / total))
        .orderBy(F.col("rows").desc(), col)
        .limit(k)
    )


def letter_profile(text: Column, letters: str) -> Column:
    """Share of each letter among the letters counted; the row-local signature of a tile."""
    n = [F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit(""))) for c in letters]
    total = n[0]
    for c in n[1:]:
        total = total + c
    return F.array(*[F.when(total > 0, c / total).otherwise(F.lit(0.0)).cast("double") for c in n])


def best_both_ways(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Each cell's best partner in the other item, both ways, and the mean of the two medians.

    ``left`` and ``right`` hold a fixed grid of cell signatures, so the comparison is row-local.
    """
    def best(mine: Column, other: Column) -> Column:
        def of(cell_: Column) -> Column:
            scores = F.transform(other, lambda o, i: F.struct(intersection(cell_, o).alias("s"), (-i).alias("i")))
            top = F.array_max(scores)
            return F.struct(top["s"].alias("score"), (-top["i"]).alias("partner"))

        return F.transform(mine, of)

    def median(cells: Column) -> Column:
        s = F.array_sort(F.transform(cells, lambda c: c["score"]))
        n = F.size(s)
        return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2.0

    out = pairs.withColumn("left_best", best(F.col(left), F.col(right))).withColumn(
        "right_best", best(F.col(right), F.col(left))
    )
    return out.withColumn("consistency", 0.5 * median(F.col("left_best")) + 0.5 * median(F.col("right_best")))
