"""Joins that keep a hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_HOT_ROWS = 1_000_000


def hot_threshold(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.evidlake.hotKeyRows", str(DEFAULT_HOT_ROWS)))


def join_unique(
    big: DataFrame, unique: DataFrame, key: str, row_id: str, how: str = "left", salts: int = 64, hot: DataFrame | None = None
) -> DataFrame:
    """Join ``big`` to a side holding at most one row per ``key``, spreading hot keys over salts.

    A key is hot when it has more than ``spark.evidlake.hotKeyRows`` rows, so at most rows/threshold keys
    are hot; only those few rows of ``unique`` are replicated, once per salt. Every row is kept. ``hot``: those keys, where they are
    known already, in a column of the name ``key``; every task then holds them, and rows are sent once.
    """
    if hot is not None:
        hot = F.broadcast(hot.select(F.col(key).alias("__hk")))
    else:
        hot = (
            big.where(F.col(key).isNotNull())
            .groupBy(F.col(key).alias("__hk"))
            .agg(F.count(F.lit(1)).alias("__hn"))
            .where(F.col("__hn") > hot_threshold(big))
            .select("__hk")
        )
    salted = (
        big.join(hot, F.col(key) == F.col("__hk"), "left")
        .withColumn(
            "__salt",
            F.when(F.col("__hk").isNotNull(), F.pmod(F.xxhash64(F.col(row_id)), F.lit(salts))).otherwise(
                F.lit(0).cast("bigint")
            ),
        )
        .drop("__hk")
    )
    spread = (
        unique.withColumnRenamed(key, "__uk")
        .join(hot, F.col("__uk") == F.col("__hk"), "left")
        .withColumn(
            "__usalt",
            F.explode(
                F.when(
                    F.col("__hk").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))
                ).otherwise(F.array(F.lit(0)))
            ),
        )
        .drop("__hk")
    )
    cond = (F.col(key) == F.col("__uk")) & (F.col("__salt") == F.col("__usalt"))
    out = salted.join(spread, cond, how)
    return out.drop("__uk", "__usalt", "__salt")
