"""Running totals, ranks, lags and exact order statistics that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(..)`` puts all rows of one key into one task. The functions
below cut each key's ordered rows into chunks by one or more ordered *level* columns, aggregate each
chunk (map-side combined), carry the prefix from chunk to chunk on the small table of chunk totals, and
run the window only inside a chunk. The same function is applied to the totals, level by level, so no
task ever sees more than one chunk or the distinct values of one level.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_KINDS = {"sum": F.sum, "max": F.max, "min": F.min}
Order = tuple[str, bool]  # column name, ascending


def _sort(order: Sequence[Order]) -> list[Column]:
    return [F.col(n).asc() if up else F.col(n).desc() for n, up in order]


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    pick = F.greatest if kind == "max" else F.least
    return pick(carried, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[Order],
    order: Sequence[Order],
    values: Mapping[str, tuple[Column, str]],
    inclusive: bool = True,
) -> DataFrame:
    """Add prefix aggregates over ``order`` within ``keys`` (keys and levels must not be NULL).

    ``values`` maps an output name to (column, ``sum`` | ``max`` | ``min``). ``levels`` must be monotone
    in ``order``: all rows of one chunk are contiguous. With ``inclusive=False`` the current row is left
    out (an empty prefix gives 0 for sums, NULL otherwise).
    """
    keys, levels, order = list(keys), list(levels), list(order)
    level_names = [n for n, _ in levels]
    part = keys + level_names
    end = Window.currentRow if inclusive else -1
    spec = (Window.partitionBy(*part) if part else Window.partitionBy()).orderBy(*_sort(order))
    frame = spec.rowsBetween(Window.unboundedPreceding, end)
    for name, (col, _) in values.items():
        df = df.withColumn(f"__in_{name}", col)
    local = df
    for name, (_, kind) in values.items():
        local = local.withColumn(f"__loc_{name}", _KINDS[kind](f"__in_{name}").over(frame))
    if levels:
        totals = df.groupBy(*part).agg(
            *[_KINDS[kind](f"__in_{name}").alias(f"__tot_{name}") for name, (_, kind) in values.items()]
        )
        before = running(
            totals,
            keys,
            levels[:-1],
            [levels[-1]],
            {f"__c_{n}": (F.col(f"__tot_{n}"), kind) for n, (_, kind) in values.items()},
            inclusive=False,
        ).select(*part, *[f"__c_{n}" for n in values])
        local = local.join(before, part, "left")
    out = local
    for name, (_, kind) in values.items():
        carried = F.col(f"__c_{name}") if levels else F.lit(None)
        loc = F.col(f"__loc_{name}")
        if levels:
            col = _merge(kind, carried, loc)
        else:
            col = F.coalesce(loc, F.lit(0)) if kind == "sum" else loc
        out = out.withColumn(name, col)
    drop = [c for c in out.columns if c.startswith(("__in_", "__loc_", "__c_", "__k_"))]
    drop = [c for c in drop if c not in values]
    return out.drop(*drop)


def ordinal(
    df: DataFrame, keys: Sequence[str], levels: Sequence[Order], order: Sequence[Order], name: str
) -> DataFrame:
    """1-based row number over ``order`` (which must be total) within ``keys``."""
    return running(df, keys, levels, order, {name: (F.lit(1).cast("bigint"), "sum")})


def previous(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[Order],
    order: Sequence[str],
    payload: Mapping[str, Column],
    when: Column | None = None,
) -> DataFrame:
    """The nearest earlier row's ``payload`` (ascending ``order``), optionally only rows where ``when``."""
    packed = F.struct(*[F.col(o) for o in order], *[c.alias(n) for n, c in payload.items()])
    packed = packed if when is None else F.when(when, packed)
    out = running(
        df, keys, levels, [(o, True) for o in order], {"__prev": (packed, "max")}, inclusive=False
    )
    for n in payload:
        out = out.withColumn(n, F.col(f"__prev.{n}"))
    return out.drop("__prev")


def order_stats(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Column],
    buckets: float = 1024.0,
    count_name: str | None = None,
) -> DataFrame:
    """Exact order statistics per key without collecting a key's values into one task.

    ``ranks`` maps an output name to a 0-based rank expression over column ``__n`` (rows of the key).
    Values are first counted per distinct value (map-side combined), then located by running counts
    over ``floor(value * buckets)``.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__w"))
        .withColumn("__b", F.floor(F.col("__v") * buckets))
    )
    cum = running(
        counts, keys, [("__b", True)], [("__v", True)], {"__upto": (F.col("__w"), "sum")}
    ).withColumn("__from", F.col("__upto") - F.col("__w"))
    sizes = counts.groupBy(*keys).agg(F.sum("__w").alias("__n"))
    joined = _equi(cum, sizes, keys)
    hits = {
        name: F.max(
            F.when((F.col("__from") <= rank) & (rank < F.col("__upto")), F.col("__v"))
        ).alias(name)
        for name, rank in ranks.items()
    }
    extra = [F.max("__n").alias(count_name)] if count_name else []
    return joined.groupBy(*keys).agg(*hits.values(), *extra)


def _equi(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi join; a keyless right side is a single row taken as scalars."""
    if not keys:
        for c in right.columns:
            left = left.withColumn(c, right.select(c).scalar())
        return left
    return left.join(right, keys, "inner")


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str, **kw) -> DataFrame:
    """Exact median (mean of the two middle values) per key."""
    n = F.col("__n")
    lo, hi = F.floor((n - 1) / 2), F.ceil((n - 1) / 2)
    out = order_stats(df, keys, value, {"__lo": lo, "__hi": hi}, **kw)
    return out.withColumn(name, (F.col("__lo") + F.col("__hi")) / 2.0).drop("__lo", "__hi")
