"""Content digests: per row, and for whole sets of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanes of the additive set digest: 24-bit words of a SHA-256, so 64-bit sums hold 2**39 rows of a group.
LANES, DIGITS = 5, 6


def canonical_json(names: Sequence[str]) -> Column:
    """Compact JSON with alphabetically ordered keys and explicit nulls."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def canonical_digest(names: Sequence[str]) -> Column:
    return F.sha2(canonical_json(names), 256)


def set_digest(row_digest: Column) -> Column:
    """Order-free digest of a group, as an aggregate.

    Five words of each row's SHA-256 are summed apart, so the state is five numbers: it is combined before
    the shuffle and never needs a group's rows in one place. The sums and the row count are hashed once
    more. It shows that a set changed; proof against a forger is the log's Merkle tree.
    """
    words = [
        F.sum(F.conv(F.substring(row_digest, 1 + DIGITS * i, DIGITS), 16, 10).cast("bigint"))
        for i in range(LANES)
    ]
    parts = [F.coalesce(w, F.lit(0).cast("bigint")).cast("string") for w in words]
    return F.sha2(F.concat_ws(",", *parts, F.count(row_digest).cast("string")), 256)


def set_digest_sql(row_digest: str) -> str:
    """The same aggregate as DuckDB text."""
    words = ", ".join(
        f"coalesce(sum(concat('0x', substr({row_digest}, {1 + DIGITS * i}, {DIGITS}))::bigint), 0)::varchar"
        for i in range(LANES)
    )
    return f"sha256(concat_ws(',', {words}, count({row_digest})::varchar))"
