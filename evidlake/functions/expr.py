"""Small column helpers shared by the operators. Everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def compound_key(*cols: str) -> Column:
    """One string for a tuple of columns: each value with its length before it, so that different tuples, NULLs
    and separators inside values included, never give the same string.
    """
    text = [F.col(c).cast("string") for c in cols]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def as_col(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def cascade(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First rule whose condition is true decides; NULL conditions do not fire."""
    out: Column | None = None
    for condition, value in rules:
        out = F.when(condition, as_col(value)) if out is None else out.when(condition, as_col(value))
    return out.otherwise(as_col(default)) if out is not None else as_col(default)


def codes(*pairs: tuple[Column, object]) -> Column:
    """Ordered reason codes: one entry per true condition, duplicates dropped, order kept."""
    return F.array_distinct(
        F.array_compact(F.array(*[F.when(cond, as_col(code).cast("string")) for cond, code in pairs]))
    )


def sorted_codes(*pairs: tuple[Column, object]) -> Column:
    return F.array_sort(codes(*pairs))


def joined(codes_col: Column, sep: str = "|") -> Column:
    return F.array_join(codes_col, sep)


def ratio(num: Column, den: Column) -> Column:
    """NULL on an empty denominator: missing is not zero."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def r6(col: Column) -> Column:
    """Scores are rounded to six decimals at the output edge only."""
    return F.round(col, 6)


def finite(col: Column) -> Column:
    return F.when(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), col)


def unit(col: Column) -> Column:
    """Clamp to [0, 1]; NULL and non-finite values stay NULL (NaN sorts last in Spark)."""
    ok = finite(col)
    return F.when(ok.isNotNull(), F.least(F.greatest(ok, F.lit(0.0)), F.lit(1.0)))


def logit(col: Column, eps: float = 1e-5) -> Column:
    p = F.least(F.greatest(col, F.lit(eps)), F.lit(1.0 - eps))
    return F.log(p / (1.0 - p))


def sigmoid(col: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(col, F.lit(-50.0)), F.lit(50.0))))


def weighted_logit_sum(score: Column, weight: Column) -> Column:
    """Aggregate: sigmoid of the weighted mean logit, 0.5 when no weight is present."""
    total = F.sum(weight)
    return F.when(total > 0, sigmoid(F.sum(weight * logit(score)) / total)).otherwise(F.lit(0.5))


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to [-1, 1]; NULL where either side has no direction."""
    den = norm(a) * norm(b)
    value = dot(a, b) / den
    return F.when(den > 1e-12, F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0)))


def l2_normalize(a: Column) -> Column:
    """Unit vector, or NULL when the norm is <= 1e-12 or an element is not finite."""
    bad = F.exists(as_double(a), lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    # The norm is bound once per vector; inside the inner function alone it would be computed for every element.
    divided = lambda size: F.when(~bad & (size > 1e-12), F.transform(as_double(a), lambda x: x / size))
    return F.element_at(F.transform(F.array(norm(a)), divided), 1)


def hash32(text: Column) -> Column:
    """Deterministic 32-bit draw that other engines can repeat: first 8 hex digits of MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def sign_bits(vec: Column, offset: int) -> Column:
    """32 sign bits of a vector, element ``offset + 1`` in the highest place."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(32)),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc
        + F.when(
            F.element_at(vec, (i + offset).cast("int")) > 0,
            F.expr("1L") * F.pow(F.lit(2.0), 32 - i).cast("bigint"),
        ).otherwise(F.lit(0).cast("bigint")),
    )


def hex_half(hex64: Column, half: int) -> Column:
    """One 32-bit half of a 16-digit fingerprint; all 64 bits at once would overflow BIGINT."""
    return F.conv(F.substring(hex64, 1 + 8 * half, 8), 16, 10).cast("bigint")


def hamming(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    return (
        F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))
    ).cast("bigint")


def fingerprint_similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - distance / 64.0)


def effective_at(start: Column, end: Column, at: Column) -> Column:
    """Open-ended validity: a missing bound never excludes."""
    return F.coalesce(start <= at, F.lit(True)) & F.coalesce(end > at, F.lit(True))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def backoff_seconds(attempts: Column, cap: int) -> Column:
    return F.least(F.lit(cap).cast("bigint"), F.pow(F.lit(2.0), attempts).cast("bigint"))


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC of two binary columns from nested digests (keys up to one 64-byte block)."""
    block = F.rpad(F.hex(key), 128, "0")

    def pad(mask: int) -> Column:
        words = [
            F.lpad(
                F.hex(F.conv(F.substring(block, 1 + 8 * i, 8), 16, 10).cast("bigint").bitwiseXOR(F.lit(mask).cast("bigint"))),
                8, "0",
            )
            for i in range(16)
        ]
        return F.unhex(F.concat(*words))

    inner = F.unhex(F.sha2(F.concat(pad(0x36363636), message), 256))
    return F.sha2(F.concat(pad(0x5C5C5C5C), inner), 256)


def leaf_hash(hex_digest: Column) -> Column:
    """Domain-separated log leaf: SHA-256 of 0x00 and the digest bytes."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.unhex(hex_digest)), 256)


def node_hash(left_hex: Column, right_hex: Column) -> Column:
    """Domain-separated inner node: SHA-256 of 0x01 and both children."""
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left_hex), F.unhex(right_hex)), 256)


def struct_of(names: Iterable[str]) -> Column:
    return F.struct(*[F.col(n) for n in names])
