"""Text-side operators: normalization, label detection, regions, shingles, line assembly."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.functions.expr import cascade, r6

# Letters whose case folding is not plain lowercasing.
CASEFOLD = [
    ("ß", "ss"), ("ẞ", "ss"), ("ſ", "s"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
    ("ﬅ", "st"), ("ﬆ", "st"), ("ŉ", "ʼn"), ("ǰ", "ǰ"), ("ẖ", "ẖ"), ("ẗ", "ẗ"), ("ẘ", "ẘ"), ("ẙ", "ẙ"), ("ẚ", "aʾ"),
]
# Phrases that label an item as generated, tried in this order.
LABEL_PATTERNS = [
    r"\ba\s*[il1|][\s-]*generated\b",
    r"\bgenerated\s+(?:by|with|using)\s+ai\b",
    r"\b(?:made|created)\s+(?:by|with|using)\s+ai\b",
    r"\bsynthetic[\s-]*image\b",
]
SHINGLE_WORDS = 5


def normalize_text(col: Column) -> Column:
    """Case-fold, ``_`` to blank, keep only ``[a-z0-9+.-]``, collapse blanks."""
    out = col
    for letter, plain in CASEFOLD:
        out = F.replace(out, F.lit(letter), F.lit(plain))
    out = F.translate(F.lower(out), "_", " ")
    return F.trim(F.regexp_replace(out, "[^a-z0-9+.-]+", " "))


def detect_labels(lines: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Add ``kind`` and ``phrase``: explicit label patterns first, then configured terms in order."""
    norm = F.col("__norm")
    hits = [F.nullif(F.regexp_extract(norm, p, 0), F.lit("")) for p in LABEL_PATTERNS]
    explicit = F.coalesce(*hits)
    configured = F.coalesce(*[F.when(norm.contains(t), F.lit(t)) for t in terms]) if terms else F.lit(None)
    return (
        # One-element explode: keeps the optimizer from repeating the normalization in every pattern.
        lines.withColumn("__norm", F.explode(F.array(normalize_text(F.col(text)))))
        .withColumn("__explicit", explicit)
        .withColumn("phrase", F.coalesce(F.col("__explicit"), configured))
        .withColumn(
            "kind",
            cascade(
                [
                    (F.col("__explicit").isNotNull(), "EXPLICIT_AI_LABEL"),
                    (F.col("phrase").isNotNull(), "CONFIGURED_GENERATOR_MARK"),
                ]
            ),
        )
        .drop("__norm", "__explicit")
    )


def marker_summary(lines: DataFrame, asset: str, confidence: str, readable: Column) -> DataFrame:
    """One row per asset from its detected lines: status, strength and distinct (kind, phrase) count.

    All aggregates are associative, so an asset with very many lines is combined before the shuffle.
    """
    hit = F.col("kind").isNotNull() & readable
    per_marker = lines.groupBy(asset, "kind", "phrase").agg(
        F.max(F.when(hit, F.col(confidence))).alias(confidence),
        F.max(readable.cast("int")).alias("__ok"),
    )
    ok = F.max("__ok")
    hit = F.col("kind").isNotNull() & (F.col("__ok") == 1)
    explicit = F.max(F.when(hit & (F.col("kind") == "EXPLICIT_AI_LABEL"), 1))
    best = F.max(F.when(hit, F.col(confidence)))
    strength = F.least(
        F.lit(0.98), F.when(explicit.isNotNull(), 0.76).otherwise(F.lit(0.62)) + 0.22 * best
    )
    return per_marker.groupBy(asset).agg(
        cascade(
            [
                (ok == 0, "VISIBLE_MARKER_ANALYSIS_FAILED"),
                (best.isNotNull(), "VISIBLE_AI_MARKER_FOUND"),
            ],
            "NO_VISIBLE_AI_MARKER_FOUND",
        ).alias("classification"),
        F.coalesce(r6(strength), F.lit(0.0)).alias("marker_strength"),
        F.count(F.when(hit, 1)).alias("markers"),
    )


# Region names and where each starts (left or centre or right of the slack).
REGIONS = ("whole", "center", "head", "tail")
REGION_FRACTION = 0.64
REGION_MIN = 64


def region_views(df: DataFrame, item: str, text: str) -> DataFrame:
    """The whole item plus overlapping regions of 64 % of its length; equal boxes appear once."""
    n = F.char_length(F.col(text))
    width = F.least(n, F.greatest(F.lit(REGION_MIN), F.floor(n * F.lit(REGION_FRACTION)).cast("int")))
    boxes = F.array(
        F.struct(F.lit("whole").alias("region"), F.lit(0).alias("start"), F.col("__n").alias("width")),
        F.struct(
            F.lit("center").alias("region"),
            F.floor((F.col("__n") - F.col("__w")) / 2.0).cast("int").alias("start"),
            F.col("__w").alias("width"),
        ),
        F.struct(F.lit("head").alias("region"), F.lit(0).alias("start"), F.col("__w").alias("width")),
        F.struct(
            F.lit("tail").alias("region"),
            (F.col("__n") - F.col("__w")).alias("start"),
            F.col("__w").alias("width"),
        ),
    )
    narrow = F.col("__w") < F.col("__n")
    return (
        df.withColumn("__n", n)
        .withColumn("__w", width)
        .withColumn("__box", F.explode(F.when(narrow, boxes).otherwise(F.slice(boxes, 1, 1))))
        .select(
            item,
            F.col("__box.region").alias("region"),
            F.substring(F.col(text), F.col("__box.start") + 1, F.col("__box.width")).alias("chunk"),
        )
    )


def tiles(df: DataFrame, item: str, text: str, g: int) -> DataFrame:
    """Cut an item into g x g consecutive tiles that together hold the whole text."""
    n = F.char_length(F.col(text))
    cell = F.col("__cell")
    start = F.floor(cell * n / F.lit(g * g)).cast("int")
    end = F.floor((cell + 1) * n / F.lit(g * g)).cast("int")
    return df.withColumn("__cell", F.explode(F.sequence(F.lit(0), F.lit(g * g - 1)))).select(
        item,
        F.floor(cell / g).cast("bigint").alias("tile_row"),
        (cell % g).cast("bigint").alias("tile_col"),
        F.substring(F.col(text), start + 1, end - start).alias("tile"),
    )


def shingles(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Distinct word shingles of a whole text (the text itself when it is shorter)."""
    # The words are bound to a lambda variable so they are split once, not once per shingle.
    def of(parts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(parts) - (words - 1), F.lit(1)))
        return F.array_distinct(
            F.transform(starts, lambda i: F.array_join(F.slice(parts, i, words), " "))
        )

    return F.transform(F.array(F.split(text, " ")), of)[0]


MINIMA = 8


def minima_of(texts: pd.Series) -> pd.Series:
    """The least 32-bit word at each place of the SHA-256s of a text's shingles, in hex; of no text, as many nulls.

    A shingle is the text from its first word's start to its last word's end.
    """
    sha256, out = hashlib.sha256, []
    for text in texts:
        if text is None:
            out.append([None] * MINIMA)
            continue
        data = text.encode()
        blank = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        start, end = np.append(0, blank + 1), np.append(blank, len(data))
        words = min(SHINGLE_WORDS, len(start))
        cut = zip(start[: len(start) - words + 1].tolist(), end[words - 1 :].tolist(), strict=True)
        digests = b"".join([sha256(data[i:j]).digest() for i, j in cut])
        least = np.frombuffer(digests, ">u4").reshape(-1, MINIMA).min(axis=0)
        out.append([f"{x:08x}" for x in least.tolist()])
    return pd.Series(out)


def with_minima(df: DataFrame, text: str, name: str = "minima") -> DataFrame:
    """Add eight min-hashes of the shingle set: the least 32-bit word at each place of the SHA-256s.

    Row-local: no shingle is ever shuffled.
    """
    return df.withColumn(name, F.pandas_udf(minima_of, "array<string>")(F.col(text)))


def with_sketch(df: DataFrame, text: str) -> DataFrame:
    """Add ``hi`` and ``lo``, a 64-bit sketch: the last byte of each of the eight min-hashes."""
    def half(first: int) -> Column:
        tails = [F.substring(F.col("minima")[first + i], 7, 2) for i in range(4)]
        # Never NULL, so no join on it makes the optimizer repeat the hashing in a not-null filter.
        return F.coalesce(F.conv(F.concat(*tails), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))

    return with_minima(df, text).withColumn("hi", half(0)).withColumn("lo", half(4)).drop("minima")


def assemble_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of one line, left to right, with mean confidence and the box they span.

    A line is bounded by the page layout, so collecting its words is safe.
    """
    return words.groupBy(*keys).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("left_px", "word_no", "word"))),
                lambda w: w["word"],
            ),
            " ",
        ).alias("line"),
        r6(F.avg("conf")).alias("mean_conf"),
        F.min("left_px").alias("box_left"),
        F.max(F.col("left_px") + 8).alias("box_right"),
    )
