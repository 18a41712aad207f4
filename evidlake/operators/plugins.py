"""Plug-in surface: batch embedders and detectors, provider routing, statistics, view generators.

A provider is a plain function over a batch. Spark partitions the work and keeps one provider per
worker; a failing item becomes an error row instead of failing the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.session import cut_lineage, stored

# Keys that put everything below them into a bucket.
BUCKETS = {
    "failure": "failure", "failures": "failure", "error": "failure", "errors": "failure",
    "success": "success", "successes": "success", "informational": "informational", "info": "informational",
}


def json_pairs(docs: DataFrame, item: str, doc: str) -> DataFrame:
    """Every key and value of a JSON text at any depth, with the bucket its enclosing keys put it in: ``item, key, value, bucket``.

    Texts become variants, which are opened level by level; each level is written once, and there are as many as the
    deepest text has. Values that are not strings are JSON text, with numbers in plain form. NULL, texts that are not JSON
    and objects that repeat a key give no rows.
    """
    buckets = F.create_map(*[F.lit(x) for pair in BUCKETS.items() for x in pair])
    level = docs.select(F.col(item).alias("__item"), F.try_parse_json(doc).alias("__v"), F.lit("status").alias("bucket"))
    text = F.when(F.is_variant_null("value"), F.lit("null")).otherwise(F.col("value").cast("string"))
    out: DataFrame | None = None
    while True:
        opened = level.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("__v").outer())).select(
            "__item", "bucket", "key", "value", F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)").alias("inner")
        )
        opened = stored(opened, "json")
        pairs = opened.where("key is not null").select(F.col("__item").alias(item), "key", text.alias("value"), "bucket")
        out = pairs if out is None else out.unionByName(pairs)
        inner = opened.where("inner")
        if inner.isEmpty():
            return out
        level = inner.select("__item", F.col("value").alias("__v"), F.coalesce(buckets[F.lower("key")], "bucket").alias("bucket"))


def hashed_shingles(texts: list[str], dim: int = 64) -> np.ndarray:
    """Default embedder: word trigrams hashed into signed buckets, unit length. No weights needed."""
    out = np.zeros((len(texts), dim))
    for row, text in enumerate(texts):
        words = text.lower().split()
        for i in range(max(len(words) - 2, 1)):
            h = int.from_bytes(hashlib.md5(" ".join(words[i : i + 3]).encode()).digest()[:8], "little")
            out[row, h % dim] += 1.0 if (h >> 32) & 1 else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(size, 1e-12)


def embed(
    items: DataFrame, item: str, text: str, provider: Callable[[list[str]], np.ndarray] = hashed_shingles,
    dim: int = 64, batch: int = 256,
) -> DataFrame:
    """Vectors of a text column; wrong counts, non-finite or zero vectors become an error code."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    vec = np.asarray(provider(part[text].tolist()), dtype=float)
                    if vec.shape != (len(part), dim):
                        raise RuntimeError("EMBEDDING_BATCH_SHAPE_INVALID")
                    good = np.isfinite(vec).all(axis=1) & (np.linalg.norm(vec, axis=1) > 1e-12)
                    errors = [None if g else "EMBEDDING_NOT_USABLE" for g in good]
                    vectors = [v.tolist() if g else None for v, g in zip(vec, good, strict=True)]
                except Exception as exc:  # noqa: BLE001 - recorded per row by contract
                    vectors, errors = [None] * len(part), [f"EMBEDDING_FAILED:{type(exc).__name__}"] * len(part)
                yield pd.DataFrame({item: part[item], "embedding": vectors, "error": errors})

    kind = items.schema[item].dataType.simpleString()
    return items.select(item, text).mapInPandas(run, f"{item} {kind}, embedding array<double>, error string")


def detect(
    items: DataFrame, item: str, text: str, name: str, provider: Callable[[str], float]
) -> DataFrame:
    """Scores of one detector; each failing item is an error row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores, errors = [], []
            for value in pdf[text]:
                try:
                    score = float(provider(value))
                    if not 0.0 <= score <= 1.0:
                        raise ValueError("SCORE_OUT_OF_RANGE")
                    scores.append(score)
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 - recorded per row by contract
                    scores.append(None)
                    errors.append(f"DETECTOR_FAILED:{type(exc).__name__}")
            yield pd.DataFrame({item: pdf[item], "score": pd.Series(scores, dtype=float), "error": errors})

    kind = items.schema[item].dataType.simpleString()
    out = items.select(item, text).mapInPandas(run, f"{item} {kind}, score double, error string")
    return out.withColumn("provider", F.lit(name))


def route(
    items: DataFrame, item: str, text: str, primary: tuple[str, Callable[[str], float]],
    fallback: tuple[str, Callable[[str], float]], force_fallback: bool = False,
) -> DataFrame:
    """Primary detector for all items; the fallback only for items whose primary call failed.

    A valid low score is a result and never triggers the fallback.
    """
    if force_fallback:
        return detect(items, item, text, *fallback).withColumn("role", F.lit("FALLBACK"))
    # Both the results and the list of failures come from one run of the primary detector.
    first = cut_lineage(detect(items, item, text, *primary)).withColumn("role", F.lit("PRIMARY"))
    failed = items.join(first.where("error is not null").select(item), item, "left_semi")
    second = detect(failed, item, text, *fallback).withColumn("role", F.lit("FALLBACK"))
    return first.where("error is null").unionByName(second)


def grouped_statistic(df: DataFrame, by: str, value: str, statistic: Callable[[pd.Series], float]) -> DataFrame:
    """Any statistic of bounded groups (for example one bootstrap draw) as a grouped pandas aggregate."""
    @F.pandas_udf("double")
    def agg(v: pd.Series) -> float:
        return float(statistic(v))

    return df.groupBy(by).agg(agg(F.col(value)).alias("statistic"))


# View name, scope and quality weight.
DELIVERY_VIEWS = [
    ("original", "DELIVERY_TRANSFORM", 1.00), ("lowercase", "DELIVERY_TRANSFORM", 0.92), ("collapsed", "DELIVERY_TRANSFORM", 0.76),
    ("no_punctuation", "DELIVERY_TRANSFORM", 0.78), ("no_digits", "DELIVERY_TRANSFORM", 0.72),
    ("crop_center", "SPATIAL_CROP", 0.68), ("crop_head", "SPATIAL_CROP", 0.68), ("crop_tail", "SPATIAL_CROP", 0.68),
]
CROP_FRACTION = 0.78


def delivery_views(items: DataFrame, item: str, text: str) -> DataFrame:
    """Delivery transforms and crops of each whole text, with quality weights."""
    x, n = F.col(text), F.char_length(F.col(text))
    w = F.greatest(F.lit(1), F.floor(n * CROP_FRACTION).cast("int"))
    forms = {
        "original": x, "lowercase": F.lower(x), "collapsed": F.trim(F.regexp_replace(x, r"\s+", " ")),
        "no_punctuation": F.regexp_replace(x, r"[.,;:!?]", ""), "no_digits": F.regexp_replace(x, r"[0-9]", ""),
        "crop_center": F.substring(x, F.floor((n - w) / 2.0).cast("int") + 1, w), "crop_head": F.substring(x, F.lit(1), w),
        "crop_tail": F.substring(x, n - w + 1, w),
    }
    rows = F.array(
        *[F.struct(F.lit(v).alias("view"), F.lit(s).alias("scope"), F.lit(q).alias("weight"), forms[v].alias("content")) for v, s, q in DELIVERY_VIEWS]
    )
    return items.select(item, F.explode(rows).alias("v")).select(item, "v.*")


def perturbations(items: DataFrame, item: str, text: str) -> DataFrame:
    """Robustness battery: named edits of each whole text, easy and hard."""
    x, n = F.col(text), F.char_length(F.col(text))
    at = lambda f: F.floor(n * f).cast("int")
    words = F.split(x, " ")
    half = F.floor(F.size(words) / 2).cast("int")
    cases: list[tuple[str, str, Column]] = [
        ("identity", "easy", x), ("upper", "easy", F.upper(x)), ("lower", "easy", F.lower(x)), ("trim", "easy", F.trim(x)),
        ("double_space", "easy", F.regexp_replace(x, " ", "  ")), ("tabs", "easy", F.regexp_replace(x, " ", "\t")),
        ("no_newline", "easy", F.regexp_replace(x, "\n", " ")), ("caption", "easy", F.concat(x, F.lit("\nSource: shared copy"))),
        ("title", "easy", F.concat(F.lit("Copy\n"), x)), ("quote", "easy", F.concat(F.lit('"'), x, F.lit('"'))),
        ("crop_head_90", "easy", F.substring(x, F.lit(1), at(0.9))), ("crop_tail_90", "easy", F.substring(x, at(0.1) + 1, n)),
        ("no_comma", "easy", F.regexp_replace(x, ",", "")), ("no_period", "easy", F.regexp_replace(x, r"\.", "")),
        ("crop_center_50", "hard", F.substring(x, at(0.25) + 1, at(0.5))), ("crop_head_25", "hard", F.substring(x, F.lit(1), at(0.25))),
        ("no_digits", "hard", F.regexp_replace(x, "[0-9]", "")), ("no_vowel_a", "hard", F.regexp_replace(x, "a", "")),
        ("leet", "hard", F.translate(x, "aeio", "4310")), ("mask_middle", "hard", F.overlay(x, F.repeat(F.lit("#"), 16), at(0.5) + 1)),
        ("swap_halves", "hard", F.array_join(F.concat(F.slice(words, half + 1, F.size(words)), F.slice(words, F.lit(1), half)), " ")),
        ("reverse_words", "hard", F.array_join(F.reverse(words), " ")), ("every_other_word", "hard", F.array_join(F.filter(words, lambda w, i: i % 2 == 0), " ")),
        ("sorted_words", "hard", F.array_join(F.array_sort(words), " ")), ("mirror", "hard", F.reverse(x)),
        ("collage", "hard", F.concat(F.substring(x, F.lit(1), at(0.3)), F.lit("\n...\n"), F.substring(x, at(0.7) + 1, n))),
    ]
    rows = F.array(*[F.struct(F.lit(c).alias("case"), F.lit(d).alias("difficulty"), v.alias("content")) for c, d, v in cases])
    return items.select(item, F.explode(rows).alias("p")).select(item, "p.*")
