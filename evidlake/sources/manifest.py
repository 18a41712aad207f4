"""Manifest source with rule validation, uniqueness, leakage and lineage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidlake.functions.skew import join_unique
from evidlake.sources.catalog import rule_violations

# Accepted partitions and text formats.
PARTITIONS = ("TRAIN", "CALIBRATION", "TEST")
SHA256_HEX = "^[0-9a-f]{64}$"
SAFE_PATH = r"^(?!/)(?!.*(^|/)\.\.(/|$))[^\\]+$"


def read_manifest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Items of a manifest file; nothing is inferred, malformed files fail."""
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select(F.explode("items").alias("item")).select("item.*")


def field_rules(partitions: tuple[str, ...] = PARTITIONS) -> list:
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return [
        (blank("location"), "LOCATION_REQUIRED"),
        (~F.col("location").rlike(SAFE_PATH), "LOCATION_NOT_SAFE_RELATIVE_PATH"),
        (~F.col("sha256").rlike(SHA256_HEX), "SHA256_NOT_HEX"),
        (blank("source_lineage_id"), "SOURCE_LINEAGE_REQUIRED"),
        (~F.col("part").isin(*partitions), "PARTITION_NOT_ALLOWED"),
        (F.col("derived_from") == F.col("asset_id"), "DERIVED_FROM_ITSELF"),
    ]


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once (partial counts before the shuffle)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def leakage(items: DataFrame, key: str, part: str = "part") -> DataFrame:
    """Keys seen in more than one partition."""
    return (
        items.groupBy(key)
        .agg(F.count_distinct(part).alias("partitions"), F.count(F.lit(1)).alias("rows"))
        .where("partitions > 1")
    )


def missing_parents(items: DataFrame) -> DataFrame:
    """Derived items whose parent is in no manifest."""
    ids = items.select(F.col("asset_id").alias("derived_from"))
    return items.where("derived_from is not null").join(ids, "derived_from", "left_anti")


def validate_manifest(items: DataFrame, unique: tuple[str, ...] = ("asset_id", "location", "sha256")) -> DataFrame:
    """All violations of a manifest: field rules, then rows that share a value that must be unique."""
    out = rule_violations(items, "asset_id", field_rules())
    for c in unique:
        dup = duplicates(items, c).select(F.col(c), F.lit(f"DUPLICATE_{c.upper()}").alias("rule"))
        hits = join_unique(items.select(*dict.fromkeys(["asset_id", c])), dup, c, "asset_id", "inner")
        out = out.unionByName(hits.select("asset_id", "rule"))
    return out


def bind_corpus(preds: DataFrame, manifest: DataFrame, partition: str) -> DataFrame:
    """Bind predictions to corpus items and list what does not fit."""
    # Reasons, in order.
    items = manifest.select(
        "asset_id", F.col("source_lineage_id").alias("bound_lineage"), "part", "location"
    )
    repeated = duplicates(manifest, "location").select("location", F.lit(True).alias("__dup"))
    bound = preds.join(items, "asset_id", "left").join(repeated, "location", "left")
    reason = F.when(F.col("location").isNull(), "ASSET_NOT_IN_MANIFEST").when(
        F.col("part") != partition, "WRONG_PARTITION"
    ).when(F.col("__dup"), "DUPLICATE_LOCATION")
    return bound.withColumn("violation", reason).drop("__dup")
