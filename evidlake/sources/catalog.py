"""Catalog scans, integrity-checked reads, admission, bulk import, snapshots and tenant scoping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.functions.expr import cascade, codes, compound_key, joined
from evidlake.functions.running import ordinal


def scan_catalog(works: DataFrame, tenant_id: str, catalog_id: str | None = None) -> DataFrame:
    """References of one tenant (and catalog), newest first. Both tests are pushed to the scan."""
    out = works.where(F.col("tenant_id") == tenant_id)
    if catalog_id is not None:
        out = out.where(F.col("catalog_id") == catalog_id)
    return out.orderBy(F.col("work_id").desc())


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Stored objects with their bytes, keyed by file name."""
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("object_id"), "content"
    )


def verify_objects(objects: DataFrame, expected: DataFrame) -> DataFrame:
    """Recompute digest and size of each expected object; failed rows stay, but are not rankable.

    ``objects(object_id, content)``, ``expected(object_id, sha256, byte_size)``. The content is reduced to
    digest and length before the join, so object bytes are never shuffled.
    """
    measured = objects.select(
        "object_id",
        F.sha2("content", 256).alias("__sha"),
        F.octet_length("content").cast("bigint").alias("__size"),
    )
    state = cascade(
        [
            (F.col("__sha").isNull(), "READ_FAILED"),
            (F.col("__sha") != F.col("sha256"), "SHA256_MISMATCH"),
            (F.col("__size") != F.col("byte_size"), "BYTE_SIZE_MISMATCH"),
        ],
        "VERIFIED",
    )
    return (
        expected.join(measured, "object_id", "left")
        .withColumn("state", state)
        .withColumn("rankable", F.col("state") == "VERIFIED")
        .drop("__sha", "__size")
    )


def admit(df: DataFrame, text: str, max_bytes: int, max_units: int) -> DataFrame:
    """Admission gate: empty, too large, too many units or undecodable input is refused with a type."""
    size = F.octet_length(F.encode(F.col(text), "utf-8")).cast("bigint")
    units = F.size(F.split(F.col(text), " ")).cast("bigint")
    reason = cascade(
        [
            (F.coalesce(size, F.lit(0)) == 0, "EMPTY_INPUT"),
            (size > max_bytes, "TOO_LARGE"),
            (F.col(text).contains("�"), "UNDECODABLE"),
            (units > max_units, "TOO_MANY_UNITS"),
        ]
    )
    return df.withColumn("reject_reason", reason).withColumn(
        "admitted", F.col("reject_reason").isNull()
    )


def bulk_import(files: DataFrame, manifest: DataFrame, batch: str, size: int) -> DataFrame:
    """Outcome of each import batch: files left-joined to the manifest by file name.

    A batch of more than ``size`` files is imported in numbered parts of that size, in the order of the file
    names' MD5, so every file is in one part whatever the batch holds; files without a batch are a batch too. A file is
    imported or rejected as ``admitted`` says (without that column, as ``reject_reason`` is NULL or not), and neither
    where that is NULL.
    """
    admitted = F.col("admitted") if "admitted" in files.columns else F.col("reject_reason").isNull()
    spread = files.withColumn("__in", admitted).withColumn("__md5", F.md5(F.coalesce("filename", F.lit(""))))
    spread = spread.withColumn("__chunk", F.substring("__md5", 1, 3)).withColumn("__key", compound_key(batch))
    numbered = ordinal(spread, ["__key"], [("__chunk", True)], [("__md5", True), ("filename", True)], "__nr")
    rows = numbered.withColumn("part", F.floor((F.col("__nr") - 1) / size).cast("bigint")).join(manifest, "filename", "left")
    n = F.count(F.lit(1))
    rejected = F.count_if(~F.col("__in"))
    return rows.groupBy(batch, "part").agg(
        n.alias("files"),
        F.count("title").alias("described"),
        F.count(F.when(F.coalesce(F.col("license_hint"), F.lit("NONE")) == "NONE", 1)).alias("defaulted"),
        F.count_if("__in").alias("imported"),
        rejected.alias("rejected"),
        (rejected == 0).alias("complete"),
    )


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, immutable: list[str]) -> DataFrame:
    """Keys that vanished or whose immutable columns changed between two snapshots."""
    b = before.select(F.col(key), F.struct(*immutable).alias("__b"))
    a = after.select(F.col(key), F.struct(*immutable).alias("__a"))
    changed = joined(
        codes(*[(~F.col(f"__b.{c}").eqNullSafe(F.col(f"__a.{c}")), c) for c in immutable]), ","
    )
    return (
        b.join(a, key, "left")
        .withColumn("changed", F.when(F.col("__a").isNotNull(), changed))
        .withColumn(
            "violation",
            cascade([(F.col("__a").isNull(), "ROW_DELETED"), (F.col("changed") != "", "ROW_UPDATED")]),
        )
        .where("violation is not null")
        .select(key, "violation", "changed")
    )


def tenant_scope(df: DataFrame, tenant: object) -> DataFrame:
    return df.where(F.col("tenant_id") == tenant)


def tenant_leaks(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose tenant differs from that of the row they reference."""
    owner = parent.select(F.col(key), F.col("tenant_id").alias("owner_tenant_id"))
    return child.join(owner, key).where(~F.col("tenant_id").eqNullSafe(F.col("owner_tenant_id")))


def lookup_embeddings(items: DataFrame, cache: DataFrame, schema: str, dim: int) -> DataFrame:
    """Cache outcome per item on its exact identity digest: hit, miss, or why an entry is invalid."""
    vec = F.col("cached").cast("array<double>")
    size = F.sqrt(F.aggregate(F.transform(vec, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    bad = F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    outcome = cascade(
        [
            (F.col("cached").isNull() & F.col("cache_schema").isNull(), "MISS"),
            (F.col("cache_schema") != schema, "INVALID_SCHEMA"),
            (F.col("cache_item") != F.col("item_id"), "INVALID_IDENTITY"),
            (F.size("cached") != dim, "INVALID_DIMENSION"),
            (bad, "INVALID_NOT_FINITE"),
            (F.abs(size - 1.0) > 1e-3, "INVALID_NORM"),
        ],
        "HIT",
    )
    return items.join(cache, "identity", "left").withColumn("outcome", outcome)


def rule_violations(df: DataFrame, key: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """One row per (key, broken rule), in rule order of evaluation."""
    return df.select(key, F.explode(codes(*rules)).alias("rule"))
