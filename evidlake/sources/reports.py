"""Logs and sinks: JSON-lines log, appended leaves, sealed reports, packages, metric text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.functions.digest import set_digest
from evidlake.functions.running import ordinal
from evidlake.sources.manifest import SHA256_HEX

LOG_SCHEMA = "leaf_index bigint, statement_id bigint, packet_hash string"


def parse_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Records of an append-only log; malformed lines and non-digest hashes are skipped."""
    rec = F.from_json(F.col(value), LOG_SCHEMA, {"mode": "PERMISSIVE"})
    return (
        lines.select(rec.alias("r"))
        .select("r.*")
        .where(F.col("leaf_index").isNotNull() & F.col("packet_hash").rlike(SHA256_HEX))
    )


def read_jsonl_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return parse_log_lines(reader.text(path))


def number_appended(new: DataFrame, existing: DataFrame, key: str, chunk: Column) -> DataFrame:
    """Assign the next indexes to new records, ordered by ``key``, after the leaves already logged."""
    size = existing.agg(F.coalesce(F.max("leaf_index") + 1, F.lit(0)).alias("n"))
    numbered = ordinal(new.withColumn("__chunk", chunk), [], [("__chunk", True)], [(key, True)], "__rn")
    return (
        numbered.withColumn("leaf_index", size.select("n").scalar() + F.col("__rn") - 1)
        .withColumn("tree_size", F.col("leaf_index") + 1)
        .drop("__rn", "__chunk")
    )


def append_log(df: DataFrame, path: str) -> None:
    """Single-writer append of numbered leaves."""
    df.write.mode("append").parquet(path)


def seal_report(predictions: DataFrame, record: Column, inputs: Column) -> DataFrame:
    """Digests of prediction rows, of metric inputs, and of the report that holds both."""
    return predictions.agg(
        F.count(F.lit(1)).alias("predictions"),
        set_digest(F.sha2(record, 256)).alias("prediction_digest"),
        set_digest(F.sha2(inputs, 256)).alias("metric_inputs_digest"),
    ).withColumn(
        "report_digest",
        F.sha2(F.concat_ws("|", "predictions", "prediction_digest", "metric_inputs_digest"), 256),
    )


def render_metrics(agg: DataFrame, name: str, label: str, value: str, suffix: str = "") -> DataFrame:
    """Lines ``name{label="x"} value`` of an aggregate."""
    return agg.select(
        F.format_string(
            f'{name}{suffix}{{{label}="%s"}} %d', F.col(label), F.col(value).cast("bigint")
        ).alias("line")
    )


def export_packages(packages: DataFrame, path: str) -> None:
    """One JSON document per statement."""
    packages.write.mode("overwrite").json(path)
