"""Session defaults, and where long lineages are cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "evidlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, AQE, skew join)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application: they need not have it installed or on their path."""
    context = spark.sparkContext
    if getattr(context, "_evidlake_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "evidlake.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._evidlake_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    private = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(private)
    return shared_dir(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once (an eager checkpoint computes them twice), for every executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Bytes of the source tables that one bucket of ``stored_by`` stands for.
BUCKET_BYTES = 16 << 20


def stored_by(df: DataFrame, name: str, key: str, sources: list[DataFrame]) -> DataFrame:
    """As ``stored``, but dealt into buckets by ``key``: joins and aggregates on it read the buckets and send nothing.

    One bucket for every 16 MB of ``sources``, and one for each core at least. The catalog entry goes at once; the files
    and what is known of their layout stay with the rows that are returned.
    """
    spark = df.sparkSession
    size = sum(int(str(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for x in sources)
    buckets = min(1 << 14, max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)))
    # Instants are written as numbers: eight bytes, not twelve.
    instants = [c for c, kind in df.dtypes if kind == "timestamp"]
    plain = df.withColumns({c: F.unix_micros(c) for c in instants}).repartition(buckets, key)
    table = f"{name}_{uuid.uuid4().hex}"
    plain.write.format("parquet").bucketBy(buckets, key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    out = spark.table(table).withColumns({c: F.timestamp_micros(c) for c in instants})
    spark.sql(f"drop table {table}")
    return out


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over the cores when a scan comes in fewer partitions than there are cores.

    Large inputs already arrive in many splits and are left alone, so this adds no shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df._jdf.rdd().getNumPartitions() < cores else df
