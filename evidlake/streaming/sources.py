"""Reading tables as streams and running bounded streams to completion."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidlake.session import shared_dir


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A table's files as a stream, of a table that is one file or a folder of files. The trigger size bounds what one
    micro-batch can hold."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # What a pattern finds may be files and folders of them; a filter on file names would pass over the files of a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parquet*")


def in_parts(rows: DataFrame, part: str, parts: int, name: str, rows_per_file: int = 1 << 20) -> DataFrame:
    """The rows as a stream that delivers part 0 first, then part 1, and so on, one part in a micro-batch.

    Each part is written after the one before it, as equally many files of about ``rows_per_file`` rows.
    """
    spark = rows.sparkSession
    out = scratch(spark, name)
    files = max(1, -(-rows.count() // (parts * rows_per_file)))
    for p in range(parts):
        rows.where(f"{part} = {p}").drop(part).repartition(files).write.mode("append").parquet(out)
    return spark.readStream.schema(rows.drop(part).schema).option("maxFilesPerTrigger", files).parquet(out)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available now into Parquet and return the result."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def drain_batches(
    stream: DataFrame, name: str, each: Callable[[DataFrame, int, str], None], outputs: dict[str, str]
) -> dict[str, DataFrame]:
    """Run ``each(batch, batch_id, folder)`` for every micro-batch; it writes to ``folder/<output>``.

    A batch overwrites its own ``batch=<id>`` folders, so a replayed batch changes nothing.
    """
    spark = stream.sparkSession
    out = scratch(spark, name)
    ran: list[int] = []

    def one(df: DataFrame, batch_id: int) -> None:
        each(df, batch_id, out)
        ran.append(batch_id)

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    # A stream without rows has no batch, and its outputs are empty.
    return {n: spark.read.schema(ddl).parquet(f"{out}/{n}/*") if ran else spark.createDataFrame([], ddl) for n, ddl in outputs.items()}


def write_batch(df: DataFrame, folder: str, output: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{output}/batch={batch_id}")
