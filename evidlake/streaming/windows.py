"""Event-time windows, sessions, stream-static joins and per-batch scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.functions.expr import backoff_seconds
from evidlake.functions.running import running
from evidlake.functions.expr import compound_key
from evidlake.functions.skew import join_unique
from evidlake.operators import cones
from evidlake.operators.usage import evaluate_drift, fan_out, merge_telemetry, telemetry_summary
from evidlake.streaming.sources import write_batch


def usage_rollup(usage: DataFrame, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Quantity per tenant, meter and tumbling window; a window is emitted once it can no longer change."""
    timed = usage.withColumn("ts", F.col("created_at").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy(F.window("ts", window).alias("w"), "tenant_id", "meter").agg(
        F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("requests")
    ).select(F.unix_micros("w.start").alias("window_start_us"), "tenant_id", "meter", "quantity", "requests")


def sessions(events: DataFrame, gap: str = "2 hours", watermark: str = "1 hour") -> DataFrame:
    """Activity sessions per tenant: a gap longer than ``gap`` starts a new one."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy(F.session_window("ts", gap).alias("s"), "tenant_id").agg(F.count(F.lit(1)).alias("events")).select(
        "tenant_id", F.unix_micros("s.start").alias("start_us"), F.unix_micros("s.end").alias("end_us"), "events"
    )


def stream_fan_out(events: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Stream-static join: deliveries of each new event."""
    return fan_out(events, endpoints)


def screen_batch(refs: DataFrame, k: int):
    """Score each micro-batch's new items against the references, whose index is written once and read by every batch."""
    index = cones.build(refs, keep=True)

    def each(batch: DataFrame, batch_id: int, folder: str) -> None:
        q = batch.selectExpr("vec_id as query_id", "0L as scope", "embedding as vec")
        write_batch(cones.nearest(q, index, k), folder, "hits", batch_id)

    return each


def drift_batch(baselines: DataFrame):
    """Check everything observed so far against the recorded baselines, after every micro-batch.

    Each batch leaves its mergeable partial sums, a few rows for each score and bundle, beside the output; a check merges
    those of all batches up to its own. So the last batch's checks don't depend on how the rows were cut into batches,
    and a batch that is run again changes nothing. ``batch`` says which check a row belongs to.
    """
    def each(batch: DataFrame, batch_id: int, folder: str) -> None:
        spark = batch.sparkSession
        sums = telemetry_summary(batch, ["bundle_id", "score_name"]).withColumn("batch", F.lit(batch_id).cast("bigint"))
        write_batch(sums, folder, "sums", batch_id)
        so_far = spark.read.schema(sums.schema).parquet(f"{folder}/sums/*").where(F.col("batch") <= batch_id)
        checks = evaluate_drift(merge_telemetry(so_far, ["score_name"]), baselines)
        cols = ("lane", "score_name", "identity_matches", "observations", "shift", "state", "reason_code")
        write_batch(checks.select(*cols).withColumn("batch", F.lit(batch_id).cast("bigint")), folder, "checks", batch_id)

    return each


def split_late(max_delay_s: int):
    """Rows later than the watermark earlier batches reached go to a side table, the rest go on.

    The watermark is the greatest event time of earlier batches less the delay; it is kept as one row per
    batch beside the output, so a restart finds it again.
    """
    def each(batch: DataFrame, batch_id: int, folder: str) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp")))
        floor_ = None
        if batch_id > 0:
            seen = spark.read.schema("max_us bigint, batch bigint").parquet(f"{folder}/watermark/*")
            top = seen.where(F.col("batch") < batch_id).agg(F.max("max_us")).first()[0]
            floor_ = None if top is None else top - max_delay_s * 1_000_000
        late = F.lit(False) if floor_ is None else F.col("at_us") < floor_
        tagged = rows.withColumn("late", late)
        write_batch(tagged.where("not late").drop("late"), folder, "on_time", batch_id)
        write_batch(tagged.where("late").drop("late"), folder, "late", batch_id)
        mark = rows.agg(F.max("at_us").alias("max_us")).withColumn("batch", F.lit(batch_id).cast("bigint"))
        write_batch(mark, folder, "watermark", batch_id)

    return each


def deduplicate_batch(keys: list[str]):
    """NEW, REPLAY or CONFLICT per request of a key, whatever the number of keys.

    What a key's first payload was is kept as rows beside the output, written once per batch for the keys
    that batch saw first. Everything runs as joins and aggregates, with no call per key.
    """
    def each(batch: DataFrame, batch_id: int, folder: str) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("key", compound_key(*keys))
        first = rows.groupBy("key").agg(F.min(F.struct("ts", "event_id", "digest")).alias("f")).select(
            "key", F.col("f.event_id").alias("first_id"), F.col("f.digest").alias("first_digest")
        )
        if batch_id > 0:
            known = spark.read.schema("key string, digest string, batch bigint").parquet(f"{folder}/registry/*")
            first = first.join(known.where(F.col("batch") < batch_id).select("key", "digest"), "key", "left")
        else:
            first = first.withColumn("digest", F.lit(None).cast("string"))
        fresh = first.where("digest is null")
        write_batch(
            fresh.select("key", F.col("first_digest").alias("digest"), F.lit(batch_id).cast("bigint").alias("batch")),
            folder, "registry", batch_id,
        )
        facts = first.select(
            "key", F.when(F.col("digest").isNull(), F.col("first_id")).alias("new_id"),
            F.coalesce("digest", "first_digest").alias("truth"),
        )
        outcome = F.when(F.col("event_id") == F.col("new_id"), "NEW").when(
            F.col("digest") == F.col("truth"), "REPLAY"
        ).otherwise("CONFLICT")
        judged = join_unique(rows, facts, "key", "event_id", "inner")
        write_batch(judged.select("event_id", outcome.alias("outcome")), folder, "outcomes", batch_id)

    return each


def retry_batch(max_attempts: int, cap_s: int = 600):
    """Delivered, retrying with backoff, or dead-lettered after each attempt; dead letters go to a sink of
    their own. ``(delivery_key, event_id, ts, succeeded)``; attempts after an end state are ignored.

    An attempt counts when no earlier one succeeded and fewer than ``max_attempts`` came before, so the
    state of a delivery is two numbers kept beside the output, and a batch is numbered by running counts.
    """
    def each(batch: DataFrame, batch_id: int, folder: str) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn(
            "hour", F.floor(F.col("at") / 3_600_000_000).cast("bigint")
        )
        if batch_id > 0:
            seen = spark.read.schema("delivery_key string, tried bigint, won bigint").parquet(f"{folder}/attempts/*")
            before = seen.groupBy("delivery_key").agg(F.sum("tried").alias("tried0"), F.sum("won").alias("won0"))
            rows = join_unique(rows, before, "delivery_key", "event_id")
        else:
            none = F.lit(None).cast("bigint")
            rows = rows.withColumn("tried0", none).withColumn("won0", none)
        rows = running(
            rows, ["delivery_key"], [("hour", True)], [("at", True), ("event_id", True)],
            {"n": (F.lit(1).cast("bigint"), "sum"), "wins": (F.col("succeeded").cast("bigint"), "sum")},
        )
        zero = F.lit(0).cast("bigint")
        attempt = F.coalesce("tried0", zero) + F.col("n")
        prior = F.coalesce("won0", zero) + F.col("wins") - F.col("succeeded").cast("bigint")
        rows = rows.withColumn("attempt", attempt).where((prior == 0) & (F.col("attempt") <= max_attempts))
        state = F.when(F.col("succeeded"), "DELIVERED").when(
            F.col("attempt") >= max_attempts, "DEAD_LETTERED"
        ).otherwise("RETRYING")
        rows = rows.withColumn("state", state)
        wait = backoff_seconds(F.col("attempt"), cap_s) * 1_000_000
        out = rows.select(
            "delivery_key", "event_id", "attempt", "state",
            F.when(F.col("state") == "RETRYING", F.col("at") + wait).alias("next_attempt_us"),
        )
        write_batch(out.where("state <> 'DEAD_LETTERED'"), folder, "deliveries", batch_id)
        write_batch(out.where("state = 'DEAD_LETTERED'"), folder, "dead_letters", batch_id)
        tried = rows.groupBy("delivery_key").agg(
            F.count(F.lit(1)).alias("tried"), F.sum(F.col("succeeded").cast("bigint")).alias("won")
        )
        write_batch(tried, folder, "attempts", batch_id)

    return each
