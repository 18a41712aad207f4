"""Operations analytics: metering, latency, telemetry, drift, queues, idempotency, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidlake.functions.expr import cascade, compound_key, ratio
from evidlake.functions.running import ordinal, previous, running
from evidlake.functions.skew import join_unique
from evidlake.operators.evaluation import nearest_rank

DAY_US = 86_400_000_000


def ts_us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def complete_domain(df: DataFrame, keys: list[str], column: str, domain: list[str], fill: dict[str, object]) -> DataFrame:
    """One row per key and domain value, absent ones filled. The closed list is unrolled per key."""
    present = df.select(*keys).distinct().withColumn(column, F.explode(F.array(*[F.lit(d) for d in domain])))
    out = present.join(df, [*keys, column], "left")
    for name, value in fill.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def usage_summary(usage: DataFrame, meters: list[str], as_of: Column, days: int) -> DataFrame:
    """Quantity per tenant and meter over a trailing window; a silent meter reports zero.

    Every meter is a conditional sum of the same pass, then unrolled, so no second scan fills the gaps.
    """
    since = as_of - F.expr(f"interval {days} days")
    inside = (F.col("created_at") >= since) & (F.col("created_at") < as_of)
    sums = [F.sum(F.when(inside & (F.col("meter") == m), F.col("quantity")).otherwise(F.lit(0))).alias(f"m{i}") for i, m in enumerate(meters)]
    wide = usage.groupBy("tenant_id").agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("meter"), F.col(f"m{i}").alias("quantity")) for i, m in enumerate(meters)]))
    return wide.select("tenant_id", rows.alias("r")).select("tenant_id", "r.meter", "r.quantity")


def usage_since(usage: DataFrame, meter: str, since: Column) -> DataFrame:
    hit = (F.col("meter") == meter) & (F.col("created_at") >= since)
    return usage.groupBy("tenant_id").agg(
        F.coalesce(F.sum(F.when(hit, F.col("quantity"))), F.lit(0).cast("bigint")).alias("quantity")
    )


def backlog(jobs: DataFrame) -> DataFrame:
    """Jobs by state per tenant, and since when the oldest unfinished one waits."""
    open_ = F.col("state").isin("PENDING", "SUBMITTED", "RETRYABLE")
    n = lambda s: F.count_if(F.col("state") == s)
    return jobs.groupBy("tenant_id").agg(
        n("PENDING").alias("pending"), n("SUBMITTED").alias("submitted"), n("RETRYABLE").alias("retryable"),
        n("CONFIRMED").alias("confirmed"), n("FAILED").alias("failed"),
        F.min(F.when(open_, ts_us("created_at"))).alias("oldest_open_us"),
    )


def recent_n(df: DataFrame, series: list[str], n: int, order: str, tie: str) -> DataFrame:
    """The n most recent samples of each series (the window keeps n rows per series and task)."""
    w = Window.partitionBy(*series).orderBy(F.col(order).desc(), F.col(tie).desc())
    return df.withColumn("age_rank", F.row_number().over(w).cast("bigint")).where(F.col("age_rank") <= n)


def latency_quantiles(obs: DataFrame, series: str) -> DataFrame:
    """Nearest-rank p50, p95 and p99 over all samples of each series, from counts of distinct values."""
    return nearest_rank(
        obs, [series], "latency_ms", {"p50": 0.50, "p95": 0.95, "p99": 0.99}, buckets=1.0, count_name="samples"
    )


def telemetry_summary(obs: DataFrame, by: list[str]) -> DataFrame:
    """Semi-additive summary: count, sum, min, max; missing, non-finite and negative values are skipped."""
    v = F.col("value")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))) & (v >= 0)
    used = F.when(ok, v)
    return obs.groupBy(*by).agg(
        F.count(used).alias("count"), F.sum(used).alias("total"), F.min(used).alias("min"), F.max(used).alias("max"),
        F.count_if(~ok).alias("skipped"),
    )


def merge_telemetry(packets: DataFrame, by: list[str]) -> DataFrame:
    """Merge partial summaries: totals add, means are count-weighted, empty packets are counted apart."""
    good = F.coalesce(F.col("count") > 0, F.lit(False))
    return packets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(good).alias("valid_packets"),
        F.sum(F.when(good, F.col("count"))).alias("count"),
        ratio(F.sum(F.when(good, F.col("total"))), F.sum(F.when(good, F.col("count")))).alias("mean"),
        F.min(F.when(good, F.col("min"))).alias("min"), F.max(F.when(good, F.col("max"))).alias("max"),
        # A handful of deployed bundles.
        F.array_sort(F.collect_set(F.when(good, F.col("bundle_id")))).alias("bundle_ids"),
    )


def join_baseline(baselines: DataFrame, current: DataFrame) -> DataFrame:
    return baselines.join(current, "score_name", "left")


def evaluate_drift(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """State of each baseline: identity first, then sample size, then standardized shift of the mean.

    ``baselines(lane, score_name, bundle_id, base_mean, base_sd, min_n, warn, revalidate)``; several bundles
    of one baseline are separated by commas. Scores from any other set of bundles have lost their identity.
    """
    c = F.col
    j = join_baseline(baselines.withColumnRenamed("bundle_id", "base_bundle"), current)
    same = F.coalesce(c("bundle_ids") == F.array_sort(F.split("base_bundle", ",")), F.lit(False))
    shift = F.abs(c("mean") - c("base_mean")) / F.greatest(c("base_sd"), F.lit(1e-6))
    n = F.coalesce(c("count"), F.lit(0).cast("bigint"))
    rules = [
        (~c("identity_matches"), "REVALIDATION_REQUIRED", "MODEL_BUNDLE_IDENTITY_DRIFT"),
        (c("observations") < c("min_n"), "INSUFFICIENT_CURRENT_OBSERVATIONS", "DRIFT_SAMPLE_GATE_NOT_MET"),
        (c("shift") >= c("revalidate"), "REVALIDATION_REQUIRED", "SCORE_DISTRIBUTION_SHIFT_EXCEEDS_REVALIDATION_THRESHOLD"),
        (c("shift") >= c("warn"), "WARNING", "SCORE_DISTRIBUTION_SHIFT_WARNING"),
    ]
    out = j.withColumn("identity_matches", same).withColumn("shift", shift).withColumn("observations", n)
    return out.withColumn("state", cascade([(r[0], r[1]) for r in rules], "STABLE")).withColumn(
        "reason_code", cascade([(r[0], r[2]) for r in rules])
    )


def drift_rollup(checks: DataFrame, by: list[str]) -> DataFrame:
    """The worst state of a group of checks."""
    any_ = lambda s: F.bool_or(F.col("state") == s)
    order = ("REVALIDATION_REQUIRED", "WARNING", "INSUFFICIENT_CURRENT_OBSERVATIONS")
    return checks.groupBy(*by).agg(
        cascade([(any_(s), s) for s in order], "STABLE").alias("state"),
        any_("REVALIDATION_REQUIRED").alias("revalidation_required"),
    )


def same_set(observed: DataFrame, expected: DataFrame, key: str, member: str) -> DataFrame:
    """Whether two sets of members per key are equal, from one tagged aggregate."""
    tag = lambda d, n: d.select(key, member, F.lit(n).alias("src"))
    both = tag(observed, "o").unionByName(tag(expected, "e")).groupBy(key, member).agg(
        F.bool_or(F.col("src") == "o").alias("o"), F.bool_or(F.col("src") == "e").alias("e")
    )
    return both.groupBy(key).agg(
        F.bool_and(F.col("o") & F.col("e")).alias("equal"),
        F.count_if(~F.col("e")).alias("unexpected"), F.count_if(~F.col("o")).alias("absent"),
    )


def idempotency(requests: DataFrame, keys: list[str], row: str) -> DataFrame:
    """NEW for the first request of a key, REPLAY for the same payload again, CONFLICT for another.

    The first request per key is an aggregate; requests meet it in a join that spreads hot keys.
    """
    k = compound_key(*keys)
    first = requests.groupBy(k.alias("__key")).agg(F.min(F.struct("ts", row, "digest")).alias("f"))
    first = first.select("__key", F.col(f"f.{row}").alias("__first_row"), F.col("f.digest").alias("__first_digest"))
    out = join_unique(requests.withColumn("__key", k), first, "__key", row, "inner")
    verdict = cascade(
        [
            (F.col(row) == F.col("__first_row"), "NEW"),
            (F.col("digest") == F.col("__first_digest"), "REPLAY"),
        ],
        "CONFLICT",
    )
    return out.withColumn("outcome", verdict).drop("__key", "__first_row", "__first_digest")


def trailing_count(df: DataFrame, key: str, row: str, ts: str, hours: int) -> DataFrame:
    """Rows of the same key in the trailing window ending at each row.

    Two counts of a sweep: rows up to now minus rows before the window's start. Chunked by day.
    """
    span = hours * 3_600_000_000
    at = ts_us(ts)
    base = df.select(F.col(key), F.col(row), at.alias("at"))
    parts = F.array(
        F.struct((F.col("at") - span).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("inc")),
        F.struct(F.col("at").alias("at"), F.lit(1).alias("kind"), F.lit(1).cast("bigint").alias("inc")),
        F.struct(F.col("at").alias("at"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("inc")),
    )
    line = base.select(key, row, F.explode(parts).alias("p")).select(key, row, "p.*").withColumn(
        "day", F.floor(F.col("at") / DAY_US).cast("bigint")
    )
    swept = running(
        line, [key], [("day", True)], [("at", True), ("kind", True), (row, True)], {"upto": (F.col("inc"), "sum")}
    )
    end = lambda n: F.max(F.when(F.col("kind") == n, F.col("upto")))
    return swept.groupBy(key, row).agg((end(2) - end(0)).alias("trailing"))


def assign_versions(new: DataFrame, existing: DataFrame, keys: list[str], row: str, ts: str) -> DataFrame:
    """Next version number of each new row after the versions its key already has."""
    k = compound_key(*keys)
    top = existing.groupBy(k.alias("__key")).agg(F.max("version").alias("__top"))
    numbered = ordinal(
        new.withColumn("__key", k).withColumn("__day", F.floor(ts_us(ts) / DAY_US).cast("bigint")),
        ["__key"], [("__day", True)], [(ts, True), (row, True)], "__n",
    )
    out = join_unique(numbered, top, "__key", row)
    return out.withColumn("version", F.coalesce(F.col("__top"), F.lit(0)) + F.col("__n")).drop("__key", "__top", "__n", "__day")


def stage_changes(progress: DataFrame, scan: str, stage: str, ts: str, row: str) -> DataFrame:
    """First row of each run of equal stages, with the time since the scan's first row."""
    p = progress.select(scan, stage, row, ts_us(ts).alias("at")).withColumn("day", F.floor(F.col("at") / DAY_US).cast("bigint"))
    p = previous(p, [scan], [("day", True)], ["at", row], {"__before": F.col(stage)})
    starts = p.groupBy(scan).agg(F.min("at").alias("__start"))
    changed = p.where(F.col("__before").isNull() | (F.col("__before") != F.col(stage)))
    out = join_unique(changed, starts, scan, row)
    return out.select(scan, row, stage, (F.col("at") - F.col("__start")).alias("elapsed_us"))


def work_batch(jobs: DataFrame, states: list[str], limit: int) -> DataFrame:
    """Oldest claimable jobs, leased ones skipped; a top-k, never a full sort."""
    return jobs.where(F.col("state").isin(*states) & ~F.col("leased")).orderBy("created_at", "job_id").limit(limit)


def listing(df: DataFrame, condition: Column, limit: int) -> DataFrame:
    """Newest rows that pass a filter."""
    return df.where(condition).orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(limit)


def fan_out(events: DataFrame, endpoints: DataFrame) -> DataFrame:
    """One delivery per event and active endpoint of its tenant that wants its type."""
    e = endpoints.where("active").select("tenant_id", "endpoint_id", "only_type")
    wants = F.col("only_type").isNull() | (F.col("only_type") == F.col("event_type"))
    return events.join(e, "tenant_id").where(wants).drop("only_type")


def latest_stages(attempts: DataFrame) -> DataFrame:
    """Newest attempt per (scan, stage)."""
    return attempts.groupBy("scan_id", "stage").agg(
        F.max(F.struct("heartbeat_us", "event_id", "attempt", "max_attempts", "lease_expires_us")).alias("b")
    ).select("scan_id", "stage", "b.*")


# The stages of a scan in their order.
STAGES = ["signup", "view", "click", "purchase", "error"]


def stage_timeline(attempts: DataFrame, as_of_us: int) -> DataFrame:
    """Digest of a scan's stages and its derived progress: the running stage, else the next pending one.

    After folding to the newest attempt a scan has at most one row per stage of a closed list.
    """
    n = latest_stages(attempts)
    position = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage")).cast("bigint")
    state = cascade(
        [
            (F.col("lease_expires_us") > as_of_us, "RUNNING"),
            (F.col("attempt") >= F.col("max_attempts"), "FAILED_TERMINAL"),
            (F.col("attempt") % 2 == 0, "PENDING"),
        ],
        "COMPLETED",
    )
    n = n.withColumn("pos", position).withColumn("state", state)
    rows = F.array_sort(F.collect_list(F.struct("pos", "stage", "state", "attempt")))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["stage"], r["state"], r["attempt"])), ",")
    pick = lambda s: F.min(F.when(F.col("state") == s, F.struct("pos", "stage")))
    return n.groupBy("scan_id").agg(
        text.alias("timeline"), F.sha2(text, 256).alias("timeline_digest"),
        F.coalesce(pick("RUNNING")["stage"], pick("PENDING")["stage"]).alias("progress_stage"),
    )


def lease_state(attempts: DataFrame, as_of_us: int) -> DataFrame:
    """What an expired lease becomes: retryable, or terminal once its attempts are used up."""
    n = latest_stages(attempts)
    return n.withColumn(
        "lease",
        cascade(
            [
                (F.col("lease_expires_us") > as_of_us, "HELD"),
                (F.col("attempt") >= F.col("max_attempts"), "FAILED_TERMINAL"),
            ],
            "FAILED_RETRYABLE",
        ),
    )


def accept_attestations(
    attestations: DataFrame, members: DataFrame, registry: DataFrame, as_of_us: int, max_age_s: int, skew_s: int = 60
) -> DataFrame:
    """Accept or refuse counterparty attestations.

    The registry decides where it can be read; a registry that cannot be read is not permission. The
    local directory only fills in where no registry answer exists. A body is accepted once per tenant.
    """
    c = F.col
    reg = registry.select("signer", F.col("readable").alias("__readable"), F.col("active").alias("__active"))
    mem = members.select("tenant_id", "signer", F.col("status").alias("__status"))
    j = attestations.join(reg, "signer", "left").join(mem, ["tenant_id", "signer"], "left")
    authority = cascade(
        [(c("__readable"), "ON_CHAIN_REGISTRY"), (~c("__readable"), "ON_CHAIN_REGISTRY_UNAVAILABLE")], "LOCAL_DIRECTORY"
    )
    permitted = cascade(
        [(c("__readable"), c("__active")), (~c("__readable"), False)], F.coalesce(c("__status") == "ACTIVE", F.lit(False))
    )
    age_us = as_of_us - c("issued_us")
    j = j.withColumn("authority", authority).withColumn(
        "refusal",
        cascade(
            [
                (~c("commitment_ok"), "BODY_DOES_NOT_MATCH_DEPLOYMENT"),
                (age_us < -skew_s * 1_000_000, "SIGNATURE_ISSUED_IN_FUTURE"),
                (age_us > max_age_s * 1_000_000, "SIGNATURE_EXPIRED"),
                (~permitted, "SIGNER_NOT_PERMITTED"),
            ]
        ),
    )
    k = compound_key("tenant_id", "body_hash")
    first = j.where("refusal is null").groupBy(k.alias("__key")).agg(
        F.min_by("attestation_id", F.struct("issued_us", "attestation_id")).alias("__first_id")
    )
    out = join_unique(j.withColumn("__key", k), first, "__key", "attestation_id")
    replay = c("refusal").isNull() & (c("__first_id") != c("attestation_id"))
    return out.withColumn("refusal", F.when(replay, "REPLAYED_BODY").otherwise(c("refusal"))).withColumn(
        "accepted", c("refusal").isNull()
    ).drop("__key", "__first_id", "__readable", "__active", "__status")
