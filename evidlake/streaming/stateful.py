"""Order-dependent operators with per-key state.

A key's rows of one micro-batch are put in time order and folded over a small state; the micro-batch is
bounded by the source's trigger size, so a hot key never brings more than one trigger's rows to a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_US = 86_400_000_000


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(batches)
    rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()
    return rows.sort_values(["at", "event_id"]) if len(rows) else rows


def _stamped(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


def daily_quota(requests: DataFrame, limit: int) -> DataFrame:
    """Admit at most ``limit`` requests of a tenant in any 24 hours; a rejected one uses nothing up.

    The state is the accepted times still inside the window, never more than ``limit``.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(batches)
        kept = list(state.get[0]) if state.exists else []
        out = []
        for event_id, at in zip(rows["event_id"], rows["at"], strict=True):
            kept = [x for x in kept if x >= at - DAY_US]
            ok = len(kept) < limit
            if ok:
                kept.append(int(at))
            out.append((key[0], event_id, ok, len(kept)))
        state.update((kept,))
        yield pd.DataFrame(out, columns=["tenant_id", "event_id", "admitted", "used"])

    return _stamped(requests).groupBy("tenant_id").applyInPandasWithState(
        step, "tenant_id bigint, event_id bigint, admitted boolean, used bigint", "kept array<bigint>", "append",
        GroupStateTimeout.NoTimeout,
    )


def token_bucket(requests: DataFrame, per_minute: float, burst: float, cost: float = 1.0) -> DataFrame:
    """Token-bucket admission: capped refill since the last request, and seconds to wait when refused."""
    rate = per_minute / 60.0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(batches)
        tokens, last = state.get if state.exists else (burst, None)
        out = []
        for event_id, at in zip(rows["event_id"], rows["at"], strict=True):
            if last is not None:
                tokens = min(burst, tokens + max(at - last, 0) / 1e6 * rate)
            last = int(at)
            if tokens < cost:
                out.append((event_id, False, max(1.0, (cost - tokens) / rate)))
            else:
                tokens -= cost
                out.append((event_id, True, 0.0))
        state.update((float(tokens), last))
        yield pd.DataFrame(out, columns=["event_id", "admitted", "retry_after_s"])

    return _stamped(requests).groupBy("tenant_id").applyInPandasWithState(
        step, "event_id bigint, admitted boolean, retry_after_s double", "tokens double, last bigint", "append",
        GroupStateTimeout.NoTimeout,
    )


def lease_expiry(heartbeats: DataFrame, lease_s: int, max_attempts: int, watermark: str = "10 minutes") -> DataFrame:
    """An expired lease is retryable until its attempts are used up, then terminal.

    Expiry shows as a gap to the next heartbeat, or as event time passing the lease's end.
    """
    lease_us = lease_s * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, attempts = state.get if state.exists else (None, 0)
        out = []

        def expire(at: int) -> None:
            nonlocal attempts
            attempts += 1
            done = attempts >= max_attempts
            out.append((key[0], key[1], at, attempts, "FAILED_TERMINAL" if done else "FAILED_RETRYABLE"))

        if state.hasTimedOut:
            if last is not None and attempts < max_attempts:
                expire(last + lease_us)
            state.update((None, attempts))
        else:
            rows = _ordered(batches)
            for at in rows["at"]:
                if last is not None and attempts < max_attempts and at - last > lease_us:
                    expire(last + lease_us)
                last = max(int(at), last or 0)
            state.update((last, attempts))
            end_ms = (last + lease_us) // 1000
            state.setTimeoutTimestamp(max(end_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["scan_id", "stage", "expired_us", "attempt", "outcome"])

    timed = _stamped(heartbeats).withWatermark("ts", watermark)
    return timed.groupBy("scan_id", "stage").applyInPandasWithState(
        step, "scan_id bigint, stage string, expired_us bigint, attempt bigint, outcome string",
        "last bigint, attempts bigint", "append", GroupStateTimeout.EventTimeTimeout,
    )


def close_batches(leaves: DataFrame, every: int, max_age_s: int, watermark: str = "1 minute") -> DataFrame:
    """Close a log's batch when it is full or when its oldest leaf is too old.

    The key is the batch a leaf's index belongs to, not the log, so one busy log is spread over keys.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, top, oldest = state.get if state.exists else (0, -1, None)
        out = []
        if state.hasTimedOut:
            out.append((key[0], count, top + 1, "AGE"))
            state.remove()
        else:
            for rows in batches:
                count += len(rows)
                top = max(top, int(rows["leaf_index"].max()))
                low = int(rows["created_s"].min())
                oldest = low if oldest is None else min(oldest, low)
            if count >= every:
                out.append((key[0], count, top + 1, "COUNT"))
                state.remove()
            else:
                state.update((count, top, oldest))
                state.setTimeoutTimestamp(max((oldest + max_age_s) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["batch", "leaves", "tree_size", "trigger"])

    keyed = leaves.withColumn("batch", F.floor(F.col("leaf_index") / every).cast("bigint")).withWatermark("ts", watermark)
    return keyed.groupBy("batch").applyInPandasWithState(
        step, "batch bigint, leaves bigint, tree_size bigint, trigger string", "count bigint, top bigint, oldest bigint",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
