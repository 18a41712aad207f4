"""Streams over the table files, run to completion and compared with their batch twins."""

from pyspark.sql import functions as F

from evidlake.functions.expr import r6
from evidlake.plans.operations import _BAD, _DS, BASELINES
from evidlake.plans.registry import query
from evidlake.plans.retrieval import _TOP
from evidlake.sources.tables import Tables
from evidlake.streaming import stateful as ST
from evidlake.streaming import windows as W
from evidlake.streaming.sources import drain, drain_batches, file_stream, in_parts


class Streams(Tables):
    """The same views over streamed tables."""

    def raw(self, name):
        return file_stream(self.spark, self.folder, name)


def live(t: Tables) -> Streams:
    return Streams(t.spark, t.folder)


@query(
    "ss1_deduplication",
    "select event_id, case when event_id = f then 'NEW' when digest = fd then 'REPLAY' else 'CONFLICT' end as outcome from (select event_id, digest, first_value(event_id) over w as f, first_value(digest) over w as fd from V_EVENT window w as (partition by tenant_id, idem_key order by ts, event_id)) t",
)
def ss1(t):
    """Five parts, one in each micro-batch: what a key's first payload was outlives its batch."""
    rows = Parts(t.spark, t.folder).requests().select("tenant_id", "idem_key", "event_id", "digest", "ts")
    return drain_batches(rows, "dedup", W.deduplicate_batch(["tenant_id", "idem_key"]), {"outcomes": "event_id bigint, outcome string"})["outcomes"]


@query("ss2_daily_quota")
def ss2(t):
    return drain(ST.daily_quota(live(t).requests().select("tenant_id", "event_id", "ts"), 2), "quota")


@query("ss3_token_bucket")
def ss3(t):
    return drain(ST.token_bucket(live(t).requests().select("tenant_id", "event_id", "ts"), 0.01, 2.0), "bucket")


@query("ss4_lease_expiry")
def ss4(t):
    beats = live(t).stages().selectExpr("scan_id", "stage", "event_id", "cast(heartbeat_at as timestamp) as ts")
    return drain(ST.lease_expiry(beats, 43_200, 3), "lease")


@query(
    "ss5_batch_closing",
    "select b as batch, n as leaves, m + 1 as tree_size, case when n >= 64 then 'COUNT' else 'AGE' end as trigger from (select event_id // 64 as b, count(*) as n, max(event_id) as m from events group by 1) t where n >= 64",
)
def ss5(t):
    # Every event is a logged leaf; its id is its index.
    leaves = live(t).requests().selectExpr(
        "event_id as leaf_index", "unix_seconds(cast(ts as timestamp)) as created_s", "cast(ts as timestamp) as ts"
    )
    return drain(ST.close_batches(leaves, 64, 10_000_000), "batches")


_DELIV = "select concat(tenant_id, '/', idem_key) as k, event_id, epoch_us(ts) as tt, event_type <> 'error' and event_id % 3 <> 0 as ok from V_EVENT"


@query(
    "ss6_delivery_retries",
    f"""with d as ({_DELIV}), n as (select *, row_number() over (partition by k order by tt, event_id) as a, coalesce(sum(ok::int) over (partition by k order by tt, event_id rows between unbounded preceding and 1 preceding), 0) as done from d)
        select k as delivery_key, event_id, a as attempt, case when ok then 'DELIVERED' when a >= 3 then 'DEAD_LETTERED' else 'RETRYING' end as state, case when not ok and a < 3 then tt + least(600, (2 ** a)::bigint)::bigint * 1000000 end as next_attempt_us from n where done = 0 and a <= 3""",
)
def ss6(t):
    results = live(t).requests().selectExpr(
        "concat(tenant_id, '/', idem_key) as delivery_key", "event_id", "ts", "event_type <> 'error' and event_id % 3 <> 0 as succeeded"
    )
    ddl = "delivery_key string, event_id bigint, attempt bigint, state string, next_attempt_us bigint"
    out = drain_batches(results, "delivery", W.retry_batch(3), {"deliveries": ddl, "dead_letters": ddl})
    return out["deliveries"].unionByName(out["dead_letters"])


@query(
    "ss7_usage_rollup",
    """select epoch_us(time_bucket(interval 1 hour, created_at)) as window_start_us, tenant_id, meter, sum(quantity)::bigint as quantity, count(*) as requests from V_USAGE
       where time_bucket(interval 1 hour, created_at) + interval 1 hour <= (select max(ts) from events) - interval 1 hour group by all""",
)
def ss7(t):
    return drain(W.usage_rollup(live(t).usage()), "rollup")


@query(
    "ss8_sessions",
    """with e as (select tenant_id, ts, case when ts - lag(ts) over (partition by tenant_id order by ts) < interval 2 hours then 0 else 1 end as s from V_EVENT), g as (select *, sum(s) over (partition by tenant_id order by ts rows unbounded preceding) as g from e),
        x as (select tenant_id, g, epoch_us(min(ts)) as start_us, epoch_us(max(ts) + interval 2 hours) as end_us, count(*) as events from g group by 1, 2)
       select tenant_id, start_us, end_us, events from x where end_us <= (select epoch_us(max(ts) - interval 1 hour) from events)""",
)
def ss8(t):
    return drain(W.sessions(live(t).requests()), "sessions")


PARTS = 5
# Events in five parts by time; every 50th arrives one part late and the next two.
_PART = "cast(floor(4 * (t - lo) / (hi - lo + 1)) as int)"
_ARRIVES = f"least({_PART} + case event_id % 50 when 0 then 1 when 1 then 2 else 0 end, {PARTS - 1})"


def events_in_parts(t: Tables, arrives: str, name: str):
    """The events as a stream of several files in the order of event time, or nearly."""
    events = t.raw("events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    ends = events.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    parts = events.withColumns({"lo": ends.select("lo").scalar(), "hi": ends.select("hi").scalar()}).withColumn("part", F.expr(arrives))
    return in_parts(parts.drop("t", "lo", "hi"), "part", PARTS, name)


class Parts(Tables):
    """The same views over the events, delivered in parts."""

    def raw(self, name):
        return events_in_parts(Tables(self.spark, self.folder), _PART, name) if name == "events" else super().raw(name)


@query("ss9_drift_alerts", _DS)
def ss9(t):
    """The check after the last of five parts: what each part left is merged."""
    base = t.spark.createDataFrame(
        BASELINES, "lane string, score_name string, bundle_id string, base_mean double, base_sd double, min_n bigint, warn double, revalidate double"
    )
    ddl = "lane string, score_name string, identity_matches boolean, observations bigint, shift double, state string, reason_code string, batch bigint"
    obs = Parts(t.spark, t.folder).telemetry().withColumn("value", F.expr(_BAD))
    out = drain_batches(obs, "drift", W.drift_batch(base), {"checks": ddl})["checks"]
    last = out.agg(F.max("batch").alias("last"))
    return out.where(F.col("batch") == last.select("last").scalar()).drop("batch").withColumn("shift", r6(F.col("shift")))


@query("ss10_catalog_screening", f"select query_id, ref_id, round(sim, 6) as similarity, rank from ({_TOP.format('', 5)}) t")
def ss10(t):
    refs = t.anchors().selectExpr("item_id as ref_id", "0L as scope", "embedding as vec")
    ddl = "query_id bigint, ref_id bigint, similarity double, rank bigint"
    out = drain_batches(live(t).raw("embeddings"), "screen", W.screen_batch(refs, 5), {"hits": ddl})["hits"]
    return out.select("query_id", "ref_id", r6(F.col("similarity")).alias("similarity"), "rank")


@query(
    "ss11_stream_fan_out",
    "select e.event_id, e.event_type, p.endpoint_id from V_EVENT e join V_ENDPOINT p on p.tenant_id = e.tenant_id and p.active and (p.only_type is null or p.only_type = e.event_type)",
)
def ss11(t):
    joined = W.stream_fan_out(live(t).requests().select("event_id", "tenant_id", "event_type"), t.endpoints())
    return drain(joined.select("event_id", "event_type", "endpoint_id"), "fanout")


@query(
    "ss12_late_rows",
    f"""with b as (select event_id, epoch_us(ts) as t from events), e as (select *, min(t) over () as lo, max(t) over () as hi from b), p as (select event_id, t, {_ARRIVES} as part from e),
        m as (select part, max(t) as top from p group by 1), w as (select p.part, max(m.top) - 3600000000 as floor_ from (select distinct part from p) p join m on m.part < p.part group by 1)
        select event_id, t as at_us, coalesce(t < floor_, false) as late from p left join w on w.part = p.part""",
)
def ss12(t):
    ddl = "event_id bigint, at_us bigint"
    rows = events_in_parts(t, _ARRIVES, "arrivals").select("event_id", "ts")
    out = drain_batches(rows, "late", W.split_late(3600), {"on_time": ddl, "late": ddl})
    return out["on_time"].withColumn("late", F.lit(False)).unionByName(out["late"].withColumn("late", F.lit(True)))
