"""Metering, telemetry, drift, queues and requests over the event table."""

from pyspark.sql import functions as F

from evidlake.functions.expr import r6
from evidlake.operators import usage as O
from evidlake.plans.registry import query
from evidlake.sources.tables import Tables

METERS = ["signup", "error", "click", "view", "purchase"]
_M = "(values ('signup'), ('error'), ('click'), ('view'), ('purchase'))"


def stamp(text: str):
    return F.lit(text).cast("timestamp")


@query(
    "ag1_usage_summary",
    f"""select t.tenant_id, m.meter, coalesce(sum(u.quantity), 0)::bigint as quantity from (select distinct tenant_id from V_USAGE) t cross join {_M} m(meter)
        left join V_USAGE u on u.tenant_id = t.tenant_id and u.meter = m.meter and u.created_at >= timestamp '2024-01-18' and u.created_at < timestamp '2024-01-25' group by all""",
)
def ag1(t):
    return O.usage_summary(t.usage(), METERS, stamp("2024-01-25"), 7)


@query(
    "ag2_usage_since",
    "select tenant_id, coalesce(sum(quantity) filter (where meter = 'view' and created_at >= timestamp '2024-01-20'), 0)::bigint as quantity from V_USAGE group by 1",
)
def ag2(t):
    return O.usage_since(t.usage(), "view", stamp("2024-01-20"))


@query(
    "ag3_backlog",
    """select tenant_id, count(*) filter (where state = 'PENDING') as pending, count(*) filter (where state = 'SUBMITTED') as submitted, count(*) filter (where state = 'RETRYABLE') as retryable, count(*) filter (where state = 'CONFIRMED') as confirmed,
       count(*) filter (where state = 'FAILED') as failed, min(epoch_us(created_at)) filter (where state in ('PENDING', 'SUBMITTED', 'RETRYABLE')) as oldest_open_us from V_JOB group by 1""",
)
def ag3(t):
    return O.backlog(t.jobs())


_BAD = "case when value < 2 then null when value < 4 then -value else value end"
_PACK = f"select packet_id, bundle_id, score_name, count(*) filter (where v >= 0) as count, sum(v) filter (where v >= 0) as total, min(v) filter (where v >= 0) as min, max(v) filter (where v >= 0) as max, count(*) filter (where v is null or v < 0) as skipped from (select *, {_BAD} as v from V_TELEM) t group by all"


def packets(t: Tables):
    obs = t.telemetry().withColumn("value", F.expr(_BAD))
    return O.telemetry_summary(obs, ["packet_id", "bundle_id", "score_name"])


@query("ag4_telemetry_summary", f"select packet_id, bundle_id, score_name, count, round(total / nullif(count, 0), 6) as mean, min, max, skipped from ({_PACK}) p")
def ag4(t):
    p = packets(t).withColumn("mean", F.expr("round(total / nullif(count, 0), 6)"))
    return p.select("packet_id", "bundle_id", "score_name", "count", "mean", "min", "max", "skipped")


_MERGE = f"select score_name, count(*) as packets, count(*) filter (where count > 0) as valid_packets, sum(count)::bigint as n, sum(total) / sum(count) as mean, min(min) as mn, max(max) as mx, array_to_string(list_sort(list(distinct bundle_id) filter (where count > 0)), ',') as bundles from ({_PACK}) p group by 1"


@query("ag5_merge_telemetry", f"select score_name, packets, valid_packets, n as count, round(mean, 6) as mean, mn as min, mx as max, bundles as bundle_ids from ({_MERGE}) m")
def ag5(t):
    m = O.merge_telemetry(packets(t), ["score_name"])
    return m.withColumn("mean", r6(F.col("mean"))).withColumn("bundle_ids", F.array_join("bundle_ids", ","))


# Recorded baselines: one per lane and score; some name another bundle, some need more data.
BASELINES = [
    ("copy", "view", "b0,b1", 40.0, 30.0, 10, 0.2, 1.0), ("copy", "click", "b0,b1", 20.0, 10.0, 10, 0.5, 1.0), ("origin", "error", "b0,b1", 49.0, 50.0, 10, 0.2, 1.0),
    ("origin", "purchase", "b1", 50.0, 30.0, 10, 0.2, 1.0), ("style", "signup", "b0,b1", 50.0, 30.0, 10_000_000, 0.2, 1.0), ("style", "absent", "b0", 1.0, 1.0, 1, 0.2, 1.0),
]
_BL = "(values " + ", ".join(f"('{a}', '{b}', '{c}', {d}e0, {e}e0, {f}, {g}e0, {h}e0)" for a, b, c, d, e, f, g, h in BASELINES) + ") b(lane, score_name, base, bm, bs, mn, wa, re)"
_DR = f"""select lane, score_name, coalesce(bundles = base, false) as identity_matches, coalesce(n, 0)::bigint as observations, abs(mean - bm) / greatest(bs, 1e-6) as sh, mn, wa, re from {_BL} left join (
   select score_name, sum(count) as n, sum(total) / sum(count) as mean, array_to_string(list_sort(list(distinct bundle_id)), ',') as bundles from ({_PACK}) p where count > 0 group by 1) m using (score_name)"""
_DS = f"""select lane, score_name, identity_matches, observations, round(sh, 6) as shift, case when not identity_matches then 'REVALIDATION_REQUIRED' when observations < mn then 'INSUFFICIENT_CURRENT_OBSERVATIONS' when sh >= re then 'REVALIDATION_REQUIRED' when sh >= wa then 'WARNING' else 'STABLE' end as state,
   case when not identity_matches then 'MODEL_BUNDLE_IDENTITY_DRIFT' when observations < mn then 'DRIFT_SAMPLE_GATE_NOT_MET' when sh >= re then 'SCORE_DISTRIBUTION_SHIFT_EXCEEDS_REVALIDATION_THRESHOLD' when sh >= wa then 'SCORE_DISTRIBUTION_SHIFT_WARNING' end as reason_code from ({_DR}) d"""


def drift(t: Tables):
    base = t.spark.createDataFrame(
        BASELINES, "lane string, score_name string, bundle_id string, base_mean double, base_sd double, min_n bigint, warn double, revalidate double"
    )
    current = O.merge_telemetry(packets(t), ["score_name"])
    return O.evaluate_drift(current, base)


@query("ag6_drift_evaluation", _DS)
def ag6(t):
    return drift(t).select("lane", "score_name", "identity_matches", "observations", r6(F.col("shift")).alias("shift"), "state", "reason_code")


@query(
    "ag6_drift_rollup",
    f"select lane, case when bool_or(state = 'REVALIDATION_REQUIRED') then 'REVALIDATION_REQUIRED' when bool_or(state = 'WARNING') then 'WARNING' when bool_or(state = 'INSUFFICIENT_CURRENT_OBSERVATIONS') then 'INSUFFICIENT_CURRENT_OBSERVATIONS' else 'STABLE' end as state, bool_or(state = 'REVALIDATION_REQUIRED') as revalidation_required from ({_DS}) d group by 1",
)
def ag6b(t):
    return O.drift_rollup(drift(t), ["lane"])


@query("jn23_drift_baseline", f"select lane, score_name, observations from ({_DR}) d")
def jn23(t):
    return drift(t).select("lane", "score_name", "observations")


_RECENT = "select * from (select *, row_number() over (partition by meter order by created_at desc, event_id desc) as age_rank from V_USAGE) t where age_rank <= {0}"


@query(
    "ag7_latency_quantiles",
    "select meter, count(*) as samples, quantile_disc(latency_ms, 0.5) as p50, quantile_disc(latency_ms, 0.95) as p95, quantile_disc(latency_ms, 0.99) as p99 from V_USAGE group by 1",
)
def ag7(t):
    return O.latency_quantiles(t.usage(), "meter")


@query("wn11_recent_ring", f"select event_id, meter, age_rank from ({_RECENT.format(100)}) r")
def wn11(t):
    return O.recent_n(t.usage(), ["meter"], 100, "created_at", "event_id").select("event_id", "meter", "age_rank")


@query(
    "wn8_idempotency",
    """select event_id, case when event_id = f then 'NEW' when digest = fd then 'REPLAY' else 'CONFLICT' end as outcome from (select event_id, digest, first_value(event_id) over w as f, first_value(digest) over w as fd from V_EVENT window w as (partition by tenant_id, idem_key order by ts, event_id)) t""",
)
def wn8(t):
    return O.idempotency(t.requests(), ["tenant_id", "idem_key"], "event_id").select("event_id", "outcome")


@query(
    "wn12_trailing_day",
    "select event_id, count(*) over (partition by tenant_id order by created_at range between interval 24 hours preceding and current row) as trailing from V_USAGE",
)
def wn12(t):
    return O.trailing_count(t.usage(), "tenant_id", "event_id", "created_at", 24).select("event_id", "trailing")


@query(
    "wn7_next_version",
    """with e as (select *, row_number() over (partition by tenant_id, work_id % 5 order by effective_from, claim_id) as v from V_CLAIM where effective_from < timestamp '1997-01-01'),
       n as (select *, row_number() over (partition by tenant_id, work_id % 5 order by effective_from, claim_id) as v from V_CLAIM where effective_from >= timestamp '1997-01-01')
       select n.claim_id, n.v + coalesce((select max(v) from e where e.tenant_id = n.tenant_id and e.work_id % 5 = n.work_id % 5), 0) as version from n""",
)
def wn7(t):
    c = t.claims().withColumn("slot", F.col("work_id") % 5)
    cut = stamp("1997-01-01")
    empty = c.where("false").selectExpr("tenant_id", "slot", "cast(0 as bigint) as version")
    existing = O.assign_versions(c.where(F.col("effective_from") < cut), empty, ["tenant_id", "slot"], "claim_id", "effective_from")
    new = O.assign_versions(c.where(F.col("effective_from") >= cut), existing, ["tenant_id", "slot"], "claim_id", "effective_from")
    return new.select("claim_id", "version")


@query(
    "wn13_stage_changes",
    """select scan_id, event_id, stage, heartbeat_us - s as elapsed_us from (select *, lag(stage) over w as b, min(heartbeat_us) over (partition by scan_id) as s from V_STAGE window w as (partition by scan_id order by heartbeat_us, event_id)) t where b is null or b <> stage""",
)
def wn13(t):
    return O.stage_changes(t.stages(), "scan_id", "stage", "heartbeat_at", "event_id")


@query(
    "tk3_work_batch",
    "select job_id, state, attempts from V_JOB where state in ('PENDING', 'RETRYABLE') and not leased order by created_at, job_id limit 50",
)
def tk3(t):
    return O.work_batch(t.jobs(), ["PENDING", "RETRYABLE"], 50).select("job_id", "state", "attempts")


@query(
    "tk3_stranded_recovery",
    "select job_id, state from V_JOB where state in ('SUBMITTED', 'RETRYABLE') and not leased order by created_at, job_id limit 200",
)
def tk3b(t):
    return O.work_batch(t.jobs(), ["SUBMITTED", "RETRYABLE"], 200).select("job_id", "state")


@query("tk4_listing", "select job_id, tenant_id, state from V_JOB where state = 'FAILED' and attempts >= 5 order by created_at desc, job_id desc limit 100")
def tk4(t):
    return O.listing(t.jobs(), (F.col("state") == "FAILED") & (F.col("attempts") >= 5), 100).select("job_id", "tenant_id", "state")


@query(
    "jn16_fan_out",
    "select e.event_id, e.event_type, p.endpoint_id from V_EVENT e join V_ENDPOINT p on p.tenant_id = e.tenant_id and p.active and (p.only_type is null or p.only_type = e.event_type)",
)
def jn16(t):
    return O.fan_out(t.requests(), t.endpoints()).select("event_id", "event_type", "endpoint_id")


_ATT = "select event_id as attestation_id, tenant_id, concat('m', tenant_id % 60) as signer, digest as body_hash, epoch_us(ts) as issued_us, event_id % 13 <> 0 as commitment_ok from V_EVENT"


@query(
    "jn25_attestations",
    f"""with g as (select concat('m', s_suppkey % 60) as signer, bool_or(s_suppkey % 5 <> 0) as readable, bool_or(s_acctbal > 4000) as active from supplier where s_suppkey % 60 < 40 group by 1),
        m as (select c_custkey as tenant_id, concat('m', c_custkey % 60) as signer, case when c_acctbal > 0 then 'ACTIVE' else 'SUSPENDED' end as status from customer),
        j as (select a.*, case when g.readable then 'ON_CHAIN_REGISTRY' when not g.readable then 'ON_CHAIN_REGISTRY_UNAVAILABLE' else 'LOCAL_DIRECTORY' end as authority,
          case when not commitment_ok then 'BODY_DOES_NOT_MATCH_DEPLOYMENT' when 1705708800000000 - issued_us < -60000000 then 'SIGNATURE_ISSUED_IN_FUTURE' when 1705708800000000 - issued_us > 1296000000000 then 'SIGNATURE_EXPIRED'
            when not (case when g.readable then g.active when not g.readable then false else coalesce(m.status = 'ACTIVE', false) end) then 'SIGNER_NOT_PERMITTED' end as r from ({_ATT}) a left join g using (signer) left join m on m.tenant_id = a.tenant_id and m.signer = a.signer),
        k as (select *, row_number() over (partition by tenant_id, body_hash, r is null order by issued_us, attestation_id) as n from j)
        select attestation_id, authority, case when r is null and n > 1 then 'REPLAYED_BODY' else r end as refusal, r is null and n = 1 as accepted from k""",
)
def jn25(t):
    att = t.requests().selectExpr(
        "event_id as attestation_id", "tenant_id", "concat('m', tenant_id % 60) as signer", "digest as body_hash",
        "unix_micros(cast(ts as timestamp)) as issued_us", "event_id % 13 <> 0 as commitment_ok",
    )
    reg = t.raw("supplier").where("s_suppkey % 60 < 40").groupBy(F.expr("concat('m', s_suppkey % 60)").alias("signer")).agg(
        F.bool_or(F.expr("s_suppkey % 5 <> 0")).alias("readable"), F.bool_or(F.col("s_acctbal") > 4000).alias("active")
    )
    mem = t.raw("customer").selectExpr(
        "c_custkey as tenant_id", "concat('m', c_custkey % 60) as signer", "if(c_acctbal > 0, 'ACTIVE', 'SUSPENDED') as status"
    )
    return O.accept_attestations(att, mem, reg, 1705708800000000, 1_296_000).select("attestation_id", "authority", "refusal", "accepted")


_NOW = 1706400000000000
_LATE = "select scan_id, stage, max((heartbeat_us, event_id, attempt, max_attempts, lease_expires_us)) as b from V_STAGE group by 1, 2"


@query(
    "ag40_stage_timeline",
    f"""with n as (select scan_id, stage, list_position(['signup', 'view', 'click', 'purchase', 'error'], stage) as pos, b[3] as attempt, case when b[5] > {_NOW} then 'RUNNING' when b[3] >= b[4] then 'FAILED_TERMINAL' when b[3] % 2 = 0 then 'PENDING' else 'COMPLETED' end as state from ({_LATE}) l)
        select scan_id, string_agg(concat(stage, ':', state, ':', attempt), ',' order by pos) as timeline, sha256(string_agg(concat(stage, ':', state, ':', attempt), ',' order by pos)) as timeline_digest,
          coalesce(arg_min(stage, pos) filter (where state = 'RUNNING'), arg_min(stage, pos) filter (where state = 'PENDING')) as progress_stage from n group by 1""",
)
def ag40(t):
    return O.stage_timeline(t.stages(), _NOW)


@query(
    "st6_complete_domain",
    """select s.scan_id, m.stage, coalesce(n, 0)::bigint as attempts from (select distinct scan_id from V_STAGE) s cross join (values ('signup'), ('view'), ('click'), ('purchase'), ('error'), ('archive')) m(stage)
       left join (select scan_id, stage, count(*) as n from V_STAGE group by 1, 2) c on c.scan_id = s.scan_id and c.stage = m.stage""",
)
def st6(t):
    counted = t.stages().groupBy("scan_id", "stage").agg(F.count(F.lit(1)).alias("attempts"))
    return O.complete_domain(counted, ["scan_id"], "stage", [*O.STAGES, "archive"], {"attempts": 0})


@query(
    "st4_same_set",
    """with o as (select distinct packet_id, score_name from V_TELEM where value > 5), e as (select distinct packet_id, score_name from V_TELEM where value < 100)
       select coalesce(o.packet_id, e.packet_id) as packet_id, bool_and(o.packet_id is not null and e.packet_id is not null) as equal, count(*) filter (where e.packet_id is null) as unexpected, count(*) filter (where o.packet_id is null) as absent
       from o full join e on o.packet_id = e.packet_id and o.score_name = e.score_name group by 1""",
)
def st4(t):
    v = t.telemetry()
    return O.same_set(v.where("value > 5"), v.where("value < 100"), "packet_id", "score_name")


@query(
    "prj9_json_walk",
    """with d as (select event_id, concat('{"id":', event_id, ',"meta":', props, ',"items":[{"code":"', event_type, '"},{"errors":{"code":"E', event_id % 3, '"}}]}') as doc from V_EVENT)
       select event_id, count(*) as pairs, sum(case when key = 'code' then 1 else 0 end)::bigint as code_keys, max(case when key = 'k' then value::varchar end) as k_value,
         count(*) filter (where contains(fullkey, '.errors') and key = 'code') as failure_codes from (select event_id, t.key, t.value, t.fullkey from d, json_tree(d.doc) t where t.key is not null and t.type is not null and regexp_full_match(t.key, '[a-z].*')) q group by 1""",
)
def prj9(t):
    from evidlake.operators.plugins import json_pairs

    doc = F.concat(
        F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"meta":'), F.col("props"), F.lit(',"items":[{"code":"'),
        F.col("event_type"), F.lit('"},{"errors":{"code":"E'), (F.col("event_id") % 3).cast("string"), F.lit('"}}]}'),
    )
    pairs = json_pairs(t.requests().select("event_id", doc.alias("doc")), "event_id", "doc")
    return pairs.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("key") == "code").alias("code_keys"),
        F.max(F.when(F.col("key") == "k", F.col("value"))).alias("k_value"),
        F.count_if((F.col("key") == "code") & (F.col("bucket") == "failure")).alias("failure_codes"),
    )
