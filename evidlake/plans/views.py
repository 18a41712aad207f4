"""The bound views as DuckDB text (see sources.tables for the Spark side)."""


def h32(x: str) -> str:
    return f"concat('0x', substr(md5({x}), 1, 8))::bigint"


def bits(e: str, o: int) -> str:
    return (
        f"list_sum(list_transform(generate_series(1, 32), lambda i: case when {e}[i + {o}] > 0 "
        "then (1::bigint << (32 - i)) else 0 end))::bigint"
    )


def wlogit(score: str, weight: str, where: str = "true") -> str:
    """Sigmoid of the weighted mean logit as an aggregate."""
    p = f"least(greatest({score}, 1e-5), 1 - 1e-5)"
    return (
        f"(1 / (1 + exp(-(sum({weight} * ln({p} / (1 - {p}))) filter (where {where}) / "
        f"sum({weight}) filter (where {where})))))"
    )


# A text's distinct word shingles, and one byte of a min-hash.
SHINGLES = (
    "list_distinct(list_transform(generate_series(1, greatest(len(string_split({0}, ' ')) - 4, 1)), "
    "lambda i: array_to_string(string_split({0}, ' ')[i:i + 4], ' ')))"
)
DIGESTS = "list_transform(" + SHINGLES + ", lambda s: sha256(s))"
MINIMUM = "list_min(list_transform(d, lambda s: substr(s, {0}, 8)))"
_TAILS = [f"substr({MINIMUM.format(1 + 8 * k)}, 7, 2)" for k in range(8)]

_JOBSTATE = (
    "case event_type when 'view' then 'PENDING' when 'click' then 'SUBMITTED' when 'purchase' then 'CONFIRMED' "
    "when 'signup' then 'RETRYABLE' else 'FAILED' end"
)

def _failure(kind: str) -> str:
    """The first failed check of a recorded row: which rows are tampered with goes by their id."""
    checks = {
        31: "INTEGRITY_EVENT_MISSING", 37: "INTEGRITY_EVENT_TYPE_INVALID", 41: "INTEGRITY_TENANT_MISMATCH", 43: "INTEGRITY_SUBJECT_MISMATCH",
        47: "INTEGRITY_DIGEST_MISMATCH", 53: "INTEGRITY_LOG_INCLUSION_MISSING", 59: "INTEGRITY_PROJECTION_MISSING", 61: "PROJECTION_INTEGRITY_MISMATCH",
    }
    return "case " + " ".join(f"when {kind}_id % {n} = 0 then '{kind.upper()}_{code}'" for n, code in checks.items()) + " end"


VIEWS: dict[str, str] = {
    "V_WORK": "select doc_id as work_id, lang as tenant_id, source as catalog_id, text, n_chars as byte_size, sha256(text) as sha256, case when doc_id % 7 = 0 then null else concat('c', doc_id % 20) end as claimant from documents",
    "V_VERSION": "select doc_id as work_id, v::bigint as version, sha256(concat(text, '#', v)) as sha256 from documents cross join (values (1),(2),(3)) t(v) where v <= doc_id % 4",
    "V_MANIFEST": "select doc_id as asset_id, concat('items/', doc_id) as location, sha256(text) as sha256, source as source_lineage_id, case doc_id % 4 when 0 then 'TRAIN' when 1 then 'CALIBRATION' when 2 then 'TEST' else 'DEMO' end as part, case when doc_id % 50 = 0 then doc_id + 100000000 when doc_id % 10 = 0 then doc_id + 1 end as derived_from from documents",
    "V_LINE": "select doc_id, line_no::bigint as line_no, line from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line_no, unnest(string_split(text, chr(10))) as line from documents) t",
    "V_WORD": f"select doc_id as page, ((pos - 1) // 8)::bigint as line_no, pos::bigint as word_no, word, (((pos - 1) % 8) * 10)::bigint as left_px, ({h32('word')} % 100) / 1e2 as conf from (select doc_id, generate_subscripts(string_split(text, ' '), 1) as pos, unnest(string_split(text, ' ')) as word from documents) t where word <> ''",
    "V_CHUNK": "select doc_id, region, substring(text, s + 1, w) as chunk from (select doc_id, text, region, case region when 'center' then cast(floor((n - w) / 2e0) as int) when 'tail' then n - w else 0 end as s, case region when 'whole' then n else w end as w from (select doc_id, text, length(text)::int as n, least(length(text)::int, greatest(64, cast(floor(length(text) * 0.64e0) as int))) as w from documents) d cross join (values ('whole'),('center'),('head'),('tail')) r(region) where region = 'whole' or w < n) t",
    "V_FP": "select doc_id as item_id, concat('0x', " + ", ".join(_TAILS[:4]) + ")::bigint as hi, concat('0x', " + ", ".join(_TAILS[4:]) + ")::bigint as lo from (select doc_id, " + DIGESTS.format("text") + " as d from documents) t",
    "V_ANCHOR": "select vec_id as item_id, label::bigint as profile_key, label % 2 = 0 as authorized, embedding::double[] as embedding from embeddings",
    "V_BITS": f"select vec_id as item_id, {bits('embedding', 0)} as hi, {bits('embedding', 32)} as lo from embeddings",
    "V_QREF": "select q.item_id as query_id, q.profile_key as expected_profile, q.profile_key <> 9 as known, q.embedding as q_emb, r.item_id as ref_id, r.profile_key, r.embedding as r_emb, list_dot_product(q.embedding, r.embedding) / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(r.embedding, r.embedding))) as sim from V_ANCHOR q cross join V_ANCHOR r where q.item_id <> r.item_id",
    "V_SCORE": f"select l.doc_id as asset_id, l.quality::bigint as label, d.lang as grp, d.source as source_lineage_id, concat('p', l.doc_id % 3) as provider, floor((0.35e0 * l.quality + 0.65e0 * ({h32('cast(l.doc_id as varchar)')} % 10000) / 1e4) * 100e0) / 100e0 as score from labels l join documents d on d.doc_id = l.doc_id",
    "V_DET": "select l.doc_id as asset_id, p::bigint as provider_no, (p % 2)::bigint as family, v::bigint as view_no, case when v < 5 then 'DELIVERY_TRANSFORM' else 'SPATIAL_CROP' end as scope, case v when 0 then 1e0 when 1 then 0.92e0 when 2 then 0.76e0 when 3 then 0.78e0 when 4 then 0.72e0 else 0.68e0 end as weight, p <> 2 as calibrated, (0.5e0 * l.quality + 0.5e0 * (" + h32("concat(l.doc_id, '-', p, '-', v)") + " % 1000) / 1e3) * 0.98e0 + 0.01e0 as score from labels l cross join (values (0),(1),(2)) a(p) cross join (values (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) b(v)",
    "V_EVENT": "select event_id, user_id as tenant_id, concat('k', event_id % 200) as idem_key, sha256(concat(event_type, '|', event_id % 2)) as digest, ts, event_type, value, props from events",
    "V_USAGE": "select event_id, user_id as tenant_id, event_type as meter, cast(floor(abs(value)) as bigint) + 1 as quantity, value as latency_ms, ts as created_at from events",
    "V_JOB": f"select event_id as job_id, user_id as tenant_id, {_JOBSTATE} as state, event_id % 9 as attempts, ts as created_at, event_id % 3 = 0 as leased from events",
    "V_STAGE": "select event_id, user_id as scan_id, event_type as stage, event_id % 4 as attempt, 3::bigint as max_attempts, ts as heartbeat_at, epoch_us(ts) as heartbeat_us, epoch_us(ts) + 180000000 as lease_expires_us from events",
    "V_TELEM": "select concat(user_id, '-', cast(cast(ts as date) as varchar)) as packet_id, event_type as score_name, concat('b', user_id % 2) as bundle_id, value, ts from events",
    "V_ENDPOINT": "select c_custkey * 10 + slot as endpoint_id, c_custkey as tenant_id, case when c_mktsegment = 'BUILDING' then 'purchase' when c_mktsegment = 'MACHINERY' then 'error' when slot = 2 then 'view' end as only_type, c_acctbal > 0 as active from customer cross join (values (1::bigint),(2::bigint)) s(slot)",
    "V_CLAIM": "select o_orderkey as claim_id, o_custkey as tenant_id, o_orderkey % 500 as work_id, case o_orderstatus when 'F' then 'CORROBORATED' when 'O' then 'ASSERTED' else 'DISPUTED' end as state, o_orderdate as effective_from from orders",
    "V_LICENSE": "select l.l_orderkey * 10 + l.l_linenumber as license_id, l.l_orderkey as claim_id, l.l_orderkey % 500 as work_id, case when l.l_linenumber = 7 then -1 else o.o_custkey end as tenant_id, case l.l_returnflag when 'N' then 'ACTIVE' when 'A' then 'SUSPENDED' else 'REVOKED' end as state, case l.l_linestatus when 'O' then 'marketing' else 'editorial' end as permitted_use, l.l_shipdate as effective_from, l.l_shipdate + interval '30' day as effective_until from lineitem l join orders o on o.o_orderkey = l.l_orderkey",
    "V_TITLE": f"select claim_id, work_id, tenant_id, case when claim_id % 17 = 3 then 'SUPERSEDED' when claim_id % 19 = 4 then 'REVOKED' else state end as state, effective_from, case when claim_id % 4 = 1 then effective_from + interval '700' day end as effective_until, {_failure('claim')} as failure from V_CLAIM",
    "V_GRANT": f"select license_id, claim_id, case when license_id % 27 = 2 then work_id + 1 else work_id end as work_id, license_id % 10 as version, case when license_id % 23 = 5 then 'SUPERSEDED' when license_id % 29 = 6 then 'EXPIRED' else state end as state, case when license_id % 5 = 0 then ['marketing', 'editorial'] else [permitted_use] end as permitted, case when license_id % 6 = 1 then ['marketing'] when license_id % 10 = 3 then ['editorial', 'resale'] else [] end as prohibited, case when license_id % 13 <> 0 then cast(effective_from as timestamp) + to_seconds(license_id % 86400) end as effective_from, case when license_id % 8 <> 0 then cast(effective_until as timestamp) + interval '400' day end as effective_until, {_failure('license')} as failure from (select license_id, claim_id, work_id, m[1] as effective_from, m[2] as state, m[3] as permitted_use, m[1] + interval '30' day as effective_until from (select license_id, claim_id, work_id, min((effective_from, state, permitted_use, tenant_id)) as m from V_LICENSE group by all) g) g",
    "V_SCAN": "select o_orderkey as scan_id, o_custkey as tenant_id, case o_orderkey % 5 when 0 then 'MATCH_FOUND' when 1 then 'INCONCLUSIVE' when 2 then 'NO_MATCH_IN_CHECKED_SOURCES' when 3 then 'SCOPE_INCOMPLETE' else 'ERROR' end as match_status, case when o_orderkey % 5 = 2 then 'COMPLETE' when o_orderkey % 7 < 4 then 'COMPLETE' when o_orderkey % 7 = 4 then 'PARTIAL' when o_orderkey % 7 = 5 then 'DEGRADED' else 'TRUNCATED' end as coverage_status, case o_orderkey % 4 when 0 then 'LIKELY_AI_GENERATED' when 1 then 'NO_AI_ORIGIN_EVIDENCE_DETECTED' when 2 then 'AI_ORIGIN_REVIEW_CANDIDATE' end as origin_class, case o_orderkey % 3 when 0 then 'HIGH' when 1 then 'LOW' else 'REVIEW' end as style_tier, case when o_orderkey % 2 = 0 then 'marketing' else 'editorial' end as intended_use, o_orderkey % 500 as work_id, o_orderdate as created_at from orders",
    "V_RIGHTS": "select l_orderkey as subject_id, l_orderkey * 10 + l_linenumber as rights_event_id, case l_linenumber % 4 when 0 then 'CORROBORATED' when 1 then 'DISPUTED' when 2 then 'SUPERSEDED' else 'REVOKED' end as event_type, l_shipdate as created_at from lineitem",
    "V_COVER": "select l_orderkey as scan_id, l_orderkey * 10 + l_linenumber as ref_id, l_linenumber <= 3 as is_candidate, " + h32("concat(l_orderkey, '-', l_linenumber, '-', l_partkey)") + " % 10 as outcome from lineitem",
    "V_POINT": "select l_suppkey as pair_id, l_orderkey * 10 + l_linenumber as link_id, least(1e0, l_discount * 10e0) as x, least(1e0, l_tax * 12e0) as y, l_quantity / 50e0 as err from lineitem",
    "V_STMT": "select conv_id as scan_id, turn, conv_id * 1000 + turn as statement_id, lag(conv_id * 1000 + turn) over (partition by conv_id order by turn) as previous_statement_id, sha256(text) as payload_digest, case when turn % 5 = 0 then 'RESULT' when turn % 5 = 1 then 'DISPUTE' when turn % 5 = 2 then 'CORRECTION' when turn % 5 = 3 then 'SUPERSESSION' else 'REVOCATION' end as statement_type from conversations",
    "V_LEAF": "select row_number() over (order by doc_id) - 1 as leaf_index, doc_id as statement_id, sha256(text) as packet_hash, 1704067200 + doc_id * 7 as created_s from documents where doc_id % 11 <> 0",
    "V_CKPT": "select tree_size, tree_size % 30 = 0 as confirmed, tree_size % 20 = 0 as queued from (select row_number() over (order by doc_id) as tree_size from documents where doc_id % 11 <> 0) t where tree_size % 10 = 0",
    "V_MEMBER": "select *, greatest(0e0, 1e0 - sd / 0.18e0) as st, case when spatial_corroborated then greatest(o, dc, sm) else greatest(o, dc) end as agg from (select asset_id, provider_no, max(family) as family, bool_or(calibrated) as calibrated, max(score) filter (where view_no = 0) as o, "
    + wlogit("score", "weight", "scope = 'DELIVERY_TRANSFORM'") + " as dc, " + wlogit("score", "weight", "scope = 'DELIVERY_TRANSFORM' and view_no > 0") + " as td, stddev_pop(score) filter (where scope = 'DELIVERY_TRANSFORM') as sd, median(score) filter (where scope = 'SPATIAL_CROP') as sm, count(*) filter (where scope = 'SPATIAL_CROP' and score >= 0.58) as sup, count(*) filter (where scope = 'SPATIAL_CROP' and score >= 0.58) >= 3 as spatial_corroborated from V_DET group by asset_id, provider_no) q",
    "V_FAMILY": "select asset_id, family, round(" + wlogit("a6", "rel") + ", 6) as score, avg(rel) as rel, bool_and(calibrated) as calibrated, bool_and(provider_no < 2 or asset_id % 3 = 0) as verified, avg(s6) as stability, count(*) as members from (select asset_id, family, provider_no, calibrated, round(agg, 6) as a6, round(st, 6) as s6, (case when calibrated then 1e0 else 0.78e0 end) * (0.45e0 + 0.55e0 * round(st, 6)) as rel from V_MEMBER) m group by asset_id, family",
    "V_FUSED": "select asset_id, " + wlogit("score", "rel") + " as fused, case when count(*) > 1 then stddev_pop(score) end as disagreement, sum(stability * rel) / sum(rel) as stability, min(stability) as min_stability, sum(members)::bigint as members, count(*) as observed, count(*) filter (where verified) as families, count(*) filter (where verified and calibrated) as cal, count(*) filter (where stability >= 0.35 and score >= 0.58) as obs_pos, count(*) filter (where verified and stability >= 0.35 and score >= 0.58) as pos, count(*) filter (where verified and stability >= 0.35 and score >= 0.78) as strong, count(*) filter (where verified and calibrated and stability >= 0.35 and score >= 0.78) as cal_strong, count(*) filter (where verified and calibrated and stability >= 0.35 and score >= 0.58) as cal_pos, count(*) filter (where verified and score >= 0.58) as ver_pos from V_FAMILY group by asset_id",
}
