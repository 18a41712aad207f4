"""Rights, policy evaluation, triage and lanes over orders and line items."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidlake.functions.expr import joined
from evidlake.functions.skew import join_unique
from evidlake.operators import decisions as D
from evidlake.operators import ledger as L
from evidlake.operators import rights as R
from evidlake.operators.fusion import origin_state
from evidlake.plans.fusion import _STATES
from evidlake.plans.registry import query
from evidlake.session import spread, stored, stored_by
from evidlake.sources.tables import Tables

AS_OF = "1999-06-15 00:00:00"
# Rows of rights facts (under a kilobyte each) that every executor may hold.
FEW_FACTS = 10_000


def as_of():
    return F.lit(AS_OF).cast("timestamp")


_AT = """case when failure is not null then 'UNVERIFIED' when state in ('SUSPENDED', 'SUPERSEDED', 'REVOKED', 'EXPIRED') then 'LICENSE_' || state when effective_from > {0} then 'LICENSE_NOT_YET_EFFECTIVE'
      when effective_until <= {0} then 'LICENSE_EXPIRED' when list_contains(prohibited, {1}) then 'LICENSE_PROHIBITS_INTENDED_USE' when not list_contains(permitted, {1}) then 'LICENSE_DOES_NOT_LIST_INTENDED_USE' else 'LICENSE_PERMITS_INTENDED_USE' end"""


@query(
    "jn11_license_authorizes",
    f"""with v as (select s.scan_id, s.work_id, case when g.license_id is not null then {_AT.format("s.created_at", "s.intended_use")} end as verdict
         from (select scan_id, work_id, intended_use, cast(created_at as timestamp) + to_seconds(scan_id % 86400) as created_at from V_SCAN) s left join (select license_id, work_id as g_work, state, permitted, prohibited, effective_from, effective_until, failure from V_GRANT) g on g.g_work = s.work_id)
       select scan_id as event_id, work_id, count(*) filter (where verdict = 'LICENSE_PERMITS_INTENDED_USE') as permitting, count(*) filter (where verdict = 'LICENSE_PROHIBITS_INTENDED_USE') as prohibiting,
         count(*) filter (where verdict = 'LICENSE_DOES_NOT_LIST_INTENDED_USE') as other_use, count(*) filter (where verdict = 'LICENSE_EXPIRED') as expired, count(*) filter (where verdict = 'LICENSE_NOT_YET_EFFECTIVE') as not_yet_effective,
         count(*) filter (where verdict = 'LICENSE_SUSPENDED') as suspended, count(*) filter (where verdict = 'LICENSE_REVOKED') as revoked, count(*) filter (where verdict = 'LICENSE_SUPERSEDED') as superseded, count(*) filter (where verdict = 'UNVERIFIED') as unverified,
         count(*) filter (where verdict = 'LICENSE_PERMITS_INTENDED_USE') > 0 as authorized,
         coalesce(array_to_string(list_sort(list_distinct(list(case when verdict = 'UNVERIFIED' then 'LICENSE_PROJECTION_INTEGRITY_UNVERIFIED' else verdict end))), '|'), '') as reason_codes from v group by 1, 2""",
)
def jn11(t):
    at = F.unix_micros("created_at") + F.col("scan_id") % 86400 * 1_000_000
    uses = t.scans().select(F.col("scan_id").alias("event_id"), "work_id", "intended_use", at.alias("at_us"))
    lic = gated_licenses(t).select(
        "work_id", "state", "permitted_uses", "prohibited_uses", "verified", F.unix_micros("effective_from").alias("from_us"), F.unix_micros("effective_until").alias("until_us")
    )
    return R.license_authorizes(uses, lic)


def gated_rights(t: Tables):
    """Claims and licenses with the verdict on their recorded projection."""
    return gated_claims(t), gated_licenses(t)


def gated_claims(t: Tables):
    titles = t.titles(stored_by(t.claims(), "claims", "claim_id", [t.raw("orders")]))
    return R.gated(titles, L.projection_integrity(*t.rights_log("claim", titles), subject="claim"), "claim_id", "claim")


def gated_licenses(t: Tables):
    """Licenses, their events and their verdicts meet by license, in the buckets they are stored in."""
    grants = t.grants(stored_by(t.first_licenses(), "licenses", "license_id", [t.raw("lineitem"), t.raw("orders")]))
    return R.gated(grants, L.projection_integrity(*t.rights_log("license", grants), subject="license"), "license_id", "license")


@query(
    "jn20_license_integrity",
    "select license_id as id, failure as reason_code, failure is null as verified from V_GRANT union all select -claim_id, failure, failure is null from V_TITLE",
)
def jn20_license(t):
    c, g = gated_rights(t)
    out = lambda df, id_: df.select(id_, F.col("integrity_code").alias("reason_code"), "verified")
    return out(g, F.col("license_id").alias("id")).unionByName(out(c, (-F.col("claim_id")).alias("id")))


_BACK = f"""select l.*, case when c.claim_id is null then 'LICENSE_NOT_BOUND_TO_RECORDED_CLAIM' when c.state = 'CORROBORATED' and c.effective_from <= timestamp '{AS_OF}' then 'STRONG' when c.state = 'DISPUTED' then 'MATCHED_CLAIM_DISPUTED' else 'MATCHED_CLAIM_NOT_CORROBORATED' end as backing
  from V_LICENSE l left join V_CLAIM c on c.claim_id = l.claim_id"""


@query("jn12_backed_licenses", f"select license_id, claim_id, backing from ({_BACK}) b")
def jn12(t):
    return R.backed_licenses(t.licenses(), t.claims(), as_of()).select("license_id", "claim_id", "backing")


@query(
    "jn13_rights_history",
    """with s as (select concat('claim:', claim_id) as subject, work_id from V_CLAIM union all select concat('license:', license_id), work_id from V_LICENSE union all select distinct concat('work:', work_id), work_id from V_CLAIM)
       select work_id, rights_event_id, event_type from (select *, case rights_event_id % 3 when 0 then concat('claim:', subject_id) when 1 then concat('license:', rights_event_id) else concat('work:', subject_id) end as subject from V_RIGHTS) e join s using (subject)""",
)
def jn13(t):
    ev = t.rights_events().selectExpr(
        "*", "case rights_event_id % 3 when 0 then concat('claim:', subject_id) when 1 then concat('license:', rights_event_id) else concat('work:', subject_id) end as subject"
    )
    return R.rights_history(ev, t.claims(), t.licenses()).select("work_id", "rights_event_id", "event_type")


_LIST = "list_sort(list_distinct(list_filter(flatten(list({0})), lambda z: z is not null)))"
_NOW = f"timestamp '{AS_OF}'"
_FACTS = f"""tt as (select *, failure is null and state = 'CORROBORATED' and coalesce(effective_from <= {_NOW}, true) and coalesce(effective_until > {_NOW}, true) as stands,
     [failure, case when effective_from > {_NOW} then 'CLAIM_NOT_YET_EFFECTIVE' end, case when effective_until <= {_NOW} then 'CLAIM_NO_LONGER_EFFECTIVE' end, case when state in ('DISPUTED', 'SUPERSEDED', 'REVOKED') then 'CLAIM_' || state end] as codes from V_TITLE),
  ca as (select work_id, count(*) as claims, count(*) filter (where stands) as corroborated, bool_or(state = 'DISPUTED') as disputed, bool_or(failure is not null) as c_odd, {_LIST.format("codes")} as c_codes from tt group by 1),
  gl as (select g.*, intended_use, {_AT.format(_NOW, "intended_use")} as verdict, c_state, coalesce(stands, false) as stands
     from V_GRANT g cross join (values ('marketing'), ('editorial')) u(intended_use) left join (select claim_id as c_id, work_id as c_work, state as c_state, stands from tt) c on c_id = g.claim_id and c_work = g.work_id),
  gw as (select *, case when verdict = 'LICENSE_PERMITS_INTENDED_USE' and not stands then case when c_state is null then ['LICENSE_NOT_BOUND_TO_RECORDED_CLAIM'] else ['LICENSE_BACKING_CLAIM_NOT_CORROBORATED', case when c_state in ('DISPUTED', 'SUPERSEDED', 'REVOKED') then 'MATCHED_CLAIM_' || c_state else 'MATCHED_CLAIM_NOT_CORROBORATED' end] end else [] end as more from gl),
  lu as (select work_id, intended_use, count(*) as licenses, bool_or(verdict = 'LICENSE_SUSPENDED') as suspended, bool_or(failure is not null) as l_odd, count(*) filter (where verdict = 'LICENSE_PERMITS_INTENDED_USE') as scope, count(*) filter (where verdict = 'LICENSE_PERMITS_INTENDED_USE' and stands) as strong,
     min((version, license_id)) filter (where verdict = 'LICENSE_PERMITS_INTENDED_USE' and stands) as best, {_LIST.format("list_append(more, coalesce(failure, verdict))")} as l_codes from gw group by all),
  wk as (select distinct work_id, intended_use from (select work_id from V_TITLE union select work_id from V_GRANT) w cross join (values ('marketing'), ('editorial')) u(intended_use)),
  fa as (select wk.work_id, wk.intended_use, coalesce(claims, 0) as claims, coalesce(licenses, 0) as licenses, coalesce(scope, 0) as scope, coalesce(strong, 0) as strong, best[2] as first_id,
     concat_ws('|', case when disputed then 'CLAIM_DISPUTED' end, case when suspended then 'LICENSE_SUSPENDED' end) as blocking,
     concat_ws('|', case when c_odd then 'CLAIM_PROJECTION_INTEGRITY_UNVERIFIED' end, case when l_odd then 'LICENSE_PROJECTION_INTEGRITY_UNVERIFIED' end, case when corroborated = 0 then 'NO_CORROBORATED_CLAIM' end, case when claims is null then 'NO_RECORDED_CLAIM' end, case when licenses is null then 'NO_RECORDED_LICENSE' end) as missing,
     coalesce(array_to_string(c_codes, '|'), '') as claim_reasons, coalesce(array_to_string(l_codes, '|'), '') as license_reasons
     from wk left join ca on ca.work_id = wk.work_id left join lu on lu.work_id = wk.work_id and lu.intended_use = wk.intended_use),
  fx as (select *, strong > 0 as authorized, case when strong > 0 then 'EXISTING_LICENSE' when blocking <> '' then 'DISPUTED' when licenses > 0 then 'EXISTING_LICENSE' else 'NO_LICENSE_INFO' end as derived_path from fa)"""


def facts(t: Tables):
    claims, licenses = gated_rights(t)
    return R.rights_facts(claims, licenses, ["marketing", "editorial"], as_of())


@query(
    "dc11_rights_facts",
    f"with {_FACTS} select work_id, intended_use, authorized, first_id as authorizing_license_id, scope, strong, blocking, missing, claim_reasons, license_reasons, derived_path from fx",
)
def dc11(t):
    f = facts(t)
    for c in ("blocking", "missing", "claim_reasons", "license_reasons"):
        f = f.withColumn(c, joined(F.col(c)))
    return f.select(
        "work_id", "intended_use", "authorized", "authorizing_license_id", "scope", "strong", "blocking", "missing", "claim_reasons", "license_reasons", "derived_path"
    )


_BASE = """select *, case when match_status = 'NO_MATCH_IN_CHECKED_SOURCES' then 'PASS_BY_POLICY' else 'REVIEW' end as baseline_action, 'NO_LICENSE_INFO' as baseline_path,
  case match_status when 'SCOPE_INCOMPLETE' then 'SCOPE_INCOMPLETE_REQUIRES_REVIEW' when 'ERROR' then 'SCAN_ERROR_REQUIRES_REVIEW' when 'INCONCLUSIVE' then 'VISUAL_EVIDENCE_INCONCLUSIVE' when 'NO_MATCH_IN_CHECKED_SOURCES' then 'NO_MATCH_IN_DECLARED_CATALOG|PASS_IS_POLICY_NOT_COPYRIGHT_CLEARANCE'
    else case when coverage_status <> 'COMPLETE' then 'MATCH_FOUND_WITH_INCOMPLETE_SCOPE_REQUIRES_REVIEW' else 'MATCH_REQUIRES_PERSISTED_RIGHTS_EVALUATION' end end as baseline_reasons,
  ['REQUIRED', 'INFORMATIONAL', 'DISABLED'][scan_id % 3 + 1] as origin_mode, style_tier in ('HIGH', 'REVIEW') as style_review from V_SCAN"""


@query("dc9_baseline_policy", f"select scan_id, baseline_action, baseline_path, baseline_reasons from ({_BASE}) b")
def dc9(t):
    return D.baseline_policy(t.scans()).select("scan_id", "baseline_action", "baseline_path", "baseline_reasons")


_LEG = """select *, case work_id % 6 when 0 then 'EXISTING_LICENSE' when 1 then 'LICENSE_AVAILABLE' when 2 then 'DISPUTED' when 3 then 'NO_LICENSE_INFO' when 4 then 'BOGUS' end as rights_path,
  case when work_id % 6 = 0 then 'CORROBORATED' else ['CORROBORATED', 'ASSERTED', 'DISPUTED', 'SUPERSEDED', 'REVOKED', 'ODD'][work_id % 7 % 6 + 1] end as claim_state from V_SCAN"""


@query(
    "dc10_legacy_policy",
    f"""with x as ({_LEG}), k as (select *, case when rights_path = 'BOGUS' or rights_path is null then 'NO_LICENSE_INFO' else rights_path end as p, case scan_id % 3 when 0 then 'CANDIDATE_VERIFICATION_TRUNCATED' when 1 then 'CANDIDATE_VERIFICATION_FAILURE|CANDIDATE_VERIFICATION_PARTIAL' end as why from x)
       select scan_id, case when match_status = 'NO_MATCH_IN_CHECKED_SOURCES' then 'PASS_BY_POLICY' when match_status <> 'MATCH_FOUND' then 'REVIEW' when coverage_status = 'COMPLETE' and rights_path = 'EXISTING_LICENSE' and claim_state = 'CORROBORATED' and intended_use = 'marketing' then 'PASS_BY_POLICY' else 'REVIEW' end as policy_action,
        case when match_status <> 'MATCH_FOUND' then 'NO_LICENSE_INFO' else p end as policy_path,
        case match_status when 'SCOPE_INCOMPLETE' then concat_ws('|', 'SCOPE_INCOMPLETE_REQUIRES_REVIEW', why) when 'ERROR' then 'SCAN_ERROR_REQUIRES_REVIEW' when 'INCONCLUSIVE' then 'VISUAL_EVIDENCE_INCONCLUSIVE' when 'NO_MATCH_IN_CHECKED_SOURCES' then 'NO_MATCH_IN_DECLARED_CATALOG|PASS_IS_POLICY_NOT_COPYRIGHT_CLEARANCE' else
         case when coverage_status <> 'COMPLETE' then concat_ws('|', 'MATCH_FOUND_WITH_INCOMPLETE_SCOPE_REQUIRES_REVIEW', why) when rights_path is null then 'MATCH_WITHOUT_RIGHTS_RECORD' when rights_path = 'BOGUS' then 'MATCHED_RIGHTS_PATH_INVALID' when rights_path = 'DISPUTED' then 'MATCHED_RIGHTS_RECORD_DISPUTED'
          when claim_state = 'ASSERTED' then 'MATCHED_CLAIM_NOT_CORROBORATED' when claim_state in ('DISPUTED', 'SUPERSEDED', 'REVOKED') then 'MATCHED_CLAIM_' || claim_state when claim_state <> 'CORROBORATED' then 'MATCHED_CLAIM_STATE_INVALID'
          when rights_path = 'EXISTING_LICENSE' and intended_use = 'marketing' then 'MATCHED_USE_ALLOWED_BY_RIGHTS_RECORD' when rights_path = 'LICENSE_AVAILABLE' then 'LICENSE_PATH_AVAILABLE_REVIEW_REQUIRED' else 'MATCH_REQUIRES_RIGHTS_REVIEW' end end as reason_codes from k""",
)
def dc10(t):
    s = t.scans().selectExpr(
        "*", "case work_id % 6 when 0 then 'EXISTING_LICENSE' when 1 then 'LICENSE_AVAILABLE' when 2 then 'DISPUTED' when 3 then 'NO_LICENSE_INFO' when 4 then 'BOGUS' end as rights_path",
        "case when work_id % 6 = 0 then 'CORROBORATED' else element_at(array('CORROBORATED', 'ASSERTED', 'DISPUTED', 'SUPERSEDED', 'REVOKED', 'ODD'), cast(work_id % 7 % 6 + 1 as int)) end as claim_state",
        "array('marketing') as allowed_uses",
        "case scan_id % 3 when 0 then array('CANDIDATE_VERIFICATION_TRUNCATED') when 1 then array('CANDIDATE_VERIFICATION_FAILURE', 'CANDIDATE_VERIFICATION_PARTIAL') "
        "else cast(array() as array<string>) end as coverage_reason_codes",
    )
    return D.legacy_policy(s).select("scan_id", "policy_action", "policy_path", "reason_codes")


def _policy_sql(rules: dict) -> str:
    """The staged evaluation as text, for given rule values."""
    rc = str(rules.get("require_complete_coverage", True)).lower()
    rq = str(rules.get("require_corroborated_claim", True)).lower()
    bl = str(rules.get("block_enabled", False)).lower()
    ms = str(rules.get("review_on_missing_facts", True)).lower()
    eo = "origin_class in (" + ", ".join(f"'{v}'" for v in rules.get("escalate_origin", []) or ["-"]) + ")"
    es = "style_tier in (" + ", ".join(f"'{v}'" for v in rules.get("escalate_style", []) or ["-"]) + ")"
    return f"""select scan_id, '{rules['name']}' as policy, a9 as policy_action, recorded_action, mrules as matched_rules, array_to_string(list_sort(list_distinct(list_filter(string_split(concat_ws('|', baseline_reasons, own, blocking, case when u then concat_ws('|', nullif(claim_reasons, ''), nullif(license_reasons, '')) end), '|'), lambda z: z <> ''))), '|') as reason_codes,
       case when f then derived_path else baseline_path end as rights_path from (
     select *, case when {ms} and missing <> '' and a8 = 'PASS_BY_POLICY' and f then 'REVIEW' else a8 end as a9,
       concat_ws('|', case when f then 'persisted_rights_facts_are_authoritative' end, case when blocking <> '' then 'terminal_rights_state_cannot_authorize' end, case when {rc} and not c then 'require_complete_coverage_for_pass' end, case when s4 then 'require_corroborated_claim_for_pass' end, case when eo then 'escalate_on.ai_origin_classification' end,
         case when es then 'escalate_on.creator_profile_tier' end, case when rqm and origin_class is not null then 'honor_required_origin_policy_mode' end, case when s8 then 'block_enabled' end, case when {ms} and missing <> '' then 'review_on_missing_facts' end) as mrules,
       concat_ws('|', case when p then 'PERSISTED_LICENSE_PERMITS_INTENDED_USE' end, case when u then 'MATCH_WITHOUT_AUTHORIZING_PERSISTED_LICENSE' end, case when s3 then 'INCOMPLETE_COVERAGE_BLOCKS_PASS' end, case when s4 then 'MATCH_WITHOUT_CORROBORATED_CLAIM' end, case when s5 then 'AI_ORIGIN_CLASSIFICATION_ESCALATED_BY_POLICY' end, case when s6 then 'CREATOR_PROFILE_RESEMBLANCE_ESCALATED_BY_POLICY' end,
         case when s7 then 'AI_ORIGIN_RESULT_REQUIRES_PRODUCT_REVIEW|AI_ORIGIN_REVIEW_IS_NOT_INFRINGEMENT_FINDING' end, case when not rqm and origin_class is not null then case when origin_mode = 'DISABLED' then 'AI_ORIGIN_CHECK_DISABLED_BY_POLICY' else 'AI_ORIGIN_INFORMATIONAL_ONLY' end end,
         case when style_review and not f then 'STYLE_SIGNAL_NOT_AUTO_ESCALATED_WITHOUT_AI_ORIGIN_SUPPORT' end, case when s8 then 'BLOCKED_BY_TENANT_POLICY_ON_TERMINAL_RIGHTS_STATE' end) as own from (
     select *, case when s8 then 'BLOCK' else a7 end as a8 from (
     select *, {bl} and f and c and blocking <> '' as s8, case when s7 then 'REVIEW' else a6 end as a7 from (
     select *, coalesce(rqm and origin_class <> 'NO_AI_ORIGIN_EVIDENCE_DETECTED' and a6 = 'PASS_BY_POLICY', false) as s7 from (
     select *, case when s6 then 'REVIEW' else a5 end as a6 from (
     select *, es and a5 = 'PASS_BY_POLICY' as s6 from (
     select *, case when s5 then 'REVIEW' else a4 end as a5 from (
     select *, eo and a4 = 'PASS_BY_POLICY' as s5 from (
     select *, case when s4 then 'REVIEW' else a3 end as a4 from (
     select *, {rq} and f and a3 = 'PASS_BY_POLICY' and contains(missing, 'NO_CORROBORATED_CLAIM') as s4 from (
     select *, case when s3 then 'REVIEW' else a2 end as a3 from (
     select *, {rc} and not c and a2 = 'PASS_BY_POLICY' and match_status <> 'NO_MATCH_IN_CHECKED_SOURCES' as s3 from (
     select *, case when blocking <> '' and a1 = 'PASS_BY_POLICY' then 'REVIEW' else a1 end as a2 from (
     select *, case when p then 'PASS_BY_POLICY' when u then 'REVIEW' else baseline_action end as a1 from (
     select *, f and c and elig as p, f and not (c and elig) as u from (
     select b.*, match_status = 'MATCH_FOUND' as f, coverage_status = 'COMPLETE' as c, case when {rq} then strong else scope end > 0 as elig, blocking, missing, claim_reasons, license_reasons, derived_path, origin_mode = 'REQUIRED' as rqm, coalesce({eo}, false) as eo, {es} as es,
        case when match_status = 'NO_MATCH_IN_CHECKED_SOURCES' then 'PASS_BY_POLICY' else 'REVIEW' end as recorded_action from ({_BASE}) b join fx using (work_id, intended_use)
     ) q0) q1) q2) q3) q4) q5) q6) q7) q8) q9) q10) q11) q12) q13) q14) q15"""


def with_facts(t: Tables):
    # Evaluation is heavy per row: three numbers of each scan are dealt out where a scan of the table has few splits.
    s = t.scans(spread(t.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")).selectExpr(
        "*", "element_at(array('REQUIRED', 'INFORMATIONAL', 'DISABLED'), cast(scan_id % 3 + 1 as int)) as origin_mode", "style_tier in ('HIGH', 'REVIEW') as style_review"
    )
    # One row for each work and use: where they are few, no scan is sent to meet them.
    known = stored(facts(t), "facts")
    if known.count() <= FEW_FACTS:
        joined_ = D.baseline_policy(s).join(F.broadcast(known), ["work_id", "intended_use"], "left")
    else:
        key = F.concat_ws("|", "work_id", "intended_use")
        known = known.withColumn("__use", key).drop("work_id", "intended_use")
        joined_ = join_unique(D.baseline_policy(s).withColumn("__use", key), known, "__use", "scan_id").drop("__use")
    return joined_.withColumn("recorded_action", F.col("baseline_action"))


_POL = [
    {"name": "default"},
    {"name": "open", "require_complete_coverage": False, "require_corroborated_claim": False, "review_on_missing_facts": False},
    {"name": "strict", "block_enabled": True, "escalate_origin": ["AI_ORIGIN_REVIEW_CANDIDATE"], "escalate_style": ["HIGH"]},
]


@query(
    "dc12_policy_evaluation",
    f"with {_FACTS} select scan_id, policy_action, matched_rules, reason_codes, rights_path from ({_policy_sql(_POL[0])}) z",
)
def dc12(t):
    s = with_facts(t).withColumn("rules", D.rules_struct("default"))
    return D.evaluate_policy(s).select("scan_id", "policy_action", "matched_rules", "reason_codes", "rights_path")


@query(
    "jn21_policy_dry_run",
    f"with {_FACTS} select scan_id, policy, policy_action, policy_action <> recorded_action as differs, matched_rules, reason_codes from ("
    + " union all ".join(_policy_sql(p) for p in _POL) + ") z",
)
def jn21(t):
    pol = [D.rules_struct(p["name"], {k: v for k, v in p.items() if k != "name"}) for p in _POL]
    return D.policy_dry_run(with_facts(t), pol).select(
        "scan_id", F.col("rules.policy").alias("policy"), "policy_action", "differs", "matched_rules", "reason_codes"
    )


_STRONG = "coalesce(origin_class in ('LIKELY_AI_GENERATED'), false) or coalesce(origin_class = 'AI_ORIGIN_REVIEW_CANDIDATE' and style_tier = 'HIGH', false)"


@query(
    "dc13_policy_overlay",
    f"""with b as (select *, {_STRONG} as joint, origin_mode = 'REQUIRED' as rq, baseline_action = 'PASS_BY_POLICY' as ps, match_status = 'MATCH_FOUND' as f from ({_BASE}) b),
       x as (select *, rq and style_review and joint and ps as bo, rq and not (style_review and joint) and ps and coalesce(origin_class <> 'NO_AI_ORIGIN_EVIDENCE_DETECTED', false) as oo from b)
       select scan_id, case when bo or oo then 'REVIEW' else baseline_action end as overlaid_action, concat_ws('|', case when not rq and origin_class is not null then case when origin_mode = 'DISABLED' then 'AI_ORIGIN_CHECK_DISABLED_BY_POLICY' else 'AI_ORIGIN_INFORMATIONAL_ONLY' end end,
         case when bo then 'AI_ORIGIN_AND_STYLE_RESEMBLANCE_REVIEW_RECOMMENDED|STYLE_REVIEW_IS_NOT_COPY_OR_INFRINGEMENT_FINDING' end, case when oo then 'AI_ORIGIN_RESULT_REQUIRES_PRODUCT_REVIEW|AI_ORIGIN_REVIEW_IS_NOT_INFRINGEMENT_FINDING' end,
         case when style_review and not f and (not rq or (not bo and not oo and not joint)) then 'STYLE_SIGNAL_NOT_AUTO_ESCALATED_WITHOUT_AI_ORIGIN_SUPPORT' end) as added_reasons from x""",
)
def dc13(t):
    s = with_scan_context(t)
    return D.overlay_policy(s).select("scan_id", "overlaid_action", "added_reasons")


def with_scan_context(t: Tables):
    s = t.scans().selectExpr(
        "*", "element_at(array('REQUIRED', 'INFORMATIONAL', 'DISABLED'), cast(scan_id % 3 + 1 as int)) as origin_mode", "style_tier in ('HIGH', 'REVIEW') as style_review",
        "coalesce(origin_class in ('LIKELY_AI_GENERATED', 'AI_ORIGIN_REVIEW_CANDIDATE'), false) as origin_review",
    )
    return D.baseline_policy(s).withColumn("action", F.col("baseline_action"))


_AI = "coalesce(origin_class = 'LIKELY_AI_GENERATED', false)"
_REV = "coalesce(origin_class in ('LIKELY_AI_GENERATED', 'AI_ORIGIN_REVIEW_CANDIDATE'), false)"
_JR = f"""select *, case when match_status = 'SCOPE_INCOMPLETE' then 'SOURCE_SCOPE_INCOMPLETE' when f and ai then 'AI_ASSISTED_COPY_EVIDENCE' when f and rev then 'COPY_EVIDENCE_ORIGIN_REVIEW' when ai and st then 'AI_STYLE_RESEMBLANCE_REVIEW' when ai then 'AI_INDICATORS_WITHOUT_RIGHTS_MATCH'
   when f then 'COPY_EVIDENCE_ORIGIN_UNRESOLVED' when rev and st then 'ORIGIN_AND_STYLE_REVIEW' when rev then 'AI_ORIGIN_REVIEW_WITHOUT_RIGHTS_MATCH' when st then 'STYLE_RESEMBLANCE_ORIGIN_UNRESOLVED' when origin_class = 'NO_AI_ORIGIN_EVIDENCE_DETECTED' then 'NO_STRONG_AI_SIGNAL_OR_RIGHTS_MATCH' else 'ORIGIN_UNKNOWN_WITHOUT_RIGHTS_MATCH' end as risk_class
   from (select *, match_status = 'MATCH_FOUND' as f, {_AI} as ai, {_REV} as rev, style_tier = 'HIGH' as st from ({_BASE}) b) q"""
_JACT = "case risk_class when 'SOURCE_SCOPE_INCOMPLETE' then 'REVIEW_SCOPE' when 'AI_ASSISTED_COPY_EVIDENCE' then 'REVIEW_RIGHTS_AND_ORIGIN' when 'COPY_EVIDENCE_ORIGIN_REVIEW' then 'REVIEW_RIGHTS_AND_ORIGIN' when 'AI_STYLE_RESEMBLANCE_REVIEW' then 'REVIEW_STYLE_AND_ORIGIN' when 'AI_INDICATORS_WITHOUT_RIGHTS_MATCH' then 'REVIEW_ORIGIN' when 'COPY_EVIDENCE_ORIGIN_UNRESOLVED' then 'REVIEW_COPY_RIGHTS' when 'ORIGIN_AND_STYLE_REVIEW' then 'REVIEW_STYLE_AND_ORIGIN' when 'STYLE_RESEMBLANCE_ORIGIN_UNRESOLVED' then 'REVIEW_STYLE' when 'NO_STRONG_AI_SIGNAL_OR_RIGHTS_MATCH' then 'RECORD_AND_CONTINUE' else 'REVIEW_ORIGIN' end"


@query(
    "dc14_joint_risk",
    f"select scan_id, risk_class, case when baseline_action = 'PASS_BY_POLICY' then 'RECORD_AND_CONTINUE' else {_JACT} end as case_action from ({_JR}) j",
)
def dc14(t):
    return D.joint_risk(with_scan_context(t)).select("scan_id", "risk_class", "case_action")


_ACT = "case when scan_id % 17 = 0 then 'BLOCK' when match_status = 'NO_MATCH_IN_CHECKED_SOURCES' or scan_id % 4 = 0 then 'PASS_BY_POLICY' else 'REVIEW' end"


@query(
    "dc15_review_cases",
    f"""select scan_id, case when a in ('REVIEW', 'BLOCK') then 'POLICY_' || a else 'MATCH_' || match_status end as opened_reason, case when a = 'BLOCK' then 'HIGH' else 'NORMAL' end as priority from (select *, {_ACT} as a from V_SCAN) s
        where (a in ('REVIEW', 'BLOCK') or match_status in ('SCOPE_INCOMPLETE', 'ERROR')) and scan_id % 6 <> 1""",
)
def dc15(t):
    s = t.scans().withColumn("policy_action", F.expr(_ACT))
    return D.review_cases(s, t.scans().where("scan_id % 6 = 1")).select("scan_id", "opened_reason", "priority")


@query(
    "dc16_policy_trace",
    f"""select scan_id, sha256(concat('{{"baseline_action":"', baseline_action, '","coverage_status":"', coverage_status, '","match_status":"', match_status, '","origin_class":', coalesce('"' || origin_class || '"', 'null'), ',"policy_version":"v1","scan_id":', scan_id, '}}')) as trace_digest,
        scan_id % 10 <> 3 as trace_ok from ({_BASE}) b""",
)
def dc16(t):
    material = ["scan_id", "match_status", "coverage_status", "origin_class", "baseline_action", "policy_version"]
    s = D.policy_trace(with_scan_context(t).withColumn("policy_version", F.lit("v1")), material)
    # Some stored decisions were altered after their trace was written.
    altered = s.withColumn(
        "baseline_action", F.when(F.col("scan_id") % 10 == 3, "BLOCK").otherwise(F.col("baseline_action"))
    )
    return D.verify_trace(altered, material).select("scan_id", "trace_digest", "trace_ok")


@query(
    "dc17_findings",
    """select scan_id, match_status, coverage_status, coverage_status = 'COMPLETE' as complete, case when match_status = 'MATCH_FOUND' then work_id end as top_match_work_id, origin_class as origin_classification, style_tier as profile_tier, style_tier = 'HIGH' as profile_review, true as profile_advisory_only from V_SCAN""",
)
def dc17(t):
    return findings(t.scans()).select(
        "scan_id", F.col("findings.copy.match_status").alias("match_status"), F.col("scope.coverage_status").alias("coverage_status"), F.col("scope.complete").alias("complete"),
        F.col("findings.copy.top_match_work_id").alias("top_match_work_id"), F.col("findings.origin.classification").alias("origin_classification"),
        F.col("findings.profile.tier").alias("profile_tier"), F.col("findings.profile.review").alias("profile_review"), F.col("findings.profile.advisory_only").alias("profile_advisory_only"),
    )


def findings(scans):
    """Scope and per-lane findings sections of a statement, the lanes kept apart."""
    c = F.col
    return scans.select(
        "scan_id",
        F.struct("coverage_status", (c("coverage_status") == "COMPLETE").alias("complete")).alias("scope"),
        F.struct(
            F.struct("match_status", F.when(c("match_status") == "MATCH_FOUND", c("work_id")).alias("top_match_work_id")).alias("copy"),
            F.struct(c("origin_class").alias("classification")).alias("origin"),
            F.struct(c("style_tier").alias("tier"), (c("style_tier") == "HIGH").alias("review"), F.lit(True).alias("advisory_only")).alias("profile"),
        ).alias("findings"),
    )


_DONE = """select scan_id, tenant_id, concat('c', scan_id % 4) as catalog_id, intended_use, match_status, case when match_status = 'NO_MATCH_IN_CHECKED_SOURCES' then 'PASS_BY_POLICY' else 'REVIEW' end as policy_action,
    case when match_status = 'MATCH_FOUND' then 'EXISTING_LICENSE' end as rights_path, case when scan_id % 9 = 0 then null when scan_id % 9 < 4 then {arr}('A', 'B'){end} else {arr}('A'){end} end as reason_codes, case when scan_id % 14 <> 0 then coverage_status end as coverage_status,
    case when scan_id % 3 = 0 then 'CONFIRMED' else 'PENDING' end as anchor_status, case when scan_id % 6 <> 0 then 'local-log' end as proof_provider, case when scan_id % 6 <> 0 then {sha} end as packet_hash,
    case when scan_id % 8 <> 0 then scan_id * 10 end as statement_id, case when scan_id % 8 <> 0 then {sha2} end as statement_digest, case when match_status = 'INCONCLUSIVE' then scan_id * 100 end as review_case_id,
    case when scan_id % 10 <> 0 then created_at end as completed_at from {src}"""
_DONE_SQL = (
    _DONE.replace("{arr}('A', 'B'){end}", "['A', 'B']").replace("{arr}('A'){end}", "['A']").replace("{sha2}", "sha256(concat('s', scan_id))").replace("{sha}", "sha256(concat('p', scan_id))").replace("{src}", "V_SCAN")
)


@query(
    "dc18_completed_payload",
    f"""select scan_id, cast(to_json(struct_pack(schema := 'evidlake.scan_completed.v1', scan_id := scan_id, tenant_id := tenant_id, catalog_id := catalog_id, intended_use := intended_use, match_status := match_status, policy_action := policy_action, rights_path := rights_path,
         reason_codes := coalesce(reason_codes, []), coverage_status := coverage_status, coverage_complete := coalesce(coverage_status = 'COMPLETE', false), anchor_status := anchor_status, proof_provider := proof_provider, packet_hash_sha256 := packet_hash,
         statement_id := statement_id, statement_digest_sha256 := statement_digest, review_case_id := review_case_id, completed_at := strftime(completed_at, '%Y-%m-%dT%H:%M:%SZ'), notice := '{D.NOTICE}')) as varchar) as payload from ({_DONE_SQL}) d""",
)
def dc18(t):
    scans = t.scans()
    named = _DONE.replace("{arr}", "array").replace("{end}", "").replace("{sha2}", "sha2(concat('s', scan_id), 256)").replace("{sha}", "sha2(concat('p', scan_id), 256)")
    columns = named.removeprefix("select ").removesuffix(" from {src}")
    return D.completed_payload(t.spark.sql(f"select {columns} from {{scans}}", scans=scans))


def lanes(t: Tables):
    s = t.scans().selectExpr(
        "*", "scan_id % 21 = 0 as exact", "scan_id % 13 = 0 as review_supported", "scan_id % 19 = 0 as match_supported", "style_tier = 'REVIEW' as style_review",
        "case work_id % 3 when 0 then 'EXISTING_LICENSE' when 1 then 'DISPUTED' end as rights_path",
    )
    return D.lane_status(s.withColumn("origin_state", F.when(F.col("origin_class").isNotNull(), origin_state(F.col("origin_class")))))


_LANES = f"""select *, case when match_status in ('SCOPE_INCOMPLETE', 'ERROR') then 'unchecked' when scan_id % 21 = 0 or scan_id % 19 = 0 or match_status = 'MATCH_FOUND' then 'hit' when scan_id % 13 = 0 or match_status = 'INCONCLUSIVE' then 'review' when coverage_status <> 'COMPLETE' then 'unchecked' else 'clear' end as copy_lane,
   case when os is null or os in ('ORIGIN_UNKNOWN', 'CHECK_UNAVAILABLE') then 'unchecked' when os in ('AI_CONFIRMED', 'AI_INDICATORS_FOUND') then 'hit' when os = 'AI_INDICATORS_NEED_REVIEW' then 'review' else 'clear' end as origin_lane,
   case when style_tier in ('HIGH', 'REVIEW') then 'advisory' else 'clear' end as profile_lane, case when work_id % 3 = 0 then 'clear' else 'advisory' end as rights_lane from (select *, case when origin_class is not null then {_STATES.format('origin_class')} end as os from V_SCAN) s"""


@query("prj15_lane_status", f"select scan_id, copy_lane, origin_lane, profile_lane, rights_lane from ({_LANES}) l")
def prj15(t):
    return lanes(t).select("scan_id", "copy_lane", "origin_lane", "profile_lane", "rights_lane")


@query(
    "prj16_lane_metrics",
    f"""select scan_id, case when copy_lane = 'unchecked' or v is null then null else v end as copy_value, case when profile_lane in ('clear', 'advisory') and p is not null and u then null else p end as profile_value,
        case when p is not null and u then 'uncalibrated for this catalog' end as profile_withheld from (select *, case when scan_id % 21 = 0 then 1e0 when scan_id % 9 = 0 then null else (scan_id % 100) / 100e0 end as v, case when scan_id % 8 = 0 then null else (scan_id % 50) / 50e0 end as p, scan_id % 2 = 0 as u from ({_LANES}) l) q""",
)
def prj16(t):
    s = lanes(t)
    v = F.expr("case when exact then 1D when scan_id % 9 = 0 then null else (scan_id % 100) / 100D end")
    p = F.expr("case when scan_id % 8 = 0 then null else (scan_id % 50) / 50D end")
    cv, _ = D.lane_metric(v, F.col("copy_lane"), F.lit(False))
    pv, note = D.lane_metric(p, F.col("profile_lane"), F.col("scan_id") % 2 == 0)
    return s.select("scan_id", cv.alias("copy_value"), pv.alias("profile_value"), note.alias("profile_withheld"))


@query(
    "prj19_findings_line",
    f"""select scan_id, case when l <> '' then upper(l[1]) || substr(l, 2) end as findings from (select scan_id, concat_ws('; ', case copy_lane when 'hit' then 'stored-work copy found evidence' when 'review' then 'stored-work copy needs review' end, case origin_lane when 'hit' then 'AI origin found evidence' when 'review' then 'AI origin needs review' end) as l from ({_LANES}) q) z""",
)
def prj19(t):
    return lanes(t).select("scan_id", D.findings_line().alias("findings"))


# A sequential fold over the sorted history: STATE:version:end.
_FOLD = "list_reduce({0}, lambda acc, x: case when split_part(acc, ':', 1) in ('SUPERSEDED', 'REVOKED') or split_part(acc, ':', 1) = split_part(x, ':', 1) then acc else concat(split_part(x, ':', 1), ':', split_part(acc, ':', 2)::bigint + 1, ':', split_part(x, ':', 2)) end, 'ASSERTED:1:')"
_HIST = "select subject_id, rights_event_id, event_type, created_at, list(concat(event_type, ':', epoch_us(created_at))) over (partition by subject_id order by created_at, rights_event_id rows unbounded preceding) as hist from V_RIGHTS"


@query(
    "lg6_rights_replay",
    f"""with h as ({_HIST}), f as (select *, {_FOLD.format('hist')} as a, {_FOLD.format('hist[1:len(hist) - 1]')} as b from h)
        select subject_id, rights_event_id, event_type, case when split_part(b, ':', 1) in ('SUPERSEDED', 'REVOKED') then 'TERMINAL' else split_part(b, ':', 1) end as state_before, a <> b as legal, split_part(a, ':', 2)::bigint as version,
          case when a <> b and event_type in ('SUPERSEDED', 'REVOKED') then epoch_us(created_at) end as effective_until_us from f""",
)
def lg6(t):
    out = R.replay_rights(t.rights_events()).drop("created_at")
    return out.withColumn("effective_until_us", F.unix_micros("effective_until")).drop("effective_until")


@query(
    "lg6_current_rights",
    f"""with h as ({_HIST}), m as (select subject_id, arg_max(hist, len(hist)) as hist from h group by 1), f as (select subject_id, len(hist) as n, {_FOLD.format('hist')} as a from m)
        select subject_id, split_part(a, ':', 1) as state, split_part(a, ':', 2)::bigint as version, case when split_part(a, ':', 1) in ('SUPERSEDED', 'REVOKED') then split_part(a, ':', 3)::bigint end as effective_until_us, n - split_part(a, ':', 2)::bigint + 1 as rejected from f""",
)
def lg6b(t):
    out = R.current_rights(R.replay_rights(t.rights_events()))
    return out.withColumn("effective_until_us", F.unix_micros("effective_until")).drop("effective_until")


@query(
    "lg9_supersession",
    """with r as (select l_orderkey * 10 + l_linenumber as id, l_orderkey as tenant_id, l_orderkey % 500 as work_id, max(case when l_linenumber % 4 = 2 then 1 else 0 end) as sup, max(l_linenumber) as ln from lineitem group by all),
       x as (select id, tenant_id, work_id, case when sup = 1 then 'SUPERSEDED' else 'ASSERTED' end as state, case when id % 40 = 2 then id when sup = 1 and id % 60 <> 6 then id + 1 when id % 50 = 1 then id + 3 end as tgt from r)
       select x.id, x.state, x.tgt as superseded_by_id, case when x.state = 'SUPERSEDED' and x.tgt is null then 'SUPERSEDED_WITHOUT_TARGET' when x.state <> 'SUPERSEDED' and x.tgt is not null then 'TARGET_WITHOUT_SUPERSEDED' when x.tgt = x.id then 'SUPERSEDES_ITSELF' when x.tgt is not null and y.id is null then 'TARGET_MISSING'
         when x.tgt is not null and (y.tenant_id <> x.tenant_id or y.work_id <> x.work_id) then 'TARGET_OF_OTHER_TENANT_OR_WORK' else 'OK' end as verdict from x left join x y on y.id = x.tgt""",
)
def lg9(t):
    rows = t.raw("lineitem").selectExpr("l_orderkey * 10 + l_linenumber as id", "l_orderkey as tenant_id", "l_orderkey % 500 as work_id", "l_linenumber % 4 = 2 as sup").distinct()
    rows = rows.selectExpr(
        "id", "tenant_id", "work_id", "if(sup, 'SUPERSEDED', 'ASSERTED') as state",
        "case when id % 40 = 2 then id when sup and id % 60 <> 6 then id + 1 when id % 50 = 1 then id + 3 end as superseded_by_id",
    )
    return R.supersession(rows).select("id", "state", "superseded_by_id", "verdict")


# Chains of conversation turns: most records are replaced by the next; some links are to nowhere, to others' or in a circle.
_CHAIN = """c as (select conv_id * 1000 + turn as id, conv_id as tenant_id, conv_id % 500 as work_id, lead(conv_id * 1000 + turn) over (partition by conv_id order by turn) as nxt, first_value(conv_id * 1000 + turn) over (partition by conv_id order by turn) as head from conversations where conv_id is not null and turn is not null),
  x as (select id, tenant_id, work_id, case when nxt is not null and not (tenant_id % 11 = 3 and id % 5 = 1) then nxt when nxt is null and tenant_id % 7 = 2 and head <> id then head when nxt is null and tenant_id % 13 = 5 then id + 500 end as tgt from c),
  a as (select x.id, x.tgt, y.id is not null as found from x left join x y on y.id = x.tgt)"""


@query(
    "lg9_current_record",
    f"""with recursive {_CHAIN}, w as (select id as start, id, 0 as steps, [id] as path, 'GO' as kind from a union all
        select w.start, a.tgt, w.steps + 1, list_append(w.path, a.tgt), case when list_contains(w.path, a.tgt) then 'CYCLE' when not a.found then 'BROKEN' else 'GO' end from w join a on a.id = w.id where w.kind = 'GO' and a.tgt is not null),
      e as (select start, arg_max(id, steps) as final, arg_max(kind, steps) as kind, max(steps) as steps from w group by 1)
      select start as id, case when kind = 'GO' then final end as current_id, case when kind <> 'GO' then kind when steps = 0 then 'CURRENT' else 'RESOLVED' end as resolution, case when kind = 'GO' then steps end as steps from e""",
)
def lg9_current(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    chain = t.raw("conversations").where("conv_id is not null and turn is not null").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("tenant_id"), (F.col("conv_id") % 500).alias("work_id"),
        F.lead(F.col("conv_id") * 1000 + F.col("turn")).over(w).alias("nxt"), F.first(F.col("conv_id") * 1000 + F.col("turn")).over(w).alias("head"),
    )
    rows = chain.selectExpr(
        "id", "tenant_id", "work_id",
        "case when nxt is not null and not (tenant_id % 11 = 3 and id % 5 = 1) then nxt when nxt is null and tenant_id % 7 = 2 and head <> id then head "
        "when nxt is null and tenant_id % 13 = 5 then id + 500 end as superseded_by_id",
    ).selectExpr("*", "if(superseded_by_id is null, 'ASSERTED', 'SUPERSEDED') as state")
    return R.current_records(rows)
