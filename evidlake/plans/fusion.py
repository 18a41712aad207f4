"""Copy, style and origin fusion, multi-view detectors, and support geometry."""

from pyspark.sql import functions as F

from evidlake.functions import expr as X
from evidlake.functions.expr import hash32, joined, r6
from evidlake.operators import coverage as C
from evidlake.operators import fusion as U
from evidlake.operators import geometry as G
from evidlake.operators import similarity as S
from evidlake.operators import text as T
from evidlake.plans.registry import query
from evidlake.plans.retrieval import PAIR_SQL, pairs
from evidlake.plans.views import h32
from evidlake.sources.tables import Tables


def draw(*parts: str):
    """A repeatable number in [0, 1) with three digits."""
    return (hash32(F.concat_ws("-", *[F.col(p) if p.islower() else F.lit(p) for p in parts])) % 1000) / 1e3


def dsql(*parts: str) -> str:
    shown = ", ".join(p if p.islower() else f"'{p}'" for p in parts)
    return f"(({h32(f'concat_ws(chr(45), {shown})')} % 1000) / 1e3)"


# -- detectors -----------------------------------------------------------------------------------
@query(
    "ag27_detector_aggregate",
    """select asset_id, provider_no, family, calibrated, round(agg, 6) as aggregate_score, round(o, 6) as original_score, round(dc, 6) as delivery_score, round(td, 6) as transformed_score,
       round(sm, 6) as spatial_score, sup as spatial_support, spatial_corroborated, round(sd, 6) as view_std, round(st, 6) as stability from V_MEMBER""",
)
def ag27(t):
    return U.detector_aggregate(t.detector_views())


def members(t: Tables):
    return U.detector_aggregate(t.detector_views()).withColumn("verified", F.expr("provider_no < 2 or asset_id % 3 = 0"))


@query(
    "ag28_family_rows",
    "select asset_id, family, score, round(rel, 10) as reliability, calibrated, verified, round(stability, 8) as stability, members from V_FAMILY",
)
def ag28a(t):
    # Means of six-decimal values are shown with the digits they have, so no tie is rounded.
    f = U.family_rows(members(t))
    return f.withColumn("reliability", F.round("reliability", 10)).withColumn("stability", F.round("stability", 8))


@query(
    "ag28_family_fusion",
    """select asset_id, round(fused, 6) as fused_score, round(disagreement, 8) as disagreement, round(stability, 6) as stability, round(min_stability, 8) as min_stability, members, observed as observed_families, families, cal as calibrated_families,
       obs_pos as observed_positive, pos as positive, strong, cal_strong as calibrated_strong, cal_pos as calibrated_positive, ver_pos as verified_positive from V_FUSED""",
)
def ag28(t):
    f = U.fuse_families(U.family_rows(members(t)))
    for c, digits in (("fused_score", 6), ("disagreement", 8), ("stability", 6), ("min_stability", 8)):
        f = f.withColumn(c, F.round(c, digits))
    return f


@query(
    "ag29_geo_consensus",
    """select asset_id, provider_no, round(exp((ln(greatest(1e-6, least(a, 1e0))) + case when provider_no = 1 then 0 else ln(greatest(1e-6, least(b, 1e0))) end) / case when provider_no = 1 then 1 else 2 end), 6) as consensus
       from (select asset_id, provider_no, max(score) filter (where view_no = 0) as a, max(score) filter (where view_no = 7) as b from V_DET group by all) t""",
)
def ag29(t):
    v = t.detector_views().groupBy("asset_id", "provider_no").agg(
        F.max(F.when(F.col("view_no") == 0, F.col("score"))).alias("a"),
        F.max(F.when((F.col("view_no") == 7) & (F.col("provider_no") != 1), F.col("score"))).alias("b"),
    )
    return v.select("asset_id", "provider_no", r6(U.geo_consensus(F.col("a"), F.col("b"))).alias("consensus"))


def assets(t: Tables):
    f = U.fuse_families(U.family_rows(members(t)))
    return f.selectExpr(
        "*", "asset_id % 29 = 0 as trusted", "asset_id % 31 = 0 as untrusted", "asset_id % 9 = 0 as marker_supported",
        "0.6D + (asset_id % 40) / 100D as marker_strength", "(asset_id % 10) / 10D as marker_confidence", "asset_id % 13 = 0 as low_quality",
    )


_ASSET = "select *, asset_id % 29 = 0 as trusted, asset_id % 31 = 0 as untrusted, asset_id % 9 = 0 as marker, 0.6e0 + (asset_id % 40) / 100e0 as ms, (asset_id % 10) / 10e0 as mc, asset_id % 13 = 0 as lowq, coalesce(min_stability < 0.35, false) as unstable from V_FUSED"
_ORIGIN = f"""select *, case when trusted then 'AI_PROVENANCE_CONFIRMED' when untrusted then 'AI_PROVENANCE_ASSERTED_UNTRUSTED_SIGNER' when marker and cal_pos >= 1 and not unstable then 'AI_INDICATORS_CORROBORATED'
   when marker then 'AI_ORIGIN_MARKER_FOUND' when members = 0 then 'SYNTHETIC_ORIGIN_ANALYSIS_UNAVAILABLE' when lowq then 'INCONCLUSIVE_LOW_RESOLUTION' when disagreement >= 0.22 then 'INCONCLUSIVE_DETECTOR_DISAGREEMENT'
   when fused >= 0.78 and cal_strong >= 2 and cal = families and not unstable then 'LIKELY_AI_GENERATED' when obs_pos >= 1 or fused >= 0.58 then 'AI_ORIGIN_REVIEW_CANDIDATE'
   when unstable then 'INCONCLUSIVE_TRANSFORM_INSTABILITY' when families >= 2 and cal = families and ver_pos = 0 then 'NO_AI_ORIGIN_EVIDENCE_DETECTED' else 'AI_ORIGIN_INCONCLUSIVE_LIMITED_COVERAGE' end as classification from ({_ASSET}) a"""


@query(
    "dc4_origin_classification",
    f"""select asset_id, classification, case when classification = 'AI_PROVENANCE_CONFIRMED' then 'PROVENANCE' when classification in ('AI_PROVENANCE_ASSERTED_UNTRUSTED_SIGNER', 'AI_ORIGIN_MARKER_FOUND', 'AI_ORIGIN_REVIEW_CANDIDATE') then 'REVIEW'
        when classification in ('AI_INDICATORS_CORROBORATED', 'LIKELY_AI_GENERATED') then 'HIGH' when classification = 'SYNTHETIC_ORIGIN_ANALYSIS_UNAVAILABLE' then 'UNAVAILABLE' when classification = 'NO_AI_ORIGIN_EVIDENCE_DETECTED' then 'LOW' else 'INCONCLUSIVE' end as evidence_tier,
      classification not in ('NO_AI_ORIGIN_EVIDENCE_DETECTED', 'SYNTHETIC_ORIGIN_ANALYSIS_UNAVAILABLE') as review_recommended,
      concat_ws('|', case classification when 'AI_PROVENANCE_CONFIRMED' then 'TRUSTED_C2PA_AI_ASSERTION|AI_ORIGIN_IDENTIFIED_BY_PROVENANCE' when 'AI_PROVENANCE_ASSERTED_UNTRUSTED_SIGNER' then 'C2PA_AI_ASSERTION_PRESENT|C2PA_SIGNER_TRUST_NOT_CONFIRMED'
          when 'AI_INDICATORS_CORROBORATED' then 'VISIBLE_AI_MARKER_AND_MODEL_SIGNAL_AGREE|VISIBLE_MARKER_REQUIRES_REVIEW_NOT_PROVENANCE' when 'AI_ORIGIN_MARKER_FOUND' then 'VISIBLE_AI_MARKER_FOUND|VISIBLE_MARKER_REQUIRES_REVIEW_NOT_PROVENANCE'
          when 'SYNTHETIC_ORIGIN_ANALYSIS_UNAVAILABLE' then 'NO_SYNTHETIC_DETECTOR_ACTIVE' when 'INCONCLUSIVE_LOW_RESOLUTION' then 'IMAGE_TOO_SMALL_FOR_CONFIGURED_OPERATING_DOMAIN|ABSTAINED' when 'INCONCLUSIVE_DETECTOR_DISAGREEMENT' then 'DETECTOR_ENSEMBLE_DISAGREEMENT|ABSTAINED'
          when 'LIKELY_AI_GENERATED' then 'SYNTHETIC_DETECTOR_SUPPORT|TRANSFORM_CONSISTENT_SUPPORT' when 'AI_ORIGIN_REVIEW_CANDIDATE' then 'SYNTHETIC_DETECTOR_REVIEW_RANGE' when 'INCONCLUSIVE_TRANSFORM_INSTABILITY' then 'DETECTOR_UNSTABLE_ACROSS_COMMON_TRANSFORMS|ABSTAINED'
          when 'NO_AI_ORIGIN_EVIDENCE_DETECTED' then 'DETECTORS_DID_NOT_FIND_AI_ORIGIN_EVIDENCE|NOT_PROOF_OF_HUMAN_ORIGIN' else 'LOW_MODEL_RESPONSE_WITHOUT_NEGATIVE_CLEARANCE_SUPPORT|ABSTAINED|NOT_PROOF_OF_HUMAN_ORIGIN' end,
        case when classification = 'AI_ORIGIN_REVIEW_CANDIDATE' and unstable then 'TRANSFORM_SENSITIVE_SIGNAL_RETAINS_REVIEW_ONLY' end, case when classification = 'AI_ORIGIN_REVIEW_CANDIDATE' and families < 2 then 'INDEPENDENT_EVIDENCE_FAMILY_CORROBORATION_REQUIRED' end,
        case when classification = 'AI_ORIGIN_REVIEW_CANDIDATE' and cal < families then 'DEPLOYMENT_CALIBRATION_INCOMPLETE' end, case when members = 1 then 'SINGLE_DETECTOR_LIMITATION' end, case when families = 1 then 'SINGLE_EVIDENCE_FAMILY_LIMITATION' end,
        case when observed > families then 'UNVERIFIED_EVIDENCE_FAMILY_DECLARATIONS_EXCLUDED' end) as reason_codes from ({_ORIGIN}) o""",
)
def dc4(t):
    return U.classify_origin(assets(t)).select("asset_id", "classification", "evidence_tier", "review_recommended", "reason_codes")


@query(
    "dc5_origin_scorecard",
    f"""with s as (select *, (case when fused >= 0.58 then 1 else 0 end + case when marker then 1 else 0 end + case when trusted or untrusted then 1 else 0 end) as src,
          greatest(round_even(100 * fused, 0), case when marker then round_even(100 * least(greatest(ms, 0), 1), 0) else 0 end, case when trusted then 100e0 when untrusted then 82e0 else 0 end) as sig,
          greatest(round_even(100 * (0.35e0 * least(families / 2e0, 1) + 0.35e0 * coalesce(cal / nullif(families, 0)::double, 0) + 0.30e0 * coalesce(least(greatest(stability, 0), 1), 0)), 0),
            case when marker then least(55e0, round_even(35 + 20 * mc, 0)) else 0 end, case when trusted then 100e0 when untrusted then 55e0 else 0 end) as q from ({_ASSET}) a),
       z as (select asset_id, least(100, sig + case when src >= 2 then 5 else 0 end)::bigint as signal_score, least(100, q + case when src >= 2 then 6 else 0 end)::bigint as quality_score from s)
       select *, case when signal_score >= 80 then 'Strong AI signal' when signal_score >= 58 then 'AI signal found' when signal_score >= 35 then 'Weak AI signal' else 'Little AI signal found' end as signal_label,
         case when quality_score >= 80 then 'High' when quality_score >= 50 then 'Medium' else 'Low' end as quality_label from z""",
)
def dc5(t):
    return U.origin_scorecard(assets(t)).select("asset_id", "signal_score", "quality_score", "signal_label", "quality_label")


_STATES = "case when {0} = 'AI_PROVENANCE_CONFIRMED' then 'AI_CONFIRMED' when {0} in ('LIKELY_AI_GENERATED', 'AI_INDICATORS_CORROBORATED') then 'AI_INDICATORS_FOUND' when {0} in ('AI_ORIGIN_MARKER_FOUND', 'AI_ORIGIN_REVIEW_CANDIDATE', 'AI_PROVENANCE_ASSERTED_UNTRUSTED_SIGNER') then 'AI_INDICATORS_NEED_REVIEW' when {0} = 'NO_AI_ORIGIN_EVIDENCE_DETECTED' then 'NO_STRONG_AI_SIGNAL' when {0} = 'SYNTHETIC_ORIGIN_ANALYSIS_UNAVAILABLE' then 'CHECK_UNAVAILABLE' else 'ORIGIN_UNKNOWN' end"


@query("dc6_origin_state", f"select asset_id, {_STATES.format('classification')} as state from ({_ORIGIN}) o")
def dc6(t):
    return U.classify_origin(assets(t)).select("asset_id", U.origin_state(F.col("classification")).alias("state"))


@query(
    "dc7_forensic_indicators",
    """select d.asset_id, d.provider_no, d.view_no, d.scope, round(d.score, 6) as score, case when d.scope = 'SPATIAL_CROP' then d.score >= 0.58 end as is_hotspot,
       case when d.scope <> 'SPATIAL_CROP' then round(least(greatest(d.score / greatest(round(m.o, 6), 1e-6), 0), 1), 6) end as retention_ratio,
       case when d.scope <> 'SPATIAL_CROP' then case when d.score / greatest(round(m.o, 6), 1e-6) >= 0.85 then 'SURVIVED' when d.score / greatest(round(m.o, 6), 1e-6) >= 0.5 then 'MODERATE' else 'DEGRADED' end end as retention_state
       from V_DET d join V_MEMBER m using (asset_id, provider_no) where d.view_no > 0""",
)
def dc7(t):
    return U.forensic_indicators(t.detector_views(), U.detector_aggregate(t.detector_views()))


@query(
    "fn13_resilience",
    """select asset_id, provider_no, count(*) filter (where r >= 0.85) as survived, count(*) filter (where r >= 0.5 and r < 0.85) as moderate, count(*) filter (where r < 0.5) as degraded
       from (select d.asset_id, d.provider_no, d.score / greatest(m.o, 1e-6) as r from V_DET d join V_MEMBER m using (asset_id, provider_no) where d.scope = 'DELIVERY_TRANSFORM' and d.view_no > 0) t group by all""",
)
def fn13(t):
    v = t.detector_views()
    o = v.where("view_no = 0").selectExpr("asset_id", "provider_no", "score as o")
    s = U.retention_state(U.retention_ratio(F.col("score"), F.col("o")))
    n = lambda x: F.count_if(F.col("s") == x)
    return (
        v.where("scope = 'DELIVERY_TRANSFORM' and view_no > 0").join(o, ["asset_id", "provider_no"]).withColumn("s", s)
        .groupBy("asset_id", "provider_no")
        .agg(n("SURVIVED").alias("survived"), n("MODERATE").alias("moderate"), n("DEGRADED").alias("degraded"))
    )


@query(
    "tk6_ranked_cues",
    """select asset_id, string_agg(concat('g', view_no % 4, '=', (round(s, 6) * 1000000)::bigint), ';' order by s desc, concat('g', view_no % 4)) as cues from (
         select asset_id, view_no % 4 as view_no, max(floor(score * 10) / 10) as s from V_DET group by 1, 2) t group by asset_id""",
)
def tk6(t):
    n = {i: F.max(F.when(F.col("view_no") % 4 == i, F.floor(F.col("score") * 10) / 10)).alias(f"g{i}") for i in range(4)}
    wide = t.detector_views().groupBy("asset_id").agg(*n.values())
    m = F.create_map(*[x for i in range(4) for x in (F.lit(f"g{i}"), F.col(f"g{i}"))])
    shown = F.array_join(
        F.transform(U.ranked_cues(m), lambda e: F.concat_ws("=", e["name"], F.round(e["score"] * 1000000).cast("bigint").cast("string"))), ";"
    )
    return wide.select("asset_id", shown.alias("cues"))


@query(
    "prj18_origin_gate",
    """select asset_id, mode, case when mode = 'OFF' then false else true end as checked, case when mode = 'OFF' then true when mode = 'FLAG_ONLY' then true else not refuse end as allowed, case when mode = 'OFF' then null when st = 'AI_CONFIRMED' then 'DECLARED_AI' when refuse then 'SCORE_ABOVE_THRESHOLD' end as refusal
       from (select *, st = 'AI_CONFIRMED' or (st in ('AI_INDICATORS_FOUND', 'AI_INDICATORS_NEED_REVIEW') and s is not null and s > 0.7) as refuse from (
         select asset_id, ['OFF', 'FLAG_ONLY', 'BLOCK'][asset_id % 3 + 1] as mode, case when asset_id % 11 = 0 then 'AI_CONFIRMED' when score >= 0.6 then 'AI_INDICATORS_FOUND' when score >= 0.4 then 'AI_INDICATORS_NEED_REVIEW' else 'NO_STRONG_AI_SIGNAL' end as st,
           case when asset_id % 8 = 0 then null else score end as s from V_SCORE) a) b""",
)
def prj18(t):
    rows = t.scores().selectExpr(
        "asset_id", "element_at(array('OFF', 'FLAG_ONLY', 'BLOCK'), cast(asset_id % 3 + 1 as int)) as mode",
        "case when asset_id % 11 = 0 then 'AI_CONFIRMED' when score >= 0.6 then 'AI_INDICATORS_FOUND' when score >= 0.4 then 'AI_INDICATORS_NEED_REVIEW' else 'NO_STRONG_AI_SIGNAL' end as state",
        "if(asset_id % 8 = 0, null, score) as score",
    )
    return origin_gate(rows, 0.7)


def origin_gate(df, threshold):
    """Declared AI always refuses, scored findings only above the threshold, an unmeasured score admits."""
    c = F.col
    found = c("state").isin("AI_INDICATORS_FOUND", "AI_INDICATORS_NEED_REVIEW")
    refusal = X.cascade(
        [
            (c("mode") == "OFF", F.lit(None).cast("string")),
            (c("state") == "AI_CONFIRMED", "DECLARED_AI"),
            (found & (c("score") > threshold), "SCORE_ABOVE_THRESHOLD"),
        ]
    )
    return df.withColumn("refusal", refusal).select(
        "asset_id", "mode", (c("mode") != "OFF").alias("checked"),
        ((c("mode") != "BLOCK") | c("refusal").isNull()).alias("allowed"), "refusal",
    )


# -- copy fusion ---------------------------------------------------------------------------------
_PAIRIN = f"""select doc_id, item_id, shared, passage_shingles, doc_id % 12 = 0 as exact, case when doc_id % 10 = 1 then null else 0.35e0 + 0.65e0 * shared / passage_shingles end as ai,
   0.5e0 + 0.5e0 * {dsql('PH', 'doc_id', 'item_id')} as phash, case when doc_id % 9 = 4 then null else 0.55e0 + 0.45e0 * {dsql('ST', 'doc_id', 'item_id')} end as structure, {dsql('V', 'doc_id', 'item_id')} < 0.6 as validated,
   20 + 60 * {dsql('IN', 'doc_id', 'item_id')} as inliers, 0.5e0 + 0.5e0 * {dsql('IR', 'doc_id', 'item_id')} as ir, 0.4e0 * {dsql('QC', 'doc_id', 'item_id')} as qc, 0.5e0 * {dsql('RC', 'doc_id', 'item_id')} as rc,
   case when doc_id % 6 = 2 then null else 0.02e0 * {dsql('ER', 'doc_id', 'item_id')} end as er, case when {dsql('AG', 'doc_id', 'item_id')} < 0.25 then 'CORROBORATION_REQUIRED' else 'STRICT' end as grade, doc_id % 14 = 3 as refl from ({PAIR_SQL}) p"""
_GQ = "case when validated then round(0.25e0 * least(inliers / 60e0, 1) + 0.30e0 * least(ir, 1) + 0.25e0 * least(sqrt(qc * rc) / 0.2e0, 1) + 0.2e0 * case when er is null then 0.5e0 else greatest(1 - er / 0.0125e0, 0) end, 6) else 0e0 end"
_FUSE = f"""with i as (select * exclude (structure), case when doc_id % 7 <> 5 then structure end as structure from ({_PAIRIN}) p), g as (select *, {_GQ} as gq, coalesce(ai >= 0.55, false) as fa, coalesce(ai >= 0.70, false) as fg, phash >= 0.78 as fp, coalesce(structure >= 0.76, false) as fs, grade = 'CORROBORATION_REQUIRED' as rel from i),
  m as (select *, rel and coalesce(structure >= 0.84, false) and (fa or fp) as relok, validated and coalesce(structure >= 0.97, false) and ir >= 0.9 as concl,
     (validated and fs and (fa or fp)) or (validated and coalesce(structure >= 0.84, false) and gq >= 0.72) or (validated and coalesce(ai >= 0.86, false) and gq >= 0.72 and coalesce(structure >= 0.62, false)) or (rel and coalesce(structure >= 0.84, false) and (fa or fp)) or (validated and coalesce(structure >= 0.97, false) and ir >= 0.9) as mt,
     0.25e0 * coalesce(ai, phash) + 0.15e0 * phash + 0.32e0 * gq + 0.28e0 * coalesce(structure, 0) as idx from g),
  r as (select *, not mt and (validated or coalesce(ai >= 0.8, false) or phash >= 0.9 or rel) as rv from m),
  f as (select doc_id, item_id, case when exact then 1e0 else gq end as geometry_quality, exact, case when exact then 1e0 else round(idx, 6) end as evidence_index, exact or mt as match_supported, not exact and rv as review_supported,
    case when exact then 'VERY_HIGH' when mt and idx >= 0.84 then 'VERY_HIGH' when mt then 'HIGH' when rv then 'REVIEW' else 'LOW' end as evidence_tier,
    case when exact then 'EXACT_BINARY_COPY' when mt and least(qc, rc) < 0.18 then 'VERIFIED_PARTIAL_COPY_EVIDENCE' when mt then 'VERIFIED_NEAR_DUPLICATE' when rv then 'REVIEW_CANDIDATE' else 'NEAREST_CANDIDATE_ONLY' end as classification,
    case when exact then 4 else fa::int + fp::int + fs::int end::bigint as support_count, case when exact then 'NOT_REQUIRED_FOR_EXACT_HASH' when validated then 'VERIFIED' when rel then 'RECOVERED_PENDING_PIXEL_AGREEMENT' else 'REJECTED' end as geometry_state, case when exact then 'EXACT' else 'DIFFERENT_BYTES' end as sha256_state, case when exact then 'CORROBORATING' when fa then 'SUPPORT' when ai is not null then 'WEAK' else 'UNAVAILABLE' end as retrieval_state,
    case when exact then 'CORROBORATING' when fp then 'SUPPORT' else 'WEAK' end as phash_state, case when exact then 'NOT_REQUIRED_FOR_EXACT_HASH' when fs then 'STRONG' when structure is not null then 'MEASURED_WEAK' else 'UNAVAILABLE_WITHOUT_GEOMETRY' end as structure_state,
    case when exact then 'EXACT_SHA256_MATCH' else concat_ws('|', case when validated then 'ROBUST_GEOMETRY_VERIFIED' end, case when fs then 'ALIGNED_STRUCTURE_CORROBORATES' end, case when fg and not mt then 'SSCD_GEOMETRY_SUPPORT_REQUIRES_ALIGNED_STRUCTURE' when fg then 'SSCD_GEOMETRY_AND_STRUCTURE_CORROBORATE' when fa then 'SSCD_SUPPORTS_CANDIDATE' end,
      case when fp then 'PHASH_SUPPORTS_CANDIDATE' end, case when concl then 'ALIGNED_PIXELS_EFFECTIVELY_IDENTICAL' end, case when refl then 'ALIGNMENT_IS_A_MIRROR_IMAGE' end, case when rel and relok then 'RELAXED_ALIGNMENT_CONFIRMED_BY_ALIGNED_PIXELS' when rel then 'RELAXED_ALIGNMENT_NOT_CONFIRMED_BY_ALIGNED_PIXELS' when not validated then 'NO_VERIFIED_LOCAL_GEOMETRY' end) end as reason_codes from r)"""


def copy_inputs(t: Tables):
    d = lambda tag: draw(tag, "doc_id", "item_id")
    p = pairs(t)
    return p.select(
        "doc_id", "item_id", (F.col("doc_id") % 12 == 0).alias("exact"),
        F.when(F.col("doc_id") % 10 != 1, 0.35 + 0.65 * F.col("shared") / F.col("passage_shingles")).alias("ai"),
        (0.5 + 0.5 * d("PH")).alias("phash"),
        F.when(F.col("doc_id") % 9 != 4, 0.55 + 0.45 * d("ST")).alias("structure"),
        (F.col("doc_id") % 7 != 5).alias("structure_available"),
        (d("V") < 0.6).alias("validated"), (20 + 60 * d("IN")).alias("inliers"), (0.5 + 0.5 * d("IR")).alias("inlier_ratio"),
        (0.4 * d("QC")).alias("query_coverage"), (0.5 * d("RC")).alias("reference_coverage"),
        F.when(F.col("doc_id") % 6 != 2, 0.02 * d("ER")).alias("symmetric_error"),
        F.when(d("AG") < 0.25, "CORROBORATION_REQUIRED").otherwise("STRICT").alias("alignment_grade"),
        (F.col("doc_id") % 14 == 3).alias("reflected"),
        F.col("item_id").alias("retrieval_rank"),
    )


_FCOLS = ["doc_id", "item_id", "geometry_quality", "evidence_index", "match_supported", "review_supported", "evidence_tier", "classification", "support_count", "geometry_state", "sha256_state", "retrieval_state", "phash_state", "structure_state", "reason_codes"]


@query("dc1_copy_fusion", f"{_FUSE} select {', '.join(_FCOLS)} from f")
def dc1(t):
    return U.fuse_copy(copy_inputs(t)).select(*_FCOLS)


_VRANK = "select doc_id, item_id, row_number() over (partition by doc_id order by case when exact then 3 when match_supported then 2 when review_supported then 1 else 0 end desc, evidence_index desc, item_id) as verification_rank, match_supported, review_supported from f"


@query("wn2_verification_rank", f"{_FUSE} select doc_id, item_id, item_id as retrieval_rank, verification_rank from ({_VRANK}) v")
def wn2(t):
    return S.verification_rank(U.fuse_copy(copy_inputs(t)), "doc_id", "item_id").select("doc_id", "item_id", "retrieval_rank", "verification_rank")


@query(
    "dc8_match_decision",
    f"""{_FUSE}, k as ({_VRANK}) select d.doc_id, case when coalesce(k.match_supported, false) then 'MATCH_FOUND' when coalesce(k.review_supported, false) then 'INCONCLUSIVE' when d.doc_id % 3 <> 0 then 'NO_MATCH_IN_CHECKED_SOURCES' else 'SCOPE_INCOMPLETE' end as match_status
        from documents d left join k on k.doc_id = d.doc_id and k.verification_rank = 1""",
)
def dc8(t):
    top = S.verification_rank(U.fuse_copy(copy_inputs(t)), "doc_id", "item_id").where("verification_rank = 1").select(
        "doc_id", "match_supported", "review_supported"
    )
    d = t.raw("documents").select("doc_id").join(top, "doc_id", "left")
    no = F.lit(False)
    status = C.match_decision(F.coalesce("match_supported", no), F.coalesce("review_supported", no), F.col("doc_id") % 3 != 0)
    return d.select("doc_id", status.alias("match_status"))


# -- geometry ------------------------------------------------------------------------------------
@query(
    "fn11_geometry_quality",
    """select pair_id, link_id, case when link_id % 5 <> 0 then round(0.25e0 * least(err * 100 / 60e0, 1) + 0.3e0 * x + 0.25e0 * least(sqrt(x * y) / 0.2e0, 1) + 0.2e0 * case when link_id % 3 = 0 then 0.5e0 else greatest(1 - err / 50e0 / 0.0125e0, 0) end, 6) else 0e0 end as quality from V_POINT""",
)
def fn11(t):
    p = t.points()
    q = U.geometry_quality(
        F.col("link_id") % 5 != 0, F.col("err") * 100, F.col("x"), F.col("x"), F.col("y"),
        F.when(F.col("link_id") % 3 != 0, F.col("err") / 50.0),
    )
    return p.select("pair_id", "link_id", q.alias("quality"))


_CELL = "greatest(0, least(3, floor({0} * 4)))::bigint"


@query(
    "ag33_grid_occupancy",
    f"select pair_id, count(distinct {_CELL.format('y')} * 4 + {_CELL.format('x')}) as cells from V_POINT group by pair_id",
)
def ag33(t):
    return G.grid_cells(t.points(), "pair_id")


_PAD = "greatest(({1} - {0}) / 2 + 0.025e0, 0.035e0)"


@query(
    "ag34_support_patches",
    f"""with c as (select pair_id, {_CELL.format('x')} as gx, {_CELL.format('y')} as gy, count(*) as support, median(err) as me, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from V_POINT group by all),
       n as (select *, sum(support) over (partition by pair_id) as n from c), k as (select *, row_number() over (partition by pair_id order by support desc, me, gy, gx) as patch from n where support >= greatest(3, least(6, ceil(n * 0.06e0))))
       select pair_id, patch, gx, gy, support, round(support / n, 6) as support_fraction, round(me, 6) as median_error, round(greatest(0, (x0 + x1) / 2 - {_PAD.format('x0', 'x1')}), 6) as left, round(least(1, (x0 + x1) / 2 + {_PAD.format('x0', 'x1')}), 6) as right,
         round(greatest(0, (y0 + y1) / 2 - {_PAD.format('y0', 'y1')}), 6) as top, round(least(1, (y0 + y1) / 2 + {_PAD.format('y0', 'y1')}), 6) as bottom from k where patch <= 4""",
)
def ag34(t):
    return G.support_patches(t.points(), "pair_id")


@query(
    "tk8_top_links",
    "select * from (select pair_id, link_id, row_number() over (partition by pair_id order by err, x * 64, link_id) as rank from (select distinct pair_id, link_id, x, err from V_POINT) d) t where rank <= 64",
)
def tk8(t):
    links = t.points().select("pair_id", "link_id", "x", "err").distinct().withColumn("distance", F.col("x") * 64)
    return G.top_links(links, "pair_id").select("pair_id", "link_id", "rank")


@query(
    "ag36_top_shares",
    "select p_brand, count(*) as rows, round(count(*) / (select count(*) from part), 6) as share from part group by 1 order by 2 desc, 1 limit 6",
)
def ag36(t):
    return G.top_shares(t.raw("part"), "p_brand", 6)


@query(
    "ag32_line_assembly",
    "select page, line_no, string_agg(word, ' ' order by left_px, word_no) as line, round(avg(conf), 6) as mean_conf, min(left_px) as box_left, max(left_px + 8) as box_right from V_WORD group by all",
)
def ag32(t):
    return T.assemble_lines(t.words(), ["page", "line_no"])


@query("udtf1_region_views", "select doc_id, region, length(chunk) as chars, sha256(chunk) as chunk_digest from V_CHUNK")
def udtf1(t):
    return t.chunks().select("doc_id", "region", F.char_length("chunk").cast("bigint").alias("chars"), F.sha2("chunk", 256).alias("chunk_digest"))


_TILE = "substring(text, floor(c * n / {0})::int + 1, floor((c + 1) * n / {0})::int - floor(c * n / {0})::int)"


@query(
    "udtf4_tiles",
    f"select doc_id, (c // 3)::bigint as tile_row, (c % 3)::bigint as tile_col, sha256({_TILE.format(9)}) as tile_digest from (select doc_id, text, length(text) as n, unnest(range(0, 9)) as c from documents) t",
)
def udtf4(t):
    return T.tiles(t.texts(), "doc_id", "text", 3).select("doc_id", "tile_row", "tile_col", F.sha2("tile", 256).alias("tile_digest"))


LETTERS = "aeinrt"
_CNT = "length(x) - length(replace(x, '{0}', ''))"
_SIG = (
    "(select case when list_sum(v) > 0 then list_transform(v, lambda z: z / list_sum(v)::double) else list_transform(v, lambda z: 0e0) end from (select ["
    + ", ".join(f"length({{0}}) - length(replace({{0}}, '{c}', ''))" for c in LETTERS)
    + "] as v) s)"
)
_CELLS = "list_transform(range(0, 4), lambda c: " + _TILE.format(4) + ")"
_BEST = "list_transform({0}, lambda a: list_max(list_transform({1}, lambda b: list_sum(list_transform(range(1, 7), lambda k: least(a[k], b[k]))))))"


@query(
    "tk7_best_match_both_ways",
    f"""with tl as (select doc_id, c, {_TILE.format(4)} as x from (select doc_id, text, length(text) as n, unnest(range(0, 4)) as c from documents) q),
      sg as (select doc_id, c, [{', '.join(_CNT.format(ch) for ch in LETTERS)}] as v from tl),
      nm as (select doc_id, list(case when list_sum(v) > 0 then list_transform(v, lambda z: z / list_sum(v)::double) else list_transform(v, lambda z: 0e0) end order by c) as cells from sg group by doc_id),
      pr as (select a.doc_id, {_BEST.format('a.cells', 'b.cells')} as lb, {_BEST.format('b.cells', 'a.cells')} as rb from nm a join nm b on b.doc_id = a.doc_id + 1)
      select doc_id, round(0.5e0 * list_median(lb) + 0.5e0 * list_median(rb), 6) as consistency from pr""",
)
def tk7(t):
    n = F.char_length("text")
    cell = lambda i: F.substring(
        "text", F.floor(F.lit(i) * n / 4).cast("int") + 1, F.floor(F.lit(i + 1) * n / 4).cast("int") - F.floor(F.lit(i) * n / 4).cast("int")
    )
    cut = t.texts().select("doc_id", *[cell(i).alias(f"c{i}") for i in range(4)])
    sig = cut.select("doc_id", F.array(*[G.letter_profile(F.col(f"c{i}"), LETTERS) for i in range(4)]).alias("cells"))
    nxt = sig.select((F.col("doc_id") - 1).alias("doc_id"), F.col("cells").alias("other"))
    return G.best_both_ways(sig.join(nxt, "doc_id"), "cells", "other").select("doc_id", r6(F.col("consistency")).alias("consistency"))


# -- style fusion --------------------------------------------------------------------------------
_STYLE = f"""with i as (select item_id, authorized, item_id % 9 <> 0 as active, case when item_id % 10 = 3 then null else 0.45e0 + 0.55e0 * {dsql('L', 'item_id')} end as raw, 0.4e0 + 0.6e0 * {dsql('P', 'item_id')} as pa, 0.4e0 + 0.6e0 * {dsql('T', 'item_id')} as tn, 0.4e0 + 0.6e0 * {dsql('S', 'item_id')} as sk,
     case when item_id % 8 = 5 then null else 0.4e0 + 0.6e0 * {dsql('X', 'item_id')} end as tx, case when item_id % 7 = 4 then null else 0.4e0 + 0.6e0 * {dsql('TI', 'item_id')} end as tile, case when item_id % 6 = 1 then null else {dsql('C', 'item_id')} end as content, item_id % 4 + 1 as n, {dsql('G', 'item_id')} - 0.2e0 as gap, 0.1e0 * {dsql('M', 'item_id')} as margin,
     item_id % 5 <> 2 as ready, case when item_id % 12 = 7 then 'NONE' else 'BONFERRONI_FAMILY_WISE_V1' end as corr, 0.15e0 * {dsql('TP', 'item_id')} as tp, {dsql('PP', 'item_id')} as pp from V_ANCHOR),
  a as (select *, case when active then raw end as l, 0.1e0 * pa + 0.15e0 * tn + 0.375e0 * sk + 0.375e0 * tx as m, ready and corr = 'BONFERRONI_FAMILY_WISE_V1' as rdy from i),
  b as (select *, l - content as sg from a),
  c as (select *, case when sg is not null then least(greatest((sg + 0.05e0) / 0.45e0, 0), 1) end as sep from b),
  d as (select *, (coalesce(0.5e0 * l, 0) + coalesce(case when l is null then 0.65e0 else 0.25e0 end * m, 0) + coalesce(case when l is null then 0.35e0 else 0.15e0 end * tile, 0) + coalesce(0.1e0 * sep, 0))
       / nullif(case when l is null then 0 else 0.5e0 end + case when m is null then 0 when l is null then 0.65e0 else 0.25e0 end + case when tile is null then 0 when l is null then 0.35e0 else 0.15e0 end + case when sep is null then 0 else 0.1e0 end, 0) as ix0,
     coalesce(l >= 0.68, false)::int + coalesce(m >= 0.7, false)::int + coalesce(tile >= 0.68, false)::int + coalesce(sg >= 0.12, false)::int + (margin >= 0.03)::int as sc,
     case when content is null then 'CONTENT_CONTROL_UNAVAILABLE' when sg >= 0.12 then 'STYLE_EXCEEDS_CONTENT_CONTROL' when content >= 0.75 and (sg is null or sg < 0.1) then 'STYLE_AND_CONTENT_CONFOUNDED' else 'MIXED_STYLE_AND_CONTENT_SIGNAL' end as cs from c),
  e as (select *, coalesce(ix0, 0) as ix from d),
  f as (select *, case when not active then 'DIAGNOSTIC' when ix >= 0.84 and sc >= 3 and n >= 3 and gap > 0 and rdy and tp <= 0.05 and pp >= 0.5 and cs <> 'STYLE_AND_CONTENT_CONFOUNDED' then 'VERY_HIGH'
        when ix >= 0.74 and sc >= 3 and n >= 3 and gap > 0 and rdy and tp <= 0.10 and pp >= 0.25 then 'HIGH' when ix >= 0.58 and sc >= 1 then 'REVIEW' else 'LOW' end as tier from e),
  g as (select item_id, authorized, round(ix, 6) as evidence_index, sc::bigint as support_count, cs as confound_state, tier as evidence_tier,
     case tier when 'DIAGNOSTIC' then 'DIAGNOSTIC_STYLE_RESEMBLANCE_ONLY' when 'VERY_HIGH' then 'VERY_HIGH_STYLE_RESEMBLANCE_EVIDENCE' when 'HIGH' then 'HIGH_STYLE_RESEMBLANCE_EVIDENCE' when 'REVIEW' then case when rdy then 'STYLE_RESEMBLANCE_REVIEW_CANDIDATE' else 'UNCALIBRATED_STYLE_RESEMBLANCE_REVIEW_CANDIDATE' end else 'LOW_STYLE_RESEMBLANCE_EVIDENCE' end as classification,
     active and tier in ('VERY_HIGH', 'HIGH', 'REVIEW') as review_recommended,
     concat_ws('|', case when l >= 0.68 then 'LEARNED_STYLE_EMBEDDING_SUPPORT' end, case when m >= 0.7 then 'MARK_MAKING_AND_TEXTURE_SUPPORT' end, case when tile >= 0.68 then 'BIDIRECTIONAL_TILE_STYLE_SUPPORT' end, case when sg >= 0.12 then 'STYLE_EXCEEDS_CONTENT_CONTROL' end, case when margin >= 0.03 then 'CATALOG_RANKING_MARGIN_SUPPORT' end,
       case when cs = 'STYLE_AND_CONTENT_CONFOUNDED' then 'CONTENT_CONFOUND_REQUIRES_CAUTION' end, case when n < 2 then 'SINGLE_EXEMPLAR_LIMITATION' end, case when gap <= 0 then 'RAW_COSINE_CATALOG_INVERSION_DETECTED' end,
       case when rdy then 'CATALOG_RELATIVE_EMPIRICAL_SUPPORT_READY' else 'STYLE_CALIBRATION_INSUFFICIENT' end, case when ready and not rdy then 'STYLE_SELECTION_CORRECTION_REQUIRED' end,
       case when active and tier in ('VERY_HIGH', 'HIGH', 'REVIEW') then 'STYLE_RESEMBLANCE_REVIEW_RECOMMENDED' end, case when not active then 'DIAGNOSTIC_FALLBACK_CANNOT_ATTRIBUTE_CREATOR' end) as reason_codes from f)"""


def style_inputs(t: Tables):
    d = lambda tag: draw(tag, "item_id")
    i = F.col("item_id")
    high = lambda tag: 0.4 + 0.6 * d(tag)
    return t.anchors().select(
        "item_id", "authorized", (i % 9 != 0).alias("active"), F.when(i % 10 != 3, 0.45 + 0.55 * d("L")).alias("raw_similarity"),
        high("P").alias("palette"), high("T").alias("tone"), high("S").alias("stroke"), F.when(i % 8 != 5, high("X")).alias("texture"),
        F.when(i % 7 != 4, high("TI")).alias("tile"), F.when(i % 6 != 1, d("C")).alias("content"), (i % 4 + 1).alias("sample_count"),
        (d("G") - 0.2).alias("gap"), (0.1 * d("M")).alias("margin"), (i % 5 != 2).alias("cal_ready"),
        F.when(i % 12 == 7, "NONE").otherwise("BONFERRONI_FAMILY_WISE_V1").alias("cal_correction"), (0.15 * d("TP")).alias("tail_p"), d("PP").alias("positive_percentile"),
    )


_SCOLS = ["item_id", "evidence_index", "support_count", "confound_state", "evidence_tier", "classification", "review_recommended", "reason_codes"]


@query("dc2_style_fusion", f"{_STYLE} select {', '.join(_SCOLS)} from g")
def dc2(t):
    return U.fuse_style(style_inputs(t)).withColumn("reason_codes", joined(F.col("reason_codes"))).select(*_SCOLS)


@query(
    "dc3_consent_gate",
    f"""{_STYLE} select item_id, case when review_recommended and not authorized then 'ADVISORY_ONLY' else evidence_tier end as evidence_tier, case when review_recommended and not authorized then 'PROFILE_ENROLLMENT_NOT_CONSENT_BACKED' else classification end as classification,
       review_recommended and authorized as review_recommended, case when review_recommended and not authorized then concat(reason_codes, '|PROFILE_CONSENT_NOT_CONFIRMED|STYLE_POLICY_ESCALATION_SUPPRESSED') else reason_codes end as reason_codes from g""",
)
def dc3(t):
    return U.consent_gate(U.fuse_style(style_inputs(t))).withColumn("reason_codes", joined(F.col("reason_codes"))).select(
        "item_id", "evidence_tier", "classification", "review_recommended", "reason_codes"
    )


@query(
    "fn12_mechanics",
    f"select item_id, case when item_id % 8 = 5 then null else round(0.1e0 * (0.4e0 + 0.6e0 * {dsql('P', 'item_id')}) + 0.15e0 * (0.4e0 + 0.6e0 * {dsql('T', 'item_id')}) + 0.375e0 * (0.4e0 + 0.6e0 * {dsql('S', 'item_id')}) + 0.375e0 * (0.4e0 + 0.6e0 * {dsql('X', 'item_id')}), 6) end as mechanics from V_ANCHOR",
)
def fn12(t):
    m = U.mechanics(F.col("palette"), F.col("tone"), F.col("stroke"), F.col("texture"))
    return style_inputs(t).select("item_id", r6(m).alias("mechanics"))
