"""Evidence fusion: copy, style and origin signals become tiers, classes and ordered reasons.

Row-level fusion is pure column logic; multi-view detector scores are folded by three small group-bys
(view -> member -> family -> asset). Scores are rounded to six decimals between the folds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.functions.expr import (
    cascade,
    codes,
    joined,
    r6,
    ratio,
    unit,
    weighted_logit_sum,
)


@dataclass(frozen=True)
class CopyThresholds:
    """Operating points of copy fusion."""

    structure_match: float = 0.76
    structure_very_strong: float = 0.84
    structure_support: float = 0.62
    structure_conclusive: float = 0.97
    inlier_ratio_conclusive: float = 0.90
    geometry_very_strong: float = 0.72
    learned_support: float = 0.55
    learned_geometry: float = 0.70
    learned_very_strong: float = 0.86
    learned_review: float = 0.80
    phash_support: float = 0.78
    phash_review: float = 0.90


@dataclass(frozen=True)
class StyleThresholds:
    """Operating points of style fusion."""

    learned: float = 0.68
    mechanics: float = 0.70
    tile: float = 0.68
    content_gap: float = 0.12
    margin: float = 0.03
    review: float = 0.58
    high: float = 0.74
    very_high: float = 0.84
    high_tail: float = 0.10
    very_high_tail: float = 0.05
    high_percentile: float = 0.25
    very_high_percentile: float = 0.50


@dataclass(frozen=True)
class OriginThresholds:
    """Operating points of origin classification."""

    likely: float = 0.78
    review: float = 0.58
    max_view_std: float = 0.18
    min_stability: float = 0.35
    max_disagreement: float = 0.22
    min_families: int = 2


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def geometry_quality(
    validated: Column, inliers: Column, inlier_ratio: Column, query_cov: Column, ref_cov: Column, error: Column
) -> Column:
    """Weighted support of a validated alignment; an unmeasured error counts half."""
    area = F.sqrt(F.greatest(_zero(query_cov), F.lit(0.0)) * F.greatest(_zero(ref_cov), F.lit(0.0)))
    error_part = F.when(error.isNull(), 0.5).otherwise(unit(1.0 - error / 0.0125))
    score = (
        0.25 * unit(_zero(inliers) / 60.0)
        + 0.30 * unit(_zero(inlier_ratio))
        + 0.25 * unit(area / 0.20)
        + 0.20 * error_part
    )
    return F.when(_true(validated), r6(score)).otherwise(F.lit(0.0))


def fuse_copy(pairs: DataFrame, th: CopyThresholds = CopyThresholds()) -> DataFrame:
    """Tier, class, index and ordered reasons of each candidate pair.

    Input: ``exact, ai, phash, structure, validated, inliers, inlier_ratio, query_coverage,
    reference_coverage, symmetric_error, alignment_grade, reflected`` and, if there, ``structure_available``: a structure that
    wasn't available counts for nothing, whatever its number. Retrieval and fingerprint alone never make a match. Each
    signal's state is a column of its own.
    """
    c = F.col
    pairs = pairs.withColumn(
        "geometry_quality",
        geometry_quality(
            c("validated"), c("inliers"), c("inlier_ratio"), c("query_coverage"), c("reference_coverage"),
            c("symmetric_error"),
        ),
    )
    ai, ph, st = unit(c("ai")), unit(c("phash")), unit(c("structure"))
    if "structure_available" in pairs.columns:
        st = F.when(_true(c("structure_available")), st)
    valid, relaxed = _true(c("validated")), _true(c("alignment_grade") == "CORROBORATION_REQUIRED")
    at_least = lambda x, v: _true(x >= v)
    flags = {
        "__ai": at_least(ai, th.learned_support),
        "__ai_geo": at_least(ai, th.learned_geometry),
        "__ph": at_least(ph, th.phash_support),
        "__st": at_least(st, th.structure_match),
    }
    for name, test in flags.items():
        pairs = pairs.withColumn(name, test)
    backed = c("__ai") | c("__ph")
    very_strong = at_least(st, th.structure_very_strong)
    geo_strong = c("geometry_quality") >= th.geometry_very_strong
    conclusive = (
        valid & at_least(st, th.structure_conclusive) & at_least(_zero(c("inlier_ratio")), th.inlier_ratio_conclusive)
    )
    relaxed_ok = relaxed & very_strong & backed
    match = (
        (valid & c("__st") & backed)
        | (valid & very_strong & geo_strong)
        | (valid & at_least(ai, th.learned_very_strong) & geo_strong & at_least(st, th.structure_support))
        | relaxed_ok
        | conclusive
    )
    global_review = at_least(ai, th.learned_review) | at_least(ph, th.phash_review)
    pairs = (
        pairs.withColumn("__match", match)
        .withColumn("__review", ~c("__match") & (valid | global_review | relaxed))
        .withColumn(
            "__index",
            unit(
                0.25 * F.coalesce(ai, ph) + 0.15 * ph + 0.32 * c("geometry_quality")
                + 0.28 * F.coalesce(st, F.lit(0.0))
            ),
        )
    )
    reasons = codes(
        (valid, "ROBUST_GEOMETRY_VERIFIED"),
        (c("__st"), "ALIGNED_STRUCTURE_CORROBORATES"),
        (c("__ai_geo") & ~c("__match"), "SSCD_GEOMETRY_SUPPORT_REQUIRES_ALIGNED_STRUCTURE"),
        (c("__ai_geo") & c("__match"), "SSCD_GEOMETRY_AND_STRUCTURE_CORROBORATE"),
        (c("__ai") & ~c("__ai_geo"), "SSCD_SUPPORTS_CANDIDATE"),
        (c("__ph"), "PHASH_SUPPORTS_CANDIDATE"),
        (conclusive, "ALIGNED_PIXELS_EFFECTIVELY_IDENTICAL"),
        (_true(c("reflected")), "ALIGNMENT_IS_A_MIRROR_IMAGE"),
        (relaxed & relaxed_ok, "RELAXED_ALIGNMENT_CONFIRMED_BY_ALIGNED_PIXELS"),
        (relaxed & ~relaxed_ok, "RELAXED_ALIGNMENT_NOT_CONFIRMED_BY_ALIGNED_PIXELS"),
        (~relaxed & ~valid, "NO_VERIFIED_LOCAL_GEOMETRY"),
    )
    partial = F.least(_zero(c("query_coverage")), _zero(c("reference_coverage"))) < 0.18
    exact = _true(c("exact"))
    out = pairs.withColumn("reason_codes", F.when(exact, F.lit("EXACT_SHA256_MATCH")).otherwise(joined(reasons)))
    out = (
        out.withColumn("evidence_index", F.when(exact, 1.0).otherwise(r6(c("__index"))))
        # Equal bytes need no alignment: their geometry is perfect.
        .withColumn("geometry_quality", F.when(exact, 1.0).otherwise(c("geometry_quality")))
        .withColumn("match_supported", exact | c("__match"))
        .withColumn("review_supported", ~exact & c("__review"))
        .withColumn(
            "evidence_tier",
            cascade(
                [
                    (exact, "VERY_HIGH"),
                    (c("__match") & (c("__index") >= 0.84), "VERY_HIGH"),
                    (c("__match"), "HIGH"),
                    (c("__review"), "REVIEW"),
                ],
                "LOW",
            ),
        )
        .withColumn(
            "classification",
            cascade(
                [
                    (exact, "EXACT_BINARY_COPY"),
                    (c("__match") & partial, "VERIFIED_PARTIAL_COPY_EVIDENCE"),
                    (c("__match"), "VERIFIED_NEAR_DUPLICATE"),
                    (c("__review"), "REVIEW_CANDIDATE"),
                ],
                "NEAREST_CANDIDATE_ONLY",
            ),
        )
        .withColumn(
            "support_count",
            F.when(exact, 4).otherwise(c("__ai").cast("int") + c("__ph").cast("int") + c("__st").cast("int")).cast("bigint"),
        )
        .withColumn(
            "geometry_state",
            cascade(
                [
                    (exact, "NOT_REQUIRED_FOR_EXACT_HASH"),
                    (valid, "VERIFIED"),
                    (relaxed, "RECOVERED_PENDING_PIXEL_AGREEMENT"),
                ],
                "REJECTED",
            ),
        )
        .withColumn("sha256_state", F.when(exact, "EXACT").otherwise(F.lit("DIFFERENT_BYTES")))
        .withColumn(
            "retrieval_state",
            cascade([(exact, "CORROBORATING"), (c("__ai"), "SUPPORT"), (c("ai").isNotNull(), "WEAK")], "UNAVAILABLE"),
        )
        .withColumn("phash_state", cascade([(exact, "CORROBORATING"), (c("__ph"), "SUPPORT")], "WEAK"))
        .withColumn(
            "structure_state",
            cascade(
                [(exact, "NOT_REQUIRED_FOR_EXACT_HASH"), (c("__st"), "STRONG"), (st.isNotNull(), "MEASURED_WEAK")],
                "UNAVAILABLE_WITHOUT_GEOMETRY",
            ),
        )
    )
    return out.drop("__ai", "__ai_geo", "__ph", "__st", "__match", "__review", "__index")


def mechanics(palette: Column, tone: Column, stroke: Column, texture: Column) -> Column:
    """Mark-making and texture outweigh colour; NULL when any factor is missing."""
    return unit(0.10 * palette + 0.15 * tone + 0.375 * stroke + 0.375 * texture)


def weighted_available(parts: list[tuple[float | Column, Column]]) -> Column:
    """Mean over the components that were measured; 0 when none was."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for w, value in parts:
        w = w if isinstance(w, Column) else F.lit(w)
        total = total + F.coalesce(w * value, F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), w).otherwise(F.lit(0.0))
    return F.coalesce(ratio(total, weight), F.lit(0.0))


def fuse_style(profiles: DataFrame, th: StyleThresholds = StyleThresholds()) -> DataFrame:
    """Tier, class, index and ordered reasons of each creator-profile comparison.

    Input: ``active, raw_similarity, palette, tone, stroke, texture, tile, content, sample_count, gap,
    margin, cal_ready, cal_correction, tail_p, positive_percentile``.
    """
    c = F.col
    p = (
        profiles.withColumn("learned", F.when(c("active"), unit(c("raw_similarity"))))
        .withColumn("mechanics", mechanics(c("palette"), c("tone"), c("stroke"), c("texture")))
        .withColumn("content", unit(c("content")))
        .withColumn("style_gap", c("learned") - c("content"))
    )
    separation = unit((c("style_gap") + 0.05) / 0.45)
    has = c("learned").isNotNull()
    p = p.withColumn(
        "__index",
        weighted_available(
            [
                (0.50, c("learned")),
                (F.when(has, 0.25).otherwise(F.lit(0.65)), c("mechanics")),
                (F.when(has, 0.15).otherwise(F.lit(0.35)), c("tile")),
                (0.10, F.when(has, separation)),
            ]
        ),
    )
    support = [
        (_true(c("learned") >= th.learned), "LEARNED_STYLE_EMBEDDING_SUPPORT"),
        (_true(c("mechanics") >= th.mechanics), "MARK_MAKING_AND_TEXTURE_SUPPORT"),
        (_true(c("tile") >= th.tile), "BIDIRECTIONAL_TILE_STYLE_SUPPORT"),
        (_true(c("style_gap") >= th.content_gap), "STYLE_EXCEEDS_CONTENT_CONTROL"),
        (_true(c("margin") >= th.margin), "CATALOG_RANKING_MARGIN_SUPPORT"),
    ]
    count = F.lit(0)
    for test, _ in support:
        count = count + test.cast("int")
    p = p.withColumn("support_count", count.cast("bigint"))
    p = p.withColumn(
        "confound_state",
        cascade(
            [
                (c("content").isNull(), "CONTENT_CONTROL_UNAVAILABLE"),
                (c("style_gap") >= th.content_gap, "STYLE_EXCEEDS_CONTENT_CONTROL"),
                ((c("content") >= 0.75) & (c("style_gap").isNull() | (c("style_gap") < 0.10)), "STYLE_AND_CONTENT_CONFOUNDED"),
            ],
            "MIXED_STYLE_AND_CONTENT_SIGNAL",
        ),
    )
    adjusted = _true(c("cal_correction") == "BONFERRONI_FAMILY_WISE_V1")
    ready = _true(c("cal_ready")) & adjusted
    positive_gap = _true(c("gap") > 0)
    base = _true(c("active")) & (c("support_count") >= 3) & (c("sample_count") >= 3) & positive_gap & ready
    very_high = (
        base & (c("__index") >= th.very_high) & _true(c("tail_p") <= th.very_high_tail)
        & _true(c("positive_percentile") >= th.very_high_percentile)
        & (c("confound_state") != "STYLE_AND_CONTENT_CONFOUNDED")
    )
    high = (
        base & (c("__index") >= th.high) & _true(c("tail_p") <= th.high_tail)
        & _true(c("positive_percentile") >= th.high_percentile)
    )
    review = (c("__index") >= th.review) & (c("support_count") >= 1)
    p = p.withColumn(
        "evidence_tier",
        cascade([(~c("active"), "DIAGNOSTIC"), (very_high, "VERY_HIGH"), (high, "HIGH"), (review, "REVIEW")], "LOW"),
    )
    p = p.withColumn(
        "classification",
        cascade(
            [
                (c("evidence_tier") == "DIAGNOSTIC", "DIAGNOSTIC_STYLE_RESEMBLANCE_ONLY"),
                (c("evidence_tier") == "VERY_HIGH", "VERY_HIGH_STYLE_RESEMBLANCE_EVIDENCE"),
                (c("evidence_tier") == "HIGH", "HIGH_STYLE_RESEMBLANCE_EVIDENCE"),
                ((c("evidence_tier") == "REVIEW") & ready, "STYLE_RESEMBLANCE_REVIEW_CANDIDATE"),
                (c("evidence_tier") == "REVIEW", "UNCALIBRATED_STYLE_RESEMBLANCE_REVIEW_CANDIDATE"),
            ],
            "LOW_STYLE_RESEMBLANCE_EVIDENCE",
        ),
    )
    recommended = c("active") & c("evidence_tier").isin("VERY_HIGH", "HIGH", "REVIEW")
    reasons = codes(
        *support,
        (c("confound_state") == "STYLE_AND_CONTENT_CONFOUNDED", "CONTENT_CONFOUND_REQUIRES_CAUTION"),
        (c("sample_count") < 2, "SINGLE_EXEMPLAR_LIMITATION"),
        (c("gap") <= 0, "RAW_COSINE_CATALOG_INVERSION_DETECTED"),
        (ready, "CATALOG_RELATIVE_EMPIRICAL_SUPPORT_READY"),
        (~ready, "STYLE_CALIBRATION_INSUFFICIENT"),
        (_true(c("cal_ready")) & ~adjusted, "STYLE_SELECTION_CORRECTION_REQUIRED"),
        (recommended, "STYLE_RESEMBLANCE_REVIEW_RECOMMENDED"),
        (~c("active"), "DIAGNOSTIC_FALLBACK_CANNOT_ATTRIBUTE_CREATOR"),
    )
    return (
        p.withColumn("evidence_index", r6(c("__index")))
        .withColumn("review_recommended", recommended)
        .withColumn("reason_codes", reasons)
        .withColumn(
            "profile_reliability",
            cascade(
                [(c("sample_count") >= 3, "MULTI_WORK_PROFILE"), (c("sample_count") == 2, "LIMITED_PROFILE")],
                "SINGLE_EXEMPLAR_ONLY",
            ),
        )
        .drop("__index")
    )


def consent_gate(style: DataFrame) -> DataFrame:
    """A review recommendation about a profile without consent becomes advisory only."""
    demote = F.col("review_recommended") & ~_true(F.col("authorized"))
    extra = F.array(F.lit("PROFILE_CONSENT_NOT_CONFIRMED"), F.lit("STYLE_POLICY_ESCALATION_SUPPRESSED"))
    return (
        style.withColumn("__demote", demote)
        .withColumn("evidence_tier", F.when(F.col("__demote"), "ADVISORY_ONLY").otherwise(F.col("evidence_tier")))
        .withColumn(
            "classification",
            F.when(F.col("__demote"), "PROFILE_ENROLLMENT_NOT_CONSENT_BACKED").otherwise(F.col("classification")),
        )
        .withColumn(
            "reason_codes",
            F.when(F.col("__demote"), F.array_distinct(F.concat("reason_codes", extra))).otherwise(F.col("reason_codes")),
        )
        .withColumn("review_recommended", F.col("review_recommended") & ~F.col("__demote"))
        .drop("__demote")
    )


# -- detectors -----------------------------------------------------------------------------------
def detector_aggregate(views: DataFrame, th: OriginThresholds = OriginThresholds()) -> DataFrame:
    """One member row per (asset, provider) from its views; the original view is never averaged down."""
    c = F.col
    delivery = c("scope") == "DELIVERY_TRANSFORM"
    only = lambda cond, x: F.when(cond, x)
    spatial = only(~delivery, c("score"))
    agg = views.groupBy("asset_id", "provider_no").agg(
        F.max("family").alias("family"),
        F.bool_or("calibrated").alias("calibrated"),
        F.max(only(c("view_no") == 0, c("score"))).alias("original"),
        weighted_logit_sum(only(delivery, c("score")), only(delivery, c("weight"))).alias("delivery"),
        weighted_logit_sum(
            only(delivery & (c("view_no") > 0), c("score")), only(delivery & (c("view_no") > 0), c("weight"))
        ).alias("transformed"),
        F.stddev_pop(only(delivery, c("score"))).alias("view_std"),
        # A member has a fixed handful of spatial views.
        F.percentile(spatial, 0.5).alias("spatial"),
        F.count(spatial).alias("__spatial_n"),
        F.count_if(spatial >= th.review).alias("spatial_support"),
    )
    need = F.least(F.lit(3).cast("bigint"), c("__spatial_n"))
    agg = agg.withColumn("spatial_corroborated", (need >= 2) & (c("spatial_support") >= need))
    return agg.select(
        "asset_id", "provider_no", "family", "calibrated",
        r6(
            F.when(c("spatial_corroborated"), F.greatest("original", "delivery", "spatial")).otherwise(
                F.greatest("original", "delivery")
            )
        ).alias("aggregate_score"),
        r6(c("original")).alias("original_score"),
        r6(c("delivery")).alias("delivery_score"),
        r6(c("transformed")).alias("transformed_score"),
        r6(c("spatial")).alias("spatial_score"),
        "spatial_support", "spatial_corroborated",
        r6(c("view_std")).alias("view_std"),
        r6(F.greatest(F.lit(0.0), 1.0 - c("view_std") / th.max_view_std)).alias("stability"),
    )


def family_rows(members: DataFrame) -> DataFrame:
    """Reliability-weighted score per (asset, family)."""
    c = F.col
    steadiness = F.when(c("stability").isNull(), 0.75).otherwise(0.45 + 0.55 * c("stability"))
    rel = F.when(c("calibrated"), 1.0).otherwise(F.lit(0.78)) * steadiness
    m = members.withColumn("__rel", rel)
    return m.groupBy("asset_id", "family").agg(
        r6(weighted_logit_sum(c("aggregate_score"), c("__rel"))).alias("score"),
        F.avg("__rel").alias("reliability"),
        F.bool_and("calibrated").alias("calibrated"),
        F.bool_and("verified").alias("verified"),
        F.avg("stability").alias("stability"),
        F.count(F.lit(1)).alias("members"),
    )


def fuse_families(families: DataFrame, th: OriginThresholds = OriginThresholds()) -> DataFrame:
    """One ensemble row per asset: fused score, disagreement, and how many families support what."""
    c = F.col
    stable = c("stability").isNull() | (c("stability") >= th.min_stability)
    pos, strong = c("score") >= th.review, c("score") >= th.likely
    ver, cal = c("verified"), c("calibrated")
    measured = F.when(c("stability").isNotNull(), c("reliability"))
    return families.groupBy("asset_id").agg(
        weighted_logit_sum(c("score"), c("reliability")).alias("fused_score"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_pop("score")).alias("disagreement"),
        ratio(F.sum(c("stability") * measured), F.sum(measured)).alias("stability"),
        F.min("stability").alias("min_stability"),
        F.sum("members").alias("members"),
        F.count(F.lit(1)).alias("observed_families"),
        F.count_if(ver).alias("families"),
        F.count_if(ver & cal).alias("calibrated_families"),
        F.count_if(stable & pos).alias("observed_positive"),
        F.count_if(ver & stable & pos).alias("positive"),
        F.count_if(ver & stable & strong).alias("strong"),
        F.count_if(ver & cal & stable & strong).alias("calibrated_strong"),
        F.count_if(ver & cal & stable & pos).alias("calibrated_positive"),
        F.count_if(ver & pos).alias("verified_positive"),
    )


def geo_consensus(*signals: Column) -> Column:
    """Geometric mean over the signals that were measured, floored at 1e-6."""
    logs = F.array_compact(F.array(*[F.when(s.isNotNull(), F.log(F.greatest(F.lit(1e-6), F.least(s, F.lit(1.0))))) for s in signals]))
    total = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(logs) > 0, F.exp(total / F.size(logs)))


# Classification of each branch, its tier, whether review is recommended, its first reasons.
ORIGIN_BRANCHES = [
    ("trusted", "AI_PROVENANCE_CONFIRMED", "PROVENANCE", True, "TRUSTED_C2PA_AI_ASSERTION|AI_ORIGIN_IDENTIFIED_BY_PROVENANCE"),
    ("untrusted", "AI_PROVENANCE_ASSERTED_UNTRUSTED_SIGNER", "REVIEW", True, "C2PA_AI_ASSERTION_PRESENT|C2PA_SIGNER_TRUST_NOT_CONFIRMED"),
    ("marker_and_model", "AI_INDICATORS_CORROBORATED", "HIGH", True, "VISIBLE_AI_MARKER_AND_MODEL_SIGNAL_AGREE|VISIBLE_MARKER_REQUIRES_REVIEW_NOT_PROVENANCE"),
    ("marker", "AI_ORIGIN_MARKER_FOUND", "REVIEW", True, "VISIBLE_AI_MARKER_FOUND|VISIBLE_MARKER_REQUIRES_REVIEW_NOT_PROVENANCE"),
    ("none", "SYNTHETIC_ORIGIN_ANALYSIS_UNAVAILABLE", "UNAVAILABLE", False, "NO_SYNTHETIC_DETECTOR_ACTIVE"),
    ("low_quality", "INCONCLUSIVE_LOW_RESOLUTION", "INCONCLUSIVE", True, "IMAGE_TOO_SMALL_FOR_CONFIGURED_OPERATING_DOMAIN|ABSTAINED"),
    ("disagree", "INCONCLUSIVE_DETECTOR_DISAGREEMENT", "INCONCLUSIVE", True, "DETECTOR_ENSEMBLE_DISAGREEMENT|ABSTAINED"),
    ("likely", "LIKELY_AI_GENERATED", "HIGH", True, "SYNTHETIC_DETECTOR_SUPPORT|TRANSFORM_CONSISTENT_SUPPORT"),
    ("review", "AI_ORIGIN_REVIEW_CANDIDATE", "REVIEW", True, "SYNTHETIC_DETECTOR_REVIEW_RANGE"),
    ("unstable", "INCONCLUSIVE_TRANSFORM_INSTABILITY", "INCONCLUSIVE", True, "DETECTOR_UNSTABLE_ACROSS_COMMON_TRANSFORMS|ABSTAINED"),
    ("cleared", "NO_AI_ORIGIN_EVIDENCE_DETECTED", "LOW", False, "DETECTORS_DID_NOT_FIND_AI_ORIGIN_EVIDENCE|NOT_PROOF_OF_HUMAN_ORIGIN"),
    ("limited", "AI_ORIGIN_INCONCLUSIVE_LIMITED_COVERAGE", "INCONCLUSIVE", True, "LOW_MODEL_RESPONSE_WITHOUT_NEGATIVE_CLEARANCE_SUPPORT|ABSTAINED|NOT_PROOF_OF_HUMAN_ORIGIN"),
]
# Presentation state of each class; all others are ORIGIN_UNKNOWN.
ORIGIN_STATES = {
    "AI_PROVENANCE_CONFIRMED": "AI_CONFIRMED",
    "LIKELY_AI_GENERATED": "AI_INDICATORS_FOUND",
    "AI_INDICATORS_CORROBORATED": "AI_INDICATORS_FOUND",
    "AI_ORIGIN_MARKER_FOUND": "AI_INDICATORS_NEED_REVIEW",
    "AI_ORIGIN_REVIEW_CANDIDATE": "AI_INDICATORS_NEED_REVIEW",
    "AI_PROVENANCE_ASSERTED_UNTRUSTED_SIGNER": "AI_INDICATORS_NEED_REVIEW",
    "NO_AI_ORIGIN_EVIDENCE_DETECTED": "NO_STRONG_AI_SIGNAL",
    "SYNTHETIC_ORIGIN_ANALYSIS_UNAVAILABLE": "CHECK_UNAVAILABLE",
}


def origin_state(classification: Column) -> Column:
    return cascade([(classification == k, v) for k, v in ORIGIN_STATES.items()], "ORIGIN_UNKNOWN")


def classify_origin(assets: DataFrame, th: OriginThresholds = OriginThresholds()) -> DataFrame:
    """The first branch that holds decides class, tier, recommendation and leading reasons.

    Input: the columns of ``fuse_families`` plus ``trusted, untrusted, marker_supported, low_quality``.
    """
    c = F.col
    unstable = _true(c("min_stability") < th.min_stability)
    incomplete = c("calibrated_families") < c("families")
    a = assets.withColumn("unstable", unstable)
    tests = {
        "trusted": c("trusted"),
        "untrusted": c("untrusted"),
        "marker_and_model": c("marker_supported") & (c("calibrated_positive") >= 1) & ~c("unstable"),
        "marker": c("marker_supported"),
        "none": F.coalesce(c("members"), F.lit(0)) == 0,
        "low_quality": c("low_quality"),
        "disagree": c("disagreement") >= th.max_disagreement,
        "likely": (c("fused_score") >= th.likely) & (c("calibrated_strong") >= th.min_families) & ~incomplete & ~c("unstable"),
        "review": (c("observed_positive") >= 1) | (c("fused_score") >= th.review),
        "unstable": c("unstable"),
        "cleared": (c("families") >= th.min_families) & ~incomplete & (c("verified_positive") == 0),
        "limited": F.lit(True),
    }
    branch = cascade([(tests[b[0]], b[0]) for b in ORIGIN_BRANCHES])
    a = a.withColumn("__branch", branch)
    for i, name in ((1, "classification"), (2, "evidence_tier"), (3, "review_recommended"), (4, "__lead")):
        a = a.withColumn(name, cascade([(c("__branch") == b[0], b[i]) for b in ORIGIN_BRANCHES]))
    in_review = c("__branch") == "review"
    more = codes(
        (in_review & c("unstable"), "TRANSFORM_SENSITIVE_SIGNAL_RETAINS_REVIEW_ONLY"),
        (in_review & (c("families") < th.min_families), "INDEPENDENT_EVIDENCE_FAMILY_CORROBORATION_REQUIRED"),
        (in_review & incomplete, "DEPLOYMENT_CALIBRATION_INCOMPLETE"),
        (c("members") == 1, "SINGLE_DETECTOR_LIMITATION"),
        (c("families") == 1, "SINGLE_EVIDENCE_FAMILY_LIMITATION"),
        (c("observed_families") > c("families"), "UNVERIFIED_EVIDENCE_FAMILY_DECLARATIONS_EXCLUDED"),
    )
    return a.withColumn(
        "reason_codes", F.concat_ws("|", c("__lead"), F.nullif(joined(more), F.lit("")))
    ).drop("__branch", "__lead")


def origin_scorecard(assets: DataFrame, th: OriginThresholds = OriginThresholds()) -> DataFrame:
    """Signal strength and evidence quality, two separate 0-100 readings (half-even rounding)."""
    c = F.col
    whole = lambda x: F.bround(x, 0)
    asserted = c("trusted") | c("untrusted")
    sources = (
        _true(c("fused_score") >= th.review).cast("int") + c("marker_supported").cast("int") + asserted.cast("int")
    )
    signal = F.coalesce(
        F.greatest(
            whole(100.0 * c("fused_score")),
            F.when(c("marker_supported"), whole(100.0 * unit(c("marker_strength")))),
            cascade([(c("trusted"), 100.0), (c("untrusted"), 82.0)]),
        ),
        F.lit(0.0),
    )
    score = F.least(F.lit(100.0), whole(signal + F.when(sources >= 2, 5.0).otherwise(F.lit(0.0))))
    model_quality = whole(
        100.0
        * (
            0.35 * F.least(c("families") / float(th.min_families), F.lit(1.0))
            + 0.35 * F.coalesce(ratio(c("calibrated_families"), c("families")), F.lit(0.0))
            + 0.30 * F.coalesce(unit(c("stability")), F.lit(0.0))
        )
    )
    marker_quality = F.when(
        c("marker_supported"), F.least(F.lit(55.0), whole(35.0 + 20.0 * _zero(c("marker_confidence"))))
    ).otherwise(F.lit(0.0))
    provenance_quality = cascade([(c("trusted"), 100.0), (c("untrusted"), 55.0)], 0.0)
    quality = F.least(
        F.lit(100.0),
        F.greatest(model_quality, marker_quality, provenance_quality) + F.when(sources >= 2, 6.0).otherwise(F.lit(0.0)),
    )
    out = assets.withColumn("signal_score", score.cast("bigint")).withColumn("quality_score", quality.cast("bigint"))
    return out.withColumn(
        "signal_label",
        cascade(
            [
                (c("signal_score") >= 80, "Strong AI signal"),
                (c("signal_score") >= 58, "AI signal found"),
                (c("signal_score") >= 35, "Weak AI signal"),
            ],
            "Little AI signal found",
        ),
    ).withColumn(
        "quality_label", cascade([(c("quality_score") >= 80, "High"), (c("quality_score") >= 50, "Medium")], "Low")
    )


def retention_ratio(score: Column, original: Column) -> Column:
    return score / F.greatest(F.coalesce(original, score), F.lit(1e-6))


def retention_state(ratio_: Column) -> Column:
    return cascade([(ratio_ >= 0.85, "SURVIVED"), (ratio_ >= 0.50, "MODERATE")], "DEGRADED")


def forensic_indicators(views: DataFrame, members: DataFrame, th: OriginThresholds = OriginThresholds()) -> DataFrame:
    """Per view: spatial hot spots, and how much of the original signal each transform kept."""
    base = members.select("asset_id", "provider_no", F.col("original_score").alias("__o"))
    v = views.where("not (scope = 'DELIVERY_TRANSFORM' and view_no = 0)").join(base, ["asset_id", "provider_no"], "left")
    spatial = F.col("scope") == "SPATIAL_CROP"
    kept = retention_ratio(F.col("score"), F.col("__o"))
    return v.select(
        "asset_id", "provider_no", "view_no", "scope",
        r6(F.col("score")).alias("score"),
        F.when(spatial, F.col("score") >= th.review).alias("is_hotspot"),
        F.when(~spatial, r6(unit(kept))).alias("retention_ratio"),
        F.when(~spatial, retention_state(kept)).alias("retention_state"),
    )


def ranked_cues(scores_map: Column) -> Column:
    """Map entries as an array, score descending, then name."""
    entries = F.transform(
        F.map_entries(scores_map), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("name"))
    )
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["name"].alias("name"), (-e["neg"]).alias("score")))
