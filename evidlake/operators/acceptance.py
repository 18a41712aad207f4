"""Acceptance gates, report consistency, eligibility, registry identity and calibration joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.functions.expr import cascade, codes, joined
from evidlake.operators.evaluation import gate_passes, platt


def gate_results(reports: DataFrame, gates: list[tuple[str, str, str, float]]) -> DataFrame:
    """Each report against each gate of its policy. Gates are a short policy list, unrolled per report."""
    rows = F.array(
        *[
            F.struct(
                F.lit(g).alias("gate_id"), F.lit(m).alias("metric"), F.lit(op).alias("op"), F.lit(v).alias("expected"),
                F.try_element_at("metrics", F.lit(m)).alias("actual"),
            )
            for g, m, op, v in gates
        ]
    )
    out = reports.withColumn("g", F.explode(rows)).select("*", "g.*").drop("g")
    out = out.withColumn("passed", gate_passes(F.col("actual"), F.col("op"), F.col("expected")))
    return out.withColumn(
        "reason_code",
        cascade(
            [
                (F.col("passed"), F.lit(None).cast("string")),
                (F.col("actual").isNull(), "ACCEPTANCE_METRIC_MISSING"),
            ],
            "ACCEPTANCE_GATE_FAILED",
        ),
    )


def acceptance(
    reports: DataFrame, gates: list, policy: dict, external: dict[str, str]
) -> DataFrame:
    """Recommendation per report: every gate, identity, domain, eligibility and outside evidence."""
    results = gate_results(reports, gates)
    c = F.col
    failed = F.collect_set(F.when(~c("passed"), F.concat(F.lit("METRIC_GATE_FAILED:"), c("gate_id"))))
    rows = results.groupBy("report_id").agg(
        F.every("passed").alias("metrics_passed"),
        failed.alias("failed"),
        F.first("bundle_id").alias("bundle_id"),
        F.first("domain_id").alias("domain_id"),
        F.first("evaluation_eligible").alias("evaluation_eligible"),
    )
    open_gates = [g for g in policy["external_gates"] if not str(external.get(g) or "").strip()]
    other = codes(
        (c("bundle_id") != policy["bundle_id"], "MODEL_BUNDLE_ID_MISMATCH"),
        (c("domain_id") != policy["domain_id"], "DECLARED_DOMAIN_MISMATCH"),
        (~c("evaluation_eligible"), "REPORT_NOT_EVALUATION_ELIGIBLE"),
        (F.lit(not policy["ratified"]), "ACCEPTANCE_POLICY_NOT_RATIFIED_BEFORE_FINAL_TEST"),
        *[(F.lit(True), f"EXTERNAL_GATE_UNRESOLVED:{g}") for g in open_gates],
    )
    reasons = F.array_sort(F.array_distinct(F.concat(c("failed"), other)))
    return rows.withColumn("__r", reasons).select(
        "report_id",
        "metrics_passed",
        F.when(F.size("__r") == 0, "METRIC_AND_EXTERNAL_GATES_PASSED_REQUIRES_HUMAN_PROMOTION_RECORD")
        .otherwise("DO_NOT_PROMOTE")
        .alias("recommendation"),
        joined(c("__r")).alias("reason_codes"),
    )


def validate_reports(reports: DataFrame) -> DataFrame:
    """Cross-field contradictions of recorded reports, digest recomputed from the material."""
    c = F.col
    promoted = c("promotion_state") == "PROMOTED_FOR_DECLARED_DOMAIN"
    found = codes(
        (c("grade") == "", "EVALUATION_GRADE_REQUIRED"),
        ((c("grade") == "SMOKE_TEST_ONLY") & c("evaluation_eligible"), "SMOKE_TEST_CANNOT_BE_ELIGIBLE"),
        (c("evaluation_eligible") & ~c("corpus_eligible"), "EVALUATION_WITHOUT_ELIGIBLE_CORPUS"),
        (c("promotion_eligible") != promoted, "PROMOTION_FIELDS_DISAGREE"),
        (promoted & ~c("evaluation_eligible"), "PROMOTION_WITHOUT_ELIGIBLE_EVALUATION"),
        (F.sha2("prediction_material", 256) != c("prediction_digest"), "PREDICTION_DIGEST_MISMATCH"),
    )
    return reports.withColumn("violations", found)


def eligibility(
    preds: DataFrame, by: str, cluster: str, min_pos: int, min_neg: int, min_clusters: int
) -> DataFrame:
    """Whether a benchmark has enough positives, negatives and independent clusters."""
    counts = preds.groupBy(by).agg(
        F.sum("label").cast("bigint").alias("positives"),
        F.sum(1 - F.col("label")).cast("bigint").alias("negatives"),
        F.count_distinct(cluster).alias("clusters"),
    )
    reasons = codes(
        (F.col("positives") < min_pos, "INSUFFICIENT_POSITIVES"),
        (F.col("negatives") < min_neg, "INSUFFICIENT_NEGATIVES"),
        (F.col("clusters") < min_clusters, "INSUFFICIENT_CLUSTERS"),
    )
    return counts.withColumn("reasons", joined(reasons)).withColumn("eligible", F.col("reasons") == "")


def govern(scores: DataFrame, registry: DataFrame, provider: str, identity: list[str]) -> DataFrame:
    """Detector rows against the approved registry; unapproved rows stay visible, but unverified."""
    reg = registry.select(provider, F.lit(True).alias("__known"), *[F.col(c).alias(f"__{c}") for c in identity])
    out = scores.join(reg, provider, "left")
    wrong = codes(*[(~F.col(c).eqNullSafe(F.col(f"__{c}")), c) for c in identity])
    known = F.coalesce("__known", F.lit(False))
    out = out.withColumn("mismatched", F.when(known, joined(wrong, ",")).otherwise(F.lit("")))
    return (
        out.withColumn("verified", known & (F.col("mismatched") == ""))
        .withColumn(
            "warning",
            cascade(
                [
                    (~known, "EVIDENCE_FAMILY_NOT_REGISTRY_APPROVED"),
                    (F.col("mismatched") != "", "EVIDENCE_FAMILY_REGISTRY_IDENTITY_MISMATCH"),
                ]
            ),
        )
        .drop("__known", *[f"__{c}" for c in identity])
    )


def apply_calibration(scores: DataFrame, params: DataFrame, provider: str, context: list[str]) -> DataFrame:
    """Calibrated score only where provider, version and context all match; else the raw score and why."""
    p = params.select(
        provider, "slope", "intercept", F.col("model_version").alias("__mv"), *[F.col(c).alias(f"__{c}") for c in context]
    )
    out = scores.join(p, provider, "left")
    differs = F.lit(False)
    for c in context:
        differs = differs | (F.col(f"__{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"__{c}")))
    state = cascade(
        [
            (F.col("slope").isNull(), "NOT_AVAILABLE_FOR_PROVIDER"),
            (F.col("__mv") != F.col("model_version"), "MODEL_VERSION_MISMATCH"),
            (differs, "CALIBRATION_CONTEXT_MISMATCH"),
        ],
        "HELD_OUT_PLATT_CALIBRATION",
    )
    return (
        out.withColumn("state", state)
        .withColumn(
            "calibrated_score",
            F.when(
                F.col("state") == "HELD_OUT_PLATT_CALIBRATION",
                platt(F.col("score"), F.col("slope"), F.col("intercept")),
            ).otherwise(F.col("score")),
        )
        .drop("__mv", *[f"__{c}" for c in context])
    )
