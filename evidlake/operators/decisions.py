"""Policy, triage and lane decisions as ordered column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.functions.digest import canonical_digest
from evidlake.functions.expr import cascade, codes, joined

PASS, REVIEW, BLOCK = "PASS_BY_POLICY", "REVIEW", "BLOCK"
MATCH = "MATCH_FOUND"
NO_MATCH = "NO_MATCH_IN_CHECKED_SOURCES"
# The default policy.
DEFAULT_RULES = {
    "require_complete_coverage": True,
    "require_corroborated_claim": True,
    "block_enabled": False,
    "review_on_missing_facts": True,
    "honor_required_origin_mode": True,
    "escalate_origin": [],
    "escalate_style": [],
}


def _status(name: str) -> Column:
    return F.col("match_status") == name


def baseline_policy(scans: DataFrame) -> DataFrame:
    """What the evidence alone allows, before any recorded right is read."""
    complete = F.col("coverage_status") == "COMPLETE"
    rules = [
        (_status("SCOPE_INCOMPLETE"), REVIEW, "SCOPE_INCOMPLETE_REQUIRES_REVIEW"),
        (_status("ERROR"), REVIEW, "SCAN_ERROR_REQUIRES_REVIEW"),
        (_status("INCONCLUSIVE"), REVIEW, "VISUAL_EVIDENCE_INCONCLUSIVE"),
        (_status(NO_MATCH), PASS, "NO_MATCH_IN_DECLARED_CATALOG|PASS_IS_POLICY_NOT_COPYRIGHT_CLEARANCE"),
        (~complete, REVIEW, "MATCH_FOUND_WITH_INCOMPLETE_SCOPE_REQUIRES_REVIEW"),
    ]
    return (
        scans.withColumn("baseline_action", cascade([(r[0], r[1]) for r in rules], REVIEW))
        .withColumn("baseline_path", F.lit("NO_LICENSE_INFO"))
        .withColumn(
            "baseline_reasons", cascade([(r[0], r[2]) for r in rules], "MATCH_REQUIRES_PERSISTED_RIGHTS_EVALUATION")
        )
    )


def legacy_policy(scans: DataFrame) -> DataFrame:
    """Work-level policy: needs ``rights_path, claim_state, allowed_uses`` of the matched work (or NULL).

    Where the scope was incomplete, the reasons of ``coverage_reason_codes`` (an array, if there is one) follow the policy's own.
    """
    c = F.col
    none = "NO_LICENSE_INFO"
    known = c("rights_path").isin("EXISTING_LICENSE", "LICENSE_AVAILABLE", "NO_LICENSE_INFO", "DISPUTED")
    path = F.when(known, c("rights_path")).otherwise(F.lit(none))
    rules = [
        (_status("SCOPE_INCOMPLETE"), REVIEW, none, "SCOPE_INCOMPLETE_REQUIRES_REVIEW"),
        (_status("ERROR"), REVIEW, none, "SCAN_ERROR_REQUIRES_REVIEW"),
        (_status("INCONCLUSIVE"), REVIEW, none, "VISUAL_EVIDENCE_INCONCLUSIVE"),
        (_status(NO_MATCH), PASS, none, "NO_MATCH_IN_DECLARED_CATALOG|PASS_IS_POLICY_NOT_COPYRIGHT_CLEARANCE"),
        (c("coverage_status") != "COMPLETE", REVIEW, path, "MATCH_FOUND_WITH_INCOMPLETE_SCOPE_REQUIRES_REVIEW"),
        (c("rights_path").isNull(), REVIEW, none, "MATCH_WITHOUT_RIGHTS_RECORD"),
        (~known, REVIEW, none, "MATCHED_RIGHTS_PATH_INVALID"),
        (c("rights_path") == "DISPUTED", REVIEW, path, "MATCHED_RIGHTS_RECORD_DISPUTED"),
        (c("claim_state") == "ASSERTED", REVIEW, path, "MATCHED_CLAIM_NOT_CORROBORATED"),
        (c("claim_state") == "DISPUTED", REVIEW, path, "MATCHED_CLAIM_DISPUTED"),
        (c("claim_state") == "SUPERSEDED", REVIEW, path, "MATCHED_CLAIM_SUPERSEDED"),
        (c("claim_state") == "REVOKED", REVIEW, path, "MATCHED_CLAIM_REVOKED"),
        (F.coalesce(c("claim_state") != "CORROBORATED", F.lit(True)), REVIEW, path, "MATCHED_CLAIM_STATE_INVALID"),
        (
            (c("rights_path") == "EXISTING_LICENSE") & F.array_contains("allowed_uses", c("intended_use")),
            PASS, path, "MATCHED_USE_ALLOWED_BY_RIGHTS_RECORD",
        ),
        (c("rights_path") == "LICENSE_AVAILABLE", REVIEW, path, "LICENSE_PATH_AVAILABLE_REVIEW_REQUIRED"),
    ]
    pick = lambda i, default: cascade([(r[0], r[i]) for r in rules], default)
    reasons = pick(3, "MATCH_REQUIRES_RIGHTS_REVIEW")
    if "coverage_reason_codes" in scans.columns:
        scoped = reasons.isin("SCOPE_INCOMPLETE_REQUIRES_REVIEW", "MATCH_FOUND_WITH_INCOMPLETE_SCOPE_REQUIRES_REVIEW")
        why = F.when(scoped & (F.size("coverage_reason_codes") > 0), joined(c("coverage_reason_codes")))
        reasons = F.concat_ws("|", reasons, why)
    return (
        scans.withColumn("policy_action", pick(1, REVIEW))
        .withColumn("policy_path", pick(2, path))
        .withColumn("reason_codes", reasons)
    )


NOTICE = "Evidence within the sources that were checked, and a policy recommendation: no legal finding of infringement."


def completed_payload(scans: DataFrame) -> DataFrame:
    """``scan_id, payload``: the summary sent when a scan is completed, as JSON of nineteen fields.

    Needs the scan's own columns (``scan_id, tenant_id, catalog_id, intended_use, match_status, policy_action, rights_path,
    reason_codes, anchor_status, completed_at``), its coverage (``coverage_status``), the proof of its packet (``proof_provider,
    packet_hash``), its statement (``statement_id, statement_digest``) and ``review_case_id``; all but the ids may be NULL and then
    are ``null``, an unknown coverage is not complete, and unknown reasons are none.
    """
    c = F.col
    fields = [
        F.lit("evidlake.scan_completed.v1").alias("schema"), "scan_id", "tenant_id", "catalog_id", "intended_use", "match_status", "policy_action",
        "rights_path", F.coalesce("reason_codes", F.array().cast("array<string>")).alias("reason_codes"), "coverage_status",
        c("coverage_status").eqNullSafe("COMPLETE").alias("coverage_complete"), "anchor_status", "proof_provider",
        c("packet_hash").alias("packet_hash_sha256"), "statement_id", c("statement_digest").alias("statement_digest_sha256"), "review_case_id",
        F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("completed_at"), F.lit(NOTICE).alias("notice"),
    ]
    return scans.select("scan_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def rules_struct(name: str, rules: dict | None = None) -> Column:
    merged = {**DEFAULT_RULES, **(rules or {})}
    fields = [F.lit(name).alias("policy")]
    for key, value in merged.items():
        if isinstance(value, list):
            fields.append(F.array(*[F.lit(v) for v in value]).cast("array<string>").alias(key))
        else:
            fields.append(F.lit(value).alias(key))
    return F.struct(*fields)


def evaluate_policy(scans: DataFrame) -> DataFrame:
    """Apply the rules in column ``rules`` to scans joined with their rights facts.

    Needs the columns of ``baseline_policy`` and ``rights.rights_facts`` plus ``origin_class, style_tier,
    origin_mode, style_review``. Each rule can only move the action, so the action is a chain of columns.
    """
    c = F.col
    rule = lambda name: c(f"rules.{name}")
    found, complete = _status(MATCH), c("coverage_status") == "COMPLETE"
    n = lambda x: F.coalesce(c(x), F.lit(0).cast("bigint"))
    arr = lambda x: F.coalesce(c(x), F.array().cast("array<string>"))
    unrecorded = c("claims").isNull()
    unmatched = c("work_id").isNull() if "work_id" in scans.columns else F.lit(False)
    s = scans.withColumn("__blocking", arr("blocking")).withColumn(
        "__missing",
        F.when(unmatched, F.array(F.lit("NO_MATCHED_WORK")))
        .when(unrecorded, F.array(F.lit("NO_RECORDED_CLAIM"), F.lit("NO_RECORDED_LICENSE")))
        .otherwise(arr("missing")),
    )
    blocked = F.size("__blocking") > 0
    eligible = F.when(rule("require_corroborated_claim"), n("strong")).otherwise(n("scope")) > 0
    passing = c("__action") == PASS
    unclaimed = F.array_contains("__missing", "NO_CORROBORATED_CLAIM")
    has_origin = c("origin_class").isNotNull()
    required = F.coalesce(rule("honor_required_origin_mode") & (c("origin_mode") == "REQUIRED"), F.lit(False))
    quiet = c("origin_class") == "NO_AI_ORIGIN_EVIDENCE_DETECTED"
    esc_origin = F.coalesce(F.array_contains(rule("escalate_origin"), c("origin_class")), F.lit(False))
    esc_style = F.coalesce(F.array_contains(rule("escalate_style"), c("style_tier")), F.lit(False))
    steps = [
        ("persisted", found & complete & eligible, PASS, True),
        ("unpersisted", found & ~(complete & eligible), REVIEW, True),
        ("terminal", blocked & passing, REVIEW, False),
        ("incomplete", rule("require_complete_coverage") & ~complete & passing & ~_status(NO_MATCH), REVIEW, False),
        ("unclaimed", rule("require_corroborated_claim") & found & passing & unclaimed, REVIEW, False),
        ("origin", esc_origin & passing, REVIEW, False),
        ("style", esc_style & passing, REVIEW, False),
        ("required", required & has_origin & ~quiet & passing, REVIEW, False),
        ("block", rule("block_enabled") & found & complete & blocked, BLOCK, False),
        ("missing", rule("review_on_missing_facts") & (F.size("__missing") > 0) & passing & found, REVIEW, False),
    ]
    s = s.withColumn("__action", c("baseline_action"))
    for name, test, action, _ in steps:
        s = s.withColumn(f"__did_{name}", F.coalesce(test, F.lit(False))).withColumn(
            "__action", F.when(c(f"__did_{name}"), action).otherwise(c("__action"))
        )
    hit = lambda name: c(f"__did_{name}")
    matched = codes(
        (found, "persisted_rights_facts_are_authoritative"),
        (blocked, "terminal_rights_state_cannot_authorize"),
        (rule("require_complete_coverage") & ~complete, "require_complete_coverage_for_pass"),
        (hit("unclaimed"), "require_corroborated_claim_for_pass"),
        (esc_origin, "escalate_on.ai_origin_classification"),
        (esc_style, "escalate_on.creator_profile_tier"),
        (required & has_origin, "honor_required_origin_policy_mode"),
        (hit("block"), "block_enabled"),
        (rule("review_on_missing_facts") & (F.size("__missing") > 0), "review_on_missing_facts"),
    )
    own = codes(
        (hit("persisted"), "PERSISTED_LICENSE_PERMITS_INTENDED_USE"),
        (hit("unpersisted"), "MATCH_WITHOUT_AUTHORIZING_PERSISTED_LICENSE"),
        (hit("incomplete"), "INCOMPLETE_COVERAGE_BLOCKS_PASS"),
        (hit("unclaimed"), "MATCH_WITHOUT_CORROBORATED_CLAIM"),
        (hit("origin"), "AI_ORIGIN_CLASSIFICATION_ESCALATED_BY_POLICY"),
        (hit("style"), "CREATOR_PROFILE_RESEMBLANCE_ESCALATED_BY_POLICY"),
        (hit("required"), "AI_ORIGIN_RESULT_REQUIRES_PRODUCT_REVIEW"),
        (hit("required"), "AI_ORIGIN_REVIEW_IS_NOT_INFRINGEMENT_FINDING"),
        (~required & has_origin & (c("origin_mode") == "DISABLED"), "AI_ORIGIN_CHECK_DISABLED_BY_POLICY"),
        (~required & has_origin & (c("origin_mode") != "DISABLED"), "AI_ORIGIN_INFORMATIONAL_ONLY"),
        (c("style_review") & ~found, "STYLE_SIGNAL_NOT_AUTO_ESCALATED_WITHOUT_AI_ORIGIN_SUPPORT"),
        (hit("block"), "BLOCKED_BY_TENANT_POLICY_ON_TERMINAL_RIGHTS_STATE"),
    )
    empty = F.array().cast("array<string>")
    recorded = F.when(hit("unpersisted"), F.concat(arr("claim_reasons"), arr("license_reasons"))).otherwise(empty)
    reasons = F.array_sort(
        F.array_distinct(F.concat(F.split("baseline_reasons", r"\|"), own, c("__blocking"), recorded))
    )
    s = s.withColumn("policy_action", c("__action")).withColumn("matched_rules", joined(matched)).withColumn(
        "reason_codes", joined(reasons)
    ).withColumn(
        "rights_path",
        F.when(found, F.coalesce("derived_path", F.lit("NO_LICENSE_INFO"))).otherwise(c("baseline_path")),
    )
    return s.drop("__action", "__blocking", "__missing", *[f"__did_{x[0]}" for x in steps])


def policy_dry_run(scans: DataFrame, policies: list[Column]) -> DataFrame:
    """Recorded scans under other policy versions (a short list), flagging decisions that differ."""
    out = evaluate_policy(scans.withColumn("rules", F.explode(F.array(*policies))))
    return out.withColumn("differs", F.col("policy_action") != F.col("recorded_action"))


def overlay_policy(df: DataFrame) -> DataFrame:
    """Effect of origin and style results on an action, by origin mode.

    Needs ``match_status, action, origin_class, origin_mode, style_tier, style_review``.
    """
    c = F.col
    required = c("origin_mode") == "REQUIRED"
    has = c("origin_class").isNotNull()
    passing = c("action") == PASS
    strong = F.coalesce(
        c("origin_class").isin(
            "AI_PROVENANCE_CONFIRMED", "AI_PROVENANCE_ASSERTED_UNTRUSTED_SIGNER", "LIKELY_AI_GENERATED",
            "AI_INDICATORS_CORROBORATED", "AI_ORIGIN_MARKER_FOUND",
        ),
        F.lit(False),
    )
    joint = strong | F.coalesce(
        (c("origin_class") == "AI_ORIGIN_REVIEW_CANDIDATE") & c("style_tier").isin("HIGH", "VERY_HIGH"), F.lit(False)
    )
    loud = has & F.coalesce(c("origin_class") != "NO_AI_ORIGIN_EVIDENCE_DETECTED", F.lit(False))
    both = required & c("style_review") & joint & passing
    only = required & ~both & loud & passing
    reasons = codes(
        (~required & has & (c("origin_mode") == "DISABLED"), "AI_ORIGIN_CHECK_DISABLED_BY_POLICY"),
        (~required & has & (c("origin_mode") != "DISABLED"), "AI_ORIGIN_INFORMATIONAL_ONLY"),
        (both, "AI_ORIGIN_AND_STYLE_RESEMBLANCE_REVIEW_RECOMMENDED"),
        (both, "STYLE_REVIEW_IS_NOT_COPY_OR_INFRINGEMENT_FINDING"),
        (only, "AI_ORIGIN_RESULT_REQUIRES_PRODUCT_REVIEW"),
        (only, "AI_ORIGIN_REVIEW_IS_NOT_INFRINGEMENT_FINDING"),
        (
            c("style_review") & ~_status(MATCH) & (~required | (~both & ~only & ~joint)),
            "STYLE_SIGNAL_NOT_AUTO_ESCALATED_WITHOUT_AI_ORIGIN_SUPPORT",
        ),
    )
    return df.withColumn("added_reasons", joined(reasons)).withColumn(
        "overlaid_action", F.when(both | only, REVIEW).otherwise(c("action"))
    )


def joint_risk(df: DataFrame) -> DataFrame:
    """Triage class and case action. Needs ``match_status, action, origin_class, origin_review, style_tier``."""
    c = F.col
    found = _status(MATCH)
    ai = F.coalesce(
        c("origin_class").isin("AI_PROVENANCE_CONFIRMED", "LIKELY_AI_GENERATED", "AI_INDICATORS_CORROBORATED"), F.lit(False)
    )
    style = F.coalesce(c("style_tier").isin("HIGH", "VERY_HIGH"), F.lit(False))
    rev = F.coalesce(c("origin_review"), F.lit(False))
    # Class and case action of each branch, in order.
    rules = [
        (_status("SCOPE_INCOMPLETE"), "SOURCE_SCOPE_INCOMPLETE", "REVIEW_SCOPE"),
        (found & ai, "AI_ASSISTED_COPY_EVIDENCE", "REVIEW_RIGHTS_AND_ORIGIN"),
        (found & rev, "COPY_EVIDENCE_ORIGIN_REVIEW", "REVIEW_RIGHTS_AND_ORIGIN"),
        (~found & ai & style, "AI_STYLE_RESEMBLANCE_REVIEW", "REVIEW_STYLE_AND_ORIGIN"),
        (~found & ai, "AI_INDICATORS_WITHOUT_RIGHTS_MATCH", "REVIEW_ORIGIN"),
        (found, "COPY_EVIDENCE_ORIGIN_UNRESOLVED", "REVIEW_COPY_RIGHTS"),
        (rev & style, "ORIGIN_AND_STYLE_REVIEW", "REVIEW_STYLE_AND_ORIGIN"),
        (rev, "AI_ORIGIN_REVIEW_WITHOUT_RIGHTS_MATCH", "REVIEW_ORIGIN"),
        (style, "STYLE_RESEMBLANCE_ORIGIN_UNRESOLVED", "REVIEW_STYLE"),
        (c("origin_class") == "NO_AI_ORIGIN_EVIDENCE_DETECTED", "NO_STRONG_AI_SIGNAL_OR_RIGHTS_MATCH", "RECORD_AND_CONTINUE"),
        (c("origin_class") == "AI_ORIGIN_CHECK_DISABLED", "AI_CHECK_DISABLED_WITHOUT_RIGHTS_MATCH", "RECORD_AND_CONTINUE"),
        (c("origin_class") == "SYNTHETIC_ORIGIN_ANALYSIS_UNAVAILABLE", "AI_CHECK_UNAVAILABLE_WITHOUT_RIGHTS_MATCH", "ACTIVATE_AI_CHECKS"),
    ]
    case = cascade([(r[0], r[2]) for r in rules], "REVIEW_ORIGIN")
    return df.withColumn(
        "risk_class", cascade([(r[0], r[1]) for r in rules], "ORIGIN_UNKNOWN_WITHOUT_RIGHTS_MATCH")
    ).withColumn("case_action", F.when(c("action") == PASS, "RECORD_AND_CONTINUE").otherwise(case))


def review_cases(scans: DataFrame, existing: DataFrame) -> DataFrame:
    """New review cases: one per scan that needs one and has none; blocked scans first."""
    c = F.col
    reason = cascade(
        [
            (c("policy_action").isin(REVIEW, BLOCK), F.concat(F.lit("POLICY_"), c("policy_action"))),
            (c("match_status").isin("SCOPE_INCOMPLETE", "ERROR"), F.concat(F.lit("MATCH_"), c("match_status"))),
        ]
    )
    return (
        scans.withColumn("opened_reason", reason)
        .where("opened_reason is not null")
        .join(existing.select("scan_id"), "scan_id", "left_anti")
        .withColumn("priority", F.when(c("policy_action") == BLOCK, "HIGH").otherwise("NORMAL"))
    )


def policy_trace(df: DataFrame, material: list[str]) -> DataFrame:
    """Digest of everything a decision rested on."""
    return df.withColumn("trace_digest", canonical_digest(material))


def verify_trace(df: DataFrame, material: list[str]) -> DataFrame:
    return df.withColumn("trace_ok", F.coalesce(canonical_digest(material) == F.col("trace_digest"), F.lit(False)))


# -- lanes ---------------------------------------------------------------------------------------
def lane_status(scans: DataFrame) -> DataFrame:
    """State of the four lanes of a scan: hit, review, advisory, clear or unchecked.

    Needs ``match_status, coverage_status, exact, match_supported, review_supported, origin_state,
    style_tier, style_review, rights_path``.
    """
    c = F.col
    yes = lambda x: F.coalesce(c(x), F.lit(False))
    cov = F.coalesce(c("coverage_status"), F.lit("UNKNOWN"))
    copy = cascade(
        [
            ((cov == "EMPTY_SCOPE") | c("match_status").isin("SCOPE_INCOMPLETE", "ERROR"), "unchecked"),
            (yes("exact") | yes("match_supported") | _status(MATCH), "hit"),
            (yes("review_supported") | _status("INCONCLUSIVE"), "review"),
            (~cov.isin("COMPLETE", "UNKNOWN"), "unchecked"),
        ],
        "clear",
    )
    origin = cascade(
        [
            (c("origin_state").isNull() | c("origin_state").isin("ORIGIN_UNKNOWN", "CHECK_UNAVAILABLE"), "unchecked"),
            (c("origin_state").isin("AI_CONFIRMED", "AI_INDICATORS_FOUND"), "hit"),
            (c("origin_state") == "AI_INDICATORS_NEED_REVIEW", "review"),
        ],
        "clear",
    )
    profile = cascade(
        [
            (c("style_tier").isNull(), "unchecked"),
            (c("style_tier").isin("VERY_HIGH", "HIGH") | yes("style_review"), "advisory"),
        ],
        "clear",
    )
    rights = F.when(F.coalesce(c("rights_path"), F.lit("NO_LICENSE_INFO")) == "EXISTING_LICENSE", "clear").otherwise("advisory")
    return (
        scans.withColumn("copy_lane", copy)
        .withColumn("origin_lane", origin)
        .withColumn("profile_lane", profile)
        .withColumn("rights_lane", rights)
    )


def lane_metric(value: Column, state: Column, uncalibrated: Column) -> tuple[Column, Column]:
    """Gauge value and withheld note: no value for an unchecked lane, and none for an uncalibrated index
    that found nothing. Never measured is NULL, not zero."""
    hide = uncalibrated & state.isin("clear", "advisory") & value.isNotNull()
    shown = F.when((state == "unchecked") | hide, F.lit(None).cast("double")).otherwise(value)
    note = F.when((state != "unchecked") & hide, "uncalibrated for this catalog")
    return shown, note


# Lane names inside a sentence.
LANE_NOUNS = [("copy", "stored-work copy"), ("origin", "AI origin"), ("profile", "creator profile"), ("rights", "recorded rights")]


def findings_line() -> Column:
    """One line naming the lanes that found or need something; NULL when none did."""
    clauses = []
    for lane, noun in LANE_NOUNS:
        state = F.col(f"{lane}_lane")
        clauses.append(F.when(state == "hit", f"{noun} found evidence").when(state == "review", f"{noun} needs review"))
    line = F.concat_ws("; ", *clauses)
    return F.when(line != "", F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, 2, 1_000_000)))
