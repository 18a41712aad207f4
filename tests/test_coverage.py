"""The six states of coverage, each from what a scan declared and what was recorded."""

import pytest

from evidlake.operators import coverage

ROWS = "scan_id bigint, ref_id bigint, is_candidate boolean, is_verified boolean, failure string, learned_state string"
SCANS = "scan_id bigint, declared_total bigint, query_state string, requirement string"
OK, SEEN, LISTED = (True, True, None, "EXECUTED"), (True, False, None, "EXECUTED"), (False, False, None, "EXECUTED")


@pytest.mark.parametrize(
    ("rows", "declared", "state", "required", "status", "reasons"),
    [
        ([], 0, "EXECUTED", False, "EMPTY_SCOPE", "DECLARED_CATALOG_EMPTY"),
        ([], 0, "UNAVAILABLE", True, "EMPTY_SCOPE", "DECLARED_CATALOG_EMPTY|REQUIRED_LEARNED_RETRIEVAL_INCOMPLETE"),
        ([OK], 1, "EXECUTED", True, "COMPLETE", ""),
        ([OK, SEEN], 2, "EXECUTED", False, "PARTIAL", "CANDIDATE_VERIFICATION_PARTIAL"),
        ([(True, False, "VERIFICATION", "EXECUTED")], 1, "EXECUTED", False, "FAILED", "CANDIDATE_VERIFICATION_FAILURE"),
        ([OK, (True, False, "VERIFICATION", "EXECUTED")], 2, "EXECUTED", False, "PARTIAL", "CANDIDATE_VERIFICATION_FAILURE"),
        ([OK, LISTED], 2, "EXECUTED", False, "TRUNCATED", "CANDIDATE_VERIFICATION_TRUNCATED"),
        ([(True, True, None, "UNAVAILABLE")], 1, "UNAVAILABLE", True, "DEGRADED", "REQUIRED_LEARNED_RETRIEVAL_INCOMPLETE"),
        ([(True, True, None, "UNAVAILABLE")], 1, "UNAVAILABLE", False, "COMPLETE", ""),
        ([OK, (True, True, "REFERENCE", "EXECUTED")], 2, "EXECUTED", True, "DEGRADED", "REQUIRED_LEARNED_RETRIEVAL_INCOMPLETE"),
        ([OK], 2, "EXECUTED", False, "FAILED", "COVERAGE_MANIFEST_INCONSISTENT|CANDIDATE_VERIFICATION_TRUNCATED"),
        ([OK, (True, True, "ASSET", "EXECUTED")], 2, "EXECUTED", False, "FAILED", "CANDIDATE_VERIFICATION_FAILURE"),
        ([OK, (False, True, None, "EXECUTED")], 2, "EXECUTED", False, "FAILED", "COVERAGE_MANIFEST_INCONSISTENT|CANDIDATE_VERIFICATION_TRUNCATED"),
    ],
)
def test_states(spark, rows, declared, state, required, status, reasons):
    frame = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], ROWS)
    scans = spark.createDataFrame([(1, declared, state, "LEARNED_REQUIRED" if required else "BASELINE_ALLOWED")], SCANS)
    got = coverage.coverage_snapshot(frame, scans).first()
    assert (got.coverage_status, got.reason_codes) == (status, reasons)


def test_digests_tell_membership_from_outcome(spark):
    scans = spark.createDataFrame([(i, 1, "EXECUTED", "BASELINE_ALLOWED") for i in (1, 2)], SCANS)
    rows = spark.createDataFrame([(1, 7, *OK), (2, 7, True, True, None, "UNAVAILABLE")], ROWS)
    a, b = coverage.coverage_snapshot(rows, scans).collect()
    assert a.catalog_digest == b.catalog_digest and a.snapshot_digest != b.snapshot_digest
