"""States of the five signals of a copy decision, and structure that was not available."""

import pytest

from evidlake.operators import fusion

COLUMNS = (
    "exact boolean, ai double, phash double, structure double, structure_available boolean, validated boolean, inliers double, inlier_ratio double, "
    "query_coverage double, reference_coverage double, symmetric_error double, alignment_grade string, reflected boolean"
)
STRONG = dict(
    exact=False, ai=0.9, phash=0.9, structure=0.9, structure_available=True, validated=True, inliers=80.0, inlier_ratio=0.95, query_coverage=0.5,
    reference_coverage=0.5, symmetric_error=0.01, alignment_grade="STRICT", reflected=False,
)


@pytest.mark.parametrize(
    ("change", "states", "match"),
    [
        ({}, ("DIFFERENT_BYTES", "SUPPORT", "SUPPORT", "VERIFIED", "STRONG"), True),
        ({"exact": True, "ai": None}, ("EXACT", "CORROBORATING", "CORROBORATING", "NOT_REQUIRED_FOR_EXACT_HASH", "NOT_REQUIRED_FOR_EXACT_HASH"), True),
        ({"ai": None, "phash": 0.5}, ("DIFFERENT_BYTES", "UNAVAILABLE", "WEAK", "VERIFIED", "STRONG"), True),
        ({"ai": 0.1, "structure": 0.3}, ("DIFFERENT_BYTES", "WEAK", "SUPPORT", "VERIFIED", "MEASURED_WEAK"), False),
        ({"structure_available": False}, ("DIFFERENT_BYTES", "SUPPORT", "SUPPORT", "VERIFIED", "UNAVAILABLE_WITHOUT_GEOMETRY"), False),
        ({"structure": None}, ("DIFFERENT_BYTES", "SUPPORT", "SUPPORT", "VERIFIED", "UNAVAILABLE_WITHOUT_GEOMETRY"), False),
        ({"validated": False}, ("DIFFERENT_BYTES", "SUPPORT", "SUPPORT", "REJECTED", "STRONG"), False),
        (
            {"validated": False, "alignment_grade": "CORROBORATION_REQUIRED"},
            ("DIFFERENT_BYTES", "SUPPORT", "SUPPORT", "RECOVERED_PENDING_PIXEL_AGREEMENT", "STRONG"), True,
        ),
    ],
)
def test_signal_states(spark, change, states, match):
    got = fusion.fuse_copy(spark.createDataFrame([tuple((STRONG | change).values())], COLUMNS)).first()
    assert (got.sha256_state, got.retrieval_state, got.phash_state, got.geometry_state, got.structure_state) == states
    assert got.match_supported == match
    if not change.get("structure_available", True):
        assert "ALIGNED_STRUCTURE_CORROBORATES" not in got.reason_codes
