"""Rights that fail closed: prohibitions, unverified rows, ended claims, and the sweep against all pairs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from evidlake.operators import decisions, ledger, rights
from evidlake.plans.rights import gated_rights
from evidlake.sources.tables import Tables

NOW = datetime.datetime(2024, 6, 1)
DAY = datetime.timedelta(days=1)
CLAIM = "claim_id bigint, work_id bigint, state string, effective_from timestamp, effective_until timestamp, verified boolean, integrity_code string"
LICENSE = (
    "license_id bigint, claim_id bigint, work_id bigint, version bigint, state string, permitted_uses array<string>, prohibited_uses array<string>, "
    "effective_from timestamp, effective_until timestamp, verified boolean, integrity_code string"
)
GOOD_CLAIM = dict(claim_id=1, work_id=7, state="CORROBORATED", effective_from=NOW - DAY, effective_until=None, verified=True, integrity_code=None)
GOOD_LICENSE = dict(
    license_id=5, claim_id=1, work_id=7, version=1, state="ACTIVE", permitted_uses=["ads"], prohibited_uses=[], effective_from=NOW - DAY,
    effective_until=NOW + DAY, verified=True, integrity_code=None,
)


def facts(spark, claim=None, license_=None):
    c = spark.createDataFrame([tuple((GOOD_CLAIM | (claim or {})).values())], CLAIM)
    row = license_ if isinstance(license_, list) else [GOOD_LICENSE | (license_ or {})]
    lic = spark.createDataFrame([tuple(r.values()) for r in row], LICENSE)
    return rights.rights_facts(c, lic, ["ads"], F.lit(NOW))


def verdict(spark, **kw):
    """The action for a complete match whose baseline is a review."""
    scan = spark.createDataFrame(
        [(1, 7, "MATCH_FOUND", "COMPLETE", "ads", None, "LOW", "DISABLED", False)],
        "scan_id bigint, work_id bigint, match_status string, coverage_status string, intended_use string, origin_class string, style_tier string, origin_mode string, style_review boolean",
    )
    known = facts(spark, **kw).drop("intended_use")
    scan = decisions.baseline_policy(scan).join(known, "work_id").withColumn("rules", decisions.rules_struct("default"))
    return decisions.evaluate_policy(scan).first()


@pytest.mark.parametrize(
    ("claim", "license_", "reason", "path"),
    [
        ({}, {"prohibited_uses": ["ads"]}, "LICENSE_PROHIBITS_INTENDED_USE", "EXISTING_LICENSE"),
        ({}, {"verified": False, "integrity_code": "LICENSE_PROJECTION_INTEGRITY_MISMATCH"}, "LICENSE_PROJECTION_INTEGRITY_MISMATCH", "EXISTING_LICENSE"),
        ({"verified": False, "integrity_code": "CLAIM_INTEGRITY_EVENT_MISSING"}, {}, "CLAIM_INTEGRITY_EVENT_MISSING", "EXISTING_LICENSE"),
        ({"effective_until": NOW}, {}, "CLAIM_NO_LONGER_EFFECTIVE", "EXISTING_LICENSE"),
        ({"effective_from": NOW + DAY}, {}, "CLAIM_NOT_YET_EFFECTIVE", "EXISTING_LICENSE"),
        ({"state": "SUPERSEDED"}, {}, "MATCHED_CLAIM_SUPERSEDED", "EXISTING_LICENSE"),
        ({"state": "REVOKED"}, {}, "CLAIM_REVOKED", "EXISTING_LICENSE"),
        ({"state": "DISPUTED"}, {}, "MATCHED_CLAIM_DISPUTED", "DISPUTED"),
        ({"state": "ASSERTED"}, {}, "MATCHED_CLAIM_NOT_CORROBORATED", "EXISTING_LICENSE"),
        ({}, {"claim_id": 99}, "LICENSE_NOT_BOUND_TO_RECORDED_CLAIM", "EXISTING_LICENSE"),
        ({}, {"state": "EXPIRED"}, "LICENSE_EXPIRED", "EXISTING_LICENSE"),
        ({}, {"state": "SUPERSEDED"}, "LICENSE_SUPERSEDED", "EXISTING_LICENSE"),
        ({}, {"state": "SUSPENDED"}, "LICENSE_SUSPENDED", "DISPUTED"),
        ({}, {"effective_until": NOW}, "LICENSE_EXPIRED", "EXISTING_LICENSE"),
        ({}, {"permitted_uses": ["films"]}, "LICENSE_DOES_NOT_LIST_INTENDED_USE", "EXISTING_LICENSE"),
    ],
)
def test_one_flaw_turns_a_pass(spark, claim, license_, reason, path):
    found = facts(spark, claim, license_).first()
    assert not found.authorized and found.authorizing_license_id is None and found.derived_path == path
    assert reason in found.claim_reasons + found.license_reasons
    assert found.claim_reasons == sorted(set(found.claim_reasons)) and found.license_reasons == sorted(set(found.license_reasons))
    out = verdict(spark, claim=claim, license_=license_)
    assert out.policy_action == "REVIEW" and "MATCH_WITHOUT_AUTHORIZING_PERSISTED_LICENSE" in out.reason_codes


def test_a_sound_license_passes_and_the_first_version_is_named(spark):
    found = facts(spark).first()
    assert found.authorized and found.license_reasons == ["LICENSE_PERMITS_INTENDED_USE"] and found.missing == []
    assert verdict(spark).policy_action == "PASS_BY_POLICY"
    rows = [GOOD_LICENSE | {"license_id": 3, "version": 2}, GOOD_LICENSE | {"license_id": 4}, GOOD_LICENSE | {"license_id": 1, "prohibited_uses": ["ads"]}]
    found = facts(spark, license_=rows).first()
    assert found.authorizing_license_id == 4 and found.strong == 2 and found.vetoed == 1
    # A suspended license that fails the gate can't block either.
    odd = GOOD_LICENSE | {"state": "SUSPENDED", "verified": False, "integrity_code": "LICENSE_INTEGRITY_EVENT_MISSING"}
    found = facts(spark, license_=[odd]).first()
    assert found.blocking == [] and found.missing == ["LICENSE_PROJECTION_INTEGRITY_UNVERIFIED"]


def test_gate_fails_closed(spark):
    rows = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (None, 10)], "claim_id bigint, tenant_id bigint")
    verdicts = spark.createDataFrame([(1, True, None), (2, False, "X")], "id bigint, verified boolean, reason_code string")
    got = {r.claim_id: (r.verified, r.integrity_code) for r in rights.gated(rows, verdicts, "claim_id", "claim").collect()}
    assert got == {1: (True, None), 2: (False, "X"), 3: (False, "CLAIM_INTEGRITY_EVENT_MISSING"), None: (False, "CLAIM_INTEGRITY_EVENT_MISSING")}


def test_integrity_checks_in_order(spark):
    good = dict(id=1, event_id=11, at=2, event_type="LICENSE_CREATED", event_tenant=5, subject_type="license", subject_id=1, payload_digest="p", recomputed_digest="p", projection_digest="d")
    cases = [
        ({}, "p", None), ({"event_type": "CLAIM_CREATED", "event_tenant": 6}, "p", "EVENT_TYPE_INVALID"), ({"event_tenant": None, "subject_id": 2}, "p", "TENANT_MISMATCH"),
        ({"subject_type": "claim", "recomputed_digest": "x"}, "p", "SUBJECT_MISMATCH"), ({"recomputed_digest": "x"}, None, "DIGEST_MISMATCH"), ({"projection_digest": None}, "q", "LOG_INCLUSION_MISSING"),
        ({"projection_digest": None}, "p", "PROJECTION_MISSING"),
    ]
    schema = "id bigint, event_id bigint, at bigint, event_type string, event_tenant bigint, subject_type string, subject_id bigint, payload_digest string, recomputed_digest string, projection_digest string"
    rows = spark.createDataFrame([(1, 5, "d")], "id bigint, tenant_id bigint, projection_digest string")
    for change, packet, reason in cases:
        old = good | {"event_id": 12, "at": 1, "projection_digest": "old"}
        events = spark.createDataFrame([tuple((good | change).values()), tuple(old.values())], schema)
        leaves = spark.createDataFrame([(11, packet)], "event_id bigint, packet_hash string")
        got = ledger.projection_integrity(rows, events, leaves, "license").first()
        assert got.reason_code == (reason and f"LICENSE_INTEGRITY_{reason}") and got.verified == (reason is None)


def test_sweep_with_vetoes_matches_pairs(spark):
    rng = random.Random(2)
    second = 1_000_000
    when = lambda: rng.choice([None, rng.randrange(0, 300_000) * second])
    some = lambda: rng.sample(["a", "b", "*"], rng.randrange(3))
    lic = [
        (rng.choice([1, 2]), rng.choice(["ACTIVE"] * 6 + list(rights.LICENSE_BLOCKED)), some() or None, some(), when(), when(), rng.random() < 0.8)
        for _ in range(120)
    ]
    edges = [t for x in lic for t in x[4:6] if t is not None]
    uses = [(i, rng.choice([1, 2, 3, None]), rng.choice(["a", "b", "c", "*", None]), rng.choice([*edges, rng.randrange(300_000) * second, None])) for i in range(300)]
    got = rights.license_authorizes(
        spark.createDataFrame(uses, "event_id bigint, work_id bigint, intended_use string, at_us bigint"),
        spark.createDataFrame(lic, "work_id bigint, state string, permitted_uses array<string>, prohibited_uses array<string>, from_us bigint, until_us bigint, verified boolean"),
    ).collect()
    assert len(got) == 300
    by = {u[0]: u for u in uses}
    for r in got:
        _, work, use, at = by[r.event_id]
        n = dict.fromkeys(("permitting", "prohibiting", "other_use", "expired", "not_yet_effective", "suspended", "revoked", "superseded", "unverified"), 0)
        if None not in (work, use, at):
            for w, state, yes, no, start, end, ok in lic:
                if w != work:
                    continue
                if not ok:
                    n["unverified"] += 1
                elif state in rights.LICENSE_BLOCKED:
                    n[state.lower()] += 1
                elif start is not None and start > at:
                    n["not_yet_effective"] += 1
                elif end is not None and end <= at:
                    n["expired"] += 1
                elif use in no:
                    n["prohibiting"] += 1
                elif use not in (yes or []):
                    n["other_use"] += 1
                else:
                    n["permitting"] += 1
        assert {k: r[k] for k in n} == n, by[r.event_id]
        assert r.authorized == (n["permitting"] > 0)


LINKS = "id bigint, tenant_id bigint, work_id bigint, state string, superseded_by_id bigint"


def test_chains_end_at_their_current_record(spark):
    link = lambda i, to, tenant=1: (i, tenant, 1, "ASSERTED" if to is None else "SUPERSEDED", to)
    rows = [link(i, i + 1) for i in range(1000)] + [link(1000, None)]  # a long chain
    rows += [link(2000 + i, 1000) for i in range(50)]  # many replaced by one
    rows += [link(3000 + i, 3000 + (i + 1) % 7) for i in range(7)] + [link(3100, 3003)]  # a circle, and a way into it
    rows += [link(4000, 4001), link(4001, 4999), link(4002, 4002), link(4003, 5000), link(5000, None, tenant=2), (4004, 1, 1, "SUPERSEDED", None), link(4005, 4004)]
    got = {r.id: (r.current_id, r.resolution, r.steps) for r in rights.current_records(spark.createDataFrame(rows, LINKS)).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (1000, "RESOLVED", 1000 - i) for i in range(1000)) and got[1000] == (1000, "CURRENT", 0)
    assert all(got[2000 + i] == (1000, "RESOLVED", 1) for i in range(50))
    assert {got[i] for i in [*range(3000, 3007), 3100]} == {(None, "CYCLE", None)}
    assert {got[i] for i in range(4000, 4006)} == {(None, "BROKEN", None)} and got[5000] == (5000, "CURRENT", 0)
    assert rights.current_records(spark.createDataFrame([], LINKS)).count() == 0


def test_the_gate_derives_licenses_once(spark):
    """Digests are compared by 16 bytes of their own: equal strings alone are equal; licenses are derived once."""
    df = spark.createDataFrame([("ab", "ab"), ("ab", "AB"), ("", "x"), (None, "ab")], "a string, b string")
    same = [(r.a == r.b, r.s) for r in df.withColumn("s", ledger.packed_digest(F.col("a")).eqNullSafe(ledger.packed_digest(F.col("b")))).collect()]
    assert all(x == y for x, y in same)
    t = Tables(spark, "/root/testdata/sf0.001")
    claims, licenses = gated_rights(t)
    # The join behind the licenses runs once: rows, events and leaves are derived from what it stored.
    assert not any("lineitem" in f for f in licenses.inputFiles()) and licenses.columns[-2:] == ["verified", "integrity_code"]
