"""Which licenses of a work meet the claims when rights facts are collected."""

import datetime

from pyspark.sql import functions as F

from evidlake.operators import rights

NOW = datetime.datetime(2024, 6, 1)
DAY = datetime.timedelta(days=1)
CLAIM = "claim_id bigint, work_id bigint, state string, effective_from timestamp, effective_until timestamp, verified boolean, integrity_code string"
LICENSE = (
    "license_id bigint, claim_id bigint, work_id bigint, version bigint, state string, permitted_uses array<string>, prohibited_uses array<string>, "
    "effective_from timestamp, effective_until timestamp, verified boolean, integrity_code string"
)


def test_only_fitting_licenses_ask_for_their_claim(spark, monkeypatch):
    asked, backed = [], rights.backed_licenses

    def counting(licenses, claims, as_of):
        asked.append(licenses.count())
        return backed(licenses, claims, as_of)

    monkeypatch.setattr(rights, "backed_licenses", counting)
    row = lambda i, claim, state="ACTIVE", yes=("ads",), no=(), start=NOW - DAY, end=None, code=None: (
        i, claim, 7, i, state, list(yes), list(no), start, end, code is None, code
    )
    lic = [row(i, i, state) for i, state in enumerate(["SUSPENDED", "REVOKED", "EXPIRED", "SUPERSEDED"] * 25)]
    lic += [row(200, 200, start=NOW + DAY), row(201, 201, end=NOW), row(202, 202, yes=["films"]), row(203, 203, no=["ads"]), row(204, 204, code="X"), row(205, 205, code="Y")]
    # These fit: two with a claim that stands, one with a disputed claim, one with another work's, one without.
    lic += [row(300, 1), row(301, 1), row(302, 2), row(303, 3), row(304, None)]
    claims = [(1, 7, "CORROBORATED", NOW - DAY, None, True, None), (2, 7, "DISPUTED", NOW - DAY, None, True, None), (3, 8, "CORROBORATED", NOW - DAY, None, True, None)]
    facts = rights.rights_facts(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(lic, LICENSE), ["ads", "press"], F.lit(NOW))
    got = {r.intended_use: r for r in facts.where("work_id = 7").collect()}
    # One row for all that do not fit or name no claim, and one for each claim that is named.
    assert asked == [4]
    ads, press = got["ads"], got["press"]
    assert (ads.licenses, ads.scope, ads.strong, ads.authorizing_license_id, ads.vetoed, ads.other) == (111, 5, 2, 300, 1, 1)
    assert (press.licenses, press.scope, press.strong, press.authorizing_license_id, press.vetoed, press.other) == (111, 0, 0, None, 0, 7)
    assert (ads.licenses_suspended, ads.licenses_not_yet, ads.licenses_over, sorted(ads.license_failures)) == (25, 1, 1, ["X", "Y"])
    assert sorted(ads.weak) == ["LICENSE_NOT_BOUND_TO_RECORDED_CLAIM", "MATCHED_CLAIM_DISPUTED"] and press.weak == []
