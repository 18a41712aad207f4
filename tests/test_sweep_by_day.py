"""The sweep of licenses by work and day: what it writes, and instants that very many ask about."""

from evidlake.operators import rights

SECOND = 1_000_000
LICENSE = "work_id bigint, state string, permitted_uses array<string>, prohibited_uses array<string>, from_us bigint, until_us bigint, verified boolean"
USE = "event_id bigint, work_id bigint, intended_use string, at_us bigint"


def test_only_questions_and_ends_of_days_are_written(spark, monkeypatch):
    written = {}

    def stored(df, name):
        written[name] = df.count()
        return df

    monkeypatch.setattr(rights, "stored", stored)
    lic = [(1, "ACTIVE", ["a", "b"], ["c"], i * SECOND, None, True) for i in range(500)] + [(1, s, ["a"], [], 5, None, s != "ACTIVE") for s in ("ACTIVE", "REVOKED")]
    uses = [(i, 1, "a", 100 * SECOND) for i in range(40)] + [(40, 1, "c", 499 * SECOND), (41, 1, "d", 10**13), (42, 2, "a", 5)]
    got = {r.event_id: r for r in rights.license_authorizes(spark.createDataFrame(uses, USE), spark.createDataFrame(lic, LICENSE)).collect()}
    # Five hundred licenses of a work, forty uses at one instant: a row for each question, and the ends of two days at most for each use.
    assert sum(written.values()) <= 4 + 2 * 6
    assert all((got[i].permitting, got[i].not_yet_effective, got[i].authorized) == (101, 399, True) for i in range(40))
    assert (got[40].permitting, got[40].prohibiting, got[40].other_use) == (0, 500, 0) and (got[41].other_use, got[41].authorized) == (500, False)
    assert all((got[i].revoked, got[i].unverified) == (1, 1) for i in range(42)) and (got[42].revoked, got[42].reason_codes) == (0, "")
