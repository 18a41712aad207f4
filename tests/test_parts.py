"""Results that must not depend on how a stream is cut, rows that really are late, and fits that converge."""

import datetime

import numpy as np
import pytest

from evidlake.operators import evaluation
from evidlake.streaming import windows
from evidlake.streaming.sources import drain_batches, in_parts

CHECKS = "lane string, score_name string, identity_matches boolean, observations bigint, shift double, state string, reason_code string, batch bigint"


def drift(spark, parts):
    rng = np.random.default_rng(0)
    rows = [(i % parts, f"p{i % 9}", "s" if i % 3 else "t", f"b{i % 2 if i % 3 else 0}", float(v)) for i, v in enumerate(rng.uniform(0, 2, 90))]
    obs = in_parts(spark.createDataFrame(rows, "part int, packet_id string, score_name string, bundle_id string, value double"), "part", parts, "obs", 10)
    base = spark.createDataFrame(
        [("l", "s", "b0,b1", 1.0, 0.5, 50, 0.5, 2.0), ("l", "t", "b1", 1.0, 0.5, 5, 0.5, 2.0), ("l", "none", "b0", 1.0, 0.5, 5, 0.5, 2.0)],
        "lane string, score_name string, bundle_id string, base_mean double, base_sd double, min_n bigint, warn double, revalidate double",
    )
    return drain_batches(obs, "drift", windows.drift_batch(base), {"checks": CHECKS})["checks"].collect()


def test_drift_merges_all_batches(spark):
    final = lambda rows: sorted((r.score_name, r.observations, round(r.shift or 0, 9), r.state) for r in rows if r.batch == max(x.batch for x in rows))
    one, five = drift(spark, 1), drift(spark, 5)
    assert {r.batch for r in one} == {0} and {r.batch for r in five} == {0, 1, 2, 3, 4}
    assert final(one) == final(five) and [r[1] for r in final(five) if r[0] == "s"] == [60]
    early = [r for r in five if r.batch == 0 and r.score_name == "s"]
    assert early[0].state == "INSUFFICIENT_CURRENT_OBSERVATIONS"


def test_late_rows_are_told_by_earlier_parts(spark):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [(0, 1, at(0)), (0, 2, at(5)), (1, 3, at(4.5)), (1, 4, at(3)), (1, 5, at(9)), (2, 6, at(7)), (2, 7, at(8.5))]
    ddl = "event_id bigint, at_us bigint"
    stream = in_parts(spark.createDataFrame(rows, "part int, event_id bigint, ts timestamp"), "part", 3, "arrivals")
    out = drain_batches(stream, "late", windows.split_late(3600), {"on_time": ddl, "late": ddl})
    assert {r.event_id for r in out["late"].collect()} == {4, 6} and {r.event_id for r in out["on_time"].collect()} == {1, 2, 3, 5, 7}


@pytest.mark.parametrize(("most", "state"), [(100, "FITTED"), (8, "NOT_CONVERGED")])
def test_separable_provider_needs_more_steps(spark, most, state):
    # Classes that don't overlap: only the penalty holds the slope, far from where the fit begins.
    rows = [("p", 0.4 + 0.001 * (i % 50), 0) for i in range(4000)] + [("p", 0.55 + 0.001 * (i % 50), 1) for i in range(4000)]
    got = evaluation.fit_platt(spark.createDataFrame(rows, "provider string, score double, label int"), "provider", most=most).first()
    assert got.state == state
    if state == "FITTED":
        x = np.log(np.array([r[1] for r in rows]) / (1 - np.array([r[1] for r in rows])))
        y = np.array([r[2] for r in rows], float)
        q = 1 / (1 + np.exp(-(got.slope * x + got.intercept)))
        assert abs(((q - y) * x).sum() + 1e-3 * got.slope) < 1e-4 and abs((q - y).sum() + 1e-4 * got.intercept) < 1e-4
