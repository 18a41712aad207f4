"""What the integrity gate and the policy queries send: rows, events and verdicts meet in buckets, scans meet few facts in place."""

import re

import pytest

import __spark_entry__ as entry
from evidlake.plans import rights as plans
from evidlake.plans.rights import gated_rights
from evidlake.session import stored_by
from evidlake.sources.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def merging(spark):
    """Joins send rows, however small the tables: as at size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def sent(df):
    """By what the rows of each exchange of the plan are dealt."""
    return re.findall(r"Exchange hashpartitioning\((.*), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_rows_and_events_meet_in_their_buckets(merging):
    for gated in gated_rights(Tables(merging, SF)):
        # Events and leaves meet by event, verdicts go back by id; nothing else is sent.
        assert sorted(x.split("#")[0] for x in sent(gated)) == ["__vid", "event_id", "event_id"]


def test_buckets_keep_every_row(spark):
    rows = spark.range(1000).selectExpr(
        "if(id % 10 = 0, null, id % 300) as k", "if(id % 7 = 0, null, timestamp_micros(id * 1000003 - 10000000)) as at", "array(string(id)) as a", "id % 2 = 0 as b"
    )
    out = stored_by(rows, "some", "k", [rows])
    assert out.dtypes == rows.dtypes and sorted(map(str, out.collect())) == sorted(map(str, rows.collect()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("some_")]


def test_dry_run_sends_no_scan(merging):
    # This table has one split, so its rows are dealt over the cores.
    assert [x.split("#")[0] for x in sent(entry.queries()["jn21_policy_dry_run"](merging, SF))] == ["o_orderkey"]


def test_evaluation_sends_no_scan_unless_facts_are_many(merging, monkeypatch):
    few = entry.queries()["dc12_policy_evaluation"](merging, SF)
    assert [x.split("#")[0] for x in sent(few)] == ["o_orderkey"]
    monkeypatch.setattr(plans, "FEW_FACTS", 0)
    many = entry.queries()["dc12_policy_evaluation"](merging, SF)
    assert len(sent(many)) > 1 and few.columns == many.columns
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
