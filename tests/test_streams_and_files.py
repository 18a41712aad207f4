"""Streams over several files and micro-batches, and the file sources and sinks."""

import datetime
import hashlib
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidlake.sources import catalog, manifest, reports
from evidlake.sources.tables import Tables
from evidlake.streaming import stateful, windows
from evidlake.streaming.sources import drain, drain_batches, file_stream

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Four event files, read one per micro-batch; the last one is late."""
    root = tmp_path_factory.mktemp("events")
    for n in range(4):
        shift = 0 if n == 3 else n * 600
        rows = [
            {
                "event_id": n * 100 + i, "ts": START + datetime.timedelta(minutes=shift + i * 5), "user_id": i % 3,
                "event_type": ("view", "error")[i % 2], "value": 1.0, "props": "{}",
            }
            for i in range(30)
        ]
        pq.write_table(pa.Table.from_pylist(rows), root / ("events.parquet" if n == 0 else f"events.parquet{n}"))
        (root / ("events.parquet" if n == 0 else f"events.parquet{n}")).touch()
        import os

        os.utime(root / ("events.parquet" if n == 0 else f"events.parquet{n}"), (1_700_000_000 + n, 1_700_000_000 + n))
    return str(root)


def stream(spark, folder):
    return file_stream(spark, folder, "events", 1).withColumnRenamed("user_id", "tenant_id")


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    for n in range(3):
        pq.write_table(pa.table({"event_id": [n, n + 10]}), tmp_path / "events.parquet" / f"part-{n}.snappy.parquet")
    pq.write_table(pa.table({"event_id": pa.array([], pa.int64())}), tmp_path / "none.parquet")
    pq.write_table(pa.table({"event_id": [77]}), tmp_path / "other.parquet")
    copy = lambda df, batch_id, out: windows.write_batch(df, out, "ids", batch_id)
    got = lambda name: drain_batches(file_stream(spark, str(tmp_path), name, 2), "t", copy, {"ids": "event_id bigint"})["ids"]
    assert sorted(r.event_id for r in got("events").collect()) == [0, 1, 2, 10, 11, 12]
    assert [r.event_id for r in got("other").collect()] == [77]
    assert got("none").count() == 0
    assert drain(file_stream(spark, str(tmp_path), "events"), "t").count() == 6


def test_deduplication_over_batches(spark, folder):
    s = stream(spark, folder).withColumn("idem_key", F.concat(F.lit("k"), F.col("event_id") % 10)).withColumn("digest", F.concat(F.lit("d"), F.col("event_id") % 20))
    out = drain_batches(s, "t", windows.deduplicate_batch(["tenant_id", "idem_key"]), {"outcomes": "event_id bigint, outcome string"})["outcomes"]
    rows = {r["event_id"]: r["outcome"] for r in out.collect()}
    assert len(rows) == 120
    first, want = {}, {}
    for n in range(4):
        for i in range(30):
            e = n * 100 + i
            key, d = (i % 3, e % 10), e % 20
            if key not in first:
                first[key], want[e] = d, "NEW"
            else:
                want[e] = "REPLAY" if d == first[key] else "CONFLICT"
    assert rows == want


def test_retries_over_batches(spark, folder):
    s = stream(spark, folder).select(F.concat(F.lit("d"), F.col("event_id") % 7).alias("delivery_key"), "event_id", "ts", (F.col("event_id") % 5 == 4).alias("succeeded"))
    ddl = "delivery_key string, event_id bigint, attempt bigint, state string, next_attempt_us bigint"
    out = drain_batches(s, "r", windows.retry_batch(3), {"deliveries": ddl, "dead_letters": ddl})
    got = {r["event_id"]: (r["attempt"], r["state"]) for d in out.values() for r in d.collect()}
    want, seen = {}, {}
    for n in range(4):
        for i in range(30):
            e = n * 100 + i
            tries, done = seen.get(e % 7, (0, False))
            if done:
                continue
            tries += 1
            ok = e % 5 == 4
            state = "DELIVERED" if ok else "DEAD_LETTERED" if tries >= 3 else "RETRYING"
            want[e] = (tries, state)
            seen[e % 7] = (tries, state != "RETRYING")
    assert got == want


def test_quota_and_tokens(spark, folder):
    s = stream(spark, folder).where("event_id < 300").select("tenant_id", "event_id", "ts")
    quota = {r["event_id"]: r["admitted"] for r in drain(stateful.daily_quota(s, 8), "q").collect()}
    tokens = {r["event_id"]: r["admitted"] for r in drain(stateful.token_bucket(s, 0.05, 3.0), "b").collect()}
    want_q, want_t = {}, {}
    kept, level = {}, {}
    for n in range(3):
        for i in range(30):
            e, at, k = n * 100 + i, (n * 600 + i * 5) * 60, i % 3
            live = [x for x in kept.get(k, []) if x >= at - 86400]
            want_q[e] = len(live) < 8
            kept[k] = live + ([at] if want_q[e] else [])
            tok, last = level.get(k, (3.0, None))
            tok = tok if last is None else min(3.0, tok + (at - last) * 0.05 / 60)
            want_t[e] = tok >= 1
            level[k] = (tok - (1 if tok >= 1 else 0), at)
    assert quota == want_q and tokens == want_t
    assert not all(want_q.values()) and not all(want_t.values())


def test_late_rows_go_to_the_side_table(spark, folder):
    ddl = "event_id bigint, at_us bigint"
    out = drain_batches(stream(spark, folder).select("event_id", "ts"), "l", windows.split_late(3600), {"on_time": ddl, "late": ddl})
    assert {r["event_id"] // 100 for r in out["late"].collect()} == {3}
    assert out["on_time"].count() + out["late"].count() == 120


def test_leases_and_batches(spark, folder):
    beats = stream(spark, folder).where("event_id < 300").select(F.col("tenant_id").alias("scan_id"), F.lit("s").alias("stage"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    out = drain(stateful.lease_expiry(beats, 3600, 5), "lease").orderBy("scan_id", "expired_us").collect()
    gaps = [r for r in out if r["scan_id"] == 0]
    assert [r["outcome"] for r in gaps][:2] == ["FAILED_RETRYABLE", "FAILED_RETRYABLE"]
    leaves = stream(spark, folder).select(F.col("event_id").alias("leaf_index"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_s"), F.col("ts").cast("timestamp").alias("ts")).where("leaf_index < 300")
    closed = {r["batch"]: (r["leaves"], r["trigger"]) for r in drain(stateful.close_batches(leaves, 30, 3600), "cut").collect()}
    assert closed[0] == (30, "COUNT") and "COUNT" in {t for _, t in closed.values()}


def test_objects_and_logs_from_files(spark, tmp_path):
    root = tmp_path / "objects"
    root.mkdir()
    (root / "a.bin").write_bytes(b"hello")
    (root / "b.bin").write_bytes(b"changed")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = spark.createDataFrame(
        [("a.bin", sha(b"hello"), 5), ("b.bin", sha(b"before"), 6), ("c.bin", sha(b"x"), 1)], "object_id string, sha256 string, byte_size bigint"
    )
    got = {r["object_id"]: r["state"] for r in catalog.verify_objects(catalog.read_objects(spark, str(root)), want).collect()}
    assert got == {"a.bin": "VERIFIED", "b.bin": "SHA256_MISMATCH", "c.bin": "READ_FAILED"}
    log = tmp_path / "log.jsonl"
    good = {"leaf_index": 0, "statement_id": 5, "packet_hash": sha(b"1")}
    log.write_text(json.dumps(good) + "\n{torn\n" + json.dumps({**good, "packet_hash": "zz"}) + "\n")
    parsed = reports.read_jsonl_log(spark, str(log))
    assert parsed.count() == 1
    new = spark.createDataFrame([(9,), (7,)], "statement_id bigint")
    numbered = reports.number_appended(new, parsed, "statement_id", F.lit(0).cast("bigint"))
    assert {r["statement_id"]: r["leaf_index"] for r in numbered.collect()} == {7: 1, 9: 2}
    out = str(tmp_path / "leaves")
    reports.append_log(numbered, out)
    reports.append_log(numbered, out)
    assert spark.read.parquet(out).count() == 4


def test_manifest_file(spark, tmp_path):
    item = {"asset_id": 1, "location": "a/b.png", "sha256": "0" * 64, "source_lineage_id": "l", "part": "TEST", "derived_from": None}
    bad = {**item, "asset_id": 2, "location": "../x", "sha256": "zz", "part": "OTHER", "derived_from": 2}
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"items": [item, bad]}))
    from pyspark.sql.types import ArrayType, StructType

    one = StructType.fromDDL("asset_id bigint, location string, sha256 string, source_lineage_id string, part string, derived_from bigint")
    items = manifest.read_manifest(spark, str(path), StructType().add("items", ArrayType(one)))
    rules = {(r["asset_id"], r["rule"]) for r in manifest.validate_manifest(items).collect()}
    assert rules == {(2, r) for r in ("LOCATION_NOT_SAFE_RELATIVE_PATH", "SHA256_NOT_HEX", "PARTITION_NOT_ALLOWED", "DERIVED_FROM_ITSELF")}


def test_filters_and_columns_reach_the_scan(spark):
    from conftest import SF

    plan = catalog.scan_catalog(Tables(spark, SF).works(), "en").select("work_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[-1]
