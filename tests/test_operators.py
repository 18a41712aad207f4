"""Operators on literal inputs and against brute force."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidlake.functions.expr import leaf_hash
from evidlake.operators import coverage, fusion, ledger, plugins, rights, similarity, text, usage
from evidlake.operators import evaluation as ev
from evidlake.operators import profiles as pr
from evidlake.sources.catalog import bulk_import


def vec_frames(spark, q, r, scopes=1):
    qs = [(i, i % scopes, [float(x) for x in v]) for i, v in enumerate(q)]
    rs = [(i, i % scopes, [float(x) for x in v]) for i, v in enumerate(r)]
    return (
        spark.createDataFrame(qs, "query_id bigint, scope bigint, vec array<double>"),
        spark.createDataFrame(rs, "ref_id bigint, scope bigint, vec array<double>"),
    )


@pytest.mark.parametrize("metric,scopes,selfless", [("cosine", 1, True), ("dot", 1, False), ("cosine", 3, True)])
def test_nearest_is_exact(spark, metric, scopes, selfless):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8)) * 3
    r = np.array([centers[i % 6] + rng.normal(size=8) for i in range(120)])
    r[40:60] = r[40]  # a third of one region are copies
    q, rr = vec_frames(spark, r[:50], r, scopes)
    got = similarity.nearest(q, rr, 5, metric, exclude_self=selfless, pivots=5, block_rows=16, scoped=scopes > 1)
    found = {}
    for row in got.collect():
        found.setdefault(row["query_id"], []).append((row["rank"], row["ref_id"], row["similarity"]))
    a, b = r[:50], r
    if metric == "cosine":
        a, b = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    s = np.round(a @ b.T, 12)
    for i in range(50):
        order = sorted(
            (j for j in range(120) if j % scopes == i % scopes and not (selfless and j == i)), key=lambda j: (-s[i, j], j)
        )[:5]
        mine = sorted(found[i])
        assert np.allclose([x[2] for x in mine], [s[i, j] for j in order], atol=1e-9)
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5]


def test_hamming_join_finds_every_pair(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = []
    for i, b in enumerate(base):
        fps += [b, b, b ^ (1 << rng.randrange(64)), b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))]
    df = spark.createDataFrame([(i, f >> 32, f & 0xFFFFFFFF) for i, f in enumerate(fps)], "item_id bigint, hi bigint, lo bigint")
    got = {(r["item_id"], r["other_id"]): r["distance"] for r in similarity.hamming_join(df, 3, 6).collect()}
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(f, i)
    ids = sorted(first.items(), key=lambda x: x[1])
    want = {
        (i, j): bin(f ^ g).count("1") for f, i in ids for g, j in ids if i < j and bin(f ^ g).count("1") <= 3
    }
    assert got == want and want


def test_copies_stay_linear(spark):
    docs = spark.createDataFrame([(i, "same words in every copy of this text") for i in range(40)], "work_id bigint, text string")
    assert similarity.lsh_candidates(docs, "work_id", "text").count() == 39
    hashed = docs.withColumn("sha256", F.sha2("text", 256))
    assert similarity.exact_matches(hashed).count() == 39


def test_shingles_are_hashed_once(spark):
    """The bands are stored: no join or aggregate over them hashes the texts again. Min-hashes are as by SHA-256 of each shingle."""
    rows = [(0, "a b c d e f g"), (1, "a  b é "), (2, ""), (3, None), (4, "a b c d e f h"), (5, None), (6, "x y z")]
    docs = spark.createDataFrame(rows, "work_id bigint, text string")
    got = {r.work_id: r.minima for r in text.with_minima(docs, "text").collect()}
    for i, t in rows:
        if t is None:
            assert got[i] == [None] * 8
            continue
        w = t.split(" ")
        hashed = [hashlib.sha256(" ".join(w[k : k + 5]).encode()).hexdigest() for k in range(max(1, len(w) - 4))]
        assert got[i] == [min(h[8 * k : 8 * k + 8] for h in hashed) for k in range(8)]
    found = similarity.lsh_candidates(docs, "work_id", "text")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "minima_of" not in plan
    assert (5, 3, 4) in {tuple(r) for r in found.collect()}


def merkle(leaves):
    level = [hashlib.sha256(b"\x00" + bytes.fromhex(x)).hexdigest() for x in leaves]
    while len(level) > 1:
        level = [
            hashlib.sha256(b"\x01" + bytes.fromhex(level[i] + level[i + 1])).hexdigest() if i + 1 < len(level) else level[i]
            for i in range(0, len(level), 2)
        ]
    return level[0]


@pytest.mark.parametrize("n", [1, 2, 5, 16, 37])
def test_merkle_root_proofs_and_prefixes(spark, n):
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    leaves = spark.createDataFrame(list(enumerate(hashes)), "leaf_index bigint, packet_hash string")
    assert ledger.merkle_root(leaves, bits=2).first()["root"] == merkle(hashes)
    proofs = ledger.inclusion_proofs(leaves, bits=2)
    ok = ledger.verify_proofs(proofs, F.lit(n).cast("bigint"), F.lit(merkle(hashes))).collect()
    assert len(ok) == n and all(r["valid"] and r["strict_valid"] for r in ok)
    wrong = ledger.verify_proofs(proofs, F.lit(n).cast("bigint"), F.lit(merkle(hashes[::-1] + hashes[:1]))).collect()
    assert not any(r["valid"] for r in wrong)
    sizes = spark.createDataFrame([(i,) for i in range(1, n + 1)], "tree_size bigint")
    for r in ledger.prefix_roots(ledger.node_table(leaves, bits=2), sizes).collect():
        assert r["recomputed"] == merkle(hashes[: r["tree_size"]])


def test_swapped_side_fails_the_strict_form_only(spark):
    # Equal siblings hash alike from either side, so only the shape gives the swap away.
    h = hashlib.sha256(b"x").hexdigest()
    leaves = spark.createDataFrame([(0, h), (1, h)], "leaf_index bigint, packet_hash string")
    p = ledger.inclusion_proofs(leaves, bits=2).withColumn("sides", F.transform("sides", lambda s: F.when(s == "left", "right").otherwise("left")))
    rows = ledger.verify_proofs(p, F.lit(2).cast("bigint"), F.lit(merkle([h, h]))).collect()
    assert all(r["valid"] and not r["strict_valid"] for r in rows)
    assert spark.createDataFrame([(h,)], "p string").select(leaf_hash(F.col("p")).alias("l")).first()["l"] == hashlib.sha256(b"\x00" + bytes.fromhex(h)).hexdigest()


BASE = {
    "exact": False, "ai": 0.72, "phash": 1.0, "structure": 0.9, "validated": True, "inliers": 60.0, "inlier_ratio": 0.9,
    "query_coverage": 0.5, "reference_coverage": 0.5, "symmetric_error": 0.001, "alignment_grade": "STRICT", "reflected": False,
}


def fuse(spark, **change):
    row = {**BASE, **change}
    schema = "exact boolean, ai double, phash double, structure double, validated boolean, inliers double, inlier_ratio double, query_coverage double, reference_coverage double, symmetric_error double, alignment_grade string, reflected boolean"
    return fusion.fuse_copy(spark.createDataFrame([tuple(row.values())], schema)).first()


def test_copy_fusion_paths(spark):
    assert fuse(spark, exact=True)["classification"] == "EXACT_BINARY_COPY"
    near = fuse(spark)
    assert near["match_supported"] and near["classification"] == "VERIFIED_NEAR_DUPLICATE"
    assert fuse(spark, query_coverage=0.1)["classification"] == "VERIFIED_PARTIAL_COPY_EVIDENCE"
    alone = fuse(spark, validated=False, structure=None, ai=0.99)
    assert not alone["match_supported"] and alone["evidence_tier"] == "REVIEW"
    quiet = fuse(spark, validated=False, structure=None, ai=None, phash=0.2)
    assert quiet["evidence_tier"] == "LOW" and quiet["reason_codes"] == "NO_VERIFIED_LOCAL_GEOMETRY"
    relaxed = fuse(spark, validated=False, alignment_grade="CORROBORATION_REQUIRED")
    assert relaxed["match_supported"] and "RELAXED_ALIGNMENT_CONFIRMED" in relaxed["reason_codes"]
    crop = fuse(spark, ai=0.1, phash=0.1, structure=0.98, inliers=5.0, query_coverage=0.01)
    assert crop["match_supported"] and "ALIGNED_PIXELS_EFFECTIVELY_IDENTICAL" in crop["reason_codes"]


def test_coverage_states(spark):
    cases = {
        1: [(1, True, True, None), (2, True, True, None)],
        2: [(1, True, True, None), (2, False, False, None)],
        3: [(1, True, True, None), (2, True, False, None)],
        4: [(1, True, False, "VERIFICATION")],
        5: [(1, True, True, None), (2, True, False, "ASSET")],
        6: [(1, True, True, None), (1, True, True, None)],
    }
    rows = [(s, *r) for s, rs in cases.items() for r in rs]
    df = spark.createDataFrame(rows, "scan_id bigint, ref_id bigint, is_candidate boolean, is_verified boolean, failure string")
    got = {r["scan_id"]: r["coverage_status"] for r in coverage.coverage_snapshot(df).collect()}
    assert got == {1: "COMPLETE", 2: "TRUNCATED", 3: "PARTIAL", 4: "FAILED", 5: "FAILED", 6: "FAILED"}


def test_auc_ap_and_tails_match_the_definitions(spark):
    rng = random.Random(4)
    data = [(i, "g", rng.randint(0, 1), rng.randint(0, 20) / 20) for i in range(200)]
    df = spark.createDataFrame(data, "id bigint, grp string, label bigint, score double")
    pos, neg = [d[3] for d in data if d[2]], [d[3] for d in data if not d[2]]
    auc = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(ev.roc_auc(df, ["grp"]).first()["auc"] - auc) < 1e-12
    tp, total = 0, 0.0
    for rank, d in enumerate(sorted(data, key=lambda d: (-d[3], d[0])), 1):
        if d[2]:
            tp += 1
            total += tp / rank
    assert abs(ev.average_precision(df, ["grp"], "id").first()["average_precision"] - total / len(pos)) < 1e-12
    op = ev.operating_points(df, ["grp"]).first()
    t95 = float(np.quantile(pos, 0.05, method="lower"))
    assert op["fpr_at_95_tpr_threshold"] == t95 and abs(op["fpr_at_95_tpr"] - np.mean(np.array(neg) >= t95)) < 1e-12


def test_bootstrap_counts_clusters_and_reports_why_not(spark):
    rows = [(f"l{i % 3}", i % 4 != 0) for i in range(30)] + [(None, True)]
    df = spark.createDataFrame(rows, "lineage string, ok boolean")
    out = ev.cluster_bootstrap(df, "lineage", F.col("ok").cast("double"), F.lit(1.0), 100).first()
    assert out["cluster_count"] == 3 and not out["eligible_for_acceptance"]
    assert out["reason_codes"] == "SOURCE_LINEAGE_MISSING|MINIMUM_SOURCE_LINEAGE_CLUSTERS_NOT_MET"
    assert out["lower"] <= out["point_estimate"] <= out["upper"]
    with pytest.raises(ValueError):
        ev.cluster_bootstrap(df, "lineage", F.lit(1.0), F.lit(1.0), 50)


def test_platt_recovers_a_calibrated_score(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.uniform(0.02, 0.98, 4000), 6)
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-(1.5 * np.log(p / (1 - p)) - 0.4)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"provider": "p", "score": p, "label": y}))
    fit = ev.fit_platt(df, "provider").first()
    assert fit["state"] == "FITTED" and abs(fit["slope"] - 1.5) < 0.15 and abs(fit["intercept"] + 0.4) < 0.15
    flipped = ev.fit_platt(df.withColumn("label", 1 - F.col("label")), "provider").first()
    assert flipped["state"] == "INVERTED_OR_NOT_FINITE"


def test_csls_excludes_own_density_and_gap_can_invert(spark):
    anchors = spark.createDataFrame(
        [(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [0.8, 0.6]), (4, 2, [0.6, 0.8])],
        "item_id bigint, profile_key bigint, embedding array<double>",
    )
    dense = {r["item_id"]: r["density"] for r in pr.local_density(anchors, 1, True).collect()}
    assert abs(dense[1] - 0.8) < 1e-9 and abs(dense[3] - 0.96) < 1e-9
    gap = {r["profile_key"]: r["gap"] for r in pr.discrimination_gap(anchors, 2).collect()}
    assert gap[1] < 0 < gap[2]


def test_license_sweep_matches_pairs(spark):
    rng = random.Random(8)
    day = 86_400_000_000
    lic = [(w, rng.choice(["ACTIVE", "SUSPENDED", "REVOKED"]), rng.choice(["a", "b"]), s * day, (s + rng.randint(1, 9)) * day) for w in (1, 1, 1, 2) for s in [rng.randint(0, 30) for _ in range(25)]]
    uses = [(i, rng.choice([1, 1, 2, 3]), rng.choice(["a", "b"]), rng.randint(0, 40) * day) for i in range(60)]
    got = rights.license_authorizes(
        spark.createDataFrame(uses, "event_id bigint, work_id bigint, intended_use string, at_us bigint"),
        spark.createDataFrame(lic, "work_id bigint, state string, permitted_use string, from_us bigint, until_us bigint"),
    ).collect()
    assert len(got) == 60
    by = {u[0]: u for u in uses}
    for r in got:
        _, w, use, at = by[r["event_id"]]
        mine = [x for x in lic if x[0] == w and x[1] == "ACTIVE"]
        assert r["permitting"] == sum(x[2] == use and x[3] <= at < x[4] for x in mine)
        assert r["expired"] == sum(x[4] <= at for x in mine)
        assert r["not_yet_effective"] == sum(x[3] > at for x in mine)


def test_drift_identity_beats_the_numbers(spark):
    base = spark.createDataFrame([("l", "s", "b1", 10.0, 1.0, 1, 0.5, 2.0)], "lane string, score_name string, bundle_id string, base_mean double, base_sd double, min_n bigint, warn double, revalidate double")
    def state(bundle, mean, n=5):
        cur = spark.createDataFrame([("s", n, mean, [bundle])], "score_name string, count bigint, mean double, bundle_ids array<string>")
        return usage.evaluate_drift(cur, base).first()["state"]
    assert state("b2", 10.0) == "REVALIDATION_REQUIRED"
    assert state("b1", 10.1) == "STABLE"
    assert state("b1", 10.7) == "WARNING"
    assert state("b1", 13.0) == "REVALIDATION_REQUIRED"
    assert state("b1", 13.0, 0) == "INSUFFICIENT_CURRENT_OBSERVATIONS"


def test_routing_never_replaces_a_low_score(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id bigint, text string")

    def primary(text):
        if text == "bad":
            raise RuntimeError("down")
        return 0.01

    got = {r["id"]: (r["provider"], r["score"]) for r in plugins.route(df, "id", "text", ("p", primary), ("f", lambda t: 0.9)).collect()}
    assert got == {1: ("p", 0.01), 2: ("f", 0.9)}


def test_embedding_provider_errors_are_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "")], "id bigint, text string")
    bad = plugins.embed(df, "id", "text", lambda texts: np.zeros((len(texts), 64))).collect()
    assert {r["error"] for r in bad} == {"EMBEDDING_NOT_USABLE"}
    short = plugins.embed(df, "id", "text", lambda texts: np.ones((1, 3))).collect()
    assert all(r["error"].startswith("EMBEDDING_FAILED") for r in short)


def test_keys_of_different_tuples_never_meet(spark):
    rows = [(1, "a", "b|c", "d1", 1), (2, "a|b", "c", "d2", 2), (3, None, "c", "d3", 3), (4, "c", None, "d4", 4), (5, None, "c", "d3", 5), (6, "a", "b|c", "d9", 6), (7, "-", "c", "d7", 7)]
    df = spark.createDataFrame(rows, "event_id bigint, tenant_id string, idem_key string, digest string, ts bigint").withColumn(
        "ts", F.timestamp_seconds("ts")
    )
    got = {r["event_id"]: r["outcome"] for r in usage.idempotency(df, ["tenant_id", "idem_key"], "event_id").collect()}
    assert got == {1: "NEW", 2: "NEW", 3: "NEW", 4: "NEW", 5: "REPLAY", 6: "CONFLICT", 7: "NEW"}


def test_drift_of_mixed_bundles(spark):
    packets = spark.createDataFrame(
        [("s", "b0", 5, 50.0, 1.0, 20.0), ("s", "b1", 5, 60.0, 1.0, 20.0), ("t", "b0", 9, 90.0, 1.0, 20.0)],
        "score_name string, bundle_id string, count bigint, total double, min double, max double",
    )
    base = spark.createDataFrame(
        [("x", "s", "b0", 11.0, 1.0, 1, 5.0, 9.0), ("y", "s", "b1,b0", 11.0, 1.0, 1, 5.0, 9.0), ("x", "t", "b0", 10.0, 1.0, 1, 5.0, 9.0)],
        "lane string, score_name string, bundle_id string, base_mean double, base_sd double, min_n bigint, warn double, revalidate double",
    )
    got = {(r["lane"], r["score_name"]): (r["state"], r["observations"]) for r in usage.evaluate_drift(usage.merge_telemetry(packets, ["score_name"]), base).collect()}
    assert got == {("x", "s"): ("REVALIDATION_REQUIRED", 10), ("y", "s"): ("STABLE", 10), ("x", "t"): ("STABLE", 9)}


def test_import_leaves_no_file_out(spark):
    files = spark.range(105).selectExpr("concat('f', id) as filename", "if(id < 100, 'big', 'small') as batch", "cast(null as string) as reject_reason")
    manifest = spark.range(50).selectExpr("concat('f', id) as filename", "'t' as title", "'NONE' as license_hint")
    got = bulk_import(files, manifest, "batch", 30).collect()
    assert sorted((r["batch"], r["part"], r["files"]) for r in got) == [("big", 0, 30), ("big", 1, 30), ("big", 2, 30), ("big", 3, 10), ("small", 0, 5)]
    assert sum(r["imported"] for r in got) == 105 and sum(r["described"] for r in got) == 50


def test_lines_are_assembled_where_their_page_is(spark):
    from evidlake.operators.text import assemble_lines
    from evidlake.sources.tables import Tables

    plan = assemble_lines(Tables(spark, "/root/testdata/sf0.001").words(), ["page", "line_no"])
    # The one exchange deals whole texts: nothing is sent word by word.
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") == 1 and text.index("Generate") < text.index("Exchange ")
