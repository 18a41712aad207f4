"""The index of cones against all pairs, and how little of them it scores."""

import numpy as np
import pytest

from evidlake.operators import cones


def frames(spark, q, r):
    rows = lambda m: [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows(q), "query_id bigint, vec array<double>"), spark.createDataFrame(rows(r), "ref_id bigint, vec array<double>")


def data(kind, n, d=12):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 4, (n, 1))
    if kind == "clusters":
        x = (np.eye(d) * 3)[np.arange(n) % d] * rng.uniform(0.5, 2, (n, 1)) + 0.1 * rng.normal(size=(n, d))
    x[n // 3 : n // 2] = x[n // 3]  # copies
    x[-3:] = 0.0  # no direction
    return x


def similarities(q, r, metric):
    if metric == "cosine":
        q, r = (m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None] for m in (q, r))
    return np.round(q @ r.T, 12)


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("kind", ["clusters", "sphere"])
@pytest.mark.parametrize("leaf", [7, 10**6])
def test_nearest_and_threshold_are_exact(spark, metric, kind, leaf):
    x = data(kind, 300)
    q, r = frames(spark, x[:200], x)
    index = cones.build(r, metric, leaf_rows=leaf)
    s = similarities(x[:200], x, metric)
    got = {}
    for row in cones.nearest(q, index, 5, block_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.ref_id, row.similarity))
    for i in range(200):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-s[i, j], j))[:5]
        assert np.allclose([v for _, v in got[i]], s[i, order], atol=1e-9) and len(got[i]) == 5
    floor = 0.95 if metric == "cosine" else 4.0
    sure = {(i, j) for i in range(200) for j in range(300) if i != j and s[i, j] >= floor + 1e-9}
    maybe = {(i, j) for i in range(200) for j in range(300) if i != j and s[i, j] >= floor - 1e-9}
    pairs = {(p.query_id, p.ref_id) for p in cones.within(q, index, floor, block_rows=16).collect()}
    assert sure <= pairs <= maybe


def test_clusters_are_pruned(spark):
    x = data("clusters", 3000)
    q, r = frames(spark, x[::30], x)
    index = cones.build(r, leaf_rows=50)
    rows = cones.cost(q, index, 5).collect()
    assert len(rows) == 100 and index.tree is not None
    # Queries without a direction are as near to all, and must meet all.
    assert np.mean([p.share for p in rows]) < 0.2


def test_few_or_no_references(spark):
    q, r = frames(spark, np.eye(3), np.eye(3))
    assert cones.nearest(q, cones.build(r.limit(0)), 2).count() == 0
    assert cones.nearest(q.limit(0), cones.build(r, leaf_rows=1), 2).count() == 0
    assert cones.nearest(q, cones.build(r, leaf_rows=1), 5).count() == 6  # all but itself
    zeros = r.selectExpr("ref_id", "transform(vec, x -> 0D) as vec")
    assert cones.nearest(q, cones.build(zeros, leaf_rows=1), 5).count() == 6


def shuffled(spark, df):
    """Bytes that are shuffled until all rows are there."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    df().write.format("noop").mode("overwrite").save()
    return written() - before


@pytest.mark.parametrize("kind", ["clusters", "sphere"])
def test_what_is_sent_grows_as_the_table(spark, kind):
    def found(n):
        q, r = frames(spark, *[data(kind, n, 64)] * 2)
        return shuffled(spark, lambda: cones.nearest(q, cones.build(r, leaf_rows=16), 5, block_rows=16))

    found(100)
    assert found(4000) < 5 * found(1000)


def test_many_equal_vectors_and_sizes(spark):
    """More copies than hits, all in one leaf; sizes beyond single precision; more hits than a leaf has rows."""
    x = np.concatenate([np.tile([[1.0, 2.0, 3.0]], (90, 1)), np.random.default_rng(5).normal(size=(60, 3))])
    for scale, k in ((1.0, 4), (1e30, 4), (1.0, 70)):
        q, r = frames(spark, x * scale, x * scale)
        hits = cones.nearest(q, cones.build(r, "cosine", leaf_rows=20), k, block_rows=16).collect()
        s = similarities(x, x, "cosine")
        for i in range(150):
            want = sorted((j for j in range(150) if j != i), key=lambda j: (-s[i, j], j))[:k]
            assert [h.ref_id for h in sorted(hits, key=lambda h: h.rank) if h.query_id == i] == want
