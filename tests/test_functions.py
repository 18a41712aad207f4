"""Running totals, order statistics, skewed joins and scalar functions against brute force."""

import hashlib
import hmac
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from evidlake.functions import expr as X
from evidlake.functions.digest import set_digest
from evidlake.functions.running import medians, order_stats, ordinal, previous, running
from evidlake.functions.skew import join_unique


def sample(n=400, seed=3):
    rng = random.Random(seed)
    # One key holds most rows.
    return [("hot" if rng.random() < 0.7 else f"k{i % 5}", i, rng.randint(0, 50), rng.random()) for i in range(n)]


def test_running_matches_a_plain_fold(spark):
    data = sample()
    df = spark.createDataFrame(data, "k string, id bigint, at bigint, x double").withColumn("b", F.floor(F.col("at") / 10))
    out = running(
        df, ["k"], [("b", True), ("at", True)], [("at", True), ("id", True)],
        {"s": (F.col("id"), "sum"), "m": (F.col("x"), "max")},
    ).collect()
    excl = running(df, ["k"], [("b", True)], [("at", True), ("id", True)], {"s": (F.col("id"), "sum")}, inclusive=False)
    before = {r["id"]: r["s"] for r in excl.collect()}
    assert len(out) == len(data)
    for r in out:
        prior = [d for d in data if d[0] == r["k"] and (d[2], d[1]) <= (r["at"], r["id"])]
        assert r["s"] == sum(d[1] for d in prior)
        assert r["m"] == max(d[3] for d in prior)
        assert before[r["id"]] == r["s"] - r["id"]


def test_descending_ordinal_and_previous(spark):
    data = sample()
    df = spark.createDataFrame(data, "k string, id bigint, at bigint, x double").withColumn("b", F.floor(F.col("at") / 7))
    down = ordinal(df, ["k"], [("b", False)], [("at", False), ("id", True)], "n").collect()
    prev = previous(df, ["k"], [("b", True)], ["at", "id"], {"p": F.col("id")}, when=F.col("x") > 0.5).collect()
    for r in down:
        assert r["n"] == 1 + sum(1 for d in data if d[0] == r["k"] and (-d[2], d[1]) < (-r["at"], r["id"]))
    for r in prev:
        earlier = [(d[2], d[1]) for d in data if d[0] == r["k"] and d[3] > 0.5 and (d[2], d[1]) < (r["at"], r["id"])]
        assert r["p"] == (max(earlier)[1] if earlier else None)


def test_order_statistics_are_exact(spark):
    data = sample(801, 9)
    df = spark.createDataFrame(data, "k string, id bigint, at bigint, x double")
    got = {r["k"]: r["m"] for r in medians(df, ["k"], "x", "m").collect()}
    low = {r["k"]: r["q"] for r in order_stats(df, ["k"], "x", {"q": F.floor((F.col("__n") - 1) * 0.05)}).collect()}
    for k in {d[0] for d in data}:
        xs = sorted(d[3] for d in data if d[0] == k)
        assert abs(got[k] - statistics.median(xs)) < 1e-12
        assert low[k] == float(np.quantile(xs, 0.05, method="lower"))


def test_hot_keys_are_spread_and_nothing_is_lost(spark):
    big = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", 1000 + i) for i in range(4)], "k string, id bigint")
    unique = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, v bigint")
    out = {r["id"]: r["v"] for r in join_unique(big, unique, "k", "id").collect()}
    assert len(out) == 304 and out[5] == 1 and out[1001] == 2 and out[1002] is None
    assert join_unique(big, unique, "k", "id", "inner").count() == 301


def test_set_digest_ignores_order_and_sees_change(spark):
    a = [("c", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(50)]
    d = lambda rows: spark.createDataFrame(rows, "g string, h string").groupBy("g").agg(set_digest(F.col("h")).alias("d")).first()["d"]
    assert d(a) == d(a[::-1]) != d(a[1:])
    assert d(a) != d(a + a[:1])


def test_hmac_and_sides(spark):
    row = spark.createDataFrame([("secret-7", "1700000000.{}")], "k string, m string").select(
        X.hmac_sha256(F.encode("k", "utf-8"), F.encode("m", "utf-8")).alias("h")
    ).first()
    assert row["h"] == hmac.new(b"secret-7", b"1700000000.{}", hashlib.sha256).hexdigest()


def test_missing_is_not_zero(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-2.0,), (0.4,)], "x double")
    got = [r["u"] for r in df.select(X.unit(F.col("x")).alias("u")).collect()]
    assert got == [None, None, None, 0.0, 0.4]
    empty = df.select(X.ratio(F.lit(1), F.lit(0)).alias("r")).first()
    assert empty["r"] is None
