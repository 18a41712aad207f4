"""Creator-profile analytics on the embedding table."""

from pyspark.sql import functions as F

from evidlake.functions.expr import r6
from evidlake.operators import geometry as G
from evidlake.operators import profiles as P
from evidlake.plans.registry import query

DIM = 64
_U = "u as (select item_id, profile_key, authorized, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) as v from V_ANCHOR)"
_POOL = _U + ", pl as (select profile_key, n, list(m order by i) as mean from (select profile_key, i, avg(x) as m, count(*) as n from (select profile_key, unnest(v) as x, generate_subscripts(v, 1) as i from u) t group by 1, 2) q group by 1, 2)"
_TAB = _POOL + ", tb as (select u.item_id, u.profile_key as own, pl.profile_key, pl.n, list_dot_product(u.v, pl.mean) as s from u cross join pl)"
_SIM = _U + ", sm as (select a.item_id as q, a.profile_key as qp, b.item_id as r, b.profile_key as rp, list_dot_product(a.v, b.v) as s from u a cross join u b)"


@query(
    "ag21_prototypes",
    f"with {_POOL} select profile_key, n, round(mean[1] / sqrt(list_dot_product(mean, mean)), 6) as first, round(mean[64] / sqrt(list_dot_product(mean, mean)), 6) as last, 'MULTI_WORK_PROFILE' as strength from pl",
)
def ag21(t):
    p = P.prototypes(t.anchors(), DIM)
    return p.select("profile_key", "n", r6(F.col("prototype")[0]).alias("first"), r6(F.col("prototype")[63]).alias("last"), "strength")


@query(
    "jn17_cohesion",
    f"with {_SIM} select qp as profile_key, (select count(*) from u where u.profile_key = qp) as n, round(avg(s), 6) as mean_pairwise from sm where qp = rp and q < r group by 1",
)
def jn17(t):
    return P.cohesion(t.anchors(), DIM).withColumn("mean_pairwise", r6(F.col("mean_pairwise")))


@query(
    "ag22_pool_similarity",
    f"with {_TAB} select item_id as query_id, profile_key, round(s, 6) as score, rank from (select *, row_number() over (partition by item_id order by s desc, profile_key) as rank from tb) z where rank <= 5",
)
def ag22(t):
    u = P.unit_anchors(t.anchors())
    p = P.pools(u, DIM).select("profile_key", F.col("mean").alias("vec"))
    out = P.pool_scores(u.select(F.col("item_id").alias("query_id"), "vec"), p, 5)
    return out.select("query_id", "profile_key", r6(F.col("score")).alias("score"), "rank")


_READOUT = f"""{_SIM}, ad as (select q, avg(s) as d from (select *, row_number() over (partition by q order by s desc, r) as k from sm where q <> r) t where k <= 15 group by q),
        qd as (select q, avg(s) as d from (select *, row_number() over (partition by q order by s desc, r) as k from sm) t where k <= 15 group by q),
        c as (select sm.q, sm.rp, avg(sm.s) as raw, 2 * avg(sm.s) - max(qd.d) - avg(ad.d) as readout from sm join ad on ad.q = sm.r join qd on qd.q = sm.q group by all)"""


def _ranks(score: str, method: str) -> str:
    return f"""with {_READOUT}, r as (select *, row_number() over w as rank, count(*) over (partition by q) as profiles, avg(raw) over (partition by q) as mu, stddev_pop(raw) over (partition by q) as sd, {score} - lead({score}) over w as margin,
         cume_dist() over (partition by q order by round({score}, 9)) as cp from c window w as (partition by q order by {score} desc, rp))
       select q as query_id, rp as profile_key, rank, '{method}' as method, round({score}, 6) as readout, round(raw, 6) as raw, round(cp, 6) as catalog_percentile, round(case when profiles >= 3 and sd > 1e-6 then (raw - mu) / sd end, 6) as z, round(margin, 6) as margin from r where rank <= 5"""


@query("wn4_profile_rank", _ranks("readout", "CSD_PLUS_CSLS"))
def wn4(t):
    return rounded_ranks(P.profile_rank(t.anchors(), DIM))


@query("wn4_profile_rank_raw", _ranks("raw", "RAW_POOL_COSINE"))
def wn4_raw(t):
    return rounded_ranks(P.profile_rank(t.anchors(), DIM, learned=False))


def rounded_ranks(out):
    return out.select("query_id", "profile_key", "rank", "method", *[r6(F.col(c)).alias(c) for c in ("readout", "raw", "catalog_percentile", "z", "margin")])


@query(
    "ag23_csls",
    f"""with {_SIM}, ad as (select q, avg(s) as d from (select *, row_number() over (partition by q order by s desc, r) as k from sm where q <> r) t where k <= 15 group by q),
        qd as (select q, avg(s) as d from (select *, row_number() over (partition by q order by s desc, r) as k from sm) t where k <= 15 group by q),
        c as (select sm.q, sm.rp, 2 * avg(sm.s) - max(qd.d) - avg(ad.d) as csls from sm join ad on ad.q = sm.r join qd on qd.q = sm.q group by all)
        select q as query_id, rp as profile_key, rank, round(csls, 6) as csls from (select *, row_number() over (partition by q order by csls desc, rp) as rank from c) z where rank <= 5""",
)
def ag23(t):
    return P.csls(t.anchors(), DIM).select("query_id", "profile_key", "rank", r6(F.col("csls")).alias("csls"))


_NEAR3 = f"{_SIM}, n3 as (select * from (select *, row_number() over (partition by q order by s desc, r) as k from sm where qp = rp and q <> r) t where k <= 3)"


@query("wn9_exemplars", f"with {_NEAR3} select q as item_id, r as exemplar_id, k as rank from n3")
def wn9(t):
    return P.exemplars(t.anchors(), 3).select(F.col("query_id").alias("item_id"), F.col("ref_id").alias("exemplar_id"), "rank")


@query(
    "ag24_robust_member",
    f"""with {_NEAR3}, pl as (select profile_key, list(m order by i) as mean from (select profile_key, i, avg(x) as m from (select profile_key, unnest(v) as x, generate_subscripts(v, 1) as i from u) t group by 1, 2) q group by 1),
        rb as (select q, median(s) as robust from n3 group by 1)
        select u.item_id, round(rb.robust, 6) as robust, round(d, 6) as prototype_similarity, round(0.65e0 * d + 0.35e0 * rb.robust, 6) as profile_similarity
        from (select item_id, list_dot_product(v, mean) / sqrt(list_dot_product(mean, mean)) as d from u join pl using (profile_key)) u join rb on rb.q = u.item_id""",
)
def ag24(t):
    out = P.robust_member(t.anchors(), DIM)
    return out.select(F.col("query_id").alias("item_id"), *[r6(F.col(c)).alias(c) for c in ("robust", "prototype_similarity", "profile_similarity")])


@query(
    "ag25_discrimination_gap",
    f"""with {_SIM}, w as (select qp, median(s) as wm from (select q, qp, avg(s) as s from sm where qp = rp and q <> r group by all) t group by 1),
        c as (select qp, rp, median(s) as m from (select q, qp, rp, avg(s) as s from sm where qp <> rp group by all) t group by 1, 2), x as (select qp, max(m) as m, arg_max(rp, (m, rp)) as rp from c group by 1)
        select qp as profile_key, round(wm, 6) as within_median, round(x.m, 6) as worst_cross_median, x.rp as worst_cross_profile, round(wm - x.m, 6) as gap from w join x using (qp)""",
)
def ag25(t):
    g = P.discrimination_gap(t.anchors(), DIM)
    return g.select("profile_key", r6(F.col("within_median")).alias("within_median"), r6(F.col("worst_cross_median")).alias("worst_cross_median"), "worst_cross_profile", r6(F.col("gap")).alias("gap"))


@query(
    "ag26_empirical_support",
    f"""with {_TAB}, ng as (select profile_key, s from tb where own <> profile_key), ps as (select profile_key, (s * n - 1) / (n - 1) as s from tb where own = profile_key),
        qs as (select item_id, profile_key, s from tb where own = profile_key),
        a as (select qs.item_id, qs.profile_key, (1e0 + count(*) filter (where ng.s >= qs.s)) / (count(*) + 1e0) as raw from qs join ng using (profile_key) group by all),
        b as (select qs.item_id, (1e0 + count(*) filter (where ps.s <= qs.s)) / (count(*) + 1e0) as pp from qs join ps using (profile_key) group by all),
        u2 as (select ps.profile_key, avg(case when ps.s > ng.s then 1e0 when ps.s = ng.s then 0.5e0 else 0e0 end) as auc from ps join ng using (profile_key) group by 1)
        select a.item_id, a.profile_key, round(raw, 6) as tail_p_raw, round(least(1e0, raw * (select count(*) from pl)), 6) as tail_p, round(pp, 6) as positive_percentile, round(auc, 6) as separation_auc, '' as reason_codes, true as ready from a join b using (item_id) join u2 using (profile_key)""",
)
def ag26(t):
    e = P.empirical_support(t.anchors(), DIM)
    return e.select("item_id", "profile_key", *[r6(F.col(c)).alias(c) for c in ("tail_p_raw", "tail_p", "positive_percentile", "separation_auc")], "reason_codes", "ready")


@query(
    "ag35_histogram_features",
    """with h as (select item_id, profile_key, list_transform(range(0, 8), lambda b: len(list_filter(embedding, lambda x: least(floor((x + 0.4e0) / 0.8e0 * 8), 7) = b)) / 64e0) as h from V_ANCHOR),
        n as (select item_id - 1 as item_id, h as g from h)
        select item_id, round(h[4], 6) as bin_four, round(list_sum(list_transform(range(1, 9), lambda k: least(h[k], g[k]))), 6) as intersection from h join n using (item_id)""",
)
def ag35(t):
    h = t.anchors().select("item_id", G.histogram(F.col("embedding").cast("array<double>"), 8, -0.4, 0.4).alias("h"))
    nxt = h.select((F.col("item_id") - 1).alias("item_id"), F.col("h").alias("g"))
    return h.join(nxt, "item_id").select("item_id", r6(F.col("h")[3]).alias("bin_four"), r6(G.intersection(F.col("h"), F.col("g"))).alias("intersection"))
