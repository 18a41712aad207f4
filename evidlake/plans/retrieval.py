"""Retrieval, near duplicates, coverage and the flagship."""

from pyspark.sql import functions as F

from evidlake.functions.digest import set_digest_sql
from evidlake.functions.expr import hamming, r6
from evidlake.operators import cones
from evidlake.operators import coverage as C
from evidlake.operators import similarity as S
from evidlake.plans.registry import query
from evidlake.plans.views import DIGESTS, MINIMUM, SHINGLES
from evidlake.sources.tables import Tables


def vectors(t: Tables, scope: str = "0L"):
    a = t.anchors()
    q = a.selectExpr("item_id as query_id", f"{scope} as scope", "embedding as vec")
    r = a.selectExpr("item_id as ref_id", f"{scope} as scope", "embedding as vec")
    return q, r


def top(t: Tables, k: int, scope: str = "0L"):
    q, r = vectors(t, scope)
    return S.nearest(q, r, k, scoped=scope != "0L")


_TOP = "select * from (select query_id, ref_id, expected_profile, known, profile_key, sim, row_number() over (partition by query_id order by sim desc, ref_id) as rank from V_QREF {0}) z where rank <= {1}"


@query("jn1_cosine_top", f"select query_id, ref_id, round(sim, 6) as similarity, rank from ({_TOP.format('', 10)}) t")
def jn1(t):
    return top(t, 10).select("query_id", "ref_id", r6(F.col("similarity")).alias("similarity"), "rank")


# Vectors in ten clusters, one for each label.
_CLUSTERED = "list_transform(embedding, lambda x, i: cast(x as double) * 0.2e0 + case when i - 1 = label % 64 then 1e0 else 0e0 end)"
_CLUSTER_SIM = f"""with c as (select vec_id, {_CLUSTERED} as e from embeddings), n as (select vec_id, e, sqrt(list_dot_product(e, e)) as size from c),
  s as (select q.vec_id as query_id, r.vec_id as ref_id, list_dot_product(q.e, r.e) / (q.size * r.size) as sim from n q join n r on q.vec_id <> r.vec_id)"""


def clustered(t: Tables):
    v = t.raw("embeddings").select(
        F.col("vec_id"), F.transform("embedding", lambda x, i: x.cast("double") * 0.2 + F.when(i == F.col("label") % 64, 1.0).otherwise(0.0)).alias("vec")
    )
    return v.withColumnRenamed("vec_id", "query_id"), cones.build(v.withColumnRenamed("vec_id", "ref_id"), leaf_rows=32)


@query(
    "jn1_cone_search",
    f"{_CLUSTER_SIM}, k as (select *, row_number() over (partition by query_id order by round(sim, 12) desc, ref_id) as rank from s) select query_id, ref_id, round(sim, 6) as similarity, rank from k where rank <= 5",
)
def jn1_cones(t):
    q, index = clustered(t)
    return cones.nearest(q, index, 5).select("query_id", "ref_id", r6(F.col("similarity")).alias("similarity"), "rank")


@query("jn1_cone_threshold", f"{_CLUSTER_SIM} select query_id, ref_id, round(sim, 6) as similarity from s where round(sim, 12) >= 0.97")
def jn1_threshold(t):
    q, index = clustered(t)
    return cones.within(q, index, 0.97).select("query_id", "ref_id", r6(F.col("similarity")).alias("similarity"))


@query("jn1_cone_cost")
def jn1_cost(t):
    """Leaves visited, references scored and their share of all, for each query."""
    q, index = clustered(t)
    return cones.cost(q, index, 5)


@query(
    "wn5_nearest_within_profile",
    f"select query_id as item_id, ref_id as neighbour_id, round(sim, 6) as similarity, rank from ({_TOP.format('where expected_profile = profile_key', 5)}) t",
)
def wn5(t):
    out = top(t, 5, "profile_key")
    return out.select(F.col("query_id").alias("item_id"), F.col("ref_id").alias("neighbour_id"), r6(F.col("similarity")).alias("similarity"), "rank")


@query(
    "jn2_exact_matches",
    "select * from (select work_id, min(work_id) over (partition by sha256) as first_id, count(*) over (partition by sha256) as copies from V_WORK) t where work_id <> first_id",
)
def jn2(t):
    return S.exact_matches(t.works().select("work_id", "sha256")).select("work_id", "first_id", "copies")


@query(
    "jn3_hamming_join",
    """with d as (select hi, lo, min(item_id) as item_id, count(*) as copies from V_FP group by 1, 2)
       select a.item_id, b.item_id as other_id, bit_count(xor(a.hi, b.hi))::bigint + bit_count(xor(a.lo, b.lo))::bigint as distance, a.copies, b.copies as other_copies
       from d a join d b on a.item_id < b.item_id where bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3""",
)
def jn3(t):
    return S.hamming_join(t.fingerprints(), 3, 6)


_BANDS = "union all ".join(
    f"select doc_id, concat('{b}-', {MINIMUM.format(1 + 16 * b)}, '-', {MINIMUM.format(9 + 16 * b)}) as bucket from t "
    for b in range(4)
)


_SETS = f"""with s as (select doc_id, list_sort({SHINGLES.format("text")}) as g from documents), k as (select doc_id, g, min(doc_id) over (partition by g) as class_id from s),
  t as (select class_id, len(g) as n, unnest(g) as gram from k where doc_id = class_id)"""


@query(
    "jn4_similar_sets",
    f"""{_SETS}, m as (select x.class_id as a, y.class_id as b, count(*) as shared, any_value(x.n) + any_value(y.n) as total from t x join t y on x.gram = y.gram and x.class_id < y.class_id group by 1, 2)
       select a, b, shared, round(shared / (total - shared), 6) as jaccard from m where shared / (total - shared) >= 0.8""",
)
def jn4_sets(t):
    """Pairs of different documents with a Jaccard similarity of 0.8 or more of their word shingles."""
    pairs = S.similar_items(t.raw("documents"), "doc_id", "text")
    return pairs.withColumn("jaccard", r6(F.col("jaccard")))


@query("jn4_classes", f"{_SETS} select doc_id as item_id, class_id, len(g)::bigint as size from k")
def jn4_classes(t):
    """The class of equal shingle sets each document belongs to."""
    return S.shingle_sets(t.raw("documents"), "doc_id", "text").drop("grams")


@query(
    "jn4_near_duplicate_candidates",
    f"""with t as (select doc_id, {DIGESTS.format('text')} as d from documents), m as ({_BANDS}),
       e as (select doc_id, min(doc_id) over (partition by bucket) as leader from m)
       select doc_id as work_id, leader as candidate_id, count(*) as shared_bands from e where doc_id <> leader group by all""",
)
def jn4(t):
    return S.lsh_candidates(t.texts().withColumnRenamed("doc_id", "work_id"), "work_id", "text")


_LATEST = "select work_id, max(version) as version, arg_max(sha256, version) as version_sha256 from V_VERSION group by 1"


@query(
    "jn5_latest_version",
    f"select w.work_id, v.version, v.version_sha256, case when v.version is null then 'ASSET_VERSION_MISSING' else 'CURRENT' end as version_state from V_WORK w left join ({_LATEST}) v using (work_id)",
)
def jn5(t):
    works = t.works().select("work_id")
    return S.with_latest_version(works, t.versions()).withColumnRenamed("sha256", "version_sha256")


@query("wn3_latest_per_key", _LATEST)
def wn3(t):
    return S.latest(t.versions(), ["work_id"], "version", ["sha256"]).withColumnRenamed("sha256", "version_sha256")


_VIEWSQL = """v as (select item_id as query_id, 'whole' as view, embedding as vec from V_ANCHOR
     union all select item_id, 'region_head', embedding[1:40] || list_transform(generate_series(1, 24), lambda i: 0e0) from V_ANCHOR
     union all select item_id, 'region_tail', list_transform(generate_series(1, 24), lambda i: 0e0) || embedding[25:64] from V_ANCHOR),
  s as (select v.query_id, v.view, r.item_id as ref_id, list_dot_product(v.vec, r.embedding) / (sqrt(list_dot_product(v.vec, v.vec)) * sqrt(list_dot_product(r.embedding, r.embedding)))
          - case when v.view = 'whole' then 0e0 else 0.02e0 end as score from v cross join V_ANCHOR r where r.item_id <> v.query_id),
  b as (select query_id, ref_id, max(score) as score, arg_max(view, (score, view)) as view from s group by all)"""


@query(
    "jn6_regional_best",
    f"with {_VIEWSQL} select query_id, ref_id, round(score, 6) as score, view, rank from (select *, row_number() over (partition by query_id order by score desc, ref_id) as rank from b) t where rank <= 8",
)
def jn6(t):
    from pyspark.sql.window import Window

    a = t.anchors()
    zero = "transform(sequence(1, 24), i -> 0D)"
    e = "cast(embedding as array<double>)"
    views = a.selectExpr(
        "item_id",
        f"explode(array(struct('whole' as view, 0L as n, {e} as vec), struct('region_head' as view, 1L as n, concat(slice({e}, 1, 40), {zero}) as vec), "
        f"struct('region_tail' as view, 2L as n, concat({zero}, slice({e}, 25, 40)) as vec))) as v",
    )
    # A view is its own query; ids are restored after the search.
    q = views.selectExpr("item_id * 4 + v.n as query_id", "0L as scope", "v.vec as vec")
    r = a.selectExpr("item_id as ref_id", "0L as scope", "embedding as vec")
    hits = S.nearest(q, r, 9, exclude_self=False).selectExpr(
        "floor(query_id / 4) as query_id", "element_at(array('whole', 'region_head', 'region_tail'), cast(query_id % 4 + 1 as int)) as view",
        "ref_id", "similarity",
    ).where("query_id <> ref_id")
    best = S.regional_best(hits)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ref_id")
    return best.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 8").select(
        "query_id", "ref_id", r6(F.col("score")).alias("score"), "view", "rank"
    )


_DIST = "bit_count(xor(a.hi, b.hi))::bigint + bit_count(xor(a.lo, b.lo))::bigint"
_CAND = f"""select t.query_id, t.ref_id, t.sim, {_DIST} as distance, t.profile_key, t.expected_profile from ({_TOP.format('', 8)}) t
  join V_BITS a on a.item_id = t.query_id join V_BITS b on b.item_id = t.ref_id"""


def candidates(t: Tables):
    """The eight nearest of every vector with fingerprint distance and exact-bits flag."""
    near = top(t, 8)
    bits = t.vector_bits()
    q = bits.selectExpr("item_id as query_id", "hi as q_hi", "lo as q_lo")
    r = bits.selectExpr("item_id as ref_id", "hi as r_hi", "lo as r_lo")
    d = hamming(F.col("q_hi"), F.col("q_lo"), F.col("r_hi"), F.col("r_lo"))
    return near.join(q, "query_id").join(r, "ref_id").select(
        "query_id", "ref_id", "similarity", d.alias("distance"), (d == 0).alias("exact")
    )


@query(
    "wn1_retrieval_rank",
    f"select query_id, ref_id, round(sim, 6) as similarity, distance, row_number() over (partition by query_id order by case when distance = 0 then 0 else 1 end, sim desc, distance, ref_id) as retrieval_rank from ({_CAND}) c",
)
def wn1(t):
    return S.rank_candidates(candidates(t)).select("query_id", "ref_id", r6(F.col("similarity")).alias("similarity"), "distance", "retrieval_rank")


@query(
    "tk1_adaptive_bound",
    """select query_id, ref_id, rank from (select query_id, ref_id, row_number() over (partition by query_id order by sim desc, ref_id) as rank, count(*) over (partition by query_id) as total
         from V_QREF where expected_profile = profile_key) t where rank <= case when total <= 64 then total else 8 end""",
)
def tk1(t):
    near = top(t, S.EXHAUSTIVE_MAX, "profile_key")
    a = t.anchors()
    sizes = a.groupBy("profile_key").agg((F.count(F.lit(1)) - 1).alias("total"))
    own = a.select(F.col("item_id").alias("query_id"), "profile_key").join(sizes, "profile_key")
    return near.join(own, "query_id").where(F.col("rank") <= S.bounded_limit(F.col("total"))).select("query_id", "ref_id", "rank")


@query("tk2_top_three", f"select query_id, ref_id, rank from ({_TOP.format('', 3)}) t")
def tk2(t):
    return top(t, 3).select("query_id", "ref_id", "rank")


def ranked_truth(t: Tables, k: int = 10):
    a = t.anchors()
    q = a.selectExpr("item_id as query_id", "profile_key as expected", "profile_key <> 9 as known")
    r = a.selectExpr("item_id as ref_id", "profile_key")
    return top(t, k).join(q, "query_id").join(r, "ref_id").selectExpr(
        "query_id", "rank", "similarity", "known", "expected = profile_key as relevant", "expected % 2 as half"
    )


@query(
    "ag44_retrieval_quality",
    f"""with r as (select *, expected_profile % 2 as half from ({_TOP.format('', 10)}) t), f as (select query_id, known, half, min(rank) filter (where expected_profile = profile_key) as fr from r group by all)
       select half, count(*) filter (where known) as known_queries, round(avg(case when fr <= 1 then 1e0 else 0e0 end) filter (where known), 6) as recall_at_1,
        round(avg(case when fr <= 5 then 1e0 else 0e0 end) filter (where known), 6) as recall_at_5, round(avg(case when fr <= 10 then 1e0 else 0e0 end) filter (where known), 6) as recall_at_10,
        round(avg(fr) filter (where known), 6) as mean_first_rank from f group by half""",
)
def ag44(t):
    m = S.retrieval_metrics(ranked_truth(t), ["half"])
    cols = ("recall_at_1", "recall_at_5", "recall_at_10", "mean_first_rank")
    return m.select("half", "known_queries", *[r6(F.col(c)).alias(c) for c in cols])


@query(
    "ag45_open_set",
    f"select known, count(*) as queries, round(avg(case when sim < 0.3 then 1e0 else 0e0 end), 6) as rejected from ({_TOP.format('', 1)}) t group by known",
)
def ag45(t):
    return S.open_set(ranked_truth(t, 1), 0.3).select("known", "queries", r6(F.col("rejected")).alias("rejected"))


_FLAG = f"""with c as (select *, row_number() over (partition by query_id order by case when distance = 0 then 0 else 1 end, sim desc, distance, ref_id) as rk from ({_CAND}) q),
   n as (select count(*) - 1 as total from V_ANCHOR),
   s as (select query_id, max(sim) as top, count(*) as cand from c group by 1)
   select c.query_id, c.ref_id, round(c.sim, 6) as similarity, c.distance, c.rk as retrieval_rank,
     case when s.cand < (select total from n) then 'TRUNCATED' else 'COMPLETE' end as coverage_status,
     case when s.top >= 0.5 then 'MATCH_FOUND' when s.top >= 0.35 then 'INCONCLUSIVE' when s.cand >= (select total from n) then 'NO_MATCH_IN_CHECKED_SOURCES' else 'SCOPE_INCOMPLETE' end as match_status
   from c join s using (query_id) where c.rk <= 5"""


@query("flagship_retrieval_decision", _FLAG)
def flagship(t):
    from pyspark.sql.window import Window

    # Ranking a scan's eight candidates: the window sees at most eight rows per scan.
    ranked = S.rank_candidates(candidates(t))
    total = t.anchors().agg((F.count(F.lit(1)) - 1).alias("n")).select("n").scalar()
    w = Window.partitionBy("query_id")
    out = ranked.withColumn("__top", F.max("similarity").over(w)).withColumn("__cand", F.count(F.lit(1)).over(w))
    complete = F.col("__cand") >= total
    return out.where("retrieval_rank <= 5").select(
        "query_id", "ref_id", r6(F.col("similarity")).alias("similarity"), "distance", "retrieval_rank",
        F.when(complete, "COMPLETE").otherwise("TRUNCATED").alias("coverage_status"),
        C.match_decision(F.col("__top") >= 0.5, F.col("__top") >= 0.35, complete).alias("match_status"),
    )


# -- coverage ------------------------------------------------------------------------------------
_COV = "select scan_id, ref_id, is_candidate, is_candidate and outcome >= 2 as is_verified, case when outcome = 0 and ref_id % 2 = 0 then 'ASSET' when outcome = 0 and is_candidate then 'VERIFICATION' end as failure from V_COVER"


def cover(t: Tables):
    return t.coverage_rows().selectExpr(
        "scan_id", "ref_id", "is_candidate", "is_candidate and outcome >= 2 as is_verified",
        "case when outcome = 0 and ref_id % 2 = 0 then 'ASSET' when outcome = 0 and is_candidate then 'VERIFICATION' end as failure",
    )


_SNAP = f"""select scan_id, eligible, candidates, verified, greatest(0, eligible - candidates) as omitted, af + vf as failed,
    case when dr <> eligible or af > 0 then 'FAILED' when candidates > 0 and verified = 0 and vf > 0 then 'FAILED' when vf > 0 or verified < candidates then 'PARTIAL'
      when candidates < eligible then 'TRUNCATED' else 'COMPLETE' end as coverage_status,
    concat_ws('|', case when dr <> eligible then 'COVERAGE_MANIFEST_INCONSISTENT' end, case when af > 0 then 'REQUIRED_LEARNED_RETRIEVAL_INCOMPLETE' end, case when candidates < eligible then 'CANDIDATE_VERIFICATION_TRUNCATED' end,
      case when af + vf > 0 then 'CANDIDATE_VERIFICATION_FAILURE' end, case when verified < candidates and vf = 0 then 'CANDIDATE_VERIFICATION_PARTIAL' end) as reason_codes, snapshot_digest
  from (select scan_id, count(*) as eligible, count(distinct ref_id) as dr, count(*) filter (where is_candidate) as candidates, count(*) filter (where is_verified) as verified,
     count(*) filter (where failure = 'ASSET') as af, count(*) filter (where failure = 'VERIFICATION') as vf,
     {set_digest_sql("sha256(concat_ws('|', ref_id, is_candidate, is_verified, coalesce(failure, '')))")} as snapshot_digest from ({_COV}) c group by scan_id) g"""


_DECLARED = """select o_orderkey as scan_id, coalesce(n, 0) + case when o_orderkey % 37 = 0 then 1 else 0 end as declared_total, case when o_orderkey % 6 = 0 then 'UNAVAILABLE' else 'EXECUTED' end as query_state,
    case when o_orderkey % 3 = 0 then 'LEARNED_REQUIRED' else 'BASELINE_ALLOWED' end as requirement from orders left join (select scan_id, count(*) as n from V_COVER group by 1) c on c.scan_id = o_orderkey"""
_SNAP6 = f"""with r as (select *, case when ref_id % 29 = 0 then 'UNAVAILABLE' else 'EXECUTED' end as learned_state, case when failure is null and ref_id % 31 = 0 then 'REFERENCE' else failure end as fail from ({_COV}) c),
  g as (select scan_id, count(*) as listed, count(distinct ref_id) as dr, count(*) filter (where is_candidate) as candidates, count(*) filter (where is_verified) as verified, count(*) filter (where fail = 'ASSET') as af,
     count(*) filter (where fail = 'VERIFICATION') as vf, count(*) filter (where fail = 'REFERENCE') as rf, count(*) filter (where learned_state = 'EXECUTED') as ai,
     {set_digest_sql("sha256(concat_ws('|', ref_id, is_candidate, is_verified, coalesce(fail, ''), learned_state))")} as snapshot_digest, {set_digest_sql("sha256(cast(ref_id as varchar))")} as catalog_digest from r group by 1),
  s as (select d.scan_id, declared_total as total, coalesce(listed, 0) as listed, coalesce(dr, 0) as dr, coalesce(candidates, 0) as candidates, coalesce(verified, 0) as verified, coalesce(af, 0) as af, coalesce(vf, 0) as vf, snapshot_digest, catalog_digest,
     requirement = 'LEARNED_REQUIRED' and not (query_state = 'EXECUTED' and coalesce(ai, 0) = declared_total and coalesce(af, 0) + coalesce(rf, 0) = 0) as short, coalesce(listed, 0) <> declared_total or coalesce(dr, 0) <> coalesce(listed, 0) as odd
     from ({_DECLARED}) d left join g on g.scan_id = d.scan_id)
  select scan_id, total as eligible, candidates, verified, greatest(0, total - candidates) as omitted, af + vf as failed,
    case when odd or af > 0 then 'FAILED' when total = 0 then 'EMPTY_SCOPE' when candidates > 0 and verified = 0 and vf > 0 then 'FAILED' when short then 'DEGRADED' when af + vf > 0 or verified < candidates then 'PARTIAL' when candidates < total then 'TRUNCATED' else 'COMPLETE' end as coverage_status,
    concat_ws('|', case when odd then 'COVERAGE_MANIFEST_INCONSISTENT' end, case when total = 0 then 'DECLARED_CATALOG_EMPTY' end, case when short then 'REQUIRED_LEARNED_RETRIEVAL_INCOMPLETE' end, case when candidates < total then 'CANDIDATE_VERIFICATION_TRUNCATED' end,
      case when af + vf > 0 then 'CANDIDATE_VERIFICATION_FAILURE' end, case when verified < candidates and vf = 0 then 'CANDIDATE_VERIFICATION_PARTIAL' end) as reason_codes, snapshot_digest, catalog_digest from s"""


def declared_scans(t: Tables):
    sizes = t.coverage_rows().groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    return t.raw("orders").select(F.col("o_orderkey").alias("scan_id")).join(sizes, "scan_id", "left").selectExpr(
        "scan_id", "coalesce(n, 0) + if(scan_id % 37 = 0, 1, 0) as declared_total", "if(scan_id % 6 = 0, 'UNAVAILABLE', 'EXECUTED') as query_state",
        "if(scan_id % 3 = 0, 'LEARNED_REQUIRED', 'BASELINE_ALLOWED') as requirement",
    )


@query("ag37_coverage_snapshot", _SNAP6)
def ag37(t):
    """Every order is a declared scan: some have no rows, some declare more than was listed, some lack the learned query."""
    rows = cover(t).withColumn("learned_state", F.expr("if(ref_id % 29 = 0, 'UNAVAILABLE', 'EXECUTED')"))
    rows = rows.withColumn("failure", F.expr("if(failure is null and ref_id % 31 = 0, 'REFERENCE', failure)"))
    return C.coverage_snapshot(rows, declared_scans(t))


@query(
    "prj17_coverage_breakdown",
    f"select scan_id, eligible, verified, omitted, failed, greatest(0, eligible - verified - omitted - failed) as screened_out, greatest(eligible, verified + omitted + failed) as total from ({_SNAP}) s",
)
def prj17(t):
    return C.coverage_breakdown(C.coverage_snapshot(cover(t)))


@query(
    "st1_omitted",
    "select distinct scan_id, ref_id, 'CANDIDATE_LIMIT' as reason_code from V_COVER m where not exists (select 1 from V_COVER c where c.is_candidate and c.scan_id = m.scan_id and c.ref_id = m.ref_id)",
)
def st1(t):
    return C.omitted(t.coverage_rows())


@query(
    "st2_manifest_consistent",
    """with p as (select scan_id, ref_id, count(*) filter (where outcome <> 5) as m, count(*) filter (where is_candidate) as c, count(*) filter (where outcome >= 3) as v, count(*) filter (where outcome = 0) as f from V_COVER group by all)
       select scan_id, count(*) filter (where c > 0 and m = 0) as stray_candidates, count(*) filter (where v > 0 and c = 0) as stray_verified, count(*) filter (where f > 0 and m = 0) as stray_failed,
         count(*) filter (where m > 1) as duplicates, count(*) filter (where (c > 0 and m = 0) or (v > 0 and c = 0) or (f > 0 and m = 0) or m > 1) = 0 as consistent from p where m + c + v + f > 0 group by scan_id""",
)
def st2(t):
    r = t.coverage_rows()
    return C.manifest_consistent(r.where("outcome <> 5"), r.where("is_candidate"), r.where("outcome >= 3"), r.where("outcome = 0"))


@query(
    "st3_union_failures",
    "select distinct scan_id, ref_id from V_COVER where outcome = 0 or (is_candidate and outcome = 1)",
)
def st3(t):
    r = t.coverage_rows()
    return C.union_failures((r.where("outcome = 0"), "asset"), (r.where("is_candidate and outcome = 1"), "verification"))


@query(
    "st5_still_present",
    "select scan_id, ref_id from V_COVER where is_candidate intersect select scan_id, ref_id from V_COVER where outcome <= 3",
)
def st5(t):
    r = t.coverage_rows()
    return C.still_present(r.where("is_candidate"), r.where("outcome <= 3"))


@query(
    "ag39_deletion_receipts",
    """select *, case when requested = 0 then 'NOTHING_REQUESTED' when still_present > 0 then 'DELETION_INCOMPLETE' when retained > 0 then 'DELETED_WITH_RETENTION' else 'DELETED' end as state from (
         select scan_id, count(*) filter (where is_candidate) as requested, count(*) filter (where is_candidate and outcome >= 3) as deleted, count(*) filter (where is_candidate and outcome = 2) as retained,
           count(*) filter (where is_candidate and outcome < 1) as still_present from V_COVER group by scan_id) t""",
)
def ag39(t):
    rows = t.coverage_rows().selectExpr(
        "scan_id", "is_candidate as requested", "outcome >= 3 as deleted", "outcome = 2 as retained", "outcome < 1 as present"
    )
    return C.deletion_receipts(rows)


@query(
    "ag38_catalog_digest",
    f"select *, concat('manifest_', substr(digest, 1, 20)) as catalog_version from (select tenant_id, catalog_id, count(*) as members, {set_digest_sql(chr(115) + 'ha256(concat_ws(chr(124), work_id, sha256))')} as digest from V_WORK group by all) t",
)
def ag38(t):
    return C.catalog_digest(t.works(), ["tenant_id", "catalog_id"])


# -- text pairs ----------------------------------------------------------------------------------
_DOCSH = "select doc_id, unnest(sh) as s from (select doc_id, " + SHINGLES.format("text") + " as sh from documents) q"
_ITEMSH = "select item_id, len(sh) as n, unnest(sh) as s from (select item_id, " + SHINGLES.format("text") + " as sh from benchmark) q"
PAIR_SQL = f"select doc_id, item_id, count(*) as shared, max(n)::bigint as passage_shingles from ({_DOCSH}) d join ({_ITEMSH}) i using (s) group by all"


def pairs(t: Tables):
    return S.nominate_by_shingles(t.texts(), t.raw("benchmark"))


def containment(doc_id: int, item_id: int, text: str, passage: str) -> float:
    """Share of a passage's shingles found in the document; one pair in 17 fails on purpose."""
    if (doc_id + item_id) % 17 == 0:
        raise ValueError("unreadable pair")

    def sh(s: str) -> set[str]:
        w = s.split(" ")
        return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    want = sh(passage)
    return len(want & sh(text)) / len(want)


@query(
    "jn22_pair_verification",
    f"select doc_id, item_id, round(shared / passage_shingles, 6) as score from ({PAIR_SQL}) p",
)
def jn22(t):
    return pairs(t).select("doc_id", "item_id", r6(F.col("shared") / F.col("passage_shingles")).alias("score"))


@query(
    "udf4_pair_plugin",
    f"select doc_id, item_id, case when (doc_id + item_id) % 17 = 0 then null else round(shared / passage_shingles, 6) end as score, case when (doc_id + item_id) % 17 = 0 then 'VERIFICATION_FAILED:ValueError' end as error from ({PAIR_SQL}) p",
)
def udf4(t):
    out = S.verify_pairs(pairs(t), t.raw("documents"), t.raw("benchmark"), containment)
    return out.select("doc_id", "item_id", r6(F.col("score")).alias("score"), "error")
