"""Model evaluation, corpus binding, acceptance and calibration."""

from pyspark.sql import functions as F

from evidlake.functions.expr import joined, r6
from evidlake.operators import acceptance as A
from evidlake.operators import evaluation as V
from evidlake.plans.registry import query
from evidlake.plans.views import h32
from evidlake.sources import manifest as M

_AUC = """select grp, sum(case when a.score > b.score then 1e0 when a.score = b.score then 0.5e0 else 0e0 end) / count(*) as auc
  from (select grp, score from V_SCORE where label = 1) a join (select grp, score from V_SCORE where label = 0) b using (grp) group by grp"""


@query("ag8_roc_auc", f"select g.grp, round(auc, 6) as auc from (select distinct grp from V_SCORE) g left join ({_AUC}) t on t.grp = g.grp")
def ag8(t):
    return V.roc_auc(t.scores(), ["grp"]).select("grp", r6(F.col("auc")).alias("auc"))


_RANKED = """select *, row_number() over (partition by grp order by score desc, asset_id) as rank,
   sum(label) over (partition by grp order by score desc, asset_id rows unbounded preceding)::bigint as tp from V_SCORE"""


@query(
    "ag9_average_precision",
    f"select grp, round(sum(case when label = 1 then tp / rank end) / nullif(sum(label), 0), 6) as average_precision from ({_RANKED}) t group by grp",
)
def ag9(t):
    ap = V.average_precision(t.scores(), ["grp"], "asset_id")
    return ap.select("grp", r6(F.col("average_precision")).alias("average_precision"))


@query(
    "wn10_running_precision",
    f"select asset_id, grp, rank, tp, round(tp / rank, 6) as precision_so_far from ({_RANKED}) t",
)
def wn10(t):
    return V.running_precision(t.scores(), ["grp"], "asset_id").select(
        "asset_id", "grp", "rank", F.col("tp").cast("bigint").alias("tp"), r6(F.col("precision_so_far")).alias("precision_so_far")
    )


_CONF = """select grp, count(*) filter (where score >= 0.5 and label = 1) as tp, count(*) filter (where score >= 0.5 and label = 0) as fp,
  count(*) filter (where score < 0.5 and label = 0) as tn, count(*) filter (where score < 0.5 and label = 1) as fn,
  count(*) filter (where score >= 0.4 and score < 0.5) as rev from V_SCORE group by grp"""


@query(
    "ag10_confusion",
    f"""select grp, tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall,
      round(tn / nullif(tn + fp, 0), 6) as specificity, round(fp / nullif(tn + fp, 0), 6) as fpr, round(rev / nullif(tp + fp + tn + fn, 0), 6) as review_rate from ({_CONF}) t""",
)
def ag10(t):
    out = V.confusion(t.scores(), ["grp"], 0.5, 0.4)
    rates = ("precision", "recall", "specificity", "fpr", "review_rate")
    return out.select("grp", "tp", "fp", "tn", "fn", *[r6(F.col(c)).alias(c) for c in rates])


@query(
    "ag11_selective",
    """select grp, count(*) as rows, count(*) filter (where a) as abstained, round(count(*) filter (where not a and (score >= 0.5) = (label = 1)) / nullif(count(*) filter (where not a), 0), 6) as selective_accuracy,
      round(count(*) filter (where not a) / count(*), 6) as coverage from (select *, score >= 0.45 and score < 0.55 as a from V_SCORE) t group by grp""",
)
def ag11(t):
    return V.selective(t.scores(), ["grp"]).select(
        "grp", "rows", "abstained", r6(F.col("selective_accuracy")).alias("selective_accuracy"), r6(F.col("coverage")).alias("coverage")
    )


@query(
    "ag12_wilson",
    """select source_lineage_id, round(greatest(0e0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) as lower,
      round(least(1e0, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) as upper
      from (select source_lineage_id, count(*)::double as n, avg(case when (score >= 0.5) = (label = 1) then 1e0 else 0e0 end) as p, 1.959963984540054e0 as z from V_SCORE group by 1) t""",
)
def ag12(t):
    right = (F.col("score") >= 0.5) == (F.col("label") == 1)
    c = t.scores().groupBy("source_lineage_id").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_if(right).cast("double").alias("k")
    )
    lo, hi = V.wilson(F.col("k"), F.col("n"))
    return c.select("source_lineage_id", r6(lo).alias("lower"), r6(hi).alias("upper"))


@query(
    "ag13_operating_points",
    """with p as (select grp, score, row_number() over (partition by grp order by score) - 1 as i, count(*) over (partition by grp) as n from V_SCORE where label = 1),
       q as (select grp, score, row_number() over (partition by grp order by score) - 1 as i, count(*) over (partition by grp) as n from V_SCORE where label = 0),
       a as (select grp, score as t95 from p where i = floor((n - 1) * 0.05e0)), b as (select grp, score as t1 from q where i = ceil((n - 1) * 0.99e0))
       , o as (select a.grp, t95, t1 from a join b on b.grp = a.grp), x as (select o.grp, avg(case when q.score >= t95 then 1e0 else 0e0 end) as v from o join q on q.grp = o.grp group by 1), y as (select o.grp, avg(case when p.score >= t1 then 1e0 else 0e0 end) as v from o join p on p.grp = o.grp group by 1)
       select g.grp, t95 as fpr_at_95_tpr_threshold, round(x.v, 6) as fpr_at_95_tpr, t1 as tpr_at_1_fpr_threshold, round(y.v, 6) as tpr_at_1_fpr from (select distinct grp from V_SCORE) g left join o on o.grp = g.grp left join x on x.grp = g.grp left join y on y.grp = g.grp""",
)
def ag13(t):
    return V.operating_points(t.scores(), ["grp"]).select(
        "grp", "fpr_at_95_tpr_threshold", r6(F.col("fpr_at_95_tpr")).alias("fpr_at_95_tpr"),
        "tpr_at_1_fpr_threshold", r6(F.col("tpr_at_1_fpr")).alias("tpr_at_1_fpr"),
    )


@query(
    "ag14_equal_error",
    """with th as (select distinct grp, score as t from V_SCORE), r as (select th.grp, t, sum(s.label) > 0 and sum(1 - s.label) > 0 as both_, sum(case when s.label = 1 and s.score < t then 1e0 else 0e0 end) / sum(s.label) as fnr,
         sum(case when s.label = 0 and s.score >= t then 1e0 else 0e0 end) / sum(1 - s.label) as fpr from th join V_SCORE s on s.grp = th.grp group by th.grp, t)
       select grp, case when both_ then round(e, 6) end as eer, case when both_ then t end as eer_threshold from (select grp, both_, 0.5e0 * (fnr + fpr) as e, t, row_number() over (partition by grp order by abs(fnr - fpr), 0.5e0 * (fnr + fpr), t) as k from r) z where k = 1""",
)
def ag14(t):
    return V.equal_error(t.scores(), ["grp"]).select("grp", r6(F.col("eer")).alias("eer"), "eer_threshold")


@query(
    "ag15_calibration_error",
    """select grp, round(sum(n * abs(s / n - y / n)) / sum(n), 6) as ece, round(sum(sq) / sum(n), 6) as brier from (
         select grp, least(floor(score * 10), 9) as b, count(*) as n, sum(score) as s, sum(label) as y, sum((score - label) ** 2) as sq from V_SCORE group by 1, 2) t group by grp""",
)
def ag15(t):
    return V.calibration_error(t.scores(), ["grp"]).select("grp", r6(F.col("ece")).alias("ece"), r6(F.col("brier")).alias("brier"))


_PLATT = """with recursive s as (select provider, ln(greatest(1e-6, least(1 - 1e-6, score)) / (1 - greatest(1e-6, least(1 - 1e-6, score)))) as x, label::double as y from V_SCORE),
  cnt as (select provider, count(*) filter (where y = 1) as positives, count(*) filter (where y = 0) as negatives from s group by 1),
  fit(k, provider, a, b) as (select 0, provider, 1e0, 0e0 from cnt union all
    select k + 1, provider, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) from (
      select k, provider, a, b, sum((q - y) * x) + 1e-3 * a as ga, sum(q - y) + 1e-4 * b as gb, sum(v * x * x) + 1e-3 as haa, sum(v * x) as hab, sum(v) + 1e-4 as hbb
      from (select *, greatest(q * (1 - q), 1e-6) as v from (select f.k, f.provider, f.a, f.b, s.x, s.y, 1 / (1 + exp(-(f.a * s.x + f.b))) as q from fit f join s using (provider) where f.k < 12) j0) j group by k, provider, a, b) g)
  select provider, round(case when state = 'FITTED' then a end, 6) as slope, round(case when state = 'FITTED' then b end, 6) as intercept, state, positives, negatives, case when state = 'FITTED' then 0e0 end as residual
  from (select *, case when least(positives, negatives) < 25 then 'INSUFFICIENT_CLASS_SAMPLES' when not (a > 0) then 'INVERTED_OR_NOT_FINITE' else 'FITTED' end as state from fit join cnt using (provider) where k = 12) r"""


@query("ag16_platt_fit", _PLATT)
def ag16(t):
    return V.fit_platt(t.scores(), "provider").select(
        "provider", r6(F.col("slope")).alias("slope"), r6(F.col("intercept")).alias("intercept"), "state", "positives", "negatives",
        r6(F.col("residual")).alias("residual"),
    )


_TIMES = " + ".join(f"(u >= {b})::int" for b in V.POISSON_BOUNDS)
_BOOT = f"""with c as (select source_lineage_id as cl, sum(case when (score >= 0.5) = (label = 1) then 1e0 else 0e0 end) as num, count(*)::double as den from V_SCORE group by 1),
  dr as (select it, num, den, {h32("concat(it, '-', cl)")} as u from c cross join range(1, 201) r(it)),
  sm as (select it, sum(num * ({_TIMES})) / sum(den * ({_TIMES})) as v from dr group by it)"""


@query(
    "ag17_cluster_bootstrap",
    _BOOT + """ select (select count(*) from c) as cluster_count, (select count(*) from V_SCORE) as row_count, 0::bigint as missing_cluster_row_count,
      round((select sum(num) / sum(den) from c), 6) as point_estimate, round(quantile_cont(v, 0.025), 6) as lower, round(quantile_cont(v, 0.975), 6) as upper,
      true as eligible_for_acceptance, '' as reason_codes from sm""",
)
def ag17(t):
    right = ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")
    out = V.cluster_bootstrap(t.scores(), "source_lineage_id", right, F.lit(1.0), 200)
    return out.select(
        "cluster_count", "row_count", "missing_cluster_row_count", *[r6(F.col(c)).alias(c) for c in ("point_estimate", "lower", "upper")],
        "eligible_for_acceptance", "reason_codes",
    )


@query("ag18_binary_rate", "select provider, round(avg(case when score >= 0.5 then 1e0 else 0e0 end) filter (where label = 1), 6) as rate from V_SCORE group by provider")
def ag18(t):
    return t.scores().groupBy("provider").agg(r6(V.binary_rate(F.col("score") >= 0.5, F.col("label") == 1)).alias("rate"))


@query(
    "ag19_group_accuracy",
    """select provider, source_lineage_id, round(avg(case when (score >= 0.5) = (label = 1) then 1e0 else 0e0 end) filter (where not (score >= 0.45 and score < 0.55)), 6) as accuracy,
       round(avg(case when not (score >= 0.45 and score < 0.55) then 1e0 else 0e0 end), 6) as coverage from V_SCORE group by all""",
)
def ag19(t):
    out = V.selective(t.scores(), ["provider", "source_lineage_id"])
    return out.select("provider", "source_lineage_id", r6(F.col("selective_accuracy")).alias("accuracy"), r6(F.col("coverage")).alias("coverage"))


@query(
    "ag20_by_case",
    """with r as (select source_lineage_id as grp, case when score >= 0.6 then 'MATCH' when score >= 0.4 then 'REVIEW' else 'MISSED' end as outcome from V_SCORE)
       select grp, grouping(grp)::bigint as overall, count(*) as n, count(*) filter (where outcome='MATCH') as match, count(*) filter (where outcome='REVIEW') as review,
         count(*) filter (where outcome='MISSED') as missed, round(count(*) filter (where outcome='MATCH') / count(*), 4) as recall_match,
         count(*) filter (where outcome='MATCH') < count(*) as weak from r group by rollup(grp)""",
)
def ag20(t):
    res = t.scores().selectExpr(
        "source_lineage_id as grp", "case when score >= 0.6 then 'MATCH' when score >= 0.4 then 'REVIEW' else 'MISSED' end as outcome"
    )
    return V.by_case(res, "grp")


@query(
    "ag30_partition_leakage",
    "select sha256, count(distinct part) as partitions, count(*) as rows from V_MANIFEST group by 1 having count(distinct part) > 1",
)
def ag30(t):
    return M.leakage(t.manifest(), "sha256")


@query("ag31_duplicates", "select sha256, count(*) as rows from V_MANIFEST group by 1 having count(*) > 1")
def ag31(t):
    return M.duplicates(t.manifest(), "sha256")


@query(
    "jn14_corpus_binding",
    """select s.asset_id, m.source_lineage_id as bound_lineage, case when m.asset_id is null then 'ASSET_NOT_IN_MANIFEST' when m.part <> 'TEST' then 'WRONG_PARTITION' when s.dup then 'DUPLICATE_LOCATION' end as violation
       from (select asset_id + case when asset_id % 9 = 0 then 5000000 else 0 end as asset_id, false as dup from V_SCORE) s left join V_MANIFEST m on m.asset_id = s.asset_id""",
)
def jn14(t):
    preds = t.scores().selectExpr("asset_id + if(asset_id % 9 = 0, 5000000, 0) as asset_id")
    return M.bind_corpus(preds, t.manifest(), "TEST").select("asset_id", "bound_lineage", "violation")


@query(
    "jn15_missing_parents",
    "select asset_id, derived_from from V_MANIFEST m where derived_from is not null and not exists (select 1 from V_MANIFEST p where p.asset_id = m.derived_from)",
)
def jn15(t):
    return M.missing_parents(t.manifest()).select("asset_id", "derived_from")


@query(
    "tk5_error_gallery",
    """select asset_id, score, case when score >= 0.45 and score < 0.55 then 'ABSTENTION' when score >= 0.5 and label = 0 then 'FALSE_ALARM' else 'MISS' end as error_type
       from V_SCORE where (score >= 0.45 and score < 0.55) or (score >= 0.5) <> (label = 1)""",
)
def tk5(t):
    return V.error_gallery(t.scores()).select("asset_id", "score", "error_type")


_METRICS = f"""m as (
   select c.grp, 'auc' as metric, a.auc as actual from ({_CONF}) c join ({_AUC}) a using (grp)
   union all select grp, 'precision', tp / nullif(tp + fp, 0) from ({_CONF}) c
   union all select grp, 'fpr', fp / nullif(tn + fp, 0) from ({_CONF}) c)"""
_GATES = "g as (select * from (values ('g1','auc','GTE',0.6e0),('g2','precision','GTE',0.9e0),('g3','fpr','LTE',0.05e0),('g4','missing_metric','GTE',0.5e0)) g(gate_id, metric, op, expected))"


def report_metrics(t):
    c = V.confusion(t.scores(), ["grp"], 0.5, 0.4)
    a = V.roc_auc(t.scores(), ["grp"])
    return c.join(a, "grp", "left").select(
        F.col("grp").alias("report_id"), F.create_map(F.lit("auc"), "auc", F.lit("precision"), "precision", F.lit("fpr"), "fpr").alias("metrics"),
        F.expr("grp <> 'fr'").alias("evaluation_eligible"), F.lit("bundle-1").alias("bundle_id"),
        F.expr("if(grp = 'de', 'other-domain', 'demo')").alias("domain_id"),
    )


GATES = [("g1", "auc", "GTE", 0.6), ("g2", "precision", "GTE", 0.9), ("g3", "fpr", "LTE", 0.05), ("g4", "missing_metric", "GTE", 0.5)]


@query(
    "ag41_acceptance_gates",
    f"""with {_METRICS}, {_GATES}, x as (select d.grp as report_id, g.gate_id, m.actual, case when g.op = 'GTE' then coalesce(m.actual >= g.expected, false) else coalesce(m.actual <= g.expected, false) end as passed
          from (select distinct grp from V_SCORE) d cross join g left join m on m.grp = d.grp and m.metric = g.metric)
        select report_id, gate_id, round(actual, 6) as actual, passed, case when passed then null when actual is null then 'ACCEPTANCE_METRIC_MISSING' else 'ACCEPTANCE_GATE_FAILED' end as reason_code from x""",
)
def ag41(t):
    return A.gate_results(report_metrics(t), GATES).select("report_id", "gate_id", r6(F.col("actual")).alias("actual"), "passed", "reason_code")


@query(
    "ag41_acceptance_decision",
    f"""with {_METRICS}, {_GATES}, x as (select d.grp as report_id, g.gate_id, case when g.op = 'GTE' then coalesce(m.actual >= g.expected, false) else coalesce(m.actual <= g.expected, false) end as passed
          from (select distinct grp from V_SCORE) d cross join g left join m on m.grp = d.grp and m.metric = g.metric)
        select report_id, bool_and(passed) as metrics_passed, 'DO_NOT_PROMOTE' as recommendation,
          array_to_string(list_sort(list_concat(list('METRIC_GATE_FAILED:' || gate_id) filter (where not passed), list_concat(case when report_id = 'de' then ['DECLARED_DOMAIN_MISMATCH'] else []::varchar[] end,
             list_concat(case when report_id = 'fr' then ['REPORT_NOT_EVALUATION_ELIGIBLE'] else []::varchar[] end, ['EXTERNAL_GATE_UNRESOLVED:rights-review'])))), '|') as reason_codes from x group by report_id""",
)
def ag41b(t):
    policy = {"bundle_id": "bundle-1", "domain_id": "demo", "ratified": True, "external_gates": ["rights-review"]}
    return A.acceptance(report_metrics(t), GATES, policy, {})


@query(
    "ag42_report_consistency",
    """select asset_id as report_id, concat_ws('|', case when asset_id % 6 = 0 then 'EVALUATION_GRADE_REQUIRED' end, case when asset_id % 5 = 0 and asset_id % 6 <> 0 then 'SMOKE_TEST_CANNOT_BE_ELIGIBLE' end,
          case when asset_id % 7 = 0 then 'PROMOTION_FIELDS_DISAGREE' end, case when asset_id % 4 = 0 then 'PREDICTION_DIGEST_MISMATCH' end) as violations from V_SCORE""",
)
def ag42(t):
    # Each prediction stands for a recorded report about itself.
    rep = t.scores().selectExpr(
        "asset_id as report_id", "concat_ws('|', asset_id, label) as prediction_material",
        "sha2(concat_ws('|', asset_id, label + if(asset_id % 4 = 0, 1, 0)), 256) as prediction_digest",
        "case when asset_id % 6 = 0 then '' when asset_id % 5 = 0 then 'SMOKE_TEST_ONLY' else 'HELD_OUT' end as grade",
        "true as evaluation_eligible", "true as corpus_eligible", "asset_id % 7 = 0 as promotion_eligible", "'NOT_PROMOTED' as promotion_state",
    )
    return A.validate_reports(rep).select("report_id", joined(F.col("violations")).alias("violations"))


@query(
    "ag43_eligibility",
    """select grp, p as positives, n as negatives, s as clusters, concat_ws('|', case when p < 30 then 'INSUFFICIENT_POSITIVES' end, case when n < 10 then 'INSUFFICIENT_NEGATIVES' end, case when s < 5 then 'INSUFFICIENT_CLUSTERS' end) as reasons,
       p >= 30 and n >= 10 and s >= 5 as eligible from (select grp, sum(label)::bigint as p, sum(1 - label)::bigint as n, count(distinct source_lineage_id) as s from V_SCORE group by grp) t""",
)
def ag43(t):
    return A.eligibility(t.scores(), "grp", "source_lineage_id", 30, 10, 5)


@query(
    "jn18_registry_identity",
    """select asset_id, provider_no, view_no, family, concat_ws(',', case when asset_id % 5 = 0 and provider_no < 2 then 'model_version' end, case when asset_id % 7 = 0 and provider_no < 2 then 'artifact' end) as mismatched,
         provider_no < 2 and asset_id % 5 <> 0 and asset_id % 7 <> 0 as verified, case when provider_no = 2 then 'EVIDENCE_FAMILY_NOT_REGISTRY_APPROVED' when asset_id % 5 = 0 or asset_id % 7 = 0 then 'EVIDENCE_FAMILY_REGISTRY_IDENTITY_MISMATCH' end as warning from V_DET""",
)
def jn18(t):
    registry = t.spark.createDataFrame([(0, "v1", "a0"), (1, "v1", "a1")], "provider_no bigint, model_version string, artifact string")
    s = t.detector_views().selectExpr(
        "*", "if(asset_id % 5 = 0, 'v2', 'v1') as model_version", "if(asset_id % 7 = 0, 'zz', concat('a', provider_no)) as artifact"
    )
    return A.govern(s, registry, "provider_no", ["model_version", "artifact"]).select(
        "asset_id", "provider_no", "view_no", "family", "mismatched", "verified", "warning"
    )


@query(
    "jn19_calibration",
    """select asset_id, provider_no, view_no, case when provider_no = 2 then 'NOT_AVAILABLE_FOR_PROVIDER' when asset_id % 5 = 0 then 'MODEL_VERSION_MISMATCH' when asset_id % 7 = 0 then 'CALIBRATION_CONTEXT_MISMATCH' else 'HELD_OUT_PLATT_CALIBRATION' end as state,
        round(case when provider_no = 2 or asset_id % 5 = 0 or asset_id % 7 = 0 then score else 1 / (1 + exp(-((1.2e0 + 0.1e0 * provider_no) * ln(score / (1 - score)) - 0.3e0))) end, 6) as calibrated_score from V_DET""",
)
def jn19(t):
    params = t.spark.createDataFrame(
        [(0, "v1", "demo", 1.2, -0.3), (1, "v1", "demo", 1.3, -0.3)],
        "provider_no bigint, model_version string, domain_id string, slope double, intercept double",
    )
    s = t.detector_views().selectExpr(
        "*", "if(asset_id % 5 = 0, 'v2', 'v1') as model_version", "if(asset_id % 7 = 0, 'field', 'demo') as domain_id"
    )
    return A.apply_calibration(s, params, "provider_no", ["domain_id"]).select(
        "asset_id", "provider_no", "view_no", "state", r6(F.col("calibrated_score")).alias("calibrated_score")
    )
