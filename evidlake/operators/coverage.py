"""What a scan checked and what it did not: coverage lattice, digests, deletion receipts, set tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.functions.digest import set_digest
from evidlake.functions.expr import cascade, codes, joined


def coverage_snapshot(rows: DataFrame, scans: DataFrame | None = None, learned_required: bool = True) -> DataFrame:
    """Counts, six-state status, ordered reasons and digests per declared scan.

    ``rows(scan_id, ref_id, is_candidate, is_verified, failure[, learned_state])`` is the recorded manifest, with failure NULL,
    ``ASSET``, ``REFERENCE`` (its learned vector could not be made) or ``VERIFICATION``. ``scans(scan_id, declared_total,
    query_state, requirement)`` says what each scan was to cover: the size of its catalog, whether its learned query was
    ``EXECUTED``, and ``LEARNED_REQUIRED`` or ``BASELINE_ALLOWED``. A scan of an empty catalog has no rows and is reported all the
    same; a manifest of another size than declared fails closed. Without ``scans`` each manifest is taken as declared.

    Only counts and additive digests are aggregated, so a scan over any catalog is combined before the shuffle. The
    catalog digest tells which references were declared, the snapshot digest also what became of them.
    """
    c = F.col
    learned_state = c("learned_state") if "learned_state" in rows.columns else F.lit("EXECUTED")
    rows = rows.withColumn("__learned", learned_state)
    fields = ["ref_id", "is_candidate", "is_verified", F.coalesce("failure", F.lit(""))]
    fields += ["__learned"] if "learned_state" in rows.columns else []
    agg = rows.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("listed"),
        F.count_distinct("ref_id").alias("distinct_refs"),
        F.count_if("is_candidate").alias("candidates"),
        F.count_if("is_verified").alias("verified"),
        F.count_if(c("is_verified") & ~c("is_candidate")).alias("stray"),
        F.count_if(c("failure") == "ASSET").alias("asset_failed"),
        F.count_if(c("failure") == "REFERENCE").alias("reference_failed"),
        F.count_if(c("failure") == "VERIFICATION").alias("verify_failed"),
        F.count_if(c("__learned") == "EXECUTED").alias("learned"),
        set_digest(F.sha2(F.concat_ws("|", *fields), 256)).alias("snapshot_digest"),
        set_digest(F.sha2(c("ref_id").cast("string"), 256)).alias("catalog_digest"),
    )
    counts = [n for n in agg.columns if n not in ("scan_id", "snapshot_digest", "catalog_digest")]
    if scans is None:
        agg = agg.withColumn("eligible", c("listed")).withColumn("query_state", F.lit("EXECUTED"))
        agg = agg.withColumn("requirement", F.lit("LEARNED_REQUIRED" if learned_required else "BASELINE_ALLOWED"))
    else:
        declared = scans.select("scan_id", c("declared_total").cast("bigint").alias("eligible"), "query_state", "requirement")
        agg = declared.join(agg, "scan_id", "left").withColumns({n: F.coalesce(n, F.lit(0).cast("bigint")) for n in counts})
    consistent = (c("listed") == c("eligible")) & (c("distinct_refs") == c("listed")) & (c("stray") == 0)
    learned = (
        c("query_state").eqNullSafe("EXECUTED") & (c("learned") == c("eligible")) & (c("asset_failed") == 0) & (c("reference_failed") == 0)
    )
    short = c("requirement").eqNullSafe("LEARNED_REQUIRED") & ~learned
    failed = c("asset_failed") + c("verify_failed")
    status = cascade(
        [
            (~consistent | (c("asset_failed") > 0), "FAILED"),
            (c("eligible") == 0, "EMPTY_SCOPE"),
            ((c("candidates") > 0) & (c("verified") == 0) & (c("verify_failed") > 0), "FAILED"),
            (short, "DEGRADED"),
            ((failed > 0) | (c("verified") < c("candidates")), "PARTIAL"),
            (c("candidates") < c("eligible"), "TRUNCATED"),
        ],
        "COMPLETE",
    )
    reasons = codes(
        (~consistent, "COVERAGE_MANIFEST_INCONSISTENT"),
        (c("eligible") == 0, "DECLARED_CATALOG_EMPTY"),
        (short, "REQUIRED_LEARNED_RETRIEVAL_INCOMPLETE"),
        (c("candidates") < c("eligible"), "CANDIDATE_VERIFICATION_TRUNCATED"),
        (failed > 0, "CANDIDATE_VERIFICATION_FAILURE"),
        ((c("verified") < c("candidates")) & (c("verify_failed") == 0), "CANDIDATE_VERIFICATION_PARTIAL"),
    )
    return agg.select(
        "scan_id", "eligible", "candidates", "verified",
        F.greatest(F.lit(0).cast("bigint"), c("eligible") - c("candidates")).alias("omitted"),
        failed.alias("failed"),
        status.alias("coverage_status"),
        joined(reasons).alias("reason_codes"),
        "snapshot_digest", "catalog_digest",
    )


def match_decision(match: Column, review: Column, complete: Column) -> Column:
    """NO_MATCH may be said only where the declared scope was checked completely."""
    return cascade(
        [
            (match, "MATCH_FOUND"),
            (review, "INCONCLUSIVE"),
            (complete, "NO_MATCH_IN_CHECKED_SOURCES"),
        ],
        "SCOPE_INCOMPLETE",
    )


def coverage_breakdown(snapshot: DataFrame) -> DataFrame:
    """Buckets that always sum to what is drawn: the rest of the eligible count was screened out."""
    accounted = F.col("verified") + F.col("omitted") + F.col("failed")
    return snapshot.select(
        "scan_id", "eligible", "verified", "omitted", "failed",
        F.greatest(F.lit(0).cast("bigint"), F.col("eligible") - accounted).alias("screened_out"),
        F.greatest(F.col("eligible"), accounted).alias("total"),
    )


def omitted(rows: DataFrame) -> DataFrame:
    """Manifest entries that were not candidates, with the reason."""
    manifest = rows.select("scan_id", "ref_id")
    chosen = rows.where("is_candidate").select("scan_id", "ref_id")
    return manifest.join(chosen, ["scan_id", "ref_id"], "left_anti").distinct().withColumn(
        "reason_code", F.lit("CANDIDATE_LIMIT")
    )


def manifest_consistent(manifest: DataFrame, candidates: DataFrame, verified: DataFrame, failed: DataFrame) -> DataFrame:
    """Per scan: strays of each subset test and duplicate entries; consistent when all are zero.

    The four inputs (scan_id, ref_id) are tagged and aggregated once per pair instead of joined four ways.
    """
    tag = lambda df, n: df.select("scan_id", "ref_id", F.lit(n).alias("src"))
    all_ = tag(manifest, "m").unionByName(tag(candidates, "c")).unionByName(tag(verified, "v")).unionByName(tag(failed, "f"))
    n = lambda s: F.count_if(F.col("src") == s)
    pair = all_.groupBy("scan_id", "ref_id").agg(n("m").alias("m"), n("c").alias("c"), n("v").alias("v"), n("f").alias("f"))
    out = pair.groupBy("scan_id").agg(
        F.count_if((F.col("c") > 0) & (F.col("m") == 0)).alias("stray_candidates"),
        F.count_if((F.col("v") > 0) & (F.col("c") == 0)).alias("stray_verified"),
        F.count_if((F.col("f") > 0) & (F.col("m") == 0)).alias("stray_failed"),
        F.count_if(F.col("m") > 1).alias("duplicates"),
    )
    return out.withColumn(
        "consistent",
        (F.col("stray_candidates") + F.col("stray_verified") + F.col("stray_failed") + F.col("duplicates")) == 0,
    )


def union_failures(*sources: tuple[DataFrame, str]) -> DataFrame:
    """Distinct failed pairs over several sources."""
    out = None
    for df, _ in sources:
        part = df.select("scan_id", "ref_id")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def still_present(requested: DataFrame, remaining: DataFrame) -> DataFrame:
    """Requested deletions that are still there."""
    return requested.select("scan_id", "ref_id").intersect(remaining.select("scan_id", "ref_id"))


def deletion_receipts(rows: DataFrame) -> DataFrame:
    """Receipt per request from ``rows(scan_id, requested, deleted, retained, present)``."""
    agg = rows.groupBy("scan_id").agg(
        F.count_if("requested").alias("requested"),
        F.count_if(F.col("requested") & F.col("deleted")).alias("deleted"),
        F.count_if(F.col("requested") & F.col("retained")).alias("retained"),
        F.count_if(F.col("requested") & F.col("present")).alias("still_present"),
    )
    state = cascade(
        [
            (F.col("requested") == 0, "NOTHING_REQUESTED"),
            (F.col("still_present") > 0, "DELETION_INCOMPLETE"),
            (F.col("retained") > 0, "DELETED_WITH_RETENTION"),
        ],
        "DELETED",
    )
    return agg.withColumn("state", state)


def catalog_digest(works: DataFrame, by: list[str]) -> DataFrame:
    """Membership digest of a catalog from identity columns only, and a short version tag."""
    entry = F.sha2(F.concat_ws("|", "work_id", "sha256"), 256)
    return works.groupBy(*by).agg(
        F.count(F.lit(1)).alias("members"), set_digest(entry).alias("digest")
    ).withColumn("catalog_version", F.concat(F.lit("manifest_"), F.substring("digest", 1, 20)))
