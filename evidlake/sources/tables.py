"""The evidence views every operator is bound to, derived from the Parquet tables.

Each method returns one view as a DataFrame. Nothing is read until an action runs, and only the
columns a view uses reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.functions.expr import sign_bits
from evidlake.functions.running import ordinal, previous
from evidlake.operators.text import region_views, with_sketch
from evidlake.session import spread

# Rows of one chunk when ids are numbered in order (see functions.running).
ID_CHUNK = 100_000
WORD_PARTS = 32
H32 = "cast(conv(substr(md5({0}), 1, 8), 16, 10) as bigint)"


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self, *columns: str) -> DataFrame:
        """Documents for work that is heavy per row."""
        return spread(self.raw("documents").select("doc_id", "text", *columns), "doc_id")

    # -- catalog ---------------------------------------------------------------------------------
    def works(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id as work_id",
            "lang as tenant_id",
            "source as catalog_id",
            "text",
            "n_chars as byte_size",
            "sha2(text, 256) as sha256",
            "case when doc_id % 7 = 0 then null else concat('c', doc_id % 20) end as claimant",
        )

    def versions(self) -> DataFrame:
        return (
            self.raw("documents")
            .select("doc_id", "text", F.explode(F.array(*[F.lit(v) for v in (1, 2, 3)])).alias("v"))
            .where("v <= doc_id % 4")
            .selectExpr(
                "doc_id as work_id", "cast(v as bigint) as version", "sha2(concat(text, '#', v), 256) as sha256"
            )
        )

    def manifest(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id as asset_id",
            "concat('items/', doc_id) as location",
            "sha2(text, 256) as sha256",
            "source as source_lineage_id",
            "case doc_id % 4 when 0 then 'TRAIN' when 1 then 'CALIBRATION' when 2 then 'TEST' else 'DEMO' end as part",
            "case when doc_id % 50 = 0 then doc_id + 100000000 when doc_id % 10 = 0 then doc_id + 1 end as derived_from",
        )

    def lines(self) -> DataFrame:
        return self.texts().selectExpr("doc_id", "posexplode(split(text, '\\n')) as (pos, line)").selectExpr(
            "doc_id", "cast(pos + 1 as bigint) as line_no", "line"
        )

    def words(self) -> DataFrame:
        """Words by page and line. Whole texts are dealt by page, so that lines form without sending each word.

        A split of compressed texts is many times larger as words: it goes to ``WORD_PARTS`` tasks, whose words fit in memory.
        """
        docs = self.raw("documents").select("doc_id", "text")
        return (
            docs.repartition(min(1 << 14, WORD_PARTS * docs._jdf.rdd().getNumPartitions()), "doc_id")
            .selectExpr("doc_id", "posexplode(split(text, ' ')) as (pos, word)")
            .where("word <> ''")
            .selectExpr(
                "doc_id as page",
                "cast(pos div 8 as bigint) as line_no",
                "cast(pos + 1 as bigint) as word_no",
                "word",
                "cast((pos % 8) * 10 as bigint) as left_px",
                f"({H32.format('word')} % 100) / 1e2 as conf",
            )
        )

    def chunks(self) -> DataFrame:
        return region_views(self.texts(), "doc_id", "text")

    def fingerprints(self) -> DataFrame:
        """64-bit text sketches of all works, as two halves."""
        docs = self.texts().withColumnRenamed("doc_id", "item_id")
        return with_sketch(docs, "text").drop("text")

    # -- vectors ---------------------------------------------------------------------------------
    def anchors(self) -> DataFrame:
        return self.raw("embeddings").selectExpr(
            "vec_id as item_id",
            "cast(label as bigint) as profile_key",
            "label % 2 = 0 as authorized",
            "embedding",
        )

    def vector_bits(self) -> DataFrame:
        e = self.raw("embeddings")
        return e.select(
            F.col("vec_id").alias("item_id"),
            sign_bits(F.col("embedding"), 0).alias("hi"),
            sign_bits(F.col("embedding"), 32).alias("lo"),
        )

    # -- predictions -----------------------------------------------------------------------------
    def scores(self) -> DataFrame:
        docs = self.raw("documents").select("doc_id", "lang", "source")
        return (
            self.raw("labels")
            .join(docs, "doc_id")
            .selectExpr(
                "doc_id as asset_id",
                "cast(quality as bigint) as label",
                "lang as grp",
                "source as source_lineage_id",
                "concat('p', doc_id % 3) as provider",
                "floor((0.35D * quality + 0.65D * (" + H32.format("cast(doc_id as string)")
                + " % 10000) / 1e4) * 100D) / 100D as score",
            )
        )

    def detector_views(self) -> DataFrame:
        return self.raw("labels").selectExpr(
            "doc_id", "quality", "explode(array(0L, 1L, 2L)) as p"
        ).selectExpr("*", "explode(sequence(0L, 9L)) as v").selectExpr(
            "doc_id as asset_id",
            "p as provider_no",
            "p % 2 as family",
            "v as view_no",
            "case when v < 5 then 'DELIVERY_TRANSFORM' else 'SPATIAL_CROP' end as scope",
            "case v when 0 then 1D when 1 then 0.92D when 2 then 0.76D when 3 then 0.78D when 4 then 0.72D else 0.68D end as weight",
            "p <> 2 as calibrated",
            "(0.5D * quality + 0.5D * (" + H32.format("concat(doc_id, '-', p, '-', v)")
            + " % 1000) / 1e3) * 0.98D + 0.01D as score",
        )

    # -- events ----------------------------------------------------------------------------------
    def requests(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id",
            "user_id as tenant_id",
            "concat('k', event_id % 200) as idem_key",
            "sha2(concat(event_type, '|', event_id % 2), 256) as digest",
            "ts", "event_type", "value", "props",
        )

    def usage(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id", "user_id as tenant_id", "event_type as meter",
            "cast(floor(abs(value)) as bigint) + 1 as quantity", "value as latency_ms", "ts as created_at",
        )

    def jobs(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id as job_id", "user_id as tenant_id",
            "case event_type when 'view' then 'PENDING' when 'click' then 'SUBMITTED' when 'purchase' then 'CONFIRMED' "
            "when 'signup' then 'RETRYABLE' else 'FAILED' end as state",
            "event_id % 9 as attempts", "ts as created_at", "event_id % 3 = 0 as leased",
        )

    def stages(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id", "user_id as scan_id", "event_type as stage", "event_id % 4 as attempt",
            "3L as max_attempts", "ts as heartbeat_at",
            "unix_micros(cast(ts as timestamp)) as heartbeat_us",
            "unix_micros(cast(ts as timestamp)) + 180000000L as lease_expires_us",
        )

    def telemetry(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "concat(user_id, '-', cast(cast(ts as date) as string)) as packet_id",
            "event_type as score_name", "concat('b', user_id % 2) as bundle_id", "value", "ts",
        )

    def endpoints(self) -> DataFrame:
        """Two subscribers per tenant; a NULL type subscribes to everything."""
        return self.raw("customer").selectExpr(
            "c_custkey", "c_mktsegment", "c_acctbal", "explode(array(1L, 2L)) as slot"
        ).selectExpr(
            "c_custkey * 10 + slot as endpoint_id",
            "c_custkey as tenant_id",
            "case when c_mktsegment = 'BUILDING' then 'purchase' when c_mktsegment = 'MACHINERY' then 'error' "
            "when slot = 2 then 'view' end as only_type",
            "c_acctbal > 0 as active",
        )

    # -- rights ----------------------------------------------------------------------------------
    def claims(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as claim_id", "o_custkey as tenant_id", "o_orderkey % 500 as work_id",
            "case o_orderstatus when 'F' then 'CORROBORATED' when 'O' then 'ASSERTED' else 'DISPUTED' end as state",
            "cast(o_orderdate as timestamp) as effective_from",
        )

    def licenses(self) -> DataFrame:
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        return (
            self.raw("lineitem")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .selectExpr(
                "l_orderkey * 10 + l_linenumber as license_id", "l_orderkey as claim_id",
                "l_orderkey % 500 as work_id",
                "case when l_linenumber = 7 then -1L else o_custkey end as tenant_id",
                "case l_returnflag when 'N' then 'ACTIVE' when 'A' then 'SUSPENDED' else 'REVOKED' end as state",
                "case l_linestatus when 'O' then 'marketing' else 'editorial' end as permitted_use",
                "cast(l_shipdate as timestamp) as effective_from",
                "cast(l_shipdate as timestamp) + interval '30' day as effective_until",
            )
        )

    def titles(self, claims: DataFrame | None = None) -> DataFrame:
        """Claims (``claims``, where they are stored already) with all five states and an end for some of them."""
        return (claims or self.claims()).withColumn(
            "state",
            F.expr("case when claim_id % 17 = 3 then 'SUPERSEDED' when claim_id % 19 = 4 then 'REVOKED' else state end"),
        ).withColumn("effective_until", F.expr("case when claim_id % 4 = 1 then effective_from + interval 700 day end"))

    def first_licenses(self) -> DataFrame:
        """One row for each license id, as in a table with that key."""
        first = F.min(F.struct("effective_from", "state", "permitted_use", "tenant_id")).alias("m")
        return self.licenses().groupBy("license_id", "claim_id", "work_id").agg(first).select("license_id", "claim_id", "work_id", "m.*")

    def grants(self, rows: DataFrame | None = None) -> DataFrame:
        """Licenses (``rows``: those of ``first_licenses``, where they are stored already) with versions, all five states, lists of
        permitted and prohibited uses and open ends."""
        return (rows or self.first_licenses()).selectExpr(
            "license_id", "claim_id", "if(license_id % 27 = 2, work_id + 1, work_id) as work_id", "tenant_id", "license_id % 10 as version",
            "case when license_id % 23 = 5 then 'SUPERSEDED' when license_id % 29 = 6 then 'EXPIRED' else state end as state",
            "if(license_id % 5 = 0, array('marketing', 'editorial'), array(permitted_use)) as permitted_uses",
            "case when license_id % 6 = 1 then array('marketing') when license_id % 10 = 3 then array('editorial', 'resale') "
            "else cast(array() as array<string>) end as prohibited_uses",
            "if(license_id % 13 = 0, null, effective_from + make_interval(0, 0, 0, 0, 0, 0, license_id % 86400)) as effective_from",
            "if(license_id % 8 = 0, null, effective_from + interval 430 day) as effective_until",
        )

    def rights_log(self, kind: str, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Current rows of claims or licenses with the digest of their projection, their recorded events, and log leaves.

        ``rows``: those of ``titles`` or ``grants``, where they are stored already.

        Some rows have no event, and some events are of a wrong type, tenant or subject, altered, not logged, without a
        projection, or of another projection than the row's.
        """
        if kind == "claim":
            rows = (rows or self.titles()).withColumnRenamed("claim_id", "id")
            fields = "concat_ws('|', id, work_id, state, effective_from, coalesce(cast(effective_until as string), '-'))"
        else:
            rows = (rows or self.grants()).withColumnRenamed("license_id", "id")
            fields = (
                "concat_ws('|', id, claim_id, work_id, state, version, array_join(permitted_uses, ','), array_join(prohibited_uses, ','), "
                "coalesce(cast(effective_from as string), '-'), coalesce(cast(effective_until as string), '-'))"
            )
        rows = rows.selectExpr("id", "tenant_id", f"sha2({fields}, 256) as projection_digest")
        payload = "sha2(concat(id, '#', projection_digest), 256)"
        newest = rows.where("id % 31 <> 0").selectExpr(
            "id", "id * 2 + 1 as event_id", "timestamp '2000-01-01 00:00:00' as at",
            f"if(id % 37 = 0, 'NOTE', '{kind.upper()}_STATE_CHANGED') as event_type", "if(id % 41 = 0, -2L, tenant_id) as event_tenant",
            "if(id % 43 = 0, id + 1, id) as subject_id", f"'{kind}' as subject_type", f"{payload} as payload_digest",
            f"if(id % 47 = 0, sha2('altered', 256), {payload}) as recomputed_digest",
            "case when id % 59 = 0 then null when id % 61 = 0 then sha2(projection_digest, 256) else projection_digest end as projection_digest",
        )
        # Every row was created before; these events are of older projections and must not matter.
        first = newest.selectExpr(
            "id", "id * 2 as event_id", "timestamp '1999-01-01 00:00:00' as at", f"'{kind.upper()}_CREATED' as event_type", "event_tenant",
            "subject_id", "subject_type", "payload_digest", "recomputed_digest", "sha2('old', 256) as projection_digest",
        )
        leaves = newest.where("id % 53 <> 0").selectExpr("event_id", "payload_digest as packet_hash")
        return rows, newest.unionByName(first), leaves

    def scans(self, orders: DataFrame | None = None) -> DataFrame:
        return (orders or self.raw("orders")).selectExpr(
            "o_orderkey as scan_id", "o_custkey as tenant_id",
            "case o_orderkey % 5 when 0 then 'MATCH_FOUND' when 1 then 'INCONCLUSIVE' "
            "when 2 then 'NO_MATCH_IN_CHECKED_SOURCES' when 3 then 'SCOPE_INCOMPLETE' else 'ERROR' end as match_status",
            "case when o_orderkey % 5 = 2 then 'COMPLETE' when o_orderkey % 7 < 4 then 'COMPLETE' "
            "when o_orderkey % 7 = 4 then 'PARTIAL' when o_orderkey % 7 = 5 then 'DEGRADED' else 'TRUNCATED' end as coverage_status",
            "case o_orderkey % 4 when 0 then 'LIKELY_AI_GENERATED' when 1 then 'NO_AI_ORIGIN_EVIDENCE_DETECTED' "
            "when 2 then 'AI_ORIGIN_REVIEW_CANDIDATE' end as origin_class",
            "case o_orderkey % 3 when 0 then 'HIGH' when 1 then 'LOW' else 'REVIEW' end as style_tier",
            "case when o_orderkey % 2 = 0 then 'marketing' else 'editorial' end as intended_use",
            "o_orderkey % 500 as work_id", "cast(o_orderdate as timestamp) as created_at",
        )

    def rights_events(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey as subject_id", "l_orderkey * 10 + l_linenumber as rights_event_id",
            "case l_linenumber % 4 when 0 then 'CORROBORATED' when 1 then 'DISPUTED' when 2 then 'SUPERSEDED' "
            "else 'REVOKED' end as event_type",
            "cast(l_shipdate as timestamp) as created_at",
        )

    def coverage_rows(self) -> DataFrame:
        """Recorded manifest rows of each scan; outcome 0 = failed, 1 = not verified, else verified."""
        return self.raw("lineitem").selectExpr(
            "l_orderkey as scan_id", "l_orderkey * 10 + l_linenumber as ref_id",
            "l_linenumber <= 3 as is_candidate",
            H32.format("concat(l_orderkey, '-', l_linenumber, '-', l_partkey)") + " % 10 as outcome",
        )

    def points(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_suppkey as pair_id", "l_orderkey * 10 + l_linenumber as link_id",
            "least(1D, l_discount * 10D) as x", "least(1D, l_tax * 12D) as y", "l_quantity / 50D as err",
        )

    # -- ledger ----------------------------------------------------------------------------------
    def statements(self) -> DataFrame:
        base = self.raw("conversations").selectExpr(
            "conv_id as scan_id", "turn", "conv_id * 1000 + turn as statement_id",
            "sha2(text, 256) as payload_digest",
            "case when turn % 5 = 0 then 'RESULT' when turn % 5 = 1 then 'DISPUTE' when turn % 5 = 2 then 'CORRECTION' "
            "when turn % 5 = 3 then 'SUPERSESSION' else 'REVOCATION' end as statement_type",
            "cast(floor(turn / 1000) as bigint) as __chunk",
        )
        out = previous(
            base, ["scan_id"], [("__chunk", True)], ["turn"],
            {"previous_statement_id": F.col("statement_id")},
        )
        return out.drop("__chunk")

    def leaves(self) -> DataFrame:
        base = (
            self.raw("documents")
            .where("doc_id % 11 <> 0")
            .selectExpr(
                "doc_id as statement_id", "sha2(text, 256) as packet_hash",
                "1704067200L + doc_id * 7 as created_s",
                f"cast(floor(doc_id / {ID_CHUNK}) as bigint) as __chunk",
            )
        )
        out = ordinal(base, [], [("__chunk", True)], [("statement_id", True)], "__rn")
        return out.selectExpr("__rn - 1 as leaf_index", "statement_id", "packet_hash", "created_s")

    def checkpoints(self) -> DataFrame:
        return (
            self.leaves().selectExpr("leaf_index + 1 as tree_size").where("tree_size % 10 = 0")
            .selectExpr("tree_size", "tree_size % 30 = 0 as confirmed", "tree_size % 20 = 0 as queued")
        )
