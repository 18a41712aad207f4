"""Provider plug-ins and view generators over the documents."""

from pyspark.sql import functions as F

from evidlake.operators import plugins as P
from evidlake.plans.registry import query
from evidlake.plans.views import h32


def draw(text: str) -> float:
    """A deterministic detector; texts with a digit fail on purpose."""
    import hashlib

    if any(c.isdigit() for c in text):
        raise ValueError("digits")
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 1000 / 1000


def size_score(text: str) -> float:
    return len(text) % 100 / 100


@query("udf1_embeddings")
def udf1(t):
    return P.embed(t.texts(), "doc_id", "text").select(
        "doc_id", F.round(F.col("embedding")[0], 6).alias("first"), F.size("embedding").alias("dim"), "error"
    )


@query(
    "udf2_detector_rows",
    f"select doc_id, case when regexp_matches(text, '[0-9]') then null else ({h32('text')} % 1000) / 1000e0 end as score, case when regexp_matches(text, '[0-9]') then 'DETECTOR_FAILED:ValueError' end as error, 'hash' as provider from documents",
)
def udf2(t):
    return P.detect(t.texts(), "doc_id", "text", "hash", draw)


@query(
    "udf3_provider_routing",
    f"select doc_id, case when regexp_matches(text, '[0-9]') then (length(text) % 100) / 100e0 else ({h32('text')} % 1000) / 1000e0 end as score, case when regexp_matches(text, '[0-9]') then 'size' else 'hash' end as provider, case when regexp_matches(text, '[0-9]') then 'FALLBACK' else 'PRIMARY' end as role from documents",
)
def udf3(t):
    return P.route(t.texts(), "doc_id", "text", ("hash", draw), ("size", size_score)).select("doc_id", "score", "provider", "role")


@query("udaf1_grouped_statistic", "select asset_id, round(median(score), 6) as statistic from V_DET group by 1")
def udaf1(t):
    out = P.grouped_statistic(t.detector_views(), "asset_id", "score", lambda v: v.median())
    return out.withColumn("statistic", F.round("statistic", 6))


_W = "greatest(1, floor(length(text) * 0.78)::int)"


@query(
    "udtf2_delivery_views",
    f"""select doc_id, v.view, v.scope, v.weight, sha256(case v.view when 'original' then text when 'lowercase' then lower(text) when 'collapsed' then trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') when 'no_punctuation' then regexp_replace(text, '[.,;:!?]', '', 'g') when 'no_digits' then regexp_replace(text, '[0-9]', '', 'g')
          when 'crop_center' then substring(text, floor((length(text) - {_W}) / 2e0)::int + 1, {_W}) when 'crop_head' then substring(text, 1, {_W}) else substring(text, length(text) - {_W} + 1, {_W}) end) as content_digest
        from documents cross join (values """
    + ", ".join(f"('{v}', '{s}', {q}e0)" for v, s, q in P.DELIVERY_VIEWS)
    + ') v("view", scope, weight)',
)
def udtf2(t):
    out = P.delivery_views(t.texts(), "doc_id", "text")
    return out.select("doc_id", "view", "scope", "weight", F.sha2("content", 256).alias("content_digest"))


@query("udtf3_perturbations")
def udtf3(t):
    out = P.perturbations(t.texts(), "doc_id", "text")
    return out.select("doc_id", "case", "difficulty", F.char_length("content").cast("bigint").alias("chars"), F.sha2("content", 256).alias("content_digest"))
