"""Scalar functions, projections and predicates."""

from pyspark.sql import functions as F

from evidlake.functions import expr as X
from evidlake.functions.digest import canonical_digest
from evidlake.operators import text as T
from evidlake.plans.registry import query
from evidlake.plans.views import h32

TERMS = ["ith the", "eau un", "los es", "und die"]


@query(
    "prj1_request_digest",
    """select work_id, sha256(concat('{"candidate_sha256":"', sha256, '","catalog_id":"', catalog_id, '","intended_use":"', tenant_id,
       '","schema":"evidence.scan_request.v1"}')) as request_digest from V_WORK""",
)
def prj1(t):
    req = t.works().select(
        "work_id",
        F.lower(F.upper(F.col("sha256"))).alias("candidate_sha256"),
        F.trim(F.concat(F.lit("  "), F.col("catalog_id"))).alias("catalog_id"),
        F.trim(F.concat(F.col("tenant_id"), F.lit(" "))).alias("intended_use"),
        F.lit("evidence.scan_request.v1").alias("schema"),
    )
    digest = canonical_digest(["candidate_sha256", "catalog_id", "intended_use", "schema"])
    return req.select("work_id", digest.alias("request_digest"))


@query(
    "prj2_profile_key",
    """select work_id, key as profile_key, concat('sty_', substr(sha256(key), 1, 16)) as profile_id from (
         select w.work_id, coalesce(case when l.quality = 0 then concat('profile:', l.doc_id % 7) end,
                case when trim(w.claimant) <> '' then concat('creator:', lower(trim(w.claimant))) end, concat('singleton:', w.work_id)) as key
         from V_WORK w left join labels l on l.doc_id = w.work_id) t""",
)
def prj2(t):
    registry = t.raw("labels").where("quality = 0").selectExpr(
        "doc_id as work_id", "concat('profile:', doc_id % 7) as registered"
    )
    return profile_keys(t.works(), registry).select("work_id", "profile_key", "profile_id")


def profile_keys(works, registry):
    """Registered profile, else the claimant's name, else the work alone; with a stable short id."""
    name = F.trim("claimant")
    key = F.coalesce(
        F.col("registered"),
        F.when(name != "", F.concat(F.lit("creator:"), F.lower(name))),
        F.concat(F.lit("singleton:"), F.col("work_id").cast("string")),
    )
    return (
        works.join(registry, "work_id", "left")
        .withColumn("profile_key", key)
        .withColumn("profile_id", F.concat(F.lit("sty_"), F.substring(F.sha2("profile_key", 256), 1, 16)))
    )


_NORM = "trim(regexp_replace(replace(lower(replace({0}, 'ß', 'ss')), '_', ' '), '[^a-z0-9+.-]+', ' ', 'g'))"
NORM_SQL = _NORM


@query(
    "prj3_normalize_text",
    f"select work_id, length(n) as chars, sha256(n) as normalized_digest from (select work_id, {_NORM.format('text')} as n from V_WORK) t",
)
def prj3(t):
    n = T.normalize_text(F.col("text"))
    return t.works().withColumn("n", n).select(
        "work_id", F.char_length("n").cast("bigint").alias("chars"), F.sha2("n", 256).alias("normalized_digest")
    )


_PAT = [
    r"\ba\s*[il1|][\s-]*generated\b", r"\bgenerated\s+(?:by|with|using)\s+ai\b",
    r"\b(?:made|created)\s+(?:by|with|using)\s+ai\b", r"\bsynthetic[\s-]*image\b",
]
_EXPL = "coalesce(" + ", ".join(f"nullif(regexp_extract(n, '{p}'), '')" for p in _PAT) + ")"
_TERM = "coalesce(" + ", ".join(f"case when contains(n, '{x}') then '{x}' end" for x in TERMS) + ")"
# Lines as given, and the same line with a label a forger or an honest tool might add.
_LINES = (
    "select doc_id, line_no, conf, " + _NORM.format("line") + " as n from (select doc_id, line_no, "
    "concat(line, case when doc_id % 5 = 0 and line_no % 6 = 2 then ' A1-generated!' when doc_id % 5 = 1 and line_no % 7 = 1 then ' Made_with AI' else '' end) as line, "
    f"({h32('line')} % 100) / 1e2 as conf from V_LINE) s"
)
_HITS = f"select doc_id, line_no, conf, coalesce({_EXPL}, {_TERM}) as phrase, case when {_EXPL} is not null then 'EXPLICIT_AI_LABEL' when {_TERM} is not null then 'CONFIGURED_GENERATOR_MARK' end as kind from ({_LINES}) q"


def labelled_lines(t):
    tail = F.expr(
        "case when doc_id % 5 = 0 and line_no % 6 = 2 then ' A1-generated!' "
        "when doc_id % 5 = 1 and line_no % 7 = 1 then ' Made_with AI' else '' end"
    )
    lines = t.lines().withColumn("conf", (X.hash32(F.col("line")) % 100) / 1e2).withColumn(
        "line", F.concat("line", tail)
    )
    return T.detect_labels(lines, "line", TERMS)


@query(
    "prj4_label_phrases",
    f"select doc_id, line_no, kind, phrase from ({_HITS}) h where kind is not null",
)
def prj4(t):
    return labelled_lines(t).where("kind is not null").select("doc_id", "line_no", "kind", "phrase")


@query(
    "prj5_marker_summary",
    f"""with h as ({_HITS})
      select doc_id, case when max(case when conf > 0.02 then 1 else 0 end) = 0 then 'VISIBLE_MARKER_ANALYSIS_FAILED'
               when max(conf) filter (where kind is not null and conf > 0.02) is not null then 'VISIBLE_AI_MARKER_FOUND' else 'NO_VISIBLE_AI_MARKER_FOUND' end as classification,
             coalesce(round(least(0.98e0, case when count(*) filter (where kind = 'EXPLICIT_AI_LABEL' and conf > 0.02) > 0 then 0.76e0 else 0.62e0 end
                + 0.22e0 * max(conf) filter (where kind is not null and conf > 0.02)), 6), 0e0) as marker_strength,
             count(distinct (kind, phrase)) filter (where kind is not null and conf > 0.02) as markers
      from h group by doc_id""",
)
def prj5(t):
    return T.marker_summary(labelled_lines(t), "doc_id", "conf", F.col("conf") > 0.02)


@query(
    "prj6_reason_codes",
    """select asset_id, concat_ws('|', case when score >= 0.5 then 'SCORE_SUPPORTS' end, case when score < 0.5 then 'SCORE_WEAK' end,
         case when score >= 0.45 and score < 0.55 then 'ABSTAINED' end, case when label = 1 then 'LABELLED_POSITIVE' end) as ordered_codes,
       concat_ws('|', case when score >= 0.45 and score < 0.55 then 'ABSTAINED' end, case when label = 1 then 'LABELLED_POSITIVE' end,
         case when score >= 0.5 then 'SCORE_SUPPORTS' end, case when score < 0.5 then 'SCORE_WEAK' end) as sorted_codes from V_SCORE""",
)
def prj6(t):
    hit, s = F.col("score") >= 0.5, F.col("score")
    pairs = [
        (hit, "SCORE_SUPPORTS"), (~hit, "SCORE_WEAK"), ((s >= 0.45) & (s < 0.55), "ABSTAINED"),
        (F.col("label") == 1, "LABELLED_POSITIVE"), (hit, "SCORE_SUPPORTS"),
    ]
    return t.scores().select(
        "asset_id", X.joined(X.codes(*pairs)).alias("ordered_codes"),
        X.joined(X.sorted_codes(*pairs)).alias("sorted_codes"),
    )


# Keys whose values never leave the process.
SECRET_KEYS = ["authorization", "api_key", "token", "secret"]


def redact(map_col, keys=tuple(SECRET_KEYS)):
    """Replace the values of secret keys, whatever their case."""
    return F.transform_values(
        map_col, lambda k, v: F.when(F.lower(k).isin(*keys), F.lit("[redacted]")).otherwise(v)
    )


@query(
    "prj7_redaction",
    """select event_id, concat('Token=[redacted];k=', json_extract_string(props, '$.k'), ';type=', event_type) as attributes from V_EVENT""",
)
def prj7(t):
    m = F.create_map(
        F.lit("Token"), F.md5("props"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type")
    )
    shown = F.array_join(
        F.transform(F.map_entries(redact(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"
    )
    return t.requests().select("event_id", shown.alias("attributes"))


@query(
    "prj8_nested_path",
    """select event_id, event_id % 4 <> 1 as present, case when event_id % 4 = 2 then true else false end as is_null,
         case when event_id % 4 in (0, 3) then json_extract(props, '$.k')::bigint end as value from V_EVENT""",
)
def prj8(t):
    doc = F.expr(
        "case event_id % 4 when 1 then '{\"metrics\":{}}' when 2 then '{\"metrics\":{\"k\":null}}' "
        "else concat('{\"metrics\":', props, '}') end"
    )
    return resolve_path(t.requests().withColumn("doc", doc), "doc", "$.metrics.k").selectExpr(
        "event_id", "present", "is_null", "value"
    )


def resolve_path(df, doc, path, kind="bigint"):
    """Value at a path, telling an absent path from a recorded null."""
    v = F.parse_json(F.col(doc))
    at = F.try_variant_get(v, path, "variant")
    return (
        df.withColumn("__at", at)
        .withColumn("present", F.col("__at").isNotNull())
        .withColumn("is_null", F.coalesce(F.is_variant_null("__at"), F.lit(False)))
        .withColumn("value", F.try_variant_get("__at", "$", kind))
        .drop("__at")
    )


@query(
    "prj10_canonical_digest",
    """select work_id, sha256(concat('{"byte_size":', byte_size, ',"catalog_id":"', catalog_id, '","claimant":', coalesce('"' || claimant || '"', 'null'),
        ',"work_id":', work_id, '}')) as digest from V_WORK""",
)
def prj10(t):
    return t.works().select("work_id", canonical_digest(["work_id", "claimant", "byte_size", "catalog_id"]).alias("digest"))


@query(
    "prj11_integrity_projection",
    """select license_id, state, permitted_use, sha256(concat('https://records.example/', claim_id)) as source_uri_sha256,
        case when claim_id % 3 = 0 then null else sha256(concat('note ', claim_id)) end as note_sha256,
        strftime(effective_from, '%Y-%m-%dT%H:%M:%S.%f+00:00') as effective_from, strftime(effective_until, '%Y-%m-%dT%H:%M:%S.%f+00:00') as effective_until from V_LICENSE""",
)
def prj11(t):
    lic = t.licenses().withColumn("source_uri", F.expr("concat('https://records.example/', claim_id)")).withColumn(
        "note", F.expr("if(claim_id % 3 = 0, null, concat('note ', claim_id))")
    )
    return integrity_projection(lic, ["source_uri", "note"], ["effective_from", "effective_until"]).select(
        "license_id", "state", "permitted_use", "source_uri_sha256", "note_sha256", "effective_from", "effective_until"
    )


def integrity_projection(df, private, times):
    """Private text becomes its digest (absent stays absent), times become UTC text."""
    for c in private:
        df = df.withColumn(f"{c}_sha256", F.when(F.col(c) != "", F.sha2(F.col(c), 256))).drop(c)
    for c in times:
        df = df.withColumn(c, X.iso_utc(F.col(c)))
    return df


def safe_scores(m):
    """Keep usable names and finite scores in [0, 1], lower-case, rounded, in name order."""
    pairs = F.transform(
        F.map_entries(m),
        lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.round(e["value"], 6).alias("value"), e["value"].alias("raw")),
    )
    good = F.filter(
        pairs,
        lambda e: (e["key"] != "") & (F.char_length(e["key"]) <= 80) & ~F.isnan(e["raw"]) & (e["raw"] >= 0) & (e["raw"] <= 1),
    )
    return F.array_sort(F.transform(good, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


@query(
    "prj12_safe_scores",
    """select event_id, concat_ws(';', case when value / 300 <= 1 then concat('alpha=', (round(value / 300, 6) * 1000000)::bigint) end,
         concat(event_type, '=', (round((event_id % 100) / 1e2, 6) * 1000000)::bigint)) as scores from V_EVENT""",
)
def prj12(t):
    m = F.create_map(
        F.concat(F.lit(" "), F.upper("event_type")), (F.col("event_id") % 100) / 1e2,
        F.lit("Alpha "), F.col("value") / 300, F.lit("  "), F.lit(0.5), F.lit("nan"), F.lit(float("nan")),
        F.lit("over"), F.lit(1.5),
    )
    shown = F.array_join(
        F.transform(
            safe_scores(m),
            lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 1000000).cast("bigint").cast("string")),
        ),
        ";",
    )
    return t.requests().select("event_id", shown.alias("scores"))


@query(
    "prj13_degraded",
    """select tenant_id, concat_ws('|', case when views < 12 then 'COPY_LEARNED_RETRIEVAL_UNAVAILABLE' end,
         case when clicks < 12 then 'CREATOR_PROFILE_UNAVAILABLE' when clicks < 15 then 'CREATOR_PROFILE_DIAGNOSTIC_ONLY' end,
         case when errors < 12 then 'AI_ORIGIN_DETECTION_UNAVAILABLE' end,
         case when signups < 12 then 'PROOF_ANCHOR_UNAVAILABLE' when signups < 15 then 'PROOF_IS_LOCAL_TRANSPARENCY_LOG_NOT_BLOCKCHAIN' end) as degraded
       from (select tenant_id, count(*) filter (where meter='view') as views, count(*) filter (where meter='click') as clicks,
             count(*) filter (where meter='error') as errors, count(*) filter (where meter='signup') as signups from V_USAGE group by 1) t""",
)
def prj13(t):
    n = lambda m: F.count_if(F.col("meter") == m)
    status = t.usage().groupBy("tenant_id").agg(
        (n("view") >= 12).alias("retrieval"), (n("click") >= 12).alias("profiles"), (n("click") >= 15).alias("learned"),
        (n("error") >= 12).alias("origin"), (n("signup") >= 12).alias("anchor"), (n("signup") < 15).alias("local_log"),
    )
    return status.select("tenant_id", X.joined(degraded()).alias("degraded"))


def degraded():
    """Every capability a caller should not assume is running."""
    c = F.col
    return X.codes(
        (~c("retrieval"), "COPY_LEARNED_RETRIEVAL_UNAVAILABLE"),
        (~c("profiles"), "CREATOR_PROFILE_UNAVAILABLE"),
        (c("profiles") & ~c("learned"), "CREATOR_PROFILE_DIAGNOSTIC_ONLY"),
        (~c("origin"), "AI_ORIGIN_DETECTION_UNAVAILABLE"),
        (~c("anchor"), "PROOF_ANCHOR_UNAVAILABLE"),
        (c("anchor") & c("local_log"), "PROOF_IS_LOCAL_TRANSPARENCY_LOG_NOT_BLOCKCHAIN"),
    )


@query(
    "prj14_retention_tier",
    """select tier, meter, count(*) as events from (select meter, case when s <= 0 then 'none' when s <= 86400 then 'short'
        when s <= 2592000 then 'standard' else 'extended' end as tier from (select meter, (quantity - 1) * 43200 as s from V_USAGE) q) t group by all""",
)
def prj14(t):
    secs = (F.col("quantity") - 1) * 43200
    return t.usage().groupBy(retention_tier(secs).alias("tier"), "meter").agg(F.count(F.lit(1)).alias("events"))


def retention_tier(seconds):
    # One day and thirty days, in seconds.
    return X.cascade([(seconds <= 0, "none"), (seconds <= 86400, "short"), (seconds <= 2592000, "standard")], "extended")


@query(
    "fn1_unit_interval",
    """select asset_id, case when asset_id % 9 = 0 then null when asset_id % 9 = 1 then null else least(greatest(score * 2 - 0.5e0, 0e0), 1e0) end as unit from V_SCORE""",
)
def fn1(t):
    raw = F.expr("case when asset_id % 9 = 0 then null when asset_id % 9 = 1 then double('NaN') else score * 2 - 0.5D end")
    return t.scores().select("asset_id", X.unit(raw).alias("unit"))


@query(
    "fn2_logit_sigmoid",
    """select asset_id, round(ln(p / (1 - p)), 6) as logit, round(1 / (1 + exp(-least(greatest(score * 200 - 100, -50), 50))), 6) as bounded
       from (select asset_id, score, least(greatest(score, 1e-5), 1 - 1e-5) as p from V_SCORE) t""",
)
def fn2(t):
    s = F.col("score")
    return t.scores().select("asset_id", X.r6(X.logit(s)).alias("logit"), X.r6(X.sigmoid(s * 200 - 100)).alias("bounded"))


@query("fn3_likelihood_ratio", "select asset_id, round(1 / (1 + exp(-(score * 12 - 6))), 6) as score from V_SCORE")
def fn3(t):
    return t.scores().select("asset_id", X.r6(X.sigmoid(F.col("score") * 12 - 6)).alias("score"))


@query(
    "fn4_l2_normalize",
    """select item_id, case when item_id % 10 = 0 then null else round(embedding[1] / n, 6) end as first, case when item_id % 10 = 0 then null else round(embedding[64] / n, 6) end as last
       from (select item_id, embedding, sqrt(list_dot_product(embedding, embedding)) as n from V_ANCHOR) t""",
)
def fn4(t):
    v = F.expr("case when item_id % 20 = 0 then transform(embedding, x -> float(0)) when item_id % 20 = 10 then transform(embedding, x -> float('NaN')) else transform(embedding, x -> x * 3) end")
    out = t.anchors().withColumn("u", X.l2_normalize(v))
    return out.select("item_id", X.r6(F.col("u")[0]).alias("first"), X.r6(F.col("u")[63]).alias("last"))


@query(
    "fn5_cosine",
    """select a.item_id, round(list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))), 6) as cosine
       from V_ANCHOR a join V_ANCHOR b on b.item_id = a.item_id + 1""",
)
def fn5(t):
    nxt = t.anchors().selectExpr("item_id - 1 as item_id", "embedding as other")
    return t.anchors().join(nxt, "item_id").select("item_id", X.r6(X.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@query(
    "fn6_hamming",
    "select a.item_id, bit_count(xor(a.hi, b.hi))::bigint + bit_count(xor(a.lo, b.lo))::bigint as distance, greatest(0e0, 1e0 - (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo))) / 64e0) as similarity from V_BITS a join V_BITS b on b.item_id = a.item_id + 1",
)
def fn6(t):
    hexed = t.vector_bits().selectExpr("item_id", "lower(concat(lpad(hex(hi), 8, '0'), lpad(hex(lo), 8, '0'))) as h")
    nxt = hexed.selectExpr("item_id - 1 as item_id", "h as g")
    h, g = F.col("h"), F.col("g")
    d = X.hamming(X.hex_half(h, 0), X.hex_half(h, 1), X.hex_half(g, 0), X.hex_half(g, 1))
    return hexed.join(nxt, "item_id").select("item_id", d.alias("distance"), X.fingerprint_similarity(d).alias("similarity"))


@query(
    "fn7_leaf_node_hash",
    """select statement_id, sha256(unhex(concat('00', packet_hash))) as leaf_hash, sha256(unhex(concat('01', packet_hash, sha256(packet_hash)))) as node_hash from V_LEAF""",
)
def fn7(t):
    p = F.col("packet_hash")
    return t.leaves().select("statement_id", X.leaf_hash(p).alias("leaf_hash"), X.node_hash(p, F.sha2(p, 256)).alias("node_hash"))


_PAD = "xor(unhex(rpad(hex(encode(concat('secret-', user_id))), 128, '0'))::bit, unhex(repeat('{0}', 64))::bit)::blob"
_SECS = "floor(epoch(ts))::bigint"


@query(
    "fn8_hmac_freshness",
    f"""select event_id, sha256({_PAD.format('5C')} || unhex(sha256({_PAD.format('36')} || encode(concat_ws('.', {_SECS}::varchar, props))))) as signature,
       abs(epoch(timestamp '2024-01-15 00:00:00')::bigint - {_SECS}) <= 300 as fresh from events""",
)
def fn8(t):
    secs = F.unix_timestamp(F.col("ts").cast("timestamp"))
    body = F.encode(F.concat_ws(".", secs.cast("string"), F.col("props")), "utf-8")
    now = F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return t.requests().select(
        "event_id", X.hmac_sha256(F.encode(F.concat(F.lit("secret-"), F.col("tenant_id").cast("string")), "utf-8"), body).alias("signature"),
        (F.abs(now - secs) <= 300).alias("fresh"),
    )


@query(
    "fn9_backoff",
    "select job_id, least(600, (2 ** attempts)::bigint)::bigint as delay_s, epoch_us(created_at) + least(600, (2 ** attempts)::bigint)::bigint * 1000000 as next_attempt_us from V_JOB",
)
def fn9(t):
    d = X.backoff_seconds(F.col("attempts"), 600)
    when = F.col("created_at").cast("timestamp") + F.make_interval(secs=d.cast("decimal(18,6)"))
    return t.jobs().select("job_id", d.alias("delay_s"), F.unix_micros(when).alias("next_attempt_us"))


@query(
    "fn10_effective_at",
    "select license_id, coalesce(f <= t, true) and coalesce(u > t, true) as effective from (select license_id, case when license_id % 5 = 0 then null else effective_from end as f, case when license_id % 7 = 0 then null else effective_until end as u, timestamp '1998-06-01' as t from V_LICENSE) q",
)
def fn10(t):
    f = F.expr("if(license_id % 5 = 0, null, effective_from)")
    u = F.expr("if(license_id % 7 = 0, null, effective_until)")
    at = F.lit("1998-06-01 00:00:00").cast("timestamp")
    return t.licenses().select("license_id", X.effective_at(f, u, at).alias("effective"))


@query(
    "fn14_validators",
    r"""select asset_id, regexp_full_match(sha256, '[0-9a-f]{64}') as digest_ok, asset_id % 3 = 0 as hex_ok, asset_id % 4 <> 1 and asset_id % 4 <> 2 as path_ok from V_MANIFEST""",
)
def fn14(t):
    from evidlake.sources.manifest import SAFE_PATH, SHA256_HEX

    path = F.expr("case asset_id % 4 when 1 then concat('/', location) when 2 then concat('a/../', location) else location end")
    short = F.expr("case when asset_id % 3 = 0 then substring(sha256, 1, 16) else concat('z', substring(sha256, 1, 15)) end")
    return t.manifest().select(
        "asset_id", F.col("sha256").rlike(SHA256_HEX).alias("digest_ok"), short.rlike("^[0-9a-f]{16}$").alias("hex_ok"),
        path.rlike(SAFE_PATH).alias("path_ok"),
    )


@query(
    "fn15_iso_utc",
    "select claim_id, strftime(effective_from, '%Y-%m-%dT%H:%M:%S.%f+00:00') as effective_from from V_CLAIM",
)
def fn15(t):
    return t.claims().select("claim_id", X.iso_utc(F.col("effective_from")).alias("effective_from"))


@query(
    "fn16_collections",
    "select event_id, true as all_nonnegative, value > 100 as any_large, concat_ws(',', case when event_id % 7 > 2 then event_id % 7 end, event_id % 7 + 10, event_id % 7 + 20) as kept from V_EVENT",
)
def fn16(t):
    arr = F.array(F.col("event_id") % 7 + 20, F.col("event_id") % 7, F.col("event_id") % 7 + 10)
    return t.requests().select(
        "event_id", F.forall(arr, lambda x: x >= 0).alias("all_nonnegative"),
        F.exists(F.array("value", F.lit(1.0)), lambda x: x > 100).alias("any_large"),
        F.array_join(F.array_sort(F.filter(arr, lambda x: x > 2)).cast("array<string>"), ",").alias("kept"),
    )
