"""Integrity log queries over documents, conversations, orders and line items."""

from pyspark.sql import functions as F

from evidlake.functions.expr import leaf_hash
from evidlake.operators import ledger as L
from evidlake.plans.registry import query


_LEVELS = """with recursive lv(lev, h) as (select 0, (select list(sha256(unhex(concat('00', packet_hash))) order by leaf_index) from V_LEAF)
  union all select lev + 1, list_transform(range(1, len(h) + 1, 2), lambda i: case when i + 1 <= len(h) then sha256(unhex(concat('01', h[i], h[i + 1]))) else h[i] end) from lv where len(h) > 1)"""


@query("lg1_merkle_root", f"{_LEVELS} select (select count(*) from V_LEAF) as tree_size, h[1] as root from lv where len(h) = 1")
def lg1(t):
    return L.merkle_root(t.leaves(), bits=8)


@query(
    "lg2_inclusion_proofs",
    f"""{_LEVELS} select l.leaf_index as idx, sha256(unhex(concat('00', l.packet_hash))) as hash, string_agg(case when (l.leaf_index >> lev) % 2 = 1 then 'left' else 'right' end, ',' order by lev) as sides,
        string_agg(h[xor(l.leaf_index >> lev, 1) + 1], ',' order by lev) as siblings from V_LEAF l cross join lv where len(h) > 1 and xor(l.leaf_index >> lev, 1) < len(h) group by all""",
)
def lg2(t):
    return L.inclusion_proofs(t.leaves(), bits=8).select("idx", "hash", F.array_join("sides", ",").alias("sides"), F.array_join("siblings", ",").alias("siblings"))


@query("lg3_verify_proofs", "select leaf_index as idx, leaf_index % 7 <> 3 as valid, leaf_index % 7 <> 3 as strict_valid from V_LEAF")
def lg3(t):
    proofs = L.inclusion_proofs(t.leaves(), bits=8)
    # Every seventh proof is tampered with.
    bad = F.when(F.col("idx") % 7 == 3, F.transform("siblings", lambda h: F.reverse(h))).otherwise(F.col("siblings"))
    top = L.merkle_root(t.leaves(), bits=8)
    out = L.verify_proofs(proofs.withColumn("siblings", bad), top.select("tree_size").scalar(), top.select("root").scalar())
    return out.select("idx", "valid", "strict_valid")


@query(
    "lg4_prefix_roots",
    """with recursive pr(tree_size, h) as (select c.tree_size, list(sha256(unhex(concat('00', l.packet_hash))) order by l.leaf_index) from V_CKPT c join V_LEAF l on l.leaf_index < c.tree_size group by 1
        union all select tree_size, list_transform(range(1, len(h) + 1, 2), lambda i: case when i + 1 <= len(h) then sha256(unhex(concat('01', h[i], h[i + 1]))) else h[i] end) from pr where len(h) > 1)
        select tree_size, h[1] as root from pr where len(h) = 1""",
)
def lg4a(t):
    nodes = L.node_table(t.leaves(), bits=8)
    return L.prefix_roots(nodes, t.checkpoints().select("tree_size")).select("tree_size", F.col("recomputed").alias("root"))


@query(
    "lg4_checkpoint_audit",
    """select tree_size, case when tree_size % 50 = 0 then 'ROOT_MISMATCH' else 'CONSISTENT' end as verdict from V_CKPT
       union all select tree_size + 100000000000, 'CHECKPOINT_AHEAD_OF_LOG' from V_CKPT where tree_size % 70 = 0""",
)
def lg4(t):
    nodes = L.node_table(t.leaves(), bits=8)
    ck = t.checkpoints().select("tree_size")
    true_roots = L.prefix_roots(nodes, ck).select("tree_size", F.col("recomputed").alias("root"))
    # Recorded checkpoints: every fifth root altered, one of them far ahead of the log.
    recorded = true_roots.withColumn(
        "root", F.when(F.col("tree_size") % 50 == 0, F.reverse("root")).otherwise(F.col("root"))
    ).unionByName(true_roots.where("tree_size % 70 = 0").withColumn("tree_size", F.col("tree_size") + 100_000_000_000))
    size = t.leaves().agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return L.audit_checkpoints(nodes, recorded, size).select("tree_size", "verdict")


@query(
    "wn6_log_gaps",
    """with r as (select leaf_index + case when leaf_index >= 300 then 1 else 0 end as i, case when leaf_index % 101 = 5 then 'zz' else packet_hash end as p, case when leaf_index % 103 = 7 then sha256(packet_hash) else sha256(unhex(concat('00', packet_hash))) end as h, leaf_index % 101 = 5 as bad, packet_hash from V_LEAF),
        x as (select i, row_number() over (order by i) - 1 as e, bad, h, packet_hash from r)
        select i as leaf_index, e as expected_index, concat_ws('|', case when i <> e then 'LEAF_INDEX_GAP' end, case when bad then 'INVALID_PACKET_DIGEST' end, case when bad or h <> sha256(unhex(concat('00', packet_hash))) then 'LEAF_HASH_MISMATCH' end) as reasons from x
        where i <> e or bad or h <> sha256(unhex(concat('00', packet_hash)))""",
)
def wn6(t):
    recorded = t.leaves().select(
        (F.col("leaf_index") + F.when(F.col("leaf_index") >= 300, 1).otherwise(0)).alias("leaf_index"),
        F.when(F.col("leaf_index") % 101 == 5, "zz").otherwise(F.col("packet_hash")).alias("packet_hash"),
        F.when(F.col("leaf_index") % 103 == 7, F.sha2("packet_hash", 256)).otherwise(leaf_hash(F.col("packet_hash"))).alias("recorded_hash"),
    )
    return L.log_gaps(recorded)


@query(
    "jn7_unlogged",
    "select doc_id as statement_id, source from documents where doc_id not in (select statement_id from V_LEAF) order by doc_id limit 50",
)
def jn7(t):
    records = t.raw("documents").selectExpr("doc_id as statement_id", "source")
    return L.unlogged(records, t.leaves(), 50)


@query("jn8_unqueued_checkpoints", "select tree_size, confirmed from V_CKPT where not queued")
def jn8(t):
    key = ["'net-1' as deployment", "'checkpoint' as subject_type", "sha2(cast(tree_size as string), 256) as root"]
    ck = t.checkpoints().selectExpr("*", *key)
    jobs = t.checkpoints().where("queued").selectExpr(*key)
    return L.unqueued(ck, jobs).select("tree_size", "confirmed")


@query("jn9_attachable", "select tree_size from V_CKPT where confirmed and tree_size % 60 <> 0")
def jn9(t):
    root = "sha2(cast(tree_size as string), 256) as root"
    jobs = t.checkpoints().selectExpr(root, "if(confirmed, 'CONFIRMED', 'PENDING') as state")
    ck = t.checkpoints().selectExpr("tree_size", root, "if(tree_size % 60 = 0, 'receipt', null) as receipt")
    return L.attachable(jobs, ck).select("tree_size")


@query(
    "jn10_covering_checkpoint",
    "select leaf_index, (select min(tree_size) from V_CKPT c where c.tree_size > l.leaf_index) as covering, (select max(tree_size) from V_CKPT c where c.tree_size > l.leaf_index) as largest from V_LEAF l",
)
def jn10(t):
    return L.covering_checkpoint(t.leaves(), t.checkpoints())


_CK = "select tree_size, case when confirmed then 'CONFIRMED' when queued then 'PENDING' when tree_size % 70 = 0 then 'FAILED' else 'RETRYABLE' end as state, tree_size % 90 <> 0 as ok from V_CKPT"


@query(
    "jn24_subject_integrity",
    f"""with k as ({_CK}), x as (select leaf_index, (select min(tree_size) from k where tree_size > leaf_index and state = 'CONFIRMED' and ok) as ca, (select min(tree_size) from k where tree_size > leaf_index and state = 'CONFIRMED' and not ok) as ia,
          (select min(tree_size) from k where tree_size > leaf_index and state in ('PENDING', 'RETRYABLE')) as aa, (select min(tree_size) from k where tree_size > leaf_index and state = 'FAILED') as fa from V_LEAF)
        select leaf_index, case when ca is not null then 'CONFIRMED' when ia is not null then 'VERIFICATION_FAILED' when aa is not null then 'PENDING' when fa is not null then 'FAILED' else 'PENDING' end as public_status, case when ca is not null then ca when ia is not null then null else coalesce(aa, fa) end as tree_size from x""",
)
def jn24(t):
    ck = t.checkpoints().selectExpr(
        "tree_size", "case when confirmed then 'CONFIRMED' when queued then 'PENDING' when tree_size % 70 = 0 then 'FAILED' else 'RETRYABLE' end as state", "tree_size % 90 <> 0 as checks_ok"
    )
    return L.subject_integrity(t.leaves(), ck)


@query(
    "jn20_projection_integrity",
    """with ev as (select subject_id as id, max((created_at, rights_event_id)) as m from V_RIGHTS group by 1), e as (select id, m[2] as event_id from ev)
        select c.claim_id as id, e.event_id, case when e.id is null then 'CLAIM_INTEGRITY_EVENT_MISSING' when e.event_id % 13 = 0 then 'CLAIM_INTEGRITY_EVENT_TYPE_INVALID' when e.event_id % 7 = 0 then 'CLAIM_INTEGRITY_LOG_INCLUSION_MISSING' when e.event_id % 11 = 0 then 'CLAIM_INTEGRITY_PROJECTION_MISSING'
           when c.claim_id % 5 = 0 then 'CLAIM_PROJECTION_INTEGRITY_MISMATCH' end as reason_code, e.id is not null and e.event_id % 13 <> 0 and e.event_id % 7 <> 0 and e.event_id % 11 <> 0 and c.claim_id % 5 <> 0 as verified from V_CLAIM c left join e on e.id = c.claim_id""",
)
def jn20(t):
    rows = t.claims().selectExpr("claim_id as id", "sha2(concat(claim_id, '|', state), 256) as projection_digest")
    states = t.claims().selectExpr("claim_id as subject_id", "sha2(concat(claim_id, '|', if(claim_id % 5 = 0, 'OTHER', state)), 256) as pd")
    events = t.rights_events().join(states, "subject_id").selectExpr(
        "subject_id as id", "rights_event_id as event_id", "created_at as at", "if(rights_event_id % 13 = 0, 'UNKNOWN', 'CLAIM_STATE_CHANGED') as event_type",
        "sha2(cast(rights_event_id as string), 256) as payload_digest", "if(rights_event_id % 11 = 0, null, pd) as projection_digest",
    )
    leaves = t.rights_events().select("rights_event_id").distinct().where("rights_event_id % 7 <> 0").selectExpr(
        "rights_event_id as event_id", "sha2(cast(rights_event_id as string), 256) as packet_hash"
    )
    return L.projection_integrity(rows, events, leaves)


@query(
    "lg5_statement_lineage",
    """with s as (select *, case when scan_id % 7 = 3 and turn >= 2 then scan_id * 1000 when scan_id % 11 = 5 and turn = 2 then scan_id * 1000 + 777 else previous_statement_id end as prev from V_STMT),
        p as (select s.*, q.statement_id as found, case when scan_id % 13 = 4 and s.turn = 1 then 'x' else q.payload_digest end as bound, q.payload_digest as truth from s left join (select statement_id, payload_digest from s) q on q.statement_id = s.prev),
        f as (select prev, count(*) as k from s where prev is not null group by 1),
        g as (select scan_id, count(*) as statements, count(*) filter (where prev is null) as roots, count(*) filter (where prev is not null and found is null) as disc, count(*) filter (where f.k > 1) as br, count(*) filter (where prev is not null and bound <> truth) as ub,
              arg_max(statement_type, p.statement_id) filter (where f.k is null) as tip from (select p.*, p.statement_id as sid from p) p left join (select prev as fp, k from f) f on f.fp = p.sid group by scan_id)
        select scan_id, statements, case when br > 0 then 'LINEAGE_BRANCHES' when ub > 0 then 'PREDECESSOR_DIGEST_NOT_BOUND' when roots <> 1 or disc > 0 then 'LINEAGE_DISCONNECTED' else 'LINEAR' end as lineage,
          case when br = 0 and ub = 0 and roots = 1 and disc = 0 then case tip when 'RESULT' then 'ACTIVE' when 'DISPUTE' then 'DISPUTED' when 'CORRECTION' then 'CORRECTED' when 'SUPERSESSION' then 'SUPERSEDED' else 'REVOKED' end end as status from g""",
)
def lg5(t):
    s = t.statements().selectExpr(
        "scan_id", "turn", "statement_id", "statement_type", "payload_digest",
        "case when scan_id % 7 = 3 and turn >= 2 then scan_id * 1000 when scan_id % 11 = 5 and turn = 2 then scan_id * 1000 + 777 else previous_statement_id end as previous_statement_id",
    )
    parent = s.selectExpr("statement_id as previous_statement_id", "payload_digest as bound_digest")
    bound = s.join(parent, "previous_statement_id", "left").withColumn(
        "bound_digest", F.expr("if(scan_id % 13 = 4 and turn = 1 and previous_statement_id is not null, 'x', bound_digest)")
    )
    return L.lineage(bound)


_CASE = "case statement_type when 'RESULT' then 'OPEN' when 'DISPUTE' then 'DISPUTED' when 'CORRECTION' then 'IN_REVIEW' when 'SUPERSESSION' then 'RESOLVED' else 'CLOSED' end"


@query(
    "lg7_transition_audit",
    f"""with s as (select scan_id, turn, {_CASE} as state from V_STMT), l as (select *, lag(state) over (partition by scan_id order by turn) as previous_state from s)
        select scan_id, turn, previous_state, state, (previous_state, state) in (('OPEN', 'DISPUTED'), ('DISPUTED', 'IN_REVIEW'), ('IN_REVIEW', 'RESOLVED'), ('RESOLVED', 'CLOSED')) as allowed from l where previous_state is not null""",
)
def lg7(t):
    ev = t.statements().selectExpr("scan_id", "turn", f"{_CASE} as state")
    return L.audit_transitions(ev, "scan_id", "turn", F.floor(F.col("turn") / 1000).cast("bigint"))


@query(
    "lg8_cut_checkpoints",
    """select leaf_index // 16 as batch, count(*) as leaves, max(leaf_index) + 1 as tree_size, min(created_s) as oldest_s, case when count(*) >= 16 then 'COUNT' when 1704078000 - min(created_s) >= 3600 then 'AGE' else 'OPEN' end as trigger from V_LEAF group by 1""",
)
def lg8(t):
    return L.cut_checkpoints(t.leaves(), 16, 3600, 1704078000)


@query(
    "lg10_package_audit",
    """with s as (select c.conv_id * 1000 + c.turn as id, sha256(c.text) as h, p.payload_digest as pd, l.packet_hash as lh from conversations c join V_STMT v on v.statement_id = c.conv_id * 1000 + c.turn left join V_STMT p on p.statement_id = v.previous_statement_id left join V_LEAF l on l.statement_id = c.conv_id * 1000 + c.turn)
        select id as package_id, k.check, case k.check when 'packet_digest' then case when id % 9 = 0 then 'FAIL' else 'PASS' end when 'statement_digest' then case when id % 8 = 0 then 'FAIL' else 'PASS' end when 'packet_binding' then case when id % 6 = 0 then 'FAIL' else 'PASS' end
           when 'predecessor_binding' then case when pd is null then 'SKIPPED' when id % 5 = 0 then 'FAIL' else 'PASS' end else case when lh is null then 'SKIPPED' when lh = h then 'PASS' else 'FAIL' end end as result
        from s cross join (values ('packet_digest'), ('statement_digest'), ('packet_binding'), ('predecessor_binding'), ('log_inclusion')) k("check")""",
)
def lg10(t):
    text = t.raw("conversations").selectExpr("conv_id * 1000 + turn as statement_id", "text")
    s = t.statements().join(text, "statement_id")
    before = t.statements().selectExpr("statement_id as previous_statement_id", "payload_digest as predecessor_digest")
    leaf = t.leaves().selectExpr("statement_id", "packet_hash as leaf_packet_hash")
    pk = s.join(before, "previous_statement_id", "left").join(leaf, "statement_id", "left").selectExpr(
        "statement_id as package_id", "if(statement_id % 9 = 0, concat(text, '.'), text) as packet_text", "payload_digest as packet_hash",
        "sha2(cast(statement_id as string), 256) as statement_digest", "sha2(cast(statement_id + if(statement_id % 8 = 0, 1, 0) as string), 256) as recorded_statement_digest",
        "if(statement_id % 6 = 0, 'other', payload_digest) as bound_packet_hash", "predecessor_digest",
        "if(statement_id % 5 = 0, 'other', predecessor_digest) as bound_predecessor_digest", "leaf_packet_hash",
    )
    return L.audit_packages(pk)
