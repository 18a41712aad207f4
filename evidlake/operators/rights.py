"""Effective-dated rights: authorization at a time, backing claims, facts, event replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidlake.functions.expr import cascade, codes, effective_at, joined
from evidlake.functions.running import running
from evidlake.functions.skew import hot_threshold, join_unique
from evidlake.session import stored

DAY_US = 86_400_000_000
# States that never authorize.
LICENSE_BLOCKED = ("SUSPENDED", "SUPERSEDED", "REVOKED", "EXPIRED")
CLAIM_BLOCKED = ("DISPUTED", "SUPERSEDED", "REVOKED")
# Before every instant.
ALWAYS = -(1 << 62)
# What the sweep adds up, and how often an instant is asked about.
_SWEPT = ("permits", "vetoes", "started", "ended", "asked")


def gated(rows: DataFrame, verdicts: DataFrame, id_column: str, subject: str) -> DataFrame:
    """Rows with ``verified`` and ``integrity_code`` of their integrity verdict (ledger.projection_integrity).

    The gate fails closed: a row that no verdict speaks of isn't verified.
    """
    v = verdicts.select(
        F.col("id").alias("__vid"), F.col("verified").alias("verified"), F.col("reason_code").alias("integrity_code")
    )
    out = rows.join(v, rows[id_column] == F.col("__vid"), "left").drop("__vid")
    missing = F.col("verified").isNull()
    return out.withColumn(
        "integrity_code", F.when(missing, f"{subject.upper()}_INTEGRITY_EVENT_MISSING").otherwise(F.col("integrity_code"))
    ).withColumn("verified", F.coalesce("verified", F.lit(False)))


def _listed(licenses: DataFrame) -> DataFrame:
    """Licenses with lists of uses and a verdict, whatever of these their table has."""
    none = F.array().cast("array<string>")
    if "permitted_uses" not in licenses.columns:
        licenses = licenses.withColumn("permitted_uses", F.array("permitted_use"))
    out = licenses.withColumn("permitted_uses", F.coalesce("permitted_uses", none))
    prohibited = F.coalesce("prohibited_uses", none) if "prohibited_uses" in licenses.columns else none
    verified = F.coalesce("verified", F.lit(False)) if "verified" in licenses.columns else F.lit(True)
    return out.withColumn("prohibited_uses", prohibited).withColumn("verified", verified)


def license_authorizes(uses: DataFrame, licenses: DataFrame) -> DataFrame:
    """For every use, how many licenses of its work permit it at that time, and why others do not.

    ``uses(event_id, work_id, intended_use, at_us)``, ``licenses(work_id, state, permitted_uses, from_us, until_us)`` and, if
    there, ``prohibited_uses`` and ``verified`` (a single ``permitted_use`` will do as well). A license that fails the
    integrity gate gives no right and is only counted; of the others, the first of these applies: a blocked state, not yet
    effective, expired, the use is prohibited (even if it is also permitted), the use isn't listed. Open ends are NULL.

    No use is paired with a license. Permissions and vetoes are counted apart per (work, use): each license adds to them
    when it begins and takes away when it ends; changes and questions are reduced to one row for each instant before they are
    swept in time order, so neither many licenses of a work nor many uses at one time gather in a task. The sweep is
    chunked by day: a work's day is dealt once, where both what began and ended and what each use may do are added up; the
    days' totals are carried on as a small table, and every use then looks its instant up.
    """
    c = F.col
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    rows = _listed(licenses).select("work_id", "state", "permitted_uses", "prohibited_uses", "from_us", "until_us", "verified")
    blocked = c("state").isin(*LICENSE_BLOCKED)
    starts = F.coalesce("from_us", F.lit(ALWAYS))
    terms = F.array(
        F.struct(starts.alias("at_us"), one.alias("sign"), one.alias("started"), zero.alias("ended")),
        # One that ends before it starts is not yet effective until it has ended.
        F.struct(F.greatest(starts, "until_us").alias("at_us"), (-one).alias("sign"), zero.alias("started"), one.alias("ended")),
    )
    terms = F.filter(terms, lambda t: (t["sign"] > 0) | c("until_us").isNotNull())
    # "u:" and "s:" keep uses and states apart.
    use = lambda u: F.concat(F.lit("u:"), u)
    effect = lambda u, permits, vetoes: F.struct(u.alias("use_key"), permits.alias("permits"), vetoes.alias("vetoes"))
    effects = F.concat(
        F.transform(F.array_except("permitted_uses", "prohibited_uses"), lambda u: effect(use(u), one, zero)),
        F.transform(F.array_distinct("prohibited_uses"), lambda u: effect(use(u), zero, one)),
    )
    effects = F.when(F.size(effects) > 0, effects).otherwise(F.array(effect(F.lit("u"), zero, zero)))
    # Kind 0 sorts before the questions of the same instant: a license is effective from its first moment on, and no
    # longer at its last. Licenses without a term (kind -1) are only counted.
    change = lambda use_key, at, kind, *n: F.struct(
        use_key.alias("use_key"), at.alias("at_us"), F.lit(kind).alias("kind"), *[x.alias(y) for x, y in zip(n, _SWEPT)]
    )
    dated = F.flatten(
        F.transform(terms, lambda t: F.transform(effects, lambda e, i: change(
            e["use_key"], t["at_us"], 0, t["sign"] * e["permits"], t["sign"] * e["vetoes"], F.when(i == 0, t["started"]).otherwise(zero),
            F.when(i == 0, t["ended"]).otherwise(zero), zero,
        )))
    )
    counted = lambda name: F.array(change(name, F.lit(ALWAYS), -1, one, zero, zero, zero, zero))
    entries = F.when(~c("verified"), counted(F.lit("s:"))).when(blocked, counted(F.concat(F.lit("s:"), c("state")))).when(~blocked, dated)
    changes = rows.select("work_id", F.explode(entries).alias("e")).select("work_id", "e.*")
    asked = uses.where("work_id is not null and intended_use is not null and at_us is not null")
    questions = asked.select(
        "work_id", use(c("intended_use")).alias("use_key"), "at_us", F.lit(1).alias("kind"), *[zero.alias(n) for n in _SWEPT[:4]], one.alias("asked")
    )
    line = changes.unionByName(questions).groupBy("work_id", "use_key", "at_us", "kind").agg(*[F.sum(n).alias(n) for n in _SWEPT])
    line = line.withColumn("day", F.expr(f"at_us div {DAY_US}")).repartition("work_id", "day")
    in_day = Window.partitionBy("work_id", "day").orderBy("at_us", "kind")
    in_use = Window.partitionBy("work_id", "day", "use_key").orderBy("at_us", "kind")
    so_far = lambda n, w: F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(n)
    swept = line.select(
        "work_id", "day", "use_key", "at_us", "kind", "asked", so_far("permits", in_use), so_far("vetoes", in_use), so_far("started", in_day),
        so_far("ended", in_day), F.lead("kind").over(in_use).isNull().alias("ends_use"), F.lead("kind").over(in_day).isNull().alias("ends_day"),
    )
    swept = stored(swept.where("kind = 1 or ends_use or ends_day"), "swept")
    # What the days before left: a row for each day of a work, and of a use of it.
    days = swept.where("ends_day").select("work_id", "day", "started", "ended")
    days = running(days, ["work_id"], [], [("day", True)], {"begun": (c("started"), "sum"), "over": (c("ended"), "sum")}, inclusive=False)
    lasting = swept.where("ends_use and kind >= 0").select("work_id", "use_key", "day", "permits", "vetoes")
    lasting = running(
        lasting, ["work_id", "use_key"], [], [("day", True)], {"permitting": (c("permits"), "sum"), "prohibiting": (c("vetoes"), "sum")}, inclusive=False
    )
    state = lambda s: F.sum(F.when((c("kind") == -1) & (c("use_key") == f"s:{s}"), c("permits")))
    totals = swept.groupBy("work_id").agg(
        F.sum(F.when(c("ends_day"), c("started"))).alias("active"), *[state(s).alias(f"state_{s.lower()}") for s in LICENSE_BLOCKED], state("").alias("unverified")
    )
    before = lasting.drop("permits", "vetoes").join(days.drop("started", "ended"), ["work_id", "day"]).join(totals, "work_id")
    known = swept.where("kind = 1").withColumn("__ask", F.struct("work_id", "use_key", "at_us"))
    hot = known.where(c("asked") > hot_threshold(uses)).select("__ask")
    known = known.join(before, ["work_id", "use_key", "day"]).select(
        "__ask", (c("permitting") + c("permits")).alias("permitting"), (c("prohibiting") + c("vetoes")).alias("prohibiting"),
        (c("begun") + c("started")).alias("begun"), (c("over") + c("ended")).alias("over"), *totals.columns[1:],
    )
    out = uses.select("event_id", F.struct("work_id", use(c("intended_use")).alias("use_key"), "at_us").alias("__ask"))
    out = join_unique(out, known, "__ask", "event_id", hot=hot).withColumn("work_id", c("__ask.work_id"))
    n = lambda name: F.coalesce(c(name), zero)
    out = out.select(
        "event_id", "work_id", n("permitting").alias("permitting"), n("prohibiting").alias("prohibiting"),
        (n("begun") - n("over") - n("permitting") - n("prohibiting")).alias("other_use"),
        (n("over") + n("state_expired")).alias("expired"), (n("active") - n("begun")).alias("not_yet_effective"),
        n("state_suspended").alias("suspended"), n("state_revoked").alias("revoked"), n("state_superseded").alias("superseded"),
        n("unverified").alias("unverified"),
    )
    reasons = codes(
        (c("other_use") > 0, "LICENSE_DOES_NOT_LIST_INTENDED_USE"),
        (c("expired") > 0, "LICENSE_EXPIRED"),
        (c("not_yet_effective") > 0, "LICENSE_NOT_YET_EFFECTIVE"),
        (c("permitting") > 0, "LICENSE_PERMITS_INTENDED_USE"),
        (c("prohibiting") > 0, "LICENSE_PROHIBITS_INTENDED_USE"),
        (c("unverified") > 0, "LICENSE_PROJECTION_INTEGRITY_UNVERIFIED"),
        (c("revoked") > 0, "LICENSE_REVOKED"),
        (c("superseded") > 0, "LICENSE_SUPERSEDED"),
        (c("suspended") > 0, "LICENSE_SUSPENDED"),
    )
    return out.withColumn("authorized", c("permitting") > 0).withColumn("reason_codes", joined(reasons))


def corroborating(claims: DataFrame, as_of: Column) -> Column:
    """True for claims that are verified, effective at a time and corroborated: only these back a license."""
    until = F.col("effective_until") if "effective_until" in claims.columns else F.lit(None)
    verified = F.coalesce("verified", F.lit(False)) if "verified" in claims.columns else F.lit(True)
    return verified & effective_at(F.col("effective_from"), until, as_of) & (F.col("state") == "CORROBORATED")


def backed_licenses(licenses: DataFrame, claims: DataFrame, as_of: Column) -> DataFrame:
    """Whether each license rests on a claim of its own work that is corroborated, effective and, where judged, verified."""
    c = claims.select(
        F.col("claim_id").alias("claim_id"), F.col("work_id").alias("work_id"), F.col("state").alias("claim_state"),
        corroborating(claims, as_of).alias("claim_stands"),
    )
    backing = cascade(
        [
            (F.col("claim_state").isNull(), "LICENSE_NOT_BOUND_TO_RECORDED_CLAIM"),
            (F.col("claim_stands"), "STRONG"),
            (F.col("claim_state") == "DISPUTED", "MATCHED_CLAIM_DISPUTED"),
            (F.col("claim_state") == "SUPERSEDED", "MATCHED_CLAIM_SUPERSEDED"),
            (F.col("claim_state") == "REVOKED", "MATCHED_CLAIM_REVOKED"),
        ],
        "MATCHED_CLAIM_NOT_CORROBORATED",
    )
    return licenses.join(c, ["claim_id", "work_id"], "left").withColumn("backing", backing).drop("claim_stands")


def rights_history(events: DataFrame, claims: DataFrame, licenses: DataFrame) -> DataFrame:
    """Events with the work they concern: the work's own, its claims' and its licenses'."""
    subjects = (
        claims.select(F.concat(F.lit("claim:"), F.col("claim_id")).alias("subject"), "work_id")
        .unionByName(licenses.select(F.concat(F.lit("license:"), F.col("license_id")).alias("subject"), "work_id"))
        .unionByName(
            claims.select("work_id").distinct().select(F.concat(F.lit("work:"), F.col("work_id")).alias("subject"), "work_id")
        )
    )
    return events.join(subjects, "subject")


def rights_facts(claims: DataFrame, licenses: DataFrame, uses: list[str], as_of: Column) -> DataFrame:
    """The recorded rights position per (work, intended use) at a time.

    ``claims`` and ``licenses`` come through ``gated``: what isn't verified contributes no right, and says why. ``uses``
    is the short list of uses asked about. Everything is conditional counts and sets of a few codes, combined before
    the shuffle, so nothing but one row per work, and per claim that a fitting license names, is ever gathered. The authorizing
    license is the first by version (and time of creation, where there is one), then id.
    """
    c = F.col
    verified = c("verified")
    claimed = claims.withColumn("stands", corroborating(claims, as_of))
    claim_facts = claimed.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if("stands").alias("corroborated"),
        *[F.count_if(c("state") == s).alias(f"claims_{s.lower()}") for s in CLAIM_BLOCKED],
        F.count_if(c("effective_from") > as_of).alias("claims_not_yet"),
        F.count_if(c("effective_until") <= as_of).alias("claims_ended"),
        F.collect_set(F.when(~verified, c("integrity_code"))).alias("claim_failures"),
    )
    state_ok = ~c("state").isin(*LICENSE_BLOCKED)
    late, over = F.coalesce(c("effective_from") > as_of, F.lit(False)), F.coalesce(c("effective_until") <= as_of, F.lit(False))
    in_time = verified & state_ok & ~late & ~over
    order = F.struct(*[n for n in ("version", "created_at", "license_id") if n in licenses.columns])
    weak_codes = (
        "LICENSE_NOT_BOUND_TO_RECORDED_CLAIM", "MATCHED_CLAIM_DISPUTED", "MATCHED_CLAIM_NOT_CORROBORATED", "MATCHED_CLAIM_REVOKED",
        "MATCHED_CLAIM_SUPERSEDED",
    )
    listed, per_use, fitting = _listed(licenses), [], F.lit(False)
    for i, u in enumerate(uses):
        veto, named = F.array_contains("prohibited_uses", u), F.array_contains("permitted_uses", u)
        fits = F.coalesce(in_time & ~veto & named, F.lit(False))
        fitting = fitting | fits
        per_use += [
            F.count_if(fits).alias(f"scope_{i}"), F.min(F.when(fits, order)).alias(f"first_{i}"),
            F.count_if(in_time & veto).alias(f"vetoed_{i}"), F.count_if(in_time & ~veto & ~named).alias(f"other_{i}"),
        ]
    # Only a license that fits a use asks for its claim; all others of a work are one row before they meet the claims.
    blocked = [f"licenses_{s.lower()}" for s in LICENSE_BLOCKED]
    sums = ["licenses", *blocked, "licenses_not_yet", "licenses_over"]
    by_claim = listed.withColumn("claim_id", F.when(fitting, c("claim_id"))).groupBy("work_id", "claim_id").agg(
        F.count(F.lit(1)).alias("licenses"),
        *[F.count_if(verified & (c("state") == s)).alias(n) for n, s in zip(blocked, LICENSE_BLOCKED)],
        F.count_if(verified & state_ok & late).alias("licenses_not_yet"),
        F.count_if(verified & state_ok & ~late & over).alias("licenses_over"),
        F.collect_set(F.when(~verified, c("integrity_code"))).alias("license_failures"),
        *per_use,
    )
    backed = backed_licenses(by_claim, claims, as_of)
    strong, weak = c("backing") == "STRONG", c("backing").isin(*weak_codes)
    license_facts = backed.groupBy("work_id").agg(
        *[F.sum(n).alias(n) for n in sums],
        F.array_distinct(F.flatten(F.collect_set("license_failures"))).alias("license_failures"),
        *[F.sum(f"{n}_{i}").alias(f"{n}_{i}") for n in ("scope", "vetoed", "other") for i in range(len(uses))],
        *[F.coalesce(F.sum(F.when(strong, c(f"scope_{i}"))), F.lit(0).cast("bigint")).alias(f"strong_{i}") for i in range(len(uses))],
        *[F.min(F.when(strong, c(f"first_{i}"))).alias(f"first_{i}") for i in range(len(uses))],
        *[F.collect_set(F.when((c(f"scope_{i}") > 0) & weak, c("backing"))).alias(f"weak_{i}") for i in range(len(uses))],
    )
    names = ("scope", "strong", "first", "vetoed", "other", "weak")
    stacked = F.explode(
        F.array(*[F.struct(F.lit(u).alias("intended_use"), *[c(f"{n}_{i}").alias(n) for n in names]) for i, u in enumerate(uses)])
    )
    counts = [
        "claims", "corroborated", "claims_not_yet", "claims_ended", *[f"claims_{s.lower()}" for s in CLAIM_BLOCKED], "licenses",
        "licenses_not_yet", "licenses_over", *[f"licenses_{s.lower()}" for s in LICENSE_BLOCKED],
    ]
    n = lambda col: F.coalesce(c(col), F.lit(0).cast("bigint"))
    some = lambda col: F.coalesce(c(col), F.array().cast("array<string>"))
    work = claim_facts.join(license_facts, "work_id", "full").withColumn("u", stacked).select(
        "work_id", "u.intended_use", *[n(x).alias(x) for x in counts],
        *[n(f"u.{x}").alias(x) for x in ("scope", "strong", "vetoed", "other")], some("u.weak").alias("weak"),
        some("claim_failures").alias("claim_failures"), some("license_failures").alias("license_failures"),
        c("u.first.license_id").alias("authorizing_license_id"),
    )
    seen = lambda col: c(col) > 0
    blocking = codes((seen("claims_disputed"), "CLAIM_DISPUTED"), (seen("licenses_suspended"), "LICENSE_SUSPENDED"))
    missing = codes(
        (F.size("claim_failures") > 0, "CLAIM_PROJECTION_INTEGRITY_UNVERIFIED"),
        (F.size("license_failures") > 0, "LICENSE_PROJECTION_INTEGRITY_UNVERIFIED"),
        (seen("claims") & ~seen("corroborated"), "NO_CORROBORATED_CLAIM"),
        (~seen("claims"), "NO_RECORDED_CLAIM"),
        (~seen("licenses"), "NO_RECORDED_LICENSE"),
    )
    claim_reasons = codes(
        (seen("claims_disputed"), "CLAIM_DISPUTED"), (seen("claims_not_yet"), "CLAIM_NOT_YET_EFFECTIVE"),
        (seen("claims_ended"), "CLAIM_NO_LONGER_EFFECTIVE"), (seen("claims_revoked"), "CLAIM_REVOKED"),
        (seen("claims_superseded"), "CLAIM_SUPERSEDED"),
    )
    license_reasons = codes(
        (F.size(F.array_remove("weak", "LICENSE_NOT_BOUND_TO_RECORDED_CLAIM")) > 0, "LICENSE_BACKING_CLAIM_NOT_CORROBORATED"),
        (seen("other"), "LICENSE_DOES_NOT_LIST_INTENDED_USE"),
        (seen("licenses_over") | seen("licenses_expired"), "LICENSE_EXPIRED"),
        (seen("licenses_not_yet"), "LICENSE_NOT_YET_EFFECTIVE"),
        (seen("scope"), "LICENSE_PERMITS_INTENDED_USE"),
        (seen("vetoed"), "LICENSE_PROHIBITS_INTENDED_USE"),
        (seen("licenses_revoked"), "LICENSE_REVOKED"),
        (seen("licenses_superseded"), "LICENSE_SUPERSEDED"),
        (seen("licenses_suspended"), "LICENSE_SUSPENDED"),
    )
    return (
        work.withColumn("blocking", blocking)
        .withColumn("missing", missing)
        .withColumn("claim_reasons", F.array_sort(F.concat(claim_reasons, "claim_failures")))
        .withColumn("license_reasons", F.array_sort(F.concat(license_reasons, "license_failures", "weak")))
        .withColumn("authorized", c("strong") > 0)
        .withColumn(
            "derived_path",
            cascade(
                [
                    (c("strong") > 0, "EXISTING_LICENSE"),
                    (F.size("blocking") > 0, "DISPUTED"),
                    (c("licenses") > 0, "EXISTING_LICENSE"),
                ],
                "NO_LICENSE_INFO",
            ),
        )
    )


def replay_rights(events: DataFrame) -> DataFrame:
    """Which recorded claim events were legal, and the version and state each left behind.

    Terminal events (SUPERSEDED, REVOKED) are legal from every other state and end the history; before
    the first of them CORROBORATED and DISPUTED are legal unless they repeat the state. So replay needs
    the first terminal event of a subject and the previous non-terminal event: two mergeable aggregates,
    not a fold over a subject's whole history in one task.
    """
    c = F.col
    terminal = c("event_type").isin("SUPERSEDED", "REVOKED")
    e = events.withColumn("day", F.floor(F.unix_micros("created_at") / DAY_US).cast("bigint"))
    order = [("created_at", True), ("rights_event_id", True)]
    at = F.struct("created_at", "rights_event_id")
    seen = F.struct("created_at", "rights_event_id", "event_type")
    e = running(
        e, ["subject_id"], [("day", True)], order,
        {"__first_end": (F.when(terminal, at), "min"), "__last": (F.when(~terminal, seen), "max")},
        inclusive=False,
    ).withColumn("__before", c("__last.event_type"))
    open_ = c("__first_end").isNull()
    current = F.when(~open_, "TERMINAL").otherwise(F.coalesce(c("__before"), F.lit("ASSERTED")))
    legal = open_ & (c("event_type") != current)
    e = e.withColumn("state_before", current).withColumn("legal", legal)
    e = running(
        e, ["subject_id"], [("day", True)], order, {"__n": (F.col("legal").cast("bigint"), "sum")}
    )
    return e.select(
        "subject_id", "rights_event_id", "event_type", "created_at", "state_before", "legal",
        (F.lit(1) + c("__n")).alias("version"),
        F.when(c("legal") & c("event_type").isin("SUPERSEDED", "REVOKED"), c("created_at")).alias("effective_until"),
    )


def current_rights(replayed: DataFrame) -> DataFrame:
    """State, version and end of each subject after its whole history."""
    last = F.max(F.when(F.col("legal"), F.struct("version", "event_type", "effective_until")))
    return replayed.groupBy("subject_id").agg(
        last.alias("l"), F.count_if(~F.col("legal")).alias("rejected")
    ).select(
        "subject_id",
        F.coalesce("l.event_type", F.lit("ASSERTED")).alias("state"),
        F.coalesce("l.version", F.lit(1).cast("bigint")).alias("version"),
        F.col("l.effective_until").alias("effective_until"),
        "rejected",
    )


def supersession(rows: DataFrame) -> DataFrame:
    """Audit of replacement links: present exactly when superseded, not to itself, to a row of the same
    tenant and work. ``rows(id, tenant_id, work_id, state, superseded_by_id)``."""
    target = rows.select(
        F.col("id").alias("superseded_by_id"), F.col("tenant_id").alias("__t"), F.col("work_id").alias("__w"), F.lit(True).alias("__found")
    )
    c = F.col
    linked = c("superseded_by_id").isNotNull()
    verdict = cascade(
        [
            ((c("state") == "SUPERSEDED") & ~linked, "SUPERSEDED_WITHOUT_TARGET"),
            ((c("state") != "SUPERSEDED") & linked, "TARGET_WITHOUT_SUPERSEDED"),
            (c("superseded_by_id") == c("id"), "SUPERSEDES_ITSELF"),
            (linked & c("__found").isNull(), "TARGET_MISSING"),
            (linked & ((c("__t") != c("tenant_id")) | (c("__w") != c("work_id"))), "TARGET_OF_OTHER_TENANT_OR_WORK"),
        ],
        "OK",
    )
    return rows.join(target, "superseded_by_id", "left").withColumn("verdict", verdict).drop("__t", "__w", "__found")


def current_records(rows: DataFrame) -> DataFrame:
    """Where each record's chain of replacements ends: ``id, current_id, resolution, steps``.

    Takes the rows of ``supersession``. Only sound links are followed. ``CURRENT`` records are their own, ``RESOLVED`` ones
    end at ``current_id`` after ``steps`` replacements; a chain that meets a link the audit refuses is ``BROKEN`` and one that comes
    back to itself ``CYCLE``, both without a current record. Pointers are doubled: each round follows all open chains
    twice as far by one join, so a chain of n links takes log2(n) rounds, and a record that replaced very many is spread over
    salts. A round that ends no chain shows that only cycles are left. Every round is a written table.
    """
    c = F.col
    sound = c("verdict") == "OK"
    linked = sound & c("superseded_by_id").isNotNull()
    state = F.when(linked, "OPEN").when(sound, "CURRENT").otherwise("BROKEN")
    links = supersession(rows).select(
        "id", F.when(linked, c("superseded_by_id")).otherwise(c("id")).alias("at"), state.alias("ends"),
        F.when(linked, 1).otherwise(0).cast("bigint").alias("steps"),
    )
    table = stored(links, "links")
    open_ = table.where("ends = 'OPEN'").count()
    while open_:
        ahead = table.select(c("id").alias("at"), c("at").alias("next"), c("ends").alias("next_ends"), c("steps").alias("more"))
        moved = join_unique(table.where("ends = 'OPEN'"), ahead, "at", "id").select(
            "id", c("next").alias("at"), c("next_ends").alias("ends"), (c("steps") + c("more")).alias("steps")
        )
        table = stored(table.where("ends <> 'OPEN'").unionByName(moved), "links")
        left = table.where("ends = 'OPEN'").count()
        if left == open_:
            break
        open_ = left
    ended = c("ends")
    resolution = cascade([((ended == "CURRENT") & (c("steps") == 0), "CURRENT"), (ended == "CURRENT", "RESOLVED"), (ended == "OPEN", "CYCLE")], "BROKEN")
    return table.select(
        "id", F.when(ended == "CURRENT", c("at")).alias("current_id"), resolution.alias("resolution"),
        F.when(ended == "CURRENT", c("steps")).alias("steps"),
    )
