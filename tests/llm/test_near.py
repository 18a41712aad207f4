"""Near copies against all pairs by their whole texts."""

import random

import corpus_pipeline
import numpy as np

from evidlake.llm import near
from tests.llm.test_llm import classes, frame, odd_rows


def slow_groups(rows):
    sets = []
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}))
    close = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    linked = [(i, j) for i, a in sets for j, b in sets if i is not None and j is not None and i < j and close(a, b)]
    return classes({i for i, _ in sets if i is not None}, linked)


def edited(rng):
    """Copies of 60 texts with 0 to 6 of 200 words changed (similarities from 0.7 up), a chain, and a hot passage."""
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out, passage = [], text(60)
    for _ in range(60):
        base = text(200)
        for edits in (0, 1, 2, 3, 4, 6):
            own = list(base)
            for k in rng.sample(range(200), edits):
                own[k] = f"n{rng.randrange(10**6)}"
            out.append(own)
    chain = text(150)
    for _ in range(30):
        chain = [*chain[6:], *text(6)]
        out.append(chain)
    out += [passage + text(30) for _ in range(40)]
    rng.shuffle(out)
    return [(i + 100, " ".join(w), "a") for i, w in enumerate(out)]


def test_near_copies_are_all_found(spark):
    rows = odd_rows() + edited(random.Random(3))
    rows = [r for r in rows if r[0] not in (3, 14)]  # repeated doc_ids: below
    want = slow_groups(rows)
    assert {r.doc_id: r.component_id for r in near.groups(frame(spark, rows, True)).collect()} == want
    kept = sorted(r.doc_id for r in near.near_dedup(frame(spark, rows, True)).collect() if r.doc_id is not None)
    assert kept == sorted(set(want.values()))
    assert near.groups(frame(spark, rows).limit(0)).count() == 0


def test_repeated_ids_are_one_node(spark):
    rows = [(2, "a b c d e f", "a"), (2, "g h i j k l", "a"), (3, "G H i j k l", "b"), (1, "a b c d e f", "c"), (None, "a b", "a")]
    assert {r.doc_id: r.component_id for r in near.groups(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 1}
    assert sorted(r.doc_id or 0 for r in near.near_dedup(frame(spark, rows)).collect()) == [0, 1]


def test_stage_finds_lightly_edited_copies(spark, monkeypatch):
    rng = random.Random(4)
    rows = edited(rng)
    monkeypatch.setattr(corpus_pipeline, "ship_package", lambda spark: None)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()}
    assert kept == set(slow_groups(rows).values())


def test_candidates_pass_refuted_heads():
    sketch = np.zeros((4, near.HASHES), np.uint8)
    sid = np.arange(4)
    apart = {(1, 0), (2, 0), (3, 0)}
    assert near.candidates(sid, sid, sketch, set()) == [(1, 0), (2, 0), (3, 0)]
    assert near.candidates(sid, sid, sketch, apart) == [(2, 1), (3, 1)]
    assert near.candidates(sid, np.array([0, 1, 1, 1]), sketch, apart) == []
    assert near.candidates(sid, np.array([0, 1, 1, 3]), sketch, apart | {(3, 1)}) == [(3, 2)]


def test_tries_link_first(spark):
    """The stage's first pairs are those of the SimHash tries: they connect all fingerprints within three bits, and no others."""
    rows = edited(random.Random(6))
    own = near.nodes(frame(spark, rows)).cache()
    fps = {r.sid: r.fp for r in own.collect()}
    close = [(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 3]
    pairs = [(r.u, r.v) for r in near.by_tries(own).collect()]
    assert len(close) > 20 and all(u > v for u, v in pairs)
    assert classes(set(fps), pairs) == classes(set(fps), close)
    # The exact check follows: what the tries link wrongly isn't in a group, what they miss is.
    judged = {(r.u, r.v) for r in near.links(frame(spark, rows), own).collect()}
    label = classes(set(fps), judged)
    names = {r.doc_id: label[r.sid] for r in own.collect()}
    want = slow_groups(rows)
    assert all((names[a] == names[b]) == (want[a] == want[b]) for a in want for b in want)


def test_few_pairs_of_a_bucket():
    sketch, sid = np.zeros((4, near.HASHES), np.uint8), np.arange(4)
    assert near.few_pairs(sid, np.array([0, 0, 2, 2]), sketch, {(2, 0)}) == [(2, 1), (3, 0), (3, 1)]
    many = 2 * near.AT_ONCE + 3
    assert near.few_pairs(np.arange(many), np.arange(many), np.zeros((many, near.HASHES), np.uint8), set()) is None


def test_a_large_group_gives_few_pairs():
    """Edits of one text that are near to it, but mostly not to each other: a row links each to it, and no more are looked at."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(base)]
    for n in rng.integers(5, 30, 150):
        own = base.copy()
        own[rng.choice(200, n, replace=False)] = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets.append(np.unique(own))
    sets = [sets[k] for k in rng.permutation(len(sets))]
    like = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    close = {(i, j) for i in range(len(sets)) for j in range(i) if like(sets[i], sets[j]) >= 0.8}
    shorts = near.Shorts([s.astype(np.uint16).tobytes() for s in sets])
    sketch = np.stack([near.minima(s).astype(np.uint8) for s in sets])
    order, every = shorts.central(), np.arange(len(sets))
    assert like(sets[order[0]], base) > 0.97
    assert all(shorts.may(i, every)[j] for i, j in close)
    few = near.few_pairs(every, every, sketch, set(), shorts)
    assert few is None or close <= set(few)
    placed = near.Shorts([sets[k].astype(np.uint16).tobytes() for k in order])
    apart, linked = set(), []
    while True:  # what the whole sets refute is known when the rows meet again
        label = classes(set(every.tolist()), linked)
        found = near.forest(order, np.array([label[k] for k in order]), sketch[order], apart, placed)
        assert len(found) + len(linked) < len(sets) < len(close) / 10
        linked += [p for p in found if p in close]
        if not (wrong := set(found) - close):
            break
        apart |= wrong
    assert len(apart) < 20 and classes(set(every.tolist()), linked) == classes(set(every.tolist()), close)


def test_buckets_are_done_in_one_round(spark, monkeypatch):
    """Long texts just below 0.8: their shingles' lowest 16 bits would say near, and each pair refuted is another round of jobs."""
    rng = random.Random(8)
    rows = []
    for _ in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
        for k in range(8):
            own = list(base)
            for at in range(5 * k, 3000, 85):  # 35 edits of 5 shingles each, at other places: 0.79 to each other
                own[at] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own), "a"))
    again, rounds = [], []

    def noted(df, name, to=near.written, **options):
        out = to(df, name, **options)
        if name == "near-again":
            again.append(out.count())
        rounds.append(name)
        return out

    monkeypatch.setattr(near, "written", noted)
    assert {r.doc_id: r.component_id for r in near.groups(frame(spark, rows)).collect()} == slow_groups(rows)
    assert not any(again) and rounds.count("near-found") <= 2 * -(-near.BANDS // near.STEP)


def test_lows_are_exact_in_any_order():
    """Of sets of one bucket, some without their bits: may is the Jaccard similarity, always true of those."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = []
    for n in (0, 300, 330, 340, 360, 2900, 10):
        own = base.copy()
        own[rng.choice(3000, n, replace=False)] = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets.append(np.unique(own))
    low = [s.astype(np.uint32).tobytes() for s in sets]
    low[5] = low[6] = b""
    lows = near.Lows(low)
    order = lows.central()
    lows.take(order)
    for k, i in enumerate(order):
        for m, j in enumerate(order):
            both = len(np.intersect1d(sets[i], sets[j]))
            want = 9 * both >= 4 * (len(sets[i]) + len(sets[j])) or not low[i] or not low[j]
            assert lows.may(k, np.array([m]))[0] == want
    none = near.Lows([b"", b""])
    none.take(none.central())
    assert none.may(0, np.arange(2)).all()
