"""The operators for training data against brute force, on small hand-made and random tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidlake.llm import automaton_dedup, bpe, chat, mixing, packing, simhash, suffix_dedup, tokenfile, topk, toxicity, winnowing
from evidlake.llm.components import components
from evidlake.llm.repeats import covered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use within themselves, as extra columns.
CLASH = {"th": 1, "size": "x", "node": None, "fp": 3, "range": 4, "places": 5, "__n": 6, "block": 7}


def frame(spark, rows, clash=False):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    return docs.withColumns({k: F.lit(v).cast("string") for k, v in CLASH.items()}) if clash else docs


def odd_rows():
    """Nulls, empty and blank texts, repeated rows and texts, shared passages, long runs, a very long text."""
    rng = random.Random(1)
    words = ["ab", "c", "déf", "gh-i", "日本", "x" * 30]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    shared, long = text(70), text(4000)
    return [
        (1, shared, "a"), (2, "start " + shared + " end", "b"), (3, shared, None), (3, shared, None), (4, None, "a"), (5, "", "b"),
        (6, " \n\t ", "a"), (7, "aaaa " * 200, "c"), (8, "aaaa " * 150, "c"), (9, "y" * 500, "a"), (10, "z" + "y" * 300, "b"),
        (11, long, "a"), (12, long[:9000] + text(20) + long[9000:], None), (13, text(60) + " " + shared[:200], "a"), (14, "a b", "b"),
        (14, "a b c d", "b"), (15, text(55), "c"), (16, "<|endoftext|> a<|endoftext|>", "c"), (None, shared, "a"), (None, None, None),
        (20, "\x1c\x85  w" + " " + text(30), "b"), (21, shared[:260] + "Ä" + shared[260:], "a"),
    ]


def repeats(rows, window, cut, join):
    """Digest of each (doc_id, text) without what smaller doc_ids hold; units from ``cut``."""
    first = {}
    for i, t, _ in rows:
        u = cut(t or "")
        for k in range(len(u) - window + 1):
            if i is not None:
                first[u[k : k + window]] = min(first.get(u[k : k + window], i), i)
    out = []
    for i, t, _ in rows:
        u = cut(t or "")
        gone = [False] * len(u)
        for k in range(len(u) - window + 1):
            if i is not None and first[u[k : k + window]] < i:
                gone[k : k + window] = [True] * window
        spans = sum(g and not h for g, h in zip(gone, [False, *gone], strict=False))
        out.append((i, len(u), sum(gone), spans, hashlib.sha256(join([x for x, g in zip(u, gone, strict=True) if not g])).hexdigest()))
    return sorted(out, key=str)


# -- 1 chat -------------------------------------------------------------------------------------------------------
def test_chat_examples(spark):
    odd = "<|im_end|><\\|im_sep|><<|x"
    rows = [(1, 2, "assistant", odd), (1, 1, "user", None), (1, 3, "user", "bye"), (2, 0, "assistant", ""), (None, 0, None, "q"), (3, 1, "us<|er", "a"), (3, 1, "us<|er", "a")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).withColumn("turns", F.lit(2))
    examples = {(r.conv_id, r.n_turns): r for r in chat.prefix_targets(c).collect()}
    assert set(examples) == {(1, 2), (1, 3), (2, 1), (None, 1), (3, 2)}
    r = examples[1, 2]
    masked = r.formatted[r.loss_start : r.loss_start + r.loss_length]
    assert masked.count("<|") == 0 and r.formatted.endswith(masked + chat.CLOSE) and examples[1, 3].loss_length == 0
    back = {r.conv_id: r for r in chat.read_back(chat.prefix_targets(c)).collect()}
    assert back[1].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest() and back[1].loss_chars == len(odd) and back[1].n_turns == 3
    assert back[1].turns_sha256 == hashlib.sha256(f"user\n\nassistant\n{odd}\nuser\nbye\n".encode()).hexdigest()
    assert back[3].turns_sha256 == hashlib.sha256(b"us<|er\na\n" * 2).hexdigest()
    assert chat.prefix_targets(c.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="<|\\im_endsp> \nx", max_size=20), min_size=1, max_size=20))
def test_escape_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e


# -- 2 and 3 repeats ----------------------------------------------------------------------------------------------
def join_words(words):
    return b" ".join(words)


@pytest.mark.parametrize("clash", [False, True])
def test_suffix_dedup(spark, clash):
    rows = odd_rows()
    got = suffix_dedup.dedup(frame(spark, rows, clash)).collect()
    want = repeats(rows, 50, str.encode, lambda kept: bytes(kept))
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == want
    assert suffix_dedup.dedup(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("shard", [48, 1])
def test_automaton_dedup(spark, shard, monkeypatch):
    monkeypatch.setattr(automaton_dedup, "SHARD", shard)
    rows = odd_rows()
    got = automaton_dedup.dedup(frame(spark, rows, shard == 1)).collect()
    want = repeats(rows, 50, lambda t: tuple(t.encode().split()), join_words)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == [w[:3] + w[4:] for w in want]
    assert automaton_dedup.dedup(frame(spark, rows).limit(0)).count() == 0


def test_automaton_statistics():
    rng = random.Random(4)
    for _ in range(200):
        known = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 15))) for _ in range(3)]
        asked = "".join(rng.choice("ab") for _ in range(15))
        a = automaton_dedup.Automaton()
        for k in known:
            a.add(k)
        want = [max(n for n in range(e + 2) if any(asked[e + 1 - n : e + 1] in k for k in known)) for e in range(len(asked))]
        assert a.statistics(asked) == want


def test_split_shards():
    """Many members of one gram: parts by longer grams find what comparing all windows finds."""
    rng = random.Random(2)
    gram = [b"g%d" % i for i in range(16)]
    reach, members = 34, []
    for i in range(150):
        side = lambda: [b"%d" % rng.randrange(2) if rng.random() < 0.04 else b"s" for _ in range(rng.choice([0, 20, 34]))]
        left, right = side(), side()
        if len(left) + len(right) + 16 >= 50:
            members.append((rng.randrange(60), tuple(left + gram + right), reach - len(left), [i]))
    first = {}
    for doc, words, _, _ in members:
        for k in range(len(words) - 49):
            key = words[k : k + 50]
            first[key] = min(first.get(key, doc), doc)
    want = {(row, at + k) for doc, words, at, (row,) in members for k in range(len(words) - 49) if first[words[k : k + 50]] < doc}
    for shard in (1, 5, 1000):
        automaton_dedup.SHARD = shard
        got = {(row, w) for row, lo, hi in automaton_dedup.search(members, reach, 16) for w in range(lo, hi + 1)}
        assert got == want
    automaton_dedup.SHARD = 48


def test_refinement():
    rng = np.random.default_rng(0)
    around = rng.integers(97, 99, (40, 84)).astype(np.uint8)
    around[20:] = around[:20]
    around[20:, 60] ^= 1
    bucket = np.stack(list(suffix_dedup.window_buckets(around)), axis=1)
    assert bucket.shape == (40, 35)
    for o in range(35):
        same = {}
        for r in range(40):
            same.setdefault(around[r, o : o + 50].tobytes(), set()).add(int(bucket[r, o]))
        assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_covered():
    lo, hi = covered(np.array([10, 12, 0, 0, 60, 61]), 50)
    assert lo.tolist() == [0, 60] or (lo.tolist(), hi.tolist()) == ([0], [111])


# -- 4 winnowing --------------------------------------------------------------------------------------------------
def test_winnowing(spark):
    rows = odd_rows()
    docs = frame(spark, rows, True)
    got = winnowing.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True):
        q = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()))
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == sorted(want, key=str)
    by_text = {}
    for r in winnowing.fingerprints(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert by_text.setdefault((r.doc_id, len(r.fingerprint)), r.fingerprint) is not None
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert winnowing.edited_fingerprints(docs.limit(0)).count() == 0
    one = winnowing.edited_fingerprints(frame(spark, [(5, "one two three four", "a")])).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_winnowing_selects_rightmost_minima(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice("abc") for _ in range(80))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    keys = df.select(winnowing.gram_keys(winnowing.units(F.col("text"))).alias("k")).first().k
    hashes = [k >> winnowing.PLACES for k in keys]
    want = set()
    for i in range(len(hashes) - winnowing.WINDOW + 1):
        some = hashes[i : i + winnowing.WINDOW]
        at = max(j for j, h in enumerate(some) if h == min(some))
        want.add((min(some), i + at))
    got = {(x.hash, x.position) for x in winnowing.fingerprints(df).first().fingerprint}
    assert got == want and len(set(hashes)) < len(hashes)


# -- 5 and 10 tokens ----------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.standard_path())
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab 'stmdrevl.\n\t1"), st.characters(exclude_categories=["Cs"])), max_size=25), min_size=1, max_size=6))
def test_encoder(ids, texts):
    raw = [t.encode() for t in texts]
    found, count = bpe.encoder(bpe.standard_path()).encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    assert [p.tolist() for p in np.split(found, np.cumsum(count)[:-1])] == [ids(t) for t in texts]


def test_encoder_forgets(ids, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 40)
    own = bpe.Encoder(bpe.standard_path())
    for k in range(6):
        text = " ".join(f"w{k}{i}" for i in range(15))
        assert own.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0].tolist() == ids(text)
        assert own.n <= 60


def test_token_files(spark, ids):
    rows = odd_rows()
    got = tokenfile.digest(frame(spark, rows, True)).collect()
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, start = [], 0
    for i, t in order:
        own = [*ids(t), 0]
        want.append((i, start, len(own), crc(own)))
        start += len(own)
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    assert tokenfile.digest(frame(spark, rows).limit(0)).count() == 0


def test_packing(spark, ids):
    rows = odd_rows()
    got = packing.pack(frame(spark, rows, True)).collect()
    tokens = {}
    for i, t, _ in rows:
        tokens.setdefault(i, []).append([*ids(t or ""), 1])
    assert sum(r.length for r in got) == sum(len(t) for own in tokens.values() for t in own)
    for r in got:
        assert any(r.doc_tokens == len(t) and crc(t[r.start : r.start + r.length]) == r.ids_crc32 for t in tokens[r.doc_id])
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(frame(spark, rows).limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=6), st.integers(0, 40))
def test_fill_is_the_best_subset(left, room):
    sums = {0}
    for length, n in left.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    taken = packing.fill(left, room)
    assert sum(k * n for k, n in taken.items()) == max(sums) and all(n <= left[k] for k, n in taken.items())


def test_patterns_use_every_piece_once():
    rng = random.Random(5)
    lengths = {n: rng.randrange(1, 60) for n in range(1, 2048)}
    found, used = packing.patterns(lengths), {}
    for p in found:
        assert p.total <= 2048
        for length, n in p.counts:
            used[length] = used.get(length, 0) + n * p.times
    total, room = sum(k * n for k, n in lengths.items()), 2048 * sum(p.times for p in found)
    bound = sum(n.bit_length() for n in lengths.values())
    assert used == lengths and len(found) <= bound and room - total < 0.01 * total


# -- 6 simhash ----------------------------------------------------------------------------------------------------
def slow_simhash(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = low
    return label


def test_simhash_groups(spark):
    rows = odd_rows()
    got = simhash.groups(frame(spark, rows, True)).collect()
    fps = [(i, slow_simhash(t or "")) for i, t, _ in rows]
    assert sorted([(r.doc_id, r.fp % 2**64) for r in got], key=str) == sorted(fps, key=str)
    known = [(i, f) for i, f in fps if i is not None]
    label = classes({i for i, _ in known}, [(a, b) for a, f in known for b, g in known if (f ^ g).bit_count() <= 3])
    assert all(r.component_id == (None if r.doc_id is None else label[r.doc_id]) for r in got)
    kept = simhash.near_dedup(frame(spark, rows, True)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(label.values()))
    assert sum(r.doc_id is None for r in kept) == 2 and set(kept[0].asDict()) == {*frame(spark, rows).columns, *CLASH}
    assert simhash.groups(frame(spark, rows).limit(0)).count() == 0


def test_trie_links_every_near_pair(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    values = [int(b) for b in base] + [0, (1 << 64) - 1]
    for b in base:
        v = int(b)
        for _ in range(6):
            v ^= 1 << int(rng.integers(64))
            v ^= 1 << int(rng.integers(64))
            values.append(v)
    values = sorted(set(values))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)], "fp long, node long")
    found = {r.node: r.component for r in components(simhash.links(df)).collect()}
    want = classes(range(len(values)), [(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= 3])
    assert {i: found.get(i, i) for i in range(len(values))} == want and len(set(want.values())) < len(values)


def test_components(spark):
    rng = random.Random(8)
    linked = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 60)]
    df = spark.createDataFrame(linked, "u long, v long")
    want = classes({n for e in linked for n in e if e[0] != e[1]}, linked)
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


# -- 7 toxicity ---------------------------------------------------------------------------------------------------
def test_gradients():
    """By finite differences."""
    rng = np.random.default_rng(1)
    rows = [b"good word here bad", b"bad idiot", b"x" * 3]
    net = toxicity.train([b"good word here", b"bad idiot word"] * 12, np.array([0, 1] * 12))
    net.p = {k: (v + rng.standard_normal(v.shape) * 0.1).astype(np.float64) for k, v in net.p.items()}
    words = toxicity.Words(np.frombuffer(b"".join(rows), np.uint8), np.append(0, np.cumsum([len(r) for r in rows])))
    first, row = words.windows()
    y, weight = np.array([0.0, 1.0, 1.0])[row], np.ones(len(row))

    def loss():
        z = net.window_logits(words)[0].astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    grads = net.gradients(words, net.word_numbers(words), first, row, y, weight)
    for name, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept = net.p[name][at]
        net.p[name][at] = kept + 1e-2
        up = loss()
        net.p[name][at] = kept - 1e-2
        down = loss()
        net.p[name][at] = kept
        assert math.isclose((up - down) / 2e-2, g[at], rel_tol=0.05, abs_tol=2e-3), name


def test_every_word_is_in_a_window():
    for n in (1, 31, 32, 33, 48, 49, 200):
        text = b" ".join(b"w" for _ in range(n))
        words = toxicity.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        first, row = words.windows()
        at = words.places(first, row)
        assert set(at[at >= 0].tolist()) == set(range(n)) and (np.diff(first) == toxicity.STRIDE).all()


def test_toxicity(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        own = [rng.choice(words) for _ in range(rng.choice([5, 40, 200]))]
        if bad := i % 4 == 0:
            own[rng.randrange(len(own))] = "zork" + rng.choice(["", "ab", "cd"])
        rows.append((i, " ".join(own), "a"))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, "a"), (901, "", "a"), (902, "!!!", None), (None, "w1", "a"), (0, rows[0][1], "a")]
    docs = frame(spark, rows, True)
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (7000, 1, 1), (8, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.judged(docs, known).collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in tested) >= 0.95 * len(tested)
    assert all(r.score < 0.5 for r in got if r.doc_id in (900, 901, 902)) and {r.doc_id for r in got if r.doc_id == 0} == {0}
    left = toxicity.without_toxic(docs, known)
    assert left.columns == docs.columns and left.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.judged(docs.limit(0), known.limit(0)).count() == 0


# -- 8 mixing -----------------------------------------------------------------------------------------------------
def filled(sizes, weights, share, cap):
    """Targets by dealing the excess of capped sources again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark):
    rng = random.Random(11)
    rows = [(i, " ".join("w" * rng.randrange(1, 60)), rng.choice(["a", "b", "ä", "z", None, "B"])) for i in range(900)]
    rows += [(5000, None, "a"), (5001, "", "empty"), (None, "one two", "a"), (None, None, None), (7, "again and again", rows[7][2])]
    docs = frame(spark, rows, True)
    got = mixing.mix(docs).collect()
    sizes, words = {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
        words[i, s] = words.get((i, s), 0) + len((t or "").split())
    want = filled(sizes, (5, 2, 1), 1.5, 2)
    assert {(r.doc_id, r.source): r.size for r in got} == words
    assert all(math.isclose(r.target, want[r.source], abs_tol=1e-6) and r.source_size == sizes[r.source] for r in got)
    assert all(r.taken == r.copies * r.size <= 2 * r.size for r in got)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    copies = {(r.doc_id, r.source): r.copies for r in got}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(copies[i, s] for i, _, s in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_is_fair(spark):
    """Documents of every size come as often as they are due, and fractions are really drawn."""
    docs = frame(spark, [(i, "w " * (1 + i % 4), "b" if i % 5 else "a") for i in range(3000)])
    got = [r for r in mixing.mix(docs, weights=(1, 9), share=0.7, fan_in=16).collect()]
    for source in "ab":
        due = {r.target / r.source_size for r in got if r.source == source}
        for size in range(1, 5):
            own = [r.copies for r in got if r.source == source and r.size == size]
            assert abs(sum(own) / len(own) - max(due)) < 0.12 and len(set(own)) <= 2


# -- 9 top k ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [7, 8192])
def test_top_k(spark, block):
    rng = random.Random(13)
    rows = [(i, [rng.randrange(-3, 4) for _ in range(5)]) for i in range(200)] + [(200, [1, 2]), (201, []), (300, [0] * 5), (201, []), (203, None), (204, [1, None]), (None, [1])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("block", F.lit("x")).withColumn("score", F.lit(1))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 10, block).collect()
    good = [(i, v) for i, v in rows if i is not None and v is not None and None not in v]
    want = []
    for q, v in {i: v for i, v in good if i % 20 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 10, block).count() == 0


def test_scaled(spark):
    df = spark.createDataFrame([([0.5, -0.0001],), ([float("nan")],), ([float("inf")],), ([None],), (None,)], "e array<float>")
    assert [r.w for r in df.select(topk.whole(F.col("e")).alias("w")).collect()] == [True, False, False, False, False]
    assert df.select(topk.scaled(F.col("e")).alias("v")).first().v == [512, -1]


# -- pipeline -----------------------------------------------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = stage(spark, docs, folder)
        docs = found[name]
        if name != "packing":
            assert docs.columns == found[""].columns
    texts = {n: sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect()) for n, d in found.items() if n != "packing"}
    assert set(texts["toxicity"]) < set(texts[""]) and set(texts["near_duplicates"]) <= set(texts["toxicity"])
    # The stage links five-word shingles with a Jaccard similarity of 0.8 or more; one document of each group stays.
    from tests.llm.test_near import slow_groups

    label = slow_groups([(i, t, None) for i, t in texts["toxicity"]])
    assert [i for i, _ in texts["near_duplicates"]] == sorted(set(label.values()))
    want = repeats([(i, t, None) for i, t in texts["near_duplicates"]], 50, lambda t: tuple(t.encode().split()), join_words)
    left = {i: hashlib.sha256(" ".join(t.split()).encode()).hexdigest() for i, t in texts["repeated_passages"]}
    assert left == {i: h for i, n, gone, _, h in want if gone < n or n == 0}
    counts = {}
    for i, _ in texts["source_mix"]:
        counts[i] = counts.get(i, 0) + 1
    assert set(counts) <= set(left) and max(counts.values()) <= 2
    assert corpus_pipeline.run(spark, folder).count() >= len(texts["source_mix"])
