"""Periodic runs, graph search and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidlake.llm import graph_search, periodic, queries, spelling
from tests.llm.test_llm import frame, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- 13 periodic runs ---------------------------------------------------------------------------------------------
def slow_runs(words):
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                part = words[i : j + q]
                if q == min(p for p in range(1, q + 1) if part[p:] == part[:-p]):
                    found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_digest(i, text, planted):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(i).encode()) if i is not None else None
    if planted and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = slow_runs(words)
    gone = {k for s, l, q in runs for k in range(s + q, s + l)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        i, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{l},{q}\n" for s, l, q in runs)),
        sha(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


def repeating_rows():
    rng = random.Random(3)
    out = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            base = [rng.choice("abé日") * rng.randrange(1, 3) for _ in range(rng.choice([1, 2, 3, 7, 15, 16, 17, 40, 130]))]
            words += (base * 9)[: rng.randrange(7 * len(base))]
        out.append((100 + i, rng.choice([" ", "\n", " \t"]).join(words), "a"))
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_periodic_runs(spark, clash):
    rows = odd_rows() + repeating_rows()
    docs = frame(spark, rows, clash)
    for planted in (False, True):
        found = periodic.digest(periodic.collapse(periodic.with_planted_runs(docs) if planted else docs))
        assert sorted(map(tuple, found.collect()), key=str) == sorted((slow_digest(i, t, planted) for i, t, _ in rows), key=str)
    assert any(slow_digest(i, t, True) != slow_digest(i, t, False) for i, t, _ in rows)
    assert periodic.collapse(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), min_size=1, max_size=4), st.integers(1, 3))
def test_run_table(docs, times):
    docs = [d * times for d in docs]
    bounds = np.cumsum([0, *map(len, docs)])
    words = np.array([w + 10 * k for k, d in enumerate(docs) for w in d], np.int64)
    want = [(s + int(b), s + int(b) + l, q) for d, b in zip(docs, bounds, strict=False) for s, l, q in slow_runs(d)]
    assert [tuple(map(int, r)) for r in periodic.run_table(words, bounds)] == want


@pytest.mark.parametrize("scale", [16, 64, 512])
def test_convolution_finds_exact_occurrences(scale):
    rng = np.random.default_rng(scale)
    blocks, windows = rng.integers(0, 65536, (scale, 6)), rng.integers(-65536, 65536, (2 * scale, 6))
    windows[3 : 3 + scale, 2] = blocks[:, 2]
    got = periodic.occurrences(blocks, windows)
    want = np.array([((blocks - windows[o : o + scale]) ** 2).sum(axis=0) % 65537 == 0 for o in range(scale)])
    assert (got == want).all() and got[3, 2]


@pytest.mark.parametrize("longest", [1 << 15, 64])
def test_long_periods(longest, monkeypatch):
    """Periods beyond the longest transform are found by parts of their blocks."""
    monkeypatch.setattr(periodic, "LONGEST", longest)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 500, 3001)
    words = np.concatenate([rng.integers(0, 500, 777), np.tile(base, 5), [999], np.zeros(20000, np.int64)])
    start = 777
    while words[start - 1] == words[start - 1 + 3001]:
        start -= 1
    got = [tuple(map(int, r)) for r in periodic.run_table(words, np.array([0, len(words)]))]
    assert (start, 777 + 5 * 3001, 3001) in got and (777 + 5 * 3001 + 1, len(words), 1) in got
    assert all(e - s >= max(6, 4 * q) for s, e, q in got)


def test_one_very_long_text(spark):
    words = ["w%d" % (k % 20011) for k in range(1_000_000)]
    found = periodic.collapse(frame(spark, [(1, " ".join(words), "a")])).first()
    assert [tuple(r) for r in found.runs] == [(0, 1_000_000, 20011)] and found.text == " ".join(words[:20011])


# -- 12 graph search ----------------------------------------------------------------------------------------------
def slow_nearest(rows, k):
    rows = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = []
    for q in sorted({i for i, _ in rows if i % 100 == 0}):
        own = min(v for i, v in rows if i == q)
        pad = lambda v: np.pad(v, (0, 16 - len(v)))
        near = sorted((float(np.sqrt(((pad(v) - pad(own)) ** 2).sum())), i) for i, v in rows if i != q)[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("x") for c in ("block", "kind", "node", "vector", "ids", "place")}
    )


def test_graph_search_of_odd_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(1, 120)]
    same = [1.0, -2.0, 0.5, 0.0, -0.0, 3.0]
    rows += [(i, same) for i in range(300, 700)] + [(400, same), (400, [x + 1 for x in same])]
    rows += [(100, None), (200, []), (5, [0.0] * 6), (6, [float("nan")] * 6), (7, [1.0, None]), (8, [float("inf")] * 6), (None, same), (900, [1.0, 2.0]), (901, [1.0, 2.0, 0.0])]
    frame_ = vectors(spark, rows)
    want = slow_nearest(rows, 10)
    for components in (1 << 20, 900):  # one shard that is scanned whole, and several
        got = graph_search.nearest(frame_, F.col("vec_id") % 100 == 0, 10, components=components).orderBy("query_id", "rank").collect()
        assert [tuple(r)[:3] for r in got] == [w[:3] for w in want]
        assert np.allclose([r.score for r in got], [w[3] for w in want], rtol=1e-12, atol=0)
    few = vectors(spark, [(100, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 0.5])])
    assert [r.vec_id for r in graph_search.nearest(few, F.col("vec_id") == 100).orderBy("rank").collect()] == [1, 2]
    assert graph_search.nearest(few.limit(0), F.col("vec_id") == 100).count() == 0


@pytest.mark.parametrize("kind", ["sphere", "clusters", "line"])
def test_graph_recall(kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 32))
    if kind == "clusters":
        x = rng.normal(size=(20, 32))[rng.integers(0, 20, 3000)] + 0.05 * x
    if kind == "line":
        x = np.outer(rng.normal(size=3000), np.ones(32)) + 1e-6 * x
    x = rng.permutation(np.unique(x, axis=0))
    graph = graph_search.Graph(x)
    graph.build()
    asked = x[::50]
    met = graph.search((asked * graph.scale).astype(np.float32), 100)
    true = np.argsort(((x[None] - asked[:, None]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(true, met, strict=True)]) >= 9
    assert all(len(set(m[m < graph.n])) == (m < graph.n).sum() for m in met)


def test_every_place_is_reached():
    x = np.random.default_rng(1).normal(size=(400, 8))
    graph = graph_search.Graph(x)
    graph.build()
    graph.near[:, :] = graph.n  # cut all edges
    graph._reach_all()
    assert set(graph.search(graph.x[:1], 400)[0]) == set(range(400))


def test_graph_recall_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op12_graph_neighbours(spark, folder).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    want = set()
    for i, v in rows:
        if i % 100 == 0:
            span = ((x - np.array(v)) ** 2).sum(axis=1)
            near = sorted((s, j) for s, (j, _) in zip(span, rows, strict=True) if j != i)[:10]
            want |= {(i, j) for _, j in near}
    assert len(got) == len(want) and len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)


# -- 11 spelling variants -----------------------------------------------------------------------------------------
def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_variants(counts):
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), form[w] and counts[form[w]]))
    return sorted(out)


def slow_counts(rows):
    n = Counter()
    for i, t, _ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def wordy_rows():
    rng = random.Random(9)
    letters = "abcdeÀéÿß"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 14))) for _ in range(40)]
    stems += ["international" + "".join(rng.choice("xyz") for _ in range(4)) for _ in range(60)]
    out = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            words.append(rng.choice([w, w.upper(), w + str(rng.randrange(9)), w + "×", "日本" + w]))
        out.append((rng.choice([i, i, None]), rng.choice([" ", "-", "ǿ"]).join(words), "a"))
    return out


@pytest.mark.parametrize(("few", "listed"), [(64, 256), (2, 256), (1, 1), (10**6, 4)])
def test_spelling_variants(spark, few, listed, monkeypatch):
    monkeypatch.setattr(spelling, "FEW", few)
    monkeypatch.setattr(spelling, "LISTED", listed)
    rows = odd_rows() + wordy_rows()
    counts = slow_counts(rows)
    want = slow_variants(counts)
    assert sum(w[1] is not None for w in want) > 20
    got = spelling.groups(frame(spark, rows, clash=True))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == want


def test_deep_chains_and_no_words(spark):
    chain = [("aaaaaa" + "b" * k, 5 * 5**k) for k in range(6)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {"aaaaaabbbbb"}
    docs = frame(spark, [(1, None, "a"), (2, "", "a"), (3, "12 345", None)])
    assert spelling.groups(docs).count() == 0 and spelling.groups(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**9), st.text("aZÀÿx 1", max_size=30)), min_size=1, max_size=5))
def test_words_of(docs):
    texts = [t.encode() for _, t in docs]
    offsets = np.cumsum([0, *map(len, texts)])
    words, n = spelling.words_of(np.frombuffer(b"".join(texts), np.uint8), offsets, [i for i, _ in docs])
    want = Counter()
    for i, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    assert dict(zip(words.to_pylist(), n.to_pylist(), strict=True)) == {w: k for w, k in want.items() if len(w) >= 6}
