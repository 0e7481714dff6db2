"""Filter audit, lexical search and embedding pairs against brute force and odd tables."""

import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import embedding_pairs, filter_audit, lexical_search

DOCS = "doc_id long, text string, source string"
LONG = "word" + " lorem ipsum DOLOR sit amet" * 8000
PROSE = " ".join(f"w{k}" for k in range(60))
ODD = [(1, None, "a"), (2, "", None), (3, LONG, "b"), (None, PROSE, "a"), (4, PROSE, "a"), (4, PROSE, "a"), (9, PROSE, "b"), (7, PROSE, "b"), (5, " \n\t ", ""), (6, "é" * 50 + " SHOUT $ \0 tail", "c"), (8, "", "c")]
CLASHES = ("n", "key", "part", "mask", "lo", "state", "terms", "rank", "score", "v", "node", "a.b")


def odd_columns(df):
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df


# --- 11 ----------------------------------------------------------------------------


def audited(rows, labels):
    """The audit of rows (doc_id, text, part) by walking every order over every document."""
    fails = []
    for doc_id, text, part in rows:
        x = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        smaller = any(d is not None and doc_id is not None and d < doc_id and (t or "") == x for d, t, _ in rows)
        fails.append((part or "", {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", x)) > 5 * len(x), "D": bool(re.search(r"[#$%&*|]", x)), "E": smaller}, [any(v[k] == 1 for d, *v in labels if d == doc_id and doc_id is not None) for k in (0, 1)]))
    out = {}
    for part in {p for p, *_ in fails}:
        own, totals = [(f, y) for p, f, y in fails if p == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for i, k in enumerate(order):
                gone = [x for x in alive if x[0][k]]
                alive = [x for x in alive if not x[0][k]]
                totals[k] += len(gone)
                out[part, order, i + 1] = [len(alive), len(gone), sum(f[k] for f, _ in own) - len(gone), sum(f[k] and sum(f.values()) == 1 for f, _ in own), sum(y[0] for _, y in gone), sum(y[1] for _, y in gone), k]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = totals[key[1][key[2] - 1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_a_walk_of_every_order(spark):
    labels = [(4, 1, 0), (4, 0, 1), (9, 1, None), (3, 0, 1), (6, None, 1), (None, 1, 1), (99, 1, 1)]
    rows = [*ODD, *[(20 + k, f"{PROSE} {'A B C D ' * (k % 3)}{'$' * (k % 2)}{'same ' * (30 * (k % 5 == 0))}", "d") for k in range(30)]]
    df, told = odd_columns(spark.createDataFrame(rows, DOCS)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in filter_audit.audit(df, told).collect()}
    assert got == audited(rows, labels)


def test_audit_of_nothing_and_without_labels(spark):
    none, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, no_labels).count() == 0
    got = filter_audit.audit(spark.createDataFrame([(1, "a", "s")], DOCS), no_labels)
    assert got.count() == 600 and got.where("good_lost + toxic_lost > 0").count() == 0


def test_paths_through_the_lattice_are_counted():
    forward, backward = filter_audit.path_counts()
    for s in range(32):
        k = s.bit_count()
        assert (forward[s], backward[s]) == (math.factorial(k), math.factorial(5 - k))
    assert len(filter_audit.edges()) == 80 and all(sum(w for _, f, w in filter_audit.edges() if f == k) == 120 for k in range(5))


# --- 12 ----------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found(rows, items):
    words = lambda x: TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), x or ""))
    docs = [(d, Counter(words(t))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, total, df = len(docs), sum(x[2] for x in docs), Counter(t for _, c, _ in docs for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(words(t))
    out = []
    for i, c in wanted.items():
        scores = []
        for d, have, size in docs:
            m = 25 + (75 * size * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * have[t]) // (1000 * have[t] + 8 * m)) for t, q in c.items() if have[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:10])]
    return sorted(out, key=str)


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    names = np.array([f"t{k}" for k in range(400)] + ["É", "naïve", "x-y", "Zz9"])
    weights = 1 / np.arange(1, len(names) + 1)
    say = lambda size: " ".join(rng.choice(names, size, p=weights / weights.sum()))
    rows = [(k, say(int(rng.integers(1, 60)))) for k in range(n)]
    return [*rows, *[(n + k, rows[k][1]) for k in range(40)]], [(k, say(int(rng.integers(1, 25)))) for k in range(30)]


@pytest.mark.parametrize(("block", "long"), [(32_768, 1 / 16), (50, 1 / 16), (64, 0.0), (64, 1.0)])
def test_search_equals_scoring_every_document(spark, monkeypatch, block, long):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "LONG", long)
    rows, items = corpus(700)
    got = lexical_search._search(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), sorted({i: Counter(lexical_search.terms(t.encode())) for i, t in items}.items()))
    assert sorted(map(tuple, got.collect()), key=str) == found(rows, items)


def test_search_of_odd_tables_and_in_several_passes(spark, monkeypatch):
    rows = [(d, t) for d, t, _ in ODD]
    items = [(1, "W1 w2, LOREM"), (2, None), (3, ""), (4, "nowhere"), (5, "w1"), (5, "w1 tail"), (None, "w3"), (6, LONG)]
    df, bench = odd_columns(spark.createDataFrame(rows, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string")
    for chars in (8_000_000, 50_000):
        monkeypatch.setattr(lexical_search, "ITEM_CHARS", chars)
        assert sorted(map(tuple, lexical_search.search(df, bench).collect()), key=str) == found(rows, items)
    assert lexical_search.search(df.limit(0), bench).count() == 0 and lexical_search.search(df, bench.limit(0)).count() == 0


def test_long_lists_are_skipped_to_what_can_win():
    """A block of one rare and one frequent term: documents without the rare one are not proposed."""
    n = 1000
    ks = np.concatenate([[1, 2] if d < 20 else [2] for d in range(n)])
    sizes = np.array([2 if d < 20 else 1 for d in range(n)])
    block = lexical_search.Block(np.arange(n), np.full(n, 10), sizes, ks, np.ones(len(ks), np.int64), np.array([0, 6000, 1]), n, 10 * n)
    docs, scores = block.rank({1: 1, 2: 1}, 1)
    assert set(docs) == set(range(20)) and len(set(scores)) == 1
    docs, _ = block.rank({1: 1, 2: 1}, int(scores[0]) + 1)
    assert not len(docs)


# --- 13 ----------------------------------------------------------------------------


def linked(x):
    """(links, smallest row reachable) of every row of x, by all cosines."""
    n = len(x)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    a, b = np.nonzero((u @ u.T >= 0.9) & (np.abs(x).sum(1) > 0)[:, None] & ~np.eye(n, dtype=bool))
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        if (new == root).all():
            return np.bincount(a, minlength=n), root
        root = new


def around(rng, centre, cosine):
    c = centre / np.linalg.norm(centre)
    g = rng.normal(size=len(c))
    g -= g @ c * c
    return cosine * c + np.sqrt(1 - cosine**2) * g / np.linalg.norm(g)


def test_index_finds_nearly_all_links_and_none_below(spark):
    rng = np.random.default_rng(13)
    base = rng.normal(size=(500, 32))
    x = np.array([v for b in base for v in [b, *[around(rng, b, rng.uniform(0.85, 0.99)) * rng.uniform(0.1, 9) for _ in range(rng.integers(0, 4))]]])
    want, root = linked(x)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embedding_pairs.near_duplicates(odd_columns(df)).orderBy("vec_id").collect()
    n, comp = np.array([r["n_links"] for r in got]), np.array([r["component_id"] for r in got])
    assert (n <= want).all() and n.sum() >= 0.98 * want.sum() and (comp == root).mean() >= 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_tight_and_hot_groups_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(embedding_pairs, "CHUNK", 32)
    rng = np.random.default_rng(3)
    hot, near, far = rng.normal(size=(3, 24))
    x = np.array([*[around(rng, hot, 0.985) for _ in range(300)], *[around(rng, hot, 0.93) for _ in range(60)], *[near] * 200, *[around(rng, near, 0.96) for _ in range(100)], *[around(rng, far, 0.91) for _ in range(90)], *rng.normal(size=(150, 24))])
    x = x[rng.permutation(len(x))]
    want, root = linked(x)
    got = embedding_pairs.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)).orderBy("vec_id").collect()
    n = np.array([r["n_links"] for r in got])
    assert (n <= want).all() and n.sum() >= 0.99 * want.sum() and [r["component_id"] for r in got] == root.tolist()


def test_odd_vectors_link_with_nothing(spark):
    a, nan, inf = [1.0, 0.0, 0.0], float("nan"), float("inf")
    rows = [(1, a), (2, a), (2, [2.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 0.0, 0.0]), (None, a), (9, [1.0]), (10, [0.0, 1e300, 0.0]), (11, [0.0, 1e-300, 0.0]), (12, [0.0, -1.0, 0.0])]
    for kind in ("double", "float"):
        got = sorted((tuple(r) for r in embedding_pairs.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()), key=str)
        pair = [(10, 1, 10, True), (11, 1, 10, False)] if kind == "double" else [(10, 0, 10, True), (11, 0, 11, True)]
        want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), *[(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8)], (None, 0, None, True), (9, 3, 1, False), *pair, (12, 0, 12, True)]
        assert got == sorted(want, key=str)
    assert embedding_pairs.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_a_forest_connects_what_the_edges_connect():
    rng = np.random.default_rng(7)
    for _ in range(20):
        u, v = rng.integers(0, 60, (2, 40))
        root = {k: k for k in range(60)}

        def top(k, root=root):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in zip(u, v, strict=True):
            root[max(top(a), top(b))] = min(top(a), top(b))
        node, to = embedding_pairs.forest(u, v)
        assert dict(zip(node.tolist(), to.tolist(), strict=True)) == {int(k): top(k) for k in set(u) | set(v) if top(k) != k}
