"""Operators 11, 12 and 13 against brute force, and their SQL against DuckDB."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestone.llm import clustering, divergence, queries, topk

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, v string, cluster string, distance int, at int, shard string, query int"
NAN, INF = float("nan"), float("inf")


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", "y", 1, 2, "z", 3) for i, v in vectors], VECTORS)


def grid(rng, n, dims, span=2):
    """Vectors of few distinct values: many ties and repeats."""
    return [(i, [rng.randrange(-span, span + 1) / 4 for _ in range(dims)]) for i in range(n)]


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def k_means(vectors, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if whole(v) and len(v) == dims]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    per = Counter()
    for d, n in found:
        per[n] += d
    return Counter((i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, found))


@pytest.mark.parametrize("k", [1, 3, 8, 40])
def test_clusters_equal_brute_force(spark, k):
    rng = random.Random(k)
    vectors = grid(rng, 60, 4) + [(100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 0.0, 0.0]), (104, [NAN, 0.0, 0.0, 0.0]), (105, [0.0, -INF, 0.0, 0.0]), (7, [0.25, 0.5, -0.25, 0.0]), (None, [0.5, 0.5, 0.5, 0.5])]
    vectors += vectors[:5]
    got = clustering.cluster_vectors(table(spark, vectors), k=k, rounds=4, dims=4).collect()
    assert Counter(map(tuple, got)) == k_means(vectors, k, 4, 4)


def test_tree_search_equals_comparison_with_all_centroids():
    rng = np.random.default_rng(1)
    for k, span in itertools.product((1, 2, 5, 33, 200), (2, 1000)):
        centroids, vectors = rng.integers(-span, span, (k, 3)), rng.integers(-span, span, (500, 3))
        squared = ((vectors[:, None] - centroids) ** 2).sum(axis=2)
        number, distance = clustering.nearest(vectors, centroids, clustering.plant(centroids))
        assert (number == squared.argmin(axis=1)).all() and (distance == squared.min(axis=1)).all()


def test_tree_search_leaves_centroids_out():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-1000, 1000, (256, 2))
    tree, seen = clustering.plant(centroids), []
    vectors = rng.integers(-1000, 1000, (300, 2))

    class Counting(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim == 1:
                seen.append(len(at))
            return super().__getitem__(at)

    clustering.nearest(vectors, centroids.view(Counting), tree)
    assert sum(seen) < 0.3 * len(vectors) * len(centroids)


def test_large_components_are_held_within_bounds(spark):
    got = clustering.cluster_vectors(table(spark, [(1, [3e38, -3e38]), (2, [3e38, 0.0])]), k=1, rounds=2, dims=2).collect()
    assert len(got) == 2 and all(0 <= r.distance <= r.inertia for r in got)


def test_no_vectors(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        df = clustering.cluster_vectors(table(spark, rows))
        assert df.collect() == [] and df.columns == [c.split()[0] for c in clustering.RESULT.split(", ")]
    assert topk.top_inner_products(table(spark, [])).collect() == []
    assert topk.top_inner_products(table(spark, [(20, None), (None, [1.0])])).collect() == []


def top(vectors, k, every):
    rows = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in vectors if i is not None and whole(v)}
    out = []
    for i, q in rows:
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, c)), j) for j, c in rows if j != i)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block, shard, n, dims", [(128, 8192, 90, 3), (4, 16, 300, 3), (2, 8, 120, 12)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, shard, n, dims):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SHARD", shard)
    rng = random.Random(n)
    vectors = grid(rng, n, dims) + [(1000 + i, [0.5] * dims) for i in range(60)] + [(2000, None), (2020, []), (2040, [1.0]), (2060, [NAN] * dims), (2080, [None] * dims), (2100, [INF] * dims), (None, [2.0] * dims), (-40, [0.0] * dims)]
    vectors += vectors[:9] + [(0, [9.0] * dims)]
    got = topk.top_inner_products(table(spark, vectors), k=5).collect()
    assert Counter(map(tuple, got)) == top(vectors, 5, 20)


def test_top_k_of_few_rows(spark):
    vectors = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [-1.0, 3e38])]
    got = topk.top_inner_products(table(spark, vectors)).collect()
    assert len(got) == 4 and {(r.query_id, r.rank) for r in got} == {(0, 1), (0, 2), (20, 1), (20, 2)}


def test_blocks_below_the_floor_are_left_out():
    centre = np.array([[100, 0], [0, 100], [-100, 0]])
    blocks = [(np.arange(3 * i, 3 * i + 3), c + np.array([[0, 0], [1, 0], [0, 1]])) for i, c in enumerate(centre)]
    most, least = (np.array([f(v, axis=0) for _, v in blocks]) for f in (np.max, np.min))
    blocks[2] = (blocks[2][0], np.full((3, 2), 10**6))  # its bounds say that it can't help; it must not be read
    row, ids, scores = topk.search(np.array([[1, 0]]), np.array([-1]), np.array([-(10**9)]), blocks, most, least, 3)
    assert ids.tolist() == [1, 0, 2] and scores.tolist() == [101, 100, 100]


def audit(documents, least, ranks):
    texts = [(lang or "", source or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in documents]
    out = []
    for lang in {d[0] for d in texts}:
        docs = Counter(t for d in texts if d[0] == lang for t in set(d[2]))
        kept = [t for t in docs if docs[t] >= least]

        def prices(of, kept=kept):
            n = Counter(t for _, _, terms in of for t in terms if t in set(kept))
            return n, {t: 1 + 10**9 * (n[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}

        _, q = prices([d for d in texts if d[0] == lang])
        by = {s: prices([d for d in texts if d[:2] == (lang, s)]) for s in {d[1] for d in texts if d[0] == lang}}
        for s, (n, p) in by.items():
            pairs = [(-sum(abs(p[t] - p2[t]) for t in kept), o.encode(), o) for o, (_, p2) in by.items() if o != s]
            words = [(q[t] - p[t], t.encode(), t) for t in kept if n[t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[:ranks])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return Counter(out)


DOCS = "doc_id long, text string, lang string, source string, n int, term string, value int, class string, block int, a string"


@pytest.mark.parametrize("segment, sources, entries", [(4096, 64, 10**6), (8, 2, 50), (3, 3, 1)])
def test_audit_equals_brute_force(spark, monkeypatch, segment, sources, entries):
    monkeypatch.setattr(divergence, "SEGMENT", segment)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    rng = random.Random(5)
    names = ["straße", "Ärger", "日本語", "don't", "x1y", "A_b", "ſ", "İ"] + [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows = []
    for lang, source in itertools.product(("en", "de", None), ("a", "b", "c", "é", "", None, "z")):
        size = rng.choice((0, 3, 9))
        rows += [(" ".join(rng.choices(names, weights=range(len(names), 0, -1), k=rng.randrange(40))), lang, source) for _ in range(size)]
    rows += [(None, "en", "none"), ("", "en", "blank"), ("once", "fr", "only"), ("", "xx", "s1"), ("12 34", "xx", "s2"), ("word " * 5000, "en", "long"), ("", "en", "blank")]
    df = spark.createDataFrame([(1, *r, 1, "t", 2, "c", 3, "a") for r in rows], DOCS)
    assert Counter(map(tuple, divergence.source_divergence(df, 4, 6).collect())) == audit(rows, 4, 6)


def test_audit_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).collect() == []


def test_equal_subtrees_are_one_node():
    counts = np.zeros((3, 64), np.int64)
    counts[1, 5] = counts[2, 37] = 7
    forest = divergence.Forest(counts)
    assert [len(left) for left, _, _ in forest.levels] == [2, 2, 2, 2, 2, 3]  # the sevens sit in equal subtrees until the root tells left from right
    price = np.array([[1, 10]] * 3)
    assert forest.differences(np.array([0, 1, 0]), np.array([1, 2, 0]), price).tolist() == [9, 18, 0]


@pytest.mark.parametrize("name", ["op11_vantage_point_clusters", "op12_segment_tree_divergence", "op13_block_max_top_k"])
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.sql(queries.ORACLE_SQL[name])
    assert Counter(map(tuple, queries.QUERIES[name](spark, SF).select(want.columns).collect())) == Counter(want.fetchall())
