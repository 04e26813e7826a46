"""Near duplicates, components and nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from llm.edge_rows import ROWS, ascii_lower, documents, words
from pyspark.sql import functions as F

from renderscope.llm import near_dedup, neighbours
from renderscope.llm.components import components


def shingle_set(text):
    w = words(ascii_lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=85):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    ids = [least.get(find(i)) for i in range(len(rows))]
    return sorted(((r[0], len(s), c, r[0] == c) for r, s, c in zip(rows, sets, ids, strict=True)), key=repr)


def found(docs, **kw):
    got = near_dedup.near_duplicates(docs, **kw).select("doc_id", "n_shingles", "component_id", "kept").collect()
    return sorted(map(tuple, got), key=repr)


def test_edges(spark):
    docs = documents(spark, "component_id string")
    assert found(docs) == brute(ROWS)
    assert found(docs.limit(0)) == []
    assert found(docs.filter("doc_id in (3, 4)")) == [(3, 0, 3, True), (4, 0, 4, True)]
    assert near_dedup.one_of_each(docs).columns == docs.columns


def near_copies(seed, groups, copies):
    """Groups of edited copies with a passage that all documents share."""
    rng = random.Random(seed)
    shared = [f"p{i}" for i in range(40)]
    rows = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(rng.randrange(1, copies)):
            text = base[:]
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text[:60] + shared + text[60:]), "en", "s", 1, "x"))
    return rows


def test_random_groups(spark):
    rows = near_copies(1, 25, 12)
    assert found(documents(spark, rows=rows)) == brute(rows)


def test_large_nodes_branch_and_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    rows = near_copies(2, 3, 60)
    assert found(documents(spark, rows=rows)) == brute(rows)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    root = {r.v: r.root for r in got.collect()}
    assert got.count() == len(root)
    assert all(root[v] == 100 for v in range(100, 141))
    assert all(root[a] == root[b] for a, b in links if a != b) and all(root[v] <= v for v in root)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- neighbours ----------------------------------------------------------------


def brute_nearest(rows, k, query):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = set()
    for q, a in {(i, tuple(v)): (i, v) for i, v in good if query(i)}.values():
        near = [(-float(neighbours.cosines(a[None], b[None])[0]), i) for i, b in good if i != q and len(a) == len(b)]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(near)[:k], 1)}
    return out


@pytest.mark.parametrize("shard_points,pass_bytes", [(16_384, 1 << 20), (100, 500)])
def test_factor_one_is_exact(spark, shard_points, pass_bytes):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(600, 6)).round(1)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(600 + i, vectors[0].tolist(), "x") for i in range(60)]  # many equal vectors: ties by id
    rows += [(700, None, "x"), (701, [0.0] * 6, "x"), (702, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (703, [float("nan")] * 6, "x")]
    rows += [(704, [float("inf")] * 6, "x"), (705, [], "x"), (None, [1.0] * 6, "x"), (710, [1.0, 2.0], "x"), (720, [2.0, 1.0], "x")]
    rows += [(50, vectors[50].tolist(), "x")]  # a repeated row
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = neighbours.nearest(table, F.col("vec_id") % 10 == 0, shard_points=shard_points, pass_bytes=pass_bytes).collect()
    want = brute_nearest([r[:2] for r in rows], 5, lambda i: i % 10 == 0)
    assert len(got) == len(want)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_ties_beyond_the_spare_places_are_settled_exactly(spark):
    rng = np.random.default_rng(9)
    line = rng.normal(size=6)
    rows = [(1000 - i, (line * (1 + i)).tolist()) for i in range(100)]  # scaled copies: cosines equal but for rounding
    rows += [(2000 + i, v.tolist()) for i, v in enumerate(rng.integers(0, 2, (300, 12)).astype(float))]  # binary
    rows += [(3000 + i, [float(i + 1)]) for i in range(60)]  # one dimension
    rows += [(4000, (line + rng.normal(size=6) * 1e-3 * i).tolist()) for i in range(40)]  # one id, many vectors
    rows += [(5000, [2.0, 1.0, 1.0])] * 9 + [(5001, [2.0, 1.0, 1.0]), (5002, [1.0, 2.0, 1.0])]  # one id, many equal rows
    rows = [r for r in rows if any(r[1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, F.col("vec_id") % 20 == 0)
    want = brute_nearest(rows, 5, lambda i: i % 20 == 0)
    shown = {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()}
    assert shown == want


def test_parallel_points_are_not_pruned():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=24) * rng.uniform(1, 2, 5000)[:, None] * rng.choice([1, 1 + 1e-15], (5000, 24))
    tree = neighbours.build_tree(np.arange(5000), vectors, 5)
    found = neighbours.candidates(tree, vectors[:8], 5, 1.0, np.arange(8))
    near = {(int(r), int(tree.ids[p][0])) for rows, places in found for r, p in zip(rows, places, strict=True)}
    for row in range(8):
        exact = neighbours.cosines(vectors[row][None], vectors)
        order = [i for i in np.lexsort((np.arange(5000), -exact)) if i != row][:5]
        assert {(row, i) for i in order} <= near


def test_factor_leaves_out_more_and_recall_falls(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    vectors = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.3
    tree = neighbours.build_tree(np.arange(4000), vectors, 5)
    queries = vectors[::100]
    best = np.argsort(-neighbours._unit(queries) @ tree.unit.T, axis=1)[:, :5]
    share, recall = [], []
    for factor in (1.0, 1.5, 6.0):
        at, cosine, compared = neighbours.search_tree(tree, queries, 5, factor)
        top = np.take_along_axis(at, np.argsort(-cosine, axis=1)[:, :5], 1)
        share.append(compared / len(queries) / len(tree.unit))
        recall.append(np.mean([len(set(a) & set(b)) / 5 for a, b in zip(top, best, strict=True)]))
    assert recall[0] == 1 and recall[1] >= 0.9
    assert share[0] > share[1] > share[2] and share[0] < 0.8
