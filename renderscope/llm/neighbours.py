"""Nearest neighbours by cosine from vantage-point trees, one per shard.

On the unit sphere the chord is a metric and orders like the cosine. A tree
splits its points by their distance to a vantage point; the triangle inequality
bounds how near either side can be, and a side is left out if that bound, times
``factor``, is beyond the k-th best so far. Factor 1 is exact; larger factors
leave out more. All queries of a block walk a tree together, first to the leaf
each of them falls into, then everywhere else the bound allows. Points within
rounding of the k-th best stay until they are scored exactly; where they exceed
the spare places of a query, it walks the tree again and takes every one.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renderscope.session import staged

#: Points of a shard, about.
SHARD_POINTS = 16_384
LEAF = 64
#: Candidates kept beyond k until they are scored exactly; queries with more of them walk again.
SPARE = 16
#: Bytes of query vectors that go to every executor at a time; more queries take more passes over the index.
PASS_BYTES = 32 << 20
#: Queries that walk a tree together.
TOGETHER = 1024
#: Components scored at a time.
SCORED_VALUES = 1 << 22
#: Scored pairs held before they are cut to k per query.
HELD_PAIRS = 1 << 20


# --- trees ---------------------------------------------------------------------


@dataclass
class Tree:
    """Distinct vectors in leaf order. Nodes: vantage point, children, and the distance range of each child.

    ``low`` and ``high`` are the least and greatest id of each vector.
    """

    vectors: np.ndarray
    unit: np.ndarray
    ids: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray
    nodes: list[tuple]


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def margin(dim: int) -> float:
    """Twice what a product of unit rows and ``cosines`` can differ by, in double precision."""
    return 4 * (dim + 8) * float(np.finfo(np.float64).eps)


def slack(dim: int) -> float:
    """Error of a difference of three chords: near 0 a chord is off by the root of its cosine's error."""
    return 3 * math.sqrt(margin(dim))


def _smallest(ids: np.ndarray, k: int) -> np.ndarray:
    """Of sorted ids, enough to hold the k smallest beside any one id: each up to k times, 2k in all."""
    if len(ids) <= k:
        return ids
    times = np.arange(len(ids)) - np.searchsorted(ids, ids)
    return ids[times < k][: 2 * k]


def build_tree(ids: np.ndarray, vectors: np.ndarray, k: int) -> Tree:
    """Equal vectors are one point with its smallest ids: no other can be among the k nearest."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    first = np.flatnonzero(np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)]))
    groups = [_smallest(g, k) for g in np.split(ids, first[1:])]
    low, high = ids[first], ids[np.append(first[1:], len(ids)) - 1]
    vectors = vectors[first]
    unit = _unit(vectors)
    place = np.arange(len(unit))
    nodes: list[tuple] = []

    def grow(a: int, b: int) -> int:
        """Node over place[a:b]; a leaf is (-1, a, b)."""
        if b - a <= LEAF:
            nodes.append((-1, a, b))
            return len(nodes) - 1
        own = place[a:b]
        # The point farthest from the first one: vantage points near the rim split best.
        far = own[np.argmin(unit[own] @ unit[own[0]])]
        d = chord(unit[own] @ unit[far])
        by = np.argsort(d, kind="stable")
        place[a:b], d = own[by], d[by]
        half = (b - a) // 2
        at = len(nodes)
        nodes.append(())
        ranges = (d[0], d[half - 1], d[half], d[-1])
        nodes[at] = (unit[far], grow(a, a + half), grow(a + half, b), *ranges)
        return at

    if len(unit):
        grow(0, len(unit))
    return Tree(vectors[place], unit[place], [groups[i] for i in place], low[place], high[place], nodes)


def _alone(tree: Tree, a: int, b: int, own: np.ndarray) -> np.ndarray:
    """Which of the points a to b have no id but the query's own, query by query."""
    return (tree.low[a:b] == own[:, None]) & (tree.high[a:b] == own[:, None])


def _merge(best: np.ndarray, at: np.ndarray, cosine: np.ndarray, points: np.ndarray) -> None:
    """Keep the best of old and new candidates, row by row."""
    both = np.concatenate([best, cosine], axis=1)
    names = np.concatenate([at, np.broadcast_to(points, cosine.shape)], axis=1)
    keep = np.argpartition(-both, best.shape[1] - 1, axis=1)[:, : best.shape[1]]
    best[:] = np.take_along_axis(both, keep, 1)
    at[:] = np.take_along_axis(names, keep, 1)


def search_tree(
    tree: Tree, queries: np.ndarray, k: int, factor: float, own: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, int]:
    """Points (places in the tree, -1 for none) and cosines of each query's candidates; vectors compared.

    Points that hold only the query's id in ``own`` are no candidates.
    """
    q = _unit(queries)
    best = np.full((len(q), k + SPARE), -np.inf)
    at = np.full(best.shape, -1, np.int64)
    home = np.full(len(q), -1)
    near, off = margin(q.shape[1]), slack(q.shape[1])
    compared = 0

    def leaf(node: int, rows: np.ndarray) -> None:
        nonlocal compared
        _, a, b = tree.nodes[node]
        compared += len(rows) * (b - a)
        part, names = best[rows], at[rows]
        cosine = q[rows] @ tree.unit[a:b].T
        if own is not None:
            cosine[_alone(tree, a, b, own[rows])] = -np.inf
        _merge(part, names, cosine, np.arange(a, b))
        best[rows], at[rows] = part, names

    def descend(node: int, rows: np.ndarray) -> None:
        if len(tree.nodes[node]) == 3:
            home[rows] = node
            leaf(node, rows)
            return
        point, inner, outer, _, inner_far, outer_near, _ = tree.nodes[node]
        d = chord(q[rows] @ point)
        inside = d <= (inner_far + outer_near) / 2
        for child, part in ((inner, rows[inside]), (outer, rows[~inside])):
            if len(part):
                descend(child, part)

    def visit(node: int, rows: np.ndarray) -> None:
        if len(tree.nodes[node]) == 3:
            rows = rows[home[rows] != node]
            if len(rows):
                leaf(node, rows)
            return
        for child, bound in _bounds(tree.nodes[node], q[rows]):
            reach = chord(kth_best(best[rows], k).clip(min=-1) - near)
            part = rows[bound * factor <= reach + off]
            if len(part):
                visit(child, part)

    if tree.nodes:
        every = np.arange(len(q))
        descend(0, every)
        visit(0, every)
    at[best == -np.inf] = -1
    return at, best, compared


def _bounds(node: tuple, q: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each child and the least distance it can have to the queries."""
    point, inner, outer, inner_near, inner_far, outer_near, outer_far = node
    d = chord(q @ point)
    sides = ((inner, inner_near, inner_far), (outer, outer_near, outer_far))
    return [(child, np.maximum(np.maximum(near - d, d - far), 0)) for child, near, far in sides]


def kth_best(best: np.ndarray, k: int) -> np.ndarray:
    return np.partition(best, -k, axis=1)[:, -k]


def points_from(
    tree: Tree, queries: np.ndarray, least: np.ndarray, own: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of a query and a point of at least its cosine ``least``: rows and places, leaf by leaf."""
    q = _unit(queries)
    reach = chord(least) + slack(q.shape[1])
    open_nodes = [(0, np.arange(len(q)))]
    while open_nodes:
        node, rows = open_nodes.pop()
        if len(tree.nodes[node]) == 3:
            _, a, b = tree.nodes[node]
            close = (q[rows] @ tree.unit[a:b].T >= least[rows, None]) & ~_alone(tree, a, b, own[rows])
            row, place = np.nonzero(close)
            yield rows[row], place + a
            continue
        for child, bound in _bounds(tree.nodes[node], q[rows]):
            part = rows[bound <= reach[rows]]
            if len(part):
                open_nodes.append((child, part))


def candidates(
    tree: Tree, queries: np.ndarray, k: int, factor: float, own: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and places of all points that can be among the k nearest once scored exactly."""
    at, best, _ = search_tree(tree, queries, k, factor, own)
    least = kth_best(best, k) - margin(queries.shape[1])
    full = np.flatnonzero((best.min(axis=1) >= least) & np.isfinite(least))
    at[full] = -1
    row, column = np.nonzero(at >= 0)
    yield row, at[row, column]
    if len(full):
        for row, place in points_from(tree, queries[full], least[full], own[full]):
            yield full[row], place


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision, summed in order."""
    dot = np.cumsum(queries * vectors, axis=-1)[..., -1]
    a = np.cumsum(queries * queries, axis=-1)[..., -1]
    b = np.cumsum(vectors * vectors, axis=-1)[..., -1]
    return np.clip(dot / np.sqrt(a * b), -1.0, 1.0)


# --- Spark ---------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """No nulls, no non-finite components, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _points(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    return (
        rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
        .filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        .withColumn("dim", F.size("vector"))
    )


def build_index(
    rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shard_points: int = SHARD_POINTS
) -> DataFrame:
    """dim, shard, tree: a tree per shard over every usable vector of its dimension."""
    points = _points(rows, id_col, vector_col)
    shards = max(1, math.ceil(points.count() / shard_points))

    def tree(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        built = build_tree(part["vec_id"].to_numpy(np.int64), np.stack(part["vector"].to_numpy()).astype(np.float64), k)
        return pd.DataFrame([{"dim": key[0], "shard": key[1], "tree": pickle.dumps(built, 5)}])

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return staged(dealt.groupBy("dim", "shard").applyInPandas(tree, "dim int, shard long, tree binary"))


def search(index: DataFrame, queries: pd.DataFrame, k: int, factor: float) -> DataFrame:
    """query_id, query_key, vec_id, score: the k nearest to each query among the shards of a task."""
    shared = index.sparkSession.sparkContext.broadcast(  # PASS_BYTES at most
        {
            dim: (q["vec_id"].to_numpy(np.int64), q["key"].to_numpy(np.int64), np.stack(q["vector"].to_numpy()).astype(np.float64))
            for dim, q in queries.groupby("dim")
        }
    )
    names = ["query_id", "query_key", "vec_id", "score"]

    def nearest_of(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts).sort_values(["query_key", "score", "vec_id"], ascending=[True, False, True])
        return rows.groupby("query_key", sort=False).head(k)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in names})
        for batch in batches:
            for dim, data in zip(batch["dim"], batch["tree"], strict=True):
                if dim not in shared.value:
                    continue
                tree: Tree = pickle.loads(data)
                ids, keys, vectors = shared.value[dim]
                parts, pairs = [held], 0
                step = max(1, SCORED_VALUES // int(dim))
                for i in range(0, len(ids), TOGETHER):
                    part = vectors[i : i + TOGETHER]
                    for rows, places in candidates(tree, part, k, factor, ids[i : i + TOGETHER]):
                        for j in range(0, len(rows), step):
                            row, place = rows[j : j + step], places[j : j + step]
                            score = cosines(part[row], tree.vectors[place])
                            own = [tree.ids[p] for p in place]
                            times = np.fromiter(map(len, own), np.int64, len(own))
                            row, score = np.repeat(row, times), np.repeat(score, times)
                            vec = np.concatenate(own)
                            other = vec != ids[i + row]
                            columns = (ids[i + row], keys[i + row], vec, score)
                            parts.append(pd.DataFrame({n: c[other] for n, c in zip(names, columns, strict=True)}))
                            pairs += len(vec)
                            if pairs >= HELD_PAIRS:
                                parts, pairs = [nearest_of(parts)], 0
                held = nearest_of(parts)
        yield held

    return index.select("dim", "tree").mapInPandas(found, "query_id long, query_key long, vec_id long, score double")


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    factor: float = 1.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pass_bytes: int = PASS_BYTES,
    shard_points: int = SHARD_POINTS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query row, ties to the smaller id.

    Candidates are all usable vectors of the query's dimension with another id.
    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without id. Equal rows are one query; rows that share an
    id but not the vector are queries of their own. Fewer candidates, fewer
    rows; an empty table gives none; other columns are not looked at.
    """
    index = build_index(rows, k, id_col, vector_col, shard_points)
    asked = staged(
        _points(rows.filter(is_query), id_col, vector_col).distinct().withColumn("key", F.xxhash64("vec_id", "vector"))
    )
    size = asked.agg(F.coalesce(F.sum(F.col("dim") * 8 + 32), F.lit(0))).first()[0]
    passes = max(1, math.ceil(size / pass_bytes))
    found = None
    for i in range(passes):
        block = asked.filter(F.pmod("key", F.lit(passes)) == i).toPandas()
        part = search(index, block, k, factor)
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_key", "query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
