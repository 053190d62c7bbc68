"""Centroid clustering with a vantage-point tree over the centroids (operator 11).

Vectors are held as integers, so distances, ties and means are exact. Each round a tree over the centroids is built by
the driver, broadcast, and searched best-first for each vector; tasks send sums per cluster, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Components are held within this bound, so that the squared distance of 64 components fits a long.
MOST = 1 << 27
#: Centroids in a leaf.
LEAF = 2
#: Numbers in the table of bounds that one step of the search holds.
TABLE = 1 << 22
#: Share by which lower bounds are lessened, so that rounding never hides a centroid.
SLACK = 2.0**-46


def integer_vector(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, within ``MOST``."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))


def finite(vector: Column) -> Column:
    """Whether a vector is there and has no component that is null, not a number or infinite."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


class Tree(NamedTuple):
    """A vantage-point tree; node 0 is the root.

    ``points`` holds the centroids that a node compares itself: its vantage point, or a leaf's members; -1 fills up.
    ``children`` are the nodes of the nearer and the farther half (-1: none), ``shells`` the least and the largest
    distance of either half from the vantage point.
    """

    points: np.ndarray
    children: np.ndarray
    shells: np.ndarray


def plant(centroids: np.ndarray) -> Tree:
    """The tree over at least one centroid; halves are cut by rank, so equal centroids are split as well."""
    points, children, shells = [], [], []

    def grow(members: np.ndarray) -> int:
        node = len(points)
        points.append(np.full(LEAF, -1))
        children.append([-1, -1])
        shells.append(np.zeros((2, 2)))
        if len(members) <= LEAF:
            points[node][: len(members)] = members
            return node
        away = np.sqrt(((centroids[members] - centroids[members[0]]) ** 2).sum(axis=1).astype(float))
        vantage = members[away.argmax()]
        points[node][0] = vantage
        rest = members[members != vantage]
        away = np.sqrt(((centroids[rest] - centroids[vantage]) ** 2).sum(axis=1).astype(float))
        order = away.argsort(kind="stable")
        for side, half in enumerate(np.array_split(order, 2)):
            shells[node][side] = away[half[0]], away[half[-1]]
            children[node][side] = grow(rest[half])
        return node

    grow(np.arange(len(centroids)))
    return Tree(np.array(points), np.array(children), np.array(shells))


def nearest(vectors: np.ndarray, centroids: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each vector; of equally near ones the smallest number.

    Each vector has its own queue of open nodes with lower bounds and takes the least of them; a node is searched while
    its bound doesn't exceed the best distance, equality included. All vectors of a batch take a step together.
    """
    n, nodes = len(vectors), len(tree.points)
    if n * nodes > TABLE and n > 1:
        parts = [nearest(x, centroids, tree) for x in np.array_split(vectors, 2)]
        return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(centroids))
    queue = np.full((n, nodes), np.inf)
    queue[:, 0] = 0
    live = np.arange(n)
    while len(live):
        node = queue[live].argmin(axis=1)
        low = queue[live, node]
        going = low <= np.sqrt(best[live].astype(float))
        live, node, low = live[going], node[going], low[going]
        queue[live, node] = np.inf
        first = np.zeros(len(live))
        for slot in range(LEAF):
            c = tree.points[node, slot]
            at = np.flatnonzero(c >= 0)
            who, c = live[at], c[at]
            squared = ((vectors[who] - centroids[c]) ** 2).sum(axis=1)
            if slot == 0:
                first[at] = np.sqrt(squared.astype(float))
            nearer = (squared < best[who]) | ((squared == best[who]) & (c < number[who]))
            best[who[nearer]], number[who[nearer]] = squared[nearer], c[nearer]
        for side in range(2):
            child = tree.children[node, side]
            at = np.flatnonzero(child >= 0)
            near, far = tree.shells[node[at], side].T
            bound = np.maximum(first[at] - far, near - first[at]) - SLACK * (first[at] + far)
            queue[live[at], child[at]] = np.maximum(bound, low[at])
    return number, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of each non-empty cluster. The driver gets one row per centroid and component."""
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, plant(centroids)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tree = shared.value
        counts, totals = np.zeros(len(own), np.int64), np.zeros(own.shape, np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), own.shape[1])
            if not len(v):
                continue
            number, _ = nearest(v, own, tree)
            order = number.argsort(kind="stable")
            there, starts = np.unique(number[order], return_index=True)
            totals[there] += np.add.reduceat(v[order], starts, axis=0)
            counts += np.bincount(number, minlength=len(own))
        there = np.flatnonzero(counts)
        made = [np.repeat(there, own.shape[1]), np.tile(np.arange(own.shape[1]), len(there)), np.repeat(counts[there], own.shape[1]), totals[there].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], ["cluster", "component", "n", "total"])

    found = vectors.select("v").mapInArrow(sums, "cluster long, component long, n long, total long")
    rows = found.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    shared.unpersist()
    by_cluster: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        by_cluster.setdefault(r.cluster, (r.n, [0] * centroids.shape[1]))[1][r.component] = int(r.total)
    return by_cluster


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, number and squared distance of the nearest centroid."""
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, plant(centroids)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, squared = nearest(_matrix(batch.column("v"), shared.value[0].shape[1]), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(squared, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(assign, "vec_id long, cluster int, distance long")


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster_vectors(embeddings: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3") -> DataFrame:
    """k-means over integer vectors with exact arithmetic: a row per kept vector.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; null, shorter, longer and empty vectors get
    no row. Components become floor(scale * x), held within 2^27 (only |x| beyond 131,072 at a scale of 1024 are), so that every
    distance fits a long. The first centroids are the ``k`` vectors of the smallest sha256 of "salt:vec_id", or all if fewer;
    a null vec_id counts last and is clustered like any other. Repeated rows each count and get a row each. Of equally near
    centroids the smallest number wins; empty clusters keep their centroid. Without kept vectors the result is empty.
    Columns other than vec_id and embedding are ignored.

    ``k`` and ``dims`` bound what reaches the driver and what is broadcast (k * dims numbers); rows only feed sums that
    tasks make before anything is shuffled, so a cluster with most rows costs no more than others. The vectors are written once
    as integers; each round is one pass over that table.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where((F.size("embedding") == dims) & finite(F.col("embedding")))
    vectors = materialise(rows.select("vec_id", integer_vector(F.col("embedding"), scale).alias("v")), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    seeds = vectors.select("v", digest.alias("digest")).orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], RESULT)
    centroids = np.array([r.v for r in seeds], np.int64)
    for _ in range(rounds):
        found = cluster_sums(vectors, centroids)
        after = centroids.copy()
        for c, (n, totals) in found.items():
            after[c] = [t // n for t in totals]
        centroids = after
    result = materialise(assigned(vectors, centroids), "assigned")
    discard(vectors)
    inertia = result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    total = sum(int(r.d) for r in inertia)
    most = (1 << 63) - 1
    stats = [(r.cluster, min(int(r.d), most), min(total, most), hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in inertia]
    per_cluster = spark.createDataFrame(stats, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return result.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3") -> str:
    """The same result by plain comparison with every centroid: one pair of common table expressions a round."""
    places = f"range(1, {dims + 1})"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT v, sha256('{salt}:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, v, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS place FROM"
            f" (SELECT vec_id, v.v, c, CAST(list_sum(list_transform({places}, lambda i: (v.v[i] - c{r}.v[i]) * (v.v[i] - c{r}.v[i]))) AS BIGINT) AS d FROM v, c{r})) WHERE place = 1)"
        )
        if r < rounds:
            parts.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v"
                f" FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest({places}) AS i, unnest(v) AS x FROM a{r}) GROUP BY c, i) GROUP BY c) m USING (c))"
            )
    last = f"a{rounds}"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, CAST({last}.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY {last}.c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} ON {last}.c = c{rounds}.c"
    )
