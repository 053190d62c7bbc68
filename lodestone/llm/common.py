"""Helpers shared by the operators of this package: shared scratch tables and distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, materialise, new_path, shared_dir  # noqa: F401

#: Up to this many ids are broadcast (about 20 MB).
BROADCAST_IDS = 200_000
#: Up to this many links are joined by one task (about 1 MB): a round over them then needs no exchange.
TASK_LINKS = 50_000


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it, whatever its case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def few(ids: DataFrame) -> DataFrame:
    """``ids``, marked for broadcast if they are few enough; else they are joined by a shuffle."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find over the pairs ``(a, b)``.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the forest stays as it is; the links become
    stars around the smallest id of each component in a number of rounds that grows with the logarithm of the longest
    path. Each round groups by id with partial aggregation of the minimum, joins that back, and is written to the
    shared folder; nothing but a few counts reaches the driver.

    Returns ``(id, component)`` for each id that occurs in a link, ``component`` the smallest id reachable.
    Loops and nulls are ignored; without links the result is empty.
    """
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    edges, seen = materialise(edges, "edges"), None
    while (sums := _fingerprint(edges)) != seen:
        seen = sums
        edges = _near(edges, sums)
        # Large star: all that is larger than u hangs below the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v")
        # Small star: of all parents of v the smallest stays, and the others hang below it too.
        parent = large.groupBy("v").agg(F.min("u").alias("m"))
        pairs = F.array(F.struct("m", F.col("v").alias("w")), F.struct("m", F.col("u").alias("w")))
        small = large.join(parent, "v").select(F.explode(pairs).alias("e")).select(F.col("e.m").alias("u"), F.col("e.w").alias("v")).where("u <> v").distinct()
        after = materialise(small, "edges")
        discard(edges)
        edges = after
    edges = _near(edges, seen)
    roots = edges.select("u").distinct()
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots.select(F.col("u").alias("id"), F.col("u").alias("component")))


def _near(edges: DataFrame, sums: tuple) -> DataFrame:
    """The edges in one partition if they are few, else as they are dealt."""
    return edges.coalesce(1) if sums[0] <= TASK_LINKS else edges


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and two sums over hashes of the edges: equal sets have equal ones."""
    half = lambda seed: F.sum(F.shiftright(F.xxhash64("u", "v", F.lit(seed)), 20))
    return tuple(edges.agg(F.count("*"), half(1), half(2)).first())
