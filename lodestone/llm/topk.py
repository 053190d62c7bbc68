"""Exact top-k by inner product with block-at-a-time pruning (operator 13).

Vectors are documents, their components weights of terms. Rows are sorted so that neighbours resemble each other and are
cut into blocks; a block keeps the largest and least weight of each term and a forward index of its vectors. A query
takes blocks in the order of their bounds and stops once a bound is below its k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .clustering import finite, integer_vector
from .common import discard, few, materialise

#: Rows of a block, of a shard (what one task scores against), and shards whose queries go through a task together.
BLOCK, SHARD, TOGETHER = 128, 8192, 4
#: Below this all sums of products are exact in doubles.
EXACT = 2.0**53


def locality(v: Column) -> Column:
    """The two terms of the largest weights, by number and sign."""
    sized = F.transform(v, lambda x, i: F.struct(F.abs(x).alias("size"), (2 * i + (x < 0).cast("int")).alias("term")))
    return F.transform(F.slice(F.sort_array(sized, asc=False), 1, 2), lambda x: x["term"])


def ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, v, candidate, query) with a gapless place ``at`` in an order that keeps like vectors together."""
    keys = ["near", "v", "vec_id"]
    ordered = rows.withColumn("near", locality(F.col("v"))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = ordered.select("vec_id", "v", "candidate", "query", F.monotonically_increasing_id().alias("made"))
    numbered = materialise(numbered.select("*", F.shiftright("made", 33).alias("part")), "ranges")
    starts = numbered.groupBy("part").agg(F.count("*").alias("n"))  # a row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return numbered.join(few(starts), "part").withColumn("at", F.col("start") + F.col("made") - F.shiftleft("part", 33)).drop("part", "made", "start")


def block_index(rows: DataFrame) -> DataFrame:
    """Per block of candidates: shard, ids, forward index (all weights in a row), largest and least weight of each term."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        block = table["at"].to_numpy() // BLOCK
        ids, v = table["vec_id"].to_numpy(), _matrix(table["v"], table.num_rows)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        cuts = list(zip(starts, [*starts[1:], len(block)]))
        made = [[key[0].as_py()] * len(cuts), [ids[a:b] for a, b in cuts], [v[a:b].ravel() for a, b in cuts], [v[a:b].max(axis=0) for a, b in cuts], [v[a:b].min(axis=0) for a, b in cuts]]
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
        return pa.table([pa.array(c, k) for c, k in zip(made, kinds)], names=["shard", "ids", "forward", "most", "least"])

    return rows.where("candidate").select("shard", "at", "vec_id", "v").groupBy("shard").applyInArrow(build, "shard long, ids array<long>, forward array<int>, most array<int>, least array<int>")


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each row, ties to smaller ids, in that order, and their ranks from 0."""
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    keep = rank < k
    return rows[keep], scores[keep], ids[keep], rank[keep]


def search(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each query's k best vectors of the blocks among those that reach its ``floor``.

    A query's own id is left out. Bounds equal to the k-th score are searched, as a tie may go to a smaller id.
    """
    size = lambda x: float(np.abs(x.astype(float)).max(initial=0))
    safe = size(queries) * max(size(most), size(least)) * queries.shape[1] < EXACT
    kind = np.float64 if safe else np.int64
    queries, most, least = queries.astype(kind), most.astype(kind), least.astype(kind)
    forward = [(ids, v.astype(kind)) for ids, v in blocks]
    bounds = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    everyone, floor = np.arange(len(queries)), floor.copy()
    found = [np.empty(0, np.int64)] * 3
    for step in range(len(blocks)):
        block = order[:, step]
        live = everyone[bounds[everyone, block] >= floor]
        if not len(live):
            break
        new = [found]
        for b in np.unique(block[live]):
            who = live[block[live] == b]
            ids, v = forward[b]
            scores = (queries[who] @ v.T).astype(np.int64)
            row, column = np.nonzero((scores >= floor[who][:, None]) & (ids != own[who][:, None]))
            new.append([who[row], scores[row, column], ids[column]])
        *found, rank = best(*(np.concatenate(x) for x in zip(*new)), k)
        full = rank == k - 1
        floor[found[0][full]] = np.maximum(floor[found[0][full]], found[1][full])
    return found[0], found[2], found[1]


def scored(left: DataFrame, blocks: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Results of the packed queries (home, queries) against the blocks with the same keys; a query skips its home shard if ``keys`` has a chunk."""
    again = "chunk" in keys

    def score(key: tuple, packed: pa.Table, index: pa.Table) -> pa.Table:
        shard = key[-1].as_py()
        if again:
            packed = packed.filter(pc.not_equal(packed["home"], shard))
        rows = packed["queries"].combine_chunks().flatten()
        m, n = len(rows), index.num_rows
        out = [np.empty(0, np.int64)] * 4
        if m and n:
            own, row_id = (rows.field(c).to_numpy() for c in ("vec_id", "at"))
            floor = rows.field("floor").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            ids = [x.as_py() for x in index["ids"]]
            most, least = _matrix(index["most"], n), _matrix(index["least"], n)
            blocks = [(np.array(x), np.asarray(f.values).reshape(len(x), -1)) for x, f in zip(ids, index["forward"])]
            row, found, scores = search(_matrix(rows.field("v"), m), own, floor, blocks, most, least, k)
            out = [row_id[row], own[row], found, scores]
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["at", "query_id", "vec_id", "score"])

    return left.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(score, "at long, query_id long, vec_id long, score long")


def boxes(rows: DataFrame, key: str, most: str, least: str) -> DataFrame:
    """Per key the range of each term: array of structs (least, most)."""
    each = rows.select(key, F.posexplode(F.arrays_zip(F.col(least).alias("least"), F.col(most).alias("most"))).alias("term", "range"))
    each = each.groupBy(key, "term").agg(F.min("range.least").cast("long").alias("least"), F.max("range.most").cast("long").alias("most"))
    return each.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("term", "least", "most"))), lambda x: F.struct(x["least"].alias("least"), x["most"].alias("most"))).alias("box"))


def box_bound(a: Column, b: Column) -> Column:
    """The largest inner product that vectors of two boxes may have."""
    products = F.zip_with(a, b, lambda x, y: F.greatest(*(x[i] * y[j] for i in ("least", "most") for j in ("least", "most"))))
    return F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x)


def top_inner_products(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """For each row whose vec_id is divisible by ``every`` the ``k`` other rows of the highest integer inner product.

    Components become floor(scale * x), held within 2^27 (only |x| beyond 2,097,152 at a scale of 64 are). Rows with a null
    vec_id or vector, or with a null or non-finite component, take no part; shorter and empty vectors count as filled up
    with zeros. Rows of the same vec_id and vector count once; rows of the same vec_id and other vectors are rows of their
    own, but no query finds its own vec_id. Ties go to smaller vec_ids. An empty table gives an empty result. Columns
    other than vec_id and embedding are ignored.

    Of equal vectors the k + 1 smallest vec_ids are enough for any query and only they are searched; this loses nothing, as
    they have one score. First each shard's queries search their own shard, whose k-th score is a floor for the rest. Then groups
    of shards' queries meet each other shard that the ranges of their terms allow to reach the least floor. The work is that of
    all queries against all rows, in tasks of at most ``SHARD`` rows and ``TOGETHER`` shards' queries.
    """
    whole = finite(F.col("embedding")) & F.col("vec_id").isNotNull()
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(whole).select("vec_id", integer_vector(F.col("embedding"), scale).alias("v"))
    vectors = materialise(rows, "vectors")
    dims = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    vectors = vectors.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(dims) - F.size("v"))))
    copy = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    candidates = vectors.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("vec_id", "v").distinct()
    queries = vectors.where(F.col("vec_id") % every == 0).distinct()
    flagged = candidates.select("vec_id", "v", F.lit(True).alias("candidate"), F.lit(False).alias("query")).unionByName(queries.select("vec_id", "v", F.lit(False).alias("candidate"), F.lit(True).alias("query")))
    placed = ranges(flagged).withColumn("shard", F.floor(F.col("at") / SHARD))
    blocks = materialise(block_index(placed), "blocks")
    asked = placed.where("query").select("shard", "at", "vec_id", "v")

    def pack(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("shard").alias("home")).agg(F.collect_list(F.struct("at", "vec_id", "v", "floor")).alias("queries"))

    own = pack(asked.withColumn("floor", F.lit(None).cast("long"))).withColumn("shard", F.col("home"))
    home = materialise(scored(own, blocks, ["shard"], k), "home")
    floors = home.groupBy("at").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    again = pack(asked.join(floors, "at", "left")).withColumn("chunk", F.floor(F.col("home") / TOGETHER))
    again = materialise(again, "queries")

    each = again.select("chunk", F.explode("queries.v").alias("v"))
    least = again.groupBy("chunk").agg(F.min(F.array_min(F.transform("queries.floor", lambda x: F.coalesce(x, F.lit(-(1 << 63)))))).alias("floor"))
    shards = boxes(blocks, "shard", "most", "least")
    last = blocks.agg(F.max("shard")).first()[0]
    chunks = boxes(each, "chunk", "v", "v").join(least, "chunk").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long"))))
    pairs = chunks.toDF("chunk", "asked", "floor", "shard").join(shards, "shard").where(box_bound(F.col("asked"), F.col("box")) >= F.col("floor")).select("chunk", "shard")
    pairs = materialise(pairs, "pairs")
    rest = scored(again.join(few(pairs), "chunk"), blocks.join(few(pairs), "shard"), ["chunk", "shard"], k)

    order = Window.partitionBy("at").orderBy(F.desc("score"), "vec_id")
    found = home.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
(SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)) WHERE rank <= 20"""
