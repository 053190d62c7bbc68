"""Near-duplicate documents by b-bit MinHash (operator 10).

Candidates come from bands of full minima; the low bits of all minima, packed into four longs, estimate a pair's
similarity by counting equal bits, corrected for chance collisions; pairs that may reach the threshold are confirmed on
the full shingle sets; links go to a distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, few, materialise
from .shingles import WIDTH, mix, set_digest, shingle_set

#: Minima of a signature, and how many make a band: at a similarity of 0.75 a pair shares no band with probability 5e-6.
MINIMA, ROWS = 128, 4
#: Low bits kept of each minimum.
BITS = 2
#: Links have at least this percentage of shingles in common.
PERCENT = 75
#: Estimated similarity under which a candidate isn't confirmed: 5.4 standard deviations below the threshold.
LEAST_ESTIMATE = 0.5
#: Up to this many members a bucket's remaining members are compared directly; larger buckets get more hubs first.
SMALL_BUCKET = 64
#: Members of a block when large buckets are compared, and rows that are compared with a block at a time.
BLOCK, STEP = 4096, 64
#: Words of parity sketches that are compared at a time.
PARITY_WORDS = 1 << 20

_DRAW = np.random.Generator(np.random.PCG64(10))
_MULTIPLY = _DRAW.integers(1, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _DRAW.integers(0, 1 << 63, MINIMA, np.uint64)
_BAND = _DRAW.integers(1, 1 << 63, MINIMA, np.uint64) | np.uint64(1)
_WORDS = MINIMA * BITS // 64


def minima(hashes: np.ndarray, step: int = 1 << 10) -> np.ndarray:
    """The smallest value of each of ``MINIMA`` permutations over a set."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), step):
        np.minimum(least, ((hashes[k : k + step, None] ^ _FLIP) * _MULTIPLY).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band; the band's number is in the key."""
    sums = (least * _BAND).reshape(-1, ROWS).sum(axis=1, dtype=np.uint64)
    return mix(sums + np.arange(MINIMA // ROWS, dtype=np.uint64)).view(np.int64)


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of all minima, packed into 64-bit words."""
    low = (least & np.uint64((1 << BITS) - 1)).reshape(_WORDS, -1)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


SKETCH = "doc_id long, n_shingles long, digest binary, bits array<long>, bands array<long>"


def sketches(documents: DataFrame) -> DataFrame:
    """Per document: size and digest of its shingle set, packed signature and band keys (null for an empty set)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bits, bands = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                hashes = shingle_set(text)
                sizes.append(len(hashes))
                digests.append(set_digest(hashes))
                least = minima(hashes) if len(hashes) else None
                bits.append(None if least is None else packed_bits(least))
                bands.append(None if least is None else band_keys(least))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bits", "bands"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, SKETCH)


def full_sets(documents: DataFrame) -> DataFrame:
    """Digest and the whole set of shingle hashes of each document."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(x) for x in found], pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["digest", "hashes"])

    return documents.select("text").mapInArrow(sets, "digest binary, hashes array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: the share of equal minima, corrected for the chance that low bits collide."""
    even = sum(1 << i for i in range(0, 64, BITS))
    even -= 1 << 64 if even >> 63 else 0
    differing = F.lit(0)
    for i in range(_WORDS):
        x = a[i].bitwiseXOR(b[i])
        for shift in range(1, BITS):
            x = x.bitwiseOR(F.shiftrightunsigned(a[i].bitwiseXOR(b[i]), shift))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(even)))
    chance = 1 / (1 << BITS)
    return (1 - differing / MINIMA - chance) / (1 - chance)


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the distinct candidate pairs (a, b) those that sizes and packed signatures leave possible."""
    side = classes.select("digest", "n_shingles", "bits")
    found = pairs.join(side.toDF("a", "n_a", "bits_a"), "a").join(side.toDF("b", "n_b", "bits_b"), "b")
    sizes_allow = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    return found.where(sizes_allow & (estimate(F.col("bits_a"), F.col("bits_b")) >= LEAST_ESTIMATE)).select("a", "b", "n_a", "n_b")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose full sets reach the threshold."""
    both = pairs.join(sets.toDF("a", "hashes_a"), "a").join(sets.toDF("b", "hashes_b"), "b")
    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return both.withColumn("common", common).where(100 * F.col("common") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Link documents whose sets of distinct 5-word shingles have a similarity of at least 0.75.

    Takes doc_id and text; other columns are ignored. Returns per row doc_id, n_shingles, component_id (smallest doc_id
    reachable over links) and kept. Texts with fewer than five words have one shingle; null, empty and wordless texts
    have none and are linked with nothing. A null doc_id is no name: its row gets component_id null and is kept, though
    its text still links others. Repeated rows share component and verdict. An empty table gives an empty result.

    Rows with the same set are one class from the start, by partial aggregation over the set's digest, so copies of one
    text never meet in a task. Within a bucket of a band, classes are paired with a hub, never all with all. The hub is
    the most central member: the one whose own buckets hold the most members. Near copies of a text differ from it less
    than from one another, so the central ones have nearly all links of a group, and as they are hubs in most of its
    bands, their pairs recur and are confirmed once. Then come rounds in which only buckets whose members still lie in
    several components take part: those of up to 64 members compare all members of different components, larger ones
    get the next most central member as a hub; the rounds end when one adds no link. What large buckets then still
    hold apart is compared in blocks (``apart_in_buckets``), every member outside the main component with all others. So a
    link is lost only if none of the 32 bands holds it (5e-6) or its estimate falls below ``LEAST_ESTIMATE``.
    """
    table = materialise(sketches(documents), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n_shingles", "bits", "bands")).alias("x")
    classes = materialise(table.where("n_shingles > 0").groupBy("digest").agg(first).select("digest", "x.doc_id", "x.n_shingles", "x.bits", "x.bands"), "classes")
    members = classes.select("digest", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialise(members.join(shared, "key"), "buckets")
    central = buckets.groupBy("digest").agg((-F.sum("n")).alias("rank"))
    buckets = materialise(buckets.join(central, "digest"), "buckets")
    first_hubs = buckets.groupBy("key").agg(F.min(F.struct("rank", "digest"))["digest"].alias("hub"))
    buckets = materialise(buckets.join(first_hubs, "key"), "buckets")
    pairs = buckets.where("digest <> hub").select(F.col("hub").alias("a"), F.col("digest").alias("b")).distinct()
    pairs = materialise(likely(pairs, classes), "pairs")
    links = confirmed_pairs(pairs, classes, documents)
    components = connected_components(links)
    turn, used = 0, None
    while True:
        turn += 1
        placed = buckets.where("n > 2").join(components.withColumnRenamed("id", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
        if turn > 1:
            placed = placed.where(F.col("n") > SMALL_BUCKET)
        mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
        active = materialise(placed.join(mixed, "key").where("digest <> hub"), "active")
        right = active.select("key", F.col("digest").alias("b"), F.col("component").alias("c_b"), "n")
        large = active.where(F.col("n") > SMALL_BUCKET)
        if used is not None:
            large = large.join(used, ["key", "digest"], "left_anti")
        hubs = materialise(large.groupBy("key").agg(F.min(F.struct("rank", "digest", "component")).alias("x")).select("key", F.col("x.digest").alias("a"), F.col("x.component").alias("c_a")), "hubs")
        as_used = hubs.select("key", F.col("a").alias("digest"))
        used = as_used if used is None else used.unionByName(as_used)
        candidates = hubs.join(right.drop("n"), "key").where("c_a <> c_b").select("a", "b")
        if turn == 1:
            members = active.where(F.col("n") <= SMALL_BUCKET)
            left = members.select("key", F.col("digest").alias("a"), F.col("component").alias("c_a"))
            candidates = candidates.unionByName(left.join(right.where(F.col("n") <= SMALL_BUCKET).drop("n"), "key").where("c_a < c_b").select("a", "b"))
        pairs = materialise(likely(candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes), "pairs")
        discard(active)
        found = confirmed_pairs(pairs, classes, documents)
        if not found.limit(1).count():
            break
        components = extended(components, found)
    found = confirmed_pairs(materialise(apart_in_buckets(buckets, components, classes, documents), "pairs"), classes, documents)
    if found.limit(1).count():
        components = extended(components, found)

    named = classes.select("digest", "doc_id").join(components.withColumnRenamed("id", "digest"), "digest")
    named = named.select("digest", "component").join(named.groupBy("component").agg(F.min("doc_id").alias("of_component")), "component")
    names = classes.select("digest", F.col("doc_id").alias("of_class")).join(named.select("digest", "of_component"), "digest", "left").select("digest", F.coalesce("of_component", "of_class").alias("named"))
    out = table.where("n_shingles > 0").select("doc_id", "n_shingles", "digest").join(names, "digest").select("doc_id", "n_shingles", "named")
    out = out.unionByName(table.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("named")))
    component = F.when(F.col("doc_id").isNotNull(), F.col("named"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == F.col("named"), F.lit(True)).alias("kept"))


def extended(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components with further links; each old one counts as a star."""
    stars = components.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    return connected_components(stars.unionByName(links))


def parity(hashes: np.ndarray) -> bytes:
    """Which of 4 to 8 bits a shingle are hit an odd number of times. Two of these differ in no more bits than the sets in elements."""
    width = max(64, 1 << (4 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def parities(documents: DataFrame) -> DataFrame:
    """Digest and parity sketch of each document's set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(x) for x in found], pa.binary()), pa.array([parity(x) for x in found], pa.binary())], ["digest", "parity"])

    return documents.select("text").mapInArrow(sketch, "digest binary, parity binary")


def apart_in_buckets(buckets: DataFrame, components: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidates (a, b, n_a, n_b) of the large buckets that still hold several components: every pair that may be a link.

    The members outside a bucket's main component meet all its members in blocks, at most two blocks a task. There a pair
    must pass by sizes and packed signatures and then by parity sketches, whose differing bits are never more than the
    elements that two sets don't share; so what they rule out is no link. Few pairs that are none pass.
    """
    placed = buckets.where(F.col("n") > SMALL_BUCKET).select("key", "digest").join(components.withColumnRenamed("id", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    placed = materialise(placed, "placed")
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.ceil(F.sum("n") / BLOCK).alias("blocks"), F.count("*").alias("held")).where("held > 1")
    members = materialise(placed.join(mixed, "key"), "members")
    sketched = parities(of_classes(members.select("digest").distinct(), classes, documents)).distinct()
    members = members.join(classes.select("digest", "n_shingles", "bits"), "digest").join(sketched, "digest")
    members = members.withColumns({"minor": F.col("component") != F.col("main"), "block": F.pmod(F.xxhash64("digest"), "blocks")})
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    columns = ["key", "digest", "component", "n_shingles", "bits", "parity"]
    left = members.where("minor").select(*columns, F.lit(True).alias("asks"), F.col("block").alias("i"), every.alias("j"))
    right = members.select(*columns, F.lit(False).alias("asks"), every.alias("i"), F.col("block").alias("j"))
    found = left.unionByName(right).groupBy("key", "i", "j").applyInArrow(_compare, "a binary, b binary, n_a long, n_b long")
    return found.distinct()


def _folded(sketch: np.ndarray, width: int) -> np.ndarray:
    """Parity sketches at a smaller width: halves are added without carry."""
    while sketch.shape[1] > width:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def _compare(table: pa.Table) -> pa.Table:
    """Pairs of an asking and another row of different components that sizes, signatures and parities leave possible."""
    asks = table["asks"].to_numpy().astype(bool)
    digest, sizes = np.array(table["digest"].to_pylist(), object), table["n_shingles"].to_numpy()
    component = np.unique(np.array(table["component"].to_pylist(), object), return_inverse=True)[1]
    bits = table["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(sizes), _WORDS)
    sketches = [np.frombuffer(x, np.uint64) for x in table["parity"].to_pylist()]
    widths = np.array([len(x) for x in sketches])
    even = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    most = MINIMA * (1 - (1 << BITS) ** -1.0) * (1 - LEAST_ESTIMATE)  # minima that may differ
    left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
    kept = []
    for k in range(0, len(left), STEP):
        who = left[k : k + STEP]
        x = bits[who][:, None] ^ bits[right]
        differing = np.zeros(x.shape[:2], np.int64)
        for w in range(_WORDS):
            y = x[:, :, w]
            for shift in range(1, BITS):
                y = y | (x[:, :, w] >> np.uint64(shift))
            differing += np.bitwise_count(y & even)
        less, more = np.minimum(sizes[who][:, None], sizes[right]), np.maximum(sizes[who][:, None], sizes[right])
        rows, columns = np.nonzero((differing <= most) & (100 * less >= PERCENT * more) & (component[who][:, None] != component[right]))
        a, b = who[rows], right[columns]
        for wide_a, wide_b in np.unique(np.stack([widths[a], widths[b]], axis=1), axis=0):
            width = min(wide_a, wide_b)
            at = np.flatnonzero((widths[a] == wide_a) & (widths[b] == wide_b))
            for part in np.array_split(at, -(-len(at) * max(wide_a, wide_b) // PARITY_WORDS)):
                x = _folded(np.stack([sketches[i] for i in a[part]]), width) ^ _folded(np.stack([sketches[i] for i in b[part]]), width)
                unshared = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
                # Sets reach the threshold if those elements are at most so large a share of both sizes.
                near = part[(100 + PERCENT) * unshared <= (100 - PERCENT) * (sizes[a[part]] + sizes[b[part]])]
                kept += zip(a[near], b[near])
    ordered = [(i, j) if digest[i] < digest[j] else (j, i) for i, j in kept]
    a, b = (np.array(x, np.int64) for x in zip(*ordered)) if ordered else (np.empty(0, np.int64),) * 2
    return pa.table([pa.array(digest[a].tolist(), pa.binary()), pa.array(digest[b].tolist(), pa.binary()), pa.array(sizes[a], pa.int64()), pa.array(sizes[b], pa.int64())], names=["a", "b", "n_a", "n_b"])


def of_classes(wanted: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """A document of each wanted class (digest)."""
    ids = few(materialise(wanted.join(classes.select("digest", F.col("doc_id").alias("id")), "digest").select("id").distinct(), "ids"))
    return documents.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")


def confirmed_pairs(pairs: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs that reach the threshold on full sets; sets are made anew from one document of each class involved."""
    wanted = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
    sets = materialise(full_sets(of_classes(wanted, classes, documents)), "sets")
    links = materialise(confirmed(pairs, sets), "links")
    discard(sets, pairs)
    return links
