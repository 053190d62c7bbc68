"""Source divergence audit by hash-consed segment trees (operator 12).

The counts of a group over the term ids of a segment are the leaves of a binary tree. Equal subtrees, of whatever group
and place, are one node. Two groups are compared by walking their trees together; each pair of nodes is priced once,
however often it occurs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import few, materialise

#: A probability of one.
UNIT = 1_000_000_000
#: Added to each count.
PRIOR = 5
#: Terms in a segment, about: the places of one tree.
SEGMENT = 4096
#: Sources that a task compares with as many others.
SOURCES = 64
#: Entries that a task counts before it sends them on.
ENTRIES = 400_000

#: ASCII letters in lower case, bytes of other characters as they are, anything else a space.
_TO_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and characters beyond ASCII, only A-Z lower-cased."""
    return (text or b"").translate(_TO_TERMS).split()


def term_counts(documents: DataFrame) -> DataFrame:
    """Occurrences and documents of each term per (lang, source), summed within tasks; a null term stands for the group itself."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[Counter, Counter]] = {}
        entries = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                n, docs = found.setdefault((lang, source), (Counter(), Counter({None: 0})))
                before = len(docs)
                terms = terms_of(text)
                n.update(terms)
                docs.update(set(terms))
                docs[None] += 1
                entries += len(docs) - before
                if entries > ENTRIES:
                    yield packed(found)
                    found, entries = {}, 0
        yield packed(found)

    def packed(found: dict) -> pa.RecordBatch:
        rows = [(*group, term, n[term], d) for group, (n, docs) in found.items() for term, d in docs.items()]
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["lang", "source", "term", "n", "docs"])

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    made = documents.select(*named, "text").mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    return made.withColumn("term", F.col("term").cast("string"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), exactly."""
    exact = "decimal(28,0)"
    return F.call_function("div", (count + PRIOR).cast(exact) * F.lit(UNIT).cast("decimal(10,0)"), (total + PRIOR * terms).cast(exact)) + 1


class Forest:
    """Hash-consed segment trees, one per row of a matrix of counts.

    ``leaves`` are the distinct counts (-1 fills the last places), ``levels`` from the leaves up hold the left and the right
    child of each distinct node, ``roots`` the root of each row.
    """

    def __init__(self, counts: np.ndarray) -> None:
        rows, width = counts.shape
        full = np.full((rows, 1 << max(0, width - 1).bit_length()), -1, np.int64)
        full[:, :width] = counts
        self.leaves, nodes = np.unique(full, return_inverse=True)
        nodes, size = nodes.reshape(full.shape), len(self.leaves)
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        while nodes.shape[1] > 1:
            made, inverse = np.unique(nodes[:, ::2] * size + nodes[:, 1::2], return_inverse=True)
            self.levels.append((made // size, made % size, size))
            nodes, size = inverse.reshape(rows, -1), len(made)
        self.roots = nodes[:, 0]

    def differences(self, a: np.ndarray, b: np.ndarray, price: np.ndarray) -> np.ndarray:
        """Summed absolute difference of the prices of rows ``a[i]`` and ``b[i]``; ``price`` is per row and leaf.

        Walks down from the roots keeping the distinct pairs of nodes of each comparison, prices the distinct pairs of
        leaves, and hands the sums back up.
        """
        which, x, y = np.arange(len(a)), self.roots[a], self.roots[b]
        memo = []
        for left, right, size in reversed(self.levels):
            key = (np.tile(which, 2) * size + np.concatenate([left[x], right[x]])) * size + np.concatenate([left[y], right[y]])
            distinct, inverse = np.unique(key, return_inverse=True)
            memo.append(inverse)
            which, x, y = distinct // (size * size), distinct // size % size, distinct % size
        value = np.abs(price[a[which], x] - price[b[which], y])
        for inverse in reversed(memo):
            left, right = inverse.reshape(2, -1)
            value = value[left] + value[right]
        return value


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """Prices of one segment for the pairs of sources of two blocks; rows without a term name the sources."""
    marks, cells = table.filter(pc.is_null(table["term"])).sort_by("source"), table.filter(pc.is_valid(table["term"]))
    names, blocks = marks["source"].to_pylist(), marks["block"].to_numpy()
    order = cells.select(["df", "term"]).group_by(["df", "term"]).aggregate([]).sort_by([("df", "descending"), ("term", "ascending")])
    size = marks["size"][0].as_py() if names else 0
    counts = np.zeros((len(names), size), np.int64) if size else np.full((len(names), 1), -1)
    row = pc.index_in(cells["source"], value_set=marks["source"]).to_numpy()
    counts[row, pc.index_in(cells["term"], value_set=order["term"]).to_numpy()] = cells["n"].to_numpy()
    forest = Forest(counts)
    price = np.array([[0 if c < 0 else 1 + UNIT * (c + PRIOR) // (total + PRIOR * terms) for c in forest.leaves.tolist()] for total, terms in zip(marks["total"].to_pylist(), marks["terms"].to_pylist())], np.int64)
    lang, first, second = key[0].as_py(), key[3].as_py(), key[4].as_py()
    found = []
    for i in np.flatnonzero(blocks == first):
        others = np.flatnonzero(blocks == second)
        others = others[others > i] if first == second else others
        if len(others):
            values = forest.differences(np.full(len(others), i), others, price)
            found += [(lang, *sorted((names[i], names[j])), v) for j, v in zip(others, values.tolist())]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 4, kinds)], names=["lang", "a", "b", "value"])


def source_divergence(documents: DataFrame, least_docs: int = 30, ranks: int = 50) -> DataFrame:
    """How the sources of a language differ: (lang, source, part, item, value, rank), all arithmetic exact.

    Part "pair": each other source of the language with the summed difference of smoothed probabilities over the kept
    terms; part "term": up to ``ranks`` terms that the source uses more than its language. Ties go by the bytes of the item.
    Null text, lang and source are empty; a group whose texts are null, empty or hold no kept term has rows of part
    "pair" all the same; rows that share a doc_id are documents of their own; an empty table gives an empty result. Columns
    other than text, lang and source are ignored.

    Tasks count terms before the shuffle by (lang, term), so neither a common term nor a large source is one task's work.
    Kept terms are dealt into segments by the size of their document frequency and a hash, about ``SEGMENT`` terms each, and
    sources into blocks of about ``SOURCES``; a task holds two blocks of one segment. Terms of like frequency share a
    segment, so that its trees have many equal subtrees. The pairs of sources are what is asked for.
    """
    by_term = Window.partitionBy("lang", "term")
    summed = term_counts(documents).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    summed = summed.select("lang", "source", "term", "n", F.sum("docs").over(by_term).alias("df"), F.sum("n").over(by_term).alias("lang_n"), (F.row_number().over(by_term.orderBy("source")) == 1).alias("head"))
    kept = materialise(summed.where(F.col("term").isNull() | (F.col("df") >= least_docs)).withColumn("class", F.length(F.bin("df"))), "terms")
    terms = kept.where("term is not null")
    sizes = materialise(terms.where("head").groupBy("lang", "class").agg(F.count("*").alias("size"), F.sum("lang_n").alias("n")), "classes")
    langs = sizes.groupBy("lang").agg(F.sum("size").alias("terms"), F.sum("n").alias("lang_total"))
    blocks = kept.where("term is null").groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).alias("blocks"))
    groups = kept.where("term is null").select("lang", "source").join(terms.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").join(blocks, "lang").na.fill(0, ["total", "terms", "lang_total"])
    groups = materialise(groups.withColumn("block", F.pmod(F.xxhash64("source"), "blocks")), "groups")

    rows = terms.join(few(groups), ["lang", "source"])
    value = probability(F.col("n"), F.col("total"), F.col("terms")) - probability(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    used = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).where("value > 0")
    used = used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)

    buckets = sizes.select("lang", "class", F.ceil(F.col("size") / SEGMENT).alias("buckets"))
    placed = rows.join(few(buckets), ["lang", "class"]).withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets"))
    segments = placed.where("head").groupBy("lang", "class", "bucket").agg(F.count("*").alias("size"))
    nothing = groups.select("lang", F.lit(-1).alias("class"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("size")).distinct()
    whole = segments.unionByName(nothing).join(few(groups), "lang")
    columns = ["lang", "class", "bucket", "source", "term", "n", "df", "size", "total", "terms", "block", "blocks"]
    absent = {c: F.lit(None).cast(t).alias(c) for c, t in (("term", "string"), ("n", "long"), ("df", "long"), ("size", "long"))}
    cells = placed.select([absent[c] if c == "size" else F.col(c) for c in columns]).unionByName(whole.select([F.col(c) if c not in absent or c == "size" else absent[c] for c in columns]))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    cells = cells.select("*", other).withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    priced = cells.groupBy("lang", "class", "bucket", "first", "second").applyInArrow(_compare, "lang string, a string, b string, value long")
    sums = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("side")
    pairs = sums.select("lang", "value", sides).select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(used)


SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (total + 5 * v) AS p FROM t JOIN k ON t.lang = k.lang JOIN v ON v.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
q AS (SELECT c.lang, c.term, 1 + 1000000000::HUGEINT * (sum(n) + 5) // (any_value(total) + 5 * any_value(v)) AS q FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) s USING (lang) GROUP BY c.lang, c.term),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM t a JOIN t b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.a = a.source AND s.b = b.source
UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= 50"""
