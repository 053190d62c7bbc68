"""Quality rules with robust multivariate outlier detection (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .shingles import mix, word_hashes

#: Base rules: fewest words, and the largest percentage of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"

#: Statistics of a vector, each with the standard deviation that is added to what the estimate finds. The central half
#: of a group often agrees in a statistic (no symbols, no repeats); without a floor any other value would be infinitely far.
FLOORS = {"log_word_length": 0.08, "symbols": 0.03, "repeats": 0.1, "log_dup_lines": 0.5, "punctuation": 0.03, "capitals": 0.04}
P = len(FLOORS)
#: Vectors are kept as whole multiples of 1/SCALE, so that sums don't depend on the order of rows.
SCALE = 4096
#: Rows that a language and source needs for an estimate of its own.
LEAST_ROWS = 60
#: Share of a group's rows that the estimate is made from.
CORE = 0.5
#: Concentration steps, and starts of which the one with the least determinant counts.
STEPS, STARTS = 6, 2
#: Quantile of chi-square with 6 degrees of freedom at 1 - 1e-7: beyond it a document is rejected.
CUTOFF = 43.34
#: Histogram buckets per octave of squared distance.
FINE = 16

STATS = "doc_id long, group string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, q array<long>"

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_IS_INNER = (np.arange(256) & 0xC0) == 0x80
_IS_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_IS_PUNCTUATION = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_SECOND, _THIRD = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def counts(text: bytes | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, punctuation and capitals (the last two: ASCII)."""
    text = text or b""
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = word_hashes(text, fold=False)
    repeated = 0
    if len(words) > 3:
        windows = mix(words[:-2] + mix(words[1:-1] * _SECOND + mix(words[2:] * _THIRD)))
        _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
        again = times[back] > 1
        mark = np.zeros(len(words), bool)
        for k in range(3):
            mark[k : len(words) - 2 + k] |= again
        repeated = int(mark.sum())
    seen: set[bytes] = set()
    doubles = 0
    for line in text.split(b"\n"):
        if line in seen:
            doubles += 1
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    return len(words), int(by_byte[~_IS_SPACE & ~_IS_INNER].sum()), int(by_byte[_IS_SYMBOL].sum()), doubles, repeated, int(by_byte[_IS_PUNCTUATION].sum()), int(by_byte[_IS_CAPITAL].sum())


def vector(words: int, chars: int, symbols: int, doubles: int, repeated: int, punctuation: int, capitals: int) -> list[int]:
    """The transformed statistics in the order of ``FLOORS``, in units of 1/SCALE: logarithms of sizes, arcsines of shares."""
    share = lambda k: float(np.arcsin(np.sqrt(min(1.0, k / max(chars, 1)))))
    x = (np.log(max(chars, 1) / max(words, 1)), share(symbols), repeated / max(words, 1), np.log1p(doubles), share(punctuation), share(capitals))
    return [round(float(v) * SCALE) for v in x]


def statistics(documents: DataFrame) -> DataFrame:
    """Base counts and the transformed vector of each document; ``group`` names its language and source."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = list(zip(*found)) if found else [[]] * 7
            failed = [c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT_PERCENT * c[0] for c in found]
            arrays = [batch.column("doc_id"), batch.column("group"), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(failed, pa.bool_()), pa.array([vector(*c) for c in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "group", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "q"])

    group = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}).alias("group")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), group, "text").mapInArrow(measure, STATS)


def distance(mean: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance of the columns q0.. to ``mean`` under the inverse covariance, given row by row."""
    off = [F.col(f"q{i}") / SCALE - mean[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + off[i] * off[j] * inverse[i * P + j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


ESTIMATE = "group string, start int, n long, log_det double, mean array<double>, inverse array<double>, final_inverse array<double>"
_SUMS = [f"s{i}" for i in range(P)] + [f"s{i}_{j}" for i in range(P) for j in range(i, P)]


def concentrate(rows: pd.DataFrame) -> pd.DataFrame:
    """From a group's histogram over distances, the estimate from the buckets that hold its central rows."""
    rows = rows.sort_values("bucket")
    reached = rows["n"].cumsum().to_numpy()
    n = int(reached[-1])
    last = int(np.searchsorted(reached, CORE * n))
    core = rows.iloc[: last + 1]
    h = int(core["n"].sum())
    sums = {k: float(core[k].sum()) for k in _SUMS}
    mean = np.array([sums[f"s{i}"] / h / SCALE for i in range(P)])
    cov = np.empty((P, P))
    for i in range(P):
        for j in range(i, P):
            cov[i, j] = cov[j, i] = sums[f"s{i}_{j}"] / h / SCALE**2 - mean[i] * mean[j]
    floor = np.diag(np.square(list(FLOORS.values())))
    _, log_det = np.linalg.slogdet(cov + floor / 100)
    inverse = np.linalg.inv(cov + floor / 100)
    # The core's spread is less than the group's; under normality its middle half has this share of the variance.
    final = np.linalg.inv(cov / SPREAD_OF_CORE + floor)
    return pd.DataFrame({"group": [rows["group"].iloc[0]], "start": [int(rows["start"].iloc[0])], "n": [n], "log_det": [log_det], "mean": [mean.tolist()], "inverse": [inverse.ravel().tolist()], "final_inverse": [final.ravel().tolist()]})


#: P(chi-square with 8 degrees < median with 6) / P(chi-square with 6 degrees < its median): the consistency factor.
SPREAD_OF_CORE = 0.5604


def sums_by_bucket(rows: DataFrame, bucket: Column) -> DataFrame:
    """Count, sums and sums of products of each group and start in each bucket of distance; partial sums go ahead. Products
    are whole numbers, so their sums in doubles are exact in groups of up to 1e8 rows, and never overflow."""
    products = [F.sum((F.col(f"q{i}") * F.col(f"q{j}")).cast("double")).alias(f"s{i}_{j}") for i in range(P) for j in range(i, P)]
    return rows.groupBy("group", "start", bucket.alias("bucket")).agg(F.count("*").alias("n"), *[F.sum(f"q{i}").alias(f"s{i}") for i in range(P)], *products)


def estimates(vectors: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates of each group of ``vectors`` (group, doc_id, q0..).

    One start takes the rows nearest to the coordinates' medians, in units of their median deviations' order; the others
    take a tenth of the rows by hash. Each concentration step is one aggregation of all rows: squared distances fall in
    narrow buckets per group, and the buckets that hold the central half give the next mean and covariance. A group of
    any size is summed by all tasks; only a histogram of bounded length meets in one. The start of least determinant wins.
    """
    medians = vectors.groupBy("group").agg(*[F.percentile_approx(f"q{i}", 0.5, 10000).alias(f"m{i}") for i in range(P)])
    near = sum(((F.col(f"q{i}") - F.col(f"m{i}")) / SCALE / f) * ((F.col(f"q{i}") - F.col(f"m{i}")) / SCALE / f) for i, f in enumerate(FLOORS.values()))
    log_bucket = lambda d: F.floor(F.log2(d + F.lit(2.0**-20)) * FINE).cast("int")
    first = sums_by_bucket(vectors.join(medians, "group").withColumn("start", F.lit(0)), log_bucket(near))
    for start in range(1, STARTS):
        drawn = F.when(F.pmod(F.xxhash64("doc_id", F.lit(start)), F.lit(10)) == 0, 0).otherwise(1)
        first = first.unionByName(sums_by_bucket(vectors.withColumn("start", F.lit(start)), drawn))
    found = materialise(first.groupBy("group", "start").applyInPandas(concentrate, ESTIMATE), "estimates")
    for _ in range(STEPS):
        step = sums_by_bucket(vectors.join(found.select("group", "start", "mean", "inverse"), "group"), log_bucket(distance(F.col("mean"), F.col("inverse"))))
        after = materialise(step.groupBy("group", "start").applyInPandas(concentrate, ESTIMATE), "estimates")
        discard(found)
        found = after
    return found.groupBy("group").agg(F.min_by(F.struct("n", "mean", "final_inverse"), F.struct("log_det", "start")).alias("x")).select("group", "x.*")


def quality_verdicts(documents: DataFrame) -> DataFrame:
    """Base counts, base_failed and kept for each row of ``documents`` (doc_id, text, lang, source).

    Words are maximal runs without ASCII white space, counted over the whole text. ``base_failed``: fewer than 50 words,
    or more than half of them in repeated 3-word windows. Of the others, ``kept`` is false where the squared Mahalanobis
    distance of the transformed statistics to the robust estimate for the row's language and source exceeds ``CUTOFF``.
    Groups with fewer than ``LEAST_ROWS`` passing rows are estimated together, per language and then all; what is still
    less has no estimate and stays. Length is no statistic, so neither short nor long documents are rejected for it.

    A null text has no words and fails; null language and source are groups like any other; rows with null doc_id and
    repeated rows are judged each on its own. An empty table gives an empty result; other columns are ignored.
    """
    stats = materialise(statistics(documents), "statistics")
    passing = stats.where("not base_failed").select("doc_id", "group", *[F.col("q")[i].alias(f"q{i}") for i in range(P)])
    language = F.to_json(F.struct(F.get_json_object("group", "$.lang").alias("lang")), {"ignoreNullFields": "false"})
    sizes = passing.groupBy("group").agg(F.count("*").alias("n")).withColumn("wider", F.when(F.col("n") >= LEAST_ROWS, F.col("group")).otherwise(language))
    wider = sizes.groupBy("wider").agg(F.sum("n").alias("n_wider"))
    names = materialise(sizes.join(wider, "wider").select("group", F.when(F.col("n_wider") >= LEAST_ROWS, F.col("wider")).otherwise(F.lit("all")).alias("pooled")), "names")
    vectors = materialise(passing.join(names, "group").drop("group").withColumnRenamed("pooled", "group"), "vectors")
    found = materialise(estimates(vectors).where(F.col("n") >= LEAST_ROWS), "estimates")
    discard(vectors)
    judged = stats.join(names, "group", "left").select("*", *[F.col("q")[i].alias(f"q{i}") for i in range(P)])
    judged = judged.join(found.select(F.col("group").alias("pooled"), "mean", "final_inverse"), "pooled", "left")
    near = F.coalesce(distance(F.col("mean"), F.col("final_inverse")) <= CUTOFF, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"))
