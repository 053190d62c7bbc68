"""Relational operators: anti and range joins, first touch, upserts, quotas, histograms, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def half_up(x: Column, digits: int = 0) -> Column:
    """Round halves towards plus infinity, as ``floor(x + 0.5)`` does."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def percent_label(part: Column, whole: Column) -> Column:
    """``N%``, and ``0%`` without a whole."""
    return F.when(whole > 0, F.concat(half_up(100 * part / whole).cast("string"), F.lit("%"))).otherwise(F.lit("0%"))


def or_default(x: Column, default: str) -> Column:
    """Null and the empty string count as missing."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def keep_latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Old rows, and of the new ones the first of each key that the old lack."""
    return old.unionByName(keep_latest(new, keys, *order).join(old.select(*keys), list(keys), "left_anti"))


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Of each key the last new row, or else the old one."""
    last = keep_latest(new, keys, *order)
    return last.unionByName(old.join(last.select(*keys), list(keys), "left_anti"))


def admit_by_quota(events: DataFrame, key: str, quota: Column, *order: Column) -> DataFrame:
    """Each event's running number within its key, whether the quota admits it, and what then remains (-1: refused)."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = events.withColumn("nth", F.row_number().over(w).cast("long"))
    admitted = F.col("nth") <= quota
    return numbered.withColumn("admitted", admitted).withColumn("remaining", F.when(admitted, quota - F.col("nth")).otherwise(F.lit(-1)).cast("long"))


def without_recent(left: DataFrame, right: DataFrame, key: str, right_ts: str, since: Column) -> DataFrame:
    """Left rows whose key has no right row at or after ``since``."""
    return left.join(right.where(F.col(right_ts) >= since).select(key), key, "left_anti")


def fixed_histogram(df: DataFrame, value: str, domain: Sequence[int]) -> DataFrame:
    """A row per value of the domain, also for those that don't occur."""
    counts = df.groupBy(F.col(value).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    values = df.sparkSession.range(min(domain), max(domain) + 1).select(F.col("id").cast("int").alias("bucket"))
    return values.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


#: Weights of severities in a quality score.
SEVERITY_WEIGHT = {"critical": 10, "major": 5, "minor": 2}


def weighted_scores(checks: DataFrame) -> DataFrame:
    """Score per category and over all (category null): weight of what passed per weight of all, 100 if there is none."""
    weight = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in SEVERITY_WEIGHT.items()], F.lit(0))
    sums = checks.withColumn("w", weight).rollup("category").agg(F.count("*").alias("total"), F.count_if("passed").alias("n_passed"), F.sum("w").alias("w_all"), F.coalesce(F.sum(F.when(F.col("passed"), F.col("w"))), F.lit(0)).alias("w_ok"))
    return sums.select("category", "total", "n_passed", F.when(F.col("w_all") > 0, half_up(100 * F.col("w_ok") / F.col("w_all"))).otherwise(F.lit(100)).cast("long").alias("score"))


def top_groups(df: DataFrame, keys: Sequence[str], position: str, k: int) -> DataFrame:
    """The k largest groups; of equal ones those that were seen first come first."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(position).alias("first_seen")).orderBy(F.desc("n"), "first_seen", *keys).limit(k)
