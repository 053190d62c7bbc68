"""Operators over ordered rows of a document: carried flags, islands, numbering, proximity and prefix cuts.

All take a key (the document) and an order (the paragraph's place) and share one window, so one sort serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def within(key: str = "doc_id", order: str = "idx") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def so_far(key: str = "doc_id", order: str = "idx") -> WindowSpec:
    return within(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(key: str = "doc_id", order: str = "idx") -> WindowSpec:
    return within(key, order).rowsBetween(Window.unboundedPreceding, -1)


def whole(key: str = "doc_id") -> WindowSpec:
    return Window.partitionBy(key)


def carried(sets: Column, clears: Column, frame: WindowSpec) -> Column:
    """A flag that a row sets or clears for those after it."""
    return F.coalesce(F.last(F.when(sets, True).when(clears, False), ignorenulls=True).over(frame), F.lit(False))


def island(breaks: Column, frame: WindowSpec) -> Column:
    """Number of breaks up to a row: rows between breaks share it."""
    return F.sum(breaks.cast("long")).over(frame)


def number_headings(df: DataFrame, level: str, levels: int = 3) -> DataFrame:
    """Adds ``number``: 1, 1.1, 1.1.1 ...; a heading restarts the counts of deeper ones. ``level`` is null elsewhere."""
    names = []
    for depth in range(1, levels + 1):
        group, name = f"_g{depth}", f"_n{depth}"
        df = df.withColumn(group, F.sum((F.col(level) < depth).cast("long")).over(so_far()))
        deeper = Window.partitionBy("doc_id", group).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn(name, F.coalesce(F.sum((F.col(level) == depth).cast("long")).over(deeper), F.lit(0)))
        names.append(name)
    parts = F.slice(F.array(*[F.col(n).cast("string") for n in names]), F.lit(1), F.col(level))
    out = df.withColumn("number", F.when(F.col(level).isNotNull(), F.array_join(parts, ".")))
    return out.drop(*names, *[f"_g{d}" for d in range(1, levels + 1)])


def collapse_runs(df: DataFrame, empty: Column, keep: int, unless_next: Column) -> DataFrame:
    """Drops rows beyond the first ``keep`` of a run of empty ones, unless the next other row fulfils ``unless_next``."""
    df = df.withColumn("_e", empty).withColumn("_u", unless_next).withColumn("_i", island(~F.col("_e"), so_far()))
    run = Window.partitionBy("doc_id", "_i", "_e").orderBy("idx")
    after = Window.partitionBy("doc_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_rn", F.row_number().over(run)).withColumn("_next", F.last(F.when(~F.col("_e"), F.col("_u")), ignorenulls=True).over(after))
    return df.where(~F.col("_e") | (F.col("_rn") <= keep) | F.coalesce("_next", F.lit(False))).drop("_e", "_u", "_i", "_rn", "_next")


def strip_contents(df: DataFrame, head: Column, skippable: Column) -> DataFrame:
    """Drops a heading of contents and the skippable rows that follow it without a gap."""
    inside = carried(head, ~skippable, so_far())
    return df.withColumn("_in", inside).withColumn("_drop", head | (skippable & F.col("_in"))).where(~F.col("_drop")).drop("_in", "_drop")


def prefix_within(df: DataFrame, size: Column, most: int) -> DataFrame:
    """Rows while the running sum of sizes stays within ``most``; the first row stays in any case."""
    total = F.sum(size).over(so_far())
    return df.withColumn("_t", total).withColumn("_rn", F.row_number().over(within())).where((F.col("_t") <= most) | (F.col("_rn") == 1)).drop("_t", "_rn")


def near(flag: Column, back: int, ahead: int) -> Column:
    """Whether a row with the flag lies within so many rows before or after."""
    return F.max(flag.cast("int")).over(within().rowsBetween(-back, ahead)) == 1
