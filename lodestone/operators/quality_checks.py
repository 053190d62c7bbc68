"""Rule-driven quality checks of documents: predicates over paragraphs, counted in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import weighted_scores

#: Twips per millimetre, per line and per point's half.
TWIPS_PER_MM, TWIPS_PER_LINE = 56.7, 240
#: Examples that a check keeps.
EXAMPLES = 5


@dataclass(frozen=True)
class Check:
    """What is evaluated, what of that is bad, and how much it weighs."""

    id: str
    category: str
    severity: str
    evaluated: Column
    bad: Column


@dataclass(frozen=True)
class Rules:
    """Expected values; a missing property passes."""

    font: str = "Times New Roman"
    size: float = 14.0
    line: int = 360
    indent: int = 709
    margin: int = 1134
    alignment: str = "both"


def paragraph_checks(rules: Rules) -> list[Check]:
    """Checks over paragraph rows: type, text, font, size, line, indent, alignment, underline."""
    kind, text = F.col("type"), F.col("text")
    body = (kind == "body") & (text != "")
    heading = kind.startswith("heading")
    line = F.col("line")
    return [
        Check("text.fontFamily", "text", "critical", body, F.col("font") != rules.font),
        Check("text.fontSize", "text", "critical", body, F.col("size") != rules.size),
        Check("text.lineSpacing", "text", "critical", body, F.abs(line - rules.line) > 10),
        Check("text.firstLineIndent", "text", "critical", body, F.coalesce(F.abs(F.col("indent") - rules.indent) > 57, F.lit(True))),
        Check("text.alignment", "text", "major", body, F.col("alignment") != rules.alignment),
        Check("text.multipleSpaces", "text", "major", text != "", text.rlike(" {2,}")),
        Check("text.doubleDots", "text", "minor", text != "", text.rlike(r"(^|[^.])\.\.([^.]|$)")),
        Check("text.noUnderline", "text", "major", F.lit(True), F.col("underline")),
        Check("headings.numbering", "headings", "major", heading, ~text.rlike(r"^[0-9][0-9.]*\s")),
        Check("headings.h1Format", "headings", "critical", kind == "heading_1", F.col("alignment") != "center"),
        Check("tables.emptyCellParagraphs", "tables", "minor", kind == "table", F.trim(text) == ""),
    ]


def run_checks(paragraphs: DataFrame, checks: list[Check]) -> DataFrame:
    """doc_id, check_id, category, severity, n_evaluated, bad_count, passed and up to five examples (places), per check.

    All checks of a document are counted in one aggregation with partial sums; a null predicate is not bad. Examples are
    the first few hits by row number, so no task holds all hits of a document.
    """
    hits = [c.evaluated & F.coalesce(c.bad, F.lit(False)) for c in checks]
    counts = [x for k, (c, hit) in enumerate(zip(checks, hits)) for x in (F.count_if(c.evaluated).alias(f"e{k}"), F.count_if(hit).alias(f"b{k}"))]
    named = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c.id).alias("check_id"), F.lit(c.category).alias("category"), F.lit(c.severity).alias("severity"), F.col(f"e{k}").alias("n_evaluated"), F.col(f"b{k}").alias("bad_count"), (F.col(f"b{k}") == 0).alias("passed")) for k, c in enumerate(checks)])
    counted = paragraphs.groupBy("doc_id").agg(*counts).select("doc_id", F.explode(named).alias("c")).select("doc_id", "c.*")
    bad = paragraphs.select("doc_id", "idx", F.explode(F.array_compact(F.array(*[F.when(hit, k) for k, hit in enumerate(hits)]))).alias("k"))
    first = bad.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "k").orderBy("idx"))).where(F.col("n") <= EXAMPLES)
    examples = first.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list("idx")).alias("examples"))
    none = F.array().cast("array<int>")
    return counted.join(examples, ["doc_id", "k"], "left").withColumn("examples", F.coalesce("examples", none)).drop("k")


def loss_severity(percent: Column) -> Column:
    """Losing more than a fifth of a text is critical, more than a twentieth major."""
    return F.when(percent > 20, "critical").when(percent > 5, "major").otherwise("minor")


def scores(checked: DataFrame) -> DataFrame:
    """Score per category and in all, over all documents."""
    return weighted_scores(checked)
