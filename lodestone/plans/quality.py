"""Quality reports over paragraphs whose properties are dealt by rule; the SQL deals the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality_checks as qc
from ..operators.relational import half_up
from ..sources import docx
from .catalog import Catalog, Tables
from .ordered import PARAGRAPHS, typed

catalog = Catalog()
query = catalog.query


def formatted(t: Tables) -> DataFrame:
    """Paragraphs with properties by (doc_id + idx) modulo small numbers; some are missing."""
    k = F.col("doc_id") + F.col("idx")
    return typed(t).withColumns({
        "font": F.when(k % 7 != 0, F.when(k % 5 == 0, "Arial").otherwise("Times New Roman")),
        "size": F.when(k % 6 == 0, 12.0).otherwise(14.0),
        "line": F.when(k % 4 == 0, 240).otherwise(365),
        "indent": F.when(k % 9 != 0, 700 + (k % 3) * 40),
        "alignment": F.when(k % 8 == 0, "left").when(k % 8 == 1, "center").otherwise("both"),
        "underline": k % 11 == 0,
    })


_FORMATTED = PARAGRAPHS + """, f AS (SELECT *, CASE WHEN (doc_id + idx) % 7 <> 0 THEN CASE WHEN (doc_id + idx) % 5 = 0 THEN 'Arial' ELSE 'Times New Roman' END END AS font, CASE WHEN (doc_id + idx) % 6 = 0 THEN 12.0 ELSE 14.0 END AS size, CASE WHEN (doc_id + idx) % 4 = 0 THEN 240 ELSE 365 END AS line,
CASE WHEN (doc_id + idx) % 9 <> 0 THEN 700 + ((doc_id + idx) % 3) * 40 END AS indent, CASE (doc_id + idx) % 8 WHEN 0 THEN 'left' WHEN 1 THEN 'center' ELSE 'both' END AS alignment, (doc_id + idx) % 11 = 0 AS underline, type = 'body' AND text <> '' AS body FROM p),
r AS (SELECT doc_id, idx, unnest([
{'check_id': 'text.fontFamily', 'category': 'text', 'severity': 'critical', 'e': body, 'b': font <> 'Times New Roman'},
{'check_id': 'text.fontSize', 'category': 'text', 'severity': 'critical', 'e': body, 'b': size <> 14},
{'check_id': 'text.lineSpacing', 'category': 'text', 'severity': 'critical', 'e': body, 'b': abs(line - 360) > 10},
{'check_id': 'text.firstLineIndent', 'category': 'text', 'severity': 'critical', 'e': body, 'b': coalesce(abs(indent - 709) > 57, true)},
{'check_id': 'text.alignment', 'category': 'text', 'severity': 'major', 'e': body, 'b': alignment <> 'both'},
{'check_id': 'text.multipleSpaces', 'category': 'text', 'severity': 'major', 'e': text <> '', 'b': contains(text, '  ')},
{'check_id': 'text.doubleDots', 'category': 'text', 'severity': 'minor', 'e': text <> '', 'b': regexp_matches(text, '(^|[^.])\\.\\.([^.]|$)')},
{'check_id': 'text.noUnderline', 'category': 'text', 'severity': 'major', 'e': true, 'b': underline},
{'check_id': 'headings.numbering', 'category': 'headings', 'severity': 'major', 'e': type LIKE 'heading%', 'b': NOT regexp_matches(text, '^[0-9][0-9.]*\\s')},
{'check_id': 'headings.h1Format', 'category': 'headings', 'severity': 'critical', 'e': type = 'heading_1', 'b': alignment <> 'center'},
{'check_id': 'tables.emptyCellParagraphs', 'category': 'tables', 'severity': 'minor', 'e': type = 'table', 'b': trim(text) = ''}]) AS c FROM f),
q AS (SELECT doc_id, c.check_id, c.category, c.severity, count(*) FILTER (c.e) AS n_evaluated, count(*) FILTER (c.e AND c.b) AS bad_count, coalesce((list(idx ORDER BY idx) FILTER (c.e AND c.b))[1:5], []) AS examples FROM r GROUP BY ALL)
"""


@query(_FORMATTED + "SELECT doc_id, check_id, category, severity, n_evaluated, bad_count, bad_count = 0 AS passed, examples FROM q")
def q5_q16_check_report(t: Tables) -> DataFrame:
    return qc.run_checks(formatted(t), qc.paragraph_checks(qc.Rules()))


@query(_FORMATTED + "SELECT category, count(*) AS total, count(*) FILTER (bad_count = 0) AS n_passed, CAST(floor(100.0 * coalesce(sum(w) FILTER (bad_count = 0), 0) / sum(w) + 0.5) AS BIGINT) AS score FROM (SELECT *, CASE severity WHEN 'critical' THEN 10 WHEN 'major' THEN 5 ELSE 2 END AS w FROM q) GROUP BY ROLLUP (category)")
def a16_check_scores(t: Tables) -> DataFrame:
    return qc.scores(qc.run_checks(formatted(t), qc.paragraph_checks(qc.Rules())))


@query(_FORMATTED + "SELECT check_id, count(*) FILTER (bad_count > 0) AS failing_docs, floor(1000.0 * count(*) FILTER (bad_count > 0) / count(*) + 0.5) / 10 AS pct FROM q GROUP BY 1")
def a19_top_failures(t: Tables) -> DataFrame:
    checked = qc.run_checks(formatted(t), qc.paragraph_checks(qc.Rules()))
    failing = F.count_if(~F.col("passed"))
    return checked.groupBy("check_id").agg(failing.alias("failing_docs"), half_up(100 * failing / F.count("*"), 1).alias("pct"))


@query(PARAGRAPHS + "SELECT doc_id, pct, CASE WHEN pct > 20 THEN 'critical' WHEN pct > 5 THEN 'major' ELSE 'minor' END AS severity, pct <= 5 AS passed FROM (SELECT doc_id, CAST(floor(100.0 * (sum(length(text)) - coalesce(sum(length(text)) FILTER (type <> 'caption'), 0)) / sum(length(text)) + 0.5) AS BIGINT) AS pct FROM p GROUP BY 1 HAVING sum(length(text)) > 0)")
def q29_content_loss(t: Tables) -> DataFrame:
    n = F.length("text")
    sums = typed(t).groupBy("doc_id").agg(F.sum(n).alias("o"), F.coalesce(F.sum(F.when(F.col("type") != "caption", n)), F.lit(0)).alias("f")).where("o > 0")
    pct = half_up(100 * (F.col("o") - F.col("f")) / F.col("o")).cast("long")
    return sums.select("doc_id", pct.alias("pct")).select("doc_id", "pct", qc.loss_severity(F.col("pct")).alias("severity"), (F.col("pct") <= 5).alias("passed"))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, CAST(len(string_split(text, chr(10))) AS BIGINT) AS paragraphs, length(text) - len(string_split(text, chr(10))) + 1 AS chars, CAST(1 AS BIGINT) AS centred FROM documents")
def s4_s6_docx_round_trip(t: Tables) -> DataFrame:
    read = docx.paragraphs_of(docx.documents_to_docx(t.documents), "doc_id")
    return read.groupBy("key").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("alignment") == "center").alias("centred"))


QUERIES, ORACLE_SQL = catalog.queries, catalog.sql
