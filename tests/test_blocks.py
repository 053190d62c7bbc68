"""Block rules and text repairs on literal rows."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.operators import blocks

RULED = [
    ("", None, "empty"),
    (" \u00a0 ", "Heading 1", "empty"),
    ("12", None, "page_number"),
    ("12345", None, None),
    ("Anything", "Heading 3", "heading_3"),
    ("Anything", "Heading 7", None),
    ("Рисунок 4 – Схема", None, "figure_caption"),
    ("рис. 2", None, "figure_caption"),
    ("Табл. № 3 Итоги", None, "table_caption"),
    ("ВВЕДЕНИЕ", None, "heading_1"),
    ("Глава 2", None, "heading_1"),
    ("Список использованных источников", None, "bibliography_title"),
    ("Приложение Б", None, "appendix_title"),
    ("– пункт", None, "list_item"),
    ("б) пункт", None, "list_item"),
    ("12) пункт", None, "list_item"),
    ("Введение в предмет", None, None),
]


def test_ordered_rules(spark):
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(RULED)], "i int, text string, style string")
    got = {r.i: r.type for r in df.select("i", blocks.by_rule(F.col("text"), F.col("style"))["type"].alias("type")).collect()}
    assert [got[i] for i in range(len(RULED))] == [t for *_, t in RULED]


@pytest.mark.parametrize(
    ("text", "style", "want"),
    [("2.1 Методы", None, "heading_2"), ("2.1.3. Выборка", None, "heading_3"), ("3. Итоги", None, "heading_1"), ("3. " + "х" * 70, None, "list_item"), ("Таблица 1", None, "table_caption"), ("Рисунок 1", None, "figure_caption"), ("слово", "List Bullet", "list_item"), ("слово", "heading2", "heading_2"), ("слово", None, "body_text")],
)
def test_fallback_rules(spark, text, style, want):
    df = spark.createDataFrame([(text, style)], "text string, style string")
    assert df.select(blocks.fallback(F.col("text"), F.col("style"))).first()[0] == want


def in_context(spark, rows):
    df = spark.createDataFrame([(1, i, t, k) for i, (t, k) in enumerate(rows)], "doc_id long, idx int, text string, type string")
    return [r.fixed for r in blocks.validated_in_context(df).orderBy("idx").collect()]


def test_rules_of_context(spark):
    entry = ("1. Иванов И. И. Труды", "bibliography_entry")
    assert in_context(spark, [entry]) == ["body_text"]
    assert in_context(spark, [("Библиография", "bibliography_title"), ("2. Петров П.", "body_text"), ("слова", "body_text")]) == ["bibliography_title", "bibliography_entry", "body_text"]
    assert in_context(spark, [("Библиография", "bibliography_title"), entry, ("?", "unknown"), entry]) == ["bibliography_title"] + ["bibliography_entry"] * 3
    assert in_context(spark, [("a", "list_item"), ("b", "unknown"), ("c", "list_item")]) == ["list_item"] * 3
    assert in_context(spark, [("a", "toc_entry"), ("b", "body_text"), ("c", "toc"), ("d", "toc_entry")]) == ["body_text", "body_text", "toc", "toc_entry"]
    assert in_context(spark, [("a", "appendix_content"), ("Приложение А", "appendix_title"), ("b", "appendix_content"), ("Глава 2", "heading_1"), ("c", "appendix_content")]) == ["body_text", "appendix_title", "appendix_content", "heading_1", "body_text"]
    assert in_context(spark, [("x" * 201, "heading_2"), ("y" * 200, "heading_2")]) == ["body_text", "heading_2"]
    # the title comes after a chapter: entries are no longer in its list, but it was seen
    assert in_context(spark, [("Библиография", "bibliography_title"), ("Глава 2", "heading_1"), ("2. Петров П.", "body_text"), entry]) == ["bibliography_title", "heading_1", "body_text", "bibliography_entry"]


def test_rules_one_by_one(spark):
    rows = [("", None, "body_text"), ("7", None, "heading_1"), ("7", None, "toc_entry"), ("Рисунок 1", None, "body_text"), ("Рисунок 1", None, "heading_1"), ("x", "Heading 4", "body_text"), ("(проект)", None, "title_page"), ("г. Москва 2024", None, "title_page"), ("Smith J. Works", None, "bibliography_entry"), ("Иванов И. Works", None, "bibliography_entry")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "idx int, text string, style string, type string")
    got = [(r.fixed, r.language) for r in blocks.validated_one_by_one(df).orderBy("idx").collect()]
    assert [g[0] for g in got] == ["empty", "page_number", "toc_entry", "figure_caption", "heading_1", "heading_4", "title_page_annotation", "title_page_footer", "bibliography_entry", "bibliography_entry"]
    assert [g[1] for g in got[-2:]] == ["en", "ru"] and not any(g[1] for g in got[:-2])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("  \tи т. д. и Т.П..", "и так далее и тому подобное"),
        ("5 мм, 10 МПА  и 3 слова", "5\u00a0мм, 10\u00a0МПА и 3 слова"),
        ("И. И. Иванов, J. R. Smith", "И.\u00a0И.\u00a0Иванов, J.\u00a0R.\u00a0Smith"),
        ('он — "так".. но...', "он – «так». но..."),
    ],
)
def test_repairs_in_order(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(fx.repair(F.col("x"))).first()[0] == want
