"""Heading promotion and line repair: a literal for each rule, and nothing changes between fences."""

import pytest

from lodestone.operators import markdown


def run(spark, operator, *texts, **options):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, idx int, text string")
    rows = operator(df, **options).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(len(rows)))
    return [r.text for r in rows]


PROMOTED = {
    '1. <a id="_T1"></a>__ТЕХНОЛОГИЧЕСКАЯ часть__': "# ТЕХНОЛОГИЧЕСКАЯ часть", "\t1. **Назначение детали**": "## Назначение детали", "\t\t\t\t\t2.3 __Глубоко__": "#### Глубоко",
    "1. __ab__": "1. __ab__", "1. __не **то__": "1. __не **то__", "__Заключение__": "# Заключение", '<a id="x"></a>**Введение.**': "# Введение.", "СПИСОК ТРЕБОВАНИЕ ИСТОЧНИКОВ:": "# СПИСОК ТРЕБОВАНИЕ ИСТОЧНИКОВ:",
    "введение": "# введение", "Приложение Б": "# Приложение Б", "Глава IV. О нём": "# Глава IV. О нём", "Глава": "Глава", "1.1 Название раздела": "## 1.1 Название раздела", "2.3.4. Этап работ": "## 2.3.4 Этап работ", "__1.4\\. Этап работ": "## 1.4 Этап работ",
    "1. Параметр один": "1. Параметр один", "1. ОБЩАЯ ЧАСТЬ": "# 1 ОБЩАЯ ЧАСТЬ", "ОБЩИЕ СВЕДЕНИЯ": "# ОБЩИЕ СВЕДЕНИЯ", "ОБЩИЕ СВЕДЕНИЯ.": "ОБЩИЕ СВЕДЕНИЯ.", "ДА": "ДА", "__Жирная строка__": "__Жирная строка__", "Обычный текст": "Обычный текст",
}


def test_lines_that_are_headings_by_their_shape(spark):
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(PROMOTED)], "doc_id long, idx int, text string")
    got = {r.doc_id: r.text for r in markdown.promote_headings(df).collect()}
    assert [got[i] for i in range(len(PROMOTED))] == list(PROMOTED.values())


def test_levels_rise_where_the_first_is_missing(spark):
    assert run(spark, markdown.promote_headings, "### a", "#### b", "text") == ["# a", "## b", "text"]
    assert run(spark, markdown.promote_headings, "## a", "### b") == ["# a", "# b"]
    assert run(spark, markdown.promote_headings, "# a", "### b") == ["# a", "### b"]


def test_a_promoted_line_is_set_apart_and_fences_are_left(spark):
    assert run(spark, markdown.promote_headings, "text", "ОБЩИЕ СВЕДЕНИЯ", "", "ГЛАВА 2") == ["text", "", "# ОБЩИЕ СВЕДЕНИЯ", "", "# ГЛАВА 2"]
    fenced = ["```", "Введение", "## x", "1. __abc__", "~~~", "ГЛАВА 1"]
    assert run(spark, markdown.promote_headings, *fenced) == [*fenced[:5], "", "# ГЛАВА 1"]


@pytest.mark.parametrize("line, want", [
    (r"\(a\) b\. c\-d \$", "(a) b. c-d \\$"), ('x<A id="_Toc1"> </a>y', "xy"), ("# __TEXT__ ", "# TEXT"), ("## **_Open", "## Open"), ("## # Twice", "## Twice"), (r"a\_b\_c", "a_b_c"), ("a ____ b", "a  b"),
    ("Этап:__ дальше", "Этап: дальше"), ("(__слово", "(слово"), ("компонент__", "компонент"), ("__начало", "начало"), ("a_b", "ab"), ("a_b_c", "a_b_c"), ("__жирно__ и", "жирно и"),
])
def test_repairs_of_a_line(spark, line, want):
    assert run(spark, markdown.repair_lines, line) == [want]


def test_headings_stand_alone(spark):
    assert run(spark, markdown.repair_lines, "a", "# b", "## c", "d", "", "# e", "") == ["a", "", "# b", "", "## c", "", "d", "", "# e", ""]


def test_pictures(spark):
    images = spark.createDataFrame([(1, "a.png")], "doc_id long, name string")
    got = run(spark, markdown.repair_lines, "   ![x](media/a.png)", "![x](b.png)", "see ![y](b.png) and ![z](a.png), ![](extra-1.png)", "*image*", "Рисунок", "image 2", images=images)
    assert got == ["![x](media/a.png)", "", "see  and ![z](a.png), ![](extra-1.png)", "", "", "image 2"]


def test_nothing_changes_between_fences(spark):
    lines = ["```", r"a\_b __x", "# __y__", "![x](b.png)", "```"]
    assert run(spark, markdown.repair_lines, *lines, "x__") == [*lines, "x"]
