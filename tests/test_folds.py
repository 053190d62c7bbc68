"""Section matching, heading merge and renumbering: brute force and one fixture per branch."""

import random
import re

from lodestone.operators import folds

SECTIONS = [folds.Section("Введение"), folds.Section("Заключение", ["Выводы"]), folds.Section("Список источников", ["Литература"], ["СПИСОК", "ИСТОЧНИК|ЛИТЕРАТУР"]), folds.Section("Выводы"), folds.Section("Итог", ["Результаты"])]


def by_loops(lines):
    norm = lambda t: re.sub(r"[.,:;!?\s]+", " ", t).strip().lower()
    heads = [(i, t) for i, t, h in lines if h and t.strip()]
    shorts = [t for _, t, _ in lines if 0 < len(t.strip()) <= 80 and "." not in t]
    used, out = set(), []
    for s in SECTIONS:
        names = [norm(n) for n in (s.canonical, *s.synonyms)]
        betrayed = lambda t: bool(s.keywords) and all(re.search(k, t.upper()) for k in s.keywords)  # noqa: B023, E731
        free = [(i, t) for i, t in heads if i not in used]
        place = next((i for i, t in free if norm(t) in names or any(len(n) >= 6 and n in norm(t) for n in names)), None)
        if place is None and any(norm(t) in names for t in shorts):
            place = -1
        if place is None:
            place = next((i for i, t in free if betrayed(t)), None)
        if place is None and any(betrayed(t) for t in shorts):
            place = -1
        if place is not None:
            used.add(place)
        out.append((s.canonical, place is not None, place))
    return out


def test_sections_equal_brute_force(spark):
    rng = random.Random(3)
    titles = ["Введение", "1. ВВЕДЕНИЕ", "Заключение и выводы", "Выводы", "Итог.", "Итоги", "Список важной литературы", "Список источников", "литература", "Другое", "", "x" * 90]
    docs = {d: [(i, rng.choice(titles), rng.random() < 0.5) for i in range(rng.randrange(1, 8))] for d in range(120)}
    lines = spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in rows], "doc_id long, idx int, text string, heading boolean")
    got = {}
    for r in folds.match_sections(lines, SECTIONS).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.present, r.place)
    assert got == {d: {s: (p, at) for s, p, at in by_loops(rows)} for d, rows in docs.items()}


def merged(spark, *lines):
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(lines)], "doc_id long, idx int, type string, text string")
    return [(r.idx, r.text, r.merged) for r in folds.merge_headings(df).orderBy("idx").collect()]


def test_heading_merge_by_branch(spark):
    h, b = ("heading_1", "Анализ"), "body_text"
    assert merged(spark, h, (b, "и синтез"), ("unknown", "данных"), (b, "Текст")) == [(0, "Анализ и синтез данных", 2), (3, "Текст", 0)]
    assert merged(spark, h, (b, ""), (b, "и синтез"), (b, "Текст")) == [(0, "Анализ и синтез", 1), (3, "Текст", 0)]  # one blank
    assert len(merged(spark, h, (b, ""), (b, " "), (b, "и синтез"))) == 4  # two blanks
    assert merged(spark, h, (b, "и синтез"), (b, ""), (b, "Текст")) == [(0, "Анализ и синтез", 1), (2, "", 0), (3, "Текст", 0)]  # trailing blanks stay
    assert len(merged(spark, ("heading_1", "Анализ."), (b, "и синтез"))) == 2
    assert len(merged(spark, h, (b, "и синтез."), (b, "и ещё"))) == 2  # the sentence ended
    assert len(merged(spark, h, ("list_item", "и синтез"))) == 2
    assert len(merged(spark, h, (b, "и синтез [1]"))) == 2 and len(merged(spark, h, (b, "в " + "x" * 120))) == 2
    assert len(merged(spark, h, (b, "Синтез"))) == 2 and merged(spark, ("heading_2", "АНАЛИЗ"), (b, "Синтез")) == [(0, "АНАЛИЗ Синтез", 1)]
    assert merged(spark, h, ("heading_2", "и раздел"), (b, "для всех")) == [(0, "Анализ", 0), (1, "и раздел для всех", 1)]
    assert len(merged(spark, (b, "начало"), (b, "и конец"))) == 2 and len(merged(spark, ("heading_1", ""), (b, "и конец"))) == 2


def renumbered(spark, *lines):
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(lines)], "doc_id long, idx int, type string, text string")
    return [r.text for r in folds.renumber_captions(df).orderBy("idx").collect()]


def test_captions_and_references_move_together(spark):
    f, t, b = "figure_caption", "table_caption", "body_text"
    got = renumbered(spark, (b, "На рисунке 3 и рис. 1, табл. 5, рисунок 9."), (f, "Рис. 3 – один"), (f, "Рисунок 1 два"), (t, "Табл. № 5. Данные"), (t, "Таблица 2."), ("heading_1", "О рис. 3"))
    assert got == ["На рисунке 1 и рисунок 2, таблица 1, рисунок 9.", "Рисунок 1 – один", "Рисунок 2 два", "Таблица 1 – Данные", "Таблица 2", "О рис. 3"]


def test_numbers_swap_without_a_chain_and_the_last_duplicate_wins(spark):
    f, b = "figure_caption", "body_text"
    assert renumbered(spark, (f, "Рисунок 2 a"), (f, "Рисунок 1 b"), (b, "см. рисунок 1, рисунок 2, рисунок 1.5"))[2] == "см. рисунок 2, рисунок 1, рисунок 1.5"
    assert renumbered(spark, (f, "Рисунок 7 a"), (f, "Рисунок 7 b"), (b, "на рисунок 7")) == ["Рисунок 2 a", "Рисунок 2 b", "на рисунок 2"]


def test_documents_in_order_stay_and_other_words_are_left(spark):
    same = [("figure_caption", "Рисунок 1 x"), ("body_text", "рисунок 1"), ("table_caption", "Таблица 1 – y")]
    assert renumbered(spark, *same) == [x for _, x in same]
    assert renumbered(spark, ("body_text", "барис 1, рис 2"), ("figure_caption", "Рис. 1")) == ["барис 1, рисунок 2", "Рисунок 1"]
    assert renumbered(spark, (None, "Рисунок 4 x"), ("quote", "см. рисунок 4"), ("unknown", "рисунок 4")) == ["Рисунок 1 x", "см. рисунок 1", "рисунок 1"]  # told by its words


def titled(spark, *lines):
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(lines)], "doc_id long, idx int, type string, text string")
    return [r.type.removeprefix("title_page_") for r in folds.relabel_title_page(df).orderBy("idx").collect()]


def test_title_pages(spark):
    b, h = "body_text", ("heading_1", "Введение")
    page = [(b, "Министерство образования"), (b, "Группа 1"), ("list_item", "x"), (b, "т" * 50), (b, " "), (b, "Дата: ____"), (b, "(ФИО)"), (b, "Москва 2026")]
    assert titled(spark, *page, h, (b, "text")) == ["header", "info", "list_item", "title", b, "annotation", "annotation", "footer", "heading_1", b]
    assert titled(spark, *page) == [t for t, _ in page]  # no heading
    assert titled(spark, h, *page)[1:] == [t for t, _ in page] and titled(spark, (b, "one"), h) == [b, "heading_1"]
    assert titled(spark, ("title_page", "x"), *page, h)[1:-1] == [t for t, _ in page]  # labelled already
    assert titled(spark, (b, "first"), (b, "last"), ("bibliography_title", "x")) == ["title_page", "title_page", "bibliography_title"]
    assert titled(spark, *[(b, "x")] * 12, h) == ["title_page", *["info"] * 8, "title_page", b, b, "heading_1"]
