"""Text repair, normalisation and measurement as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = "\u00a0"


def guarded(x: Column, may: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` only where the cheaper test ``may`` holds; both see the text as one value, so it is computed once."""
    return F.transform(F.array(x), lambda t: F.when(may(t), change(t)).otherwise(t))[0]


def collapse_spaces(x: Column) -> Column:
    return guarded(x, lambda t: F.contains(t, F.lit("  ")), lambda t: F.regexp_replace(t, " {2,}", " "))


def fix_double_dots(x: Column) -> Column:
    """Two dots become one; an ellipsis stays."""
    return guarded(x, lambda t: F.contains(t, F.lit("..")), lambda t: F.regexp_replace(t, r"(?<!\.)\.\.(?!\.)", "."))


def strip_leading(x: Column) -> Column:
    return F.regexp_replace(x, r"^[ \t]+", "")


#: Abbreviations and their long forms, in the order in which they are expanded (fixed values).
ABBREVIATIONS = {
    "т.д.": "так далее",
    "т.п.": "тому подобное",
    "т.е.": "то есть",
    "т.к.": "так как",
    "т.н.": "так называемый",
    "т.о.": "таким образом",
    "т.с.": "так сказать",
    "т.ч.": "так что",
    "г.о.": "главным образом",
    "д.б.": "должно быть",
    "м.б.": "может быть",
    "и др.": "и другие",
}
#: Units that a number isn't parted from, as alternatives of a pattern, in their order (fixed values).
UNITS = r"мм|см|дм|км|кг|мг|мл|мин|кВт|Вт|Гц|Па|МПа|дБ|об/мин|м|г|л|с|ч|т|А|В|К|%|p\.|pp\.|pages?|с\.|стр\."


def either_case(text: str) -> str:
    """Pattern of a fixed text in either case; spelled out, as matching by Unicode's case rules is much slower."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else rf"\{c}" if c == "." else c for c in text)


def abbreviation(short: str) -> str:
    """Pattern of an abbreviation in either case, with or without a blank after its inner dots."""
    head, dot, rest = short.partition(".")
    return either_case(head + dot) + (f" ?{either_case(rest)}" if rest else "")


def expand_abbreviations(x: Column, words: Mapping[str, str] = ABBREVIATIONS) -> Column:
    """All abbreviations in one pass from left to right; where several could begin, the first of ``words``."""
    starts = "".join(sorted({c for short in words for c in (short[0].lower(), short[0].upper())}))
    seconds = "".join(sorted({either_case(short[1]) for short in words}))
    pattern = f"(?=[{starts}][{seconds}])(?:" + "|".join(map(abbreviation, words)) + ")"  # few places pass the first look
    long = F.create_map(*[F.lit(s) for pair in words.items() for s in pair])

    def expand(t: Column) -> Column:
        full = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: long[F.replace(F.lower(m), F.lit(". "), F.lit("."))])
        return F.array_join(F.zip_with(F.split(t, pattern), full, lambda piece, word: F.concat(piece, F.coalesce(word, F.lit("")))), "")

    return guarded(x, lambda t: t.rlike(pattern), expand)


def nbsp_before_units(x: Column, units: str = UNITS) -> Column:
    """A no-break space between a number and one of the units (alternatives of a pattern)."""
    return guarded(x, lambda t: t.rlike(r"[0-9]\s"), lambda t: F.regexp_replace(t, rf"(?iu)([0-9])\s+({units})(?=[\s.,;:!?\-)}}\]]|\z)", f"$1{NBSP}$2"))


def nbsp_after_initials(x: Column) -> Column:
    """No-break spaces between initials, and between them and the surname, in both alphabets."""

    def bind(t: Column) -> Column:
        for big, small in (("А-ЯЁ", "а-яё"), ("A-Z", "a-z")):
            t = F.regexp_replace(t, rf"([{big}])\.\s+([{big}])\.", f"$1.{NBSP}$2.")
            t = F.regexp_replace(t, rf"([{big}])\.\s+([{big}][{small}]+)", f"$1.{NBSP}$2")
        return t

    return guarded(x, lambda t: t.rlike(r"[А-ЯЁA-Z]\.\s+[А-ЯЁA-Z]"), bind)


def quotes_and_dashes(x: Column) -> Column:
    quoted = guarded(x, lambda t: F.contains(t, F.lit('"')), lambda t: F.regexp_replace(t, '"([^"]+)"', "«$1»"))
    return F.translate(quoted, "—", "–")


def repair(x: Column) -> Column:
    """All fixes of a paragraph in their fixed order."""
    x = fix_double_dots(collapse_spaces(strip_leading(x)))
    return quotes_and_dashes(nbsp_after_initials(nbsp_before_units(expand_abbreviations(x))))


def encode_entities(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def decode_entities(x: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def normalise_heading(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def list_type(x: Column) -> Column:
    return F.when(x.rlike(r"^\s*[-•*–] "), "bullet").when(x.rlike(r"^\s*[a-z]\) "), "latin").when(x.rlike(r"^\s*[0-9]+[.)] "), "digit")


def truncate_half(x: Column) -> Column:
    """The first half, cut at a word's end, with an ellipsis; short texts stay."""
    left = F.substring(x, F.lit(1), F.ceil(F.length(x) / 2).cast("int"))
    cut = F.regexp_extract(left, r"(?s)^(.*)\s\S*$", 1)
    return F.when(F.length(x) < 20, x).otherwise(F.concat(F.when(cut != "", cut).otherwise(left), F.lit("…")))


def mask(x: Column, patterns: Mapping[str, str]) -> Column:
    """Each pattern's matches by its tag, in the given order."""
    for tag, pattern in patterns.items():
        x = F.regexp_replace(x, pattern, f"[{tag}]")
    return x


#: Personal data and what stands for it, in the order in which it is masked.
PERSONAL = [
    (r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "[email]"),
    (r"(?:\+7|8)[\s\-()]*[0-9][0-9\s\-()]{8,}", "[phone]"),
    (r"\b[0-9]{4}\s?[0-9]{6}\b", "[passport]"),
    (r"\b[0-9]{3}-[0-9]{3}-[0-9]{3}\s?[0-9]{2}\b", "[snils]"),
    (r"(?iu)\bИНН[\s:]*[0-9]{10,12}\b", "ИНН [inn]"),
    (r"\b[А-ЯЁ][а-яё]+\s+[А-ЯЁ]\.\s?[А-ЯЁ]\.\s?", "[ФИО] "),
    (r"\b[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+\b", "[ФИО]"),
]


def mask_personal(x: Column) -> Column:
    """Mail, phone, passport, insurance and tax numbers and names replaced, in this order; a letter or digit beside a word is no boundary."""
    for pattern, by in PERSONAL:
        x = F.regexp_replace(x, pattern, by.replace("[", "\\["))
    return x


def is_numeric_cell(x: Column) -> Column:
    return F.trim(x).rlike(r"^[-+]?[0-9][0-9 .,]*%?$")


def pipe_row(cells: Column, width: int) -> Column:
    """Cells as a table row, padded to a width, with bars escaped."""
    padded = F.concat(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), F.greatest(F.lit(width) - F.size(cells), F.lit(0))))
    return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))


def json_in(x: Column) -> Column:
    """The outermost braces of a noisy text, or null if they hold no JSON."""
    inner = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(F.get_json_object(inner, "$").isNotNull(), inner)
