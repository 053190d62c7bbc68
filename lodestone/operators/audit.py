"""Audit of posts: a score and a list of what to mend, by title, description, keywords and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths that a result page shows, keywords that a post needs.
TITLE_MOST, DESCRIPTION_LEAST, DESCRIPTION_MOST, KEYWORDS_LEAST = 70, 120, 180, 10
#: Words that searches look for.
YEAR, FREE, EXAMPLE, DOWNLOAD, PAID = r"\b(?:2025|2026|2027)\b", r"(?<!\p{L})бесплатн", "пример|образец|шаблон", "скачать|загрузить", r"\bpro\b|pro\s+plus|платн"
IN_WORD = r"(?<!\p{L})в\s+(?:ворд|word)|ворде"


def audit_posts(posts: DataFrame) -> DataFrame:
    """slug, score (to 100), flags and issues, the lowest score being the most urgent. ``posts``: slug, title, description, keywords, modified.

    Nulls count as empty; words are looked for in title and description, whatever their case.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = posts.select("slug", text("title").alias("title"), text("description").alias("description"), F.greatest(F.coalesce(F.size("keywords"), F.lit(0)), F.lit(0)).alias("keyword_count"), F.col("modified").isNotNull().alias("has_modified"))
    rows = rows.withColumns({"title_length": F.length("title"), "description_length": F.length("description"), "hay": F.lower(F.concat_ws(" ", "title", "description"))})
    has = {"has_year": YEAR, "has_free": FREE, "has_example": EXAMPLE, "has_word": IN_WORD, "has_download": DOWNLOAD}
    rows = rows.withColumns({name: F.col("hay").rlike(pattern) for name, pattern in has.items()})
    title, description, keywords = F.col("title_length"), F.col("description_length"), F.col("keyword_count")

    def points(good: Column, full: int, else_: int = 0) -> Column:
        return F.when(good, full).otherwise(else_)

    score = (
        points(F.col("has_year"), 20) + points(title <= TITLE_MOST, 15, 5) + points(description.between(DESCRIPTION_LEAST, DESCRIPTION_MOST), 15, 5) + points(keywords >= KEYWORDS_LEAST, 15, 5)
        + points(F.col("has_modified"), 10) + points(F.col("has_free"), 10) + points(F.col("has_example"), 10) + points(F.col("has_download"), 5)
    )
    issues = F.array(
        F.when(~F.col("has_year"), "year"), F.when(title > TITLE_MOST, F.format_string("title %d", title)), F.when(description < DESCRIPTION_LEAST, F.format_string("description %d short", description)),
        F.when(description > DESCRIPTION_MOST, F.format_string("description %d long", description)), F.when(keywords < KEYWORDS_LEAST, F.format_string("keywords %d", keywords)), F.when(~F.col("has_modified"), "modified"),
        F.when(~F.col("has_free") & ~F.col("hay").rlike(PAID), "free"), F.when(~F.col("has_example"), "example"),
    )
    return rows.select("slug", score.alias("score"), "title_length", "description_length", "keyword_count", *has, "has_modified", F.array_compact(issues).alias("issues"))
