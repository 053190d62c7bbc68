"""Small fixtures for the operators: rows with nulls, empty, long and repeated texts, and clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, digest string, key int, component string"


def documents(spark, texts, first=0):
    """Documents with consecutive ids and columns whose names the operators use inside."""
    rows = [(first + i, t, "en", "s", 0, "x", "y", 1, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edge_texts(rng: random.Random) -> list:
    """Null, empty, blank, short, very long and repeated texts, near copies, and other scripts."""
    long = " ".join(words(rng, 8000))
    base = words(rng, 120)
    near = list(base)
    near[60] = "changed"
    far = words(rng, 60) + base[:60]
    return [None, "", " \n\t ", "one", "one two three", "One  two three", long, long, " ".join(base), " ".join(near), " ".join(far), " ".join(base).upper(), "日本語 テキスト ñandú Straße", "a" * 5000]
