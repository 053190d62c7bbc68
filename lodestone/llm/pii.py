"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame functions only (operator 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, fresh, materialise

#: Kinds in the order of reports. Possessive quantifiers and look-behinds give the same matches as the plain patterns,
#: in time linear in the text.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What a pattern may discover: white-space separated tokens with a digit or an at sign, and numbers in groups.
CANDIDATES = {
    "token": r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+",
    "run": r"(?<![\p{L}\p{N}])(?:\+\x20?)?\(?[0-9]++(?:[\x20().-]{1,3}[0-9]++)++(?![\p{L}\p{N}])",
}
#: Rounds of bootstrapping; distinct seeds that a pattern needs; confidence from which its other instances are seeds too.
ROUNDS, LEAST_SEEDS, CONFIDENT = 3, 3, 0.6
#: Characters in a value that may be discovered.
LEAST_CHARS = 6


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether 13 to 19 digits have a valid check digit."""
    digits = F.reverse(_digits(value))
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return n.between(13, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(19)), F.lit(1))), F.lit(0), add) % 10 == 0)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches of a pattern: value, the words beside it, and the ``gap`` of characters
    since the match before. The texts between the matches come from ``split``."""

    def describe(m: Column) -> Column:
        def one(i: Column) -> Column:
            gap = F.element_at(m["gaps"], i)
            left = F.reverse(F.regexp_extract(F.reverse(gap), r"^\s*+(\S++)", 1))
            right = F.regexp_extract(F.element_at(m["gaps"], i + 1), r"^\s*+(\S++)", 1)
            return F.struct(F.length(gap).cast("long").alias("gap"), F.element_at(m["found"], i).alias("value"), left.alias("left"), right.alias("right"))

        return F.transform(F.sequence(F.lit(1), F.size(m["found"])), one)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern).alias("gaps"))
    none = F.array().cast("array<struct<gap: long, value: string, left: string, right: string>>")
    return F.when(text.rlike(pattern), F.transform(F.array(both), describe)[0]).otherwise(none)


def raw_spans(documents: DataFrame) -> DataFrame:
    """From one scan: doc_id, text_key, kind, start, end, value, left and right of all valid base spans and candidates.

    Places are running sums over the matches of a row and kind, in code points, end exclusive.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), matches(F.col("text"), p).alias("m")) for k, p in (KINDS | CANDIDATES).items()])
    some = documents.where(F.col("text").rlike("[0-9@]")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), F.explode(kinds).alias("x"))
    each = some.select("row", "doc_id", "text_key", "x.kind", F.posexplode("x.m").alias("at", "m")).select("row", "doc_id", "text_key", "kind", "at", "m.*")
    n = F.length("value").cast("long")
    end = F.sum(F.col("gap") + n).over(Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    placed = each.select("doc_id", "text_key", "kind", (end - n).alias("start"), end.alias("end"), "value", "left", "right")
    passing = F.lit(True)
    for kind in KINDS:
        passing = passing & ((F.col("kind") != kind) | valid(kind, F.col("value")))
    return placed.where(passing)


def shape(value: Column) -> Column:
    """A value's format: runs of letters, of digits with their length class, and all else as it is."""
    letters = F.regexp_replace(value, r"\p{L}+", "a")
    return F.regexp_replace(F.regexp_replace(letters, "[0-9]{5,}", "99"), "[0-9]{1,4}", "9")


def coarse(value: Column) -> Column:
    """A value's format class: whether it has an at sign, letters, a plus, and about how many digits."""
    has = lambda p, mark: F.when(value.rlike(p), F.lit(mark)).otherwise(F.lit(""))
    return F.concat(F.lit("~"), has("@", "@"), has(r"\p{L}", "a"), has(r"^\+", "+"), F.floor(F.length(_digits(value)) / 4).cast("string"))


def edges(spans: DataFrame) -> DataFrame:
    """Lexical patterns of each span: the word to its left or right, or both, with the value's format; both words also
    with its format class."""
    form = shape(F.col("value"))
    left, right = F.lower(F.col("left")), F.lower(F.col("right"))
    both = (left != "") & (right != "")
    found = F.array(
        F.when(left != "", F.concat_ws("\t", F.lit("L"), left, form)),
        F.when(right != "", F.concat_ws("\t", F.lit("R"), right, form)),
        F.when(both, F.concat_ws("\t", F.lit("B"), left, right, form)),
        F.when(left.rlike("[:=#]$"), F.concat_ws("\t", F.lit("L"), left, coarse(F.col("value")))),
        F.when(both, F.concat_ws("\t", F.lit("B"), left, right, coarse(F.col("value")))),
    )
    return spans.select("value", F.explode(F.array_compact(found)).alias("pattern")).distinct()


def trimmed(spans: DataFrame) -> DataFrame:
    """Candidates without the punctuation around them, with places to match."""
    head = F.regexp_replace("value", r"^[^\p{L}\p{N}+]++", "")
    value = F.reverse(F.regexp_replace(F.reverse(head), r"^[^\p{L}\p{N}]++", ""))
    return spans.withColumns({"start": F.col("start") + F.length("value") - F.length(head), "value": value}).withColumn("end", F.col("start") + F.length("value"))


def all_spans(documents: DataFrame) -> DataFrame:
    """Base spans and those that high-confidence patterns find beside them: doc_id, text_key, kind, start, end, base.

    Values of base spans are the first seeds, with score 1 for their kind. In each round a pattern's confidence for a
    kind is the sum of its seeds' scores over the number of its distinct instances plus one. Patterns with at least
    ``LEAST_SEEDS`` seeds and a confidence of ``CONFIDENT`` are held: their other instances become seeds with the best
    such confidence as score, so the next round may hold patterns in which no base span ever stood. What the last round
    has as seeds is found, wherever it stands. Edges are distinct pairs of pattern and value, grouped with partial
    aggregation; nothing of the graph reaches the driver.
    """
    raw = materialise(raw_spans(documents), "raw")
    base = raw.where(F.col("kind").isin(*KINDS))
    candidates = trimmed(raw.where(~F.col("kind").isin(*KINDS))).where(F.length("value") >= LEAST_CHARS)
    b = base.select(F.col("doc_id").alias("b_id"), F.col("text_key").alias("b_key"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    # Spans that overlap share a stretch of 64 characters; a longer one lies in several.
    stretch = lambda first, end: F.explode(F.sequence(F.floor(F.col(first) / 64), F.floor((F.col(end) - 1) / 64)))
    b = b.withColumn("b_stretch", stretch("b_start", "b_end"))
    numbered = materialise(candidates.withColumn("number", F.monotonically_increasing_id()), "candidates")
    near = numbered.select("number", "doc_id", "text_key", "start", "end", stretch("start", "end").alias("stretch"))
    overlap = F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_key") == F.col("b_key")) & (F.col("stretch") == F.col("b_stretch")) & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    taken = near.join(b, overlap, "left_semi").select("number").distinct()
    free = materialise(numbered.join(taken, "number", "left_anti").drop("number"), "free")

    seeds = base.select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    graph = materialise(edges(base.select("value", "left", "right").unionByName(free.select("value", "left", "right"))), "graph")
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEDS)
    scores = materialise(seeds, "scores")
    for _ in range(ROUNDS):
        sums = graph.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("seeds")).where(F.col("seeds") >= LEAST_SEEDS)
        sure = sums.join(sizes, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("n") + 1)).alias("score")).where(F.col("score") >= CONFIDENT)
        reached = graph.join(sure, "pattern").groupBy("value", "kind").agg(F.max("score").alias("score"))
        after = materialise(scores.unionByName(reached).groupBy("value", "kind").agg(F.max("score").alias("score")), "scores")
        discard(scores)
        scores = after
    kinds = scores.groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    more = free.drop("kind").join(kinds.join(seeds.select("value"), "value", "left_anti"), "value")
    columns = ["doc_id", "text_key", "kind", "start", "end"]
    return base.select(*columns, F.lit(True).alias("base")).unionByName(more.select(*columns, F.lit(False).alias("base")))


def find_pii(documents: DataFrame) -> DataFrame:
    """The documents with ``spans``: array of (kind, start, end, base), by kind as listed, then start.

    Places are code points of the whole text, end exclusive; matches of a kind that fail its check are dropped without
    another try. Spans of different kinds may overlap. A null text has no spans. Spans of a row are found by its doc_id
    (null equals null) and a hash of its text, so repeated rows get the same spans. A column ``spans`` of the input is
    replaced, all others stay. An empty table stays empty.
    """
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    spans = F.array_sort(F.collect_set(F.struct(place.alias("place"), "start", "end", "kind", "base")))
    none = F.array().cast("array<struct<place: int, start: long, end: long, kind: string, base: boolean>>")
    return beside(documents, all_spans(documents.select("doc_id", "text")), spans, "spans", none)


def beside(documents: DataFrame, spans: DataFrame, gathered: Column, name: str, otherwise: Column) -> DataFrame:
    """The documents with ``gathered``, an aggregate over each one's spans, as column ``name``."""
    doc, key, own, made = (fresh(c, documents.columns) for c in ("f_id", "f_key", "f_own", "f_spans"))
    by_row = spans.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(gathered.alias(made))
    joined = documents.withColumn(own, F.xxhash64("text")).join(by_row, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key)), "left")
    return joined.withColumn(name, F.coalesce(made, otherwise)).drop(doc, key, made, own)


def mask_pii(documents: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; spans that overlap become one, named after the
    first. All columns but ``text`` stay as they are.

    Spans are merged by windows over those of a document. The text is cut in UTF-32, in which a place is found in
    constant time.
    """
    found = all_spans(documents.select("doc_id", "text")).select("doc_id", "text_key", "start", "end", "kind").distinct()
    order = Window.partitionBy("doc_id", "text_key").orderBy("start", F.desc("end"), "kind")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("fresh", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
    numbered = marked.withColumn("group", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc_id", "text_key", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.when(F.col("fresh") == 1, F.col("kind"))).alias("kind"))
    cuts = F.array_sort(F.collect_list(F.struct("start", "end", "kind")))
    name = fresh("f_cuts", documents.columns)
    joined = beside(documents, merged, cuts, name, F.lit(None))
    whole = F.struct(F.encode("text", "UTF-32").alias("bytes"), F.col(name).alias("cuts"), F.length("text").alias("n"))

    def pieces(w: Column) -> Column:
        def one(i: Column) -> Column:
            first = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(w["cuts"], i - 1)["end"])
            here = F.get(w["cuts"], i)
            end = F.coalesce(here["start"], w["n"].cast("long"))
            between = F.decode(F.substring(w["bytes"], (4 * first + 1).cast("int"), (4 * (end - first)).cast("int")), "UTF-32")
            return F.when(here.isNull(), between).otherwise(F.concat(between, F.lit("["), F.upper(here["kind"]), F.lit("]")))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(w["cuts"])), one), "")

    masked = F.transform(F.array(whole), pieces)[0]
    return joined.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(masked)).drop(name)
