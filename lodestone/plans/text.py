"""Text queries over documents and pages.

The corpus has none of the defects that the fixes repair, so queries put them in by rule first; the SQL does the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators.relational import half_up
from ..sources.tables import paragraphs
from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query


def defective(t: Tables) -> DataFrame:
    """Documents with doubled blanks, doubled or tripled dots, and leading blanks, by doc_id modulo 4."""
    x, k = F.col("text"), F.col("doc_id") % 4
    made = F.when(k == 0, F.replace(x, F.lit(" "), F.lit("  "))).when(k == 1, F.replace(x, F.lit(". "), F.lit(".. "))).when(k == 2, F.replace(x, F.lit(". "), F.lit("... "))).otherwise(F.concat(F.lit(" \t "), x))
    return t.documents.withColumn("text", made)


_DEFECTIVE = "WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, ' ', '  ') WHEN 1 THEN replace(text, '. ', '.. ') WHEN 2 THEN replace(text, '. ', '... ') ELSE ' ' || chr(9) || ' ' || text END AS text FROM documents) "


@query(_DEFECTIVE + "SELECT doc_id, md5(regexp_replace(text, ' {2,}', ' ', 'g')) AS fixed, text <> regexp_replace(text, ' {2,}', ' ', 'g') AS changed FROM d")
def t1_collapse_spaces(t: Tables) -> DataFrame:
    fixed = fx.collapse_spaces(F.col("text"))
    return defective(t).select("doc_id", F.md5(fixed).alias("fixed"), (F.col("text") != fixed).alias("changed"))


@query(_DEFECTIVE + r"SELECT doc_id, md5(regexp_replace(text, '(^|[^.])\.\.([^.]|$)', '\1.\2', 'g')) AS fixed FROM d")
def t2_double_dots(t: Tables) -> DataFrame:
    return defective(t).select("doc_id", F.md5(fx.fix_double_dots(F.col("text"))).alias("fixed"))


@query(_DEFECTIVE + "SELECT doc_id, md5(ltrim(text, ' ' || chr(9))) AS fixed FROM d")
def t3_strip_leading(t: Tables) -> DataFrame:
    return defective(t).select("doc_id", F.md5(fx.strip_leading(F.col("text"))).alias("fixed"))


@query("""SELECT doc_id, md5(replace(regexp_replace(replace(replace(text, ' the ', ' "the" '), ', ', ' — '), '"([^"' || chr(10) || ']*)"', '«\\1»', 'g'), '—', '–')) AS fixed FROM documents""")
def t6_quotes_dashes(t: Tables) -> DataFrame:
    quoted = F.replace(F.replace("text", F.lit(" the "), F.lit(' "the" ')), F.lit(", "), F.lit(" — "))
    return t.documents.select("doc_id", F.md5(fx.quotes_and_dashes(quoted)).alias("fixed"))


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS encoded, true AS round_trip FROM pages")
def t14_entities(t: Tables) -> DataFrame:
    encoded = fx.encode_entities(F.col("html"))
    return t.pages.select("page_id", F.md5(encoded).alias("encoded"), (fx.decode_entities(encoded) == F.col("html")).alias("round_trip"))


@query(r"SELECT page_id, trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^\p{L}\p{N}]+', ' ', 'g')) AS heading FROM pages")
def t15_normalised_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", fx.normalise_heading(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("heading"))


@query(r"WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), m AS (SELECT doc_id, (['- ', '1. ', 'a) ', ''])[CAST(length(x) % 4 + 1 AS INT)] || x AS x FROM p) SELECT doc_id, CASE WHEN regexp_matches(x, '^\s*[-•*–] ') THEN 'bullet' WHEN regexp_matches(x, '^\s*[a-z]\) ') THEN 'latin' WHEN regexp_matches(x, '^\s*[0-9]+[.)] ') THEN 'digit' END AS kind, count(*) AS n FROM m GROUP BY 1, 2")
def t16_list_types(t: Tables) -> DataFrame:
    marker = F.element_at(F.array(*map(F.lit, ("- ", "1. ", "a) ", ""))), (F.length("text") % 4 + 1).cast("int"))
    return paragraphs(t.documents).select("doc_id", fx.list_type(F.concat(marker, "text")).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, CASE WHEN length(text) < 20 THEN length(text) ELSE CASE WHEN c <> '' THEN length(c) ELSE length(l) END + 1 END AS kept_chars FROM (SELECT *, regexp_extract(l, '(?s)^(.*)\s\S*$', 1) AS c FROM (SELECT doc_id, text, left(text, CAST(ceil(length(text) / 2) AS INT)) AS l FROM documents))")
def t19_truncate_half(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length(fx.truncate_half(F.col("text"))).cast("long").alias("kept_chars"))


@query(r"SELECT doc_id, length(text) AS chars, length(regexp_replace(text, '\s', '', 'g')) AS solid, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words, CAST(greatest(1, ceil(length(text) / 2000)) AS BIGINT) AS pages FROM documents")
def t20_text_statistics(t: Tables) -> DataFrame:
    n = F.length("text")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return t.documents.select("doc_id", n.cast("long").alias("chars"), F.length(F.regexp_replace("text", r"\s", "")).cast("long").alias("solid"), words.cast("long").alias("words"), F.greatest(F.lit(1), F.ceil(n / 2000)).cast("long").alias("pages"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[EMAIL]', 'g'), '\+[0-9][0-9 ()-]{8,}[0-9]', '[PHONE]', 'g'), '[0-9]{10,}', '[NUMBER]', 'g')) AS masked FROM documents")
def t22_mask_identifiers(t: Tables) -> DataFrame:
    patterns = {"EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "PHONE": r"\+[0-9][0-9 ()-]{8,}[0-9]", "NUMBER": "[0-9]{10,}"}
    return t.documents.select("doc_id", F.md5(fx.mask(F.col("text"), patterns)).alias("masked"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def t24_json_from_noise(t: Tables) -> DataFrame:
    noisy = F.when(F.col("event_id") % 3 == 0, F.lit("no json here {oops")).otherwise(F.concat(F.lit("answer:\n```"), "props", F.lit("``` done")))
    return t.events.select("event_id", F.get_json_object(fx.json_in(noisy), "$.k").cast("long").alias("k"))


@query(r"SELECT c_custkey, regexp_matches(trim(CASE WHEN c_custkey % 2 = 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) ELSE c_name END), '^[-+]?[0-9][0-9 .,]*%?$') AS numeric FROM customer")
def t25_numeric_cells(t: Tables) -> DataFrame:
    cell = F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal").cast("decimal(18,2)").cast("string")).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", fx.is_numeric_cell(cell).alias("numeric"))


@query(r"SELECT p_partkey, '| ' || array_to_string(list_transform([p_name, p_brand || '|' || p_size], lambda c: replace(c, '|', '\|')) || [''], ' | ') || ' |' AS line FROM part")
def t28_pipe_tables(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fx.pipe_row(F.array("p_name", F.concat("p_brand", F.lit("|"), "p_size")), 3).alias("line"))


@query("""SELECT page_id, CAST(20 * (length(title) BETWEEN 30 AND 70)::INT + 15 * contains(html, '<h1')::INT + 15 * contains(html, 'lang=')::INT + 15 * (length(html) > 3000)::INT + 10 * contains(html, '<a href')::INT + 10 * contains(html, '<article')::INT + 10 * contains(html, '<table')::INT + 5 * contains(html, '<img')::INT AS BIGINT) AS score,
list_filter([CASE WHEN NOT length(title) BETWEEN 30 AND 70 THEN 'title length' END, CASE WHEN NOT contains(html, '<h1') THEN 'no h1' END, CASE WHEN NOT contains(html, '<img') THEN 'no image' END], lambda x: x IS NOT NULL) AS issues FROM (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)""")
def t33_page_audit(t: Tables) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)

    def has(s: str):
        return F.contains(F.col("html"), F.lit(s))

    parts = [(20, F.length(title).between(30, 70)), (15, has("<h1")), (15, has("lang=")), (15, F.length("html") > 3000), (10, has("<a href")), (10, has("<article")), (10, has("<table")), (5, has("<img"))]
    issues = F.array(F.when(~parts[0][1], "title length"), F.when(~has("<h1"), "no h1"), F.when(~has("<img"), "no image"))
    return t.pages.select("page_id", sum(w * c.cast("int") for w, c in parts).cast("long").alias("score"), F.array_compact(issues).alias("issues"))


@query("SELECT lang, count(*) AS n, floor(avg(n_chars) * 10 + 0.5) / 10 AS mean_chars, CAST(count(*) FILTER (n_chars > 2000) AS DOUBLE) / count(*) AS long_share FROM documents GROUP BY 1")
def c13_corpus_complexity(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), half_up(F.avg("n_chars"), 1).alias("mean_chars"), (F.count_if(F.col("n_chars") > 2000) / F.count("*")).alias("long_share"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z]{3}') AND NOT regexp_matches(text, '[\p{Cyrillic}]{3}') THEN 'latin' ELSE 'other' END AS script FROM documents")
def c4_script(t: Tables) -> DataFrame:
    latin = F.col("text").rlike("[A-Za-z]{3}") & ~F.col("text").rlike(r"\p{IsCyrillic}{3}")
    return t.documents.select("doc_id", F.when(latin, "latin").otherwise("other").alias("script"))


@query("SELECT item_id, count(*) AS hits, min(doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def j21_contains_join(t: Tables) -> DataFrame:
    """Whole items in whole texts. A text that holds an item has the item's inner words between blanks, so the five after
    the first are an equi-join key; pairs that share it are compared in full. Items of fewer words are compared as such."""
    def key(words: Column, at: Column) -> Column:
        return F.xxhash64(F.array_join(F.slice(words, at, 5), " "))

    items = t.benchmark.select("item_id", F.col("text").alias("item"), F.split("text", " ").alias("w"))
    long = items.where(F.size("w") >= 7).select("item_id", "item", key(F.col("w"), F.lit(2)).alias("key"))
    pair = F.transform(F.array(F.struct(F.split("text", " ").alias("w"))), lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(s["w"]) - 4)), lambda i: key(s["w"], i)))[0]
    windows = t.documents.select("doc_id", F.explode(F.array_distinct(pair)).alias("key"))
    shared = windows.join(long.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    found = shared.join(t.documents.select("doc_id", "text"), "doc_id").join(long.select("item_id", "item"), "item_id").where(F.contains("text", "item")).select("item_id", "doc_id")
    short = items.where(F.size("w") < 7).select("item_id", "item")
    found = found.unionByName(t.documents.join(short, F.contains("text", "item")).select("item_id", "doc_id"))
    return found.groupBy("item_id").agg(F.count("*").alias("hits"), F.min("doc_id").alias("first_doc"))


QUERIES, ORACLE_SQL = catalog.queries, catalog.sql
