"""Operators 5 and 10 against brute force."""

import math
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, line_dedup, near_dedup
from lodestone.llm.shingles import shingle_set

from .data import documents, edge_texts, empty, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def word_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = [word_shingles(t) for t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], roots(len(sets), links)


def near_copies(rng):
    texts = edge_texts(rng)
    for _ in range(25):
        base = words(rng, rng.randrange(20, 200))
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    chain = words(rng, 150)  # each links to the next only
    for k in range(12):
        chain = chain[8:] + words(rng, 8)
        texts.append(" ".join(chain))
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = near_copies(random.Random(7))
    sizes, component = brute_components(texts)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (sizes[i], component[i], component[i] == i)


def test_large_groups_link_over_hubs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    rng = random.Random(3)
    base = words(rng, 100)
    texts = []
    for k in range(40):
        copy = list(base)
        for _ in range(k % 4):
            copy[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    _, component = brute_components(texts)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == component


def test_large_buckets_are_split_by_further_bands(spark, monkeypatch):
    """Pairs that a long common passage puts into the buckets of many others, which they aren't links of: all are found."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    rng = random.Random(8)
    passage = words(rng, 120)
    texts = []
    for _ in range(60):
        own = words(rng, 60)
        for _ in range(2):
            copy = passage + own
            copy[rng.randrange(120, 180)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    _, component = brute_components(texts)
    assert len(set(component)) == 60
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == component


def test_large_buckets_at_their_real_size(spark):
    """300 documents share a passage that puts them into the same buckets; pairs at 0.76 to 0.9 are linked, the rest isn't."""
    rng = random.Random(9)
    passage, texts = words(rng, 150), []
    for k in range(150):
        own = words(rng, 90)
        for _ in range(2):
            copy = passage + own
            for _ in range(1 + k % 3):
                copy[rng.randrange(150, 240)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    _, component = brute_components(texts)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == component


def test_parity_sketches_never_differ_in_more_than_the_sets_do():
    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 700):
        for _ in range(30):
            pool = rng.integers(0, 1 << 63, 2 * n, np.uint64)
            a, b = (np.unique(pool[rng.random(2 * n) < p]) for p in (0.9, 0.5))
            if len(a) and len(b):
                x, y = (np.frombuffer(near_dedup.parity(s), np.uint64)[None] for s in (a, b))
                width = min(x.shape[1], y.shape[1])
                differing = np.bitwise_count(near_dedup._folded(x, width) ^ near_dedup._folded(y, width)).sum()
                assert differing <= len(np.setxor1d(a, b))


def test_near_duplicates_of_nothing_and_of_nulls(spark):
    assert near_dedup.near_duplicates(empty(spark)).collect() == []
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(None, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (7, 0, 7, True)], key=str)


def test_estimate_is_close_to_the_similarity(spark):
    rng = np.random.default_rng(1)
    rows = []
    for share in (0.3, 0.6, 0.9):
        a = np.unique(rng.integers(0, 1 << 63, 2000, np.uint64))
        b = np.concatenate([a[: int(len(a) * share)], rng.integers(0, 1 << 63, int(len(a) * (1 - share)), np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        rows.append((true, near_dedup.packed_bits(near_dedup.minima(a)).tolist(), near_dedup.packed_bits(near_dedup.minima(b)).tolist()))
    df = spark.createDataFrame(rows, "true double, a array<long>, b array<long>")
    for r in df.select("true", near_dedup.estimate(F.col("a"), F.col("b")).alias("e")).collect():
        assert abs(r.true - r.e) < 0.2


@pytest.mark.parametrize("text", ["", "a", "A b", "x  y\tz\n", "é " * 50, "w " * 3])
def test_shingle_sets_count_distinct_shingles(text):
    assert len(shingle_set(text.encode())) == len(word_shingles(text))


def test_components_of_a_path_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200), (None, 3)]
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def line_shingles(line):
    """All runs of 8 characters; a shorter line is one shingle."""
    return {line[k : k + 8] for k in range(max(1, len(line) - 7))}


def brute_lines(texts):
    """The texts without the lines that copy an earlier one."""
    occurrences = defaultdict(list)
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            if re.search(r"\S", line):
                occurrences[line].append((i, k))
    lines = list(occurrences)
    sets = [line_shingles(x) for x in lines]
    links = [(i, j) for j in range(len(lines)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    groups = defaultdict(list)
    for line, root in zip(lines, roots(len(lines), links)):
        groups[root] += occurrences[line]
    gone = {place for g in groups.values() for place in sorted(g)[1:]}
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in enumerate(texts)]


def test_line_shingles_begin_at_each_character(spark):
    lines = ["https://a.example/one", "https://b.example/two-other", "2024-01-03,alice,17.5,ok", "x", "exactly8", "nine char", "  blanks  at  ends ", "日本語テキストの行です", "🙂🙂 zero 🙂🙂🙂 width", "a" * 3000, "tab\tand\rreturn"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.size(F.array_distinct(line_dedup.hashes())).alias("n"))
    assert {r.line: r.n for r in df.collect()} == {x: len(line_shingles(x)) for x in lines}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join(words(rng, rng.randrange(30, 60))) for _ in range(40)]
    texts = edge_texts(rng)
    for _ in range(40):
        lines = [rng.choice(pool).split(" ") for _ in range(rng.randrange(1, 6))]
        for line in lines:
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = f"e{rng.randrange(10**6)}"
        texts.append("\n".join(map(" ".join, lines)))
    got = line_dedup.dedup_lines(documents(spark, texts))
    assert {"lang", "key", "component", "n_lines", "n_dropped"} <= set(got.columns)
    result = {r.doc_id: r.text for r in got.collect()}
    want = brute_lines(texts)
    assert len(result) == len(texts)
    assert sum(result[i] != want[i] for i in range(len(texts))) <= 1  # bands find all but a few in a hundred links


def test_line_dedup_reads_all_of_a_line(spark):
    rng = random.Random(12)
    base = "Reference " + "".join(rng.choice("0123456789abcdef") for _ in range(300))
    near = base[:200] + "#" + base[201:]
    texts = ["https://a.example/one", "https://b.example/two-other", "2024-01-03,alice,17.5,ok", "2024-01-29,bob,99.1,fail", "Reference 1234567890", "Reference 1234567899999", base, near]
    assert len(line_shingles(base) & line_shingles(near)) >= 0.8 * len(line_shingles(base) | line_shingles(near))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [*texts[:7], ""]


def test_line_dedup_links_many_small_clusters_that_share_boilerplate(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL_BUCKET", 2)
    rng = random.Random(13)
    boilerplate = " ".join(words(rng, 40))
    texts = []
    for _ in range(30):
        line = boilerplate + " " + " ".join(words(rng, 20))
        at = len(line) - 40
        texts += [line, line[:at] + "#" + line[at + 1 :], line[:at] + "~" + line[at + 1 :]]
    rng.shuffle(texts)
    want = brute_lines(texts)
    assert sum(t != "" for t in want) == 30
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_lines_apart_in_large_buckets_meet_whenever_signatures_allow(spark, monkeypatch):
    """Signatures that share much with many: every pair that may be a link is a candidate, in small buckets and over blocks of large ones."""
    monkeypatch.setattr(line_dedup, "SMALL_BUCKET", 3)
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    rng = random.Random(7)
    common_to_all, some = range(5), [rng.sample(range(100, 400), 6) for _ in range(12)]
    signatures = []
    for i in range(120):
        held = [*common_to_all, *rng.choice(some)][: rng.choice([11, 9, 8, 7])]
        size = rng.choice([12, 12, 11, 10, 7, 3, 1])
        signatures.append(sorted({*rng.sample(held, min(size, rng.randrange(1, len(held) + 1))), *rng.sample(range(1000, 10**6), size)})[:size])
    signatures = [rng.sample(x, len(x)) for x in signatures]
    lines = spark.createDataFrame(list(enumerate(signatures)), "line_id long, minima array<int>")
    components = [i // 2 for i in range(len(signatures))]
    apart = spark.createDataFrame(list(enumerate(components)), "line_id long, component long")

    def may(a, b):
        less, more = sorted((len(a), len(b)))
        return 12 * len({*a} & {*b}) >= 5 * less and (more == less == 12 or 10 * less >= 8 * more)

    want = {(i, j) for j in range(len(signatures)) for i in range(j) if components[i] != components[j] and may(signatures[i], signatures[j])}
    got = [tuple(r) for r in line_dedup.pairs_apart(apart, lines).collect()]
    assert len(want) > 100 and want <= set(got) and len(got) == len(set(got))
    assert all(a < b and components[a] != components[b] and 12 * len({*signatures[a]} & {*signatures[b]}) >= 5 * min(len(signatures[a]), len(signatures[b])) for a, b in got)


def test_line_bands_find_links_at_the_threshold(spark):
    """Recall over pairs of a similarity from 0.8 to 0.86, found by shingles made here; the rest is left to chance."""
    rng = random.Random(14)
    texts, near = [], 0
    for _ in range(400):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300))
        copy = list(line)
        for at in (60, 150, 240):
            copy[at] = "#"
        copy = "".join(copy) + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randrange(12)))
        a, b = line_shingles(line), line_shingles(copy)
        near += 80 * len(a | b) <= 100 * len(a & b) <= 86 * len(a | b)
        texts += [line, copy]
    assert near > 300
    kept = line_dedup.dedup_lines(documents(spark, texts)).where("n_dropped = 0").count()
    assert len(texts) - kept >= 0.97 * near


def test_a_line_repeated_in_long_documents(spark):
    a, b = "the same line over and over again, with one word different", "the same line over and over again, with one word changed!"
    start = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(documents(spark, ["\n".join([a] * 20_000), "\n".join([b] * 20_000), "x" * 1_000_000])).collect()}
    assert got == {0: (20_000, 19_999), 1: (20_000, 20_000), 2: (1, 0)} or got[1][1] >= 19_999
    assert time.time() - start < 60


def test_parity_sketches_never_rule_out_a_link(spark):
    """Two sketches differ in no more bits than the sets in members; sets that differ much are told apart, so few non-links reach their texts."""
    rng = random.Random(15)
    sets = []
    for n in (1, 9, 60, 250, 900):
        for changed in (0, 0.05, 0.1, 0.2, 0.4):
            a = {rng.randrange(-(2**63), 2**63) for _ in range(n)}
            b = {x if rng.random() > changed else rng.randrange(-(2**63), 2**63) for x in a}
            sets.append((sorted(a), sorted(b)))
    df = spark.createDataFrame(sets, "a array<long>, b array<long>")
    side = lambda c: F.struct(F.size(c).cast("long").alias("n"), line_dedup.parity(F.col(c)).alias("parity"))
    rows = df.select("a", "b", side("a").alias("x"), side("b").alias("y")).withColumn("may", line_dedup.possible(F.col("x"), F.col("y"), ["n", "parity"])).collect()
    for r in rows:
        a, b = {*r.a}, {*r.b}
        assert sum(bin((i ^ j) & (2**64 - 1)).count("1") for i, j in zip(r.x.parity, r.y.parity, strict=True)) <= len(a ^ b)
        assert r.may or 100 * len(a & b) < 80 * len(a | b)
    assert not any(r.may for r in rows if len(r.a) >= 60 and 100 * len({*r.a} & {*r.b}) < 60 * len({*r.a} | {*r.b}))


def test_large_groups_of_near_lines_need_few_comparisons_of_texts(spark, monkeypatch):
    """Copies of a line with changes of their own, some of them links: what is compared by text grows with the group, not with its square."""
    rng = random.Random(16)
    base = words(rng, 60)
    texts = [" ".join(w if rng.random() > 0.06 else f"e{rng.randrange(10**6)}" for w in base) for _ in range(300)]
    compared, real = [], line_dedup.linked

    def linked(pairs, texts):
        compared.append(line_dedup.likely(pairs, texts).count())
        return real(pairs, texts)

    monkeypatch.setattr(line_dedup, "linked", linked)
    want = brute_lines(texts)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert sum(got[i] != want[i] for i in range(len(texts))) <= 3
    assert sum(compared) < 20 * len(texts)


def test_large_buckets_deal_out_only_lines_outside_their_main_component(spark, monkeypatch):
    """Of a bucket of 600 lines 6 belong to other components: these meet all lines, the others don't meet each other."""
    monkeypatch.setattr(line_dedup, "BLOCK", 64)
    minima, outside = list(range(12)), {7, 100, 101, 300, 450, 599}
    lines = spark.createDataFrame([(i, minima) for i in range(600)], "line_id long, minima array<int>")
    components = {i: i // 2 + 1 if i in outside else 0 for i in range(600)}
    apart = spark.createDataFrame(list(components.items()), "line_id long, component long")
    buckets = lines.select(F.lit(1).alias("key"), "line_id").withColumn("n", F.lit(600))
    packed = line_dedup.materialise(line_dedup.in_blocks(buckets, apart, lines), "blocks")
    want = {(i, j) for j in range(600) for i in range(j) if components[i] != components[j]}
    got = [tuple(r) for r in line_dedup.within_large(packed).collect()]
    assert set(got) == want and len(got) == len(want)
    monkeypatch.setattr(line_dedup, "pairs_of", lambda left, right, near: F.array(F.struct(F.size(left).alias("a"), F.size(right).alias("b"))))
    met = line_dedup.within_large(packed).agg(F.max("a"), F.max("b")).first()
    assert met[0] <= len(outside) < met[1]


def test_keys_of_lines_are_kept_no_longer_than_needed(spark):
    assert "keys" not in line_dedup.fuzzy_line_groups(documents(spark, ["a line of some length", "another one"]))[0].columns


def test_small_buckets_give_only_pairs_that_signatures_allow(spark):
    """Lines that share a band and little else leave no rows, however many share it; links in the same buckets do."""
    common, lines = [1, 2], []
    for i in range(300):
        own = [1000 * (i // 2) + 10 * k + (5000000 if k > 8 and i % 2 else 0) for k in range(3, 13)]
        lines.append((i, 300, common + own))
    table = spark.createDataFrame(lines, "line_id long, n long, minima array<int>")
    buckets = table.select(F.floor(F.col("line_id") / 10).alias("key"), "line_id").withColumns({"n": F.lit(10), "hub": F.lit(0)})
    got = sorted(tuple(r) for r in line_dedup.within_small(buckets, table).collect())
    assert got == [(i, i + 1) for i in range(0, 300, 2)]


def test_lines_of_common_words_share_no_buckets(spark, monkeypatch):
    """Prose of few words without copies: lines have many pairs of shingles in common and no passage, so they meet nowhere."""
    rng = random.Random(17)
    texts = [" ".join(words(rng, rng.randrange(40, 80), 60)) for _ in range(3000)]
    rows, real = [], line_dedup.materialise

    def materialise(df, name):
        made = real(df, name)
        rows.append(made.count() if name in ("buckets", "pairs") else 0)
        return made

    monkeypatch.setattr(line_dedup, "materialise", materialise)
    assert line_dedup.dedup_lines(documents(spark, texts)).where("n_dropped > 0").isEmpty()
    assert sum(rows) < 100


def test_lines_of_any_length_and_script_are_looked_up(spark):
    """Near copies of 5 to 120 characters, with blanks and without, repeated patterns of different lengths: as by brute force."""
    rng = random.Random(18)
    letters, texts = "abcdefghij" + "абвгдежз" + "日本語の行", []
    for n in [*range(5, 40), *range(40, 121, 4)] * 2:
        line = "".join(rng.choice(letters + " " * (4 * (n % 2))) for _ in range(n))
        near = n // 10
        texts += [line, line + "".join(rng.choice(letters) for _ in range(near)), line[near // 2 :] + "#", line[: n // 2] + "~" + line[n // 2 + 1 :]]
    texts += [x * n for x in ("-", "=-", "no yes ", "abcdefghijkl mnopqrstuv") for n in (8, 30, 70, 200)]
    rng.shuffle(texts)
    want = brute_lines(texts)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert sum(got[i] != want[i] for i in range(len(texts))) <= 2


def test_line_dedup_keeps_columns_of_any_name(spark):
    rows = [(1, "one line here", "a", 1), (2, "one line here", "b", 2)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, gone_id string, Gone_Places int"))
    assert {tuple(r)[:4] for r in got.collect()} == {(1, "one line here", "a", 1), (2, "", "b", 2)}


def test_line_dedup_of_nothing_and_of_nulls(spark):
    assert line_dedup.dedup_lines(empty(spark)).collect() == []
    rows = [(None, "same line here"), (1, "same line here\n\nother"), (2, None), (3, "")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: ("", 1, 1), 1: ("same line here\n\nother", 3, 0), 2: (None, 0, 0), 3: ("", 1, 0)}


def test_band_probability():
    assert (1 - 0.75**near_dedup.ROWS) ** (near_dedup.MINIMA // near_dedup.ROWS) < 1e-5
    assert math.isclose(near_dedup.MINIMA / near_dedup.ROWS, 32)
