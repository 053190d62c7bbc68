"""Secret scanning with inferred probabilistic automata (operator 7)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Base kinds in the order of reports. A match must have the given length in its given group.
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),  # runs of fewer characters fail anyway
}
#: Kind of the spans that the automata add.
FOUND = "format"
#: What is scored: runs of at least this many characters of credentials.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: A state stands for a place in a value and up to so many symbols before it; places from ``PLACES`` on count as one.
CONTEXT, PLACES = 2, 512
#: Entries of a task's counts that are held before they leave it.
HELD = 100_000
#: Level of the Hoeffding test of two states, shared by as many tests as there are states, and visits that a state needs, in number and as a share of the values; rarer ones
#: at a place that end in the same symbols count as one.
ALPHA, LEAST_VISITS, LEAST_SHARE = 0.01, 20, 0.001
#: Share of the values with which a character at a place stands for itself instead of its class.
LITERAL = 0.3
#: Share of a state's probability kept for symbols that it never saw.
UNSEEN = 0.002
#: Candidates are reported from this log-likelihood ratio to plain runs on, in nats, if they are no less likely a
#: character than all but this share of the labelled values.
LEAST_RATIO, LEAST_QUANTILE = 12.0, 0.02

#: Character classes and their sizes; other characters stand for themselves.
CLASSES = {"h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ", "d": "0123456789"}
_CLASS = str.maketrans({c: k for k, cs in CLASSES.items() for c in cs})
_SIZE = {k: len(cs) for k, cs in CLASSES.items()}
#: The symbol of a value's end, and what a character's number is raised by where it stands for itself instead of its class.
END, ITSELF = "", 1 << 16

#: How often each symbol follows at a place behind the last symbols: counts by (place, those symbols).
Counts = dict[tuple[int, str], Counter]


def often(places: Iterable[tuple[int, str, int]], n: int) -> dict[int, set[str]]:
    """The characters that stand for themselves by place: those that many of ``n`` values have there. ``places``: place, character, values."""
    found: dict[int, set[str]] = {}
    for k, c, m in places:
        if k < PLACES and m >= max(LITERAL * n, LEAST_VISITS):
            found.setdefault(k, set()).add(c)
    return found


def symbols(value: str, literal: dict[int, set[str]]) -> Iterator[str]:
    for k, (c, symbol) in enumerate(zip(value, value.translate(_CLASS))):
        yield chr(ITSELF + ord(c)) if k in literal and c in literal[k] else symbol


def steps(value: str, literal: dict[int, set[str]], ends: bool) -> Iterator[tuple[int, str, str]]:
    """The place, the last symbols before it, and the symbol there, for each place of a value and its end."""
    last = ""
    for k, symbol in enumerate(symbols(value, literal)):
        yield min(k, PLACES), last, symbol
        last = (last + symbol)[-CONTEXT:]
    if ends:
        yield min(len(value), PLACES), last, END


class Automaton:
    """A probabilistic automaton over character classes, inferred from counts of symbols by merging states.

    A state is a place together with the last symbols before it, and knows how often each symbol follows and how often values
    end there. A symbol is a class of characters, or a character that many of the strings have at that place. What is too rare
    at a place counts with all that shares its last symbol, then with all else that is rare there. All values count, each with all
    its characters: what is held is bounded by the places and symbols, not by the values. From the root down, the most visited
    state of a place first, a state is merged with one of its own place if by Hoeffding's bound no frequency differs in the two
    or in any pair of states that follow both; without such evidence nothing is merged. Merging adds the counts, so
    what lies below becomes better founded. Last, states of different places are merged by the same test: a repeating part
    becomes a loop, a fixed length stays. Without ``ends`` the strings' lengths count for nothing. Where a state has no way on,
    scoring goes on at the most visited state of the next place.
    """

    def __init__(self, values: list[str], ends: bool = True) -> None:
        literal = often(((*x, n) for x, n in Counter((k, c) for v in values for k, c in enumerate(v)).items()), len(values))
        counts: Counts = {}
        for value in values:
            for place, last, symbol in steps(value, literal, ends):
                counts.setdefault((place, last), Counter())[symbol] += 1
        self.infer(counts, literal, len(values), ends)

    @classmethod
    def of(cls, counts: Counts, literal: dict[int, set[str]], n: int, ends: bool = True) -> Automaton:
        """The automaton of ``n`` values that were counted elsewhere."""
        made = cls.__new__(cls)
        made.infer(counts, literal, n, ends)
        return made

    def found(self, counts: Counts, n: int) -> dict[int, dict[str, int]]:
        """The states of each place by the symbols before it, with their counts; those of rare ones are added up."""
        least = max(LEAST_VISITS, LEAST_SHARE * n)
        places: dict[int, list[dict[str, Counter]]] = {}
        for (place, last), c in sorted(counts.items()):
            places.setdefault(place, [{} for _ in range(CONTEXT + 1)])[len(last)][last] = Counter(c)
        self.visits, self.place, index = [], [], {}
        for place, orders in sorted(places.items()):
            at = index[place] = {}
            for k in range(CONTEXT, -1, -1):
                for last, c in sorted(orders[k].items()):
                    if k and c.total() < least:
                        orders[k - 1].setdefault(last[1:], Counter()).update(c)
                    elif c.total() >= least or not at:
                        at[last] = len(self.visits)
                        self.visits.append(c)
                        self.place.append(place)
        return index

    def infer(self, counts: Counts, literal: dict[int, set[str]], n: int, ends: bool) -> None:
        """Settle the states place by place, then merge those of different places: by then their counts are whole."""
        self.literal, self.ends, self.least = literal, ends, -math.inf
        index = self.found(counts or {(0, ""): Counter()}, n)
        self.arcs: list[dict[str, int]] = [{} for _ in self.visits]
        self.merged = list(range(len(self.visits)))  # the state that each is merged with
        self.differ: set[tuple[int, int]] = set()
        for place, at in index.items():
            after = index.get(min(place + 1, PLACES), {})
            for last, state in at.items():
                for symbol in self.visits[state]:
                    ways = [(last + symbol)[-k:] if k else "" for k in range(CONTEXT, -1, -1)]
                    if symbol != END and (way := next((w for w in ways if w in after), None)) is not None:
                        self.arcs[state][symbol] = after[way]
        settled: list[int] = []
        for at in index.values():
            layer: list[int] = []
            for state in sorted(at.values(), key=lambda x: (-self.visits[x].total(), x)):
                if self.at(state) != state or self.visits[state].total() < LEAST_VISITS:
                    continue
                same = next((r for r in layer if self.at(r) == r and self.alike(r, state)), None)
                if same is None:
                    layer.append(state)
                else:
                    self.fold(same, state)
            settled += layer
        self.main = {place: max(at.values(), key=lambda x: self.visits[self.at(x)].total()) for place, at in index.items()}
        root = self.at(index[0][""]) if 0 in index and "" in index[0] else 0
        known = []
        for state in settled:
            if self.at(state) != state:
                continue
            earlier = next((r for r in known if self.alike(r, state)), None)
            if earlier is None:
                known.append(state)
                continue
            self.merged[state] = earlier
            self.visits[earlier].update(self.visits[state])
            self.arcs[earlier] = self.arcs[state] | self.arcs[earlier]
        kept, self.main = set(known), {k: self.at(x) for k, x in self.main.items()}
        self.arcs = [{symbol: self.at(t) for symbol, t in arcs.items() if self.at(t) in kept} for arcs in self.arcs]
        self.main = {k: x for k, x in self.main.items() if x in kept}
        self.root, reached = root, {root}
        ahead = [root, *self.main.values()]
        while ahead:
            for t in self.arcs[ahead.pop()].values():
                if t not in reached:
                    reached.add(t)
                    ahead.append(t)
        self.settled = sorted(reached)
        self.logs = {}
        for state in {*reached, *self.main.values()}:
            n = self.visits[state].total()
            self.logs[state] = {symbol: math.log((1 - UNSEEN) * m / n + UNSEEN / (len(CLASSES) + 8)) - math.log(_SIZE.get(symbol, 1)) for symbol, m in self.visits[state].items() if n}
        self.unseen = math.log(UNSEEN / (len(CLASSES) + 8))
        keep = self.logs.keys()
        self.arcs = {state: self.arcs[state] for state in keep}
        self.place = {state: self.place[state] for state in keep}
        del self.visits, self.merged, self.differ

    def at(self, state: int) -> int:
        while self.merged[state] != state:
            self.merged[state] = state = self.merged[self.merged[state]]
        return state

    def alike(self, a: int, b: int) -> bool:
        """Whether no pair of states with evidence differs, from this pair on, which needs evidence itself.

        Pairs that led to a difference are remembered, so a way that two tests share is walked once.
        """
        pairs, above = [(self.at(a), self.at(b))], {}
        above[pairs[0]] = None
        while pairs:
            pair = a, b = pairs.pop()
            n, m = self.visits[a].total(), self.visits[b].total()
            if min(n, m) < LEAST_VISITS:
                if above[pair] is None:
                    return False
                continue
            bound = math.sqrt(0.5 * math.log(2 * len(self.visits) / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if pair in self.differ or any(abs(self.visits[a][x] / n - self.visits[b][x] / m) > bound for x in self.visits[a].keys() | self.visits[b].keys()):
                while pair is not None:
                    self.differ.add(pair)
                    pair = above[pair]
                return False
            for x in self.arcs[a].keys() & self.arcs[b].keys():
                below = self.at(self.arcs[a][x]), self.at(self.arcs[b][x])
                if below[0] != below[1] and below not in above:
                    above[below] = pair
                    pairs.append(below)
        return True

    def fold(self, a: int, b: int) -> None:
        """Merge b with a, and what follows both."""
        pairs = [(a, b)]
        while pairs:
            a, b = map(self.at, pairs.pop())
            if a == b:
                continue
            self.merged[b] = a
            self.visits[a].update(self.visits[b])
            for symbol, below in self.arcs[b].items():
                if symbol in self.arcs[a]:
                    pairs.append((self.arcs[a][symbol], below))
                else:
                    self.arcs[a][symbol] = below

    def score(self, value: str) -> float:
        """Log-likelihood of a whole value; its class's characters are equally likely."""
        state, total = self.root, 0.0
        for symbol in chain(symbols(value, self.literal), [END] if self.ends else []):
            log = self.logs[state].get(symbol)
            total += self.unseen - math.log(_SIZE.get(symbol, 1)) if log is None else log
            after = self.arcs[state].get(symbol)
            state = self.main.get(min(self.place[state] + 1, PLACES), state) if after is None else after
        return total


def shape(value: str) -> str:
    """The classes of characters in a value: what tells formats of one kind apart before inference."""
    return "".join(sorted(set(value.translate(_CLASS)) & set(CLASSES)))


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Leftmost non-overlapping matches per kind that pass: kind, start, end, value, by start, then kind as listed."""
    found = []
    for kind, (pattern, group, least) in KINDS.items():
        if (kind == "assign" and ":" not in text and "=" not in text) or (kind == "access" and "AKIA" not in text):
            continue
        found += [(kind, m.start(), m.end(), m.group(group)) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    order = list(KINDS)
    return sorted(found, key=lambda x: (x[1], order.index(x[0])))


def candidates(text: str, spans: list[tuple[str, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Start, end and value of the runs that no base span overlaps; ``spans`` are in order of start."""
    k, reached = 0, 0
    for m in CANDIDATE.finditer(text):
        while k < len(spans) and spans[k][1] < m.end():
            reached = max(reached, spans[k][2])
            k += 1
        if reached <= m.start():
            yield m.start(), m.end(), m.group()


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
SCANNED = "doc_id long, spans array<struct<kind: string, start: long, end: long, value: string>>"


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id and all base spans and candidates (kind null) of each row's text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text) if text else []
                spans = spans + [(None, *x) for x in candidates(text, spans)] if text else spans
                rows.append([dict(zip(("kind", "start", "end", "value"), x)) for x in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _SPANS)], ["doc_id", "spans"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCANNED)


#: The kind of the candidates among values, and the format of all values whose shape is rare in their kind.
PLAIN, REST = "", "rest"


def labelled(scans: DataFrame) -> DataFrame:
    """kind, value, shape, half: all distinct values of each kind and all distinct candidates; half is 0 or 1 by the value's hash."""
    values = scans.select(F.explode("spans").alias("s")).select(F.coalesce("s.kind", F.lit(PLAIN)).alias("kind"), "s.value").distinct()

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = pa.array([shape(v.as_py()) for v in batch.column("value")], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, shapes], [*batch.schema.names, "shape"])

    values = values.withColumn("half", F.pmod(F.xxhash64("value"), F.lit(2)).cast("int"))
    return values.mapInArrow(shaped, "kind string, value string, half int, shape string")


def counted(values: DataFrame, of: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """How often each of the tuples that ``of`` makes of rows occurs (n), added up within tasks first."""
    names = [c.split()[0] for c in schema.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = [*zip(*held)] or [()] * len(names)
            kinds = [pa.string() if c.endswith("string") else pa.int32() for c in schema.split(", ")]
            made = pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(held.values(), pa.int64())], [*names, "n"])
            held.clear()
            return made

        for batch in batches:
            for row in batch.to_pylist():
                for made in of(row):
                    held[made] += 1
                    if len(held) >= HELD:
                        yield out()
        yield out()

    return values.mapInArrow(count, f"{schema}, n long").groupBy(*names).agg(F.sum("n").alias("n"))


def best(models: list[Automaton], value: str) -> tuple[float, Automaton]:
    """The likelihood of a value under the automaton that makes it likeliest."""
    score, _, model = max((m.score(value), k, m) for k, m in enumerate(models))
    return score, model


def typical(value: str, score: float, model: Automaton) -> bool:
    """Whether a value is, a character, as likely as a format's labelled values."""
    return score / (len(value) + 1) >= model.least


def formats(values: DataFrame) -> tuple[list[Automaton], Automaton]:
    """An automaton for each shape that enough of a kind's values have and one for all its others together; last, that of plain runs.

    ``least`` is what all but a few of one half of the values score under the other half's automaton, a character. The driver gets counts
    by place and symbols, which the number of values doesn't make more.
    """
    sizes = {(r["kind"], r["shape"]): r["n"] for r in values.groupBy("kind", "shape").agg(F.count("*").alias("n")).collect()}
    enough = lambda n: n >= 2 * LEAST_VISITS
    group_of = {x: (PLAIN, "") if x[0] == PLAIN else x if enough(n) else (x[0], REST) for x, n in sizes.items()}
    totals: Counter = Counter()
    for x, n in sizes.items():
        totals[group_of[x]] += n
    names = [x for x in sorted(totals) if x[0] == PLAIN or enough(totals[x])]
    number = {x: names.index(g) for x, g in group_of.items() if g in names}
    asked = F.create_map(*[F.lit(v) for (kind, of), k in number.items() for v in (f"{kind} {of}", k)]) if number else F.lit(None).cast("map<string,int>")
    rows = values.withColumn("g", asked[F.concat_ws(" ", "kind", "shape")]).where("g IS NOT NULL").select("g", "half", "value")

    of_place = counted(rows, lambda r: ((r["g"], k, c) for k, c in enumerate(r["value"][:PLACES])), "g int, place int, c string").where(F.col("n") >= LEAST_VISITS)
    seen: dict[int, list[tuple[int, str, int]]] = {}
    for r in of_place.collect():
        seen.setdefault(r["g"], []).append((r["place"], r["c"], r["n"]))
    literal = {k: often(seen.get(k, []), totals[g]) for k, g in enumerate(names)}
    ends = [g[0] != PLAIN for g in names]  # runs of words are of any length

    def halves_of(rows: DataFrame) -> dict[tuple[int, int], Counts]:
        found: dict[tuple[int, int], Counts] = {}
        tails = counted(rows, lambda r: ((r["g"], r["half"], *x) for x in steps(r["value"], literal[r["g"]], ends[r["g"]])), "g int, half int, place int, last string, symbol string")
        for r in tails.collect():
            found.setdefault((r["g"], r["half"]), {}).setdefault((r["place"], r["last"]), Counter())[r["symbol"]] = r["n"]
        return found

    halves = halves_of(rows)

    def whole(halves: dict[tuple[int, int], Counts], k: int) -> Counts:
        both: Counts = {}
        for half in (0, 1):
            for x, c in halves.get((k, half), {}).items():
                both.setdefault(x, Counter()).update(c)
        return both

    size = lambda counts: sum(c.total() for (place, _), c in counts.items() if not place)
    models = [Automaton.of(whole(halves, k), literal[k], totals[g], ends[k]) for k, g in enumerate(names)]
    firsts = [Automaton.of(halves.get((k, 0), {}), literal[k], size(halves.get((k, 0), {})), ends[k]) if ends[k] else None for k in range(len(names))]
    scored = counted(
        rows.where((F.col("half") == 1) & F.col("g").isin([k for k, e in enumerate(ends) if e])),
        lambda r: iter([(r["g"], math.floor(1000 * firsts[r["g"]].score(r["value"]) / (len(r["value"]) + 1)))]), "g int, score int",
    )
    scores: dict[int, list[tuple[int, int]]] = {}
    for r in scored.collect():
        scores.setdefault(r["g"], []).append((r["score"], r["n"]))
    for k, of in scores.items():
        left = int(LEAST_QUANTILE * sum(n for _, n in of))
        for score, n in sorted(of):
            models[k].least, left = score / 1000, left - n
            if left < 0:
                break
    learned = [m for m, e in zip(models, ends) if e]
    if (PLAIN, "") not in names:
        return learned, Automaton([], ends=False)
    k = names.index((PLAIN, ""))
    plain = models[k]
    if learned:  # among the plain runs are the formats that are looked for: what is typical of one, and likelier so than by the other half's plain runs, is left out of a second count
        others = [Automaton.of(of := halves.get((k, half), {}), literal[k], size(of), False) for half in (1, 0)]

        def ordinary(value: str, half: int) -> bool:
            score, model = best(learned, value)
            return not typical(value, score, model) or score <= others[half].score(value)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(map(ordinary, batch.column("value").to_pylist(), batch.column("half").to_pylist()), pa.bool_()))

        again = whole(halves_of(rows.where(F.col("g") == k).mapInArrow(kept, rows.schema)), k)
        if enough(size(again)):
            plain = Automaton.of(again, literal[k], size(again), False)
    return learned, plain


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (array of kind, start, end, value) of each row: base spans, and those that the automata add.

    For each kind automata are inferred from all its labelled values, which are base matches, one for each shape of them, and one
    from all plain runs. Every candidate is scored in whole under all of them: it is a secret where the best format's
    likelihood exceeds that of plain runs enough and is, a character, as high as that of the labelled values. Without
    enough labelled values of a kind it has no automaton, and without any there are only base spans. Places are code points, end exclusive. A null text has no spans; a null
    doc_id stays; repeated rows give the same; other columns are ignored.
    """
    scans = materialise(scanned(documents), "scans")
    values = materialise(labelled(scans), "values")
    models, plain = formats(values)
    discard(values)

    def secret(value: str) -> bool:
        if not models:
            return False
        score, model = best(models, value)
        return score - plain.score(value) >= LEAST_RATIO and typical(value, score, model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            rows = []
            for spans in batch.column("spans").to_pylist():
                kept = []
                for s in spans:
                    if s["kind"] is None:
                        if len(known) > 100_000:
                            known.clear()
                        if s["value"] not in known:
                            known[s["value"]] = secret(s["value"])
                        if not known[s["value"]]:
                            continue
                        s["kind"] = FOUND
                    kept.append(s)
                kept.sort(key=lambda s: (s["start"], [*KINDS, FOUND].index(s["kind"])))
                rows.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _SPANS)], ["doc_id", "spans"])

    return scans.mapInArrow(judge, SCANNED)
