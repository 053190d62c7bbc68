"""Byte-level BPE by a lazily determinised transducer, and streaming decoding (operator 4)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoded matches of which a worker remembers the ids, and the longest that it remembers.
CACHE, CACHE_CHARS = 1_000_000, 64
#: States that are kept; at one more all are dropped but the one that the machine is in, and made again as needed.
STATES = 200_000
#: White space as the pattern's authors' engine has it; Python's also has four control characters.
SPACE = r"\t-\r\x20\x85\xA0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


#: The state before a text: one guess, after no token, at the root of the trie.
START = ((-1, 0),)


class Transducer:
    """Encodes byte strings, a byte at a time, into the ids that merging by rank gives.

    Merging by rank has a local description: a sequence of tokens is the encoding of its bytes if and only if each token
    encodes to itself and each adjacent pair encodes to that pair. So a nondeterministic machine can guess where tokens
    end: it walks the trie of tokens, and at a token it may emit it, if it may follow the one before, and return to the
    root. A state of the deterministic machine is the set of guesses still open: for each, the token before it and the
    place in the trie; of that token it holds only what decides which may follow, so states recur within and across texts.
    They and their transitions are made when first needed; when too many are kept, they are dropped and made anew, so the
    machine is the only path and its memory is bounded. Of all ways to end a token at a byte one is valid, so a
    transition gives out that token, and the tokens of a string are read back from its end, each beginning where the one
    before it ends.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][byte]
            self.ends[node] = i
        self.lengths = {i: len(b) for b, i in ranks.items()}
        self.may_follow: dict[int, dict[int, bool]] = {}
        self.spines: tuple[dict[int, list[tuple[bytes, int]]], ...] = ({}, {})
        self.extends: dict[bytes, int] = {}  # the least rank of the tokens that a string begins
        for token, i in ranks.items():
            for k in range(1, len(token)):
                self.extends[token[:k]] = min(i, self.extends.get(token[:k], i))
        self.alike: dict[tuple, int] = {}
        self.stands_for: dict[int, int] = {-1: -1}
        self.forget(())

    def forget(self, state: tuple) -> int:
        """Drop all states; the number of the given one, which stays."""
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[int, tuple[int, int]]] = []
        self.number(START)
        return self.number(state or START)

    def number(self, state: tuple) -> int:
        known = self.numbers.get(state)
        if known is None:
            known = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return known

    def last(self, token: int) -> int:
        """The token that stands for all with the same parts at their right edge that may still merge with what follows."""
        known = self.stands_for.get(token)
        if known is None:
            parts = tuple((x, until) for x, until in self.spine(token, 1) if self.extends.get(x, until) < until)
            known = self.stands_for[token] = self.alike.setdefault(parts, token)
        return known

    def merge(self, text: bytes) -> list[bytes]:
        """Plain merging by rank, until two parts are left."""
        parts = [text[k : k + 1] for k in range(len(text))]
        while len(parts) > 2:
            rank, k = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that lie at a token's left (0) or right (1) edge while it is merged, largest first, each with the
        rank at which it becomes part of the next larger one. Empty if merging doesn't make the token."""
        known = self.spines[side]
        if token not in known:
            part, until, found = self.tokens[token], 1 << 60, []
            while True:
                found.append((part, until))
                if len(part) == 1:
                    break
                halves = self.merge(part)
                if len(halves) > 2:
                    found = []
                    break
                until = self.ranks[part]
                part = halves[side]
            known[token] = found
        return known[token]

    def follows(self, before: int, token: int) -> bool:
        """Whether merging leaves the two tokens apart: no part at the right edge of the one and part at the left edge
        of the other, both there at the time, merge before either is merged into its own token. At equal ranks the
        leftmost merge goes first."""
        known = self.may_follow.setdefault(before, {})
        if token not in known:
            right = self.spine(token, 0)
            left = self.spine(before, 1) if before >= 0 else []
            get = self.ranks.get
            known[token] = bool(right) and not any((m := get(x + y)) is not None and m < x_until and m <= y_until for x, x_until in left for y, y_until in right)
        return known[token]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The token that ends with the byte, and the state after it."""
        guesses = []  # by place in the trie, deepest first: an order that the set alone determines
        children, ends = self.children, self.ends
        closed = -1
        for before, node in self.states[state]:
            child = children[node].get(byte)
            if child is None:
                continue
            if children[child]:
                guesses.append((before, child))
            token = ends[child]
            if token >= 0 and closed < 0 and self.follows(before, token):
                closed = token  # of all ways to end here one is valid
        if closed < 0:
            raise ValueError(f"byte {byte} ends no token")
        guesses.append((self.last(closed), 0))
        after = tuple(guesses)
        if len(self.states) >= STATES and after not in self.numbers:
            return closed, self.forget(after)
        self.steps[state][byte] = made = closed, self.number(after)
        return made

    def encode(self, text: bytes) -> tuple[int, ...]:
        if text in self.ranks:
            return (self.ranks[text],)  # the library takes a whole match that is a token, however it merges
        ending: list[int] = []
        state = 0
        for byte in text:
            token, state = self.steps[state].get(byte) or self.step(state, byte)
            ending.append(token)
        out, end = [], len(text)
        while end:
            out.append(ending[end - 1])
            end -= self.lengths[out[-1]]
        return tuple(out[::-1])


class Decoder:
    """Streaming decoder: takes ids one by one and gives out whole UTF-8 characters only.

    Its state is the beginning of a character, at most three bytes; the step for a state and an id is made once.
    Bytes that begin no character pass as they are.
    """

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens
        self.steps: dict[bytes, dict[int, tuple[bytes, bytes]]] = {b"": {}}

    @staticmethod
    def open_tail(data: bytes) -> int:
        """Length of the unfinished character at the end."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                need = 2 if byte & 0xE0 == 0xC0 else 3 if byte & 0xF0 == 0xE0 else 4 if byte & 0xF8 == 0xF0 else 1
                return back if back < need else 0
        return 0

    def step(self, state: bytes, token: int) -> tuple[bytes, bytes]:
        data = state + self.tokens[token]
        cut = len(data) - self.open_tail(data)
        made = self.steps.setdefault(state, {})[token] = (data[:cut], data[cut:])
        self.steps.setdefault(data[cut:], {})
        return made

    def decode(self, ids: Iterable[int]) -> Iterator[bytes]:
        state = b""
        steps = self.steps[state]
        for i in ids:
            made = steps.get(i) or self.step(state, i)
            if made[1] != state:
                steps = self.steps[made[1]]
            state = made[1]
            yield made[0]
        yield state


class Encoded(dict):
    """A bounded dictionary from a match to its ids and their decimal form, filled by a transducer."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, match: str) -> tuple[tuple[int, ...], bytes]:
        ids = self.transducer.encode(match.encode())
        made = (ids, ",".join(map(str, ids)).encode())
        if len(match) <= CACHE_CHARS:
            if len(self) > CACHE:
                self.clear()
            self[match] = made
        return made


@cache
def codec(ranks_path: str, pattern: str):
    """The pattern's ``findall``, the encoder and the decoder; one of each for all tasks of a worker."""
    import regex

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    explicit = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    transducer = Transducer(ranks)
    return regex.compile(explicit).findall, Encoded(transducer), Decoder(transducer.tokens)


def round_trip(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode each whole text (null: empty) and decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Matches of ``pattern`` are encoded separately, without special tokens. An empty text has no ids. Rows are
    independent: repeated ones give the same, a null doc_id stays null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches_of, encoded, decoder = codec(ranks_path, pattern)
        for batch in batches:
            sizes, ids_digests, text_digests = [], [], []
            for text in batch.column("text").to_pylist():
                ids_digest, text_digest = hashlib.sha256(), hashlib.sha256()
                parts = list(map(encoded.__getitem__, matches_of(text or "")))
                ids_digest.update(b",".join([p[1] for p in parts]))
                text_digest.update(b"".join(decoder.decode(i for p in parts for i in p[0])))
                sizes.append(sum([len(p[0]) for p in parts]))
                ids_digests.append(ids_digest.hexdigest())
                text_digests.append(text_digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
