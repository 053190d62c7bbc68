"""Best-fit packing of token sequences with swap-based local search (operator 1)."""

from __future__ import annotations

import bisect
import math
import os
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialise

#: Tokens in a sequence.
CAPACITY = 4096
#: Pieces that one task packs together.
BLOCK = 4096
#: Sequences with more free tokens than this are opened again at the next level.
SLACK = 16
#: Share of its sequences that a level must save for another level to follow.
WORTH = 0.001
#: Blocks of rows that a task packs together from the second level on, where only underfull sequences' pieces are left.
WIDER = 8
#: Bytes of texts that are tokenised at once, unless one text has more, and chunks whose ids are gathered at once.
SLICE, GATHER = 6 << 20, 1 << 20
#: Words of which a worker remembers the ids, those used last and as many used before them, and the longest that it remembers.
CACHE, CACHE_CHARS = 200_000, 64
#: New words, and chunks that aren't plain, that go to the tokenizer in one call: what it gives for each takes far more memory than its ids.
LEARN = 4096
#: Characters that normalisation leaves alone but for lower case, the same in Python and in the tokenizer.
PLAIN = r"^[\x{21}-\x{7E}\x{A1}-\x{12F}\x{131}-\x{17F}]+$"
#: The tokenizer's own split of such text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Pool:
    """The ids of many strings: ``ids`` one after the other, and each string's start and count."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.sizes, self.starts = ids, sizes, np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, parts: list[bytes]) -> Pool:
        return cls(np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4)

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the strings at these numbers, one after the other."""
        n = self.sizes[at]
        return self.ids[np.arange(n.sum()) + np.repeat(self.starts[at] - (np.cumsum(n) - n), n)]


@cache
def chunk_ids(tokenizer: str) -> Callable[[pa.Array], Pool]:
    """A function from chunks without ASCII white space to their ids; one for all tasks of a worker.

    The tokenizer drops white space and joins nothing across it. Plain chunks are split into words, whose ids are kept
    in a bounded dictionary; new words, and chunks that aren't plain, go to the tokenizer in one call for all.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    specials = [x.content for x in model.get_added_tokens_decoder().values()]
    words_of = regex.compile(f"{WORDS}| ").findall
    known: dict[str, bytes] = {}
    before: dict[str, bytes] = {}

    def learn(words: list[str]) -> dict[str, bytes]:
        found = model.encode(" ".join(words), add_special_tokens=False)
        sizes = np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))
        ends, ids = (np.cumsum(sizes) * 4).tolist(), np.array(found.ids, "<u4").tobytes()
        return {w: ids[a:b] for w, a, b in zip(words, [0, *ends], ends)}

    def of_words(words: list[str]) -> list[bytes]:
        nonlocal known, before
        if len(known) > CACHE:
            known, before = {}, known
        known |= {w: before[w] for w in words if w in before}
        unseen, new = [w for w in words if w not in known and w != " "], {}
        for k in range(0, len(unseen), LEARN):
            new |= learn(unseen[k : k + LEARN])
        known.update((w, ids) for w, ids in new.items() if len(w) <= CACHE_CHARS)
        new[" "] = b""
        return [new[w] if w in new else known[w] for w in words]

    def ids_of(chunks: pa.Array) -> Pool:
        plain = pc.match_substring_regex(chunks, PLAIN)
        for special in specials:
            plain = pc.and_not(plain, pc.match_substring(chunks, special))
        mask = plain.to_numpy(zero_copy_only=False)
        text = " ".join(chunks.filter(plain).to_pylist()).lower()
        words = pa.array(words_of(text), pa.string()).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        pool, at = Pool.of(of_words(distinct)), words.indices.to_numpy()
        others = chunks.filter(pc.invert(plain))
        calls = (model.encode_batch_fast(others.slice(k, LEARN).to_pylist(), add_special_tokens=False) for k in range(0, len(others), LEARN))
        rest = Pool.of([np.array(e.ids, "<u4").tobytes() for call in calls for e in call])
        sizes = np.zeros(len(chunks), np.int64)
        sizes[~mask] = rest.sizes
        if mask.any():
            blank = distinct.index(" ") if " " in distinct else -1
            ends = np.append(np.flatnonzero(at == blank), len(at))
            reached = np.concatenate([[0], np.cumsum(pool.sizes[at])])[ends]
            sizes[mask] = np.diff(reached, prepend=0)
        made = Pool(np.concatenate([pool.gather(at), rest.ids]), sizes)
        # Ids of plain chunks lie before those of the others.
        made.starts[mask] = np.cumsum(sizes[mask]) - sizes[mask]
        made.starts[~mask] = sizes[mask].sum() + rest.starts
        return made

    return ids_of


def token_ids(texts: pa.Array, ids_of: Callable[[pa.Array], Pool]) -> Iterator[np.ndarray]:
    """The ids of each text in order. Distinct chunks are looked up once a batch, and their ids gathered by place."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    pool, index = ids_of(coded.dictionary), coded.indices.to_numpy()
    for first, end in zip(ends[:-1], ends[1:]):
        yield np.concatenate([pool.gather(index[k : min(k + GATHER, end)]) for k in range(first, max(end, first + 1), GATHER)])


def pieces(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32.

    A document's ids are the tokenizer's for its text (null: empty), without special tokens, then ``end_id``; thus an
    empty text makes one piece of one token. The crc is over the ids as little-endian unsigned 32-bit numbers.

    Repeated rows are packed as often as they occur; columns beside doc_id and text are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = chunk_ids(tokenizer)
        tail = np.array([end_id], "<u4")
        for batch in batches:
            rows, texts = [], batch.column("text")
            step = max(1, SLICE * len(texts) // max(1, texts.nbytes))
            for row, ids in enumerate(chain.from_iterable(token_ids(texts.slice(k, step), ids_of) for k in range(0, len(texts), step))):
                ids = np.concatenate([ids, tail])
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity]
                    rows.append((row, k // capacity, k, len(part), zlib.crc32(part)))
            made = np.array(rows, np.int64).reshape(-1, 5).T
            columns = [batch.column("doc_id").take(pa.array(made[0])), pa.array(made[1].astype(np.int32)), *map(pa.array, made[2:])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES)


class Search:
    """Swap-based local search over the bins of a block.

    A step takes tokens out of one bin and puts them into another so that the sum of squared fills rises: an item moves,
    or is exchanged for a shorter one, or for two that are shorter together. Moving ``d`` tokens from a fill of ``f`` to
    one of ``g`` raises it where ``g + d > f``.
    """

    def __init__(self, lengths: list[int], bins: list[int], capacity: int) -> None:
        self.size, self.bin, self.capacity = np.array(lengths), np.array(bins), capacity
        self.fill = np.bincount(self.bin, self.size).astype(np.int64)
        self.view = self.pairs = None
        self.items: list[set[int]] = [set() for _ in self.fill]
        for i, b in enumerate(bins):
            self.items[b].add(i)

    def put(self, item: int, target: int) -> None:
        source, n = int(self.bin[item]), self.size[item]
        self.items[source].remove(item)
        self.items[target].add(item)
        self.fill[source] -= n
        self.fill[target] += n
        self.bin[item] = target
        self.view = self.pairs = None

    def underfull(self) -> tuple[np.ndarray, ...]:
        """The underfull bins, and the items in them with their lengths, bins and the room there; kept until a step."""
        if self.view is None:
            is_open = (self.fill > 0) & (self.fill < self.capacity)
            others = np.flatnonzero(is_open[self.bin])
            of = self.bin[others]
            self.view = np.flatnonzero(is_open), others, self.size[others], of, self.capacity - self.fill[of]
        return self.view

    def by_bin(self) -> tuple[np.ndarray, ...]:
        """The items of underfull bins in order of (bin, length), and each bin's first and last place among them."""
        if self.pairs is None:
            _, others, lengths, of, _ = self.underfull()
            by = np.lexsort((lengths, of))
            of = of[by]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            ends = np.append(starts[1:], len(of))
            several = ends - starts > 1
            self.pairs = others[by], lengths[by], of, starts[several], ends[several]
        return self.pairs

    def step(self, source: int) -> bool:
        """One step that takes tokens out of ``source``: the first of a move to the fullest bin, the exchange that takes
        most and the exchange for two, over its items from the longest on. False if there is none."""
        size, here = self.size, self.fill[source]
        order = sorted(self.items[source], key=lambda i: (-size[i], i))
        targets, others, lengths, of, room_there = self.underfull()
        fills = self.fill[targets]
        for i in order:
            fits = (fills + size[i] <= self.capacity) & (fills + size[i] > here) & (targets != source)
            if fits.any():
                self.put(i, int(targets[np.argmax(np.where(fits, fills, -1))]))
                return True
        least = np.where(of == source, self.capacity + 1, np.maximum(1, here - self.fill[of] + 1))
        for i in order:
            taken = size[i] - lengths
            fits = (taken <= room_there) & (taken >= least)
            if fits.any():
                k = int(np.argmax(np.where(fits, taken, -1)))
                j, target = int(others[k]), int(of[k])
                self.put(j, source)
                self.put(i, target)
                return True
        # For two: of the bins whose shortest and longest pairs leave it possible, the first with a pair that fits.
        others, lengths, of, starts, ends = self.by_bin()
        at = of[starts]
        room, least = self.capacity - self.fill[at], np.maximum(1, here - self.fill[at] + 1)
        shortest, longest = lengths[starts] + lengths[starts + 1], lengths[ends - 1] + lengths[ends - 2]
        for i in order:
            low, high = size[i] - room, size[i] - least
            for b in np.flatnonzero((at != source) & (shortest <= high) & (longest >= low)).tolist():
                one, two = int(starts[b]), int(ends[b]) - 1
                while one < two and not low[b] <= (both := lengths[one] + lengths[two]) <= high[b]:
                    one, two = (one, two - 1) if both > high[b] else (one + 1, two)
                if one < two:
                    target = int(at[b])
                    for k in (one, two):
                        self.put(int(others[k]), source)
                    self.put(i, target)
                    return True
        return False

    def run(self) -> np.ndarray:
        """Steps from the emptiest bins on until none is left or the count of bins reaches its lower bound."""
        least = -(-int(self.size.sum()) // self.capacity)
        again = True
        while again and (self.fill > 0).sum() > least:
            again = False
            for source in sorted(np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)).tolist(), key=lambda b: self.fill[b]):
                while self.items[source] and self.step(source):
                    again = True
                if not self.items[source] and (self.fill > 0).sum() <= least:
                    break
        return self.bin


def pack_block(lengths: list[int], capacity: int = CAPACITY, search: bool = True) -> list[int]:
    """The bin of each item: best fit in descending order of length, then local search to its fixed point, which is where
    no move or exchange raises the sum of squared fills, or to as few bins as the sum of lengths allows."""
    free: list[tuple[int, int]] = []  # (room, bin), ascending
    bins, n = [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect.bisect_left(free, (lengths[i], -1))
        r, b = free.pop(at) if at < len(free) else (capacity, n)
        n = max(n, b + 1)
        bins[i] = b
        if r > lengths[i]:
            bisect.insort(free, (r - lengths[i], b))
    if search and n > math.ceil(sum(lengths) / capacity):
        bins = Search(lengths, bins, capacity).run().tolist()
    used = {b: k for k, b in enumerate(sorted(set(bins)))}
    return [used[b] for b in bins]


def pack(parts: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Pack rows with a ``length`` of 1 to ``capacity`` into sequences; adds sequence_id and offset (both long).

    Rows are numbered and dealt by a hash of their number to blocks of about ``block`` rows, repeated ones too, each
    block packed in a task of its own by best fit. Sequences left with more than ``SLACK`` free tokens are opened, and
    their pieces go on to the local search (a table of one block goes there at once): they are dealt anew to as many blocks, ``WIDER`` times as large, as they need: up to a level of one block, or until a level saves fewer than
    ``WORTH`` of its sequences, as where no two pieces fit together. So a task's size doesn't grow with the input.
    Within a block ties go by doc_id, piece and start. An empty table stays empty.
    """
    columns = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    row, in_level, in_block, free = (fresh(c, parts.columns) for c in ("row", "level", "block", "free"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in parts.schema if f.name in columns)}, `{row}` long, sequence_id long, offset long, `{free}` long"

    def packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        level, number = key
        group = group.sort_values(["doc_id", "piece", "start"], kind="stable").reset_index(drop=True)
        bins = pd.Series(pack_block(group["length"].tolist(), capacity, search=level > 0 or single))
        group["sequence_id"] = (level << 56) + (number << 24) + bins
        group["offset"] = group["length"].groupby(bins).cumsum() - group["length"]
        group[free] = capacity - group["length"].groupby(bins).transform("sum")
        return group[[*columns, row, "sequence_id", "offset", free]]

    single = False
    rest = materialise(parts.select(*columns).withColumn(row, F.monotonically_increasing_id()), "pieces")
    n, sequences, level, done = rest.count(), None, 0, None
    while True:
        blocks = max(1, math.ceil(n / (block * (WIDER if level else 1))))
        single = blocks == 1
        keyed = rest.withColumn(in_level, F.lit(level).cast("long")).withColumn(in_block, F.pmod(F.xxhash64(row, F.lit(level)), F.lit(blocks)).cast("long"))
        rows = materialise(keyed.groupBy(in_level, in_block).applyInPandas(packed, schema), "packed")
        if level == 0:
            discard(rest)
        made = F.count_distinct("sequence_id")
        now, opened, n = rows.agg(made, F.count_distinct(F.when(F.col(free) > SLACK, F.col("sequence_id"))), F.count(F.when(F.col(free) > SLACK, 1))).first()
        last = single or (sequences is not None and sequences - now < WORTH * sequences)
        full = (rows if last else rows.where(F.col(free) <= SLACK)).drop(row, free)
        done = full if done is None else done.unionByName(full)
        if last:
            return done
        rest = rows.where(F.col(free) > SLACK).select(*columns, row)
        sequences, level = opened, level + 1


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack ``documents`` (doc_id, text): a row per piece with its sequence and place."""
    return pack(pieces(documents, tokenizer, end_id, capacity), capacity)
