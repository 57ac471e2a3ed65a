"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Pre-tokens are found without a regular expression: each codepoint gets a class, each class is a transition function of
a small automaton, and an associative scan composes these functions, so that the state before every codepoint is known
at once; a table of (state, class) says where a pre-token starts. The byte slices go through a cache of pair merges.
The byte length of every token follows from its id, so ids and offsets decode back to the bytes of the text.

Null texts count as empty: no tokens, an empty decoded text. Bytes that are no UTF-8 become U+FFFD first, as a library
that takes strings would have it. Rows keep their order within a partition; there is no shuffle. Repeated rows give
repeated results, and an empty table none. Very long texts are slices of their own, with memory in proportion to the
longest text. The results take the place of columns that bear their names; other columns stay, whatever they are called.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceIds
from .texts import slices, tidy

# Classes of codepoints.
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE = range(6)
# What a codepoint is in its place: the first three as their classes; a quote that begins a contraction of one or two
# letters; white space before more white space or the end; the last space or other blank of a run.
QUOTE_1, QUOTE_2, BLANKS_GO_ON, LAST_SPACE, LAST_BLANK = range(3, 8)
SIGNS = 8
# States: what the pre-token in progress is. OVER: the next codepoint starts one.
OVER, LETTERS, NUMBERS, OTHERS, BLANKS, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8

#: Pieces in each of the two generations of the cache.
CACHE_PIECES = 100_000
#: Pieces longer than this are merged with a heap.
LONG_PIECE = 48
#: Shorter ones are merged so many at a time, so that the arrays for them stay small.
TOGETHER = 1 << 14
#: The rank of a pair that doesn't merge.
NONE = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every codepoint, asked from the library whose results are to be matched: it returns the characters that a class matches."""
    import tiktoken

    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    table = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        asked = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        members = bytes(asked.encode_ordinary(every)).decode("utf-8")
        table[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    return table


def step(state: int, sign: int) -> tuple[int, bool]:
    """The state after a codepoint, and whether a pre-token starts at it."""
    if sign == LETTER:
        if state == TWO_LEFT:
            return ONE_LEFT, False
        if state == ONE_LEFT:
            return OVER, False
        return LETTERS, state not in (LETTERS, AFTER_SPACE)
    if sign == NUMBER:
        return NUMBERS, state not in (NUMBERS, AFTER_SPACE)
    if sign in (OTHER, QUOTE_1, QUOTE_2):
        if state in (OTHERS, AFTER_SPACE):
            return OTHERS, False
        return {OTHER: OTHERS, QUOTE_1: ONE_LEFT, QUOTE_2: TWO_LEFT}[sign], True
    if sign == BLANKS_GO_ON:
        return BLANKS, state != BLANKS
    return (AFTER_SPACE if sign == LAST_SPACE else OVER), True


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each sign's transition function (a second set of signs first resets the state: a new text), the
    composition table of all functions that arise, each function's state from OVER, and the starts by state and sign."""
    functions = [tuple(step(s, sign)[0] for s in range(STATES)) for sign in range(SIGNS)]
    functions += [(f[OVER],) * STATES for f in functions]
    number = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(STATES)), *functions]))}
    todo = list(number)
    while todo:
        f = todo.pop()
        for g in functions:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    every = list(number)
    table = np.array([[number[tuple(g[x] for x in f)] for g in every] for f in every], np.uint16)
    starts = np.array([[step(s, sign)[1] for sign in range(SIGNS)] for s in range(STATES)])
    return np.array([number[f] for f in functions], np.uint16), table, np.array([f[OVER] for f in every], np.uint8), starts


def scan(functions: np.ndarray, table: np.ndarray, width: int = 256) -> np.ndarray:
    """The composition of each function with all before it: within blocks, all blocks at once, then over the blocks' totals."""
    n, many = len(functions), len(table)
    if n <= width:
        out = functions.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat = table.ravel()
    for i in range(1, width):
        grid[i] = flat[grid[i - 1].astype(np.intp) * many + grid[i]]
    before = scan(grid[-1], table, width)[:-1].astype(np.intp)
    grid[:, 1:] = flat[before * many + grid[:, 1:]]
    return grid.T.ravel()[:n]


def boundaries(data: bytes, edge: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens of the rows start, and the end of the data."""
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(1, np.int64)
    place = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    first = np.zeros(n, bool)
    first[np.searchsorted(place, edge[:-1][edge[:-1] < edge[-1]])] = True
    last = np.append(first[1:], True)
    sign = class_table()[points]
    blank = (sign == SPACE) | (sign == BLANK)
    goes_on = blank & np.append(blank[1:], True) | blank & last
    ends = blank & ~goes_on
    quotes = np.flatnonzero(sign == QUOTE)
    space = sign == SPACE
    sign[goes_on] = BLANKS_GO_ON
    sign[ends] = LAST_BLANK
    sign[ends & space] = LAST_SPACE
    sign[quotes] = OTHER
    if quotes.size:
        ahead = np.append(points, [0, 0])
        shut = np.append(last, [True, True])
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        open_1, open_2 = ~shut[quotes], ~shut[quotes] & ~shut[quotes + 1]
        sign[quotes[open_1 & np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE_1
        pair = [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
        sign[quotes[open_2 & (pair[0] | pair[1] | pair[2])]] = QUOTE_2
    numbers, table, after, starts = automaton()
    done = after[scan(numbers[sign + SIGNS * first], table)]
    before = np.append(np.uint8(OVER), done[:-1])
    begins = starts[before, sign] | first
    return np.append(place[begins], len(data))


class Merger:
    """Pair merging by the ranks of a vocabulary, with a cache of pieces."""

    def __init__(self, ranks: dict[bytes, int], most: int = CACHE_PIECES):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.bytes_of = pa.array(self.tokens, pa.large_binary())
        self.pieces = PieceIds(self._resolve, most)
        # Ids of the single bytes, and of what each pair of ids merges into; without all bytes, pieces are merged one by one.
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        whole = {t: r for t, r in ranks.items() if len(t) > 1}
        pairs = [(ranks[t[:k]] * len(self.tokens) + ranks[t[k:]], r) for t, r in whole.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs, self.merged = np.array(sorted(pairs) or [(-1, NONE)], np.int64).T.copy()

    def _resolve(self, lot: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        get = self.ranks.get
        each = [None if (r := get(p)) is None else [r] for p in lot]
        short = [k for k, ids in enumerate(each) if ids is None and len(lot[k]) <= LONG_PIECE] if (self.single >= 0).all() else []
        for some in (short[k : k + TOGETHER] for k in range(0, len(short), TOGETHER)):
            for k, ids in zip(some, self._merge_lot([lot[k] for k in some])):
                each[k] = ids
        each = [self.merge(p) if ids is None else ids for p, ids in zip(lot, each)]
        return np.array([i for ids in each for i in ids], np.uint32), np.array(list(map(len, each)), np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair of ids merges into, NONE where it doesn't."""
        key = left * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NONE)

    def _merge_lot(self, lot: list[bytes]) -> list[list[int]]:
        """The ids of many pieces at once: in each round every piece that still can merges its pair of least rank, the leftmost of
        equals. Pieces lie end to end; the rank of a pair stands at its left id."""
        ids = self.single[np.frombuffer(b"".join(lot), np.uint8)]
        size = np.array(list(map(len, lot)), np.int64)
        own, out = np.arange(len(lot)), [[] for _ in lot]
        start = np.cumsum(size) - size
        rank = np.append(self._rank(ids[:-1], ids[1:]), NONE)
        rank[start + size - 1] = NONE
        while len(own):
            least = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), start)
            goes_on = least >> 32 < NONE
            if not goes_on.all():
                done = np.flatnonzero(~goes_on)
                for k, a, n in zip(own[done].tolist(), start[done].tolist(), size[done].tolist()):
                    out[k] = ids[a : a + n].tolist()
                keep = np.repeat(goes_on, size)
                gone = np.cumsum(np.where(goes_on, 0, size))[goes_on]
                ids, rank = ids[keep], rank[keep]
                own, size, start, least = own[goes_on], size[goes_on], start[goes_on] - gone, least[goes_on] - gone
                if not len(own):
                    break
            at = least & 0xFFFFFFFF
            ids[at] = least >> 32
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep]
            before = np.arange(len(own))  # one id less for each piece before
            at, start, size = at - before, start - before, size - 1
            inner = at < start + size - 1
            rank[at] = NONE
            rank[at[inner]] = self._rank(ids[at[inner]], ids[at[inner] + 1])
            led = at[at > start]
            rank[led - 1] = self._rank(ids[led - 1], ids[led])
        return out

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece: the pair of least rank merges first, the leftmost of equals."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._merge_long(piece) if len(piece) > LONG_PIECE else self._merge_short(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        get, none = self.ranks.get, len(self.tokens)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and linked ends: time n log n for a piece of any length."""
        get, n = self.ranks.get, len(piece)
        end, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def rank(i: int) -> int | None:
            j = end[i]
            return get(piece[i : end[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != to:
                continue
            alive[end[i]] = False
            end[i] = to
            if to < n:
                back[to] = i
            for k in (i, back[i]):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[end[k]]))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, data: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces between the cuts, and the number of ids of each piece."""
        return self.pieces.encode(data, cuts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, one after the other."""
        return bytes(self.bytes_of.take(pa.array(ids)).buffers()[2] or b"")


_mergers: dict[str, Merger] = {}


def merger(key: str, ranks: dict[bytes, int]) -> Merger:
    """The worker's own Merger of a vocabulary; it outlives tasks, so its cache does."""
    if key not in _mergers:
        _mergers.clear()
        _mergers[key] = Merger(ranks)
    return _mergers[key]


def whole(column: pa.Array) -> pa.Array:
    """The column with bytes that are no UTF-8 replaced."""
    try:
        column.validate(full=True)
        return column
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()], pa.string())


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """The columns `keep` of docs (all but the text by default), n_tokens, ids (binary, little-endian unsigned 32-bit
    integers) and token_bytes (binary, the same of each token's length in bytes: the offsets kept for decoding); with
    `decoded`, instead of token_bytes the bytes that the ids decode to. `vocabulary` is a rank file that the driver
    reads; its ranks are broadcast (a fixed size)."""
    ranks = read_ranks(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    names = [c for c in docs.columns if c != text] if keep is None else keep
    last = "decoded" if decoded else "token_bytes"
    names = [c for c in names if c not in ("n_tokens", "ids", last)]
    rest = docs.select(*names)
    source = docs.select(F.col(text).cast("string").alias("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(names)])
    out = rest.schema.add("n_tokens", "long").add("ids", "binary").add(last, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(vocabulary, sent.value)
        for batch in batches:
            for low, high, data, edge in slices(whole(batch.column(0))):
                cuts = boundaries(data, edge)
                ids, counts = own.encode(data, cuts)
                row = np.searchsorted(cuts[:-1], edge)
                split = np.append(0, np.cumsum(counts))[row].tolist()
                each = [ids[a:b] for a, b in zip(split, split[1:])]
                if decoded:
                    back = [own.decode(x) for x in each]
                else:
                    back = [own.lengths[x].astype(np.uint32).tobytes() for x in each]
                rest = batch.slice(low, high - low).columns[1:]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(split), pa.int64()), pa.array([x.tobytes() for x in each], pa.binary()), pa.array(back, pa.binary())], names=out.names)

    return source.mapInArrow(tidy(run), out)


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """tokens with `decoded`, the bytes of its ids; null ids count as none. An id that the vocabulary lacks is an error."""
    sent = tokens.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    source = tokens.drop("decoded")
    at = source.columns.index(ids)
    out = tokens.drop("decoded").schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(vocabulary, sent.value)
        for batch in batches:
            back = [own.decode(np.frombuffer(x or b"", np.uint32)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names=out.names)

    return source.mapInArrow(tidy(run), out)
