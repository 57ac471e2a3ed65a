"""Benchmark decontamination: suffix arrays over shards of the documents, searched for every suffix of the benchmark.

A shard is a run of rows of about SLICE_BYTES within a task. Its suffix array orders the word positions by their next
`window` words or more (ranks tripled: 1, 3, 9, 27 words). Every test suffix is looked up by binary search; the range of
suffixes that share its first `window` words gives its verbatim occurrences. Equal windows have one range, so what is
worked on is places and items, never pairs of them: an item and a document of one word repeated cost their lengths. From
each place found, a binary search among the sorted test suffixes gives the longest verbatim match that begins there;
the common length of two suffixes comes from digests of runs of 1, 2, 4, ... words, in as many steps as it has bits.

The documents are read once and never shuffled. The benchmark is written to the shared folder in blocks of BLOCK_BYTES
of text (an item longer than that is a block of its own); a task holds a few blocks at a time and takes each shard
through all of them. Only the list of blocks passes through the driver.

Words: A-Z lower-cased, runs of ASCII letters and digits and of all characters beyond ASCII. A null or empty text has
no words: a document without words is never hit, an item without words is never found, and no item gives no hit.
Repeated items count once by their ids as text, the null id as "None". Rows are judged one by one, so repeated rows give
repeated results. Of the documents only the id and the text are read, so other columns can't clash. A very long text is
a shard of its own, with memory in proportion to it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_folder
from .texts import SLICE_BYTES, byte_class, ragged, run_digests, slices, tidy, word_digests, word_spans

WINDOW = 10
#: Bytes of benchmark text in a block; blocks that a worker holds; shards are larger where there are more blocks than that.
BLOCK_BYTES, BLOCKS_HELD, LARGE_SHARD = 2 << 20, 8, 8 << 20

WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = bytes(range(256)).lower()
_DOC_END, _ITEM_END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def digests_of(data: bytes, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text in, digests of its lower-cased words in two streams (rows), and the first word of each row (n + 1)."""
    data = data.translate(_LOWER)
    starts, ends, first = word_spans(data, edge, WORD)
    return word_digests(data, starts, ends), first


def with_ends(words: np.ndarray, first: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The words with a mark after each row, which equals nothing else, and the place of each word."""
    rows = len(first) - 1
    place = np.arange(len(words)) + np.repeat(np.arange(rows), np.diff(first))
    out = (np.arange(len(words) + rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ salt
    out[place] = words
    return out, place


def _ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the values, and the rank of each, from 1; equal values share a rank."""
    order = np.argsort(values, kind="stable")
    fresh = np.ones(len(values), np.uint64)
    fresh[1:] = values[order[1:]] != values[order[:-1]]
    rank = np.empty(len(values), np.uint64)
    rank[order] = np.cumsum(fresh)
    return order, rank


def suffix_array(rank: np.ndarray, depth: int) -> np.ndarray:
    """The places in the order of what follows them, as far as `depth` words at least, or until no two are equal."""
    size = len(rank)
    order, rank = _ranks(rank)
    known, bits = 1, max(1, int(size).bit_length() + 1)
    parts = min(3, 63 // bits)
    while known < depth and size and int(rank.max()) < size:
        key = np.zeros(size, np.uint64)
        for k in range(parts):
            key <<= np.uint64(bits)
            if known * k < size:
                key[: size - known * k] |= rank[known * k :]
        order, rank = _ranks(key)
        known *= parts
    return order


class Runs:
    """Digests of runs of 1, 2, 4, ... words from each place of a sequence with end marks."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.levels = [symbols]
        while 1 << len(self.levels) <= longest:
            self.levels.append(run_digests(symbols, 1 << len(self.levels)))

    def common(self, place: np.ndarray, other: Runs, there: np.ndarray) -> np.ndarray:
        """The words that the suffixes at `place` and, in the other sequence, `there` have in common."""
        n = np.zeros(len(place), np.int64)
        for k in reversed(range(min(len(self.levels), len(other.levels)))):
            a, b = self.levels[k], other.levels[k]
            x, y = place + n, there + n
            fits = np.flatnonzero((x < len(a)) & (y < len(b)))
            n[fits[a[x[fits]] == b[y[fits]]]] += 1 << k
        return n


class Tests:
    """The words of a block of benchmark items, and their windows."""

    def __init__(self, names: list[str], words: list[np.ndarray], window: int):
        counts = np.array([w.shape[1] for w in words], np.int64)
        first = np.append(0, np.cumsum(counts))
        every = np.concatenate([np.zeros((2, 0), np.uint64), *words], axis=1)
        self.names, self.window, self.longest = names, window, int(counts.max(initial=0))
        self.symbols, self.place = with_ends(every[0], first, _ITEM_END)
        self.words, self.twins = every
        width = np.minimum(counts, window)
        n = counts - width + (counts > 0)
        #: For each window: its first word, its place, its words, its item; each test suffix that is long enough has one.
        self.at = ragged(first[:-1], n)
        self.begin = self.place[self.at]
        self.width = np.repeat(width, n)
        self.item = np.repeat(np.arange(len(names)), n)

    @cached_property
    def runs(self) -> Runs:
        return Runs(self.symbols, self.longest)

    @cached_property
    def order(self) -> np.ndarray:
        """The suffix array of the block itself."""
        return suffix_array(self.symbols, self.longest + 1)

    @cached_property
    def keys(self) -> np.ndarray:
        """At each place the item, as a place among the ids sorted as text, and the word within it, as one number."""
        nth = {name: k for k, name in enumerate(self.sorted_names)}
        by_name = np.array([nth[name] for name in self.names], np.int64)
        mark = np.ones(len(self.symbols), bool)
        mark[self.place] = False
        item = np.cumsum(mark)[self.place]
        start = np.append(0, np.flatnonzero(mark) + 1)
        out = np.full(len(self.symbols), np.iinfo(np.int64).max)
        out[self.place] = by_name[item] << 32 | (self.place - start[item])
        return out

    @cached_property
    def sorted_names(self) -> list[str]:
        return sorted(set(self.names))


class Shard:
    """A suffix array over the words of a run of rows; a mark that no word equals ends each row."""

    def __init__(self, data: bytes, edge: np.ndarray, depth: int):
        (one, two), self.first = digests_of(data, edge)
        rows = len(edge) - 1
        self.symbols, self.place = with_ends(one, self.first, _DOC_END)
        #: The place at which each row begins.
        self.begin = self.first[:-1] + np.arange(rows)
        self.vocabulary, at, number = np.unique(one, return_index=True, return_inverse=True)
        self.check = two[at]
        self.ids = np.zeros(len(self.symbols) + 1, np.int64)
        self.ids[self.place] = number + 1
        self.array = suffix_array(self.ids[:-1].astype(np.uint64), depth)

    def numbers(self, tests: Tests) -> np.ndarray:
        """The test words as numbers of this shard's vocabulary; -1 where it lacks the word."""
        if not len(self.vocabulary):
            return np.full(len(tests.words), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, tests.words), len(self.vocabulary) - 1)
        same = (self.vocabulary[at] == tests.words) & (self.check[at] == tests.twins)
        return np.where(same, at + 1, -1)

    def bounds(self, words: np.ndarray, at: np.ndarray, width: np.ndarray, after: bool) -> np.ndarray:
        """Binary search of all suffixes at once: how many suffixes of the array come before words[at : at + width],
        or, if after, before or equal to it in its first `width` words."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.array), np.int64)
        last = len(self.ids) - 1
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            here = self.array[mid]
            sign = np.zeros(len(open_), np.int8)
            live = np.arange(len(open_))
            for k in range(int(width.max(initial=0))):
                live = live[width[open_[live]] > k]
                if not live.size:
                    break
                ours = self.ids[np.minimum(here[live] + k, last)]
                theirs = words[at[open_[live]] + k]
                sign[live] = np.sign(ours - theirs)
                live = live[ours == theirs]
            right = sign <= 0 if after else sign < 0
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        return low

    def found(self, tests: Tests) -> Found | None:
        """The occurrences of the test windows, if there are any."""
        words = self.numbers(tests)
        missing = np.concatenate([[0], np.cumsum(words < 0)])
        able = np.flatnonzero(missing[tests.at + tests.width] == missing[tests.at])
        if not able.size or not len(self.array):
            return None
        at, width = tests.at[able], tests.width[able]
        low = self.bounds(words, at, width, False)
        n = self.bounds(words, at, width, True) - low
        there = n > 0
        return Found(self, tests, able[there], low[there], n[there]) if there.any() else None


class Found:
    """The test windows that occur in a shard, equal ones as one range of its suffix array."""

    def __init__(self, shard: Shard, tests: Tests, which: np.ndarray, low: np.ndarray, n: np.ndarray):
        self.shard, self.tests, self.which = shard, tests, which
        width = tests.width[which]
        _, one, self.range = np.unique(low * (int(width.max()) + 1) + width, return_index=True, return_inverse=True)
        self.width = width[one]
        self.place = shard.array[ragged(low[one], n[one])]
        self.of = np.repeat(np.arange(len(one)), n[one])
        self.row = np.searchsorted(shard.begin, self.place, side="right") - 1

    def cover(self, change: np.ndarray) -> None:
        """Add 1 where an occurrence begins, and take it off where it is over."""
        np.add.at(change, self.place, 1)
        np.add.at(change, self.place + self.width[self.of], -1)

    def items(self) -> Iterator[tuple[int, list[str]]]:
        """Each row with the items found in it. Ranges with the same items count as one."""
        n_items = len(self.tests.names)
        pairs = np.unique(self.range * n_items + self.tests.item[self.which])
        cut = np.searchsorted(pairs, np.arange(len(self.width) + 1) * n_items)
        items = pairs % n_items
        sets: dict[bytes, int] = {}
        number = np.array([sets.setdefault(items[a:b].tobytes(), len(sets)) for a, b in zip(cut.tolist(), cut[1:].tolist())], np.int64)
        lists = [np.frombuffer(x, np.int64) for x in sets]
        sizes = np.array(list(map(len, lists)), np.int64)
        rows = np.unique(self.row * len(sets) + number[self.of])
        row, own = rows // len(sets), rows % len(sets)
        every = np.concatenate(lists)[ragged((np.cumsum(sizes) - sizes)[own], sizes[own])]
        pairs = np.unique(np.repeat(row, sizes[own]) * n_items + every)
        row = pairs // n_items
        for a, b in zip(starts := np.flatnonzero(np.diff(row, prepend=-1)), np.append(starts[1:], len(row))):
            yield int(row[a]), [self.tests.names[k] for k in (pairs[a:b] % n_items).tolist()]

    def longest(self) -> Iterator[tuple[int, tuple[int, str, int, int]]]:
        """Each row with its longest match: minus its words, the item, the place in the item and in the row; of equally long ones the
        first in the row, and there the one of the least item and place in it."""
        tests, shard = self.tests, self.shard
        # The widest range of each place.
        order = np.lexsort([-self.width[self.of], self.place])
        keep = order[np.flatnonzero(np.diff(self.place[order], prepend=-1))]
        place, row, of = self.place[keep], self.row[keep], self.of[keep]
        ours, end = Runs(shard.symbols, tests.longest), len(tests.order)
        common = lambda k, at: ours.common(place[k], tests.runs, tests.order[at])
        # Where the suffix at each place would stand among the test suffixes.
        low, high = np.zeros(len(place), np.int64), np.full(len(place), end)
        while (k := np.flatnonzero(low < high)).size:
            mid = (low[k] + high[k]) >> 1
            n = common(k, mid)
            x, y = place[k] + n, tests.order[mid] + n
            after = np.zeros(len(k), bool)
            inside = (x < len(shard.symbols)) & (y < len(tests.symbols))
            after[inside] = tests.symbols[y[inside]] < shard.symbols[x[inside]]
            low[k[after]] = mid[after] + 1
            high[k[~after]] = mid[~after]
        every = np.arange(len(place))
        left, right = (np.where((at >= 0) & (at < end), common(every, np.clip(at, 0, end - 1)), 0) for at in (low - 1, low))
        length = np.maximum(left, right)
        # What is shorter than a window only counts as a whole item.
        whole = length < tests.window
        length[whole] = self.width[of[whole]]
        best = np.lexsort([place, -length, row])
        best = best[np.flatnonzero(np.diff(row[best], prepend=-1))]

        def edge(up: bool) -> np.ndarray:
            """The first, or one past the last, of the test suffixes that share the whole match."""
            at = np.clip(np.where(left[best] >= length[best], low[best] - 1, low[best]), 0, end - 1)
            a, b = (at, np.full(len(best), end)) if up else (np.full(len(best), -1), at.copy())
            while (k := np.flatnonzero(b - a > 1)).size:
                mid = (a[k] + b[k]) >> 1
                same = common(best[k], mid) >= length[best[k]]
                a[k[same == up]] = mid[same == up]
                b[k[same != up]] = mid[same != up]
            return b

        least = np.full(len(self.width), np.iinfo(np.int64).max)
        np.minimum.at(least, self.range, tests.keys[tests.begin[self.which]])
        for k, a, b in zip(best.tolist(), edge(False).tolist(), edge(True).tolist()):
            key = int(least[of[k]] if whole[k] else tests.keys[tests.order[a:b]].min())
            yield int(row[k]), (-int(length[k]), tests.sorted_names[key >> 32], key & 0xFFFFFFFF, int(place[k] - shard.begin[row[k]]))


class Benchmark:
    """The blocks of a benchmark in the shared folder, and the few that a worker holds."""

    held: OrderedDict[tuple[str, int], Tests] = OrderedDict()

    def __init__(self, paths: list[str], window: int):
        self.paths, self.window = paths, window
        self.shard_bytes = SLICE_BYTES if len(paths) <= BLOCKS_HELD else LARGE_SHARD

    def blocks(self) -> Iterator[Tests]:
        for path in self.paths:
            own = self.held.pop((path, self.window), None)
            if own is None:
                while len(self.held) >= BLOCKS_HELD:
                    self.held.popitem(last=False)
                where, at = fs.FileSystem.from_uri(path)
                rows = pq.read_table(at, filesystem=where)
                own = Tests(rows.column("item").to_pylist(), [np.frombuffer(w, np.uint64).reshape(2, -1) for w in rows.column("words").to_pylist()], self.window)
            self.held[path, self.window] = own
            yield own


def stored(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Benchmark:
    """The benchmark's items as digests of their words, in blocks in the shared folder; only files of successful tasks count."""
    spark = benchmark.sparkSession
    folder = new_folder(spark, "benchmark")
    source = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("None")).alias("item"), F.col(text).cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = fs.FileSystem.from_uri(folder)
        files.create_dir(where, recursive=True)
        names, words, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal names, words, held
            name = f"block-{uuid.uuid4().hex}.parquet"
            pq.write_table(pa.table({"item": pa.array(names, pa.string()), "words": pa.array(words, pa.large_binary())}), f"{where}/{name}", filesystem=files)
            names, words, held = [], [], 0
            return pa.record_batch([pa.array([f"{folder}/{name}"])], names=["path"])

        for batch in batches:
            for low, high, data, edge in slices(batch.column(1), block_bytes):
                digests, first = digests_of(data, edge)
                for k, name in enumerate(batch.column(0)[low:high].to_pylist()):
                    own = digests[:, first[k] : first[k + 1]]
                    if not own.shape[1]:
                        continue
                    if held and held + int(edge[k + 1] - edge[k]) > block_bytes:
                        yield flush()
                    names.append(name)
                    words.append(np.ascontiguousarray(own).tobytes())
                    held += int(edge[k + 1] - edge[k])
        if names:
            yield flush()

    parts = max(1, -(-size // block_bytes))
    return Benchmark(sorted(r["path"] for r in source.repartition(parts).mapInArrow(tidy(save), "path string").collect()), window)


REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_item string, longest_item_word long, longest_doc_word long"


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document: n_words, n_hit (words inside an occurrence of a test window), n_items (items with one), items_sha256
    (of those ids as text, sorted, comma-joined), contaminated (n_hit > 0), and the longest verbatim match of a test suffix: its
    words, its item, and where it begins in the item and in the document (word numbers from 0; 0 words and nulls without a match).
    Of equally long matches the first in the document counts, and there the one of the least item id (as text) and place in it.
    Ids may be of any type."""
    tests = stored(benchmark, window, item_id, item_text, block_bytes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, edge in slices(batch.column(1), tests.shard_bytes):
                shard = Shard(data, edge, window)
                change = np.zeros(len(shard.ids) + 1, np.int64)
                names: dict[int, set[str]] = {}
                best: dict[int, tuple[int, str, int, int]] = {}
                for block in tests.blocks():
                    if (found := shard.found(block)) is not None:
                        found.cover(change)
                        for row, own in found.items():
                            names.setdefault(row, set()).update(own)
                        for row, match in found.longest():
                            # Of equally long ones the first in the row, then by item.
                            best[row] = min(best.get(row, match), match, key=lambda m: (m[0], m[3], m[1], m[2]))
                hit = np.append(0, np.cumsum(np.cumsum(change)[shard.place] > 0))
                hits = hit[shard.first[1:]] - hit[shard.first[:-1]]
                lists = [sorted(names.get(k, ())) for k in range(high - low)]
                matches = [best.get(k, (0, None, None, None)) for k in range(high - low)]
                yield pa.record_batch(
                    [
                        batch.column(0)[low:high],
                        pa.array(np.diff(shard.first)),
                        pa.array(hits),
                        pa.array(map(len, lists), pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists], pa.string()),
                        pa.array(hits > 0),
                        pa.array([-m[0] for m in matches], pa.int64()),
                        pa.array([m[1] for m in matches], pa.string()),
                        pa.array([m[2] for m in matches], pa.int64()),
                        pa.array([m[3] for m in matches], pa.int64()),
                    ],
                    names=["doc_id", *(c.split(" ")[0] for c in REPORT.split(", "))],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(search), f"doc_id {kind}, {REPORT}")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without a hit word, with the columns of docs, whatever their names; they are filtered as they pass."""
    tests = stored(benchmark, window, item_id, item_text, block_bytes)
    at = docs.columns.index(text)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, edge in slices(batch.column(at), tests.shard_bytes):
                shard = Shard(data, edge, window)
                clean = np.ones(high - low, bool)
                for block in tests.blocks():
                    if (found := shard.found(block)) is not None:
                        clean[found.row] = False
                yield batch.slice(low, high - low).filter(pa.array(clean))

    return docs.mapInArrow(tidy(search), docs.schema)
