"""Token-id files: each id in the fewest bits that the vocabulary needs, with block offsets for random access.

File: the mark IDPACK01; bits and ids per block (unsigned 32-bit); numbers of documents and ids (signed 64-bit); the
document ids; the end of each document, counted in ids; the byte offset of each block and of the end; the blocks. A
block holds its ids bit by bit, lowest first, and begins at a byte. All numbers are little-endian.

The documents are dealt to parts by ranges of their ids, sorted there, and written in files of a bounded number of
ids, so that the files in the order of their names hold all documents by ascending id. An id that many rows bear (null is
one) gets several parts, by ranges of a digest of the ids. A file is written under another name and then renamed, so a
task that is run again replaces it by the same. Null texts count as empty; each document ends with the end id, so none
is without ids. Null document ids come first; rows of equal id follow the digest of their ids, then their bytes. An empty
table gives no files. A very long text is encoded by itself, with memory in proportion to it. Only the id and the text
are read, so other columns can't clash.

As in the library, the vocabulary's added tokens that stand in a text are those tokens, in this very spelling.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import whole
from .pieces import PieceIds
from .shared import new_folder, written
from .texts import PLAIN_WORD, byte_class, ragged, slices, tidy

MARK = b"IDPACK01"
BLOCK = 4096
#: Ids of a file, but for its last document.
FILE_IDS = 1 << 21
CACHE_PIECES = 600_000
#: The null document id in a file.
NO_ID = -(1 << 63)
#: The library encodes parts of the text one by one: its normaliser and splitter never look across ASCII white space, nor
#: between an ASCII letter and an ASCII sign that begins or ends no contraction and no special token.
#: Kinds of bytes: 0 white space, 1 letters, 2 such signs, 4 all others.
KINDS = (
    4 * PLAIN_WORD
    - 3 * ~byte_class((0x41, 0x5A), (0x61, 0x7A))
    - 2 * ~byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7E))
).astype(np.uint8)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, lowest bit first; whole bytes are that already."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    narrow = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = narrow
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def to_file(doc_ids: list[int], docs: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    return b"".join(
        [
            MARK,
            np.array([bits, block], "<u4").tobytes(),
            np.array([len(docs), len(ids)], "<i8").tobytes(),
            np.array(doc_ids, "<i8").tobytes(),
            np.cumsum([len(d) for d in docs]).astype("<i8").tobytes(),
            np.cumsum([0] + [len(b) for b in blocks]).astype("<i8").tobytes(),
            *blocks,
        ]
    )


class TokenFile:
    """A file's contents: whole, or any document by its place."""

    def __init__(self, data: bytes):
        if data[:8] != MARK:
            raise ValueError("not a token-id file")
        self.bits, self.block = (int(x) for x in np.frombuffer(data, "<u4", 2, 8))
        n, self.n_ids = (int(x) for x in np.frombuffer(data, "<i8", 2, 16))
        self.doc_ids = np.frombuffer(data, "<i8", n, 32)
        self.ends = np.frombuffer(data, "<i8", n, 32 + 8 * n)
        self.n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<i8", self.n_blocks + 1, 32 + 16 * n)
        self.data = memoryview(data)[32 + 16 * n + 8 * (self.n_blocks + 1) :]

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-end // self.block)
        parts = [unpack(self.data[self.offsets[k] : self.offsets[k + 1]], min(self.block, self.n_ids - k * self.block), self.bits) for k in range(first, last)]
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def parts(data: bytes, edge: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The parts with A-Z lower-cased, as the normaliser would, and the number of each row's first part: words, with the
    signs around them apart, so that there are far fewer different ones."""
    raw = np.frombuffer(data, np.uint8)
    kind = KINDS[raw]
    last = np.zeros(len(kind), np.uint8)
    last[1:] = kind[:-1]
    apart = kind + last == 3
    rows = edge[1:-1][(edge[1:-1] > 0) & (edge[1:-1] < len(raw))]
    apart[rows] = (kind[rows] > 0) & (last[rows] > 0)
    begins = np.flatnonzero(apart | ((kind > 0) & (last == 0)))
    cuts = np.flatnonzero(apart)
    spaced = np.full(len(raw) + len(cuts), 0x20, np.uint8)
    own = np.ones(len(spaced), bool)
    own[cuts + np.arange(len(cuts))] = False
    spaced[own] = raw
    return spaced.tobytes().lower().split(), np.searchsorted(begins, edge)


class Added:
    """The added tokens of a vocabulary. The library cuts texts at them before anything else, the longest first where several
    begin; a token with another rule than that is an error."""

    #: No byte of a text in UTF-8: it begins the part that stands for an added token, before the token's number.
    MARK = b"\xff"

    def __init__(self, text: str):
        every = json.loads(text).get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in every):
            raise ValueError("an added token with a rule of its own")
        self.ids = [t["id"] for t in every]
        self.number = {t["content"].encode(): k for k, t in enumerate(every)}
        longest_first = sorted(self.number, key=len, reverse=True)
        self.pattern = re.compile(b"|".join(map(re.escape, longest_first))) if every else None

    def marked(self, data: bytes, edge: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The rows with each added token as a part of its own, and the new row offsets."""
        if self.pattern is None or not self.pattern.search(data):
            return data, edge
        rows = [self.pattern.sub(lambda m: b" %b%d " % (self.MARK, self.number[m[0]]), data[a:b]) for a, b in zip(edge.tolist(), edge[1:].tolist())]
        return b"".join(rows), np.cumsum([0, *map(len, rows)])


_caches: dict[str, PieceIds] = {}


def _one_word(piece: str) -> bool:
    """Whether the library certainly takes a part as one word: small Latin letters only."""
    return piece.isalpha() and piece.islower() and max(piece) < "\u0250"


def resolver(text: str, marks: str = "~^`|{}") -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """The library's ids of many parts in few calls. Parts that are one word stand side by side, and the tokens that end
    a word part the ids. Between the others stands a sign that none of them holds and that is one token of its own;
    without such a sign each is encoded by itself. Added tokens come marked, so what looks like one here isn't."""
    from tokenizers import Tokenizer

    own, added = Tokenizer.from_str(text), Added(text)
    own.encode_special_tokens = True
    fast = lambda lot: [e.ids for e in own.encode_batch_fast(lot, add_special_tokens=False)]
    single = {m: ids[0] for m, ids in zip(marks, fast(list(marks))) if len(ids) == 1}
    suffix = json.loads(text)["model"].get("end_of_word_suffix")
    ends = np.zeros(own.get_vocab_size(), bool)
    ends[[i for t, i in own.get_vocab().items() if suffix and t.endswith(suffix)]] = True

    def words(lot: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        ids = np.array(fast([" ".join(lot)])[0], np.uint32)
        last = np.flatnonzero(ends[ids]) + 1
        return (ids, np.diff(last, prepend=0)) if len(last) == len(lot) and last[-1] == len(ids) else None

    def marked(lot: list[str]) -> tuple[np.ndarray, np.ndarray]:
        mark = next((m for m in single if not any(m in p for p in lot)), None)
        if mark is None:
            each = fast(lot)
            return np.array([i for ids in each for i in ids], np.uint32), np.array(list(map(len, each)), np.int64)
        ids = np.array(fast([f" {mark} ".join(lot)])[0], np.uint32)
        here = ids == single[mark]
        return ids[~here], np.diff(np.concatenate([[-1], np.flatnonzero(here), [len(ids)]])) - 1

    def tokens(lot: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([added.ids[int(p[1:])] for p in lot], np.uint32), np.ones(len(lot), np.int64)

    def resolve(lot: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        marks = np.array([p[:1] == Added.MARK for p in lot], bool)
        pieces = [p.decode("utf-8", "replace") for p in lot]
        simple = np.array(list(map(_one_word, pieces)), bool) & bool(suffix) & ~marks
        counts, ids = np.zeros(len(lot), np.int64), []
        place = np.zeros(len(lot), np.int64)
        at = 0
        for chosen, how in ((np.flatnonzero(simple), words), (np.flatnonzero(~simple & ~marks), marked), (np.flatnonzero(marks), tokens)):
            if not chosen.size:
                continue
            part = [pieces[k] for k in chosen.tolist()]
            got = how(part) or marked(part)
            counts[chosen] = got[1]
            place[chosen] = at + np.cumsum(got[1]) - got[1]
            ids.append(got[0])
            at += len(got[0])
        return np.concatenate(ids)[ragged(place, counts)], counts

    return resolve


def _library(vocabulary: str, text: str) -> PieceIds:
    """The worker's own tokenizer of a vocabulary, behind a cache; it outlives tasks."""
    if vocabulary not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _caches.clear()
        _caches[vocabulary] = PieceIds(resolver(text), CACHE_PIECES)
    return _caches[vocabulary]


def vocabulary_size(text: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text).get_vocab_size()


def part_of(keys: np.ndarray, digests: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The part of each row: the number of cuts at or below its id. An id that is several cuts has as many parts, and its rows go
    to them by ranges of their digests."""
    digests = digests ^ np.uint64(1 << 63)  # in the order of signed numbers
    last = np.searchsorted(cuts, keys, side="right")
    many = np.maximum(last - np.searchsorted(cuts, keys, side="left"), 1)
    width = np.uint64((1 << 64) - 1) // many.astype(np.uint64) + np.uint64(1)
    return (last - many + 1 + (digests // np.maximum(width, np.uint64(1))).astype(np.int64) * (many > 1)).astype(np.int32) if len(keys) else np.zeros(0, np.int32)


def encode(docs: DataFrame, vocabulary: str, end_id: int, cuts: list[int], id_col: str = "doc_id", text: str = "text", kind: type = np.uint32) -> DataFrame:
    """(part, doc_id, digest, ids): the ids of each text as integers of a kind, the end id last, and a digest of them."""
    with open(vocabulary, encoding="utf-8") as f:
        rules = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, added, edges = _library(vocabulary, sent.value), Added(sent.value), np.array(cuts, np.int64)
        for batch in batches:
            keys = batch.column(0).fill_null(NO_ID).to_numpy()
            for low, high, data, edge in slices(whole(batch.column(1))):
                pieces, first = parts(*added.marked(data, edge))
                ids, counts = own.encode_pieces(pieces)
                split = np.append(0, np.cumsum(counts))[first].tolist()
                ids, end = ids.astype(kind), np.array([end_id], kind).tobytes()
                packed = [ids[a:b].tobytes() + end for a, b in zip(split, split[1:])]
                digests = np.array([xxhash.xxh3_64_intdigest(p) for p in packed], np.uint64)
                part = part_of(keys[low:high], digests, edges)
                yield pa.record_batch([pa.array(part), batch.column(0).slice(low, high - low), pa.array(digests.view(np.int64)), pa.array(packed, pa.binary())], names=["part", "doc_id", "digest", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "part int, doc_id long, digest long, ids binary")


def write(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS, block: int = BLOCK) -> tuple[str, DataFrame]:
    """Encode docs into files in a folder that all executors share (a new one by default); the folder, and the table of
    files: file, part, nth, n_docs, n_ids, start (ids of all files before it)."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(vocabulary, encoding="utf-8") as f:
        bits = max(1, (vocabulary_size(f.read()) - 1).bit_length(), int(end_id).bit_length())
    at = [k / parts for k in range(1, parts)]
    cuts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d")).agg(F.percentile_approx("d", at, 100 * parts).alias("c")).first()["c"] if at else []
    kind = np.uint16 if bits <= 16 else np.uint32
    dealt = encode(docs, vocabulary, end_id, sorted(cuts or []), id_col, text, kind).repartitionById(parts, "part").sortWithinPartitions("doc_id", "digest", "ids")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = fs.FileSystem.from_uri(folder)
        files.create_dir(where, recursive=True)
        part, nth, keys, own, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal nth, keys, own, size
            name = f"ids-{part:06d}-{nth:06d}.bin"
            draft = f"{where}/.{name}-{uuid.uuid4().hex}"
            with files.open_output_stream(draft) as f:
                f.write(to_file(keys, own, bits, block))
            files.move(draft, f"{where}/{name}")
            row = pa.record_batch([pa.array([name]), pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([size], pa.int64())], names=["file", "part", "nth", "n_docs", "n_ids"])
            nth, keys, own, size = nth + 1, [], [], 0
            return row

        for batch in batches:
            for key, ids in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                keys.append(NO_ID if key is None else key)
                own.append(np.frombuffer(ids, kind))
                size += len(own[-1])
                if size >= file_ids:
                    yield flush()
        if own:
            yield flush()

    files = written(dealt.mapInArrow(tidy(save), "file string, part int, nth int, n_docs long, n_ids long"), "token-ids-list")
    # The start of each part from the parts' sums (one row a part), then of each file within its part.
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("nth")) - F.col("n_ids")
    return folder, files.withColumn("inside", inside).join(before, "part").select("file", "part", "nth", "n_docs", "n_ids", (F.col("before") + F.col("inside")).alias("start"))


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """From the files of a folder, one row per document: doc_id, start, n_tokens, ids_crc32, file, nth_in_file."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = TokenFile(data)
                starts = np.append(0, own.ends[:-1]) if len(own.ends) else own.ends
                ids = own.ids(0, own.n_ids)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), own.ends.tolist())]
                name = path.rpartition("/")[2]
                keys = pa.array(own.doc_ids, mask=own.doc_ids == NO_ID)
                yield pa.record_batch(
                    [pa.array([name] * len(crc), pa.string()), pa.array(range(len(crc)), pa.int32()), keys, pa.array(starts), pa.array(own.ends - starts), pa.array(crc, pa.int64())],
                    names=["file", "nth_in_file", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string, nth_in_file int")
    loaded = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").load(folder).select("path", "content")
    docs = loaded.mapInArrow(tidy(load), "file string, nth_in_file int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(files.select("file", "start"), "file").select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "file", "nth_in_file")
