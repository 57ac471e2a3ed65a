"""Substring dedup: anchors at difference-cover positions find what may repeat, whole windows then decide.

Words are split at ASCII white space. Word positions modulo a period are taken where they lie in a difference cover: any
two positions have a common offset below the period at which both are cover positions, so two equal windows share an
anchor (a shorter run of words) at cover positions of both. Anchors that occur twice, anywhere, are extended: the
windows around them are compared as wholes, by 128-bit digests, and the words of each window that occurs twice go.

The texts are written once, bucketed by block (a pseudo-random share of the rows), so that the three passes over them
need no shuffle of texts. What travels is digests: each block sends every digest once (twice, where the block itself
holds it more often), in one packed row for each part of the digests' range, and gets a bit for each back. So a passage
that a third of the documents hold is one digest for each block, and no pair of documents is ever formed.

Null and empty texts have no words and keep none. Every row gives one row, repeated ids and null ids too; texts with
fewer words than a window keep all, and an empty table gives none. Very long texts are part of one block; memory follows
the longest text. Only the id and the text are read, so other columns can't clash. All that is written on the way is
removed at the end, an error or not; the result is a table in the shared folder.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_folder, scratch, written
from .texts import PLAIN_WORD, ragged, run_digests, slices, word_digests, word_spans

WINDOW = 35
#: Bytes of text in a block, about, and for each packed row at least: beyond 160 GB blocks grow with the root of the size,
#: or there would be more packed rows (blocks times parts) than digests worth packing.
BLOCK_BYTES, ROW_BYTES = 8 << 20, 400
#: Bytes of text in a bucket of the written table, about, and so of a task.
BUCKET_BYTES = 128 << 20
#: Perfect difference sets: every difference modulo the period occurs between two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}


def cover_for(window: int) -> tuple[int, np.ndarray]:
    """A period, and which positions modulo it are cover positions; an anchor has window - period + 1 words."""
    period = max(p for p in COVERS if p == 1 or 5 * p <= 3 * window)
    inside = np.zeros(period, bool)
    inside[list(COVERS[period])] = True
    return period, inside


class Words:
    """The words of a block's rows as digests, and the places of anchors and windows among them."""

    def __init__(self, column: pa.Array, window: int):
        digests, counts = [np.zeros((2, 0), np.uint64)], []
        for _, _, data, edge in slices(column):
            starts, ends, first = word_spans(data, edge, PLAIN_WORD)
            digests.append(word_digests(data, starts, ends))
            counts.append(np.diff(first))
        self.one, self.two = np.concatenate(digests, axis=1)
        self.counts = np.concatenate([np.zeros(0, np.int64), *counts])
        self.first = np.cumsum(self.counts) - self.counts
        self.window = window

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of the anchors, and their digests; rows without a whole window have none."""
        period, inside = cover_for(self.window)
        width = self.window - period + 1
        n = np.where(self.counts >= self.window, self.counts - width + 1, 0)
        within = ragged(np.zeros(len(n), np.int64), n)
        here = inside[within % period]
        place = ragged(self.first, n)[here]
        return place, run_digests(self.one, width)[place][:, None]

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts of the windows that hold one of the shared anchors at an offset below the period, and their digests."""
        period, _ = cover_for(self.window)
        row = np.searchsorted(self.first, shared, side="right") - 1
        low = np.maximum(shared - period + 1, self.first[row])
        high = np.minimum(shared, self.first[row] + self.counts[row] - self.window)
        change = np.zeros(len(self.one) + 2, np.int64)
        np.add.at(change, low, 1)
        np.add.at(change, high + 1, -1)
        start = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        return start, np.stack([run_digests(w, self.window, k)[start] for k, w in enumerate((self.one, self.two))], axis=1)

    def removed(self, starts: np.ndarray) -> np.ndarray:
        """Which words the windows cover."""
        change = np.zeros(len(self.one) + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + self.window, -1)
        return np.cumsum(change)[:-1] > 0


class Dealt:
    """Digests in the order of their part (the first word modulo the number of parts) and value, each once."""

    def __init__(self, digests: np.ndarray, parts: int):
        part = (digests[:, 0] % np.uint64(parts)).astype(np.int64)
        order = np.lexsort([*digests.T[::-1], part])
        ordered = digests[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(fresh) - 1
        at = np.flatnonzero(fresh)
        self.digests, self.part = ordered[at], part[order][at]
        self.twice = np.diff(np.append(at, len(order))) > 1
        self.edge = np.searchsorted(self.part, np.arange(parts + 1))

    def rows(self, block: int) -> pa.RecordBatch:
        there = np.flatnonzero(np.diff(self.edge)).tolist()
        packed = [np.repeat(self.digests[a:b], 1 + self.twice[a:b], axis=0).tobytes() for a, b in ((self.edge[p], self.edge[p + 1]) for p in there)]
        return pa.record_batch([pa.array(there, pa.int32()), pa.array([block] * len(there), pa.int32()), pa.array(packed, pa.binary())], names=["part", "block", "digests"])

    def again(self, found: dict[int, bytes]) -> np.ndarray:
        """For each digest as given, whether it occurs twice; parts without such a digest send nothing back."""
        bits = np.zeros(len(self.part), bool)
        for part, mask in found.items():
            a, b = self.edge[part], self.edge[part + 1]
            bits[a:b] = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a)
        return bits[self.number]


def _sent(packed: DataFrame, width: int) -> DataFrame:
    """From (part, block, digests) to (part, block, bits): which digests of each row occur twice in their part."""

    def count(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64).reshape(-1, width) for x in table.column("digests").to_pylist()]
        every = np.concatenate(lists)
        order = np.lexsort(every.T[::-1])
        ordered = every[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        at = np.flatnonzero(fresh)
        many = np.empty(len(order), bool)
        many[order] = np.repeat(np.diff(np.append(at, len(order))) > 1, np.diff(np.append(at, len(order))))
        blocks, masks, low = [], [], 0
        for block, own in zip(table.column("block").to_pylist(), lists):
            first = np.ones(len(own), bool)
            first[1:] = (own[1:] != own[:-1]).any(axis=1)
            bits = many[low : low + len(own)][first]
            low += len(own)
            if bits.any():
                blocks.append(block)
                masks.append(np.packbits(bits).tobytes())
        part = table.column("part")[0].as_py()
        return pa.table([pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()), pa.array(masks, pa.binary())], names=["part", "block", "bits"])

    return packed.groupBy("part").applyInArrow(count, "part int, block int, bits binary")


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table.column("row"))).combine_chunks()


def _text(table: pa.Table) -> pa.Array:
    column = table.column("text").combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _found(bits: pa.Table, step: int) -> dict[int, bytes]:
    return {p: m for s, p, m in zip(*(bits.column(c).to_pylist() for c in ("step", "part", "bits"))) if s == step}


PACKED = "part int, block int, digests binary"


def repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text", with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space) and, if
    asked for, kept (those words themselves)."""
    if window < 2:
        raise ValueError("a window has two words or more")
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(n, min(size // block_bytes, math.isqrt(size // ROW_BYTES)))
    buckets = max(n, -(-size // BUCKET_BYTES))
    name = f"tillage_blocks_{uuid.uuid4().hex}"
    rows = source.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).repartition(buckets, "block")

    def first_pass(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        _, digests = Words(_text(table), window).anchors()
        return pa.Table.from_batches([Dealt(digests, parts).rows(table.column("block")[0].as_py())])

    def second_pass(table: pa.Table, bits: pa.Table) -> pa.Table:
        if not table.num_rows or not bits.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], names=["part", "block", "digests"])
        table = _in_order(table)
        words = Words(_text(table), window)
        place, digests = words.anchors()
        _, found = words.windows(place[Dealt(digests, parts).again(_found(bits, 1))])
        return pa.Table.from_batches([Dealt(found, parts).rows(table.column("block")[0].as_py())])

    head = source.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {head}, n_words long, n_removed long, kept_sha256 string" + (", row long, kept string" if with_text else "")

    def third_pass(table: pa.Table, bits: pa.Table) -> pa.Table:
        table = _in_order(table)
        column = _text(table)
        gone, first, counts = None, None, None
        if bits.num_rows and table.num_rows:
            words = Words(column, window)
            place, digests = words.anchors()
            start, found = words.windows(place[Dealt(digests, parts).again(_found(bits, 1))])
            gone, first, counts = words.removed(start[Dealt(found, parts).again(_found(bits, 2))]), words.first, words.counts
        n_words, n_removed, digest, kept = [], [], [], []
        for low, high, data, edge in slices(column):
            for k, a, b in zip(range(low, high), edge.tolist(), edge[1:].tolist()):
                own = data[a:b].split()
                left = own
                if gone is not None and (mask := gone[first[k] : first[k] + counts[k]]).any():
                    left = list(compress(own, (~mask).tolist()))
                whole = b" ".join(left)
                n_words.append(len(own))
                n_removed.append(len(own) - len(left))
                digest.append(hashlib.sha256(whole).hexdigest())
                if with_text:
                    kept.append(whole.decode("utf-8", "replace"))
        columns = {"doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if with_text:
            columns |= {"row": table.column("row"), "kept": pa.array(kept, pa.string())}
        return pa.table(columns)

    with_bits = lambda table, bits: table.groupBy("block").cogroup(bits.groupBy("block"))
    with scratch("substring-dedup"):
        try:
            rows.write.bucketBy(buckets, "block").option("path", new_folder(spark, "substring-blocks")).format("parquet").saveAsTable(name)
            blocks = spark.read.table(name)
            narrow = blocks.select("block", "row", "text")
            anchors = _sent(narrow.groupBy("block").applyInArrow(first_pass, PACKED), 1)
            shared = written(anchors.withColumn("step", F.lit(1)), "substring-anchors")
            windows = _sent(with_bits(narrow, shared).applyInArrow(second_pass, PACKED), 2)
            repeated = written(windows.withColumn("step", F.lit(2)), "substring-windows")
            return written(with_bits(blocks, shared.unionByName(repeated)).applyInArrow(third_pass, out), "substring-dedup")
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """docs with the repeated words gone from the text, the kept ones joined by a space; a text that loses nothing stays
    as it is, null too. The other columns of a row stay with it."""
    names = docs.columns
    boxed = written(docs.select(F.struct(*names).alias("_all")).withColumn("_n", F.monotonically_increasing_id()), "substring-rows")
    found = repeats(boxed.select("_n", F.col("_all")[text].alias("text")), window, "_n", with_text=True)
    joined = boxed.join(found.select(F.col("doc_id").alias("_n"), "n_removed", "kept"), "_n")
    return joined.select(*[F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_all")[c]).alias(c) if c == text else F.col("_all")[c].alias(c) for c in names])
