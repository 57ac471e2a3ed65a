"""Chunks of documents: packing, overlapping splits, absorption of labels, runs. Each document is worked on alone; where it is
several rows, they are sorted within a task and pass as a stream, of which the open chunk is held."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import dealt

#: Sizes in characters of paragraphs packed, pieces that overlap, pieces cut at marks, blocks and contexts, and
#: what a table may have in rows and characters.
PACKED, SPLIT, RECURSIVE, BLOCK, CONTEXT, TABLE = (700, 20), (800, 40), (800, 120), 800, 780, (4, 1600)

CHUNKS = "doc_id long, chunk int, content string"
_COLUMNS = ["doc_id", "chunk", "content"]


def pack_paragraphs(text: str, most: int = PACKED[0], least: int = PACKED[1]) -> list[str]:
    """Paragraphs packed greedily up to a size; longer ones are cut, shorter results dropped."""
    out: list[str] = []
    now = ""
    for block in (b.strip() for b in re.split(r"\n\s*\n|\n", text)):
        if not block:
            continue
        if now and len(now) + 1 + len(block) > most:
            out.append(now)
            now = ""
        while len(block) > most:
            out.append(block[:most])
            block = block[most:]
        now = f"{now}\n{block}" if now else block
    return [c for c in [*out, now] if len(c) >= least]


def split_overlapping(text: str, most: int = SPLIT[0], overlap: int = SPLIT[1]) -> list[str]:
    """Pieces of at most `most` characters that end at a sentence, else at white space, else anywhere, each beginning
    `overlap` characters before the end of the last."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            cuts = [m.end() for m in re.finditer(r"[.!?]\s", text[at:end])] or [m.end() for m in re.finditer(r"\s", text[at:end])]
            good = [c for c in cuts if c > max(overlap, most // 2)]
            end = at + good[-1] if good else end
        out.append(text[at:end].strip())
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return [c for c in out if c]


#: Bytes of texts that a task takes apart at a time; a longer text is taken alone.
AT_ONCE = 1 << 20


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in order, so many at a time that their texts have AT_ONCE bytes or are one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _each(docs: DataFrame, split) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch, 1):
                parts = [split(t or "") for t in some.column(1).to_pylist()]
                of = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
                nth, content = [k for p in parts for k in range(len(p))], [c for p in parts for c in p]
                yield pa.record_batch([some.column(0).take(of), pa.array(nth, pa.int32()), pa.array(content, pa.string())], names=_COLUMNS)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, CHUNKS)


def packed(docs: DataFrame, most: int = PACKED[0], least: int = PACKED[1]) -> DataFrame:
    """Every document's paragraphs packed into chunks; no shuffle."""
    return _each(docs, lambda t: pack_paragraphs(t, most, least))


def overlapping(docs: DataFrame, most: int = SPLIT[0], overlap: int = SPLIT[1]) -> DataFrame:
    """Every document split into overlapping pieces; no shuffle."""
    return _each(docs, lambda t: split_overlapping(t, most, overlap))


def by_document(rows: Iterator[dict], key: str = "doc_id") -> Iterator[tuple[object, Iterator[dict]]]:
    """Sorted rows as documents: the key and the rows of each, which are to be read before the next document."""
    ahead = [r for r in [next(rows, None)] if r is not None]

    def own(first: dict) -> Iterator[dict]:
        yield first
        for r in rows:
            if r[key] != first[key]:
                ahead.append(r)
                return
            yield r

    while ahead:
        first = ahead.pop()
        yield first[key], own(first)


def streamed(rows: DataFrame, order: list[str], pack, columns: list[str], schema: str, at_once: int = 2000) -> DataFrame:
    """The rows of each document (doc_id), in order, through `pack`, which takes an iterator of rows and gives tuples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = (dict(zip(batch.columns, r)) for batch in batches for r in batch.itertuples(index=False, name=None))
        out = []
        for doc, own in by_document(every):
            for made in pack(own):
                out.append((doc, *made))
                if len(out) >= at_once:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    return dealt(rows, ["doc_id"], order).mapInPandas(run, schema)


def absorbed(texts: Iterator[str], most: int) -> Iterator[str]:
    held: str | None = None
    for text in texts:
        if held is not None and len(text) > most:
            yield f"{held}\n{text}"
            held = None
            continue
        if held is not None:
            yield held
            held = None
        if len(text) <= most:
            held = text
        else:
            yield text
    if held is not None:
        yield held


def _numbered(texts: Iterator[str]) -> Iterator[tuple[int, str]]:
    return enumerate(texts)


def absorb_labels(chunks: DataFrame, most: int = 16) -> DataFrame:
    """Within each document, a chunk of at most `most` characters joins the next one, if that is longer."""
    rows = chunks.select("doc_id", "chunk", F.coalesce("content", F.lit("")).alias("content"))
    return streamed(rows, ["chunk", "content"], lambda own: _numbered(absorbed((r["content"] for r in own), most)), _COLUMNS, CHUNKS)


def worthwhile(chunks: DataFrame, least: int = 30) -> DataFrame:
    """Chunks long enough that aren't references only, each content of a document once (the first)."""
    kept = chunks.filter((F.char_length(F.trim("content")) >= least) & ~F.col("content").rlike(r"^\s*(see|cf\.|ref)[^.]{0,40}\.?\s*$"))
    return kept.groupBy("doc_id", "content").agg(F.min("chunk").alias("chunk"))


def split_recursive(text: str, most: int = RECURSIVE[0], overlap: int = RECURSIVE[1], marks: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Pieces of at most `most` characters, cut at the first of the marks that occurs; parts that are still too long are cut
    at the next marks, and at last anywhere. Neighbours share whole parts of up to `overlap` characters."""
    if len(text) <= most:
        return [text.strip()] if text.strip() else []
    nth = next((i for i, m in enumerate(marks) if m in text), None)
    if nth is None:
        return [text[i : i + most] for i in range(0, len(text), most)]
    out: list[str] = []
    held: list[str] = []
    size = 0

    def close() -> None:
        if piece := "".join(held).strip():
            out.append(piece)

    for part in re.split(f"(?<={re.escape(marks[nth])})", text):
        if len(part) > most:
            close()
            held, size = [], 0
            out += split_recursive(part, most, overlap, marks[nth + 1 :])
            continue
        if size + len(part) > most:
            close()
            while held and (size > overlap or size + len(part) > most):
                size -= len(held.pop(0))
        held.append(part)
        size += len(part)
    close()
    return out


def recursive(docs: DataFrame, most: int = RECURSIVE[0], overlap: int = RECURSIVE[1]) -> DataFrame:
    """Every document split recursively; no shuffle."""
    return _each(docs, lambda t: split_recursive(t, most, overlap))


def split_table(text: str, most_rows: int = TABLE[0], most: int = TABLE[1]) -> list[str]:
    """A Markdown table as tables of a few rows, each with the header; a table without one gets c1, c2 and so on. Texts
    without rows stay whole."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    row = lambda x: x.startswith("|") and x.endswith("|")
    headed = len(lines) > 1 and row(lines[0]) and re.fullmatch(r"\|(\s*:?-+:?\s*\|)+", lines[1]) is not None
    body = [x for x in lines[2 if headed else 0 :] if row(x)]
    if not body:
        return [text] if text.strip() else []
    n = body[0].strip("|").count("|") + 1
    head = lines[:2] if headed else ["| " + " | ".join(f"c{i + 1}" for i in range(n)) + " |", "|" + " --- |" * n]
    width = sum(len(x) + 1 for x in head)
    groups: list[list[str]] = [[]]
    for x in body:
        now = groups[-1]
        if now and (len(now) == most_rows or width + sum(len(y) + 1 for y in now) + len(x) > most):
            groups.append([])
        groups[-1].append(x)
    return ["\n".join(head + g) for g in groups]


def table_rows(tables: DataFrame, most_rows: int = TABLE[0], most: int = TABLE[1]) -> DataFrame:
    """Every table split by rows; no shuffle."""
    return _each(tables, lambda t: split_table(t, most_rows, most))


def pack_blocks(blocks: Iterator[tuple[str, str]], most: int = BLOCK) -> Iterator[str]:
    """(title, text) blocks packed in order; a new title or a chunk that would grow too long begins a new one. A block that
    is too long alone is a chunk of its own."""
    held: list[str] = []
    title, size = "", 0
    for head, body in blocks:
        if not body.strip():
            continue
        if held and ((head and head != title) or size + len(head) + len(body) + 3 > most):
            yield "\n".join(held)
            held = []
        if not held:
            title, size = head, 0
        held.append(body.strip())
        size += len(body) + 1
    if held:
        yield "\n".join(held)


def merge_context(blocks: Iterator[tuple[str, str]], most: int = CONTEXT) -> Iterator[str]:
    """(heading path, text) blocks merged while the heading stays the same or goes below it, up to a size."""
    held, above = "", ""
    for head, body in blocks:
        body = body.strip()
        if not body:
            continue
        below = bool(held) and (head == above or (bool(above) and head.startswith(f"{above} > ")))
        if below and len(held) + 2 + len(body) <= most:
            held += f"\n\n{body}"
            continue
        if held:
            yield held
        held, above = body, head
    if held:
        yield held


def _ordered(blocks: DataFrame, pack) -> DataFrame:
    rows = blocks.select("doc_id", "at", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "content")])
    return streamed(rows, ["at", "title", "content"], lambda own: _numbered(pack((r["title"], r["content"]) for r in own)), _COLUMNS, CHUNKS)


def packed_blocks(blocks: DataFrame, most: int = BLOCK) -> DataFrame:
    """Blocks (doc_id, at, title, content) of every document packed by title and size."""
    return _ordered(blocks, lambda b: pack_blocks(b, most))


def merged_context(blocks: DataFrame, most: int = CONTEXT) -> DataFrame:
    """Blocks (doc_id, at, title, content) of every document merged by heading and size."""
    return _ordered(blocks, lambda b: merge_context(b, most))
