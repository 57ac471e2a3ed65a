"""Chunks of whole documents: segments merged by what their headings have in common, table rows joined, long texts split, paths and
titles written out.

Two steps depend on how much an open chunk holds already; they number the rows of a document in order, as a stream within a task
that keeps one row. All else is aggregation and windows of a document: counts of the first chunks by heading are there before any
path is written."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import inf

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import dealt
from .structure import TEXT_BLOCKS, new_titles

#: Characters of a chunk, and of the overlap of the parts of a longer text.
MOST, OVERLAP = 1000, 40
#: Points for a segment whose headings agree with those of the open chunk's first, and where both have the
#: heading and it differs.
AGREEMENT = {"path": (3, -2), "primary": (4, -1), "structure": (2, 0), "title": (3, 0), "titles": (2, 0)}
#: Points for one side of the walls, for tables (which are never of one table here), and for depths one apart.
SAME_SIDE, TABLES, NEAR = 1, -4, 1
#: Chunks that hold less than the first and at most the second with the new segment take it for so many points.
TAKEN = ((350, MOST, 3), (inf, 750, 5), (inf, MOST, 8))
#: A path counts for at least so many characters; texts up to so many are short; so many segments of a document,
#: and so many characters without a path, make a cover.
PATH_CHARS, SHORT, COVER = 20, 180, (3, 140)
#: Lines that only part others; lines that end a paragraph (a date, or up to 12 plain characters); where sentences
#: end, and where else a text may be cut; what stands between joined rows; what leads a caption in a path.
RULE, TRAILER = "^[-=_.~·•ㆍ―─━]{5,}$", r"^(\d{4}년\s+\d{1,2}월\s+\d{1,2}일|[가-힣A-Za-z0-9\s]{1,12})$"
SENTENCE, PAUSE, ROWS, CAPTIONED = r"(?<=[.!?。])\s+", r"(?<=[,;:])\s+|\s+", "\n---\n", "📋 "

SEGMENT = "doc_id long, at long, sector string, block string, content string, path string, nodes array<struct<depth: int, kind: string, rule: string, notation: string, text: string>>, header array<string>, caption string, caption_place string"
#: What the numbering of segments looks at.
WATCHED = ["path", "primary", "structure", "title", "titles", "side", "top", "depth", "weight", "short", "trailer", "alone"]


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _keys(nodes: Column, kind: str, deepest: int | None = None) -> Column:
    """The headings of a kind among the open ones, each as one text."""
    own = F.filter(nodes, lambda n: (n["kind"] == kind) & (F.trim(n["text"]) != "") & (F.lit(True) if deepest is None else n["depth"] <= deepest))
    return F.transform(own, lambda n: F.concat_ws(":", n["depth"].cast("string"), n["rule"], n["notation"], n["text"]))


def _watched(segments: DataFrame) -> DataFrame:
    """Segments with what decides where chunks begin; lines that only part others, and empty ones, go."""
    flat, chars = _flat(F.col("content")), F.char_length("content")
    titles, structure = lambda d: F.array_join(_keys(F.col("nodes"), "title", d), " > "), _keys(F.col("nodes"), "divider")
    family = F.when(F.col("block").isin(*TEXT_BLOCKS), "text").when(F.startswith("block", F.lit("table")), "table").otherwise(F.col("block"))
    cover = (F.col("at") <= COVER[0]) & ((F.col("block") == "heading-inline") | ((F.col("path") == "") & (F.char_length(F.trim("content")) <= COVER[1])))
    return segments.filter((flat != "") & ~flat.rlike(RULE)).withColumns(
        {
            "primary": F.coalesce(F.get(structure, F.lit(0)), F.lit("")),
            "structure": F.array_join(structure, " > "),
            "title": titles(1),
            "titles": titles(2),
            "top": F.coalesce(F.get(_keys(F.col("nodes"), "title"), F.lit(0)), F.lit("")),
            "side": F.concat_ws("|", "sector", family),
            "depth": F.coalesce(F.array_max(F.transform("nodes", lambda n: n["depth"])), F.lit(0)),
            "weight": chars + F.greatest(F.lit(PATH_CHARS), F.char_length("path")),
            "short": F.col("block").isin(*TEXT_BLOCKS) & (F.char_length(flat) <= SHORT),
            "trailer": (F.col("block") == "paragraph") & flat.rlike(TRAILER),
            "alone": F.col("block").isin("table", "table-row") | cover,
        }
    )


def points(lead: dict, new: dict) -> int:
    """What speaks for a segment in the chunk that `lead` begins, on the same side of the walls."""
    out = SAME_SIDE + (TABLES if new["side"].endswith("|table") else 0)
    for heading, (agrees, differs) in AGREEMENT.items():
        if lead[heading] and new[heading]:
            out += agrees if lead[heading] == new[heading] else differs
    return out + (NEAR if lead["depth"] and new["depth"] and abs(lead["depth"] - new["depth"]) <= 1 else 0)


def begins(lead: dict, last: dict, size: int, new: dict) -> bool:
    """Whether a segment begins a chunk of its own, after one with its first and last segment and size."""
    one_place = all(lead[k] == new[k] for k in ("path", "primary"))
    if one_place and lead["side"] == new["side"] and ((last["short"] and new["short"]) or (new["trailer"] and lead["paragraph"])):
        return False
    walled = lead["side"] != new["side"] or lead["alone"] or new["alone"] or ("" not in (lead["top"], new["top"]) and lead["top"] != new["top"])
    grown = size + new["weight"]
    if not walled and any(size < below and grown <= upto and points(lead, new) >= least for below, upto, least in TAKEN):
        return False
    return walled or not one_place or grown > MOST


def numbered(rows: DataFrame, order: list[str], watched: list[str], name: str, numbers: Callable[[], Callable[[dict], int]]) -> DataFrame:
    """rows with a number: those of each document (doc_id) go in order, within a task, to a function made anew for each. Only the
    watched columns become Python values; the rest passes as it is."""
    schema = rows.withColumn(name, F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, give = object(), None
        for batch in batches:
            out = []
            for row in batch.select(["doc_id", *watched]).to_pylist():
                if row["doc_id"] != doc:
                    doc, give = row["doc_id"], numbers()
                out.append(give(row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, name])

    return dealt(rows, ["doc_id"], order).mapInArrow(run, schema)


def _by_headings() -> Callable[[dict], int]:
    lead = last = None
    size = count = 0

    def give(new: dict) -> int:
        nonlocal lead, last, size, count
        new["paragraph"] = new["block"] == "paragraph"
        opened = lead is None or begins(lead, last, size, new)
        if opened:
            lead, size, count = new, 0, count + 1
        last, size = new, size + new["weight"]
        if opened and new["alone"]:
            lead = None
        return count

    return give


def _by_room(most: int) -> Callable[[], Callable[[dict], int]]:
    """Rows of one table together, while what they hold with the marks between them stays within `most`."""

    def make() -> Callable[[dict], int]:
        table, size, count = None, 0, 0

        def give(new: dict) -> int:
            nonlocal table, size, count
            joined = size + len(ROWS) + new["chars"]
            if new["table"] is None or new["table"] != table or joined > most:
                count, joined = count + 1, new["chars"]
            table, size = new["table"], joined
            return count

        return give

    return make


def _common(lists: Column) -> Column:
    """The headings that all lists of open headings begin with."""

    def shared(a: Column, b: Column) -> Column:
        same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
        return F.slice(a, F.lit(1), F.least(F.size(a), F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(a))).cast("int"))

    return F.aggregate(lists, F.get(lists, F.lit(0)), shared)


def _joined(rows: DataFrame, by: str, between: str) -> DataFrame:
    """Numbered rows of one number as one chunk."""
    in_order = F.array_sort(F.collect_list(F.struct("at", F.trim("content", F.lit(" \n")).alias("t"))))
    kind = lambda *b: F.max(F.col("block").isin(*b).cast("int")) == 1
    block = F.when(kind("table-row"), "table-row").when(kind("table"), "table").when(kind("paragraph"), "paragraph").otherwise(F.min_by("block", "at"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("at"))).alias(c)
    lead = F.min_by(F.struct("path", "sector", "header", "nodes"), "at").alias("lead")
    made = rows.groupBy("doc_id", by).agg(
        F.min("at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("n_segments").alias("n_segments"), block.alias("block"), first("caption"), first("caption_place"), lead,
        F.min("n_primary").alias("n_primary"), _common(F.collect_list("nodes")).alias("common"), F.array_join(F.transform(in_order, lambda x: x["t"]), between).alias("content"),
    )
    nodes = F.when(F.size("common") > 0, F.col("common")).otherwise(F.col("lead.nodes"))
    return made.withColumns({"nodes": nodes, "sector": F.col("lead.sector"), "header": F.col("lead.header"), "path": F.col("lead.path"), "at": F.col("first_at")}).drop("lead", "common")


def _before(text: Column, at: Column) -> Column:
    """The text up to a place that is found in it, unless nothing is before."""
    cut = F.regexp_replace(F.substring(text, F.lit(1), (at - 1).cast("int")), r"\s+$", "")
    return F.when((at > 1) & (F.trim(cut) != ""), cut).otherwise(text)


def _without_table(chunks: DataFrame) -> DataFrame:
    """A paragraph right before the rows of a table under the same heading ends where it repeats the table: at the headers in a
    row, at the first value, or, below its first line, at any of these."""
    w = Window.partitionBy("doc_id").orderBy("at")
    near = chunks.withColumn("_t", F.lead(F.struct("block", "heading", "header", "content")).over(w))
    heads = F.filter(F.transform(F.col("_t.header"), _flat), lambda h: h != "")
    quoted = F.array_join(F.transform(heads, lambda h: F.concat(F.lit("\\Q"), F.replace(h, F.lit("\\E"), F.lit("")), F.lit("\\E"))), r"\s*")
    line = F.trim(F.regexp_extract(F.trim(F.col("_t.content"), F.lit(" \n")), r"^[^\n]*", 0))
    value = F.trim(F.when(F.contains(line, F.lit(":")), F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).otherwise(line))
    applies = (F.col("block") == "paragraph") & (F.col("_t.block") == "table-row") & (F.col("_t.heading") == F.col("heading")) & F.col("_t.header").isNotNull()
    near = near.withColumns({"_heads": heads, "_quoted": quoted, "_value": value, "_cut": F.coalesce(applies, F.lit(False))})
    once = F.when(F.size("_heads") > 0, _before(F.col("content"), F.regexp_instr("content", "_quoted"))).otherwise(F.col("content"))
    near = near.withColumn("_text", once)
    near = near.withColumn("_text", F.when(F.col("_value") != "", _before(F.col("_text"), F.instr(F.col("_text"), F.col("_value")))).otherwise(F.col("_text")))
    top, rest = F.regexp_extract("_text", r"^[^\n]*", 0), F.regexp_extract("_text", r"(?s)^[^\n]*\n(.*)$", 1)
    places = F.filter(F.transform(F.array_append(F.col("_heads"), _flat(F.col("_value"))), lambda h: F.when(h != "", F.instr(rest, h))), lambda p: p > 0)
    below = F.regexp_replace(F.substring(rest, F.lit(1), (F.array_min(places) - 1).cast("int")), r"\s+$", "")
    short = F.concat_ws("\n", F.nullif(F.rtrim(top), F.lit("")), F.nullif(below, F.lit("")))
    near = near.withColumn("_text", F.when((F.size(places) > 0) & (short != ""), short).otherwise(F.col("_text")))
    return near.withColumn("content", F.when(F.col("_cut"), F.col("_text")).otherwise(F.col("content"))).drop("_t", "_heads", "_quoted", "_value", "_cut", "_text")


def overlapped(text: str, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """A text in parts of whole sentences, else of what lies between pauses and blanks, each led by the end of the one before; a
    text without either in windows."""
    text = text.strip()
    if len(text) <= most:
        return [text] if text else []
    pieces = next((p for p in ([x for x in re.split(cut, text) if x] for cut in (SENTENCE, PAUSE)) if len(p) > 1), None)
    if pieces is None:
        starts = range(0, max(len(text) - overlap, 1), max(1, most - overlap))
        return [w for w in (text[k : k + most].strip() for k in starts) if w]
    parts = [pieces[0]]
    for piece in pieces[1:]:
        if len(parts[-1]) + 1 + len(piece) <= most:
            parts[-1] += f" {piece}"
        else:
            parts.append(" ".join(filter(None, (parts[-1][-overlap:].strip() if overlap else "", piece))))
    return parts


def by_lines(text: str, most: int = MOST) -> list[str]:
    """A text in parts of whole lines; lines that are too long are split alone."""
    parts: list[str] = []
    room = 0
    for line in filter(None, (x.strip() for x in text.splitlines())):
        if len(line) > most:
            parts, room = parts + overlapped(line, most), 0
        elif parts and len(line) < room:
            parts[-1], room = f"{parts[-1]}\n{line}", room - len(line) - 1
        else:
            parts.append(line)
            room = most - len(line)
    return parts


def _split(chunks: DataFrame, most: int) -> DataFrame:
    """Chunks of texts or rows that are longer than `most` as parts; the others as they are."""
    text, rows = F.col("block").isin(*TEXT_BLOCKS), F.col("block") == "table-row"

    @F.pandas_udf("array<string>")
    def cut(content: pd.Series, how: pd.Series) -> pd.Series:
        return pd.Series([by_lines(c, most) if h == "table-row" else overlapped(c, most) for c, h in zip(content, how)], dtype=object)

    long = (text | rows) & (F.char_length("content") > most)
    whole = chunks.filter(~long).select("*", F.lit(0).alias("part"), F.lit(1).alias("parts"))
    parted = chunks.filter(long).withColumn("_parts", cut("content", "block")).select("*", F.posexplode("_parts").alias("part", "_own"), F.size("_parts").alias("parts"))
    return whole.unionByName(parted.withColumn("content", F.col("_own")).drop("_parts", "_own"))


def _paths(chunks: DataFrame) -> DataFrame:
    """The whole path of each chunk: titles, then what divides below them. A first heading that divides and is a sentence of its own
    stands as its mark where the chunk has the sentence, not at all where its heading has one chunk or this is its first, and as
    its mark in tables and where further ones follow."""
    own = F.filter("nodes", lambda n: (n["kind"] != "title") & (F.trim(n["text"]) != ""))
    titles = F.transform(F.filter("nodes", lambda n: (n["kind"] == "title") & (F.trim(n["text"]) != "")), lambda n: n["text"])
    shown = chunks.withColumns({"_own": own, "titles": titles})
    of_heading = Window.partitionBy("doc_id", "sector", "primary", F.size("titles") > 0).orderBy("at", "part")
    shown = shown.withColumn("_nth", F.row_number().over(of_heading))
    flat = _flat(F.col("content"))
    sentence = lambda n: (n["rule"] == "symbol") & (F.trim(n["notation"]) != "") & (_flat(n["notation"]) != _flat(n["text"]))
    single = (F.col("n_primary") <= 1) | (F.col("_nth") == 1)

    def part(n: Column, k: Column) -> Column:
        lead = (k == 0) & sentence(n)
        marked = F.col("block").isin("table", "table-row") | (F.size("_own") > 1)
        plain = F.when((n["rule"] == "symbol") & (k < F.size("_own") - 1) & (n["notation"] != ""), n["notation"]).otherwise(n["text"])
        return F.when(sentence(n) & F.contains(flat, _flat(n["text"])), n["notation"]).when(lead & single, F.lit("")).when(lead & marked, n["notation"]).otherwise(plain)

    below = F.filter(F.transform("_own", part), lambda t: F.trim(t) != "")
    shown = shown.withColumn("_below", below)
    # Titles at whose end the parts below end too are given once; so are neighbours that are equal.
    size, all_ = F.size("_below"), F.size("titles")
    ends = lambda k: (F.size("titles") - k <= size) & (F.slice("titles", (k + 1).cast("int"), (all_ - k).cast("int")) == F.slice("_below", (size - all_ + k + 1).cast("int"), (all_ - k).cast("int")))
    # The place is held within the parts, so that the slice is one even where the first condition fails.
    safe = lambda k: F.when(F.size("titles") - k <= size, ends(k)).otherwise(F.lit(False))
    cut = F.when((all_ > 0) & (size > 0), F.array_min(F.filter(F.sequence(F.lit(0), all_ - 1), safe)))
    every = F.concat(F.when(cut.isNotNull(), F.slice("titles", F.lit(1), cut)).otherwise(F.col("titles")), F.col("_below"))
    shown = shown.withColumn("_every", every)
    once = F.filter("_every", lambda t, k: (k == 0) | ~F.coalesce(_flat(F.get("_every", k - 1)) == _flat(t), F.lit(False)))
    whole = F.when(F.size("titles") > 0, F.array_join(once, " > ")).otherwise(F.col("heading"))
    caption = F.when((F.col("block") == "table-row") & (F.size("titles") > 0), F.concat(F.lit(CAPTIONED), F.nullif("caption", F.lit(""))))
    return shown.withColumn("path", F.concat_ws(" > ", whole, caption)).drop("_own", "_below", "_every", "_nth")


def _titled(chunks: DataFrame) -> DataFrame:
    """The titles that come up for the first time, above the text of the chunk, but for those that its first line begins with and
    those that its first lines are."""
    shown = new_titles(chunks, ["doc_id", "sector"], "_order", "titles")
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = _flat(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
    led = F.transform(F.slice(lines, F.lit(1), F.size("lines")), _flat)
    fresh = F.filter("lines", lambda t: (_flat(t) != "") & ~((first != "") & (F.startswith(_flat(t), first) | F.startswith(first, _flat(t)))) & ~F.array_contains(led, _flat(t)))
    leads = (F.size("lines") > 0) & (F.col("block") != "table-single-row")
    return shown.withColumn("content", F.when(leads, F.array_join(F.concat(fresh, lines), "\n")).otherwise(F.col("content"))).drop("lines")


def chunks(segments: DataFrame, most: int = MOST) -> DataFrame:
    """Segments (SEGMENT) of every document as chunks: doc_id, chunk (from 1), sector, block, path, content, first_at, last_at,
    n_segments, part and parts (of a chunk that was split), caption, header. Chunks are of at most `most` characters, before
    titles, but for tables that aren't rows and single headings."""
    known = _watched(segments)
    first = numbered(known, ["at"], [*WATCHED, "block"], "number", _by_headings).withColumns({"last_at": F.col("at"), "n_segments": F.lit(1), "n_primary": F.lit(0)})
    made = _joined(first.drop(*[c for c in WATCHED if c != "path"]), "number", "\n")
    primary = F.coalesce(F.get(_keys(F.col("nodes"), "divider"), F.lit(0)), F.lit(""))
    heading = F.coalesce(F.element_at(F.transform("nodes", lambda n: n["text"]), F.when(F.size("nodes") > 0, -1)), F.col("path"))
    made = made.withColumns({"primary": primary, "heading": heading})
    made = made.withColumn("n_primary", F.count("*").over(Window.partitionBy("doc_id", "sector", "primary")))
    made = _without_table(made)
    w = Window.partitionBy("doc_id").orderBy("at")
    table = F.when((F.col("block") == "table-row") & F.col("header").isNotNull() & (F.size("header") > 0), F.concat_ws("\u0001", "heading", F.to_json("header")))
    made = made.withColumn("table", table).withColumn("_new", (~F.coalesce(F.lag("table").over(w) == F.col("table"), F.lit(False))).cast("int"))
    made = made.withColumn("_run", F.sum("_new").over(w))
    same = Window.partitionBy("doc_id", "_run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumns({c: F.coalesce(c, F.last(F.nullif(c, F.lit("")), ignorenulls=True).over(same)) for c in ("caption", "caption_place")})
    rows = made.withColumn("chars", F.char_length(F.trim("content", F.lit(" \n")))).drop("_new", "_run", "number", "first_at")
    packed = numbered(rows, ["at"], ["table", "chars"], "number", _by_room(most)).drop("chars", "table", "primary", "heading")
    packed = _joined(packed, "number", ROWS).withColumns({"primary": primary, "heading": heading})
    parts = _split(packed, most)
    parts = parts.withColumn("_order", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "part")))
    out = _titled(_paths(parts))
    return out.filter(F.trim("content") != "").select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("_order")).alias("chunk"), "sector", "block", "path", "content", "first_at", "last_at", "n_segments", "part", "parts", "caption", "header")
