"""Document files: Markdown, DOCX and HWPX (zip and XML), as lines in their order, where Spark reads the bytes; the lines as
segments, or as the chunks of whole documents.

What can't be read isn't passed over: there is a row for it with the problem in place of content: a file that is too large, of
another kind, broken, or whose bytes are no UTF-8 (its text is there, with marks for the bad bytes)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import passages, structure
from ..operators.cells import PLAIN_COLOURS, Cell, grid, lines_of, tidy
from ..operators.structure import Heading, heading_pattern

#: Larger files are not read.
MOST_BYTES = 30 << 20
SEGMENTS = "path string, source_order int, heading_path string, content string, problem string"
LINES = "path string, at long, text string, line string, block string, place string, rows int, depth int, header array<string>, caption string, problem string"
_HEADING = re.compile(r"(#{1,6})\s+(.+)")
#: Where an HWPX archive names its fill colours; boxes of up to so many characters belong to their paragraph's text;
#: boxes that say nothing.
COLOUR_FILES, BOX = ("Contents/Header.xml", "Contents/header.xml", "Header.xml", "header.xml"), 30
STATES = ("신청불가", "신청가능", "(신청불가)", "(신청가능)", "신청불가신청가능", "(신청불가)(신청가능)")


@dataclass
class Line:
    """A line or row of a document: its text, the line that heading rules look at, the block that it is, the depth that its style
    gives it, and of a table its number of rows, headers and caption, and the rows where they are segments of their own."""

    text: str
    block: str = "paragraph"
    depth: int = 0
    line: str = ""
    rows: int | None = None
    header: list[str] = field(default_factory=list)
    caption: str = ""
    parts: list[str] = field(default_factory=list)

    @property
    def place(self) -> str:
        return "table" if self.block.startswith("table") else "paragraph"


def _decoded(data: bytes) -> str:
    """UTF-8, with or without a mark; else the Korean code page if that fits; else UTF-8 with marks for the bad bytes."""
    for encoding in ("utf-8-sig", "cp949"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def _nested(lines: Iterator[Line]) -> Iterator[tuple[str, str]]:
    """The path of open headings and the text of each line that is no heading."""
    path: list[tuple[int, str]] = []
    for x in lines:
        if x.depth:
            path = [p for p in path if p[0] < x.depth] + [(x.depth, x.text)]
        elif x.text:
            yield from ((" > ".join(t for _, t in path), t) for t in x.parts or [x.text])


def markdown_lines(data: bytes) -> Iterator[Line]:
    """Lines with the depth of their # marks."""
    for text in _decoded(data).splitlines():
        m = _HEADING.match(text)
        yield Line((m[2] if m else text).strip(), depth=len(m[1]) if m else 0)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(node: ElementTree.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _local(k) == name), "")


def _pieces(node: ElementTree.Element) -> Iterator[str | ElementTree.Element]:
    """What is in a paragraph or cell, in order: texts, ends of lines, and tables, which are not gone into."""
    for child in node:
        kind = _local(child.tag)
        if kind == "tbl":
            yield child
            continue
        if kind == "t":
            yield child.text or ""
        elif kind in ("lineBreak", "br"):
            yield "\n"
        yield from _pieces(child)
        if kind == "p":
            yield "\n"
        if _local(node.tag) == "t":
            yield child.tail or ""


def _cell_text(cell: ElementTree.Element) -> str:
    """The text of a cell; a table within it is its rows, once."""
    inner = lambda t: "\n" + "\n".join(" | ".join(r.seen) for r in grid(_rows(t, {}))) + "\n"
    return tidy("".join(p if isinstance(p, str) else inner(p) for p in _pieces(cell)))


def _span(cell: ElementTree.Element, *names: str) -> int:
    """How many columns or rows a cell spans: by its own attributes, those of cellSpan, or of gridSpan in its properties; 1 without."""
    places = [cell, *(x for x in cell if _local(x.tag) == "cellSpan"), *(x for p in cell if _local(p.tag) == "tcPr" for x in p if _local(x.tag) == "gridSpan")]
    said = [_attribute(x, n) for n in names for x in places if n != "val" or _local(x.tag) == "gridSpan"]
    return max(1, next((int(v) for v in said if v.isdigit()), 1))


def _colour(value: str) -> str:
    text = value.strip().lstrip("#").upper()
    return text if re.fullmatch("[0-9A-F]{6}", text) else ""


def _coloured(cell: ElementTree.Element, colours: dict[str, str]) -> bool:
    """By the archive's colours for the cell's fill, or by its own shading."""
    shade = next((_attribute(x, "fill") for p in cell if _local(p.tag) == "tcPr" for x in p if _local(x.tag) == "shd"), "")
    return (colours.get(_attribute(cell, "borderFillIDRef").strip()) or _colour(shade)) not in PLAIN_COLOURS


def _rows(table: ElementTree.Element, colours: dict[str, str]) -> list[list[Cell]]:
    return [[(_cell_text(c), _span(c, "colSpan", "val"), _span(c, "rowSpan"), _coloured(c, colours)) for c in row if _local(c.tag) == "tc"] for row in table if _local(row.tag) == "tr"]


def _hwpx_table(table: ElementTree.Element, colours: dict[str, str]) -> Iterator[Line]:
    rows = _rows(table, colours)
    n = len(grid(rows))
    for x in lines_of(rows):
        yield Line(x.content, x.block, line=" ".join(x.content.split()) if n == 1 else "", rows=n, header=x.header, caption=x.caption)


def _property(node: ElementTree.Element, group: str, name: str) -> ElementTree.Element | None:
    """A property of a DOCX row or cell."""
    return next((x for p in node if _local(p.tag) == group for x in p if _local(x.tag) == name), None)


def _docx_rows(table: ElementTree.Element) -> list[list[str]]:
    """The texts of each row; that of a merged cell (its first row's) in every row and column that it spans. Rows without text are left
    out."""
    out: list[list[str]] = []
    above: dict[int, str] = {}
    for row in (r for r in table if _local(r.tag) == "tr"):
        skipped = _property(row, "trPr", "gridBefore")
        at, own = int(_attribute(skipped, "val") or 0) if skipped is not None else 0, {}
        for cell in (c for c in row if _local(c.tag) == "tc"):
            merged = _property(cell, "tcPr", "vMerge")
            goes_on = merged is not None and _attribute(merged, "val") in ("", "continue") and at in above
            text, wide = above[at] if goes_on else _cell_text(cell), _span(cell, "val")
            own |= dict.fromkeys(range(at, at + wide), text)
            at += wide
        above = own
        out.append([t for t in own.values() if t])
    return [texts for texts in out if texts]


def _docx_table(table: ElementTree.Element, colours: dict[str, str]) -> Iterator[Line]:
    """A table as one line, with its rows, cells joined by " | ", as parts. One of a single row may be a heading."""
    rows = _docx_rows(table)
    if rows:
        parts = [" | ".join(t.replace("\n", " ") for t in row) for row in rows]
        yield Line("\n".join(" | ".join(row) for row in rows), "table", line=" ".join(" ".join(rows[0]).split()) if len(rows) == 1 else "", rows=len(rows), parts=parts)


def _box(table: ElementTree.Element) -> str | None:
    """The text of a table of one short cell, which stands for a box in its line; empty for one that says nothing."""
    rows = grid(_rows(table, {}))
    if len(rows) != 1 or len(rows[0].texts) != 1 or len(rows[0].texts[0]) > BOX:
        return None
    text = " ".join(rows[0].texts[0].split())
    return "" if text.replace(" ", "") in STATES else f"({text})"


def _paragraph(node: ElementTree.Element, depth: int, table_lines, colours: dict[str, str]) -> Iterator[Line]:
    """The text of a paragraph and its tables in their order: what stands before, between and after them are lines of their own."""
    held = ""
    for piece in _pieces(node):
        box = _box(piece) if not isinstance(piece, str) else None
        if isinstance(piece, str) or box is not None:
            held += piece if isinstance(piece, str) else f" {box} " if box not in held else ""
            continue
        if tidy(held):
            yield Line(tidy(held), depth=depth)
        held = ""
        yield from table_lines(piece, colours)
    if tidy(held):
        yield Line(tidy(held), depth=depth)


def _blocks(node: ElementTree.Element, table_lines, colours: dict[str, str]) -> Iterator[Line]:
    """Paragraphs and tables of a document body."""
    for child in node:
        kind = _local(child.tag)
        if kind == "tbl":
            yield from table_lines(child, colours)
        elif kind == "p":
            yield from _paragraph(child, _docx_depth(child), table_lines, colours)
        else:
            yield from _blocks(child, table_lines, colours)


def _docx_depth(paragraph: ElementTree.Element) -> int:
    """The depth of the heading style of a paragraph."""
    for x in paragraph.iter():
        if _local(x.tag) == "pStyle":
            m = re.fullmatch(r"[Hh]eading\s*([1-9])", _attribute(x, "val"))
            return int(m[1]) if m else 0
    return 0


def _fill_colours(archive: zipfile.ZipFile) -> dict[str, str]:
    """The fill colour of each border of an HWPX archive, by its id."""
    name = next((n for n in COLOUR_FILES if n in archive.namelist()), None)
    borders = [x for x in ElementTree.fromstring(archive.read(name)).iter() if _local(x.tag) == "borderFill"] if name else []
    faces = {_attribute(b, "id").strip(): [_colour(_attribute(x, "faceColor")) for x in b.iter() if _local(x.tag) == "winBrush"] for b in borders}
    return {own: next(filter(None, found)) for own, found in faces.items() if any(found)}


def zipped_lines(data: bytes) -> Iterator[Line]:
    """The lines of a DOCX (word/document.xml) or HWPX (Contents/sectionN.xml by N) file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sections = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"Contents/section(\d+)\.xml", n)))
        colours = _fill_colours(z) if sections else {}
        for name in [n for _, n in sections] or ["word/document.xml"]:
            for x in _blocks(ElementTree.fromstring(z.read(name)), _hwpx_table if sections else _docx_table, colours):
                if x.text.replace(" ", "") not in STATES:
                    yield x


def _read(path: str, data: bytes) -> list[Line]:
    return list(zipped_lines(data) if path.lower().endswith(("docx", "hwpx")) else markdown_lines(data))


def _files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The files below a folder that are read, with their bytes, and the others with the problem: of these only the name and length
    are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    known = F.lower("path").rlike(r"\.(md|txt|docx|hwpx)$")
    refused = files.filter(~known | (F.col("length") > MOST_BYTES)).select("path", F.when(~known, "another kind of file").otherwise("too large").alias("problem"))
    return files.filter(known & (F.col("length") <= MOST_BYTES)).select("path", "content"), refused


def _each_file(files: DataFrame, rows_of, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                try:
                    rows = rows_of(path, _read(path, data))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
                    rows = [tuple({"path": path, "problem": f"broken: {error}", "at": -1, "source_order": -1}.get(n) for n in names)]
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, schema)


def _problem(text: str) -> str | None:
    return "bytes that are no text" if "\ufffd" in text else None


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of all .md, .txt, .docx and .hwpx files below a folder (LINES), and a row (at -1) for each file with a problem."""
    files, refused = _files(spark, folder)

    def rows_of(path: str, own: list[Line]) -> list[tuple]:
        return [(path, k, x.text, x.line or x.text, x.block, x.place, x.rows, x.depth, x.header or None, x.caption or None, _problem(x.text)) for k, x in enumerate(own, 1) if x.text]

    nothing = {"text": "string", "line": "string", "block": "string", "place": "string", "rows": "int", "depth": "int", "header": "array<string>", "caption": "string"}
    rest = refused.select("path", F.lit(-1).cast("long").alias("at"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], "problem")
    return _each_file(files, rows_of, LINES).unionByName(rest)


def document_segments(found: DataFrame, main: list[Heading], appendix: list[Heading] | None = None, body_exit: dict | None = None, appendix_exit: dict | None = None) -> DataFrame:
    """Lines (LINES) as the segments of whole documents, by heading rules as they are stored (structure.rules_of), with sectors,
    open headings and captions on their tables: what passages.chunks() takes, with the path of the file as doc_id. Styles that
    have a depth are headings too. In HWPX files a heading of depth 1 stands alone; in others the first body after a heading is
    led by all that are open."""
    rules, keys = [*main, *(appendix or [])], ["doc_id"]
    own = found.filter("at >= 0").withColumnRenamed("path", "doc_id")
    line, place, rows = F.col("line"), F.col("place"), F.col("rows")
    if appendix:
        enters, leaves = structure.sides(line, main, appendix, body_exit, appendix_exit, place, rows)
        own = structure.with_sector(own, keys, "at", enters, leaves)
    else:
        own = own.withColumn("sector", F.lit("main"))
    style = F.when(F.col("depth") > 0, F.struct(F.col("depth"), F.lit("title").alias("kind"), F.lit("style").alias("rule"), line.alias("notation"), line.alias("text")))
    node = structure.heading_node(line, rules, F.col("sector"), place, rows) if rules else F.lit(None).cast(structure.NODE)
    own = own.withColumn("node", F.coalesce(style.cast(structure.NODE), node)).drop("depth")
    own = structure.with_nodes(own, [*keys, "sector"], "at", "node", [*range(1, 10), *(r.depth for r in rules)])
    split = F.lower("doc_id").endswith(".hwpx")
    parts = [structure.segments(own.filter(which), keys, "at", "text", "node", "block", whole_path=whole) for which, whole in ((split, False), (~split, True))]
    made = parts[0].unionByName(parts[1]).withColumn("path", structure.path_of(F.col("nodes"), F.col("content"))).withColumnRenamed("caption", "own_caption")
    made = structure.with_captions(made, keys, "at", "path", "block", "content", "own_caption")
    return made.select("doc_id", "at", "sector", "block", "content", "path", "nodes", "header", F.coalesce("own_caption", "caption").alias("caption"), "caption_place")


def document_chunks(spark: SparkSession, folder: str, main: list[Heading], appendix: list[Heading] | None = None, body_exit: dict | None = None, appendix_exit: dict | None = None) -> DataFrame:
    """The documents below a folder as chunks (see passages.chunks)."""
    return passages.chunks(document_segments(lines(spark, folder), main, appendix, body_exit, appendix_exit))


def segments(spark: SparkSession, folder: str, rules: list[Heading] | None = None) -> DataFrame:
    """Each line that is no heading with the path of headings above it, for all files below a folder, and a row with the `problem` for
    each file that can't be read (source_order -1) or is read with losses. Headings have a style or fit one of the rules."""
    files, refused = _files(spark, folder)
    patterns = [(re.compile(heading_pattern(r)), r.depth) for r in rules or []]

    def rows_of(path: str, own: list[Line]) -> list[tuple]:
        for x in own:
            x.depth = x.depth or next((d for p, d in patterns if x.place == "paragraph" and p.search(x.text)), 0)
        return [(path, i, p, t, _problem(t)) for i, (p, t) in enumerate(_nested(iter(own)))]

    rest = refused.select("path", F.lit(-1).alias("source_order"), F.lit(None).cast("string").alias("heading_path"), F.lit(None).cast("string").alias("content"), "problem")
    return _each_file(files, rows_of, SEGMENTS).unionByName(rest)
