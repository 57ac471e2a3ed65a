"""Tables of cells: spans laid out, the pattern of the whole table, the role of each row, and the rows as lines of text.

A table is the unit: one group is one table. What a row is follows from its colours, written as a word with a letter for each cell
that has text (c coloured, w not), from the pattern of the table and from the rows before it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .relational import dealt

#: A cell: its text, how many columns and rows it spans, whether it is coloured as headers are.
Cell = tuple[str, int, int, bool]

#: Text of columns that only part others; marks that stand for a value though they have no letter; a text that
#: is a caption; fill colours that count as none.
SPACER, DASHES, CAPTION = r"[↓⇓↑⇑→←↔↕|│┃ ]*", ("-", "–", "—", "~"), r"[《<〈「『].+[》>〉」』]"
PLAIN_COLOURS = ("", "FFFFFF", "FFFDF8", "FDFDFD", "FCFCFC", "FAFAFA")

RECORDS, PAIRS, GROUPS = "header-row-records", "header-value-pairs", "header-value-pair-groups"
HEADER, VALUES, DATA = "header-row", "header-value-row", "data-row"

#: The role of a row by what is open and by its colours: the first pattern that its word has decides. `first` is a table's first
#: row; `mixed` a first row that has coloured headers beside values.
ROLES = {
    "first": [("c+|w+", HEADER), ("cc?w.*", VALUES), (".*", HEADER)],
    "first-mixed": [("c+|w+", HEADER), ("c.*", VALUES), (".*", HEADER)],
    "first-paired": [("c+|w+", HEADER), ("cc?w.*", VALUES), (".*", DATA)],
    "first-paired-mixed": [("c+|w+", HEADER), ("c.*", VALUES), (".*", DATA)],
    RECORDS: [("c+", HEADER), ("cw.*", VALUES), (".*", DATA)],
    PAIRS: [("c+", HEADER), ("cc?w.*", VALUES), (".*c.*", HEADER), (".*", DATA)],
}
ROLES[GROUPS] = ROLES[PAIRS]


@dataclass(frozen=True)
class Row:
    """The texts of a row by column, each in lines without needless blanks, and whether they are coloured."""

    texts: list[str]
    coloured: list[bool]

    @property
    def seen(self) -> list[str]:
        return [t for t in self.texts if t]

    @property
    def colours(self) -> str:
        return "".join("c" if c else "w" for t, c in zip(self.texts, self.coloured) if t)

    @property
    def pairs(self) -> list[tuple[int, int]]:
        """The columns of neighbours that both have text."""
        return [(k, k + 1) for k in range(0, len(self.texts) - 1, 2) if self.texts[k] and self.texts[k + 1]]


@dataclass
class Line:
    """A row as text: what block it is, its role, the headers above it, the caption that it bears."""

    content: str
    block: str
    role: str = DATA
    header: list[str] = field(default_factory=list)
    caption: str = ""


def tidy(text: str | None) -> str:
    return "\n".join(filter(None, (" ".join(line.split()) for line in (text or "").splitlines())))


def grid(rows: list[list[Cell]]) -> list[Row]:
    """The cells where they stand: each takes the first free place of its row and all places that it spans; the first column of a
    span has the text, in each row of it. Rows without text and columns that only part others are left out."""
    places: dict[tuple[int, int], tuple[str, bool]] = {}
    for y, cells in enumerate(rows):
        x = 0
        for text, wide, high, coloured in cells:
            while (y, x) in places:
                x += 1
            span = [(y + down, x + right) for down in range(min(high, len(rows) - y)) for right in range(wide)]
            for place in span:
                places.setdefault(place, (tidy(text) if place[1] == x else "", coloured))
    width = 1 + max((x for _, x in places), default=-1)
    lines = [[places.get((y, x), ("", False)) for x in range(width)] for y in range(len(rows))]
    lines = [line for line in lines if any(t for t, _ in line)]
    kept = [x for x in range(width) if not all(re.fullmatch(SPACER, line[x][0]) for line in lines)] if width > 1 else []
    return [Row([line[x][0] for x in kept or range(width)], [line[x][1] for x in kept or range(width)]) for line in lines]


def _says(text: str) -> bool:
    return text in DASHES or any(c.isalnum() for c in text)


def _in_groups(row: Row) -> bool:
    """Whether the values of a row are lists of their own: an odd number of texts, or values with lines or colons."""
    if len(row.seen) >= 3 and len(row.seen) % 2:
        return True
    return any("\n" in v or ":" in v or "：" in v for v in row.texts[1::2])


def pattern_of(table: list[Row]) -> str:
    """The pattern of a whole table: pairs, if its columns go in twos and its first row, its colours or its texts say so."""
    width = len(table[0].texts) if table else 0
    if len(table) < 2 or width < 2 or width % 2:
        return RECORDS
    colours = [[(row.coloured[h], row.coloured[v]) for h, v in row.pairs] for row in table]
    first, every = colours[0], [c for row in colours for c in row]
    heads, plain = sum(h for h, _ in every), sum(not v for _, v in every)
    led = not re.fullmatch("cc+", table[0].colours) and (any(h for h, _ in first) or sum(not v for _, v in first) >= 2)
    by_colour = heads >= 2 and plain >= 2 and 2 * len(every) - heads - plain <= max(2, heads // 2)
    if not (led or by_colour or len(every) >= max(2, len(table))):
        return RECORDS
    return GROUPS if _in_groups(table[0]) else PAIRS


def _role(row: Row, state: str, mixed: bool) -> str:
    table = ROLES[f"{state}-mixed" if mixed and f"{state}-mixed" in ROLES else state]
    return next(role for word, role in table if re.fullmatch(word, row.colours))


def _one_line(text: str) -> str:
    return " ".join(text.split("\n"))


def _paired(row: Row) -> str:
    return "\n".join(f"{_one_line(row.texts[h])}: {row.texts[v]}" for h, v in row.pairs)


def _values(row: Row, pattern: str) -> str:
    """A row of headers and their values: pairs beside each other, or a main header over further headers and their values."""
    if pattern != GROUPS or len(row.seen) < 3:
        return _paired(row)
    main, rest = _one_line(row.seen[0]), row.seen[1:]
    twos = [" : ".join([_one_line(rest[k]), *rest[k + 1 : k + 2]]) for k in range(0, len(rest), 2)]
    return f"{main}: {', '.join(twos)}"


def _under(headers: list[str], row: Row) -> str:
    """The values of a row below their headers; where headers are empty they go on with the one before."""
    values = [(headers[x] if x < len(headers) else "", t) for x, t in enumerate(row.texts)]
    if all(headers):
        return "\n".join(f"{h}: {t}" if h else t for h, t in values if t and _says(t))
    groups: list[tuple[str, list[str]]] = []
    for head, text in values:
        if head:
            groups.append((head, []))
        if groups and text and _says(text):
            groups[-1][1].append(text)
    joined = "\n".join(f"{h}: {' | '.join(own)}" for h, own in groups if own)
    return joined or "\n".join(t for _, t in values if t and _says(t))


def lines_of(rows: list[list[Cell]]) -> Iterator[Line]:
    """A table as lines: one for each row of values, with the headers that hold for it. A table of one row, one with a caption in a
    row of its own and one without values are one line."""
    table = grid(rows)
    if len(table) == 1:
        yield Line("\n".join(table[0].seen), "table-single-row")
        return
    if table and len(table[0].seen) == 1 and re.fullmatch(CAPTION, table[0].seen[0]):
        caption = table[0].seen[0]
        body = ["\n".join(r.seen) for r in table[1:]]
        yield Line("\n".join([caption, *(body[1:] if body[0] == caption else body)]), "table", caption=caption)
        return
    open_, headers, plain_below, told = pattern_of(table), [], False, False
    for nth, row in enumerate(table):
        if not any(map(_says, row.texts)):
            continue
        word = row.colours
        state = open_ if nth else "first" if open_ == RECORDS else "first-paired"
        role = _role(row, state, mixed=word.startswith("c") and any(row.coloured[h] for h, _ in row.pairs))
        if open_ == RECORDS and headers and nth:
            # Right below a header row stand values; if they lead with a coloured cell, so may all that follow.
            plain_below = plain_below or (nth == 1 and word.startswith("c"))
            role = DATA if nth == 1 or plain_below else role
        if role == HEADER:
            open_, headers, plain_below = RECORDS, [_one_line(t) for t in row.texts], False
            continue
        own = PAIRS if re.match("cw", word) else GROUPS if re.match("ccw", word) else GROUPS if _in_groups(row) else PAIRS
        if role == VALUES:
            content = f"{_one_line(row.seen[0])}: {', '.join(row.seen[1:])}" if open_ == RECORDS and re.match("cw", word) else _values(row, own)
            open_ = own if content else open_
        else:
            content = _under(headers, row) if headers else _values(row, own) if open_ != RECORDS else ""
            content = content or "\n".join(row.seen)
        if content:
            told = True
            yield Line(content, "table-row", role, headers if role == DATA else [])
    if table and not told:
        yield Line("\n".join(" | ".join(r.seen) for r in table), "table")


CELLS = ["table_id", "row", "text", "col_span", "row_span", "coloured"]


def _by_table(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[list[Cell]]]]:
    """Sorted cells as tables: the id and the rows of each."""
    known = (c for batch in batches for c in zip(*(batch.column(n).to_pylist() for n in CELLS)))
    for table, own in groupby(known, key=lambda c: c[0]):
        yield table, [[(c[2] or "", max(1, c[3] or 1), max(1, c[4] or 1), bool(c[5])) for c in row] for _, row in groupby(own, key=lambda c: c[1])]


def tables(cells: DataFrame) -> DataFrame:
    """Cells (table_id, row, col, text, col_span, row_span, coloured) to the lines of each table: table_id, nth, block, role,
    content, header (array), caption. Tables pass one after the other as a stream of sorted cells."""
    out = StructType().add("table_id", cells.schema["table_id"].dataType).add("nth", IntegerType())
    for name, kind in (("block", StringType()), ("role", StringType()), ("content", StringType()), ("header", ArrayType(StringType())), ("caption", StringType())):
        out = out.add(name, kind)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for table, rows in _by_table(batches):
            made += [{"table_id": table, "nth": k, "block": x.block, "role": x.role, "content": x.content, "header": x.header, "caption": x.caption} for k, x in enumerate(lines_of(rows))]
            if len(made) >= 5000:
                yield pa.RecordBatch.from_pylist(made, schema)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    ordered = cells.select("table_id", "row", "col", "text", F.col("col_span").cast("int"), F.col("row_span").cast("int"), "coloured")
    return dealt(ordered, ["table_id"], ["row", "col"]).mapInArrow(run, out)
