"""Document structure against plain versions that go line by line."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tillage.operators import cells as C
from tillage.operators import passages as P
from tillage.operators import structure as S
from tillage.operators.structure import Heading
from tillage.plans import structure as plans


@pytest.mark.parametrize(
    ("rule", "good", "bad"),
    [
        (Heading("numeric_dot", 1, notation="1."), ["1. Text", " 12.글"], ["1 Text", "1.", "a. b", "1. 23"]),
        (Heading("numeric_dot", 1, options={"segments": 2}), ["1.2 Text", "1.2. Text"], ["1. Text"]),
        (Heading("numeric_dot", 1, options={"trailing_dot": "forbidden", "leading_space_max": 1}), [" 1 Text"], ["  1 Text"]),
        (Heading("korean_letter_dot", 1, notation="가."), ["가. 글"], ["가 글", "A. b"]),
        (Heading("korean_letter_paren", 1), ["나) 글"], ["나 글"]),
        (Heading("roman", 1), ["Ⅱ. Part", "IV Part", "Ⅲ글"], ["1. Part"]),
        (Heading("numeric_paren", 1), ["3) x"], ["(3) x", "3. x"]),
        (Heading("paren_numeric", 1), ["(3) x"], ["3) x"]),
        (Heading("paren_korean", 1), ["(가) x"], ["가) x"]),
        (Heading("circled_number", 1), ["③ x"], ["3 x", "③"]),
        (Heading("circled_korean", 1), ["㉠ x"], ["가 x"]),
        (Heading("legal_article", 1), ["제3조 x", "제3조의2(목적) x"], ["제3 x"]),
        (Heading("symbol", 1, options={"symbols": ["□", "-"]}), ["□ x", "- x"], ["x"]),
        (Heading("symbol", 1, options={"symbols": "□", "require_text_after_marker": False}), ["□", "□ 1"], ["□1"]),
        (Heading("symbol", 1, options={"symbols": "□", "require_text_after_marker": False, "trailing_space_max": 1}), ["□ "], ["□  ", "□ 1"]),
        (Heading("pattern", 1, options={"pattern": "^Art [0-9]+"}), ["Art 3"], ["An Art 3"]),
    ],
)
def test_heading_rules(spark, rule, good, bad):
    df = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", S.heading_depth(F.col("t"), [rule]).alias("d")).collect()}
    assert got == {t: 1 for t in good} | {t: None for t in [*bad, None]}


def test_sectors(spark):
    """All runs of lines that enter, leave, do both, neither or say nothing."""
    rows = [(k, i, e, b) for k, own in enumerate(itertools.product([(True, False), (False, True), (True, True), (False, False), (None, None)], repeat=4)) for i, (e, b) in enumerate(own)]
    df = spark.createDataFrame(rows, "k int, i int, e boolean, b boolean")
    got = {(r["k"], r["i"]): r["sector"] for r in S.with_sector(df, ["k"], "i", F.col("e"), F.col("b")).collect()}
    for _, own in itertools.groupby(rows, key=lambda r: r[0]):
        side = "main"
        for k, i, e, b in own:
            if side == "main" and e:
                side = "appendix"
            elif side == "appendix" and b:
                side = "main"
            assert got[k, i] == side


def test_criteria():
    """Stored criteria choose rules of the other side; symbols never lead back; criteria of another mode choose none."""
    main = [Heading("roman", 1, notation="Ⅰ.", name="r"), Heading("symbol", 1, notation="■", options={"symbols": "■"}), Heading("numeric_dot", 2, notation="1."), Heading("paren_numeric", 3, notation="(1)")]
    kinds = lambda c: [r.kind for r in S.leaving(main, c)]
    assert kinds({"mode": "matched_heading", "match": {"depth": 2}}) == ["roman", "symbol", "numeric_dot"]
    assert kinds({"mode": "matched_heading", "match": {"depth": 3, "notation": "(1)"}}) == ["paren_numeric"]
    assert kinds({"mode": "matched_heading", "match": {"rule_id": "r"}}) == ["roman"]
    assert kinds({"mode": "other", "match": {}}) == kinds({"mode": "matched_heading"}) == kinds(None) == []
    assert [r.symbolic for r in main] == [False, True, False, False]


def test_sides(spark):
    main = [Heading("roman", 1, notation="Ⅰ."), Heading("symbol", 1, notation="■", options={"symbols": "■"}), Heading("paren_numeric", 3, notation="(1)")]
    appendix = [Heading("appendix_title_table", 1, "appendix", location="table"), Heading("numeric_paren", 2, "appendix", notation="1)")]
    rows = [("■ a", "paragraph", None), ("참고 1 | Forms", "table", 1), ("Ⅰ. b", "paragraph", None), ("참고 1 | Forms", "table", 3), ("1) c", "paragraph", None), ("(1) d", "paragraph", None), (None, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, line string, place string, rows int")

    def found(**criteria):
        enters, leaves = S.sides(F.col("line"), main, appendix, place=F.col("place"), rows=F.col("rows"), **criteria)
        return [(bool(r["e"]), bool(r["l"])) for r in df.select("k", enters.alias("e"), leaves.alias("l")).orderBy("k").collect()]

    no = (False, False)
    assert found() == [no, (True, False), (False, True), no, no, no, no]
    wide = {"mode": "matched_heading", "match": {"depth": 3}}
    assert found(body_exit=wide, appendix_exit=wide) == [no, (True, False), (False, True), no, (True, False), (False, True), no]


LINES = [
    ("Ⅰ. One", "paragraph"), ("1. Two", "paragraph"), ("2. Three", "paragraph"), ("(1) four", "paragraph"), ("body", "paragraph"), ("1. Five", "paragraph"), ("<Of six>", "paragraph"), ("a | b", "table-row"), ("a | c", "table-row"),
    ("2) annex", "paragraph"), ("1. Six", "paragraph"), ("3) x", "paragraph"), ("text", "paragraph"), ("Ⅱ. Seven", "paragraph"), ("same  text", "paragraph"), ("same text", "table"), ("<Late>", "paragraph"), ("Ⅲ. Last", "paragraph"),
]


def plain_segments(rows, pending):
    """One document line by line: rows of (sector, node or None, text, kind), with a list of waiting headings for each sector."""
    out, waiting = [], {}
    for at, (sector, node, text, kind) in enumerate(rows):
        held = waiting.setdefault(sector, [])
        if node:
            if held and held[-1][1]["depth"] == 1 and node["depth"] > 1:
                out.append((held[-1][0], sector, "heading-line", held[-1][1]["text"]))
            held.append((at, node))
            if re.search(S.SAYING, text) or node["kind"] == "divider":
                out.append((at, sector, "heading-inline", text))
                held.clear()
            continue
        if held and held[-1][1]["depth"] == 1:
            out.append((held[-1][0], sector, "heading-line", held[-1][1]["text"]))
        led = [n["text"] for _, n in (held if pending is None else held[-pending:]) if n["depth"] > 1 and not kind.startswith("table")]
        out.append((at, sector, kind, "\n".join([*led, text])))
        held.clear()
    return sorted(out)


@pytest.mark.parametrize("pending", [1, 2, None])
def test_segments(spark, pending):
    """Of headings in a row the last, the last two or all lead the body after them, in each sector by itself."""
    rules = [Heading("roman", 1, notation="Ⅰ."), Heading("numeric_dot", 2, notation="1."), Heading("paren_numeric", 4, notation="(1)"), Heading("pattern", 3, options={"pattern": "^[a-z]{2}$"}), Heading("numeric_paren", 1, "appendix", notation="1)")]
    rng = random.Random(4)
    pool = [*LINES, ("de", "paragraph"), ("fg", "paragraph"), ("3. With: colon", "paragraph"), ("plain", "paragraph")]
    rows = [(d, i, *rng.choice(pool)) for d in range(40) for i in range(rng.randrange(30))]
    df = spark.createDataFrame(rows, "d int, at int, line string, kind string")
    main, appendix = [r for r in rules if r.sector == "main"], [r for r in rules if r.sector == "appendix"]
    enters, leaves = S.sides(F.col("line"), main, appendix)
    known = S.with_sector(df, ["d"], "at", enters, leaves).withColumn("node", S.heading_node(F.col("line"), rules, F.col("sector")))
    plain = {}
    for r in known.orderBy("d", "at").collect():
        plain.setdefault(r["d"], []).append((r["sector"], r["node"] and r["node"].asDict(), r["line"], r["kind"]))
    got = {}
    for r in S.segments(known, ["d"], "at", "line", "node", "kind", pending).collect():
        got.setdefault(r["d"], []).append((r["at"], r["sector"], r["block"], r["content"]))
    flat = lambda t: " ".join(t.split())
    for d, own in plain.items():
        every = plain_segments(own, pending)
        kept = [x for x, y in zip(every, [*every[1:], None]) if not (y and x[2] == "paragraph" and y[2] == "table" and flat(x[3]) == flat(y[3]))]
        assert sorted(got.get(d, [])) == kept, d


def test_three_headings_in_a_row(spark):
    rules = [Heading("roman", 1, notation="Ⅰ."), Heading("numeric_dot", 2, notation="1."), Heading("pattern", 3, options={"pattern": "^[a-z]{2}$"}), Heading("pattern", 4, options={"pattern": "^[A-Z]{2}$"})]
    df = spark.createDataFrame([(1, i, t, "paragraph") for i, t in enumerate(["Ⅰ. Top", "1. Two", "ab", "GH", "body", "more"])], "d int, at int, line string, kind string").withColumn("sector", F.lit("main"))
    df = S.with_nodes(df.withColumn("node", S.heading_node(F.col("line"), rules)), ["d"], "at", "node", [1, 2, 3, 4])
    texts = lambda **k: [r["content"] for r in S.segments(df, ["d"], "at", "line", "node", "kind", **k).orderBy("at").collect()]
    assert texts() == ["Ⅰ. Top", "GH\nbody", "more"]
    assert texts(pending=None) == ["Ⅰ. Top", "1. Two\nab\nGH\nbody", "more"]
    assert texts(whole_path=True) == ["Ⅰ. Top\n1. Two\nab\nGH\nbody", "more"]


def test_captions(spark):
    """A caption is on its table only: the next, else the last; a table may give one away and take another."""
    rows = [("p", "<A> x"), ("p", "text\n<B>\nmore"), ("p", "<C>"), ("table", "cells"), ("table-row", "row"), ("p", "<D>"), ("p", "<E>"), ("table", "<F>\nown"), ("p", "between"), ("table", "last"), ("p", "<G>"), ("x", "<H>")]
    df = spark.createDataFrame([(1, i, "h", "paragraph" if k == "p" else k, t) for i, (k, t) in enumerate(rows)], "d int, at int, path string, block string, content string")
    got = [(r["at"], r["content"], r["caption"], r["caption_place"]) for r in S.with_captions(df, ["d"], "at", "path", "block", "content").orderBy("at").collect()]
    assert got == [
        (0, "<A> x", None, None),
        (1, "text\nmore", None, None),
        (3, "<C>\n<B>\ncells", "<C>", "before-table"),
        (4, "row", None, None),
        (7, "<E>\n<D>\nown", "<E>", "before-table"),
        (8, "between", None, None),
        (9, "<G>\n<F>\nlast", "<G>", "after-table"),
        (11, "<H>", None, None),
    ]


def test_captions_in_boxes(spark):
    """A caption in a box of its own goes to the table beside it, the next or else the last, if that is under its heading; what is
    between ends the search; captions that tables have brought with them stay."""
    kinds = {"p": "paragraph", "t": "table", "r": "table-row", "s": "table-single-row", "h": "heading-line"}
    rows = [
        ("a", "s", "<A>", ""), ("a", "p", "text", ""), ("a", "r", "one", ""), ("a", "r", "two", ""),
        ("a", "s", "<B>", ""), ("a", "h", "stop", ""), ("a", "t", "<C>\nthree", "<C>"), ("a", "t", "four", ""),
        ("b", "s", "<D>", ""), ("c", "t", "five", ""), ("c", "s", "<E>\nmore", ""), ("c", "s", "<F>", ""), ("c", "p", "<G>", ""), ("c", "s", "a | b", ""),
    ]
    df = spark.createDataFrame([(1, i, h, kinds[k], t, own) for i, (h, k, t, own) in enumerate(rows)], "d int, at int, path string, block string, content string, own string")
    got = {r["at"]: (r["content"], r["caption"], r["caption_place"]) for r in S.with_captions(df, ["d"], "at", "path", "block", "content", "own").collect()}
    # <A> and <B> meet at the rows between them; nothing is beside <D>, and <F> and <G> have boxes on both sides.
    moved = {2: ("<B>\n<A>\none", "<B>", "after-table"), 9: ("<E>\nfive", "<E>", "after-table"), 10: ("more", None, None)}
    assert got == {i: moved.get(i, (t, None, None)) for i, (_, _, t, _) in enumerate(rows) if i not in (0, 4)}


def test_nodes(spark):
    """Open headings against a stack."""
    rng = random.Random(8)
    rows = [(d, i, rng.choice([None, None, 1, 2, 3, 5])) for d in range(30) for i in range(rng.randrange(25))]
    df = spark.createDataFrame(rows, "d int, at int, depth int").withColumn("node", F.when(F.col("depth").isNotNull(), F.struct("depth", F.lit("title").alias("kind"), F.lit("r").alias("rule"), F.lit("").alias("notation"), F.col("at").cast("string").alias("text"))))
    got = {(r["d"], r["at"]): [n["text"] for n in r["nodes"]] for r in S.with_nodes(df, ["d"], "at", "node", [1, 2, 3, 5]).collect()}
    for _, own in itertools.groupby(rows, key=lambda r: r[0]):
        stack = []
        for d, at, depth in own:
            if depth:
                stack = [s for s in stack if s[0] < depth] + [(depth, str(at))]
            assert got[d, at] == [t for _, t in stack]


def test_preview(spark):
    """Rules that nothing fits are dropped, marks that no rule knows are proposed, below what is open before them."""
    rules = [Heading("roman", 1, notation="Ⅰ."), Heading("numeric_dot", 3, notation="1.")]
    texts = ["① first", "Ⅰ. Top", "▶ mark one", "▶ mark two", "▶ 12", "※ note", "plain", None, "Ⅰ. Again", " ○ late"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "d int, at int, line string")
    got = {(r["rule"], r["notation"]): (r["depth"], r["n"], r["samples"], r["action"]) for r in S.preview(df, "line", rules, 2, ["d"], "at").collect()}
    assert got == {
        ("roman", "Ⅰ."): (1, 2, ["Ⅰ. Again", "Ⅰ. Top"], "keep"),
        ("numeric_dot", "1."): (3, 0, [], "drop"),
        ("symbol", "①"): (5, 1, ["① first"], "new"),
        ("symbol", "▶"): (2, 2, ["▶ mark one", "▶ mark two"], "new"),
        ("symbol", "※"): (2, 1, ["※ note"], "new"),
        ("symbol", "○"): (2, 1, [" ○ late"], "new"),
    }


c = lambda t, w=1, h=1, x=False: (t, w, h, x)
H = lambda t, w=1, h=1: (t, w, h, True)


def told(*rows):
    return [x.content for x in C.lines_of(list(rows))]


def test_table_grid():
    """Every place has the cell that covers it, and no cell covers a place that is taken."""
    assert [r.texts for r in C.grid([[c("a", 2), c("b")], [c("x", 1, 2), c("c", 2)], [c("d"), c("e")]])] == [["a", "", "b"], ["x", "c", ""], ["x", "d", "e"]]
    assert [r.texts for r in C.grid([[c("a"), c("↓"), c("b")], [c("c"), c(" "), c("d")], [c(" ")]])] == [["a", "b"], ["c", "d"]]
    assert [r.texts for r in C.grid([[c("a", 1, 9)], [c("b")]])] == [["a", ""], ["a", "b"]] and C.grid([]) == [] and C.grid([[c("", 3, 2)]]) == []
    rng = random.Random(1)
    for _ in range(200):
        rows = [[c(f"{y}.{x}", rng.randint(1, 3), rng.randint(1, 3)) for x in range(rng.randint(1, 4))] for y in range(rng.randint(1, 5))]
        made = C.grid(rows)
        for y, cells in enumerate(rows):
            for text, wide, high, _ in cells:
                # A cell stands once in each row that it spans, in one column, whatever is beside it.
                assert [y2 for y2, r in enumerate(made) if text in r.texts] == list(range(y, min(y + high, len(rows))))
                assert len({r.texts.index(text) for r in made if text in r.texts}) == 1


def test_table_patterns(spark):
    assert told([H("kind"), H("a", 2)], [c("k1", h=2), c("1"), c("2")], [c("3"), c("4")], [c(" "), c("")]) == ["kind: k1\na: 1 | 2", "kind: k1\na: 3 | 4"]
    assert told([H("h1"), c("v1"), H("h2"), c("v2")], [H("x"), c("y"), c(""), c("")]) == ["h1: v1\nh2: v2", "x: y"]
    # A main header over headers and their values; the pattern changes with a row that is coloured throughout.
    assert told([H("rates"), H("rice"), c("5"), c("")], [H("rates"), H("hay"), c("3"), c("")], [H("crop"), H("rate")], [c("rye"), c("4")]) == ["rates: rice : 5", "rates: hay : 3", "crop: rye\nrate: 4"]
    # Without colours the first row is a header row; marks without letters are no values, dashes are.
    assert told([c("a"), c("b")], [c("1"), c("-")], [c("*"), c("*")], [c("2"), c("*")]) == ["a: 1\nb: -", "a: 2"]
    # Records whose first column is coloured: all rows below the header are records.
    assert told([H("n"), H("v")], [H("x"), c("1")], [H("y"), c("2")]) == ["n: x\nv: 1", "n: y\nv: 2"]
    # A row of a header and values between records.
    assert told([H("n"), H("v")], [c("x"), c("1")], [H("sum"), c("1")]) == ["n: x\nv: 1", "sum: 1"]
    assert [(x.block, x.content, x.caption) for x in C.lines_of([[c("《Title》", 2)], [c("a"), c("b")], [c("d"), c("e")]])] == [("table", "《Title》\na\nb\nd\ne", "《Title》")]
    assert [(x.block, x.content) for x in C.lines_of([[c("one"), c("row")]])] == [("table-single-row", "one\nrow")]
    assert [(x.block, x.content) for x in C.lines_of([[H("only"), H("heads")], [H("and"), H("more")]])] == [("table-row", "only: and\nheads: more")]
    assert [(x.block, x.content) for x in C.lines_of([[c("*"), c("!")], [c("!"), c("*")]])] == [("table", "* | !\n! | *")]
    assert told() == [] and told([c("", 3, 2)]) == []
    rows = [(1, 0, 0, "h", 1, 1, True), (1, 0, 1, "v", 1, 1, False), (1, 1, 0, "g", None, None, True), (1, 1, 1, "w", 1, 0, None), (2, 0, 0, None, 1, 1, None)]
    df = spark.createDataFrame(rows, "table_id long, row long, col int, text string, col_span int, row_span int, coloured boolean")
    assert [(r["table_id"], r["nth"], r["role"], r["content"]) for r in C.tables(df).orderBy("nth").collect()] == [(1, 0, C.VALUES, "h: v"), (1, 1, C.VALUES, "g: w")]


NODE = lambda d, t, kind="title", rule="r", mark="": (d, kind, rule, mark or t, t)
A, B, PRIMARY, OTHER = NODE(1, "A"), NODE(2, "B"), NODE(3, "(1) p", "divider", "paren_numeric", "(1)"), NODE(3, "(2) q", "divider", "paren_numeric", "(2)")


def chunked(spark, rows):
    """Rows (sector, block, content, nodes, header, caption) of one document as its chunks."""
    made = [(1, at + 10, s, b, t, " > ".join(n[4] for n in nodes), list(nodes), h, cap, None) for at, (s, b, t, nodes, h, cap) in enumerate(rows)]
    return P.chunks(spark.createDataFrame(made, P.SEGMENT)).orderBy("chunk").collect()


def test_points():
    """Scores worked out by hand."""
    base = dict(path="x", primary="p", structure="p > q", title="A", titles="A > B", side="main|text", depth=3)
    assert P.points(base, base) == 1 + 3 + 4 + 2 + 3 + 2 + 1
    assert P.points(base, base | {"path": "y"}) == 16 - 3 - 2
    assert P.points(base, base | {"primary": "z", "structure": ""}) == 16 - 4 - 1 - 2
    assert P.points(base, base | {"primary": "", "structure": "z", "titles": "A > C"}) == 16 - 4 - 2 - 2
    assert P.points(base, base | {"depth": 5}) == 15 and P.points(base | {"side": "main|table"}, base | {"side": "main|table"}) == 12


def test_chunks_by_hand(spark):
    text = lambda n: "word " * (n // 5)
    row = lambda t, nodes, sector="main", block="paragraph", header=None, caption=None: (sector, block, t, nodes, header, caption)
    spans = lambda rows: [(r["first_at"] - 10, r["last_at"] - 10) for r in chunked(spark, rows)]
    # Short lines under one heading stay together whatever their number; a date ends its paragraph.
    assert spans([row(f"line {k}", (A, B)) for k in range(40)]) == [(0, 39)]
    assert spans([row(text(900), (A, B)), row("2024년 1월 2일", (A, B))]) == [(0, 1)]
    # One heading, 900 and 200 characters: 1 + 3 + 3 + 2 + 1 = 10 points, but over the limit.
    assert spans([row(text(600), (A, B)), row(text(250), (A, B)), row(text(250), (A, B))]) == [(0, 1), (2, 2)]
    # Another first heading: 1 + 3 + 2 + 1 - 2 - 1 = 4 points, enough below 350 characters only.
    assert spans([row(text(200), (A, B, PRIMARY)), row(text(200), (A, B, OTHER))]) == [(0, 1)]
    assert spans([row(text(400), (A, B, PRIMARY)), row(text(200), (A, B, OTHER))]) == [(0, 0), (1, 1)]
    # Another outermost title, sector or kind of block is a wall; lines of dashes are left out.
    assert spans([row("a", (A,)), row("b", (NODE(1, "Z"),)), row("c", (NODE(1, "Z"),), "appendix"), row("-----", (A,)), row("d", (A,), "appendix", "heading-line")]) == [(0, 0), (1, 1), (2, 2), (4, 4)]
    # Rows of one table are joined up to the limit; other headers and tables that aren't rows stand alone.
    table = [row(f"h: {text(300)}", (A,), block="table-row", header=["h"]) for _ in range(4)]
    assert spans([*table, row("h: x", (A,), block="table-row", header=["g"]), row("t", (A,), block="table"), row("t", (A,), block="table")]) == [(0, 2), (3, 3), (4, 4), (5, 5), (6, 6)]
    got = chunked(spark, [row("x", (A,), block="table-row", header=["h"], caption="<C>"), *[row(text(700), (A,), block="table-row", header=["h"])] * 2])
    assert [(r["path"], r["caption"], r["n_segments"]) for r in got] == [("A > 📋 <C>", "<C>", 2), ("A > 📋 <C>", "<C>", 1)]
    # A paragraph that goes on into the table below it ends there.
    assert [r["content"] for r in chunked(spark, [row("Rates are: crop  rate rice 5", (A,)), row("crop: rice\nrate: 5", (A,), block="table-row", header=["crop", "rate"])])] == ["A\nRates are:", "crop: rice\nrate: 5"]
    assert chunked(spark, []) == []


def test_chunk_paths(spark):
    """Titles come up once; a heading that divides and is a sentence is its mark, or nothing, by how many chunks it has."""
    long = "words without end " * 60
    mark = NODE(3, "○ A whole sentence", "divider", "symbol", "○")
    row = lambda t, nodes: ("main", "paragraph", t, nodes, None, None)
    got = chunked(spark, [row(long[:960], (A, B, mark)), row(long[:960], (A, B, mark)), row("○ A whole sentence", (A, B, mark)), row(f"x {long[:958]}", (A, NODE(2, "D"))), row("(2) q", (OTHER,)), row("end", (A, NODE(2, "A"), NODE(3, "A")))])
    assert [r["path"] for r in got] == ["A > B", "A > B > ○ A whole sentence", "A > B > ○", "A > D", "(2) q", "A"]
    assert [r["content"].split("\n")[:2] for r in got][:4] == [["A", "B"], [long[:960].strip()], ["○ A whole sentence"], ["D", f"x {long[:958]}".strip()]]


def test_chunk_properties(spark):
    """Chunks of random documents: in order, each segment in one; no wall within; none too long unless a single sentence is."""
    rng = random.Random(2)
    rows = []
    for doc in range(25):
        for at in range(rng.randrange(60)):
            nodes = rng.choice([(), (A,), (A, B), (A, B, PRIMARY), (A, B, OTHER), (NODE(1, "Z"),), (NODE(1, "Z"), PRIMARY)])
            block = rng.choice(["paragraph"] * 6 + ["heading-inline", "table-row", "table-row", "table-row", "table", "table-single-row"])
            content = rng.choice(["x", "word " * 30, "word " * 90, "-----", "", " \n ", "2024년 1월 2일", "t. " * 20, "Sentence is here. " * 120, "line: of a row\n" * 100])
            rows.append((doc, at, rng.choice(["main"] * 5 + ["appendix"]), block, f"{content}#{at}#" if len(content) > 5 and content[0] not in "-2 " else content, " > ".join(n[4] for n in nodes), list(nodes), rng.choice([["h"], ["g"], None]) if block == "table-row" else None, None, None))
    order = list(rows)
    rng.shuffle(rows)
    got = {}
    for r in P.chunks(spark.createDataFrame(rows, P.SEGMENT)).orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append(r)
    of = {}
    for r in order:
        if r[4].strip() and not re.fullmatch(P.RULE, " ".join(r[4].split())):
            of.setdefault(r[0], {})[r[1]] = r
    assert got.keys() == of.keys()
    family = lambda b: "text" if b in S.TEXT_BLOCKS else "table" if b.startswith("table") else b
    for doc, own in got.items():
        assert [r["chunk"] for r in own] == list(range(1, len(own) + 1))
        seen = []
        for r in own:
            inside = [s for at, s in of[doc].items() if r["first_at"] <= at <= r["last_at"]]
            assert len(inside) == r["n_segments"] and len({(s[2], family(s[3])) for s in inside}) == 1
            tops = {n[4] for s in inside for n in s[6][:1] if n[1] == "title"}
            assert len(tops) <= 1 or all(len(s[4]) <= 180 for s in inside)
            if len(inside) > 1 and "table" in r["block"] and r["block"] != "table-single-row":
                assert len({(s[5], str(s[7])) for s in inside}) == 1
            titles = sum(len(n[4]) + 1 for n in inside[0][6])
            if r["block"] in (*S.TEXT_BLOCKS, "table-row"):
                assert len(r["content"]) <= P.MOST + P.OVERLAP + titles
            if r["part"] == 0:
                seen += [s[1] for s in inside]
        assert seen == sorted(of[doc])
        whole = "\n".join(r["content"] for r in own)
        assert all(f"#{at}#" in whole for at, s in of[doc].items() if f"#{at}#" in s[4] and s[3] != "paragraph")


def test_split_texts():
    rng = random.Random(6)
    for _ in range(200):
        words = ["w" * rng.randint(1, 30) + rng.choice(["", "", ".", ",", "!"]) for _ in range(rng.randint(1, 120))]
        text = " ".join(words)
        parts = P.overlapped(text, 200, 20)
        assert all(len(p) <= 221 for p in parts) or any(len(s) > 180 for s in re.split(P.SENTENCE, text))
        assert [w for w in " ".join(parts).split() if w in set(words)] and parts[0] == text[: len(parts[0])]
        assert not text[len(parts[0]) :].strip() or len(parts) > 1
    assert P.overlapped("x" * 450, 200, 20) == ["x" * 200, "x" * 200, "x" * 90] and P.overlapped("  ") == [] and P.overlapped(" a ") == ["a"]
    assert P.by_lines("ab\n\ncd\n" + "x" * 12, 6) == ["ab\ncd", *P.overlapped("x" * 12, 6)]


def test_chunks_of_the_tables(spark, sf_dir):
    """Every segment is in one chunk, in order, under its own headings."""
    own = {}
    for r in plans.segments(spark, sf_dir).collect():
        if r["content"].strip():
            own.setdefault(r["doc_id"], {})[r["at"]] = r
    seen = {}
    for r in plans.d8_chunks(spark, sf_dir).orderBy("doc_id", "chunk").collect():
        inside = [s for at, s in own[r["doc_id"]].items() if r["first_at"] <= at <= r["last_at"]]
        assert inside and {s["sector"] for s in inside} == {r["sector"]} and r["n_segments"] == len(inside)
        assert r["parts"] > 1 or inside[0]["content"].splitlines()[-1].strip() in r["content"]
        seen.setdefault(r["doc_id"], []).extend(s["at"] for s in inside if r["part"] == 0)
    assert {k: sorted(v) for k, v in own.items()} == {k: sorted(v) for k, v in seen.items()}


def test_tables_from_a_union(spark):
    """Cells that come from sides which are dealt by the table already are dealt once more: the adaptive run may merge the partitions
    of the sides in different ways, and then a table's cells were in several tasks (seen on 147,236 tables, not on few)."""
    from pyspark.sql import Window

    each = spark.range(80).select((F.col("id") % 10).alias("table_id"), "id").withColumn("nth", F.row_number().over(Window.partitionBy("table_id").orderBy("id")))
    cell = lambda row, col, text, coloured: F.struct(row.cast("long").alias("row"), F.lit(col).alias("col"), text.alias("text"), F.lit(1).alias("col_span"), F.lit(1).alias("row_span"), F.lit(coloured).alias("coloured"))
    heads = each.filter("nth = 1").select("table_id", F.inline(F.array(*[cell(F.lit(0), k, F.lit(t), True) for k, t in enumerate("ab")])))
    body = each.select("table_id", F.inline(F.array(cell(F.col("nth"), 0, F.col("id").cast("string"), False), cell(F.col("nth"), 1, F.lit("x"), False))))
    got = C.tables(heads.unionByName(body)).select("table_id", "nth", "content")
    assert "REPARTITION_BY_COL" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == sorted((t, k, f"a: {t + 10 * k}\nb: x") for t in range(10) for k in range(8))
