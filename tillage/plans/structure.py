"""Document structure over lines made from conversations: turns as headings, table rows, captions and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import passages as P
from ..operators import structure as S
from ..operators.structure import Heading
from ..sources.tables import table
from .registry import query

RULES = [
    Heading("roman", 1, notation="Ⅰ."),
    Heading("numeric_dot", 2, notation="1."),
    Heading("symbol", 2, notation="■", options={"symbols": "■"}),
    Heading("paren_numeric", 3, notation="(1)"),
    Heading("numeric_paren", 1, "appendix", notation="1)"),
    Heading("circled_number", 2, "appendix", notation="①"),
]
MAIN, APPENDIX = [r for r in RULES if r.sector == "main"], [r for r in RULES if r.sector == "appendix"]
#: As they are stored: what ends the body, and what ends an appendix.
BODY_EXIT, APPENDIX_EXIT = {"mode": "matched_heading", "match": {"depth": 1}}, {"mode": "matched_heading", "match": {"depth": 2}}
_REGEX = {r.kind: S.heading_pattern(r).replace("'", "''") for r in RULES}

_LINES = """SELECT conv_id, turn, CASE k WHEN 0 THEN 'Ⅱ. Part ' || turn WHEN 1 THEN turn || '. Section ' || role WHEN 2 THEN '(' || turn || ') point: ' || role WHEN 3 THEN turn || ') annex ' || role WHEN 4 THEN '<Table ' || turn || '>' WHEN 5 THEN '| ' || turn || ' | ' || role || ' |' WHEN 6 THEN '| x | ' || role || ' |'
WHEN 7 THEN CASE WHEN conv_id % 2 = 0 THEN '■ item ' ELSE '▶ remark ' END || role ELSE text END AS line, CASE WHEN k IN (5, 6) THEN 'table-row' ELSE 'paragraph' END AS kind FROM (SELECT conv_id, turn, role, text, (turn * 7 + conv_id) % 9 AS k FROM conversations)"""


def lines(spark, sf_dir):
    """Turns as the lines of documents: headings of three depths, those of appendices, captions, table rows, marks that a rule knows
    and marks that none does, and texts."""
    c = table(spark, sf_dir, "conversations")
    k, n = (F.col("turn") * 7 + F.col("conv_id")) % 9, F.col("turn").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("Ⅱ. Part "), n)).when(k == 1, F.concat(n, F.lit(". Section "), "role")).when(k == 2, F.concat(F.lit("("), n, F.lit(") point: "), "role")).when(k == 3, F.concat(n, F.lit(") annex "), "role"))
        .when(k == 4, F.concat(F.lit("<Table "), n, F.lit(">"))).when(k == 5, F.concat(F.lit("| "), n, F.lit(" | "), "role", F.lit(" |"))).when(k == 6, F.concat(F.lit("| x | "), "role", F.lit(" |")))
        .when(k == 7, F.concat(F.when(F.col("conv_id") % 2 == 0, "■ item ").otherwise("▶ remark "), "role")).otherwise(F.col("text"))
    )
    return c.select("conv_id", "turn", text.alias("line"), F.when(k.isin(5, 6), "table-row").otherwise("paragraph").alias("kind"))


def _case(of, rules=RULES) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(line, '{_REGEX[r.kind]}') THEN {of(r)}" for r in rules) + " END"


_DEPTH = _case(lambda r: r.depth)


@query(f"SELECT conv_id, turn, {_DEPTH} AS depth FROM ({_LINES})")
def d1_heading_rules(spark, sf_dir):
    """The depth of each line by the first of the rules that it fits."""
    return lines(spark, sf_dir).select("conv_id", "turn", S.heading_depth(F.col("line"), RULES).alias("depth"))


@query(f"""WITH h AS (SELECT *, {_case(RULES.index)} AS r, {_DEPTH} AS depth FROM ({_LINES})), rules(r, sector, rule, depth, notation) AS (VALUES {", ".join(f"({k}, '{r.sector}', '{r.kind}', {r.depth}, '{r.notation}')" for k, r in enumerate(RULES))}),
n AS (SELECT *, last_value(depth IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, regexp_extract(line, '^\\s*([○●□■▣◇◆❍⊙❑▪▫◦•·※▶▷])\\s*.*[가-힣A-Za-z].*$', 1) AS mark FROM h),
few AS (SELECT r, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT line)), 1, 3), '; ') AS samples FROM h WHERE r IS NOT NULL GROUP BY 1)
SELECT sector, rule, depth, notation, coalesce(n, 0) AS n, coalesce(samples, '') AS samples, CASE WHEN n > 0 THEN 'keep' ELSE 'drop' END AS action FROM rules LEFT JOIN few USING (r)
UNION ALL SELECT 'main', 'symbol', max(coalesce(above + 1, 2)), mark, count(*), array_to_string(list_slice(list_sort(list(DISTINCT line)), 1, 3), '; '), 'new' FROM n WHERE r IS NULL AND mark <> '' GROUP BY mark""")
def z15_heading_preview(spark, sf_dir):
    """How many lines each rule finds, and the first three; marks that no rule knows, as new rules."""
    p = S.preview(lines(spark, sf_dir), "line", RULES, keys=["conv_id"], order="turn")
    return p.select("sector", "rule", "depth", "notation", "n", F.array_join("samples", "; ").alias("samples"), "action")


_SECTOR = f"""WITH m AS (SELECT *, regexp_matches(line, '{_REGEX["numeric_paren"]}') AS enters, regexp_matches(line, '{_REGEX["roman"]}') OR regexp_matches(line, '{_REGEX["numeric_dot"]}') AS leaves FROM ({_LINES})),
s AS (SELECT *, CASE WHEN coalesce(last_value(CASE WHEN enters THEN 1 WHEN leaves THEN 0 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), 0) = 1 THEN 'appendix' ELSE 'main' END AS sector FROM m)"""


def sectors(spark, sf_dir):
    """The lines with their sector, by criteria as they are stored: an appendix heading of depth 1 enters, a main heading of depth 1 or
    2 leaves, but for symbols, which never lead back."""
    enters, leaves = S.sides(F.col("line"), MAIN, APPENDIX, BODY_EXIT, APPENDIX_EXIT)
    return S.with_sector(lines(spark, sf_dir), ["conv_id"], "turn", enters, leaves)


@query(f"{_SECTOR} SELECT conv_id, turn, sector FROM s")
def d3_sectors(spark, sf_dir):
    return sectors(spark, sf_dir).select("conv_id", "turn", "sector")


_SEGMENTS = f"""{_SECTOR}, d AS (SELECT *, CASE WHEN sector = 'appendix' THEN {_case(lambda r: r.depth, APPENDIX)} ELSE {_case(lambda r: r.depth, MAIN)} END AS depth FROM s),
y AS (SELECT *, depth IS NOT NULL AND (regexp_matches(line, '[:：]|\\b20[0-9]{{2}}\\b|[0-9]{{1,2}}\\.\\s*[0-9]{{1,2}}\\.') OR (sector = 'main' AND regexp_matches(line, '{_REGEX["symbol"]}'))) AS says FROM d),
n AS (SELECT *, lag(CASE WHEN NOT says THEN depth END) OVER w AS bd, lag(line) OVER w AS bt, lead(depth) OVER w AS ad, lead(1) OVER w AS there FROM y WINDOW w AS (PARTITION BY conv_id, sector ORDER BY turn)),
g AS (SELECT *, CASE WHEN says THEN 'heading-inline' WHEN depth = 1 AND there = 1 AND (ad IS NULL OR ad > 1) THEN 'heading-line' WHEN depth IS NULL THEN kind END AS block, CASE WHEN depth IS NULL AND bd > 1 AND kind = 'paragraph' THEN bt || coalesce(chr(10) || line, '') ELSE line END AS content FROM n)"""


def parts(spark, sf_dir):
    """The segments of the lines, with the headings that are open at each."""
    known = sectors(spark, sf_dir).withColumn("node", S.heading_node(F.col("line"), RULES, F.col("sector")))
    known = S.with_nodes(known, ["conv_id", "sector"], "turn", "node", [r.depth for r in RULES])
    return S.segments(known, ["conv_id"], "turn", "line", "node", "kind")


@query(f"{_SEGMENTS} SELECT conv_id, turn, sector, block, content FROM g WHERE block IS NOT NULL")
def d19_segments(spark, sf_dir):
    """Headings that say something, headings of depth 1 alone, body lines with the heading that waits for them."""
    return parts(spark, sf_dir).select("conv_id", "turn", "sector", "block", "content")


_MARKED = r"(?m)^\s*([《<〈「『].+[》>〉」』])\s*$"


@query(f"""{_SEGMENTS}, f AS (SELECT conv_id, turn, block, sector AS path, content, CASE WHEN block LIKE 'table%' THEN 'table' WHEN block IN ('paragraph', 'heading-inline') THEN 'text' ELSE 'other' END AS family FROM g WHERE block IS NOT NULL),
r AS (SELECT *, sum(CASE WHEN coalesce(lag_path <> path OR lag_family = 'other' OR family = 'other', true) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY turn) AS lag_path, lag(family) OVER (PARTITION BY conv_id ORDER BY turn) AS lag_family FROM f)),
t AS (SELECT *, CASE WHEN family = 'table' THEN last_value(CASE WHEN family = 'table' AND coalesce(lf, '') <> 'table' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id, run ORDER BY turn) END AS tab FROM (SELECT *, lag(family) OVER (PARTITION BY conv_id, run ORDER BY turn) AS lf FROM r)),
k AS (SELECT *, regexp_extract_all(content, '{_MARKED}', 1) AS caps, CASE WHEN family <> 'other' AND len(regexp_extract_all(content, '{_MARKED}', 1)) > 0 THEN (SELECT min(tab) FROM t n WHERE n.conv_id = c.conv_id AND n.run = c.run AND n.turn > c.turn) END AS later,
CASE WHEN family <> 'other' AND len(regexp_extract_all(content, '{_MARKED}', 1)) > 0 THEN (SELECT max(tab) FROM t b WHERE b.conv_id = c.conv_id AND b.run = c.run AND b.turn < c.turn) END AS earlier FROM t c),
to_ AS (SELECT conv_id, coalesce(later, earlier) AS turn, turn AS o, unnest(caps) AS cap, CASE WHEN later IS NOT NULL THEN 'before-table' ELSE 'after-table' END AS place FROM k WHERE coalesce(later, earlier) IS NOT NULL),
got AS (SELECT conv_id, turn, string_agg(cap, chr(10) ORDER BY o DESC) AS caps, arg_max(cap, o) AS caption, arg_max(place, o) AS place FROM to_ GROUP BY 1, 2),
z AS (SELECT k.conv_id, k.turn, block, CASE WHEN coalesce(later, earlier) IS NOT NULL THEN trim(regexp_replace(regexp_replace(content, '{_MARKED}', '', 'g'), '\n{{2,}}', chr(10), 'g'), ' ' || chr(10)) ELSE content END AS rest, got.caps, caption, place AS caption_place FROM k LEFT JOIN got ON got.conv_id = k.conv_id AND got.turn = k.turn)
SELECT conv_id, turn, block, coalesce(caps || chr(10), '') || rest AS content, caption, caption_place FROM z WHERE trim(coalesce(caps, '') || rest) <> ''""")
def d18_captions(spark, sf_dir):
    """The segments with their captions on their tables and nowhere else; here the sector stands for the heading."""
    own = S.with_captions(parts(spark, sf_dir), ["conv_id"], "turn", "sector", "block", "content")
    return own.select("conv_id", "turn", "block", "content", "caption", "caption_place")


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'A' ELSE 'B' END AS t1, CASE WHEN turn % 3 = 0 THEN 'x' ELSE 'y' END AS t2 FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, t1, t2 ORDER BY turn) = 1 AS fresh FROM c),
p AS (SELECT *, last_value(CASE WHEN fresh THEN t1 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p1, last_value(CASE WHEN fresh THEN t2 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p2 FROM f)
SELECT conv_id, turn, CASE WHEN fresh THEN concat_ws(' / ', CASE WHEN t1 IS DISTINCT FROM p1 THEN t1 END, CASE WHEN t2 IS DISTINCT FROM p2 THEN t2 END) ELSE '' END AS lines FROM p""")
def n10_new_titles(spark, sf_dir):
    """The titles that a chunk shows: only those that haven't been seen right before."""
    titles = F.array(F.when(F.col("turn") % 4 == 0, "A").otherwise("B"), F.when(F.col("turn") % 3 == 0, "x").otherwise("y"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", titles.alias("titles"))
    return S.new_titles(c, ["conv_id"], "turn", "titles").select("conv_id", "turn", F.array_join("lines", " / ").alias("lines"))


def cells(spark, sf_dir):
    """Every order's lines as a table: a coloured header row whose last header spans two columns, and a column of arrows; each flag
    spans the rows of two lines, those of the first of them; a coloured total beside its value ends the table."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag").distinct()
    li = li.withColumn("nth", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")))
    li = li.withColumn("all", F.count("*").over(Window.partitionBy("l_orderkey")))
    cell = lambda row, col, text, wide=1, coloured=False, high=F.lit(1): F.struct(row.cast("long").alias("row"), F.lit(col).alias("col"), text.alias("text"), F.lit(wide).alias("col_span"), high.cast("int").alias("row_span"), F.lit(coloured).alias("coloured"))
    zero, n, last = F.lit(0), F.col("nth"), F.col("all") + 1
    head = F.array(cell(zero, 0, F.lit("flag"), coloured=True), cell(zero, 1, F.lit("→"), coloured=True), cell(zero, 2, F.lit("part"), 2, coloured=True))
    own = F.array(cell(n, 1, F.lit("")), cell(n, 2, F.col("l_partkey").cast("string")), cell(n, 3, F.col("l_quantity").cast("int").cast("string")))
    flag = F.array(cell(n, 0, F.col("l_returnflag"), high=F.when(n < F.col("all"), 2).otherwise(1)))
    foot = F.array(cell(last, 0, F.lit("lines"), coloured=True), cell(last, 1, F.lit("")), cell(last, 2, F.col("all").cast("string")), cell(last, 3, F.lit("in all")))
    # In one pass: the first line brings the header row, the last one the total.
    parts = [F.when(n == 1, head), F.when(n % 2 == 1, flag), own, F.when(n == F.col("all"), foot)]
    return li.select(F.col("l_orderkey").alias("table_id"), F.inline(F.concat(*[F.coalesce(p, F.slice(own, 1, 0)) for p in parts])))


@query("""WITH l AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag)),
f AS (SELECT *, CASE WHEN nth % 2 = 1 THEN l_returnflag ELSE lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY nth) END AS flag FROM l)
SELECT l_orderkey AS table_id, CAST(nth - 1 AS INT) AS nth, 'data-row' AS role, 'flag: ' || flag || chr(10) || 'part: ' || l_partkey || ' | ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) AS content FROM f
UNION ALL SELECT l_orderkey, CAST(n AS INT), 'header-value-row', 'lines: ' || n || ', in all' FROM l WHERE nth = 1""")
def d4_tables(spark, sf_dir):
    """Tables of cells with spans in both directions as lines of "header: value", and of pairs."""
    return C.tables(cells(spark, sf_dir)).select("table_id", "nth", "role", "content")


def segments(spark, sf_dir):
    """The segments of the lines as the chunk builder takes them."""
    p = parts(spark, sf_dir).withColumn("path", S.path_of(F.col("nodes"), F.col("content")))
    p = S.with_captions(p, ["conv_id"], "turn", "path", "block", "content")
    header = F.when(F.col("block") == "table-row", F.array(F.lit("No."), F.lit("Role")))
    return p.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("at"), "sector", "block", "content", "path", "nodes", header.alias("header"), "caption", "caption_place")


@query()
def d8_chunks(spark, sf_dir):
    """Whole documents as chunks: segments merged by their headings, table rows joined, long ones split, paths and titles."""
    return P.chunks(segments(spark, sf_dir)).drop("header")
