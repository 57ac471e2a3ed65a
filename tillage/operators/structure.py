"""Document structure: heading rules and stored schemas, body and appendix, open headings, segments, captions, title lines. Rules
are compiled on the driver; what depends on neighbours are windows of a document."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the marks of headings look like; {} stands for the letters that a rule allows.
MARKS = {
    "korean_letter_dot": "[{}]",
    "korean_letter_paren": r"[{}]\)",
    "roman": "(?:[{}]|[IVXLCDM]+)",
    "numeric_paren": r"[0-9]+\)",
    "circled_number": "[①-⑳]",
    "circled_korean": "[㉠-㉯]",
    "paren_numeric": r"\([0-9]+\)",
    "paren_korean": r"\([{}]\)",
}
LETTERS = {"korean_letter_dot": "가-히", "korean_letter_paren": "가-히", "paren_korean": "가-히", "roman": "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ"}
#: Kinds whose mark may end in a dot, and whether the dot may be left out where nothing is said.
DOTTED = {"numeric_dot": False, "korean_letter_dot": False, "roman": True}
#: Kinds whose headings divide a text and don't title it; the mark of a heading by kind, where it isn't the whole line.
DIVIDERS = ("symbol", "circled_number", "circled_korean", "paren_numeric", "paren_korean")
NOTATIONS = {
    "roman": r"^[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]\.?",
    "numeric_dot": r"^[0-9]+\.?",
    "korean_letter_dot": r"^[가-힣]\.?",
    "numeric_paren": r"^[0-9]+\)",
    "korean_letter_paren": r"^[가-힣]\)",
    "circled_number": "^[①-⑳]",
    "circled_korean": "^[㉮-㉻]",
    "paren_numeric": r"^\([0-9]+\)",
    "paren_korean": r"^\([가-힣]\)",
    "symbol": "^[○●□■◇◆❍⊙▪▫◦•·]",
    "legal_article": "^제[0-9]+조(?:의[0-9]+)?",
}
#: What makes a mark more than a symbol; what a heading has that says something itself; symbols that new headings
#: may begin with; words that title an appendix.
LETTERED, SAYING = "[0-9A-Za-z가-힣ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ①-⑳㉮-㉻]", r"[:：]|\b20[0-9]{2}\b|[0-9]{1,2}\.\s*[0-9]{1,2}\."
APPENDIX_WORDS = ("참고", "첨부")


@dataclass(frozen=True)
class Heading:
    """A rule: where its headings stand (depth, sector, in paragraphs, tables or both), and how they begin."""

    kind: str
    depth: int
    sector: str = "main"
    notation: str = ""
    options: dict = field(default_factory=dict)
    location: str = "paragraph"
    name: str = ""

    @property
    def symbolic(self) -> bool:
        """Whether the mark is a symbol only, with no letter or digit."""
        mark = re.sub(r"[\s,.\-_/|()]+", "", self.notation)
        return "symbol" in (self.kind, self.name) or bool(mark and not re.search(LETTERED, mark))

    @property
    def divides(self) -> bool:
        return self.kind in DIVIDERS


def rules_of(schema: str | dict, sector: str = "main") -> list[Heading]:
    """The rules of a stored schema: JSON with `levels`, each with depth, location, rule_id, rule_type, notation, rule_options or
    a pattern of its own. Levels that have neither a known type nor a pattern are left out; the rest goes by depth."""
    levels = (json.loads(schema) if isinstance(schema, str) else schema).get("levels") or []
    out = []
    for nth, level in enumerate((x for x in levels if isinstance(x, dict)), 1):
        kind, options = str(level.get("rule_type") or "").strip(), dict(level.get("rule_options") or {})
        options |= {"letters": options[k] for k in ("letter_range", "roman_range") if options.get(k)}
        place = str(level.get("location") or "").strip().lower()
        rule = Heading(kind, int(level.get("depth") or nth), sector, str(level.get("notation") or "").strip(), options, place if place in ("table", "both") else "paragraph", str(level.get("rule_id") or "").strip())
        if kind not in (*MARKS, *DOTTED, "legal_article", "symbol", "appendix_title_table"):
            if not isinstance(level.get("pattern"), str):
                continue
            rule = Heading("pattern", rule.depth, sector, rule.notation, options | {"pattern": level["pattern"]}, rule.location, rule.name)
        out.append(rule)
    return sorted(out, key=lambda r: r.depth)


def heading_pattern(rule: Heading) -> str:
    """The regular expression of a rule: leading space, mark, dot, and then a text with a letter or what else is asked for."""
    o = rule.options
    if rule.kind == "appendix_title_table":
        words = "|".join(re.escape(w.strip()) for w in o.get("keywords") or APPENDIX_WORDS if w.strip())
        number = r"\s*\d+\s*" if o.get("left_cell_number_required", True) else r"\s*"
        return rf"^\s*(?:{words}){number}(?:\||\s)\s*.{{{o.get('title_cell_min_length', 2)},}}$"

    def upto(n: int | None, free: str) -> str:
        return free if n is None else f"[ \\t]{{0,{n}}}"

    lead = upto(o.get("leading_space_max"), r"\s*" if o.get("allow_leading_space", True) else "")
    if rule.kind == "numeric_dot":
        mark = r"\.".join(["[0-9]+"] * max(1, o.get("segments", 1)))
    elif rule.kind == "legal_article":
        mark = "제[0-9]+조" + ("(?:의[0-9]+)?" if o.get("allow_sub_article", True) else "") + (r"(?:\s*\([^\)]+\))?" if o.get("allow_title_paren", True) else "")
    elif rule.kind == "symbol":
        mark = "[" + "".join(re.escape(c) for c in "".join(o.get("symbols", rule.notation))) + "]"
    elif rule.kind in MARKS:
        mark = MARKS[rule.kind].format(o.get("letters", LETTERS.get(rule.kind, "")))
    else:
        mark, lead = o["pattern"], ""
    if rule.kind in DOTTED:
        loose = DOTTED[rule.kind] or (rule.kind == "numeric_dot" and (o.get("allow_trailing_dot", True) if o.get("segments", 1) > 1 else o.get("allow_missing_terminal_dot", False)))
        said = o.get("trailing_dot")
        dot = said if said in ("required", "forbidden", "either") else "either" if " / " in rule.notation or loose else "required" if rule.notation.strip().endswith(".") else "forbidden"
        mark += {"required": r"\.", "either": r"\.?", "forbidden": ""}[dot]
    room = o.get("trailing_space_max")
    if o.get("require_text_after_marker", True):
        after = upto(room, r"\s*") + ".*[가-힣A-Za-z].*$"
    elif room is not None:
        after = upto(room, "") + "$"
    else:
        after = r"(?:\s+|$)" if o.get("require_space_or_eol", True) else ""
    return f"^{lead}{mark}{after}" if rule.kind != "pattern" else mark


def _first_rule(text: Column, rules: list[Heading], sector: Column | None = None, place: Column | None = None, rows: Column | None = None) -> Column:
    """The number of the first rule that a line fits; null for other lines. With a place ("paragraph" or "table"), rules for the
    other don't count; with the number of rows of its table, titles of appendices stand in tables of one row."""
    out: Column = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        fits = text.rlike(heading_pattern(rule))
        if sector is not None:
            fits = fits & (sector == rule.sector)
        if rule.kind == "appendix_title_table":
            fits = fits & (F.lit(False) if place is None else (place == "table"))
            if rows is not None and rule.options.get("single_row_table_only", True):
                fits = fits & F.coalesce(rows == 1, F.lit(True))
        elif place is not None and rule.location != "both":
            fits = fits & (place == rule.location)
        out = F.when(fits, k).otherwise(out)
    return out


def heading_depth(text: Column, rules: list[Heading], sector: Column | None = None) -> Column:
    """The depth of the first rule that a line fits (of its sector, if one is given); null for other lines."""
    return F.get(F.array(*[F.lit(r.depth) for r in rules]), _first_rule(text, rules, sector))


#: A heading as a value: its depth, whether it titles or divides, the kind of its rule, its mark and its line.
NODE = "struct<depth: int, kind: string, rule: string, notation: string, text: string>"


def heading_node(text: Column, rules: list[Heading], sector: Column | None = None, place: Column | None = None, rows: Column | None = None) -> Column:
    """The heading that a line is, by the first rule that it fits; null for other lines. Depth-1 headings of an appendix are titles."""
    line = F.trim(F.regexp_replace(text, r"[ \t]+", " "))
    which = F.get(F.array(*[F.struct(F.lit(r.depth).alias("depth"), F.lit("divider" if r.divides and not (r.sector == "appendix" and r.depth == 1) else "title").alias("kind"), F.lit(r.kind).alias("rule"), F.lit(NOTATIONS.get(r.kind, "")).alias("mark")) for r in rules]), _first_rule(text, rules, sector, place, rows))
    mark = F.when(which["mark"] != "", F.nullif(F.regexp_extract(line, "|".join(f"(?:{p})" for p in NOTATIONS.values()), 0), F.lit("")))
    return F.when(which.isNotNull(), F.struct(which["depth"].alias("depth"), which["kind"].alias("kind"), which["rule"].alias("rule"), F.coalesce(mark, line).alias("notation"), line.alias("text")))


def with_nodes(lines: DataFrame, keys: list[str], order: str, node: str, depths: list[int]) -> DataFrame:
    """lines with `nodes`: the headings that are open at each, itself included; a heading closes those as deep and deeper."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(F.col(order).alias("at"), F.col(node).alias("node"))
    depths = sorted(set(depths))
    seen = lines.withColumns({f"_d{d}": F.last(F.when(F.col(f"{node}.depth") == d, at), ignorenulls=True).over(w) for d in depths})
    closed = lambda d: F.greatest(*[F.col(f"_d{x}.at") for x in depths if x < d], F.lit(None), F.lit(None))
    open_ = [F.when(F.coalesce(F.col(f"_d{d}.at") > closed(d), F.lit(True)), F.col(f"_d{d}.node")) for d in depths]
    return seen.withColumn("nodes", F.array_compact(F.array(*open_))).drop(*[f"_d{d}" for d in depths])


def path_of(nodes: Column, content: Column) -> Column:
    """Open headings as a path for a text: titles whole; of those that divide the mark alone where deeper ones follow or the text
    has the heading itself."""
    flat = F.regexp_replace(content, r"\s+", " ")
    part = lambda n, i: F.when(n["kind"] == "title", n["text"]).when(F.contains(flat, n["text"]) | (i < F.size(nodes) - 1), n["notation"]).otherwise(n["text"])
    return F.array_join(F.filter(F.transform(nodes, part), lambda t: t != ""), " > ")


#: Symbols that a line may begin with as a heading, and the depth that each has if nothing is open before it.
SYMBOLS = {"○●□■▣◇◆❍⊙❑▪▫◦•·※▶▷": 2, "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳": 5, "㉮㉯㉰㉱㉲㉳㉴㉵㉶㉷㉸㉹㉺㉻": 6}


def preview(lines: DataFrame, text: str, rules: list[Heading], samples: int = 3, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """For each rule how many lines fit it first of all rules of its sector, and the first few of them as text: sector, rule, depth,
    notation, n, samples, action (keep, or drop for a rule that nothing fits; new, see below). The few are chosen in 64 parts first.

    With keys and order, lines that no rule fits but that begin with a symbol and have a letter are proposed as rules of their
    own: one for each symbol, one below the heading open before it, at the deepest place where it occurs, or at the depth that
    the symbol has by itself."""
    which = _first_rule(F.col(text), rules)
    hits = lines.select(which.alias("_rule"), F.col(text).alias("_text")).filter("_rule is not null")

    def few(found: DataFrame, key: str) -> DataFrame:
        part = found.select(key, "_text").distinct().withColumn("_part", F.pmod(F.xxhash64("_text"), F.lit(64)))
        chosen = part.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_part").orderBy("_text"))).filter(F.col("_n") <= samples)
        return chosen.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("_text")), 1, samples).alias("samples"))

    known = lines.sparkSession.createDataFrame([(k, r.sector, r.kind, r.depth, r.notation) for k, r in enumerate(rules)], "_rule int, sector string, rule string, depth int, notation string")
    counts = hits.groupBy("_rule").agg(F.count("*").alias("n")).join(few(hits, "_rule"), "_rule")
    out = known.join(counts, "_rule", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    out = out.withColumn("action", F.when(F.col("n") > 0, "keep").otherwise("drop")).drop("_rule")
    if keys is None:
        return out
    marks = "".join(SYMBOLS)
    begun = F.regexp_extract(text, rf"^\s*([{marks}])\s*.*[가-힣A-Za-z].*$", 1)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    above = F.last(heading_depth(F.col(text), rules), ignorenulls=True).over(w)
    own: Column = F.lit(2)
    for symbols, depth in SYMBOLS.items():
        own = F.when(F.contains(F.lit(symbols), begun), depth).otherwise(own)
    fresh = lines.select(which.alias("_rule"), begun.alias("notation"), above.alias("_above"), own.alias("_own"), F.col(text).alias("_text")).filter("_rule is null and notation <> ''")
    found = fresh.groupBy("notation").agg(F.max(F.coalesce(F.col("_above") + 1, F.col("_own"))).cast("int").alias("depth"), F.count("*").alias("n")).join(few(fresh, "notation"), "notation")
    return out.unionByName(found.select(F.lit("main").alias("sector"), F.lit("symbol").alias("rule"), "depth", "notation", "n", "samples", F.lit("new").alias("action")))


def leaving(rules: list[Heading], criteria: dict | None = None) -> list[Heading]:
    """The rules of the other side whose headings end this one, by stored criteria {"mode": "matched_heading", "match": {depth,
    rule_id, notation}}: all as deep at most, of this name and mark, where they are given. Criteria of another mode have none."""
    if criteria is None:
        return []
    match = criteria.get("match")
    if str(criteria.get("mode") or "").strip() != "matched_heading" or not isinstance(match, dict):
        return []
    deepest, name, mark = match.get("depth"), str(match.get("rule_id") or "").strip(), str(match.get("notation") or "").strip()
    return [r for r in rules if (deepest is None or r.depth <= int(deepest)) and name in ("", r.name) and mark in ("", r.notation)]


def sides(text: Column, main: list[Heading], appendix: list[Heading], body_exit: dict | None = None, appendix_exit: dict | None = None, place: Column | None = None, rows: Column | None = None) -> tuple[Column, Column]:
    """Whether a line enters the appendix and whether it leaves it, for with_sector(). It enters by a rule of the body's exit, or as
    a heading of depth 1 of the appendix. It leaves as a heading of depth 1 or 2 of the body, or by a rule of the appendix's exit;
    marks that are symbols never lead back."""
    fits = lambda rules: _first_rule(text, rules, None, place, rows).isNotNull() if rules else F.lit(False)
    first = lambda rules: F.get(F.array(*[F.struct(F.lit(r.depth).alias("d"), F.lit(r.symbolic).alias("s")) for r in rules]), _first_rule(text, rules, None, place, rows)) if rules else F.lit(None).cast("struct<d: int, s: boolean>")
    enters = fits(leaving(appendix, body_exit)) | F.coalesce(first(appendix)["d"] == 1, F.lit(False))
    back = [r for r in main if r.depth <= 2] if appendix_exit is None else leaving(main, appendix_exit)
    met = first(main)
    return enters, fits([r for r in back if not r.symbolic]) | F.coalesce((met["d"] <= 2) & ~met["s"], F.lit(False))


def with_sector(lines: DataFrame, keys: list[str], order: str, enters: Column, leaves: Column) -> DataFrame:
    """lines with `sector`: main until a line enters the appendix, appendix until one leaves it, that line included. A line that
    does both changes sides: so the side follows from the last line that did one only and the number of changes since."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    into, back = F.coalesce(enters, F.lit(False)), F.coalesce(leaves, F.lit(False))
    marked = lines.withColumns({"_both": (into & back).cast("int"), "_side": F.when(into & ~back, 1).when(back & ~into, 0)})
    turned = marked.withColumn("_turns", F.sum("_both").over(w))
    last = F.last(F.when(F.col("_side").isNotNull(), F.struct("_side", "_turns")), ignorenulls=True).over(w)
    known = turned.withColumn("_last", last)
    side = (F.coalesce("_last._side", F.lit(0)) + F.col("_turns") - F.coalesce("_last._turns", F.lit(0))) % 2
    return known.withColumn("sector", F.when(side == 1, "appendix").otherwise("main")).drop("_both", "_side", "_turns", "_last")


TEXT_BLOCKS = ("paragraph", "heading-inline")


def segments(lines: DataFrame, keys: list[str], order: str, text: str, node: str, kind: str, pending: int | None = 1, whole_path: bool = False) -> DataFrame:
    """The segments of lines (with `sector`; node null for body lines), as `block` and `content`.

    heading-inline: headings that say something themselves, and those that divide with a text. heading-line: a heading of depth
    1 on which body or a deeper heading follows in its sector, alone. Else the line's own kind: body lines, led by the headings
    that wait for them in their sector: the last of those since the sector's last body (`pending`; None: all of them), unless it
    stands alone; tables aren't led. With whole_path (lines with `nodes`), the first body after a heading is led by all headings
    that are open, and none stands alone. A paragraph whose text the table right after it has is left out."""
    own, at = [*keys, "sector"], F.col(f"{node}.depth")
    w = Window.partitionBy(*own).orderBy(order)
    rest = F.regexp_replace(F.col(f"{node}.text"), "|".join(f"(?:{NOTATIONS[k]})" for k in DIVIDERS), "")
    says = at.isNotNull() & (F.col(text).rlike(SAYING) | ((F.col(f"{node}.kind") == "divider") & rest.rlike("[가-힣A-Za-z0-9]")))
    seen = lines.withColumn("_says", F.coalesce(says, F.lit(False)))
    seen = seen.withColumn("_run", F.coalesce(F.sum((at.isNull() | F.col("_says")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    waiting = F.collect_list(F.when(at.isNotNull() & ~F.col("_says"), F.col(node))).over(Window.partitionBy(*own, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumns({"_led": waiting, "_next": F.lead(F.struct(at.alias("d"), F.lit(1).alias("there"))).over(w)})
    led = F.col("_led") if pending is None else F.slice("_led", F.greatest(F.size("_led") - (pending - 1), F.lit(1)), pending)
    above = F.transform(F.filter(led, lambda n: n["depth"] > 1), lambda n: n["text"])
    if whole_path:
        above = F.when(F.size("_led") > 0, F.transform("nodes", lambda n: n["text"]))
    alone = F.lit(not whole_path) & (at == 1) & ~F.col("_says") & F.col("_next").isNotNull() & (F.col("_next.d").isNull() | (F.col("_next.d") > 1))
    block = F.when(F.col("_says"), "heading-inline").when(F.coalesce(alone, F.lit(False)), "heading-line").when(at.isNull(), F.col(kind))
    content = F.when(at.isNull() & ~F.startswith(F.col(kind), F.lit("table")), F.concat_ws("\n", F.coalesce(above, F.array().cast("array<string>")), text)).otherwise(F.col(text))
    made = seen.withColumns({"block": block, "content": content}).filter("block is not null").drop("_says", "_run", "_led", "_next")
    flat = F.trim(F.regexp_replace("content", r"\s+", " "))
    after = F.lead(F.struct("block", flat.alias("flat"))).over(Window.partitionBy(*keys).orderBy(order))
    twice = (F.col("block") == "paragraph") & (F.col("_after.block") == "table") & (F.col("_after.flat") == flat) & (flat != "")
    return made.withColumn("_after", after).filter(~F.coalesce(twice, F.lit(False))).drop("_after")


_CAPTION = r"(?m)^\s*([《<〈「『].+[》>〉」』])\s*$"


def _with_targets(parts: DataFrame, keys: list[str], order: str, path: str, block: str, content: str, own: str | None = None) -> DataFrame:
    """parts with `_captions` (the caption lines of a segment), `_target` (the first row, by order, of the run of table segments that
    they belong to: the next under the same heading with nothing but text between, else the last before) and `_place`. A table of a
    single row may be the box of a caption; other captions don't look past it. A segment with a caption of its `own` keeps its lines."""
    w = Window.partitionBy(*keys).orderBy(order)
    family = F.when(F.col(block).isin("table", "table-row"), "table").when(F.col(block).isin(*TEXT_BLOCKS), "text").otherwise("other")
    known = parts.withColumns({"_family": family, "_path": F.coalesce(path, F.lit(""))})
    known = known.withColumn("_new", F.coalesce((F.lag("_path").over(w) != F.col("_path")) | (F.lag("_family").over(w) == "other") | (F.col("_family") == "other"), F.lit(True)).cast("int"))
    run = known.withColumn("_run", F.sum("_new").over(w))
    inner = Window.partitionBy(*keys, "_run").orderBy(order)
    first = (F.col("_family") == "table") & F.coalesce(F.lag("_family").over(inner) != "table", F.lit(True))
    starts = run.withColumn("_start", F.when(first, F.col(order)))
    starts = starts.withColumn("_table", F.when(F.col("_family") == "table", F.last("_start", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0))))
    after = F.first("_table", ignorenulls=True).over(inner.rowsBetween(1, Window.unboundedFollowing))
    before = F.last("_table", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    # A box is a run of its own, so its tables are those of the runs beside it, if they are under its heading.
    every = inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = starts.withColumn("_beside", F.struct("_path", F.first("_table", ignorenulls=True).over(every).alias("first"), F.last("_table", ignorenulls=True).over(every).alias("last")))
    found = starts.withColumns({"_captions": F.regexp_extract_all(content, F.lit(_CAPTION), 1), "_after": after, "_before": before, "_ahead": F.lead("_beside").over(w), "_behind": F.lag("_beside").over(w)})
    box = F.col(block) == "table-single-row"
    sides = {"_after": F.when(F.col("_ahead._path") == F.col("_path"), F.col("_ahead.first")), "_before": F.when(F.col("_behind._path") == F.col("_path"), F.col("_behind.last"))}
    found = found.withColumns({c: F.when(box, v).otherwise(F.col(c)) for c, v in sides.items()}).drop("_beside", "_ahead", "_behind")
    settled = F.coalesce(F.col(own) != "", F.lit(False)) if own else F.lit(False)
    bears = (F.size("_captions") > 0) & ((F.col("_family") != "other") | F.coalesce(box, F.lit(False))) & ~settled
    target = F.when(bears, F.coalesce("_after", "_before"))
    place = F.when(target.isNotNull(), F.when(F.col("_after").isNotNull(), "before-table").otherwise("after-table"))
    return found.withColumns({"_target": target, "_place": place}).drop("_family", "_path", "_new", "_run", "_start", "_table", "_after", "_before")


def captions(parts: DataFrame, keys: list[str], order: str, path: str, block: str, content: str) -> DataFrame:
    """For each segment with caption lines that have a table: `captions`, `target` and `place` (see with_captions)."""
    found = _with_targets(parts, keys, order, path, block, content).filter("_target is not null")
    return found.select(*keys, order, F.col("_captions").alias("captions"), F.col("_target").alias("target"), F.col("_place").alias("place"))


def with_captions(parts: DataFrame, keys: list[str], order: str, path: str, block: str, content: str, own: str | None = None) -> DataFrame:
    """parts with caption lines taken out of their texts and put on the first segment of their table, above its content unless that has
    them, and as `caption` and `caption_place` (of several the last). Segments that are left without a text go. With `own`, a column
    with the captions that tables bring with them, these stay where they are."""
    found = _with_targets(parts, keys, order, path, block, content, own)
    # Each segment at its own place, and once more, as a message, at the place that its captions go to.
    twice = F.array(F.struct(F.col(order).alias("at"), F.lit(False).alias("sent")), F.struct(F.col("_target").alias("at"), F.lit(True).alias("sent")))
    meeting = found.withColumn("_m", F.explode(twice)).filter("_m.at is not null")
    mine = F.when(F.col("_m.sent"), F.struct(F.col(order).alias("o"), F.col("_captions").alias("c"), F.col("_place").alias("p")))
    got = F.sort_array(F.collect_list(mine).over(Window.partitionBy(*keys, "_m.at")))
    left = F.trim(F.regexp_replace(F.regexp_replace(content, _CAPTION, ""), r"\n{2,}", "\n"), F.lit(" \n"))
    out = meeting.withColumns({"_got": got, "_text": F.when(F.col("_target").isNotNull(), left).otherwise(F.col(content))}).filter("not _m.sent")
    told = F.flatten(F.transform("_got", lambda g: g["c"]))
    whole = F.aggregate(told, F.col("_text"), lambda s, c: F.when(F.contains(s, c), s).otherwise(F.concat_ws("\n", c, F.nullif(s, F.lit("")))))
    last = F.when(F.size("_got") > 0, F.element_at("_got", -1))
    caption = F.when(F.size(told) > 0, F.element_at(told, -1))
    out = out.withColumns({content: whole, "caption": caption, "caption_place": last["p"]})
    return out.filter(F.length(F.trim(content)) > 0).drop("_captions", "_target", "_place", "_m", "_got", "_text")


def new_titles(chunks: DataFrame, keys: list[str], order: str, titles: str) -> DataFrame:
    """chunks with `lines`: where a path of titles (outermost first) comes up for the first time within its keys, those of them
    that differ from the path that came up before it; nothing elsewhere."""
    filled = chunks.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, titles).orderBy(order)))
    first = (F.col("_nth") == 1) & (F.size(titles) > 0)
    before = F.last(F.when(first, F.col(titles)), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    fresh = filled.withColumns({"_first": first, "_before": before})
    changed = F.filter(titles, lambda t, i: ~F.coalesce(F.get("_before", i) == t, F.lit(False)))
    return fresh.withColumn("lines", F.when(F.col("_first"), changed).otherwise(F.array().cast("array<string>"))).drop("_nth", "_first", "_before")
