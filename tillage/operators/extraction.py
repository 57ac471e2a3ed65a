"""Figures, codes, aliases and headings drawn from texts, as functions of columns."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .relational import dimension

#: Words of a forecast text, in the order in which they are tried, and their codes.
RAIN_WORDS = [("2", ["비/눈", "진눈깨비"]), ("1", ["비"]), ("3", ["눈"]), ("4", ["소나기"])]
SKY_WORDS = [("4", ["흐림", "흐리고"]), ("3", ["구름많"])]


def first_word(text: Column, rules: list[tuple[str, list[str]]], default: str | None) -> Column:
    """The label of the first rule that has a word in the text."""
    out = F.lit(default)
    for label, words in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), label).otherwise(out)
    return out


def first_number(text: Column, patterns: list[str]) -> Column:
    """The number that the first pattern with a positive one finds in its first group; null where none does."""
    found = [F.regexp_extract(text, p, 1).try_cast("int") for p in patterns]
    return F.coalesce(*[F.when(n > 0, n) for n in found])


def capped_end(start: Column, end: Column, days: Column) -> Column:
    """The end of a span of at most so many days; unchanged where there is no limit or no start."""
    return F.when(days.isNull() | start.isNull(), end).otherwise(F.least(F.coalesce(end, F.date_add(start, days)), F.date_add(start, days)))


def has_alias(text: Column, alias: str, negations: list[str]) -> Column:
    """Whether a text names an alias and doesn't exclude it. White space doesn't count, but an alias of one character must
    stand alone. Each negation is a pattern with {} for the alias."""
    word = re.escape(alias)
    if len(alias) == 1:
        named = text.rlike(f"(^|[^0-9A-Za-z]){word}([^0-9A-Za-z]|$)")
    else:
        named = F.contains(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", ""), F.lit(re.sub(r"\s", "", alias.lower())))
    return named & ~reduce(lambda a, b: a | b, [text.rlike(n.format(word)) for n in negations])


def repaired(text: Column, literals: list[tuple[str, str]], patterns: list[tuple[str, str]]) -> Column:
    """A text after literal and then pattern replacements, in order."""
    out = reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), literals, text)
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), patterns, out)


def heading_likeness(a: Column, b: Column) -> Column:
    """3 for equal headings, 2 where one begins with the other, 1 for the same parent, else 0."""
    parent = lambda h: F.trim(F.regexp_replace(h, r"^(.*) > .*$", "$1"))
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, 0).when(a == b, 3).when(F.startswith(a, b) | F.startswith(b, a), 2).when((parent(a) != "") & (parent(a) == parent(b)), 1).otherwise(0)


def with_heading_path(df: DataFrame, keys: list[str], order: str, depth: str, title: str, levels: int) -> DataFrame:
    """df with `path`: the open headings at each row, outermost first. A heading closes those as deep or deeper; rows
    without a depth are body. One window; for each level the last heading of it that no higher one has closed."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = [F.last(F.when(F.col(depth) <= d, F.when(F.col(depth) == d, F.col(title)).otherwise("")), ignorenulls=True).over(w) for d in range(1, levels + 1)]
    return df.withColumn("path", F.concat_ws(" > ", *[F.nullif(a, F.lit("")) for a in at]))


def with_captions(df: DataFrame, keys: list[str], order: str, cluster: str, caption: str) -> DataFrame:
    """df with the caption carried along each run of rows of the same cluster."""
    w = Window.partitionBy(*keys).orderBy(order)
    turned = F.coalesce((F.lag(cluster).over(w) != F.col(cluster)).cast("int"), F.lit(1))
    islands = df.withColumn("_run", F.sum(turned).over(w))
    upto = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn(caption, F.last(caption, ignorenulls=True).over(upto)).drop("_run")


def without_echo(df: DataFrame, keys: list[str], order: str, kind: str, text: str) -> DataFrame:
    """df without the paragraphs that the table after them repeats."""
    w = Window.partitionBy(*keys).orderBy(order)
    flat = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    marked = df.withColumns({"_flat": flat}).withColumns({"_next": F.lead("_flat").over(w), "_kind": F.lead(kind).over(w)})
    echo = (F.col(kind) == "paragraph") & (F.col("_kind") == "table") & (F.col("_flat") == F.col("_next")) & (F.col("_flat") != "")
    return marked.filter(~F.coalesce(echo, F.lit(False))).drop("_flat", "_next", "_kind")


#: The weights of what two names have in common.
LIKENESS = {"blocks": 0.72, "words": 0.28, "inside": 0.12}


def likeness(a: str, b: str) -> float:
    """The weighted sum of the matching-blocks ratio of the texts without white space, the Jaccard index of their words, and
    whether one contains the other; at most 1, which equal texts have, and 0 for empty ones."""
    flat = ["".join((x or "").lower().split()) for x in (a, b)]
    if not all(flat):
        return 0.0
    words = [set((x or "").lower().split()) for x in (a, b)]
    shares = {
        "blocks": SequenceMatcher(None, *flat).ratio(),
        "words": len(set.intersection(*words)) / max(1, len(set.union(*words))),
        "inside": any(x in y for x, y in (flat, flat[::-1])),
    }
    return 1.0 if flat[0] == flat[1] else min(1.0, sum(LIKENESS[k] * v for k, v in shares.items()))


def best_match(names: DataFrame, column: str, choices: list[str], least: float = 0.46) -> DataFrame:
    """The distinct values of a column with the choice (of a short list) that is most like each, and its score; values that
    are like none stay, with null. Ties go to the earlier choice."""

    @F.pandas_udf("struct<choice:string,score:double>")
    def pick(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            scored = [(likeness(v, c), -i) for i, c in enumerate(choices)]
            score, at = max(scored, default=(0.0, 0))
            rows.append((choices[-at], round(score, 6)) if score >= least else (None, None))
        return pd.DataFrame(rows, columns=["choice", "score"])

    return names.select(column).distinct().withColumn("_m", pick(column)).select(column, "_m.choice", "_m.score")


#: The code pages that garbled texts were written in, in the order in which they are tried, and the letters that
#: show that one fits.
CODE_PAGES, LETTERS = ("cp949", "utf-8", "shift_jis", "gb18030"), "[가-힣]"


def decoded(text: str | None, pages: tuple[str, ...] = CODE_PAGES, letters: str = LETTERS) -> str | None:
    """A text whose bytes were read as Latin-1, read by the first code page that gives such letters; others stay as they are."""
    if not text or re.search(letters, text) or not re.search("[\x80-\xff]", text):
        return text
    for page in pages:
        try:
            fixed = text.encode("latin-1").decode(page)
        except UnicodeError:
            continue
        if re.search(letters, fixed):
            return fixed
    return text


def encoding_repaired(df: DataFrame, column: str, pages: tuple[str, ...] = CODE_PAGES, letters: str = LETTERS) -> DataFrame:
    """df with garbled texts of a column put right: only distinct texts with bytes beyond ASCII go through Python."""

    @F.pandas_udf(StringType())
    def fixed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: decoded(t, pages, letters))

    odd = df.select(column).filter(F.col(column).rlike("[\\x80-\\xff]")).distinct()
    known = odd.withColumn("_fixed", fixed(column))
    return df.join(known, column, "left").withColumn(column, F.coalesce("_fixed", column)).select(df.columns)


def first_alias(texts: DataFrame, text: str, places: DataFrame, most: int = 10_000) -> Column:
    """The place of the first alias (by prio, then place) that a text has, of a dimension (place, alias, prio) of at most so many
    aliases; null without."""
    own = F.struct("prio", "place", F.lower("alias").alias("alias"))
    known = dimension(places.filter("alias <> ''").select(own.alias("a")), "a", most)
    every = F.array(*[F.struct(F.lit(r["place"]).alias("place"), F.lit(r["alias"]).alias("alias")) for r in known]) if known else F.array().cast("array<struct<place: string, alias: string>>")
    return F.get(F.filter(every, lambda a: F.contains(F.lower(F.col(text)), a["alias"])), F.lit(0))["place"]
