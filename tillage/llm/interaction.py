"""Filter interaction audit: long-form window evaluation of filters applied in every order.

Each document becomes a mask of the filters that it fails; documents of one part and mask are one cell. The cells are unpivoted
against the steps of every order, a running bit-or over the steps before says which failed earlier, and conditional sums and a
total over the window of a filter give the figures. Everything is DataFrame expressions; what is shuffled by document are an id,
a digest and a mask, never a text.

Null texts and langs are empty strings. Every row is a document, repeated rows too. A row without an id comes after every id
and before none, so it neither repeats nor is repeated; it has no labels. Of labels that repeat an id, any with the value 1
counts. An empty table gives no rows. Of other columns, whatever they are called, none is read. Copies of one text are counted
by id before they meet at their text, and cells of a text meet instead of its rows, so a text of a third of all rows is one
short group. A very long text costs its length in one task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import BLANKS
from .shared import written

#: The filter that looks at the other documents; the others are in failures().
REPEATED = "E"
NAMES = "ABCDE"


def failures(text: Column, words: Column) -> dict[str, Column]:
    """Whether a text fails each of the filters that look at nothing else."""
    n_words, n_chars = F.size(words).cast("long"), F.char_length(text).cast("long")
    capitals = n_chars - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n_words,
        "C": 100 * capitals > 3 * n_chars,
        "D": text.rlike(r"[#$%&*|]"),
    }


def _bit(name: str) -> int:
    return 1 << NAMES.index(name)


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The documents of each part by the filters that they fail: part, mask, n, good, toxic."""
    texts = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    worded = texts.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    mask = F.lit(0)
    for name, fails in failures(F.col("text"), F.col("words")).items():
        mask = mask + F.when(fails, _bit(name)).otherwise(0)
    seen = worded.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    seen = written(seen.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")), "interaction-documents")

    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    # Rows without an id would all meet in one task of the join, and have no labels.
    known = seen.filter(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    marked = known.unionByName(seen.filter(F.col("doc_id").isNull()).withColumns({"good": F.lit(False), "toxic": F.lit(False)}))

    # Within (digest, part, mask, marks) each id is one row, so the least id comes with its number of rows.
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    copies = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"), first)
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    later = copies.withColumn("later", F.col("n") - F.col("n_null") - F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    both = F.array(
        F.struct((F.col("mask") + _bit(REPEATED)).alias("mask"), F.col("later").alias("n")),
        F.struct(F.col("mask"), (F.col("n") - F.col("later")).alias("n")),
    )
    split = later.select("part", "good", "toxic", F.explode(both).alias("c")).select("part", "good", "toxic", "c.mask", "c.n").filter("n > 0")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def audit(found: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, from the cells: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley. The orders are the permutations of NAMES, 120 for five filters."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(NAMES)])
    steps = found.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "name"))
    steps = steps.filter("name <> ''").withColumn("step", (F.col("at") + 1).cast("int"))
    bit = F.expr(f"shiftleft(1, instr('{NAMES}', name) - 1)")
    long_form = steps.withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long_form = long_form.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))

    here, gone = (F.col("fails") > 0) & (F.col("earlier") == 0), (F.col("fails") > 0) & (F.col("earlier") > 0)
    total = lambda which, c: F.sum(F.when(which, F.col(c)).otherwise(0))
    out = long_form.groupBy("part", "filter_order", "step", "name").agg(
        total((F.col("fails") == 0) & (F.col("earlier") == 0), "n").alias("kept"),
        total(here, "n").alias("removed"),
        total(gone, "n").alias("redundant"),
        total(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "name"))).drop("name")
