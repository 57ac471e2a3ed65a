"""Mixing sources to target weights: subset-sum budget fitting.

Each source gets a target of words by its weight, at most `most` times its size, the excess going to the others by weight.
Documents of one source are counted by their exact size; a share of each size is taken first, then dynamic programming over a
bounded knapsack of the copies left fits the remaining budget, nearest to the target; of the documents of a size, those that
come first by a seeded hash of their ids are taken once more than the others.

Null texts have size 0; null is a source of its own, after all others. Rows that share id, source and size are taken as they
come in the sorted table; which of them is no matter, as they give equal results. Rows without an id are ordered among each
other likewise. An empty table gives an empty result, a source without words the target 0. Results replace columns that bear
their names. A very long text costs its length in one task.

A source of a third of all rows is counted by size before it is shuffled, and its documents are sorted into ranges of equal
size whatever they share, so no source, size or id is one group of rows. One source's sizes, at most one row for each number of
words that occurs, are fitted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .texts import PLAIN_WORD, slices, tidy, word_spans

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 11
#: Sources of up to SMALL words are fitted by the knapsack alone; sums of up to LARGEST are held as bits.
SMALL, LARGEST = 1 << 16, 1 << 22
#: Rows that one task sorts.
ROWS = 500_000


def sized(docs: DataFrame, keep: Sequence[str] | None = None, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """row (the struct of the columns to keep), id, source, size in words: a written table."""
    keep = docs.columns if keep is None else keep
    boxed = docs.select(F.struct(*keep).alias("row"), F.col(id_col).cast("string").alias("id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            for row, end, data, edge in slices(batch.column("text")):
                size[row:end] = np.diff(word_spans(data, edge, PLAIN_WORD)[2])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size)], names=["row", "id", "source", "size"])

    schema = boxed.drop("text").schema.add("size", "long")
    return written(boxed.mapInArrow(tidy(run), schema), "mixing-sizes")


def _running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of the column over the rows before in `order`: sums within ranges, and one row for each
    range (as many as shuffle partitions) for what comes before it."""
    placed = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumns(sums), "mixing-order")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_range").agg(*[F.sum(n).alias(n) for n in sums])
    ranges = ranges.select("_range", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_{n}") for n in sums])
    out = placed.withColumns({n: F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in sums}).join(F.broadcast(ranges), "_range")
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", *[f"_{n}" for n in sums])


def targets(counts: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The target of each source, from (source, size, n): source, source_size, target. Weights repeat along the sources in order
    of their code points, null last. A source is at its limit if it stays below its share of what those with a lower limit for
    their weight leave; the rest is shared by the others."""
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    placed = _running(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    weighed = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_limit = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    ordered = written(_running(weighed, by_limit, {"caps": F.col("cap"), "weights": F.col("weight")}), "mixing-limits")
    whole = ordered.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    exact = lambda c: c.cast("decimal(19,0)")
    share = exact(F.col("weight")) * exact(F.lit(whole[0]) - F.col("caps"))
    ordered = ordered.withColumn("at_limit", exact(F.col("cap")) * exact(F.lit(whole[1]) - F.col("weights")) <= share)
    gone = ordered.filter("at_limit").agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, left = whole[0] - gone[0], max(whole[1] - gone[1], 1)
    shared = F.col("weight") * F.lit(float(rest)) / F.lit(float(left))
    return ordered.select("source", "source_size", F.when(F.col("at_limit"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def knapsack(sizes: Sequence[int], copies: Sequence[int], goal: float) -> list[int]:
    """Copies of each size (positive, at most as many as given) whose sum is nearest to the goal, of two as near the lower: the
    reachable sums as bits, and for each sum the first step that reaches it."""
    wanted = max(int(goal + 0.5), 0)
    top = 2 * wanted + 1
    mask, reach = (1 << (top + 1)) - 1, 1
    parent = np.full(top + 1, -1, np.int32)
    steps: list[tuple[int, int]] = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        left, part = min(copies[k], top // sizes[k]), 1
        while left > 0 and not reach >> wanted & 1:
            part = min(part, left)
            fresh = (reach << part * sizes[k]) & mask & ~reach
            if fresh:
                bits = np.frombuffer(fresh.to_bytes(top // 8 + 1, "little"), np.uint8)
                parent[np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = len(steps)
                reach |= fresh
            steps.append((k, part))
            left, part = left - part, part * 2
    below = (reach & ((1 << (wanted + 1)) - 1)).bit_length() - 1
    above = reach >> wanted
    above = wanted + (above & -above).bit_length() - 1 if above else below
    best = below if goal - below <= above - goal else above
    out = [0] * len(sizes)
    while best > 0:
        k, part = steps[parent[best]]
        out[k] += part
        best -= part * sizes[k]
    return out


def fit(sizes: Sequence[int], counts: Sequence[int], target: float, most: int = MOST) -> list[int]:
    """How many documents of each size are taken, copies counted: first a share of each size, what a size can't take going on to
    the next shorter one, then by the knapsack what is left of the target. All of it is the knapsack's in small sources."""
    order = sorted((k for k in range(len(sizes)) if sizes[k] > 0), key=lambda k: -sizes[k])
    out = [0] * len(sizes)
    if not order or target <= 0:
        return out
    whole = sum(sizes[k] * counts[k] for k in order)
    open_ = min(max(SMALL, 2 * sizes[order[0]]), LARGEST // 4)
    share, carried = max(target - open_, 0.0) / whole, 0.0
    for k in order:
        wanted = counts[k] * sizes[k] * share + carried
        out[k] = max(min(most * counts[k], int(wanted // sizes[k])), 0)
        carried = wanted - out[k] * sizes[k]
    goal = target - sum(out[k] * sizes[k] for k in order)
    for k in order:  # only where documents are longer than the sums that are held
        if goal > LARGEST // 2:
            more = min(most * counts[k] - out[k], int((goal - LARGEST // 4) // sizes[k]))
            out[k], goal = out[k] + max(more, 0), goal - max(more, 0) * sizes[k]
    # What doesn't fit in twice the goal is never nearer to it than nothing.
    able = [k for k in order if most * counts[k] > out[k] and sizes[k] <= 2 * goal + 1]
    if goal <= LARGEST // 2:
        for k, more in zip(able, knapsack([sizes[k] for k in able], [most * counts[k] - out[k] for k in able], goal)):
            out[k] += more
    return out


def _plan(counts: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """The copies that every document of a source and size gets, and how many of them get one more."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sizes, n = group["size"].to_pylist(), group["n"].to_pylist()
        taken = fit(sizes, n, group["target"][0].as_py(), most)
        each = pa.array([t // c for t, c in zip(taken, n)], pa.int64())
        more = pa.array([t % c for t, c in zip(taken, n)], pa.int64())
        return group.append_column("each", each).append_column("more", more)

    both = counts.join(goals.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    return both.groupBy("source").applyInArrow(run, "source string, size long, n long, source_size long, target double, each long, more long")


def mix(
    docs: DataFrame, keep: Sequence[str] | None = None, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED, text: str = "text", source: str = "source", id_col: str = "doc_id"
) -> DataFrame:
    """The columns of docs (or those named) and size, source_size, target, copies (how often the mix has the document) and taken
    (size times copies). The same rows and seed give the same mix, however they are partitioned."""
    spark = docs.sparkSession
    rows = sized(docs, keep, text, source, id_col)
    counts = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mixing-counts")
    plan = written(_plan(counts, targets(counts, weights, most), most), "mixing-plan")

    # Ranges of rows by source, size and hash; a range holds part of a source and size, or several of them.
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // ROWS + 1)
    order = ["source", "size", "hash", "id", "at"]
    spread = rows.withColumns({"hash": F.xxhash64(F.lit(seed), "id"), "at": F.monotonically_increasing_id()}).repartitionByRange(ranges, *order)
    placed = written(spread.withColumn("range", F.spark_partition_id()), "mixing-ranges")
    parts = placed.groupBy("range", "source", "size").agg(F.count("*").alias("own"))
    ahead = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("own").over(ahead), F.lit(0))).select("range", F.col("source").alias("_source"), F.col("size").alias("_size"), "ahead")
    parts = parts.join(plan, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size"))).drop("source", "size", "n")

    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    joined = placed.join(parts.withColumnRenamed("range", "_range"), (F.col("range") == F.col("_range")) & same)
    rank = F.row_number().over(Window.partitionBy("range", "source", "size").orderBy("hash", "id", "at")) + F.col("ahead")
    chosen = joined.withColumn("copies", F.col("each") + F.when(rank <= F.col("more"), 1).otherwise(0)).withColumn("taken", F.col("size") * F.col("copies"))
    results = ["size", "source_size", "target", "copies", "taken"]
    names = [c for c in rows.schema["row"].dataType.names if c not in results]
    return chosen.select(*[F.col("row")[c].alias(c) for c in names], *results)
