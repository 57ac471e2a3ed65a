"""Joins, rollups, ranking and keyed writes as functions of DataFrames and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conjunction(**wanted: object) -> Column:
    """The conditions that are given, all of them: a list means membership, None no condition."""
    parts = [F.col(c).isin(v) if isinstance(v, (list, tuple)) else F.col(c) == F.lit(v) for c, v in wanted.items() if v is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


#: Rows that a table may have to count as a dimension.
DIMENSION_ROWS = 10_000


def dimension(df: DataFrame, column: str, most: int = DIMENSION_ROWS) -> list:
    """The values of a small dimension, in order; a larger one is an error, never a list on the driver."""
    rows = df.select(column).filter(F.col(column).isNotNull()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(r[0] for r in rows)


def small(df: DataFrame, most: int = DIMENSION_ROWS) -> DataFrame:
    """df to be broadcast, if it has at most so many rows; else as it is, so that Spark chooses another join."""
    return F.broadcast(df) if len(df.limit(most + 1).select(F.lit(1)).collect()) <= most else df


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows of a key in one task, sorted by keys and order, for functions that take the rows of a task as a stream. Dealt by a
    hash of the keys, not by the keys: Spark leaves a shuffle by columns out where what is below claims to be dealt by them, as a
    union of windows does, and the adaptive run then merges the partitions of each side its own way."""
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def labelled(*columns: str) -> Column:
    """The first of the columns that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def counted(base: DataFrame, keys: list[str], *parts: DataFrame) -> DataFrame:
    """base with the aggregates of each part, which has one row for each key; missing counts are 0."""
    out = base
    for part in parts:
        new = [c for c in part.columns if c not in keys]
        out = out.join(part, keys, "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in new})
    return out


def share(part: str, whole: str, digits: int = 1) -> Column:
    """100 * part / whole, null where whole is 0."""
    return F.round(F.lit(100.0) * F.col(part) / F.nullif(F.col(whole), F.lit(0)), digits)


def status_rollup(child: DataFrame, keys: list[str], status: str, end: str) -> DataFrame:
    """One row for each key from its children's status (done, doing or else): counts, progress, and the last end once all are done."""
    done, doing = F.col(status) == "done", F.col(status) == "doing"
    counts = child.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count(F.when(done, 1)).alias("n_done"),
        F.count(F.when(doing, 1)).alias("n_doing"),
        F.max(F.when(done, F.col(end))).alias("last_end"),
    )
    state = F.when(F.col("n") == F.col("n_done"), "done").when(F.col("n_done") + F.col("n_doing") > 0, "doing").otherwise("open")
    return counts.withColumns({"status": state, "rate": share("n_done", "n"), "last_end": F.when(F.col("n") == F.col("n_done"), F.col("last_end"))})


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def first_n(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_nth") <= n).drop("_nth")


def numbered_after(new: DataFrame, base: DataFrame, keys: list[str], number: str, *order: Column) -> DataFrame:
    """new with `number`: within each key on from the largest of base."""
    last = base.groupBy(*keys).agg(F.max(number).alias("_last"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return new.join(last, keys, "left").withColumn(number, F.coalesce("_last", F.lit(0)) + nth).drop("_last")


def carried_forward(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with the value carried over gaps, and is_extrapolated where it was."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("is_extrapolated", F.col(value).isNull()).withColumn(value, F.last(value, ignorenulls=True).over(w))


def runs(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive integers within each key: first, last, n."""
    one = df.select(*keys, number).distinct()
    island = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return one.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_island")


def keyed_difference(want: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """The keys to add and the keys to delete, with `action`."""
    a, b = want.select(*keys).distinct(), have.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("action", F.lit("add")).unionByName(b.join(a, keys, "left_anti").withColumn("action", F.lit("delete")))


def upsert(base: DataFrame, new: DataFrame, keys: list[str], *latest: Column) -> DataFrame:
    """base with the rows of new in place of those with their keys; of several new rows of a key the first in `latest` order counts."""
    fresh = first_per_key(new, keys, *latest) if latest else new
    return base.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(base.columns))


def updated(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """df with new values in the rows that meet the condition; a condition that is null changes nothing."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def either_key(queries: DataFrame, key: str, targets: DataFrame, candidates: list[str], *rank: Column) -> DataFrame:
    """Resolve a free-form key against several columns: one equi-join for each column, and the best row in `rank` order.
    `queries` has distinct keys."""
    hits = None
    for column in candidates:
        own = queries.select(key).join(targets, F.col(key) == F.col(column).cast("string"))
        hits = own if hits is None else hits.unionByName(own)
    return first_per_key(hits.distinct(), [key], *rank)


def ladder(left: DataFrame, right: DataFrame, rungs: list[list[str]], left_id: str, right_id: str, guard: str | None = None) -> DataFrame:
    """(left_id, right_id, rung) pairs that agree on the columns of a rung, with the first rung they agree on: a union of
    equi-joins. The guard column, on the last rung, must not differ where both sides have it."""
    pairs = None
    for k, keys in enumerate(rungs):
        extra = [guard] if guard and guard not in keys else []
        a = left.select(left_id, *keys, *extra).dropna(subset=keys)
        b = right.select(right_id, *keys, *[F.col(g).alias(f"_{g}") for g in extra]).dropna(subset=keys)
        met = a.join(b, keys)
        if extra and k == len(rungs) - 1:
            met = met.filter(F.coalesce(F.col(guard) == F.col(f"_{guard}"), F.lit(True)))
        met = met.select(left_id, right_id, F.lit(k + 1).alias("rung"))
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs.groupBy(left_id, right_id).agg(F.min("rung").alias("rung"))


def next_or_last(df: DataFrame, keys: list[str], at: str, now: Column, value: str) -> DataFrame:
    """For each key the value at the least time from now on, or else at the greatest."""
    later = F.min_by(F.when(F.col(at) >= now, F.col(value)), F.when(F.col(at) >= now, F.col(at)))
    return df.groupBy(*keys).agg(F.coalesce(later, F.max_by(value, at)).alias(value))
