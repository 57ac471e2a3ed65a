"""Connected components of an edge list, as joins: alternating large and small stars, labels are the least ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, written


def _stars(edges: DataFrame) -> DataFrame:
    """One large star, then one small star. The least neighbour of each node is aggregated and joined back, so that a
    hub is a skewed key of a plain join, which Spark splits, and never a group in one task."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(down, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(down.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of ids in, (node, component) out for every id in an edge between different ids; the component is
    its least id. Null ids are left out; an empty list gives an empty table. Each round is a table in the shared folder."""
    now = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    with scratch("components"):
        now, seen = written(now, "round"), None
        while True:
            mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
            if tuple(mark) == seen or not mark["n"]:
                break
            now, seen = written(_stars(now), "round"), tuple(mark)
        now = written(now, "components")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
