"""SimHash near-duplicates: fingerprints embedded as bit counts of segments, joined over a grid, verified exactly.

Fingerprint: A-Z lower-cased, words split at ASCII white space, shingles of three words joined by a space (all words
where there are fewer; a text without words has fingerprint 0, and null is such a text), XXH64 with seed 42 of each
shingle, repeats included; a bit is 1 where it is 1 in over half of them.

Equal fingerprints meet first, in one aggregation. Then the 64 bits are 16 segments of 4, and a fingerprint is a point of
the grid: its bit counts, packed in one number. Bit counts are no further apart (sum of absolute differences) than the
fingerprints are in bits, so two fingerprints at most two bits apart have points at most two steps apart, and some point
is at most one step from both. Each fingerprint goes to its own point and the 32 around it; those that meet at a point
are within reach, and their differing bits decide.

Points where over DENSE fingerprints meet would make too many pairs. All that come to such a point go on to a finer
grid, 32 segments of 2 bits, and from what is dense there to the finest, 64 segments of one bit. Its points are words,
one step is one bit, so at most 65 fingerprints meet at a point and any two of them are at most two bits apart: links to
the least of them do. Each step is exact, and no fingerprint is left out at any size.

Documents without an id get a fingerprint and no component. Repeated ids count as one document with several texts. An
empty table gives no rows; very long texts are worked on alone. Only the id and the text are read, so other columns
can't clash. Ids are whole numbers, or texts of such; another id is an
error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import scratch, written
from .texts import slices, tidy

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Bits of a segment, from the coarsest grid to the finest. RADIUS is one step out and one step back.
WIDTHS = (4, 2, 1)
#: Fingerprints at a point beyond which it is dense.
DENSE = 64
_AT_ONCE = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        cuts = [(0, len(line))]
    else:
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        cuts = list(zip(starts[: len(words) - shingle + 1].tolist(), (starts[shingle:] - 1).tolist()))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, len(cuts), _AT_ONCE):
        h = np.array([digest(line[a:b], SEED) for a, b in cuts[k : k + _AT_ONCE]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(cuts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, edge in slices(batch.column(1)):
                at = edge.tolist()
                found += [fingerprint(data[a:b], shingle) for a, b in zip(at, at[1:])]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def _point(fp: Column, width: int) -> Column:
    """The bit counts of the segments of so many bits, each in as many bits of a long."""
    if width == 1:
        return fp
    odd = F.lit(0x5555555555555555)
    high, low = F.shiftrightunsigned(fp, 1).bitwiseAND(odd), fp.bitwiseAND(odd)
    twos = F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseXOR(low))
    if width == 2:
        return twos
    some = F.lit(0x3333333333333333)
    return twos.bitwiseAND(some) + F.shiftrightunsigned(twos, 2).bitwiseAND(some)


def _reach(nodes: DataFrame, width: int) -> DataFrame:
    """Each node (fp, rep) at its point and at all points one step away: point, fp, rep. A step up or down that a segment of
    `width` bits can't take is left out; where a segment is one bit, up is the only step from 0 and down from 1."""
    n = 64 // width
    stepped = nodes.select("fp", "rep", _point(F.col("fp"), width).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(2 * n))).alias("step"))
    at = f"{width} * (step div 2)"
    count = F.expr(f"CAST(shiftrightunsigned(own, CAST({at} AS INT)) & {(1 << width) - 1} AS INT)")
    counted = stepped.withColumn("count", F.when(F.col("step") < 2 * n, count).otherwise(0))
    to = F.col("count") + F.when(F.col("step") % 2 == 1, 1).otherwise(-1)
    moved = counted.withColumn("to", F.when(F.col("step") == 2 * n, F.lit(0)).otherwise(to)).filter((F.col("to") >= 0) & (F.col("to") <= width))
    return moved.select(F.expr(f"CASE WHEN step = {2 * n} THEN own ELSE own ^ shiftleft(CAST(count ^ to AS BIGINT), CAST({at} AS INT)) END").alias("point"), "fp", "rep")


def links(nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """(u, v) links between the reps of different fingerprints (fp, rep) that connect all at most RADIUS bits apart, and no
    others. Where a point is not dense, all its pairs within RADIUS are there."""
    found, crowd = None, nodes
    for width in WIDTHS[:-1]:
        reach = _reach(crowd, width)
        met = written(reach.groupBy("point").agg(F.count("*").alias("n")).filter("n > 1"), f"simhash-grid-{width}")
        thin = reach.join(met.filter(F.col("n") <= dense).select("point"), "point").groupBy("point").agg(F.collect_list(F.struct("fp", "rep")).alias("all"))
        pairs = thin.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).filter("a.fp < b.fp")
        near = pairs.filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS).select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))
        found = near if found is None else found.union(near)
        full = met.filter(F.col("n") > dense).select("point")
        if full.isEmpty():
            return found.distinct()
        crowd = written(reach.join(full, "point", "left_semi").select("fp", "rep").distinct(), f"simhash-crowd-{width}")
    words = _reach(crowd, WIDTHS[-1]).groupBy("point").agg(F.collect_set("rep").alias("reps")).filter(F.size("reps") > 1)
    stars = words.select(F.array_min("reps").alias("v"), F.explode("reps").alias("u")).filter("u != v")
    return found.union(stars.select("u", "v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (the least id reachable over links of at most RADIUS bits)."""
    prints = written(fingerprints(docs, id_col, text, shingle), "simhash")
    nodes = written(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    # An id that several rows bear links their fingerprints.
    many = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a != b")
    shared = prints.join(many.select("doc_id"), "doc_id").join(nodes, "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    with scratch("components"):
        labels = components(links(nodes, dense).union(shared))
    of = nodes.join(labels, nodes.rep == labels.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
