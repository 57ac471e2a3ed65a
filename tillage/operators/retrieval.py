"""Retrieval over vectors and texts: cosine neighbours, exactly or by an index, a cascade of backends, scores, lexical fallback,
diversity."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.tables import held


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos in double precision; null where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def clamped(asked: int, most: int) -> int:
    """A number of rows asked for, one at least."""
    return max(1, min(asked, most))


def fetch_size(limit: Column, wide: Column) -> Column:
    """How many neighbours to fetch for `limit` results: more where boosts will reorder them."""
    cap = F.greatest(F.lit(1), F.least(limit, F.lit(12)))
    return F.least(F.lit(30), F.greatest(cap * F.when(wide, 3).otherwise(2), cap + 6))


Backend = Callable[[DataFrame], DataFrame]


def answered(queries: DataFrame, key: str, backends: list[Backend]) -> DataFrame:
    """For each query the hits of the first backend that has any, with its number. A backend gets only the queries that those
    before it leave open, and none is started when nothing is open; queries that none answers are left out."""
    done, left = [], queries
    for k, backend in enumerate(backends, 1):
        hits = held(backend(left).withColumn("backend", F.lit(k)))
        done.append(hits)
        if k == len(backends):
            break
        left = held(left.join(hits.select(key).distinct(), key, "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def _directions(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column as rows of length 1, and the places of those that have one: whole, of this width, not zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    at = np.flatnonzero(sizes == width)
    rows = flat[(starts[at][:, None] + np.arange(width))] if width else np.zeros((len(at), 0))
    length = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return rows[good] / length[good][:, None], at[good]


#: Vectors that are held against all queries of a block at a time.
STEP = 1024


class _Best:
    """The k nearest of each query so far: distances in millionths and ids. Equally far ones count by id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.ids = k, None
        self.far, self.held = np.zeros((queries, 0), np.int64), np.zeros((queries, 0), np.int64)

    def take(self, ids: pa.Array, far: np.ndarray) -> None:
        """Distances of all queries to some more vectors; a distance of NEVER is none."""
        known = 0 if self.ids is None else len(self.ids)
        self.ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        rank = np.empty(len(self.ids), np.int64)
        rank[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        every = np.concatenate([self.held, np.broadcast_to(known + np.arange(len(ids)), far.shape)], axis=1)
        far = np.concatenate([self.far, far], axis=1)
        # Distance and rank of the id as one number: no two of a query are equal.
        key = far * len(rank) + rank[every]
        if key.shape[1] > self.k:
            chosen = np.argpartition(key, self.k - 1, axis=1)[:, : self.k]
            far, every = np.take_along_axis(far, chosen, 1), np.take_along_axis(every, chosen, 1)
        kept, at = np.unique(every, return_inverse=True)
        self.ids, self.held, self.far = self.ids.take(pa.array(kept)), at.reshape(every.shape), far

    def rows(self, names: pa.Array) -> pa.RecordBatch:
        there = self.far < NEVER
        query, _ = np.nonzero(there)
        return pa.record_batch([names.take(pa.array(query)), self.ids.take(pa.array(self.held[there])), pa.array(self.far[there] / 1e6)], names=["query_id", "id", "distance"])


#: Further than any distance, in millionths.
NEVER = 1 << 24


def _search(batches: Iterator[pa.RecordBatch], sent: pa.Table, k: int, cells: bool) -> Iterator[pa.RecordBatch]:
    """The k nearest of the batches' vectors (id, vector; with cells: cell) for each query that was sent (query_id, v; with cells: the
    cells that it looks into)."""
    own = sent.column("v").combine_chunks() if sent.num_rows else None
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    width = int(pc.max(pc.list_value_length(own)).as_py() or 0) if own is not None else 0
    if not width:
        return
    wanted, place = _directions(own, width)
    names = sent.column("query_id").combine_chunks().take(pa.array(place))
    looks: dict[int, np.ndarray] = {}
    if cells:
        lists = [sent.column("cells")[int(p)].as_py() for p in place]
        for q, own_cells in enumerate(lists):
            for c in own_cells:
                looks.setdefault(c, []).append(q)
        looks = {c: np.array(q) for c, q in looks.items()}
    best = _Best(len(wanted), k)
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            some = batch.slice(at, STEP)
            rows, there = _directions(some.column(1), width)
            if not len(rows):
                continue
            ids = some.column(0).take(pa.array(there))
            if not cells:
                best.take(ids, np.rint((1 - wanted @ rows.T) * 1e6).astype(np.int64))
                continue
            far = np.full((len(wanted), len(rows)), NEVER, np.int64)
            cell = some.column(2).to_numpy()[there]
            for c in np.unique(cell):
                if int(c) in looks:
                    inside, asking = np.flatnonzero(cell == c), looks[int(c)]
                    far[np.ix_(asking, inside)] = np.rint((1 - wanted[asking] @ rows[inside].T) * 1e6)
            best.take(ids, far)
    if best.ids is not None:
        yield best.rows(names)


def _in_blocks(queries: DataFrame, most: int) -> Iterator[DataFrame]:
    """Queries in blocks of about `most` (a hash of the id chooses the block)."""
    blocks = -(-queries.count() // most) or 1
    for b in range(blocks):
        yield queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)


def _ranked(parts: list[DataFrame], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, vector_id: str, embedding: str, most: int = 4096) -> DataFrame:
    """The k nearest vectors of every query by cosine distance (6 digits), exactly: a stated set of queries against all rows.
    The queries are counted, and go out in blocks of about `most`, so that nothing sent grows with the data: more queries mean
    more blocks. Each task multiplies STEP vectors at a time with the block and keeps its own best k of each query. Vectors that
    are null, zero or of another width are nobody's neighbours."""
    q = queries.select(F.col(query_id).alias("query_id"), F.col(embedding).alias("v"))
    kinds = f"query_id {queries.schema[query_id].dataType.simpleString()}, id {vectors.schema[vector_id].dataType.simpleString()}, distance double"
    parts = []
    for some in _in_blocks(q, most):
        sent = q.sparkSession.sparkContext.broadcast(some.toArrow().combine_chunks())
        parts.append(vectors.select(vector_id, embedding).mapInArrow(lambda batches, sent=sent: _search(batches, sent.value, k, False), kinds))
    return _ranked(parts, k)


#: Vectors that the centres of an index are fitted on, at most; rounds of the fitting; cells of an index, at most.
FITTED, ROUNDS, CELLS = 20_000, 12, 4096


def _centres(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Directions that the vectors (of length 1) gather around; always the same for the same vectors."""
    dice = np.random.default_rng(7)
    centres = vectors[dice.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-12)[:, None], centres)
    return centres


#: Vectors that an index is measured with, at most, and the share of their k nearest that it has to find.
MEASURED, RECALL = 200, 0.95


def build_index(vectors: DataFrame, path: str, vector_id: str, embedding: str, cells: int | None = None, k: int = 10, recall: float = RECALL) -> None:
    """Write an index of vectors: path/rows by cell, with every row that has a direction, and path/centres. Each vector is in the
    cell of its nearest centre. The centres, as many as the root of the number of rows (CELLS at most), are fitted on FITTED
    vectors at most, which a hash of the id chooses. Then MEASURED vectors are searched for exactly: path/probes has how many
    cells a search has to look into to find `recall` of their k nearest, and the recall that this gives them."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(vector_id).alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    n = own.count()
    every = max(1, n // FITTED)
    some = own.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).limit(2 * FITTED).select("v").toArrow()["v"].combine_chunks()
    some = some.chunk(0) if isinstance(some, pa.ChunkedArray) else some
    width = int(pc.max(pc.list_value_length(some)).as_py() or 0) if len(some) else 0
    fitted = _centres(_directions(some, width)[0], cells or max(1, min(CELLS, isqrt(n)))) if width else np.zeros((0, 0))
    rows = [(k, c.tolist()) for k, c in enumerate(fitted)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    sent = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows if len(centres) else 0, STEP):
                some = batch.slice(at, STEP)
                found, there = _directions(some.column(1), centres.shape[1])
                if len(found):
                    yield pa.record_batch([*some.take(pa.array(there)).columns, pa.array(np.argmax(found @ centres.T, axis=1), pa.int32())], names=["id", "v", "cell"])

    kind = vectors.schema[vector_id].dataType.simpleString()
    # By cell and a part of it, so that a cell that many vectors are in isn't one task's.
    dealt = own.mapInArrow(run, f"id {kind}, v array<double>, cell int").withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt.repartition("cell", "_part").drop("_part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    rows = spark.read.schema(f"id {kind}, v array<double>, cell int").parquet(f"{path}/rows")
    some = rows.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, n // MEASURED))) == 0).limit(MEASURED).select("id", "v")
    asked = {r["id"]: r["v"] for r in some.collect()}
    found = nearest(spark.createDataFrame(list(asked.items()), f"id {kind}, v array<double>"), rows, k, "id", "id", "v").join(rows.select("id", "cell"), "id").select("query_id", "cell").collect()
    depth = np.array([np.sum(fitted @ np.array(asked[q]) > fitted[c] @ np.array(asked[q])) for q, c in found] or [0])
    probes = int(np.sort(depth)[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1
    spark.createDataFrame([(probes, float(np.mean(depth < probes)), kind)], "probes int, recall double, id_type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")


def probe_index(queries: DataFrame, path: str, k: int, query_id: str, embedding: str, probes: int | None = None, most: int = 4096) -> DataFrame:
    """The k nearest of each query among the vectors in the `probes` cells whose centres are nearest to it (as many as the index was
    measured to need): an approximation, exact where probes is the number of cells. Only the cells that a block of queries looks into are read."""
    spark = queries.sparkSession
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()  # CELLS at most
    told = spark.read.parquet(f"{path}/probes").first()
    probes = probes or told["probes"]
    rows = spark.read.schema(f"id {told['id_type']}, v array<double>, cell int").parquet(f"{path}/rows")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(embedding).cast("array<double>").alias("v"))
    kinds = f"query_id {queries.schema[query_id].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, distance double"
    matrix = np.array(centres["centre"].to_pylist(), np.float64).reshape(centres.num_rows, -1 if centres.num_rows else 0)
    parts = []
    for some in _in_blocks(q, most):
        table = some.toArrow().combine_chunks()
        own = table.column("v").combine_chunks()
        own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
        found, there = _directions(own, matrix.shape[1])
        chosen = np.argsort(-(found @ matrix.T), axis=1, kind="stable")[:, :probes]
        table = table.take(pa.array(there)).append_column("cells", pa.array(chosen.tolist(), pa.list_(pa.int32())))
        sent = spark.sparkContext.broadcast(table)
        inside = rows.filter(F.col("cell").isin([int(c) for c in np.unique(chosen)])).select("id", "v", "cell")
        parts.append(inside.mapInArrow(lambda batches, sent=sent: _search(batches, sent.value, k, True), kinds))
    return _ranked(parts, k)


def score(distance: Column) -> Column:
    """A distance as points: 1000 less its thousandth, at least 1; a negative distance gives 1000."""
    return F.when(distance < 0, 1000).otherwise(F.greatest(F.lit(1), F.bround(1000 - 1000 * distance))).cast("int")


def tokens(text: Column) -> Column:
    """The distinct words of a text, with the bigrams of its characters other than white space. The characters are taken once, in
    time linear in the text: what stands in a lambda is evaluated anew for each element."""
    chars = F.regexp_extract_all(F.regexp_replace(F.lower(text), r"\s+", ""), F.lit("(?s)."), F.lit(0))
    pairs = F.filter(F.zip_with(chars, F.slice(chars, 2, 1 << 30), lambda a, b: F.concat(a, b)), lambda p: p.isNotNull())
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")
    return F.array_union(words, pairs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def lexical(text: Column, words: list[str]) -> Column:
    """3 for each query word of two characters or more that the text contains, and up to 10 for words in common."""
    contained = sum((F.when(F.contains(F.lower(text), F.lit(w)), 3).otherwise(0) for w in words if len(w) >= 2), F.lit(0))
    own = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))
    return contained + F.least(F.lit(10), F.size(F.array_intersect(own, F.array(*map(F.lit, dict.fromkeys(words))))))


def lexical_hits(queries: DataFrame, texts: DataFrame, limit: int, preferred: Column, most: int = 4096) -> DataFrame:
    """For each query (query_id, words) the texts (id, text) of most points, as lexical() counts them: query_id, id, score, rank; of
    equal ones the lower id first, texts without a point never. If none of the `limit` has a preferred source, the best that
    has one takes the last place. Queries go out in blocks of about `most`; a task finds all their words in a text in one pass
    and keeps its own best of each query."""
    rows = texts.select("id", F.lower("text").alias("text"), F.coalesce(preferred, F.lit(False)).alias("preferred"))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {texts.schema['id'].dataType.simpleString()}, preferred boolean, score long"
    names = to_arrow_type(queries.schema["query_id"].dataType)
    parts = []
    for some in _in_blocks(queries.select("query_id", "words"), most):
        sent = queries.sparkSession.sparkContext.broadcast([(r["query_id"], list(dict.fromkeys(r["words"] or []))) for r in some.toLocalIterator()])
        parts.append(rows.mapInArrow(lambda batches, sent=sent: _lexical_best(batches, sent.value, limit, names), kinds))
    every = reduce(DataFrame.unionByName, parts)
    by_points = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = every.withColumn("nth", F.row_number().over(by_points))
    ranked = ranked.withColumn("pick", F.when(F.col("preferred"), F.row_number().over(Window.partitionBy("query_id", "preferred").orderBy(F.desc("score"), "id"))))
    whole = Window.partitionBy("query_id")
    has, is_any = F.max((F.col("preferred") & (F.col("nth") <= limit)).cast("int")).over(whole) == 1, F.max(F.col("preferred").cast("int")).over(whole) == 1
    room = F.when(has | ~is_any, limit).otherwise(limit - 1)
    chosen = ranked.withColumns({"room": room, "forced": is_any & ~has & (F.col("pick") == 1)}).filter((F.col("nth") <= F.col("room")) | F.coalesce("forced", F.lit(False)))
    return chosen.select("query_id", "id", "score", F.row_number().over(by_points).alias("rank"))


def _lexical_best(batches: Iterator[pa.RecordBatch], queries: list[tuple[object, list[str]]], limit: int, names: pa.DataType) -> Iterator[pa.RecordBatch]:
    import ahocorasick
    import regex

    machine, exact, split = ahocorasick.Automaton(), {}, regex.compile(r"[^\p{L}\p{N}_]+")
    for q, (_, words) in enumerate(queries):
        for w in filter(None, words):
            exact.setdefault(w, []).append(q)
    for w, asking in exact.items():
        machine.add_word(w, (w, asking))
    if not len(machine):
        return
    machine.make_automaton()
    best: dict[tuple[int, bool], list] = {}
    ids = pa.int64()
    for batch in batches:
        ids = batch.column(0).type
        for i, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(3))):
            points, shared = defaultdict(int), defaultdict(int)
            for w, asking in {w: a for _, (w, a) in machine.iter(text or "")}.items():
                for q in asking if len(w) >= 2 else ():
                    points[q] += 3
            for w in set(split.split(text or "")):
                for q in exact.get(w, ()):
                    shared[q] += 1
            for q in points.keys() | shared.keys():
                own = best.setdefault((q, wanted), [])
                own.append((-(points[q] + min(10, shared[q])), i))
                if len(own) > 8 * limit:
                    own.sort()
                    del own[limit:]
    rows = [(q, i, p, -s) for (q, p), own in best.items() for s, i in sorted(own)[:limit]]
    if rows:
        q, i, p, points = zip(*rows)
        yield pa.record_batch([pa.array([queries[k][0] for k in q], names), pa.array(i, ids), pa.array(p), pa.array(points, pa.int64())], names=["query_id", "id", "preferred", "score"])


def within_budget(df: DataFrame, keys: list[str], order: list[str], text: str, most: int) -> DataFrame:
    """The rows of each key, in order, as long as their texts together have at most so many characters."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(F.char_length(text)).over(w)).filter(F.col("used") <= most)


def diverse(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance within each query's few candidates (query_id, id, score, tokens): greedily the one of
    largest weight * relevance - (1 - weight) * likeness to the chosen; ties go to the lower id."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("id").to_dict("records")
        low, high = min(r["score"] for r in rows), max(r["score"] for r in rows)
        sets = {r["id"]: set(r["tokens"]) for r in rows}
        relevance = {r["id"]: (r["score"] - low) / (high - low) if high > low else 1.0 for r in rows}
        like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 0.0
        left, chosen = [r["id"] for r in rows], []
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (weight * relevance[i] - (1 - weight) * max((like(i, c) for c in chosen), default=0.0), -i))
            chosen.append(best)
            left.remove(best)
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]] * len(chosen), "id": chosen, "rank": range(1, len(chosen) + 1)})

    return candidates.groupBy("query_id").applyInPandas(choose, "query_id long, id long, rank int")
