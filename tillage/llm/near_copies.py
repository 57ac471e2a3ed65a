"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them.

Shingles: A-Z lower-cased, words split at ASCII white space, runs of five words (all words where there are fewer), as
64-bit digests. Texts with the same set are one node, named by the digest of the set.

The first candidates come from SimHash: each node has a fingerprint of 64 bits, a bit is 1 where it is 1 in over half of the
shingles, and nodes at most simhash.RADIUS bits apart meet on op6's grid (simhash.links). Whole sets decide which of them are
linked. That finds most near copies, but bits promise nothing, so what they leave apart is looked for by prefixes.

Candidates of the second step come from prefixes, which lose nothing: if the shingles of all sets are put in one order, whatever it is, two
sets of n and m shingles that are similar enough share one of the first n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1. The
order puts shingles last that are frequent in a sample, so that common passages hardly ever bring texts together. At the
first shingle that two sets share, what is left of the shorter one bounds what they can share.

Nodes that share a prefix shingle are held against the first of them: each node against the first one with which it shares
most, then against some further ones that are still in another component. After that only pairs from different
components are left, all of them, so a large group of copies makes neither all its pairs nor a link for each shingle.

Where every shingle is frequent, as in texts put together from blocks, prefixes bring many unlike texts together. A node that
would be held against more than CROWD rows of other components is crowded; pairs of crowded nodes meet by parts of their
sets instead (patterns()), so no node has more than CROWD rows or its patterns to go through. Two similar sets of at most u shingles differ in at most 2u / 9, so if all shingles are dealt into parts by a
hash, some part has at most SLACK differences, and of its pieces two are the same in both sets. Pieces hold some seven
shingles of all places of a text, so unlike texts hardly ever share one.

Counts of the shingles in BUCKETS buckets bound what two sets share and drop most candidates; the whole sets decide the
others. Ids are whole numbers, or texts of such; another id is an error.

Null and empty texts have the empty set and are copies of each other. Rows without an id stand for themselves. An empty
table gives an empty one; very long texts are worked on alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .shared import scratch, written
from .texts import PLAIN_WORD, _mixed, run_digests, slices, tidy, word_digests, word_spans

SHINGLE = 5
#: The least similarity, as a fraction of whole numbers: bounds are taken without rounding.
SIMILAR = (4, 5)
#: One text of so many is sampled for the order; a shingle counts as frequent from so many of them; at most so many are kept.
SAMPLE, FREQUENT, KEPT = 16, 4, 1 << 19
#: First nodes that a node is held against before all pairs from different components are.
TRIED = 8
#: Buckets of the counts that bound what two sets share. A count of 255 may stand for more and bounds nothing.
BUCKETS = 256
#: Rows of other components from which on a node is crowded.
CROWD = 20_000
#: Differences that the best part may have, and the pieces of a part; two of SLACK + 2 pieces are free of so many differences.
SLACK, PIECES = 2, 4
#: Shingles that more than one row in so many has are dealt with apart, at most as many; one node of so many is looked at for them.
HOT, HOT_SAMPLE = 10_000, 16
#: Bits of the map that says of which documents the sets are wanted.
MAP_BITS = 1 << 26


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text, the digests of its shingles, each once, in their own order."""
    for _, _, data, edge in slices(column):
        data = data.lower()
        starts, ends, first = word_spans(data, edge, PLAIN_WORD)
        words = word_digests(data, starts, ends, 1)[0]
        runs = run_digests(words, shingle)
        at = first.tolist()
        for a, b in zip(at, at[1:]):
            if b - a >= shingle:
                yield np.unique(runs[a : b - shingle + 1])
            else:
                yield run_digests(words[a:b], b - a) if b > a else words[:0]


def _small(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces, so that a task holds few sets at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            yield batch.slice(k, most)


def _name(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    edge = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    flat = np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(flat))


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of (doc_id, text), and their counts; at most KEPT, so the size is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            for own in shingle_sets(batch.column(1)):
                yield pa.record_batch([pa.array(own.view(np.int64))], names=["token"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(tidy(run), "token long")
    counts = sample.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "token").limit(KEPT).toArrow()
    tokens, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set of shingles; that of the empty set is 0."""
    ones = np.zeros(64, np.int64)
    mixed = _mixed(own)
    for k in range(0, len(own), 1 << 15):
        ones += np.unpackbits(mixed[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def prefixes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, prefix, counts, fp) of (doc_id, text): the name and size of the set, the shingles that it is found by,
    how many it has in each bucket, and its fingerprint."""
    common = docs.sparkSession.sparkContext.broadcast(frequent(docs))
    p, q = SIMILAR

    def prefix(own: np.ndarray) -> np.ndarray:
        tokens, counts = common.value
        rank = np.zeros(len(own), np.int64)
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
            rank = np.where(tokens[at] == own, counts[at], 0)
        n = len(own)
        return own[np.argsort(rank, kind="stable")][: n - -(-n * p // q) + 1].copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            names, sizes, found, counts, bits = [], [], [], [], []
            for own in shingle_sets(batch.column(1)):
                names.append(_name(own))
                sizes.append(len(own))
                found.append(prefix(own))
                bits.append(fingerprint(own))
                counts.append(np.minimum(np.bincount((own >> np.uint64(7)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 255).astype(np.uint8).tobytes())
            yield pa.record_batch([batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), _lists(found), pa.array(counts, pa.binary()), pa.array(bits, pa.int64())], names=["doc_id", "node", "n", "prefix", "counts", "fp"])

    return docs.mapInArrow(tidy(run), "doc_id long, node long, n int, prefix array<long>, counts binary, fp long")


def by_fingerprints(nodes: DataFrame) -> DataFrame:
    """The pairs (node, node2), the larger first, that connect all nodes (node, fp) at most simhash.RADIUS bits apart: nodes of one
    fingerprint with the least of them, and the least ones of fingerprints that are near each other."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "near-prints")
    same = nodes.select("node", "fp").join(prints, "fp").filter("node != rep").select("node", F.col("rep").alias("node2"))
    across = simhash.links(prints).select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("node2"))
    return same.union(across).distinct()


def _met(nodes: DataFrame) -> DataFrame:
    """(token, node, n, pos, node2, n2, pos2) of the prefix shingles that several nodes have, with the first node of each: the one
    with the fewest shingles before it, so the one most like what its copies were made from. The rows of a shingle pass as a
    stream, of which only the first node and the last row are carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_numpy() for k in range(4)]
            if before is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(before, rows)]
            token = rows[0]
            fresh = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            lead = np.repeat(fresh, np.diff(np.append(fresh, len(token))))
            use = np.arange(len(token)) != lead
            if before is not None and len(before[0]) == 2:
                use[1] = False  # went out with the last batch
            ahead = np.unique(lead[use])
            if before is not None and len(before[0]) == 2:
                ahead = ahead[ahead != 0]
            out = np.sort(np.concatenate([np.flatnonzero(use), ahead]))
            yield pa.record_batch([x[out] for x in rows] + [x[lead[out]] for x in rows[1:]], names=["token", "node", "n", "pos", "node2", "n2", "pos2"])
            last = int(lead[-1])
            # A group that has already gone out keeps its first row twice, as a mark.
            before = [x[[last, last]] if len(token) - last > 1 else x[[last]] for x in rows]

    rows = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "node", "n", "pos")
    # A shingle that very many nodes have would be one task's: its first node is an aggregate, which goes out to all tasks.
    some = rows.filter(F.pmod("node", F.lit(HOT_SAMPLE)) == 0)
    n_some = some.count()
    hot = some.groupBy("token").agg(F.count("*").alias("k")).filter(F.col("k") * HOT > F.lit(n_some) + HOT * FREQUENT)
    hot = written(hot.orderBy(F.desc("k"), "token").limit(HOT).select("token"), "near-hot")
    dealt = rows.join(F.broadcast(hot), "token", "left_anti").repartition("token").sortWithinPartitions("token", "pos", "node")
    cold = dealt.mapInArrow(tidy(run), "token long, node long, n int, pos int, node2 long, n2 int, pos2 int")
    held = rows.join(F.broadcast(hot), "token")
    first = held.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("f"))
    led = held.join(F.broadcast(first), "token").select("token", "node", "n", "pos", F.col("f.node").alias("node2"), F.col("f.n").alias("n2"), F.col("f.pos").alias("pos2"))
    return cold.unionByName(led)


def _possible(rows: DataFrame) -> DataFrame:
    """The pairs (node, node2) whose sizes and places allow for the similarity, once each with the number of rows."""
    p, q = SIMILAR
    sizes = (F.least("n", "n2").cast("long") * q >= F.greatest("n", "n2").cast("long") * p)
    left = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")).cast("long")
    return rows.filter(sizes & (left * (p + q) >= (F.col("n").cast("long") + F.col("n2")) * p)).groupBy("node", "node2").agg(F.count("*").alias("shared"))


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs, with the first document of each node, whose counts allow for the similarity."""
    p, q = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(n, BUCKETS) for k in (4, 5))
            size = x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64)
            open_ended = (x == 255).any(axis=1) | (y == 255).any(axis=1)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(open_ended | (np.minimum(x, y).sum(axis=1, dtype=np.int64) * (p + q) >= size * p)))

    ends = [nodes.select(*[F.col(c).alias(c + k) for c in ("node", "rep", "counts")]) for k in ("", "2")]
    both = pairs.join(ends[0], "node").join(ends[1], "node2").select("node", "node2", "rep", "rep2", "counts", "counts2")
    return both.mapInArrow(tidy(run), "node long, node2 long, rep long, rep2 long")


def _of_wanted(docs: DataFrame, reps: DataFrame, made, column: str) -> DataFrame:
    """(rep, node, column) of the documents that reps names, and maybe of some others: what is made of their sets."""
    named = reps.select(F.pmod(reps.columns[0], F.lit(MAP_BITS)).alias("bit"))
    places = named.groupBy(F.shiftright("bit", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS >> 5, np.uint32)
    bits[places.column(0).to_numpy()] = places.column(1).to_numpy().astype(np.uint32)
    wanted = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(0).to_numpy() % MAP_BITS
            for some in _small([batch.filter(pa.array(wanted.value[bit >> 5] >> (bit & 31).astype(np.uint32) & 1 == 1))]):
                found = list(shingle_sets(some.column(1)))
                yield pa.record_batch([some.column(0), pa.array([_name(own) for own in found], pa.int64()), made(found)], names=["rep", "node", column.split()[0]])

    return docs.mapInArrow(tidy(run), f"rep long, node long, {column}")


def _bands(size: int) -> tuple[int, int, int]:
    """The number of a size's band, the largest size of the band and of the next: sizes that allow for the similarity are in one
    band or in neighbours."""
    p, q = SIMILAR
    k, top = 0, 1
    while top < size:
        k, top = k + 1, max(top + 1, top * q // p)
    return k, top, max(top + 1, top * q // p)


def patterns(own: np.ndarray) -> np.ndarray:
    """What a set is found by where its shingles are all frequent: for its band of sizes and for the next larger one, each two
    pieces of each part. Similar sets have one in common."""
    p, q = SIMILAR
    if not len(own):
        return own
    band, *tops = _bands(len(own))
    one, two = np.array([(a, b) for a in range(PIECES) for b in range(a + 1, PIECES)]).T
    mixed = _mixed(own)
    out = []
    for k, top in enumerate(tops):
        # Of sizes up to top, similar sets differ in at most 2 top (q - p) / (q + p) shingles.
        parts = 2 * top * (q - p) // (q + p) // (SLACK + 1) + 1
        piece = (mixed % np.uint64(parts * PIECES)).astype(np.int64)
        order = np.argsort(piece, kind="stable")
        first = np.flatnonzero(np.diff(piece[order], prepend=-1))
        held = np.zeros(parts * PIECES, np.uint64)
        held[piece[order][first]] = np.add.reduceat(_mixed(mixed[order] + np.uint64(1)), first)
        held = held.reshape(parts, PIECES)
        place = (np.arange(parts, dtype=np.uint64) * np.uint64(len(one)))[:, None] + np.arange(len(one), dtype=np.uint64) + (np.uint64(band + k) << np.uint64(40))
        out.append(_mixed(_mixed(held[:, one] + place) + held[:, two]).ravel())
    return np.concatenate(out)


def _apart(rows: DataFrame, key: str) -> DataFrame:
    """The pairs of rows (key, node, n, component, ...) that share a key but not the component: those of the component that most
    rows of a key have against the others, and the others among themselves."""
    rows = written(rows.join(rows.groupBy(key).agg(F.mode("component", True).alias("most")), key), "near-sides")
    main, rest = rows.filter("component = most").drop("most"), rows.filter("component != most").drop("most")
    other = rest.select(key, *[F.col(c).alias(f"{c}2") for c in rest.columns if c != key])
    return main.join(other, key).unionByName(rest.join(other, key).filter("node > node2 and component != component2"))


def _similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar. Texts aren't shuffled: a map of bits, of bounded size, says which documents may
    be wanted, and the join settles it."""
    p, q = SIMILAR
    pairs = written(_bounded(pairs, nodes), "near-bounded")
    # Equal rows of one id may be there several times.
    sets = written(_of_wanted(docs, pairs.select("rep").union(pairs.select("rep2")), _lists, "own array<long>"), "near-sets")
    ends = [sets.select(*[F.col(c).alias(c + k) for c in ("rep", "node", "own")]) for k in ("", "2")]
    both = pairs.join(ends[0], ["node", "rep"]).join(ends[1], ["node2", "rep2"])
    shared = F.size(F.array_intersect("own", "own2"))
    near = both.filter(shared * (p + q) >= (F.size("own") + F.size("own2")) * p)
    return near.select(F.col("node").alias("u"), F.col("node2").alias("v")).distinct()


def _unlike(rows: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (node, node2), the larger first, of rows (token, node, n, pos, component) that share a token but not the component:
    from each node that isn't crowded against all of them, and of crowded ones those that share a pattern."""
    counts = rows.groupBy("token", "component").agg(F.count("*").alias("own"))
    whole = counts.groupBy("token").agg(F.sum("own").alias("every"), F.max_by("component", F.struct("own", "component")).alias("most"), F.count("*").alias("several")).filter("several > 1")
    rows = rows.join(whole.drop("several"), "token").join(counts, ["token", "component"]).withColumn("others", F.col("every") - F.col("own")).drop("every", "own")
    rows = written(rows, "near-apart")
    crowded = written(rows.groupBy("node").agg(F.sum("others").alias("cost")).filter(F.col("cost") > CROWD).select("node", F.lit(True).alias("crowded")), "near-crowds")
    rows = rows.drop("others").join(crowded, "node", "left")
    # The rows of a token's largest component against the others, so that its own are never paired.
    main, rest = rows.filter("component = most").drop("most"), rows.filter("component != most").drop("most")
    asked = lambda df: df.select("token", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "pos", "component")])
    free = lambda df: df.filter("crowded is null").drop("crowded")
    met = free(main).join(asked(rest), "token").unionByName(free(rest).join(asked(main), "token")).unionByName(free(rest).join(asked(rest), "token").filter("component != component2"))
    larger = lambda df: df.select(F.greatest("node", "node2").alias("node"), F.least("node", "node2").alias("node2"))
    direct = larger(_possible(met))
    return direct.unionByName(_by_patterns(rows.filter("crowded"), nodes, docs)).distinct()


def _by_patterns(rows: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (node, node2) of the nodes of rows that share a pattern, but not the component, and whose sizes allow for the
    similarity."""
    p, q = SIMILAR
    crowded = written(rows.select("node", "n", "component").distinct().join(nodes.select("node", "rep"), "node"), "near-crowded")
    if crowded.isEmpty():
        return crowded.select("node", F.col("node").alias("node2"))
    found = _of_wanted(docs, crowded.select("rep"), lambda sets: _lists([patterns(own) for own in sets]), "found array<long>")
    found = found.join(crowded, ["node", "rep"]).select(F.explode("found").alias("found"), "node", "n", "component").distinct()
    found = written(found, "near-patterns")
    several = found.groupBy("found").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a != b").select("found")
    pairs = _apart(written(found.join(several, "found"), "near-patterns"), "found")
    sizes = F.least("n", "n2").cast("long") * q >= F.greatest("n", "n2").cast("long") * p
    return pairs.filter(sizes).select(F.greatest("node", "node2").alias("node"), F.least("node", "node2").alias("node2")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, component) of each row with an id; the component is the least node reachable over similar sets. Nodes are
    sets of shingles, so rows that share an id but not the text are apart."""
    with scratch("near-found"):
        return _found(docs, id_col, text)


def _found(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    prints = written(prefixes(docs), "near-prefixes")
    nodes = written(prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("counts").alias("counts"), F.first("fp").alias("fp")), "near-nodes")
    near = written(_similar(by_fingerprints(nodes), nodes, docs), "near-bits")
    met = written(_met(prints.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))), "near-met")
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "node2"))
    stars = written(_possible(met.filter("node != node2")).withColumn("nth", nth).filter(F.col("nth") <= TRIED).select("node", "node2", "nth"), "near-stars")

    def named(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs that are still in different components."""
        ends = [labels.select(F.col("node").alias("node" + k), F.col("component").alias("c" + k)) for k in ("", "2")]
        both = pairs.join(ends[0], "node", "left").join(ends[1], "node2", "left")
        return both.filter(F.coalesce("c", "node") != F.coalesce("c2", "node2")).select("node", "node2")

    # What fingerprints leave apart.
    first = written(named(stars.filter("nth = 1").select("node", "node2"), components(near)), "near-first")
    first = written(near.union(_similar(first, nodes, docs)), "near-links")
    others = stars.filter("nth > 1").select("node", "node2")
    links = written(first.union(_similar(written(named(others, components(first)), "near-others"), nodes, docs)), "near-links")
    # What is still apart, though it shares a prefix shingle.
    labels = written(components(links), "near-labels")
    rows = met.select("token", "node", "n", "pos").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = _unlike(rows, nodes, docs)
    tried = stars.select(F.greatest("node", "node2").alias("node"), F.least("node", "node2").alias("node2"))
    rest = written(rest.join(tried, ["node", "node2"], "left_anti"), "near-rest")
    labels = components(links.union(_similar(rest, nodes, docs)))
    found = prints.select("doc_id", "node").join(labels, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    return written(found, "near-found")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with the columns of docs, whatever they are called: the one with the least id, of several with
    that id the one with the least node, and of equal texts the first as JSON. Rows without an id stay, since nothing can
    stand for them."""

    @F.arrow_udf("long")
    def name(texts: pa.Array) -> pa.Array:
        return pa.array([_name(own) for own in shingle_sets(texts)], pa.int64())

    found = near_copies(docs, id_col, text)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    staying = found.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("s")).select(F.col("s.doc_id").alias("id"), F.col("s.node").alias("node"))
    # An id that one row bears names that row; only for repeated ids the nodes are needed to tell which is which.
    repeated = written(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("id")), "near-repeated")
    single = rows.join(staying.join(repeated, "id", "left_anti").select("id"), "id").select("row")
    named = rows.join(repeated, "id", "left_semi").withColumn("node", name("text")).join(staying, ["id", "node"])
    nth = F.row_number().over(Window.partitionBy("id", "node").orderBy("text", F.to_json("row")))
    once = named.withColumn("nth", nth).filter("nth = 1").select("row")
    return single.union(once).union(rows.filter("id is null").select("row")).select("row.*")
