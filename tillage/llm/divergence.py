"""Source divergence audit: sort-based streaming over the terms of each language.

Every task sorts the terms of its documents by term, language, source and document; a run of equal ones is a count, a run of one
source its documents and occurrences. These partial runs are dealt by language and term, sorted by (lang, term, source) and
scanned once: a run of (lang, term) has the document frequency, and with it the kept terms and their counts by source. A second
scan of the kept runs emits for each two sources that share a term what the term adds to their distance, summed within a task
before it leaves it.

Rows are documents, repeated rows too; an id isn't needed. Null text, lang and source are empty strings; a document without
terms still makes its group. Equal values rank by item. An empty table gives no rows; other columns, whatever they are called,
aren't read. A very long text is a slice of its own. A term of a third of all rows is one partial row for each source and task
that it occurs in (as far as their memory goes), so no run holds documents.

Exactness: probabilities are integers of at most 1,000,000,001; products stay below 2 ** 63, the counts' products are decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .texts import byte_class, ragged, slices, tidy, word_spans

#: Bytes of the terms: ASCII letters and all that isn't ASCII.
TERM = byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Bytes of text that are sorted at once, partial rows that a task holds, pair sums that it holds.
SLICE, HELD, PAIRS = 8 << 20, 1_000_000, 2_000_000

PARTIAL = "lang string, term string, source string, docs long, n long"
KEPT = "lang string, term string, source string, n long, lang_n long, run long"


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that are equal in all columns begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _terms(data: bytes, edge: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of the rows of a slice, lower-cased, and the row of each."""
    starts, ends, first = word_spans(data, edge, TERM)
    lengths = ends - starts
    letters = LOWER[np.frombuffer(data, np.uint8)[ragged(starts, lengths)]] if starts.size else np.zeros(0, np.uint8)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return terms, np.repeat(np.arange(len(edge) - 1), np.diff(first))


def _slice_runs(lang: pa.Array, source: pa.Array, data: bytes, edge: np.ndarray) -> pa.Table:
    """The partial runs of a slice. Rows are numbered by lang and source, so that one key of term and row sorts by term, lang,
    source and document."""
    (lang_code, langs), (source_code, sources) = _codes(lang), _codes(source)
    by_group = np.lexsort((source_code, lang_code))
    place = np.empty_like(by_group)
    place[by_group] = np.arange(len(by_group))
    terms, row = _terms(data, edge)
    code, names = _codes(terms)
    key = np.sort(code.astype(np.int64) * len(by_group) + place[row])
    occurs = _starts(key)
    count = np.diff(np.append(occurs, len(key)))
    term, at = np.divmod(key[occurs], len(by_group))
    at = by_group[at]
    run = _starts(term, lang_code[at], source_code[at])
    docs = np.diff(np.append(run, len(occurs)))
    n = np.add.reduceat(count, run) if run.size else count
    rows = at[run]
    columns = [langs.take(pa.array(lang_code[rows])), names.take(pa.array(term[run])), sources.take(pa.array(source_code[rows])), pa.array(docs, pa.int64()), pa.array(n, pa.int64())]
    return pa.table(dict(zip(("lang", "term", "source", "docs", "n"), columns)))


def _merged(tables: list[pa.Table]) -> pa.Table:
    """Partial runs with equal (lang, term, source) as one, by a sort of their codes."""
    whole = pa.concat_tables(tables).combine_chunks()
    if not whole.num_rows:
        return whole
    codes = [_codes(whole[c])[0] for c in ("source", "term", "lang")]
    order = np.lexsort(codes)
    run = _starts(*[c[order] for c in codes])
    out = whole.select(["lang", "term", "source"]).take(pa.array(order[run]))
    for c in ("docs", "n"):
        out = out.append_column(c, pa.array(np.add.reduceat(whole[c].to_numpy()[order], run)))
    return out


def _emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
    strings = pa.schema([pa.field(f.name, pa.string() if pa.types.is_large_string(f.type) else f.type) for f in table.schema])
    yield from table.cast(strings).combine_chunks().to_batches(max_chunksize=50_000)


def _partial_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        lang, source = batch.column("lang"), batch.column("source")
        for row, end, data, edge in slices(batch.column("text"), SLICE):
            held.append(_slice_runs(lang.slice(row, end - row), source.slice(row, end - row), data, edge))
            if sum(t.num_rows for t in held) > 2 * HELD:
                held = [_merged(held)]
                if held[0].num_rows > HELD:
                    yield from _emit(held.pop())
    if held:
        yield from _emit(_merged(held))


def _changes(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Where a run of sorted rows that are equal in the named columns begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in names:
        column = table[c].combine_chunks()
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _whole_runs(batches: Iterator[pa.RecordBatch], sums: tuple[str, ...] = ()) -> Iterator[pa.Table]:
    """Sorted rows in tables that cut no run of (lang, term). Rows of one source within a run are added up in `sums`, where given;
    what waits for the end of a run is at most a row for each source."""
    wait: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if wait is None else pa.concat_tables([wait, rows])).combine_chunks()
        if not rows.num_rows:
            continue
        if sums:
            first = _changes(rows, ("lang", "term", "source"))
            out = rows.drop_columns(list(sums)).take(pa.array(first))
            for c in sums:
                out = out.append_column(rows.schema.field(c), pa.array(np.add.reduceat(rows[c].to_numpy(), first)))
            rows = out
        last = int(_changes(rows, ("lang", "term"))[-1])
        wait = rows.slice(last)
        if last:
            yield rows.slice(0, last).combine_chunks()
    if wait is not None and wait.num_rows:
        yield wait.combine_chunks()


def _kept_runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_runs(batches, ("docs", "n")):
            first = _changes(rows, ("lang", "term"))
            length = np.diff(np.append(first, rows.num_rows))
            frequency, n = (np.add.reduceat(rows[c].to_numpy(), first) for c in ("docs", "n"))
            head = np.zeros(rows.num_rows, np.int64)
            head[first] = 1
            out = rows.drop_columns(["docs"]).append_column("lang_n", pa.array(np.repeat(n, length))).append_column("run", pa.array(head))
            yield from _emit(out.filter(pa.array(np.repeat(frequency >= least, length))))

    return run


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The terms of each lang in at least so many of its documents: lang, term, source, n (occurrences in the source), lang_n (in the
    lang), run (1 in the first row of a term): a written table."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = texts.mapInArrow(tidy(_partial_runs), PARTIAL)
    return written(partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(tidy(_kept_runs(least)), KEPT), "divergence-terms")


def probability(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * ({n} + 2)) div greatest({total} + 2 * {terms}, 1)")


def distance(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each two sources with a term in common: how far the distances of such terms are from what they would be if each
    occurred in one of the two only, which single_sides() adds. Rows of a run are paired at growing steps."""
    names: dict[tuple[str, str], int] = {}
    sums: list[tuple[np.ndarray, np.ndarray]] = []

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        key, value = (np.concatenate(x) for x in zip(*sums))
        order = np.argsort(key, kind="stable")
        first = _starts(key[order])
        return key[order][first], np.add.reduceat(value[order], first)

    def sent() -> Iterator[pa.RecordBatch]:
        if sums:
            key, value = reduced()
            of = list(names)
            a, b = key >> 32, key & 0xFFFFFFFF
            strings = [[of[k][0] for k in a], [of[k][1] for k in a], [of[k][1] for k in b]]
            yield pa.RecordBatch.from_arrays([*(pa.array(s, pa.string()) for s in strings), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])
            sums.clear()

    for rows in _whole_runs(batches):
        p, zero = rows["p"].to_numpy(), rows["zero"].to_numpy()
        (lang, langs), (source, sources) = _codes(rows["lang"]), _codes(rows["source"])
        pairs, back = np.unique(lang.astype(np.int64) * len(sources) + source, return_inverse=True)
        known = [names.setdefault((langs[int(k) // len(sources)].as_py(), sources[int(k) % len(sources)].as_py()), len(names)) for k in pairs]
        code = np.array(known, np.int64)[back]
        first = _changes(rows, ("lang", "term"))
        last = np.repeat(np.append(first[1:], rows.num_rows), np.diff(np.append(first, rows.num_rows)))
        a, step = np.arange(rows.num_rows), 1
        while (a := a[a + step < last[a]]).size:
            b = a + step
            value = _distances(p[a], p[b]) - _distances(p[a], zero[b]) - _distances(zero[a], p[b]) + _distances(zero[a], zero[b])
            sums.append((code[a] << 32 | code[b], value))
            step += 1
            if sum(len(k) for k, _ in sums) > PAIRS:
                sums[:] = [reduced()]
                if len(sums[0][0]) > PAIRS // 2:
                    yield from sent()
    yield from sent()


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a lang, part `pair` has its distance to each other source of the
    lang over all kept terms, part `term` the `top` terms that it has more of than the lang.

    A term that neither of two sources has adds the same to their distance whatever it is, one that only one of them has what its
    count says; so the distance is the sum over all terms as if in neither, corrected by the counts of each source alone, and by the
    terms that both have."""
    kept = kept_terms(docs, least)
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = kept.groupBy("lang").agg(F.sum("run").alias("terms"), F.sum("n").alias("lang_total"))
    groups = occurring.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "lang_total"]).withColumn("zero", probability("0", "total", "terms"))
    groups = written(groups, "divergence-groups")

    here = kept.join(groups, ["lang", "source"]).withColumn("p", probability("n", "total", "terms"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = here.withColumn("q", probability("lang_n", "lang_total", "terms")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    both_ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s")
    dealt = here.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    shared = dealt.mapInArrow(tidy(_shared_terms), "lang string, source string, item string, value long").select("lang", both_ways, "value")
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    neither = groups.join(other, "lang").filter("source <> item").select("lang", F.struct("source", "item").alias("s"), (F.col("terms") * distance("zero", "other_zero")).alias("value"))
    counts = here.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("times"))
    single = counts.join(other, "lang").filter("source <> item").select("lang", both_ways, (F.col("times") * (distance("p", "other_zero") - distance("zero", "other_zero"))).alias("value"))
    pairs = neither.unionByName(single).unionByName(shared).groupBy("lang", "s.source", "s.item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(ranked))
    return pairs.select("lang", "source", "part", "item", "value", "rank").unionByName(terms)
