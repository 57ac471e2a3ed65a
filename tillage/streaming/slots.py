"""Streams: keyed slots where the latest wins, and requests that later evidence settles, in batches or as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.relational import first_per_key

#: Bytes that a bucket of a table should have.
BUCKET_BYTES = 256 << 20

#: Requests that are written to a state at once.
PIECE = 10_000


def upsert_stream(rows: DataFrame, target: str, keys: list[str], order: str, checkpoint: str, bucket_bytes: int = BUCKET_BYTES) -> StreamingQuery:
    """Each micro-batch replaces the slots that it has rows for, unless these are older (by `order`) than what is there; a batch that
    comes again gives the same table. Slots are in
    buckets by a hash of their key, and a batch writes the buckets that it touches anew, as target/v=<batch>.<buckets>/bucket=<k>;
    the others stay as they are. A version counts once it is whole, so readers never see half a batch. Of a bucket the newest
    version and the one before it stay, older ones go. Buckets are as many as the table's bytes ask for, a power of two: once it
    has outgrown them, a batch writes all of it in more of them, so each row is written anew for that a bounded number of times."""

    def apply(batch: DataFrame, nth: int) -> None:
        spark = batch.sparkSession
        files, versions = _versions(spark, target, nth)
        size = sum(files.getContentSummary(p).getLength() for p in _newest(versions).values())
        known = max((n for _, n in versions), default=1)
        wanted = max(known, 1 << max(0, -(-size // bucket_bytes) - 1).bit_length())
        at = F.pmod(F.xxhash64(*keys), F.lit(wanted)).cast("int")
        batch = batch.withColumn("bucket", at)
        # At most as many as there are buckets; the batch is read once more when it is written.
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
        if not touched:
            return
        base = current(spark, target, before=nth, only=touched if wanted == known else None)
        both = batch.withColumn("_new", F.lit(1))
        both = both if base is None else both.unionByName(base.withColumns({"bucket": at, "_new": F.lit(0)}))
        fresh = first_per_key(both, keys, F.desc(order), F.desc("_new")).drop("_new")
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={nth}.{wanted}")
        files, versions = _versions(spark, target, nth + 1)
        for (v, n), own in versions.items():
            for bucket, path in own.items():
                later = sum(1 for (w, m), other in versions.items() if w > v and (m > n or bucket in other))
                if later >= 2:
                    files.delete(path, True)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str, before: int | None = None) -> tuple:
    """The file system of a table, and for each whole version (batch, number of buckets) its buckets' folders."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for s in files.listStatus(path) if files.exists(path) else ():
        name = s.getPath().getName()
        if not (s.isDirectory() and name.startswith("v=")):
            continue
        batch, _, count = name[2:].partition(".")
        inner = {f.getPath().getName(): f.getPath() for f in files.listStatus(s.getPath())}
        if "_SUCCESS" in inner and (before is None or int(batch) < before):
            found[int(batch), int(count)] = {int(n[7:]): p for n, p in inner.items() if n.startswith("bucket=")}
    return files, found


def _newest(versions: dict) -> dict:
    """The folder of each bucket in its newest version; versions of fewer buckets are outgrown."""
    most = max((n for _, n in versions), default=0)
    newest = {}
    for (v, n), own in sorted(versions.items()):
        newest |= own if n == most else {}
    return newest


def current(spark: SparkSession, target: str, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The table with the newest version of each bucket, or the newest before a batch; of some buckets only, if so asked."""
    newest = _newest(_versions(spark, target, before)[1])
    paths = [p.toString() for k, p in sorted(newest.items()) if only is None or k in only]
    return spark.read.parquet(*paths) if paths else None


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type of a stream of events, with a watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def settled(requests: DataFrame, evidence: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Requests that a later row of evidence with the same keys supersedes."""
    last = evidence.groupBy(*keys).agg(F.max(at).alias("_last"))
    return requests.join(last, keys).filter(F.col("_last") > F.col(at)).drop("_last")


class _Settling(StatefulProcessor):
    """What is known of the keys of one bucket: the newest evidence of each, and the requests that wait for a newer one, both as lists
    by column, so that a bucket takes a few calls for all of its keys. Keys are texts (`_text`); no column has nulls."""

    def __init__(self, width: int) -> None:
        self.names = [f"k{i}" for i in range(width)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        lists = ", ".join(f"{k} array<string>" for k in self.names)
        self.newest = handle.getValueState("newest", f"{lists}, at array<long>")
        self.waiting = handle.getListState("waiting", f"{lists}, request array<long>, at array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        newest = {tuple(k): t for *k, t in zip(*(self.newest.get() or ()))}
        out, new, risen, names = [], [], False, [*self.names, "request", "at"]
        for batch in rows:
            for asks, *k, request, at in zip(*(batch[c].tolist() for c in ["asks", *names])):
                last = newest.get(tuple(k))
                if not asks:
                    if last is None or last < at:
                        newest[tuple(k)], risen = at, True
                elif last is not None and at < last:
                    out.append((*k, request, at))
                else:
                    new.append((*k, request, at))
            if len(out) >= PIECE:
                yield pd.DataFrame(out, columns=names)
                out = []
        if risen:
            self.newest.update(tuple(list(c) for c in zip(*((*k, t) for k, t in newest.items()))))
            open_ = []
            for piece in chain((zip(*p) for p in self.waiting.get()), [new]):
                for place in piece:
                    (out if place[-1] < newest.get(place[:-2], place[-1]) else open_).append(place)
                if len(out) >= PIECE:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            self.waiting.clear()
            new = open_
        if out:
            yield pd.DataFrame(out, columns=names)
        for i in range(0, len(new), PIECE):
            self.waiting.appendValue(tuple(list(c) for c in zip(*new[i : i + PIECE])))

    def close(self) -> None:
        pass


def _text(name: str, kind: str) -> tuple[Column, Callable[[str], Column]]:
    """A key's column as a text, equal where Spark's keys are (null and NaN too), and how the key is had back from it."""
    if kind.startswith(("array", "map", "struct", "variant")):
        raise ValueError(f"{name}: keys of type {kind} have no text")
    col, back = F.col(name), lambda text: text.cast(kind)
    if kind in ("float", "double"):
        col = col + F.lit(0.0)  # -0.0 is 0.0
    elif kind == "timestamp":
        col, back = F.unix_micros(name), lambda text: F.timestamp_micros(text.cast("long"))
    elif kind == "binary":
        col, back = F.hex(name), F.unhex
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("")), lambda c: F.when(F.col(c) != "", back(F.substring(c, 2, 2**31 - 1)))


def settled_stream(events: DataFrame, keys: list[str], at: str, request: str, buckets: int = 1024) -> DataFrame:
    """Of a stream of requests (with an id) and pieces of evidence (without), in any order, the requests that evidence of the same
    keys supersedes, each once, as soon as both are there: keys, request, at. What settled() gives for all rows at once. A key's
    state is its newest evidence and the requests that none has superseded yet. Keys share their state in buckets by a hash, as the
    calls for a key cost more than its rows do; a batch reads and writes the buckets that it has rows for. Let a bucket have some
    thousand waiting requests; their number stays as long as the checkpoint. Needs the RocksDB state store."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    if not {kinds[request], kinds[at]} <= {"tinyint", "smallint", "int", "bigint"}:
        raise ValueError(f"{request} and {at} have to be whole numbers")
    texts = [_text(c, kinds[c]) for c in keys]
    names = [f"k{i}" for i in range(len(keys))]
    rows = events.filter(F.col(at).isNotNull()).select(F.col(request).isNotNull().alias("asks"), *(t.alias(k) for k, (t, _) in zip(names, texts)), F.coalesce(F.col(request).cast("long"), F.lit(0)).alias("request"), F.col(at).cast("long").alias("at"))
    grouped = rows.withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(buckets))).groupBy("bucket")
    schema = ", ".join([*(f"{k} string" for k in names), "request long", "at long"])
    found = grouped.transformWithStateInPandas(_Settling(len(keys)), schema, "Append", "None")
    return found.select(*(back(k).alias(c) for k, c, (_, back) in zip(names, keys, texts)), F.col("request").cast(kinds[request]).alias(request), F.col("at").cast(kinds[at]).alias(at))


def rescheduled(anchors: DataFrame, rules: DataFrame) -> DataFrame:
    """The work that hangs on done work (owner, job, at, done_day), with new dates: a row for each rule (ref_job, job, days_min,
    days_max; a dimension) of the job done. For streams too: goes to upsert_stream with owner and job as keys and `at` as order,
    so that of several anchors the latest counts."""
    dim = rules.select(F.col("ref_job").alias("job"), F.col("job").alias("_next"), "days_min", "days_max")
    met = anchors.join(dim, "job")
    return met.select("owner", F.col("_next").alias("job"), "at", F.date_add("done_day", F.col("days_min")).alias("start_day"), F.date_add("done_day", F.col("days_max")).alias("end_day"))
