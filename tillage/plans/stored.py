"""Files and streams: tables written in other forms, some of it damaged, and read again; keyed state over micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as T
from ..sources.tables import new_folder, table
from ..streaming.slots import current, settled_stream, upsert_stream
from .registry import query


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 50 <> 0")
def s5_json_scan(spark, sf_dir):
    """Rows of JSON files, of which every fiftieth breaks off."""
    e, path = table(spark, sf_dir, "events"), new_folder(spark, "s5")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    e.select(F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    return T.json_rows(spark, path, "event_id long, event_type string, value double", lines=True)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'U' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 10 = 1")
def s6_json_upsert(spark, sf_dir):
    """JSON files with the rows of a batch in place of those of the same keys, which take the place of the files."""
    o, path, kind = table(spark, sf_dir, "orders"), new_folder(spark, "s6"), "o_orderkey long, status string"
    o.select("o_orderkey", F.col("o_orderstatus").alias("status")).write.json(path)
    new = o.filter("o_orderkey % 10 = 0").select("o_orderkey", F.lit("U").alias("status")).unionByName(o.filter("o_orderkey % 10 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("status")))
    T.json_upsert(new, path, kind, ["o_orderkey"])
    return T.json_rows(spark, path, kind, lines=True)


@query("SELECT 'conv-' || conv_id AS source_file, CAST(turn AS VARCHAR) AS chunk_id, role AS section, text FROM conversations WHERE length(trim(text)) >= 20")
def s7_chunk_files(spark, sf_dir):
    """The chunks of stored documents, without short ones."""
    c, path = table(spark, sf_dir, "conversations"), new_folder(spark, "s7")
    chunk = F.struct(F.col("turn").cast("string").alias("chunk_id"), F.lit("").alias("title"), F.col("role").alias("section"), "text")
    stored = c.groupBy("conv_id").agg(F.collect_list(chunk).alias("chunks")).select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("source_file"), "chunks")
    stored.write.json(path)
    return T.chunk_files(spark, path, lines=True).select("source_file", "chunk_id", "section", "text")


@query("""SELECT 'm' || m AS model, p_name AS file, p_type AS expected, CASE WHEN p_size % (m + 1) = 0 THEN 'REJECT' ELSE 'OK' END AS status, p_size AS latency_ms, CASE WHEN p_size % 7 = 0 THEN 'a "quoted", error' END AS error FROM part CROSS JOIN (VALUES (1), (2)) t(m)""")
def s15_csv_log(spark, sf_dir):
    """Evaluation results, added to CSV files model by model, and read again."""
    p, path = table(spark, sf_dir, "part"), new_folder(spark, "s15")
    for m in (1, 2):
        status = F.when(F.col("p_size") % (m + 1) == 0, "REJECT").otherwise("OK")
        none = F.lit(None).cast("int")
        T.append_evaluations(p.select(F.lit(f"m{m}").alias("model"), F.col("p_name").alias("file"), F.col("p_type").alias("expected"), status.alias("status"), F.col("p_size").alias("latency_ms"), none.alias("prompt_tokens"), none.alias("completion_tokens"), F.when(F.col("p_size") % 7 == 0, 'a "quoted", error').alias("error")), path)
    return T.evaluation_rows(spark, path).select("model", "file", "expected", "status", "latency_ms", "error")


def arriving(spark, sf_dir, name, *columns):
    """The events as a stream of several micro-batches."""
    path = new_folder(spark, name)
    table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", *columns).repartition(4, "event_id").write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def m1_slots(spark, sf_dir):
    """The newest value of each slot, upserted micro-batch by micro-batch."""
    target = new_folder(spark, "m1")
    upsert_stream(arriving(spark, sf_dir, "m1-in", "value"), target, ["user_id", "event_type"], "event_id", f"{target}-state").awaitTermination()
    return current(spark, target).select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_id AS request, event_id AS "at" FROM events r WHERE event_type = 'error' AND event_id < (SELECT max(event_id) FROM events e WHERE e.user_id = r.user_id AND e.event_type = 'purchase')""")
def m2_superseded(spark, sf_dir):
    """Requests that later evidence supersedes, as a stream with keyed state."""
    out, store = new_folder(spark, "m2"), "spark.sql.streaming.stateStore.providerClass"
    known = arriving(spark, sf_dir, "m2-in").filter("event_type IN ('error', 'purchase')")
    events = known.select("user_id", F.when(F.col("event_type") == "error", F.col("event_id")).alias("request"), F.col("event_id").alias("at"))
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = settled_stream(events, ["user_id"], "at", "request", buckets=max(256, T.stored_bytes(spark, f"{sf_dir}/events.parquet") >> 17))
        found.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.schema(found.schema).parquet(out)
