"""Payments, laggards, missing sets and progress, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import programme as P
from ..operators import relational as R
from ..sources.tables import table
from .registry import query

AS_OF = "1998-06-15"
#: The rate of a kind of part for each hectare, else of a word in its name.
RATES = [("PROMO", None, 310.0, None), ("LARGE", None, 155.0, None), (None, "ring", 77.5, 1), (None, "widget", 12.5, 2)]


@query("""WITH w AS (SELECT l_suppkey, p_size * 100.0 * l_quantity AS area, p_type, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
r AS (SELECT l_suppkey, CASE WHEN p_type = 'PROMO' THEN 310.0 WHEN p_type = 'LARGE' THEN 155.0 WHEN contains(p_name, 'ring') THEN 77.5 WHEN contains(p_name, 'widget') THEN 12.5 END AS rate, round_even(CAST(area AS DOUBLE) / 10000.0, 4) AS ha FROM w)
SELECT l_suppkey, count(*) AS n_items, CAST(sum(CAST(round_even(CAST(rate AS DOUBLE) * 1000 * ha, 0) AS BIGINT)) AS BIGINT) AS total FROM r WHERE rate IS NOT NULL GROUP BY 1""")
def g18_payments(spark, sf_dir):
    """Payments by supplier for returned lines; a part's size times the quantity stands for the area."""
    rates = spark.createDataFrame(RATES, "code string, keyword string, rate double, prio int")
    li, p = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'"), table(spark, sf_dir, "part")
    work = li.join(p, li.l_partkey == p.p_partkey).select("l_suppkey", "p_type", "p_name", (F.col("p_size") * 100.0 * F.col("l_quantity")).alias("area"))
    return P.payments(work, rates, "l_suppkey", "p_type", "area", "p_name")


@query("""SELECT o_custkey, count(*) AS n_open, array_to_string(list_sort(list(o_orderkey))[1:3], ',') AS first_ids FROM orders WHERE o_orderstatus <> 'F' AND abs(date_diff('day', DATE '1998-06-15', CAST(o_orderdate AS DATE))) <= 60 GROUP BY 1 ORDER BY n_open DESC, o_custkey LIMIT 25""")
def g19_laggards(spark, sf_dir):
    """Households with the most open work near a day."""
    todo = table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey"))
    late = P.laggards(todo, "o_custkey", "o_orderdate", F.col("o_orderstatus") == "F", F.lit(AS_OF).cast("date"), 60)
    return late.orderBy(F.desc("n_open"), "o_custkey").limit(25).withColumn("first_ids", F.array_join(F.transform("first_ids", lambda x: x.cast("string")), ","))


@query("""WITH s AS (SELECT user_id, list(DISTINCT event_type) AS got FROM events WHERE ts < TIMESTAMP '2024-01-03 00:00:00' GROUP BY 1), r AS (SELECT user_id, list_filter(['signup', 'purchase', 'view'], lambda x: NOT list_contains(got, x)) AS missing FROM s)
SELECT user_id, array_to_string(missing, ',') AS missing, len(missing) AS n_missing, CASE WHEN len(missing) = 0 THEN 'completed' WHEN len(missing) < 3 THEN 'in_progress' ELSE 'pending' END AS state FROM r""")
def g20_missing_sets(spark, sf_dir):
    """Which of the required kinds of evidence each user lacks, in their order."""
    early = table(spark, sf_dir, "events").filter(F.col("ts") < F.lit("2024-01-03 00:00:00").cast("timestamp"))
    got = early.groupBy("user_id").agg(F.collect_set("event_type").alias("got"))
    required = F.array(*map(F.lit, ("signup", "purchase", "view")))
    out = got.withColumns(P.completeness(required, F.col("got")))
    return out.select("user_id", F.array_join("missing", ",").alias("missing"), F.size("missing").cast("long").alias("n_missing"), "state")


@query("""WITH r AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS need, coalesce(list(DISTINCT l_returnflag) FILTER (l_linestatus = 'F'), []) AS got FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(list_filter(need, lambda x: NOT list_contains(got, x))) = 0 THEN 'completed' WHEN len(got) > 0 THEN 'in_progress' ELSE 'pending' END AS state FROM r""")
def g21_computed_status(spark, sf_dir):
    """The state of work from what it requires and what is submitted."""
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("need"), F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_returnflag"))).alias("got"))
    return r.select("l_orderkey", P.completeness(F.col("need"), F.col("got"))["state"].alias("state"))


@query("""WITH j AS (SELECT o_custkey, o_orderkey, o_orderstatus, count(*) AS required, count(*) FILTER (l_linestatus = 'F') AS submitted FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE least(1.0, CAST(submitted AS DOUBLE) / required) END), 4) AS credit, count(*) AS n FROM j GROUP BY 1""")
def g26_progress(spark, sf_dir):
    """Progress with partial credit by household."""
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("required"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("submitted"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("pending")
    work = table(spark, sf_dir, "orders").join(per, "o_orderkey").withColumn("status", status)
    return work.groupBy("o_custkey").agg(F.round(F.sum(P.credit("status", "submitted", "required")), 4).alias("credit"), F.count("*").alias("n"))


@query("""WITH pool AS (SELECT c_custkey, c_mktsegment FROM customer), a AS (SELECT DISTINCT o_orderpriority FROM orders), s AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), d AS (SELECT o_orderpriority, min(o_orderdate) FILTER (o_orderstatus <> 'F') AS due FROM orders GROUP BY 1)
SELECT a.o_orderpriority, CAST(due AS DATE) AS due, count(*) FILTER (s.o_custkey IS NOT NULL) AS submitted, count(*) FILTER (s.o_custkey IS NULL) AS unsubmitted, min(c_custkey) FILTER (s.o_custkey IS NULL) AS example
FROM a CROSS JOIN pool LEFT JOIN s ON s.o_custkey = c_custkey AND s.o_orderpriority = a.o_orderpriority JOIN d ON d.o_orderpriority = a.o_orderpriority GROUP BY 1, 2""")
def g27_activity_stats(spark, sf_dir):
    """By activity its earliest open due date, and how many of the pool have and haven't submitted. Each of the pool bears the
    activities that it has submitted, and is counted for each activity where it is read; only sums are shuffled."""
    o = table(spark, sf_dir, "orders")
    due = o.groupBy("o_orderpriority").agg(F.to_date(F.min(F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")))).alias("due"))
    activities = R.dimension(o.select("o_orderpriority").distinct(), "o_orderpriority")
    sent = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("sent"))  # activities at most
    pool = table(spark, sf_dir, "customer").select("c_custkey").join(sent, "c_custkey", "left")
    each = pool.select("c_custkey", "sent", F.explode(F.array(*map(F.lit, activities))).alias("o_orderpriority"))
    yes = F.coalesce(F.array_contains("sent", F.col("o_orderpriority")), F.lit(False))
    met = each.groupBy("o_orderpriority").agg(F.count(F.when(yes, 1)).alias("submitted"), F.count(F.when(~yes, 1)).alias("unsubmitted"), F.min(F.when(~yes, F.col("c_custkey"))).alias("example"))
    return met.join(due, "o_orderpriority").select("o_orderpriority", "due", "submitted", "unsubmitted", "example")


@query("""SELECT c_mktsegment, count(DISTINCT c_custkey) AS members, count(DISTINCT o_orderkey) AS n_work, CAST(max(o_orderdate) AS DATE) AS last_due, round(avg(o_totalprice), 2) AS mean_price FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def g28_group_view(spark, sf_dir):
    """Work is summed up for each member before it meets the members; o_orderkey and c_custkey are keys of their tables."""
    work = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("due"), F.sum("o_totalprice").alias("price"), F.count("o_totalprice").alias("priced")
    )
    met = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(work, "c_custkey", "left")
    return met.groupBy("c_mktsegment").agg(
        F.count("c_custkey").alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_work"), F.to_date(F.max("due")).alias("last_due"), F.round(F.sum("price") / F.nullif(F.sum("priced"), F.lit(0)), 2).alias("mean_price")
    )


@query("""SELECT lang, count(*) AS n, round(avg(CASE WHEN (n_chars >= 1500) = (quality = 1) THEN 1.0 ELSE 0.0 END), 4) AS accuracy,
round(count(*) FILTER (n_chars >= 1500 AND quality = 0) / nullif(count(*) FILTER (quality = 0), 0), 4) AS false_ok, round(count(*) FILTER (n_chars < 1500 AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0), 4) AS false_reject
FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def g32_model_eval(spark, sf_dir):
    """A rule (long texts are good) held against labels, by language: accuracy and both kinds of error."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    ok, good = F.col("n_chars") >= 1500, F.col("quality") == 1
    n = lambda c: F.count(F.when(c, 1))
    return d.groupBy("lang").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(ok == good, 1.0).otherwise(0.0)), 4).alias("accuracy"),
        F.round(F.try_divide(n(ok & ~good), n(~good)), 4).alias("false_ok"),
        F.round(F.try_divide(n(~ok & good), n(good)), 4).alias("false_reject"),
    )


@query("""WITH r AS (SELECT lang, length(text) AS len, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, min(len) AS low, max(len) AS high, round(avg(len), 2) AS mean, max(len) FILTER (i = CAST(floor(n * 0.25) AS BIGINT)) AS q25, max(len) FILTER (i = CAST(floor(n * 0.5) AS BIGINT)) AS q50, max(len) FILTER (i = CAST(floor(n * 0.95) AS BIGINT)) AS q95 FROM r GROUP BY 1""")
def g33_length_stats(spark, sf_dir):
    """Lengths by language with quantiles by index: floor(n * q) from 0. Equal lengths are counted first, so that what
    is ranked are the different lengths of a language and not its documents."""
    sizes = table(spark, sf_dir, "documents").groupBy("lang", F.char_length("text").alias("len")).agg(F.count("*").alias("m"))
    from pyspark.sql import Window

    w = Window.partitionBy("lang")
    r = sizes.withColumns({"upto": F.sum("m").over(w.orderBy("len")), "n": F.sum("m").over(w)})
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("len")))
    return r.groupBy("lang").agg(
        F.min("len").cast("long").alias("low"), F.max("len").cast("long").alias("high"), F.round(F.sum(F.col("len") * F.col("m")) / F.max("n"), 2).alias("mean"),
        at(0.25).cast("long").alias("q25"), at(0.5).cast("long").alias("q50"), at(0.95).cast("long").alias("q95"),
    )


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'F'), l AS (SELECT user_id, max(CAST(ts AS DATE)) AS last_log FROM events GROUP BY 1)
SELECT c_custkey, CASE WHEN o_orderdate < DATE '1996-01-01' THEN 'OVERDUE' WHEN last_log IS NULL THEN 'NO_LOG' WHEN last_log < DATE '2024-01-25' THEN 'SILENT' WHEN o_orderkey IS NOT NULL THEN 'NEXT' ELSE 'REST' END AS scenario
FROM customer LEFT JOIN o ON o_custkey = c_custkey AND r = 1 LEFT JOIN l ON user_id = c_custkey""")
def r1_rules(spark, sf_dir):
    """The first rule that fits a household, from its next open work and its last log entry."""
    still = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", "o_orderdate")
    due = R.first_per_key(still, ["o_custkey"], F.asc("o_orderdate"), F.asc("o_orderkey"))
    log = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("last_log"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    met = c.join(due, F.col("c_custkey") == F.col("o_custkey"), "left").join(log, F.col("c_custkey") == F.col("user_id"), "left")
    day = lambda d: F.lit(d).cast("date")
    rule = F.when(F.col("o_orderdate") < day("1996-01-01"), "OVERDUE").when(F.col("last_log").isNull(), "NO_LOG").when(F.col("last_log") < day("2024-01-25"), "SILENT").when(F.col("o_orderkey").isNotNull(), "NEXT").otherwise("REST")
    return met.select("c_custkey", rule.alias("scenario"))


@query("""SELECT o_custkey, count(*) AS n_work, CAST(sum(len(js)) AS BIGINT) AS n_jobs FROM (SELECT o_custkey, o_orderkey, list(l_linenumber) FILTER (l_linenumber IS NOT NULL) AS js FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY 1""")
def z5_nested_catalogue(spark, sf_dir):
    """Work with its nested jobs, and the sizes of both lists."""
    jobs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("jobs"))
    work = table(spark, sf_dir, "orders").join(jobs, "o_orderkey", "left")
    nested = work.groupBy("o_custkey").agg(F.count("*").alias("n_work"), F.sum(F.size(F.col("jobs"))).alias("n_jobs_or_less"), F.sum(F.when(F.col("jobs").isNotNull(), F.size("jobs"))).alias("n_jobs"))
    return nested.select("o_custkey", "n_work", "n_jobs")
