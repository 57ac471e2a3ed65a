"""Joins, counts, ranking, set operations and writes, bound to the driver's tables: customers are households, orders their
scheduled work (F done, P doing, O open), lineitems its jobs, events the activity log, nations the villages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import table
from .registry import query

AS_OF = "1998-06-15"


@query("""
SELECT c_custkey, n_name AS village, coalesce(n_work, 0) AS n_work, coalesce(n_done, 0) AS n_done, coalesce(n_late, 0) AS n_late,
       coalesce(n_jobs, 0) AS n_jobs, CASE WHEN coalesce(n_work, 0) > 0 THEN round(n_done / n_work, 4) ELSE 0.0 END AS ratio
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_work, count(*) FILTER (o_orderstatus = 'F') AS n_done,
                  count(*) FILTER (o_orderstatus <> 'F' AND o_orderdate < DATE '1998-06-15') AS n_late FROM orders GROUP BY 1) o ON o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_jobs FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) l ON l.o_custkey = c_custkey
""")
def g1_entity_summary(spark, sf_dir):
    """Households with their work counted in parts that are aggregated before they are joined."""
    orders = table(spark, sf_dir, "orders")
    work = orders.groupBy("o_custkey").agg(
        F.count("*").alias("n_work"),
        F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_done"),
        F.count(F.when((F.col("o_orderstatus") != "F") & (F.col("o_orderdate") < F.lit(AS_OF).cast("date")), 1)).alias("n_late"),
    )
    per_order = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    jobs = orders.select("o_orderkey", "o_custkey").join(per_order, "o_orderkey").groupBy("o_custkey").agg(F.sum("n").alias("n_jobs"))
    base = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    base = base.select("c_custkey", F.col("n_name").alias("village"), F.col("c_custkey").alias("o_custkey"))
    out = R.counted(base, ["o_custkey"], work, jobs)
    ratio = F.when(F.col("n_work") > 0, F.round(F.col("n_done") / F.col("n_work"), 4)).otherwise(0.0)
    return out.select("c_custkey", "village", "n_work", "n_done", "n_late", "n_jobs", ratio.alias("ratio"))


@query("""SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n_villages, count(DISTINCT o_orderkey) AS n_work, count(DISTINCT (o_custkey, o_orderpriority)) AS n_pairs
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def g2_group_counts(spark, sf_dir):
    """Distinct counts by group, one of them of pairs (as a struct, so that nulls count as values)."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    joined = c.join(o, F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_mktsegment").agg(
        F.countDistinct("c_nationkey").alias("n_villages"), F.countDistinct("o_orderkey").alias("n_work"), F.count_distinct(F.struct("o_custkey", "o_orderpriority")).alias("n_pairs")
    )


@query("SELECT l_returnflag, count(DISTINCT (l_partkey, l_suppkey, l_linenumber)) AS n FROM lineitem GROUP BY 1")
def g3_rowvalue_distinct(spark, sf_dir):
    """Distinct rows of three columns by group."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct(F.struct("l_partkey", "l_suppkey", "l_linenumber")).alias("n"))


@query("""SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS DATE) AS last_done,
CASE WHEN count(*) = count(*) FILTER (o_orderstatus = 'F') THEN 'END' WHEN count(*) FILTER (o_orderstatus IN ('F', 'P')) > 0 THEN 'ING'
     WHEN min(o_orderdate) < DATE '1998-06-15' THEN 'DLY' ELSE 'PRE' END AS status FROM orders GROUP BY 1""")
def g5_status_from_agg(spark, sf_dir):
    """A status from the counts and dates of each household's work."""
    done = F.col("o_orderstatus") == "F"
    agg = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("a"), F.max(F.when(done, F.col("o_orderdate"))).alias("b"), F.count("*").alias("n"), F.count(F.when(done, 1)).alias("d"), F.count(F.when(F.col("o_orderstatus").isin("F", "P"), 1)).alias("w")
    )
    status = F.when(F.col("n") == F.col("d"), "END").when(F.col("w") > 0, "ING").when(F.col("a") < F.lit(AS_OF).cast("date"), "DLY").otherwise("PRE")
    return agg.select("o_custkey", F.to_date("a").alias("first_day"), F.to_date("b").alias("last_done"), status.alias("status"))


def _jobs(spark, sf_dir):
    status = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") == "N", "doing").otherwise("done")).otherwise("open")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", status.alias("status"), F.to_date("l_shipdate").alias("last_end"))


_L2 = """WITH j AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'N' THEN 'doing' ELSE 'done' END ELSE 'open' END AS s, CAST(l_shipdate AS DATE) AS e FROM lineitem),
l2 AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (s = 'done') AS n_done, count(*) FILTER (s = 'doing') AS n_doing,
  CASE WHEN count(*) = count(*) FILTER (s = 'done') THEN max(e) END AS last_end,
  CASE WHEN count(*) = count(*) FILTER (s = 'done') THEN 'done' WHEN count(*) FILTER (s IN ('done', 'doing')) > 0 THEN 'doing' ELSE 'open' END AS status,
  round(100.0 * count(*) FILTER (s = 'done') / nullif(count(*), 0), 1) AS rate FROM j GROUP BY 1)"""
_UP = """SELECT {k}, count(*) AS n, count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'doing') AS n_doing,
  CASE WHEN count(*) = count(*) FILTER (status = 'done') THEN max(last_end) END AS last_end,
  CASE WHEN count(*) = count(*) FILTER (status = 'done') THEN 'done' WHEN count(*) FILTER (status IN ('done', 'doing')) > 0 THEN 'doing' ELSE 'open' END AS status,
  round(CAST(100.0 * count(*) FILTER (status = 'done') AS DOUBLE) / nullif(count(*), 0), 1) AS rate"""


@query(f"{_L2} SELECT * FROM l2")
def g6_rollup_l2(spark, sf_dir):
    """Work from its jobs."""
    return R.status_rollup(_jobs(spark, sf_dir), ["l_orderkey"], "status", "last_end")


@query(f"{_L2} {_UP.format(k='o_custkey')} FROM l2 JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def g7_rollup_l3(spark, sf_dir):
    """Households from their work."""
    work = g6_rollup_l2(spark, sf_dir).select("l_orderkey", "status", "last_end")
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return R.status_rollup(work.join(owners, F.col("l_orderkey") == F.col("o_orderkey")), ["o_custkey"], "status", "last_end")


@query(f"{_L2}, l3 AS ({_UP.format(k='o_custkey')} FROM l2 JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) {_UP.format(k='c_nationkey')} FROM l3 JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def g8_rollup_l4(spark, sf_dir):
    """Villages from their households."""
    homes = g7_rollup_l3(spark, sf_dir).select("o_custkey", "status", "last_end")
    where = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return R.status_rollup(homes.join(where, F.col("o_custkey") == F.col("c_custkey")), ["c_nationkey"], "status", "last_end")


@query("SELECT user_id, max(ts) AS last_ts FROM events GROUP BY 1")
def g9_latest_per_key(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE json_valid(props) AND json_extract(props, '$.k') IS NOT NULL GROUP BY 1")
def g10_json_counts(spark, sf_dir):
    """Counts by a field of JSON texts; malformed ones and those without the field don't count."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select(k.alias("k")).filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-20 00:00:00') AS n_since FROM events GROUP BY 1")
def g11_counts_since(spark, sf_dir):
    since = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.when(F.col("ts") >= since, 1)).alias("n_since"))


@query("SELECT count(*) FILTER (event_type = 'error') AS n_unread, count(*) AS n FROM events")
def g12_unread(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("n_unread"), F.count("*").alias("n"))


@query("SELECT s_suppkey, s_name, s_nationkey, count(l_suppkey) AS n_lines FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL")
def g13_leftjoin_count(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_lines"))
    return R.counted(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), ["s_suppkey"], n)


@query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_homes FROM nation")
def g14_scalar_subquery(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_homes"))
    return R.counted(table(spark, sf_dir, "nation").select("n_nationkey"), ["n_nationkey"], n)


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def g15_counts_desc(spark, sf_dir):
    """Counts by type, largest first; the total is a sum over the few counts."""
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("share")).orderBy(F.desc("n"), "event_type")


@query("SELECT c_nationkey, count(*) AS n_open FROM orders JOIN customer ON o_custkey = c_custkey WHERE coalesce(o_orderstatus, '') NOT IN ('F') GROUP BY 1")
def g16_pending_by_village(spark, sf_dir):
    """Open work by village; work of unknown status is open."""
    still = table(spark, sf_dir, "orders").filter(~F.coalesce(F.col("o_orderstatus"), F.lit("")).isin("F"))
    return still.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n_open"))


@query("""SELECT n_regionkey, CAST(sum(n) AS BIGINT) AS n_work, count(*) FILTER (n > 5) AS n_active FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n_work DESC, n_active DESC""")
def g17_dashboard(spark, sf_dir):
    """Sums of sums, and how many households are active."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    where = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    out = n.join(where, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_regionkey").agg(F.sum("n").alias("n_work"), F.count(F.when(F.col("n") > 5, 1)).alias("n_active"))
    return out.orderBy(F.desc("n_work"), F.desc("n_active"))


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus IN ('P', 'O') THEN 'open' ELSE 'unknown' END AS status FROM orders""")
def g22_status_default(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus").isin("P", "O"), "open").otherwise("unknown")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", status.alias("status"))


@query("""SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority) AS priorities, count(*) AS n FROM orders GROUP BY 1""")
def g23_listagg(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), " | ").alias("priorities"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, count(*) AS n, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def g24_evidence_summary(spark, sf_dir):
    """An ordered list for each work item, aggregated before the join."""
    parts = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda p: p["l_linenumber"].cast("string")), ",").alias("lines"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(per, "o_orderkey")


@query("""SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS start_day, CAST(max(o_orderdate) AS DATE) AS end_day, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority FROM orders GROUP BY 1""")
def g25_first_last(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("start_day"), F.to_date(F.max("o_orderdate")).alias("end_day"), F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("first_priority")
    )


@query("""WITH h AS (SELECT c_nationkey, o_custkey, 100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) AS rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_nationkey, count(*) FILTER (rate >= 50) AS good, count(*) FILTER (rate >= 25 AND rate < 50) AS mid, count(*) FILTER (rate < 25) AS behind, count(DISTINCT o_custkey) AS n_homes, round(avg(rate), 2) AS mean_rate FROM h GROUP BY 1""")
def g29_pulse(spark, sf_dir):
    """Households in three classes by their rate, counted by village."""
    done = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    rates = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((100.0 * done / F.count("*")).alias("rate"))
    homes = rates.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    r = F.col("rate")
    return homes.groupBy("c_nationkey").agg(
        F.count(F.when(r >= 50, 1)).alias("good"), F.count(F.when((r >= 25) & (r < 50), 1)).alias("mid"), F.count(F.when(r < 25, 1)).alias("behind"), F.count("*").alias("n_homes"), F.round(F.avg("rate"), 2).alias("mean_rate")
    )


@query("SELECT e.event_id, u.c_name, u.c_mktsegment FROM events e JOIN customer u ON e.user_id = u.c_custkey")
def j1_inner(spark, sf_dir):
    e, u = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    return e.join(u, e.user_id == u.c_custkey).select("event_id", "c_name", "c_mktsegment")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_shipdate < o_orderdate THEN 'EARLY' WHEN o_orderstatus = l_linestatus THEN 'MATCH' ELSE 'MISMATCH' END AS verdict
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def j3_case_both_sides(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    verdict = F.when(F.col("l_shipdate") < F.col("o_orderdate"), "EARLY").when(F.col("o_orderstatus") == F.col("l_linestatus"), "MATCH").otherwise("MISMATCH")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_partkey", verdict.alias("verdict"))


@query("SELECT event_id, CASE WHEN o_orderkey IS NULL THEN 'GENERAL' ELSE 'PROJECT' END AS kind FROM events LEFT JOIN orders ON event_id = o_orderkey AND user_id % 3 = o_custkey % 3")
def j4_null_side(spark, sf_dir):
    """A left join on two keys; what finds no partner is general."""
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    met = e.join(o, (e.event_id == o.o_orderkey) & (e.user_id % 3 == o.o_custkey % 3), "left")
    return met.select("event_id", F.when(F.col("o_orderkey").isNull(), "GENERAL").otherwise("PROJECT").alias("kind"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority, c_name, n_name, r_name, p_name, s_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
WHERE o_orderstatus = 'P' AND l_returnflag = 'R' ORDER BY o_orderdate DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100""")
def j5_star_board(spark, sf_dir):
    """A board of the newest hundred jobs with seven dimensions: the fact is filtered and cut before most joins."""
    li = table(spark, sf_dir, "lineitem").filter(R.conjunction(l_returnflag="R"))
    o = table(spark, sf_dir, "orders").filter(R.conjunction(o_orderstatus="P"))
    top = li.join(o, li.l_orderkey == o.o_orderkey).orderBy(F.desc_nulls_last("o_orderdate"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(100)
    out = top
    for name, key, own in (("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey"), ("part", "l_partkey", "p_partkey"), ("supplier", "l_suppkey", "s_suppkey")):
        out = out.join(table(spark, sf_dir, name), F.col(key) == F.col(own), "left")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "o_orderpriority", "c_name", "n_name", "r_name", "p_name", "s_name")


@query("SELECT a.n_name AS village, b.n_name AS twin FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j10_self_join(spark, sf_dir):
    a, b = table(spark, sf_dir, "nation").alias("a"), table(spark, sf_dir, "nation").alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("village"), F.col("b.n_name").alias("twin"))


@query("""WITH q AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events), m AS (SELECT key, c_custkey, c_mktsegment FROM q JOIN customer ON key = CAST(c_custkey AS VARCHAR) OR key = CAST(c_nationkey AS VARCHAR))
SELECT key, c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (c_mktsegment = 'BUILDING') DESC, c_custkey) AS r FROM m) WHERE r = 1""")
def j11_or_lookup(spark, sf_dir):
    """Free-form keys resolved against two columns; a preferred segment first, then the least id."""
    keys = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key")).distinct()
    found = R.either_key(keys, "key", table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey"], F.desc(F.col("c_mktsegment") == "BUILDING"), F.asc("c_custkey"))
    return found.select("key", "c_custkey", "c_mktsegment")


@query("""WITH e AS (SELECT event_id, user_id, event_id AS a, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), o AS (SELECT o_orderkey, o_custkey AS user_id, o_orderkey AS a, o_orderkey % 100 AS k FROM orders)
SELECT event_id, o_orderkey, min(rung) AS rung FROM (SELECT event_id, o_orderkey, 1 AS rung FROM e JOIN o USING (a, k) UNION ALL SELECT event_id, o_orderkey, 2 FROM e JOIN o ON e.k = o.k AND e.user_id = o.user_id) GROUP BY ALL""")
def j12_ladder(spark, sf_dir):
    """Log entries and work that agree on one of two rungs of keys."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("a"), k.alias("k"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("a"), (F.col("o_orderkey") % 100).alias("k"))
    return R.ladder(e, o, [["a", "k"], ["k", "user_id"]], "event_id", "o_orderkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS engaged FROM customer")
def j13_exists_flag(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct()
    return table(spark, sf_dir, "customer").join(keys, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.col("k").isNotNull().alias("engaged"))


@query("SELECT count(*) AS n_silent FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1998-06-15' - 700)")
def j14_anti_count(spark, sf_dir):
    recent = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.date_sub(F.lit(AS_OF).cast("date"), 700))
    return table(spark, sf_dir, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("n_silent"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey IN (1, 5, 9, 200) AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def j16_range_and_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(R.conjunction(o_custkey=[1, 5, 9, 200], o_orderstatus=None))
    return o.filter(F.col("o_orderdate").between(F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date"))).select("o_orderkey", "o_orderdate")


@query("""SELECT o_custkey, coalesce(arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderdate >= DATE '1998-06-15'), arg_max(o_orderkey, (o_orderdate, o_orderkey))) AS o_orderkey FROM orders GROUP BY 1""")
def j17_nearest_future(spark, sf_dir):
    """The next work item from a day on, or else the last."""
    o = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    now = F.struct(F.lit(AS_OF).cast("timestamp").alias("o_orderdate"), F.lit(-1).cast("long").alias("o_orderkey"))
    return R.next_or_last(o, ["o_custkey"], "at", now, "o_orderkey")


@query("SELECT n_nationkey, p_type, l AS job_seq FROM nation CROSS JOIN (SELECT DISTINCT p_type FROM part) CROSS JOIN (SELECT unnest(range(1, 4)) AS l)")
def j18_fanout(spark, sf_dir):
    """Villages times kinds times job templates, all of them small dimensions."""
    kinds = table(spark, sf_dir, "part").select("p_type").distinct()
    jobs = spark.range(1, 4).select(F.col("id").alias("job_seq"))
    return table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(kinds).crossJoin(jobs)


@query("""SELECT e.event_id, n + row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS seq FROM events e JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1) b USING (user_id) WHERE e.event_type = 'error'""")
def n2_next_seq(spark, sf_dir):
    """New rows numbered on from the largest number of their key."""
    e = table(spark, sf_dir, "events")
    base = e.filter("event_type <> 'error'").groupBy("user_id").agg(F.count("*").alias("seq"))
    fresh = e.filter("event_type = 'error'").select("event_id", "user_id").join(base.select("user_id"), "user_id", "left_semi")
    return R.numbered_after(fresh, base, ["user_id"], "seq", F.asc("event_id")).select("event_id", "seq")


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) - DATE '2024-01-01' AS n FROM events), i AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS g FROM d)
SELECT user_id, CAST(min(n) AS INT) AS first, CAST(max(n) AS INT) AS last, count(*) AS n FROM i GROUP BY user_id, g""")
def n11_runs(spark, sf_dir):
    """Runs of consecutive active days of each user."""
    days = table(spark, sf_dir, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"))
    return R.runs(days, ["user_id"], "day")


@query("""SELECT * EXCLUDE (r) FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def n1_first_per_key(spark, sf_dir):
    return R.first_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderstatus = 'F', o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def t1_topk(spark, sf_dir):
    """Mixed directions and a condition as a sort key; each task keeps its own fifty."""
    return table(spark, sf_dir, "orders").orderBy(F.col("o_orderstatus") == "F", F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice", "o_orderdate")


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS village FROM customer ORDER BY village ASC NULLS LAST, c_custkey")
def t3_nulls_last(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("village")).orderBy(F.asc_nulls_last("village"), "c_custkey")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def t5_page(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").offset(40).limit(20).select("p_partkey", "p_name")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events")
def u1_union_all(spark, sf_dir):
    parts = [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("orders", "customer", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH w AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS p FROM orders WHERE o_orderstatus <> 'F'), h AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS p FROM orders WHERE o_orderdate < DATE '1997-01-01')
SELECT k, p, 'add' AS action FROM (SELECT * FROM w EXCEPT SELECT * FROM h) UNION ALL SELECT k, p, 'delete' FROM (SELECT * FROM h EXCEPT SELECT * FROM w)""")
def u2_diff(spark, sf_dir):
    """What to add to and what to delete from a set of keys to make it the wanted one."""
    o = table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "k", "o_orderpriority": "p"})
    return R.keyed_difference(o.filter("o_orderstatus <> 'F'"), o.filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("date")), ["k", "p"])


@query("""SELECT 'review' AS kind, event_id AS id, user_id FROM events WHERE event_type = 'error' UNION ALL SELECT 'nudge', o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < DATE '1996-01-01'""")
def u3_inbox(spark, sf_dir):
    """Two queues of different shape in one inbox."""
    review = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.lit("review").alias("kind"), F.col("event_id").alias("id"), "user_id")
    late = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("date")))
    return review.unionByName(late.select(F.lit("nudge").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id")))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def u4_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT c_nationkey, c_mktsegment, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS first_id, c_custkey AS id, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer")
def u6_grid_dedupe(spark, sf_dir):
    """The first of each cell, and with it each of the ids that share the cell, a row each: a cell may hold a third of all rows, so
    it is summed up and joined back, never one list or one window."""
    c = table(spark, sf_dir, "customer")
    cells = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first_id"), F.count("*").alias("n"))
    same = F.col("c.c_nationkey").eqNullSafe(F.col("f.c_nationkey")) & F.col("c.c_mktsegment").eqNullSafe(F.col("f.c_mktsegment"))
    return c.alias("c").join(cells.alias("f"), same).select("c.c_nationkey", "c.c_mktsegment", "first_id", F.col("c_custkey").alias("id"), "n")


@query("""WITH new AS (SELECT o_custkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'P'),
base AS (SELECT o_custkey, o_orderpriority, min(o_totalprice) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, o_totalprice FROM new WHERE r = 1 UNION ALL SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.o_custkey = b.o_custkey AND n.o_orderpriority = b.o_orderpriority)""")
def w1_upsert(spark, sf_dir):
    """A keyed table with newer rows in place of the old; the latest of several counts."""
    o = table(spark, sf_dir, "orders")
    base = o.filter("o_orderstatus = 'F'").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_totalprice").alias("o_totalprice"))
    return R.upsert(base, o.filter("o_orderstatus = 'P'"), ["o_custkey", "o_orderpriority"], F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("SELECT event_id, event_type, CASE WHEN event_type = 'error' AND value < 10 THEN TIMESTAMP '2024-02-01 00:00:00' END AS deleted_dt FROM events")
def w4_soft_delete(spark, sf_dir):
    """A conditional update; a row whose condition is null stays as it is."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.lit(None).cast("timestamp").alias("deleted_dt"))
    return R.updated(e, (F.col("event_type") == "error") & (F.col("value") < 10), deleted_dt=F.lit("2024-02-01 00:00:00").cast("timestamp")).drop("value")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type = 'error' THEN 'closed' ELSE 'open' END AS status FROM events""")
def w5_json_update(spark, sf_dir):
    """A field set in the JSON text of some rows, and read back."""
    old = F.from_json("props", "map<string,string>")
    new = F.to_json(F.map_concat(F.coalesce(old, F.create_map().cast("map<string,string>")), F.create_map(F.lit("status"), F.when(F.col("event_type") == "error", "closed").otherwise("open"))))
    e = table(spark, sf_dir, "events").withColumn("props", new)
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.status").alias("status"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O')")
def w6_cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return table(spark, sf_dir, "lineitem").join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'")
def w8_retention(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp")).select("event_id", "ts")


@query("""SELECT coalesce(o_custkey, user_id) AS k, coalesce(n_work, 0) AS n_work, coalesce(n_log, 0) AS n_log, CASE WHEN coalesce(n_work, 0) = 0 THEN 50.0 ELSE round(100.0 * n_done / n_work, 1) END AS rate
FROM (SELECT o_custkey, count(*) AS n_work, count(*) FILTER (o_orderstatus = 'F') AS n_done FROM orders GROUP BY 1) o FULL JOIN (SELECT user_id, count(*) AS n_log FROM events GROUP BY 1) e ON o_custkey = user_id""")
def z23_full_union(spark, sf_dir):
    """Work and log of each household, also of those with only one of the two."""
    work = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_work"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_done"))
    log = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n_log"))
    both = work.join(log, "k", "full")
    rate = F.when(F.coalesce("n_work", F.lit(0)) == 0, 50.0).otherwise(F.round(100.0 * F.col("n_done") / F.col("n_work"), 1))
    return both.select("k", F.coalesce("n_work", F.lit(0)).alias("n_work"), F.coalesce("n_log", F.lit(0)).alias("n_log"), rate.alias("rate"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderkey IS NULL THEN 'unknown work' WHEN l_linenumber < 1 THEN 'bad number' WHEN l_shipdate < o_orderdate THEN 'ends before it starts' END AS reason FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL OR l_linenumber < 1 OR l_shipdate < o_orderdate")
def z20_rejects(spark, sf_dir):
    """Rows that fail a reference or a range, with the reason."""
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    reason = F.when(F.col("o_orderkey").isNull(), "unknown work").when(F.col("l_linenumber") < 1, "bad number").when(F.col("l_shipdate") < F.col("o_orderdate"), "ends before it starts")
    return met.select("l_orderkey", "l_linenumber", "l_partkey", reason.alias("reason")).filter("reason is not null")
