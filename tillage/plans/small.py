"""Smaller queries: geographic residuals, formatted ids, buckets of days and times, numbers in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import seasons as S
from ..sources.tables import Statement, execute, execute_many, new_folder, table
from .registry import query


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
WHERE round(2 * 6371000.0 * asin(sqrt(pow(sin(radians((34.0 + (s_suppkey % 10) / 10.0) - (34.0 + (p_partkey % 10) / 10.0)) / 2), 2))), 1) > 50000""")
def j23_geo_residual(spark, sf_dir):
    """Equi-joins, then what lies too far apart."""
    li, p, s = (table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier"))
    met = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    metres = S.haversine(34.0 + (F.col("p_partkey") % 10) / 10.0, F.lit(0.0), 34.0 + (F.col("s_suppkey") % 10) / 10.0, F.lit(0.0))
    return met.filter(F.round(metres, 1) > 50000).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT n_nationkey, 'V' || lpad(CAST(max(c_custkey) + 1 AS VARCHAR), 8, '0') AS next_id FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def n3_next_formatted_id(spark, sf_dir):
    """The next id of each village, with a prefix and leading zeros."""
    last = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("c_custkey").alias("m"))
    known = last.join(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")
    return known.select("n_nationkey", F.concat(F.lit("V"), F.lpad((F.col("m") + 1).cast("string"), 8, "0")).alias("next_id"))


@query("""SELECT o_orderkey, CASE WHEN d < 0 THEN 'overdue' WHEN d = 0 THEN 'today' WHEN d <= 7 THEN 'D-' || CAST(d AS VARCHAR) ELSE 'later' END AS bucket
FROM (SELECT o_orderkey, date_diff('day', DATE '1998-06-15', CAST(o_orderdate AS DATE)) AS d FROM orders)""")
def x16_days_left(spark, sf_dir):
    """Days left, in words."""
    d = F.datediff(F.to_date("o_orderdate"), F.lit("1998-06-15").cast("date"))
    text = F.when(d < 0, "overdue").when(d == 0, "today").when(d <= 7, F.concat(F.lit("D-"), d.cast("string"))).otherwise("later")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("bucket"))


@query("""SELECT event_id, CASE WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || ' min' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || ' h' WHEN s < 604800 THEN CAST(s // 86400 AS VARCHAR) || ' d' ELSE strftime(ts, '%Y-%m-%d') END AS ago
FROM (SELECT event_id, ts, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts)) AS BIGINT) AS s FROM events)""")
def z9_relative_time(spark, sf_dir):
    """How long ago, in the largest unit that fits."""
    gone = F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    s = F.floor(gone / 1000000)
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.lit(f" {name}"))
    text = F.when(s < 3600, unit(60, "min")).when(s < 86400, unit(3600, "h")).when(s < 604800, unit(86400, "d")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("ago"))


@query(r"SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9]', '', 'g') AS BIGINT) AS amount FROM events")
def e16_numbers(spark, sf_dir):
    """A number from a text with other signs; null where there is none."""
    return table(spark, sf_dir, "events").select("event_id", F.regexp_replace("props", "[^0-9]", "").try_cast("bigint").alias("amount"))


@query("""SELECT user_id, count(*) FILTER (ts >= coalesce(seen, TIMESTAMP '2024-01-24 00:00:00')) AS n_new FROM events LEFT JOIN (SELECT user_id AS u, max(ts) FILTER (event_type = 'signup') AS seen FROM events GROUP BY 1) ON u = user_id GROUP BY 1""")
def z17_last_seen_default(spark, sf_dir):
    """What is new since the last visit, or for a week where there was none."""
    e = table(spark, sf_dir, "events")
    seen = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("seen"))
    since = F.coalesce("seen", F.lit("2024-01-24 00:00:00").cast("timestamp_ntz" if dict(e.dtypes)["ts"] == "timestamp_ntz" else "timestamp"))
    return e.join(seen, "user_id").groupBy("user_id").agg(F.count(F.when(F.col("ts") >= since, 1)).alias("n_new"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def s1_scan(spark, sf_dir):
    """A selection and a projection; both reach the scan."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT event_type, count(*) FILTER (value < 10) AS n_updated, count(*) FILTER (value > 90) AS n_deleted, count(*) AS n, count(*) FILTER (value <= 90 OR value IS NULL) AS n_after, count(*) FILTER (value < 10) AS n_zero FROM events GROUP BY 1""")
def s2_affected(spark, sf_dir):
    """A batch of statements on a table: how many rows each touched, and what the table holds when it is read again."""
    path = new_folder(spark, "s2")
    table(spark, sf_dir, "events").select("event_id", "event_type", "value").write.parquet(path)
    # The second sees what the first left; it asks for values that are there no longer, and so does the fourth.
    value = F.col("value")
    counts = execute(spark, path, [Statement(value < 10, {"value": F.lit(0.0)}), Statement(value.between(0.5, 9.5), {"value": F.lit(99.0)}), Statement(value > 90), Statement(value > 95)], ["event_type"])
    after = spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n_after"), F.count(F.when(value == 0, 1)).alias("n_zero"))
    both = counts.join(after, "event_type", "left").fillna(0, ["n_after", "n_zero"])
    return both.select("event_type", (F.col("n_1") + F.col("n_2")).alias("n_updated"), (F.col("n_3") + F.col("n_4")).alias("n_deleted"), F.col("n_before").alias("n"), "n_after", "n_zero")


@query(
    """
    WITH given AS (
        SELECT l_orderkey AS k, l_linenumber AS nth, CAST(l_extendedprice AS DOUBLE) AS price FROM lineitem WHERE l_returnflag = 'R'
        UNION ALL SELECT DISTINCT -l_orderkey, 1, 0.0 FROM lineitem WHERE l_linenumber = 7 AND l_returnflag = 'A'),
    asked AS (SELECT k, count(*) AS times, arg_max(price, {'n': nth, 'p': price}) AS price FROM given GROUP BY k),
    closed AS (SELECT l_orderkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1993-01-01' GROUP BY 1),
    done AS (
        SELECT coalesce(o_orderkey, k) AS o_orderkey, o_orderpriority, CASE WHEN k IS NULL THEN o_totalprice ELSE price END AS total, coalesce(times, 0) AS times, o_orderkey IS NULL AS added
        FROM orders FULL JOIN asked ON o_orderkey = k)
    SELECT o_orderpriority, CAST(sum(CASE WHEN added THEN 0 ELSE times END) AS BIGINT) AS n_touched, count(*) FILTER (added) AS n_added,
        count(*) FILTER (c.k IS NOT NULL) AS n_deleted, count(*) FILTER (c.k IS NULL) AS n_after, CAST(sum(CASE WHEN c.k IS NULL THEN CAST(round(total * 100) AS BIGINT) END) AS BIGINT) AS cents
    FROM done LEFT JOIN closed c ON c.k = o_orderkey GROUP BY 1
    """
)
def s2_many(spark, sf_dir):
    """One statement for many parameters, twice on one table: prices by the last returned item, with keys that aren't there added; then
    the keys that are closed deleted."""
    path, item = new_folder(spark, "s2-many"), table(spark, sf_dir, "lineitem")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice")).write.parquet(path)
    price = item.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("nth"), F.col("l_extendedprice").cast("double").alias("o_totalprice"))
    fresh = item.filter("l_linenumber = 7 AND l_returnflag = 'A'").select((-F.col("l_orderkey")).alias("o_orderkey"), F.lit(1).alias("nth"), F.lit(0.0).alias("o_totalprice")).distinct()
    first = execute_many(spark, path, price.unionByName(fresh), ["o_orderkey"], ["nth"], ["o_orderpriority"], "upsert")
    closed = item.filter("l_shipdate < TIMESTAMP '1993-01-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    second = execute_many(spark, path, closed, ["o_orderkey"], [], ["o_orderpriority"], "delete")
    after = spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count("*").alias("n_after"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    parts = [first.select("o_orderpriority", "n_touched", "n_added"), second.select("o_orderpriority", F.col("n_touched").alias("n_deleted")), after]
    every = parts[0].unionByName(parts[1], True).unionByName(parts[2], True).groupBy("o_orderpriority")
    counts = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_touched", "n_added", "n_deleted", "n_after")]
    return every.agg(*counts, F.sum("cents").alias("cents"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('P', 'O') AND o_orderpriority = '1-URGENT'")
def f1_conjunction(spark, sf_dir):
    """The conditions that are given, and none for those that aren't."""
    return table(spark, sf_dir, "orders").filter(R.conjunction(o_orderstatus=["P", "O"], o_orderpriority="1-URGENT", o_custkey=None)).select("o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1998-06-15' - 7")
def f6_recent(spark, sf_dir):
    """Not older than seven days at a given day."""
    o = table(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderdate") >= F.date_sub(F.lit("1998-06-15").cast("date"), 7).cast(o.schema["o_orderdate"].dataType)).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-03-31'")
def f7_between(spark, sf_dir):
    """Days within two others, both included."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").filter(day.between(F.lit("1995-03-01").cast("date"), F.lit("1995-03-31").cast("date"))).select("o_orderkey", day.alias("day"))


@query("SELECT c_custkey, CASE WHEN c_custkey = first_id THEN 'Y' ELSE 'N' END AS is_leader FROM customer JOIN (SELECT c_nationkey, min(c_custkey) AS first_id FROM customer GROUP BY 1) USING (c_nationkey)")
def f11_leader(spark, sf_dir):
    """Who leads each group: its first member."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    first = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first_id"))
    return c.join(first, "c_nationkey").select("c_custkey", F.when(F.col("c_custkey") == F.col("first_id"), "Y").otherwise("N").alias("is_leader"))


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus <> 'F', o_orderkey")
def t2_condition_key(spark, sf_dir):
    """Done work first: a condition as a sort key."""
    return table(spark, sf_dir, "orders").orderBy(F.col("o_orderstatus") != "F", "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO' ORDER BY p_partkey FETCH FIRST 20 ROWS ONLY")
def t6_first_rows(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_type = 'PROMO'").orderBy("p_partkey").limit(20).select("p_partkey", "p_name")


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY n DESC, total DESC, o_custkey LIMIT 12")
def t8_top_by_two(spark, sf_dir):
    """The twelve by two keys, both downwards."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return n.orderBy(F.desc("n"), F.desc("total"), "o_custkey").limit(12)


@query("""SELECT o_orderkey, o_orderpriority, CASE WHEN s <= e THEN mmdd BETWEEN s AND e ELSE mmdd >= s OR mmdd <= e END AS in_season FROM (SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%m%d') AS mmdd FROM orders)
JOIN (VALUES ('1-URGENT', '1101', '0228'), ('2-HIGH', '0401', '0610'), ('3-MEDIUM', '0701', '0701')) t(p, s, e) ON p = o_orderpriority""")
def x3_in_season(spark, sf_dir):
    """Whether each work lies in the season of its kind, which may run over the turn of the year."""
    seasons = spark.createDataFrame([("1-URGENT", "1101", "0228"), ("2-HIGH", "0401", "0610"), ("3-MEDIUM", "0701", "0701")], "o_orderpriority string, s string, e string")
    o = table(spark, sf_dir, "orders").join(R.small(seasons), "o_orderpriority")
    return o.select("o_orderkey", "o_orderpriority", S.in_season(F.col("o_orderdate"), "s", "e").alias("in_season"))
