"""Weather shaping, seasons and places, bound to events (day, hour, type, value) and to made-up coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import seasons as S
from ..sources.tables import table
from .registry import query

KINDS = ["click", "error", "purchase", "signup", "view"]


def _slots(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "event_type", "value", "event_id")


@query("SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) AS INT) AS hour, " + ", ".join(f"arg_max(value, event_id) FILTER (event_type = '{k}') AS \"{k}\"" for k in KINDS) + " FROM events GROUP BY 1, 2")
def p1_pivot(spark, sf_dir):
    """From category rows to slots, the last value of each category."""
    return S.slots_wide(_slots(spark, sf_dir), ["day", "hour"], "event_type", "value", "event_id", KINDS)


@query("""SELECT CAST(ts AS DATE) AS day, max(value) FILTER (event_type = 'click') AS high, min(value) FILTER (event_type = 'click') AS low,
arg_min(value, (abs(hour(ts) - 12), event_id)) AS noon, mode(event_type ORDER BY event_type) IS NOT NULL AS has_mode FROM events GROUP BY 1""")
def p3_daily(spark, sf_dir):
    """Days from slots: extremes of a category, and the value nearest to noon."""
    s = _slots(spark, sf_dir)
    click = F.when(F.col("event_type") == "click", F.col("value"))
    days = s.groupBy("day").agg(F.max(click).alias("high"), F.min(click).alias("low"), F.mode("event_type", True).isNotNull().alias("has_mode"))
    return days.join(S.nearest_noon(s, ["day"], "hour", "value", "event_id").withColumnRenamed("value", "noon"), "day")


@query("""WITH k AS (SELECT DISTINCT user_id FROM events), d AS (SELECT user_id, CAST(DATE '2024-01-10' + CAST(i AS INT) AS DATE) AS day FROM k CROSS JOIN range(7) t(i)), m AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS value FROM events GROUP BY 1, 2)
SELECT d.user_id, d.day, coalesce(last_value(m.value IGNORE NULLS) OVER (PARTITION BY d.user_id ORDER BY d.day), 24.0) AS value, m.value IS NULL AS is_extrapolated FROM d LEFT JOIN m ON m.user_id = d.user_id AND m.day = d.day""")
def p4_weekly(spark, sf_dir):
    """Seven days for each user: the day's value, or the last before it, or a default."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "value")
    days = S.spine(e, ["user_id"], F.lit("2024-01-10").cast("date"), 7)
    return S.filled(days.join(e.groupBy("user_id", "day").agg(F.max("value").alias("value")), ["user_id", "day"], "left"), ["user_id"], "day", "value", 24.0)


@query("""SELECT user_id, event_id, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id)) AS v, v IS NULL AS is_extrapolated FROM (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN value END AS v FROM events)""")
def n4_locf(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("v"))
    return R.carried_forward(e, ["user_id"], "event_id", "v")


@query("SELECT user_id, arg_min(event_id, (abs(hour(ts) - 12), event_id)) AS event_id FROM events GROUP BY 1")
def n5_nearest_noon(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.hour("ts").alias("hour"), F.col("event_id").alias("o"))
    return S.nearest_noon(e, ["user_id"], "hour", "event_id", "o")


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), v AS (SELECT CAST(ts AS DATE) AS day, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
SELECT day, (SELECT event_type FROM c WHERE c.day = v.day ORDER BY n DESC, event_type LIMIT 1) AS modal, lo, hi FROM v""")
def g34_day_summary(spark, sf_dir):
    """The commonest type of each day, the first in the alphabet of equals, and the span of values."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    n = e.groupBy("day", "event_type").agg(F.count("*").alias("n"))
    modal = n.groupBy("day").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("modal"))
    span = e.groupBy("day").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return modal.join(span, "day")


OPTIONS = [(1, "spring", "0301", "0531"), (2, "autumn", "0901", "1115"), (3, "winter", "1116", "0228")]


@query("""SELECT o_orderkey, CASE WHEN m BETWEEN '0301' AND '0531' THEN 'spring' WHEN m BETWEEN '0901' AND '1115' THEN 'autumn' WHEN m >= '1116' OR m <= '0228' THEN 'winter' END AS season FROM (SELECT o_orderkey, strftime(o_orderdate, '%m%d') AS m FROM orders)""")
def x1_season(spark, sf_dir):
    """The first season that holds a day; one of them runs over the turn of the year."""
    options = spark.createDataFrame(OPTIONS, "prio int, label string, start string, end string")
    return S.season_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", options).drop("o_orderdate")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + 7 AS earliest, CAST(o_orderdate AS DATE) + 21 AS latest FROM orders WHERE o_orderstatus = 'P'")
def x4_anchor_shift(spark, sf_dir):
    """Windows that open and close so many days after an anchor."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", F.date_add(day, 7).alias("earliest"), F.date_add(day, 21).alias("latest"))


@query("SELECT o_orderkey, i AS nth, CASE WHEN i = 1 THEN 'START' WHEN i = n THEN 'END' ELSE 'MID' END AS point FROM (SELECT o_orderkey, o_orderkey % 4 + 1 AS n, unnest(range(1, o_orderkey % 4 + 2)) AS i FROM orders)")
def x5_repeats(spark, sf_dir):
    """Drafts of repeated work: the first, those between, the last."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4 + 1).alias("n"))
    each = o.select("o_orderkey", "n", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"))
    return each.select("o_orderkey", "nth", F.when(F.col("nth") == 1, "START").when(F.col("nth") == F.col("n"), "END").otherwise("MID").alias("point"))


_PLACE = "33.0 + (c_custkey % 50) / 10.0 AS lat, 125.0 + (c_custkey % 70) / 12.0 AS lon"


@query(f"""WITH p AS (SELECT c_custkey, {_PLACE} FROM customer), k AS (SELECT 6371.00877 / 5.0 AS re, radians(30.0) AS s1, radians(60.0) AS s2, radians(126.0) AS ol, radians(38.0) AS ob),
a AS (SELECT *, ln(cos(s1) / cos(s2)) / ln(tan(pi() * 0.25 + s2 * 0.5) / tan(pi() * 0.25 + s1 * 0.5)) AS sn FROM k), b AS (SELECT *, pow(tan(pi() * 0.25 + s1 * 0.5), sn) * cos(s1) / sn AS sf FROM a), c AS (SELECT *, re * sf / pow(tan(pi() * 0.25 + ob * 0.5), sn) AS ro FROM b)
SELECT c_custkey, CAST(floor(re * sf / pow(tan(pi() * 0.25 + radians(lat) * 0.5), sn) * sin((radians(lon) - ol) * sn) + 43.5) AS INT) AS nx, CAST(floor(ro - re * sf / pow(tan(pi() * 0.25 + radians(lat) * 0.5), sn) * cos((radians(lon) - ol) * sn) + 136.5) AS INT) AS ny FROM p, c""")
def x7_grid(spark, sf_dir):
    """The forecast cell of each household's place."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (33.0 + (F.col("c_custkey") % 50) / 10.0).alias("lat"), (125.0 + (F.col("c_custkey") % 70) / 12.0).alias("lon"))
    nx, ny = S.grid_cell(F.col("lat"), F.col("lon"))
    return c.select("c_custkey", nx.alias("nx"), ny.alias("ny"))


@query(f"""WITH p AS (SELECT c_custkey, {_PLACE} FROM customer) SELECT c_custkey, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(37.5665 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(37.5665)) * pow(sin(radians(126.978 - lon) / 2), 2))), 1) AS metres FROM p""")
def x8_haversine(spark, sf_dir):
    """Metres from each household's place to a point."""
    lat, lon = 33.0 + (F.col("c_custkey") % 50) / 10.0, 125.0 + (F.col("c_custkey") % 70) / 12.0
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(S.haversine(lat, lon, F.lit(37.5665), F.lit(126.978)), 1).alias("metres"))


@query(f"""WITH p AS (SELECT c_custkey, c_nationkey, {_PLACE} FROM customer), s AS (SELECT s_suppkey, s_nationkey, 33.0 + (s_suppkey % 45) / 9.0 AS slat, 125.0 + (s_suppkey % 60) / 10.0 AS slon FROM supplier),
d AS (SELECT c_custkey, s_suppkey, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(slat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2))), 1) AS metres FROM p JOIN s ON c_nationkey = s_nationkey)
SELECT c_custkey, arg_min(s_suppkey, (metres, s_suppkey)) AS nearest, min(metres) AS metres FROM d GROUP BY 1""")
def j22_nearest(spark, sf_dir):
    """The nearest supplier of the same village, looked for in cells of growing size, never among all pairs."""
    p = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("village"), (33.0 + (F.col("c_custkey") % 50) / 10.0).alias("lat"), (125.0 + (F.col("c_custkey") % 70) / 12.0).alias("lon"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("village"), (33.0 + (F.col("s_suppkey") % 45) / 9.0).alias("lat"), (125.0 + (F.col("s_suppkey") % 60) / 10.0).alias("lon"))
    return S.nearest_place(p, s, ["village"], "c_custkey", "s_suppkey")
