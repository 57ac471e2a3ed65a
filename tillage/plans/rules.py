"""Schedules, parsing, reports and progress, bound to orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as X
from ..operators import lookups as L
from ..operators import programme as P
from ..operators import relational as R
from ..operators import seasons as S
from ..sources.tables import table
from .registry import query
from .weather import OPTIONS

_SEASON = "CASE WHEN m BETWEEN '0301' AND '0531' THEN 'spring' WHEN m BETWEEN '0901' AND '1115' THEN 'autumn' WHEN m >= '1116' OR m <= '0228' THEN 'winter' END"


def _seasons(spark, sf_dir):
    options = spark.createDataFrame(OPTIONS, "prio int, label string, start string, end string")
    return S.season_of(table(spark, sf_dir, "orders"), "o_orderdate", options)


@query(f"SELECT o_orderkey, o_orderstatus <> 'P' OR {_SEASON} IS NOT NULL AS visible FROM (SELECT *, strftime(o_orderdate, '%m%d') AS m FROM orders)")
def x2_visible(spark, sf_dir):
    """Work that depends on a season shows only while there is one; other work always."""
    return _seasons(spark, sf_dir).select("o_orderkey", ((F.col("o_orderstatus") != "P") | F.col("season").isNotNull()).alias("visible"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 3 END, CASE o_orderstatus WHEN 'P' THEN 7 END, 14) AS INT) AS due FROM orders""")
def x6_offset(spark, sf_dir):
    """Due dates by the offset of the activity, else of the status, else a default."""
    days = F.coalesce(L.mapped("o_orderpriority", {"1-URGENT": 1, "2-HIGH": 3}, None), L.mapped("o_orderstatus", {"P": 7}, None), F.lit(14))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), days.cast("int")).alias("due"))


@query("SELECT c_nationkey, coalesce(max(TRY_CAST(split_part(c_name, '#', 2) AS BIGINT)), 0) + 1 AS next_key FROM customer GROUP BY 1")
def x9_next_key(spark, sf_dir):
    """One more than the largest number in the names; names without one don't count."""
    n = F.split_part("c_name", F.lit("#"), F.lit(2)).try_cast("bigint")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_key"))


_SKIES = ["비/눈", "구름많고 비", "눈", "소나기", "흐림", "맑음", "흐리고 눈"]


@query(f"""SELECT event_id, CASE WHEN contains(t, '비/눈') OR contains(t, '진눈깨비') THEN '2' WHEN contains(t, '비') THEN '1' WHEN contains(t, '눈') THEN '3' WHEN contains(t, '소나기') THEN '4' ELSE '0' END AS pty,
CASE WHEN contains(t, '흐림') OR contains(t, '흐리고') THEN '4' WHEN contains(t, '구름많') THEN '3' ELSE '1' END AS sky FROM (SELECT event_id, list_extract({_SKIES}, event_id % 7 + 1) AS t FROM events)""")
def x10_weather_codes(spark, sf_dir):
    """Codes of rain and sky from the words of a forecast."""
    text = F.get(F.array(*map(F.lit, _SKIES)), (F.col("event_id") % 7).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", X.first_word(text, X.RAIN_WORDS, "0").alias("pty"), X.first_word(text, X.SKY_WORDS, "1").alias("sky"))


@query("""SELECT event_id, strftime(b, '%Y%m%d') AS base_date, strftime(b, '%H%M') AS base_time FROM (SELECT event_id, CAST(to_timestamp(floor((epoch(ts) - 8100) / 10800) * 10800 + 7200) AT TIME ZONE 'UTC' AS TIMESTAMP) AS b FROM events)""")
def x11_release(spark, sf_dir):
    """The newest forecast at a time: one every three hours from two o'clock, to be had a quarter of an hour later."""
    b = S.release(F.col("ts"), first_hour=2, every_hours=3, lag_minutes=15)
    return table(spark, sf_dir, "events").select("event_id", F.date_format(b, "yyyyMMdd").alias("base_date"), F.date_format(b, "HHmm").alias("base_time"))


@query(r"SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)([?#].*)?$', 1), '') AS INT) AS number, TRY_CAST(regexp_replace(regexp_extract(html, '20[0-9]{2}-[0-9]{2}-[0-9]{2}'), '^$', 'none') AS DATE) AS day FROM pages")
def x12_safe_parse(spark, sf_dir):
    """Numbers and days where there are any, else null."""
    n = F.nullif(F.regexp_extract("url", r"/([0-9]+)([?#].*)?$", 1), F.lit("")).try_cast("int")
    return table(spark, sf_dir, "pages").select("page_id", n.alias("number"), F.try_to_date(F.regexp_extract("html", "20[0-9]{2}-[0-9]{2}-[0-9]{2}", 0), "yyyy-MM-dd").alias("day"))


@query(r"SELECT p_partkey, lower(trim(regexp_replace(p_name, '[ \t]+', ' ', 'g'))) AS name, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, split_part(p_name, ' ', 2) AS noun, repeat('*', p_size % 5) AS stars FROM part")
def x13_strings(spark, sf_dir):
    name = F.lower(F.trim(F.regexp_replace("p_name", r"[ \t]+", " ")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", name.alias("name"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"), F.expr("repeat('*', p_size % 5)").alias("stars")
    )


@query("""SELECT p_partkey, list_contains(w, 'ring') AS has, CAST(len(list_filter(list_distinct(w), lambda x: x NOT IN ('small', 'ring'))) AS INT) AS n_other, array_to_string(list_sort(list_distinct(list_concat(w, ['small', 'ring']))), ' ') AS every
FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def x14_arrays(spark, sf_dir):
    w, few = F.split("p_name", " "), F.array(F.lit("small"), F.lit("ring"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_contains(w, "ring").alias("has"), F.size(F.array_except(w, few)).alias("n_other"), F.array_join(F.array_sort(F.array_union(w, few)), " ").alias("every"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract(CASE WHEN json_valid(p) THEN p END, '$.k') AS BIGINT), -1) AS k FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{bad' ELSE props END AS p FROM events)")
def x15_json_default(spark, sf_dir):
    """A field of JSON texts; malformed ones count as empty."""
    text = F.when(F.col("event_id") % 5 == 0, "{bad").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_variant_get(F.try_parse_json(text), "$.k", "bigint"), F.lit(-1)).alias("k"))


@query("""WITH f AS (SELECT user_id, min(date_trunc('hour', ts)) AS slot FROM events GROUP BY 1)
SELECT user_id, slot, arg_max(value, event_id) FILTER (event_type = 'click' AND date_trunc('hour', ts) = slot) AS click, coalesce(arg_min(value, event_id) FILTER (event_type = 'purchase' AND CAST(ts AS DATE) = CAST(slot AS DATE)), max(value) FILTER (event_type = 'click' AND CAST(ts AS DATE) = CAST(slot AS DATE))) AS high
FROM events JOIN f USING (user_id) GROUP BY 1, 2""")
def p2_near_slot(spark, sf_dir):
    """The first slot of each user with its value, and the day's high: the official one, else the largest of the slots."""
    e = table(spark, sf_dir, "events").withColumn("at", F.date_trunc("hour", "ts").cast(table(spark, sf_dir, "events").schema["ts"].dataType))
    met = e.join(e.groupBy("user_id").agg(F.min("at").alias("slot")), "user_id")
    kind, today = F.col("event_type"), F.to_date("at") == F.to_date("slot")
    at = lambda c, how: how(F.when(c, F.col("value")), F.when(c, F.col("event_id")))
    high = F.coalesce(at((kind == "purchase") & today, F.min_by), F.max(F.when((kind == "click") & today, F.col("value"))))
    return met.groupBy("user_id", "slot").agg(at((kind == "click") & (F.col("at") == F.col("slot")), F.max_by).alias("click"), high.alias("high"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'F'),
t AS (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS todo FROM o WHERE r = 1 GROUP BY 1), l AS (SELECT user_id, max(CAST(ts AS DATE)) AS last_log, count(*) FILTER (event_type = 'error') AS retakes FROM events GROUP BY 1)
SELECT c_custkey, coalesce(todo, '') AS todo, last_log, coalesce(retakes, 0) AS retakes FROM customer LEFT JOIN t ON o_custkey = c_custkey LEFT JOIN l ON user_id = c_custkey""")
def r2_context(spark, sf_dir):
    """What is known of each household: its next open work of each activity by due date, its last entry, what must be done again."""
    still = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    first = R.first_per_key(still, ["o_custkey", "o_orderpriority"], F.asc("o_orderdate"), F.asc("o_orderkey"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    todo = first.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(ids, ",").alias("todo"))
    log = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max(F.to_date("ts")).alias("last_log"), F.count(F.when(F.col("event_type") == "error", 1)).alias("retakes"))
    out = table(spark, sf_dir, "customer").select("c_custkey").join(todo, "c_custkey", "left").join(log, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("todo", F.lit("")).alias("todo"), "last_log", F.coalesce("retakes", F.lit(0)).alias("retakes"))


@query("""WITH o AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'), x AS (SELECT o_custkey, event_id FROM events JOIN o ON event_id = o_orderkey), c AS (SELECT DISTINCT o_custkey FROM o),
f AS (SELECT o_custkey, event_id FROM events e JOIN c ON user_id = o_custkey WHERE NOT EXISTS (SELECT 1 FROM o WHERE o_orderkey = e.event_id)), n AS (SELECT o_custkey, count(*) AS n_work FROM o GROUP BY 1)
SELECT n.o_custkey, n_work, (SELECT count(*) FROM x WHERE x.o_custkey = n.o_custkey) AS n_exact, (SELECT count(*) FROM f WHERE f.o_custkey = n.o_custkey) AS n_fallback FROM n""")
def r3_report(spark, sf_dir):
    """A programme's work by household, with the entries that name it, and those that only name the household."""
    o = table(spark, sf_dir, "orders").filter(R.conjunction(o_orderpriority="1-URGENT")).select("o_orderkey", "o_custkey")
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    exact = e.join(o, F.col("event_id") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("n_exact"))
    rest = e.join(o.select("o_orderkey"), F.col("event_id") == F.col("o_orderkey"), "left_anti")
    fallback = rest.groupBy(F.col("user_id").alias("o_custkey")).agg(F.count("*").alias("n_fallback"))
    return R.counted(o.groupBy("o_custkey").agg(F.count("*").alias("n_work")), ["o_custkey"], exact, fallback)


@query("""WITH a AS (SELECT p_type, p_brand, count(*) FILTER (l_linestatus = 'F') AS sub, count(*) FILTER (l_linestatus <> 'F') AS pending, coalesce(list(DISTINCT l_returnflag) FILTER (p_type IN ('ECONOMY', 'SMALL') AND l_linestatus <> 'F'), []) AS req, coalesce(list(DISTINCT l_returnflag) FILTER (l_linestatus = 'F'), []) AS got
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), k AS (SELECT *, CASE p_type WHEN 'PROMO' THEN 4 WHEN 'LARGE' THEN 2 END AS known, len(list_intersect(req, got)) AS met FROM a)
SELECT p_type, p_brand, CAST(CASE WHEN known IS NOT NULL THEN least(sub, known) WHEN len(req) > 0 THEN least(CASE WHEN met > 0 THEN met ELSE sub END, len(req)) ELSE sub END AS BIGINT) AS done,
CAST(CASE WHEN known IS NOT NULL THEN known WHEN len(req) > 0 THEN len(req) ELSE greatest(sub + pending, 1) END AS BIGINT) AS target FROM k""")
def g30_activity_progress(spark, sf_dir):
    """Done and target by activity: a known target, else the required kinds, else what is done and open."""
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    done = F.col("l_linestatus") == "F"
    a = met.groupBy("p_type", "p_brand").agg(
        F.count(F.when(done, 1)).alias("sub"), F.count(F.when(~done, 1)).alias("pending"),
        F.collect_set(F.when(F.col("p_type").isin("ECONOMY", "SMALL") & ~done, F.col("l_returnflag"))).alias("req"), F.collect_set(F.when(done, F.col("l_returnflag"))).alias("got"),
    )
    done_col, target = P.progress(L.mapped("p_type", {"PROMO": 4, "LARGE": 2}, None), F.col("req"), F.col("got"), F.col("sub"), F.col("pending"))
    return a.select("p_type", "p_brand", done_col.alias("done"), target.alias("target"))


@query(f"SELECT season, count(DISTINCT o_custkey) AS n_homes FROM (SELECT o_custkey, {_SEASON} AS season FROM (SELECT *, strftime(o_orderdate, '%m%d') AS m FROM orders WHERE o_orderstatus = 'P')) WHERE season IS NOT NULL GROUP BY 1")
def g31_season_banner(spark, sf_dir):
    """How many households have work in each season."""
    s = _seasons(spark, sf_dir).filter("o_orderstatus = 'P' and season is not null")
    return s.groupBy("season").agg(F.count_distinct("o_custkey").alias("n_homes"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND {_SEASON} = 'spring' THEN make_date(year(o_orderdate), 3, 1) WHEN o_orderstatus = 'P' AND {_SEASON} = 'autumn' THEN make_date(year(o_orderdate), 9, 1) ELSE CAST(o_orderdate AS DATE) END AS day FROM (SELECT *, strftime(o_orderdate, '%m%d') AS m FROM orders)""")
def z13_reschedule(spark, sf_dir):
    """Work in progress moves to the beginning of the season it lies in; other work keeps its day."""
    s = _seasons(spark, sf_dir).withColumn("day", F.to_date("o_orderdate"))
    start = F.make_date(F.year("day"), L.mapped("season", {"spring": 3, "autumn": 9}, None), F.lit(1))
    return R.updated(s, (F.col("o_orderstatus") == "P") & start.isNotNull(), day=start).select("o_orderkey", "day")


@query("""SELECT CASE WHEN p_type = 'PROMO' THEN 310.0 WHEN regexp_matches(p_name, '(small|large) (ring|rod)') THEN 77.5 END AS rate, p_partkey FROM part""")
def z14_rates(spark, sf_dir):
    """A rate by code, else by a pattern in the name, else none."""
    rate = F.when(F.col("p_type") == "PROMO", 310.0).when(F.col("p_name").rlike("(small|large) (ring|rod)"), 77.5)
    return table(spark, sf_dir, "part").select("p_partkey", rate.alias("rate"))
