"""Boards, look-ups, sort orders, keyed writes and small reports, bound to the driver's tables as in `relational`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups as L
from ..operators import relational as R
from ..sources.tables import table
from .registry import query

_K = "TRY_CAST(json_extract(props, '$.k') AS BIGINT)"
_JOBS = [("drain", "tion", "water"), ("seed", "ing", "the"), ("till", "est", "of")]


def _k():
    return F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")


@query("SELECT c_custkey, c_name, s_name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def j2_left(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left").select("c_custkey", "c_name", "s_name")


@query(f"""SELECT event_id, c_name, n_name, r_name, o_orderpriority, p_name, s_name, p.role AS role FROM events e LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON event_id = o_orderkey LEFT JOIN part ON {_K} = p_partkey LEFT JOIN supplier ON {_K} = s_suppkey
LEFT JOIN (SELECT conv_id, min(role) AS role FROM conversations GROUP BY 1) p ON p.conv_id = {_K}""")
def j6_log_context(spark, sf_dir):
    """Log entries with eight dimensions; each side has one row for its key, so that no entry doubles."""
    roles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("role").alias("role"))
    out = table(spark, sf_dir, "events").withColumn("k", _k())
    for name, key, own in (("customer", "user_id", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey"), ("orders", "event_id", "o_orderkey"), ("part", "k", "p_partkey"), ("supplier", "k", "s_suppkey")):
        out = out.join(table(spark, sf_dir, name), F.col(key) == F.col(own), "left")
    return out.join(roles, F.col("k") == F.col("conv_id"), "left").select("event_id", "c_name", "n_name", "r_name", "o_orderpriority", "p_name", "s_name", "role")


@query("""SELECT event_id, o_orderkey, c_name, n_name FROM events LEFT JOIN orders ON o_orderkey = event_id LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE event_type = 'error' AND value >= 20""")
def j7_evidence_board(spark, sf_dir):
    """Evidence through its work to the household and village; the conditions are those that are given."""
    e = table(spark, sf_dir, "events").filter(R.conjunction(event_type="error", user_id=None) & (F.col("value") >= 20))
    out = e.join(table(spark, sf_dir, "orders"), F.col("event_id") == F.col("o_orderkey"), "left")
    out = out.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("event_id", "o_orderkey", "c_name", "n_name")


@query("""SELECT event_id, l_partkey, p_name FROM events LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS l_partkey FROM lineitem GROUP BY 1) ON l_orderkey = event_id
LEFT JOIN part ON p_partkey = l_partkey""")
def j8_one_of_many(spark, sf_dir):
    """A bridge with several rows for a key: the first is chosen before the join, so that entries stay single."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("l_partkey"))
    out = table(spark, sf_dir, "events").join(first, F.col("event_id") == F.col("l_orderkey"), "left")
    return out.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").select("event_id", "l_partkey", "p_name")


@query("SELECT c_custkey, n_name AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 2")
def j9_literal_in_on(spark, sf_dir):
    """A code list cut to one group before the left join."""
    codes = table(spark, sf_dir, "nation").filter("n_regionkey = 2")
    return table(spark, sf_dir, "customer").join(codes, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.col("n_name").alias("label"))


@query("""SELECT 'error' AS kind, count(*) > 0 AS found FROM (SELECT 1 FROM events WHERE event_type = 'error' LIMIT 1) UNION ALL SELECT 'none', count(*) > 0 FROM (SELECT 1 FROM events WHERE event_type = 'none' LIMIT 1)""")
def j15_probe(spark, sf_dir):
    """Whether there are rows at all: one row is enough to know."""
    probe = lambda k: table(spark, sf_dir, "events").filter(F.col("event_type") == k).limit(1).agg((F.count("*") > 0).alias("found")).select(F.lit(k).alias("kind"), "found")
    return probe("error").unionByName(probe("none"))


@query("""WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY event_id) AS ids FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, coalesce(n, 0) AS n, ids FROM events e LEFT JOIN p ON p.user_id = e.user_id AND p.day = CAST(e.ts AS DATE) WHERE event_type = 'error'""")
def j19_merged_summary(spark, sf_dir):
    """Entries with a summary of the purchases of the same user and day, which is aggregated first."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), "|")
    p = e.filter("event_type = 'purchase'").groupBy("user_id", "day").agg(F.count("*").alias("n"), ids.alias("ids"))
    return e.filter("event_type = 'error'").join(p, ["user_id", "day"], "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"), "ids")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size IN (1, 2, 3, 4, 5))")
def j20_in_set(spark, sf_dir):
    """Rows whose key is in a set that is itself a query."""
    few = table(spark, sf_dir, "part").filter(R.conjunction(p_type="PROMO", p_size=[1, 2, 3, 4, 5]))
    return table(spark, sf_dir, "lineitem").join(few, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"""WITH j(job, a, b) AS (VALUES {', '.join(str(j) for j in _JOBS)}), s AS (SELECT doc_id, job, 20 * CAST(contains(text, a) AS INT) + 10 * CAST(contains(text, b) AS INT) AS score FROM documents CROSS JOIN j)
SELECT doc_id, arg_max(job, (score, job)) AS job, max(score) AS score FROM s GROUP BY 1 HAVING max(score) > 0""")
def j21_best_job(spark, sf_dir):
    """The job that fits a text best. The jobs are a fixed short list, so their scores are columns and not a join."""
    has = lambda w: F.contains(F.col("text"), F.lit(w)).cast("int")
    scores = F.array(*[F.struct((20 * has(a) + 10 * has(b)).alias("score"), F.lit(job).alias("job")) for job, a, b in _JOBS])
    best = table(spark, sf_dir, "documents").select("doc_id", F.array_max(scores).alias("s")).select("doc_id", "s.job", "s.score")
    return best.filter("score > 0")


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey IN (12, -3) OR c_mktsegment = 'BUILDING'")
def f3_typed_keys(spark, sf_dir):
    """Keys of digits are sought in the number column, others in the text column."""
    return table(spark, sf_dir, "customer").filter(L.typed_match(["12", "-3", "BUILDING"], "c_nationkey", "c_mktsegment")).select("c_custkey", "c_nationkey", "c_mktsegment")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'END' WHEN 'P' THEN 'ING' WHEN 'O' THEN 'PRE' ELSE 'ETC' END AS code FROM orders""")
def f13_code_map(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", L.mapped("o_orderstatus", {"F": "END", "P": "ING", "O": "PRE"}, "ETC").alias("code"))


_RAW = ["", "rct2", "Invoice_1", "before_work", "field_after", "spreading", "pic", "x"]


@query(f"""SELECT event_id, CASE WHEN r = '' THEN 'OTH' WHEN regexp_full_match(r, 'PIC[1-3]?|RCT[1-5]?|EQP|DST|OTH') THEN r WHEN regexp_matches(r, 'INVOICE|RECEIPT') THEN 'RCT5' WHEN regexp_matches(r, 'BEFORE|START') THEN 'PIC2'
WHEN regexp_matches(r, 'AFTER|END|BAG|SPREADING|FIELD|DRY|COLLECTION|TILLAGE|DRAINAGE') THEN 'PIC1' ELSE 'OTH' END AS code FROM (SELECT event_id, upper(trim(list_extract({_RAW}, event_id % 8 + 1))) AS r FROM events)""")
def f14_evidence_code(spark, sf_dir):
    """Free-form kinds of evidence as codes, by the first rule that fits."""
    raw = F.get(F.array(*map(F.lit, _RAW)), (F.col("event_id") % 8).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", L.evidence_code(raw).alias("code"))


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NULL OR o_orderpriority = '1-URGENT'")
def f2_nullable_flag(spark, sf_dir):
    """A flag that counts as set where it is null."""
    flag = F.nullif("o_orderpriority", F.lit("5-LOW"))
    return table(spark, sf_dir, "orders").filter(F.coalesce(flag, F.lit("1-URGENT")) == "1-URGENT").select("o_orderkey")


@query("SELECT doc_id, substr(text, 1, 40) AS short FROM documents")
def f16_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 40).alias("short"))


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END, s_nationkey * 100.0) DESC, s_suppkey")
def t4_fallback_order(spark, sf_dir):
    at = F.coalesce(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")), F.col("s_nationkey") * 100.0)
    return table(spark, sf_dir, "supplier").orderBy(at.desc(), "s_suppkey").select("s_suppkey", "s_name")


_RANK = {"error": 0, "purchase": 1, "signup": 2}


@query("SELECT event_id, event_type FROM events ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 9 END, event_id")
def t9_urgency(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(L.mapped("event_type", _RANK, 9), "event_id").select("event_id", "event_type")


@query("""SELECT o_orderpriority, n_open, due FROM (SELECT o_orderpriority, count(*) FILTER (o_orderstatus <> 'F') AS n_open, CAST(min(o_orderdate) FILTER (o_orderstatus = 'O') AS DATE) AS due FROM orders GROUP BY 1)
ORDER BY n_open > 0 DESC, due ASC NULLS LAST, n_open DESC, o_orderpriority LIMIT 1""")
def t10_recommend(spark, sf_dir):
    """The activity to do next: open ones first, then the earliest due, then the one with most open work."""
    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.when(F.col("o_orderstatus") != "F", 1)).alias("n_open"), F.to_date(F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate")))).alias("due"))
    return n.orderBy(F.desc(F.col("n_open") > 0), F.asc_nulls_last("due"), F.desc("n_open"), "o_orderpriority").limit(1).select("o_orderpriority", "n_open", "due")


@query("""SELECT id, arg_min(name, prio) FILTER (trim(name) <> '') AS name FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS name, 1 AS prio FROM customer
UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier UNION ALL SELECT DISTINCT user_id, NULL, 3 FROM events) GROUP BY 1""")
def u5_pool(spark, sf_dir):
    """Everyone that any source knows; the first name that isn't blank, by source."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.lit(None).cast("string").alias("name")).distinct()
    return L.first_named([c, s, e], "id", "name")


@query("""SELECT coalesce(b.k, n.k) AS k, CASE WHEN n.k IS NULL THEN b.v ELSE n.v END AS v, CASE WHEN n.k IS NULL THEN 'kept' WHEN b.k IS NULL THEN 'inserted' ELSE 'updated' END AS action
FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F') b FULL JOIN (SELECT event_id AS k, value AS v FROM events) n ON b.k = n.k""")
def w2_insert_or_update(spark, sf_dir):
    """The merged table, and what happened to each row."""
    base = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("value").alias("v"))
    return L.merged(base, new, ["k"])


@query("SELECT o_orderkey, coalesce(value, o_totalprice) AS o_totalprice FROM orders LEFT JOIN events ON event_id = o_orderkey AND event_type = 'purchase'")
def w7_partial_update(spark, sf_dir):
    """New values where there are any."""
    new = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", "value")
    return table(spark, sf_dir, "orders").join(new, F.col("event_id") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("value", "o_totalprice").alias("o_totalprice"))


@query("""SELECT event_id, ts, user_id FROM events WHERE NOT ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'
UNION ALL SELECT -user_id, TIMESTAMP '2024-01-11 00:00:00', user_id FROM (SELECT DISTINCT user_id FROM events)""")
def z19_replace_range(spark, sf_dir):
    """The rows of a range of time replaced by seeds, the same at every run."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    at = lambda t: F.lit(t).cast(e.schema["ts"].dataType)
    seeds = e.select("user_id").distinct().select((-F.col("user_id")).alias("event_id"), at("2024-01-11 00:00:00").alias("ts"), "user_id")
    return e.filter(~F.coalesce(F.col("ts").between(at("2024-01-10 00:00:00"), at("2024-01-12 00:00:00")), F.lit(False))).unionByName(seeds)


@query("SELECT l_orderkey, arg_min(p_partkey, (p_type <> 'PROMO', p_partkey)) AS pick FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def z1_preferred_part(spark, sf_dir):
    """One part for each work item: of the preferred kind if there is one, else the least number."""
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return met.groupBy("l_orderkey").agg(F.min_by("p_partkey", F.struct((F.col("p_type") != "PROMO").alias("other"), "p_partkey")).alias("pick"))


@query("""SELECT c_custkey, c_nationkey, c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey) AS leader FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def z3_members(spark, sf_dir):
    """The households that take part, with the leader of each village marked."""
    taking = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_nationkey")
    heads = taking.groupBy("c_nationkey").agg(F.min("c_custkey").alias("head"))
    return taking.join(heads, "c_nationkey").select("c_custkey", "c_nationkey", (F.col("c_custkey") == F.col("head")).alias("leader"))


@query("""SELECT n_nationkey, c_custkey, o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'none' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS label FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey""")
def z4_expansion(spark, sf_dir):
    """Villages with their households and their work; those without any stay."""
    out = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    label = F.when(F.col("o_orderkey").isNull(), "none").when(F.col("o_orderstatus") == "F", "done").otherwise("open")
    return out.select("n_nationkey", "c_custkey", "o_orderkey", label.alias("label"))


@query(f"""SELECT e.event_id, coalesce(o.o_orderkey, p.o_orderkey, latest, -1) AS parent FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id AND o.o_orderstatus = 'P' LEFT JOIN orders p ON p.o_orderkey = {_K} AND p.o_orderstatus = 'O'
LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1) l ON l.o_custkey = e.user_id""")
def z7_parent(spark, sf_dir):
    """The work an entry belongs to: the one it names, else the one in its JSON, else the user's latest, else none (-1)."""
    o = table(spark, sf_dir, "orders")
    named = o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("named"))
    parsed = o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("parsed"))
    latest = o.groupBy(F.col("o_custkey").alias("user_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", _k().alias("k"))
    met = e.join(named, F.col("event_id") == F.col("named"), "left").join(parsed, F.col("k") == F.col("parsed"), "left").join(latest, "user_id", "left")
    return met.select("event_id", F.coalesce("named", "parsed", "latest", F.lit(-1)).alias("parent"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type IN ('error', 'purchase') AND value > 30 GROUP BY 1")
def z8_pending_pick(spark, sf_dir):
    """The newest entry of each user that waits for another try."""
    few = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase") & (F.col("value") > 30))
    return few.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""SELECT CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 1 WHEN p_type IN ('PROMO', 'ECONOMY') THEN 2 ELSE 3 END AS prio, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1 ORDER BY 1""")
def z11_categories(spark, sf_dir):
    """Counts by category in a fixed order; those without members don't appear."""
    prio = L.mapped("p_type", {"SMALL": 1, "MEDIUM": 1, "LARGE": 1, "PROMO": 2, "ECONOMY": 2}, 3)
    return table(spark, sf_dir, "part").groupBy(prio.alias("prio")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id")).orderBy("prio")


@query("""SELECT doc_id, toxic = 1 OR n_chars / 5000.0 < 0.55 OR (source = 'web' AND NOT contains(text, 'the')) AS doubtful FROM labels JOIN documents USING (doc_id)""")
def z22_doubtful(spark, sf_dir):
    """What needs a second look: a bad verdict, low confidence, or a text without the word it must have."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    doubt = (F.col("toxic") == 1) | (F.col("n_chars") / 5000.0 < 0.55) | ((F.col("source") == "web") & ~F.contains("text", F.lit("the")))
    return d.select("doc_id", doubt.alias("doubtful"))


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_done, count(*) FILTER (o_orderstatus = 'P') AS n_doing, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS n_open,
round(100.0 * count(*) FILTER (o_orderstatus = 'F') / nullif(count(*), 0), 1) AS percent FROM orders GROUP BY 1""")
def z24_project_summary(spark, sf_dir):
    n = lambda c: F.count(F.when(c, 1))
    s = F.col("o_orderstatus")
    out = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), n(s == "F").alias("n_done"), n(s == "P").alias("n_doing"), n(~s.isin("F", "P")).alias("n_open"))
    return out.withColumn("percent", R.share("n_done", "n"))


@query("""WITH f AS (SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (o_orderpriority <> '5-LOW') AS first_priority FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(a.first_priority, b.first_priority) AS first_priority FROM customer LEFT JOIN f a ON a.o_custkey = c_custkey LEFT JOIN f b ON b.o_custkey = c_nationkey""")
def z25_residents(spark, sf_dir):
    """The first activity of each household, looked up by one key and else by another."""
    first = F.min_by(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")), F.when(F.col("o_orderpriority") != "5-LOW", F.struct("o_orderdate", "o_orderkey")))
    f = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(first.alias("p"))
    return L.either_lookup(table(spark, sf_dir, "customer"), f, "o_custkey", "p", ["c_custkey", "c_nationkey"]).select("c_custkey", F.col("p").alias("first_priority"))


@query("""WITH j AS (SELECT o_orderpriority, o_orderkey, o_custkey, least(1.0, count(*) FILTER (l_linestatus = 'F') / 3.0) AS credit FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT o_orderpriority, round(sum(credit), 4) AS done, count(*) AS total, count(DISTINCT o_custkey) AS members FROM j GROUP BY 1""")
def z26_detail(spark, sf_dir):
    """Done of total by activity with partial credit, and the households with any work in it."""
    sent = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("sent"))
    met = table(spark, sf_dir, "orders").join(sent, "o_orderkey").withColumn("credit", F.least(F.lit(1.0), F.col("sent") / 3.0))
    return met.groupBy("o_orderpriority").agg(F.round(F.sum("credit"), 4).alias("done"), F.count("*").alias("total"), F.count_distinct("o_custkey").alias("members"))


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-12 06:00:00' AND TIMESTAMP '2024-01-14 18:00:00' ORDER BY ts, event_id")
def z27_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = lambda t: F.lit(t).cast(e.schema["ts"].dataType)
    return e.filter(F.col("ts").between(at("2024-01-12 06:00:00"), at("2024-01-14 18:00:00"))).select("event_id", "ts").orderBy("ts", "event_id")
