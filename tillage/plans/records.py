"""Records written and looked up: predicates, invariants, copies and replacements, diaries, rules, holidays, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as X
from ..operators import records as D
from ..operators import relational as R
from ..operators import retrieval as V
from ..sources.tables import emptied, held, new_folder, table
from ..streaming.slots import rescheduled
from .registry import query

AS_OF = "1998-06-15"


@query("""SELECT event_id, event_type LIKE 'pur%' AS by_prefix, coalesce(props LIKE '%: 1%', false) AS by_text FROM events WHERE event_type LIKE 'pur%' OR props LIKE '%: 1%'""")
def f4_like(spark, sf_dir):
    """Rows by the beginning of a key or by what a JSON text contains."""
    prefix, inside = F.startswith("event_type", F.lit("pur")), F.coalesce(F.contains("props", F.lit(": 1")), F.lit(False))
    return table(spark, sf_dir, "events").filter(prefix | inside).select("event_id", prefix.alias("by_prefix"), inside.alias("by_text"))


@query("SELECT event_id, ts FROM events WHERE json_extract_string(props, '$.k') = '87'")
def f5_json_path(spark, sf_dir):
    """Rows by a field within a JSON text; malformed texts match nothing."""
    return table(spark, sf_dir, "events").filter(F.get_json_object("props", "$.k") == "87").select("event_id", "ts")


@query(f"SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate AND o_orderdate <= TIMESTAMP '{AS_OF} 00:00:00'")
def f8_anomalies(spark, sf_dir):
    """Work of the past whose evidence is older than the work itself; there should be none."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    wrong = (F.col("l_shipdate") < F.col("o_orderdate")) & (F.col("o_orderdate") <= F.lit(f"{AS_OF} 00:00:00").cast(o.schema["o_orderdate"].dataType))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter(wrong).select("l_orderkey", "l_linenumber", "l_shipdate", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 200")
def f9_clamped_page(spark, sf_dir):
    """The newest work, as many rows as a user asks for, but one at least and 200 at most: here 500."""
    return table(spark, sf_dir, "orders").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(V.clamped(500, 200)).select("o_orderkey", "o_orderdate")


@query("SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day, CAST(max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS DATE) AS last_done FROM orders GROUP BY 1")
def g4_min_max(spark, sf_dir):
    """The first and last day of each household's work, and the last of what is done."""
    day = lambda c: F.to_date(c)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        day(F.min("o_orderdate")).alias("first_day"), day(F.max("o_orderdate")).alias("last_day"), day(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))).alias("last_done")
    )


@query("SELECT r_regionkey, 'seed ' || r_name || ' ' || i AS name, i AS nth FROM region CROSS JOIN (SELECT unnest(range(1, 11)) AS i)")
def s17_series(spark, sf_dir):
    """Ten seed rows for each region."""
    n = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long")))
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name", n.alias("nth"))
    return r.select("r_regionkey", F.concat_ws(" ", F.lit("seed"), "r_name", F.col("nth").cast("string")).alias("name"), "nth")


@query("SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS start_date, CASE WHEN o_orderstatus = 'P' THEN 'there before' END AS remark FROM orders WHERE o_orderstatus IN ('P', 'O')")
def s18_copied(spark, sf_dir):
    """Rows of one table added to another, which has a column more, and read back with what was there."""
    path, o = new_folder(spark, "s18"), table(spark, sf_dir, "orders")
    as_there = lambda status, remark: o.filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("start_date"), F.lit(remark).cast("string").alias("remark"))
    as_there("P", "there before").write.parquet(path)
    as_there("O", None).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("SELECT vec_id, len(embedding) AS width, '{\"label\":\"' || label || '\",\"source\":\"embeddings\"}' AS metadata FROM embeddings")
def s16_vector_rows(spark, sf_dir):
    """Vectors as a store takes them: with their metadata as flat text."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.struct("label", F.lit("embeddings").alias("source")).alias("metadata"))
    return D.vector_rows(rows, "metadata").select("vec_id", F.size("embedding").cast("long").alias("width"), "metadata")


@query("""SELECT p_partkey, CAST(least(30, greatest(cap * CASE WHEN wide THEN 3 ELSE 2 END, cap + 6)) AS INT) AS k FROM (SELECT p_partkey, greatest(1, least(p_size, 12)) AS cap, contains(p_type, 'PROMO') OR contains(p_name, 'ring') AS wide FROM part)""")
def v2_fetch_size(spark, sf_dir):
    """How many neighbours to fetch, by the limit asked for and whether boosts will reorder them."""
    wide = F.contains("p_type", F.lit("PROMO")) | F.contains("p_name", F.lit("ring"))
    return table(spark, sf_dir, "part").select("p_partkey", V.fetch_size(F.col("p_size"), wide).cast("int").alias("k"))


#: Vectors of these labels are in the store; questions are answered by it up to this distance.
STORED, NEAR = 4, 0.64

_WORDS = r"list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: length(x) > 3))"
_ASKED = f"q AS (SELECT vec_id AS query_id, embedding, list_slice(list_sort({_WORDS}), 1, 4) AS words FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0)"
_POINTS = r"3 * len(list_filter(words, lambda w: length(w) >= 2 AND contains(lower(text), w))) + least(10, len(list_intersect(list_distinct(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')), words)))"
_LEXICAL = f"""l AS (SELECT query_id, doc_id AS id, {_POINTS} AS score, source = 'src3' AS pref FROM q CROSS JOIN documents),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth, row_number() OVER (PARTITION BY query_id, pref ORDER BY score DESC, id) AS pick FROM l WHERE score > 0),
k AS (SELECT *, bool_or(pref AND nth <= 6) OVER (PARTITION BY query_id) AS has, bool_or(pref) OVER (PARTITION BY query_id) AS exists_pref FROM r),
c AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM k WHERE nth <= CASE WHEN has OR NOT exists_pref THEN 6 ELSE 5 END OR (exists_pref AND NOT has AND pref AND pick = 1))"""


def questions(spark, sf_dir):
    """Every hundredth vector as a question, with the words of the document of its number that come first."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda x: F.char_length(x) > 3))
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").join(texts, "vec_id")
    return asked.select(F.col("vec_id").alias("query_id"), "embedding", F.slice(F.array_sort(words), 1, 4).alias("words"))


def lexical(spark, sf_dir, asked):
    """The six best texts by words, one of a preferred source among them where there is any."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return V.lexical_hits(asked, texts, 6, F.col("source") == "src3")


@query(f"WITH {_ASKED}, {_LEXICAL} SELECT query_id, id, CAST(score AS BIGINT) AS score, CAST(rank AS INT) AS rank FROM c")
def v8_preferred(spark, sf_dir):
    """Texts of most words in common with each question, the preferred source always among them."""
    return lexical(spark, sf_dir, questions(spark, sf_dir))


@query(f"""WITH {_ASKED}, {_LEXICAL}, near AS (SELECT query_id, vec_id AS id, round(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS far FROM q JOIN embeddings e ON e.label <= {STORED} AND vec_id <> query_id),
v AS (SELECT query_id, id, 1 AS backend FROM near WHERE far <= {NEAR} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY far, id) <= 4),
w AS (SELECT item_id, unnest(list_distinct(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'))) AS w FROM benchmark), m AS (SELECT query_id, item_id, count(*) AS n FROM (SELECT query_id, unnest(words) AS w FROM q) JOIN w USING (w) GROUP BY 1, 2),
s AS (SELECT query_id, item_id AS id, 2 AS backend FROM m WHERE query_id NOT IN (SELECT query_id FROM v) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, item_id) <= 4)
SELECT * FROM v UNION ALL SELECT * FROM s UNION ALL SELECT query_id, id, 3 FROM c WHERE query_id NOT IN (SELECT query_id FROM v) AND query_id NOT IN (SELECT query_id FROM s)""")
def v9_cascade(spark, sf_dir):
    """For each question the hits of the first backend that has any: near vectors in the store, items of a keyword store, texts by
    their words. What comes later is asked for what is open only."""
    e, items = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark")

    def vectors(asked):
        near = V.nearest(asked, e.filter(F.col("label") <= STORED), 5, "query_id", "vec_id", "embedding").filter((F.col("distance") <= NEAR) & (F.col("id") != F.col("query_id")))
        return R.first_n(near, ["query_id"], 4, "distance", "id").select("query_id", "id")

    def keywords(asked):
        words = items.select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("w"))
        met = asked.select("query_id", F.explode("words").alias("w")).join(words, "w").groupBy("query_id", "item_id").agg(F.count("*").alias("n"))
        return R.first_n(met, ["query_id"], 4, F.desc("n"), "item_id").select("query_id", F.col("item_id").alias("id"))

    return V.answered(held(questions(spark, sf_dir)), "query_id", [vectors, keywords, lambda asked: lexical(spark, sf_dir, asked).select("query_id", "id")])


@query("""SELECT doc_id, lang, source FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE lang = 'fr' AND source IS NOT NULL) OR source IS NULL UNION ALL SELECT -doc_id, 'fr', source FROM documents WHERE lang = 'fr' AND source IS NOT NULL""")
def w3_replaced(spark, sf_dir):
    """All rows of a file go where there are new rows for it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    new = d.filter("lang = 'fr' AND source IS NOT NULL").select((-F.col("doc_id")).alias("doc_id"), "lang", "source")
    return D.replaced(d, new, ["source"])


@query("SELECT 'logs' AS name, count(*) AS n_before, 0 AS n_after, count(*) AS n_again FROM events UNION ALL SELECT 'pages', count(*), 0, count(*) FROM pages")
def w9_truncated(spark, sf_dir):
    """Tables that are emptied: the rows that each had, has then, and has again when it is filled anew."""
    found = []
    for name, source, key in (("logs", "events", "event_id"), ("pages", "pages", "page_id")):
        path, rows = new_folder(spark, f"w9-{name}"), table(spark, sf_dir, source).select(key)
        rows.write.parquet(path)
        before, after = emptied(spark, path), spark.read.parquet(path).count()
        rows.write.mode("append").parquet(path)
        found.append(spark.read.parquet(path).agg(F.count("*").alias("n_again")).select(F.lit(name).alias("name"), F.lit(before).cast("long").alias("n_before"), F.lit(after).cast("int").alias("n_after"), "n_again"))
    return found[0].unionByName(found[1])


#: Which kinds of evidence a piece of work needs; a dimension.
NEEDS = [("1-URGENT", ["before", "during", "after"]), ("2-HIGH", ["before", "after"]), ("3-MEDIUM", ["after"]), ("5-LOW", [])]


@query("""SELECT o_orderkey, coalesce(n, 1) AS n_required, coalesce(kinds, 'photo') AS kinds FROM orders LEFT JOIN (VALUES ('1-URGENT', 3, 'before,during,after'), ('2-HIGH', 2, 'before,after'), ('3-MEDIUM', 1, 'after'), ('5-LOW', 0, '')) t(p, n, kinds) ON o_orderpriority = p""")
def z2_required(spark, sf_dir):
    """The kinds of evidence that each work needs; a photo where nothing is said."""
    dim = spark.createDataFrame(NEEDS, "o_orderpriority string, kinds array<string>")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(R.small(dim), "o_orderpriority", "left")
    kinds = F.coalesce("kinds", F.array(F.lit("photo")))
    return o.select("o_orderkey", F.size(kinds).alias("n_required"), F.array_join(kinds, ",").alias("kinds"))


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type FROM events), b AS (SELECT user_id, day, count(*) AS base FROM e WHERE event_type NOT IN ('signup', 'view') GROUP BY ALL), m AS (SELECT user_id, day, count(*) AS others FROM e WHERE event_type = 'view' AND event_id % 3 = 0 GROUP BY ALL),
n AS (SELECT user_id, day, event_id, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id, day) AS own FROM e WHERE event_type = 'signup'),
w AS (SELECT user_id, day, event_id, CAST(coalesce(base, 0) + CASE WHEN i <= coalesce(others, 0) THEN greatest(coalesce(others, 0), own) ELSE 0 END + i AS INT) AS exec_no FROM n LEFT JOIN b USING (user_id, day) LEFT JOIN m USING (user_id, day))
SELECT 'journal' AS target, user_id, day, event_id, exec_no, CAST(NULL AS BIGINT) AS prj_id FROM w UNION ALL SELECT 'bridge', user_id, day, event_id, exec_no, event_id % 7 FROM w WHERE event_id % 7 <> 0""")
def z6_diary(spark, sf_dir):
    """New diary entries in the journal and, where they belong to work, in the bridge, as the tables have them afterwards. Others write
    entries of the same days in between: the numbers that these take are given out again."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type", F.nullif(F.col("event_id") % 7, F.lit(0)).alias("prj_id"))
    journal, bridge, columns = new_folder(spark, "z6-journal"), new_folder(spark, "z6-bridge"), ["user_id", "day", "event_id", "exec_no"]
    nothing = e.limit(0).withColumn("exec_no", F.lit(0))
    numbered = lambda rows, there: R.numbered_after(rows, there, ["user_id", "day"], "exec_no", F.asc("event_id"))
    numbered(e.filter("event_type NOT IN ('signup', 'view')"), nothing).select(columns).write.parquet(journal)
    nothing.select(*columns, "prj_id").write.parquet(bridge)
    others = []

    def meanwhile():
        if not others:
            others.append(held(numbered(e.filter("event_type = 'view' AND event_id % 3 = 0"), spark.read.parquet(journal)).select(columns)))
            others[0].write.mode("append").parquet(journal)

    D.write_diary(e.filter("event_type = 'signup'"), journal, bridge, ["user_id", "day"], "exec_no", "prj_id", F.asc("event_id"), meanwhile=meanwhile)
    new = spark.read.parquet(journal).join(e.filter("event_type = 'signup'").select("event_id"), "event_id", "left_semi")
    none = F.lit(None).cast("long").alias("prj_id")
    return new.select(F.lit("journal").alias("target"), *columns, none).unionByName(spark.read.parquet(bridge).select(F.lit("bridge").alias("target"), *columns, "prj_id"))


@query(r"""WITH p AS (SELECT 'N-' || n_nationkey AS place, lower(substr(n_name, 1, 3)) AS alias, n_nationkey AS prio FROM nation UNION ALL SELECT 'N-' || n_nationkey, lower(n_name), n_nationkey FROM nation UNION ALL SELECT 'R-' || r_regionkey, lower(substr(r_name, 1, 2)), 100 + r_regionkey FROM region),
m AS (SELECT item_id, arg_min(place, (prio, place)) AS place FROM benchmark JOIN p ON contains(lower(text), alias) GROUP BY 1)
SELECT item_id, coalesce(place, nullif(upper(regexp_extract(text, '(?i)\b(p-[0-9]+)\b', 1)), '')) AS place FROM benchmark LEFT JOIN m USING (item_id)""")
def z10_place(spark, sf_dir):
    """The place that a text is about: by the names that people use for it, which are a dimension, else by a code in the text."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    alias = lambda df, mark, key, name, first: df.select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("place"), F.lower(name).alias("alias"), (F.lit(first) + F.col(key)).alias("prio"))
    places = alias(n, "N-", "n_nationkey", F.substring("n_name", 1, 3), 0).unionByName(alias(n, "N-", "n_nationkey", "n_name", 0)).unionByName(alias(r, "R-", "r_regionkey", F.substring("r_name", 1, 2), 100))
    code = F.nullif(F.upper(F.regexp_extract("text", r"(?i)\b(p-[0-9]+)\b", 1)), F.lit(""))
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.coalesce(X.first_alias(b, "text", places), code).alias("place"))


@query("""WITH h AS (SELECT * FROM (VALUES ('0101', NULL, 'New Year'), ('0301', NULL, 'Independence Movement Day'), ('0505', NULL, 'Children''s Day'), (NULL, DATE '2024-02-10', 'Lunar New Year'), (NULL, DATE '2024-05-15', 'Buddha''s Birthday'), (NULL, DATE '2024-09-17', 'Harvest Festival'), (NULL, DATE '2024-01-10', 'Village Day')) t(mmdd, day, name))
SELECT e.day, name, n FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) e LEFT JOIN h ON h.day = e.day OR h.mmdd = strftime(e.day, '%m%d')""")
def z12_holidays(spark, sf_dir):
    """Each day with its holiday: of the solar calendar every year, of the lunar one by dates."""
    dim = spark.createDataFrame(D.HOLIDAYS, "mmdd string, day string, name string")
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return D.with_holidays(days, dim, "day").select("day", "name", "n")


@query("""WITH r AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events), s AS (SELECT event_id, k, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'after' END AS direction, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 20 END AS lo, CASE WHEN k % 4 = 0 THEN NULL ELSE k % 13 END AS hi, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 5 - 2 END AS times FROM r),
v AS (SELECT *, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 3 - 1 END AS c, CASE WHEN k % 4 = 1 THEN 'photo ' || k ELSE '' END AS m, CASE WHEN k % 6 = 0 THEN 'given' ELSE '' END AS b, CASE WHEN k % 7 = 0 THEN '(증빙방법) : report ' || k WHEN k % 7 = 1 THEN ' ' ELSE NULL END AS line FROM s),
w AS (SELECT *, CASE WHEN k % 7 = 0 THEN line ELSE b END AS basis, CASE WHEN m = '' AND k % 7 = 0 THEN 'report ' || k ELSE m END AS method FROM v)
SELECT event_id, direction, CAST(least(coalesce(lo, hi), coalesce(hi, lo)) AS INT) AS min_days, CAST(greatest(coalesce(lo, hi), coalesce(hi, lo)) AS INT) AS max_days, CAST(greatest(1, coalesce(times, 1)) AS INT) AS times,
CASE WHEN c IS NOT NULL OR basis <> '' OR method <> '' THEN CAST(greatest(1, coalesce(c, 1)) AS INT) END AS evidence_count, CASE WHEN c IS NOT NULL OR basis <> '' OR method <> '' THEN method END AS evidence_method, CASE WHEN c IS NOT NULL OR basis <> '' OR method <> '' THEN basis END AS evidence_basis FROM w""")
def z16_rules(spark, sf_dir):
    """Rules written as JSON with gaps, put in order: of dates a direction, least and most days, how often; of evidence how many
    pieces, the method and what it is based on."""
    k = F.get_json_object("props", "$.k").cast("long")
    gap = lambda hole, v: F.when(k % hole == 0, None).otherwise(v.cast("string"))
    fields = F.create_map(F.lit("dir"), F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise(""), F.lit("min"), gap(3, k % 20), F.lit("max"), gap(4, k % 13), F.lit("times"), gap(5, k % 5 - 2))
    text, proof = k.cast("string"), lambda *kv: F.to_json(F.create_map(*kv))
    shown = proof(F.lit("count"), gap(3, k % 3 - 1), F.lit("method"), F.when(k % 4 == 1, F.concat(F.lit(" photo "), text)).otherwise(""), F.lit("basis"), F.when(k % 6 == 0, "given"))
    line = F.when(k % 7 == 0, F.concat(F.lit("(증빙방법) : report "), text)).when(k % 7 == 1, " ")
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(fields).alias("rule"), shown.alias("proof"), line.alias("line"))
    out = D.normal_evidence(D.normal_rules(e, "rule", "after"), "proof", "line")
    return out.select("event_id", "direction", "min_days", "max_days", "times", "evidence_count", "evidence_method", "evidence_basis")


@query("""SELECT 'm' || m AS model, p_partkey AS file, CASE WHEN p_size % (m + 2) = 0 THEN 'UNCERTAIN' WHEN p_retailprice > 1000 * m THEN 'OK' ELSE 'REJECT' END AS status, CAST(100 * m + p_size AS INT) AS latency_ms FROM part CROSS JOIN (VALUES (1), (2), (3)) t(m)""")
def z18_run_log(spark, sf_dir):
    """One row for each picture and each of three models."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("m"))
    status = F.when(F.col("p_size") % (F.col("m") + 2) == 0, "UNCERTAIN").when(F.col("p_retailprice") > 1000 * F.col("m"), "OK").otherwise("REJECT")
    return p.select(F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"), F.col("p_partkey").alias("file"), status.alias("status"), (100 * F.col("m") + F.col("p_size")).cast("int").alias("latency_ms"))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey AS pos, p_brand AS heading, p_type = 'PROMO' AS is_header, p_size AS score, string_split(lower(p_name), ' ') AS names, p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE ': ' || CAST(floor(p_retailprice) AS INT) || ' won per ha' END AS content, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS INT) END AS price FROM part),
r AS (SELECT DISTINCT id, pos, heading, score, content, price, unnest(names) AS name FROM p), m AS (SELECT name, count(*) AS n_exact, sum(score) AS score, max(price) AS most FROM r WHERE name <> '' GROUP BY 1),
x AS (SELECT DISTINCT r.name, p.id FROM r JOIN p ON p.heading = r.heading UNION SELECT DISTINCT r.name, p.id FROM r JOIN p ON abs(p.pos - r.pos) <= 2),
near AS (SELECT name, count(*) FILTER (is_header) AS n_headers, arg_max(id, (score, -id)) AS top, arg_max(content, (score, -id)) AS excerpt FROM x JOIN p USING (id) GROUP BY 1)
SELECT name, n_exact, n_headers, CAST(m.score + 5 * n_headers AS BIGINT) AS score, top, excerpt, coalesce((SELECT max(price) FROM r WHERE r.name = m.name AND r.id = top), most) AS price FROM m JOIN near USING (name) ORDER BY n_exact DESC, n_headers DESC, score DESC, name LIMIT 12""")
def z21_suggestions(spark, sf_dir):
    """Activities named in rows: by how many rows name them, by header rows under their headings and near them, by score; with the
    best excerpt and its price; the first twelve."""
    p = table(spark, sf_dir, "part")
    priced = F.col("p_size") % 3 != 0
    content = F.concat("p_name", F.when(priced, F.concat(F.lit(": "), F.floor("p_retailprice").cast("int").cast("string"), F.lit(" won per ha"))).otherwise(""))
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("at"), F.col("p_brand").alias("heading"), (F.col("p_type") == "PROMO").alias("is_header"), F.col("p_size").alias("score"), F.split(F.lower("p_name"), " ").alias("names"), content.alias("content"))
    price = F.nullif(F.regexp_extract("content", r": ([0-9]+) won", 1), F.lit("")).cast("int")
    return D.suggestions(rows.withColumn("price", price), 12)


#: Which work hangs on which, and how many days after it.
FOLLOWS = [("click", "view", 1, 3), ("click", "signup", 7, 10), ("signup", "purchase", 0, 14)]


@query("""WITH a AS (SELECT user_id AS owner, event_type, event_id AS "at", CAST(ts AS DATE) AS day FROM events), r AS (SELECT * FROM (VALUES ('click', 'view', 1, 3), ('click', 'signup', 7, 10), ('signup', 'purchase', 0, 14)) t(ref_job, job, lo, hi)),
m AS (SELECT owner, job, "at", day + lo AS start_day, day + hi AS end_day, row_number() OVER (PARTITION BY owner, job ORDER BY "at" DESC) AS n FROM a JOIN r ON event_type = ref_job)
SELECT owner, job, "at", CAST(start_day AS DATE) AS start_day, CAST(end_day AS DATE) AS end_day FROM m WHERE n = 1""")
def m3_rescheduled(spark, sf_dir):
    """The dates of the work that hangs on each household's last done work of a kind; the same rows that the stream writes."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("job"), F.col("event_id").alias("at"), F.to_date("ts").alias("done_day"))
    new = rescheduled(e, R.small(spark.createDataFrame(FOLLOWS, "ref_job string, job string, days_min int, days_max int")))
    return R.upsert(new.limit(0), new, ["owner", "job"], F.desc("at"))
