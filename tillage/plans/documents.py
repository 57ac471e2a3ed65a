"""Retrieval, extraction and chunking, bound to documents, embeddings, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import relational as R
from ..operators import retrieval as V
from ..sources.tables import new_folder, table
from .registry import query

_COS = "list_cosine_distance(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))"
_KNN = f"""SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6), b.vec_id) AS rank FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0"""


@query(f"SELECT * FROM ({_KNN}) WHERE rank <= 10")
def v1_knn(spark, sf_dir):
    """The ten nearest vectors of every hundredth, exactly."""
    v = table(spark, sf_dir, "embeddings")
    return V.nearest(v.filter("vec_id % 100 = 0"), v, 10, "vec_id", "vec_id", "embedding")


@query()
def v1_indexed(spark, sf_dir):
    """The ten nearest of every hundredth as an index finds them: all rows are in it, and as many of its cells are looked into as it
    was measured to need for 95 of 100."""
    v, path = table(spark, sf_dir, "embeddings"), new_folder(spark, "v1")
    V.build_index(v, path, "vec_id", "embedding")
    return V.probe_index(v.filter("vec_id % 100 = 0"), path, 10, "vec_id", "embedding")


@query(f"SELECT query_id, id, CAST(CASE WHEN distance < 0 THEN 1000 ELSE greatest(1, round_even(1000 - 1000 * distance, 0)) END AS INT) AS score FROM ({_KNN}) WHERE rank <= 5")
def v3_score(spark, sf_dir):
    """Distances as points."""
    v = table(spark, sf_dir, "embeddings")
    near = V.nearest(v.filter("vec_id % 100 = 0"), v, 5, "vec_id", "vec_id", "embedding")
    return near.select("query_id", "id", V.score(F.col("distance")).alias("score"))


@query(r"""SELECT doc_id, CASE WHEN lang = 'en' THEN 250 ELSE 0 END + CASE WHEN contains(lower(text), 'tion') THEN 250 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]+\s*%') THEN 125 ELSE 0 END AS boost FROM documents""")
def v5_boost(spark, sf_dir):
    """Additive boosts from a field, a word and a pattern."""
    b = F.when(F.col("lang") == "en", 250).otherwise(0) + F.when(F.contains(F.lower("text"), F.lit("tion")), 250).otherwise(0) + F.when(F.col("text").rlike(r"[0-9]+\s*%"), 125).otherwise(0)
    return table(spark, sf_dir, "documents").select("doc_id", b.alias("boost"))


@query(r"""WITH t AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 6) AS jaccard FROM t a JOIN t b ON a.item_id + 1 = b.item_id""")
def v7_jaccard(spark, sf_dir):
    """The share of common words of each item and the next."""
    words = F.array_distinct(F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), ""))
    t = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    a, b = t.alias("a"), t.alias("b")
    return a.join(b, F.col("a.item_id") + 1 == F.col("b.item_id")).select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(V.jaccard(F.col("a.w"), F.col("b.w")), 6).alias("jaccard"))


@query(r"""SELECT doc_id, score FROM (SELECT doc_id, 3 * (CAST(contains(lower(text), 'nation') AS INT) + CAST(contains(lower(text), 'the') AS INT)) + least(10, len(list_filter(list_distinct(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')), lambda x: x IN ('nation', 'the', 'a')))) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 60""")
def v8_lexical(spark, sf_dir):
    """The documents of most words in common with a query. Those without any go after the sixty are chosen, so that no filter
    makes the score be computed twice."""
    s = V.lexical(F.col("text"), ["nation", "the", "a"]).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("score")).orderBy(F.desc("score"), "doc_id").limit(60).filter("score > 0")


@query("SELECT conv_id, turn, used FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS used FROM conversations) WHERE used <= 1500")
def v11_budget(spark, sf_dir):
    """The turns of each conversation that fit a budget of characters."""
    return V.within_budget(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text", 1500).select("conv_id", "turn", "used")


@query()
def v6_diverse(spark, sf_dir):
    """Five of the twenty nearest by relevance and diversity; the likeness is that of the texts' words and bigrams."""
    v = table(spark, sf_dir, "embeddings")
    near = V.nearest(v.filter("vec_id % 100 = 0"), v, 20, "vec_id", "vec_id", "embedding")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    few = near.join(texts, "id").select("query_id", "id", V.score(F.col("distance")).alias("score"), V.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return V.diverse(few, 5)


@query()
def d5_pack(spark, sf_dir):
    """Paragraphs packed into chunks."""
    return C.packed(table(spark, sf_dir, "documents"))


@query()
def d9_split(spark, sf_dir):
    """Overlapping pieces."""
    return C.overlapping(table(spark, sf_dir, "documents"))


@query()
def n6_absorb(spark, sf_dir):
    """Turns as chunks: short ones join the next."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk"), F.col("text").alias("content"))
    return C.absorb_labels(turns, 40)


_LINES = r"SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS chunk FROM documents"


@query(f"""SELECT doc_id, content, min(chunk) AS chunk FROM ({_LINES}) WHERE length(trim(content)) >= 30 GROUP BY 1, 2""")
def d13_filter_dedupe(spark, sf_dir):
    """Lines worth keeping, each once in its document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    return C.worthwhile(lines.select("doc_id", "content", (F.col("pos") + 1).cast("long").alias("chunk")))


@query(r"""SELECT doc_id, nullif(regexp_extract(text, '([0-9]{1,3})\s*%', 1), '') AS percent, CAST(nullif(regexp_extract(text, '([0-9]{4})-[0-9]{2}', 1), '') AS INT) AS year, upper(substr(sha256(text), 1, 8)) AS short_id FROM documents""")
def e1_extract(spark, sf_dir):
    """Figures drawn from texts by patterns, and a short id."""
    year = F.nullif(F.regexp_extract("text", r"([0-9]{4})-[0-9]{2}", 1), F.lit("")).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.regexp_extract("text", r"([0-9]{1,3})\s*%", 1), F.lit("")).alias("percent"), year.alias("year"), F.upper(F.substring(F.sha2("text", 256), 1, 8)).alias("short_id"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 20 ELSE 10 END + CASE WHEN contains(p_name, 'ring') THEN 40 WHEN contains(p_name, 'widget') THEN 18 ELSE 0 END + CASE WHEN p_size <= 10 THEN 8 ELSE 0 END + least(6, p_size // 10) AS score FROM part""")
def e6_score(spark, sf_dir):
    """A sum of points."""
    name = F.col("p_name")
    s = F.when(F.col("p_type") == "PROMO", 20).otherwise(10) + F.when(F.contains(name, F.lit("ring")), 40).when(F.contains(name, F.lit("widget")), 18).otherwise(0) + F.when(F.col("p_size") <= 10, 8).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", (s + F.least(F.lit(6), F.floor(F.col("p_size") / 10).cast("int"))).alias("score"))


@query("""WITH s AS (SELECT conv_id, turn FROM conversations WHERE contains(text, '?')) SELECT DISTINCT c.conv_id, c.turn FROM conversations c JOIN s ON s.conv_id = c.conv_id AND abs(s.turn - c.turn) <= 1""")
def e8_neighbours(spark, sf_dir):
    """Turns with a question mark and those beside them: each seed gives its few neighbours' places, an equi-join keeps those that exist."""
    c = table(spark, sf_dir, "conversations")
    seeds = c.filter(F.contains("text", F.lit("?"))).select("conv_id", F.explode(F.array(F.col("turn") - 1, F.col("turn"), F.col("turn") + 1)).alias("turn")).distinct()
    return c.select("conv_id", "turn").distinct().join(seeds, ["conv_id", "turn"])


_WORDS = {"mail": ("@", "mail"), "price": ("%", "$"), "web": ("http", "www")}


@query("""SELECT doc_id, CASE WHEN a > 0 THEN 'mail' WHEN b > 0 THEN 'price' WHEN c > 0 THEN 'web' END AS kind, CASE WHEN a > 0 THEN CAST([0.45, 0.65][a] AS DOUBLE) WHEN b > 0 THEN CAST([0.45, 0.65][b] AS DOUBLE) WHEN c > 0 THEN CAST([0.45, 0.65][c] AS DOUBLE) ELSE 0.0 END AS confidence
FROM (SELECT doc_id, CAST(contains(text, '@') AS INT) + CAST(contains(text, 'mail') AS INT) AS a, CAST(contains(text, '%') AS INT) + CAST(contains(text, '$') AS INT) AS b, CAST(contains(text, 'http') AS INT) + CAST(contains(text, 'www') AS INT) AS c FROM documents)""")
def e11_classify(spark, sf_dir):
    """The first class, in order, that has a word in the text; more words give more confidence."""
    kind, confidence = F.lit(None).cast("string"), F.lit(0.0)
    for label, words in reversed(_WORDS.items()):
        n = sum((F.contains(F.col("text"), F.lit(w)).cast("int") for w in words), F.lit(0))
        kind = F.when(n > 0, label).otherwise(kind)
        confidence = F.when(n > 1, 0.65).when(n > 0, 0.45).otherwise(confidence)
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), confidence.alias("confidence"))


@query("""SELECT p_partkey, round(len(list_filter(list_distinct(string_split(p_name, '')), lambda x: contains('small ring', x))) / len(list_distinct(string_split(p_name, ''))), 4) AS overlap FROM part""")
def e15_overlap(spark, sf_dir):
    """The share of a name's characters that a query has."""
    chars = F.array_distinct(F.array_remove(F.split("p_name", ""), ""))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.size(F.filter(chars, lambda x: F.contains(F.lit("small ring"), x))) / F.size(chars), 4).alias("overlap"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), nullif(trim(url), ''), 'none') AS label FROM pages")
def f10_label(spark, sf_dir):
    """The first label that isn't blank."""
    p = table(spark, sf_dir, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return p.select("page_id", F.coalesce(R.labelled("title", "url"), F.lit("none")).alias("label"))


@query("SELECT c_custkey, concat(substr(c_name, 1, 9), repeat('*', length(c_name) - 9)) AS masked FROM customer")
def f12_mask(spark, sf_dir):
    """Names with their numbers masked."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.substring("c_name", 1, 9), F.expr("repeat('*', length(c_name) - 9)")).alias("masked"))
