"""Extraction, headings and captions, bound to documents, pages, conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import extraction as X
from ..operators import relational as R
from ..sources.tables import table
from .registry import query

_NOTE = "CASE o_orderkey % 4 WHEN 0 THEN 'within ' || (o_orderkey % 20) || ' days' WHEN 1 THEN 'gap ' || (o_orderkey % 9) || ' days, 3 photos' WHEN 2 THEN 'from start to end photos' ELSE 'free' END"
_DAYS = [r"gap ([0-9]+) days", r"within ([0-9]+) days"]


def _notes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.expr(_NOTE).alias("note"))


@query(f"""WITH n AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, {_NOTE} AS note FROM orders), d AS (SELECT *, coalesce(nullif(TRY_CAST(regexp_extract(note, '{_DAYS[0]}', 1) AS INT), 0), nullif(TRY_CAST(regexp_extract(note, '{_DAYS[1]}', 1) AS INT), 0)) AS days FROM n)
SELECT o_orderkey, days, CASE WHEN days IS NULL THEN day + 10 ELSE least(day + 10, day + days) END AS end_day FROM d""")
def e2_interval(spark, sf_dir):
    """The days that a note allows, and the end that they leave."""
    n = _notes(spark, sf_dir).withColumn("days", X.first_number(F.col("note"), _DAYS))
    return n.select("o_orderkey", "days", X.capped_end(F.col("day"), F.date_add("day", 10), F.col("days")).alias("end_day"))


@query(f"""SELECT o_orderkey, CAST(CASE WHEN regexp_matches(note, '[0-9]+ photos') THEN greatest(1, least(10, CAST(regexp_extract(note, '([0-9]+) photos', 1) AS INT))) WHEN regexp_matches(note, 'start.*end.*photos') THEN 2 ELSE 1 END AS INT) AS times
FROM (SELECT o_orderkey, {_NOTE} AS note FROM orders)""")
def e3_repeat_count(spark, sf_dir):
    """How often a note asks for a photo, from 1 to 10."""
    note = F.col("note")
    n = F.greatest(F.lit(1), F.least(F.lit(10), X.first_number(note, ["([0-9]+) photos"])))
    times = F.when(note.rlike("[0-9]+ photos"), n).when(note.rlike("start.*end.*photos"), 2).otherwise(1)
    return _notes(spark, sf_dir).select("o_orderkey", times.alias("times"))


@query()
def e5_best_match(spark, sf_dir):
    """Part names and the tool that each is most like. The names are few; each is compared once."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.join(X.best_match(p, "p_name", ["small ring", "widgets", "iron rod"]), "p_name", "left").select("p_partkey", "choice", "score")


_PATH = "regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/', ' > ', 'g')"


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/", " > ").alias("h"))


@query(rf"""WITH p AS (SELECT page_id, {_PATH} AS h, trim(regexp_replace({_PATH}, '^(.*) > .*$', '\1')) AS up FROM pages)
SELECT a.page_id, CAST(CASE WHEN a.h = '' OR b.h = '' OR a.h IS NULL OR b.h IS NULL THEN 0 WHEN a.h = b.h THEN 3 WHEN starts_with(a.h, b.h) OR starts_with(b.h, a.h) THEN 2 WHEN a.up <> '' AND a.up = b.up THEN 1 ELSE 0 END AS INT) AS points FROM p a JOIN p b ON b.page_id = a.page_id + 1""")
def e7_heading_likeness(spark, sf_dir):
    """How alike the places of a page and the next are."""
    p = _paths(spark, sf_dir)
    b = p.select((F.col("page_id") - 1).alias("page_id"), F.col("h").alias("g"))
    return p.join(b, "page_id").select("page_id", X.heading_likeness(F.col("h"), F.col("g")).alias("points"))


_POINTS = "20 * CAST(contains(text, 'nation') AS INT) + 8 * CAST(contains(text, '?') AS INT) + 3 * CAST(role = 'user' AS INT)"


@query(f"""WITH s AS (SELECT conv_id, turn, {_POINTS} AS points FROM conversations), t AS (SELECT * FROM s WHERE points > 0 ORDER BY points DESC, conv_id, turn LIMIT 12)
SELECT DISTINCT c.conv_id, c.turn FROM s c JOIN t ON t.conv_id = c.conv_id AND abs(t.turn - c.turn) <= 1""")
def e9_context(spark, sf_dir):
    """The twelve turns of most points, with those beside them."""
    has = lambda w: F.contains("text", F.lit(w)).cast("int")
    points = 20 * has("nation") + 8 * has("?") + 3 * (F.col("role") == "user").cast("int")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", points.alias("points"))
    seeds = c.filter("points > 0").orderBy(F.desc("points"), "conv_id", "turn").limit(12)
    near = seeds.select("conv_id", F.explode(F.array(F.col("turn") - 1, F.col("turn"), F.col("turn") + 1)).alias("turn")).distinct()
    return c.select("conv_id", "turn").distinct().join(near, ["conv_id", "turn"])


_ALIASES = [("N", "nation"), ("T", "thst"), ("A", "a")]
_NEGATIONS = [r"{}\s*excluded", r"(not|without)\s+{}"]


@query(r"""WITH f AS (SELECT doc_id, regexp_replace(lower(text), '[ \t\r\n]+', '', 'g') AS flat, text FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN contains(flat, 'nation') AND NOT regexp_matches(text, 'nation\s*excluded|(not|without)\s+nation') THEN 'N' END, CASE WHEN contains(flat, 'thst') AND NOT regexp_matches(text, 'thst\s*excluded|(not|without)\s+thst') THEN 'T' END,
CASE WHEN regexp_matches(text, '(^|[^0-9A-Za-z])a([^0-9A-Za-z]|$)') AND NOT regexp_matches(text, 'a\s*excluded|(not|without)\s+a') THEN 'A' END) AS codes FROM f""")
def e10_aliases(spark, sf_dir):
    """The codes whose alias a text names and doesn't exclude."""
    codes = [F.when(X.has_alias(F.col("text"), alias, _NEGATIONS), code) for code, alias in _ALIASES]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", *codes).alias("codes"))


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN contains(p_name, 'ring') OR contains(p_name, 'bolt') WHEN 'LARGE' THEN contains(p_name, 'widget') ELSE true END AS passes FROM part")
def e12_keyword_check(spark, sf_dir):
    """Whether a name has a word that its kind requires; kinds without a list pass."""
    need = F.create_map(F.lit("PROMO"), F.array(F.lit("ring"), F.lit("bolt")), F.lit("LARGE"), F.array(F.lit("widget")))
    ok = F.exists(F.try_element_at(need, F.col("p_type")), lambda w: F.contains("p_name", w))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(ok, F.lit(True)).alias("passes"))


@query(r"""SELECT item_id, regexp_replace(regexp_replace(replace(replace(text, 'tion', 'sion'), ',', ';'), '[ \t\n]+', ' ', 'g'), '(oo)+', 'o', 'g') AS text FROM benchmark""")
def e13_repair(spark, sf_dir):
    """Texts after replacements in order: words first, then patterns."""
    t = X.repaired(F.col("text"), [("tion", "sion"), (",", ";")], [(r"[ \t\n]+", " "), ("(oo)+", "o")])
    return table(spark, sf_dir, "benchmark").select("item_id", t.alias("text"))


@query("""WITH q AS (SELECT o_orderkey, strftime(o_orderdate, '%m/%d') || CASE o_orderkey % 3 WHEN 0 THEN ' sown, when to drain' WHEN 1 THEN ' sown, thanks' ELSE ' when to drain' END AS q FROM orders)
SELECT o_orderkey, '2024-' || replace(regexp_extract(q, '[0-9]{2}/[0-9]{2}'), '/', '-') AS day, 'drain' AS target FROM q WHERE contains(q, 'sown') AND contains(q, 'when') AND contains(q, 'drain')""")
def e14_date_intent(spark, sf_dir):
    """Questions that name a day, what was done then, and what is asked for."""
    tail = F.when(F.col("o_orderkey") % 3 == 0, " sown, when to drain").when(F.col("o_orderkey") % 3 == 1, " sown, thanks").otherwise(" when to drain")
    q = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "MM/dd"), tail).alias("q"))
    m, d = (F.regexp_extract("q", "([0-9]{1,2})/([0-9]{1,2})", i).try_cast("int") for i in (1, 2))
    day = F.format_string("2024-%02d-%02d", m, d)
    done, wanted = X.first_word(F.col("q"), [("seed", ["sown"])], None), X.first_word(F.col("q"), [("drain", ["drain"])], None)
    asked = m.between(1, 12) & d.between(1, 31) & done.isNotNull() & F.contains("q", F.lit("when")) & wanted.isNotNull()
    return q.filter(asked).select("o_orderkey", day.alias("day"), wanted.alias("target"))


_H = "SELECT conv_id, turn, CASE WHEN (turn * 7 + conv_id) % 4 > 0 THEN (turn * 7 + conv_id) % 4 END AS depth, 'T' || turn AS title FROM conversations"
_UP = "nullif(arg_max(CASE WHEN depth = {d} THEN title ELSE '' END, turn) FILTER (depth <= {d}) OVER (PARTITION BY conv_id ORDER BY turn), '')"


@query(f"SELECT conv_id, turn, concat_ws(' > ', {', '.join(_UP.format(d=d) for d in (1, 2, 3))}) AS path FROM ({_H})")
def d2_heading_path(spark, sf_dir):
    """The open headings at each turn."""
    n = (F.col("turn") * 7 + F.col("conv_id")) % 4
    h = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(n > 0, n).alias("depth"), F.concat(F.lit("T"), F.col("turn").cast("string")).alias("title"))
    return X.with_heading_path(h, ["conv_id"], "turn", "depth", "title", 3).select("conv_id", "turn", "path")


@query("SELECT p_partkey, concat_ws(chr(10), 'name: ' || p_name, 'kind: ' || p_type, 'size: ' || p_size) AS content FROM part")
def d12_row_documents(spark, sf_dir):
    """Rows as texts of "header: value" lines."""
    line = lambda h, c: F.concat(F.lit(f"{h}: "), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n", line("name", "p_name"), line("kind", "p_type"), line("size", "p_size")).alias("content"))


@query(f"SELECT page_id, array_to_string(list_filter(string_split({_PATH}, ' > '), lambda x: NOT regexp_full_match(x, '[0-9]+') AND x <> ''), ' > ') AS path FROM pages")
def d14_clean_path(spark, sf_dir):
    """Heading paths without the parts that are numbers."""
    parts = F.filter(F.split("h", " > "), lambda x: ~x.rlike("^[0-9]+$") & (x != ""))
    return _paths(spark, sf_dir).select("page_id", F.array_join(parts, " > ").alias("path"))


@query(r"SELECT doc_id, '[' || coalesce(source, '') || ' > ' || coalesce(lang, '') || ']' || chr(10) || text AS prefixed, text AS body FROM documents")
def d15_context_prefix(spark, sf_dir):
    """A line of context before the text, and the text with it taken off again."""
    head = F.concat(F.lit("["), F.coalesce("source", F.lit("")), F.lit(" > "), F.coalesce("lang", F.lit("")), F.lit("]\n"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.col("text")).alias("prefixed"))
    return d.select("doc_id", "prefixed", F.regexp_replace("prefixed", r"^\[[^\]\n]*\]\n", "").alias("body"))


@query(r"""SELECT doc_id, CASE WHEN contains(text, 'License') OR contains(text, 'Copyright') THEN 'license' WHEN contains(text, '@') THEN 'contact' ELSE 'other' END AS kind, coalesce(TRY_CAST(nullif(regexp_extract(text, '[vV]([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE), 1.0) AS version,
TRY_CAST(regexp_replace(regexp_extract(text, '20[0-9]{2}-[0-9]{2}-[0-9]{2}'), '^$', 'none') AS DATE) AS published FROM documents""")
def d16_metadata(spark, sf_dir):
    """Kind, version and day of publication from the text."""
    text = F.col("text")
    kind = X.first_word(text, [("license", ["License", "Copyright"]), ("contact", ["@"])], "other")
    version = F.coalesce(F.regexp_extract("text", r"[vV]([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(1.0))
    day = F.try_to_date(F.regexp_extract("text", "20[0-9]{2}-[0-9]{2}-[0-9]{2}", 0), "yyyy-MM-dd")
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), version.alias("version"), day.alias("published"))


@query("SELECT c_custkey, regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]+', '-', 'g') || '-' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 6) AS slug FROM customer")
def d17_slug(spark, sf_dir):
    short = F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 6)
    slug = F.regexp_replace(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), "[^a-z0-9]+", "-")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(slug, F.lit("-"), short).alias("slug"))


@query("SELECT conv_id, turn, coalesce(h, last_value(h IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn)) AS heading FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS h FROM conversations)")
def n8_heading_fill(spark, sf_dir):
    """The last heading, carried to the rows below it."""
    h = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("heading"))
    return R.carried_forward(h, ["conv_id"], "turn", "heading").drop("is_extrapolated")


@query("""WITH c AS (SELECT conv_id, turn, turn // 3 AS kind, CASE WHEN turn % 4 = 0 THEN 'C' || turn END AS caption FROM conversations)
SELECT conv_id, turn, coalesce(caption, last_value(caption IGNORE NULLS) OVER (PARTITION BY conv_id, kind ORDER BY turn)) AS caption FROM c""")
def n9_captions(spark, sf_dir):
    """Captions carried along runs of a kind, and no further."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 3).alias("kind"), F.when(F.col("turn") % 4 == 0, F.concat(F.lit("C"), F.col("turn").cast("string"))).alias("caption"))
    return X.with_captions(c, ["conv_id"], "turn", "kind", "caption").select("conv_id", "turn", "caption")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents), k AS (SELECT doc_id, pos, trim(regexp_replace(content, '[ \t\r\n]+', ' ', 'g')) AS flat, pos % 2 = 1 AS par FROM l),
n AS (SELECT *, lead(flat) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM k) SELECT doc_id, pos FROM n WHERE NOT coalesce(par AND flat = next AND flat <> '', false)""")
def n12_echo(spark, sf_dir):
    """Lines, without those that the next one repeats (odd lines stand for paragraphs, even ones for tables)."""
    l0 = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "content"))
    kind = F.when(F.col("at") % 2 == 0, "paragraph").otherwise("table")
    return X.without_echo(l0.withColumn("kind", kind), ["doc_id"], "at", "kind", "content").select("doc_id", (F.col("at") + 1).cast("long").alias("pos"))


@query("""SELECT item_id, CASE WHEN contains(flat, 'nation') THEN 'nation' WHEN contains(flat, 'tion') THEN 'tion' WHEN contains(flat, 'ing') THEN 'ing' WHEN contains(flat, 'th') THEN 'th' END AS intent
FROM (SELECT item_id, replace(replace(lower(text), ' ', ''), chr(10), '') AS flat FROM benchmark)""")
def v4_intent(spark, sf_dir):
    """The longest keyword in a text; white space doesn't count."""
    flat = F.regexp_replace(F.lower("text"), "[ \n]", "")
    words = sorted(["th", "tion", "ing", "nation"], key=lambda w: (-len(w), w))
    return table(spark, sf_dir, "benchmark").select("item_id", X.first_word(flat, [(w, [w]) for w in words], None).alias("intent"))


@query("""SELECT page_id, TRY_CAST(regexp_replace(url, '[^0-9]', '', 'g') AS BIGINT) AS number FROM pages WHERE contains(html, 'nation') OR contains(url, 'en/') ORDER BY number ASC NULLS LAST, page_id LIMIT 20""")
def v10_summaries(spark, sf_dir):
    """The first twenty by the number in their names of those with a keyword."""
    p = table(spark, sf_dir, "pages").filter(F.contains("html", F.lit("nation")) | F.contains("url", F.lit("en/")))
    n = p.select("page_id", F.regexp_replace("url", "[^0-9]", "").try_cast("bigint").alias("number"))
    return n.orderBy(F.asc_nulls_last("number"), "page_id").limit(20)


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '논물 ' || n_name WHEN 1 THEN '재배 ' || c_mktsegment ELSE coalesce(n_name, '') END AS name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def f15_encoding(spark, sf_dir):
    """Names whose bytes were read in the wrong encoding, of two code pages, put right; each distinct one once."""
    named = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    read_as = lambda text, page: F.decode(F.encode(text, page), "ISO-8859-1")
    kind = F.col("c_custkey") % 4
    # The first two letters in CP949, since the JVM's encode() takes standard code pages only.
    old = F.decode(F.unhex(F.lit("C0E7B9E820")), "ISO-8859-1")
    name = F.when(kind == 0, read_as(F.concat(F.lit("논물 "), "n_name"), "UTF-8")).when(kind == 1, F.concat(old, "c_mktsegment")).otherwise(F.coalesce("n_name", F.lit("")))
    return X.encoding_repaired(named.select("c_custkey", name.alias("name")), "name")


@query()
def d6_blocks(spark, sf_dir):
    """Turns packed into chunks; a change of speaker begins a new one."""
    return C.packed_blocks(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("at"), F.col("role").alias("title"), F.col("text").alias("content")))


@query()
def d7_merge(spark, sf_dir):
    """Turns merged while they stay under the same heading or go below it."""
    h = F.when(F.col("turn") % 3 == 0, "A").when(F.col("turn") % 3 == 1, "A > B").otherwise("C")
    return C.merged_context(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("at"), h.alias("title"), F.col("text").alias("content")))


@query()
def d10_recursive(spark, sf_dir):
    """Documents split at the widest separator that gives pieces small enough."""
    return C.recursive(table(spark, sf_dir, "documents"))


@query("""WITH r AS (SELECT l_orderkey AS doc_id, '| ' || l_linenumber || ' | ' || l_partkey || ' |' AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem)
SELECT doc_id, CAST(i // 4 AS INT) AS chunk, '| no | part |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS content FROM r GROUP BY 1, 2""")
def d11_table_rows(spark, sf_dir):
    """Tables of each work item's lines, split by rows with the header repeated."""
    line = F.format_string("| %s | %s |", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))), lambda r: r["line"]), "\n")
    tables = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("| no | part |\n| --- | --- |\n"), rows).alias("text"))
    return C.table_rows(tables)
