"""Quality rules [native]: a threshold table compiled into one Spark projection, without user functions.

Words are runs of characters other than ASCII white space. Null texts count as empty: no words, all counts 0,
rejected for length. Every row gives one row, repeated rows too, and an empty table none; a very long text costs its
length. judge() gives the columns of the input and its results, which take the place of columns that bear their names;
keep() gives the rows as they were, whatever their columns are called.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words of a repeat window, a power of two.
WINDOW = 8

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the be to of and that have with in is it for on are was as at by this from or an "
    "der die das und ist nicht zu den mit von im auf ein eine für sich des dem auch als "
    "le la les de des et en un une du dans que qui pour pas sur au avec est par "
    "el los las y del se por con para una no lo su al como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject where 100 * metric is outside [least, most] percent of per (or metric itself, where per is empty)."""

    metric: str
    per: str = ""
    least: float | None = None
    most: float | None = None


#: The first two are the base rules; the rest is the method's own table.
BASE_RULES = (Rule("n_words", least=20), Rule("n_repeat_words", per="n_words", most=30))
RULES = (
    Rule("n_words", most=1_000_000),
    Rule("word_chars", per="n_words", least=200, most=1500),
    Rule("n_symbols", per="n_words", most=10),
    Rule("n_stop_words", per="n_words", least=5),
    Rule("n_twin_words", per="n_words", most=20),
    Rule("n_dup_lines", per="n_lines", most=60),
    Rule("n_bullet_lines", per="n_lines", most=90),
    Rule("n_ellipsis_lines", per="n_lines", most=30),
)


def failed(rules: tuple[Rule, ...]) -> Column:
    """One boolean column: whether any rule of the table rejects. An empty denominator rejects nothing."""

    def one(rule: Rule) -> Column:
        value = F.col(rule.metric) * F.lit(100 if rule.per else 1)
        bound = (lambda x: F.lit(x) * F.col(rule.per)) if rule.per else F.lit
        out = F.lit(False)
        if rule.least is not None:
            out = out | (value < bound(rule.least))
        if rule.most is not None:
            out = out | (value > bound(rule.most))
        return out

    return reduce(lambda a, b: a | b, map(one, rules), F.lit(False))


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row as the struct `_row`, with n_words, word_chars, n_symbols, n_stop_words, n_twin_words, n_lines, n_dup_lines,
    n_bullet_lines, n_ellipsis_lines and n_repeat_words (all long): one narrow projection over each row, no shuffle."""
    own = ["_words", "_lines", "_marks", "_sorted", "_text"]
    out = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    out = out.withColumns(
        {
            "_words": F.array_remove(F.split("_text", BLANKS), ""),
            "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    # A digest of each window of WINDOW words, by doubling; only texts where one occurs twice are sorted.
    out = out.withColumn("_marks", F.when(F.size("_words") >= WINDOW, F.transform("_words", lambda x: F.xxhash64(x))))
    step = 1
    while step < WINDOW:
        out = out.withColumn("_marks", F.transform("_marks", lambda x, i: F.xxhash64(x, F.get("_marks", i + step))))  # noqa: B023
        step *= 2
    out = out.withColumn("_marks", F.slice("_marks", F.lit(1), F.greatest(F.size("_marks") - (WINDOW - 1), F.lit(0))))
    out = out.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_marks")) < F.size("_marks"),
            F.sort_array(F.transform("_marks", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )

    def again(x: Column, k: Column) -> Column:
        beside = lambda j: F.coalesce(F.get("_sorted", j)["h"] == x["h"], F.lit(False))
        return beside(k - 1) | beside(k + 1)

    at = F.sort_array(F.transform(F.filter("_sorted", again), lambda x: x["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n")),
    )["n"]
    is_stop = lambda x: F.lower(x).isin(STOP_WORDS)
    long = lambda c: c.cast("long")
    return out.withColumns(
        {
            "n_words": long(F.size("_words")),
            "word_chars": long(F.char_length(F.array_join("_words", ""))),
            "n_symbols": long(F.regexp_count("_text", F.lit(SYMBOLS))),
            "n_stop_words": long(F.size(F.filter("_words", is_stop))),
            "n_twin_words": long(F.size(F.filter("_words", lambda x, i: F.get("_words", i - 1) == x))),
            "n_lines": long(F.size("_lines")),
            "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
            "n_bullet_lines": long(F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]")))),
            "n_ellipsis_lines": long(F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")))),
            "n_repeat_words": long(F.coalesce(covered, F.lit(0))),
        }
    ).drop(*own)


def _judged(docs: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Each row as the struct `_row`, with the metrics, base_failed and kept.

    A filter on these columns stays above the metrics: n_words counts as not deterministic, since it names the row's
    number (times zero). Otherwise the optimizer would write each metric out in the filter again for each of its uses,
    one within the other, and evaluate it so often for each row. Filters on the columns of docs belong before this."""
    held = metrics(docs, text).withColumn("n_words", F.col("n_words") + F.lit(0) * F.monotonically_increasing_id())
    return held.withColumn("base_failed", failed(BASE_RULES)).withColumn("kept", ~F.col("base_failed") & ~failed(rules))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the metrics, base_failed and kept (neither a base rule nor one of `rules` rejects)."""
    judged = _judged(docs, text, rules)
    results = judged.columns[1:]
    return judged.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in results], *results)


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    return _judged(docs, text, rules).filter("kept").select("_row.*")
