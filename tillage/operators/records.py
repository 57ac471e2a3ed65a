"""Records: replacements, diaries, holidays, rules, suggestions, and rows for a vector store."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import held
from .relational import numbered_after, small

#: Holidays of the solar calendar by month and day, others by their dates.
HOLIDAYS = [
    ("0101", None, "New Year"),
    ("0301", None, "Independence Movement Day"),
    ("0505", None, "Children's Day"),
    (None, "2024-02-10", "Lunar New Year"),
    (None, "2024-05-15", "Buddha's Birthday"),
    (None, "2024-09-17", "Harvest Festival"),
    (None, "2024-01-10", "Village Day"),
]


def vector_rows(rows: DataFrame, metadata: str) -> DataFrame:
    """rows with the struct of metadata as JSON of flat texts: numbers and lists become text, empty fields go."""
    fields = rows.schema[metadata].dataType.fieldNames()
    kinds = {f.name: f.dataType.typeName() for f in rows.schema[metadata].dataType.fields}
    flat = [(F.to_json(F.col(metadata)[f]) if kinds[f] in ("array", "map", "struct") else F.col(metadata)[f].cast("string")).alias(f) for f in fields]
    return rows.withColumn(metadata, F.to_json(F.struct(*flat)))


def save_vectors(rows: DataFrame, path: str, metadata: str, reset: bool = False) -> None:
    """Write vectors with their flat metadata as a Parquet table; added to what is there, or in its place."""
    vector_rows(rows, metadata).write.mode("overwrite" if reset else "append").parquet(path)


def replaced(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base without the groups that new has rows for, and new."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").select(new.columns).unionByName(new)


def diary(new: DataFrame, old: DataFrame, keys: list[str], number: str, project: str, *order: Column) -> DataFrame:
    """The rows to be written for new entries: each with a number on from the largest of its keys in old, once for the journal
    and, where it belongs to a project, once for the bridge."""
    numbered = numbered_after(new, old, keys, number, *order)
    journal = numbered.select(F.lit("journal").alias("target"), *keys, number, F.lit(None).cast(new.schema[project].dataType).alias(project))
    bridge = numbered.filter(F.col(project).isNotNull()).select(F.lit("bridge").alias("target"), *keys, number, project)
    return journal.unionByName(bridge)


class NumbersTaken(Exception):
    """Entries that could not be written, since others took their numbers at each try."""


def write_diary(new: DataFrame, journal: str, bridge: str, keys: list[str], number: str, project: str, *order: Column, tries: int = 2, meanwhile: Callable[[], None] | None = None) -> DataFrame:
    """Write new entries to the tables of the journal and of the bridge (Parquet, with the columns of new, the number and, in the
    bridge, the project), and give them with their numbers. They are numbered on from the largest number of their keys; those whose
    numbers others have written by the time of the write are numbered again, alone, and after `tries` that is an error. The
    bridge is written from the rows that the journal took, so the two agree. `meanwhile` runs between numbering and writing."""
    spark = new.sparkSession
    left, done = held(new), []
    for _ in range(tries):
        numbered = held(numbered_after(left, spark.read.parquet(journal), keys, number, *order))
        if meanwhile is not None:
            meanwhile()
        taken = spark.read.parquet(journal).select(*keys, number)
        free = held(numbered.join(taken, [*keys, number], "left_anti"))
        free.select(spark.read.parquet(journal).columns).write.mode("append").parquet(journal)
        free.filter(F.col(project).isNotNull()).select(spark.read.parquet(bridge).columns).write.mode("append").parquet(bridge)
        done.append(free)
        left = held(conflicts(numbered, taken, [*keys, number]).drop(number))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise NumbersTaken(f"{left.count()} entries")


def conflicts(rows: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are taken already, to be numbered again."""
    return rows.join(there.select(*keys), keys, "left_semi")


def with_holidays(days: DataFrame, holidays: DataFrame, day: str) -> DataFrame:
    """days with the name of each holiday on them: two equi-joins, one by month and day and one by date; others have none."""
    yearly = small(holidays.filter("mmdd is not null").select(F.col("mmdd").alias("_mmdd"), F.col("name").alias("_yearly")))
    dated = small(holidays.filter("day is not null").select(F.to_date("day").alias("_day"), F.col("name").alias("_dated")))
    met = days.join(yearly, F.date_format(day, "MMdd") == F.col("_mmdd"), "left").join(dated, F.col(day) == F.col("_day"), "left")
    names = F.filter(F.array("_dated", "_yearly"), lambda x: x.isNotNull())
    return met.withColumn("name", F.explode_outer(names)).drop("_mmdd", "_day", "_yearly", "_dated")


def normal_rules(rows: DataFrame, rule: str, default: str) -> DataFrame:
    """rows with the parts of a rule in JSON (dir, min, max, times): a default direction, the one bound for a missing other,
    bounds in order, at least one time. A rule that is no JSON has no bounds."""
    own = F.from_json(rule, "map<string,string>")
    part = lambda k: F.try_element_at(own, F.lit(k)).try_cast("int")
    low, high = F.coalesce(part("min"), part("max")), F.coalesce(part("max"), part("min"))
    return rows.withColumns(
        {
            "direction": F.coalesce(F.nullif(F.trim(F.try_element_at(own, F.lit("dir"))), F.lit("")), F.lit(default)),
            "min_days": F.least(low, high),
            "max_days": F.greatest(low, high),
            "times": F.greatest(F.lit(1), F.coalesce(part("times"), F.lit(1))),
        }
    )


#: The label of a line that says how work is proved, and what stands around it.
METHOD_LABEL, AROUND = r"\(?증빙방법\)?", " :"


def normal_evidence(rows: DataFrame, rule: str, basis: str) -> DataFrame:
    """rows with the parts of an evidence rule in JSON (count, method, basis): a line that gives the basis wins over the rule's own and
    stands for a missing method, without its label; at least one piece where there is a method or basis; nothing else is nulls."""
    own = F.from_json(rule, "map<string,string>")
    part = lambda k: F.trim(F.coalesce(F.try_element_at(own, F.lit(k)), F.lit("")))
    line = F.trim(F.coalesce(basis, F.lit("")))
    known = rows.withColumns({"_basis": F.coalesce(F.nullif(line, F.lit("")), part("basis")), "_method": part("method"), "_count": F.greatest(F.lit(1), part("count").try_cast("int"))})
    told = F.trim(F.regexp_replace("_basis", METHOD_LABEL, ""), F.lit(AROUND))
    known = known.withColumn("_method", F.when((F.col("_method") == "") & (line != ""), told).otherwise(F.col("_method")))
    says = (F.col("_method") != "") | (F.col("_basis") != "")
    given = says | part("count").try_cast("int").isNotNull()
    out = known.withColumns(
        {
            "evidence_count": F.when(given, F.when(part("count").try_cast("int").isNotNull(), F.col("_count")).otherwise(1)),
            "evidence_method": F.when(given, F.col("_method")),
            "evidence_basis": F.when(given, F.col("_basis")),
        }
    )
    return out.drop("_basis", "_method", "_count")


def suggestions(rows: DataFrame, most: int, near: int = 2) -> DataFrame:
    """Of rows (id, at, heading, is_header, score, names, content, price) the names: how many rows bear each (n_exact), how many
    header rows (n_headers) are among these, the other rows under their headings, and those at most `near` places from them;
    the scores of the rows that bear it and five for each such header; the best of all these rows (top, excerpt) and its price,
    if it bears the name, else the largest price of a row that does. The first by these three and the name.

    Rows under a heading are summed up before names meet them, and neighbours are found by their places, so that rows of a
    heading are never paired."""
    named = rows.withColumn("name", F.explode(F.array_distinct("names"))).filter("name <> ''")
    best = F.max(F.struct("score", (-F.col("id")).alias("first"), "id", "content")).alias("best")
    headers = F.count(F.when(F.col("is_header"), 1)).alias("n")
    exact = named.groupBy("name").agg(F.count("*").alias("n_exact"), F.sum("score").alias("_score"), F.max("price").alias("_price"))
    under = named.select("name", "heading").distinct()
    inside = under.join(rows.groupBy("heading").agg(headers, best), "heading").select("name", "n", "best")
    places = named.select("name", F.explode(F.sequence(F.col("at") - near, F.col("at") + near)).alias("at")).distinct()
    beside = places.join(rows, "at").join(under, ["name", "heading"], "left_anti").groupBy("name").agg(headers, best)
    met = inside.unionByName(beside).groupBy("name").agg(F.sum("n").alias("n_headers"), F.max("best").alias("best"))
    own = named.select(F.col("name").alias("_name"), F.col("id").alias("_id"), F.col("price").alias("_own"))
    every = exact.join(met, "name").join(own, (F.col("name") == F.col("_name")) & (F.col("best.id") == F.col("_id")), "left")
    out = every.select("name", "n_exact", "n_headers", (F.col("_score") + 5 * F.col("n_headers")).cast("long").alias("score"), F.col("best.id").alias("top"), F.col("best.content").alias("excerpt"), F.coalesce("_own", "_price").alias("price"))
    return out.orderBy(F.desc("n_exact"), F.desc("n_headers"), F.desc("score"), "name").limit(most)
