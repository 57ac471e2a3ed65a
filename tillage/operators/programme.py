"""Programme analytics: payments, laggards, missing sets, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import DIMENSION_ROWS, small


def payments(work: DataFrame, rates: DataFrame, owner: str, code: str, area: str, name: str) -> DataFrame:
    """Money by owner: the rate of a code, or of the first keyword in its name, per hectare. rates: code, keyword, rate, and
    prio (order of the keywords); more than DIMENSION_ROWS keywords are an error, more codes are joined by size. Areas are square metres, rounded to 4 digits of a
    hectare; each amount is rounded half to even."""
    by_code = rates.filter("code is not null").select(F.col("code").alias(code), F.col("rate").alias("_by_code"))
    words = [(r["keyword"], r["rate"]) for r in rates.filter("keyword is not null").orderBy("prio").limit(DIMENSION_ROWS + 1).collect()]
    if len(words) > DIMENSION_ROWS:
        raise ValueError(f"more than {DIMENSION_ROWS} keywords")
    fallback: Column = F.lit(None).cast("double")
    for keyword, rate in reversed(words):
        fallback = F.when(F.contains(F.col(name), F.lit(keyword)), F.lit(float(rate))).otherwise(fallback)
    priced = work.join(small(by_code), code, "left").withColumn("rate", F.coalesce("_by_code", fallback))
    hectares = F.bround(F.col(area) / F.lit(10000.0), 4)
    items = priced.filter("rate is not null").withColumn("amount", F.bround(F.col("rate") * 1000 * hectares).cast("long"))
    return items.groupBy(owner).agg(F.count("*").alias("n_items"), F.sum("amount").alias("total"))


def laggards(todo: DataFrame, owner: str, due: str, done: Column, as_of: Column, days: int, sample: int = 3) -> DataFrame:
    """By owner the open work due within `days` of as_of, both ways; work without a due date passes. With the first few ids,
    chosen in 64 parts of each owner first, so that an owner of very much work is never one list or one task."""
    near = F.coalesce(F.abs(F.datediff(F.col(due), as_of)) <= days, F.lit(True))
    late = todo.filter(~F.coalesce(done, F.lit(False)) & near).select(owner, "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("_part"))
    nth = F.row_number().over(Window.partitionBy(owner, "_part").orderBy("id"))
    few = late.withColumn("_nth", nth).filter(F.col("_nth") <= sample).groupBy(owner).agg(F.slice(F.sort_array(F.collect_list("id")), 1, sample).alias("first_ids"))
    counts = late.groupBy(owner).agg(F.count("*").alias("n_open"))
    same = F.col(f"c.{owner}").eqNullSafe(F.col(f"f.{owner}"))
    return counts.alias("c").join(few.alias("f"), same).select(f"c.{owner}", "n_open", "first_ids")


def completeness(required: Column, submitted: Column) -> dict[str, Column]:
    """missing (required but not submitted, in their order) and a state of completed, in_progress or pending."""
    missing = F.array_except(required, submitted)
    state = F.when(F.size(missing) == 0, "completed").when(F.size(F.array_intersect(required, submitted)) > 0, "in_progress").otherwise("pending")
    return {"missing": missing, "state": state}


def credit(status: str, submitted: str, required: str) -> Column:
    """Partial credit: 1 for completed work, the submitted share of what is required, a half for work in progress."""
    part = F.least(F.lit(1.0), F.col(submitted) / F.col(required))
    return F.when(F.col(status) == "completed", 1.0).when(F.col(required) > 0, part).when(F.col(status) == "in_progress", 0.5).otherwise(0.0)


def progress(known: Column, required: Column, submitted: Column, n_submitted: Column, n_pending: Column) -> tuple[Column, Column]:
    """(done, target): against a known target; else against the required kinds, where rows count if no kind fits; else
    against all that is done and pending, at least 1."""
    need, both = F.size(required), F.size(F.array_intersect(required, submitted))
    done = F.when(known.isNotNull(), F.least(n_submitted, known)).when(need > 0, F.least(F.when(both > 0, both).otherwise(n_submitted), need)).otherwise(n_submitted)
    target = F.when(known.isNotNull(), known).when(need > 0, need).otherwise(F.greatest(n_submitted + n_pending, F.lit(1)))
    return done.cast("long"), target.cast("long")
