"""Look-ups, code maps and merges as functions of DataFrames and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The codes of kinds of evidence, and the words that stand for one, in the order in which they are tried.
EVIDENCE_CODES = ["PIC", "PIC1", "PIC2", "PIC3", "RCT", "RCT1", "RCT2", "RCT3", "RCT4", "RCT5", "EQP", "DST", "OTH"]
EVIDENCE_WORDS = [
    ("RCT5", ["INVOICE", "RECEIPT"]),
    ("PIC2", ["BEFORE", "START"]),
    ("PIC1", ["AFTER", "END"]),
    ("PIC1", ["BAG", "SPREADING", "FIELD", "DRY", "COLLECTION", "TILLAGE", "DRAINAGE"]),
]


def mapped(column: str, codes: dict[str, object], default: object) -> Column:
    """The code of a value, or the default where there is none (null too)."""
    return reduce(lambda out, kv: F.when(F.col(column) == kv[0], F.lit(kv[1])).otherwise(out), reversed(codes.items()), F.lit(default))


def typed_match(keys: list[str], number: str, text: str) -> Column:
    """Whether a row matches one of the keys: those that are integers against the number column, the others against the text."""
    whole = lambda k: k.removeprefix("-").isdecimal()
    return F.col(number).isin([int(k) for k in keys if whole(k)]) | F.col(text).isin([k for k in keys if not whole(k)])


def evidence_code(raw: Column) -> Column:
    """The code of a free-form kind of evidence: itself if it is one, else by the first words it contains, else OTH."""
    kind = F.upper(F.trim(raw))
    code: Column = F.lit("OTH")
    for value, words in reversed(EVIDENCE_WORDS):
        code = F.when(reduce(lambda a, b: a | b, [F.contains(kind, F.lit(w)) for w in words]), value).otherwise(code)
    return F.when(kind.isin(EVIDENCE_CODES), kind).otherwise(code)


def first_named(sources: list[DataFrame], key: str, name: str) -> DataFrame:
    """Every key of any source, with the first name that isn't blank, in the order of the sources."""
    every = reduce(DataFrame.unionByName, [s.select(key, name, F.lit(i).alias("_prio")) for i, s in enumerate(sources)])
    good = F.nullif(F.trim(name), F.lit("")).isNotNull()
    return every.groupBy(key).agg(F.min_by(F.when(good, F.col(name)), F.when(good, F.struct("_prio", name))).alias(name))


def merged(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of new inserted or put in place of its own, and `action`: kept, inserted or updated. Keys are
    unique on each side and not null."""
    values = [c for c in base.columns if c not in keys]
    b = base.withColumn("_b", F.lit(True))
    n = new.select(*keys, *[F.col(c).alias(f"_{c}_new") for c in values], F.lit(True).alias("_n"))
    both = b.join(n, keys, "full")
    action = F.when(F.col("_n").isNull(), "kept").when(F.col("_b").isNull(), "inserted").otherwise("updated")
    return both.select(*keys, *[F.when(F.col("_n"), F.col(f"_{c}_new")).otherwise(F.col(c)).alias(c) for c in values], action.alias("action"))


def either_lookup(df: DataFrame, dim: DataFrame, key: str, value: str, by: list[str]) -> DataFrame:
    """df with the value that dim has for the first of its columns `by` that finds one; one equi-join for each."""
    out, found = df, []
    for i, column in enumerate(by):
        side = dim.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        out = out.join(side, F.col(column) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(f"_v{i}")
    return out.withColumn(value, F.coalesce(*found)).drop(*found)
