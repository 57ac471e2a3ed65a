"""Reading and writing tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: This process's folder in each shared folder.
_own: dict[str, str] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files in a folder."""
    files, at = _files(spark, path)
    return files.getContentSummary(at).getLength()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses in the folder that driver and executors share, spark.checkpoint.dir; it goes when the process
    ends. Only in local mode may that setting be missing: then it is a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or ""
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if root not in _own:
        _own[root] = f"{root.rstrip('/') or 'file://' + tempfile.mkdtemp(prefix='spark-tillage-')}/tables-{uuid.uuid4().hex}"
        files, where = _files(spark, _own[root])

        def gone() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone already
                files.delete(where, True)

        atexit.register(gone)
    return f"{_own[root]}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame, name: str = "held") -> DataFrame:
    """df as a table in the shared folder: computed once, without lineage, safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_table(spark: SparkSession, staged: str, path: str) -> None:
    """Put a folder that is written whole in the place of a table: readers see the old one or the new one."""
    files, there = _files(spark, path)
    old = _files(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")[1]
    if files.exists(there) and not files.rename(there, old):
        raise OSError(f"{path} can't be moved")
    if not files.rename(_files(spark, staged)[1], there):
        files.rename(old, there)
        raise OSError(f"{staged} can't be moved to {path}")
    files.delete(old, True)


@dataclass(frozen=True)
class Statement:
    """A change of the rows that a condition holds for: new values for columns, or none, which deletes them."""

    where: Column
    values: dict[str, Column] = field(default_factory=dict)


def execute(spark: SparkSession, path: str, statements: list[Statement], by: list[str]) -> DataFrame:
    """Run statements on a Parquet table, one after the other, each on what the one before left, and give the numbers of rows that
    each touched by the columns `by`, as they were before: n_1, n_2, ... and n_before. The table changes at once, at the end."""
    columns = spark.read.parquet(path).columns
    rows = spark.read.parquet(path).withColumns({"_there": F.lit(True), **{f"_by{k}": F.col(c) for k, c in enumerate(by)}})
    for nth, s in enumerate(statements, 1):
        rows = rows.withColumn(f"_hit{nth}", F.col("_there") & F.coalesce(s.where, F.lit(False)))
        hit = F.col(f"_hit{nth}")
        rows = rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in s.values.items()}) if s.values else rows.withColumn("_there", F.col("_there") & ~hit)
    done = held(rows, "statements")
    staged = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    done.filter("_there").select(columns).write.parquet(staged)
    replace_table(spark, staged, path)
    names = [F.col(f"_by{k}").alias(c) for k, c in enumerate(by)]
    return done.groupBy(*names).agg(*[F.count(F.when(F.col(f"_hit{k}"), 1)).alias(f"n_{k}") for k in range(1, len(statements) + 1)], F.count("*").alias("n_before"))


def execute_many(spark: SparkSession, path: str, given: DataFrame, on: list[str], order: list[str], by: list[str], action: str = "update") -> DataFrame:
    """Run one statement on a Parquet table with many rows of parameters, in the order of the columns `order`: each changes, or with
    action "delete" removes, the rows whose columns `on` equal its own, and "upsert" adds a row where there is none.

    The other columns of `given` are the new values, null as well. A later row of parameters meets what an earlier one left, so of
    several the last one's values stay (of equal order, the greatest), and each counts for the rows that it meets; of deletes only
    the first meets any. Parameters that are null in `on` meet nothing and add nothing. Gives by the columns `by`, as they were
    before, or are in what is added: n_touched, n_added, n_before. The table changes at once, at the end."""
    if action not in ("update", "delete", "upsert"):
        raise ValueError(f"no such action: {action}")
    there = spark.read.parquet(path)
    values = [c for c in there.columns if c in given.columns and c not in on]
    # A key's parameters are one row before they meet the table, so a key with very many of them is no hot row of the join.
    last = F.max(F.struct(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.struct(*values, F.lit(True).alias("_is")).alias("_new")))
    asked = given.dropna(subset=on).groupBy(*on).agg(last["_new"].alias("_new"), F.count("*").alias("_times"))
    met = there.withColumn("_there", F.lit(True)).join(asked, on, "full" if action == "upsert" else "left")
    before, hit, added = F.col("_there").isNotNull(), F.col("_times").isNotNull(), F.col("_there").isNull()
    groups = {f"_by{k}": F.when(before | F.lit(c in on), F.col(c)).otherwise(F.col(f"_new.{c}") if c in values else F.lit(None)) for k, c in enumerate(by)}
    done = met.withColumns({**groups, "_touched": F.when(before & hit, F.lit(1) if action == "delete" else F.col("_times")).otherwise(0), "_added": added.cast("int")})
    if action != "delete":
        done = done.withColumns({c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).cast(there.schema[c].dataType) for c in values})
    done = held(done.drop("_new"), "statements")
    staged = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    (done.filter(~hit) if action == "delete" else done).select(there.columns).write.parquet(staged)
    replace_table(spark, staged, path)
    names = [F.col(f"_by{k}").alias(c) for k, c in enumerate(by)]
    return done.groupBy(*names).agg(F.sum("_touched").alias("n_touched"), F.sum("_added").cast("long").alias("n_added"), F.count("_there").alias("n_before"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_rows(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """The rows of JSON files: each file an object or an array of them, or, with lines, each line an object. What is no JSON is
    dropped; rejected_files() has it."""
    texts = spark.read.text(path, wholetext=not lines)
    if lines:
        return texts.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.from_json("value", "map<string,string>").alias("m")).filter("m is not null").select("r.*")
    return texts.select(F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("r")).filter("r is not null").select("r.*")


def rejected_files(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """The files that hold what is no JSON: file, problem (their text, or the lines of it)."""
    texts = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("problem")).filter("problem <> ''")
    parsed = F.from_json("problem", "map<string,string>") if lines else F.from_json("problem", f"array<struct<{schema}>>")
    broken = parsed.isNull() if lines else parsed.isNull() | F.exists(parsed, lambda r: r.isNull())
    return texts.filter(broken)


def json_upsert(rows: DataFrame, path: str, schema: str, keys: list[str], folder: str | None = None) -> None:
    """JSON files of a row a line with the rows of a batch in place of those of the same keys; written to another folder, or in the
    place of the files that were read, which they take once they are whole."""
    old = json_rows(rows.sparkSession, path, schema, lines=True)
    replaced = old.join(rows.select(*keys).distinct(), keys, "left_anti").select(rows.columns)
    staged = folder or f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    replaced.unionByName(rows).write.mode("overwrite").json(staged)
    if folder is None:
        replace_table(rows.sparkSession, staged, path)


def chunk_files(spark: SparkSession, folder: str, least: int = 20, lines: bool = False) -> DataFrame:
    """The chunks of JSON files in a folder (or, with lines, of their lines), one row each, without texts of fewer than `least`
    characters."""
    kind = "source_file string, chunks array<struct<chunk_id:string,title:string,section:string,text:string>>"
    exploded = json_rows(spark, folder, kind, lines).select("source_file", F.explode("chunks").alias("c")).select("source_file", "c.*")
    return exploded.filter(F.char_length(F.trim("text")) >= least)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write df so that only the partitions that it has rows for are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def emptied(spark: SparkSession, path: str) -> int:
    """Empty a Parquet table and say how many rows it had."""
    rows = spark.read.parquet(path)
    schema, before = rows.schema, rows.count()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return before


def append_evaluations(rows: DataFrame, path: str) -> None:
    """Add evaluation results to a folder of CSV files with headers."""
    rows.write.mode("append").csv(path, header=True)


def evaluation_rows(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation results from CSV files with a header."""
    kind = "model string, file string, expected string, status string, latency_ms int, prompt_tokens int, completion_tokens int, error string"
    return spark.read.schema(kind).csv(path, header=True)
