"""Reading tables, and the shared folder for data that outlives a stage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by whatever path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of this process in each shared folder.
_own: dict[str, str] = {}
_made: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """This process's folder in spark.checkpoint.dir, which driver and executors share, removed when the process ends; only in local
    mode that setting may be missing (tests), and the folder is a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or ""
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if root not in _own:
        base = root.rstrip("/") or f"file://{tempfile.mkdtemp(prefix='spark-tillage-')}"
        _own[root] = f"{base}/tillage-{uuid.uuid4().hex}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own[root])
        atexit.register(_delete, where, spark.sparkContext._jsc.hadoopConfiguration())
    return _own[root]


def _delete(where, conf) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        where.getFileSystem(conf).delete(where, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append((spark, path))
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared_folder() through Spark's file systems."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(*keep: str) -> Iterator[None]:
    """The folders made within are removed at the end, an error or not, but those whose names begin as one of `keep`; they are
    left to the scratch around this one, if there is one."""
    before, made = _made.get(), []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for spark, path in made:
            if not path.rpartition("/")[2].startswith(keep or ("\0",)):
                remove_folder(spark, path)
            elif before is not None:
                before.append((spark, path))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, has no lineage left and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
