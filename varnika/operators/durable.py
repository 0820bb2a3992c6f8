"""Durable cuts of the lineage: tables in the folder that all machines share, and their removal."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from spark.checkpoint.dir. Without it there is none: a temporary folder is one machine's own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local["):
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='varnika-')}"  # driver and executors are one process, as in tests
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/varnika-{name}-{uuid.uuid4().hex}"


_watched: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("varnika-tables", default=())


@contextlib.contextmanager
def tables_made():
    """A list of the folders that keep() writes while this holds, in the thread that holds it."""
    made: list[str] = []
    before = _watched.set((*_watched.get(), made))
    try:
        yield made
    finally:
        _watched.reset(before)


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that goes once nothing reads it."""
    path = shared_path(spark, name)
    for made in _watched.get():
        made.append(path)
    return path


def tidy(f):
    """f, returning a DataFrame, with the tables that keep() wrote meanwhile deleted but for those that the result reads."""

    @functools.wraps(f)
    def run(*args, **how):
        with tables_made() as made:
            df = f(*args, **how)
        read = {x.rpartition("/")[0].rpartition("/")[2] for x in df.inputFiles()}
        remove(df.sparkSession, [x for x in made if x.rpartition("/")[2] not in read])
        return df

    return run


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives Catalyst real sizes for its join choice.
    """
    path = table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by keep() that no later plan reads."""
    remove(df.sparkSession, {x.rpartition("/")[0] for x in df.inputFiles()})


def remove(spark: SparkSession, folders) -> None:
    """Delete folders that keep() made."""
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in folders:
        if "/varnika-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
