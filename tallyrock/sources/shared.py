"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The tables of the innermost ``scratch`` block.
_tables: ContextVar[list[DataFrame] | None] = ContextVar("tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset and all tasks run in this process, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tallyrock-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage.

    The table survives the loss of executors; its rows are computed once.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if (tables := _tables.get()) is not None:
        tables.append(out)
    return out


def drop_table(df: DataFrame) -> None:
    """Remove a table that ``cut`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``cut`` writes in the block are removed at its end, but for those given to what it yields.

    Those belong to the block around it, if there is one. What comes out of a block is such a table, or reads none of it.
    """
    tables: list[DataFrame] = []
    around = _tables.get()

    def keep(table: DataFrame) -> DataFrame:
        tables.remove(table)
        if around is not None:
            around.append(table)
        return table

    mark = _tables.set(tables)
    try:
        yield keep
    finally:
        _tables.reset(mark)
        for table in tables:
            drop_table(table)
