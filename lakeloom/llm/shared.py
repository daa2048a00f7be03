"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str, int]] = []  # by whom: the thread that saved it


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it.

    Where it is unset, a temporary folder is set in local mode alone, as all of it is then one process. Elsewhere that is an error: executors
    would each write to a disk of their own.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lakeloom-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet and read again; a lost executor can't take them away."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path, threading.get_ident()))
    return spark.read.schema(df.schema).parquet(path)


def saved_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of what make() gives, saved; the tables that make() saved on its way are deleted, as nothing reads them any more."""
    before, own = {path for _, path, _ in _written}, threading.get_ident()
    made = make()
    on_its_way = [e for e in _written if e[1] not in before and e[2] == own]
    out = saved(made, name)
    for entry in on_its_way:
        _delete(*entry[:2])
        _written.remove(entry)
    return out


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes not to be a column of df, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for spark, path, _ in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; whoever owns the folder clears it
            return
