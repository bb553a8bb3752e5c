"""Writing intermediate tables to the folder the cluster shares."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

_SETTING = "spark.checkpoint.dir"
DEFAULT_BROADCAST_ROWS = 500_000
#: Lists that note the paths of tables as they are written; see ``noted_tables``.
_notes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one uses a folder inside the warehouse."""
    configured = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as parquet and read it back.  The tables of a run go when its session ends."""
    spark = df.sparkSession
    run = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    path = f"{run}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    for note in _notes:
        note.append(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted_tables() -> Iterator[list[str]]:
    """The paths of the tables that are written meanwhile."""
    note: list[str] = []
    _notes.append(note)
    try:
        yield note
    finally:
        _notes[:] = [n for n in _notes if n is not note]


def drop_tables(spark: SparkSession, paths: list[str], unless: DataFrame | None = None) -> list[str]:
    """Delete written tables that are no longer needed, but for those that ``unless`` reads; returns what stays."""
    read = unless.inputFiles() if unless is not None else []
    stays = [p for p in paths if any(p.rsplit("/", 1)[-1] in file for file in read)]
    for path in set(paths) - set(stays):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return stays


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose result is written.

    It does so once the driver has collected their plans as garbage, which a driver with memory to spare does rarely; until
    then they lie on the disks.  Results are the same without.
    """
    time.sleep(0.5)  # a plan is held until the last event of its step is handled
    spark.sparkContext._jvm.System.gc()


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Size check before a broadcast; never counts past the bound."""
    return df.limit(rows + 1).count() <= rows


def broadcast_checked(df: DataFrame, rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it is measurably small, otherwise ask for a shuffled join."""
    return F.broadcast(df) if has_at_most(df, rows) else df.hint("merge")


def task_count(spark: SparkSession, wanted: int | None = None) -> int:
    return wanted or int(spark.conf.get("spark.sql.shuffle.partitions"))
