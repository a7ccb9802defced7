"""The folder for tables that jobs write for themselves."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one of this machine, if all tasks run on it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(made)
    return made


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


#: Bytes of a row group of stored rows: what a task that writes them holds.
GROUP_BYTES = 32 << 20


def stored(rows: DataFrame, place: str) -> DataFrame:
    """Writes rows to a folder and gives them as read from there.

    For bodies and parsed payloads, which several jobs read: persisted, they are batches of 4 MB on an executor's heap, of which Java's
    streams hold a hundred for each task when they go to its disk or come from there. Here a task holds a row group, and a job
    reads the columns that it needs.
    """
    rows.write.option("parquet.block.size", GROUP_BYTES).parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)
