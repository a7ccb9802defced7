"""Stored dimension snapshots: the first row of each key over all flushes, brought up to date by what was flushed since.

A snapshot is a table of its own and the version of the commit log up to which it holds batches. Bringing it up to date reads
it and the rows of later batches only, and takes minima that combine on the map side. If a batch that it holds was played
again since, its rows can't be told from others, and the snapshot is made anew from all that stands.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweir.operators.dims import dim_snapshot
from lakeweir.schemas import TABLES
from lakeweir.sources import commits
from lakeweir.sources.lake import scan_table

#: Keys of the dimension tables.
KEYS = {"resources": ["resource_hash"], "scopes": ["name", "version"], "metric_definitions": ["scope_name", "scope_version", "name"]}


def stored(spark: SparkSession, base: str, table: str, log: DataFrame | None = None) -> tuple[str, int] | None:
    """The path of a table's last snapshot and the version that it goes up to."""
    log = commits.entries(spark, base) if log is None else log
    last = log.filter((F.col("kind") == "snapshot") & (F.col("token") == table)).agg(F.max_by(F.struct("path", "upto"), "version").alias("x")).first().x
    return None if last is None else (last.path, last.upto)


def refresh(spark: SparkSession, base: str, table: str) -> DataFrame:
    """Brings the snapshot of a dimension table up to date and returns it."""
    upto, log = commits.latest(spark, base), commits.entries(spark, base)
    held = stored(spark, base, table, log)
    if held is not None and log.filter(f"kind = 'batch' AND version > {held[1]}").isEmpty():
        return read(spark, base, table)
    if held is not None and not commits.replaced(log).filter(f"version <= {held[1]} AND by > {held[1]}").isEmpty():
        held = None
    if held is None:
        rows = scan_table(spark, base, table, log)
    else:
        rows = spark.read.schema(TABLES[table]).parquet(held[0]).unionByName(scan_table(spark, base, table, log, since=held[1]))
    place = f"{base}/_snapshots/{table}/{uuid.uuid4().hex}"
    dim_snapshot(rows, KEYS[table]).write.option("compression", "zstd").parquet(place)
    commits.commit(spark, base, [{"kind": "snapshot", "token": table, "path": place, "upto": upto}])
    return read(spark, base, table)


def read(spark: SparkSession, base: str, table: str) -> DataFrame:
    """The stored snapshot of a dimension table; empty where there is none."""
    held = stored(spark, base, table)
    return spark.createDataFrame([], TABLES[table]) if held is None else spark.read.schema(TABLES[table]).parquet(held[0])
