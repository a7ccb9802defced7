"""Reading the lake: batches that were committed, compacted files in place of their sources, time ranges pruned."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeweir.functions.columns import partition_columns
from lakeweir.schemas import EXTRA, TABLES
from lakeweir.sources import commits
from lakeweir.sources.commits import delete_path, exists

__all__ = ["delete_path", "exists", "file_name", "partition_inventory", "rows_per_day", "scan_lake", "scan_mixed_depth", "scan_range", "scan_table", "vacuum"]

PARTS = ("year", "month", "day", "hour")
#: Seconds for which files that no commit names are left alone, as their job may still be running.
KEPT_SECONDS = 7 * 86400
#: Replaced tokens up to which a scan leaves their rows out by a plain filter, which prunes folders; beyond it joins.
FEW = 200


def file_name() -> Column:
    """The one form of a file's path that scans, the inventory and the log share: decoded, a local one without scheme.

    Spark gives the path of a row's file URL-encoded, in which a plus sign stands for itself.
    """
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def _committed(rows: DataFrame, log: DataFrame, since: int | None = None) -> DataFrame:
    """rows (with batch) of the last token of each batch; those of lakes without a log bear no mark and are all kept.

    Tokens, one a batch, are broadcast: joined by shuffle, the rows of a batch would be one key, and so one task's. With ``since``, only rows of batches that were committed after that version.
    """
    if since is not None:
        newer = commits.live(log).filter(F.col("version") > since).select(F.col("token").alias("batch"))
        return rows.join(F.broadcast(newer), "batch", "left_semi")
    tokens = commits.live(log).select(F.col("token").alias("_token"), F.lit(True).alias("_live"))
    known = rows.join(F.broadcast(tokens), F.col("batch") == F.col("_token"), "left")
    return known.filter(F.col("_live") | F.col("batch").isNull() | ~F.contains("batch", F.lit(commits.MARK))).drop("_token", "_live")


def without_replaced(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of compacted files (with batch) without those of batches that were played again later."""
    gone = commits.replaced(log).select("token").distinct()
    tokens = [r.token for r in gone.limit(FEW + 1).collect()]
    if not tokens:
        return rows
    if len(tokens) <= FEW:
        return rows.filter(F.col("batch").isNull() | ~F.col("batch").isin(tokens))
    return rows.join(gone.withColumnRenamed("token", "batch"), "batch", "left_anti")


def _schema(table: str) -> str:
    return ", ".join(filter(None, (TABLES[table], EXTRA.get(table))))


def standing(spark: SparkSession, base: str, log: DataFrame | None = None) -> DataFrame | None:
    """Facts with batch and _file: hour files of committed batches that no compaction replaced, and the compacted files that stand."""
    columns = [*StructType.fromDDL(TABLES["metric_data"]).names, "batch"]
    log = commits.entries(spark, base) if log is None else log
    parts = []
    if exists(spark, f"{base}/metric_data"):
        hours = spark.read.schema(_schema("metric_data")).parquet(f"{base}/metric_data").withColumn("_file", file_name())
        hours = hours.join(commits.sources(log).withColumnRenamed("path", "_file"), "_file", "left_anti")
        parts.append(_committed(hours.select(*columns, "_file"), log))
    if exists(spark, f"{base}/metric_data_daily"):
        days = spark.read.schema(_schema("metric_data")).parquet(f"{base}/metric_data_daily").withColumn("_file", file_name())
        days = days.join(commits.targets(log).withColumnRenamed("path", "_file"), "_file", "left_semi")
        parts.append(without_replaced(days.select(*columns, "_file"), log))
    return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def scan_lake(spark: SparkSession, base: str) -> DataFrame:
    """All facts of committed batches, each once, whatever was played again or compacted."""
    rows = standing(spark, base)
    return spark.createDataFrame([], TABLES["metric_data"]) if rows is None else rows.drop("batch", "_file")


def scan_range(spark: SparkSession, base: str, start: datetime, end: datetime) -> DataFrame:
    """Facts with start <= timestamp < end; the hour folders outside are not read, nor the row groups of compacted files."""
    utc = lambda t: t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t
    form = lambda t: utc(t).strftime("%Y%m%d%H")
    zone = lambda t: F.lit(utc(t).isoformat(sep=" ") + " UTC").cast("timestamp")
    days = F.concat(*PARTS[:3]).between(form(start)[:8], form(end)[:8])
    hours = F.concat(*PARTS).between(form(start), form(end))
    return scan_lake(spark, base).filter(days & hours & (F.col("timestamp") >= zone(start)) & (F.col("timestamp") < zone(end)))


def scan_mixed_depth(spark: SparkSession, base: str) -> DataFrame:
    """A lake whose days hold hour folders beside day-level files; the time columns come from the event time."""
    rows = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).option("pathGlobFilter", "*.parquet").parquet(base)
    return rows.drop(*PARTS).withColumns(partition_columns(F.col("timestamp")))


def scan_table(spark: SparkSession, base: str, table: str, log: DataFrame | None = None, since: int | None = None) -> DataFrame:
    """Rows of a dimension table in all committed batches, or in those committed after a version."""
    try:
        rows = spark.read.option("mergeSchema", True).schema(f"{TABLES[table]}, batch STRING").parquet(f"{base}/{table}")
    except AnalysisException:
        return spark.createDataFrame([], TABLES[table])
    return _committed(rows, commits.entries(spark, base) if log is None else log, since).drop("batch")


def partition_inventory(spark: SparkSession, base: str) -> DataFrame:
    """year, month, day, path, file_count, bytes and files of each day, in order; only *.parquet under dated folders."""
    rows = dated_files(spark, base)
    folder = F.regexp_extract("path", r"^(.*/day=\d+)/", 1)
    return rows.groupBy("year", "month", "day", folder.alias("path")).agg(F.count(F.lit(1)).alias("file_count"), F.sum("length").alias("bytes"), F.sort_array(F.collect_list(rows.path)).alias("files")).orderBy("year", "month", "day", "path")


def dated_files(spark: SparkSession, base: str) -> DataFrame:
    """path, length, changed, year, month and day of the *.parquet files under dated folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(base)
    part = lambda name: F.regexp_extract("path", rf"/{name}=(\d+)/", 1)
    named = files.select(file_name().alias("path"), "length", F.col("modificationTime").alias("changed"))
    return named.select("*", *(part(x).alias(x) for x in PARTS[:3])).filter("year <> '' AND month <> '' AND day <> ''")


def rows_per_day(spark: SparkSession, base: str) -> DataFrame:
    """year, month, day, files and rows of the facts that a scan reads, by the folder that they are in."""
    rows = standing(spark, base)
    if rows is None:
        return spark.createDataFrame([], "year STRING, month STRING, day STRING, files BIGINT, rows BIGINT")
    per_file = rows.groupBy("year", "month", "day", "_file").agg(F.count(F.lit(1)).alias("_n"))
    return per_file.groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("files"), F.sum("_n").alias("rows"))


def vacuum(spark: SparkSession, base: str, seconds: float = KEPT_SECONDS) -> DataFrame:
    """Deletes files that no scan reads and that are older than ``seconds``, then writes a checkpoint without them.

    Those are files of batches that were never committed or were played again, sources of compactions, and what a compaction
    that lost its race had written. Returns path and deleted (whether that worked) of each.
    """
    log = commits.entries(spark, base)
    old = F.col("changed") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(seconds)).cast("decimal(18,6)"))
    token = F.regexp_extract("path", r"/batch=([^/]*)/", 1)
    lost = None
    for folder in ("metric_data", "resources", "scopes", "metric_definitions", "metric_data_daily"):
        if not exists(spark, f"{base}/{folder}"):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{base}/{folder}")
        files = files.select(file_name().alias("path"), F.col("modificationTime").alias("changed"))
        if folder == "metric_data_daily":
            own = files.join(commits.targets(log), "path", "left_anti")
        else:
            marked = files.withColumn("batch", token).filter(F.contains("batch", F.lit(commits.MARK)))
            own = marked.join(commits.live(log).select(F.col("token").alias("batch")), "batch", "left_anti").select("path", "changed")
            own = own.unionByName(files.join(commits.sources(log), "path", "left_semi")).distinct()
        found = own.filter(old).select("path")
        lost = found if lost is None else lost.unionByName(found)
    if lost is None:
        return spark.createDataFrame([], "path STRING, deleted BOOLEAN")
    done = [(r.path, delete_path(spark, r.path)) for r in lost.collect()]  # names of the files to delete, as file systems delete one by one
    present = None
    for folder in ("metric_data", "metric_data_daily"):
        if exists(spark, f"{base}/{folder}"):
            files = dated_files(spark, f"{base}/{folder}").select("path")
            present = files if present is None else present.unionByName(files)
    commits.checkpoint(spark, base, present)
    return spark.createDataFrame(done, "path STRING, deleted BOOLEAN")
