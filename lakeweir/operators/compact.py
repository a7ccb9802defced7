"""Compaction: the files of a day into few verified ones, in the order of time.

The commit that names the targets and their sources is the point at which scans change over. It is refused if another commit
has replaced one of the sources meanwhile, and then the targets are deleted: of two compactions of a day one stands. Rows keep
the token of their batch, so a batch that is played again later replaces them too. Sources are deleted last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweir.schemas import EXTRA, TABLES
from lakeweir.sources import commits
from lakeweir.sources.commits import delete_path, exists
from lakeweir.sources.lake import dated_files, file_name, without_replaced

THRESHOLD, FILE_BYTES, DAYS_AT_ONCE, COMMIT_DAYS = 10, 512 << 20, 8, 32
#: Bytes of a row group: a scan of an hour reads the groups that hold it, out of those of the day.
GROUP_BYTES = 8 << 20
RESULT = "year STRING, month STRING, day STRING, status STRING, files_before BIGINT, files_after BIGINT, rows BIGINT"


def live_inventory(spark: SparkSession, base: str, log: DataFrame | None = None) -> DataFrame:
    """file_count, bytes and files of each day: hour files of committed batches and standing compacted files."""
    log = commits.entries(spark, base) if log is None else log
    found = None
    for folder in ("metric_data", "metric_data_daily"):
        if not exists(spark, f"{base}/{folder}"):
            continue
        own = dated_files(spark, f"{base}/{folder}").select("year", "month", "day", "path", "length")
        if folder == "metric_data":
            tokens = commits.live(log).select(F.col("token").alias("_token"), F.lit(True).alias("_live"))
            own = own.join(commits.sources(log), "path", "left_anti").withColumn("_batch", F.regexp_extract("path", r"/batch=([^/]*)/", 1))
            own = own.join(tokens, F.col("_batch") == F.col("_token"), "left").filter(F.col("_live") | ~F.contains("_batch", F.lit(commits.MARK)))
        else:
            own = own.join(commits.targets(log), "path", "left_semi")
        own = own.select("year", "month", "day", "path", "length")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], "year STRING, month STRING, day STRING, file_count BIGINT, bytes BIGINT, files ARRAY<STRING>")
    return found.groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("file_count"), F.sum("length").alias("bytes"), F.sort_array(F.collect_list("path")).alias("files"))


def candidates(spark: SparkSession, base: str, threshold: int = THRESHOLD) -> DataFrame:
    return live_inventory(spark, base).filter(F.col("file_count") >= threshold).orderBy("year", "month", "day")


def _read_files(spark: SparkSession, base: str, files: list[str], log: DataFrame) -> DataFrame:
    schema = ", ".join((TABLES["metric_data"], EXTRA["metric_data"]))
    columns = [c.split()[0] for c in schema.split(", ")]
    parts = []
    for folder in ("metric_data", "metric_data_daily"):
        own = [f for f in files if f"/{folder}/" in f]
        if own:
            rows = spark.read.schema(schema).option("basePath", f"{base}/{folder}").parquet(*own)
            rows = without_replaced(rows, log) if folder == "metric_data_daily" else rows
            parts.append(rows.select(columns))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def pack_day(spark: SparkSession, base: str, day, log: DataFrame, dry_run: bool = False, count: Callable[[DataFrame], int] | None = None) -> tuple[tuple, list[str]]:
    """One day: write its rows and verify their number (count: of what was written). The result row, and the files made if it may be committed."""
    key, files = (day.year, day.month, day.day), list(day.files)
    try:
        rows = _read_files(spark, base, files, log)
        before = rows.count()
    except Exception:
        return (*key, "unreadable", len(files), len(files), None), []
    if dry_run:
        return (*key, "dry run", len(files), len(files), before), []
    folder = f"{base}/metric_data_daily/year={day.year}/month={day.month}/day={day.day}/part={uuid.uuid4().hex}"
    n = max(1, -(-int(day.bytes or 0) // FILE_BYTES))
    packed = rows.drop("year", "month", "day")
    packed = packed.coalesce(1) if n == 1 else packed.repartitionByRange(n, "timestamp")
    packed.sortWithinPartitions("timestamp").write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(folder)
    made = spark.read.schema(packed.schema).parquet(folder)
    found = {r.path: r.n for r in made.groupBy(file_name().alias("path")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a file
    if (sum(found.values()) if count is None else count(made)) != before:
        delete_path(spark, folder)
        return (*key, "count mismatch", len(files), len(files), before), []
    return (*key, "compacted", len(files), len(found), before), list(found)


def _replaced(spark: SparkSession, days: list[tuple], newer: DataFrame) -> set[tuple]:
    """The keys of days (key, targets, sources) of which newer entries of the log have replaced a source."""
    if not days:
        return set()
    own = spark.createDataFrame([(*key, f) for key, _, files in days for f in files], "year STRING, month STRING, day STRING, path STRING")
    gone = newer.filter("kind = 'source'").select("path")
    return {tuple(r) for r in own.join(gone, "path", "left_semi").select("year", "month", "day").distinct().collect()}


def _commit(spark: SparkSession, base: str, packed: list[tuple], version: int) -> set[tuple]:
    """Commits the days (key, targets, sources) that nobody else has compacted since the version; the keys of the others."""
    lost: set[tuple] = set()
    while packed:
        made = [{"kind": "target", "path": t} for _, targets, _ in packed for t in targets] + [{"kind": "source", "path": f} for _, _, files in packed for f in files]
        if commits.commit(spark, base, made, lambda newer, own=packed: bool(_replaced(spark, own, newer)), version) is not None:
            break
        lost |= _replaced(spark, packed, commits.entries(spark, base, after=version))
        packed = [p for p in packed if p[0] not in lost]
    return lost


def compact(spark: SparkSession, base: str, threshold: int = THRESHOLD, dry_run: bool = False, delete: bool = True, count: Callable[[DataFrame], int] | None = None, before_commit: Callable[[], object] | None = None) -> DataFrame:
    """Compacts each day with enough files; one result row per day found.

    A few days are written at once, as they are independent, and COMMIT_DAYS at most are committed together. A day whose files
    another compaction has replaced meanwhile is a conflict and keeps that one's. ``before_commit`` is called before each commit.
    """
    version, log = commits.latest(spark, base), commits.entries(spark, base)
    listed = live_inventory(spark, base, log).withColumn("files", F.when(F.col("file_count") >= threshold, F.col("files")))
    days = listed.orderBy("year", "month", "day").collect()  # one row a day; paths of the days to compact only
    found, results = [d for d in days if d.file_count >= threshold], []
    with ThreadPoolExecutor(DAYS_AT_ONCE) as pool:
        for start in range(0, len(found), COMMIT_DAYS):
            own = found[start : start + COMMIT_DAYS]
            done = list(pool.map(lambda day: pack_day(spark, base, day, log, dry_run, count), own))
            if before_commit is not None:
                before_commit()
            packed = [(r[:3], targets, list(d.files)) for d, (r, targets) in zip(own, done, strict=True) if r[3] == "compacted"]
            lost = _commit(spark, base, packed, version)
            unread = [(r[:3], [], list(d.files)) for d, (r, _) in zip(own, done, strict=True) if r[3] == "unreadable"]
            lost |= _replaced(spark, unread, commits.entries(spark, base, after=version))
            list(pool.map(lambda p: delete_path(spark, p), [t for key, targets, _ in packed if key in lost for t in targets]))
            if delete:
                list(pool.map(lambda p: delete_path(spark, p), [f for key, _, files in packed if key not in lost for f in files]))
            results += [(*r[:3], "conflict", r[4], r[4], r[6]) if r[:3] in lost else r for r, _ in done]
    results += [(d.year, d.month, d.day, "skipped", d.file_count, d.file_count, None) for d in days if d.file_count < threshold]
    return spark.createDataFrame(results, RESULT)


def summary(results: DataFrame) -> DataFrame:
    done = F.col("status") == "compacted"
    return results.agg(F.count(F.lit(1)).alias("partitions_found"), F.count_if(~done).alias("skipped"), F.count_if(done).alias("compacted"), F.coalesce(F.sum(F.when(done, F.col("files_before"))), F.lit(0)).alias("files_before"), F.coalesce(F.sum(F.when(done, F.col("files_after"))), F.lit(0)).alias("files_after"), F.coalesce(F.sum(F.when(done, F.col("rows"))), F.lit(0)).alias("rows"))
