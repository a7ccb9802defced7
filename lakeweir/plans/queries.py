"""The registered queries of the lake and the DuckDB SQL that gives the same rows from the events table."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweir.operators import compact as compaction
from lakeweir.operators import snapshots
from lakeweir.operators.admit import admit
from lakeweir.operators.dims import definition_dim, dim_snapshot, resource_dim, scope_dim, table_rows
from lakeweir.operators.flatten import fact_rows, flatten, json_tables
from lakeweir.operators.stats import ingest_stats
from lakeweir.operators.stats import rows_per_partition as count_partitions
from lakeweir.plans.encode import BODY_CAP, INFLATED_CAP, encode, encode_attributes, encode_cases, encode_nulls
from lakeweir.schemas import KINDS
from lakeweir.sources import commits, lake
from lakeweir.sources.lake import partition_inventory, scan_lake, scan_mixed_depth, scan_range, scan_table
from lakeweir.sources.payloads import read_payloads, stream_payloads, write_payloads
from lakeweir.sources.shared import new_folder, stored
from lakeweir.streaming.ingest import ADDED, TIMER, flush, ingest, keep, log_totals, pending_rows, prepared, start_stream, write_dimension, write_facts

NOW = datetime(2024, 1, 1)


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return admit(encode(_events(spark, sf_dir)))


def _levels(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return flatten(_admitted(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that several batches are taken from, stored: persisted, they are all on the executors' heaps."""
    return stored(encode(_events(prepared(spark), sf_dir)), new_folder(spark, "encoded"))


def _written(spark: SparkSession, sf_dir: str) -> str:
    base, token = new_folder(spark, "lake"), commits.new_token("0")
    write_facts(fact_rows(_levels(spark, sf_dir)["points"], NOW), base, token)
    commits.commit(spark, base, [{"kind": "batch", "batch": "0", "token": token, "reason": TIMER}])
    return base


def _third(b: int):
    return F.pmod("payload_id", F.lit(3)) == b


def _micros(df: DataFrame) -> DataFrame:
    return df.withColumn("ts_us", F.unix_micros("timestamp")).drop("timestamp")


def flatten_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _micros(_levels(spark, sf_dir)["points"])
    return points.select("payload_id", "resource_hash", "scope_name", "scope_version", "metric_name", "ts_us", F.when(~F.isnan("value_double"), F.col("value_double")).alias("value_double"), "value_int", "attributes")


def flatten_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)["metrics"].select("payload_id", "r_pos", "scope_name", "scope_version", "metric_name", "unit", "metric_type")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resource_dim(_levels(spark, sf_dir)["resources"])


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope_dim(_levels(spark, sf_dir)["scopes"])


def scopes_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope_dim(_levels(spark, sf_dir)["scopes"], flush=True)


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definition_dim(_levels(spark, sf_dir)["metrics"])


def definitions_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definition_dim(_levels(spark, sf_dir)["metrics"], flush=True)


def _stored(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A dimension table over three flushes, each stored with its own time."""
    base, levels = new_folder(spark, "lake"), {k: v.persist() for k, v in _levels(spark, sf_dir).items()}
    for b in range(3):
        write_dimension(table_rows({k: v.filter(_third(b)) for k, v in levels.items()}, datetime(2024, 1, 1 + b))[table], base, table, str(b))
    for level in levels.values():
        level.unpersist()
    return scan_table(spark, base, table).withColumn("created_us", F.unix_micros("created_at"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dim_snapshot(_stored(spark, sf_dir, "resources"), ["resource_hash"])
    return found.select("resource_hash", "attributes", "created_us", (F.col("updated_at") == F.col("created_at")).alias("fresh"))


def scope_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim_snapshot(_stored(spark, sf_dir, "scopes"), ["name", "version"]).select("name", "version", "created_us")


def definition_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dim_snapshot(_stored(spark, sf_dir, "metric_definitions"), ["scope_name", "scope_version", "name"])
    return found.select("scope_name", "scope_version", "name", "unit", "metric_type", "description", "created_us")


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each dimension table in each flush, as stored."""
    parts = [_stored(spark, sf_dir, t).groupBy("created_us").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "created_us", "n") for t in ("resources", "scopes", "metric_definitions")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def admission_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _admitted(spark, sf_dir).select("payload_id", "status", "error")


def admission_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule, with a payload that meets and one that breaks it."""
    return admit(encode_cases(_events(prepared(spark), sf_dir)), BODY_CAP, INFLATED_CAP).select("payload_id", "status", "error")


def admission_parser_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the parser's own rules, and the points that each payload gives."""
    admitted = admit(encode_cases(_events(prepared(spark), sf_dir)), BODY_CAP, INFLATED_CAP, need_resources=False)
    return ingest_stats(admitted).select("payload_id", "status", "data_points", F.element_at(F.when(F.size("errors") > 0, F.col("errors")), 1).alias("error"))


def attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute lists of every kind of value as stored text, and their hash."""
    rows = flatten(admit(encode_attributes(_events(prepared(spark), sf_dir))))["resources"]
    return rows.select("payload_id", "r_pos", "attributes", "resource_hash")


def flatten_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With two kinds of metrics only: the others are unknown and give no points."""
    kinds = KINDS[1:3]
    levels = flatten(admit(encode(_events(prepared(spark), sf_dir)), kinds=kinds), kinds)
    points = levels["points"].groupBy("metric_name").agg(F.count(F.lit(1)).alias("points"))
    types = levels["metrics"].groupBy("metric_name", "metric_type").agg(F.count(F.lit(1)).alias("definitions"))
    return types.join(points, "metric_name", "left").select("metric_name", "metric_type", "definitions", F.coalesce("points", F.lit(0)).alias("points"))


def _payload_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each payload, those of odd numbers gzipped."""
    folder = new_folder(spark, "payloads")
    rows = encode(_events(prepared(spark), sf_dir)).select("payload_id", F.col("body").cast("string").alias("value"), (F.col("payload_id") % 2 == 1).alias("gzip"))
    write_payloads(rows, folder, **ADDED)
    return folder


def payload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads read from files, plain and gzipped, and what each gives."""
    found = ingest_stats(admit(read_payloads(spark, _payload_files(spark, sf_dir), "*.txt*")))
    number = F.regexp_extract("payload_id", r"payload_id=(\d+)", 1).cast("bigint")
    return found.select(number.alias("payload_id"), "status", "resources", "data_points", F.col("payload_id").endswith(".gz").alias("gzip"))


def stream_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload files through a stream that is drained."""
    base, source = new_folder(spark, "lake"), _payload_files(spark, sf_dir)
    start_stream(stream_payloads(spark, source, "*.txt*", max_files=1_000), base, f"{base}/_checkpoint", available_now=True).awaitTermination()
    return _facts(scan_lake(spark, base))


def buffered_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in micro-batches that wait for a number of rows, the rest flushed at the end; a batch is played twice."""
    base, payloads = new_folder(spark, "lake"), _encoded(spark, sf_dir)
    for b in (0, 1, 1):
        keep(payloads.filter(_third(b)), base, f"{b:012d}", since=0.0)
    flush(spark, base, NOW)
    keep(payloads.filter(_third(2)), base, f"{2:012d}", since=0.0)
    flush(spark, base, NOW)
    return _facts(scan_lake(spark, base))


def waiting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that wait for each table, after one flush."""
    base, payloads = new_folder(spark, "lake"), encode(_events(prepared(spark), sf_dir))
    keep(payloads.filter(_third(0)), base, f"{0:012d}", since=0.0)
    flush(spark, base, NOW)
    keep(payloads.filter(_third(1)), base, f"{1:012d}", since=0.0)
    return pending_rows(spark, base)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_stats(_admitted(spark, sf_dir)).withColumn("n_errors", F.size("errors").cast("long")).drop("errors")


def parse_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics without a write, and the tables that exist after it (none)."""
    base = new_folder(spark, "lake")
    found = ingest(encode(_events(prepared(spark), sf_dir)), base, "0", NOW, write=False)
    return found.select("payload_id", "data_points", "written", F.lit(lake.exists(spark, base)).alias("stored"))


def failed_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics where no table can be written: counts kept, an error for each of the four."""
    found = ingest(encode(_events(prepared(spark), sf_dir)), "nofs://nowhere/lake", "0", NOW)
    return found.select("payload_id", "status", "data_points", "written", F.size(F.filter("errors", lambda e: e.startswith("Write error"))).cast("long").alias("write_errors"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over three batches that were written and logged, one of them played twice."""
    base, payloads = new_folder(spark, "lake"), _encoded(spark, sf_dir)
    for b in (0, 1, 2, 2):
        ingest(payloads.filter(_third(b)), base, f"{b:012d}", NOW, log=True)
    return log_totals(spark, base).drop("threshold_flushes")


def rows_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_partitions(fact_rows(_levels(spark, sf_dir)["points"], NOW))


def _facts(df: DataFrame) -> DataFrame:
    return _micros(df).select("resource_hash", "scope_name", "metric_name", "ts_us", "value_double", "value_int", "attributes", "year", "month", "day", "hour")


def lake_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(scan_lake(spark, _written(spark, sf_dir)))


def time_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _events(spark, sf_dir).agg(F.min("ts").cast("date").alias("d")).first()
    start = datetime.combine(days.d, datetime.min.time()) + timedelta(days=10, hours=5, minutes=30)
    return _facts(scan_range(spark, _written(spark, sf_dir), start, start + timedelta(days=2)))


def compaction_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _written(spark, sf_dir)
    compaction.compact(spark, base)
    return _facts(scan_lake(spark, base))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that hold files, with their folder and number of files."""
    found = partition_inventory(spark, _written(spark, sf_dir) + "/metric_data")
    return found.select("year", "month", "day", F.regexp_extract("path", r"metric_data/(.*)$", 1).alias("path"), "file_count", (F.size("files") == F.col("file_count")).alias("listed"))


def rows_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.rows_per_day(spark, _written(spark, sf_dir))


def mixed_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lake in which one day is a file beside the hour folders of the others."""
    base, facts = new_folder(spark, "lake"), fact_rows(_levels(spark, sf_dir)["points"], NOW).persist()
    year, month, day = facts.agg(F.min(F.struct("year", "month", "day")).alias("d")).first().d
    own = (F.col("year") == year) & (F.col("month") == month) & (F.col("day") == day)
    facts.filter(~own).write.partitionBy("year", "month", "day", "hour").parquet(f"{base}/metric_data")
    facts.filter(own).drop("year", "month", "day", "hour").coalesce(1).write.parquet(f"{base}/metric_data/year={year}/month={month}/day={day}")
    facts.unpersist()
    return _facts(scan_mixed_depth(spark, f"{base}/metric_data"))


def _compacted(spark: SparkSession, base: str, **how) -> DataFrame:
    return compaction.compact(spark, base, **how).select("year", "month", "day", "status", "files_before", "files_after", "rows")


def compaction_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What compaction did with each day: those with fewer files than the threshold are skipped."""
    return _compacted(spark, _written(spark, sf_dir))


def compaction_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compacted(spark, _written(spark, sf_dir), threshold=1, dry_run=True)


def compaction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.summary(compaction.compact(spark, _written(spark, sf_dir)))


def compaction_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after a compaction that left its sources in place, and one whose counts didn't match, in a folder with odd characters."""
    base = _written(spark, sf_dir)
    odd = f"{base}/a b%20+é"
    scan_lake(spark, base).withColumn("batch", F.lit("0")).write.partitionBy("year", "month", "day", "hour", "batch").parquet(f"{odd}/metric_data")
    compaction.compact(spark, odd, threshold=1, count=lambda df: -1)
    compaction.compact(spark, odd, threshold=1, delete=False)
    return _facts(scan_lake(spark, odd))


def compaction_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose rewritten count is wrong stay as they are."""
    base = _written(spark, sf_dir)
    found = _compacted(spark, base, threshold=1, count=lambda df: -1).select("year", "month", "day", "status", "files_before")
    return found.join(lake.rows_per_day(spark, base), ["year", "month", "day"])


def compaction_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day holds a broken file: it is left out, the others are compacted."""
    base = _written(spark, sf_dir)
    first = partition_inventory(spark, f"{base}/metric_data").first()
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{first.path}/hour=00/batch=broken/broken.parquet")
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    stream.write(bytearray(b"no Parquet file"))
    stream.close()
    return compaction.compact(spark, base, threshold=1).select("year", "month", "day", "status", "rows")


def replay_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of three batches that were compacted, played again, compacted with the sources kept, and played again."""
    base, payloads = new_folder(spark, "lake"), _encoded(spark, sf_dir)
    play = lambda b: ingest(payloads.filter(_third(b)), base, str(b), NOW)
    for b in range(3):
        play(b)
    compaction.compact(spark, base, threshold=1)
    play(1)
    compaction.compact(spark, base, threshold=1, delete=False)
    play(1)
    play(2)
    return _facts(scan_lake(spark, base))


def _raced(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A lake that two compactions list before either commits, and what the one did that came second."""
    base = _written(spark, sf_dir)
    return base, compaction.compact(spark, base, threshold=1, before_commit=lambda: compaction.compact(spark, base, threshold=1))


def two_compactors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(scan_lake(spark, _raced(spark, sf_dir)[0]))


def compaction_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the compaction that came second did with each day, and the files and rows that stand."""
    base, second = _raced(spark, sf_dir)
    return second.select("year", "month", "day", "status").join(lake.rows_per_day(spark, base), ["year", "month", "day"])


def vacuumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after a vacuum that deleted replaced batches, sources of a compaction and what was never committed; files by kind of folder."""
    base, payloads = new_folder(spark, "lake"), _encoded(spark, sf_dir)
    for b in (0, 1, 2, 2):
        ingest(payloads.filter(_third(b)), base, str(b), NOW)
    write_facts(fact_rows(flatten(admit(payloads))["points"], NOW), base, commits.new_token("lost"))
    compaction.compact(spark, base, threshold=1, delete=False)
    lake.vacuum(spark, base, seconds=0)
    left = lake.dated_files(spark, f"{base}/metric_data")
    return _facts(scan_lake(spark, base)).withColumn("files_left", F.lit(left.count()))


def failed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that scans see of a batch whose third table can't be written, and after it was played again."""
    base, payloads = new_folder(spark, "lake"), _encoded(spark, sf_dir)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/scopes")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where).close()  # a file where the table's folder should be
    tables = ("metric_data", "resources", "metric_definitions", "scopes")
    seen = lambda t: (scan_lake(spark, base) if t == "metric_data" else scan_table(spark, base, t)).count()
    ingest(payloads, base, "0", NOW)
    before = {t: seen(t) for t in tables[:3]}
    lake.delete_path(spark, f"{base}/scopes")
    ingest(payloads, base, "0", NOW)
    return spark.createDataFrame([(t, before.get(t, 0), seen(t)) for t in tables], "table_name STRING, failed BIGINT, played_again BIGINT")


def oversize_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload files, some of which are above the cap: those are told from the listing and never read."""
    folder = new_folder(spark, "payloads")
    rows = encode(_events(prepared(spark), sf_dir)).select("payload_id", F.col("body").cast("string").alias("value"), F.lit(False).alias("gzip"))
    padded = rows.withColumn("value", F.when(F.col("payload_id") % 40 == 4, F.concat("value", F.repeat(F.lit(" "), F.lit(BODY_CAP)))).otherwise(F.col("value")))
    write_payloads(padded, folder, **ADDED)
    found = admit(read_payloads(spark, folder, "*.txt", body_cap=BODY_CAP), body_cap=BODY_CAP)
    return ingest_stats(found).select(F.regexp_extract("payload_id", r"payload_id=(\d+)", 1).cast("bigint").alias("payload_id"), "status", "data_points")


def admission_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null at each level of a payload, and times given as numbers: the outcome, and the time of the point."""
    admitted = admit(encode_nulls(_events(prepared(spark), sf_dir))).persist()
    points = flatten(admitted)["points"].select("payload_id", F.unix_micros("timestamp").alias("ts_us"))
    found = admitted.select("payload_id", "status", "error").join(points, "payload_id", "left")
    admitted.unpersist()
    return found


def flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four relations as JSON objects, by their place in the payload."""
    rows = json_tables(_levels(spark, sf_dir))
    return rows.select("payload_id", "table_name", F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("at"), "row")


def _streamed(spark: SparkSession, sf_dir: str, **how) -> str:
    """A lake made by a stream over payload files."""
    base, source = new_folder(spark, "lake"), _payload_files(spark, sf_dir)
    start_stream(stream_payloads(spark, source, "*.txt*"), base, f"{base}/_checkpoint", available_now=True, **how).awaitTermination()
    return base


def stream_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a stream whose rows never reach its threshold: they are written when it ends."""
    return _facts(scan_lake(spark, _streamed(spark, sf_dir, rows=10**12)))


def stream_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the four tables after a stream of one batch, and of those that still wait."""
    base = _streamed(spark, sf_dir, rows=10**12)
    tables = {"metric_data": scan_lake(spark, base), **{t: scan_table(spark, base, t) for t in ("resources", "scopes", "metric_definitions")}}
    parts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t, rows in tables.items()]
    counted = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return counted.join(pending_rows(spark, base).withColumnRenamed("n", "waiting"), "table_name")


def stream_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a stream that flushes by rows; such flushes are told from those of the timer."""
    totals_ = log_totals(spark, _streamed(spark, sf_dir, rows=1))
    return totals_.select("requests_total", "requests_success", "requests_error", "points_ingested", "rows_written", "flushes", (F.col("threshold_flushes") > 0).alias("by_rows"))


def stream_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a stream wrote, and how many rows, where few wait and nothing more arrives: its time had come."""
    base, source = new_folder(spark, "lake"), _payload_files(spark, sf_dir)
    stream = start_stream(stream_payloads(spark, source, "*.txt*"), base, f"{base}/_checkpoint", rows=10**12, seconds=10, poll=1)
    tried = lambda: stream.lastProgress["batchId"] if stream.lastProgress else 0
    while not commits.latest(spark, base) and stream.isActive and tried() < 600:  # its clock makes a micro-batch a second, or as long as one takes
        time.sleep(0.5)
    stream.stop()
    return commits.live(commits.entries(spark, base)).select("reason", "rows")


def _increments(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A stored snapshot that was brought up to date after the first of three batches and after the last."""
    base, payloads = new_folder(spark, "lake"), _encoded(spark, sf_dir)
    for b in range(3):
        ingest(payloads.filter(_third(b)), base, str(b), datetime(2024, 1, 1 + b))
        if b != 1:
            snapshots.refresh(spark, base, table)
    return snapshots.read(spark, base, table).withColumn("created_us", F.unix_micros("created_at"))


def dim_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _increments(spark, sf_dir, "resources").select("resource_hash", "attributes", "created_us", (F.col("updated_at") == F.col("created_at")).alias("fresh"))


def definition_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _increments(spark, sf_dir, "metric_definitions").select("scope_name", "scope_version", "name", "unit", "metric_type", "description", "created_us")


def compacted_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time range out of compacted days."""
    first = _events(spark, sf_dir).agg(F.min("ts").cast("date").alias("d")).first()
    start = datetime.combine(first.d, datetime.min.time()) + timedelta(days=10, hours=5, minutes=30)
    base = _written(spark, sf_dir)
    compaction.compact(spark, base, threshold=1)
    return _facts(scan_range(spark, base, start, start + timedelta(days=2)))


def metric_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and mean value per metric and hour."""
    facts = fact_rows(_levels(spark, sf_dir)["points"], NOW)
    return facts.groupBy("metric_name", "year", "month", "day", "hour").agg(F.count(F.lit(1)).alias("points"), F.round(F.avg(F.coalesce("value_double", F.col("value_int").cast("double"))), 6).alias("mean_value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flatten_points": flatten_points,
    "flatten_definitions": flatten_definitions,
    "resource_dim": resources,
    "scope_dim": scopes,
    "scope_dim_flush": scopes_flush,
    "definition_dim": definitions,
    "definition_dim_flush": definitions_flush,
    "dim_snapshot": snapshot,
    "scope_snapshot": scope_snapshot,
    "definition_snapshot": definition_snapshot,
    "stored_rows": stored_rows,
    "admission_cases": admission_cases,
    "admission_parser_cases": admission_parser_cases,
    "attribute_values": attribute_values,
    "flatten_kinds": flatten_kinds,
    "payload_files": payload_files,
    "stream_facts": stream_facts,
    "buffered_facts": buffered_facts,
    "pending_rows": waiting_rows,
    "parse_only": parse_only,
    "failed_write": failed_write,
    "rows_per_day": rows_per_day,
    "mixed_depth_scan": mixed_depth,
    "compaction_days": compaction_days,
    "compaction_dry_run": compaction_dry_run,
    "compaction_summary": compaction_summary,
    "compaction_kept": compaction_kept,
    "compaction_mismatch": compaction_mismatch,
    "compaction_unreadable": compaction_unreadable,
    "admission_log": admission_log,
    "ingest_stats": stats,
    "ingest_totals": totals,
    "rows_per_partition": rows_per_partition,
    "time_range_scan": time_range_scan,
    "metric_hourly": metric_hourly,
    "lake_roundtrip": lake_roundtrip,
    "compaction_roundtrip": compaction_roundtrip,
    "partition_inventory": inventory,
    "replay_after_compaction": replay_after_compaction,
    "two_compactors": two_compactors,
    "compaction_conflict": compaction_conflict,
    "vacuumed": vacuumed,
    "failed_batch": failed_batch,
    "oversize_payloads": oversize_payloads,
    "admission_nulls": admission_nulls,
    "flatten_json": flatten_json,
    "stream_drained": stream_drained,
    "stream_tables": stream_tables,
    "stream_threshold": stream_threshold,
    "stream_timer": stream_timer,
    "dim_increments": dim_increments,
    "definition_increments": definition_increments,
    "compacted_range_scan": compacted_range_scan,
}

_EVENTS = """
WITH e AS (SELECT *, event_id // 50 AS payload_id, event_id % 50 AS r_pos, epoch_us(ts) AS ts_us,
  '{"host.name": "host-' || (user_id % 20) || '", "service.name": "' || event_type || '"}' AS _sorted,
  '{"service.name": "' || event_type || '", "host.name": "host-' || (user_id % 20) || '"}' AS resource_attributes,
  'scope-' || event_type AS scope_name, CASE WHEN user_id % 3 <> 0 THEN '1.' || (user_id % 3) WHEN event_id % 4 = 0 THEN '' END AS scope_version,
  event_type || '.value' AS metric_name, CASE WHEN event_id % 7 <> 0 THEN 'u' || (event_id % 3) END AS unit,
  ['gauge', 'sum', 'histogram', 'summary', 'exponentialHistogram', 'unknown'][event_id % 6 + 1] AS metric_type,
  CASE WHEN event_id % 4 IN (0, 1) THEN value END AS value_double,
  CASE WHEN event_id % 4 = 2 THEN CAST(floor(value) AS BIGINT) END AS value_int,
  CASE WHEN event_id % 5 <> 0 THEN '{"k": ' || json_extract_string(props, '$.k') || '}' END AS attributes FROM events),
g AS (SELECT *, sha256(_sorted) AS resource_hash FROM e WHERE payload_id % 40 NOT IN (1, 2, 3)),
p AS (SELECT *, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour FROM g WHERE metric_type <> 'unknown')
"""
_FACTS = "SELECT resource_hash, scope_name, metric_name, ts_us, value_double, value_int, attributes, year, month, day, hour FROM p"
_STATUS = """CASE payload_id % 40 WHEN 1 THEN 400 WHEN 2 THEN 400 WHEN 3 THEN 500 ELSE 200 END AS status"""
_STATS = f"""{_EVENTS}, s AS (SELECT x.payload_id, {_STATUS.replace("payload_id", "x.payload_id")}, coalesce(r, 0) AS resources, coalesce(sc, 0) AS scopes, coalesce(d, 0) AS metric_definitions, coalesce(n, 0) AS data_points, coalesce(n, 0) AS written
FROM (SELECT DISTINCT payload_id FROM e) x LEFT JOIN (SELECT payload_id, count(DISTINCT resource_hash) AS r, count(DISTINCT (scope_name, coalesce(scope_version, '-'))) AS sc, count(DISTINCT (scope_name, coalesce(scope_version, '-'), metric_name)) AS d, count(*) FILTER (metric_type <> 'unknown') AS n FROM g GROUP BY 1) y ON x.payload_id = y.payload_id)
"""
_DAY = "epoch_us(TIMESTAMP '2024-01-01') + min(payload_id % 3) * 86400000000"
_FLUSHED = f"{_EVENTS}, f AS (SELECT *, payload_id % 3 AS b FROM g)"
_DAYS = f"{_EVENTS}, d AS (SELECT year, month, day, count(DISTINCT hour) AS n, count(*) AS k FROM p GROUP BY ALL)"
_CASES = """
WITH c AS (SELECT DISTINCT event_id // 50 AS payload_id, (event_id // 50) % 20 AS k FROM events),
r AS (SELECT payload_id, k, CASE WHEN k IN (0, 1, 17, 18) THEN 200 WHEN k IN (4, 5) THEN 413 WHEN k IN (2, 3, 6, 7, 8, 9, 10, 16) THEN 400 ELSE 500 END AS status,
  CASE WHEN k IN (0, 1, 17, 18) THEN NULL WHEN k IN (2, 3) THEN 'invalid gzip payload' WHEN k = 4 THEN 'decompressed payload too large' WHEN k = 5 THEN 'payload too large'
  WHEN k IN (6, 7, 8) THEN 'invalid JSON' WHEN k IN (9, 10, 16) THEN 'Missing resourceMetrics in OTLP payload' ELSE 'Parse error: unreadable structure or number' END AS error FROM c)
"""
_AGAIN = "CASE WHEN event_id % 3 = 0 THEN 'again \\u00e9' ELSE event_type END"
_ODD = {
    "s": f"""'"s": "' || {_AGAIN} || '"'""",
    "i": """'"i": "' || event_id || '"'""",
    "d": """'"d": ' || event_id || '.5'""",
    "b": """'"b": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END""",
    "y": """'"y": "AAE="'""",
    "a": """'"a": [' || event_id || ', "x", [], []]'""",
    "m": """'"m": {"k": true}'""",
    "u": """'"u": {"otherValue": 1}'""",
    "n": """'"n": {}'""",
}
_odd_text = lambda keys: "'{' || " + " || ', ' || ".join(_ODD[k] for k in keys) + " || '}'"
_NULLS = """
WITH c AS (SELECT DISTINCT event_id // 50 AS payload_id, (event_id // 50) % 20 AS k FROM events)
SELECT payload_id, CAST(CASE WHEN k IN (0, 14, 15, 16, 17) THEN 200 ELSE 500 END AS INTEGER) AS status,
  CASE WHEN k NOT IN (0, 14, 15, 16, 17) THEN 'Parse error: unreadable structure or number' END AS error,
  CASE WHEN k = 16 THEN 1700000000000000 WHEN k IN (0, 14, 15, 17) THEN 1700000000000001 END AS ts_us FROM c
"""
_JSON = """, x AS (SELECT *, CAST(r_pos AS VARCHAR) AS p0, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso FROM g)
SELECT payload_id, 'resources' AS table_name, p0 AS at, json_object('resource_hash', resource_hash, 'attributes', resource_attributes)::VARCHAR AS "row" FROM x
UNION ALL SELECT payload_id, 'scopes', p0 || ',0', json_object('name', scope_name, 'version', scope_version)::VARCHAR FROM x
UNION ALL SELECT payload_id, 'metric_definitions', p0 || ',0,0',
  json_object('scope_name', scope_name, 'scope_version', scope_version, 'name', metric_name, 'unit', unit, 'metric_type', metric_type, 'description', NULL)::VARCHAR FROM x
UNION ALL SELECT payload_id, 'metric_data', p0 || ',0,0,0', json_object('resource_hash', resource_hash, 'scope_name', scope_name, 'scope_version', scope_version, 'metric_name', metric_name,
  'timestamp', iso, 'value_double', value_double, 'value_int', value_int, 'attributes', attributes)::VARCHAR FROM x WHERE metric_type <> 'unknown'
"""
_TABLE_COUNTS = """SELECT 'metric_data' AS table_name, count(*) FILTER (metric_type <> 'unknown') AS n FROM g
UNION ALL SELECT 'resources', count(DISTINCT resource_hash) FROM g
UNION ALL SELECT 'scopes', count(DISTINCT (scope_name, coalesce(scope_version, ''))) FROM g
UNION ALL SELECT 'metric_definitions', count(DISTINCT (scope_name, coalesce(scope_version, ''), metric_name)) FROM g"""
_RANGE = f"""{_EVENTS}, b AS (SELECT CAST(CAST(min(ts) AS DATE) AS TIMESTAMP) + INTERVAL 10 DAY + INTERVAL 5 HOUR + INTERVAL 30 MINUTE AS t FROM events)
{_FACTS}, b WHERE ts >= b.t AND ts < b.t + INTERVAL 2 DAY"""
_DEFINITION = "SELECT scope_name, arg_min(struct_pack(v := scope_version), event_id).v AS scope_version, metric_name AS name, arg_min(struct_pack(v := unit), event_id).v AS unit, arg_min(metric_type, event_id) AS metric_type, CAST(NULL AS VARCHAR) AS description FROM g GROUP BY scope_name, coalesce(scope_version, '{0}'), metric_name"

ORACLES: dict[str, str] = {
    "flatten_points": f"{_EVENTS} SELECT payload_id, resource_hash, scope_name, scope_version, metric_name, ts_us, value_double, value_int, attributes FROM p",
    "flatten_definitions": f"{_EVENTS} SELECT payload_id, CAST(r_pos AS INTEGER) AS r_pos, scope_name, scope_version, metric_name, unit, metric_type FROM g",
    "resource_dim": f"{_EVENTS} SELECT DISTINCT resource_hash, resource_attributes AS attributes FROM g",
    "scope_dim": f"{_EVENTS} SELECT DISTINCT scope_name AS name, scope_version AS version FROM g",
    "scope_dim_flush": f"{_EVENTS} SELECT scope_name AS name, arg_min(struct_pack(v := scope_version), event_id).v AS version FROM g GROUP BY scope_name, coalesce(scope_version, '')",
    "definition_dim": f"{_EVENTS} {_DEFINITION.format('-')}",
    "definition_dim_flush": f"{_EVENTS} {_DEFINITION.format('')}",
    "dim_snapshot": f"{_EVENTS} SELECT resource_hash, any_value(resource_attributes) AS attributes, {_DAY} AS created_us, true AS fresh FROM g GROUP BY resource_hash",
    "scope_snapshot": f"""{_FLUSHED} SELECT scope_name AS name, version, {_DAY} AS created_us
        FROM (SELECT b AS payload_id, scope_name, arg_min(struct_pack(v := scope_version), event_id).v AS version FROM f
        GROUP BY b, scope_name, coalesce(scope_version, '')) GROUP BY scope_name, version""",
    "definition_snapshot": f"""{_FLUSHED}, r AS (SELECT b AS payload_id, scope_name, metric_name, arg_min(struct_pack(v := scope_version, u := unit, t := metric_type), event_id) AS x
        FROM f GROUP BY b, scope_name, coalesce(scope_version, ''), metric_name)
        SELECT scope_name, x.v AS scope_version, metric_name AS name, arg_min(x, payload_id).u AS unit, arg_min(x, payload_id).t AS metric_type, CAST(NULL AS VARCHAR) AS description, {_DAY} AS created_us
        FROM r GROUP BY scope_name, x.v, metric_name""",
    "stored_rows": f"""{_EVENTS}, t AS (SELECT *, epoch_us(TIMESTAMP '2024-01-01') + (payload_id % 3) * 86400000000 AS created_us FROM g)
        SELECT 'resources' AS table_name, created_us, count(DISTINCT resource_hash) AS n FROM t GROUP BY ALL
        UNION ALL SELECT 'scopes', created_us, count(DISTINCT (scope_name, coalesce(scope_version, ''))) FROM t GROUP BY ALL
        UNION ALL SELECT 'metric_definitions', created_us, count(DISTINCT (scope_name, coalesce(scope_version, ''), metric_name)) FROM t GROUP BY ALL""",
    "admission_cases": f"{_CASES} SELECT payload_id, CAST(status AS INTEGER) AS status, error FROM r",
    "admission_parser_cases": f"""{_CASES}
        SELECT payload_id, CAST(CASE WHEN k IN (9, 10, 16) THEN 500 ELSE status END AS INTEGER) AS status, CASE WHEN k = 10 THEN 'Parse error: payload cannot be empty' WHEN k IN (9, 16) THEN 'Parse error: missing resourceMetrics' ELSE error END AS error, CAST(CASE WHEN status = 200 THEN 1 ELSE 0 END AS BIGINT) AS data_points
        FROM r""",
    "attribute_values": f"SELECT event_id // 50 AS payload_id, CAST(event_id % 50 AS INTEGER) AS r_pos, {_odd_text('sidbyamun')} AS attributes, sha256({_odd_text('abdimnsuy')}) AS resource_hash FROM events",
    "flatten_kinds": f"""{_EVENTS}, k AS (SELECT *, CASE WHEN metric_type IN ('sum', 'histogram') THEN metric_type ELSE 'unknown' END AS t FROM e
        WHERE payload_id % 40 NOT IN (1, 2) AND NOT (payload_id % 40 = 3 AND (payload_id * 50) % 6 IN (1, 2)))
        SELECT metric_name, t AS metric_type, count(*) AS definitions, (SELECT count(*) FROM k j
        WHERE j.metric_name = k.metric_name AND j.t <> 'unknown') AS points FROM k GROUP BY metric_name, t""",
    "payload_files": f"{_STATS} SELECT payload_id, CAST(status AS INTEGER) AS status, resources, data_points, payload_id % 2 = 1 AS gzip FROM s",
    "stream_facts": f"{_EVENTS} {_FACTS}",
    "buffered_facts": f"{_EVENTS} {_FACTS}",
    "pending_rows": f"""{_EVENTS}, w AS (SELECT * FROM g WHERE payload_id % 3 = 1) SELECT 'metric_data' AS table_name, count(*) FILTER (metric_type <> 'unknown') AS n FROM w
        UNION ALL SELECT 'resources', count(DISTINCT resource_hash) FROM w
        UNION ALL SELECT 'scopes', count(DISTINCT (scope_name, coalesce(scope_version, ''))) FROM w
        UNION ALL SELECT 'metric_definitions', count(DISTINCT (scope_name, coalesce(scope_version, ''), metric_name)) FROM w""",
    "parse_only": f"{_STATS} SELECT payload_id, data_points, CAST(0 AS BIGINT) AS written, false AS stored FROM s",
    "failed_write": f"{_STATS} SELECT payload_id, CAST(status AS INTEGER) AS status, data_points, CAST(0 AS BIGINT) AS written, CAST(4 AS BIGINT) AS write_errors FROM s",
    "rows_per_day": f"{_DAYS} SELECT year, month, day, n AS files, k AS rows FROM d",
    "mixed_depth_scan": f"{_EVENTS} {_FACTS}",
    "compaction_days": f"""{_DAYS}
        SELECT year, month, day, CASE WHEN n >= 10 THEN 'compacted' ELSE 'skipped' END AS status, n AS files_before, CASE WHEN n >= 10 THEN 1 ELSE n END AS files_after, CASE WHEN n >= 10 THEN k END AS rows
        FROM d""",
    "compaction_dry_run": f"{_DAYS} SELECT year, month, day, 'dry run' AS status, n AS files_before, n AS files_after, k AS rows FROM d",
    "compaction_summary": f"""{_DAYS}
        SELECT count(*) AS partitions_found, count(*) FILTER (n < 10) AS skipped, count(*) FILTER (n >= 10) AS compacted, coalesce(CAST(sum(n) FILTER (n >= 10) AS BIGINT), 0) AS files_before, count(*) FILTER (n >= 10) AS files_after, coalesce(CAST(sum(k) FILTER (n >= 10) AS BIGINT), 0) AS rows
        FROM d""",
    "compaction_kept": f"{_EVENTS} {_FACTS}",
    "compaction_mismatch": f"{_DAYS} SELECT year, month, day, 'count mismatch' AS status, n AS files_before, n AS files, k AS rows FROM d",
    "compaction_unreadable": f"""{_DAYS}
        SELECT year, month, day, CASE WHEN row_number() OVER (ORDER BY year, month, day) = 1 THEN 'unreadable' ELSE 'compacted' END AS status, CASE WHEN row_number() OVER (ORDER BY year, month, day) > 1 THEN k END AS rows
        FROM d""",
    "admission_log": f"""{_EVENTS}
        SELECT DISTINCT payload_id, CAST({_STATUS.replace(' AS status', '')} AS INTEGER) AS status, CASE payload_id % 40 WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'Missing resourceMetrics in OTLP payload' WHEN 3 THEN 'Parse error: unreadable structure or number' END AS error
        FROM e""",
    "ingest_stats": f"{_STATS} SELECT payload_id, CAST(status AS INTEGER) AS status, resources, scopes, metric_definitions, data_points, written, CAST(status <> 200 AS BIGINT) AS n_errors FROM s",
    "ingest_totals": f"""{_STATS}
        SELECT count(*) FILTER (status IN (200, 500)) AS requests_total, count(*) FILTER (status = 200) AS requests_success, count(*) FILTER (status = 500) AS requests_error, CAST(sum(data_points) AS BIGINT) AS points_ingested, count(DISTINCT payload_id % 3) FILTER (written > 0) AS flushes, CAST(sum(written) AS BIGINT) AS rows_written
        FROM s""",
    "rows_per_partition": f"{_EVENTS} SELECT year, month, day, hour, count(*) AS rows FROM p GROUP BY ALL",
    "time_range_scan": f"""{_EVENTS}, b AS (SELECT CAST(CAST(min(ts) AS DATE) AS TIMESTAMP) + INTERVAL 10 DAY + INTERVAL 5 HOUR + INTERVAL 30 MINUTE AS t
        FROM events) {_FACTS}, b WHERE ts >= b.t AND ts < b.t + INTERVAL 2 DAY""",
    "metric_hourly": f"{_EVENTS} SELECT metric_name, year, month, day, hour, count(*) AS points, round(avg(coalesce(value_double, value_int)), 6) AS mean_value FROM p GROUP BY ALL",
    "lake_roundtrip": f"{_EVENTS} {_FACTS}",
    "compaction_roundtrip": f"{_EVENTS} {_FACTS}",
    "partition_inventory": f"{_DAYS} SELECT year, month, day, 'year=' || year || '/month=' || month || '/day=' || day AS path, n AS file_count, true AS listed FROM d",
    "replay_after_compaction": f"{_EVENTS} {_FACTS}",
    "two_compactors": f"{_EVENTS} {_FACTS}",
    "compaction_conflict": f"{_DAYS} SELECT year, month, day, 'conflict' AS status, CAST(1 AS BIGINT) AS files, k AS rows FROM d",
    "vacuumed": f"{_EVENTS} {_FACTS.replace(' FROM p', ', CAST(0 AS BIGINT) AS files_left FROM p')}",
    "failed_batch": f"{_EVENTS} SELECT table_name, CAST(0 AS BIGINT) AS failed, n AS played_again FROM ({_TABLE_COUNTS})",
    "oversize_payloads": f"""{_STATS} SELECT payload_id, CAST(CASE WHEN payload_id % 40 = 4 THEN 413 ELSE status END AS INTEGER) AS status,
        CASE WHEN payload_id % 40 = 4 THEN 0 ELSE data_points END AS data_points FROM s""",
    "admission_nulls": _NULLS,
    "flatten_json": f"{_EVENTS} {_JSON}",
    "stream_drained": f"{_EVENTS} {_FACTS}",
    "stream_tables": f"{_EVENTS} SELECT table_name, n, CAST(0 AS BIGINT) AS waiting FROM ({_TABLE_COUNTS})",
    "stream_threshold": f"""{_STATS} SELECT count(*) FILTER (status IN (200, 500)) AS requests_total, count(*) FILTER (status = 200) AS requests_success,
        count(*) FILTER (status = 500) AS requests_error, CAST(sum(data_points) AS BIGINT) AS points_ingested, CAST(sum(written) AS BIGINT) AS rows_written,
        CAST(0 AS BIGINT) AS flushes, true AS by_rows FROM s""",
    "stream_timer": f"{_EVENTS} SELECT 'timer' AS reason, count(*) AS rows FROM p",
    "compacted_range_scan": _RANGE,
}
ORACLES["dim_increments"] = ORACLES["dim_snapshot"]
ORACLES["definition_increments"] = ORACLES["definition_snapshot"]
