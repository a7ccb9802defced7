"""Ingest jobs: one batch of payloads, or a stream of them, to the four tables and the ingest log.

A batch writes its rows to the four tables under a token of its own, and then commits the token: before that no scan sees a
row of it in any table, and a batch that is played again replaces itself, compacted or not. There is no watermark: late points
go to their own hour.

A stream with a row threshold keeps the payloads of its micro-batches in ``_pending`` until enough rows wait or enough time has
passed. They are kept with their number of points, so whether a flush is due is seen without their bodies. The commit of a
flush also says up to which micro-batch of the stream it goes, so payloads are pending or committed, never both. Micro-batches
are bounded, so one that is full is a part of what had arrived: the timer waits for its last part, the row threshold doesn't.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweir.operators.admit import admit
from lakeweir.operators.dims import table_rows
from lakeweir.operators.flatten import fact_rows, flatten
from lakeweir.operators.stats import ingest_stats, ingest_totals, points_in
from lakeweir.schemas import KINDS
from lakeweir.sources import commits
from lakeweir.sources import payloads as payload_source
from lakeweir.sources.commits import delete_path, exists, new_token
from lakeweir.sources.shared import new_folder, stored

FLUSH_SECONDS, FLUSH_ROWS, POLL_SECONDS = 600, 50_000, 10
LOG = "payload_id STRING, status INT, resources BIGINT, scopes BIGINT, metric_definitions BIGINT, data_points BIGINT, written BIGINT, errors ARRAY<STRING>, batch STRING"
#: Why a batch was written: its time had come, enough rows waited, or the stream ended.
TIMER, ROWS, DRAIN = "timer", "rows", "drain"

#: Tasks put their files in place themselves, as no scan sees them before the commit; else the driver moves them one by one.
ADDED = {"compression": "snappy", "mapreduce.fileoutputcommitter.algorithm.version": "2"}


def write_facts(facts: DataFrame, base: str, batch: str) -> None:
    """Adds facts under batch=<batch> folders; one file an hour, more where an hour is large."""
    spread = facts.withColumn("batch", F.lit(batch)).hint("rebalance", "year", "month", "day", "hour")
    spread.write.mode("append").options(**ADDED).partitionBy("year", "month", "day", "hour", "batch").parquet(f"{base}/metric_data")


def write_dimension(rows: DataFrame, base: str, table: str, batch: str) -> None:
    """Adds rows under a batch=<batch> folder."""
    rows.withColumn("batch", F.lit(batch)).write.mode("append").options(**ADDED).partitionBy("batch").parquet(f"{base}/{table}")


def _replace(rows: DataFrame, base: str, table: str, *keys: str) -> None:
    """Puts rows in place of those with the same keys."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy(*keys).parquet(f"{base}/{table}")


def ingest(payloads: DataFrame, base: str, batch: str, batch_time: datetime | None = None, write: bool = True, log: bool = False, kinds: tuple[str, ...] = KINDS, reason: str = TIMER, also: tuple[dict, ...] = (), **caps) -> DataFrame:
    """Ingests a batch and returns its statistics per payload; a failed write is reported in them, counts kept.

    With ``write`` off, payloads are parsed and counted only. Statistics are stored: with ``log`` on in the ingest log, else in
    the shared folder; so nothing stays persisted. ``also`` are further entries of the batch's commit. The parsed payloads, which all
    tables and the statistics are made from, are stored too until these are written.
    """
    spark, now, token = payloads.sparkSession, batch_time or datetime.now(timezone.utc), new_token(batch)
    place = f"{base}/_admitted/{token}" if log else new_folder(spark, "admitted")
    try:
        admitted = stored(admit(payloads, kinds=kinds, **caps), place)
        failures = _written(admitted, kinds, base, batch, token, now, reason, also) if write else []
        stats = ingest_stats(admitted, written=write and not failures, kinds=kinds)
        if failures:
            stats = stats.withColumn("errors", F.concat("errors", F.array(*map(F.lit, failures))))
        if not log:
            return stored(stats, new_folder(spark, "stats"))
        _replace(stats.withColumn("payload_id", F.col("payload_id").cast("string")).withColumn("batch", F.lit(batch)), base, "_log", "batch")
        return spark.read.schema(LOG).parquet(f"{base}/_log").filter(F.col("batch") == batch).drop("batch")
    finally:
        delete_path(spark, place)


def _written(admitted: DataFrame, kinds: tuple[str, ...], base: str, batch: str, token: str, now: datetime, reason: str, also: tuple[dict, ...]) -> list[str]:
    """Writes the four tables at once and, if all are written, commits them; the errors of those that are not.

    The number of rows is summed over the payloads: Spark leaves out an observed part of a plan that turns out empty.
    """
    levels, spark = flatten(admitted, kinds), admitted.sparkSession
    jobs = [lambda: write_facts(fact_rows(levels["points"], now), base, token)]
    jobs += [lambda t=t, rows=rows: write_dimension(rows, base, t, token) for t, rows in table_rows(levels, now).items()]

    def failure(job) -> str | None:
        try:
            job()
        except Exception as error:  # reported to the caller, who decides whether to play the batch again
            return f"Write error: {type(error).__name__}"
        return None

    with ThreadPoolExecutor(len(jobs)) as pool:
        failures = list(filter(None, pool.map(failure, jobs)))
    if not failures:
        rows = admitted.agg(F.coalesce(F.sum(points_in("payload", kinds)), F.lit(0))).first()[0]
        commits.commit(spark, base, [{"kind": "batch", "batch": batch, "token": token, "reason": reason, "rows": rows}, *also])
    return failures


def log_totals(spark: SparkSession, base: str) -> DataFrame:
    """Totals over all batches in the ingest log. Batches with rows that a timer or an end of the stream wrote are flushes, those
    that enough rows brought about are counted apart."""
    log = spark.read.schema(LOG).parquet(f"{base}/_log")
    done = commits.live(commits.entries(spark, base)).filter("rows > 0")
    counted = done.agg(F.count_if(F.col("reason") != ROWS).alias("timer"), F.count_if(F.col("reason") == ROWS).alias("rows")).first()
    return ingest_totals(log, counted.timer).withColumn("threshold_flushes", F.lit(counted.rows).cast("long"))


# --- pending payloads ---------------------------------------------------------------------------------------------

_PENDING = "payload_id STRING, body BINARY, gzip BOOLEAN, length BIGINT, points BIGINT, since DOUBLE, stream STRING, batch STRING"


def keep(payloads: DataFrame, base: str, batch: str, since: float | None = None, stream: str = "-", counted: bool = True) -> None:
    """Puts a micro-batch's payloads aside until the next flush, with the number of points of each (null where they needn't be ``counted``,
    which takes a parse); again in place of itself."""
    own = payloads if "length" in payloads.columns else payloads.withColumn("length", F.octet_length("body"))
    own, points = (admit(own, carry=("body", "gzip", "length")), points_in("payload")) if counted else (own, F.lit(None).cast("bigint"))
    known = own.select(F.col("payload_id").cast("string").alias("payload_id"), "body", "gzip", F.col("length").cast("bigint").alias("length"), points.alias("points"))
    since = time.time() if since is None else since
    _replace(known.select("*", F.lit(since).alias("since"), F.lit(stream).alias("stream"), F.lit(batch).alias("batch")), base, "_pending", "stream", "batch")


def pending(spark: SparkSession, base: str) -> DataFrame:
    """Payloads that wait for a flush: those of micro-batches behind their stream's last flush."""
    path = f"{base}/_pending"
    if not exists(spark, path):
        return spark.createDataFrame([], _PENDING)
    log = commits.entries(spark, base).filter("kind = 'flushed'")
    done = log.groupBy(F.col("token").alias("stream")).agg(F.max("batch").alias("_done"))
    rows = spark.read.schema(_PENDING).parquet(path).join(F.broadcast(done), "stream", "left")  # one row a stream; else all its bodies are one key
    return rows.filter(F.col("_done").isNull() | (F.col("batch") > F.col("_done"))).drop("_done")


def pending_rows(spark: SparkSession, base: str) -> DataFrame:
    """table_name and n: rows that a flush would write to each table."""
    levels = flatten(admit(pending(spark, base)))
    tables = {"metric_data": levels["points"], **table_rows(levels, datetime(1970, 1, 1))}
    counted = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, rows in tables.items()]
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out


def waiting(spark: SparkSession, base: str) -> DataFrame:
    """points and since of all that is pending, from the columns kept beside the bodies; a payload that wasn't counted has one."""
    return pending(spark, base).agg(F.coalesce(F.sum(F.coalesce("points", F.lit(1))), F.lit(0)).alias("points"), F.min("since").alias("since"))


def due(spark: SparkSession, base: str, rows: int | None = FLUSH_ROWS, seconds: float = FLUSH_SECONDS, now: float | None = None) -> str | None:
    """Why a flush is due: enough data points wait (ROWS), or some and for long enough (TIMER); None if none is."""
    found = waiting(spark, base).first()
    if found.since is None or not found.points:
        return None
    if rows is not None and found.points >= rows:
        return ROWS
    return TIMER if (time.time() if now is None else now) - found.since >= seconds else None


def flush(spark: SparkSession, base: str, batch_time: datetime | None = None, log: bool = False, reason: str = TIMER) -> DataFrame:
    """Writes all that is pending as one batch, named after the oldest micro-batch in it; returns its statistics."""
    held = pending(spark, base)
    kept = [(r.stream, r.batch) for r in held.select("stream", "batch").distinct().orderBy("stream", "batch").collect()]  # one a micro-batch since the last flush
    if not kept:
        return ingest_stats(admit(held))
    first, last = dict(reversed(kept)), dict(kept)
    also = tuple({"kind": "flushed", "token": stream, "batch": batch} for stream, batch in last.items())
    name = "+".join(f"{stream}-{batch}" for stream, batch in first.items())
    stats = ingest(held.select("payload_id", "body", "gzip", "length"), base, name, batch_time, log=log, reason=reason, also=also)
    if not _failed(stats):
        for stream, batch in kept:  # pending no more since the commit
            delete_path(spark, f"{base}/_pending/stream={stream}/batch={batch}")
    return stats


# --- streams ------------------------------------------------------------------------------------------------------


def _failed(stats: DataFrame) -> list:
    return stats.filter(F.exists("errors", lambda e: e.startswith("Write error"))).select("errors").limit(1).collect()


def _checked(stats: DataFrame, batch: str) -> None:
    if found := _failed(stats):
        raise RuntimeError(f"batch {batch} was not written: {found[0].errors}")


class IngestStream:
    """A running stream of payloads; when it ends or is stopped, what still waits is written too."""

    def __init__(self, query, spark: SparkSession, base: str, buffered: bool):
        self.query, self._spark, self._base, self._buffered = query, spark, base, buffered

    def _drain(self) -> None:
        if self._buffered:
            _checked(flush(self._spark, self._base, log=True, reason=DRAIN), "drained")

    def awaitTermination(self, timeout: int | None = None) -> bool:  # noqa: N802  as Spark's queries have it
        """Waits for the end; True if it came."""
        ended = self.query.awaitTermination(timeout) if timeout is not None else (self.query.awaitTermination() or True)
        if ended:
            self._drain()
        return bool(ended)

    def stop(self) -> None:
        """Ends the stream after the micro-batch at hand is done."""
        self.query.stop()
        self._drain()

    def __getattr__(self, name: str):
        return getattr(self.query, name)


def start_stream(payloads: DataFrame, base: str, checkpoint: str, available_now: bool = False, seconds: int = FLUSH_SECONDS, rows: int | None = None, poll: int = POLL_SECONDS, full: int | None = None) -> IngestStream:
    """A stream that ingests its micro-batches and logs them; with available_now it drains what is there and ends.

    Without ``rows``, each micro-batch is written, one every ``seconds``; a drain, whose micro-batches come one upon the other, puts
    them aside and writes every ``seconds`` and at its end. With ``rows``, payloads are looked for every ``poll``
    seconds and written once that many data points wait or the oldest has waited ``seconds``: a clock beside the payloads makes
    a micro-batch even where none arrives. A micro-batch of ``full`` payloads (MAX_FILES) has more behind it, which are read before the
    timer counts.
    """
    spark = payloads.sparkSession

    def named(frame: DataFrame) -> str:
        """The stream's own name, so that the batches of two streams to one lake are told apart."""
        return frame.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "-"

    def each(frame: DataFrame, number: int) -> None:
        batch = f"{named(frame)}-{number:012d}"
        _checked(ingest(frame, base, batch, log=True), batch)

    oldest: list[float] = []  # when a drain put the first payloads aside that it hasn't written

    def drained(frame: DataFrame, number: int) -> None:
        keep(frame, base, f"{number:012d}", stream=named(frame), counted=False)
        oldest.append(time.time())
        if oldest[-1] - oldest[0] >= seconds:
            _checked(flush(frame.sparkSession, base, log=True, reason=TIMER), str(number))
            oldest.clear()

    def gathered(frame: DataFrame, number: int) -> None:
        session, batch, stream = frame.sparkSession, f"{number:012d}", named(frame)
        if not frame.select("payload_id").isEmpty():
            keep(frame, base, batch, stream=stream)
        reason = due(session, base, rows, seconds)
        if reason == TIMER and pending(session, base).filter((F.col("stream") == stream) & (F.col("batch") == batch)).count() >= (full or payload_source.MAX_FILES):
            return  # a part of what had arrived; the rest is read first
        if reason:
            _checked(flush(session, base, log=True, reason=reason), str(number))

    if rows is not None and not available_now:
        clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter("value < 0")
        payloads = payloads.unionByName(clock.select(*(F.lit(None).cast(t).alias(n) for n, t in payloads.dtypes)))
    writer = payloads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(gathered if rows is not None else drained if available_now else each)
    query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds if rows is None else poll} seconds")).start()
    return IngestStream(query, spark, base, rows is not None or available_now)


def session(builder: SparkSession.Builder) -> SparkSession:
    """A session with the settings that the jobs need."""
    return prepared(builder.getOrCreate())


def prepared(spark: SparkSession) -> SparkSession:
    """Times in UTC, the last of equal keys, times in files with statistics, which the default form has not, and small shuffles
    that stay spread: a batch has few bytes for each of many hour files, and what takes long is to make the files. What goes to
    Python at once is bounded by bytes, as bodies are large: 10,000 of them would be the memory of a machine. It is bounded by rows
    too, as the bytes are added up anew at each row: lists that are null cost the square of the batch. Payload files are small and many: a task lists and reads many of them, where Spark's defaults make 10,000 tasks of a listing. A stream's log of
    files isn't rewritten every ten micro-batches, which costs the square of their number. Rows of files are read 1,024 at once, as parsed
    payloads are large."""
    settings = {"session.timeZone": "UTC", "mapKeyDedupPolicy": "LAST_WIN", "parquet.outputTimestampType": "TIMESTAMP_MICROS", "adaptive.coalescePartitions.minPartitionSize": "16k", "execution.arrow.maxBytesPerBatch": "1m", "execution.arrow.maxRecordsPerBatch": "500"}
    settings |= {"sources.parallelPartitionDiscovery.parallelism": "96", "files.openCostInBytes": "256k", "streaming.fileSource.log.compactInterval": "1000", "hive.filesourcePartitionFileCacheSize": "0", "parquet.columnarReaderBatchSize": "1024"}
    for name, value in settings.items():
        spark.conf.set(f"spark.sql.{name}", value)
    return spark
