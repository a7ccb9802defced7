"""Payload sources: files of one JSON document each, plain or gzipped, in batches or as a stream."""

from __future__ import annotations

import gzip
import os
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lakeweir.operators.admit import BODY_CAP
from lakeweir.sources.commits import local_path

_FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def _payloads(files: DataFrame, large: DataFrame, body_cap: int) -> DataFrame:
    """Bodies of files up to the cap, and the others without: Spark can't read one above 2 GB, nor needs to read any above the cap."""
    columns = lambda body: (F.col("path").alias("payload_id"), body.alias("body"), F.col("path").endswith(".gz").alias("gzip"), "length")
    read = files.filter(F.col("length") <= body_cap).select(*columns(F.col("content")))
    listed = large.filter(F.col("length") > body_cap).select(*columns(F.lit(None).cast("binary")))
    return read.unionByName(listed)


def read_payloads(spark: SparkSession, path: str, glob: str = "*.json*", body_cap: int = BODY_CAP) -> DataFrame:
    """payload_id, body (bytes as stored), gzip and length of each file; a body above the cap is null, and never read."""
    files = lambda: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return _payloads(files(), files(), body_cap)


#: Files of a micro-batch where no limit is given: for these, and those of the two before, the driver holds some 2 kB each, for all others under 1 kB.
MAX_FILES = 40_000


def stream_payloads(spark: SparkSession, path: str, glob: str = "*.json*", max_files: int | None = None, body_cap: int = BODY_CAP) -> DataFrame:
    """The same as a stream of files as they arrive, at most ``max_files`` (MAX_FILES) in a micro-batch."""
    bound = max_files or MAX_FILES

    def files() -> DataFrame:
        # what a listing found beyond the limit is kept for some micro-batches, so that not each lists the folder anew
        limits = {"maxFilesPerTrigger": bound, "maxCachedFiles": 5 * bound}
        return spark.readStream.format("binaryFile").schema(_FILES).options(pathGlobFilter=glob, **limits).load(path)

    return _payloads(files(), files(), body_cap)


#: Folders over which files are spread, so that no folder has all of them and they are listed in many tasks.
GROUPS = 128


def _putter(folder: str) -> Callable[[Iterable[Row]], None]:
    """Puts each row's value (and a line end, as Spark does) into a file of its own, whole or not at all; again in its place."""

    def put(rows: Iterable[Row]) -> None:
        for row in rows:
            own = f"{folder}/group={row.payload_id % GROUPS}"
            os.makedirs(own, exist_ok=True)
            data, held = row.value.encode() + b"\n", f"{own}/.{uuid.uuid4().hex}"
            with open(held, "wb") as file:
                file.write(gzip.compress(data, 6, mtime=0) if row.gzip else data)
            os.replace(held, f"{own}/payload_id={row.payload_id}.txt{'.gz' if row.gzip else ''}")

    return put


def write_payloads(rows: DataFrame, folder: str, **options: str) -> None:
    """A file for each row (payload_id, value, gzip), whose path has payload_id=<id>.

    Spark's writer names no files, so it needs a folder for each, and to make these on disk takes it some 50 ms of a core a
    file; there tasks write the files themselves. In other file systems Spark's writer does.
    """
    if place := local_path(rows.sparkSession, folder):
        os.makedirs(place, exist_ok=True)
        rows.select("payload_id", "value", "gzip").foreachPartition(_putter(place))
        return
    held = rows.repartition("payload_id").persist()
    for squeezed, kind in ((False, "none"), (True, "gzip")):
        held.filter(F.col("gzip") == squeezed).select("payload_id", "value").write.mode("append").options(**options).option("compression", kind).partitionBy("payload_id").text(folder)
    held.unpersist()
