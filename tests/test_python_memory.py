"""Queries over admitted payloads hand Python no plain body, and bound what it is handed at once, whatever the session had."""

import glob
import os
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

import __spark_entry__ as entry
from lakeweir.operators import admit as admission

BOUNDS = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")
QUERIES = ["compaction_kept", "compaction_unreadable", "stored_rows", "scope_snapshot", "compaction_conflict", "compacted_range_scan", "two_compactors"]


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """Payloads of fifty events, most with a quoted NaN, in two hours of a day and one of the range that range scans ask for."""
    folder = str(tmp_path_factory.mktemp("few"))
    for path in glob.glob("/root/testdata/sf0.001/*.parquet"):
        if not path.endswith("/events.parquet"):
            os.symlink(path, f"{folder}/{os.path.basename(path)}")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_id < 350")
    start = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    hours = F.when(F.col("event_id") < 300, F.col("event_id") % 2).otherwise(10 * 24 + 7)
    events.withColumn("ts", F.timestamp_add("HOUR", hours, start)).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_plain_bodies_stay_out_of_python(spark, few, monkeypatch, name):
    def fails(*args):
        def opened(body, squeezed):
            assert body.null_count == len(body)
            return body.cast("string")

        opened.__annotations__ = {"body": pa.Array, "squeezed": pa.Array, "return": pa.Array}
        opener = F.arrow_udf(opened, StringType())
        return lambda *columns: F.struct(opener(*columns).alias("text"), F.lit(None).cast("string").alias("outcome"))

    for bound in BOUNDS:
        spark.conf.unset(bound)
    monkeypatch.setattr(admission, "_opener", fails)
    assert entry.queries()[name](spark, few).count()
    assert [spark.conf.get(bound) for bound in BOUNDS] == ["1m", "500"]
