"""The commit log, over-size bodies, plain bodies, clustered days, pending payloads and stored snapshots."""

import glob
import json
import threading
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from test_lake import POINT, payload, table

from lakeweir.functions.columns import with_attribute_texts
from lakeweir.operators import admit as admission
from lakeweir.operators import compact as compaction
from lakeweir.operators import snapshots
from lakeweir.operators.admit import admit
from lakeweir.operators.dims import dim_snapshot
from lakeweir.operators.flatten import flatten
from lakeweir.sources import commits
from lakeweir.sources.lake import scan_lake, scan_range, scan_table, vacuum
from lakeweir.sources.payloads import read_payloads, stream_payloads
from lakeweir.streaming.ingest import TIMER, due, flush, ingest, keep, pending, prepared, start_stream, waiting, write_facts


def plan(df):
    return df._jdf.queryExecution().toString()


def test_races_take_turns(spark, tmp_path):
    """Of writers that want the same version one gets it; the others take the next, or give up where they clash."""
    base, won = str(tmp_path / "lake"), []

    def work(name):
        for i in range(8):
            won.append(commits.commit(spark, base, [{"kind": "batch", "batch": f"{name}-{i}", "token": f"{name}-{i}@"}]))

    threads = [threading.Thread(target=work, args=(n,)) for n in "abcd"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == list(range(1, 33)) and commits.live(commits.entries(spark, base)).count() == 32
    assert not commits.put_if_absent(spark, f"{base}/_commits/{5:020d}.json", "other")
    assert commits.commit(spark, base, [{"kind": "source", "path": "x"}], lambda newer: newer.count() == 2, since=30) is None
    assert commits.latest(spark, base) == 32


def test_scans_read_a_bounded_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "EVERY", 25)
    base = str(tmp_path / "lake")
    for i in range(240):
        rows = [{"kind": "batch", "batch": str(i % 200), "token": f"{i % 200}@{i}", "rows": i}, {"kind": "flushed", "token": "s", "batch": f"{i:05d}"}]
        if i % 10 == 0:
            rows += [{"kind": "target", "path": f"t{i}"}, {"kind": "source", "path": f"t{i - 10}"}, {"kind": "source", "path": f"h{i}"}]
        commits.commit(spark, base, rows)
    log = commits.entries(spark, base)
    assert commits.live(log).count() == 200 and commits.replaced(log).count() == 40
    assert [r.path for r in commits.targets(log).collect()] == ["t230"]
    assert log.filter("kind = 'flushed'").agg(F.max("batch")).first()[0] == "00239"
    assert len(glob.glob(f"{base}/_commits/*.json")) <= 50 and len(glob.glob(f"{base}/_commits/checkpoint-*")) == 2
    assert len(log.inputFiles()) <= 27


def test_bodies_above_the_cap_are_not_read(spark, tmp_path):
    good = json.dumps(payload(POINT)).encode()
    (tmp_path / "good.json").write_bytes(good)
    with open(tmp_path / "huge.json", "wb") as file:
        file.truncate(2_200_000_000)  # beyond what Spark can hold in a value
    rows = read_payloads(prepared(spark), str(tmp_path))
    assert "LessThanOrEqual(length" in plan(rows)
    got = {r.payload_id.rsplit("/", 1)[1]: (r.status, r.error) for r in admit(rows).collect()}
    assert got == {"good.json": (200, None), "huge.json": (413, "payload too large")}
    base = str(tmp_path / "lake")
    start_stream(stream_payloads(spark, str(tmp_path)), base, str(tmp_path / "check"), available_now=True).awaitTermination()
    assert scan_lake(spark, base).count() == 1


def test_plain_bodies_stay_in_the_jvm(spark, monkeypatch):
    """Python is handed the odd bodies only, and none of the texts that were read whole."""

    def fails(*args):
        def opened(body, squeezed):
            assert body.null_count == len(body)
            return body.cast("string")

        import pyarrow as pa

        opened.__annotations__ = {"body": pa.Array, "squeezed": pa.Array, "return": pa.Array}
        opener = F.arrow_udf(opened, StringType())
        return lambda *columns: F.struct(opener(*columns).alias("text"), F.lit(None).cast("string").alias("outcome"))

    monkeypatch.setattr(admission, "_opener", fails)
    good = [payload(POINT), payload({**POINT, "attributes": [{"key": "a", "value": {"arrayValue": {"values": [{"intValue": 1}]}}}]}), {"resourceMetrics": [], "é": "ü"}]
    assert {r.status for r in admit(table(spark, *good)).collect()} == {200}


def test_quoted_numbers_stay_in_the_jvm(spark):
    """NaN and the infinities as texts are handed to no Python, and as bare tokens are; both are read as before."""
    bodies = [json.dumps(payload({**POINT, "asDouble": x})) for x in ("NaN", "Infinity", "-Infinity")]
    odd = [b.replace('"NaN"', "NaN") for b in bodies[:1]] + [b.replace('"-Infinity"', "-Infinity") for b in bodies[2:]]
    plain = admission._plain(F.col("body").cast("string"), F.lit(False))
    assert [r.plain for r in table(spark, *bodies, *odd).select(plain.alias("plain")).collect()] == [True] * 3 + [False] * 2
    assert [r.status for r in admit(table(spark, *bodies, *odd)).orderBy("payload_id").collect()] == [200] * 3 + [500] * 2
    assert [r.status for r in admit(table(spark, '{"resourceMetrics": [], "x": "a"NaN"b"}', '{"resourceMetrics": [], "x": ""NaN""}')).collect()] == [400, 400]


def test_bytes_that_go_to_python_at_once_are_bounded(spark):
    """Large bodies go to Python a few at a time, however many a task has."""
    prepared(spark)

    def sizes(body: pa.Array) -> pa.Array:
        return pa.array([len(body)] * len(body), pa.int64())

    bodies = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 50_000).cast("binary").alias("body"))
    assert bodies.select(F.arrow_udf(sizes, "bigint")("body").alias("n")).agg(F.max("n")).first()[0] <= 40


def test_rows_that_go_to_python_at_once_are_bounded(spark):
    """Small rows too: to add up the bytes of a batch of null lists at each row costs the square of its rows."""
    prepared(spark)

    def sizes(number: pa.Array) -> pa.Array:
        return pa.array([len(number)] * len(number), pa.int64())

    assert spark.range(0, 20_000, 1, 1).select(F.arrow_udf(sizes, "bigint")("id").alias("n")).agg(F.max("n")).first()[0] <= 500


def test_plain_attributes_are_paired_once(spark):
    """The plain pairs of an attribute list are made by one column, whatever reads them; the texts are those of before."""
    prepared(spark)
    rows = spark.createDataFrame([([("b", '{"intValue":1}'), ("a", '{"stringValue":"x"}'), ("b", '{"intValue":2}')],), ([("a", '{"doubleValue":0.5}')],), ([],), (None,)], "attributes array<struct<key:string,value:string>>")
    found = with_attribute_texts(rows, "attributes", stored="s", hashed="h")
    assert [(r.s, r.h) for r in found.collect()] == [('{"b": 2, "a": "x"}', '{"a": "x", "b": 2}'), ('{"a": 0.5}', '{"a": 0.5}'), ("{}", "{}"), ("{}", "{}")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("map_from_entries") == 1


@pytest.mark.parametrize(("body", "status"), [
    ('{"resourceMetrics": []}],"y":[{}', 400), ('{"resourceMetrics": []},"z":{}', 400), ('{"resourceMetrics": []}],"_d":[{"resourceMetrics": []}', 400),
    ('{"resourceMetrics": []} ', 200), ("﻿" + '{"resourceMetrics": []}', 200), ('{"resourceMetrics": {}}', 500), ('{"x": 1}', 400),
    ('{"resourceMetrics": [], "x": INF}', 400), ('{"resourceMetrics": [], "x": "null"}', 200), ('{"resourceMetrics": [], "x": 01}', 400),
])
def test_odd_bodies(spark, body, status):
    assert admit(table(spark, body)).first().status == status


def test_times_as_numbers(spark):
    rows = table(spark, payload({"timeUnixNano": 1.7e18}), payload({"timeUnixNano": 1500.5}), payload({"timeUnixNano": 1e40}), payload({"timeUnixNano": "1.7e18"}))
    admitted = admit(rows)
    assert {r.payload_id: r.status for r in admitted.collect()} == {0: 200, 1: 200, 2: 500, 3: 500}
    assert {r.payload_id: r.us for r in flatten(admitted)["points"].selectExpr("payload_id", "unix_micros(timestamp) AS us").collect()} == {0: 1_700_000_000_000_000, 1: 2}


def test_an_hour_of_a_compacted_day(spark, tmp_path, monkeypatch):
    """Row groups of a compacted day hold ranges of time, so an hour needs few of them."""
    monkeypatch.setattr(compaction, "GROUP_BYTES", 100_000)
    base, token = str(tmp_path / "lake"), commits.new_token("0")
    at = F.timestamp_seconds(F.lit(1_700_006_400) + (F.col("id") * 7919) % 86_400)
    facts = prepared(spark).range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("resource_hash"), F.lit("s").alias("scope_name"), F.lit("m").alias("metric_name"), at.alias("timestamp"), F.rand(1).alias("value_double"), F.col("id").alias("value_int"), F.lit(None).cast("string").alias("attributes"), F.lit(datetime(2024, 1, 1)).alias("ingested_at"))
    facts = facts.withColumns({n: F.date_format("timestamp", f) for n, f in (("year", "yyyy"), ("month", "MM"), ("day", "dd"), ("hour", "HH"))})
    write_facts(facts, base, token)
    commits.commit(spark, base, [{"kind": "batch", "batch": "0", "token": token, "reason": TIMER}])
    assert {r.status for r in compaction.compact(spark, base, threshold=1).collect()} == {"compacted"}
    files = glob.glob(f"{base}/metric_data_daily/**/*.parquet", recursive=True)
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in files for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    spans = [next(g.column(i).statistics for i in range(g.num_columns) if g.column(i).path_in_schema == "timestamp") for g in groups]
    start, end = datetime(2023, 11, 15, 5), datetime(2023, 11, 15, 6)
    held = [s for s in spans if s.min.replace(tzinfo=None) < end and s.max.replace(tzinfo=None) >= start]
    assert len(groups) >= 10 and 1 <= len(held) <= len(groups) // 4
    ranged = scan_range(spark, base, start, end)
    assert ranged.count() == facts.filter((F.col("timestamp") >= F.lit("2023-11-15 05:00:00 UTC").cast("timestamp")) & (F.col("timestamp") < F.lit("2023-11-15 06:00:00 UTC").cast("timestamp"))).count()
    assert "GreaterThanOrEqual(timestamp" in plan(ranged)


def test_pending_payloads_are_flushed_once(spark, tmp_path):
    base = str(tmp_path / "lake")
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    keep(table(spark, payload(POINT, POINT)), base, "000", since=100.0, stream="s")
    keep(table(spark, payload(POINT)), base, "001", since=100.0, stream="s")
    read = waiting(spark, base)
    assert (read.first().points, due(spark, base, rows=3, now=100.0), due(spark, base, rows=4, seconds=5, now=106.0), due(spark, base, rows=4, seconds=5, now=101.0)) == (3, "rows", "timer", None)
    assert all("body" not in line for line in plan(read).split("== Physical Plan ==")[1].splitlines() if "ReadSchema" in line)
    flush(spark, base)
    keep(table(spark, payload(POINT)), base, "001", since=100.0, stream="s")  # as a stream does that died before it noted the micro-batch
    assert pending(spark, base).count() == 0 and due(spark, base, rows=1) is None
    keep(table(spark, payload(POINT)), base, "000", since=100.0, stream="other")
    assert flush(spark, base).count() == 1 and scan_lake(spark, base).count() == 4
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


@pytest.mark.parametrize("files", [3, 5])
def test_a_stream_that_ends_leaves_nothing(spark, tmp_path, files):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(files):
        (source / f"{i}.json").write_text(json.dumps(payload(POINT, POINT)))
    base = str(tmp_path / "lake")
    start_stream(stream_payloads(prepared(spark), str(source), max_files=1), base, str(tmp_path / "check"), available_now=True, rows=3, seconds=10**6).awaitTermination()
    assert scan_lake(spark, base).count() == 2 * files and pending(spark, base).count() == 0
    assert {r.reason for r in commits.live(commits.entries(spark, base)).collect()} == {"rows", "drain"}


def test_pending_payloads_of_a_stream_are_spread(spark, tmp_path):
    """What waits is joined to the log by broadcast, whatever the sizes: by shuffle, a stream's bodies would all be one task's."""
    base = str(tmp_path / "lake")
    keep(table(spark, payload(POINT)), base, "000", stream="s")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for _ in range(2):  # before the first commit and after it
            assert "SortMergeJoin" not in plan(pending(spark, base))
            assert "SortMergeJoin" not in plan(scan_table(spark, base, "scopes"))
            flush(spark, base)
            keep(table(spark, payload(POINT)), base, "001", stream="s")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_batch_without_rows_is_committed(spark, tmp_path):
    """A batch of which no payload is admitted is written and committed, with no rows."""
    base = str(tmp_path / "lake")
    payloads = table(spark, "{", payload(POINT)).cache()
    ingest(payloads.filter("payload_id < 1"), base, "0")
    ingest(payloads, base, "1")
    assert {r.batch: r.rows for r in commits.live(commits.entries(spark, base)).collect()} == {"0": 0, "1": 1}
    payloads.unpersist()


def test_parsed_payloads_are_not_persisted(spark, tmp_path, monkeypatch):
    """What all tables are made from is stored while they are written, in row groups that are bounded, and not kept on the executors' heaps."""
    base, payloads = str(tmp_path / "lake"), table(spark, "{", payload(POINT, POINT), payload(POINT))
    monkeypatch.setattr(type(payloads), "persist", lambda *args: pytest.fail("persisted"))
    for log in (False, True):
        found = ingest(payloads, base, str(log), log=log)
        assert sorted((r.status, r.data_points, r.written) for r in found.collect()) == [(200, 1, 1), (200, 2, 2), (400, 0, 0)]
    assert scan_lake(spark, base).count() == 6 and not glob.glob(f"{base}/_admitted/*")
    assert {r.status for r in ingest(payloads, "nofs://nowhere/lake", "0").collect()} == {200, 400}


def test_listing_payload_files_takes_few_tasks(spark, tmp_path):
    """However many folders there are, a listing has no task for each of them."""
    for i in range(150):
        (tmp_path / f"payload_id={i}").mkdir()
        (tmp_path / f"payload_id={i}" / "x.json").write_text(json.dumps(payload(POINT)))
    prepared(spark).sparkContext.setJobGroup("listing", "listing")
    try:
        read = read_payloads(spark, str(tmp_path))
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
        assert stages and max(s.numTasks for s in stages) <= 96
        assert read.count() == 150
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_snapshots(spark, tmp_path):
    base = str(tmp_path / "lake")
    hosts = lambda: {r.attributes for r in snapshots.read(spark, base, "resources").collect()}
    one = lambda h, b: ingest(table(spark, payload(POINT, resource=[("host.name", {"stringValue": h})])), base, b)
    assert snapshots.refresh(spark, base, "resources").count() == 0
    one("a", "0")
    snapshots.refresh(spark, base, "resources")
    one("b", "1")
    assert snapshots.refresh(spark, base, "resources").count() == 2
    files = {f.split("batch=")[1][:1] for f in scan_table(spark, base, "resources", since=snapshots.stored(spark, base, "resources")[1]).inputFiles() if "batch=" in f}
    assert files <= {"0", "1"}
    one("c", "0")  # batch 0 again, with other rows
    assert snapshots.refresh(spark, base, "resources").count() == 2 and hosts() == {'{"host.name": "b"}', '{"host.name": "c"}'}
    assert "Window" not in plan(dim_snapshot(scan_table(spark, base, "resources"), ["resource_hash"]))


def test_vacuum(spark, tmp_path):
    base = str(tmp_path / "lake")
    for batch in ("0", "0", "1"):
        ingest(table(spark, payload(POINT)), base, batch)
    files = lambda t: len(glob.glob(f"{base}/{t}/**/*.parquet", recursive=True))
    assert files("metric_data") == 3 and vacuum(spark, base).count() == 0  # too young
    assert vacuum(spark, base, seconds=0).filter("deleted").count() == 4 and files("metric_data") == files("resources") == 2
    compaction.compact(spark, base, threshold=1, delete=False)
    vacuum(spark, base, seconds=0)
    assert files("metric_data") == 0 and scan_lake(spark, base).count() == 2
