"""Hand-written payloads through admission, flattening, sinks, streams and compaction."""

import gzip
import hashlib
import json
import re
import shutil
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakeweir.operators.admit import admit
from lakeweir.operators.compact import compact, summary
from lakeweir.operators.dims import definition_dim, scope_dim
from lakeweir.operators.flatten import flatten
from lakeweir.operators.stats import ingest_stats
from lakeweir.sources import commits
from lakeweir.sources import payloads as payload_source
from lakeweir.sources.lake import partition_inventory, scan_lake, scan_range
from lakeweir.sources.payloads import read_payloads, stream_payloads
from lakeweir.sources.shared import shared_folder
from lakeweir.streaming import ingest as streaming
from lakeweir.streaming.ingest import due, flush, ingest, keep, pending_rows, prepared, start_stream


def payload(*points, kind="gauge", resource=(("host.name", {"stringValue": "h"}),), scope=None, name="cpu", unit="1"):
    attributes = [{"key": k, "value": v} for k, v in resource]
    return {"resourceMetrics": [{"resource": {"attributes": attributes}, "scopeMetrics": [{"scope": scope or {"name": "s", "version": "1"}, "metrics": [{"name": name, "unit": unit, kind: {"dataPoints": list(points)}}]}]}]}


POINT = {"timeUnixNano": "1700000000123456789", "asDouble": 1.5}


def table(spark, *bodies):
    rows = [(i, b if isinstance(b, bytes) else (b if isinstance(b, str) else json.dumps(b)).encode(), isinstance(b, bytes)) for i, b in enumerate(bodies)]
    return prepared(spark).createDataFrame(rows, "payload_id bigint, body binary, gzip boolean")


def test_admission(spark):
    good = payload(POINT)
    rows = table(spark, good, "{broken", {"other": 1}, payload({"timeUnixNano": "soon"}), gzip.compress(json.dumps(good).encode()), b"not gzip", gzip.compress(b"{}" + b" " * 5000), gzip.compress(json.dumps(good).encode())[:-9], "[]", json.dumps(good) + " " * 9000, payload({**POINT, "asInt": "x"}), {"resourceMetrics": "x"}, payload({**POINT, "asInt": 1.5}))
    got = {r.payload_id: (r.status, r.error) for r in admit(rows, body_cap=8000, inflated_cap=4000).collect()}
    assert [got[i][0] for i in range(13)] == [200, 400, 400, 500, 200, 400, 413, 400, 400, 413, 500, 500, 500]
    assert got[1][1] == "invalid JSON" and got[2][1] == "Missing resourceMetrics in OTLP payload" and got[6][1] == "decompressed payload too large"
    assert admit(table(spark, "{}"), need_resources=False).first().error == "Parse error: payload cannot be empty"


def test_values(spark):
    odd = [("a", {"doubleValue": 12345678.9}), ("b", {"arrayValue": {"values": [{"intValue": "4"}, {"boolValue": True}]}}), ("c", {"kvlistValue": {"values": [{"key": "k", "value": {"stringValue": "é"}}]}}), ("a", {"stringValue": "again"}), ("", {"stringValue": "no"}), ("n", {"intValue": "42"})]
    levels = flatten(admit(table(spark, payload(POINT, {"asInt": "7", "asDouble": "NaN", "attributes": [{"key": "x", "value": {"intValue": 3}}]}, {"timeUnixNano": 1500, "attributes": []}, resource=odd))))
    resource = levels["resources"].first()
    want = {"a": "again", "b": ["4", True], "c": {"k": "é"}, "n": "42"}
    assert resource.attributes == json.dumps(want)
    assert resource.resource_hash == hashlib.sha256(json.dumps(want, sort_keys=True).encode()).hexdigest()
    points = levels["points"].orderBy("p_pos").selectExpr("unix_micros(timestamp) AS us", "value_double", "value_int", "attributes").collect()
    assert points[0].us == 1700000000123457 and points[0].value_double == 1.5
    assert (points[1].us, points[1].value_int, points[1].attributes) == (0, 7, '{"x": 3}')
    assert points[2].attributes is None and points[2].us == 2


def test_first_wins_and_versions(spark):
    levels = flatten(admit(table(spark, payload(POINT, unit="a"), payload(POINT, unit="b", kind="sum"), payload(POINT, scope={"name": "s"}), payload(POINT, scope={"name": "s", "version": ""}), {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m"}]}]}]})))
    found = {(r.scope_name, r.scope_version, r.name): (r.unit, r.metric_type) for r in definition_dim(levels["metrics"]).collect()}
    assert found[("s", "1", "cpu")] == ("a", "gauge")
    assert found[("unknown", None, "m")] == (None, "unknown")
    assert scope_dim(levels["scopes"]).count() == 4 and scope_dim(levels["scopes"], flush=True).count() == 3


def test_lake(spark, tmp_path):
    base, source = str(tmp_path / "lake"), tmp_path / "in"
    source.mkdir()
    for i in range(6):
        body = json.dumps(payload(*({"timeUnixNano": (1700000000 + 3600 * (i + j)) * 10**9, "asInt": j} for j in range(4)))).encode()
        (source / f"{i}.json{'.gz' if i % 2 else ''}").write_bytes(gzip.compress(body) if i % 2 else body)
    stats = ingest(read_payloads(prepared(spark), str(source)), base, "0", datetime(2024, 1, 1))
    assert stats.selectExpr("sum(data_points) AS n").first().n == 24 == scan_lake(spark, base).count()
    ingest(read_payloads(spark, str(source)), base, "0", datetime(2024, 1, 1))
    assert scan_lake(spark, base).count() == 24  # a batch played again replaces itself
    ranged = scan_range(spark, base, datetime(2023, 11, 14, 23), datetime(2023, 11, 15, 1))
    assert ranged.count() == 5 and re.search(r"PartitionFilters: \[[^\]]*concat\(year", ranged._jdf.queryExecution().toString())
    before = sorted(map(str, scan_lake(spark, base).collect()))
    assert summary(compact(spark, base, threshold=1, dry_run=True)).first().compacted == 0
    done = summary(compact(spark, base, threshold=4)).first()
    assert done.compacted >= 1 and sorted(map(str, scan_lake(spark, base).collect())) == before
    assert partition_inventory(spark, f"{base}/metric_data_daily").count() == done.compacted
    other = str(tmp_path / "streamed")
    start_stream(stream_payloads(spark, str(source), max_files=2), other, str(tmp_path / "check"), available_now=True).awaitTermination()
    assert scan_lake(spark, other).count() == 24


def attributed(value, point=False):
    entry = {"key": "a", "value": value}
    return payload({**POINT, "attributes": [entry]}) if point else payload(POINT, resource=[("a", value)])


def deep(value, depth):
    for k in range(depth):
        value = {"arrayValue": {"values": [value]}} if k % 2 else {"kvlistValue": {"values": [{"key": "k", "value": value}]}}
    return value


MALFORMED = [{"arrayValue": None}, {"arrayValue": {"values": [1]}}, {"arrayValue": {"values": [None]}}, {"arrayValue": {"values": "x"}}, {"kvlistValue": {"values": [{"key": "k"}]}}, {"kvlistValue": {"values": [{"value": {"intValue": 1}}]}}, {"kvlistValue": {"values": [5]}}, {"kvlistValue": 7}]


def test_malformed_attributes(spark, tmp_path):
    """Each bars its own payload only, on resources and points, at any depth, in a batch and in a stream."""
    bodies = [attributed(deep(v, d), point) for v in MALFORMED for d in (0, 1, 2, 5) for point in (False, True)]
    good = [attributed(deep(v, 3), point) for v in ({"arrayValue": {}}, {"other": 1}, {"stringValue": "s"}) for point in (False, True)]
    admitted = admit(table(spark, *bodies, *good))
    got = {r.payload_id: r.status for r in admitted.collect()}
    assert [got[i] for i in range(len(got))] == [500] * len(bodies) + [200] * len(good)
    assert flatten(admitted)["points"].count() == len(good)
    source = tmp_path / "in"
    source.mkdir()
    for i, body in enumerate(bodies[:6] + good):
        (source / f"{i}.json").write_text(json.dumps(body))
    start_stream(stream_payloads(prepared(spark), str(source)), str(tmp_path / "lake"), str(tmp_path / "check"), available_now=True).awaitTermination()
    assert scan_lake(spark, str(tmp_path / "lake")).count() == len(good)


def test_strict_bodies(spark):
    good = json.dumps(payload(POINT))
    bodies = ["{'resourceMetrics':[]}", good + " {}", good + "]", payload({**POINT, "timeUnixNano": "1.5"}), payload({**POINT, "timeUnixNano": "1e18"}), payload({**POINT, "asDouble": "1.5d"}), payload({**POINT, "asDouble": "0x1p3"}), "", "5"]
    fine = [good, '{"resourceMetrics": [], "more": NaN}', payload({**POINT, "timeUnixNano": "99999999999999999999"}), payload({**POINT, "asDouble": "Infinity"}), payload({**POINT, "asDouble": " 1e3 "})]
    got = {r.payload_id: r.status for r in admit(table(spark, *bodies, *fine)).collect()}
    assert [got[i] for i in range(len(got))] == [400, 400, 400, 500, 500, 500, 500, 400, 400, *[200] * len(fine)]
    assert admit(table(spark, good.encode("utf-16"))).first().status == 400  # flagged as gzip by the helper
    both = prepared(spark).createDataFrame([(0, good.encode("utf-16"), False), (1, good.encode("utf-8-sig"), None), (2, None, False)], "payload_id bigint, body binary, gzip boolean")
    assert {r.payload_id: r.status for r in admit(both).collect()} == {0: 200, 1: 200, 2: 400}


def test_stats_plan(spark):
    """One scan, no join; admission parses a payload once."""
    stats = ingest_stats(admit(table(spark, payload(POINT, POINT), "x")))
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("from_json") == 1
    rows = {r.payload_id: r for r in stats.collect()}
    assert (rows[0].resources, rows[0].scopes, rows[0].metric_definitions, rows[0].data_points, rows[0].errors) == (1, 1, 1, 2, [])
    assert rows[1].data_points == 0 and len(rows[1].errors) == 1
    assert ingest_stats(admit(table(spark, "x").limit(0))).count() == 0


def test_pending(spark, tmp_path):
    """Payloads wait for rows or for time; a flush that is played again adds nothing."""
    base = str(tmp_path / "lake")
    first, second = table(spark, payload(POINT, POINT)), table(spark, payload(POINT, name="other"))
    assert not due(spark, base, rows=1) and flush(spark, base).count() == 0
    keep(first, base, "0", since=100.0)
    assert not due(spark, base, rows=3, seconds=60, now=130.0) and due(spark, base, rows=3, seconds=60, now=160.0) and due(spark, base, rows=2, seconds=60, now=101.0)
    keep(second, base, "1", since=110.0)
    keep(second, base, "1", since=110.0)
    assert {r.table_name: r.n for r in pending_rows(spark, base).collect()} == {"metric_data": 3, "resources": 1, "scopes": 1, "metric_definitions": 2}
    shutil.copytree(f"{base}/_pending", tmp_path / "held")
    assert flush(spark, base).selectExpr("sum(written) AS n").first().n == 3 and not due(spark, base, rows=1)
    shutil.rmtree(f"{base}/_pending")
    shutil.copytree(tmp_path / "held", f"{base}/_pending")  # as if the flush had died before it forgot its payloads
    keep(table(spark, payload(POINT)), base, "2", since=120.0)
    flush(spark, base)
    assert scan_lake(spark, base).count() == 4


def test_stream_with_rows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(4):
        (source / f"{i}.json").write_text(json.dumps(payload(POINT, POINT)))
    base = str(tmp_path / "lake")
    start_stream(stream_payloads(prepared(spark), str(source), max_files=1), base, str(tmp_path / "check"), available_now=True, rows=3, seconds=10**6).awaitTermination()
    assert scan_lake(spark, base).count() == 8 and {r.n for r in pending_rows(spark, base).collect()} == {0}


def test_shared_folder(spark):
    assert shared_folder(spark) == shared_folder(spark)


@pytest.mark.parametrize("on_disk", [True, False])
def test_payload_files_are_written_and_read_whole(spark, tmp_path, monkeypatch, on_disk):
    """On disk, folders don't grow with the payloads; elsewhere Spark's writer gives the same payloads."""
    if not on_disk:
        monkeypatch.setattr(payload_source, "local_path", lambda spark, path: None)
    rows = spark.range(0, 300).select(F.col("id").alias("payload_id"), F.concat(F.lit("é"), F.col("id")).alias("value"), (F.col("id") % 2 == 1).alias("gzip"))
    payload_source.write_payloads(rows, str(tmp_path / "p"))
    if on_disk:
        payload_source.write_payloads(rows, str(tmp_path / "p"))  # as a task that is run again
        assert len([p for p in (tmp_path / "p").rglob("*") if p.is_dir()]) <= payload_source.GROUPS
    found = payload_source.read_payloads(spark, str(tmp_path / "p"), "*.txt*").collect()
    bodies = {int(re.search(r"payload_id=(\d+)", r.payload_id)[1]): gzip.decompress(r.body) if r.gzip else r.body for r in found}
    assert len(found) == 300 and bodies == {i: f"é{i}\n".encode() for i in range(300)}
    assert {r.gzip for r in found if "payload_id=7." in r.payload_id or "payload_id=7/" in r.payload_id} == {True}


def test_micro_batches_are_bounded_and_timed_as_one(spark, tmp_path, monkeypatch):
    """Without a limit of its own a stream reads a bounded number of files at once; the timer waits for the last part of what had arrived."""
    monkeypatch.setattr(payload_source, "MAX_FILES", 2, raising=False)
    sizes = []

    def kept(payloads, *args, **how):
        sizes.append(payloads.count())
        return keep(payloads, *args, **how)

    monkeypatch.setattr(streaming, "keep", kept)
    source, base = tmp_path / "in", str(tmp_path / "lake")
    source.mkdir()
    for i in range(5):
        (source / f"{i}.json").write_text(json.dumps(payload(POINT, POINT)))
    stream = start_stream(stream_payloads(prepared(spark), str(source)), base, str(tmp_path / "check"), rows=10**12, seconds=0, poll=1)
    end = time.time() + 120
    while not commits.latest(spark, base) and stream.isActive and time.time() < end:
        time.sleep(0.2)
    stream.stop()
    assert sizes == [2, 2, 1]
    assert [(r.reason, r.rows) for r in commits.live(commits.entries(spark, base)).collect()] == [("timer", 10)]


def test_a_drain_writes_its_micro_batches_together(spark, tmp_path):
    """Micro-batches that come one upon the other are one batch of the lake: each by itself would make files in all its hours."""
    source, base = tmp_path / "in", str(tmp_path / "lake")
    source.mkdir()
    for i in range(5):
        (source / f"{i}.json").write_text(json.dumps(payload(POINT, POINT)) if i else "{broken")
    keep(table(spark, payload(POINT)), base, "0", since=100.0, stream="died", counted=False)
    assert due(spark, base, rows=None, seconds=60, now=160.0) == "timer" and due(spark, base, rows=None, seconds=60, now=159.0) is None
    start_stream(stream_payloads(prepared(spark), str(source), max_files=2), base, str(tmp_path / "check"), available_now=True).awaitTermination()
    assert [(r.reason, r.rows) for r in commits.live(commits.entries(spark, base)).collect()] == [("drain", 9)]
    assert scan_lake(spark, base).count() == 9 and due(spark, base, rows=None, seconds=0) is None
    assert sorted(r.status for r in spark.read.parquet(f"{base}/_log").collect()) == [200] * 5 + [400]
