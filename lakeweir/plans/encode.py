"""Payloads made from the events table, so that the ingest jobs can be held against SQL over that table.

Fifty events are one payload; each is one resource, scope and metric with at most one point. The encoding varies by event:
kinds, numbers as text, missing versions, units and attributes, and some payloads are broken on purpose.
"""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lakeweir.schemas import KINDS

PER_PAYLOAD, BAD_EVERY = 50, 40


def _said(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'{{"key":"{name}","value":{{"stringValue":"'), value, F.lit('"}}'))


def encode(events: DataFrame) -> DataFrame:
    """payload_id, body (bytes) and gzip."""
    i, payload = F.col("event_id"), F.expr(f"event_id div {PER_PAYLOAD}")
    turn = payload % BAD_EVERY
    nanos = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    nanos = F.when((turn == 3) & (i % PER_PAYLOAD == 0), F.lit('"soon"')).when(i % 2 == 0, F.concat(F.lit('"'), nanos, F.lit('"'))).otherwise(nanos)
    value = F.when(i % 4 == 0, F.concat(F.lit('"asDouble":'), F.col("value").cast("string"))).when(i % 4 == 1, F.concat(F.lit('"asDouble":"'), F.col("value").cast("string"), F.lit('"')))
    value = value.when(i % 4 == 2, F.concat(F.lit('"asInt":"'), F.floor(F.col("value")).cast("string"), F.lit('"'))).otherwise('"asDouble":"NaN"')
    attributes = F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(',"attributes":[{"key":"k","value":{"intValue":'), F.get_json_object("props", "$.k"), F.lit("}}]")))
    point = F.concat(F.lit('{"dataPoints":[{"timeUnixNano":'), nanos, F.lit(","), value, attributes, F.lit("}]}"))
    kind = F.lit("")
    for n, name in enumerate(KINDS):
        kind = F.when(i % 6 == n, F.concat(F.lit(f',"{name}":'), point)).otherwise(kind)
    unit = F.when(i % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(',"unit":"u'), (i % 3).cast("string"), F.lit('"')))
    version = F.when((F.col("user_id") % 3 == 0) & (i % 4 == 0), F.lit(',"version":""')).when(F.col("user_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(',"version":"1.'), (F.col("user_id") % 3).cast("string"), F.lit('"')))
    host = F.concat(F.lit("host-"), (F.col("user_id") % 20).cast("string"))
    entry = F.concat(F.lit('{"resource":{"attributes":['), _said("service.name", F.col("event_type")), F.lit(","), _said("host.name", host), F.lit(']},"scopeMetrics":[{"scope":{"name":"scope-'), F.col("event_type"), F.lit('"'), version, F.lit('},"metrics":[{"name":"'), F.col("event_type"), F.lit('.value"'), unit, kind, F.lit("}]}]}"))
    listed = events.select(payload.alias("payload_id"), i.alias("_i"), entry.alias("_entry")).groupBy("payload_id").agg(F.sort_array(F.collect_list(F.struct("_i", "_entry"))).alias("_all"))
    entries = F.array_join(F.transform("_all", lambda x: x["_entry"]), ",")
    name = F.when(F.col("payload_id") % BAD_EVERY == 2, "other").otherwise("resourceMetrics")
    body = F.concat(F.lit('{"'), name, F.lit('":['), entries, F.when(F.col("payload_id") % BAD_EVERY == 1, "").otherwise("]}"))
    return listed.select("payload_id", body.cast("binary").alias("body"), F.lit(False).alias("gzip"))


# --- payloads for each admission rule -----------------------------------------------------------------------------

#: Caps that the padded payloads exceed.
BODY_CAP, INFLATED_CAP = 200_000, 400_000
CASES = 20


def _squeeze(body: pa.Array) -> pa.Array:
    return pa.array([None if x is None else gzip.compress(x) for x in body.to_pylist()], pa.binary())


_squeezed = F.arrow_udf(_squeeze, BinaryType())


def _one(events: DataFrame) -> DataFrame:
    """payload_id, _resource, _point and _tail: the parts of a payload of one point for each group of events."""
    first = events.groupBy(F.expr(f"event_id div {PER_PAYLOAD}").alias("payload_id")).agg(F.min_by("event_type", "event_id").alias("_type"), F.min("event_id").alias("_id"))
    resource = F.concat(F.lit('{"resourceMetrics":[{"resource":{"attributes":['), _said("service.name", F.col("_type")))
    return first.select("payload_id", "_id", resource.alias("_resource"), F.lit(']},"scopeMetrics":[{"scope":{"name":"s"},"metrics":[{"name":"m","gauge":{"dataPoints":[').alias("_middle"), F.lit("]}}]}]}]}").alias("_tail"))


def encode_cases(events: DataFrame) -> DataFrame:
    """payload_id, body and gzip: payloads that meet or break one admission rule each, by payload_id modulo CASES."""
    case = F.col("payload_id") % CASES
    listed = lambda value: F.lit(f',{{"key":"odd","value":{value}}}')
    extra = F.when(case == 13, listed('{"arrayValue":null}')).when(case == 14, listed('{"arrayValue":{"values":[1]}}'))
    extra = extra.when(case == 15, listed('{"arrayValue":{"values":[{"kvlistValue":{"values":[{"key":"x"}]}}]}}')).when(case == 18, listed('{"arrayValue":{"values":[{"kvlistValue":{"values":[{"key":"x","value":{"intValue":1}}]}}]}}')).otherwise("")
    time = F.when(case == 11, '"1.5"').when(case == 19, '"soon"').otherwise(F.concat(F.lit('"17000000'), F.lpad((F.col("_id") % 100).cast("string"), 2, "0"), F.lit('000000000"')))
    value = F.when(case == 12, '"1.5d"').otherwise("1.5")
    body = F.concat("_resource", extra, "_middle", F.lit('{"timeUnixNano":'), time, F.lit(',"asDouble":'), value, F.lit("}"), "_tail")
    body = F.when(case.isin(4, 5), F.concat(body, F.repeat(F.lit(" "), F.when(case == 4, INFLATED_CAP).otherwise(BODY_CAP)))).otherwise(body)
    rows = _one(events).withColumn("_body", body)
    less = F.expr("left(_body, length(_body) - 1)")
    text = F.when(case == 6, less).when(case == 7, F.concat("_body", F.lit(" {}"))).when(case == 8, F.translate("_body", '"', "'")).when(case == 9, F.replace(F.col("_body"), F.lit("resourceMetrics"), F.lit("other")))
    text = text.when(case == 10, "{}").when(case == 16, F.concat(F.lit("["), F.col("_body"), F.lit("]"))).when(case == 17, F.concat(less, F.lit(',"more":NaN}'))).otherwise(F.col("_body"))
    rows = rows.withColumn("_text", text.cast("binary")).withColumn("_gz", _squeezed(F.when(case.isin(1, 3, 4), F.col("_text"))))
    body = F.when(case == 3, F.expr("substring(_gz, 1, length(_gz) - 9)")).otherwise(F.coalesce("_gz", "_text"))
    return rows.select("payload_id", body.alias("body"), case.isin(1, 2, 3, 4).alias("gzip"))


NULL_CASES = 20


def encode_nulls(events: DataFrame) -> DataFrame:
    """payload_id, body and gzip: by payload_id modulo NULL_CASES, payloads with a null at each level and times given as numbers."""
    case = F.col("payload_id") % NULL_CASES
    pick = lambda usual, **odd: _cases(case, usual, {int(k[1:]): v for k, v in odd.items()})
    time = pick("1700000000000001000", _13="null", _16="1.7e18", _17="1700000000000001000.0", _18='"1.7e18"')
    value = pick("1.5", _14="null")
    entries = pick('[{"key":"a","value":{"stringValue":"x"}}]', _19='[{"key":"a","value":null}]')
    points = pick(None, _11="null", _12="[null]")
    points = F.coalesce(points, F.concat(F.lit('[{"timeUnixNano":'), time, F.lit(',"asDouble":'), value, F.lit(',"attributes":'), entries, F.lit("}]")))
    gauge = F.coalesce(pick(None, _10="null"), F.concat(F.lit('{"dataPoints":'), points, F.lit("}")))
    metrics = F.coalesce(pick(None, _8="null", _9="[null]"), F.concat(F.lit('[{"name":"m","unit":'), pick('"u"', _15="null"), F.lit(',"gauge":'), gauge, F.lit("}]")))
    scopes = F.coalesce(pick(None, _5="null", _6="[null]"), F.concat(F.lit('[{"scope":'), pick('{"name":"s"}', _7="null"), F.lit(',"metrics":'), metrics, F.lit("}]")))
    resource = pick('{"attributes":[]}', _3="null", _4='{"attributes":null}')
    resources = F.coalesce(pick(None, _1="null", _2="[null]"), F.concat(F.lit('[{"resource":'), resource, F.lit(',"scopeMetrics":'), scopes, F.lit("}]")))
    body = F.concat(F.lit('{"resourceMetrics":'), resources, F.lit("}"))
    ids = events.select(F.expr(f"event_id div {PER_PAYLOAD}").alias("payload_id")).distinct()
    return ids.select("payload_id", body.cast("binary").alias("body"), F.lit(False).alias("gzip"))


def _cases(case: Column, usual: str | None, odd: dict[int, str]) -> Column:
    out = F.lit(usual)
    for n, text in odd.items():
        out = F.when(case == n, text).otherwise(out)
    return out


def encode_attributes(events: DataFrame) -> DataFrame:
    """payload_id and body: fifty resources a payload, with attributes of every kind, repeated and empty keys among them."""
    i = F.col("event_id")
    number = i.cast("string")
    said = [
        _said("s", F.col("event_type")),
        F.concat(F.lit('{"key":"i","value":{"intValue":"'), number, F.lit('"}}')),
        F.concat(F.lit('{"key":"d","value":{"doubleValue":'), number, F.lit(".5}}")),
        F.concat(F.lit('{"key":"b","value":{"boolValue":'), F.when(i % 2 == 0, "true").otherwise("false"), F.lit("}}")),
        F.lit('{"key":"y","value":{"bytesValue":"AAE="}}'),
        F.concat(F.lit('{"key":"a","value":{"arrayValue":{"values":[{"intValue":'), number, F.lit('},{"stringValue":"x"},{"arrayValue":{"values":[]}},{"arrayValue":{}}]}}}')),
        F.concat(F.lit('{"key":"m","value":{"kvlistValue":{"values":[{"key":"k","value":{"intValue":"'), number, F.lit('"}},{"key":"k","value":{"boolValue":true}}]}}}')),
        F.lit('{"key":"u","value":{"otherValue":1}}'),
        F.lit('{"key":"n"}'),
        F.lit('{"key":"","value":{"stringValue":"no"}}'),
        F.lit('{"value":{"stringValue":"no"}}'),
        F.when(i % 3 == 0, F.lit('{"key":"s","value":{"stringValue":"again \\u00e9"}}')),
    ]
    kept = F.array_join(F.filter(F.array(*said), lambda x: x.isNotNull()), ",")
    entry = F.concat(F.lit('{"resource":{"attributes":['), kept, F.lit("]}}"))
    listed = events.select(F.expr(f"event_id div {PER_PAYLOAD}").alias("payload_id"), i.alias("_i"), entry.alias("_entry")).groupBy("payload_id").agg(F.sort_array(F.collect_list(F.struct("_i", "_entry"))).alias("_all"))
    body = F.concat(F.lit('{"resourceMetrics":['), F.array_join(F.transform("_all", lambda x: x["_entry"]), ","), F.lit("]}"))
    return listed.select("payload_id", body.cast("binary").alias("body"), F.lit(False).alias("gzip"))
