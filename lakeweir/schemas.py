"""Input and stored schemas of the telemetry lake."""

from __future__ import annotations

#: A metric's kinds, in the order in which they are looked for. Fixed values.
KINDS = ("gauge", "sum", "histogram", "summary", "exponentialHistogram")


def payload_schema(kinds: tuple[str, ...] = KINDS) -> str:
    """DDL of a payload; all leaves are text, so that one bad number does not blank its neighbours."""
    attributes = "attributes: ARRAY<STRUCT<key: STRING, value: STRING>>"
    points = f"STRUCT<dataPoints: ARRAY<STRUCT<timeUnixNano: STRING, asDouble: STRING, asInt: STRING, {attributes}>>>"
    own = ", ".join(f"{k}: {points}" for k in kinds)
    metric = f"STRUCT<name: STRING, unit: STRING, description: STRING, {own}>"
    scope = f"STRUCT<scope: STRUCT<name: STRING, version: STRING>, metrics: ARRAY<{metric}>>"
    return f"resourceMetrics ARRAY<STRUCT<resource: STRUCT<{attributes}>, scopeMetrics: ARRAY<{scope}>>>"


def marked_schema(kinds: tuple[str, ...] = KINDS) -> str:
    """DDL of a list of a payload and the mark behind it."""
    return f"_d ARRAY<STRUCT<{payload_schema(kinds).replace('resourceMetrics ', 'resourceMetrics: ')}, _end: STRING>>, _corrupt_record STRING"


METRIC_DATA = "resource_hash STRING, scope_name STRING, metric_name STRING, timestamp TIMESTAMP, value_double DOUBLE, value_int BIGINT, attributes STRING, ingested_at TIMESTAMP, year STRING, month STRING, day STRING, hour STRING"
RESOURCES = "resource_hash STRING, attributes STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
SCOPES = "name STRING, version STRING, created_at TIMESTAMP"
METRIC_DEFINITIONS = "scope_name STRING, scope_version STRING, name STRING, unit STRING, metric_type STRING, description STRING, created_at TIMESTAMP"
TABLES = {"metric_data": METRIC_DATA, "resources": RESOURCES, "scopes": SCOPES, "metric_definitions": METRIC_DEFINITIONS}
EXTRA = {"metric_data": "batch STRING"}
