"""Flattening: nested payloads to one relation per level, with ordinals that keep the order of the document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweir.functions.columns import finite, nanos_to_timestamp, partition_columns, with_attribute_texts
from lakeweir.operators.admit import points_sql
from lakeweir.schemas import KINDS


def explode_resources(admitted: DataFrame) -> DataFrame:
    rows = admitted.filter("status = 200").select("payload_id", F.posexplode("payload.resourceMetrics").alias("r_pos", "_r"))
    rows = with_attribute_texts(rows, "_r.resource.attributes", stored="_stored", hashed="_hashed")
    return rows.select("payload_id", "r_pos", F.sha2("_hashed", 256).alias("resource_hash"), F.col("_stored").alias("attributes"), F.col("_r.scopeMetrics").alias("_scopes"))


def explode_scopes(resources: DataFrame) -> DataFrame:
    rows = resources.select("payload_id", "r_pos", "resource_hash", F.posexplode("_scopes").alias("s_pos", "_s"))
    return rows.select("payload_id", "r_pos", "s_pos", "resource_hash", F.coalesce("_s.scope.name", F.lit("unknown")).alias("scope_name"), F.col("_s.scope.version").alias("scope_version"), F.col("_s.metrics").alias("_metrics"))


def explode_metrics(scopes: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    rows = scopes.select("payload_id", "r_pos", "s_pos", "resource_hash", "scope_name", "scope_version", F.posexplode("_metrics").alias("m_pos", "_m"))
    kind = F.lit("unknown")
    for k in reversed(kinds):
        kind = F.when(F.col("_m")[k].isNotNull(), k).otherwise(kind)
    return rows.select("payload_id", "r_pos", "s_pos", "m_pos", "resource_hash", "scope_name", "scope_version", F.coalesce("_m.name", F.lit("unknown")).alias("metric_name"), F.col("_m.unit").alias("unit"), F.col("_m.description").alias("description"), kind.alias("metric_type"), F.expr(points_sql("_m", kinds)).alias("_points"))


def explode_points(metrics: DataFrame) -> DataFrame:
    keep = ("payload_id", "r_pos", "s_pos", "m_pos", "resource_hash", "scope_name", "scope_version", "metric_name")
    rows = with_attribute_texts(metrics.select(*keep, F.posexplode("_points").alias("p_pos", "_p")), "_p.attributes", stored="_stored")
    attributes = F.when(F.col("_p.attributes").isNotNull() & (F.col("_stored") != "{}"), F.col("_stored"))
    return rows.select(*keep[:4], "p_pos", *keep[4:], nanos_to_timestamp(F.col("_p.timeUnixNano")).alias("timestamp"), F.col("_p.asDouble").try_cast("double").alias("value_double"), F.col("_p.asInt").try_cast("bigint").alias("value_int"), attributes.alias("attributes"))


def flatten(admitted: DataFrame, kinds: tuple[str, ...] = KINDS) -> dict[str, DataFrame]:
    """resources, scopes, metrics and points of the admitted payloads; lazy, without a shuffle."""
    resources = explode_resources(admitted)
    scopes = explode_scopes(resources)
    metrics = explode_metrics(scopes, kinds)
    return {"resources": resources, "scopes": scopes, "metrics": metrics, "points": explode_points(metrics)}


def json_tables(levels: dict[str, DataFrame]) -> DataFrame:
    """payload_id, table_name, at (place in the document) and row: the four relations of each payload as JSON objects."""
    keys = {"resources": ["r_pos"], "scopes": ["r_pos", "s_pos"], "metrics": ["r_pos", "s_pos", "m_pos"], "points": ["r_pos", "s_pos", "m_pos", "p_pos"]}
    columns = {
        "resources": ["resource_hash", "attributes"],
        "scopes": [F.col("scope_name").alias("name"), F.col("scope_version").alias("version")],
        "metrics": ["scope_name", "scope_version", F.col("metric_name").alias("name"), "unit", "metric_type", "description"],
        "points": ["resource_hash", "scope_name", "scope_version", "metric_name", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp"), finite(F.col("value_double")).alias("value_double"), "value_int", "attributes"],
    }
    names = {"metrics": "metric_definitions", "points": "metric_data"}
    parts = [levels[x].select("payload_id", F.lit(names.get(x, x)).alias("table_name"), F.array(*keys[x]).alias("at"), F.to_json(F.struct(*columns[x]), {"ignoreNullFields": "false"}).alias("row")) for x in keys]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def fact_rows(points: DataFrame, batch_time) -> DataFrame:
    """Stored rows of metric_data; points are never deduplicated."""
    return points.select("resource_hash", "scope_name", "metric_name", "timestamp", finite(F.col("value_double")).alias("value_double"), "value_int", "attributes", F.lit(batch_time).cast("timestamp").alias("ingested_at"), *(c.alias(n) for n, c in partition_columns(F.col("timestamp")).items()))
