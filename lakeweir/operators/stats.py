"""Ingest statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweir.functions.columns import with_attribute_texts
from lakeweir.operators.admit import points_sql
from lakeweir.schemas import KINDS


def _points(scopes: str, kinds: tuple[str, ...]) -> str:
    """SQL for the number of points in a list of scopes."""
    total = lambda array, x, of: f"coalesce(aggregate({array}, 0L, (n, {x}) -> n + {of}), 0L)"
    return total(scopes, "s", total("s.metrics", "m", f"coalesce(CAST(size({points_sql('m', kinds)}) AS bigint), 0L)"))


def points_in(payload: str, kinds: tuple[str, ...] = KINDS) -> Column:
    """Number of points of an admitted payload; 0 where there is none."""
    return F.expr(f"coalesce(aggregate({payload}.resourceMetrics, 0L, (k, r) -> k + {_points('r.scopeMetrics', kinds)}), 0L)")


def ingest_stats(admitted: DataFrame, written: bool = True, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Per payload: distinct resources, scopes and definitions, points, rows written, and its errors.

    One pass: each payload is cut at its resources only, counted within them, and combined on the map side, as all of a
    payload's rows are in one task.
    """
    rows = admitted.select("payload_id", "status", "error", F.explode_outer("payload.resourceMetrics").alias("_r"))
    rows = with_attribute_texts(rows, "_r.resource.attributes", hashed="_hashed")
    name, listed = "coalesce(s.scope.name, 'unknown')", "filter(_r.scopeMetrics, s -> s IS NOT NULL)"
    definitions = f"flatten(transform(filter({listed}, s -> s.metrics IS NOT NULL), s -> transform(s.metrics, m -> struct({name} AS scope, s.scope.version AS version, coalesce(m.name, 'unknown') AS name))))"
    found = rows.select(
        "payload_id", "status", "error",
        F.when(F.col("_r").isNotNull(), F.sha2("_hashed", 256)).alias("hash"),
        F.expr(f"array_distinct(transform({listed}, s -> struct({name} AS name, s.scope.version AS version)))").alias("scopes"),
        F.expr(f"array_distinct({definitions})").alias("definitions"),
        F.expr(_points(listed, kinds)).alias("points"),
    )
    distinct = lambda c: F.coalesce(F.size(F.array_distinct(F.flatten(F.collect_list(c)))), F.lit(0)).cast("long")
    out = found.groupBy("payload_id").agg(
        F.first("status").alias("status"), F.first("error").alias("error"), F.size(F.collect_set("hash")).cast("long").alias("resources"), distinct("scopes").alias("scopes"),
        distinct("definitions").alias("metric_definitions"), F.coalesce(F.sum("points"), F.lit(0)).alias("data_points"),
    )
    out = out.withColumn("written", F.col("data_points") if written else F.lit(0).cast("long"))
    return out.withColumn("errors", F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.array().cast("array<string>"))).drop("error")


def ingest_totals(stats: DataFrame, flushes: int = 0) -> DataFrame:
    """Totals over the ingest log; only payloads past the shape rules count as requests."""
    request = F.col("status").isin(200, 500)
    good = request & ((F.size("errors") == 0) | (F.col("written") > 0))
    total = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")
    return stats.agg(total(request).alias("requests_total"), total(good).alias("requests_success"), total(request & ~good).alias("requests_error"), F.coalesce(F.sum("data_points"), F.lit(0)).alias("points_ingested"), F.lit(flushes).cast("long").alias("flushes"), F.coalesce(F.sum("written"), F.lit(0)).alias("rows_written"))


def rows_per_partition(facts: DataFrame) -> DataFrame:
    return facts.groupBy("year", "month", "day", "hour").agg(F.count(F.lit(1)).alias("rows"))
