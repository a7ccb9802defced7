"""Dimension rows: the first row of each key wins, in document order. Minima combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first(rows: DataFrame, keys: dict[str, Column], values: list[str], order: list[str]) -> DataFrame:
    picked = F.min_by(F.struct(*values), F.struct(*order)).alias("_first")
    return rows.groupBy(*(c.alias(f"_key_{n}") for n, c in keys.items())).agg(picked).select("_first.*")


def resource_dim(resources: DataFrame) -> DataFrame:
    return _first(resources, {"h": F.col("resource_hash")}, ["resource_hash", "attributes"], ["payload_id", "r_pos"])


def scope_dim(scopes: DataFrame, flush: bool = False) -> DataFrame:
    """Scopes by name and version; at flush scope a missing version equals an empty one."""
    version = F.coalesce("scope_version", F.lit("")) if flush else F.col("scope_version")
    found = _first(scopes, {"n": F.col("scope_name"), "v": version}, ["scope_name", "scope_version"], ["payload_id", "r_pos", "s_pos"])
    return found.withColumnsRenamed({"scope_name": "name", "scope_version": "version"})


def definition_dim(metrics: DataFrame, flush: bool = False) -> DataFrame:
    """Definitions by scope and name; unit, kind and description of the first one stay."""
    version = F.coalesce("scope_version", F.lit("")) if flush else F.col("scope_version")
    found = _first(metrics, {"s": F.col("scope_name"), "v": version, "n": F.col("metric_name")}, ["scope_name", "scope_version", "metric_name", "unit", "metric_type", "description"], ["payload_id", "r_pos", "s_pos", "m_pos"])
    return found.withColumnRenamed("metric_name", "name")


def table_rows(levels: dict[str, DataFrame], batch_time) -> dict[str, DataFrame]:
    """Rows of the three dimension tables as a flush stores them."""
    now = F.lit(batch_time).cast("timestamp")
    return {
        "resources": resource_dim(levels["resources"]).withColumns({"created_at": now, "updated_at": now}),
        "scopes": scope_dim(levels["scopes"], flush=True).withColumn("created_at", now),
        "metric_definitions": definition_dim(levels["metrics"], flush=True).withColumn("created_at", now),
    }


def dim_snapshot(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest row of each key over all flushes; minima combine on the map side, so a key in every flush is no hot one."""
    others = [c for c in rows.columns if c not in keys and c != "created_at"]
    picked = F.min_by(F.struct(*rows.columns), F.struct("created_at", *others)).alias("_first")
    return rows.groupBy(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys))).agg(picked).select("_first.*")
