"""Column expressions of the ingest jobs."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: An attribute value's tags, in the order in which they are looked for: scalars, then those that hold values. Fixed values.
SCALAR_TAGS, LIST_TAG, MAP_TAG = ("stringValue", "intValue", "doubleValue", "boolValue", "bytesValue"), "arrayValue", "kvlistValue"


class Malformed(ValueError):
    """An attribute value that the format does not allow."""


def _members(holder) -> list:
    """The values of an array or a list of pairs; none where the field is missing."""
    if not isinstance(holder, dict) or not isinstance(found := holder.get("values", []), list):
        raise Malformed(holder)
    return found


def _unwrapped(value):
    """What a tagged value holds. Text, lists and untagged objects stand for themselves; numbers, booleans and null can't."""
    if isinstance(value, (str, list)):
        return value
    if not isinstance(value, dict):
        raise Malformed(value)
    for tag in SCALAR_TAGS:
        if tag in value:
            return value[tag]
    if LIST_TAG in value:
        return list(map(_unwrapped, _members(value[LIST_TAG])))
    if MAP_TAG not in value:
        return value
    out = {}
    for pair in _members(value[MAP_TAG]):
        if not isinstance(pair, dict) or not {"key", "value"} <= pair.keys() or isinstance(pair["key"], (dict, list)):
            raise Malformed(pair)
        name = pair["key"] if isinstance(pair["key"], str) else json.dumps(pair["key"])
        out[name] = _unwrapped(pair["value"])
    return out


def _read(text: str | None):
    """The value that an attribute's raw text stands for; a missing one is an empty object."""
    if text is None:
        return {}
    try:
        value = json.loads(text)
    except ValueError:
        value = text  # text came without its quotes
    return _unwrapped(value)


def _bag_text(entries: list | None, ordered: bool) -> str | None:
    """JSON text of an attribute list; None if a value of it is malformed."""
    out: dict = {}
    try:
        for entry in entries or ():
            if entry and entry["key"]:
                out[entry["key"]] = _read(entry["value"])
    except Malformed:
        return None
    return json.dumps(out, sort_keys=ordered)


def _both_texts(attributes: pa.Array) -> pa.Array:
    held = [None if x is None else (_bag_text(x, False), _bag_text(x, True)) for x in attributes.to_pylist()]
    return pa.array([None if x is None else {"stored": x[0], "hashed": x[1]} for x in held], pa.struct([("stored", pa.string()), ("hashed", pa.string())]))


def malformed(text: str | None) -> bool:
    """Whether an attribute's raw text is a value that the format does not allow."""
    try:
        _read(text)
    except Malformed:
        return True
    return False


_texts = F.arrow_udf(_both_texts, StructType([StructField("stored", StringType()), StructField("hashed", StringType())]))

_LIST = "array<struct<key:string,value:string>>"


def nested_values(attributes: str) -> str:
    """SQL for the raw texts of an attribute list's values that are no plain scalar, so that they may be malformed."""
    plain = " OR ".join(f"startswith(e.value, '{{\"{tag}\"')" for tag in SCALAR_TAGS)
    return f"transform(filter(coalesce({attributes}, array()), e -> coalesce(e.key, '') <> '' AND NOT coalesce({plain}, true)), e -> e.value)"


#: A plain ASCII string or an integer, whose JSON text needs no Python, and a key that needs no escape.
_PLAIN, _KEY = r'^\{"(?:stringValue":"[ !#-\[\]-~]*"|intValue":(?:"-?[0-9]{1,18}"|-?[0-9]{1,18}))\}$', r"^[ !#-\[\]-~]*$"


def with_attribute_texts(rows: DataFrame, attributes: str, **kinds: str) -> DataFrame:
    """rows with columns, given as stored=<name> and hashed=<name>: JSON text of an attribute list (named by SQL), in its order and
    with keys sorted; null if a value is malformed.

    The last value of a key wins at the first one's place. Lists of plain strings and integers stay in the JVM; others go
    through Arrow. The plain pairs are a column of their own, so that they are made once for all that reads them. Needs
    spark.sql.mapKeyDedupPolicy=LAST_WIN.
    """
    listed = f"coalesce({attributes}, array())"
    plain = f"forall({listed}, e -> coalesce(e.key RLIKE r'{_KEY}' AND e.value RLIKE r'{_PLAIN}', false))"
    value = "substr(e.value, instr(e.value, ':') + 1, length(e.value) - instr(e.value, ':') - 1)"
    pairs = f"map_from_entries(transform(filter({listed}, e -> coalesce(e.key, '') <> ''), e -> struct(e.key AS key, {value} AS value)))"
    held = rows.withColumn("_pairs", F.expr(f"CASE WHEN {plain} THEN {pairs} END"))
    odd = _texts(F.expr(f"CASE WHEN _pairs IS NULL THEN {listed} END").cast(_LIST))
    of = {"stored": "map_entries(_pairs)", "hashed": "sort_array(map_entries(_pairs))"}
    text = lambda kind: F.expr(f"concat('{{', array_join(transform({of[kind]}, e -> concat('\"', e.key, '\": ', e.value)), ', '), '}}')")
    return held.withColumns({name: F.coalesce(text(kind), odd[kind]) for kind, name in kinds.items()}).drop("_pairs")


def nanos_to_timestamp(nanos: Column) -> Column:
    """Nanoseconds (number or numeric text; missing: the epoch) to a timestamp, rounded half-even to microseconds."""
    seconds = F.coalesce(nanos.try_cast("decimal(38,0)"), F.lit(0)).cast("double") / F.lit(1e9)
    whole = F.floor(seconds)
    return F.timestamp_micros((whole * 1_000_000 + F.rint((seconds - whole) * F.lit(1e6))).cast("bigint"))


def finite(value: Column) -> Column:
    """The value as a double; null for NaN and both infinities."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def partition_columns(timestamp: Column) -> dict[str, Column]:
    """Zero-padded text of the event time's year, month, day and hour."""
    return {name: F.date_format(timestamp, form) for name, form in (("year", "yyyy"), ("month", "MM"), ("day", "dd"), ("hour", "HH"))}
