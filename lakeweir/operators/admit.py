"""Admission: which payloads are read on, and why the others are not. The first rule that fails names the outcome.

Plain bodies stay in the JVM. Spark's parser is laxer than the rules, so a body is parsed inside a list, before a mark made from
its hash: if the list has the body and the mark and all types are right, the body is one JSON object and nothing else. Python
looks at the others only: gzip, other encodings, and bodies with tokens whose meaning Spark's parser loses (null, NaN, times
with a fraction or an exponent), which it passes on rewritten; and, after the parse, at bodies that were not read whole.
"""

from __future__ import annotations

import gzip
import io
import json
import zlib
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakeweir.functions.columns import malformed, nested_values
from lakeweir.schemas import KINDS, marked_schema

BODY_CAP, INFLATED_CAP = 10 << 20, 100 << 20

#: Outcomes in the order in which they are tried: status and error text. Fixed values.
TOO_LARGE = (413, "payload too large")
NO_GZIP = (400, "invalid gzip payload")
INFLATED_TOO_LARGE = (413, "decompressed payload too large")
NO_JSON = (400, "invalid JSON")
NO_RESOURCES = (400, "Missing resourceMetrics in OTLP payload")
EMPTY = (500, "Parse error: payload cannot be empty")
NO_RESOURCES_INSIDE = (500, "Parse error: missing resourceMetrics")
UNREADABLE = (500, "Parse error: unreadable structure or number")


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Tokens that Spark's parser reads otherwise than the rules do, or not at all, and the name that the parse uses itself.
_TOKENS = ("null", "NaN", "Infinity", "INF", "\x00", '"_d"')
#: The same as whole texts, which are read alike: a quote before or behind a token outside a text is no JSON to either.
_QUOTED = ('"NaN"', '"Infinity"', '"-Infinity"')
_TIMES = r'"timeUnixNano"\s*:\s*-?[0-9]+[.eE]'


class _Unreadable(ValueError):
    """A part that the format does not allow."""


def _listed(holder, name: str) -> list:
    """The objects listed under a name; none where it is missing. Other types are left to the parse."""
    if not isinstance(holder, dict) or name not in holder:
        return []
    found = holder[name]
    if found is None or isinstance(found, list) and any(x is None for x in found):
        raise _Unreadable(name)
    return found if isinstance(found, list) else []


def _no_null(holder, name: str):
    if isinstance(holder, dict) and holder.get(name, 0) is None:
        raise _Unreadable(name)
    return holder.get(name) if isinstance(holder, dict) else None


def _no_null_attributes(holder) -> None:
    for entry in _listed(holder, "attributes"):
        if isinstance(entry, dict) and entry.get("key"):
            _no_null(entry, "value")


def _whole_time(point) -> bool:
    """Gives a point's time in whole nanoseconds if it is a number with a fraction or an exponent: to the microsecond, half-even."""
    nanos = _no_null(point, "timeUnixNano")
    if not isinstance(nanos, float):
        return False
    try:
        point["timeUnixNano"] = (datetime.fromtimestamp(nanos / 1e9, timezone.utc) - _EPOCH) // timedelta(microseconds=1) * 1000
    except (ValueError, OverflowError, OSError):
        raise _Unreadable("timeUnixNano") from None
    return True


def _rewritten(document: dict, kinds: tuple[str, ...]) -> bool:
    """Raises where a null stands for a list or an object, and gives times in whole nanoseconds; whether there were others."""
    changed = False
    for resource in _listed(document, "resourceMetrics"):
        _no_null_attributes(_no_null(resource, "resource"))
        for scope in _listed(resource, "scopeMetrics"):
            _no_null(scope, "scope")
            for metric in _listed(scope, "metrics"):
                kind = next((k for k in kinds if isinstance(metric, dict) and k in metric), None)
                for point in _listed(None if kind is None else _no_null(metric, kind), "dataPoints"):
                    changed |= _whole_time(point)
                    _no_null_attributes(point)
    return changed


def _read(data: bytes) -> tuple[str, object]:
    """The text and what it says, as strict JSON with Python's numbers."""
    text = data.decode(json.detect_encoding(data))
    return text, json.loads(text)


def _shape(document) -> str | None:
    return None if isinstance(document, dict) and "resourceMetrics" in document else "no resources" if document else "empty"


def _opener(cap: int, kinds: tuple[str, ...]):
    """An Arrow function (body, gzip) -> the text to parse and the outcome that bars it, for bodies that are not plain."""
    kind = StructType([StructField("text", StringType()), StructField("outcome", StringType())])

    def inflate(body: bytes) -> bytes | str:
        try:
            with gzip.GzipFile(fileobj=io.BytesIO(body)) as stream:
                found = stream.read(cap + 1)
        except (OSError, EOFError, zlib.error):
            return "no gzip"
        return found if len(found) <= cap else "too large"

    def one(body: bytes | None, squeezed: bool | None) -> tuple:
        if body is None:
            return None, None
        found = inflate(body) if squeezed else body
        if isinstance(found, str):
            return None, found
        try:
            text, document = _read(found)
        except (ValueError, RecursionError):
            return None, "no json"
        if outcome := _shape(document):
            return None, outcome
        try:
            return json.dumps(document) if _rewritten(document, kinds) else text.removeprefix("\ufeff"), None
        except _Unreadable:
            return None, "unreadable"

    def opened(body: pa.Array, squeezed: pa.Array) -> pa.Array:
        rows = [one(*x) for x in zip(body.to_pylist(), squeezed.to_pylist(), strict=True)]
        return pa.array([{"text": t, "outcome": o} for t, o in rows], pa.struct([("text", pa.string()), ("outcome", pa.string())]))

    opened.__annotations__ = {"body": pa.Array, "squeezed": pa.Array, "return": pa.Array}
    return F.arrow_udf(opened, kind)


def _judge(text: pa.Array, nested: pa.Array) -> pa.Array:
    """The outcome of texts that were not read whole, and of attribute values that may be malformed; null is good."""

    def one(said: str | None, values: list | None) -> str | None:
        if said is not None:
            try:
                return _shape(json.loads(said)) or "unreadable"
            except (ValueError, RecursionError):
                return "no json"
        return "unreadable" if values and any(map(malformed, values)) else None

    return pa.array([one(*x) for x in zip(text.to_pylist(), nested.to_pylist(), strict=True)], pa.string())


_judged = F.arrow_udf(_judge, StringType())


def points_sql(metric: str, kinds: tuple[str, ...] = KINDS) -> str:
    """SQL for the data points of the first kind that a metric has; an empty array where that kind has none.

    Nested expressions are SQL text, as one call builds them, whereas each Column is a call to the JVM of its own.
    """
    return "CASE " + " ".join(f"WHEN {metric}.{k} IS NOT NULL THEN {metric}.{k}.dataPoints" for k in kinds) + " END"


def _bad_point(p: str) -> str:
    """SQL for whether a number of a point can't be read; times are whole numbers in the years 1 to 9999."""
    far = f"try_cast({p}.timeUnixNano AS decimal(38,0)) BETWEEN -62135596800000000000BD AND 253402300799999999999BD"
    late = f"coalesce({p}.timeUnixNano RLIKE r'^\\s*[+-]?[0-9]+\\s*$' AND {far}, false)"
    time = f"{p}.timeUnixNano IS NOT NULL AND try_cast({p}.timeUnixNano AS bigint) IS NULL AND NOT {late}"
    double = f"{p}.asDouble IS NOT NULL AND (try_cast({p}.asDouble AS double) IS NULL OR {p}.asDouble RLIKE r'[0-9.][dDfF]\\s*$|[xX]')"
    return f"({time}) OR ({double}) OR ({p}.asInt IS NOT NULL AND try_cast({p}.asInt AS bigint) IS NULL)"


def _nested(kinds: tuple[str, ...]) -> Column:
    """Raw texts of all attribute values of a payload that may be malformed."""
    points = f"transform({points_sql('m', kinds)}, p -> {nested_values('p.attributes')})"
    metrics = f"transform(s.metrics, m -> coalesce(flatten({points}), array()))"
    scopes = f"transform(r.scopeMetrics, s -> coalesce(flatten({metrics}), array()))"
    return F.expr(f"coalesce(flatten(transform(payload.resourceMetrics, r -> concat({nested_values('r.resource.attributes')}, coalesce(flatten({scopes}), array())))), array())")


def _bad_numbers(kinds: tuple[str, ...]) -> Column:
    metrics = f"exists(s.metrics, m -> coalesce(exists({points_sql('m', kinds)}, p -> {_bad_point('p')}), false))"
    return F.expr(f"coalesce(exists(payload.resourceMetrics, r -> coalesce(exists(r.scopeMetrics, s -> coalesce({metrics}, false)), false)), false)")


def _plain(text: Column, squeezed: Column) -> Column:
    """Whether Spark's parser reads a body as the rules do: no gzip, UTF-8, an object, and none of the tokens above."""
    odd = squeezed | ~F.startswith(F.ltrim(text, F.lit(" \t\r\n")), F.lit("{")) | ~F.is_valid_utf8(text) | text.rlike(_TIMES)
    bare = text
    for quoted in _QUOTED:
        bare = F.replace(bare, F.lit(quoted), F.lit('""'))
    for token in _TOKENS:
        odd = odd | F.contains(bare, F.lit(token))
    return F.coalesce(~odd, F.lit(False))


def admit(payloads: DataFrame, body_cap: int = BODY_CAP, inflated_cap: int = INFLATED_CAP, kinds: tuple[str, ...] = KINDS, need_resources: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """payload_id, payload (parsed), status and error of every payload, and the columns to carry; status 200 is admitted.

    Payloads may have gzip (default false) and length (default the body's): a source that leaves out the bodies that are too
    large gives their length. With ``need_resources`` off, the parser's own rule applies: an empty document is an error, and a
    missing resourceMetrics too. A payload with any unreadable part is rejected whole; no payload fails the job.
    """
    own = payloads if "gzip" in payloads.columns else payloads.withColumn("gzip", F.lit(False))
    body = F.col("body").cast("binary")
    size = F.coalesce("length", F.octet_length(body)) if "length" in own.columns else F.octet_length(body)
    large = F.coalesce(size > body_cap, F.lit(False))
    keep = ["payload_id", F.struct(*carry).alias("_carried") if carry else F.lit(None).alias("_carried")]
    rows = own.select(*keep, F.when(~large, body).alias("_body"), F.coalesce("gzip", F.lit(False)).alias("_gzip"), large.alias("_large"))
    text = F.col("_body").cast("string")
    rows = rows.withColumn("_plain", _plain(text, F.col("_gzip")))
    odd = ~F.col("_plain") & ~F.col("_large")
    rows = rows.withColumn("_open", _opener(inflated_cap, kinds)(F.when(odd, F.coalesce("_body", F.lit(b""))), F.when(odd, F.col("_gzip"))))
    rows = rows.withColumn("_text", F.when(F.col("_plain"), text).when(F.col("_open.outcome").isNull(), F.col("_open.text")))
    mark = F.xxhash64("_text").cast("string")
    listed = F.concat(F.lit('{"_d":['), "_text", F.lit(',{"_end":"'), mark, F.lit('"}]}'))
    parsed = F.from_json(listed, marked_schema(kinds), {"columnNameOfCorruptRecord": "_corrupt_record", "allowSingleQuotes": "false"})
    # through a generator, so that what reads the payload doesn't parse it again
    rows = rows.select("payload_id", "_carried", "_large", F.col("_open.outcome").alias("_outcome"), "_text", F.inline(F.array(F.struct(parsed.alias("_p"), mark.alias("_mark")))))
    whole = F.col("_p._corrupt_record").isNull() & (F.size("_p._d") == 2) & (F.get("_p._d", F.lit(1))["_end"] == F.col("_mark")) & F.get("_p._d", F.lit(0))["resourceMetrics"].isNotNull()
    rows = rows.select("payload_id", "_carried", "_large", "_outcome", "_text", F.coalesce(whole, F.lit(False)).alias("_whole"), F.struct(F.get("_p._d", F.lit(0))["resourceMetrics"].alias("resourceMetrics")).alias("payload"))
    judged = _judged(F.when(~F.col("_whole"), F.col("_text")), F.when(F.col("_whole"), _nested(kinds)))
    rows = rows.select("payload_id", "_carried", "_large", "_outcome", "payload", (F.col("_whole") & _bad_numbers(kinds)).alias("_unread"), judged.alias("_judged"))
    is_ = lambda name: (F.col("_outcome") == name) | (F.col("_judged") == name)
    missing = is_("no resources") | is_("empty")
    either = lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    rules: list[tuple[Column, tuple[int, str]]] = [(F.col("_large"), TOO_LARGE), (is_("no gzip"), NO_GZIP), (is_("too large"), INFLATED_TOO_LARGE), (is_("no json"), NO_JSON)]
    rules += [(missing, NO_RESOURCES)] if need_resources else [(is_("empty"), EMPTY), (missing, NO_RESOURCES_INSIDE)]
    rules.append((either(F.col("_unread"), is_("unreadable")), UNREADABLE))
    failed = F.lit(len(rules))
    for n in reversed(range(len(rules))):
        failed = F.when(F.coalesce(rules[n][0], F.lit(False)), n).otherwise(failed)
    # and again, so that a filter on the status is not moved below it
    rows = rows.select("payload_id", "_carried", F.inline(F.array(F.struct("payload", failed.alias("_failed")))))
    status, error = F.lit(200), F.lit(None).cast("string")
    for n, (_, (code, said)) in enumerate(rules):
        status, error = F.when(F.col("_failed") == n, code).otherwise(status), F.when(F.col("_failed") == n, said).otherwise(error)
    carried = [F.col(f"_carried.`{c}`").alias(c) for c in carry]
    return rows.select("payload_id", F.when(F.col("_failed") == len(rules), F.col("payload")).alias("payload"), status.alias("status"), error.alias("error"), *carried)
