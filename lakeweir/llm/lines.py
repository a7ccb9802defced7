"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a host when the share of the host's pages that hold it exceeds ``ratio`` and at least
``min_pages`` pages do; it is dropped from every page of that host. Two narrow passes over the text:

1. each page's distinct lines are counted by (host, 64-bit hash), combined on the map side before the shuffle, so a hot
   host or line sends one row a task; a host's candidates number at most its mean lines a page / ratio;
2. the candidates' exact text is counted again, so that a hash collision decides nothing.

The result is one short list of lines a host. It is broadcast only if its measured size allows; else pages are dealt by
(host, salt) against salted copies of the lists, so that a host with a third of all pages is spread.

Defined results: a null text stays null with no lines; blank lines are never counted nor dropped; a null host is a host
of its own; repeated rows are pages each; a very long text is one page; an empty table gives an empty result. Extra columns,
whatever their names, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweir.llm.common import checkpointed

RATIO, MIN_PAGES = 0.10, 5
BROADCAST_BYTES, SALTS = 32 << 20, 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _worded(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")) != ""


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """_host and _bad (its boilerplate lines), for hosts that have any."""
    base = pages.select(F.coalesce(pages[host].cast("string"), F.lit("")).alias("_host"), pages[host].isNull().alias("_none"), pages[text].alias("_text"))
    totals = base.groupBy("_host", "_none").agg(F.count(F.lit(1)).alias("_pages"))
    each = base.select("_host", "_none", F.explode(F.array_distinct(_lines(F.col("_text")))).alias("_line")).filter(_worded(F.col("_line")))
    often = (F.col("_n") >= min_pages) & (F.col("_n") > F.lit(ratio) * F.col("_pages"))
    hashed = each.groupBy("_host", "_none", F.xxhash64("_line").alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    likely = checkpointed(hashed.filter(F.col("_n") >= min_pages).join(totals, ["_host", "_none"]).filter(often).select("_host", "_none", "_hash", "_pages"))
    exact = each.withColumn("_hash", F.xxhash64("_line")).join(_sized(likely), ["_host", "_none", "_hash"]).groupBy("_host", "_none", "_line").agg(F.count(F.lit(1)).alias("_n"), F.first("_pages").alias("_pages"))
    return checkpointed(exact.filter(often).groupBy("_host", "_none").agg(F.collect_list("_line").alias("_bad")))


def _bytes(df: DataFrame) -> int:
    """Bytes of a checkpointed table's strings and rows, summed by Spark."""
    size = sum((F.coalesce(F.octet_length(F.concat_ws("", c)), F.lit(0)) if t in ("string", "array<string>") else F.lit(8) for c, t in df.dtypes), F.lit(32))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _bytes(df) <= BROADCAST_BYTES else df


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = True) -> DataFrame:
    """pages with the host's boilerplate lines removed from text, plus _n_lines and _n_dropped if counts are asked for (with more underscores where pages has such columns)."""
    bad = boilerplate(pages, host, text, ratio, min_pages).withColumnsRenamed({"_host": "_bad_host", "_none": "_bad_none"})
    # the row in one column, so that no name of its own can clash with those used here
    own = pages.select(F.struct(*(pages[c] for c in pages.columns if c != text)).alias("_row"), pages[text].alias("_text"), F.coalesce(pages[host].cast("string"), F.lit("")).alias("_host"), pages[host].isNull().alias("_none"))
    on = (F.col("_host") == F.col("_bad_host")) & (F.col("_none") == F.col("_bad_none"))
    if _bytes(bad) <= BROADCAST_BYTES:
        joined = own.join(F.broadcast(bad), on, "left")
    else:
        salted = bad.withColumn("_bad_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("_salt", F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int")).join(salted, on & (F.col("_salt") == F.col("_bad_salt")), "left")
    lines = _lines(F.col("_text"))
    held = F.col("_bad").isNotNull() & F.col("_text").isNotNull()
    joined = joined.withColumn("_kept", F.when(held, F.filter(lines, lambda x: ~F.array_contains(F.col("_bad"), x))))
    out = [F.when(held, F.array_join("_kept", "\n")).otherwise(F.col("_text")).alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in pages.columns]
    if counts:
        n_lines, n_dropped = (_free(name, pages.columns) for name in ("_n_lines", "_n_dropped"))
        out.append(F.when(F.col("_text").isNull(), 0).otherwise(F.coalesce(F.size(F.filter(lines, _worded)), F.lit(0))).cast("long").alias(n_lines))
        out.append(F.when(held, F.size(lines) - F.size("_kept")).otherwise(0).cast("long").alias(n_dropped))
    return joined.select(*out)


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name


#: The same over ``documents`` in DuckDB SQL, with the defaults.
LINES_SQL = f"""
WITH pages AS (SELECT *, row_number() OVER () AS _r, coalesce(CAST({{host}} AS VARCHAR), '') AS _host, {{host}} IS NULL AS _none FROM {{table}}),
totals AS (SELECT _host, _none, count(*) AS _pages FROM pages GROUP BY ALL),
cut AS (SELECT _r, _host, _none, unnest(string_split({{text}}, chr(10))) AS _line, generate_subscripts(string_split({{text}}, chr(10)), 1) AS _at FROM pages WHERE {{text}} IS NOT NULL),
worded AS (SELECT *, trim(translate(_line, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> '' AS _w FROM cut),
seen AS (SELECT _host, _none, _line, count(DISTINCT _r) AS _n FROM worded WHERE _w GROUP BY ALL),
bad AS (SELECT s._host, s._none, s._line FROM seen s JOIN totals t ON s._host = t._host AND s._none = t._none WHERE _n >= {MIN_PAGES} AND _n > {RATIO} * _pages),
marked AS (SELECT w.*, b._line IS NOT NULL AS _out FROM worded w LEFT JOIN bad b ON w._host = b._host AND w._none = b._none AND w._line = b._line),
text_of AS (SELECT _r, coalesce(string_agg(_line, chr(10) ORDER BY _at) FILTER (NOT _out), '') AS _kept, count(*) FILTER (_w) AS _n_lines, count(*) FILTER (_out) AS _n_dropped FROM marked GROUP BY _r)
"""
