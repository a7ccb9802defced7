r"""Mixing sources to target weights, in DataFrame functions only.

Sources, in code-point order with null last, take WEIGHTS in turn and share the size of the whole table (words of all texts)
by weight; a target stops at MOST times its source's size, and what is above goes to the others by weight. A source's
repetition rate is target / size. Each document is taken floor(rate) times, and once more with the rate's fraction as
probability: a Bernoulli draw from a hash of seed, id, source and text, so reruns agree on any partitioning.

Targets need no loop: with sources in order of MOST * size / weight, those that stop come first, and the share of a unit of
weight is the largest of (all - what the first k may take) / (weight of the others) over all k.

At scale: documents are only aggregated by source, combined on the map side, so a hot source sends one row a task. The
targets have one row a source; that row goes through one task, as a rank over all sources must. They are broadcast only
below a measured size, else dealt to (source, salt).

Defined results: a null text has size 0 and is taken like any other; a null source is a source of its own; a source without
words has target 0 and no copies; rows equal in id, source and text are numbered, whatever task they are in, and drawn
apart; an empty table gives an empty result. Extra columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweir.llm.common import checkpointed
from lakeweir.llm.lines import BROADCAST_BYTES, _bytes, _free

WEIGHTS, MOST, SALTS = (5, 2, 1), 3, 64
_WORD, _BLANKS = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Number of words of a text; one letter a word is held, not the words."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, _WORD, "x"), _BLANKS, "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """_source, _none, _source_size -> and _target, for one row a source."""
    rank = F.row_number().over(Window.orderBy("_none", "_source")) - 1
    ranked = sizes.withColumn("_rank", rank).withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_limit", F.col("_source_size") * most)
    order = Window.orderBy(F.col("_limit").cast("double") / F.col("_weight"), "_rank")
    before = F.coalesce(F.sum("_limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("_weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = ranked.withColumn("_unit", (F.sum("_source_size").over(everything) - before).cast("double") / others)
    share = F.col("_weight") * F.max("_unit").over(everything)
    return cut.select("_source", "_none", "_source_size", F.least(F.col("_limit").cast("double"), share).alias("_target"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with _nth, the number of each among the rows of its _key: 0 where no id repeats, which the ids alone show.

    Equal rows can stand for each other, so they are numbered within salts first and then behind the smaller salts. Salts go
    by place, which may differ from one reading to the next, so rows are checkpointed with them.
    """
    if rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        return rows.withColumn("_nth", F.lit(0).cast("long"))
    salted = checkpointed(rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))))
    held = salted.groupBy("_key", "_salt").agg(F.count(F.lit(1)).alias("_held"))
    first = held.select("_key", "_salt", F.coalesce(F.sum("_held").over(Window.partitionBy("_key").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    within = salted.withColumn("_at", F.row_number().over(Window.partitionBy("_key", "_salt").orderBy(F.lit(0))) - 1)
    return within.join(first, ["_key", "_salt"]).withColumn("_nth", F.col("_first") + F.col("_at")).drop("_salt", "_at", "_first")


def with_copies(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """docs with _size, _source_size, _target (of its source) and _copies (more underscores where docs has such columns)."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c, F.lit("-")) for c in (docs[id_col].cast("string"), docs[source].cast("string"), F.md5(docs[text].cast("binary"))))))
    # the row in one column, so that no name of its own can clash with those used here
    rows = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs[id_col].alias("_id"), key.alias("_key"), words(docs[text]).alias("_size"),
        F.coalesce(docs[source].cast("string"), F.lit("")).alias("_source"), docs[source].isNull().alias("_none"),
    )
    sizes = rows.groupBy("_source", "_none").agg(F.sum("_size").alias("_source_size"))
    aims = checkpointed(targets(sizes, weights, most)).withColumnsRenamed({"_source": "_s", "_none": "_sn"})
    on = (F.col("_source") == F.col("_s")) & (F.col("_none") == F.col("_sn"))
    numbered = _numbered(rows)
    if _bytes(aims) <= BROADCAST_BYTES:
        joined = numbered.join(F.broadcast(aims), on)
    else:
        salted = aims.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = numbered.withColumn("_own", F.pmod(F.xxhash64("_key", "_nth"), F.lit(SALTS)).cast("int")).join(salted, on & (F.col("_own") == F.col("_part")))
    rate = F.when(F.col("_source_size") > 0, F.least(F.lit(float(most)), F.col("_target") / F.col("_source_size"))).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", "_key", F.col("_nth").cast("string"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    copies = (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("long")
    made = {"_size": F.col("_size"), "_source_size": F.col("_source_size"), "_target": F.col("_target"), "_copies": copies}
    return joined.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns), *(c.alias(_free(n, docs.columns)) for n, c in made.items()))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    copies = _free("_copies", docs.columns)
    taken = with_copies(docs, **how)
    own = taken.select(F.struct(*(taken[c] for c in docs.columns)).alias("_row"), F.explode(F.array_repeat(F.lit(0), taken[copies].cast("int"))))
    return own.select("_row.*")


#: The result per document over ``documents`` in DuckDB SQL, with the defaults; ids are taken as unique.
MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(source, '-') || '|' || coalesce(md5(text), '-')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, {list(WEIGHTS)}[r % {len(WEIGHTS)} + 1] AS weight, {MOST} * source_size AS most FROM s),
u AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / sum(weight) OVER (ORDER BY CAST(most AS DOUBLE) / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM w),
t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), weight * max(unit) OVER ()) AS target FROM u),
j AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least({MOST}.0, t.target / t.source_size) ELSE 0.0 END AS rate,
  CAST('0x' || substr(md5(k || '|0'), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM j
"""
