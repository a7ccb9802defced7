"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes each stage's result as
Parquet in the folder that spark.checkpoint.dir names and reads it again.

Defined results: a null text is scored as empty, has no lines, is a copy of other texts without words, and is packed as the
end id alone; documents with a null or repeated id are documents each; extra columns, whatever their names, are kept by all
stages but the last; an empty table gives an empty one.
"""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lakeweir.llm import lines, packing, simhash, suffix, toxicity
from lakeweir.llm.common import read, with_ordinal
from lakeweir.sources.shared import new_folder

WORD_VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not call toxic."""
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return docs.filter(toxicity.scorer(*model)("text") < 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their site's boilerplate lines."""
    out = lines.drop_boilerplate(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, by doc_id (null last) and then text, of each group of near copies; rows that share a doc_id are documents each."""
    own = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    key = F.when((F.col("_ord") == 0) & F.col("doc_id").isNotNull(), F.col("doc_id").cast("bigint")).otherwise(F.xxhash64("doc_id", "_ord"))
    keyed = with_ordinal(own, "doc_id", "text").withColumn("_key", key)
    found = simhash.near_duplicates(keyed, id_col="_key").select(F.col("doc_id").alias("_key"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_ord", "_key")
    first = keyed.select("_key", "doc_id", "_ord").join(found, "_key").groupBy("component_id").agg(F.min(order)["_key"].alias("_key"))
    return keyed.join(first, "_key", "left_semi").select("_row.*")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document, or an earlier part of them, holds."""
    cut = suffix.remove_repeats(docs)
    text = _decoded(F.col("kept"))  # a cut may split a character
    columns = {c: F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c != "text"}
    columns |= {"text": text.alias("text"), "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return cut.select(*(columns[c] for c in docs.columns))


def _decode(kept: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.string())


_decoded = F.arrow_udf(_decode, StringType())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all that is left, in windows."""
    return packing.pack(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("suffix-array dedup", drop_repeats),
    ("packing", pack),
]

#: SQL can't express the stages (a fitted model, fingerprints, public tokenizers); tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = new_folder(spark, "corpus")
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{name}/{i}")
        docs = spark.read.parquet(f"{name}/{i}")
    return docs
