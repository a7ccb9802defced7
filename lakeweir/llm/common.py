"""What the operators share: reading, lineage cuts, row keys and byte-level helpers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweir.sources.shared import shared_folder

#: Bytes of text that one vectorised step holds at a time; a single longer text makes a longer step.
BLOCK_BYTES = 1_000_000
#: Rows and bytes that an Arrow batch holds at most, so that long texts stay within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose Arrow batches to Python are of bounded size from here on."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        df.sparkSession.conf.set(f"spark.sql.execution.arrow.{name}", most)
    return df


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow over batches of bounded size; a task gives its free memory back when it ends, as workers are reused."""
    bounded_batches(df)

    @functools.wraps(run)
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return df.mapInArrow(bounded, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that spark.checkpoint.dir names (own folder only where that is unset and all tasks run here)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def whole_id(df: DataFrame, name: str) -> Column:
    """The id column as bigint; components and order are by number, so other types are refused."""
    if not isinstance(df.schema[name].dataType, T.IntegralType):
        raise TypeError(f"{name} must be of an integer type, not {df.schema[name].dataType.simpleString()}")
    return df[name].cast("bigint")


#: Parts in which rows without a key are numbered.
NULL_PARTS = 256


def with_ordinal(df: DataFrame, key: str, tie: str, name: str = "_ord") -> DataFrame:
    """df with an ordinal that tells rows of an equal key apart, in the order of tie.

    Where no key repeats (the usual case, found from the key column alone) it is 0 and needs no shuffle of the rows. Rows
    without a key may be many: they are numbered in NULL_PARTS parts by a hash of tie, and in its order within those.
    """
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    if repeated.isEmpty():
        return df.withColumn(name, F.lit(0).cast("bigint"))
    part = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(tie), F.lit(NULL_PARTS))).otherwise(0)
    number = F.row_number().over(Window.partitionBy(key, part).orderBy(tie)) - 1
    return df.withColumn(name, F.when(F.col(key).isNull(), number.cast("bigint") * NULL_PARTS + part).otherwise(number))


def blocks(sizes: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about limit, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if len(sizes) > start:
        yield start, len(sizes)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: White space of the contracts: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n - 1, modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and the number of words of each row."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(data) else inside
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(data) else inside
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span, scrambled; equal bytes have equal hashes, but equal hashes prove nothing."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    back = powers(INVERSE, len(data) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first span of each group of equal spans, and the group of every span.

    Hashes only propose the groups; each span's bytes are compared with those of its group's first one, and spans that
    differ from it get groups of their own by their bytes.
    """
    _, first, group = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size, own = ends - starts, first[group]
    differs = size != size[own]
    other = np.flatnonzero((own != np.arange(len(own))) & ~differs & (size > 0))
    if len(other):
        done = np.cumsum(size[other]) - size[other]
        within = np.arange(done[-1] + size[other[-1]]) - np.repeat(done, size[other])
        unlike = data[np.repeat(starts[other], size[other]) + within] != data[np.repeat(starts[own[other]], size[other]) + within]
        if unlike.any():
            differs[other] = np.logical_or.reduceat(unlike, done)
    if differs.any():
        more, added = {}, []
        for i in np.flatnonzero(differs).tolist():
            value = data[starts[i] : ends[i]].tobytes()
            if value not in more:
                more[value] = len(first) + len(added)
                added.append(i)
            group[i] = more[value]
        first = np.append(first, added)
    return first, group
