"""The commit log of a lake: which batches and compacted files count.

A commit is one small file of JSON lines, ``_commits/<version>.json``, made only if no other writer made that version first:
what a job wrote before it is seen by no scan, and a job that dies leaves nothing but files to vacuum. The loser of a race
looks at what was committed meanwhile and either takes the next version or, where that clashes with its own work, gives up.

Entries are of four kinds:

* ``batch``: an ingest batch and the token under which its rows are stored in all four tables. Of a batch's tokens only the
  last counts, in hour files and in compacted ones, so a batch that is played again replaces itself whatever has happened to
  its files since.
* ``target`` and ``source``: files that a compaction made, and those that it replaced.
* ``flushed``: the last micro-batch of a stream (its token) whose pending payloads are in a committed batch.
* ``snapshot``: the stored snapshot of a dimension table (its token), and the version up to which it holds batches.

Every EVERY commits the state is written as a Parquet checkpoint, and a scan reads the last one and the commits after it.
The files of commits before the last checkpoint but one are deleted, so a scan that was planned so long ago has to be planned again.

The put is a hard link in a local file system and a rename elsewhere, as HDFS doesn't rename onto a file. A store whose renames
replace files needs one committer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = 50
FOLDER = "_commits"
#: Marks a token that counts only if a commit names it; batches without it are of lakes that have no log.
MARK = "@"
_COLUMNS = "kind STRING, batch STRING, token STRING, reason STRING, rows BIGINT, path STRING, upto BIGINT"
SCHEMA = f"version BIGINT, {_COLUMNS}"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in any file system that Spark reaches."""
    where, files = _at(spark, path)
    return files.exists(where)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as files on disk have it; None in other file systems."""
    where, files = _at(spark, path)
    return files.makeQualified(where).toUri().getPath() if files.getUri().getScheme() == "file" else None


def delete_path(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder; False if that fails, as nothing reads what is left behind."""
    where, files = _at(spark, path)
    try:
        return files.delete(where, True)
    except Exception:
        return False


def new_token(batch: str) -> str:
    return f"{batch}{MARK}{uuid.uuid4().hex}"


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with its whole text at once; False where it exists, which stays as it is."""
    folder, name = path.rsplit("/", 1)
    held = f"{folder}/.{name}.{uuid.uuid4().hex}"
    source, files = _at(spark, held)
    stream = files.create(source, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        target = _at(spark, path)[0]
        if files.getUri().getScheme() != "file":
            return not files.exists(target) and files.rename(source, target)
        local = [spark._jvm.java.io.File(files.makeQualified(p).toUri().getPath()).toPath() for p in (target, source)]
        try:
            spark._jvm.java.nio.file.Files.createLink(*local)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception.toString()):
                return False
            raise
        return True
    finally:
        files.delete(source, False)


def _listed(spark: SparkSession, base: str) -> tuple[list[int], list[int]]:
    """Versions of the checkpoints and of the commits that are there; as checkpoints replace commits, these are few."""
    where, files = _at(spark, f"{base}/{FOLDER}")
    if not files.exists(where):
        return [], []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    whole = [int(n[11:]) for n in names if n.startswith("checkpoint-")]
    whole = [v for v in whole if exists(spark, f"{base}/{FOLDER}/checkpoint-{v:020d}/_SUCCESS")]
    return sorted(whole), sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def latest(spark: SparkSession, base: str) -> int:
    """The last version; 0 before the first commit."""
    whole, single = _listed(spark, base)
    return max([0, *whole[-1:], *single[-1:]])


def _single(spark: SparkSession, base: str, versions: list[int]) -> DataFrame:
    rows = spark.read.schema(_COLUMNS).json([f"{base}/{FOLDER}/{v:020d}.json" for v in versions])
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("bigint").alias("version"), *rows.columns)


def entries(spark: SparkSession, base: str, after: int | None = None) -> DataFrame:
    """The log's entries with their versions: the state, or only what was committed after a version."""
    whole, single = _listed(spark, base)
    parts, start = [], after
    if after is None:
        start = whole[-1] if whole else 0
        if whole:
            parts.append(spark.read.schema(SCHEMA).parquet(f"{base}/{FOLDER}/checkpoint-{start:020d}"))
    if newer := [v for v in single if v > start]:
        parts.append(_single(spark, base, newer))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def commit(spark: SparkSession, base: str, rows: list[dict], clashes: Callable[[DataFrame], bool] | None = None, since: int = 0) -> int | None:
    """Commits entries as the next version and returns it; None if what was committed after ``since`` clashes with them."""
    text = "".join(json.dumps(row) + "\n" for row in rows)
    while True:
        last = latest(spark, base)
        if clashes is not None and last > since and clashes(entries(spark, base, after=since)):
            return None
        if put_if_absent(spark, f"{base}/{FOLDER}/{last + 1:020d}.json", text):
            break
    if (last + 1) % EVERY == 0:
        checkpoint(spark, base)
    return last + 1


def live(log: DataFrame) -> DataFrame:
    """batch, token, version, reason and rows of every committed batch; its last token counts."""
    own = log.filter("kind = 'batch'")
    return own.groupBy("batch").agg(F.max_by(F.struct("token", "version", "reason", "rows"), "version").alias("_x")).select("batch", "_x.*")


def replaced(log: DataFrame) -> DataFrame:
    """token and version of batches that were played again, and by, the version of the last replay."""
    last = live(log).select("batch", F.col("token").alias("_last"), F.col("version").alias("by"))
    return log.filter("kind = 'batch'").join(last, "batch").filter("token <> _last").select("token", "version", "by")


def sources(log: DataFrame) -> DataFrame:
    return log.filter("kind = 'source'").select("path").distinct()


def targets(log: DataFrame) -> DataFrame:
    """Compacted files that stand."""
    return log.filter("kind = 'target'").select("path").distinct().join(sources(log), "path", "left_anti")


def _state(log: DataFrame, present: DataFrame | None) -> DataFrame:
    """The entries that still matter. A replaced compacted file is neither target nor source any more; nor is a source, if it is not among the files present."""
    last = log.filter("kind IN ('flushed', 'snapshot')").groupBy("kind", "token").agg(F.max_by(F.struct(*log.columns), "version").alias("_x")).select("_x.*")
    again = log.filter("kind = 'target'").select("path").join(sources(log), "path", "left_semi").distinct()
    files = log.filter("kind IN ('source', 'target')").join(again, "path", "left_anti")
    if present is not None:
        files = files.filter("kind = 'target'").unionByName(files.filter("kind = 'source'").join(present, "path", "left_semi"))
    return log.filter("kind = 'batch'").unionByName(last).unionByName(files).select(log.columns)


def checkpoint(spark: SparkSession, base: str, present: DataFrame | None = None) -> int:
    """Writes the state as of the last version, and deletes what the checkpoint before this one made needless."""
    version, before = latest(spark, base), _listed(spark, base)[0]
    if version == 0 or version in before:
        return version
    state = _state(entries(spark, base).filter(F.col("version") <= version), present)
    state.coalesce(1).write.mode("ignore").parquet(f"{base}/{FOLDER}/checkpoint-{version:020d}")
    if before:
        for old in _listed(spark, base)[1]:
            if old <= before[-1]:
                delete_path(spark, f"{base}/{FOLDER}/{old:020d}.json")
        for old in before[:-1]:
            delete_path(spark, f"{base}/{FOLDER}/checkpoint-{old:020d}")
    return version
