r"""Ranked lexical search: the k best documents of each item, by presence masks.

Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. With N documents that have a term, L terms
in all, df documents that hold a term, and n and tf of one document, a term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))),
m = 75 + (25 * n * N) div L, and a document scores the sum over the item's terms, repeats included, of
w * ((10^9 * tf) div (1000 * tf + 12 * m)), in 64-bit integers.

1. Every task cuts its documents into segments of at most SEGMENT documents: their term counts, and for the items' terms the
   places and frequencies, term by term. Segments are checkpointed; N, L and df are sums over them (one row a term).
2. For an item, a segment's bitmaps of the terms (a bit a document) are turned into one mask a document of the terms present,
   and documents are grouped by mask. A mask's maximum score adds up the largest contributions that its terms have in the
   segment. Masks are evaluated by descending maximum until it falls below the k-th best score that the task has seen for
   the item; equal maxima are still evaluated, as ids decide ties.
3. A task gives its k best an item; those are ranked within salts, then within the item, so no task ranks more than k rows of
   each salt, or of each task that came before it.

Items are taken in blocks of ITEM_BYTES of text, each against all documents; a block is what goes to tasks, so its size is
bounded whatever the number of items (a single larger item is a block alone).

Defined results: a null text has no terms; an item without terms, or whose terms all weigh 0, has no rows; repeated documents
are ranked each, repeated items answered each; a null id ranks behind others of its score; empty tables give an empty result.
Long texts are cut into slices between terms. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweir.llm.common import checkpointed, map_batches, utf8, whole_id

SEGMENT, HITS, SLICE, SALTS = 4_096, 2_000_000, 1 << 20, 64
ITEM_BYTES = 8 << 20
BEST = 20
_TERM, _GAP = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_SEGMENT = "ids array<bigint>, lengths array<bigint>, terms array<int>, dfs array<int>, at array<int>, tfs array<int>, n_docs bigint, n_terms bigint"


def term_counts(text: bytes) -> Counter:
    """Each term of a text and how often it occurs."""
    found: Counter = Counter()
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + SLICE)
        end = gap.start() if gap else len(text)
        found.update(_TERM.findall(text[start:end].lower()))
        start = end
    return found


def _indexer(vocabulary: dict[bytes, int], most: int):
    """Arrow batches of (id, text) to segments of at most so many documents."""

    def segment(ids: list, lengths: list, sizes: list, terms: list, tfs: list) -> pa.RecordBatch:
        at, term, tf = np.repeat(np.arange(len(ids)), sizes), np.array(terms, np.int32), np.array(tfs, np.int32)
        order = np.lexsort((at, term))
        own, dfs = np.unique(term, return_counts=True)
        lists = [pa.array([x]) for x in (ids, lengths)] if any(x is not None for x in ids) else [pa.array([ids], pa.list_(pa.int64())), pa.array([lengths])]
        lists += [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (own, dfs, at[order], tf[order])]
        return pa.RecordBatch.from_arrays([*lists, pa.array([len(ids)]), pa.array([sum(lengths)])], names=["ids", "lengths", "terms", "dfs", "at", "tfs", "n_docs", "n_terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            whole = data.tobytes()
            for i, key in enumerate(batch.column(0).to_pylist()):
                counts = term_counts(whole[offsets[i] : offsets[i + 1]])
                if not counts:
                    continue
                mine = counts.keys() & vocabulary.keys()
                for values, value in zip(held[:3], (key, counts.total(), len(mine)), strict=True):
                    values.append(value)
                held[3].extend(vocabulary[t] for t in mine)
                held[4].extend(counts[t] for t in mine)
                if len(held[0]) >= most or len(held[3]) >= HITS:
                    yield segment(*held)
                    held = ([], [], [], [], [])
        if held[0]:
            yield segment(*held)

    return run


def masks(planes: np.ndarray, n: int) -> np.ndarray:
    """For n documents, the terms present as rows of 64-bit words; planes has a bitmap of the documents for each term."""
    wide = -(-len(planes) // 64) * 8
    across = np.zeros((wide, n), np.uint8)
    packed = np.packbits(np.unpackbits(planes, axis=1, count=n), axis=0, bitorder="little")
    across[: len(packed)] = packed
    return np.ascontiguousarray(across.T).view(np.uint64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of keys and the number of each row's group."""
    if keys.shape[1] == 1:
        found, group = np.unique(keys[:, 0], return_inverse=True)
        return found[:, None], group
    found, group = np.unique(keys, axis=0, return_inverse=True)
    return found, group.reshape(-1)


class Best:
    """The k best (score, id) seen so far; equal scores by ascending id, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """The score below which nothing can enter; 1 while there is room, as scores are above 0."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.least)
        if len(good) > self.k:
            cut = np.partition(scores[good], -self.k)[-self.k]
            good = good[scores[good] >= cut]
            good = good[np.lexsort((ids[good], null[good], -scores[good]))[: self.k]]
        self.rows = sorted(self.rows + [(-int(scores[i]), bool(null[i]), int(ids[i])) for i in good])[: self.k]


def _searcher(queries: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int):
    """Segments to each query's best documents; a query is its key, its terms in order and what each weighs in all."""

    def search(row: dict, best: dict[int, Best]) -> None:
        null = np.array([x is None for x in row["ids"]])
        ids = np.array([0 if x is None else x for x in row["ids"]], np.int64)
        n, terms = len(ids), np.array(row["terms"], np.int32)
        at, tf = np.array(row["at"], np.int64), np.array(row["tfs"], np.int64)
        size = 75 + (25 * np.array(row["lengths"], np.int64) * n_docs) // n_terms
        gain = (1_000_000_000 * tf) // (1000 * tf + 12 * size[at])
        ends = np.cumsum(row["dfs"], dtype=np.int64)
        starts = ends - np.array(row["dfs"], np.int64)
        if not len(terms):
            return
        most = np.maximum.reduceat(gain, starts)
        dense = np.zeros((len(terms), n), bool)
        dense[np.repeat(np.arange(len(terms)), row["dfs"]), at] = True
        bitmaps = np.packbits(dense, axis=1)
        del dense
        for key, own, weight in queries:
            where = np.searchsorted(terms, own)
            there = (where < len(terms)) & (terms[np.minimum(where, len(terms) - 1)] == own)
            where, weight = where[there], weight[there]
            if not len(where):
                continue
            planes = bitmaps[where]
            present = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(planes, axis=0), count=n))
            found, group = grouped(masks(planes, n)[present])
            holds = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little", count=len(where)).astype(np.int64)
            bound = holds @ (weight * most[where])
            order = np.argsort(-bound, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            turn = np.full(n, len(order), np.int64)
            turn[present] = place[group]  # the mask's place among those to be evaluated, of every document
            hits = np.concatenate([np.arange(starts[t], ends[t]) for t in where])
            value = np.repeat(weight, ends[where] - starts[where]) * gain[hits]
            done, step = 0, 16
            while done < len(order) and bound[order[done]] >= best[key].least:
                until = min(len(order), done + step)
                chosen = (turn[at[hits]] >= done) & (turn[at[hits]] < until)
                scores = np.zeros(n, np.int64)
                np.add.at(scores, at[hits[chosen]], value[chosen])
                docs = np.flatnonzero((turn >= done) & (turn < until))
                best[key].add(scores[docs], ids[docs], null[docs])
                done, step = until, step * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {key: Best(k) for key, _, _ in queries}
        for batch in batches:
            for i in range(batch.num_rows):
                search(batch.slice(i, 1).to_pylist()[0], best)
        rows = [(key, None if null else doc, -score) for key, held in best.items() for score, null, doc in held.rows]
        keys, docs, scores = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], names=["key", "doc", "score"])

    return run


def _block(docs: DataFrame, items: list, item_type: str, k: int, most: int) -> DataFrame:
    """Ranks for a bounded block of items: (item, text) rows that the driver holds."""
    spark = docs.sparkSession
    counts = [term_counts((text or "").encode()) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    segments = checkpointed(map_batches(docs, _indexer(vocabulary, most), _SEGMENT))
    n_docs, n_terms = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("_x")).groupBy("_x.terms").agg(F.sum("_x.dfs").alias("df")).collect()  # one row a term of the block
    weight = {r.terms: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))) for r in held}
    queries = []
    for key, own in enumerate(counts):
        pairs = sorted((vocabulary[t], times * weight.get(vocabulary[t], 0)) for t, times in own.items())
        pairs = [p for p in pairs if p[1] > 0]
        if pairs:
            queries.append((key, np.array([p[0] for p in pairs], np.int32), np.array([p[1] for p in pairs], np.int64)))
    found = map_batches(segments, _searcher(queries, n_docs, n_terms, k), "key int, doc bigint, score bigint")
    order = (F.col("score").desc(), F.col("doc").asc_nulls_last())
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS))
    near = found.withColumn("_n", F.row_number().over(Window.partitionBy("key", salt).orderBy(*order))).filter(F.col("_n") <= k)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(key, item) for key, (item, _) in enumerate(items)], f"key int, item {item_type}")
    return last.join(F.broadcast(names), "key").select("item", F.col("rank").cast("int").alias("rank"), "doc", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = BEST, segment: int = SEGMENT) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item with a score above 0."""
    own = docs.select(whole_id(docs, id_col).alias("_id"), docs[text].alias("_text"))
    asked = items.select(items[item_id].alias("_item"), items[item_text].alias("_text"))
    kind = asked.schema["_item"].dataType.simpleString()
    size = asked.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    parts = max(1, -(-2 * size // ITEM_BYTES)) if size > ITEM_BYTES else 1
    block = F.pmod(F.xxhash64("_item", "_text"), F.lit(parts))
    out = None
    for part in range(parts):
        rows = [(r._item, r._text) for r in asked.filter(block == part).collect()]  # ITEM_BYTES or so, whatever the number of items
        found = _block(own, rows, kind, k, segment)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(id_col), "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The result over ``documents`` and ``benchmark`` in DuckDB SQL, with the defaults.
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS terms FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS terms FROM benchmark),
asked AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(terms) AS term FROM q) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
g AS (SELECT a.i, a.item_id, d.doc_id, d.r, CAST(sum(a.times * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (75 + (25 * len(d.terms) * s.n_docs) // s.n_terms)))) AS BIGINT) AS score
  FROM asked a JOIN w ON a.term = w.term JOIN f ON a.term = f.term JOIN d ON f.r = d.r, s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM g WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {BEST}
"""
