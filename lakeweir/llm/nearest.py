"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours.

Vectors of one label are compared by cosine in double precision. The graph keeps edges of at least FLOOR (the angle of two
threshold edges is within it), so unrelated vectors cost nothing after the first lists. Equal vectors of a label are one
node that counts its rows, so a group of copies of any size is one row in every step.

1. First lists: random hyperplanes deal each label's vectors to small buckets, several times, through the origin and
   through the label's mean in turn (vectors that all point one way are not told apart by the first); a bucket is read in
   order of a projection, in overlapping chunks, so a bucket of any size takes bounded memory.
2. Refinement: joins of neighbours with their neighbours propose new edges, until a round adds none.
3. Enlargement: a vector with LIST neighbours or more has a saturated list. The lists of its whole component grow to the
   component, compared block against block; only counts and a forest of links leave a block, never its pairs.
4. Audit: links of query vectors, against all rows, measure the recall: of some that have a near neighbour in the graph,
   and of more and more of all vectors until they hold ENOUGH links or are all. Below TARGET the steps are repeated with
   other hyperplanes added, and after PASSES the operator fails. Where MOST queries hold no link at all, nothing can be
   measured; then all PASSES are made.

Defined results: null, zero and unfinished vectors (null or non-finite components), null labels and null ids link with
nothing; vectors of different lengths never link; repeated ids are one node with a row each; copies link to each other;
other columns, whatever their names, are not read; an empty table gives an empty result; ids are of an integer type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweir.llm.common import checkpointed, map_batches, shuffle_partitions, whole_id, with_ordinal
from lakeweir.llm.components import components

THRESHOLD, FLOOR, LIST = 0.98, 0.90, 32
TABLES, BUCKET, CHUNK, BLOCK, TARGET, PASSES = 10, 48, 512, 1024, 0.99, 3
#: Queries of an audit: of a wave, at the most, and links that are enough.
QUERIES, MOST, ENOUGH = 500, 16_000, 200


def _normal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        keys, ids, labels, out = [], [], [], []
        for k, i, label, v in zip(*(batch.column(c).to_pylist() for c in ("k", "vec_id", "label", "v")), strict=True):
            x = np.array([np.nan if c is None else c for c in v], np.float64)
            if not len(x) or not np.isfinite(x).all() or not (top := np.abs(x).max()):
                continue
            x /= top
            keys.append(k)
            ids.append(i)
            labels.append(label)
            out.append((x / np.linalg.norm(x)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(out, pa.binary())], names=["k", "vec_id", "label", "v"])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _means(vectors: DataFrame) -> DataFrame:
    """label, _w (bytes of a vector), _n and _mean of the vectors of a label and length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        for batch in batches:
            for label, v in zip(batch.column("label").to_pylist(), batch.column("v").to_pylist(), strict=True):
                own = held.setdefault((label, len(v)), [0, np.zeros(len(v) // 8)])
                own[0] += 1
                own[1] += np.frombuffer(v, np.float64)
        rows = [(label, w, n, total.tolist()) for (label, w), (n, total) in held.items()]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["label", "_w", "_n", "total"])

    parts = map_batches(vectors.select("label", "v"), add, "label string, _w int, _n bigint, total array<double>")
    # one row a task, label and length; summed place by place
    each = parts.select("label", "_w", "_n", F.posexplode("total").alias("at", "x"))
    summed = each.groupBy("label", "_w", "at").agg(F.sum("x").alias("x"), F.sum("_n").alias("_n"))
    return summed.groupBy("label", "_w").agg(F.first("_n").alias("_n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("_total")).select("label", "_w", "_n", F.transform("_total", lambda x: x / F.col("_n")).alias("_mean"))


def _first_lists(vectors: DataFrame, tables: range) -> DataFrame:
    """Edges (u < v, s) between vectors that share a bucket: the LIST best of each vector in a chunk."""
    sizes = checkpointed(_means(vectors))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple[int, str], list[int]] = {}
            values, counts = batch.column("v").to_pylist(), batch.column("_n").to_pylist()
            for i, (v, label) in enumerate(zip(values, batch.column("label").to_pylist(), strict=True)):
                groups.setdefault((len(v), label), []).append(i)
            for (width, _), rows in groups.items():
                bits = max(0, int(np.ceil(np.log2(counts[rows[0]] / BUCKET))))
                x = np.frombuffer(b"".join(values[i] for i in rows), np.float64).reshape(len(rows), -1)
                mean = np.array(batch.column("_mean")[rows[0]].as_py())
                own = batch.take(pa.array(rows))
                for t in tables:
                    planes = np.random.default_rng([t, width]).normal(size=(width // 8, 62))[:, : bits + 1]
                    side = (x - mean if t % 2 else x) @ planes
                    key = ((side[:, 1:] > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(rows), pa.int32()), pa.array([width] * len(rows), pa.int32()), own.column("label"), pa.array(key), pa.array(side[:, 0]), own.column("k"), own.column("v")], names=["t", "w", "label", "key", "p", "k", "v"])

    dealt = map_batches(vectors.withColumn("_w", F.octet_length("v")).join(sizes, ["label", "_w"]).select("k", "label", "v", "_n", "_mean"), deal, "t int, w int, label string, key bigint, p double, k bigint, v binary")
    dealt = dealt.withColumn("bucket", F.xxhash64("t", "w", "label", "key")).select("bucket", "p", "w", "k", "v", "label")
    dealt = dealt.repartition(shuffle_partitions(vectors.sparkSession), "bucket").sortWithinPartitions("bucket", "w", "label", "p")

    def close(keys: list, rows: list) -> pa.RecordBatch:
        x, k = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1), np.array(keys)
        s = x @ x.T
        np.fill_diagonal(s, -1)
        if len(k) > LIST:
            least = np.partition(s, len(k) - LIST, axis=1)[:, len(k) - LIST]
            s = np.where((s >= least[:, None]) | (s >= least[None, :]), s, -1)
        a, b = np.nonzero(np.triu(s >= FLOOR, 1))
        u, v = np.minimum(k[a], k[b]), np.maximum(k[a], k[b])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s[a, b], pa.float64())], names=["u", "v", "s"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, rows = None, [], []
        for batch in batches:
            for *own, k, v in zip(*(batch.column(c).to_pylist() for c in ("bucket", "w", "label", "k", "v")), strict=True):
                if own != shard:
                    if len(keys) > 1:
                        yield close(keys, rows)
                    shard, keys, rows = own, [], []
                elif len(keys) == CHUNK:
                    yield close(keys, rows)
                    keys, rows = keys[CHUNK // 2 :], rows[CHUNK // 2 :]
                keys.append(k)
                rows.append(v)
        if len(keys) > 1:
            yield close(keys, rows)

    return map_batches(dealt, lists, "u bigint, v bigint, s double")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _measured(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs (u < v) whose cosine reaches FLOOR, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([np.frombuffer(a, np.float64) @ np.frombuffer(b, np.float64) if len(a) == len(b) else -1 for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)])
            keep = np.flatnonzero(s >= FLOOR) if len(s) else []
            yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(keep, pa.int64())), batch.column("v").take(pa.array(keep, pa.int64())), pa.array(s[keep], pa.float64())], names=["u", "v", "s"])

    left = vectors.select(F.col("k").alias("u"), F.col("v").alias("x"), F.col("label").alias("_a"))
    right = vectors.select(F.col("k").alias("v"), F.col("v").alias("y"), F.col("label").alias("_b"))
    return map_batches(pairs.join(left, "u").join(right, "v").filter("_a = _b").select("u", "v", "x", "y"), run, "u bigint, v bigint, s double")


def _refined(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rounds of neighbours-of-neighbours joins over the unsaturated part of the graph, until a round adds nothing."""
    while True:
        around = _both(edges)
        full = around.groupBy("u").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= LIST).select("u")
        open_ = around.join(full, "u", "left_anti")
        beyond = open_.select(F.col("u").alias("a"), F.col("v").alias("u")).join(open_, "u").select("a", F.col("v").alias("b")).filter("a < b")
        fresh = beyond.distinct().select(F.col("a").alias("u"), F.col("b").alias("v")).join(edges.select("u", "v"), ["u", "v"], "left_anti")
        added = checkpointed(_measured(fresh, vectors))
        if added.isEmpty():
            return edges
        edges = checkpointed(edges.union(added))


def _enlarged(edges: DataFrame, vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """For components with a saturated list: (k, n: the rows of linked nodes) of every member, and a forest of its links (u, v)."""
    around = _both(edges)
    full = around.groupBy("u").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= LIST).select(F.col("u").alias("node"))
    group = components(edges.select("u", "v"))
    saturated = group.join(full, "node").select("component").distinct()
    members = checkpointed(group.join(saturated, "component").select("component", F.col("node").alias("k")))
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("_parts"))
    placed = members.join(sizes, "component").withColumn("_own", F.pmod(F.xxhash64("k"), F.col("_parts")).cast("int"))
    dealt = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
    dealt = dealt.join(vectors, "k").select("component", "_i", "_j", "_own", "k", "v", "m")
    dealt = dealt.repartition(shuffle_partitions(vectors.sparkSession), "component", "_i", "_j").sortWithinPartitions("component", "_i", "_j", "_own", "k")

    def close(pair: tuple, own: list, keys: list, rows: list, many: list) -> pa.RecordBatch:
        k, at, m, x = np.array(keys), np.array(own), np.array(many), np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        counted = near.copy()
        if pair[0] != pair[1]:  # pairs inside a block are counted where it meets itself
            counted &= at[:, None] != at[None, :]
        low = np.arange(len(k))
        while True:
            found = np.minimum(low, np.where(near, low[None, :], len(k)).min(1, initial=len(k)))
            found = found[found]
            if (found == low).all():
                break
            low = found
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(counted @ m, pa.int64()), pa.array(k[low], pa.int64())], names=["k", "n", "to"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, own, keys, rows, many = None, [], [], [], []
        for batch in batches:
            for c, i, j, o, k, v, m in zip(*(batch.column(n).to_pylist() for n in range(7)), strict=True):
                if (c, i, j) != pair:
                    if keys:
                        yield close(pair[1:], own, keys, rows, many)
                    pair, own, keys, rows, many = (c, i, j), [], [], [], []
                own.append(o)
                keys.append(k)
                rows.append(v)
                many.append(m)
        if keys:
            yield close(pair[1:], own, keys, rows, many)

    counted = checkpointed(map_batches(dealt, compare, "k bigint, n bigint, to bigint"))
    return counted.groupBy("k").agg(F.sum("n").alias("n")), counted.filter("k <> to").select(F.col("k").alias("u"), F.col("to").alias("v"))


def true_links(vectors: DataFrame, queries: list, threshold: float) -> DataFrame:
    """k and n: the rows that each query vector (a bounded number of them) is linked to, by comparison with all of its label."""
    sorted_ = sorted(queries, key=lambda r: (r.label, len(r.v)))
    blocks: dict[tuple[str, int], tuple[list, list]] = {}
    for r in sorted_:
        own = blocks.setdefault((r.label, len(r.v)), ([], []))
        own[0].append(r.k)
        own[1].append(bytes(r.v))
    held = {key: (np.array(ks), np.frombuffer(b"".join(vs), np.float64).reshape(len(ks), -1)) for key, (ks, vs) in blocks.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple[str, int], list[int]] = {}
            values = batch.column("v").to_pylist()
            for i, (label, v) in enumerate(zip(batch.column("label").to_pylist(), values, strict=True)):
                if (label, len(v)) in held:
                    groups.setdefault((label, len(v)), []).append(i)
            keys, rows, names, found = batch.column("k").to_numpy(), batch.column("m").to_numpy(), [], []
            for key, own in groups.items():
                ks, q = held[key]
                near = q @ np.frombuffer(b"".join(values[i] for i in own), np.float64).reshape(len(own), -1).T >= threshold
                near &= ks[:, None] != keys[own][None, :]
                n = near @ rows[own]
                names.append(ks[n > 0])
                found.append(n[n > 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (names, found)], names=["k", "n"])

    return map_batches(vectors, run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))


def audit(vectors: DataFrame, edges: DataFrame, counts: DataFrame, threshold: float, most: int = MOST) -> float | None:
    """Links found of query vectors, as a share of those that all rows give; None if the queries, many as they are, have none."""
    true = found = 0

    def measure(queries: list) -> None:
        nonlocal true, found
        row = true_links(vectors, queries, threshold).join(counts.withColumnRenamed("n", "found"), "k", "left").agg(F.sum("n"), F.sum(F.least(F.coalesce("found", F.lit(0)), "n"))).first()
        true, found = true + (row[0] or 0), found + (row[1] or 0)

    draw = lambda rows, n: rows.select("k", "label", "v").orderBy(F.xxhash64("k"), "k").limit(n).collect()
    near = vectors.join(_both(edges).select(F.col("u").alias("k")).distinct(), "k", "left_semi")
    if queries := draw(near, QUERIES):
        measure(queries)
    seen, n, own = 0, QUERIES, [0, 0]
    while own[0] < ENOUGH and seen < most:
        queries = draw(vectors, n)
        if len(queries) == seen:
            break
        before = true, found
        measure(queries[seen:])
        own = [own[0] + true - before[0], own[1] + found - before[1]]
        seen, n = len(queries), min(4 * n, most)
    # a lost pair does not show among vectors that have a neighbour, so each draw must hold by itself
    return min((f / t for t, f in ((true, found), own) if t), default=None)


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of embeddings."""
    own = embeddings.select(whole_id(embeddings, id_col).alias("vec_id"), embeddings[vector_col].cast("array<double>").alias("v"), embeddings[label_col].cast("string").alias("label"))
    rows = with_ordinal(own, "vec_id", "v").withColumn("k", F.when(F.col("_ord") == 0, F.col("vec_id")).otherwise(F.xxhash64("vec_id", "_ord")))
    rows = checkpointed(rows)  # nodes are named by numbers that only some rows' order gives
    valid = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    normal = checkpointed(map_batches(valid.select("k", "vec_id", "label", "v"), _normal, "k bigint, vec_id bigint, label string, v binary"))
    vectors = checkpointed(normal.groupBy("label", "v").agg(F.min("k").alias("k"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("m")))
    edges = None
    for turn in range(PASSES):
        first = _first_lists(vectors, range(turn * TABLES, (turn + 1) * TABLES))
        first = first if edges is None else first.union(edges)
        edges = _refined(checkpointed(first.groupBy("u", "v").agg(F.first("s").alias("s"))), vectors)
        many, forest = _enlarged(edges, vectors, threshold)
        links = edges.filter(F.col("s") >= threshold)
        few = _both(links).join(vectors.select(F.col("k").alias("v"), "m"), "v").groupBy(F.col("u").alias("k")).agg(F.sum("m").alias("n"))
        counts = checkpointed(few.join(many.select("k"), "k", "left_anti").union(many))
        recall = audit(vectors, edges, counts, threshold)
        if recall is not None and recall >= TARGET:
            break
    else:
        if recall is not None:
            raise RuntimeError(f"recall {recall:.4f} of the audited links is below {TARGET} after {PASSES} passes")
    name = vectors.select(F.col("k").alias("u"), "first")
    joined = links.select("u", "v").union(forest)
    joined = joined.join(name, "u").withColumnRenamed("first", "a").join(name.withColumnRenamed("u", "v"), "v").select("a", F.col("first").alias("b"))
    repeated = normal.join(rows.filter("_ord > 0").select("vec_id").distinct(), "vec_id", "left_semi").join(vectors.select("label", "v", "first"), ["label", "v"])
    group = components(joined.union(repeated.select("vec_id", "first")))
    # what a node has is joined to nodes first; only one join is on vectors, where Spark splits the rows of a hot one
    nodes = vectors.join(counts, "k", "left").join(group, vectors["first"] == group.node, "left")
    nodes = checkpointed(nodes.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "first").alias("component")))
    found = normal.select("k", "label", "v").join(nodes, ["label", "v"]).select("k", "n_links", "component")
    component = F.coalesce("component", "vec_id")
    out = rows.join(found, "k", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
