"""SimHash near-dedup: fingerprints of word shingles, matched through BK-trees.

A BK-tree keeps a fingerprint's children keyed by their integer Hamming distance to it; a search within radius r follows
only the edges between d - r and d + r. One tree over all fingerprints would have to be broadcast whole and would grow
with the corpus, so the fingerprints are dealt to shards that hold every possible match, and each shard has its own tree:

* exact search (``min_similarity`` None): the 64 bits are cut into radius + 3 blocks; two fingerprints that differ in at
  most radius bits agree on three blocks at least, so a shard for each choice of three blocks misses no pair;
* similarity search: a shard for each of 20 bands of 4 minima of the permuted shingle hashes (a pair at 0.8 meets in none
  with probability 3e-5, at 0.9 with 3e-10; pairs below 0.4 hardly ever meet), fingerprints of the distinct shingles within
  a radius of 26 bits (a pair at 0.8 is beyond it with probability 1.3e-5 for texts of 4 and 5 shingles, 1.9e-7 for long
  ones), then an estimate of the Jaccard similarity from the 80 minima that only discards pairs clearly below (a pair at
  0.8 is estimated below 0.6 with probability 2e-5). The exact similarity of the full sets decides over each pair of
  candidates that is left. A row of a shard with at most SPARSE candidates before it gives them as pairs; those of a row with
  more are joined to one dense group, whose members are compared block against block, so nothing is capped and no shard gives
  more than SPARSE pairs a row.

Equal fingerprints (or sets of shingles) are one row before dealing, so groups of copies of any size cost one row a task. A shard
gives its members' links to one another as a forest, never as all pairs. A shard with more than SHARD_ROWS rows is cut into
blocks, and a task has the tree of two of them, so that no task holds a large shard whole.

Defined results: null and blank texts have no words, fingerprint zero, and link like others; a text with fewer words than
a shingle is one shingle; repeated rows share a component; rows of one id are documents each, and a component is named by
the smallest id in it; a null id names none unless all are null; other columns, whatever their names, are not read; an
empty table gives an empty result; ids are of an integer type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweir.llm.common import SPACE, blocks, checkpointed, map_batches, mix, powers, shuffle_partitions, utf8, whole_id
from lakeweir.llm.components import components, find

SHARD_ROWS = 8_000
#: Candidates of a row in a shard that are compared as pairs; with more of them it belongs to a dense group.
SPARSE = 8
BANDS, BAND_ROWS = 20, 4
#: Estimates below this share of the least similarity are discarded; rows and bytes of shingle sets in a block of a component.
CLEAR, SET_ROWS, SET_BYTES = 0.75, 1024, 8 << 20
BROADCAST_BYTES = 32 << 20


# --- fingerprints -------------------------------------------------------------------------------------------------


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a text, in order, repeats included."""
    words = text.lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").translate(_TO_SPACE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    ends = ends.tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :])], np.uint64)  # noqa: B905


_TO_SPACE = bytes(0x20 if SPACE[i] else i for i in range(256))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


_TURNS = mix(powers(np.uint64(0xD1342543DE82EF95), BANDS * BAND_ROWS + 1)[1:]) | np.uint64(1)


def minima(distinct: np.ndarray) -> np.ndarray:
    """The minimum of each of the multiplicative permutations of the distinct hashes; the largest number where there are none."""
    out = np.full(len(_TURNS), ~np.uint64(0))
    for i in range(0, len(distinct), 2_048):
        np.minimum(out, (distinct[i : i + 2_048, None] * _TURNS[None, :]).min(0), out=out)
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each band of minima."""
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def similar(sketches: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """Which rows of sketches (minima) estimate a Jaccard similarity to own of at least least."""
    return (sketches == own[None, :]).sum(1) >= least * len(own)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, sketches: bool) -> DataFrame:
    """doc_id, fp and, where asked for, sketch, keys and a digest of the set of shingles of every row."""
    source = docs.select(whole_id(docs, id_col).alias("doc_id"), docs[text_col].alias("text"))
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())]
    if sketches:
        fields += [T.StructField("sketch", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("digest", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in blocks(np.diff(offsets), 8_000_000):
                fps, sketched, keyed, digests = [], [], [], []
                for i in range(a, b):
                    h = shingle_hashes(data[offsets[i] : offsets[i + 1]].tobytes(), width)
                    if sketches:  # the similarity is of sets, so repeats have no say
                        distinct = np.unique(mix(h))
                        fps.append(fingerprint(distinct))
                        least = minima(distinct)
                        sketched.append((least >> np.uint64(32)).astype(np.uint32).tobytes())
                        keyed.append(bands(least).view(np.int64))
                        digests.append(xxhash.xxh3_128_digest(distinct.tobytes()))
                    else:
                        fps.append(fingerprint(h))
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(np.array(fps, np.uint64).view(np.int64))]
                if sketches:
                    columns += [pa.array(sketched, pa.binary()), pa.array(keyed, pa.list_(pa.int64())), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return map_batches(source, run, T.StructType(fields))


# --- BK-tree ------------------------------------------------------------------------------------------------------


class BKTree:
    """Fingerprints as nodes, each child under its Hamming distance to its parent.

    A node also says whether its whole subtree is known to be linked together; a search for links to other groups skips
    such a subtree once the searching row belongs to it, so a family of near copies is not compared pair by pair.
    """

    def __init__(self) -> None:
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []
        self.whole: list[bool] = []
        self.parent: dict[int, int] = {}

    def add(self, value: int) -> None:
        """Adds a node, after the links of its row are known."""
        new = len(self.prints)
        own = find(self.parent, new)
        if self.prints:
            at = 0
            while True:
                self.whole[at] = self.whole[at] and find(self.parent, at) == own
                d = (self.prints[at] ^ value).bit_count()
                if d not in self.children[at]:
                    break
                at = self.children[at][d]
            self.children[at][d] = new
        self.prints.append(value)
        self.children.append({})
        self.whole.append(True)

    def near(self, value: int, radius: int, accepts: Callable[[int], bool], most: int) -> list[int]:
        """Nodes at most radius away that accepts() takes; the search ends when there are more than most."""
        found, todo = [], [0] if self.prints else []
        while todo and len(found) <= most:
            at = todo.pop()
            d = (self.prints[at] ^ value).bit_count()
            if d <= radius and accepts(at):
                found.append(at)
            own = self.children[at]
            todo.extend(own[k] for k in sorted((k for k in own if d - radius <= k <= d + radius), reverse=True))
        return found

    def link(self, value: int, radius: int, accepts: Callable[[int], bool]) -> list[int]:
        """Nodes at most radius away that accepts() takes, at least one of each group that has any, joined to the next node to be added."""
        new, found, todo = len(self.prints), [], [0] if self.prints else []
        while todo:
            at = todo.pop()
            linked = find(self.parent, at) == find(self.parent, new)
            if linked and self.whole[at]:
                continue
            d = (self.prints[at] ^ value).bit_count()
            if not linked and d <= radius and accepts(at):
                a, b = find(self.parent, at), find(self.parent, new)
                self.parent[max(a, b)] = min(a, b)
                found.append(at)
            own = self.children[at]
            todo.extend(own[k] for k in sorted((k for k in own if d - radius <= k <= d + radius), reverse=True))
        return found


def shard_pairs(fps: list[int], ids: list[int], radius: int, sketches: list[bytes], least: float, most: int = SPARSE) -> list[tuple[int, int, bool]]:
    """Candidates (a, b, dense) of a shard: pairs of rows with at most ``most`` candidates before them; a forest that joins the others to all of theirs."""
    tree, out = BKTree(), []
    matrix = np.frombuffer(b"".join(sketches), np.uint32).reshape(len(fps), -1)
    for i, value in enumerate(fps):
        near: list[np.ndarray] = []

        def accepts(j: int, i: int = i, near: list = near) -> bool:
            if not near:
                near.append(similar(matrix[:i], matrix[i], least))
            return near[0][j]

        found = tree.near(value, radius, accepts, most)
        dense = len(found) > most
        out += [(ids[i], ids[j], dense) for j in (tree.link(value, radius, accepts) if dense else found)]
        tree.add(value)
    return out


def shard_forest(fps: list[int], ids: list[int], radius: int) -> list[tuple[int, int, bool]]:
    """Links (a, b, true) between a shard's members that join all within radius; each row looks at all rows before it."""
    tree, out = BKTree(), []
    for i, value in enumerate(fps):
        out += [(ids[i], ids[j], True) for j in tree.link(value, radius, lambda _: True)]
        tree.add(value)
    return out


def shard_links(rows: DataFrame, radius: int, min_similarity: float | None, marks: DataFrame | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """rows (key, node, fp) -> links (a, b, dense) between nodes of the same shard, or candidates where there is a similarity; then marks (node, fp, sketch) are joined."""
    spark = rows.sparkSession
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    parts = F.ceil(F.col("_n") / F.lit(shard_rows)).cast("int")
    # a block meets each other block in a pair of its own; an only block meets itself
    placed = rows.join(sizes, "key").withColumn("_parts", parts).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))
    others = F.when(F.col("_parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("_parts") - 1), lambda x: x != F.col("_own")))
    dealt = placed.withColumn("_other", F.explode(others)).withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}).drop("_n", "_parts", "_own", "_other")
    dealt = dealt if marks is None else dealt.join(marks, ["node", "fp"])
    dealt = dealt.repartition(shuffle_partitions(spark), "key", "_i", "_j").sortWithinPartitions("key", "_i", "_j", "node")
    sketched = min_similarity is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, ([], [], [])

        def close() -> pa.RecordBatch:
            links = shard_pairs(*held[:2], radius, held[2], min_similarity) if sketched else shard_forest(*held[:2], radius)
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in links], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "dense"])

        for batch in batches:
            prints = batch.column("fp").to_numpy().view(np.uint64).tolist()
            keys = zip(*(batch.column(c).to_pylist() for c in ("key", "_i", "_j")), strict=True)
            marks = batch.column("sketch").to_pylist() if sketched else [None] * len(prints)
            for key, fp, node, mark in zip(keys, prints, batch.column("node").to_pylist(), marks, strict=True):
                if key != shard:
                    if len(held[0]) > 1:
                        yield close()
                    shard, held = key, ([], [], [])
                for x, value in zip(held, (fp, node, mark), strict=True):
                    x.append(value)
        if len(held[0]) > 1:
            yield close()

    return map_batches(dealt, run, "a bigint, b bigint, dense boolean")


def shingle_sets(groups: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """groups (node, dense, sparse) -> the same with shingles, the sorted set of a node's text as bytes."""
    groups = F.broadcast(groups) if groups.count() * 48 <= BROADCAST_BYTES else groups
    source = docs.select(whole_id(docs, id_col).alias("node"), docs[text_col].alias("text")).join(groups, "node").select("node", "dense", "sparse", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in blocks(np.diff(offsets), 2_000_000):
                sets = [np.unique(mix(shingle_hashes(data[offsets[i] : offsets[i + 1]].tobytes(), width))).tobytes() for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("node", "dense", "sparse")), pa.array(sets, pa.binary())], names=["node", "dense", "sparse", "shingles"])

    return checkpointed(map_batches(source, make, "node bigint, dense bigint, sparse bigint, shingles binary"))


def _placed(sets: DataFrame) -> DataFrame:
    """sets (component, node, shingles) with _parts, the blocks of a component, of bounded rows and bytes, and _own, the block of a row."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(SET_ROWS)), F.ceil(F.sum(F.length("shingles")) / F.lit(SET_BYTES))).cast("int")
    # only components of several blocks are looked up, which are few
    large = sets.groupBy("component").agg(parts.alias("_parts")).filter("_parts > 1")
    placed = sets.join(large, "component", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    return placed.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))


def pair_links(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (component, node, shingles) have a similarity of at least least.

    A set goes to the pairs of blocks of its component in which it has candidates, once to each, and is compared with these.
    """
    place = _placed(sets).select("component", "node", "_own")
    left, right = (place.select(F.col("node").alias(c), F.col("_own").alias(f"_{c}"), *(["component"] if c == "a" else [])) for c in "ab")
    dealt = pairs.select("a", "b").join(left, "a").join(right, "b").withColumns({"_i": F.least("_a", "_b"), "_j": F.greatest("_a", "_b")})
    ends = [dealt.select("component", "_i", "_j", F.col(c).alias("node"), other.alias("other")) for c, other in (("a", F.col("b")), ("b", F.lit(None).cast("bigint")))]
    wanted = ends[0].union(ends[1]).groupBy("component", "_i", "_j", "node").agg(F.collect_list("other").alias("others"))
    dealt = wanted.join(sets.select("node", "shingles"), "node").select("component", "_i", "_j", "node", "others", "shingles")
    dealt = dealt.repartition(shuffle_partitions(sets.sparkSession), "component", "_i", "_j").sortWithinPartitions("component", "_i", "_j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, asked = None, {}, []

        def close() -> pa.RecordBatch:
            links = [(a, b) for a, others in asked for b in others if _reaches(held[a], held[b], least)]
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in links], pa.int64()) for n in (0, 1)], names=["a", "b"])

        for batch in batches:
            for c, i, j, node, others, shingles in zip(*(batch.column(n).to_pylist() for n in range(6)), strict=True):
                if (c, i, j) != block:
                    if asked:
                        yield close()
                    block, held, asked = (c, i, j), {}, []
                held[node] = np.frombuffer(shingles, np.uint64)
                if others:
                    asked.append((node, others))
        if asked:
            yield close()

    return map_batches(dealt, run, "a bigint, b bigint")


def _reaches(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-6:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - shared
    return union == 0 or shared / union >= least


def exact_links(sets: DataFrame, least: float) -> DataFrame:
    """sets (component, node, shingles) -> links between nodes of a component with a similarity of at least least.

    Components are compared whole, in pairs of blocks of bounded rows and bytes; of the pairs found, a forest leaves a block.
    """
    dealt = _placed(sets).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
    dealt = dealt.select("component", "_i", "_j", "_own", "node", "shingles").repartition(shuffle_partitions(sets.sparkSession), "component", "_i", "_j").sortWithinPartitions("component", "_i", "_j", "_own", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, ([], [], [])

        def close() -> pa.RecordBatch:
            links = set_forest(np.array(held[0]), [np.frombuffer(x, np.uint64) for x in held[2]], least)
            return pa.RecordBatch.from_arrays([pa.array([held[1][i] for i, _ in links], pa.int64()), pa.array([held[1][j] for _, j in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for c, i, j, *row in zip(*(batch.column(n).to_pylist() for n in range(6)), strict=True):
                if (c, i, j) != pair:
                    if len(held[0]) > 1:
                        yield close()
                    pair, held = (c, i, j), ([], [], [])
                for x, value in zip(held, row, strict=True):
                    x.append(value)
        if len(held[0]) > 1:
            yield close()

    return map_batches(dealt, run, "a bigint, b bigint")


def set_forest(own: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (positions) that join all pairs with a Jaccard similarity of at least least; where there are two blocks, pairs between them."""
    sizes = np.array([len(x) for x in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    filled = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[filled]
    group, across, out = np.arange(len(sets)), own[0] != own[-1], []
    present = np.zeros(len(values), bool)
    ends = np.cumsum(sizes)
    for i in range(len(sets)):
        open_ = group != group[i]
        open_ &= own > own[i] if across else np.arange(len(sets)) > i
        if not open_.any():
            continue
        mine = at[ends[i] - sizes[i] : ends[i]]
        present[mine] = True
        shared = np.zeros(len(sets), np.int64)
        if len(filled):
            shared[filled] = np.add.reduceat(present[at], starts, dtype=np.int64)
        present[mine] = False
        union = sizes + sizes[i] - shared
        near = (shared / np.maximum(union, 1) >= least) | (union == 0)
        for j in np.flatnonzero(near & open_):
            if group[j] != group[i]:
                out.append((i, int(j)))
                group[group == group[j]] = group[i]
    return out


def block_keys(fp, radius: int):
    """A key for each choice of three of radius + 3 blocks of the 64 bits."""
    edges = [round(64 * i / (radius + 3)) for i in range(radius + 4)]
    keys = []
    for n, chosen in enumerate(combinations(range(radius + 3), 3)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def similar_links(rows: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, radius: int, least: float) -> DataFrame:
    """Links (a, b) of nodes whose sets of shingles have a similarity of at least least; rows (key, node, fp) deal them to shards."""
    found = checkpointed(shard_links(rows, radius, CLEAR * least, nodes.select("node", "fp", "sketch")))
    pairs = checkpointed(found.filter("NOT dense").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    dense, sparse = components(found.filter("dense").select("a", "b")), components(pairs)
    groups = dense.withColumnRenamed("component", "dense").join(sparse.withColumnRenamed("component", "sparse"), "node", "full_outer")
    sets = shingle_sets(checkpointed(groups), docs, id_col, text_col, width)
    some = [sets.filter(F.col(c).isNotNull()).select(F.col(c).alias("component"), "node", "shingles") for c in ("dense", "sparse")]
    return exact_links(some[0], least).union(pair_links(some[1], pairs, least))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 26, min_similarity: float | None = 0.8) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row of docs."""
    marked = checkpointed(fingerprints(docs, id_col, text_col, width, min_similarity is not None))
    same = ["fp"] if min_similarity is None else ["fp", "digest"]
    nodes = marked.groupBy(*same).agg(F.min("doc_id").alias("first"), *([F.min(c).alias(c) for c in ("keys", "sketch")] if len(same) > 1 else []))
    # a node is a distinct print, named by a number that its smallest doc_id gives; all-null ids get their own name
    nodes = nodes.filter("first IS NOT NULL").withColumnRenamed("first", "node")
    keys = F.col("keys") if min_similarity is not None else block_keys(F.col("fp"), radius)
    rows = nodes.select(F.explode(keys).alias("key"), "node", "fp")
    if min_similarity is None:
        linked = components(shard_links(rows, radius, None).select("a", "b"))
    else:
        linked = components(similar_links(rows, nodes, docs, id_col, text_col, width, radius, min_similarity))
    named = nodes.join(linked, nodes.node == linked.node, "left").select(*(nodes[c].alias(f"_{c}") for c in same), F.coalesce("component", nodes.node).alias("component_id"))
    on = [marked[c] == named[f"_{c}"] for c in same]
    return marked.join(named, on, "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
