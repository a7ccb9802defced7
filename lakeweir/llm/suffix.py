"""Suffix-array dedup: repeated byte strings, found by a multi-document Burrows-Wheeler transform built column by column.

Every string of ``length`` bytes that also starts earlier (smaller doc_id, or the same document further left) is covered.
All suffixes of a corpus can't be in one task, so the collection is dealt first and built per shard:

1. *Anchors.* In each window of ``length`` bytes the k-gram of least hash is its anchor (leftmost on a tie). Equal windows
   have equal anchors at equal offsets, so all windows that could be equal share an anchor's hash. Each task sends one
   record a hash that it met, so a passage in a third of all documents sends one record a task.
2. *Contexts.* An anchor whose hash occurs twice keeps its context: the bytes of all windows that it anchors, at most
   2 * length - k bytes. A task sends equal contexts once, owned by the earliest document. The contexts of a hash that
   occurs more than HOT times are split into their windows, dealt by the window's own hash and again sent once a task, so
   no hash gathers more than HOT contexts, or one window a task.
3. *Collection.* The contexts that share hashes are the documents of a collection whose Burrows-Wheeler transform is built
   as Bauer, Cox, Garofalo, Rosone and Sciortino describe: each round inserts the next symbol of every document, from its
   end, and updates transform and longest common prefixes in two sequential passes over files, block by block; in memory
   are a block and the newest row of each document. A symbol is the rank of ``symbol_bytes(length)`` bytes, counted from
   the anchor, and a context is a document for each alignment; that leaves a fifth of the rounds. Runs of common prefix >= length are the repeated windows; the earliest owner of each keeps it. Equal
   contexts of a hash are one document, owned by the earliest.

Files are a task's scratch, unlinked as they are made, in the folders that Spark spills to; no other task reads them.

Defined results: null is empty; texts shorter than ``length`` are untouched; rows with a null id count as last; repeated
ids are ordered by text, those without one by a hash of it first, and an exact repeated row is a copy of the first; extra columns, whatever their names, are handed
through in ``rest``; an empty table gives an empty result; ids are of an integer type.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweir.llm.common import blocks, checkpointed, map_batches, mix, shuffle_partitions, utf8, whole_id, with_ordinal

LENGTH, GRAM = 100, 24
FLUSH_ANCHORS, FLUSH_CONTEXTS, SPLIT = 400_000, 100_000, 8
#: Bytes of contexts in a collection (and one hash's more), rows of a block of its files, and occurrences of a hash beyond which contexts are split.
COLLECTION_BYTES, BLOCK_ROWS, HOT = 1 << 18, 1 << 17, 20_000
BROADCAST_BYTES = 32 << 20
#: Bytes of a symbol: the first of these that divides a window. Longer ones make fewer rounds.
SYMBOL_BYTES = (5, 4, 3, 2, 1)


# --- anchors ------------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A scrambled hash of the GRAM bytes from each position (len - GRAM + 1 of them)."""
    h = mix(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    have = 1
    while have < GRAM:
        step = min(have, GRAM - have)
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93) + h[step:]
        h ^= h >> np.uint64(32)
        have += step
    return mix(h)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, hash, and distance back to the first and the last window start of each anchor of a block of texts."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, np.zeros(0, np.uint64), empty, empty
    h = gram_hashes(data)
    bits = np.uint64(32)  # 32 bits of hash, then the position, so that a tie goes to the left
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    width, reach = length - GRAM + 1, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(len(at) + 1, np.int32)  # windows that end inside their document
    has = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][has], 1)
    np.add.at(inside, (offsets[1:] - length + 1)[has], -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    at = at[starts]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    i = np.flatnonzero(first)
    last = np.append(i[1:], len(at)) - 1
    return at[i], h[at[i]], at[i] - starts[i], at[i] - starts[last]


def _pack(position: np.ndarray, back: np.ndarray, near: np.ndarray) -> np.ndarray:
    return position << 16 | back << 8 | near


def _anchor_records(length: int, buckets: int):
    """Documents -> anchors that this task met twice (kind 2, with their document), and for each hash in a bucket a record with its document (0) or how often the task met it (1)."""
    names = ["bucket", "kind", "hashes", "ids", "ords", "places"]

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, ids, ords, places = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, ids, ords, places = h[order], ids[order], ords[order], places[order]
        same = h[1:] == h[:-1]
        twice = np.append(same, False) | np.insert(same, 0, False)
        one = ~np.insert(same, 0, False)
        heads = np.flatnonzero(one)
        times = np.zeros(len(h), np.int64)
        times[heads] = np.diff(np.append(heads, len(h)))
        rows: list[tuple] = []
        for kind, take in ((2, twice), (1, one & twice), (0, one & ~twice)):
            if kind == 2:  # known already: dealt anywhere
                idx = np.flatnonzero(take)
                for k in range(0, len(idx), 20_000):
                    part = idx[k : k + 20_000]
                    rows.append((int(h[part[0]] % np.uint64(buckets)), 2, b"", ids[part].tobytes(), ords[part].tobytes(), places[part].tobytes()))
                continue
            idx = np.flatnonzero(take)
            of = (h[idx] % np.uint64(buckets)).astype(np.int64)
            idx = idx[order := np.argsort(of, kind="stable")]
            of = of[order]
            cut = np.flatnonzero(np.insert(of[1:] != of[:-1], 0, True)) if len(of) else np.zeros(0, np.int64)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(of)], strict=False):
                part = idx[a:b]
                own = (times[part].tobytes(), b"", b"") if kind else (ids[part].tobytes(), ords[part].tobytes(), places[part].tobytes())
                rows.append((int(of[a]), kind, h[part].tobytes(), *own))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, ords = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("_ord").to_numpy(zero_copy_only=False)
            for a, b in blocks(np.diff(offsets)):
                own = offsets[a : b + 1] - offsets[a]
                position, h, back, near = anchors(data[offsets[a] : offsets[b]], own, length)
                if not len(position):
                    continue
                row = np.searchsorted(own, position, side="right") - 1
                held.append((h, ids[a + row], ords[a + row].astype(np.int64), _pack(position - own[row], back, near)))
                n += len(h)
                if n >= FLUSH_ANCHORS:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


def _repeated_anchors(most: int):
    """Bucket records, sorted by bucket -> (doc_id, _ord, place) of the anchors whose hash occurs twice or more.

    A hash that occurs more than most times is a row of its own: the hash as doc_id, _ord -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def known(ids: np.ndarray, ords: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ords), pa.array(places)], names=["doc_id", "_ord", "place"])

        def joined(kind: int, at: int, dtype: type) -> np.ndarray:
            return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(x[at], dtype) for x in held if x[0] == kind)])

        def close() -> pa.RecordBatch:
            h, ids, ords, places = joined(0, 1, np.uint64), joined(0, 2, np.int64), joined(0, 3, np.int64), joined(0, 4, np.int64)
            often, times = joined(1, 1, np.uint64), joined(1, 2, np.int64)
            values, group = np.unique(np.concatenate((h, often)), return_inverse=True)
            count = np.bincount(group, np.concatenate((np.ones(len(h)), times)), len(values))
            keep, hot = count[group[: len(h)]] > 1, count > most
            return known(np.append(ids[keep], values[hot].view(np.int64)), np.append(ords[keep], np.full(int(hot.sum()), -1, np.int64)), np.append(places[keep], count[hot].astype(np.int64)))

        for batch in batches:
            for b, kind, *rest in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if kind == 2:
                    yield known(*(np.frombuffer(x, t) for x, t in zip(rest[1:], (np.int64,) * 3, strict=True)))
                    continue
                if b != bucket:
                    if held:
                        yield close()
                    bucket, held = b, []
                held.append((kind, *rest))
        if held:
            yield close()

    return run


# --- contexts -----------------------------------------------------------------------------------------------------


def _contexts(length: int):
    """Documents with their repeated anchors -> distinct contexts of a task with their earliest owner."""
    names = ["hash", "context", "doc_id", "_ord", "place"]
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 3]

    def flush(best: dict[bytes, tuple]) -> pa.RecordBatch:
        owners = list(best.values())
        grams = np.frombuffer(b"".join(c[(p >> 8 & 255) : (p >> 8 & 255) + GRAM] for c, (_, _, p) in best.items()), np.uint8).reshape(-1, GRAM)
        h = np.concatenate([gram_hashes(grams[i : i + 20_000].ravel())[::GRAM] for i in range(0, len(grams), 20_000)]).view(np.int64)
        columns = [h, list(best), *zip(*owners, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple] = {}
        for batch in batches:
            for i, o, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("_ord").to_pylist(), batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                if not places:
                    continue
                data = text.encode()
                for place in places:
                    position, back = place >> 16, place >> 8 & 255
                    context = data[position - back : position - (place & 255) + length]
                    owner = (i, o, place)
                    if context not in best or owner < best[context]:
                        best[context] = owner
                if len(best) >= FLUSH_CONTEXTS:
                    yield flush(best)
                    best = {}
        if best:
            yield flush(best)

    return run


def _split(contexts: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """contexts with key, shift and _hot; those of hot hashes become their windows (shift: place in the context), once a task."""
    n = hot.count()
    if not n:
        return contexts.select(F.col("hash").alias("key"), "context", "doc_id", "_ord", "place", F.lit(0).alias("shift"), F.lit(False).alias("_hot"))
    hot = hot.withColumn("_often", F.lit(True))
    marked = contexts.join(F.broadcast(hot) if n * 16 <= BROADCAST_BYTES else hot, "hash", "left").withColumn("_hot", F.coalesce("_often", F.lit(False)))
    windows = F.transform(F.sequence(F.lit(0), F.octet_length("context") - length), lambda i: F.struct(i.alias("shift"), F.substring(F.col("context"), i + 1, F.lit(length)).alias("part")))
    whole = F.array(F.struct(F.lit(0).alias("shift"), F.col("context").alias("part")))
    parts = marked.select("hash", "_hot", "doc_id", "_ord", "place", F.inline(F.when(F.col("_hot"), windows).otherwise(whole)))
    dealt = parts.select(F.when(F.col("_hot"), F.xxhash64("part")).otherwise(F.col("hash")).alias("key"), F.col("part").alias("context"), "doc_id", "_ord", "place", "shift", "_hot")

    names = dealt.columns

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple] = {}

        def flush() -> pa.RecordBatch:
            columns = [[x[0] for x in best.values()], list(best), *([x[1][i] for x in best.values()] for i in range(4)), [True] * len(best)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], names=names)

        for batch in batches:
            mask = batch.column("_hot")
            plain = batch.filter(pc.invert(mask))
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays(plain.columns, names=names)
            windows = batch.filter(mask)
            for key, part, *owner in zip(*(windows.column(i).to_pylist() for i in range(6)), strict=True):
                owner = tuple(owner)
                if part not in best or owner < best[part][1]:
                    best[part] = (key, owner)
            if len(best) >= FLUSH_CONTEXTS:
                yield flush()
                best.clear()
        if best:
            yield flush()

    return map_batches(dealt, combine, dealt.schema)


# --- collection ---------------------------------------------------------------------------------------------------


def _scratch():
    """An unlinked file in a folder that Spark spills to."""
    folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
    return tempfile.TemporaryFile(buffering=0, dir=folders[0] if os.path.isdir(folders[0]) else None)


class Tape:
    """A column of values in sequential files: read in blocks from its start, while the next version is written."""

    def __init__(self, dtype: type, values: np.ndarray):
        self.dtype, self.now, self.next = np.dtype(dtype), _scratch(), _scratch()
        self.put(values)
        self.turn()

    def put(self, values: np.ndarray) -> None:
        left = memoryview(np.ascontiguousarray(values, self.dtype)).cast("B")
        while left:
            left = left[self.next.write(left) :]

    def get(self, n: int) -> np.ndarray:
        size, parts = n * self.dtype.itemsize, []
        while size and (part := self.now.read(size)):
            parts.append(part)
            size -= len(part)
        return np.frombuffer(parts[0] if len(parts) == 1 else b"".join(parts), self.dtype)

    def rewind(self) -> None:
        self.now.seek(0)

    def turn(self) -> None:
        """What was put is what is read from now on."""
        self.now, self.next = self.next, self.now
        self.next.seek(0)
        self.next.truncate()
        self.rewind()

    def close(self) -> None:
        self.now.close()
        self.next.close()


#: Bits of a row of the transform.
_DOC, _PREFIX, _SYMBOL = np.uint64(8), np.uint64(32), np.uint64(40)
_PREFIX_BITS, _PLACE = np.uint64(255) << _PREFIX, (np.uint64(1) << _PREFIX) - np.uint64(1)


class Collection:
    """A multi-document transform on tape; each row is symbol << 40 | common prefix with the row above << 32 | suffix.

    The symbol (0: end of a document) is the one before the suffix; the suffix is document << 8 | its symbols.

    columns: row r holds the symbol before each document's suffix of r symbols, 0 where it ends; a document has at most 254.
    Row i < n_docs is the empty suffix of document i.
    """

    def __init__(self, columns: np.ndarray, block: int | None = None):
        self.block = block or BLOCK_ROWS
        self.n_docs = self.rows = m = columns.shape[1]
        symbols = Tape(np.uint32, columns.ravel())
        self.tape = Tape(np.uint64, np.arange(m, dtype=np.uint64) << _DOC)
        self.times = np.zeros(int(columns.max(initial=0)) + 1, np.int64)  # occurrences of each symbol
        at, who = np.arange(m), np.arange(m)  # rows of the newest suffixes, ascending, and their documents
        for r in range(len(columns)):
            symbol = symbols.get(m)[who]
            go = symbol > 0
            if not go.all():
                at, who, symbol = at[go], who[go], symbol[go]
            if not len(at):
                break
            at, who = self.insert(at, who, symbol, r + 1)
        symbols.close()

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        self.tape.rewind()
        for x in range(0, self.rows, self.block):
            yield x, self.tape.get(min(self.block, self.rows - x))

    def insert(self, at: np.ndarray, who: np.ndarray, symbol: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A round: the symbols of rows at become known, and a row for each suffix that they start is inserted."""
        self.times += np.bincount(symbol, minlength=len(self.times))
        # occurrence k of a symbol is row base + k of the grown transform
        base = self.n_docs + np.cumsum(self.times) - self.times
        seen, since, last_new = np.zeros(len(base), np.int64), np.full(len(base), 254, np.uint8), np.zeros(len(base), bool)
        placed, of, changed, values = [], [], [], []
        first = 0
        for x, block in self.blocks():
            until = int(np.searchsorted(at, x + len(block)))
            here = at[first:until] - x
            prefix = (block >> _PREFIX).astype(np.uint8)
            # symbol, place and whether it is new in one number: sorting it orders the occurrences of each symbol
            key = (block >> _SYMBOL << _SYMBOL) | np.arange(0, 2 * len(block), 2, dtype=np.uint64)
            key[here] = symbol[first:until].astype(np.uint64) << _SYMBOL | (here << 1 | 1).astype(np.uint64)
            key.sort()
            key = key[np.searchsorted(key, np.uint64(1) << _SYMBOL) :]
            everywhere = prefix.min()
            if not len(key):
                since = np.minimum(since, everywhere)
                first = until
                continue
            names, place = (key >> _SYMBOL).astype(np.int64), (key & _PLACE).astype(np.int64) >> 1
            head = np.ones(len(key), bool)
            head[1:] = names[1:] != names[:-1]
            heads = np.flatnonzero(head)
            tails = np.append(heads[1:], len(key)) - 1
            fresh = (key & np.uint64(1)).astype(bool)
            f = np.flatnonzero(fresh)
            own = names[heads]
            shift = np.zeros(len(base), np.int64)  # from a place in key to a row of the grown transform
            shift[own] = base[own] + seen[own] - heads
            placed.append(shift[names[f]] + f)
            of.append(first + np.searchsorted(here, place[f]))
            first = until
            # the prefix of symbol + suffix with the row above is 1 + the least prefix between the two occurrences of the symbol
            near = fresh.copy()
            near[1:] |= fresh[:-1]
            head[heads] = near[heads] = fresh[heads] | last_new[own]
            near = np.flatnonzero(near)
            row, above = place[near], place[near - 1]
            changed.append(shift[names[near]] + near)
            opens = np.flatnonzero(head[near])
            above[opens] = row[opens] - 1
            value = _least(prefix, above + 1, row + 1) + np.uint8(1)
            if x and len(opens):
                value[opens] = np.minimum(since[names[near[opens]]], np.minimum.accumulate(prefix)[row[opens]]) + np.uint8(1)
            value[opens[seen[names[near[opens]]] == 0]] = 0
            values.append(value)
            if x + len(block) < self.rows:
                beyond = np.append(np.minimum.accumulate(prefix[::-1])[::-1], np.uint8(254))
                since = np.minimum(since, everywhere)
                since[own] = beyond[place[tails] + 1]
                last_new[own] = fresh[tails]
                seen[own] += tails - heads + 1
        rows, of, changed, values = (np.concatenate(v) for v in (placed, of, changed, values))
        if self.rows > self.block:  # each block gave an ascending run
            order = np.argsort(rows, kind="stable")
            rows, of = rows[order], of[order]
            order = np.argsort(changed, kind="stable")
            changed, values = changed[order], values[order]
        who = who[of]
        before = rows - np.arange(len(rows))  # the old row that each new one goes before
        made = who.astype(np.uint64) << _DOC | np.uint64(size)
        known, values = symbol.astype(np.uint64) << _SYMBOL, values.astype(np.uint64) << _PREFIX
        first = 0
        for x, block in self.blocks():
            y = x + len(block)
            i, j = np.searchsorted(before, (x, y)) if y < self.rows else (int(np.searchsorted(before, x)), len(before))
            until = int(np.searchsorted(at, y))
            block = block.copy()
            block[at[first:until] - x] |= known[first:until]
            first = until
            old = np.ones(len(block) + j - i, bool)
            old[rows[i:j] - (x + i)] = False
            grown = np.empty(len(old), np.uint64)
            grown[old] = block
            grown[rows[i:j] - (x + i)] = made[i:j]
            k, n = np.searchsorted(changed, (x + i, x + i + len(old)))
            own = changed[k:n] - (x + i)
            grown[own] = grown[own] & ~_PREFIX_BITS | values[k:n]
            self.tape.put(grown)
        self.tape.turn()
        self.rows += len(rows)
        return rows, who

    def repeats(self, window: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, symbols of the suffix) of each suffix whose first ``window`` symbols a document of a smaller owner number starts with too."""
        runs, docs, sizes, run = [], [], [], 0
        for _, block in self.blocks():
            prefix, suffix = (block >> _PREFIX).astype(np.uint8), block & _PLACE
            number = run + np.cumsum(prefix < window)
            run = int(number[-1])
            size = (suffix & np.uint64(255)).astype(np.int64)
            held = np.append(prefix[1:] >= window, True) | (prefix >= window)
            keep = np.flatnonzero((size >= window) & held)
            runs.append(number[keep])
            docs.append((suffix[keep] >> _DOC).astype(np.int64))
            sizes.append(size[keep])
        runs, docs, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (runs, docs, sizes))
        if not len(runs):
            return docs, sizes
        starts = np.flatnonzero(np.insert(runs[1:] != runs[:-1], 0, True))
        least = np.repeat(np.minimum.reduceat(owner[docs], starts), np.diff(np.append(starts, len(runs))))
        late = owner[docs] > least
        return docs[late], sizes[late]

    def close(self) -> None:
        self.tape.close()


def _least(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least of values[start:end] for each pair, from minima over power-of-two lengths."""
    if not len(starts):
        return np.zeros(0, np.uint8)
    level = np.frexp((ends - starts).astype(np.float64))[1] - 1
    out = np.empty(len(starts), np.uint8)
    table = values
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[starts[own]], table[ends[own] - (1 << k)])
    return out


def symbol_bytes(length: int) -> int:
    """Bytes of a symbol: windows are whole numbers of them."""
    return next(n for n in SYMBOL_BYTES if length % n == 0)


def _ranked(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of ranks."""
    if not len(high):
        return high
    base = int(low.max()) + 1
    key = high.astype(np.int64) * base + low
    if (int(high.max()) + 1) * base <= 8 * len(key):
        present = np.zeros((int(high.max()) + 1) * base, bool)
        present[key] = True
        return (np.cumsum(present, dtype=np.int32) - 1)[key]
    return np.unique(key, return_inverse=True)[1].astype(np.int32)


def byte_ranks(data: np.ndarray, n: int) -> np.ndarray:
    """The rank of the n bytes from each position, among all of them."""
    one = data.astype(np.int32)
    rank, have = one, 1
    while have < n:
        step = min(have, n - have)
        rank = _ranked(rank[:-step], rank[step:]) if step == have else _ranked(rank[: len(one) - have], one[have:])
        have += step if step == have else 1
    return rank


def windows_not_first(texts: list[bytes], length: int, anchor: np.ndarray, block: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of each window of the given length that an earlier text of the list holds too, by their transform.

    anchor: the place in each text of the k-gram that all its windows hold, equal windows at equal distances. Symbols are
    counted from it, and those that hold the k-gram's first bytes are one symbol.
    """
    step, none = symbol_bytes(length), np.zeros(0, np.int64)
    core = -(-GRAM // step)
    size = np.array([len(x) for x in texts], np.int64)
    if not len(texts) or size.max() < length:
        return none, none
    joined = b"".join(texts)
    rank = byte_ranks(np.frombuffer(joined, np.uint8), step)
    offsets = np.cumsum(size) - size
    # a document for each text and alignment that has a window
    text, phase = np.repeat(np.arange(len(texts)), step), np.tile(np.arange(step), len(texts))
    start = (anchor[text] + phase) % step
    keep = size[text] >= start + length
    text, start = text[keep], start[keep]
    count = (size[text] - start) // step
    held = (anchor[text] - start) // step  # symbols before the core
    begin = offsets[text] + start
    cores: dict[bytes, int] = {}
    named = np.array([cores.setdefault(joined[i : i + core * step], len(cores)) for i in (begin + held * step).tolist()]) + int(rank.max()) + 2
    size = count - core + 1
    columns = np.zeros((int(size.max()) + 1, len(text)), np.uint32)
    for r in range(len(columns) - 1):
        own = np.flatnonzero(size > r)
        at = size[own] - 1 - r  # the symbol's place in its document
        after = at > held[own]
        columns[r, own] = np.where(at == held[own], named[own], rank[begin[own] + (at + after * (core - 1)) * step] + 1)
    built = Collection(columns, block)
    doc, left = built.repeats(length // step - core + 1, text)
    built.close()
    return text[doc], start[doc] + (size[doc] - left) * step


def _judged(length: int):
    """Contexts and windows, sorted by key -> what is not repeated: for a context with any such window, late (the starts in it that are to be covered); for a window, first (its start)."""
    names = ["doc_id", "_ord", "place", "late", "first"]

    def found(owners: list[tuple], late: list[bytes]) -> pa.RecordBatch:
        """owners: (doc_id, _ord, place, shift, hot)"""
        columns = [[o[i] for o in owners] for i in range(3)]
        columns += [[None if o[4] else x for o, x in zip(owners, late, strict=True)], [o[3] if o[4] else None for o in owners]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)], names=names)

    def judge(many: list[tuple[bytes, tuple]]) -> pa.RecordBatch:
        many.sort(key=lambda x: x[1])
        anchor = np.array([(o[2] >> 8 & 255) - o[3] for _, o in many])
        text, start = windows_not_first([c for c, _ in many], length, anchor)
        order = np.lexsort((start, text))
        text, start = text[order], start[order].astype(np.uint8)
        cut = np.searchsorted(text, np.arange(len(many) + 1)).tolist()
        kept = [i for i, (c, _) in enumerate(many) if cut[i + 1] - cut[i] <= len(c) - length]
        return found([many[i][1] for i in kept], [start[cut[i] : cut[i + 1]].tobytes() for i in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group, alone, many, held = None, {}, [], [], 0

        def close() -> None:
            nonlocal held
            if len(group) == 1:  # a hash with one context has nothing to share windows with
                alone.extend(group.values())
            else:
                many.extend(group.items())
                held += sum(map(len, group))

        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("doc_id", "_ord", "place", "shift", "_hot"))
            for key, context, owner in zip(batch.column("key").to_pylist(), batch.column("context").to_pylist(), zip(*columns, strict=True), strict=True):
                if key != last:
                    close()
                    last, group = key, {}
                    if held >= COLLECTION_BYTES:
                        yield judge(many)
                        many, held = [], 0
                if (known := group.get(context)) is None or owner < known:
                    group[context] = owner
            if alone:
                yield found(alone, [b""] * len(alone))
                alone = []
        close()
        if alone:
            yield found(alone, [b""] * len(alone))
        if many:
            yield judge(many)

    return run


# --- removal ------------------------------------------------------------------------------------------------------


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each item of a list column, and the items; null is empty."""
    return pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(column)


def removed_bytes(offsets: np.ndarray, places: pa.Array, owned: pa.Array, length: int) -> np.ndarray:
    """Which bytes of a batch of documents are covered: those of all windows of an anchor but the ones that are known to be first.

    Each window has one anchor, so the windows of different anchors of a document are different ones.
    """
    row, place = _flat(places)
    place = place.to_numpy(zero_copy_only=False)
    owner, known = _flat(owned)
    key, late, first = (known.field(i) for i in range(3))
    key = key.to_numpy(zero_copy_only=False)
    start = lambda r, x: offsets[r] + (x >> 16) - (x >> 8 & 255)
    whole = np.flatnonzero(late.is_valid().to_numpy(zero_copy_only=False))
    some = np.flatnonzero(first.is_valid().to_numpy(zero_copy_only=False))
    # anchors that are not judged window by window are covered whole
    open_ = ~np.isin(row << 44 | place, owner[whole] << 44 | key[whole])
    n = int(offsets[-1])
    change = np.bincount(start(row[open_], place[open_]), minlength=n + 1) - np.bincount(offsets[row[open_]] + (place[open_] >> 16) - (place[open_] & 255) + 1, minlength=n + 1)
    covered = np.cumsum(change) > 0
    covered[start(owner[some], key[some]) + pc.drop_null(first).to_numpy(zero_copy_only=False)] = False
    windows, ends = utf8(late.take(pa.array(whole)))
    covered[np.repeat(start(owner[whole], key[whole]), np.diff(ends)) + windows] = True
    at = np.flatnonzero(covered)
    change = np.zeros(n + length + 1, np.int32)
    change[at] = 1
    change[at + length] -= 1
    return np.cumsum(change[:n]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, rest (a struct of the other columns of docs), kept (binary; null for a null text), n_bytes, n_removed and n_spans of every row of docs."""
    if not GRAM < length < 128 + GRAM // 2:
        raise ValueError(f"length must be from {GRAM + 1} to {127 + GRAM // 2}")
    spark = docs.sparkSession
    own = docs.select(whole_id(docs, id_col).alias("_id"), docs[text_col].alias("text"), F.struct(*(docs[c] for c in docs.columns if c != text_col)).alias("rest"))
    keyed = with_ordinal(own, "_id", "text").select(F.coalesce("_id", F.lit((1 << 63) - 1)).alias("doc_id"), F.col("_ord").cast("bigint").alias("_ord"), "text", F.col("_id").isNull().alias("_none"), "rest")
    partitions = shuffle_partitions(spark)
    met = map_batches(keyed.select("doc_id", "_ord", "text"), _anchor_records(length, partitions * SPLIT), "bucket int, kind int, hashes binary, ids binary, ords binary, places binary")
    again = map_batches(met.repartition(partitions, "bucket").sortWithinPartitions("bucket"), _repeated_anchors(hot), "doc_id bigint, _ord bigint, place bigint")
    places = checkpointed(again.groupBy("doc_id", "_ord").agg(F.collect_list("place").alias("places")))
    marked = keyed.join(places, ["doc_id", "_ord"], "left")
    contexts = map_batches(marked, _contexts(length), "hash bigint, context binary, doc_id bigint, _ord bigint, place bigint")
    dealt = _split(contexts, places.filter("_ord = -1").select(F.col("doc_id").alias("hash")), length)
    first = map_batches(dealt.repartition(partitions, "key").sortWithinPartitions("key"), _judged(length), "doc_id bigint, _ord bigint, place bigint, late binary, first int")
    owned = first.groupBy("doc_id", "_ord").agg(F.collect_list(F.struct("place", "late", "first")).alias("owned"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), keyed.schema["rest"], T.StructField("kept", T.BinaryType()), *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = removed_bytes(offsets, batch.column("places"), batch.column("owned"), length)
            begins = out.copy()
            begins[1:] &= ~out[:-1]
            starts = offsets[:-1][np.diff(offsets) > 0]
            begins[starts] = out[starts]
            within = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
            size, removed, spans = np.diff(offsets), within(out), within(begins)
            left = np.concatenate(([0], np.cumsum(size - removed)))
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~out]))])
            kept = pc.if_else(batch.column("text").is_valid(), kept, pa.scalar(None, pa.large_binary())).cast(pa.binary())
            ids = pc.if_else(batch.column("_none"), pa.scalar(None, pa.int64()), batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, batch.column("rest"), kept, *(pa.array(x.astype(np.int64)) for x in (size, removed, spans))], names=schema.names)

    return map_batches(marked.join(owned, ["doc_id", "_ord"], "left"), cut, schema)
