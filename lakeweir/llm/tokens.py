"""Token ids of whole texts, as the public tokenizers give them, without encoding the same word twice.

``encode_decode`` (byte-level vocabulary) joins a long text's halves as a tree: leaves are encoded on their own, then a
window round each join is encoded again and grows until its ids agree with both sides. ``count_tokens`` (word-end
vocabulary) encodes overlapping chunks of a long text with offsets, splices them at a stable common boundary and widens
the overlap where alignment fails. Both are narrow passes over whole texts, one text at a time in memory; only the leaves
of texts above LONG_BYTES are dealt to other tasks, to be encoded in parallel.

Ordinary text is cut into its pre-tokens in numpy; each block's distinct pre-tokens are looked up in a per-worker table
of bounded size, and the tokenizers library encodes those it lacks. Text with anything less ordinary (apostrophes, special
strings, rare characters, runs of white space) goes to the library as it is.

Defined results: null is encoded as empty text (no ids); repeated rows are encoded each; an id of any type, null too, is
handed through; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweir.llm.common import blocks, distinct_spans, map_batches, shuffle_partitions

#: Entries of a worker's table of encoded pre-tokens; it is emptied when full, so its memory is bounded.
TABLE_ENTRIES = 600_000
#: Characters of a leaf, and bytes beyond which a text's leaves are encoded by many tasks.
LEAF_CHARS, LONG_BYTES = 8_192, 1 << 16
WINDOW_TOKENS, AGREE_TOKENS = 32, 8
CHUNK_CHARS, OVERLAP_CHARS, CHUNKS_AT_ONCE = 16_384, 64, 64

#: Kinds of an ordinary text's bytes: 0 white space, 1 letter (bytes of non-ASCII letters too), 2 digit, 3 mark.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, 0x0A]] = 0
_KIND[0x80:] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_ORDINARY = bytes(x for x in [10, *range(32, 127)] if chr(x) != "'")
_LOOSE_SPACE = (b"  ", b"\n\n", b" \n", b"\n ")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The worker's tokenizer; one thread, as Spark runs a worker for each core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


class Encoder:
    """Ids of whole texts. ``spaced``: the vocabulary keeps a space with the word after it; else it drops white space."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.spaced = self.tokenizer.normalizer is None
        self.forget()

    def forget(self) -> None:
        self.place, self.starts, self.sizes, self.flat = {}, array("q"), array("q"), array("I")

    def learn(self, new: list[bytes]) -> None:
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for run, found in zip(part, self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False), strict=True):
                ids = found.ids
                self.place[run] = len(self.starts)
                self.starts.append(len(self.flat))
                self.sizes.append(len(ids))
                self.flat.extend(ids)

    def ordinary(self, text: str) -> bytes | None:
        """The bytes of a text that can be cut by the kind of its bytes, else None."""
        data = text.encode()
        rest = data.translate(None, _ORDINARY)
        if rest and not (rare := rest.decode()).isalpha() or b"<|" in data:
            return None
        if self.spaced:
            return None if data[-1:].isspace() or any(x in data for x in _LOOSE_SPACE) else data
        if rest and (max(rare) > "\u024f" or "\u0130" in rare):  # lower-casing and composing may need the library's order
            return None
        return text.lower().encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        held = [self.ordinary(x) for x in texts]
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        odd = [i for i, x in enumerate(held) if x is None]
        for i, found in zip(odd, self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False) if odd else [], strict=True):
            out[i] = np.array(found.ids, np.uint32)
        plain = [i for i, x in enumerate(held) if x is not None]
        for a, b in blocks(np.array([len(held[i]) for i in plain], np.int64)):
            for i, ids in zip(plain[a:b], self._block([held[i] for i in plain[a:b]]), strict=True):
                out[i] = ids
        return out

    def _block(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b"".join(texts)
        data, offsets = np.frombuffer(joined, np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts])))
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(texts)
        kind = _KIND[data]
        fresh = np.ones(len(data), bool)
        fresh[1:] = kind[1:] != kind[:-1]
        if self.spaced:
            fresh[1:] &= data[:-1] != 0x20
        else:
            fresh |= kind == 2
        fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(data))
        if not self.spaced:
            worded = kind[starts] != 0
            starts, ends = starts[worded], ends[worded]
        first, which = distinct_spans(data, starts, ends)
        distinct = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        new = [x for x in distinct if x not in self.place]
        if len(self.place) + len(new) > TABLE_ENTRIES:
            self.forget()
            new = distinct
        self.learn(new)
        place = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[which]
        size = np.frombuffer(self.sizes, np.int64)[place] if len(place) else np.zeros(0, np.int64)
        done = np.concatenate(([0], np.cumsum(size)))
        ids = np.frombuffer(self.flat, np.uint32)[np.repeat(np.frombuffer(self.starts, np.int64)[place] - done[:-1], size) + np.arange(done[-1])] if done[-1] else np.zeros(0, np.uint32)
        return np.split(ids, done[np.searchsorted(starts, offsets[1:-1])])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def byte_table(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    as_char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
    loaded = tokenizer(path)
    added = {i: t.content.encode() for i, t in loaded.get_added_tokens_decoder().items()}
    vocabulary = loaded.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = added[i] if i in added else bytes(as_char[c] for c in token)
    return out


def decode(ids: list[int], path: str) -> str:
    return b"".join(map(byte_table(path).__getitem__, ids)).decode("utf-8", "replace")


# --- tree concatenation -------------------------------------------------------------------------------------------


def _whole(data: bytes) -> bool:
    """Whether data starts and ends between characters."""
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def join_halves(left: list[int], right: list[int], encode: Callable[[str], list[int]], table: list[bytes], window: int = WINDOW_TOKENS, agree: int = AGREE_TOKENS) -> list[int]:
    """The ids of two neighbouring texts joined, from the ids of each.

    A window of tokens on both sides of the join is encoded anew. It is accepted once its first and last ``agree`` ids
    (or those up to the text's end) are the ones that stood there, as then all pairs of neighbours are ones that the
    vocabulary itself makes; else it grows, at the most to the whole text, where it is exact by definition.
    """
    while True:
        a, b = max(0, len(left) - window), min(len(right), window)
        before, after = left[a:], right[:b]
        data = b"".join(map(table.__getitem__, before)) + b"".join(map(table.__getitem__, after))
        whole = a == 0 and b == len(right)
        if whole or _whole(data):
            found = encode(data.decode())
            head = a == 0 or found[:agree] == before[:agree] and len(before) > agree
            tail = b == len(right) or found[-agree:] == after[-agree:] and len(after) > agree
            if whole or head and tail and len(found) >= 2 * agree:
                return left[:a] + found + right[b:]
        window *= 2


def leaves(text: str, size: int, special: re.Pattern | None) -> list[str]:
    """text halved until no part is longer than size; a special token's text is never cut."""
    todo, out = [text], []
    while todo:
        part = todo.pop()
        if len(part) <= size:
            out.append(part)
            continue
        cut = len(part) // 2
        if special:
            for m in special.finditer(part, max(0, cut - 64), min(len(part), cut + 64)):
                if m.start() < cut < m.end():
                    cut = m.end() if m.end() < len(part) else m.start()
        if not 0 < cut < len(part):
            out.append(part)
            continue
        todo += [part[cut:], part[:cut]]
    return out


@lru_cache(maxsize=2)
def special_pattern(path: str) -> re.Pattern | None:
    names = sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, names))) if names else None


def join_tree(level: list[list[int]], path: str) -> list[int]:
    """The ids of a text from those of its leaves: neighbours are joined, level by level."""
    encode = lambda text: tokenizer(path).encode(text, add_special_tokens=False).ids
    while len(level) > 1:
        level = [join_halves(level[i], level[i + 1], encode, byte_table(path)) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def encode_tree(texts: list[str], path: str, leaf_chars: int = LEAF_CHARS) -> list[list[int]]:
    """The ids of each text: the leaves of all of them in one pass, then joins level by level."""
    parts = [leaves(x, leaf_chars, special_pattern(path)) if len(x) > leaf_chars else [x] for x in texts]
    done = iter(encoder(path).encode([x for own in parts for x in own]))
    return [join_tree([next(done).tolist() for _ in own], path) for own in parts]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """id, ids (array of int) and decoded (text) of every row."""
    return _codec(docs, vocabulary, id_col, text_col, leaf_chars, long_bytes, False)


def encode_digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """id, n_tokens and SHA-256 digests of the ids and of the decoded text of every row."""
    return _codec(docs, vocabulary, id_col, text_col, leaf_chars, long_bytes, True)


def _codec(docs: DataFrame, path: str, id_col: str, text_col: str, leaf_chars: int, long_bytes: int, digest: bool) -> DataFrame:
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digest else [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    schema = T.StructType([source.schema["doc_id"], *made])
    is_long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in slices(batch):
                yield _result(keys, encode_tree(texts, path, leaf_chars), path, digest, schema.names)

    # the leaves of long texts are dealt to all tasks and encoded there; a text's leaves meet again to be joined
    rows = source.filter(is_long).select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    names = ["_row", "doc_id", "at", "part"]
    leaf_schema = T.StructType([rows.schema["_row"], rows.schema["doc_id"], T.StructField("at", T.IntegerType()), T.StructField("part", T.StringType())])
    coded_schema = T.StructType([*leaf_schema.fields[:3], T.StructField("part", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                parts = leaves(text, leaf_chars, special_pattern(path))
                again = pa.array([i] * len(parts))
                yield pa.RecordBatch.from_arrays([batch.column("_row").take(again), batch.column("doc_id").take(again), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.astype(np.uint32).tobytes() for x in encoder(path).encode(batch.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:3]), pa.array(ids, pa.binary())], names=names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, key, level = None, None, []
        close = lambda: _result(key, [join_tree(level, path)], path, digest, schema.names)
        for batch in batches:
            for i, (found, part) in enumerate(zip(batch.column("_row").to_pylist(), batch.column("part").to_pylist(), strict=True)):
                if found != row:
                    if level:
                        yield close()
                    row, key, level = found, batch.column("doc_id").slice(i, 1), []
                level.append(np.frombuffer(part, np.uint32).tolist())
        if level:
            yield close()

    partitions = shuffle_partitions(docs.sparkSession)
    coded = map_batches(map_batches(rows, cut, leaf_schema).repartition(partitions, "_row", "at"), encode, coded_schema)
    joined = map_batches(coded.repartition(partitions, "_row").sortWithinPartitions("_row", "at"), join, schema)
    return map_batches(source.filter(~is_long), short, schema).unionAll(joined)


def _result(keys: pa.Array, ids: list[list[int]], path: str, digest: bool, names: list[str]) -> pa.RecordBatch:
    if not digest:
        return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32())), pa.array([decode(x, path) for x in ids], pa.string())], names=names)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    numbers = id_texts(path)
    return pa.RecordBatch.from_arrays([keys, pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(",".join(map(numbers.__getitem__, x)).encode()) for x in ids], pa.string()), pa.array([sha(decode(x, path).encode()) for x in ids], pa.string())], names=names)


@lru_cache(maxsize=2)
def id_texts(path: str) -> list[str]:
    return list(map(str, range(len(byte_table(path)))))


def slices(batch: pa.RecordBatch, limit: int = 4_000_000) -> Iterator[tuple[pa.Array, list[str]]]:
    texts = batch.column("text").to_pylist()
    start, held = 0, 0
    for i, x in enumerate(texts):
        if i > start and held + len(x or "") > limit:
            yield batch.column("doc_id").slice(start, i - start), [t or "" for t in texts[start:i]]
            start, held = i, 0
        held += len(x or "")
    yield batch.column("doc_id").slice(start), [t or "" for t in texts[start:]]


# --- overlap resynchronisation ------------------------------------------------------------------------------------


#: A space or line feed before a letter, digit or ASCII mark.
_BREAK = re.compile(r"[ \n](?=[!-~]|[^\W_])")


class Piece(NamedTuple):
    """A stretch of a text with its ids and the offsets in the text at which their tokens start."""

    begin: int
    end: int
    ids: np.ndarray
    starts: np.ndarray

    def since(self, x: int) -> Piece:
        at = int(np.searchsorted(self.starts, x))
        return Piece(x, self.end, self.ids[at:], self.starts[at:])

    def until(self, x: int) -> np.ndarray:
        return self.ids[: int(np.searchsorted(self.starts, x))]


def pieces(text: str, spans: list[tuple[int, int]], loaded) -> list[Piece]:
    found = loaded.encode_batch([text[a:b] for a, b in spans], add_special_tokens=False)
    return [Piece(a, b, np.array(x.ids, np.uint32), np.array([o for o, _ in x.offsets], np.int64) + a) for (a, b), x in zip(spans, found, strict=True)]


def breaks(text: str, a: int, b: int) -> list[int]:
    """Offsets x, a < x < b, that follow a break; the vocabulary's normaliser and pre-tokenizer look at nothing across them."""
    return [m.end() for m in _BREAK.finditer(text, a, b) if m.end() < b]


def stable_boundary(text: str, left: Piece, right: Piece) -> int | None:
    """The first break in the overlap of two pieces at which tokens start in both, if all to the overlap's last are the same."""
    found = breaks(text, right.begin, left.end)
    last = left.end if left.end == len(text) else found[-1] if found else 0
    for x in found:
        (a, b), (c, d) = (np.searchsorted(p.starts, (x, last)) for p in (left, right))
        if a < b and left.starts[a] == x and np.array_equal(left.ids[a:b], right.ids[c:d]) and np.array_equal(left.starts[a:b], right.starts[c:d]):
            return x
    return None


def resynchronised(text: str, loaded, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[np.ndarray]:
    """The ids of a long text, as those of overlapping chunks spliced at stable boundaries.

    Where two chunks have none, their overlap doubles and both are encoded again. Once it covers a chunk they become one,
    to be encoded when its own end is known, so that a long stretch without a break is encoded once.
    """
    spans = [(max(0, a - overlap), min(len(text), a + chunk + overlap)) for a in range(0, len(text), chunk)]
    left: Piece | None = None
    joined = False  # whether left is still to be encoded
    for i in range(0, len(spans), CHUNKS_AT_ONCE):
        for right in pieces(text, spans[i : i + CHUNKS_AT_ONCE], loaded):
            if left is None:
                left = right
                continue
            begin, end, border, width = left.begin, right.end, right.begin + overlap, overlap
            x = None if joined else stable_boundary(text, left, right)
            while x is None and width <= chunk:
                width *= 2 - joined
                a, b = max(begin, border - width), min(end, border + width)
                if breaks(text, a, b):
                    left, right = pieces(text, [(begin, b), (a, end)], loaded)
                    x = stable_boundary(text, left, right)
                joined = False
            joined = x is None
            if x is None:
                left = Piece(begin, end, left.ids[:0], left.starts[:0])
            else:
                yield left.until(x)
                left = right.since(x)
    if left is not None:
        yield pieces(text, [(left.begin, left.end)], loaded)[0].ids if joined else left.ids


def encode_spliced(texts: list[str], path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[list[np.ndarray]]:
    """The ids of each text, in parts; long ones by overlap resynchronisation."""
    done = iter(encoder(path).encode([x for x in texts if len(x) <= chunk]))
    return [[next(done)] if len(x) <= chunk else list(resynchronised(x, tokenizer(path), chunk, overlap)) for x in texts]


def split_at_breaks(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """A text cut at the first break after each size characters; the ids of the parts, joined, are those of the text."""
    out, start = [], 0
    while (m := _BREAK.search(text, start + size)) and m.end() < len(text):
        out.append(text[start : m.end()])
        start = m.end()
    return [*out, text[start:]]


def encode_parts(texts: list[str], path: str) -> list[list[np.ndarray]]:
    """The ids of each text (word-end vocabulary), in parts of bounded size."""
    parts = [split_at_breaks(x) for x in texts]
    done = iter(encoder(path).encode([x for own in parts for x in own]))
    return [[next(done) for _ in own] for own in parts]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """id, n_bytes and n_tokens of every row, special strings in texts handled as the library does by default."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in slices(batch):
                found = encode_spliced(texts, vocabulary, chunk, overlap)
                yield pa.RecordBatch.from_arrays([keys, pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array([sum(map(len, x)) for x in found], pa.int64())], names=schema.names)

    return map_batches(source, run, schema)
