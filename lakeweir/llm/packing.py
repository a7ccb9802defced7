"""Hierarchical multi-length packing of token ids into windows of a few context sizes.

A document (its ids and an end id) longer than the longest window is cut into full windows first. What is left is routed to
the smallest tier that holds it. Each tier lays its documents end to end and closes a window when it is full, cutting the
document at the border, so all of a tier's windows but the last are full. At a task's end the open windows of the tiers
are emptied into the gaps of the longest one, then of the next; only the last rest of a task is padded. Windows of a tier
are put into step groups of equal token counts.

One narrow pass: a task packs the documents that it reads, in bounded memory (the open window of each tier and one
document), so a hot source needs no care. Window numbers carry the task's number; a task that is run again makes a whole
new set of its own windows.

Defined results: a null or blank text is the end id alone; repeated rows are packed each; an id of any type, null too, is
handed through; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lakeweir.llm.common import map_batches
from lakeweir.llm.tokens import encode_parts, slices

TIERS, STEP_TOKENS, END_ID = (256, 512, 1024, 2048), 16_384, 1


class Packer:
    """Windows of one task. A piece: (document's row, start, ids); emit(tier, pieces) is called for each closed window."""

    def __init__(self, tiers: tuple[int, ...], emit):
        self.tiers, self.emit = sorted(tiers), emit
        self.open: dict[int, list] = {t: [] for t in self.tiers}
        self.room = {t: t for t in self.tiers}

    def add(self, doc, ids: np.ndarray, start: int = 0) -> None:
        longest = self.tiers[-1]
        while len(ids) - start >= longest:
            self.emit(longest, [(doc, start, ids[start : start + longest])])
            start += longest
        if start < len(ids):
            tier = next(t for t in self.tiers if len(ids) - start <= t)
            self.fill(tier, doc, ids, start)

    def fill(self, tier: int, doc, ids: np.ndarray, start: int) -> None:
        while start < len(ids):
            take = min(self.room[tier], len(ids) - start)
            self.open[tier].append((doc, start, ids[start : start + take]))
            self.room[tier] -= take
            start += take
            if not self.room[tier]:
                self.close(tier)

    def close(self, tier: int) -> None:
        if self.open[tier]:
            self.emit(tier, self.open[tier])
        self.open[tier], self.room[tier] = [], tier

    def finish(self) -> None:
        """Empties the open windows into as few as can be: gaps of longer windows are filled from shorter tiers."""
        rest = [x for t in reversed(self.tiers) for x in self.open[t]]
        total = sum(len(x[2]) for x in rest)
        for t in self.tiers:
            self.open[t], self.room[t] = [], t
        for t in reversed(self.tiers):
            while total >= t or total and t == self.tiers[0]:
                window, room = [], t if total >= t else total
                total -= room
                while room:
                    doc, start, ids = rest.pop(0)
                    window.append((doc, start, ids[:room]))
                    if len(ids) > room:
                        rest.insert(0, (doc, start + room, ids[room:]))
                    room -= len(window[-1][2])
                self.emit(t, window)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id (and ids)."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id")
    fields = [source.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in names)]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    key_type = to_arrow_type(source.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        windows, used = 0, dict.fromkeys(tiers, 0)

        def emit(tier: int, pieces: list) -> None:
            nonlocal windows
            offset = 0
            step = base | used[tier] * tier // step_tokens * len(tiers) + tiers.index(tier)
            used[tier] += 1
            for (key, tokens), start, ids in pieces:
                data = np.ascontiguousarray(ids, "<u4")
                rows.append((key, start, len(data), zlib.crc32(data), tokens, base | windows, offset, tier, step, *([data.astype(np.int32)] if with_ids else [])))
                offset += len(data)
            windows += 1

        def out() -> pa.RecordBatch:
            kinds = [key_type, *[pa.int64()] * len(names), *([pa.list_(pa.int32())] if with_ids else [])]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=[f.name for f in fields])
            rows.clear()
            return made

        packer = Packer(tiers, emit)
        for batch in batches:
            for keys, texts in slices(batch):
                for key, parts in zip(keys.to_pylist(), encode_parts(texts, vocabulary), strict=True):
                    ids = np.concatenate([*parts, np.array([end_id], np.uint32)])
                    packer.add((key, len(ids)), ids)
                if rows:
                    yield out()
        packer.finish()
        if rows:
            yield out()

    return map_batches(source, run, T.StructType(fields))
