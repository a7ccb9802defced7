"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, in numpy.

``repetition`` measures, for every whole text, how many of its characters lie inside n-grams (of words) or lines that
the text holds more than once, and judges the text by those shares. Rows are independent, so the job is one narrow pass
without a shuffle; a hot source or a group of copies changes nothing. Only text and the id column are read.

Defined results: a null or blank text has no words and fails the base rule (fewer than 20 words); a very long text is
measured whole; repeated rows are judged one by one; an id of any type, null too, is handed through; other columns, whatever
their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lakeweir.llm.common import BASE, BLOCK_BYTES, INVERSE, blocks, distinct_spans, map_batches, mix, powers, utf8, word_spans

#: Largest share of a text's word characters inside repeated n-grams, by n (the limits that Rae et al., 2021, publish).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of a text's lines, and of its characters, in lines that repeat an earlier line.
LINE_LIMIT, LINE_CHAR_LIMIT = 0.30, 0.20
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _chars(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more; which of those are not the first."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def _covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Positions inside any span of the given length."""
    depth = np.zeros(total + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + length, -1)
    return np.cumsum(depth[:-1]) > 0


class Rolling:
    """Rolling hashes of the n-grams of a block's words: prefix sums of powers give each one from the sums around it."""

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        self.words, self.owner = words, owner
        self.back = powers(INVERSE, len(words))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(words.astype(np.uint64) + BASE) * powers(BASE, len(words)), dtype=np.uint64)))

    def same(self, n: int, at: np.ndarray) -> np.ndarray:
        """A number for each n-gram that starts at the given words; equal ones in a text have equal numbers, and only they."""
        h = mix((self.sums[at + n] - self.sums[at]) * self.back[at]) + mix(self.owner[at].astype(np.uint64) + np.uint64(n))
        _, first, group = np.unique(h, return_index=True, return_inverse=True)
        own = at[first[group]]
        if (self.owner[own] == self.owner[at]).all() and all((self.words[own + j] == self.words[at + j]).all() for j in range(n)):
            return group
        # a hash that two n-grams share: told apart by their words
        return np.unique(np.stack([self.owner[at], *(self.words[at + j] for j in range(n))]), axis=1, return_inverse=True)[1].ravel()


def measure(data: np.ndarray, offsets: np.ndarray, ngrams: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The measures of each row of a block of UTF-8 texts."""
    n = len(offsets) - 1
    starts, ends, counts = word_spans(data, offsets)
    chars = _chars(data)
    owner = np.repeat(np.arange(n), counts)
    length = chars[ends] - chars[starts]
    by_row = lambda values: np.bincount(owner, values, n).astype(np.int64)
    out = {"n_words": counts, "word_chars": by_row(length)}
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    out["n_symbols"] = np.diff(symbols[offsets])

    rolling = Rolling(distinct_spans(data, starts, ends)[1], owner)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(owner))  # words from this one to the text's end
    live: dict[int, np.ndarray] = {}
    shortest = min(ngrams)
    for size in sorted({*ngrams, REPEAT_WINDOW}):
        # an n-gram occurs twice only where the next shorter one does
        at = np.flatnonzero(left >= size) if size == shortest else (held := live[max(live)])[left[held] >= size]
        twice, _ = _repeated(rolling.same(size, at))
        live[size] = at[twice]
        out[f"chars_{size}"] = by_row(length * _covered(at[twice], size, len(owner)))
        if size == REPEAT_WINDOW:
            out["n_repeat_words"] = by_row(_covered(at[twice], size, len(owner)))

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate((offsets[:-1][np.diff(offsets) > 0], breaks[~np.isin(breaks + 1, offsets)] + 1)))
    row = np.searchsorted(offsets, line_starts, side="right") - 1
    line_ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)], offsets[row + 1])
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, row = line_starts[worded], line_ends[worded], row[worded]
    _, later = _repeated(distinct_spans(data, line_starts, line_ends)[1] * n + row)
    count = lambda keep, values=None: np.bincount(row[keep], None if values is None else values[keep], n).astype(np.int64)
    out["n_lines"] = count(slice(None))
    out["n_dup_lines"] = count(later)
    size = chars[line_ends] - chars[line_starts]
    out["line_chars"], out["dup_line_chars"] = count(slice(None), size), count(later, size)
    return out


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, line_char_limit: float = LINE_CHAR_LIMIT) -> DataFrame:
    """One row per row of docs: id, base measures, shares inside repeated n-grams and lines, base_failed and kept."""
    limits = dict(ngram_limits or NGRAM_LIMITS)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    shares = [f"share_{n}" for n in sorted(limits)] + ["line_share", "line_char_share"]
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in longs), *(T.StructField(x, T.DoubleType()) for x in shares), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in blocks(np.diff(offsets), BLOCK_BYTES):
                m = measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tuple(limits))
                word_chars = np.maximum(m["word_chars"], 1)
                share = {f"share_{n}": m[f"chars_{n}"] / word_chars for n in limits}
                share["line_share"] = m["n_dup_lines"] / np.maximum(m["n_lines"], 1)
                share["line_char_share"] = m["dup_line_chars"] / np.maximum(m["line_chars"], 1)
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
                bad = (share["line_share"] > line_limit) | (share["line_char_share"] > line_char_limit)
                for n, most in limits.items():
                    bad |= share[f"share_{n}"] > most
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(m[x].astype(np.int64)) for x in longs), *(pa.array(share[x].astype(np.float64)) for x in shares), pa.array(failed), pa.array(~failed & ~bad)], names=schema.names)

    return map_batches(source, run, schema)
