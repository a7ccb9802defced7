"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text and their beginnings (hashed). Training swaps identity terms in the labelled
texts for other terms of their group and penalises the change of the score, so that naming a group does not count
against a text. Labelled texts need not name a group: each text also has a term put before one of its words, so that
every term is swapped and beginnings that a term shares with other words are held back too. A sparse penalty keeps the
model to words that matter, so length does not either.

Fitting takes a bounded sample of labelled rows (SAMPLE, by hash of the id) in one task; scoring is a narrow pass over
all texts with the weights (at most FEATURES numbers) sent to the tasks. Labels, lang, source and ids are no inputs.

Defined results: null is scored as empty text, by the intercept alone; without labelled rows of both classes every score
is the share of label 1, or 0; repeated rows are scored each; several labels of an id count as their largest; very long texts
are scored whole; other columns, whatever their names, are not read; an empty table of documents gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweir.llm.common import blocks, map_batches, mix, span_hashes, utf8

SAMPLE, FEATURES, PREFIXES = 8_000, 4_096, (4, 5, 6)
SPARSITY, FAIRNESS, ROUNDS = 0.0003, 0.1, 1_000
#: Identity terms by language and group; a term is swapped for the next of its group. Fixed values.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("women", "men"),
    ("immigrants", "citizens", "refugees"),
    ("disabled", "elderly", "young"),
    ("christen", "muslime", "juden", "hindus"),
    ("frauen", "männer"),
    ("ausländer", "einheimische", "flüchtlinge"),
    ("chrétiens", "musulmans", "juifs"),
    ("femmes", "hommes"),
    ("étrangers", "réfugiés"),
    ("cristianos", "musulmanes", "judíos"),
    ("mujeres", "hombres"),
    ("extranjeros", "refugiados"),
)
_SWAP = {t.encode(): g[(i + 1) % len(g)].encode() for g in IDENTITY_TERMS for i, t in enumerate(g)}
_TERMS = tuple(_SWAP)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _LETTER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | cut[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | cut[1:])) + 1 if len(data) else starts
    return starts, ends


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each word and beginning of a word of a block, repeats included."""
    data = _LOWER[data]
    starts, ends = _word_spans(data, offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    rows, found = [row], [span_hashes(data, starts, ends)]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        rows.append(row[long])
        found.append(mix(span_hashes(data, starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(found)


def swapped(text: bytes) -> bytes | None:
    """The text with each identity term replaced by the next of its group; None if it names none."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    starts, ends = _word_spans(data, np.array([0, len(data)]))
    lower, out, at = data.tobytes(), [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if (other := _SWAP.get(lower[a:b])) is not None:
            out += [lower[at:a], other]
            at = b
    return b"".join([*out, lower[at:]]) if out else None


def mentioned(text: bytes, term: bytes) -> tuple[bytes, bytes]:
    """The text with a term put before one of its words, by its hash, and the same with the next term of the group."""
    starts, _ = _word_spans(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    at = int(starts[xxhash.xxh3_64_intdigest(text) % len(starts)]) if len(starts) else len(text)
    return tuple(b"".join((text[:at], x, b" ", text[at:])) for x in (term, _SWAP[term]))


def counterfactuals(texts: list[bytes]) -> tuple[list[tuple[bytes, bytes]], np.ndarray]:
    """Pairs of texts that differ in identity terms, and their shares in the penalty.

    Texts that name terms are swapped. The terms are put into the texts in turn, each into one text at least. Each term
    put has a share of one, and the swapped texts have together as much as all of these.
    """
    named = [(x, y) for x, y in ((t, swapped(t)) for t in texts) if y is not None]
    turns = range(max(len(texts), len(_TERMS)) if texts else 0)
    put = [mentioned(texts[i % len(texts)], _TERMS[i % len(_TERMS)]) for i in turns]
    which = np.array(turns, np.int64) % len(_TERMS)
    return named + put, np.concatenate((np.full(len(named), len(_TERMS) / max(len(named), 1)), 1 / np.bincount(which, minlength=1)[which]))


def _sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) without repeats."""
    data, offsets = utf8(pa.array(texts, pa.large_binary()))
    rows, found = [], []
    for a, b in blocks(np.diff(offsets)):
        r, f = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        order = np.lexsort((f, r))
        r, f = r[order], f[order]
        keep = np.insert((r[1:] != r[:-1]) | (f[1:] != f[:-1]), 0, True) if len(r) else np.zeros(0, bool)
        rows.append(r[keep] + a)
        found.append(f[keep])
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def fit(texts: list[bytes], labels: np.ndarray, fairness: float = FAIRNESS) -> tuple[np.ndarray, np.ndarray, float]:
    """Features (sorted), their weights and the intercept; fairness is the strength of the penalty."""
    none = np.zeros(0, np.uint64), np.zeros(0)
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        return *none, 40.0 if len(labels) and ones else -40.0
    row, feature = _sets(texts)
    # the features whose presence tells the classes apart best
    names, which = np.unique(feature, return_inverse=True)
    a = np.bincount(which, labels[row], len(names))
    b = np.bincount(which, 1 - labels[row], len(names))
    n1, n0 = ones, len(labels) - ones
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))
    terms = np.unique(_sets([t for t in _SWAP])[1])
    z[a + b < 3] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    chosen = chosen[np.abs(z[chosen]) > 3]
    names = np.union1d(names[chosen], names[np.isin(names, terms)])
    if not len(names):
        return *none, float(np.log(n1 / n0))

    def placed(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(names, feature), len(names) - 1)
        keep = names[at] == feature
        return row[keep], at[keep]

    row, at = placed(row, feature)
    pairs, share = counterfactuals(texts)
    left, right = (placed(*_sets([p[k] for p in pairs])) for k in (0, 1))
    weight, bias, n = np.zeros(len(names)), float(np.log(n1 / n0)), len(labels)
    balance = np.where(labels == 1, n / (2 * n1), n / (2 * n0))

    def slope_of_change(w: np.ndarray) -> np.ndarray:
        """Slope of the penalty: the squared change of the score when identity terms are swapped, by the pairs' shares."""
        change = np.bincount(left[0], w[left[1]], len(pairs)) - np.bincount(right[0], w[right[1]], len(pairs))
        change *= 2 * fairness * share
        return np.bincount(left[1], change[left[0]], len(names)) - np.bincount(right[1], change[right[0]], len(names))

    # the step is bounded by the largest curvature, found by power iteration
    curved, top = np.ones(len(names) + 1) / np.sqrt(len(names) + 1), 1.0
    for _ in range(30):
        held = balance * (np.bincount(row, curved[at], n) + curved[-1]) / (4 * n)
        turned = np.append(np.bincount(at, held[row], len(names)) + slope_of_change(curved[:-1]), held.sum())
        top = float(np.linalg.norm(turned)) or 1.0
        curved = turned / top
    rate = 0.8 / top
    momentum, last = weight.copy(), weight.copy()
    for k in range(1, ROUNDS + 1):
        score = np.bincount(row, momentum[at], n) + bias
        error = balance * (1 / (1 + np.exp(-np.clip(score, -40, 40))) - labels) / n
        slope = np.bincount(at, error[row], len(names)) + slope_of_change(momentum)
        bias -= rate * error.sum()
        new = momentum - rate * slope
        last, weight = weight, np.sign(new) * np.maximum(np.abs(new) - rate * SPARSITY, 0)
        momentum = weight + (k - 1) / (k + 2) * (weight - last)
    keep = weight != 0
    return names[keep], weight[keep], bias


def score_block(data: np.ndarray, offsets: np.ndarray, names: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    n = len(offsets) - 1
    total = np.full(n, bias)
    if len(names) and len(data):
        row, feature = features(data, offsets)
        at = np.minimum(np.searchsorted(names, feature), len(names) - 1)
        hit = np.flatnonzero(names[at] == feature)
        pairs = np.unique(row[hit] * len(names) + at[hit])
        total += np.bincount(pairs // len(names), weight[pairs % len(names)], n)
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """The model from at most ``sample`` labelled rows whose crc32(id) mod 5 is not 0."""
    known = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)")
    known = known.filter(F.crc32(F.col("_id").cast("string")) % 5 != 0).groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += [(x or "").encode() for x in batch.column("_text").to_pylist()]
            marks += batch.column("_y").to_pylist()
        names, weight, bias = fit(texts, np.array(marks, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(names, np.uint64(0)).view(np.int64)), pa.array(np.append(weight, bias))], names=["name", "weight"])

    # one task for a sample of bounded size
    found = map_batches(rows.repartition(1).sortWithinPartitions("_id"), learn, "name bigint, weight double").collect()
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0), -40.0
    return np.array([r.name for r in found[:-1]], np.int64).view(np.uint64), np.array([r.weight for r in found[:-1]]), float(found[-1].weight)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and score of every row of docs."""
    names, weight, bias = train(docs, labels, id_col, text_col, sample)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return source.withColumn("score", scorer(names, weight, bias)("text"))


def scorer(names: np.ndarray, weight: np.ndarray, bias: float):
    """An Arrow function from text to score."""

    def run(text: pa.Array) -> pa.Array:
        data, offsets = utf8(text)
        parts = [score_block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], names, weight, bias) for a, b in blocks(np.diff(offsets))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.DoubleType())
