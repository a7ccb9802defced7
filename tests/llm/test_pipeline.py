"""The registered queries over whole tables, their types, and the corpus pipeline, against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import PAGE, corpus, groups, plain_fingerprint, plain_removal, words_of

from lakeweir.llm import lines, tokens
from lakeweir.llm.common import NULL_PARTS
from lakeweir.llm.queries import QUERIES

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
#: Names that the stages use for themselves.
CLASHING = {"_score": "s", "_ord": "o", "_key": "k", "_host": "h", "_kept": "p", "_bad": "b", "rest": "r", "_row": "w", "_n_lines": "n"}


def texts_of_all():
    texts = corpus(70, 9)
    texts[3] = "vileword " * 3 + (texts[3] or "")
    for i in range(0, 40, 4):  # toxic ones among the labelled
        texts[i] = f"{texts[i]} vileword nastything"
    shared = "footer of the site"
    return [t if t is None or i % 3 else f"{t}\n{shared}" for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base, texts = str(tmp_path_factory.mktemp("sf")), texts_of_all()
    rows = [(i, t, "en", f"s{i % 2}", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    docs.repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vileword" in (t or ""))) for i, t in enumerate(texts) if i % 2 == 0], "doc_id bigint, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    pages = [(i, f"u{i}", PAGE.format(n=i)) for i in range(12)] + [(50, None, None), (51, "u", PAGE.format(n=5)), (51, "u", PAGE.format(n=5))]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{base}/pages.parquet")
    rng = np.random.default_rng(5)
    spark.createDataFrame([(i, (rng.normal(size=8) if i % 3 else np.ones(8)).tolist(), i % 2) for i in range(40)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{base}/embeddings.parquet")
    return base


def fetched(spark, folder, name, key):
    frame = QUERIES[name](spark, folder)
    rows = frame.collect()
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: r for r in rows}, dict(frame.dtypes)


def of(kinds, names):
    return {n: kinds[n] for n in names.split()}


def test_op1(spark, folder):
    got, kinds = fetched(spark, folder, "op1_quality_rules", "doc_id")
    assert set(of(kinds, "n_words word_chars n_symbols n_dup_lines n_repeat_words").values()) == {"bigint"} and kinds["base_failed"] == kinds["kept"] == "boolean"
    for i, text in enumerate(texts_of_all()):
        w = words_of(text)
        grams = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        inside = {j + k for j in range(len(w) - 7) if grams[tuple(w[j : j + 8])] > 1 for k in range(8)}
        seen = [x for x in (text or "").split("\n") if words_of(x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_dup_lines, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(seen) - len(set(seen)), len(inside))
        assert got[i].base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and not (got[i].base_failed and got[i].kept)


def test_op3(spark, folder):
    got, kinds = fetched(spark, folder, "op3_simhash_dedup", "doc_id")
    assert of(kinds, "fingerprint component_id") == {"fingerprint": "string", "component_id": "bigint"}
    prints = [plain_fingerprint(t, 3) for t in texts_of_all()]
    assert [got[i].fingerprint for i in range(len(prints))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(prints))] == groups(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)


def test_op4(spark, folder):
    got, kinds = fetched(spark, folder, "op4_suffix_dedup", "doc_id")
    assert of(kinds, "n_bytes n_removed n_spans kept_sha256") == {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    for i, (data, gone) in enumerate(plain_removal(texts_of_all(), 100)):
        kept, spans = bytes(np.frombuffer(data, np.uint8)[~gone]), len(re.findall(b"\x01+", gone.astype(np.uint8).tobytes()))
        assert tuple(got[i][x] for x in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op5(spark, folder):
    got, kinds = fetched(spark, folder, "op5_embedding_dedup", "vec_id")
    assert of(kinds, "n_links component_id kept") == {"n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    alike = [i for i in range(40) if i % 3 == 0]
    for i in range(40):
        same = [j for j in alike if j % 2 == i % 2] if i in alike else [i]
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(same) - 1, same[0], i == same[0])


def test_op6_op7(spark, folder):
    codec, kinds = fetched(spark, folder, "op6_bpe_codec", "doc_id")
    assert of(kinds, "n_tokens ids_sha256 decoded_sha256") == {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    counts, kinds = fetched(spark, folder, "op7_token_counts", "doc_id")
    assert of(kinds, "n_bytes n_tokens over_limit") == {"n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    for i, text in enumerate(texts_of_all()):
        ids = tokens.tokenizer(BYTE).encode(text or "", add_special_tokens=False).ids
        decoded = tokens.tokenizer(BYTE).decode(ids, skip_special_tokens=False)
        assert (codec[i].n_tokens, codec[i].ids_sha256, codec[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        n = len(tokens.tokenizer(WORD).encode(text or "", add_special_tokens=False).ids)
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len((text or "").encode()), n, n > 2048)


def test_op8(spark, folder):
    got, kinds = fetched(spark, folder, "op8_toxicity", "doc_id")
    assert of(kinds, "held_out score predicted") == {"held_out": "boolean", "score": "double", "predicted": "int"}
    for i in range(len(texts_of_all())):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5)


def test_op9(spark, folder):
    frame = QUERIES["op9_html_text"](spark, folder)
    assert frame.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    rows = frame.collect()
    assert len(rows) == 15 and all(r.n_chars == len(r.text) for r in rows)
    assert sum(r.page_id == 51 and r.text.startswith("Title 5 First paragraph") for r in rows) == 2 and next(r for r in rows if r.page_id == 50).text == ""


def check_packed(rows, texts):
    """rows: pieces; texts: by doc_id."""
    library, found, windows = tokens.tokenizer(WORD), {}, {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert found.keys() == texts.keys()
    for key, own in found.items():
        own.sort(key=lambda r: r.start)
        ids = np.array([*library.encode(texts[key] or "", add_special_tokens=False).ids, 1], "<u4")
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 2048


def test_op10(spark, folder):
    frame = QUERIES["op10_packing"](spark, folder)
    assert set(of(dict(frame.dtypes), "doc_id start length ids_crc32 doc_tokens sequence_id offset").values()) == {"bigint"}
    check_packed(frame.collect(), dict(enumerate(texts_of_all())))


@pytest.mark.parametrize("kind", ["smallint", "int", "string"])
def test_id_types(spark, folder, kind):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast(kind)).limit(8)
    from lakeweir.llm import packing, quality, simhash

    assert dict(packing.pack(docs, WORD).dtypes)["doc_id"] == kind and packing.pack(docs, WORD).count() >= 8
    assert tokens.encode_digest(docs, BYTE, long_bytes=50).count() == quality.repetition(docs).count() == 8
    if kind == "string":
        with pytest.raises(TypeError, match="integer"):
            simhash.near_duplicates(docs)
    else:
        assert simhash.near_duplicates(docs).count() == 8


# --- the pipeline -------------------------------------------------------------------------------------------------


def plain_lines(rows):
    """rows: (doc_id, text, source)"""
    pages = Counter(s for _, _, s in rows)
    holds = Counter((s, x) for _, t, s in rows for x in set((t or "").split("\n")) if x.strip())
    out = []
    for i, t, s in rows:
        bad = {x for (h, x), n in holds.items() if h == s and n >= lines.MIN_PAGES and n > lines.RATIO * pages[s]}
        out.append((i, None if t is None else "\n".join(x for x in t.split("\n") if x not in bad), s))
    return out


def ordered(rows):
    """Rows by id, those of one id by text; then those without an id, dealt to parts by a hash of the text and numbered there."""
    by_text = lambda r: (r[1] is not None, r[1] or "")
    parts = {}
    for r in sorted((r for r in rows if r[0] is None), key=by_text):
        part = 42 % NULL_PARTS if r[1] is None else xxhash.xxh64_intdigest(r[1].encode(), 42) % NULL_PARTS
        parts.setdefault(part, []).append(r)
    last = sorted(((k * NULL_PARTS + part, r) for part, own in parts.items() for k, r in enumerate(own)), key=lambda x: x[0])
    return sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], *by_text(r))) + [r for _, r in last]


def plain_copies(rows):
    def shingles(text):
        w = words_of(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    order = ordered(rows)
    sets = [shingles(r[1]) for r in order]
    near = lambda a, b: not (a | b) or len(a & b) / len(a | b) >= 0.8
    root = groups(len(order), lambda i, j: near(sets[i], sets[j]))
    return [r for i, r in enumerate(order) if root[i] == i]


def plain_repeats(rows):
    order = ordered(rows)
    cut = plain_removal([r[1] for r in order], 100)
    return [(i, None if t is None else bytes(np.frombuffer(data, np.uint8)[~gone]).decode("utf-8", "ignore"), s) for (i, t, s), (data, gone) in zip(order, cut, strict=True)]


def rows_of(frame):
    return sorted(((r.doc_id, r.text, r.source) for r in frame.collect()), key=str)


def test_stages(spark, folder):
    """Each stage on its own, on all documents and on rows with null and repeated ids, and what it keeps of other columns."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sources = {r.doc_id: r.source for r in docs.collect()}
    rows = [(i, t, sources[i]) for i, t in enumerate(texts_of_all())]
    odd = docs.filter("doc_id < 20").withColumn("doc_id", F.when(F.col("doc_id") < 8, F.lit(5)).when(F.col("doc_id") < 15, F.col("doc_id")))
    odd_rows = [(5 if i < 8 else i if i < 15 else None, t, s) for i, t, s in rows[:20]]
    stages = dict(corpus_pipeline.STAGES)
    toxic = {r.doc_id for r in QUERIES["op8_toxicity"](spark, folder).collect() if r.predicted}
    assert toxic and rows_of(stages["toxicity"](spark, docs, folder)) == sorted((r for r in rows if r[0] not in toxic), key=str)
    for name, plain in (("line dedup", plain_lines), ("SimHash near-dedup", plain_copies), ("suffix-array dedup", plain_repeats)):
        for frame, held in ((docs, rows), (odd, odd_rows)):
            got = stages[name](spark, frame, folder)
            assert got.columns == docs.columns, name
            assert rows_of(got) == sorted(plain(held), key=str), name
            first = got.first()
            assert {k: first[k] for k in CLASHING} == CLASHING
            assert all((r.text is None) or r.n_chars == len(r.text) for r in got.collect()), name
    check_packed(stages["packing"](spark, docs, folder).collect(), dict(enumerate(texts_of_all())))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r.doc_id for r in QUERIES["op8_toxicity"](spark, folder).collect() if r.predicted}
    left = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id not in toxic]
    for plain in (plain_lines, plain_copies, plain_repeats):
        left = plain(left)
    check_packed(corpus_pipeline.run(spark, folder).collect(), {i: t for i, t, _ in left})


def test_stage_on_nothing_but_nulls(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(3).withColumn("text", F.lit(None).cast("string"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == (1 if name == "SimHash near-dedup" else 3)
