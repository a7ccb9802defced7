"""Ranked search, conversation repair and source mixing against brute force: nulls, ties, repeats, empty tables, long texts, clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import public_tokenizers
import pytest
from test_operators import corpus, words_of

from lakeweir.llm import html, mixing, quality, queries, repair, search, tokens

# --- ranked search --------------------------------------------------------------------------------------------------


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_ranks(docs, items, k=20):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total, df = len(counts), sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 75 + (25 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def lexical(spark):
    texts = corpus(150, 4) + ["Alpha,BETA;gamma_alpha\x00Éa éa İI", "x1 X1 x-1", "alpha " * 5000, *["same words here"] * 30]
    docs = [(i // 2 if i > 170 else i, t) for i, t in enumerate(texts)] + [(None, "same words here"), (None, "beta")]
    items = [(1, texts[5]), (2, texts[8][:60] + " alpha Alpha beta"), (2, "same"), (3, None), (4, ""), (5, "…—!"), (None, "beta gamma x1"), (7, "éa İi nowhere"), (8, " ".join(texts[k] or "" for k in range(9))), (2, "same")]
    frame = spark.createDataFrame([(i, t, "z", 1) for i, t in docs], "doc_id bigint, text string, score string, rank int").repartition(5)
    return docs, items, frame, spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("segment", [7, 4096])
def test_search(spark, segment):
    docs, items, frame, asked = lexical(spark)
    got = search.search(frame, asked, segment=segment)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranks(docs, items)


def test_search_in_blocks_of_items(spark, monkeypatch):
    docs, items, frame, asked = lexical(spark)
    monkeypatch.setattr(search, "ITEM_BYTES", 2_000)
    assert sorted(map(tuple, search.search(frame, asked, k=5).collect()), key=str) == plain_ranks(docs, items, 5)


def test_search_empty(spark):
    _, _, frame, asked = lexical(spark)
    assert search.search(frame.limit(0), asked).count() == 0
    assert search.search(frame, asked.limit(0)).count() == 0
    assert search.search(frame.filter("text IS NULL"), asked).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(search, "SLICE", 10)
    text = " ".join(random.Random(2).choices(["a", "bcd", "é" * 30, "Longer", "..", "x" * 50], k=400))
    assert search.term_counts(text.encode()) == Counter(t.encode() for t in terms_of(text))


def test_masks():
    """Documents have the mask of the terms whose bitmaps hold them, also beyond 64 terms."""
    import numpy as np

    rng = np.random.default_rng(1)
    for m in (1, 8, 9, 64, 65, 130):
        held = rng.random((m, 37)) < 0.3
        words = search.masks(np.packbits(held, axis=1), 37)
        assert [[int(words[d, t // 64]) >> (t % 64) & 1 for t in range(m)] for d in range(37)] == held.T.astype(int).tolist()
        found, group = search.grouped(words)
        assert (found[group] == words).all() and len(found) == len({tuple(w) for w in words.tolist()})


# --- conversation repair --------------------------------------------------------------------------------------------

BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kind = "blank" if not text.strip(BLANKS) else "duplicate" if (role, text) in seen else "" if text.rstrip(BLANKS)[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(kind)
    return out


def suffixes(rows, kinds):
    """Least (cost, edits, rows given) by rows left and state, from the end; whole strings of edits are compared."""
    states = {0: "", 1: "s", 2: "u", 3: "a"}
    after = lambda x, c: {"s": 1 if x == 0 else None, "u": 2 if x != 2 else None, "a": 3 if x == 2 else None}.get(c)
    name = {"u": "user", "a": "assistant"}

    def closed(found):
        for _ in range(3):
            for x in states:
                for c in "ua":
                    to = after(x, c)
                    if to is not None and to in found:
                        cost, edits, given = found[to]
                        made = (cost + 2, "I" + edits, ((name[c], ""), *given))
                        if x not in found or made[:2] < found[x][:2]:
                            found[x] = made
        return found

    found = closed({0: (0, "", ()), 3: (0, "", ())})
    for (_, role, text), kind in zip(reversed(rows), reversed(kinds), strict=True):
        new = {}
        for x in states:
            ways = [("D", 3, x, None)]
            if kind not in ("blank", "duplicate"):
                more = kind == "truncated"
                ways += [("K", more, after(x, role[:1]), (role, text))] + [("R", 2 + more, after(x, c), (name[c], text)) for c in "ua"]
            for letter, cost, to, row in ways:
                if to is not None and to in found:
                    made = (cost + found[to][0], letter + found[to][1], (() if row is None else (row,)) + found[to][2])
                    if x not in new or made[:2] < new[x][:2]:
                        new[x] = made
        found = closed(new)
    return found[0]


def every_way(rows, kinds):
    """Least (cost, edits) over all strings of edits with at most two inserts in a place."""
    gaps = [()] + [tuple(x) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    best = None
    for edits in itertools.product("DKua", repeat=len(rows)):
        if any(k in ("blank", "duplicate") and e != "D" for e, k in zip(edits, kinds, strict=True)):
            continue
        for held in itertools.product(gaps, repeat=len(rows) + 1):
            roles, audit, cost = "".join(held[0]), "I" * len(held[0]), 2 * len(held[0])
            for (_, role, _), kind, e, gap in zip(rows, kinds, edits, held[1:], strict=True):
                roles += "" if e == "D" else (role[:1] or "?") if e == "K" else e
                audit += {"D": "D", "K": "K"}.get(e, "R") + "I" * len(gap)
                cost += {"D": 3, "K": 0}.get(e, 2) + (kind == "truncated" and e != "D") + 2 * len(gap)
                roles += "".join(gap)
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def plain_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    kinds, turns = faults(rows), {t for t, _, _ in rows if t is not None}
    cost, audit, given = suffixes(rows, kinds)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    counts = Counter(kinds)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in given).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest), given


def talk(n=300, seed=1):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None]) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No", "", " \t", None, "Why?\n", "é…", "Well!", "1", "a. b", f"{turn}.", f"{turn} .", f"t{turn}"])
            out.append((conv if conv % 40 else None, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1, 5]), role, text))
    return out


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out[conv] += [(turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def test_forms():
    """The reference of these tests against all strings of edits."""
    rng = random.Random(3)
    for _ in range(60):
        rows = [(t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", f"{t}."])) for t in range(rng.randint(0, 3))]
        assert suffixes(rows, faults(rows))[:2] == every_way(rows, faults(rows))


@pytest.mark.parametrize("batch", [3, 2000])
def test_repair(spark, monkeypatch, tmp_path, batch):
    from lakeweir.llm import common

    monkeypatch.setattr(common, "BATCH_ROWS", batch)  # conversations go over the ends of batches
    rows = talk()
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, _role string, audit string").repartition(4)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    kept = damaged(rows)
    assert got.keys() == kept.keys()
    for conv, held in kept.items():
        assert got[conv] == plain_repair(held)[0], conv
    hurt = repair.damage(frame)
    found = repair.repair(hurt, gone=hurt["_gone"])
    lines = defaultdict(list)
    for r in repair.repaired_rows(hurt, found, gone=hurt["_gone"]).orderBy("position").collect():
        lines[r.conv_id].append((r.role, r.text))
    assert {c: tuple(x) for c, x in lines.items()} == {c: plain_repair(h)[1] for c, h in kept.items() if plain_repair(h)[1]}


def test_repair_all_gone(spark):
    lost = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    frame = repair.damage(spark.createDataFrame([(5, lost, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string"))
    assert tuple(repair.repair(frame, gone=frame["_gone"]).first()) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.repair(repair.damage(empty)).count() == 0 and dict(repair.repair(empty).dtypes)["conv_id"] == "string"


def test_repair_spills(monkeypatch):
    """A long conversation, with its digests in sorted runs and its backpointers in a file."""
    monkeypatch.setattr(repair, "_RUN", 50)
    monkeypatch.setattr(repair, "_RUNS", 3)
    monkeypatch.setattr(repair, "_SPILL", 256)
    rng = random.Random(7)
    rows = [(t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["", f"{rng.randrange(600)}.", f"{t}", f"{t}!"])) for t in range(3000)]
    held = repair.Conversation("1")
    for row in rows:
        held.add(*row)
    assert held.seen.runs and held.pointers.spilled
    assert held.result()[1:] == plain_repair(rows)[0]


# --- mixing ---------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """By rounds, in fractions: what is above the limit goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, full = Fraction(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in full]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return full | share
        for s in above:
            full[s] = Fraction(most * sizes[s])
            left -= full[s]


def mixed(spark, n=400, copies=60):
    rng = random.Random(8)
    sources = ["b", "a", "Z", None, "é", "c"]
    docs = [(i, " ".join(["w"] * rng.randint(0, 60)), sources[min(rng.randrange(9), 5)]) for i in range(n)]
    docs += [(n, None, "a"), (n + 1, "", "none"), (n + 2, " \n", "none"), (n + 3, "one word two\x0bthree", "tiny")]
    docs += [(None, "same text here", "b")] * copies + [(7, "other", "a"), (7, "same id", "c")]
    return docs, spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id bigint, text string, source string, _copies string, _size int").repartition(6)


def test_mix(spark, monkeypatch):
    docs, frame = mixed(spark)
    got = mixing.with_copies(frame).collect()
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(words_of(text))
    want = plain_targets(sizes)
    assert len(got) == len(docs) and {"_copies", "__copies", "_size", "__size", "_target"} <= set(got[0].asDict())
    taken = Counter()
    for r in got:
        assert r["__size"] == len(words_of(r.text)) and r._source_size == sizes[r.source] and r._target == pytest.approx(float(want[r.source]))
        rate = r._target / sizes[r.source] if sizes[r.source] else 0
        assert math.floor(rate) <= r["__copies"] <= min(3, math.floor(rate) + 1)
        taken[r.source] += r["__copies"] * r["__size"]
    assert sum(float(x) for x in want.values()) == pytest.approx(sum(sizes.values()))
    for source, aim in want.items():
        assert abs(taken[source] - aim) <= 5 * math.sqrt(sum(len(words_of(t)) ** 2 for _, t, s in docs if s == source)) / 2 + 1
    same = [r["__copies"] for r in got if r.doc_id is None]
    assert len(same) == 60 and len(set(same)) == 2  # equal rows are drawn apart
    again = mixing.with_copies(frame.repartition(2)).collect()
    key = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    assert key(again) == key(got)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
    assert key(mixing.with_copies(frame).collect()) == key(got)
    out = Counter(map(tuple, mixing.mix(frame).collect()))
    assert out == sum((Counter({tuple(r)[:5]: r["__copies"]}) for r in got), Counter()) and mixing.mix(frame).columns == frame.columns


def test_mix_without_rows_or_words(spark):
    _, frame = mixed(spark)
    assert mixing.with_copies(frame.limit(0)).count() == 0
    bare = mixing.with_copies(frame.filter("text IS NULL OR text = ''")).collect()
    assert bare and {(r["__copies"], r._target) for r in bare} == {(0, 0.0)}


def test_mix_plan(spark):
    """DataFrame functions only."""
    _, frame = mixed(spark)
    plan = mixing.with_copies(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


# --- earlier operators: empty tables, long pages, clashing columns ---------------------------------------------------


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality.repetition(docs).count() == 0
    assert tokens.encode_digest(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert tokens.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_long_page(spark):
    said = " ".join(f"Sentence number {i} of the long story, which goes on." for i in range(12))
    body = "".join(f"<p>{said} {i}</p>" for i in range(700))
    page = f"<html><body><nav><a href='/'>Home</a></nav><article><h1>A long story</h1>{body}</article><footer>Copyright</footer></body></html>"
    pages = [(i, "u", page, "text", 1) for i in range(3)]
    got = html.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string, text string, n_chars int")).collect()
    assert len(page) > 400_000 and {r.n_chars for r in got} == {len(got[0].text)}
    assert got[0].text.startswith("A long story Sentence number 0") and got[0].text.endswith(" 699") and "Home" not in got[0].text[:60]
