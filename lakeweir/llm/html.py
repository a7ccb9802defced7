"""HTML main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks (runs of text between block-level tags), each described by its ancestors' tags, class and id
words, by its text (length, marks, share inside links, the words of short ones) and by what holds it: that holder's share of
the page's text and of links, and on which side of the holder with most text it stands. The field has two labels, main text and
other, with weights for features and for neighbouring labels; it is fitted by gradient ascent on labelled pages and decoded
by Viterbi. No feature and no weight is set by hand: what a container or a word means is learned.

Training pages are a bounded sample (SAMPLE, by hash of the id) of the pages themselves, labelled where their own
structure says what is main text, plus the same texts in made-up templates (other containers and tags; menus, notices,
adverts, forms, sidebars and comments before, inside and after the text; lists of short entries inside it), whose labels are
known as they are made, so that the weights don't hang on one template. In half of them class words are coined at random and
say nothing, and most comments say nothing of themselves either, so that shares and sides must tell. Pages that say nothing of their structure give texts to made-up templates only.
Decoding is a narrow pass over whole pages.

Defined results: null and empty pages, and pages without main text, give an empty text; repeated rows are extracted each,
and are learned from once; an id of any type, null too, is handed through; unclosed or truncated markup is read as far as
it goes, very long pages whole; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweir.llm.common import map_batches

SAMPLE, BUCKETS, ROUNDS, RIDGE, TEMPLATES = 120, 1 << 15, 100, 1e-5, 6
#: Tags that don't end a block, tags whose content is never text, and tags without content. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW, HIDDEN = "script|style", "noscript template svg iframe object canvas select textarea button title".replace(" ", "|")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that hold parts of a page. Fixed values.
HOLDERS = frozenset("html body div section article main aside nav header footer form menu dialog td details".split())

#: Containers that say what is main text and what is not. Fixed values.
MAIN, OTHER = frozenset("article main".split()), frozenset("nav header footer aside form menu dialog".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement alert banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disclaimer footer form header legal login masthead menu "
    "nav navbar navigation newsletter notice pagination popup promo promotion reactions recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription toolbar topbar trending widget".split()
)
#: Kinds of blocks that are not main text: (semantic tag or none, class words, short texts). Fixed values.
KINDS = (
    ("nav", "menu nav navigation navbar breadcrumb", True),
    ("header", "header masthead topbar banner", True),
    ("", "cookie notice consent alert popup", False),
    ("", "ad advert sponsored promo banner", False),
    ("section", "comments comment replies respond reactions", False),
    ("form", "form subscribe newsletter signup search", True),
    ("aside", "sidebar related widget recommended trending", False),
    ("footer", "footer copyright legal contentinfo", False),
)
#: What blocks of those kinds say, in four languages: words with which they begin or end. Fixed values.
SAYINGS = (
    "home|about us|contact|login|startseite|über uns|kontakt|anmelden|accueil|à propos|connexion|inicio|sobre nosotros|contacto|iniciar sesión",
    "breaking news|search|menu|suche|menü|recherche|buscar|menú",
    "we use cookies|accept all|cookies akzeptieren|wir verwenden cookies|nous utilisons des cookies|tout accepter|usamos cookies|aceptar todo",
    "advertisement|sponsored|buy now|anzeige|jetzt kaufen|publicité|acheter maintenant|publicidad|comprar ahora",
    "comments|reply|said|posted by|kommentare|antworten|schrieb|commentaires|répondre|a dit|comentarios|responder|dijo",
    "subscribe|your email|sign up|send|abonnieren|e-mail-adresse|senden|s'abonner|votre adresse|envoyer|suscribirse|tu correo|enviar",
    "related|read more|most read|mehr zum thema|weiterlesen|meistgelesen|à lire aussi|lire la suite|relacionado|leer más|lo más leído",
    "copyright|© 2024|all rights reserved|privacy policy|terms of use|alle rechte vorbehalten|datenschutz|impressum|tous droits réservés|mentions légales|todos los derechos reservados|aviso legal",
)
#: Class words of containers of main text, and of containers of everything. Fixed values.
TEXT_WORDS, PAGE_WORDS = "content entry post body story text article main".split(), "wrapper page container site layout".split()

#: A hidden element goes with its content; a self-closed svg has none, and without an end tag only the start tag goes (but script and style reach to the end).
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|$)|<svg(?=[\s/>])[^>]*/>|<({HIDDEN})(?=[\s/>])[^>]*>(?:.*?</\2\s*>)?|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<$|<(?=[a-zA-Z/!?])[^<>]*$", re.S | re.I)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS, _WHOLE = re.compile(r"[a-z]+"), re.compile(r"[a-z_-]+[0-9][\w-]*")
_BLANK = re.compile(r"\s+")
_SAID = re.compile(r"[^\W\d_]+|©")


class Block:
    __slots__ = ("names", "tags", "text", "linked")

    def __init__(self, tags: tuple[str, ...], names: tuple[frozenset, ...]):
        self.tags, self.names, self.text, self.linked = tags, names, [], 0


def leaf_blocks(page: str) -> list[tuple[tuple[str, ...], tuple[frozenset, ...], str, float]]:
    """(ancestor tags, their class and id words, text, share inside links) of each leaf block, in page order."""
    stack: list[tuple[str, frozenset]] = []
    out, at, link, parts = [], 0, 0, 0
    block = Block((), ())

    def say(raw: str) -> None:
        if raw:
            block.text.append(raw)
            if link:
                block.linked += len(raw)

    def end() -> None:
        nonlocal block
        text = _BLANK.sub(" ", unescape("".join(block.text))).strip()
        if text:
            out.append((block.tags, block.names, text, min(1.0, block.linked / len(text))))
        block = Block(tuple(t for t, _ in stack), tuple(n for _, n in stack))

    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m.group(4)
        if not tag:
            continue
        tag = tag.lower()
        closing = bool(m.group(3))
        if tag in INLINE:
            link = 0 if tag == "a" and closing else 1 if tag == "a" else link
            continue
        if tag in VOID:
            end()
            continue
        link = 0
        if closing:
            if any(t == tag for t, _ in stack):
                end_at = max(i for i, (t, _) in enumerate(stack) if t == tag)
                del stack[end_at:]
        else:
            if stack and stack[-1][0] == "p" or stack and tag == stack[-1][0] and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                stack.pop()
            named = [v.lower() for v in _NAMES.findall(m.group(5))]
            words = {w for v in named for w in _WORDS.findall(v)} | {w for v in named for w in _WHOLE.findall(v)}
            if len(stack) == 2 and tag in HOLDERS:  # parts of the page without names are told apart by number
                parts += 1
                words.add(f"#{parts}")
            stack.append((tag, frozenset(words)))
        end()
    say(page[at:])
    end()
    return out


def place_features(tags: tuple, names: tuple) -> list[str]:
    """Names of the features of where a block stands: its ancestors' tags, their order and class words."""
    out = {f"t:{t}" for t in tags}
    # the class words of html and body speak of the page, not of the block; numbers of parts say nothing
    inner = [(t, [w for w in own if w[0] != "#"]) for t, own in zip(tags, names, strict=True) if t not in ("html", "body")]
    for i, (tag, own) in enumerate(inner):
        out.update(f"w:{w}" for w in own)
        out.update(f"in:{upper}>{tag}" for upper, _ in inner[:i])
    out.add(f"top:{inner[0][0] if inner else ''}")
    out.update(f"next:{w}" for w in next((own for _, own in reversed(inner) if own), ()))
    out.add(f"own:{tags[-1] if tags else ''}")
    return sorted(out)


def text_features(text: str, linked: float, place: float) -> list[str]:
    """Names of the features of a block's text, and of its place in the page (0 to 1)."""
    words = text.count(" ") + 1
    marks, size, stop = sum(map(text.count, ".,;:!?")), min(7, words.bit_length()), text[-1] in ".!?"
    out = [f"len:{size}", f"marks:{min(5, marks.bit_length())}", f"link:{int(linked * 3.99)}", f"stop:{stop}", f"place:{int(place * 3.99)}", f"lm:{size}:{int(linked * 1.99)}:{stop}"]
    return out if words > 16 else [*out, *(f"x:{w}" for w in sorted(set(_SAID.findall(text.lower()))))]


def _hashed(names: list[str]) -> list[int]:
    """Stable numbers for feature names (FNV-1a)."""
    out = []
    for name in names:
        if (found := _SEEN.get(name)) is None:
            h = 0xCBF29CE484222325
            for c in name.encode():
                h = (h ^ c) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            found = (h ^ h >> 29) % BUCKETS
            if len(_SEEN) > 100_000:
                _SEEN.clear()
            _SEEN[name] = found
        out.append(found)
    return out


_SEEN: dict[str, int] = {}


def _holder(tags: tuple, names: tuple, named: bool) -> tuple:
    """The path to the innermost holder of a block, or to the innermost with a name."""
    depth = next((i for i in range(len(tags), 0, -1) if tags[i - 1] in HOLDERS and (names[i - 1] or not named)), 0)
    return tags[:depth], names[:depth]


def holder_features(blocks: list, named: bool) -> list[list[str]]:
    """Names of the features of what holds a block: its share of the page's text and of links, and its side of the holder with most text."""
    paths, size, linked, blocks_in, own = {}, {}, {}, {}, []
    for tags, names, text, link in blocks:
        if (path := paths.get((tags, names))) is None:
            path = paths[tags, names] = _holder(tags, names, named)
        own.append(path)
        size[path] = size.get(path, 0) + len(text)
        linked[path] = linked.get(path, 0) + link * len(text)
        blocks_in[path] = blocks_in.get(path, 0) + 1
    whole, lead, k = sum(size.values()), max(size, key=size.get), "n" if named else "h"
    inside = [i for i, path in enumerate(own) if path == lead]
    said, out = {}, []
    for i, (path, (tags, _, text, _)) in enumerate(zip(own, blocks, strict=True)):
        if path not in said:
            within = path[0][: len(lead[0])] == lead[0] and path[1][: len(lead[1])] == lead[1]
            mean = min(7, (size[path] // (6 * blocks_in[path])).bit_length())
            said[path] = [f"{k}:share:{int(4.99 * size[path] / whole)}", f"{k}:lead:{path == lead}", f"{k}:under:{within}", f"{k}:links:{int(3.99 * linked[path] / size[path])}", f"{k}:mean:{mean}"]
        side = f"{k}:side:{'before' if i < inside[0] else 'after' if i > inside[-1] else 'among'}"
        out.append([*said[path], side, f"{side}:{path == lead}:{tags[-1] if tags else ''}", f"{side}:{path == lead}:{min(7, (text.count(' ') + 1).bit_length())}"])
    return out


def page_features(blocks: list) -> list[list[int]]:
    n, places, out = len(blocks), {}, []
    if not n:
        return out
    for i, ((tags, names, text, linked), held, named) in enumerate(zip(blocks, holder_features(blocks, False), holder_features(blocks, True), strict=True)):
        if (own := places.get((tags, names))) is None:
            own = places[tags, names] = _hashed(place_features(tags, names))
        out.append(own + _hashed(text_features(text, linked, i / n)) + _hashed(held) + _hashed(named))
    return out


def structure_labels(blocks: list) -> list[int] | None:
    """1 for blocks inside a main container and no other; None where the page has no such container."""
    if not any(MAIN & set(tags) for tags, *_ in blocks):
        return None
    return [int(bool(MAIN & set(tags)) and not OTHER & set(tags) and not any(OTHER_WORDS & own for own in names[2:])) for tags, names, *_ in blocks]


def retold(blocks: list, labels: list[int], pool: list[str], rng: random.Random) -> tuple[list, list[int]]:
    """The page's text in a made-up template, with blocks of several kinds that are not main text."""
    none, neutral = frozenset(), rng.random() < 0.5
    coined = lambda: frozenset({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 7)))})  # noqa: E731  a name that says nothing
    top = [("html", none), ("body", none)]
    if rng.random() < 0.4:
        top.append(("div", coined() if neutral else frozenset({rng.choice(PAGE_WORDS)})))
    holder = rng.choice(["main", "article", "div", "div", "section", "none"])
    if neutral and rng.random() < 0.7:
        holder = rng.choice(["div", "div", "section"])
    inside = top + [(holder, coined() if neutral else none if holder in MAIN and rng.random() < 0.7 else frozenset(rng.sample(TEXT_WORDS, rng.randint(1, 2))))] * (holder != "none")
    if neutral and holder != "none" and rng.random() < 0.3:
        inside.append(("div", coined()))
    made, marks, parts = [], [], []

    def add(path: list, text: str, y: int, linked: float = 0.0) -> None:
        names = [w for _, w in path]
        if len(path) > 2 and path[2][0] in HOLDERS:
            if not any(path[2] is x for x in parts):
                parts.append(path[2])
            names[2] |= {f"#{next(i for i, x in enumerate(parts) if x is path[2])}"}
        made.append((tuple(t for t, _ in path), tuple(names), text, linked))
        marks.append(y)

    def other(kind: int, base: list) -> None:
        tag, words, short = KINDS[kind]
        semantic, says = tag and rng.random() < 0.5, rng.random() < 0.5
        # what says what it is may be unmarked
        bare = semantic and rng.random() < 0.5 or says and rng.random() < 0.4
        if neutral:
            semantic, bare = semantic and rng.random() < 0.4, False
        named = coined() if neutral and rng.random() < 0.85 else frozenset(rng.sample(words.split(), rng.randint(1, 2)))
        box = (tag if semantic else rng.choice(["div", "section", "p"] if bare else ["div", "section"]), none if bare else named)
        linked = rng.choice([0.0, 1.0]) if kind in (0, 6) else 0.0
        for _ in range(rng.randint(1, 6 if kind in (0, 4, 6) else 2)):
            text = rng.choice(pool)
            text = " ".join(text.split()[: rng.randint(1, 4)]).strip(".,") or text if short or rng.random() < (0.1 if kind == 4 else 0.3) else text
            if says and (bare or kind != 4 or rng.random() < 0.6):  # most comments say nothing of themselves
                said = rng.choice(SAYINGS[kind].split("|"))
                text = rng.choice([said, f"{said} {' '.join(text.split()[:6])}", f"{' '.join(text.split()[:3])} {said}"])
            inner = rng.choice([[], ["p"], ["p"], ["div"], ["ul", "li"], ["h3"], ["div", "p"]])
            add([*base, box, *((t, none) for t in inner)], text, 0, linked)

    for kind in (0, 1, 2, 3, 6):
        if rng.random() < (0.8 if kind < 2 else 0.3):
            other(kind, top)
    first = True
    for (_, _, text, linked), y in zip(blocks, labels, strict=True):
        if not y:
            continue
        tag = "h1" if first else rng.choice(["p"] * 8 + ["li", "blockquote", "td", "figcaption", "dd", "h2", "pre", "div"])
        upper = {"li": ["ul"], "td": ["table", "tr"], "figcaption": ["figure"], "dd": ["dl"]}.get(tag, ["header"] if first and holder in MAIN and rng.random() < 0.2 else [])
        add([*inside, *((t, none) for t in upper), (tag, none)], text, 1, linked)
        if rng.random() < 0.2:
            text = rng.choice(pool)
            add([*inside, (rng.choice(["h2", "h3", "p"]), none)], " ".join(text.split()[: rng.randint(1, 5)]), 1)
        if not first and rng.random() < 0.2:  # a list, of short entries without links
            listed, long = rng.choice([("ul", "li"), ("ol", "li"), ("dl", "dd")]), rng.random() < 0.3
            for _ in range(rng.randint(2, 6)):
                words = rng.choice(pool).split()[: rng.randint(8, 25) if long else rng.randint(1, 7)]
                entry = " ".join(words)
                add([*inside, *((t, none) for t in listed)], rng.choice([entry, f"{words[0].strip('.,:')}: {entry}", f"{entry} {rng.randint(1, 900)}"]), 1)
        if not first and rng.random() < 0.25:
            other(rng.choice([3, 5, 6]), inside)
        first = False
    for kind in (4, 3, 2, 5, 6, 7):
        if rng.random() < (0.85 if kind == 4 and neutral else 0.7 if kind in (4, 7) else 0.3):
            other(kind, inside if holder != "none" and rng.random() < 0.3 else top)
    return made, marks


class Lattice:
    """Labelled pages as arrays: the log-likelihood of their labels and its slopes."""

    def __init__(self, rows: list[tuple[list, list[int]]]):
        feats = [page_features(b) for b, _ in rows]
        self.size = np.array([len(f) for f in feats])
        self.flat = np.array([x for f in feats for b in f for x in b])
        self.of = np.repeat(np.arange(self.size.sum()), [len(b) for f in feats for b in f])
        self.y = np.concatenate([np.array(l) for _, l in rows])
        self.page = np.repeat(np.arange(len(rows)), self.size)
        self.within = np.arange(len(self.page)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.mask = np.zeros((len(rows), int(self.size.max())), bool)
        self.mask[self.page, self.within] = True
        self.truth = np.zeros((2, 2))
        both = self.page[1:] == self.page[:-1]
        np.add.at(self.truth, (self.y[:-1][both], self.y[1:][both]), 1)

    def slopes(self, weight: np.ndarray, near: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood less the ridge, and its slopes by weight and near, from a forward and a backward pass."""
        n, longest = self.mask.shape
        s = np.zeros((n, longest, 2))
        score = np.bincount(self.of, weight[self.flat], len(self.page))
        s[self.page, self.within, 1] = score
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = s[:, 0]
        for i in range(1, longest):
            ahead[:, i] = s[:, i] + np.logaddexp(ahead[:, i - 1, 0, None] + near[0], ahead[:, i - 1, 1, None] + near[1])
        behind = np.zeros((n, longest, 2))
        for i in range(longest - 2, -1, -1):
            x = s[:, i + 1] + behind[:, i + 1]
            value = np.logaddexp(near[None, :, 0] + x[:, None, 0], near[None, :, 1] + x[:, None, 1])
            behind[:, i] = np.where(self.mask[:, i + 1, None], value, 0)
        last = ahead[np.arange(n), self.size - 1]
        z = np.logaddexp(last[:, 0], last[:, 1])
        chance = np.exp(ahead[..., 1] + behind[..., 1] - z[:, None])[self.page, self.within]
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                if longest > 1:
                    p = np.exp(ahead[:, :-1, a] + near[a, b] + s[:, 1:, b] + behind[:, 1:, b] - z[:, None])
                    expected[a, b] = p[self.mask[:, 1:]].sum()
        ridge = RIDGE * len(self.page)
        value = float(score[self.y == 1].sum() + (self.truth * near).sum() - z.sum() - ridge / 2 * ((weight**2).sum() + (near**2).sum()))
        return value, np.bincount(self.flat, (self.y - chance)[self.of], BUCKETS) - ridge * weight, self.truth - expected - ridge * near


def fit(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features for label 1, and the 2 x 2 weights of neighbouring labels (label 0 has feature weight 0)."""
    cut = [b for b in map(leaf_blocks, dict.fromkeys(pages)) if b]
    known = [(b, y) for b in cut if (y := structure_labels(b)) is not None]
    rng = random.Random(0)
    pool = [text for b, _ in known for *_, text, _ in b][:5_000] or [text for b in cut for *_, text, _ in b][:5_000]
    pool = pool or [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 60))) + "." for _ in range(200)]
    if not any(any(y) for _, y in known):  # no page says what its text is: made-up pages alone
        known = [([((), (), rng.choice(pool), 0.0) for _ in range(rng.randint(2, 8))], None) for _ in range(100)]
    rows = [(b, y) for b, y in known if y is not None]
    for i, (b, y) in enumerate(known):
        y = [1] * len(b) if y is None else y
        rows += [retold(b, y, pool, random.Random(TEMPLATES * i + k)) for k in range(TEMPLATES if any(y) else 0)]
    pages_, weight, near = Lattice(rows), np.zeros(BUCKETS), np.zeros((2, 2))
    sums_w, sums_n = np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(ROUNDS):
        _, slope, slope_n = pages_.slopes(weight, near)
        sums_w += slope**2
        sums_n += slope_n**2
        weight += slope / np.sqrt(sums_w)
        near += slope_n / np.sqrt(sums_n)
    return weight, near


def viterbi(scores: list[float], near: np.ndarray) -> list[int]:
    """The likeliest labels, given each block's score for label 1."""
    (aa, ab), (ba, bb) = near.tolist()
    back, zero, one = [], 0.0, scores[0]
    for s in scores[1:]:
        from_zero = (zero + aa >= one + ba, zero + ab >= one + bb)
        zero, one = max(zero + aa, one + ba), max(zero + ab, one + bb) + s
        back.append(from_zero)
    label = int(one > zero)
    out = [label]
    for from_zero in reversed(back):
        label = 0 if from_zero[label] else 1
        out.append(label)
    return out[::-1]


def main_text(page: str | None, weight: list[float], near: np.ndarray) -> str:
    blocks = leaf_blocks(page or "")
    if not blocks:
        return ""
    labels = viterbi([sum(map(weight.__getitem__, f)) for f in page_features(blocks)], near)
    return " ".join(b[2] for b, y in zip(blocks, labels, strict=True) if y)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The field from at most ``sample`` pages, in one task."""
    ids = pages.select(F.col(id_col).alias("_id")).filter("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # repeated rows of an id are one: at most sample pages reach the task that fits
    chosen = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html")).join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("_html").alias("_html"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, near = fit([x or "" for batch in batches for x in batch.column("_html").to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(weight, near.ravel()))], names=["weight"])

    found = np.array([r.weight for r in map_batches(chosen.repartition(1).sortWithinPartitions("_id"), learn, "weight double").collect()])
    return (found[:-4], found[-4:].reshape(2, 2)) if len(found) else fit([])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    weight, near = train(pages, id_col, html_col, sample)
    weights = weight.tolist()
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = T.StructType([source.schema["page_id"], source.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights, near) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return map_batches(source, run, schema)
