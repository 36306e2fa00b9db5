"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks: runs of text between block-level tags, each with the path of open elements.  A block's vector
hashes the tags and attribute words on its path and the words of its text, beside a few figures.  A bidirectional LSTM in numpy
reads a page's blocks in order and labels each as article text or not, so that every label sees the whole page.

The network is trained on the driver from pages that are made up by rule (:func:`layout`), once for a process and always from
the same seed; the tables it is used on are not looked at.  It weighs about 170 KB.
"""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridspark.llm._text import SPACE_WORDS, Words

# Fixed values of HTML: elements that begin a block of their own, and those without an end tag.
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label"
    " legend li link main menu meta nav noscript object ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video audio".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are no text of the page.
SILENT = frozenset("script style template".split())
#: What names a drawing is not shown.
_UNSHOWN = frozenset("title desc metadata".split())
#: An element that a start tag closes: the open ones it ends, and those that it does not look beyond.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_ENDS_P = BLOCKS - {"button", "label", "option", "optgroup", "select", "object", "iframe", "canvas", "video", "audio"}

PATH, WORDS, FIGURES = 384, 64, 7
WIDTH = PATH + WORDS + FIGURES
HIDDEN = 16
SEED = 20240607
PAGES, STEPS, BATCH, RATE = 4_000, 900, 32, 0.01
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_LINK = "a"


#: What a block's vector tells of its path: the places of all its tokens as bits, the innermost tag, the number of tokens.
Path = tuple[int, str, int]


class Leaves(HTMLParser):
    """Collects ``blocks``: (path, text with single spaces, share of its characters in links).

    An open element adds to the path of the one around it, so that a page costs memory for its own length, however deep it is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, Path, bool]] = []
        self.count: Counter[str] = Counter()
        self.blocks: list[tuple[Path, str, float]] = []
        self.parts: list[str] = []
        self.linked = self.silent = 0

    def close_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.add(text, min(1.0, self.linked / len(text)))
            self.parts, self.linked = [], 0

    def add(self, text: str, share: float) -> None:
        self.blocks.append((self.open[-1][1] if self.open else (0, "", 0), text, share))

    def path(self, tag: str, names: str) -> Path:
        """The path of a new element: its tag and the lower-cased words in its class, id and role; words that no training page has only count, so that they share no place with one that tells."""
        bits, _, n = self.open[-1][1] if self.open else (0, "", 0)
        words = {w.lower() for w in _NAME_PARTS.findall(names)} if names else set()
        for token in (f"<{tag}>", *(words & _KNOWN)):
            bits |= 1 << _place(token)
        return bits, f"<{tag}>", n + 1 + len(words)

    def _pop(self, at: int) -> None:
        for tag, _, quiet in self.open[at:]:
            self.silent -= quiet
            self.count[tag] -= 1
        del self.open[at:]

    def _end_open(self, ends, within) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in ends:
                self._pop(at)
                return
            if self.open[at][0] in within:
                return

    def _unshown(self, tag: str) -> bool:
        return tag in _UNSHOWN and self.count["svg"] > 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and not self._unshown(tag):
            self.close_block()
            if tag in CLOSES:
                self._end_open(*CLOSES[tag])
            elif tag in _ENDS_P:
                self._end_open({"p"}, BLOCKS - {"p"})
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        quiet = tag in SILENT or self._unshown(tag)
        self.silent += quiet
        path = self.path(tag, " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")))
        self.count[tag] += 1
        self.open.append((tag, path, quiet))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][2]:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS and not self._unshown(tag):
            self.close_block()
        if not self.count[tag]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._pop(at)
                return
            if self.open[at][0] in BLOCKS and tag not in BLOCKS:
                return  # an inline end tag does not close a block

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.count[_LINK]:
                self.linked += len(data)


def leaves(html: str | None) -> list[tuple[Path, str, float]]:
    parser = Leaves()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    return parser.blocks


_places: dict[str, int] = {}


def _place(token: str) -> int:
    if len(_places) > 200_000:
        _places.clear()
    if (found := _places.get(token)) is None:
        found = _places[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % PATH
    return found


def vectors(blocks: list[tuple[Path, str, float]]) -> np.ndarray:
    """A row for each block."""
    n = len(blocks)
    out = np.zeros((n, WIDTH), np.float32)
    bits = b"".join([((mask | 1 << _place(f"last{tag}")) if tag else mask).to_bytes(PATH // 8, "little") for (mask, tag, _), _, _ in blocks])
    out[:, :PATH] = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(n, PATH // 8), axis=1, bitorder="little")
    raw = [text.encode("utf-8", "surrogatepass") for _, text, _ in blocks]
    words = Words(raw, SPACE_WORDS, True)
    counts = np.bincount(words.doc * WORDS + (words.hash >> np.uint64(58)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    out[:, PATH : PATH + WORDS] = counts / np.maximum(words.counts, 1)[:, None]
    chars = np.array([len(t) for _, t, _ in blocks], np.float32)
    figures = out[:, PATH + WORDS :]
    figures[:, 0] = np.log1p(chars) / 8
    figures[:, 1] = np.log1p(words.counts) / 6
    figures[:, 2] = [share for _, _, share in blocks]
    figures[:, 3] = [t[-1] in ".!?。»\"" for _, t, _ in blocks]
    figures[:, 4] = [size / 16 for (_, _, size), _, _ in blocks]
    figures[:, 5] = chars < 25
    figures[:, 6] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _walk(inputs: np.ndarray, recurrent: np.ndarray, keep: bool):
    """The hidden states of an LSTM over ``inputs`` [step, page, 4 x HIDDEN], and what its gradient needs."""
    steps, pages = inputs.shape[:2]
    h = c = np.zeros((pages, HIDDEN), np.float32)
    states = np.empty((steps, pages, HIDDEN), np.float32)
    kept = []
    for t in range(steps):
        gates = inputs[t] + h @ recurrent
        gate, new = _sigmoid(gates[:, : 3 * HIDDEN]), np.tanh(gates[:, 3 * HIDDEN :])
        i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
        before, was = c, h
        c = f * c + i * new
        shown = np.tanh(c)
        h = o * shown
        states[t] = h
        if keep:
            kept.append((i, f, o, new, before, shown, was))
    return states, kept


def _back(grads: np.ndarray, kept: list, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of ``recurrent``."""
    steps, pages = grads.shape[:2]
    out = np.empty((steps, pages, 4 * HIDDEN), np.float32)
    total = np.zeros_like(recurrent)
    dh = dc = np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, new, before, shown, was = kept[t]
        dh = dh + grads[t]
        dc = dc + dh * o * (1 - shown**2)
        out[t] = np.concatenate((dc * new * i * (1 - i), dc * before * f * (1 - f), dh * shown * o * (1 - o), dc * i * (1 - new**2)), 1)
        total += was.T @ out[t]
        dh, dc = out[t] @ recurrent.T, dc * f
    return out, total


class Labeller:
    """Two LSTMs, one for each direction, and a logistic layer over both states of a block."""

    def __init__(self, rng: np.random.Generator):
        scale = lambda *shape: (rng.standard_normal(shape) * (1 / np.sqrt(HIDDEN)) * 0.5).astype(np.float32)
        self.weights = [scale(WIDTH, 4 * HIDDEN), scale(HIDDEN, 4 * HIDDEN), scale(WIDTH, 4 * HIDDEN), scale(HIDDEN, 4 * HIDDEN), scale(2 * HIDDEN), np.zeros(1, np.float32)]

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """[step, page] -> row of the concatenated pages, the same from the end, and which are real; padding follows the real ones."""
        sizes = np.array([len(p) for p in pages])
        first = np.cumsum(sizes) - sizes
        step = np.arange(sizes.max(initial=0))[:, None]
        real = step < sizes[None]
        return np.where(real, first + step, 0), np.where(real, first + sizes - 1 - step, 0), real

    def _states(self, rows: np.ndarray, there: np.ndarray, back: np.ndarray, keep: bool = False):
        wf, rf, wb, rb, _, _ = self.weights
        forward, kept_f = _walk((rows @ wf)[there], rf, keep)
        backward, kept_b = _walk((rows @ wb)[back], rb, keep)
        return forward, backward, kept_f, kept_b

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of each block of each page that it is article text."""
        rows = np.concatenate(pages)
        there, back, real = self.padded(pages)
        forward, backward, _, _ = self._states(rows, there, back)
        out = np.empty((len(rows), 2 * HIDDEN), np.float32)
        out[there[real], :HIDDEN] = forward[real]
        out[back[real], HIDDEN:] = backward[real]
        scores = _sigmoid(out @ self.weights[4] + self.weights[5])
        return np.split(scores, np.cumsum([len(p) for p in pages])[:-1])

    def gradients(self, pages: list[np.ndarray], truth: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy over all blocks."""
        rows = np.concatenate(pages)
        there, back, real = self.padded(pages)
        forward, backward, kept_f, kept_b = self._states(rows, there, back, True)
        states = np.empty((len(rows), 2 * HIDDEN), np.float32)
        states[there[real], :HIDDEN] = forward[real]
        states[back[real], HIDDEN:] = backward[real]
        error = ((_sigmoid(states @ self.weights[4] + self.weights[5]) - truth) / len(rows)).astype(np.float32)
        spread = error[:, None] * self.weights[4][None]
        out = []
        for index, kept, w, part in ((there, kept_f, 1, slice(0, HIDDEN)), (back, kept_b, 3, slice(HIDDEN, None))):
            grads = np.where(real[..., None], spread[:, part][index], 0).astype(np.float32)
            gates, recurrent = _back(grads, kept, self.weights[w])
            by_row = np.zeros((len(rows), 4 * HIDDEN), np.float32)
            by_row[index[real]] = gates[real]
            out += [rows.T @ by_row, recurrent]
        return [*out, states.T @ error, error.sum(keepdims=True)]


# The words that the made-up layouts use; fixed values of the training data.
CONTENT = "article main content post entry story body text prose page blog news paragraph section single hentry copy lead markdown document".split()
ASIDES = {
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs toc tabs sitemap pagination pager skip".split(),
    "header": "header masthead banner top topbar site logo branding hero".split(),
    "footer": "footer bottom copyright legal colophon credits imprint disclaimer".split(),
    "sidebar": "sidebar aside rail widget related recommended trending popular more archive tags secondary complementary".split(),
    "notice": "notice cookie cookies consent gdpr alert warning message popup modal overlay toast paywall announcement privacy".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion dfp banner adsense teaser outbrain taboola".split(),
    "form": "form search newsletter signup subscribe login contact poll survey".split(),
    "comments": "comments comment respond replies reply discussion disqus thread feedback reviews".split(),
    "share": "share social sharing follow buttons tools actions meta byline author".split(),
}
PHRASES = {
    "menu": "home about contact us next previous services products login sign in skip to content".split(),
    "header": "welcome to the site of our official".split(),
    "footer": "© copyright all rights reserved terms privacy policy powered by".split(),
    "sidebar": "related read more most popular latest posts tags archive see also".split(),
    "notice": "we use cookies accept agree to continue this site by our policy dismiss".split(),
    "advert": "advertisement sponsored buy now offer free click here sale".split(),
    "form": "email name submit search subscribe your password message send".split(),
    "comments": "reply said comment likes report thanks great ago posted by user".split(),
    "share": "share tweet facebook print email save follow".split(),
}
NEUTRAL = "wrap wrapper container row col inner outer grid box layout block main page app root".split()
_TAGS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "aside", "p"], "advert": ["div", "aside", "ins"], "form": ["form"], "comments": ["section", "div", "ol"], "share": ["div", "ul"]}
_PREFIXES = "td fl wp et css js u l c x cb vc pg tpl".split()
_FACTS = "box facts data summary".split()
_KNOWN = frozenset(itertools.chain(CONTENT, *ASIDES.values(), NEUTRAL, _PREFIXES, _FACTS))
_SYLLABLES = "the an er on re in st of ti ou ha le ar se un de ca mi lo ver ge ion ung que ción".split()
_POOL = ["".join(s) for n in (1, 2, 3) for s in itertools.islice(itertools.product(_SYLLABLES, repeat=n), 0, 800, n)]


def _words(rng: random.Random, low: int, high: int) -> str:
    text = " ".join(rng.choices(_POOL, k=max(1, int(math.exp(rng.uniform(math.log(low), math.log(high + 1)))))))
    return text.capitalize() + ("." if rng.random() < 0.8 else "")


def _name(rng: random.Random, words: list[str], chance: float) -> str:
    """An attribute with one or two of the words, or with none of them."""
    if rng.random() >= chance:
        return f' class="{rng.choice(["c", "x", "b"])}{rng.randrange(1000)}"' if rng.random() < 0.2 else ""
    parts = rng.choices(words, k=rng.randrange(1, 3))
    if rng.random() < 0.3:  # a theme's or a program's own part, which tells nothing
        parts.insert(rng.randrange(2), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 7))))
    chosen = "-".join(parts)
    return f' {rng.choice(["class", "class", "id"])}="{chosen}"'


def _item(rng: random.Random, kind: str) -> str:
    own = " ".join(rng.choices(PHRASES[kind], k=rng.randrange(1, 5))) if rng.random() < 0.6 else _words(rng, 1, 6)
    long = kind in ("comments", "notice", "advert", "footer", "sidebar") and rng.random() < 0.5
    return own if not long else f"{own if rng.random() < 0.4 else ''} {_words(rng, 3, 40)}"


def _boilerplate(rng: random.Random, kind: str, plain: bool = False) -> str:
    """A container of one kind; ``plain`` ones have the tag or the name, never neither."""
    tag = rng.choice(_TAGS[kind])
    telling = tag in ("nav", "header", "footer", "aside", "form")
    name = _name(rng, ASIDES[kind], 0.5 if telling else 1.0)
    items = [_item(rng, kind) for _ in range(rng.randrange(1, 7))]
    style = rng.random()
    if kind in ("menu", "share") or style < 0.2:
        inside = "".join(f'<li><a href="#">{i}</a></li>' for i in items)
        inside = inside if tag in ("ul", "ol") else f"<ul>{inside}</ul>"
    elif kind == "form":
        inside = "".join(f"<label>{i}</label><input>" if rng.random() < 0.5 else f"<p>{i}</p>" for i in items) + "<button>Send</button>"
    elif tag in ("p", "ins") or style < 0.45:
        inside = " &middot; ".join(items[:2])
    elif style < 0.8:
        inside = "".join(f"<p>{i}</p>" for i in items)
    else:
        inside = (f"<h{rng.randrange(2, 5)}>{_item(rng, kind)}</h3>" if rng.random() < 0.7 else "") + "".join(f"<div>{i}</div>" for i in items)
    return f"<{tag}{name}>{inside}</{tag}>"


def _article(rng: random.Random) -> list[tuple[str, int]]:
    """Pieces of an article with their labels; some have boilerplate inside."""
    out: list[tuple[str, int]] = []
    kind = rng.random()
    if kind < 0.08:  # lines of one block, however short
        return [("<br>".join(_words(rng, 1, 30) if rng.random() < 0.6 else rng.choice(_POOL) for _ in range(rng.randrange(1, 8))), 1)]
    if rng.random() < 0.9:
        out.append((f"<h1>{_words(rng, 2, 14)}</h1>", 1))
    if kind < 0.16:  # facts in a table first
        out.append((f"<table{_name(rng, _FACTS, 0.8)}>{''.join(f'<tr><th>{_words(rng, 1, 2)}</th><td>{_words(rng, 1, 4)}</td></tr>' for _ in range(rng.randrange(1, 6)))}</table>", 1))
    for _ in range(rng.randrange(1, 14)):
        r = rng.random()
        if r < 0.72:
            out.append((f"<p>{'<b>' if rng.random() < 0.15 else ''}{_words(rng, 1, 160)}</p>", 1))
        elif r < 0.78:
            out.append((f"<h{rng.randrange(2, 4)}>{_words(rng, 1, 8)}</h2>", 1))
        elif r < 0.82:
            out.append((f"<ul>{''.join(f'<li>{_words(rng, 1, 20)}</li>' for _ in range(rng.randrange(1, 6)))}</ul>", 1))
        elif r < 0.85:
            out.append((f"<blockquote><p>{_words(rng, 4, 40)}</p></blockquote>", 1))
        elif r < 0.87:
            out.append((f"<table><tr><td>{_words(rng, 1, 4)}</td><td>{_words(rng, 1, 4)}</td></tr></table>", 1))
        elif r < 0.89:
            out.append((f"<p>{_words(rng, 2, 20)} <a href='#'>{_words(rng, 1, 6)}</a></p>", 1))
        elif r < 0.91:
            out.append((f"<pre><code>{_words(rng, 3, 30)}</code></pre>", 1))
        elif r < 0.93:
            out.append((f"<figure><figcaption>{_words(rng, 2, 12)}</figcaption></figure>", 1))
        else:
            out.append((_boilerplate(rng, rng.choice(["advert", "notice", "form", "share", "sidebar"])), 0))
    if rng.random() < 0.25:
        out.append((_boilerplate(rng, "comments"), 0))
    return out


class _Marked(Leaves):
    """Reads made-up pages, whose pieces stand in elements that tell their label and leave no trace in the paths."""

    def __init__(self):
        super().__init__()
        self.labels: list[bool] = []

    def add(self, text: str, share: float) -> None:
        super().add(text, share)
        self.labels.append(self.count["zz-kept"] > 0)

    def handle_starttag(self, tag, attrs):
        if tag.startswith("zz-"):
            self.close_block()
        super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag.startswith("zz-"):  # also ends what was left open inside
            self.close_block()
            self._pop(max(at for at, (name, _, _) in enumerate(self.open) if name == tag))
        else:
            super().handle_endtag(tag)

    def path(self, tag: str, names: str) -> Path:
        if tag.startswith("zz-"):
            return self.open[-1][1] if self.open else (0, "", 0)
        return super().path(tag, names)


def _wrapped(rng: random.Random, html: str, most: int) -> str:
    """Inside a few elements whose names tell nothing: layout words, a theme's prefix, made-up letters."""
    for _ in range(rng.randrange(most + 1)):
        name = "-".join([*rng.choices(_PREFIXES, k=rng.random() < 0.5), *rng.choices(NEUTRAL, k=rng.randrange(2)), *["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(rng.random() < 0.3)]])
        html = f'<div class="{name}">{html}</div>' if name else f"<div>{html}</div>"
    return html


def layout(rng: random.Random) -> tuple[list, np.ndarray]:
    """The blocks of a made-up page and their labels."""

    def marked(html: str, label: int) -> str:
        kind = "kept" if label else "gone"
        return f"<zz-{kind}>{html}</zz-{kind}>"

    before = [k for k in ("menu", "header", "notice", "advert", "sidebar", "form") if rng.random() < (0.7 if k == "menu" else 0.35)]
    after = [k for k in ("footer", "comments", "sidebar", "share", "advert", "notice", "form", "menu") if rng.random() < (0.8 if k == "footer" else 0.25)]
    nameless = rng.random() < 0.1  # names are made up; what is left are lists of links and footers
    if nameless:
        before, after = ["menu"], [k for k in after if k in ("footer", "menu", "share")]
    if rng.random() < 0.08:  # nothing but the article
        before, after = [], []
    rng.shuffle(before)

    def parts(kinds: list[str]) -> list[str]:
        made = [_boilerplate(rng, k) for k in kinds]
        told = [html for html in made if not nameless or "<li><a" in html or html.startswith("<footer")]
        return [marked(_wrapped(rng, html, 1 if rng.random() < 0.3 else 0), 0) for html in told]

    article = [(html, label) for html, label in (_article(rng) if rng.random() < 0.97 else []) if label or not nameless]
    plain = rng.random() < 0.15  # a page without paragraph elements
    pieces = "".join(marked(re.sub(r"(</?)p>", r"\1div>", html) if plain and label else html, label) for html, label in article)
    shell = rng.random()
    if shell < 0.4:
        pieces = f"<article{_name(rng, CONTENT, 0.4)}>{pieces}</article>"
    elif shell < 0.5:
        pieces = f"<main{_name(rng, CONTENT, 0.5)}>{pieces}</main>"
    elif shell < 0.72:
        pieces = f"<{rng.choice(['div', 'section'])}{_name(rng, CONTENT, 0.9)}>{pieces}</div>"
    pieces = _wrapped(rng, pieces, 3 if shell < 0.93 else 0)
    if rng.random() < 0.1:  # columns of a table
        side = parts([k for k in ("menu", "sidebar", "advert") if rng.random() < 0.6])
        body = "".join(parts(before)) + f"<table><tr><td>{''.join(side)}</td><td>{pieces}</td></tr></table>" + "".join(parts(after))
    else:
        body = "".join(parts(before)) + pieces + "".join(parts(after))
    body = _wrapped(rng, body, 2)
    if nameless:
        body = re.sub(r'(class|id)="[^"]*"', lambda m: f'{m[1]}="{rng.choice(_PREFIXES)}-{rng.choice(_POOL)}"', body)
    page = f"<html><head><title>{_words(rng, 2, 12)}</title></head><body{_name(rng, NEUTRAL, 0.2)}>{body}</body></html>"
    parser = _Marked()
    parser.feed(page)
    parser.close()
    parser.close_block()
    return parser.blocks, np.array(parser.labels, np.float32)


@cache
def trained(seed: int = SEED, steps: int = STEPS) -> Labeller:
    """A labeller trained with Adam on ``steps`` batches from ``PAGES`` made-up pages."""
    rng = random.Random(seed)
    made = [(vectors(blocks), labels) for blocks, labels in (layout(rng) for _ in range(PAGES)) if blocks]
    net = Labeller(np.random.default_rng(seed))
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = rng.sample(range(len(made)), len(made))
        pages, labels = zip(*(made[order.pop()] for _ in range(BATCH)), strict=True)
        grads = net.gradients(list(pages), np.concatenate(labels))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)) + 0.05)
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.weights[k] = (net.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def main_texts(net: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page: the blocks labelled as article text, joined by line breaks."""
    out = [""] * len(pages)
    blocks = [leaves(p) for p in pages]
    some = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
    for k in range(0, len(some), 128):
        part = some[k : k + 128]
        rows = vectors([b for i in part for b in blocks[i]])
        for i, kept in zip(part, net.label(np.split(rows, np.cumsum([len(blocks[i]) for i in part])[:-1])), strict=True):
            out[i] = "\n".join(text for (_, text, _), p in zip(blocks[i], kept.tolist(), strict=True) if p > 0.5)
    return out


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages``.

    A null or empty page, and one without an article, gives an empty text; equal rows give a row each; an empty table none.  A page is
    read whole, however long or deep; columns other than the three are not looked at.
    """
    net = pages.sparkSession.sparkContext.broadcast(trained())
    rows = pages.select(id_col, url_col, html_col).toDF("page_id", "url", "_html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(2).to_pylist()
            first = 0
            while first < len(html):
                held, size = [], 0
                while first + len(held) < len(html) and (not held or size < 2 << 20):
                    held.append(html[first + len(held)])
                    size += len(held[-1] or "")
                texts = main_texts(net.value, held)
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(held)) for c in batch.columns[:2]), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                first += len(held)

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
