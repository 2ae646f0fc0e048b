"""Main text of web pages: a recurrent labeller over the page's blocks.

A page is cut into blocks, the leaf texts between block-level tags.  Each block gives hashed
vectors of its tag path (names, class and id words) and of its words, and a few numbers; a
bidirectional LSTM in numpy reads the whole sequence and decides for every block, from both
sides of it, whether it belongs to the article.

The labeller is trained where it is used, on pages made by a generator with known labels (many
layouts of menus, headers, footers, sidebars, notices, adverts, forms and reader comments, with names that
say what they are and without, in nested elements and in tables), by
Adam on the driver, from fixed seeds; its size and its training set are parameters.

Defined results.  Null and empty html: empty text.  Scripts, styles, comments and the head are no blocks.
Character references are decoded, white space in a block (of any kind) becomes one space, ends
are trimmed, blocks left empty go; blocks are joined in page order by one newline.  Unclosed and
stray tags are borne: a head ends at the first element or text that cannot stand in it, and a
self-closed svg is empty; the text of formulas counts as any other.  Pages are read whole.  Repeated rows give equal rows; columns other
than page_id, url and html are not read.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .cluster import small_batches


@dataclass(frozen=True)
class Params:
    hidden: int = 16
    path_cells: int = 256
    word_cells: int = 64
    pages: int = 1500
    epochs: int = 7
    rate: float = 0.008
    seed: int = 5
    threshold: float = 0.5
    batch: int = 64
    cells: int = 1 << 15


# ---- blocks ----

#: Elements whose content is no text of the page.
RAW = "script|style|noscript|template|svg|iframe|object|textarea|select|title"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset(["hr"])
#: Elements that may stand in a head.
HEAD = frozenset("html head title base basefont bgsound link meta style script noscript noframes template".split())
#: Open elements that a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: The rest of a self-closed tag; a slash that ends an unquoted value belongs to the value.
_EMPTY = r"""(?:"[^"]*"|'[^']*'|=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+)|[^"'>=/]|=|/(?!>))*+/>"""
_TAG = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])(?:(?<=svg){_EMPTY}|[^>]*+>.*?(?:</\1\s*+>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*+)>|<[!?/][^>]*+>""",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def blocks_of(html: str | None) -> list[Block]:
    """The blocks with text, in page order."""
    html = html or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    parts: list[str] = []
    linked, links, in_head = 0, 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(n for _, names in stack for n in names), text, linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, in_head
        if in_head and text.strip():
            in_head = False
        if text and not in_head:
            parts.append(text)
            if links:
                linked += len(text)

    at = 0
    for m in _TAG.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if in_head and not m[2] and (name or (m[1] or "head").lower()) not in HEAD:
            in_head = False
        if not name:
            continue
        if name == "head":
            flush()
            in_head = not m[2]
        elif name == "a":
            links = 0 if m[2] else 1
        elif name == "br":
            add(" ")
        elif name in BLOCKS:
            flush()
            if name == "body":
                in_head = False
            if m[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                continue
            # a block starts: an open paragraph ends, and so do elements that cannot hold it
            if stack and stack[-1][0] == "p":
                stack.pop()
            while stack and stack[-1][0] in ENDS.get(name, ()):
                stack.pop()
            if name not in VOID:
                words = [w for found in _NAMES.findall(m[4]) for part in found for w in _WORD.findall(part.lower())] if m[4] else []
                stack.append((name, (name, *(f".{w}" for w in words))))
    add(html[at:])
    flush()
    return out


# ---- vectors ----

NUMBERS = 8
_BYTE = np.arange(256)
_STOPS, _SIGNS = (np.isin(_BYTE, np.frombuffer(c, np.uint8)) for c in (b".!?", b"|<>/"))
_CAPITALS, _DIGITS = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 48) & (_BYTE <= 57)
_path_cell: dict[str, int] = {}


def _cell(name: str, cells: int) -> int:
    known = _path_cell.get(name)
    if known is None:
        if len(_path_cell) > 100_000:
            _path_cell.clear()
        raw = np.frombuffer(name.encode(), np.uint8)
        known = _path_cell[name] = int(tk.span_hash(tk.byte_sums(raw, 3), np.array([0]), np.array([len(raw)]))[0] >> np.uint64(1))
    return known % cells


def vectors(blocks: list[Block], p: Params) -> np.ndarray:
    """(blocks, size): tag path, words, numbers."""
    n = len(blocks)
    x = np.zeros((n, p.path_cells + p.word_cells + NUMBERS), np.float32)
    for k, b in enumerate(blocks):
        for name in b.path:
            x[k, _cell(name, p.path_cells)] = 1
        if b.path:
            # the innermost element counts apart from those around it
            x[k, _cell("/" + b.path[-1], p.path_cells)] = 1
    buf, off = tk.text_buffer(pa.array([b.text for b in blocks], pa.string()))
    numbers = []
    for i, j in tk.chunks(off):
        part, rel = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        w = tk.Words(tk.LOWER[part], rel, tk.NON_ALNUM)
        words = np.maximum(w.per_text(), 1)
        cell = (w.hash % np.uint64(p.word_cells)).astype(np.int64)
        np.add.at(x[:, p.path_cells : p.path_cells + p.word_cells], (i + w.text_of(), cell), 1)
        count = lambda flag: tk.per_text_sum(flag, rel)
        size = np.maximum(np.diff(rel), 1)
        stops, signs, capitals, digits = (count(t[part]) for t in (_STOPS, _SIGNS, _CAPITALS, _DIGITS))
        numbers.append(np.stack([np.log1p(w.per_text()) / 4, stops / words, signs / words, capitals / size, digits / size], 1))
    if n:
        x[:, p.path_cells : p.path_cells + p.word_cells] = np.log1p(x[:, p.path_cells : p.path_cells + p.word_cells]) / 3
        x[:, -NUMBERS:-3] = np.concatenate(numbers)
        x[:, -3] = [b.linked / max(1, len(b.text)) for b in blocks]
        x[:, -2] = np.minimum(1.0, np.arange(n) / 8)
        x[:, -1] = np.minimum(1.0, np.arange(n)[::-1] / 8)
    return x


# ---- the network ----


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Lstm:
    """One direction.  Weights: x -> 4 gates, h -> 4 gates, bias."""

    def __init__(self, inputs: int, hidden: int, rng: np.random.Generator):
        self.hidden = hidden
        self.wx = rng.normal(0, 0.15, (inputs, 4 * hidden)).astype(np.float32)
        self.wh = rng.normal(0, 0.15, (hidden, 4 * hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x (steps, rows, inputs), mask (steps, rows): a masked step changes nothing."""
        steps, rows, _ = x.shape
        hid = self.hidden
        h, c = np.zeros((rows, hid), np.float32), np.zeros((rows, hid), np.float32)
        out = np.zeros((steps, rows, hid), np.float32)
        gates = x @ self.wx + self.b
        for t in range(steps):
            z = gates[t] + h @ self.wh
            s = _sigmoid(z[:, : 3 * hid])
            i, f, o, g = s[:, :hid], s[:, hid : 2 * hid], s[:, 2 * hid :], np.tanh(z[:, 3 * hid :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((h, c, i, f, o, g, tanh, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tanh, h)
            out[t] = h
        return out

    def backward(self, x: np.ndarray, keep: list, dout: np.ndarray) -> list[np.ndarray]:
        """Gradients of wx, wh, b for the gradient of the outputs."""
        hid = self.hidden
        dwx, dwh, db = np.zeros_like(self.wx), np.zeros_like(self.wh), np.zeros_like(self.b)
        dh_next, dc_next = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        for t in range(len(keep) - 1, -1, -1):
            h, c, i, f, o, g, tanh, m = keep[t]
            dh = dout[t] + dh_next
            do = dh * tanh
            dc = dc_next + dh * o * (1 - tanh**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), do * o * (1 - o), dc * i * (1 - g**2)], 1) * m
            dwx += x[t].T @ dz
            dwh += h.T @ dz
            db += dz.sum(0)
            dh_next = np.where(m, dz @ self.wh.T, dh)
            dc_next = np.where(m, dc * f, dc_next)
        return [dwx, dwh, db]


class Labeller:
    """Both directions and a logistic layer over both outputs."""

    def __init__(self, p: Params):
        rng = np.random.default_rng(p.seed)
        inputs = p.path_cells + p.word_cells + NUMBERS
        self.p, self.right, self.left = p, Lstm(inputs, p.hidden, rng), Lstm(inputs, p.hidden, rng)
        self.w = rng.normal(0, 0.2, 2 * p.hidden).astype(np.float32)
        self.w0 = np.zeros(1, np.float32)

    def _weights(self) -> list[np.ndarray]:
        return [self.right.wx, self.right.wh, self.right.b, self.left.wx, self.left.wh, self.left.b, self.w, self.w0]

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, pages))
        x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
        mask = np.zeros((steps, len(pages)), bool)
        for k, v in enumerate(pages):
            x[: len(v), k], mask[: len(v), k] = v, True
        return x, mask

    def _outputs(self, x, mask, keep=None):
        right = self.right.forward(x, mask, keep[0] if keep else None)
        left = self.left.forward(x[::-1], mask[::-1], keep[1] if keep else None)[::-1]
        return np.concatenate([right, left], 2)

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Of each block of each page; pages of like length go together, as many as stay under the cells when padded to the longest."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k, v in enumerate(pages) if len(v)), key=lambda k: len(pages[k]))
        while order:
            n = min(self.p.batch, len(order))
            while n > 1 and n * len(pages[order[n - 1]]) > self.p.cells:
                n -= 1
            some, order = order[:n], order[n:]
            x, mask = self.padded([pages[k] for k in some])
            prob = _sigmoid(self._outputs(x, mask) @ self.w + self.w0)
            for col, k in enumerate(some):
                out[k] = prob[: len(pages[k]), col]
        return out

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> Labeller:
        p, rng = self.p, np.random.default_rng(self.p.seed + 1)
        first = [np.zeros_like(w) for w in self._weights()]
        second = [np.zeros_like(w) for w in self._weights()]
        step = 0
        for _ in range(p.epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), 16):
                some = order[at : at + 16]
                x, mask = self.padded([pages[k] for k in some])
                y = np.zeros(mask.shape, np.float32)
                for col, k in enumerate(some):
                    y[: len(labels[k]), col] = labels[k]
                keep: tuple[list, list] = ([], [])
                h = self._outputs(x, mask, keep)
                d = (_sigmoid(h @ self.w + self.w0) - y) * mask / mask.sum()
                dh = d[:, :, None] * self.w
                hid = p.hidden
                grads = self.right.backward(x, keep[0], dh[:, :, :hid]) + self.left.backward(x[::-1], keep[1], dh[::-1, :, hid:])
                grads += [np.einsum("tr,trh->h", d, h), d.sum().reshape(1)]
                step += 1
                for w, g, a, b in zip(self._weights(), grads, first, second):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    w -= p.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
        return self


# ---- training pages ----


class PageMaker:
    """Pages of many layouts; each block is known to be of the article or not."""

    SYLLABLES = "ta re mo ki lan der sch ung tion el ar os un is en th an er in st qu ou ai eau men do ci ra ver be lo".split()
    FURNITURE = "home about contact login register search menu news products cart account help privacy terms cookies share follow subscribe newsletter sponsored copyright".split()
    WRAPPERS = ("article", "main", "section class='post'", "div class='content'", "div id='main-content'", "div class='entry article-body'", "article class='post'", "div class='story text'")
    AROUND = (
        ("nav", "ul/li/a"), ("div class='menu'", "ul/li/a"), ("header", "a"), ("header class='top'", "p"), ("div class='header banner'", "div"), ("footer", ""), ("footer", "p"), ("div id='footer'", "p"),
        ("aside", "p"), ("aside class='related'", "ul/li/a"), ("div class='sidebar'", "p"), ("div class='sidebar widget'", "ul/li"), ("div class='ad'", ""), ("div class='ad sponsored'", "p"), ("div class='advert promo'", "p"),
        ("div class='cookie notice'", "p"), ("div class='notice alert'", ""), ("section class='newsletter subscribe'", "p"), ("form", "p"), ("form class='search'", "label"), ("div class='share social'", "a"), ("div class='breadcrumb'", "a"),
        ("section id='comments'", "div class='comment'/p"), ("div class='comments'", "p"), ("ol class='comment list'", "li/p"), ("div class='pagination'", "a"),
    )

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.unnamed = 0.0

    def word(self) -> str:
        kind = self.rng.random()
        if kind < 0.3:  # letters as they come: no word is known for what it is
            return "".join(self.rng.choice("etaoinshrdlucmfwygpbvk") for _ in range(self.rng.randint(1, 9)))
        if kind < 0.34:
            return self.rng.choice(self.FURNITURE)
        return "".join(self.rng.choice(self.SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def sentence(self, least: int, most: int) -> str:
        words = [self.word() for _ in range(self.rng.randint(least, most))]
        if self.rng.random() < 0.15:
            words = [w + self.rng.choice(("###", "***", "%%%", "$$$", "!!", " |")) for w in words]
        if self.rng.random() < 0.1:
            words = [w.upper() for w in words]
        return " ".join(words).capitalize() + ("." if self.rng.random() < 0.85 else "")

    def prose(self) -> str:
        long = self.rng.random()
        return " ".join(self.sentence(1, 14) for _ in range(1 if long < 0.3 else self.rng.randint(1, 8)))

    def small(self) -> str:
        if self.rng.random() < 0.4:
            return " ".join(self.rng.choice(self.FURNITURE) for _ in range(self.rng.randint(1, 3)))
        return self.word() if self.rng.random() < 0.3 else self.sentence(1, 9)

    def inside(self, shape: str, text: str) -> str:
        for tag in reversed(shape.split("/") if shape else []):
            text = f"<{tag}>{text}</{tag.split()[0]}>" if tag != "a" else f'<a href="/x">{text}</a>'
        return text

    def part(self, wrapper: str, shape: str) -> str:
        count = self.rng.randint(1, 8) if "li" in shape or "comment" in wrapper else self.rng.randint(1, 3) if shape else 1
        prose = "comment" in wrapper or self.rng.random() < 0.35
        return f"<{wrapper}>" + "".join(self.inside(shape, self.prose() if prose else self.small()) for _ in range(count)) + f"</{wrapper.split()[0]}>"

    def name(self) -> str:
        """A class or id that says nothing."""
        return "-".join(self.rng.choice(self.SYLLABLES) + self.rng.choice(("", "", str(self.rng.randint(1, 99)))) for _ in range(self.rng.randint(1, 2)))

    def plain(self, tag: str = "div") -> str:
        """An element without a name, or with one that says nothing."""
        kind = self.rng.random()
        return tag if kind < 0.4 else f"{tag} class='{self.name()}'" if kind < 0.8 else f"{tag} id='{self.name()}'"

    def within(self, html: str, most: int) -> str:
        """In up to so many plain elements."""
        for _ in range(self.rng.randint(0, most)):
            html = f"<{self.plain()}>{html}</div>"
        return html

    def links(self) -> str:
        """A menu that nothing names: links, side by side or in a list."""
        texts = [self.small() for _ in range(self.rng.randint(2, 8))]
        if self.rng.random() < 0.5:
            return "<ul>" + "".join(f'<li><a href="/x">{t}</a></li>' for t in texts) + "</ul>"
        return self.rng.choice((" ", " | ")).join(f'<a href="/x">{t}</a>' for t in texts)

    def around(self) -> str:
        if self.rng.random() < self.unnamed:
            return self.within(self.links() if self.rng.random() < 0.7 else self.small(), 2) if self.rng.random() < 0.3 else f"<{self.plain()}>{self.links()}</div>"
        return self.part(*self.rng.choice(self.AROUND))

    def article(self) -> str:
        mark = "\x02"
        parts = []
        # of paragraphs: p, or div alone, or both
        block = self.rng.choice(("p", "p", "p", "p", "div", "mixed"))
        if self.rng.random() < 0.85:
            parts.append(f"<{(t := self.rng.choice(('h1', 'h1', 'h2')))}>{mark}{self.sentence(1, 10)}</{t}>")
        for _ in range(self.rng.choice((1, 2, 3, 5, 8, 14, 25))):
            kind = self.rng.random()
            text = mark + self.prose()
            if kind < 0.75:
                tag = block if block != "mixed" else self.rng.choice(("p", "div"))
                parts.append(f"<{self.plain() if tag == 'div' else tag}>{text}</{tag}>" if tag == "div" or self.rng.random() < 0.8 else f"<p><b>{text}<br>")
            elif kind < 0.82:
                parts.append(f"<h{self.rng.randint(2, 4)}>{text}</h2>")
            elif kind < 0.92:
                parts.append("<ul>" + "".join(f"<li>{mark}{self.sentence(2, 12)}</li>" for _ in range(self.rng.randint(1, 5))) + "</ul>")
            else:
                parts.append(f"<blockquote>{text}</blockquote>")
            if self.rng.random() < 0.06:
                parts.append(self.part(*self.rng.choice([a for a in self.AROUND if "ad" in a[0].split("'")[-2:][0].split() or "share" in a[0]])))
        if self.rng.random() < 0.12:  # readers' comments within the article
            parts.append(self.part(*self.rng.choice([a for a in self.AROUND if "comment" in a[0]])))
        inner = "".join(parts)
        if self.rng.random() < self.unnamed:
            return self.within(f"<{self.plain()}>{inner}</div>" if self.rng.random() < 0.85 else inner, 2)
        wrapper = self.rng.choice(self.WRAPPERS)
        return f"<{wrapper}>" + inner + f"</{wrapper.split()[0]}>"

    def page(self) -> tuple[list[Block], np.ndarray]:
        # of some pages most elements are named, of others few
        self.unnamed = self.rng.choice((0.0, 0.0, 0.1, 0.8))
        before = [self.around() for _ in range(self.rng.randint(0, 4))]
        after = [self.around() for _ in range(self.rng.randint(0, 4))]
        if self.rng.random() < 0.08:  # a table that lays the page out
            cell = lambda inner: f"<{self.plain('td')}>{inner}</td>"
            middle = "<table><tr>" + "".join(map(cell, [*before, self.article(), *after])) + "</tr></table>"
        else:
            middle = "".join([*before, self.article(), *after])
        if self.rng.random() < 0.3:
            middle = self.within(middle, 2)
        html = f"<html><head><title>{self.small()}</title></head><body>" + middle + "</body></html>"
        blocks = blocks_of(html)
        labels = np.array([b.text.startswith("\x02") for b in blocks], np.float32)
        return [Block(b.path, b.text.replace("\x02", ""), b.linked) for b in blocks], labels


_trained: dict[Params, Labeller] = {}


def trained(p: Params | None = None) -> Labeller:
    """The labeller for the parameters, trained on first use."""
    p = p or Params()
    if p not in _trained:
        maker = PageMaker(p.seed)
        made = [maker.page() for _ in range(p.pages)]
        made = [(b, y) for b, y in made if b]
        _trained[p] = Labeller(p).train([vectors(b, p) for b, _ in made], [y for _, y in made])
    return _trained[p]


# ---- the operator ----


def label(pages: list[list[Block]], labeller: Labeller) -> list[np.ndarray]:
    """Of each page: which blocks are of the article."""
    p = labeller.p
    flat = vectors([b for blocks in pages for b in blocks], p)
    ends = np.cumsum([0, *map(len, pages)])
    split = [flat[i:j] for i, j in zip(ends[:-1], ends[1:])]
    for v in split:
        # positions are those within the page
        n = len(v)
        v[:, -2], v[:, -1] = np.minimum(1.0, np.arange(n) / 8), np.minimum(1.0, np.arange(n)[::-1] / 8)
    return [q >= p.threshold for q in labeller.probabilities(split)]


def extract(pages: DataFrame, params: Params | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page, with the number of blocks and of those kept."""
    p = params or Params()
    small_batches(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(trained(p))

    def run(batches):
        for b in batches:
            blocks = [blocks_of(h) for h in b.column(2).to_pylist()]
            good = label(blocks, model.value)
            texts = ["\n".join(x.text for x, g in zip(own, keep) if g) for own, keep in zip(blocks, good)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in blocks], pa.int64()), pa.array([int(g.sum()) for g in good], pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
