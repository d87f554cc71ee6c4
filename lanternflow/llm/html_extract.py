"""Main text of web pages by a recurrent block labeller.

A page is read as the sequence of its leaf blocks. Each block has a vector: its tag path (tags, class and
id words, hashed, and how the path lies to that of the block's page where most text is), its words (hashed), its
length, share of link text, share of punctuation, and place. A bidirectional LSTM in numpy reads the whole sequence in
both directions, so that a block is judged with all of the document around it, and says main text or not for every block.

The labeller is trained here, on a bounded sample of pages. Their own markup is the teacher: blocks below
article or main are main text, unless they are below navigation, forms and the like. As markup differs
from site to site, each training page is also seen in other dress: other containers, with
headers, sidebars, notices, adverts, forms and reader comments around and inside it. Most class and id names of a dress are
invented or left out, so that the labeller has to judge by structure, lengths and neighbours, not by names.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG_DIM, NAME_DIM, WORD_DIM, EXTRA_DIM = 48, 24, 24, 11
PATH_DIM = 2 * TAG_DIM + NAME_DIM
DIM = PATH_DIM + WORD_DIM + EXTRA_DIM
HIDDEN = 16
SAMPLE_PAGES = 300
#: Blocks that are read at once.
LONG_PAGE = 8192

#: Fixed values of HTML: elements that end a block, have no content, or hold no text of the page.
BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that a new one of the same group closes.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    link_chars: int = 0


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order: text with references decoded, white space as one space, none empty."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    links = 0
    in_link = False

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(x for _, x in stack), text, links))
            parts.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                links += len(text)

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not m[2]
        elif tag in BLOCK:
            flush()
            in_link = False
            if m[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                if tag in _CLOSES and stack and stack[-1][0] in _CLOSES[tag]:
                    stack.pop()
                elif tag in BLOCK and stack and stack[-1][0] == "p":
                    stack.pop()
                if tag not in VOID:
                    names = " ".join(a or b or c for a, b, c in _NAMES.findall(m[4])) if m[4] else ""
                    stack.append((tag, f"{tag} {names}".strip().lower()))
    say(page[at:])
    flush()
    return out


#: Fixed values of HTML: elements that hold a run of text, or the parts of a list, table or quotation; without a name they are no container.
_FLOW = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tr td th caption blockquote pre figure figcaption summary".split())
_PATHS: dict[tuple[tuple[str, ...], tuple[str, ...]], np.ndarray] = {}
#: A container with this share of the text of the fullest one may be that of the main text; the first of them is taken.
_NEARLY_FULLEST = 0.4


def container_of(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path without its last element, if that holds a run of text, and without nameless lists and the like around it."""
    end = len(path)
    if end and path[end - 1].split(" ")[0] in _FLOW:
        end -= 1
    while end and path[end - 1] in _FLOW:
        end -= 1
    return path[:end]


def main_container(page: list[Block]) -> tuple[str, ...]:
    """The first container that holds nearly as much text outside links as the fullest one; article and main count four times."""
    mass: dict[tuple[str, ...], float] = {}
    for b in page:
        c = container_of(b.path)
        tags = {x.split(" ")[0] for x in c}
        mass[c] = mass.get(c, 0.0) + (len(b.text) - b.link_chars) * (4 if tags & {"article", "main"} else 1) * (not tags & {"head", "nav", "footer", "aside", "form"})
    most = max(mass.values(), default=0.0)
    return next((c for c, m in mass.items() if m >= _NEARLY_FULLEST * most), ())


def _path_vector(path: tuple[str, ...], main: tuple[str, ...]) -> np.ndarray:
    """Tags of the path, tags beyond what it shares with the main container, names, and how far it is from that container."""
    found = _PATHS.get((path, main))
    if found is None:
        found = np.zeros(PATH_DIM + 5, dtype=np.float32)
        shared = 0
        while shared < min(len(path), len(main)) and path[shared] == main[shared]:
            shared += 1
        own = len(container_of(path))
        for depth, element in enumerate(path):
            tag, *names = re.split(r"[\s_-]+", element)
            found[zlib.crc32(tag.encode()) % TAG_DIM] += 1.0
            if depth >= shared:
                found[TAG_DIM + zlib.crc32((tag + ":named" * (bool(names) and depth < own)).encode()) % TAG_DIM] += 1.0
            for n in names:
                found[2 * TAG_DIM + zlib.crc32(n.encode()) % NAME_DIM] += 1.0
        found = np.minimum(found, 2.0)
        beyond = [x for x in path[shared:own]]
        found[PATH_DIM:] = (own == shared == len(main), shared == len(main), len(beyond) / 3, sum(" " in x for x in beyond) / 2, (len(main) - shared) / 3)
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        _PATHS[path, main] = found
    return found


def vectors(page: list[Block], main: tuple[str, ...] | None = None, first: int = 0, total: int | None = None) -> np.ndarray:
    """A row for each block. Of a part of a page: main container, number of the first block and of all blocks of the page."""
    main = main_container(page) if main is None else main
    total = total or len(page)
    out = np.zeros((len(page), DIM), dtype=np.float32)
    for k, b in enumerate(page):
        path = _path_vector(b.path, main)
        out[k, :PATH_DIM] = path[:PATH_DIM]
        words = b.text.lower().encode().split()
        hashed = np.bincount([zlib.crc32(w) % WORD_DIM for w in words], minlength=WORD_DIM)
        n = len(b.text)
        at = first + k
        out[k, PATH_DIM : PATH_DIM + WORD_DIM] = hashed / (1 + len(words))
        out[k, PATH_DIM + WORD_DIM :] = (np.log1p(n) / 5, b.link_chars / n, sum(map(b.text.count, ".,;:!?")) / n, at / total, 1 / (1 + at), 1 / (total - at), *path[PATH_DIM:])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Two LSTMs and a logistic layer on both of their states."""

    w: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        w = {}
        for side in ("f", "b"):
            w[f"x{side}"] = rng.normal(0, DIM**-0.5, (DIM, 4 * HIDDEN)).astype(np.float32)
            w[f"h{side}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w[f"c{side}"] = np.zeros(4 * HIDDEN, dtype=np.float32)
            w[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1.0
        w["out"] = rng.normal(0, 0.1, (2 * HIDDEN, 1)).astype(np.float32)
        w["bias"] = np.zeros(1, dtype=np.float32)
        return Labeller(w)

    def _scan(self, x: np.ndarray, mask: np.ndarray, side: str, state: tuple | None = None, tape: list | None = None) -> tuple[np.ndarray, tuple]:
        """States of one direction and the last state. x: steps, pages, DIM; a step past a page's end leaves its state as it is.

        state: where to begin. tape: filled with what _back() needs; labelling keeps none.
        """
        steps, n, _ = x.shape
        order = range(steps) if side == "f" else range(steps - 1, -1, -1)
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out = np.zeros((steps, n, HIDDEN), np.float32)
        into = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        for t in order:
            z = into[t] + h @ self.w[f"h{side}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = m * (f * c + i * g) + (1 - m) * c
            tanh_c = np.tanh(new_c)
            new_h = m * (o * tanh_c) + (1 - m) * h
            if tape is not None:
                tape.append((t, i, f, o, g, c, tanh_c, h, m))
            h, c = new_h, new_c
            out[t] = h
        return out, (h, c)

    def _back(self, x: np.ndarray, d_out: np.ndarray, tape: list, side: str) -> dict[str, np.ndarray]:
        d_z = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        d_wh = np.zeros_like(self.w[f"h{side}"])
        d_h = np.zeros(d_out.shape[1:], np.float32)
        d_c = np.zeros_like(d_h)
        for t, i, f, o, g, c, tanh_c, h, m in reversed(tape):
            d_h = d_h + d_out[t]
            own = d_h * m
            inner = d_c * m + own * o * (1 - tanh_c**2)
            d_z[t] = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f), own * tanh_c * o * (1 - o), inner * i * (1 - g**2)], axis=1)
            d_wh += h.T @ d_z[t]
            d_h = d_h * (1 - m) + d_z[t] @ self.w[f"h{side}"].T
            d_c = d_c * (1 - m) + inner * f
        flat = d_z.reshape(-1, 4 * HIDDEN)
        return {f"x{side}": x.reshape(-1, DIM).T @ flat, f"h{side}": d_wh, f"c{side}": flat.sum(axis=0)}

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """How likely each block of each page is main text. Pages of like length are read together, a long page in parts."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            if len(pages[order[at]]) > LONG_PAGE:
                out[order[at]] = self._long(pages[order[at]])
                at += 1
                continue
            end = at + 1
            while end < len(order) and end - at < 256 and (end - at + 1) * len(pages[order[end]]) <= LONG_PAGE:
                end += 1
            own = order[at:end]
            x, mask = _padded([vectors(pages[k]) for k in own])
            states = np.concatenate([self._scan(x, mask, s)[0] for s in ("f", "b")], axis=2)
            p = _sigmoid(states @ self.w["out"] + self.w["bias"])[:, :, 0]
            for k, i in enumerate(own):
                out[i] = p[: len(pages[i]), k]
            at = end
        return out

    def _long(self, page: list[Block]) -> np.ndarray:
        """One page, LONG_PAGE blocks at a time in each direction; the state goes on from part to part."""
        main = main_container(page)
        total = np.zeros(len(page), np.float32) + self.w["bias"]
        for side, weights in (("f", self.w["out"][:HIDDEN]), ("b", self.w["out"][HIDDEN:])):
            state = None
            begins = range(0, len(page), LONG_PAGE)
            for k in begins if side == "f" else reversed(begins):
                x = vectors(page[k : k + LONG_PAGE], main, k, len(page))[:, None, :]
                states, state = self._scan(x, np.ones(x.shape[:2], np.float32), side, state)
                total[k : k + len(x)] += (states @ weights)[:, 0, 0]
        return _sigmoid(total)

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        tf: list = []
        tb: list = []
        hf, hb = self._scan(x, mask, "f", tape=tf)[0], self._scan(x, mask, "b", tape=tb)[0]
        states = np.concatenate([hf, hb], axis=2)
        p = _sigmoid(states @ self.w["out"] + self.w["bias"])[:, :, 0]
        total = max(1.0, float(mask.sum()))
        d = ((p - y) * mask / total).astype(np.float32)
        loss = -float((mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum()) / total
        d_states = d[:, :, None] * self.w["out"][:, 0]
        grads = {"out": (states * d[:, :, None]).sum(axis=(0, 1))[:, None], "bias": np.array([d.sum()], np.float32)}
        grads |= self._back(x, d_states[:, :, :HIDDEN], tf, "f") | self._back(x, d_states[:, :, HIDDEN:], tb, "b")
        return loss, grads


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), DIM), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = 1
    return x, mask


_NOT_MAIN = set("nav header footer aside form button select option label menu title head noscript iframe dialog".split())
_NOT_MAIN_NAMES = set("ad ads advert advertisement banner sidebar menu nav navbar breadcrumb breadcrumbs comments comment cookie notice footer header promo sponsored related share social newsletter subscribe login widget".split())


def teacher(page: list[Block]) -> np.ndarray:
    """What the markup says: 1 below article or main and below nothing that is not main text."""
    out = np.zeros(len(page), np.float32)
    for k, b in enumerate(page):
        inside = False
        for element in b.path:
            tag, *names = re.split(r"[\s_-]+", element)
            if tag in ("article", "main"):
                inside = True
            if tag in _NOT_MAIN or _NOT_MAIN_NAMES & set(names):
                inside = False
                break
        out[k] = inside
    return out


#: What invented names are made of.
_SYLLABLES = "ba ce di fo gu ha ji ko lu me na pi ro su te vo wa xy zo bri cla dro fle gno pra sti tru".split()


def dressed(page: list[Block], truth: np.ndarray, rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page in other markup: other containers for the main text, and boilerplate of all kinds around and in it."""
    pick = lambda options: str(options[int(rng.integers(len(options)))])
    invented: dict[str, str] = {}

    def renamed(path: tuple[str, ...], bare: float) -> tuple[str, ...]:
        """The path with its names left out (this often), kept (a fifth), or each replaced by an invented one, the same on the whole page."""
        out = []
        for element in path:
            tag, *names = element.split(" ", 1)
            if names and names[0] not in invented:
                r = rng.random()
                word = "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(2, 5))))
                invented[names[0]] = names[0] if r < 0.2 else word if r < 0.8 else f"{word}-{pick(_SYLLABLES)}"
            out.append(tag if not names or rng.random() < bare else f"{tag} {invented[names[0]]}")
        return tuple(out)

    outer = pick(["", "div page", "div wrapper", "div container"])
    base = ("html", "body", *([outer] if outer else []))

    def pick_path(options: list[tuple[str, ...]]) -> tuple[str, ...]:
        return options[int(rng.integers(len(options)))]

    main = base + renamed(pick_path([("article",), ("main",), ("main", "article"), ("div content", "article"), ("div post",), ("div entry-content",), ("div article-body",), ("section story",), ("div main-content",), ("article post",), ("div left", "div text"), ("section",), ("article",), ("article",)]), 0.3)
    texts = [b.text for b in page]
    some = lambda most: " ".join(pick(texts).split()[: int(rng.integers(1, most))]) or "x"

    def junk(where: tuple[str, ...], most: int, count: int, link: bool) -> list[Block]:
        # Inside the main text only a name or the kind of element sets it apart, so names stay there.
        inside = where[: len(main)] == main
        where = (*main, *renamed(where[len(main) :], 0.0)) if inside else (*base, *renamed(where[len(base) :], 0.25))
        rows = [some(most) for _ in range(count)]
        return [Block(where, t, len(t) if link else 0) for t in rows]

    menu = lambda: junk(base + pick_path([("nav", "ul", "li"), ("div menu", "ul", "li"), ("header", "nav", "li"), ("header",), ("header site-header", "div"), ("div navbar", "a")]), 3, int(rng.integers(1, 9)), True)
    notice = lambda: junk(base + pick_path([("div cookie-notice", "p"), ("div notice",), ("div banner", "p"), ("dialog", "p"), ("div ad",), ("div advert",), ("div promo",), ("aside ad",), ("div sponsored", "p"), ("div newsletter", "form"), ("form", "label"), ("form", "button"), ("form search",)]), 30, int(rng.integers(1, 3)), False)
    side = lambda: junk(base + pick_path([("aside", "p"), ("aside sidebar", "ul", "li"), ("div sidebar", "p"), ("div widget", "li"), ("div related", "ul", "li"), ("aside",)]), 25, int(rng.integers(1, 5)), bool(rng.integers(2)))
    comments = lambda where: junk(where + pick_path([("div comments", "p"), ("section comments", "div comment", "p"), ("ol comment-list", "li comment", "p"), ("div comment",), ("section comments", "p"), ("div replies", "div", "p"), ("div replies", "ul", "li")]), 60, int(rng.integers(1, 7)), False)
    foot = lambda: junk(base + pick_path([("footer",), ("footer", "p"), ("div footer", "p"), ("footer site-footer", "ul", "li")]), 12, int(rng.integers(1, 4)), False)
    rows: list[tuple[Block, int]] = [(Block(("html", "head", "title"), some(10)), 0)] if rng.integers(2) else []
    for part in (menu, notice, side):
        if rng.random() < 0.7:
            rows += [(b, 0) for b in part()]
    inner = pick_path([(), (), ("div",), ("section",)])
    good = [b for b, y in zip(page, truth) if y]
    if good and rng.random() < 0.4:  # short articles, too
        good = good[: int(rng.integers(1, len(good) + 1))]
    for b in good:
        leaf = (b.path[-1].split()[0] if b.path else "p",)
        if rng.random() < 0.25:
            leaf = pick_path([("h2",), ("h3",), ("ul", "li"), ("ol", "li"), ("blockquote",), ("blockquote", "p"), ("table", "tr", "td"), ("pre",), ("div",), ("div", "p"), ("section", "p"), ("figure", "figcaption"), ("p lead",), ("h2 part",), ("li item",)])
            leaf = renamed(leaf, 0.3)
        text = some(12) if leaf[0] in ("h2", "h3") or rng.random() < 0.1 else b.text
        rows.append((Block(main + inner + leaf, text, min(b.link_chars, len(text))), 1))
        if rng.random() < 0.08:
            rows += [(x, 0) for x in junk(main + pick_path([("div ad",), ("aside",), ("aside", "p"), ("aside", "ul", "li"), ("div share", "ul", "li"), ("form",), ("form", "label"), ("figure ad",), ("div notice",), ("div notice", "p"), ("nav", "ul", "li"), ("footer",)]), 40, int(rng.integers(1, 3)), rng.random() < 0.3)]
    if rng.random() < 0.3:
        rows += [(x, 0) for x in junk(main + pick_path([("aside",), ("aside", "p"), ("aside note", "p")]), 50, int(rng.integers(1, 4)), False)]
    if rng.random() < 0.6:
        rows += [(b, 0) for b in comments(main if rng.random() < 0.6 else base)]
    for part in (side, notice, foot):
        if rng.random() < 0.7:
            rows += [(b, 0) for b in part()]
    return [b for b, _ in rows], np.array([y for _, y in rows], np.float32)


def fit(pages: list[str], epochs: int = 8, dresses: int = 7, longest: int = 96, seed: int = 5) -> Labeller:
    """A labeller trained on sample pages. Long pages are trained on in parts of `longest` blocks; labelling reads them whole."""
    rng = np.random.default_rng(seed)
    examples: list[tuple[np.ndarray, np.ndarray]] = []
    for page in pages:
        own = blocks(page)
        truth = teacher(own)
        for k in range(1 + dresses):
            b, y = (own, truth) if k == 0 else dressed(own, truth, rng) if own else (own, truth)
            if b:
                x = vectors(b)
                examples += [(x[j : j + longest], y[j : j + longest]) for j in range(0, len(b), longest)]
    model = Labeller.new(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    count = 0
    for epoch in range(epochs):
        order = rng.permutation(len(examples))
        order = order[np.argsort([len(examples[k][0]) // 16 for k in order], kind="stable")]
        batches = [order[k : k + 32] for k in range(0, len(order), 32)]
        for b in rng.permutation(len(batches)):
            own = [examples[k] for k in batches[b]]
            x, mask = _padded([e[0] for e in own])
            y = np.zeros_like(mask)
            for k, e in enumerate(own):
                y[: len(e[1]), k] = e[1]
            _, grads = model.step(x, mask, y)
            count += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for name, g in grads.items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.w[name] -= rate * (first[name] / (1 - 0.9**count)) / (np.sqrt(second[name] / (1 - 0.999**count)) + 1e-8)
    return model


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Labeller:
    """A labeller trained on at most sample_pages pages, chosen by a hash of their id."""
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").filter("page_id is not null and html is not null")
    # Ids are chosen first: tasks send no html but that of the sample.
    chosen = known.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    rows = known.join(F.broadcast(chosen.distinct()), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).orderBy(F.xxhash64("page_id")).collect()
    return fit([r["html"] for r in rows])


def main_text(page: list[Block], probability: np.ndarray) -> str:
    return "\n\n".join(b.text for b, p in zip(page, probability) if p >= 0.5)


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages.

    A null or empty html, and a page without main text, have an empty text. Rows that repeat are extracted each;
    null ids and urls are kept. Other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                read = [blocks(h or "") for h in part.column(2).to_pylist()]
                marks = model.probabilities(read)
                texts = [main_text(b, p) for b, p in zip(read, marks)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
