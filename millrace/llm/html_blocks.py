"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of text blocks. Each block is a vector: hashed
tokens of its tag path (tags, classes, ids, roles), hashed words of its whole
text, and a few ratios. A bidirectional LSTM in numpy reads the sequence in
both directions and labels every block, so a block's label depends on the
whole page. The text is that of the blocks labelled as content.

The model is fitted in the job on at most ``SAMPLE_PAGES`` pages of at most
``SAMPLE_CHARS`` characters. Their labels come from markup that says what a
block is (article, main, nav, footer, ...); made-up page frames around the
same blocks show it layouts that the sample lacks. The fit is seeded, and its
sample is a fixed draw of distinct pages by hash, so equal tables give equal
models. Where no page of the sample has marked content, the model is fitted on
made-up pages alone (``prior_pages``) and knows names of tags and classes only.

Defined results: a null or empty page, and one without content blocks, has the
empty text; equal rows are labelled each on its own; null ids and urls are
kept; an empty table gives an empty table; other columns stay, and ones named
as an added column are replaced by it.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.text import add_columns

SAMPLE_PAGES = 300
SAMPLE_CHARS = 40_000
PATH_SIZE, WORD_SIZE, RATIOS = 256, 64, 5
HIDDEN = 24
EPOCHS = 30
# Blocks (padding included) that one pass of the network takes.
BLOCKS_AT_ONCE = 16_384

# Elements of HTML by how they take part in text.
# Raw text up to the end tag, and elements whose blocks are dropped while they are open.
RAW = "script style title textarea iframe xmp noembed noframes".split()
UNREAD = frozenset("noscript template select button object svg math canvas audio video".split())
# Tags that end an open svg or math element, except inside elements that hold HTML.
BREAKS_OUT = frozenset("article section main div p h1 h2 h3 h4 h5 h6 ul ol dl li table blockquote pre".split())
HOLDS_HTML = frozenset("foreignobject desc annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSED_BY_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# What markup says about a block, for the labels of the sample.
FRAME_TAGS = frozenset("nav footer aside form menu dialog".split())
FRAME_NAMES = frozenset(
    "ad ads advert advertisement banner promo sponsor sponsored cookie cookies consent notice alert popup modal newsletter subscribe sidebar widget related share sharing social menu nav navigation navbar breadcrumb breadcrumbs pagination pager comment comments reply replies disqus footer login search toolbar masthead".split()
)
CONTENT_TAGS = frozenset(["article", "main"])

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<(" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+(?<!/)>(?:.*?</\1(?=[\s/>]|\Z)[^>]*+(?:>|\Z)|.*)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'>]+))", re.I)
_NAME_PART = re.compile(r"[a-z0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")
_DIGIT = re.compile(r"[0-9]")


@dataclass(frozen=True)
class Block:
    """Text of one block, the tokens of its path from the outside in, and the share of it inside links."""

    path: tuple[str, ...]
    text: str
    linked: float


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in order, character references decoded and white space collapsed."""
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    parts: list[str] = []
    path: tuple[str, ...] = ()
    linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(path, text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def read(raw: str) -> None:
        nonlocal path, linked
        if any(tag in UNREAD for tag, _ in stack):
            return
        text = html.unescape(raw) if "&" in raw else raw
        if text.strip():
            if not any(p.strip() for p in parts):
                path = tuple(t for _, tokens in stack for t in tokens)
            if any(tag == "a" for tag, _ in stack):
                linked += len(text.strip())
        parts.append(text)

    for match in _TAG.finditer(page):
        if match.start() > at:
            read(page[at : match.start()])
        at = match.end()
        dropped, slash, name, attributes = match.groups()
        if not name:
            if dropped and dropped.lower() not in INLINE:
                flush()
            continue
        tag = name.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if slash:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in VOID:
            if tag in BREAKS_OUT:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in HOLDS_HTML:
                        break
                    if stack[i][0] in ("svg", "math"):
                        del stack[i:]
                        break
            closes = CLOSED_BY_ITSELF.get(tag)
            if closes:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
            if not attributes.rstrip().endswith("/"):
                names = [part for found in _NAMED.findall(attributes) for part in _NAME_PART.findall("".join(found).lower())]
                stack.append((tag, (f"<{tag}>", *(f".{n}" for n in names))))
    if at < len(page):
        read(page[at:])
    flush()
    return out


def marked_label(path: tuple[str, ...]) -> int | None:
    """What the markup of a path says: 1 content, 0 frame, None if it says nothing."""
    content = any(token[1:-1] in CONTENT_TAGS for token in path if token[0] == "<")
    outer = True
    for token in path:
        if token[0] == "<":
            outer = outer and token[1:-1] not in CONTENT_TAGS
            if token[1:-1] in FRAME_TAGS or (token == "<header>" and outer):
                return 0
        elif token[1:] in FRAME_NAMES:
            return 0
    return 1 if content else None


class Features:
    """Vectors of blocks; remembers those of paths."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) > 20_000:
                self.paths.clear()
            vector = np.zeros(PATH_SIZE, dtype=np.float32)
            for token in set(path):
                vector[zlib.crc32(token.encode()) % PATH_SIZE] = 1.0
            self.paths[path] = vector
        return self.paths[path]

    def _words(self, text: str) -> np.ndarray:
        known = self.words
        if len(known) > 200_000:
            known.clear()
        places = []
        for word in text.split(" "):
            place = known.get(word)
            if place is None:
                place = known[word] = zlib.crc32(word.lower().encode()) % WORD_SIZE
            places.append(place)
        counts = np.bincount(places, minlength=WORD_SIZE).astype(np.float32)
        return counts / np.float32(max(1, len(places)))

    def matrix(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE + RATIOS), dtype=np.float32)
        for i, block in enumerate(blocks):
            n = len(block.text)
            out[i, :PATH_SIZE] = self._path(block.path)
            out[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = self._words(block.text)
            out[i, PATH_SIZE + WORD_SIZE :] = (
                np.log1p(n) / 8, block.linked, len(_PUNCTUATION.findall(block.text)) / n, len(_DIGIT.findall(block.text)) / n, i / len(blocks),
            )
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class BidirectionalLSTM:
    """One LSTM each way and a logistic output per step, with its own gradients."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.weights: dict[str, np.ndarray] = {}
        for way in ("forth", "back"):
            self.weights[f"{way}_x"] = rng.normal(0, 0.15, (inputs, 4 * hidden)).astype(np.float32)
            self.weights[f"{way}_h"] = rng.normal(0, 0.15, (hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, dtype=np.float32)
            bias[hidden : 2 * hidden] = 1.0
            self.weights[f"{way}_b"] = bias
        self.weights["out"] = rng.normal(0, 0.3, 2 * hidden).astype(np.float32)
        self.weights["out_b"] = np.zeros(1, dtype=np.float32)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        steps, n, _ = x.shape
        h_size = self.hidden
        z_x = x @ self.weights[f"{way}_x"] + self.weights[f"{way}_b"]
        h = np.zeros((n, h_size), dtype=np.float32)
        c = np.zeros_like(h)
        states = np.zeros((steps, n, h_size), dtype=np.float32)
        kept = {}
        for t in range(steps) if way == "forth" else range(steps - 1, -1, -1):
            z = z_x[t] + h @ self.weights[f"{way}_h"]
            gates = _sigmoid(z[:, : 3 * h_size])
            i, f, o = gates[:, :h_size], gates[:, h_size : 2 * h_size], gates[:, 2 * h_size :]
            g = np.tanh(z[:, 3 * h_size :])
            m = mask[t][:, None]
            fresh = f * c + i * g
            bent = np.tanh(fresh)
            if keep:
                kept[t] = (h, c, i, f, o, g, bent, m)
            c = m * fresh + (1 - m) * c
            h = m * (o * bent) + (1 - m) * h
            states[t] = h
        return states, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run("forth", x, mask, False)[0], self._run("back", x, mask, False)[0]], axis=2)
        return both @ self.weights["out"] + self.weights["out_b"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Mean log loss over weighted steps, and its gradients."""
        steps, n, _ = x.shape
        h_size = self.hidden
        runs = {way: self._run(way, x, mask, True) for way in ("forth", "back")}
        both = np.concatenate([runs["forth"][0], runs["back"][0]], axis=2)
        p = _sigmoid(both @ self.weights["out"] + self.weights["out_b"])
        total = max(1.0, float(weight.sum()))
        loss = float((-weight * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum()) / total
        d_logit = (weight * (p - y) / total).astype(np.float32)
        grads = {"out": np.einsum("tn,tnh->h", d_logit, both), "out_b": d_logit.sum(keepdims=True).reshape(1)}
        d_both = d_logit[:, :, None] * self.weights["out"]
        for k, way in enumerate(("forth", "back")):
            kept = runs[way][1]
            d_z_all = np.zeros((steps, n, 4 * h_size), dtype=np.float32)
            d_w_h = np.zeros_like(self.weights[f"{way}_h"])
            d_h = np.zeros((n, h_size), dtype=np.float32)
            d_c = np.zeros_like(d_h)
            for t in range(steps - 1, -1, -1) if way == "forth" else range(steps):
                h, c, i, f, o, g, bent, m = kept[t]
                d_h = d_h + d_both[t][:, k * h_size : (k + 1) * h_size]
                d_fresh = m * (d_c + d_h * o * (1 - bent**2))
                d_z = np.concatenate(
                    [d_fresh * g * i * (1 - i), d_fresh * c * f * (1 - f), m * d_h * bent * o * (1 - o), d_fresh * i * (1 - g**2)], axis=1
                ).astype(np.float32)
                d_z_all[t] = d_z
                d_w_h += h.T @ d_z
                d_h = d_z @ self.weights[f"{way}_h"].T + (1 - m) * d_h
                d_c = d_fresh * f + (1 - m) * d_c
            grads[f"{way}_x"] = x.reshape(steps * n, -1).T @ d_z_all.reshape(steps * n, -1)
            grads[f"{way}_h"] = d_w_h
            grads[f"{way}_b"] = d_z_all.sum(axis=(0, 1))
        return loss, grads


def _padded(matrices: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(m) for m in matrices)
    x = np.zeros((steps, len(matrices), matrices[0].shape[1]), dtype=np.float32)
    mask = np.zeros((steps, len(matrices)), dtype=np.float32)
    for k, m in enumerate(matrices):
        x[: len(m), k] = m
        mask[: len(m), k] = 1
    return x, mask


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, seed: int = 11, rate: float = 0.01) -> BidirectionalLSTM:
    """Adam on shuffled batches of pages of like length, until the loss is small or the epochs are over."""
    features = Features()
    data = sorted(((features.matrix(blocks), np.array(labels, dtype=np.float32)) for blocks, labels in pages if blocks), key=lambda d: len(d[1]))
    model = BidirectionalLSTM(PATH_SIZE + WORD_SIZE + RATIOS, seed=seed)
    rng = np.random.default_rng(seed)
    if not data:
        raise ValueError("no page with blocks to fit on")
    groups = [data[i : i + 24] for i in range(0, len(data), 24)]
    means = {k: np.zeros_like(w) for k, w in model.weights.items()}
    squares = {k: np.zeros_like(w) for k, w in model.weights.items()}
    step = 0
    for _ in range(epochs):
        losses = []
        for g in rng.permutation(len(groups)).tolist():
            x, mask = _padded([m for m, _ in groups[g]])
            y = np.zeros_like(mask)
            for k, (_, labels) in enumerate(groups[g]):
                y[: len(labels), k] = labels
            loss, grads = model.gradients(x, mask, y, mask)
            losses.append(loss)
            step += 1
            for name, grad in grads.items():
                means[name] = 0.9 * means[name] + 0.1 * grad
                squares[name] = 0.999 * squares[name] + 0.001 * grad**2
                move = means[name] / (1 - 0.9**step) / (np.sqrt(squares[name] / (1 - 0.999**step)) + 1e-8)
                model.weights[name] = (model.weights[name] - rate * move).astype(np.float32)
        if np.mean(losses) < 0.0005:
            break
    return model


def framed(pages: list[tuple[list[Block], list[int]]], seed: int = 11, copies: int = 2) -> list[tuple[list[Block], list[int]]]:
    """The content blocks of labelled pages inside made-up frames of many kinds."""
    rng = np.random.default_rng(seed)
    wrappers = [("<article>",), ("<main>",), ("<main>", "<article>"), ("<div>", ".content"), ("<div>", ".post", ".body"), ("<div>", ".article", ".text"), ("<section>", ".story"), ("<div>", ".entry"), ("<div>", "<article>", ".post")]
    names, tags = sorted(FRAME_NAMES), sorted(FRAME_TAGS | {"header"})
    spoken = [b.text for blocks, _ in pages for b in blocks]

    def frame(inside: tuple[str, ...]) -> list[Block]:
        wrap = (f"<{tags[rng.integers(len(tags))]}>",) if rng.random() < 0.4 else ("<div>" if rng.random() < 0.7 else "<section>", f".{names[rng.integers(len(names))]}")
        inner = [("<p>",), ("<ul>", "<li>", "<a>"), ("<div>",), ("<h2>",), ("<span>",), ("<div>", "<p>")][rng.integers(6)]
        return [Block((*inside, *wrap, *inner), spoken[rng.integers(len(spoken))], float("<a>" in inner)) for _ in range(rng.integers(1, 5))]

    out = []
    for _ in range(copies):
        for blocks, labels in pages:
            body = [b for b, label in zip(blocks, labels, strict=True) if label]
            if not body or len(body) > 60:
                continue
            outer = ("<html>", "<body>")
            if rng.random() < 0.3:
                outer += ("<div>", [".page", ".wrapper", ".container", ".site"][rng.integers(4)])
            inside = (*outer, *wrappers[rng.integers(len(wrappers))])
            made: list[tuple[Block, int]] = []
            for _ in range(rng.integers(0, 4)):
                made += [(b, 0) for b in frame(outer)]
            for k, b in enumerate(body):
                last = b.path[-1] if b.path and b.path[-1][0] == "<" else "<p>"
                tag = last if last in {"<h1>", "<h2>", "<p>", "<li>", "<b>"} else ["<p>", "<li>", "<blockquote>", "<td>", "<pre>"][rng.integers(5)]
                made.append((Block((*inside, tag), b.text, b.linked), 1))
                if k and rng.random() < 0.05:
                    made += [(f, 0) for f in frame(inside)]
            for _ in range(rng.integers(0, 4)):
                made += [(b, 0) for b in frame(inside if rng.random() < 0.3 else outer)]
            out.append(([b for b, _ in made], [label for _, label in made]))
    return out


def prior_pages(pages: int = 60, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Made-up articles of meaningless words in made-up frames."""
    rng = np.random.default_rng(seed)

    def sentence() -> str:
        return " ".join("w" + "abcdefghij"[rng.integers(10)] * rng.integers(1, 8) for _ in range(rng.integers(5, 40))) + "."

    bodies = [[Block(("<article>", "<p>"), sentence(), 0.0) for _ in range(rng.integers(2, 12))] for _ in range(pages)]
    return framed([(b, [1] * len(b)) for b in bodies], seed, copies=4)


def labelled_sample(pages: DataFrame, html_column: str, rows: int = SAMPLE_PAGES) -> list[tuple[list[Block], list[int]]]:
    """``rows`` distinct pages whose markup labels every block, or all if there are fewer."""
    page = F.col(html_column).cast("string")
    marked = pages.where(F.length(page).between(1, SAMPLE_CHARS) & F.rlike(page, F.lit("(?i)<(?:article|main)\\b"))).select(page.alias("page"), F.xxhash64(page).alias("draw"))
    # About four times the wanted rows are looked at, so that tasks send few to the driver.
    one_in = max(1, marked.agg(F.count_distinct("draw")).first()[0] // (4 * rows))
    drawn = marked.where(F.pmod("draw", F.lit(one_in)) == 0).groupBy("draw").agg(F.min("page").alias("page")).orderBy("draw").limit(rows).collect()
    out = []
    for row in drawn:
        blocks = blocks_of(row.page)
        out.append((blocks, [marked_label(b.path) or 0 for b in blocks]))
    return out


def label_pages(model: BidirectionalLSTM, features: Features, pages: list[list[Block]]) -> list[np.ndarray]:
    """A content flag for every block, pages of like length together."""
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        take, most = [], 0
        while order and (not take or (len(take) + 1) * max(most, len(pages[order[-1]])) <= BLOCKS_AT_ONCE):
            take.append(order.pop())
            most = max(most, len(pages[take[-1]]))
        x, mask = _padded([features.matrix(pages[i]) for i in take])
        logits = model.logits(x, mask)
        for k, i in enumerate(take):
            out[i] = logits[: len(pages[i]), k] > 0
    return out


ADDED = T.StructType([T.StructField("main_text", T.StringType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_content_blocks", T.LongType())])


def extract_text(pages: DataFrame, html_column: str = "html", model: BidirectionalLSTM | None = None) -> DataFrame:
    """Add main_text and block counts to every page; without a model one is fitted on these pages."""
    if model is None:
        sample = labelled_sample(pages, html_column)
        model = fit(sample + framed(sample) if any(any(labels) for _, labels in sample) else prior_pages())
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        features = Features()

        def extract(texts: list) -> list[list]:
            out: list[list] = [[], [], []]
            for low in range(0, len(texts), 200):
                read = [blocks_of(t) for t in texts[low : low + 200]]
                for blocks, flags in zip(read, label_pages(shared.value, features, read), strict=True):
                    out[0].append(" ".join(b.text for b, keep in zip(blocks, flags.tolist(), strict=True) if keep))
                    out[1].append(len(blocks))
                    out[2].append(int(flags.sum()))
            return out

        return extract

    return add_columns(pages, [html_column], ADDED, make)


def main_text_report(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """The main text of every page and its length in code points."""
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html_column).alias("html"))
    found = extract_text(source, "html")
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
