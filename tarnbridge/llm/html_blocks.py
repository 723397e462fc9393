"""HTML extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks in page order. Each block has a vector of its tag path and one of its
hashed words; a bidirectional LSTM in numpy reads the whole sequence and says for each block whether it is part of the
main text. The weights come from train_blocks.py.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, workers_find_us

WEIGHTS = Path(__file__).with_name("block_labeller.npz")
PATH_DIM, WORD_DIM, EXTRA = 160, 24, 6
DIM, HIDDEN = PATH_DIM + WORD_DIM + EXTRA, 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is not text of the page.
SILENT = frozenset("iframe noframes noscript object script style svg template textarea title canvas audio video".split())
#: Those of raw text: without an end tag they reach to the end of the page. The others then are as any other element.
RAW = frozenset("iframe noframes script style textarea title".split())
#: Elements that may be open at a time; deeper ones have no structure of their own. Innermost ones that describe a block.
DEEPEST, PATH = 512, 64
#: A start tag closes these open elements, up to the nearest of the second.
CLOSES = {
    **{t: ({"p"}, {"td", "th", "li", "dd", "button", "object"}) for t in BLOCK - {"option", "label", "button"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"table", "tr"}), "th": ({"td", "th", "p"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
#: The common tags, whose quotes hold no angle brackets. It never looks behind the next angle bracket.
TAG = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9:-]*)([^<>\"']*(?:\"[^\"<>]*\"[^<>\"']*)*)>")
TAG_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
HEAD = re.compile(r"<head\b[^>]*>", re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDES = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none", re.I)
PIECES = re.compile(r"[A-Za-z]+")


@dataclass
class Block:
    path: tuple[str, ...]  # of each open element: its tag, then the words of its class, id and role
    text: str
    linked: int  # characters inside links


def parts(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text): 'text', 'start' with the attributes, and 'end'. Comments and what SILENT elements hold are left out.

    Each character is looked at a bounded number of times: what is searched for and not there is not searched for again.
    """
    low = page.lower() if page.isascii() else "".join(c.lower() if c.isascii() else c for c in page)
    none_behind: dict[str, int] = {}

    def find(what: str, at: int) -> int:
        """Like low.find, but remembers from where on there is none."""
        if what in none_behind and at >= none_behind[what]:
            return -1
        to = low.find(what, at)
        if to < 0:
            none_behind[what] = at
        return to

    def ended(name: str, at: int) -> tuple[int, int]:
        """Where the end tag of a silent element begins and ends; -1: there is none."""
        while (to := find("</" + name, at)) >= 0:
            behind = low[to + 2 + len(name) : to + 3 + len(name)]
            if behind in ("", ">", "/") or behind.isspace():
                close = find(">", to)
                return to, len(page) if close < 0 else close + 1
            at = to + 2
        return -1, -1

    def tag_end(at: int) -> int:
        """The place of the > that ends a tag; those in quotes do not. -1: there is none."""
        while True:
            to = find(">", at)
            if to < 0:
                return -1
            quotes = [(q, k) for k in "\"'" if 0 <= (q := low.find(k, at, to))]
            if not quotes:
                return to
            q, k = min(quotes)
            behind = find(k, q + 1)
            if behind < 0:
                return to
            at = behind + 1

    at = 0
    while at < len(page):
        to = page.find("<", at)
        if to < 0:
            yield "text", "", page[at:]
            return
        if to > at:
            yield "text", "", page[at:to]
        if m := TAG.match(page, to):
            name, rest, at = m[1].lower(), m[2], m.end()
        elif page.startswith("<!--", to):
            end = find("-->", to + 4)
            at = len(page) if end < 0 else end + 3
            continue
        elif low.startswith("<![cdata[", to):
            end = find("]]>", to + 9)
            yield "text", "", page[to + 9 : len(page) if end < 0 else end]
            at = len(page) if end < 0 else end + 3
            continue
        elif page.startswith(("<!", "<?"), to):
            end = find(">", to)
            at = len(page) if end < 0 else end + 1
            continue
        elif (m := TAG_NAME.match(page, to + 1)) and (end := tag_end(m.end())) >= 0:
            name, rest, at = low[to + 1 : m.end()], page[m.end() : end], end + 1
        else:
            yield "text", "", "<"
            at = to + 1
            continue
        if name[0] == "/":
            yield "end", name[1:], ""
        elif name not in SILENT:
            yield "start", name, rest
        elif not rest.endswith("/"):
            begins, ends = ended(name, at)
            if begins >= 0:
                at = ends
            elif name in RAW:
                return
            else:
                yield "start", name, rest


def without_head(page: str) -> str:
    """The page without its head, where that has an end tag or a body follows. Else the head is as any other element."""
    if m := HEAD.search(page):
        low = page[m.end() :].lower()
        ends = [(low.find(x), len(x)) for x in ("</head", "<body")]
        begun = [(k, x) for k, x in ends if k >= 0]
        if begun:
            k, _ = min(begun)
            return page[: m.start()] + " " + page[m.end() + k :]
    return page


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks with text, in page order: character references decoded, each run of white space one blank."""
    page = without_head(page)
    out: list[Block] = []
    open_: list[tuple[str, str]] = []
    text: list[str] = []
    state = {"linked": 0, "a": 0}
    counts: defaultdict[str, int] = defaultdict(int)

    def flush() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append(Block(tuple(x for _, x in open_[-PATH:]), joined, state["linked"]))
        text.clear()
        state["linked"] = 0

    def add(s: str) -> None:
        if s:
            text.append(s)
            if state["a"]:
                state["linked"] += len(s)

    def close(to: int) -> None:
        if any(t in BLOCK for t, _ in open_[to:]):
            flush()
        for t, _ in open_[to:]:
            state["a"] -= t == "a"
            counts[t] -= 1
        del open_[to:]

    for kind, tag, rest in parts(page):
        if kind == "text":
            add(rest)
            continue
        if kind == "end":
            if not counts[tag]:
                if tag in BLOCK:
                    flush()
                continue
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    close(i)
                    break
                if open_[i][0] in ("article", "main", "body", "table") and tag not in BLOCK:
                    break
            continue
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            cut = None
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] in ends:
                    cut = i
                elif open_[i][0] in stop or open_[i][0] in BLOCK - ends:
                    break
            if cut is not None:
                close(cut)
        if tag in BLOCK:
            flush()
        elif tag == "br":
            text.append(" ")
        if tag in VOID or tag == "head" or rest.endswith("/") or len(open_) == DEEPEST:  # a head that is not ended holds silent and void elements only
            continue
        names = " ".join(x for t in NAMES.findall(rest) for x in t if x) if rest else ""
        if rest and HIDES.search(rest):
            names += " is-hidden"
        open_.append((tag, f"{tag} {names}".lower().strip()))
        counts[tag] += 1
        state["a"] += tag == "a"
    flush()
    return out


def _slot(word: str, size: int) -> int:
    return crc32(word.encode()) % size


_paths: dict[tuple[str, ...], list[int]] = {}


def _path_slots(path: tuple[str, ...]) -> list[int]:
    """Places of the path's features: every tag, every name, the innermost block element, and pairs of neighbours."""
    if path not in _paths:
        if len(_paths) > 50_000:
            _paths.clear()
        feats: set[str] = set()
        tags = [x.split(" ", 1)[0] for x in path]
        for tag, full in zip(tags, path, strict=True):
            if tag not in ("html", "body", "b", "i", "span", "em", "strong"):
                feats.add(f"t:{tag}")
            feats.update(f"n:{w}" for w in PIECES.findall(full.partition(" ")[2]))
        inner = [t for t in tags if t in BLOCK]
        feats.update(f"l:{t}" for t in inner[-1:])
        feats.update(f"p:{a}>{b}" for a, b in zip(inner[-3:], inner[-2:], strict=False))
        _paths[path] = sorted({_slot(f, PATH_DIM) for f in feats})
    return _paths[path]


def vectors(page: list[Block]) -> np.ndarray:
    """A row for each block: tag-path features, hashed words, and simple measures."""
    x = np.zeros((len(page), DIM), np.float32)
    for i, b in enumerate(page):
        x[i, _path_slots(b.path)] = 1
        words = b.text.lower().split()
        np.add.at(x[i], [PATH_DIM + _slot(w, WORD_DIM) for w in words], 1 / len(words))
        n = len(b.text)
        x[i, PATH_DIM + WORD_DIM :] = (min(1, np.log1p(n) / 8), min(1, b.linked / n), min(1, sum(b.text.count(c) for c in ".,;:!?") / len(words)), i / len(page), b.text[-1] in ".!?:;\"'", min(1, len(words) / 50))
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, backward: bool, last: bool = False) -> list[tuple]:
    """States by step over (steps, pages, DIM), with last only the step's output. mask (steps, pages, 1) is 0 behind a page's end: states stay there."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out: list[tuple] = [()] * steps
    pre = x @ w + b
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        z = pre[t] + h @ u
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        c2 = f * c + i * g
        tc = np.tanh(c2)
        m = mask[t]
        before = () if last else (h, c, i, f, o, g, tc, m)
        h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
        out[t] = (*before, h)
    return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), DIM), np.float32), np.zeros((steps, len(pages), 1), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def scores(pages: list[np.ndarray], weights: dict[str, np.ndarray], cells: int = 8192) -> list[np.ndarray]:
    """For each page the chance of each block to be main text. Pages of like length go together, about `cells` blocks at a time."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    while order:
        longest = len(pages[order[-1]])
        some = order[-max(1, cells // longest) :]
        del order[-len(some) :]
        x, mask = padded([pages[k] for k in some])
        both = [np.stack([s[-1] for s in lstm(x, mask, weights["w" + d], weights["u" + d], weights["b" + d], d == "b", True)]) for d in "fb"]
        p = _sigmoid(np.concatenate(both, axis=2) @ weights["v"] + x @ weights["s"] + weights["c"])
        for j, k in enumerate(some):
            out[k] = p[: len(pages[k]), j]
    return out


def load_weights() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def extract_many(pages: list[str], weights: dict[str, np.ndarray], threshold: float = 0.5) -> list[list[str]]:
    """The main-text blocks of each page."""
    found = [blocks(p) for p in pages]
    marks = scores([vectors(b) for b in found], weights)
    return [[b.text for b, s in zip(bs, ss, strict=True) if s >= threshold] for bs, ss in zip(found, marks, strict=True)]


def extract(pages: DataFrame, keep: tuple[str, ...] = ("url",), id_col: str = "page_id", html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """For each row: page_id, *keep, text (main blocks joined by two line breaks; empty if none), n_chars (code points).

    A null, empty or text-free page gives an empty text. Unclosed and stray tags are accepted. Pages are read whole;
    repeated rows stay; columns not named are left out.
    """
    workers_find_us(pages.sparkSession)
    weights = load_weights()
    names = ["page_id", *keep]
    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), *(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = ["\n\n".join(x) for x in extract_many([p or "" for p in part.column(len(names)).to_pylist()], weights, threshold)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(F.col(id_col).alias("page_id"), *keep, F.col(html_col).cast("string").alias("__html")).mapInArrow(run, schema)
