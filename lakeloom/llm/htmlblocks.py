"""HTML extraction: leaf blocks of a page, labelled main or not by a bidirectional LSTM in numpy.

A page becomes the sequence of its text blocks. Each block is a vector: hashed words of its tag path (tags, classes, ids), hashed
words of its text and a few measures (length, links, punctuation, place in the page). The network reads the
sequence in both directions, so each block is judged in the context of the whole page. The weights beside this module come from
``train_blocks``, which makes labelled pages of many layouts from a seed and fits the network by gradient descent.
"""

from __future__ import annotations

import html
import io
import math
import pkgutil
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import ship, slices

PATH, WORDS, PLAIN = 192, 32, 8  # of the path, half for all of it and half for its last step
WIDTH = PATH + WORDS + PLAIN

# HTML's void elements, and the elements that run within a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the first kind ends an open element of the second.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>?|<(?P<end>/)?(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<end2>/)?(?P<tag2>[a-zA-Z][\w:-]*)[^>]*>?|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: Elements without text of the page: left out with all they hold if they are closed, else their start tags alone.
_SKIPPED = frozenset("noscript template svg iframe object title textarea select button".split())
_SKIP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/)?(?P<tag>{'|'.join(sorted(_SKIPPED))})(?=[\s/>])(?:(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^>]*>)",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAMES = re.compile(r"[a-zA-Z]+")
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none""", re.I)


class Block:
    """A text, how many of its characters are linked, its path's vector (shared by blocks of one path) and last named element."""

    __slots__ = ("path", "last", "text", "linked")

    def __init__(self, path: np.ndarray, last: str, text: str, linked: int):
        self.path, self.last, self.text, self.linked = path, last, text, linked


class _Path:
    """The open elements. The hashed names of all steps are kept as running sums, so that a step costs the same at any depth."""

    steps: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    known: dict[tuple[bytes, str], np.ndarray] = {}

    def __init__(self):
        self.stack: list[tuple[str, str]] = []  # (tag, what it and its attributes say)
        self.named: list[str] = []  # of these, what is not empty
        self.open: dict[str, int] = {}
        self.sums = np.zeros(PATH // 2, np.int32)

    @classmethod
    def step(cls, says: str) -> tuple[np.ndarray, np.ndarray]:
        if says not in cls.steps:
            if len(cls.steps) > 50_000:
                cls.steps.clear()
            half = PATH // 2
            every, last = np.zeros(half, np.int32), np.zeros(half, np.int32)
            for name in says.split():
                h = zlib.crc32(name.encode())
                sign = 1 if h & 0x10000 else -1
                every[h % half] += sign
                last[h // half % half] += sign
            cls.steps[says] = every, last
        return cls.steps[says]

    def push(self, tag: str, says: str) -> None:
        self.stack.append((tag, says))
        self.open[tag] = self.open.get(tag, 0) + 1
        if says:
            self.named.append(says)
            self.sums += self.step(says)[0]

    def pop(self) -> str:
        tag, says = self.stack.pop()
        self.open[tag] -= 1
        if says:
            self.named.pop()
            self.sums -= self.step(says)[0]
        return tag

    def vector(self) -> np.ndarray:
        key = self.sums.tobytes(), self.named[-1] if self.named else ""
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = np.clip(np.concatenate((self.sums, self.step(key[1])[1])), -3, 3).astype(np.int8)
        return self.known[key]


def _skips(page: str) -> dict[int, int]:
    """Where the closed elements of ``_SKIPPED`` begin and end. An end tag belongs to the last open start tag of its name; ``<svg/>`` is empty."""
    found, open_at = {}, {}
    for m in _SKIP.finditer(page):
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if open_at.get(tag):
                found[open_at[tag].pop()] = m.end()
        elif tag == "svg" and (m["attrs"] or "").endswith("/"):
            found[m.start()] = m.end()
        else:
            open_at.setdefault(tag, []).append(m.start())
    return found


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order: character references decoded, white space runs one space, empty ones left out."""
    out: list[Block] = []
    path = _Path()
    stack, opened = path.stack, path.open
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(path.vector(), path.named[-1].split(" ", 1)[0] if path.named else "", text, min(linked, len(text))))
            parts.clear()
        linked = 0

    skips, pos = _skips(page), 0
    while m := _TOKEN.match(page, pos):
        pos = m.end()
        text = m["text"]
        if text is not None:
            parts.append(text)
            if opened.get("a"):
                linked += len(text.strip())
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["raw"] is None:
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag in _SKIPPED and not (m["end"] or m["end2"]):
            pos = skips.get(m.start(), pos)
            if tag in ("title", "textarea", "select", "button"):
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
        else:
            flush()
        if m["end"] or m["end2"]:
            if opened.get(tag):
                while path.pop() != tag:
                    pass
            continue
        if tag in VOID:
            continue
        shut = CLOSES.get(tag) or ({"p"} if tag in _ENDS_P else ())
        while shut and stack and (stack[-1][0] in shut or (stack[-1][0] in INLINE and any(opened.get(t) for t in shut))):
            path.pop()
        attrs = m["attrs"] or ""
        says = "" if tag in INLINE else tag
        if attrs and tag not in INLINE:
            names = [n.lower() for a in _ATTR.finditer(attrs) for n in _NAMES.findall(a[1] or a[2] or a[3] or "")]
            says = " ".join([tag, *names, *(["hidden"] if _HIDDEN.search(attrs) else [])])
        path.push(tag, says)
    flush()
    return out


_slots: dict[str, int] = {}


def vectors(page: list[Block], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """One row for each block from ``lo`` to ``hi``."""
    some = page[lo:hi]
    x = np.zeros((len(some), WIDTH), np.float32)
    for r, b in enumerate(some):
        i = lo + r
        x[r, :PATH] = b.path
        words = b.text.split(" ")
        slots = []
        for w in words:
            s = _slots.get(w)
            if s is None:
                if len(_slots) > 300_000:
                    _slots.clear()
                s = _slots[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS
            slots.append(s)
        x[r, PATH : PATH + WORDS] = np.minimum(np.bincount(slots, minlength=WORDS) / math.sqrt(len(words)), 1.5)
        n = len(b.text)
        x[r, PATH + WORDS :] = (
            math.log1p(n) / 5, b.linked / n, (b.text.count(".") + b.text.count(",")) / len(words), b.text[-1] in ".!?…", b.last in ("h1", "h2", "h3", "h4"), i / len(page), (len(page) - i) / 20 if len(page) - i < 20 else 1, 1,
        )
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """Two LSTM layers, one for each direction, side by side, and a logistic output for each block."""

    def __init__(self, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = (rng.normal(size=(WIDTH, 4 * hidden)) / np.sqrt(WIDTH)).astype(np.float32)
            self.w[f"h{d}"] = (rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.w[f"c{d}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)
        self.w["o"] = (rng.normal(size=2 * hidden) / np.sqrt(hidden)).astype(np.float32)
        self.w["p"] = np.zeros(1, np.float32)

    @classmethod
    def load(cls, raw: bytes | None = None) -> BiLSTM:
        raw = raw or pkgutil.get_data("lakeloom.llm", "htmlblocks.npz")
        with np.load(io.BytesIO(raw)) as z:
            net = cls(int(z["hf"].shape[0]))
            net.w = {k: z[k] for k in z.files}
        return net

    def save(self, path: str) -> None:
        np.savez_compressed(path, **self.w)

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """Hidden states (pages, blocks, hidden) of one direction; ``mask`` is 0 past a page's end."""
        n, t, _ = x.shape
        k = self.hidden
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c, out = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32), np.zeros((n, t, k), np.float32)
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[:, s] + h @ self.w[f"h{d}"]
            i, f, o = _sigmoid(z[:, :k]), _sigmoid(z[:, k : 2 * k]), _sigmoid(z[:, 2 * k : 3 * k])
            g = np.tanh(z[:, 3 * k :])
            m = mask[:, s, None]
            c2 = f * c + i * g
            h2 = o * np.tanh(c2)
            if tape is not None:
                tape.append((s, h, c, i, f, o, g, c2, m))
            h, c = m * h2 + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, s] = h
        return out

    def _both(self, first: list[np.ndarray], last: list[np.ndarray], state: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, tuple]:
        """Some steps of both directions at once: what each adds to the output (steps, direction, page).

        ``first`` has the pages' rows in order, ``last`` those that the other direction reads, which come from the end; shorter ones are
        filled up before the other direction begins and after the first ends.
        """
        k, n, t = self.hidden, len(first), max(map(len, first))
        scale = np.concatenate((np.full(3 * k, 0.5, np.float32), np.ones(k, np.float32)))  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        pre, live = np.zeros((t, 2, n, 4 * k), np.float32), np.zeros((t, 2, n, 1), np.float32)
        for r, (a, b) in enumerate(zip(first, last)):
            pre[: len(a), 0, r], live[: len(a), 0, r] = (a @ self.w["xf"] + self.w["cf"]) * scale, 1
            pre[t - len(b) :, 1, r], live[t - len(b) :, 1, r] = ((b @ self.w["xb"] + self.w["cb"]) * scale)[::-1], 1
        weight, every = np.stack((self.w["hf"], self.w["hb"])) * scale, live.all(axis=(1, 2, 3)).tolist()
        (h, c), out = state, np.empty((t, 2, n, k), np.float32)
        for s in range(t):
            z = np.matmul(h, weight)
            z += pre[s]
            np.tanh(z, out=z)
            gates = z[:, :, : 3 * k] * 0.5
            gates += 0.5
            c2 = gates[:, :, k : 2 * k] * c
            c2 += gates[:, :, :k] * z[:, :, 3 * k :]
            h2 = np.tanh(c2)
            h2 *= gates[:, :, 2 * k :]
            h, c = (h2, c2) if every[s] else (np.where(live[s], h2, h), np.where(live[s], c2, c))
            out[s] = h
        return np.stack((out[:, 0] @ self.w["o"][:k], out[:, 1] @ self.w["o"][k:]), axis=1), (h, c)

    def chances(self, pages: list, batch: int = 256, chunk: int = 4096) -> list[np.ndarray]:
        """For each page, its blocks or their vectors, the chance of each block to be main text.

        Pages of like length run together; one of more than ``chunk`` blocks alone, in pieces of that length from both ends.
        """
        rows = lambda page, lo, hi: page[lo:hi] if isinstance(page, np.ndarray) else vectors(page, lo, hi)
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((j for j in range(len(pages)) if len(pages[j])), key=lambda j: len(pages[j]))
        at = 0
        while at < len(order):
            most = max(1, min(batch, 50_000 // len(pages[order[min(at + batch, len(order)) - 1]])))
            some = order[at : at + most]
            if len(pages[some[-1]]) > chunk:
                some = some[:1]
            at += len(some)
            t, n = len(pages[some[-1]]), len(some)
            state = np.zeros((2, n, self.hidden), np.float32), np.zeros((2, n, self.hidden), np.float32)
            y = np.full((t, n), self.w["p"][0], np.float32)
            for lo in range(0, t, t if n > 1 else chunk):
                hi = t if n > 1 else min(t, lo + chunk)
                first = [rows(pages[j], lo, hi) for j in some]
                last = first if hi - lo == t else [rows(pages[j], t - hi, t - lo) for j in some]
                got, state = self._both(first, last, state)
                y[lo:hi] += got[:, 0]
                y[t - hi : t - lo] += got[::-1, 1]
            for r, j in enumerate(some):
                out[j] = _sigmoid(y[: len(pages[j]), r])
        return out


def main_texts(pages: list[str], net: BiLSTM) -> list[str]:
    cut = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, p in zip(page, c) if p >= 0.5) for page, c in zip(cut, net.chances(cut))]


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    text has the main blocks in page order, joined by \\n; white space inside a block is one space, character
    references are decoded. Null or empty html, and pages without main blocks, give an empty text. Every row counts by itself:
    repeated rows, null ids and further columns make no difference. No row moves between workers.
    """
    ship(spark)

    def run(it):
        net = BiLSTM.load()
        for whole in it:
            for b in slices(whole, "html"):
                texts = main_texts([x or "" for x in b.column("html").to_pylist()], net)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    typed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return typed.mapInArrow(run, "page_id long, url string, text string, n_chars long")
