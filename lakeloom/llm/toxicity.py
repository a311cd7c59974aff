"""Toxicity: Levenshtein automata run over a trie of learned terms, with windows that tell quotation from abuse.

The lexicon is learned from labelled rows: word beginnings and whole words that toxic rows hold far more often. A text's
distinct words are each turned into a bit-parallel Levenshtein automaton (Wu and Manber's form: one machine word of
states for each number of edits) that walks the lexicon trie; terms within one edit match, a digit or sign inside a word
included. Each hit is weighted by its context: standing inside a quotation and verbs of reporting in the window of words around it lower
it, forms of address there raise it. How much each does is learned with the rest, from a prior (``CONTEXT``) that few labelled
quotations leave as it is. A hit with an edit counts a fixed share of an exact one. A logistic model on the weighted hits gives the
score. Scoring has no shuffle.
"""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import hash_sample, ship, slices

# Words of reporting and of address, in the four languages of the corpus.
REPORTS = frozenset(
    "said says wrote writes called calls quoted quote quotes reported according dit écrit appelle cité selon sagte schrieb nannte zitiert laut dijo escribió llamó cita según".split()
)
ADDRESS = frozenset("you your yours youre ur u tu toi te vous votre du dich dir dein ihr euch ti vosotros usted tus".split())
#: Quotations: from an opening mark to the next closing one of its kind in the line, and lines that begin with >.
QUOTATION = re.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|»[^«\n]*«|‹[^›\n]*›|^[ \t]*>.*$', re.M)
#: The prior of the context's weights (a quotation, a report, an address), how far from it learning may go, and the choices.
CONTEXT, SPREAD = (5.0, 1.5, 1.0), (1.5, 1.0, 1.0)
CHOICES = ((0.0, 1.0, 2.5, 5.0, 7.0), (0.0, 0.75, 1.5, 3.0), (0.0, 1.0, 2.0))
_WORD = re.compile(r"[^\W\d_]+")
#: Two runs of letters with one digit or sign between them.
_JOINED = re.compile(r"(?<![^\W\d_])(?=([^\W\d_]+(?:[\d_]|[^\w\s])[^\W\d_]+))")
_SCHEMA = "doc_id long, score double, predicted int, hits array<struct<term:string,word:string,start:int,edits:int,weight:double>>"
FEATURES = 3
SHARE = 0.5  # of an exact hit, what a hit with an edit counts


class Trie:
    """Terms and the automaton's walk. A term matches a whole word, or as a stem a word's beginning."""

    def __init__(self, terms: list[tuple[str, bool]], fuzzy_from: int, plain=frozenset(), strict=frozenset()):
        """``plain`` words match without edits only, and so do the ``strict`` terms."""
        self.fuzzy_from, self.plain, self.strict = fuzzy_from, plain, strict
        self.root: dict = {}
        for term, whole in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, whole)
        # within one edit, a word begins with a term's two first characters or has its next three (two of a term of four) near them
        self.heads = {t[:2] for t, _ in terms}
        self.mids = {t[2:5] for t, _ in terms if len(t) >= max(5, fuzzy_from)}
        self.tails = {t[2:] for t, _ in terms if fuzzy_from <= len(t) < 5}

    def near(self, w: str) -> bool:
        if w[:2] in self.heads or w[1:4] in self.mids or w[2:5] in self.mids or w[3:6] in self.mids:
            return True
        return bool(self.tails) and any(w[k : k + n] in self.tails for k in (1, 2, 3) for n in (1, 2))

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that the word matches with the fewest edits (the longest of several), or None."""
        if not self.near(word):
            return None
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        end, best, free = 1 << len(word), None, word not in self.plain
        stack = [(self.root, 1, 3)]
        while stack:
            node, r0, r1 = stack.pop()
            for c, below in node.items():
                if c == "":
                    term, whole = below
                    goal = end if whole else -1
                    edits = 0 if r0 & goal else 1 if free and len(term) >= self.fuzzy_from and r1 & goal and term not in self.strict else 2
                    if edits < 2 and (best is None or (edits, -len(term)) < (best[1], -len(best[0]))):
                        best = (term, edits)
                    continue
                m = masks.get(c, 0)
                s0 = (r0 & m) << 1
                s1 = (((r1 & m) << 1) | r0 | (r0 << 1) | (s0 << 1)) & (2 * end - 1)
                if s0 or s1:
                    stack.append((below, s0, s1))
        return best


class Scorer:
    """Terms, context windows and the logistic model; small, and sent to the workers as it is."""

    def __init__(self, terms, weights=None, bias=-4.0, fuzzy_from=4, window=8, plain=frozenset(), strict=frozenset(), context=CONTEXT):
        self.terms, self.fuzzy_from, self.window, self.plain, self.strict, self.context = terms, fuzzy_from, window, plain, strict, context
        self.weights = np.zeros(FEATURES) if weights is None else weights
        self.bias, self.trie, self.known = bias, Trie(terms, fuzzy_from, plain, strict), {}

    @property
    def state(self) -> tuple:
        """The arguments that make this scorer again."""
        return self.terms, self.weights, self.bias, self.fuzzy_from, self.window, self.plain, self.strict, self.context

    def _match(self, w: str) -> tuple[str, int] | None:
        if w not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[w] = self.trie.match(w)
        return self.known[w]

    def found(self, text: str) -> list[tuple[str, str, int, int, tuple[bool, bool, bool]]]:
        """(term, word, start, edits, (quoted, reported, addressed)) of each hit in order."""
        low = text.lower()
        found = False
        for w in {*_WORD.findall(low), *_JOINED.findall(low)}:
            found = self._match(w) is not None or found
        if not found:
            return []
        spans = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(low)]
        quotes = [m.span() for m in QUOTATION.finditer(low)]
        begins = [a for a, _ in quotes]
        out, past = [], 0
        for i, (w, a, b) in enumerate(spans):
            if a < past:
                continue  # the second half of a joined word
            got = self._match(w)
            if (got is None or got[1]) and i + 1 < len(spans) and spans[i + 1][1] == b + 1 and not low[b].isspace():
                # a digit or sign inside the word, unless the next run is a term as it stands
                joined, after = self._match(low[a : spans[i + 1][2]]), self._match(spans[i + 1][0])
                if joined and (after is None or after[1]):
                    got, b = joined, spans[i + 1][2]
                    w, past = low[a:b], b
            if got is None:
                continue
            at = bisect_right(begins, a) - 1
            near = {x for x, _, _ in spans[max(0, i - self.window) : i + self.window + 1]}
            out.append((got[0], w, a, got[1], (at >= 0 and b <= quotes[at][1], bool(near & REPORTS), bool(near & ADDRESS))))
        return out

    def weight(self, context: tuple[bool, bool, bool]) -> float:
        """Of a hit in a context: near 1, or less as it is quoted and reported more than addressed to someone."""
        doubt = self.context[0] * context[0] + self.context[1] * context[1] - self.context[2] * context[2]
        return 1 / (1 + math.exp(max(0.0, doubt) - 3))

    def hits(self, text: str) -> list[tuple[str, str, int, int, float]]:
        """(term, word, start, edits, weight) of each hit in order."""
        return [(*h[:4], self.weight(h[4])) for h in self.found(text)]

    def features(self, hits) -> list[float]:
        """Of exact hits and, as a share of one each, those with an edit: their sum by weight, whether any, and the terms hit."""
        total, kinds = 0.0, {}
        for term, _, _, edits, weight in hits:
            part = (SHARE if edits else 1.0) * weight
            total += part
            kinds[term] = min(1.0, part + kinds.get(term, 0.0))
        return [math.log1p(total), min(1.0, total), math.log1p(sum(kinds.values()))]

    def score(self, hits) -> float:
        z = self.bias + float(np.dot(self.weights[:FEATURES], self.features(hits)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn_terms(texts: list[str], toxic: list[int], share: float = 0.02, precision: float = 0.8, z: float = 4.0, longest: int = 16) -> list[tuple[str, bool]]:
    """Word beginnings (stems) and whole words that tell toxic texts, none a beginning of another.

    Of beginnings that the same toxic texts hold, the longest; a term that is always the whole word is marked so. A term is in
    4 and in ``share`` of the toxic texts at least, copies counted once: words of one text's copies don't tell anything.
    """
    a, b = Counter(), Counter()
    once = dict(zip(texts, toxic))
    texts, toxic = list(once), list(once.values())
    least = max(4, math.ceil(share * sum(toxic)))
    for text, y in zip(texts, toxic):
        seen = set()
        for w in set(_WORD.findall(text.lower())):
            seen.update(w[:k] for k in range(2, min(len(w), longest) + 1))
            seen.add(w + "$")
        (a if y else b).update(seen)
    n1, n0 = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))

    def tells(t: str) -> bool:
        x, y = a[t], b[t]
        if x < least or x < precision * (x + y):
            return False
        p = (x + y) / (n1 + n0)
        return (x / n1 - y / n0) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0)) >= z

    stems = sorted((t for t in a if t[-1] != "$" and len(t) >= 3 and a[t] >= least and tells(t)), key=lambda t: (len(t), t))
    taken, out = set(), []
    follow: dict[str, list[str]] = {}
    for t in stems:
        follow.setdefault(t[:-1], []).append(t)
    for t in stems:
        if any(t[:k] in taken for k in range(2, len(t))):
            continue
        taken.add(t)
        while more := [x for x in follow.get(t, ()) if a[x] >= 0.9 * a[t]]:
            t = more[0]
        out.append((t, a[t + "$"] >= 0.9 * a[t]))
    return out


def plain_words(texts: list[str], toxic: list[int], terms: list[tuple[str, bool]], fuzzy_from: int = 4, rate: float = 0.001) -> tuple[frozenset, frozenset]:
    """Words one edit from a term that two clean texts hold, and the terms whose other such words more than ``rate`` of them (and 2) hold.

    Near the terms of the second kind clean texts always have words not seen before, so that an edit there tells nothing.
    Copies count once.
    """
    words: Counter = Counter()
    clean = {t for t, y in zip(texts, toxic) if not y}
    for text in clean:
        low = text.lower()
        words.update({*_WORD.findall(low), *_JOINED.findall(low)})
    plain, strict = frozenset(), frozenset()
    while True:  # a word near a strict term may be near another
        trie = Trie(terms, fuzzy_from, plain, strict)
        known = {w: got[0] for w in words if (got := trie.match(w)) and got[1]}
        plain |= {w for w in known if words[w] > 1}
        rest = Counter(t for w, t in known.items() if words[w] == 1)
        more = {t for t, n in rest.items() if n > max(2, rate * len(clean))}
        if not more:
            return plain, strict
        strict |= more


def _newton(x: np.ndarray, y: np.ndarray, ridge: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the logistic model with a ridge, and its penalised log-likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return w, float(np.log(np.where(y > 0, p, 1 - p)).sum() - 0.5 * (ridge * w * w).sum())


def fit(texts: list[str], toxic: list[int], **how) -> Scorer:
    """Learn the terms, the context's weights and the logistic model (Newton's method with a ridge, for each choice of the former)."""
    if not sum(toxic):
        return Scorer([], bias=-4.0)
    terms = learn_terms(texts, toxic, **how)
    plain, strict = plain_words(texts, toxic, terms)
    scorer = Scorer(terms, plain=plain, strict=strict)
    found = [scorer.found(t) for t in texts]
    y, ridge, best = np.array(toxic, float), np.r_[1e-3, np.full(FEATURES, 0.05)], None
    x = np.zeros((len(texts), FEATURES + 1))
    x[:, 0] = 1
    for choice in itertools.product(*CHOICES):
        scorer.context = choice
        for r, hits in enumerate(found):
            if hits:
                x[r, 1:] = scorer.features([(*h[:4], scorer.weight(h[4])) for h in hits])
        w, likely = _newton(x, y, ridge)
        likely -= 0.5 * sum(((c - p) / s) ** 2 for c, p, s in zip(choice, CONTEXT, SPREAD))
        if best is None or likely > best[0]:
            best = likely, choice, w
    # more hits never make a text less toxic; without hits it is not toxic
    _, context, w = best
    return Scorer(terms, np.maximum(w[1:], 0), min(float(w[0]), -0.5), plain=plain, strict=strict, context=context)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Scorer:
    """Fit on at most ``sample`` labelled rows, those of smallest hash of doc_id, of those with crc32(doc_id) mod 5 not 0.

    The sample is broadcast to the texts (at most ``sample`` ids) and only its texts come to the driver, one for each id: of rows that
    repeat an id, the text of smallest hash. Rows whose label or id is null are left out.
    """
    use = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL AND crc32(cast(doc_id AS string)) % 5 <> 0")
    use = use.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = hash_sample(use, "doc_id", sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(pick), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r")).select("doc_id", "r.text", "toxic")
    rows = sorted((tuple(r) for r in rows.collect()), key=lambda r: r[0])
    return fit([t for _, t, _ in rows], [y for *_, y in rows])


def toxicity(spark: SparkSession, docs: DataFrame, scorer: Scorer, hits: bool = True) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) and, if wanted, hits (term, word, start, edits, weight) of every row.

    Null text is empty text and scores as a text without hits. Repeated rows, null ids and other columns of the table
    change nothing: each row is scored by its text alone.
    """
    ship(spark)
    state = scorer.state

    def run(it):
        own = Scorer(*state)
        for whole in it:
            for b in slices(whole, "text"):
                got = [own.hits(x or "") for x in b.column("text").to_pylist()]
                score = np.array([own.score(h) for h in got])
                cols = [b.column("doc_id"), pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32())]
                if hits:
                    names = ("term", "word", "start", "edits", "weight")
                    kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())))))
                    cols.append(pa.array([[dict(zip(names, h)) for h in x] for x in got], kind))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "predicted", "hits"][: len(cols)])

    schema = _SCHEMA if hits else _SCHEMA[: _SCHEMA.index(", hits")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def reject(spark: SparkSession, docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns; nothing moves between workers."""
    ship(spark)
    state = scorer.state

    def run(it):
        own = Scorer(*state)
        for whole in it:
            for b in slices(whole, "text"):
                yield b.filter(pa.array([own.score(own.hits(x or "")) < 0.5 for x in b.column("text").to_pylist()]))

    return docs.mapInArrow(run, docs.schema)
