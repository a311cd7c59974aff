"""Language identification by Bayesian fusion of evidence.

A text's likelihood under each language comes from hashed byte trigrams. To it come the language that the markup
declares and the address's suffix, each with a likelihood learned from all rows, and a prior of the host, smoothed through
its domain to the whole corpus. Those are grouped sums of the texts' posteriors; a row's own share is taken out of its
host's. Only ids, addresses and a likelihood for each language move between workers, never texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import Workspace, hash_sample, slices

SLOTS = 1 << 15
#: Second labels under which countries' registries give out names.
SECOND = frozenset("ac co com edu gob gouv gov gv info ltd me mil ne net nhs nic nom or org plc police sch school web".split())
_TAGS = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})", re.I)
_URL = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)")


def trigrams(raw: bytes) -> np.ndarray:
    """Slots of the text's byte trigrams, ASCII letters lower-cased."""
    b = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(17)


class Model:
    """log P(trigram | language) with add-half smoothing. Likelihoods are tempered: trigrams overlap and depend on each other."""

    def __init__(self, langs: list[str], logs: np.ndarray, temper: float = 0.25):
        self.langs, self.logs, self.temper = langs, logs, temper

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> Model:
        langs = sorted({lang for lang, _ in rows})
        counts = np.full((SLOTS, len(langs)), 0.5)
        for lang, text in rows:
            counts[:, langs.index(lang)] += np.bincount(trigrams(text.encode("utf-8", "surrogatepass")), minlength=SLOTS)
        return cls(langs, np.log(counts / counts.sum(axis=0)).astype(np.float32) if langs else np.zeros((SLOTS, 0), np.float32))

    def likelihoods(self, raw: bytes) -> np.ndarray:
        """Tempered log-likelihoods of a whole text, the largest of them 0."""
        t = np.bincount(trigrams(raw), minlength=SLOTS)
        at = np.flatnonzero(t)
        x = self.temper * (t[at].astype(np.float64) @ self.logs[at])
        return x - x.max() if len(x) else x


def train(docs: DataFrame, sample: int = 2000) -> Model:
    """Fit on at most ``sample`` rows with a language, those of smallest hash of doc_id; only they reach the driver."""
    rows = docs.where("lang IS NOT NULL AND lang <> ''").select("doc_id", F.lower("lang").alias("lang"), "text")
    return Model.fit([(r.lang, r.text) for r in hash_sample(rows, "doc_id", sample).collect() if r.text is not None])


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, domain, suffix) of a URL: lower case, without www.

    The suffix is the last label. The domain is what is registered under a public suffix: the last two labels, or three where the
    last but one is of ``SECOND`` and the last a country's, of two letters. An address of numbers is its own domain and has no suffix.
    """
    m = _URL.match(url or "")
    if not m:
        return None, None, None
    host = m[1].lower().rstrip(".").removeprefix("www.")
    labels = host.split(".")
    if host.startswith("[") or len(labels) == 4 and all(x.isdigit() for x in labels):
        return host, host, None
    return host, ".".join(labels[-3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND else -2 :]), labels[-1]


def identify(spark: SparkSession, rows: DataFrame, model: Model, strength: float = 4.0, top: float = 1e-6) -> DataFrame:
    """For each row of ``rows`` (key, text, html, url, host): key, lang, confidence, declared, host.

    The text counts where it is not null, else the html without tags. host (a source, say) stands in where there is no
    url. Missing evidence counts for nothing: a row without text, markup, address and host gets the corpus's prior, and with a
    model of no languages lang is null. Ties go to the first language by name. Repeated rows and keys are rows of their own, each
    with evidence of its own; other columns are ignored. Texts count whole; memory follows the longest one.
    ``strength`` is the weight, in rows, of each level of smoothing.
    """
    ws, langs = Workspace(spark, "langid"), model.langs
    shape = "key string, declared string, host string, domain string, suffix string, ll array<double>"
    state = spark.sparkContext.broadcast((model.langs, model.logs, model.temper))

    def run(it):
        own = Model(*state.value)
        for whole in it:
            for b in (y for x in slices(whole, "html") for y in slices(x, "text")):
                out = [[] for _ in range(6)]
                for key, text, page, url, host in zip(*(b.column(c).to_pylist() for c in ("key", "text", "html", "url", "host"))):
                    m = _DECLARED.search(page) if page else None
                    if text is None:
                        text = _TAGS.sub(" ", page or "")
                    place = address(url) if url else (host, host, None)
                    for c, v in zip(out, (key, m[1].lower() if m else None, *place, own.likelihoods(text.encode("utf-8", "surrogatepass")))):
                        c.append(v)
                s = pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (s, s, s, s, s, pa.list_(pa.float64())))], [x.split()[0] for x in shape.split(", ")])

    names = ("key", "text", "html", "url", "host")
    seen = ws.save(rows.select(*(F.col(c).cast("string").alias(c) for c in names)).mapInArrow(run, shape), "seen")
    if not langs:
        return ws.finish(seen.select("key", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), "declared", "host"))
    n = len(langs)
    each = [F.col("ll")[i] for i in range(n)]
    total = sum((F.exp(x) for x in each[1:]), F.exp(each[0]))
    seen = seen.select("*", *((F.exp(x) / total).alias(f"p{i}") for i, x in enumerate(each)))
    sums = lambda tag: [F.sum(f"p{i}").alias(f"{tag}{i}") for i in range(n)]
    # the corpus: one row
    base = [float(x or 0) for x in seen.agg(*sums("g")).first()]
    all_ = sum(base)
    prior = [(x + strength / n) / (all_ + strength) for x in base]
    # P(evidence | language) of declared languages and suffixes: the tables of both are small groups of sums
    weight = {}
    for c in ("declared", "suffix"):
        got = seen.where(F.col(c).isNotNull()).groupBy(c).agg(*sums("s"))
        whole = [float(x or 0) for x in got.agg(*(F.sum(f"s{i}") for i in range(n))).first()]
        held = sum(whole)
        ratio = lambda i: F.log((F.col(f"s{i}") + strength * F.col("__all") / (held + strength)) / (whole[i] + strength) + top)  # noqa: B023, E731
        weight[c] = got.withColumn("__all", sum((F.col(f"s{i}") for i in range(1, n)), F.col("s0"))).select(c, *(ratio(i).alias(f"{c}_{i}") for i in range(n)))
    domain = seen.where("domain IS NOT NULL").groupBy("domain").agg(*sums("d"))
    host = seen.where("host IS NOT NULL").groupBy("domain", "host").agg(*sums("h")).join(domain, "domain")
    host = host.drop("domain")
    x = seen.join(host, "host", "left").join(weight["declared"], "declared", "left").join(weight["suffix"], "suffix", "left")
    dn = sum((F.col(f"d{i}") for i in range(1, n)), F.col("d0"))
    hn = sum((F.col(f"h{i}") for i in range(1, n)), F.col("h0"))
    scores = []
    for i in range(n):
        mid = (F.greatest(F.col(f"d{i}") - F.col(f"p{i}"), F.lit(0.0)) + strength * prior[i]) / (F.greatest(dn - 1, F.lit(0.0)) + strength)
        own = (F.greatest(F.col(f"h{i}") - F.col(f"p{i}"), F.lit(0.0)) + strength * mid) / (F.greatest(hn - 1, F.lit(0.0)) + strength)
        s = each[i] + F.log(F.coalesce(own, F.lit(prior[i])) + top)
        s = s + F.coalesce(F.col(f"declared_{i}"), F.lit(0.0)) + F.coalesce(F.col(f"suffix_{i}"), F.lit(0.0))
        scores.append(s.alias(f"z{i}"))
    x = x.select("key", "declared", "host", *scores)
    best = F.greatest(*(F.col(f"z{i}") for i in range(n))) if n > 1 else F.col("z0")
    x = x.withColumn("best", best)
    lang = F.coalesce(*(F.when(F.col(f"z{i}") == F.col("best"), F.lit(langs[i])) for i in range(n)))
    mass = sum((F.exp(F.col(f"z{i}") - F.col("best")) for i in range(1, n)), F.exp(F.col("z0") - F.col("best")))
    return ws.finish(x.select("key", lang.alias("lang"), (1 / mass).alias("confidence"), "declared", "host"))
