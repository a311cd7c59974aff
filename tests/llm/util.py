"""Brute-force helpers and awkward rows."""

import random
import re

WS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return (text or "").translate(UPPER)


def word_sets(texts: dict, k: int, pattern=WS) -> dict:
    out = {}
    for i, t in texts.items():
        w = pattern.findall(lowered(t))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def components(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def corpus(seed: int = 1, n: int = 60) -> dict:
    """Texts with copies, near copies, shared passages and oddities."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    out = {i: text(r.choice((3, 30, 80, 200))) for i in range(n)}
    base = text(120)
    for i in range(n, n + 40):
        w = base.split(" ")
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        out[i] = " ".join(w)
    for i in range(n + 40, n + 50):
        out[i] = base.upper() if i % 2 else base
    passage = text(60)
    for i in range(n + 50, n + 56):
        out[i] = f"{text(10)}\n{passage}\n{text(r.randint(0, 20))}"
    out |= {1000: None, 1001: "", 1002: "  \n\t ", 1003: "one", 1004: "one", 1005: "one two three", 1006: "ab " * 400, 1007: "ab " * 300, 1008: "x" * 5000, 1009: "\n".join(["same line"] * 30)}
    return out


def frame(spark, texts: dict):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], DOCS)
