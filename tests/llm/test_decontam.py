import re

import numpy as np
import pytest

from lakeloom.llm import decontam, textkit
from tests.llm.util import DOCS, corpus, frame, word_sets

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def items(texts):
    long = " ".join(f"w{i}" for i in range(50))
    return {1: texts[60], 2: long, 3: "one two three", 4: "", 5: None, 6: "w1 w2 w3 w4 w5 w6", 7: "One, two: THREE!", 8: texts[2]}


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_against_brute_force(spark, block):
    """In one block of items, and in many."""
    texts = corpus(7)
    bench = items(texts)
    texts |= {3000: "intro " + " ".join(f"W{i}," for i in range(41)) + " end", 3001: " ".join(f"w{i}" for i in range(35)), 3002: "w1-w2 w3.w4 w5 w6"}
    d, b = word_sets(texts, 5, PLAIN), word_sets(bench, 5, PLAIN)
    want = {(i, j, len(y), len(x & y)) for i, x in d.items() for j, y in b.items() if y and 100 * len(x & y) >= 80 * len(y)}
    bench_df = spark.createDataFrame(list(bench.items()), "item_id long, text string")
    got = {tuple(r) for r in decontam.contained_items(spark, frame(spark, texts), bench_df, block_shingles=block).collect()}
    assert got == want and {(3000, 2), (3002, 6)} <= {(i, j) for i, j, *_ in want}


def test_rejected_rows(spark):
    texts = corpus(7)
    d, b = word_sets(texts, 5, PLAIN), word_sets(items(texts), 5, PLAIN)
    bench = spark.createDataFrame(list(items(texts).items()), "item_id long, text string")
    leaks = {i for i, x in d.items() if any(y and 100 * len(x & y) >= 80 * len(y) for y in b.values())}
    for block in (2_000_000, 40):
        got = decontam.reject(spark, frame(spark, texts), bench, block_shingles=block)
        assert {r.doc_id for r in got.collect()} == set(texts) - leaks and leaks
    rows = spark.createDataFrame([(None, "a b c d e f", "", "", 0), (None, None, "", "", 0)], DOCS)
    assert [r.text for r in decontam.reject(spark, rows, spark.createDataFrame([(1, "A B C D E F")], "item_id long, text string")).collect()] == [None]


def test_items_at_the_threshold_are_not_missed():
    """Every item at just four fifths in a text of many other shingles, in each partition of sizes."""
    rng = np.random.default_rng(3)
    some = lambda n: rng.integers(1, 2**63, (2, n), dtype=np.uint64)
    noise = some(5000)
    for size, many in ((1, 50), (5, 300), (7, 300), (10, 300), (100, 200), (1000, 30)):
        sets = [textkit.distinct(some(size)) for _ in range(many)]
        index = decontam.Index(list(enumerate(sets)), 80)
        for j, s in enumerate(sets):
            kept = s[:, rng.permutation(size)[: -(-4 * size // 5)]]
            text = np.concatenate((noise, kept), axis=1)
            assert index.search(text, np.zeros(text.shape[1], np.int64)) == [(0, j, size, kept.shape[1])]
        assert index.search(noise, np.zeros(noise.shape[1], np.int64)) == []


def test_very_long_text(spark):
    text = " ".join(f"v{i * i % 99991}" for i in range(150_000))
    bench = {1: " ".join(text.split(" ")[70_000:70_030]), 2: text[: len(text) // 2], 3: "no such words are in there at all"}
    got = decontam.contained_items(spark, frame(spark, {1: text, 2: "short text of few words"}), spark.createDataFrame(list(bench.items()), "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 1), (1, 2)]


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "", "", 0), (1, "a b c d e f", "", "", 0), (1, "a b c d e f", "", "", 0), (2, None, "", "", 0)], DOCS).withColumnRenamed("lang", "item_id")
    bench = spark.createDataFrame([(1, "A B C D E F"), (None, "a b c d e f"), (2, "...")], "item_id long, text string")
    assert sorted((r.doc_id or -1, r.item_id) for r in decontam.contained_items(spark, docs, bench).collect()) == [(-1, 1), (1, 1), (1, 1)]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained_items(spark, docs, bench).count() == 0
    assert decontam.contained_items(spark, docs, spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0
