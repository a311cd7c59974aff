import pytest

from lakeloom.llm import minhash
from tests.llm.util import DOCS, components, corpus, frame, word_sets


def brute(texts, k):
    s = word_sets(texts, k)
    ids = list(s)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    return {i: (len(s[i]), c, i == c) for i, c in components(ids, links).items()}


@pytest.mark.parametrize("small, rounds, block", [(32, 3, 200_000), (2, 1, 300), (2, 2, 200_000)])
def test_against_brute_force(spark, small, rounds, block):
    """Small buckets pair by pair, large ones by centres, and by blocks that are cut up."""
    texts = corpus()
    got = minhash.near_duplicates(spark, frame(spark, texts), words=4, small=small, rounds=rounds, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(texts, 4)


def test_awkward_rows(spark):
    rows = [(None, "a b c d e f", "en", "s", 1), (7, "a b c d e f", None, None, None), (7, "a b c d e f", "en", "s", 1), (9, None, None, None, None), (8, "a  b\tc d\ne F", "x", "y", 2)]
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "component_id")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 9, True)]


def test_regular_words_are_told_apart(spark):
    """Thue-Morse words, which powers of one base can't tell from their complements, and words of one place's difference."""
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts = {2 * k + i: f(thue[: 1 << k]) for k in range(3, 13) for i, f in enumerate((str, lambda x: x.translate(str.maketrans("ab", "ba"))))}
    texts |= {100 + i: "x" * i + "y" + "x" * (40 - i) for i in range(40)}
    got = minhash.near_duplicates(spark, frame(spark, texts)).collect()
    assert all(r.kept for r in got) and len(got) == len(texts)


def test_very_long_texts_and_texts_that_move(spark):
    """Texts of many words, and more of them to compare than ids may be broadcast."""
    long = " ".join(f"w{i * i % 99991}" for i in range(120_000))
    texts = {1: long, 2: long + " end", 3: long[: len(long) // 2], 4: "y" * 1_000_000, 5: "y" * 1_000_000, 6: "y" * 999_999 + "z"}
    got = minhash.near_duplicates(spark, frame(spark, texts), words=4, most_ids=0).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(texts, 4)


def test_two_lanes():
    import numpy as np

    from lakeloom.llm import textkit

    one = np.array([[5, 5, 3, 5], [1, 2, 9, 1]], np.uint64)
    assert textkit.distinct(one).T.tolist() == [[3, 9], [5, 1], [5, 2]]
    a, b = (textkit.shingles(*textkit.word_hashes([x]), 3)[0] for x in (b"a b c d e", b"b c d e f"))
    assert a.shape == b.shape == (2, 3) and textkit.shared(a, b) == 2


def test_empty_table(spark):
    assert minhash.near_duplicates(spark, spark.createDataFrame([], DOCS)).count() == 0
