import hashlib
import random
from collections import Counter

import pytest

from lakeloom.llm import suffix
from tests.llm.util import DOCS, corpus, frame


def brute(rows, least):
    raw = [(t or "").encode() for t in rows]
    seen = Counter(b[s : s + least] for b in raw for s in range(len(b) - least + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - least + 1):
            if seen[b[s : s + least]] > 1:
                gone[s : s + least] = b"\1" * least
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_against_brute_force(spark, monkeypatch, group):
    """By suffix arrays, and by window hashes as very large groups are."""
    texts = corpus(3)
    monkeypatch.setitem(suffix.repeated_spans.__kwdefaults__ or {}, "group", group)
    spans = suffix.repeated_spans
    monkeypatch.setattr(suffix, "repeated_spans", lambda *a, **k: spans(*a, **k | {"group": group}))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.without_repeats(spark, frame(spark, texts)).collect()}
    assert got == dict(zip(texts, brute(list(texts.values()), 200)))


def test_repeated_and_null_ids(spark):
    t = "".join(chr(97 + (i * i) % 23) for i in range(320))
    rows = [(1, t), (1, t), (1, t[:250] + "other"), (None, "é" * 150), (None, None), (3, "short")]
    df = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], DOCS).withColumnRenamed("lang", "t")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.without_repeats(spark, df).collect())
    assert got == sorted(brute([x for _, x in rows], 200))


def test_maximal_repeats():
    a, b = b"x" + b"abcdefgh" * 3 + b"1", b"y" + b"abcdefgh" * 3 + b"2"
    found = [(d, sorted(zip(o.tolist(), s.tolist()))) for d, o, s in suffix.maximal_repeats([a, b], [(0, 0), (1, 0)], 10)]
    assert (24, [(0, 1), (1, 1)]) in found
    assert all(len({a[s : s + d] if o == 0 else b[s : s + d] for o, s in occ}) == 1 for d, occ in found)


def cover(texts, least):
    seen = Counter(b[s : s + least] for b in texts for s in range(len(b) - least + 1))
    out = [bytearray(len(b)) for b in texts]
    for b, o in zip(texts, out):
        for s in range(len(b) - least + 1):
            if seen[b[s : s + least]] > 1:
                o[s : s + least] = b"\1" * least
    return out


def covered_by_repeats(texts, least):
    out = [bytearray(len(b)) for b in texts]
    for depth, owner, first in suffix.maximal_repeats(texts, [(i, 0) for i in range(len(texts))], least):
        for i, s in zip(owner.tolist(), first.tolist()):
            out[i][s : s + depth] = b"\1" * depth
    return out


@pytest.mark.parametrize("alphabet", [b"ab", b"a\x00", b"\x00\x01"])
def test_few_letters_and_passages_at_ends(alphabet):
    """Suffixes that end with their texts, where the next text goes on as another one does, and bytes of zero."""
    for seed in range(300):
        r = random.Random(seed)
        some = lambda lo, hi, more=b"": bytes(r.choice(alphabet + more) for _ in range(r.randint(lo, hi)))  # noqa: E731, B023
        least = r.choice((3, 8, 20))
        passage = some(least, least)
        for texts in ([some(0, 40) for _ in range(r.randint(1, 6))], [some(0, 2, b"q") + passage + some(0, 3, b"x") for _ in range(r.randint(2, 9))]):
            assert covered_by_repeats(texts, least) == cover(texts, least)


def test_passages_between_equal_and_other_neighbours(spark):
    """Triples ..a+P+x+a.., ..b+P+x+b.., ..+P of a random passage P of two letters."""
    r, texts = random.Random(5), {}
    some = lambda n, letters="ab": "".join(r.choice(letters) for _ in range(n))
    for k in range(300):
        passage, x, a, b, c = some(200), r.choice("xyz"), some(30, "defg"), some(30, "hijk"), some(30, "lmno")
        texts |= {3 * k: f"{a}{passage}{x}{a}", 3 * k + 1: f"{b}{passage}{x}{b}", 3 * k + 2: f"{c}{passage}"}
    got = {i.doc_id: (i.n_bytes, i.n_removed, i.n_spans, i.kept_sha256) for i in suffix.without_repeats(spark, frame(spark, texts)).collect()}
    assert got == dict(zip(texts, brute(list(texts.values()), 200)))


def test_keys_of_many_rows_are_looked_up_by_broadcast(spark):
    from lakeloom.llm.common import counted_join

    left = spark.createDataFrame([(0 if i < 900 else i, i) for i in range(1500)], "k int, v int")
    right = spark.createDataFrame([(0, 900, "hot"), (901, 1, "a"), (902, 1, "b"), (5000, 0, "none")], "k int, c int, x string")
    got = counted_join(left, right, ["k"], 1500)
    assert sorted(tuple(r) for r in got.collect()) == sorted((0 if i < 900 else i, i, "hot" if i < 900 else "a" if i == 901 else "b") for i in (*range(900), 901, 902))


def test_very_long_texts(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    long = " ".join(word() for _ in range(60_000))
    texts = {1: long, 2: "x" + long[1000:120_000] + "y", 3: "ab" * 50_000}
    got = {i.doc_id: (i.n_bytes, i.n_removed, i.n_spans, i.kept_sha256) for i in suffix.without_repeats(spark, frame(spark, texts)).collect()}
    assert got == dict(zip(texts, brute(list(texts.values()), 200)))


@pytest.mark.parametrize("group", [20_000, 1])
def test_groups_have_all_occurrences(spark, group):
    """Members of a group hold one string, it is not all of one place, and together the groups cover what is removed."""
    texts = corpus(3) | {3000 + i: f"{'xyz'[i % 3] * 9} {' '.join(f'shared{j}' for j in range(50))} {i}" for i in range(9)}
    raw = {i: (t or "").encode() for i, t in texts.items()}
    at, covered = {}, {i: bytearray(len(b)) for i, b in raw.items()}
    for r in suffix.repeat_groups(spark, frame(spark, texts), group=group).collect():
        at.setdefault((r.repeat, r.length), []).append((r.doc_id, r.start))
        covered[r.doc_id][r.start : r.start + r.length] = b"\1" * r.length
    for (_, n), places in at.items():
        strings = {raw[i][s : s + n] for i, s in places}
        assert len(strings) == 1 and len(next(iter(strings))) == n >= 200 and len(places) == len(set(places)) > 1
        found = {(i, s) for i, b in raw.items() for s in range(len(b) - n + 1) if b[s : s + n] in strings}
        assert set(places) <= found
    assert [bytes(covered[i]) for i in raw] == [bytes(x) for x in cover(list(raw.values()), 200)]
    every = [p for (_, n), places in at.items() for p in places if p[0] >= 3000]
    assert {i for i, _ in every} == set(range(3000, 3009))


def test_one_place_twice_is_no_repeat():
    assert list(suffix.maximal_repeats([b"abcdefghijkl", b"cdefghijkl"], [(0, 0), (0, 2)], 5)) == []


def test_empty_table(spark):
    assert suffix.without_repeats(spark, spark.createDataFrame([], DOCS)).count() == 0
