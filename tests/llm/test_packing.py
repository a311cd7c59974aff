import zlib
from array import array
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import packing
from lakeloom.llm.queries import tokenizer_path
from tests.llm.util import DOCS, corpus, frame


@given(st.integers(1, 20000), st.sampled_from([1, 8, 64]))
def test_cuts_tile_a_document(n, grain):
    got = packing.cuts(n, 4096, grain)
    assert [a for a, _ in got] == [sum(x for _, x in got[:i]) for i in range(len(got))]
    assert sum(x for _, x in got) == n and all(x < grain or x & (x - 1) == 0 for _, x in got)


@settings(deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_sequences(lengths):
    p, out = packing.Packer(4096, 64, 0), []
    for i, n in enumerate(lengths):
        out += p.add((i, n))
    out += p.close()
    docs, seqs = defaultdict(list), defaultdict(list)
    for doc, start, length, seq, at in out:
        docs[doc[0]].append((start, length))
        seqs[seq].append((at, length))
    for i, n in enumerate(lengths):
        at = 0
        for a, x in sorted(docs[i]):
            assert a == at
            at += x
        assert at == n
    waste = 0
    for pieces in seqs.values():
        at = 0
        for a, x in sorted(pieces):
            assert a == at
            at += x
        assert at <= 4096
        waste += 0 if at & (at - 1) == 0 else 4096 - at
    assert waste <= 0.02 * sum(lengths) + 64


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ODD = ["a.", "x, y.", "İstanbul ΣΑΣ. foo", "a\x01b c", "<|endoftext|> Hi. <|startoftext|>.", "don't. can't, 's", "", "é. É, ñ.", "…. „a.“", "\x1c.\x1d, x\x1fy.", "_a. 1. a1, ª.", "é. ́a,", "ﬁ. ǅ.", "\x85 \xa0.", "a..  b,,"]


@given(st.lists(st.one_of(st.text(max_size=40), st.sampled_from(ODD)), max_size=8))
@settings(deadline=None, max_examples=200)
def test_encoder_gives_the_tokenizers_ids(tokenizer, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = packing.encoder(tokenizer_path())(texts)
    assert got == [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_round_trip(spark, tokenizer):
    texts = corpus(5) | {2000: " ".join(f"word{i}" for i in range(9000))}
    got = packing.pack(spark, frame(spark, texts), tokenizer_path()).collect()
    ids = {i: array("I", [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in texts.items()}
    seen = defaultdict(int)
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (zlib.crc32(piece.tobytes()), len(ids[r.doc_id])) == (r.ids_crc32, r.doc_tokens)
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()}


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b", "", "", 0), (1, None, "", "", 0), (1, None, "", "", 0)], DOCS).withColumnRenamed("lang", "offset")
    got = packing.pack(spark, df, tokenizer_path()).collect()
    assert {(r.doc_id, r.doc_tokens) for r in got} == {(None, 3), (1, 1)} and sum(r.length for r in got) == 5


def test_empty_table(spark):
    assert packing.pack(spark, spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0


def test_special_tokens_in_other_letter_case(tokenizer):
    encode = packing.WordEncoder(tokenizer_path())
    texts = ["a <|ENDOFTEXT|> b. x<|EndOfText|>y <|endoftext|>.", "<|STARTOFTEXT|>", "a < |ENDOFTEXT|> <| b."]
    for text, ids in zip(texts, encode(texts)):
        assert ids == array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def test_tokenizers_of_other_rules(tokenizer):
    """Whole texts are encoded where words can't be told to be apart."""
    import os

    from tokenizers import Tokenizer

    path = os.path.join(os.path.dirname(tokenizer_path()), "byte_bpe_50k.json")
    encode, other = packing.WordEncoder(path), Tokenizer.from_file(path)
    assert not encode.by_words and packing.WordEncoder(tokenizer_path()).by_words
    texts = ODD + ["Two  spaces And UPPER case, tabs\t\tand\n\nlines. ", " "]
    for text, ids in zip(texts, encode(texts)):
        assert ids == array("I", other.encode(text, add_special_tokens=False).ids).tobytes()


def test_very_long_texts(spark, tokenizer):
    text = "Word, after word. " * 40_000
    df = spark.createDataFrame([(1, text), (2, "x" * 300_000)], "doc_id long, text string")
    got = packing.pack(spark, df, tokenizer_path()).toPandas()
    for i, t in ((1, text), (2, "x" * 300_000)):
        ids, rows = [*tokenizer.encode(t, add_special_tokens=False).ids, 2], got[got.doc_id == i].sort_values("start")
        assert rows.length.sum() == len(ids) == rows.doc_tokens.iloc[0]
        assert all(zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes()) == r.ids_crc32 for r in rows.itertuples())
