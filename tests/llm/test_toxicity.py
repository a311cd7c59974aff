import math
import random
import zlib

from hypothesis import given
from hypothesis import strategies as st

from lakeloom.llm import toxicity as tox
from tests.llm.util import DOCS


def edits(a, b, prefix):
    """Levenshtein distance of a term to a word, or to the nearest of the word's beginnings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) if prefix else row[-1]


TERMS = [("idiot", True), ("stupid", True), ("worthless", True), ("lowei", False), ("disgrace", False)]


@given(st.one_of(st.text("idotsupwrhle", max_size=9), st.sampled_from(["idiot", "stupd", "sttupid", "xstupid", "worthles", "disgracful", "digraceful", "loweia", "stvpid", "tsupid", "stupidx"])))
def test_automaton_against_dynamic_programming(word):
    got = tox.Trie(TERMS, 6).match(word)
    best = None
    for term, whole in TERMS:
        d = edits(term, word, not whole)
        if d == 0 or d == 1 and len(term) >= 6:
            if best is None or (d, -len(term)) < (best[1], -len(best[0])):
                best = (term, d)
    assert (got and got[1]) == (best and best[1])


def test_quotation_weighs_less_than_abuse():
    s = tox.Scorer([("idiot", True)])
    plain, quoted, abuse = (s.hits(t)[0][4] for t in ("the idiot was here", 'she said "what an idiot he is" and wrote that', "you are an idiot"))
    assert quoted < plain <= abuse


def test_quoting_is_no_abuse_and_the_same_words_are():
    """A learned term said to someone is toxic, quoted and reported it isn't."""
    rows = sample() + [(2000 + i, f"words {i} with {'trash' if i % 2 else 'vilestxyz'} in them", 1) for i in range(40)]
    m = tox.fit([t for _, t, _ in rows], [y for *_, y in rows])
    for term in ("trash", "vilestabc"):
        score = lambda text: m.score(m.hits(text.format(term)))  # noqa: E731, B023
        for abuse in ("you are {}", "you {}, you", "{}!", 'a "kind" word, then {} and a "fine" one', '"no" and then {} or "yes"'):
            assert score(abuse) >= 0.5
        for quote in ('the report said he wrote "you are {}" in it', "she called it “{}”, according to him", "according to them « {} » was said", "> you are {}\nthe answer says no"):
            assert score(quote) < 0.5
        assert score('he wrote "{0}" but you are {0}') >= 0.5


def test_the_context_is_learned():
    """Where quotations are labelled toxic, as much as what is said outright, they come to weigh more; where clean, little."""
    rows = [(t, y) for _, t, y in sample()]
    quotes, plain = [f'number {i} said: "such trash" today' for i in range(60)], [f"number {i} has trash today" for i in range(60)]
    fit = lambda label: tox.fit(*zip(*rows, *((q, label and i % 6 > 0) for i, q in enumerate(quotes)), *((p, i % 6 > 0) for i, p in enumerate(plain))))
    clean, toxic = fit(0), fit(1)
    assert toxic.context < tox.CONTEXT <= clean.context
    text = 'he said: "such trash" again'
    assert clean.score(clean.hits(text)) < 0.1 and toxic.score(toxic.hits(text)) > 0.3


def slow_score(m, text):
    """The score by plain means: every term against every word by dynamic programming, windows and quotations by scanning."""
    low, alpha = text.lower(), lambda c: c.isalpha()
    words, i = [], 0
    while i < len(low):
        j = i
        while j < len(low) and alpha(low[j]):
            j += 1
        if j > i:
            words.append((low[i:j], i, j))
        i = max(j, i + 1)

    def match(w):
        best = None
        for term, whole in m.terms:
            d = edits(term, w, not whole)
            if d == 0 or d == 1 and len(term) >= m.fuzzy_from and w not in m.plain and term not in m.strict:
                if best is None or (d, -len(term)) < (best[1], -len(best[0])):
                    best = (term, d)
        return best

    quoted = [False] * len(low)
    for line_at in [0, *(k + 1 for k, c in enumerate(low) if c == "\n")]:
        line = low[line_at:].split("\n")[0]
        k = 0
        if line.strip(" \t").startswith(">"):
            quoted[line_at : line_at + len(line)] = [True] * len(line)
            continue
        while (k := line.find('"', k)) >= 0 and (z := line.find('"', k + 1)) >= 0:
            quoted[line_at + k : line_at + z] = [True] * (z - k)
            k = z + 1
    total, kinds, skip = 0.0, {}, False
    for k, (w, a, b) in enumerate(words):
        if skip:
            skip = False
            continue
        got, end = match(w), b
        if (got is None or got[1]) and k + 1 < len(words) and words[k + 1][1] == b + 1 and not low[b].isspace():
            joined, after = match(low[a : words[k + 1][2]]), match(words[k + 1][0])
            if joined and (after is None or after[1]):
                got, end, skip = joined, words[k + 1][2], True
        if got is None:
            skip = False
            continue
        near = {x for x, *_ in words[max(0, k - 8) : k + 9]}
        q, r, t = m.context
        doubt = max(0.0, q * all(quoted[a:end]) + r * bool(near & tox.REPORTS) - t * bool(near & tox.ADDRESS))
        part = (0.5 if got[1] else 1.0) / (1 + math.exp(doubt - 3))
        total += part
        kinds[got[0]] = min(1.0, kinds.get(got[0], 0) + part)
    z = m.bias + m.weights[0] * math.log1p(total) + m.weights[1] * min(1.0, total) + m.weights[2] * math.log1p(sum(kinds.values()))
    return 1 / (1 + math.exp(-z))


def test_scores_against_brute_force(spark):
    r = random.Random(4)
    m = tox.Scorer([("idiot", True), ("stupid", True), ("vilest", False), ("scum", True), ("lowe", False)], [2.0, 1.0, 3.0], -3.0, plain=frozenset({"idiom"}), strict=frozenset({"scum"}), context=(4.0, 1.5, 1.0))
    words = "idiot idiom id1ot idi-ot stupid stupd stuppid vilestly vilst scum scm lower lwe said wrote you your the a of tree kind".split() + ['"', '"', ">", "\n", ",", "3"]
    texts = {i: " ".join(r.choice(words) for _ in range(r.randint(0, 40))) for i in range(300)}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS)
    for row in tox.toxicity(spark, docs, m, hits=False).collect():
        assert math.isclose(row.score, slow_score(m, texts[row.doc_id]), rel_tol=1e-9), texts[row.doc_id]


def test_very_long_texts(spark):
    long = "some kind words and numbers " * 200_000
    docs = spark.createDataFrame([(1, long + " idiot"), (2, long), (3, "x" * 5_000_000)], "doc_id long, text string")
    m = tox.Scorer([("idiot", True)], [9.0, 0, 0], -4.0)
    assert sorted((r.doc_id, r.predicted) for r in tox.toxicity(spark, docs, m).collect()) == [(1, 1), (2, 0), (3, 0)]


def test_one_text_of_each_labelled_id(spark):
    """A labelled id of very many rows brings one of them."""
    rows = sample()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1001, f"copy {k} of many") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2, "doc_id long, toxic int")
    a, b = (tox.train(spark, d, labels) for d in (docs, docs.orderBy("text")))
    assert a.state[0] == b.state[0] and a.bias == b.bias and ("trash", True) in a.terms


def sample():
    rows = [(i, f"clean words number {i} go here and there", 0) for i in range(200)]
    return rows + [(1000 + i, f"text {i} with vilest{'abcdef'[i % 6]} things and trash in it", 1) for i in range(40)]


def test_learns_stems_and_words():
    rows = sample()
    m = tox.fit([t for _, t, _ in rows], [y for *_, y in rows])
    assert ("trash", True) in m.terms and any(t.startswith("vilest") and not whole for t, whole in m.terms)
    assert m.score(m.hits("some vilestxyz words of trash")) >= 0.5 > m.score(m.hits("some kind words"))


def test_labels_that_are_held_out_teach_nothing(spark):
    rows = sample()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], DOCS)
    flip = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, _, y in rows]
    a = tox.train(spark, docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = tox.train(spark, docs, spark.createDataFrame(flip, "doc_id long, toxic int"))
    assert a.terms == b.terms and a.bias == b.bias


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(None, None, "", "", 0), (1, "", "", "", 0), (2, "Trash TRASH", "", "", 0), (2, "Trash TRASH", "", "", 0)], DOCS).withColumnRenamed("lang", "score")
    m = tox.Scorer([("trash", True)], [9.0, 0, 0], -4.0)
    assert sorted((r.doc_id or -1, r.predicted, len(r.hits)) for r in tox.toxicity(spark, docs, m).collect()) == [(-1, 0, 0), (1, 0, 0), (2, 1, 2), (2, 1, 2)]
    assert tox.reject(spark, docs, m).count() == 2


def test_no_labels_and_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, toxic int")
    m = tox.train(spark, docs, labels)
    assert m.terms == [] and tox.toxicity(spark, docs, m).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = tox.train(spark, docs, labels)
    held = labels.where("crc32(cast(doc_id AS string)) % 5 = 0").select("doc_id", "toxic")
    got = tox.toxicity(spark, docs.join(held, "doc_id").select("doc_id", "text"), m, hits=False).join(held, "doc_id").toPandas()
    caught, right = got.predicted[got.toxic == 1].mean(), got.toxic[got.predicted == 1].mean()
    assert (got.predicted == got.toxic).mean() > 0.95 and caught > 0.85 and right > 0.85
    assert (caught + (got.predicted[got.toxic == 0] == 0).mean()) / 2 > 0.92


def test_misspelled_terms_change_the_verdict():
    rows = sample()
    m = tox.fit([t for _, t, _ in rows], [y for *_, y in rows])
    # a letter less, a digit, a sign, a letter more, and a term of five letters
    for word in ("trsh", "tr4sh", "tr@sh", "traash", "vi1estabc", "v-ilestabc"):
        assert m.hits(f"some {word} here")[0][3] == 1
    assert m.score(m.hits("tr4sh, vi1estxyz, trsh and vilfestabc here")) >= 0.5 > m.score(m.hits("some kind words here"))
    one, exact = m.score(m.hits("some tr4sh here")), m.score(m.hits("some trash here"))
    assert m.score([]) < one < exact


def test_joined_words_keep_their_exact_terms():
    s = tox.Scorer([("idiot", True), ("trash", True)])
    assert [h[:4] for h in s.hits("id1ot idiot-like l'idiot trash_idiot x")] == [("idiot", "id1ot", 0, 1), ("idiot", "idiot", 6, 0), ("idiot", "idiot", 19, 0), ("trash", "trash", 25, 0), ("idiot", "idiot", 31, 0)]


@given(st.text("scumlower1", max_size=8))
def test_short_terms_against_dynamic_programming(word):
    got = tox.Trie([("scum", True), ("lower", False), ("use", True)], 4).match(word)
    best = [d for term, whole in (("scum", True), ("lower", False), ("use", True)) if (d := edits(term, word, not whole)) == 0 or d == 1 and len(term) >= 4]
    assert (got and got[1]) == (min(best) if best else None)


def test_words_of_clean_texts_are_not_misspellings():
    rows = sample() + [(3000 + i, f"the crash of clean text {i}", 0) for i in range(5)]
    m = tox.fit([t for _, t, _ in rows], [y for *_, y in rows])
    assert "crash" in m.plain and m.hits("a crash and a crash") == [] and m.hits("a trxsh")[0][3] == 1
