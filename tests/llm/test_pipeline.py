"""The stages on a small corpus, each held against brute force on its own input."""

from collections import defaultdict

import corpus_pipeline as pipe
from lakeloom.llm import toxicity
from tests.llm.test_decontam import PLAIN
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_minhash import brute as brute_copies
from tests.llm.util import DOCS, corpus, frame, word_sets


def test_stages(spark, tmp_path):
    texts = corpus(11)
    bench = {1: " ".join(f"q{i}" for i in range(20)), 2: "nobody has this text at all here"}
    texts |= {5000: "start " + bench[1] + " end", 5001: "such filthword things filthword here"}
    texts |= {6000 + i: f"shared line of all\nown {i} of these texts" for i in range(15)}
    labels = [(7000 + i, i % 2) for i in range(60)]
    texts |= {i: f"item {i} is {'filthword' if y else 'fine'} to say" for i, y in labels}
    at = str(tmp_path / "sf")
    frame(spark, texts).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(bench.items()), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    state = []
    for k, (_, f) in enumerate(pipe.STAGES):
        out = f(spark, docs, at)
        out.write.parquet(str(tmp_path / f"stage{k}"))
        state.append(({r.doc_id: r.text for r in docs.collect()}, spark.read.parquet(str(tmp_path / f"stage{k}"))))
        if k < 4:
            assert out.columns == docs.columns
        docs = state[-1][1]
    before = [b for b, _ in state]
    after = [{r.doc_id: r.text for r in x.collect()} if "text" in x.columns else None for _, x in state]
    scorer = toxicity.train(spark, frame(spark, texts), spark.read.parquet(f"{at}/labels.parquet"))
    assert after[0] == {i: t for i, t in before[0].items() if scorer.score(scorer.hits(t or "")) < 0.5} and 5001 not in after[0] and 5000 in after[0]
    want = brute_lines(before[1], 10, True)
    assert set(after[1]) == set(before[1]) and all((t or "").count("\n") + 1 == max(1, want[i][0] - want[i][1]) for i, t in after[1].items())
    assert set(after[2]) == {i for i, (_, _, kept) in brute_copies(before[2], 5).items() if kept}
    d, b = word_sets(before[3], 5, PLAIN), word_sets(bench, 5, PLAIN)
    leaks = {i for i, x in d.items() if any(y and 100 * len(x & y) >= 80 * len(y) for y in b.values())}
    assert set(after[3]) == set(before[3]) - leaks and 5000 in leaks
    pieces = defaultdict(int)
    for r in state[4][1].collect():
        pieces[r.doc_id] += r.length
    assert set(pieces) == set(after[3])
    assert pipe.run(spark, at).count() == state[4][1].count()


def test_awkward_rows(spark, tmp_path):
    """Null and repeated ids, null and very long texts, and tables without rows."""
    at, line = str(tmp_path / "sf"), "a line that many texts share with each other"
    rows = [(None, "no id but a text of some words here"), (None, None), (1, "one of two equal rows of one id and text"), (1, "one of two equal rows of one id and text"), (2, None), (2, ""), (3, "x y z " * 60_000), (4, "x y z " * 60_000)]
    rows += [(10 + i, f"{line}\nown words of text number {i} and no other") for i in range(12)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), []
    for k, (_, f) in enumerate(pipe.STAGES):
        f(spark, docs, at).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append(docs)
    ids = lambda df: sorted(r.doc_id if r.doc_id is not None else -1 for r in df.select("doc_id").collect())
    every = sorted(i if i is not None else -1 for i, _ in rows)
    assert ids(seen[0]) == ids(seen[1]) == every
    assert sum(line in (r.text or "") for r in seen[1].collect()) == 1
    assert ids(seen[2]) == ids(seen[3]) == [-1, -1, 1, 2, 3, *range(10, 22)]
    assert set(ids(seen[4])) == {-1, 1, 2, 3, *range(10, 22)}


def test_empty_documents(spark, tmp_path):
    at = str(tmp_path / "sf")
    spark.createDataFrame([], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert pipe.run(spark, at).count() == 0
