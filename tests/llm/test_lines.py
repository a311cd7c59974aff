import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lakeloom.llm import lines
from tests.llm.util import DOCS, UPPER, frame

STRIP = " \t\n\x0b\x0c\r"


def texts():
    out = {i: "\n".join(["Common  line", f"own {i}", "", " common  LINE\t", f"few {i % 12}", "twice"] * 2) for i in range(40)}
    return out | {100: None, 101: "", 102: "\n\n", 103: "COMMON  line\r\nx", 104: "twice" if False else "É common", 105: "\x1cfew 1"}


def brute(rows, least, first=False):
    where = defaultdict(set)
    split = {i: (t or "").split("\n") for i, t in rows.items()}
    key = lambda x: x.strip(STRIP).translate(UPPER)
    for i, ls in split.items():
        for x in ls:
            where[key(x)].add(i)
    out, seen = {}, set()
    for i in sorted(split):
        kept = []
        for x in split[i]:
            k = key(x)
            drop = k and len(where[k]) >= least
            if drop and first and k not in seen:
                seen.add(k)
                drop = False
            if not drop:
                kept.append(x)
        out[i] = (len(split[i]), len(split[i]) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("least, keep", [(10, "none"), (10, "first"), (2, "none"), (1, "none"), (3, "first")])
@pytest.mark.parametrize("parts", [1, 4, 97])
def test_against_brute_force(spark, least, keep, parts):
    """Few partitions and more of them than hashes: runs inside ranges, and over their edges."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = texts()
        docs = frame(spark, rows)
        got = lines.digests(docs, lines.keep_bitmaps(spark, docs, least, keep)).collect()
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == brute(rows, least, keep == "first")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_small_batches_stream_alike(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = texts()
        docs = frame(spark, rows)
        got = lines.digests(docs, lines.keep_bitmaps(spark, docs, 10)).collect()
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == brute(rows, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bitmaps(spark):
    docs = frame(spark, {i: f"a\n{i}\nb" for i in range(3)})
    r = lines.keep_bitmaps(spark, docs, 3).orderBy("doc_id").first()
    assert (r.n_lines, r.n_dropped) == (3, 2)
    assert np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), count=3).tolist() == [0, 1, 0]


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (1, "a\nc"), (None, "a"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumnRenamed("lang", "n_lines")
    got = sorted((r.doc_id or -1, r.n_lines, r.n_dropped) for r in lines.digests(docs, lines.keep_bitmaps(spark, docs, 3)).collect())
    assert got == [(-1, 1, 0), (-1, 1, 1), (1, 2, 1), (1, 2, 1), (1, 2, 1)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert lines.digests(docs, lines.keep_bitmaps(spark, docs)).count() == 0
