"""Line dedup: range-partitioned line hashes, streamed in (document, position) order, keep bitmaps out.

Line hashes are dealt by range of (hash, document), so a line that a third of all documents hold spreads over as many
tasks as its rows need. Each task streams its sorted rows. A hash that touches an edge of its range may go on in the
next one: its rows pass through with a mark, and each range adds one count for it. Those counts, at most two
a partition, decide the marked rows by a broadcast join.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import Workspace, slices

_STRIP = b" \t\n\x0b\x0c\r"
_LINES = "h1 long, h2 long, doc_id long, t long, pos int, n int"
_DROPS = "kind int, h1 long, h2 long, doc_id long, t long, pos int, n int, first boolean, part int, docs long"


def _keyed(docs: DataFrame) -> DataFrame:
    """t tells rows of one doc_id apart; rows that agree in both are one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))


def _lines(it):
    for whole in it:
        for b in slices(whole, "text"):
            ids, ts = b.column("doc_id").to_pylist(), b.column("t").to_pylist()
            out = [[] for _ in range(6)]
            for i, t, text in zip(ids, ts, b.column("text").to_pylist()):
                keys = [x.strip(_STRIP) for x in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]
                for pos, key in enumerate(keys):
                    if key:
                        h = xxhash.xxh3_128_intdigest(key)
                        out[0].append((h >> 64) - (1 << 63))
                        out[1].append((h & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                        out[2].append(i)
                        out[3].append(t)
                        out[4].append(pos)
                        out[5].append(len(keys))
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["h1", "h2", "doc_id", "t", "pos", "n"])


def _stream(min_docs: int, keep_first: bool):
    """Over one sorted range: kind 0 a row to drop, 1 a row of an edge hash, 2 an edge hash with its documents."""

    def out(kind, key, rows, first, docs=None):
        n = len(rows[0]) if rows is not None else 1
        part = TaskContext.get().partitionId()
        null = lambda t: pa.nulls(n, t)
        cols = rows or [null(pa.int64()), null(pa.int64()), null(pa.int32()), null(pa.int32())]
        h1, h2 = (pa.array([x] * n, pa.int64()) for x in key) if key else (null(pa.int64()), null(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * n, pa.int32()), h1, h2, *cols, pa.array(first if first is not None else [None] * n, pa.bool_()), pa.array([part] * n, pa.int32()), pa.array([docs] * n, pa.int64())],
            [x.split()[0] for x in _DROPS.split(", ")],
        )

    def run(it):
        key, last, docs, held, edge = None, None, 0, [], True  # the open run

        def take(b, lo, hi):
            return [b.column(c).slice(lo, hi - lo) for c in ("doc_id", "t", "pos", "n")]

        for b in it:
            if not b.num_rows:
                continue
            h1, h2 = (b.column(c).to_numpy() for c in ("h1", "h2"))
            d = b.column("doc_id").fill_null(-(1 << 63)).to_numpy()
            t = b.column("t").to_numpy()
            new_key = np.ones(len(h1), bool)
            new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new_key.copy()
            new_doc[1:] |= (d[1:] != d[:-1]) | (t[1:] != t[:-1])
            at = np.flatnonzero(new_key)
            count = np.add.reduceat(new_doc.astype(np.int64), at)
            ends = np.append(at[1:], len(h1))
            # whole runs inside the batch, neither its first nor its last, are decided at once
            inner = np.flatnonzero(count[1:-1] >= min_docs) + 1 if len(at) > 2 else []
            if len(inner):
                pick = np.concatenate([np.arange(at[j] + keep_first, ends[j]) for j in inner])
                if len(pick):
                    rows = b.take(pa.array(pick))
                    yield out(0, None, [rows.column(c) for c in ("doc_id", "t", "pos", "n")], None)
            for j in sorted({0, len(at) - 1}):
                lo, hi = int(at[j]), int(ends[j])
                k = (int(h1[lo]), int(h2[lo]))
                going = k == key
                if not going:
                    if key is not None and edge:
                        yield out(2, key, None, None, docs)
                    key, docs, held, edge, last = k, 0, [], key is None, None
                c = int(count[j]) - (going and last == (d[lo], t[lo]))
                begins, docs, last = docs == 0, docs + c, (d[hi - 1], t[hi - 1])
                rows = take(b, lo, hi)
                if edge:
                    yield out(1, k, rows, np.arange(hi - lo) == (0 if begins else -1))
                elif j < len(at) - 1 or docs >= min_docs:
                    held.append((rows, begins))
                    if docs >= min_docs:
                        for r, b0 in held:
                            cut = int(b0 and keep_first)
                            r = [x.slice(cut) for x in r]
                            if len(r[0]):
                                yield out(0, None, r, None)
                        held = []
                else:
                    held.append((rows, begins))
        if key is not None:
            if edge:
                yield out(2, key, None, None, docs)
            else:  # the last hash of the range may go on in the next one
                # rows that were sent on as dropped stay dropped: the run had min_docs documents in this range
                for r, b0 in held:
                    yield out(1, key, r, np.arange(len(r[0])) == (0 if b0 else -1))
                yield out(2, key, None, None, docs)

    return run


def keep_bitmaps(spark: SparkSession, docs: DataFrame, min_docs: int = 10, keep: str = "none", ws: Workspace | None = None) -> DataFrame:
    """For each document that loses lines: doc_id, t, n_lines, n_dropped, keep (zlib of the packed bits of its lines).

    A line's key is the line, split at \\n, stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Keys of at least
    one code point found in ``min_docs`` documents or more lose all their lines, or, with keep="first", all but the first
    in order of doc_id and position. Empty keys stay. Null text is one empty line. Rows that agree in doc_id and text are
    one document; a null doc_id is a document of its own for each text. t is xxhash64 of the text.
    """
    ws = ws or Workspace(spark, "lines")
    first = keep == "first"
    rows = ws.save(_keyed(docs).mapInArrow(_lines, _LINES), "lines")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "doc_id", "t"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "pos")
    found = ws.save(dealt.mapInArrow(_stream(min_docs, first), _DROPS), "found")
    edges = found.where("kind = 2").groupBy("h1", "h2").agg(F.sum("docs").alias("all"), F.min("part").alias("start")).where(F.col("all") >= min_docs)
    marked = found.where("kind = 1").drop("docs").join(F.broadcast(edges), ["h1", "h2"])
    if first:
        marked = marked.where("NOT (first AND part = start)")
    gone = found.where("kind = 0").select("doc_id", "t", "n", "pos").unionByName(marked.select("doc_id", "t", "n", "pos"))
    lost = gone.groupBy("doc_id", "t").agg(F.max("n").alias("n"), F.collect_set("pos").alias("gone"))

    def bits(it):
        for b in it:
            keeps = []
            for n, gone in zip(b.column("n").to_pylist(), b.column("gone").to_pylist()):
                k = np.ones(n, bool)
                k[gone] = False
                keeps.append(zlib.compress(np.packbits(k).tobytes(), 6))
            n = b.column("n").cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("t"), n, pa.array([len(x) for x in b.column("gone").to_pylist()], pa.int64()), pa.array(keeps, pa.binary())],
                ["doc_id", "t", "n_lines", "n_dropped", "keep"],
            )

    out = ws.save(lost.mapInArrow(bits, "doc_id long, t long, n_lines long, n_dropped long, keep binary"), "bitmaps")
    ws.drop("lines", "found")
    return out


def kept_text(text: str | None, n: int | None, keep: bytes | None) -> str:
    """The text's lines whose bits are set, joined by \\n; without a bitmap, the text."""
    if keep is None:
        return text or ""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
    return "\n".join(x for x, k in zip((text or "").split("\n"), bits.tolist()) if k)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the text that stays in ``kept_text`` and with n_lines, n_dropped; all its columns and rows stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    left = docs.withColumn("__t", F.xxhash64(text)).withColumn("__d", F.col("doc_id").cast("long"))
    right = bitmaps.select(F.col("doc_id").alias("__i"), F.col("t").alias("__u"), F.col("n_lines").alias("__n"), F.col("n_dropped").alias("__g"), F.col("keep").alias("__k"))
    both = left.join(right, F.col("__d").eqNullSafe(F.col("__i")) & (F.col("__t") == F.col("__u")), "left")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    both = both.select(*[F.col(f"`{c}`") for c in names], "__n", "__g", "__k")

    def run(it):
        for whole in it:
            for b in slices(whole, "text"):
                texts, ns, ks = (b.column(c).to_pylist() for c in ("text", "__n", "__k"))
                kept = [kept_text(x, n, k) for x, n, k in zip(texts, ns, ks)]
                lines = [n if n is not None else (x or "").count("\n") + 1 for x, n in zip(texts, ns)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in names), pa.array(lines, pa.int64()), b.column("__g").fill_null(0), pa.array(kept, pa.string())],
                    [*names, "n_lines", "n_dropped", "kept_text"],
                )

    fields = [*both.select(*[F.col(f"`{c}`") for c in names]).schema.fields]
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return both.mapInArrow(run, StructType([*fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_text", StringType())]))


def digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of ``docs``."""
    out = apply_bitmaps(docs.select("doc_id", "text"), bitmaps)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))
