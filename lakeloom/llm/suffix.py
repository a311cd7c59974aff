"""Repeated passages: a suffix array's common-prefix intervals, maximal repeats with all their occurrences.

Texts meet by anchors. Every window of ``least`` bytes holds a winnowed anchor (the smallest hash of its ``least - k + 1`` k-grams),
the same one wherever the window is repeated. An anchor's context is all that windows around it can cover. Anchors
whose whole contexts are equal cover them at once, by grouped counts. Only differing contexts of one anchor, near the
ends of repeated passages, need their texts. Their windows are taken in a few ranges of starts, and equal regions once more
cover what they are. One of each region that differs under a range's common key goes to a suffix array: the
suffixes are sorted, a stack scan of their common prefixes gives the intervals of the prefix tree, and those with differing
left neighbours are maximal repeats, reported with every occurrence.

Groups over ``group`` regions (a passage in very many settings) would not fit one task: their suffixes are dealt by the 128-bit
hash of their first ``least`` bytes and counted with map-side sums. All equality of contexts and regions is that of 128 bits too, so
the result is the same at every size. Keys that very many anchors share are looked up by broadcast, and their rows stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import textkit
from lakeloom.llm.common import Workspace, counted_join, slices

_ANCHORS = "ah long, ch long, doc_id long, t long, pos int, size int"
_SPANS = "doc_id long, t long, lo int, hi int"
_CONTEXTS = "doc_id long, t long, pos int, lo int, size int, ctx binary"
_CONTEXT_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
_PARTS = "key long, rh long, doc_id long, t long, pos int, lo int, hi int"
PARTS = 8


def _keyed(docs: DataFrame) -> DataFrame:
    """t tells rows of one doc_id apart by their texts; it is 0 throughout where every doc_id is there and alone."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 OR doc_id IS NULL")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (F.lit(0).cast("long") if again.isEmpty() else F.xxhash64(text)).alias("t"))


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every window of w values, by doubling."""
    size = 1
    while 2 * size <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchor_positions(raw: bytes, least: int, k: int) -> np.ndarray:
    """Where the winnowed k-grams of a text start: each window of ``least`` bytes holds one, by its content alone."""
    if len(raw) < least:
        return np.zeros(0, np.int64)
    h = textkit._TABLE[np.frombuffer(raw, np.uint8)]
    size = 1
    while size < k:
        h = h[:-size] * textkit._STEP[size.bit_length()] + h[size:]
        h ^= h >> textkit.U(29)
        size *= 2
    w = least - k + 1
    low = _sliding(h, w, np.minimum)
    high = _sliding(np.concatenate((np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64))), w, np.maximum)
    return np.flatnonzero(high == h)


def _anchors(least: int, k: int):
    reach = least - k

    def run(it):
        digest = xxhash.xxh3_64_intdigest
        for whole in it:
            for b in slices(whole, "text"):
                ah, ch, ids, ts, at, sizes = [], [], [], [], [], []
                for doc_id, t, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "t", "text"))):
                    raw = text.encode("utf-8", "surrogatepass")
                    p = anchor_positions(raw, least, k)
                    if not len(p):
                        continue
                    lo, hi = np.maximum(p - reach, 0), np.minimum(p + least, len(raw))
                    ps, ls, hs = p.tolist(), lo.tolist(), hi.tolist()
                    ah += [digest(raw[x : x + k]) for x in ps]
                    ch += [digest(raw[x:y], z - x) for x, y, z in zip(ls, hs, ps)]
                    ids += [doc_id] * len(ps)
                    ts += [t] * len(ps)
                    at += ps
                    sizes += [len(raw)] * len(ps)
                u = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
                i = lambda v: pa.array(np.array(v, np.int32))
                yield pa.RecordBatch.from_arrays([u(ah), u(ch), pa.array(ids, pa.int64()), pa.array(ts, pa.int64()), i(at), i(sizes)], [x.split()[0] for x in _ANCHORS.split(", ")])

    return run


def _ranges(pos: int, n: int, least: int, k: int):
    """The windows around an anchor in PARTS ranges of starts: (part, first, last, key's bounds), clipped to the text.

    All windows of a range hold its key, whatever is clipped; what they cover together is its region.
    """
    reach = least - k
    width = reach // PARTS + 1
    for i in range(PARTS):
        low, high = pos - min(width * (i + 1) - 1, reach), pos - width * i
        first, last = max(low, 0), min(high, n - least)
        if first <= last:
            yield i, first, last, high, low + least


def _contexts(least: int):
    """Texts with the anchors wanted of them -> (doc_id, t, pos, lo, size, ctx)."""

    def run(it):
        for whole in it:
            for b in slices(whole, "text"):
                cols = [[] for _ in range(6)]
                for doc_id, t, text, want in zip(*(b.column(c).to_pylist() for c in ("doc_id", "t", "text", "want"))):
                    raw = text.encode("utf-8", "surrogatepass")
                    for x in want:
                        for c, v in zip(cols, (doc_id, t, x["pos"], x["lo"], len(raw), raw[x["lo"] : x["hi"]])):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, _CONTEXT_TYPES)], [x.split()[0] for x in _CONTEXTS.split(", ")])

    return run


def _parts(least: int, k: int):
    """Contexts -> their ranges: (key, rh, doc_id, t, pos, lo, hi), rh the hash of the region [lo, hi)."""

    def run(it):
        digest = xxhash.xxh3_64_intdigest
        for b in it:
            cols = [[] for _ in range(7)]
            for doc_id, t, pos, lo, size, ctx in zip(*(b.column(c).to_pylist() for c in ("doc_id", "t", "pos", "lo", "size", "ctx"))):
                for i, first, last, x, y in _ranges(pos, size, least, k):
                    key, rh = digest(ctx[x - lo : y - lo], i), digest(ctx[first - lo : last + least - lo], pos - first)
                    for c, v in zip(cols, (key, rh, doc_id, t, pos, first, last + least)):
                        c.append(v)
            u = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([u(cols[0]), u(cols[1]), *(pa.array(c, x) for c, x in zip(cols[2:], kinds))], [x.split()[0] for x in _PARTS.split(", ")])

    return run


def maximal_repeats(texts: list[bytes], place: list[tuple], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of ``least`` bytes or more: (length, texts, starts), one start for each text of all occurrences.

    ``place`` gives each text's (document, offset): suffixes at one place of one document are one occurrence. The interval
    tree comes from a stack scan over the sorted suffixes' common prefixes; an interval is reported if it has two places
    and its left neighbours differ (a text's first byte has a neighbour of its own). Shorter suffixes than ``least`` are left out.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.maximum(size - least + 1, 0)
    owner = np.repeat(np.arange(len(texts)), starts)
    if len(owner) < 2:
        return
    first = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    wide = int(size.max())
    flat = np.frombuffer(b"".join(texts) + bytes(wide), np.uint8)
    begin, long = (np.cumsum(size) - size)[owner] + first, size[owner] - first
    short = np.argsort(long, kind="stable")  # a suffix comes before those that it begins
    begin, long, owner, first = begin[short], long[short], owner[short], first[short]
    rows = np.lib.stride_tricks.sliding_window_view(flat, wide)[begin]
    for a in range(0, len(rows), 32768):  # and ends with its own text
        rows[a : a + 32768][np.arange(wide) >= long[a : a + 32768, None]] = 0
    order = np.argsort(rows.view(f"S{wide}").ravel(), kind="stable")
    begin, long, owner, first = begin[order], long[order], owner[order], first[order]
    lcp = np.zeros(len(order) + 1, np.int64)
    for a in range(1, len(order), 32768):
        z = min(len(order), a + 32768)
        here = rows[order[a - 1 : z]]
        differ = here[1:] != here[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        lcp[a:z] = np.minimum(same, np.minimum(long[a:z], long[a - 1 : z - 1]))
    del rows
    docs: dict = {}
    spot = np.array([docs.setdefault(p[0], len(docs)) for p in place])[owner] * (1 << 40) + np.array([p[1] for p in place])[owner] + first
    left = np.where(first > 0, flat[begin - 1].astype(np.int64), -1 - np.arange(len(begin)))
    linked = np.concatenate(([False], lcp >= least, [False]))
    edges = np.flatnonzero(linked[1:] != linked[:-1])
    depths = lcp.tolist()
    for a, z in zip(edges[::2].tolist(), edges[1::2].tolist()):
        # suffixes a-1 .. z-1 share least bytes; the intervals come from a stack of (depth, first suffix)
        stack = [(depths[a], a - 1)]
        for j in range(a + 1, z + 1):
            d = depths[j] if j < z else 0
            at = j - 1
            while stack and stack[-1][0] > d:
                depth, at = stack.pop()
                s, l = spot[at:j], left[at:j]
                if (l[0] < 0 or l[0] != l[-1] or (l != l[0]).any()) and (s != s[0]).any():
                    yield depth, owner[at:j], first[at:j]
            if d >= least and (not stack or stack[-1][0] < d):
                stack.append((d, at))


def _repeats(least: int, suffixes: int):
    """Regions sorted by key -> the spans that maximal repeats cover, merged for each region.

    Whole groups are gathered until they have ``suffixes`` suffixes; matches between groups are repeats like others.
    """

    def spans(held):
        texts = [x[3] for x in held]
        found = [(o, f, f + depth) for depth, o, f in maximal_repeats(texts, [((x[0], x[1]), x[2]) for x in held], least)]
        if not found:
            return None
        o, lo, hi = (np.concatenate(x) for x in zip(*found))
        o, lo, hi = union(o, lo, hi)
        at = np.fromiter((x[2] for x in held), np.int64, len(held))[o]
        ids, ts = pa.array([x[0] for x in held], pa.int64()).take(pa.array(o)), pa.array([x[1] for x in held], pa.int64()).take(pa.array(o))
        return pa.RecordBatch.from_arrays([ids, ts, pa.array((lo + at).astype(np.int32)), pa.array((hi + at).astype(np.int32))], ["doc_id", "t", "lo", "hi"])

    def run(it):
        held, key, many = [], None, 0
        for b in it:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "t", "lo", "region"))):
                if row[0] != key:
                    key = row[0]
                    if many > suffixes:
                        if (out := spans(held)) is not None:
                            yield out
                        held, many = [], 0
                held.append(row[1:])
                many += len(row[4]) - least + 1
        if held and (out := spans(held)) is not None:
            yield out

    return run


def _groups(least: int, suffixes: int):
    """Regions sorted by key -> maximal repeats: (repeat, length, key, rh, at), at the place in the region, for all occurrences."""
    names = ["repeat", "length", "key", "rh", "at"]

    def groups(held):
        texts = [x[5] for x in held]
        cols = [[] for _ in names]
        for depth, owner, first in maximal_repeats(texts, [((x[2], x[3]), x[4]) for x in held], least):
            o, f = owner.tolist(), first.tolist()
            repeat = xxhash.xxh3_64_intdigest(texts[o[0]][f[0] : f[0] + depth])
            for c, v in zip(cols, ([repeat] * len(o), [depth] * len(o), [held[i][0] for i in o], [held[i][1] for i in o], f)):
                c += v
        signed = pa.array(np.array(cols[0], np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([signed, *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int32())))], names)

    def run(it):
        held, key, many = [], None, 0
        for b in it:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "rh", "doc_id", "t", "lo", "region"))):
                if row[0] != key:
                    key = row[0]
                    if many > suffixes:
                        yield groups(held)
                        held, many = [], 0
                held.append(row)
                many += len(row[5]) - least + 1
        if held:
            yield groups(held)

    return run


def union(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of several owners, sorted, those of one owner that overlap or touch made one."""
    order = np.lexsort((hi, lo, owner))
    owner, lo, hi = owner[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    step = int(hi.max()) + 2 if len(hi) else 1
    rank = np.cumsum(np.concatenate(([0], owner[1:] != owner[:-1]))) if len(owner) else owner
    reach = np.maximum.accumulate(rank * step + hi)
    new = np.ones(len(lo), bool)
    new[1:] = (rank * step + lo)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(lo)) - 1
    return owner[at], lo[at], (reach - rank * step)[last] if len(at) else hi


_WINDOWS = "w1 long, w2 long, doc_id long, t long, lo int"


def _windows(least: int, groups: bool):
    """Regions -> their windows by hash; for groups also where in which region they are."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()) + ((pa.int64(), pa.int64(), pa.int32()) if groups else ())
    names = [x.split()[0] for x in _WINDOWS.split(", ")] + (["key", "rh", "at"] if groups else [])

    def run(it):
        digest = xxhash.xxh3_128_intdigest
        for b in it:
            cols = [[] for _ in kinds]
            rows = [b.column(c).to_pylist() for c in ("doc_id", "t", "lo", "region", *(("key", "rh") if groups else ()))]
            for doc_id, t, lo, region, *of in zip(*rows):
                for s in range(len(region) - least + 1):
                    h = digest(region[s : s + least])
                    for c, v in zip(cols, ((h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), doc_id, t, lo + s, *of, s)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds)], names)

    return run


def _by_text(spans: DataFrame) -> DataFrame:
    pair = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))
    return spans.groupBy("doc_id", "t").agg(F.collect_list(pair).alias("spans"))


def repeat_groups(spark: SparkSession, docs: DataFrame, least: int = 200, k: int = 64, group: int = 20_000, suffixes: int = 60_000) -> DataFrame:
    """Groups of equal passages with all their occurrences: repeat (a hash of the passage or of its class), length, doc_id, t, start.

    Passages are those of ``repeated_spans``, in bytes, maximal within a context of 2 * ``least`` - ``k`` bytes around an anchor: one
    cannot be longer there with the same occurrences. A longer passage comes as a chain of groups of the same documents whose places go on.
    Together the groups cover just the bytes that ``repeated_spans`` does.
    """
    ws = Workspace(spark, "groups", "zstd")
    return ws.finish(_search(spark, docs, least, k, group, suffixes, ws, True))


def repeated_spans(spark: SparkSession, docs: DataFrame, least: int = 200, k: int = 64, group: int = 20_000, suffixes: int = 60_000, ws: Workspace | None = None) -> DataFrame:
    """For each text with repeats: doc_id, t, spans (each lo * 2**32 + hi, as they come), of UTF-8 bytes.

    The spans cover just the bytes of every ``least``-byte string that starts at two places or more, in one document or several.

    t is xxhash64 of the text; rows that agree in doc_id and text are copies of each other and have the same spans. Null text
    is empty; a null doc_id is an id like others. Texts under ``least`` bytes have no spans. k must be a power of two.
    """
    return _search(spark, docs, least, k, group, suffixes, ws or Workspace(spark, "suffix", "zstd"), False)


def _search(spark: SparkSession, docs: DataFrame, least: int, k: int, group: int, suffixes: int, ws: Workspace, groups: bool) -> DataFrame:
    text = _keyed(docs)
    anchors = ws.save(text.mapInArrow(_anchors(least, k), _ANCHORS), "anchors")
    again = anchors.groupBy("ah").agg(F.count(F.lit(1)).alias("c"), F.min("ch").alias("x"), F.max("ch").alias("y")).where("c > 1").select("ah", "c", (F.col("x") == F.col("y")).alias("single"))
    total = anchors.count()
    found = ws.save(counted_join(anchors, ws.save(again, "again"), ["ah"], total), "found")
    ws.drop("anchors", "again")
    ws.release()
    some = lambda *names: [F.first(c).alias(c) for c in names]  # noqa: E731  all of one row
    several = found.where("NOT single")
    kinds = ws.save(several.groupBy("ah", "ch").agg(F.count(F.lit(1)).alias("c"), *some("doc_id", "t", "pos", "size")), "kinds")
    alike = counted_join(several, kinds.where("c > 1").select("ah", "ch", "c"), ["ah", "ch"], total)
    lo, hi = F.greatest(F.col("pos") - (least - k), F.lit(0)).alias("lo"), F.least(F.col("pos") + least, F.col("size")).alias("hi")
    known = [F.xxhash64("ah", "ch").alias("repeat")] if groups else []
    direct = found.where("single").unionByName(alike).select(*known, "doc_id", "t", lo, hi).where(F.col("hi") - F.col("lo") >= least)
    want = kinds.groupBy("doc_id", "t").agg(F.collect_list(F.struct("pos", lo, hi)).alias("want"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.t") == F.col("b.t"))
    texts = text.alias("a").join(want.alias("b"), same).select("a.doc_id", "a.t", "a.text", "b.want")
    contexts = ws.save(texts.mapInArrow(_contexts(least), _CONTEXTS), "contexts")
    ws.release()
    # ranges of windows in these contexts: equal regions cover all of theirs, only what differs under one key goes on
    parts = ws.save(contexts.mapInArrow(_parts(least, k), _PARTS), "parts")
    regions = ws.save(parts.groupBy("key", "rh").agg(F.count(F.lit(1)).alias("c"), *some("doc_id", "t", "pos", "lo", "hi")), "regions")
    ws.release()
    known = [F.xxhash64("key", "rh").alias("repeat")] if groups else []
    direct = direct.unionByName(counted_join(parts, regions.where("c > 1").select("key", "rh", "c"), ["key", "rh"], parts.count()).select(*known, "doc_id", "t", "lo", "hi"))
    direct = ws.save(direct if groups else _by_text(direct), "direct")
    ws.drop("found", "kinds", *(() if groups else ("parts",)))
    ws.release()
    size = regions.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    left = regions.drop("c").join(size.hint("shuffle_hash"), "key").alias("a")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.pos") == F.col("b.pos"))
    cut = F.expr("substring(b.ctx, a.lo - b.lo + 1, a.hi - a.lo)")
    left = ws.save(left.join(contexts.alias("b"), same).select("key", "c", *(["rh"] if groups else []), "a.doc_id", "a.t", "a.lo", cut.alias("region")), "left")
    ws.drop("contexts", "regions")
    ws.release()
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    usual = left.where(F.col("c") <= group).drop("c").repartition(count, "key").sortWithinPartitions("key")
    if groups:
        maximal = ws.save(usual.mapInArrow(_groups(least, suffixes), "repeat long, length int, key long, rh long, at int"), "maximal")
        places = maximal.join(parts.drop("pos", "hi"), ["key", "rh"]).select("repeat", "length", "doc_id", "t", (F.col("lo") + F.col("at")).alias("start"))
        places = places.unionByName(direct.select("repeat", (F.col("hi") - F.col("lo")).alias("length"), "doc_id", "t", F.col("lo").alias("start")))
    else:
        spans = usual.mapInArrow(_repeats(least, suffixes), _SPANS)
    large = left.where(F.col("c") > group).drop("c")
    if not large.isEmpty():
        windows = ws.save(large.mapInArrow(_windows(least, groups), _WINDOWS + (", key long, rh long, at int" if groups else "")), "windows")
        place = F.struct("doc_id", "t", "lo")
        ends = windows.groupBy("w1", "w2").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count(F.lit(1)).alias("c")).where("x <> y").select("w1", "w2", "c")
        several = counted_join(windows, ws.save(ends, "ends"), ["w1", "w2"], windows.count())
        if groups:
            same = several.join(parts.select("key", "rh", "doc_id", "t", "lo").withColumnsRenamed({"doc_id": "d", "t": "u", "lo": "l"}), ["key", "rh"])
            places = places.unionByName(same.select(F.xxhash64("w1", "w2").alias("repeat"), F.lit(least).alias("length"), F.col("d").alias("doc_id"), F.col("u").alias("t"), (F.col("l") + F.col("at")).alias("start")))
        else:
            spans = spans.unionByName(several.select("doc_id", "t", "lo", (F.col("lo") + least).alias("hi")))
    if groups:
        return places.distinct()
    spans = ws.save(_by_text(spans).unionByName(direct).groupBy("doc_id", "t").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    ws.drop("direct", "left", "windows", "ends")
    ws.release()
    return spans


def without_repeats(spark: SparkSession, docs: DataFrame, least: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row: its bytes without those that repeated strings cover.

    A row's n_spans counts maximal removed runs; kept_sha256 is that of the other bytes put together. Null text is empty.
    """
    ws = Workspace(spark, "suffix", "zstd")
    each = repeated_spans(spark, docs, least, ws=ws)
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.t") == F.col("b.t"))
    both = _keyed(docs).alias("a").join(each.alias("b"), same, "left").select("a.doc_id", "a.text", "b.spans")

    def run(it):
        for whole in it:
            for b in slices(whole, "text"):
                cols = [[], [], [], []]
                for text, spans in zip(b.column("text"), b.column("spans")):
                    raw = text.as_buffer().to_pybytes()
                    kept, at, gone, n = hashlib.sha256(), 0, 0, 0
                    if spans.is_valid:
                        v = spans.values.to_numpy()
                        _, los, his = union(np.zeros(len(v), np.int64), v >> 32, v & 0xFFFFFFFF)
                        n, gone = len(los), int((his - los).sum())
                        for lo, hi in zip(los.tolist(), his.tolist()):
                            kept.update(raw[at:lo])
                            at = hi
                    kept.update(raw[at:])
                    for c, v in zip(cols, (len(raw), gone, n, kept.hexdigest())):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return ws.finish(both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
