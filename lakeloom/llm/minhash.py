"""Near-duplicate documents: tensored MinHash banding, links verified on whole shingle sets.

A document has ``collections`` small collections of ``width`` minhashes each. A table's key joins two of them, so
m collections give m(m-1)/2 tables of keys of 2*width hashes: 24 minhashes do the work of 264. Two documents
meet if any two collections agree.

Skew: equal sets are one class before any key is made. In a bucket of any size every member meets one centre; members that
turn out to be linked fall together and only those outside a bucket's largest component are compared further, with
members of other components. So each pair of a bucket is either compared or already known to be connected,
and no bucket is expanded into all its pairs while it holds together.

Equal sets and links are told on 128-bit hashes of the shingles (two lanes of 64 bits, both of which must agree).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import textkit
from lakeloom.llm.common import Workspace, components, counted_join, long_list, slices
from lakeloom.llm.common import near as near_ids

_SIGNS = "doc_id long, n long, s1 long, s2 long, keys array<long>"


def _sets(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]
    return textkit.shingles(*textkit.word_hashes(texts), words)


def signatures(docs: DataFrame, words: int, collections: int, width: int) -> DataFrame:
    """doc_id, n (set size), s1, s2 (128-bit digest of the set), keys (one for each collection)."""

    def run(it):
        hashes = textkit.MinHash(collections * width)
        for whole in it:
            for b in slices(whole, "text"):
                sets = _sets(b, words)
                m = hashes([x[0] for x in sets]).reshape(len(sets), collections, width)
                key = np.zeros((len(sets), collections), np.uint64)
                for j in range(width):
                    key = textkit.mix(key * textkit.U(3) + m[:, :, j])
                n = np.array([x.shape[1] for x in sets], np.int64)
                s1, s2 = textkit.set_digest(sets)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n), pa.array(s1), pa.array(s2), long_list(key.ravel(), np.where(np.ones(len(n)), collections, 0))],
                    ["doc_id", "n", "s1", "s2", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SIGNS)


def _set_table(docs: DataFrame, words: int) -> DataFrame:
    def run(it):
        for whole in it:
            for b in slices(whole, "text"):
                sets = _sets(b, words)
                n = np.array([x.shape[1] for x in sets], np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(long_list(np.concatenate([x[lane] for x in sets]), n) for lane in (0, 1))], ["doc_id", "set", "also"])

    return docs.mapInArrow(run, "doc_id long, set array<long>, also array<long>")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, collections: int = 12, width: int = 2, rounds: int = 3, small: int = 32, block: int = 200_000, most_ids: int = 1_000_000
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Linked: 100 * intersection >= ``percent`` * union of the sets of distinct ``words``-word shingles of the
    lower-cased (A-Z) text; words are runs of other than [\\x20\\x09-\\x0D]. With fewer words the whole sequence
    is the one shingle; without words the set is empty and linked with nothing. component_id is the smallest doc_id
    reachable, kept says whether that is the document itself.

    Null text is empty text. A null doc_id has n_shingles, a null component and is kept. Repeated rows of one doc_id
    give a row each with the same component. Other columns are ignored; an empty table gives an empty result.

    ``small``, ``rounds`` and ``block`` change the order of work, not the result. Texts stay where they are while the ids of
    those to be compared are at most ``most_ids``, which are then broadcast; beyond that they are shuffled once.
    """
    ws = Workspace(spark, "minhash")
    signs = ws.save(signatures(docs, words, collections, width), "signs")
    # equal sets: one class, with the smallest doc_id for its name
    full = signs.where("n > 0 AND doc_id IS NOT NULL")
    reps = full.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "keys")).alias("r"), F.count(F.lit(1)).alias("c")).select("s1", "s2", "n", F.col("r.doc_id").alias("rep"), "r.keys", "c")
    reps = ws.save(reps, "reps")
    each = reps.select("rep", "n", F.posexplode("keys").alias("i", "k"))
    again = each.groupBy("i", "k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("i", "k")
    shared = each.join(again, ["i", "k"], "left_semi").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("i", "k"))).alias("ks"))
    tables = "flatten(transform(ks, x -> transform(filter(ks, y -> y.i > x.i), y -> xxhash64(x.i, y.i, x.k, y.k))))"
    member = shared.where("size(ks) > 1").select("rep", "n", F.explode(F.expr(tables)).alias("bucket"))
    member = ws.save(member, "member0")
    many = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    member = ws.save(member.join(many, "bucket", "left_semi"), "member")
    ws.drop("member0")
    wanted = member.select(F.col("rep").alias("doc_id")).distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = text.join(near_ids(wanted, most_ids), "doc_id", "left_semi")
    sets = _set_table(text, words)
    sets = ws.save(sets.dropDuplicates(["doc_id"]) if _repeats(signs) else sets, "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """pairs (a, na, b, nb): those linked, as (a, b)."""
        x = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa"), F.col("also").alias("ta"))
        y = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb"), F.col("also").alias("tb"))
        both = F.least(F.size(F.array_intersect("sa", "sb")), F.size(F.array_intersect("ta", "tb")))
        links = pairs.join(x, "a").join(y, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")
        return ws.save(links, name)

    near = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def tidy(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where(near)
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr("if(a < b, na, nb)").alias("na"), F.expr("if(a < b, nb, na)").alias("nb")).distinct()

    # buckets of a few members: every pair; larger ones: every member with one centre
    sized = member.join(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")), "bucket")
    few = sized.where(F.col("c") <= small).drop("c")
    x = few.select("bucket", F.col("rep").alias("a"), F.col("n").alias("na"))
    y = few.select("bucket", F.col("rep").alias("b"), F.col("n").alias("nb"))
    pairs = tidy(x.join(y, "bucket").where("a < b"))
    big = ws.save(sized.where(F.col("c") > small).select("bucket", "rep", "n", F.col("rep").alias("comp")), "big0")
    links, label, work = None, None, big.count()
    for k in range(rounds):
        # a centre in every bucket that is not yet of one component: first by a hash of all, then from outside the largest
        open_ = big.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), "rep", "n")).alias("r"))
        open_ = open_.groupBy("bucket").agg(F.max(F.struct("c", "comp", "r")).alias("top"), F.min(F.struct("c", "r.h", "comp", "r")).alias("low"), F.sum("c").alias("total"), F.count(F.lit(1)).alias("comps"))
        centre = open_.where("comps > 1").select("bucket", F.col("low.r.rep").alias("a"), F.col("low.r.n").alias("na"), F.col("low.comp").alias("ca"))
        star = big.select("bucket", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb")).join(centre, "bucket").where("ca <> cb")
        star = tidy(star.select("a", "b", "na", "nb"))
        links_k = verified(ws.save(pairs.unionByName(star).distinct() if k == 0 else star, f"pairs{k}"), f"links{k}")
        links = links_k if links is None else links.unionByName(links_k)
        label = ws.save(components(ws, links, f"cc{k}_"), f"label{k}")
        big, was = _still_open(ws, big, label, f"big{k + 1}"), work
        work = big.count()
        if not work or 2 * work > was:
            break
    if work:
        # what is left: buckets of several components; their members, in blocks, against each other
        nodes = big.select("rep", "n", "comp").distinct()
        group = components(ws, big.groupBy("bucket").agg(F.min("rep").alias("a")).join(big, "bucket").select("a", F.col("rep").alias("b")).distinct(), "grp")
        nodes = nodes.join(group, nodes.rep == group.node).select("rep", "n", "comp", F.col("component").alias("grp"))
        nodes = nodes.join(nodes.groupBy("grp").agg(F.ceil(F.sum("n") / block).cast("int").alias("nb")), "grp")
        nodes = nodes.join(reps.select("rep", "keys"), "rep").join(sets.select(F.col("doc_id").alias("rep"), "set", "also"), "rep")
        mine = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
        each = nodes.withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        each = each.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "comp", "keys", "set", "also")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        each = each.repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
        links = links.unionByName(ws.save(each.mapInArrow(_blocks(percent), "a long, b long"), "blocklinks"))
        label = ws.save(components(ws, links, "last_"), "label")
    ws.drop("sets", "member")
    comp = reps.select("s1", "s2", "n", "rep", "c")
    if label is not None:
        comp = comp.join(label, comp.rep == label.node, "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("rep"), "c")
    out = counted_join(full.select("doc_id", "n", "s1", "s2"), comp, ["s1", "s2", "n"], full.count()).select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))
    alone = signs.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = out.unionByName(alone)
    return ws.finish(out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))))


def _still_open(ws: Workspace, big: DataFrame, label: DataFrame, name: str) -> DataFrame:
    """``big`` with components from ``label``, without the buckets that are of one component by now."""
    new = big.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    new = ws.save(new, f"{name}all")
    several = new.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
    return ws.save(new.join(several, "bucket", "left_semi"), name)


def _blocks(percent: int):
    """Rows sorted by (grp, i, j): members of two blocks of a group. Yields links that join components, a spanning few.

    A pair is looked at if two of its collections agree and its components differ. Sets become rows of bits over the
    shingles that the block's members share.
    """

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        i, j = rows[0][1], rows[0][2]
        left = [r for r in rows if r[3] == i]
        right = left if i == j else [r for r in rows if r[3] == j]
        if not left or not right:
            return []
        both = left if i == j else left + right
        full = np.concatenate([np.asarray(r[8]) for r in both])
        values, number, count = np.unique(full, return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        size = np.fromiter((len(r[8]) for r in both), np.int64, len(both))
        owner = np.repeat(np.arange(len(both)), size)
        use = count[number] > 1
        bits = np.zeros((len(both), int((count > 1).sum()) // 64 + 1), np.uint64)
        col = column[number[use]]
        np.bitwise_or.at(bits, (owner[use], col // 64), np.uint64(1) << (col % 64).astype(np.uint64))
        keys = np.array([r[7] for r in both], np.int64)
        n, comp = np.array([r[5] for r in both]), np.array([r[6] for r in both])
        at = 0 if i == j else len(left)
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x in range(len(left)):
            lo = x + 1 if i == j else at
            same = (keys[lo:] == keys[x]).sum(axis=1)
            fits = (same >= 2) & (comp[lo:] != comp[x]) & (100 * np.minimum(n[lo:], n[x]) >= percent * np.maximum(n[lo:], n[x]))
            ys = np.flatnonzero(fits) + lo
            if not len(ys):
                continue
            shared = np.bitwise_count(bits[ys] & bits[x]).sum(axis=1, dtype=np.int64)
            for y in ys[100 * shared >= percent * (n[ys] + n[x] - shared)].tolist():
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q and 100 * (also := len(np.intersect1d(both[x][9], both[y][9]))) >= percent * (n[x] + n[y] - also):
                    parent[p] = q
                    out.append((both[x][4], both[y][4]))
        return out

    def run(it):
        held, key = [], None
        for b in it:
            names = ("grp", "i", "j", "own", "rep", "n", "comp")
            plain = [b.column(c).to_pylist() for c in names]
            lists = [b.column(c) for c in ("keys", "set", "also")]
            for r, row in enumerate(zip(*plain)):
                if row[:3] != key:
                    if held:
                        yield _edges(links(held))
                    held, key = [], row[:3]
                held.append((*row, *(x[r].values.to_numpy() for x in lists)))
        if held:
            yield _edges(links(held))

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])


def _repeats(signs: DataFrame) -> bool:
    return not signs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
