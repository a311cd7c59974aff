"""Benchmark decontamination: size-partitioned MinHash containment search, verified on whole shingle sets.

The shingle of an item that is smallest in a random order is in a text with a chance equal to the part of the item that the text
contains, however long the text is (containment MinHash). So an item's signature is those smallest shingles themselves, and a text is
asked whether it has them. Items are partitioned by size; a partition has bands of as many minhashes as tell its
items from chance company (one for few shingles, more for many), and so many bands that a text with the threshold's share of an item
shows no whole band with a chance of ``MISS`` at most. A text with a whole band is a candidate, verified by exact containment.

The items go to the workers in blocks of bounded size, one pass over the texts for each block; texts never move.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import textkit
from lakeloom.llm.common import Workspace, long_list, slices

_FOUND = "doc_id long, item_id long, n_item long, n_shared long"
MISS = 1e-12


def _bytes(texts: list) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in texts]


def _item_sets(items: DataFrame, words: int) -> DataFrame:
    def run(it):
        for whole in it:
            for b in slices(whole, "text"):
                sets = textkit.shingles(*textkit.word_hashes(_bytes(b.column("text").to_pylist()), plain=True), words)
                n = np.array([x.shape[1] for x in sets], np.int64)
                lanes = [long_list(np.concatenate([x[lane] for x in sets]), n) for lane in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(n), *lanes], ["item_id", "n", "set", "also"])

    return items.mapInArrow(run, "item_id long, n long, set array<long>, also array<long>")


def banding(size: int, percent: int) -> tuple[int, int]:
    """(bands, minhashes in a band) of the partition that items of ``size`` shingles belong to."""
    rows = min(3, 1 + size.bit_length() // 4)  # 1 to 7 shingles: one; 8 to 127: two; more: three
    share = percent / 100
    return (1 if percent >= 100 else max(1, math.ceil(math.log(MISS) / math.log1p(-(share**rows)))), rows) if percent else (1, 0)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """The shingles that are smallest in each of ``n`` random orders."""
    rng = np.random.default_rng(19)
    out = np.empty(n, np.uint64)
    for j, (a, b) in enumerate(zip(rng.integers(1, 2**64 - 1, n, dtype=np.uint64) | textkit.U(1), rng.integers(0, 2**64 - 1, n, dtype=np.uint64))):
        out[j] = shingles[textkit.mix(shingles * a + b).argmin()]
    return out


class Index:
    """Signatures and whole sets (two lanes of hashes) of a block of items."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], percent: int):
        self.ids, self.sets, self.percent = [i for i, _ in rows], [s for _, s in rows], percent
        value, band, item, need = [], [], [], []
        for j, s in enumerate(self.sets):
            many, wide = banding(s.shape[1], percent)
            bands = np.unique(np.sort(signature(s[0], many * wide).reshape(many, wide), axis=1), axis=0)
            new = np.ones(bands.shape, bool)
            new[:, 1:] = bands[:, 1:] != bands[:, :-1]
            value.append(bands[new])
            band.append(len(need) + np.nonzero(new)[0])
            need += new.sum(axis=1).tolist()
            item += [j] * len(bands)
        value, band = np.concatenate(value), np.concatenate(band)
        by = np.argsort(value, kind="stable")
        self.value, self.start = np.unique(value[by], return_index=True)
        self.start = np.append(self.start, len(by))
        self.band, self.item, self.need = band[by], np.array(item), np.array(need)

    def candidates(self, full: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """(text, item) of texts that have a whole band of the item, sorted. full: first lane of many texts' shingles, owner: their texts."""
        at = np.minimum(np.searchsorted(self.value, full), len(self.value) - 1)
        hit = self.value[at] == full
        text, v = np.divmod(np.unique(owner[hit] * len(self.value) + at[hit]), len(self.value))
        size = self.start[v + 1] - self.start[v]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[v], size)
        seen, count = np.unique(np.repeat(text, size) * len(self.need) + self.band[place], return_counts=True)
        text, band = np.divmod(seen, len(self.need))
        whole = count == self.need[band]
        return np.stack(np.divmod(np.unique(text[whole] * len(self.ids) + self.item[band[whole]]), len(self.ids)), axis=1)

    def search(self, full: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item_id, item's shingles, shared) of many texts' shingles (two lanes), owner the text of each (ascending)."""
        out, last, own = [], -1, None
        for text, item in self.candidates(full[0], owner).tolist():
            if text != last:
                last, own = text, textkit.distinct(full[:, np.searchsorted(owner, text) : np.searchsorted(owner, text + 1)])
            size, both = self.sets[item].shape[1], textkit.shared(own, self.sets[item])
            if 100 * both >= self.percent * size:
                out.append((text, self.ids[item], size, both))
        return out


def _blocks(spark: SparkSession, items: DataFrame, words: int, percent: int, block_shingles: int, ws: Workspace):
    """Broadcast indexes that together hold all items with words and an id."""
    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    sets = ws.save(_item_sets(rows, words).where("n > 0"), "items")
    signed = F.when(F.col("n") < 8, F.col("n")).when(F.col("n") < 128, F.lit(math.prod(banding(8, percent)))).otherwise(F.lit(math.prod(banding(128, percent))))
    blocks = -(-int(sets.agg(F.sum(F.col("n") + signed)).first()[0] or 0) // block_shingles)
    for k in range(blocks):
        block = [(r.item_id, np.array([r.set, r.also], np.int64).view(np.uint64)) for r in sets.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toLocalIterator()]
        if block:
            yield spark.sparkContext.broadcast(Index(block, percent))
    ws.drop("items")


def _found(index, batch: pa.RecordBatch, words: int) -> list[tuple[int, int, int, int]]:
    hashes, first = textkit.word_hashes(_bytes(batch.column("text").to_pylist()), plain=True)
    return index.search(*textkit.running_shingles(hashes, first, words))


def contained_items(
    spark: SparkSession, docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, block_shingles: int = 2_000_000, ws: Workspace | None = None
) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared) where the text holds ``percent`` of the item's distinct shingles or more.

    Words are runs of ASCII letters, digits and characters outside ASCII, A-Z lower-cased; a shingle is ``words`` words, with
    fewer words the whole sequence. Items without words, or with a null item_id, match nothing; nor do texts without
    words. Null text is empty text. Rows of ``docs`` with equal ids give a pair each, a null doc_id gives pairs with null.
    An item of fewer words than a shingle matches texts that are just those words. ``block_shingles`` bounds the items'
    shingles and signatures that are broadcast at once (some 16 bytes each); the largest single item may pass it. Empty
    tables give no pairs. A pair is missed with a chance of ``MISS`` at most.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for index in _blocks(spark, items, words, percent, block_shingles, ws or Workspace(spark, "decontam")):
        pairs = text.mapInArrow(_probe(index, words), _FOUND)
        found = pairs if found is None else found.unionByName(pairs)
    return spark.createDataFrame([], _FOUND) if found is None else found


def _probe(index, words: int):
    def run(it):
        for whole in it:
            for b in slices(whole, "text"):
                ids, got = b.column("doc_id").to_pylist(), _found(index.value, b, words)
                cols = [[ids[x[0]] for x in got], *([x[c] for x in got] for c in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_item", "n_shared"])

    return run


def _without(index, words: int):
    def run(it):
        for whole in it:
            for b in slices(whole, "text"):
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in _found(index.value, b, words)]] = False
                yield b.filter(pa.array(keep))

    return run


def reject(spark: SparkSession, docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, block_shingles: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that ``contained_items`` has no pair for, with all their columns; each row by its own text, and none moves."""
    for index in _blocks(spark, items, words, percent, block_shingles, Workspace(spark, "decontam")):
        docs = docs.mapInArrow(_without(index, words), docs.schema)
    return docs
