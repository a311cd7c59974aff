"""Harmonic packing: token pieces in reciprocal-capacity classes, each class filling bins with a fixed count.

A document is cut into pieces of capacity/1, capacity/2, capacity/4, ... down to ``grain`` tokens; a bin of class
capacity/k takes exactly k such pieces and is full. What is left, under ``grain`` tokens, goes by its length l
into the harmonic class k = capacity // l, whose bins take k pieces and waste under ``grain`` tokens. Every worker
packs its own rows with no exchange; at its end the pieces of unfilled bins are laid in a row and cut into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import threading
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import ship, slices

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Token ids of texts (as bytes, four for each id); equal words are encoded once.

    Words between ASCII white space can be encoded apart, as the tokenizer splits there; a final full stop or comma after
    letters only is a token of its own. New words go to the tokenizer in one text, a mark between them.
    Texts of Latin letters are lower-cased first, as the tokenizer would do. ``most`` words are kept at a time.

    That holds for tokenizers with the rules of ``_RULES`` only; with any other file whole texts are encoded.
    """

    def __init__(self, path: str, most: int = 2_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_words = all(rules.get(k) == v for k, v in _RULES.items())
        #: special tokens are found before lower-casing: texts with their first characters are left as they are
        self.special = [x["content"][:2].lower() for x in rules.get("added_tokens") or ()]
        mark = self.tokenizer.encode(f"a {_MARK} a", add_special_tokens=False).ids
        self.mark = mark[1] if len(mark) == 3 and mark[0] == mark[2] else None

    def _alone(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _learn(self, new: list[str]) -> None:
        every = [w for w in new if _MARK not in w] if self.mark is not None else []
        for at in range(0, len(every), 16_384):
            plain = every[at : at + 16_384]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {_MARK} ".join(plain)], add_special_tokens=False)[0].ids, np.uint32)
            cut = [0, *(np.flatnonzero(ids == self.mark) + 1).tolist(), len(ids) + 1]
            if len(cut) == len(plain) + 1:
                raw = ids.tobytes()
                for w, a, z in zip(plain, cut, cut[1:]):
                    self.known[w] = raw[4 * a : 4 * (z - 1)]
        for w in new:
            if w not in self.known:
                self.known[w] = self._alone(w)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lists, every = [], set()
        for text in texts:
            if not _OTHER.search(text) and not any(x in text for x in self.special):
                text = text.lower()
            for c in "\t\n\x0b\x0c\r":
                text = text.replace(c, " ")
            if _RUN.search(text):
                text = _TAIL.sub(r"\1 \2", text)
            else:
                text = f"{text} ".replace(". ", " . ").replace(", ", " , ")
            words = text.split(" ")
            lists.append(words)
            every.update(words)
        known = self.known
        if len(known) + len(every) > self.most:
            known.clear()
        if new := [w for w in every if w not in known]:
            self._learn(new)
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in lists]


_MARK = "\x01"
#: The rules of a tokenizer file that words may be encoded apart with.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
_OTHER = re.compile("[^\x00-\u012f\u0131-\u024f]")
_RUN = re.compile(r"[.,](?<=[^\w ][.,]|_[.,])(?: |$)")  # a stop that is part of a longer run
_TAIL = re.compile(r"([^\W\d_])([.,])(?= |$)")
_encoders: dict[str, WordEncoder] = {}
_turn = 0


def encoder(path: str, most: int = 2_000_000) -> WordEncoder:
    """One for each worker process, so that its words serve all of the process's tasks."""
    global _turn
    _turn += 1
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].most = most
    return _encoders[path]


def rest(after: float = 5.0) -> None:
    """A task is done: if the process gets no other within some seconds, its words go, and with them their memory."""
    turn = _turn

    def forget() -> None:
        if turn == _turn:
            _encoders.clear()

    timer = threading.Timer(after, forget)
    timer.daemon = True
    timer.start()


def cuts(n: int, capacity: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full sequences, then halving classes, then the rest under ``grain``."""
    out, at, size = [], 0, capacity
    while at < n:
        if n - at >= size:
            out.append((at, size))
            at += size
        elif size > grain:
            size //= 2
        else:
            out.append((at, n - at))
            at = n
    return out


class Packer:
    """Bins of one worker. ``add`` and ``close`` return finished pieces (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int, grain: int, first_sequence: int):
        self.capacity, self.grain, self.next = capacity, grain, first_sequence
        self.open: dict[int, list[tuple]] = {}

    def _emit(self, pieces) -> list[tuple]:
        out, at = [], 0
        for doc, start, length in pieces:
            out.append((doc, start, length, self.next, at))
            at += length
        self.next += 1
        return out

    def add(self, doc: tuple) -> list[tuple]:
        out = []
        for start, length in cuts(doc[1], self.capacity, self.grain):
            k = self.capacity // length
            bin_ = self.open.setdefault(k if length < self.grain else -length, [])
            bin_.append((doc, start, length))
            if len(bin_) == k:
                out += self._emit(bin_)
                bin_.clear()
        return out

    def close(self) -> list[tuple]:
        """Pieces of unfilled bins, largest first, recut into sequences of power-of-two length."""
        left = [p for key in sorted(self.open) for p in self.open[key]]
        self.open = {}
        left.sort(key=lambda p: -p[2])
        total, sizes = sum(p[2] for p in left), []
        while total:
            size = min(self.capacity, 1 << (total.bit_length() - 1))
            sizes.append(size)
            total -= size
        out, now, room = [], [], iter(sizes)
        free = next(room, 0)
        for doc, start, length in left:
            while length:
                take = min(length, free)
                now.append((doc, start, take))
                start, length, free = start + take, length - take, free - take
                if not free:
                    out += self._emit(now)
                    now, free = [], next(room, 0)
        return out


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, grain: int = 64, words: int = 2_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of ``tokenizer`` (a path) without special tokens, then ``end_id``. ids_crc32 is that of the
    piece's ids as little-endian unsigned 32-bit numbers. A power of two is wanted for ``capacity`` and ``grain``.
    Sequences hold at most ``capacity`` ids; sequence_id is unique, its high bits the partition's number. A worker keeps the ids of
    at most ``words`` different words (some 200 bytes each) and encodes them again after that.

    Null and empty texts are the end id alone. Rows with equal or null doc_id are packed each on its own.
    Other columns are ignored; an empty table gives no rows.
    """
    ship(spark)

    def run(it):
        encode, end = encoder(tokenizer, words), np.array([end_id], np.uint32).tobytes()
        packer = Packer(capacity, grain, TaskContext.get().partitionId() << 32)

        def rows(pieces):
            cols = [[], [], [], [], [], [], []]
            for (doc_id, n, ids), start, length, sequence, at in pieces:
                crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                for c, v in zip(cols, (doc_id, start, length, crc, n, sequence, at)):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in _PIECES.split(", ")])

        for whole in it:
            for b in slices(whole, "text", 4 << 20):
                done = []
                texts = [x or "" for x in b.column("text").to_pylist()]
                for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(texts)):
                    done += packer.add((doc_id, len(ids) // 4 + 1, ids + end))
                yield rows(done)
        yield rows(packer.close())
        rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)
