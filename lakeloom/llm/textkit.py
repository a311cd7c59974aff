"""Words and word shingles of many texts at once, as hashes in numpy.

Each has two independent 64-bit hashes, called lanes. The first finds and orders; together they are 128 bits that tell equal from
different. A word's hash is multilinear: every place in a word has a random factor of its own, so that no regular
word (as Thue-Morse words are for the powers of one base) is like another.
"""

from __future__ import annotations

import numpy as np

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_LOWER = (_B + 32 * _UPPER).astype(np.uint8)
#: Words of plain_words(): ASCII letters and digits and all bytes outside ASCII; what else there is separates.
_ALNUM = (_B >= 128) | _UPPER | ((_B >= 97) & (_B <= 122)) | ((_B >= 48) & (_B <= 57))
_NOT_ALNUM = ~_ALNUM
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
_STEP = _rng.integers(1, 2**64 - 1, 16, dtype=np.uint64) | np.uint64(1)
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


_factors = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def factors(n: int, lane: int) -> np.ndarray:
    """Random odd factors of the first n places of a word (more, as they come); long words make more of them for the time being."""
    if len(_factors[lane]) >= n:
        return _factors[lane]
    made = mix(np.arange(max(n, 4096), dtype=np.uint64) * _BASE + _SEEDS[lane]) | U(1)
    if n <= 1 << 16:
        _factors[lane] = made
    return made


def word_hashes(texts: list[bytes], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (two lanes, words) of the words of all texts, and the index of each text's first word (one more at the end).

    Words are runs of bytes other than [\\x20\\x09-\\x0D] (``plain``: runs of ASCII letters, digits and bytes
    outside ASCII), A-Z lower-cased.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    inside = ~(_NOT_ALNUM if plain else _WS)[raw]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(starts, np.concatenate(([0], ends)))
    if not len(starts):
        return np.zeros((2, 0), np.uint64), first
    sizes = stops - starts
    at = np.flatnonzero(inside)
    begin = np.cumsum(sizes) - sizes
    value = _TABLE[_LOWER[raw[at]]]
    place = np.arange(len(at)) - np.repeat(begin, sizes)
    much, out = int(sizes.max()), np.empty((2, len(starts)), np.uint64)
    for lane in (0, 1):
        out[lane] = mix(np.add.reduceat(value * factors(much, lane)[place], begin) + sizes.astype(np.uint64) * _BASE)
    return out, first


def _chained(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes (lanes, n - k + 1) of every k words in a row."""
    n = words.shape[1]
    full = np.zeros((len(words), max(0, n - k + 1)), np.uint64)
    for j in range(k if full.size else 0):
        full = mix(full + words[:, j : n - k + 1 + j] * _STEP[j] + _STEP[j + 1])
    return full


def _short(words: np.ndarray) -> np.ndarray:
    """The hash (lanes, 1) of a sequence of fewer words than a shingle."""
    n = words.shape[1]
    return mix(_chained(words, n) + U(n))


def distinct(full: np.ndarray) -> np.ndarray:
    """The different columns of (lanes, n), sorted by their first lane."""
    full = full[:, np.argsort(full[0], kind="stable")]
    same = full[0, 1:] == full[0, :-1]
    if len(full) > 1 and (full[1, 1:] != full[1, :-1])[same].any():
        full = full[:, np.lexsort(full[::-1])]
        same = (full[:, 1:] == full[:, :-1]).all(axis=0)
    return full[:, np.concatenate(([True], ~same))] if full.shape[1] else full


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the distinct hashes (lanes, n) of its k-word shingles, sorted by the first; with fewer words, the whole as one."""
    full, out = _chained(words, k), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(distinct(full[:, a : b - k + 1]) if b - a >= k else _short(words[:, a:b]) if b > a else full[:, :0])
    return out


def running_shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles (lanes, n) of all texts in order, repeats included, and the text of each (ascending)."""
    full = _chained(words, k)
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    n = full.shape[1]
    inside = owner[:n] == owner[k - 1 : k - 1 + n]
    parts, texts = [full[:, inside]], [owner[:n][inside]]
    for t in np.flatnonzero((size > 0) & (size < k)).tolist():
        parts.append(_short(words[:, first[t] : first[t + 1]]))
        texts.append(np.array([t]))
    full, owner = np.concatenate(parts, axis=1), np.concatenate(texts)
    if len(parts) > 1:
        by = np.argsort(owner, kind="stable")
        full, owner = full[:, by], owner[by]
    return full, owner


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many columns two sets (lanes, n) have in common: as many as each lane has, the fewer of both."""
    return min(len(np.intersect1d(x, y, assume_unique=lane == 0)) for lane, (x, y) in enumerate(zip(a, b)))


def set_digest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums, one of each lane, that together identify a set of hashes; of one lane, two sums of it."""
    one = np.array([mix(s[0] + _STEP[8]).sum(dtype=np.uint64) for s in sets], np.uint64)
    two = np.array([mix(s[-1] ^ _STEP[9]).sum(dtype=np.uint64) for s in sets], np.uint64)
    return one.view(np.int64), two.view(np.int64)


class MinHash:
    """``n`` minhashes of sets of 64-bit hashes; an empty set has none (its row is meaningless)."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**64 - 1, n, dtype=np.uint64) | U(1)
        self.b = rng.integers(0, 2**64 - 1, n, dtype=np.uint64)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        out = np.zeros((len(sets), len(self.a)), np.uint64)
        if not sizes.sum():
            return out
        every = np.concatenate(sets)
        begin = (np.cumsum(sizes) - sizes)[sizes > 0]
        for j, (a, b) in enumerate(zip(self.a, self.b)):
            v = every * a + b
            v ^= v >> U(32)
            v *= a
            out[sizes > 0, j] = np.minimum.reduceat(v, begin)
        return out
