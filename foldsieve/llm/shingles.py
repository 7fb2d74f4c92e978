"""Hashes of words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

import functools

import numpy as np

SIZE = 5
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit number per byte, odd multipliers per place in a shingle."""
    rng = np.random.default_rng(20140601)
    return rng.integers(0, 2**64, 256, dtype=U), rng.integers(0, 2**64, SIZE, dtype=U) | U(1)


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, U(0x9E3779B97F4A7C15))
    out[0] = 1
    return np.cumprod(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the place of its text."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = SPACE[joined]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    first = np.zeros(len(joined), np.int32)
    first[starts] = starts
    place = np.arange(len(joined), dtype=np.int32) - np.maximum.accumulate(first)
    place[space] = 0
    longest = int(place.max()) + 1
    values = _tables()[0][joined] * _powers(1 << (longest - 1).bit_length() if longest > 1 else 1)[place]
    values[space] = 0
    hashes = mix(np.add.reduceat(values, starts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(ends, starts, "right")


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of SIZE words, and the place of its text; shorter texts are one shingle, texts without words none."""
    words, owner = word_hashes(texts)
    if not len(words):
        return words, owner
    factors = _tables()[1]
    n = len(words) - SIZE + 1
    if n > 0:
        total = words[:n] * factors[0]
        for j in range(1, SIZE):
            total += words[j : j + n] * factors[j]
        inside = owner[:n] == owner[SIZE - 1 :]
        hashes, owners = mix(total[inside]), owner[:n][inside]
    else:
        hashes, owners = words[:0], owner[:0]
    counts = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < SIZE))
    if len(short):
        begin = np.searchsorted(owner, short)
        few = []
        for s, b in zip(short, begin):
            c = counts[s]
            few.append((words[b : b + c] * factors[:c]).sum(dtype=U) + U(c))
        hashes = np.concatenate([hashes, mix(np.asarray(few, U))])
        owners = np.concatenate([owners, short])
    return hashes, owners


def multisets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text, by text: hash, place of the text, count."""
    hashes, owners = shingles(texts)
    if not len(hashes):
        return hashes, owners, np.zeros(0, np.int64)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])]))
    return hashes[new], owners[new], np.diff(np.concatenate([new, [len(hashes)]]))


def overlaps(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; 0 if neither has a shingle."""
    n = len(left)
    sides = [multisets(left), multisets(right)]
    totals = sum(np.bincount(o, weights=c, minlength=n) for _, o, c in sides)
    hashes = np.concatenate([s[0] for s in sides])
    owners = np.concatenate([s[1] for s in sides])
    counts = np.concatenate([s[2] for s in sides])
    order = np.lexsort((hashes, owners))
    hashes, owners, counts = hashes[order], owners[order], counts[order]
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owners[1:] == owners[:-1]))
    common = np.bincount(owners[same], weights=np.minimum(counts[same], counts[same + 1]), minlength=n)
    union = totals - common
    return np.divide(common, union, out=np.zeros(n), where=union > 0)


class Bags:
    """The shingle multisets of some texts, hashed once, and similarities of pairs of them."""

    #: Shingles looked at together.
    HELD = 1 << 20

    def __init__(self, texts: list[bytes]):
        self.hashes, owners, self.counts = multisets(texts)
        self.begin = np.searchsorted(owners, np.arange(len(texts)))
        self.sizes = np.searchsorted(owners, np.arange(len(texts)), "right") - self.begin
        self.totals = np.bincount(owners, weights=self.counts, minlength=len(texts))

    def _spread(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all shingles of the texts, and the number of each one's pair."""
        sizes = self.sizes[which]
        pair = np.repeat(np.arange(len(which)), sizes)
        return np.arange(len(pair)) + np.repeat(self.begin[which] - (np.cumsum(sizes) - sizes), sizes), pair

    def similarities(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of each pair of texts; 0 if neither has a shingle."""
        out, at = np.zeros(len(left)), 0
        load = np.cumsum(self.sizes[left] + self.sizes[right])
        while at < len(left):
            end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + self.HELD, "right")))
            a, b = left[at:end], right[at:end]
            (one, p), (two, q) = self._spread(a), self._spread(b)
            places, pairs = np.concatenate([one, two]), np.concatenate([p, q])
            order = np.lexsort((self.hashes[places], pairs))
            places, pairs = places[order], pairs[order]
            hashes, counts = self.hashes[places], self.counts[places]
            same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (pairs[1:] == pairs[:-1]))
            common = np.bincount(pairs[same], weights=np.minimum(counts[same], counts[same + 1]), minlength=len(a))
            union = self.totals[a] + self.totals[b] - common
            out[at:end] = np.divide(common, union, out=np.zeros(len(a)), where=union > 0)
            at = end
        return out
