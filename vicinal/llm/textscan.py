"""Words, lines and their 64-bit hashes of many texts at once, in numpy.

All texts of a piece of an Arrow batch lie in one byte array, each followed by a
line feed. A stretch of up to ``LONG`` bytes is hashed eight bytes at a time, all
stretches together: each step mixes the eight bytes into the state by a
bijection, so that no structure of a text makes two stretches meet. Longer ones
go to xxhash one by one. Two stretches with different bytes share a hash with a
chance of about 2**-64. Without a key the seed is public, and texts can be written
that share a hash; where equal hashes decide a result, a key drawn for the run
(``common.run_key``) keeps such texts from being made beforehand.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import xxhash

_RNG = np.random.default_rng(20240607)
_SEED, _SIZE = _RNG.integers(1, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of a stretch that is hashed in numpy, at most.
LONG = 64
#: What counts of the eight bytes read for the last 0 to 8 of a stretch.
_LAST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Multipliers of the words of a window.
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Byte classes.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Not in [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lowered.
BREAK = np.ones(256, bool)
BREAK[0x30:0x3A] = BREAK[0x61:0x7B] = BREAK[0x80:] = False
#: Bytes that continue a code point.
CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Scan:
    """The texts of a piece. ``lower``: A-Z are lowered for hashes and words;
    ``breaks``: the bytes that separate words; ``key``: of the hashes."""

    def __init__(self, texts: list[bytes], breaks: np.ndarray = WHITE, lower: bool = False, key: int = 0):
        self.n, self.key = len(texts), key
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
        self.data = LOWER[self.raw] if lower else self.raw
        self.breaks = breaks
        lens = np.fromiter(map(len, texts), np.int64, self.n)
        self.end = np.cumsum(lens + 1) - 1
        self.start = self.end - lens

    @cached_property
    def _eights(self) -> np.ndarray:
        """The eight bytes from each place on, one row each."""
        return np.lib.stride_tricks.sliding_window_view(np.concatenate([self.data, np.zeros(8, np.uint8)]), 8)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the stretches [start, end)."""
        size = end - start
        out = mix((size.astype(np.uint64) * _SIZE + _SEED) ^ np.uint64(self.key))
        live = np.flatnonzero((size > 0) & (size <= LONG))
        at, left = start[live], size[live]
        while len(live):
            bytes_ = self._eights[at].view("<u8").ravel() & _LAST[np.minimum(left, 8)]
            out[live] = mix(out[live] ^ bytes_)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        data, digest = memoryview(self.data), xxhash.xxh3_64_intdigest
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = digest(data[start[i] : end[i]], seed=self.key)
        return out

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each word."""
        gap = np.r_[True, self.breaks[self.data]] if len(self.data) else np.ones(1, bool)
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[::2], edge[1::2]
        return start, end, np.searchsorted(self.end, start)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        start, end, _ = self.words
        return self.hashes(start, end)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.words[2], minlength=self.n).astype(np.int64)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each line (split at line feeds)."""
        end = np.flatnonzero(self.raw == 10)
        start = np.r_[0, end[:-1] + 1] if len(end) else end
        return start, end, np.searchsorted(self.end, end)

    def count(self, table: np.ndarray) -> np.ndarray:
        """How many bytes of each text are in a class."""
        total = np.r_[0, np.cumsum(table[self.raw])]
        return (total[self.end] - total[self.start]).astype(np.int64)

    def per_doc(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights, minlength=self.n).astype(np.int64)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of ``width`` words of a text."""
        h, doc = self.word_hashes, self.words[2]
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(doc[:n] == doc[width - 1 :])
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out += h[k : k + n] * _STEP[k]
        return at, mix(out[at])

    def first_in_doc(self, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """True where a key comes first in its document (keys in text order)."""
        own = key ^ mix(doc.astype(np.uint64) + np.uint64(1))
        order = np.argsort(own, kind="stable")
        s = own[order]
        out = np.ones(len(key), bool)
        out[order[1:]] = s[1:] != s[:-1]
        return out

    def n_repeat_words(self, width: int = 5) -> np.ndarray:
        """Words inside windows found twice or more in their text."""
        at, h = self.windows(width)
        if not len(at):
            return np.zeros(self.n, np.int64)
        doc = self.words[2]
        own = h ^ mix(doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        step = np.zeros(len(doc) + 1, np.int64)
        np.add.at(step, at[twice], 1)
        np.add.at(step, at[twice] + width, -1)
        return self.per_doc(doc[np.cumsum(step)[:-1] > 0])

    def n_dup_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them equal to an earlier line."""
        start, end, doc = self.lines
        black = np.r_[0, np.cumsum(~WHITE[self.raw])]
        full = black[end] > black[start]
        start, end, doc = start[full], end[full], doc[full]
        dup = ~self.first_in_doc(self.hashes(start, end), doc)
        return self.per_doc(doc), self.per_doc(doc[dup])


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out
