"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up the pairs
that changed by binary search over the sorted pair keys, takes the lowest rank
of every word, merges all its occurrences and closes the gaps; words without a
pair left drop out. Words seen before come from a bounded cache, so a round
only sees new ones.

Edge cases: a null or empty text has no ids and decodes to the empty text; a
text of any length is encoded whole, with some 40 bytes of working memory a byte; special tokens written out in a text take
their own id, as the tokenizer file says. Other columns are kept; the columns
that are added replace columns of those names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vicinal.llm import common

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept by a Python worker (some 130 MB).
CACHE_WORDS = 250_000
#: Marks before a key, bytes that no UTF-8 text holds.
VERBATIM, SPECIAL = b"\xff", b"\xfe"
NONE = np.iinfo(np.int32).max


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of this kind:
    printable Latin-1 bytes stand for themselves, the others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """A vocabulary file of the tokenizers library as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.byte_id = np.zeros(256, np.int64)
        for s, b in symbols.items():
            self.byte_id[b] = vocab[s]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = made
        token = {i: bytes(symbols[c] for c in s) for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.token_len = np.array([len(token.get(i, b"")) for i in range(self.size)], np.int64)
        self.token_data = np.frombuffer(b"".join(token.get(i, b"") for i in range(self.size)), np.uint8)
        self.token_start = np.cumsum(self.token_len) - self.token_len

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the count of each word."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        rank = np.full(len(sym), NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        done_word, done_sym = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[starts, len(sym)])
            low = np.minimum.reduceat(rank, starts)
            if (low == NONE).any():
                live = np.repeat(low != NONE, size)
                done_word.append(word[~live])
                done_sym.append(sym[~live])
                sym, word, rank = sym[live], word[live], rank[live]
                low, size = low[low != NONE], size[low != NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            # in a run of overlapping pairs (a a a) every second one merges
            first = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            sym, word, rank = sym[keep], word[keep], rank[keep]
            touched = np.zeros(len(sym) + 1, bool)
            touched[at] = touched[at - 1] = True
            redo = np.flatnonzero(touched[:-1])
            rank[redo] = NONE
            redo = redo[redo + 1 < len(sym)]
            redo = redo[word[redo] == word[redo + 1]]
            rank[redo] = self.ranks(sym[redo], sym[redo + 1])
        word = np.concatenate([*done_word, np.zeros(0, np.int64)])
        sym = np.concatenate([*done_sym, np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all sequences one after another, and the length of each."""
        lens = self.token_len[ids]
        data = self.token_data[common.ragged(self.token_start[ids], lens)]
        total = np.r_[0, np.cumsum(lens)]
        ends = np.cumsum(counts)
        return data, total[ends] - total[ends - counts]


class PieceCache:
    """Ids of pieces of text; ``encode`` is asked for new pieces only. Beyond
    ``limit`` pieces it starts anew, so its memory is bounded."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_WORDS):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and the count of each piece."""
        new = list(set(pieces).difference(self.index))
        if len(self.index) + len(new) > self.limit and self.index:
            self.clear()
            new = list(set(pieces))
        if new:
            flat, count = self.encode(new)
            n = len(self.index)
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
            self.flat = self._room(self.flat, self.used + len(flat))
            self.flat[self.used : self.used + len(flat)] = flat
            self.start, self.count = self._room(self.start, n + len(new)), self._room(self.count, n + len(new))
            self.count[n : n + len(new)] = count
            self.start[n : n + len(new)] = self.used + np.cumsum(count) - count
            self.used += len(flat)
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        return self.flat[common.ragged(self.start[at], self.count[at])], self.count[at]


class Encoder:
    """Splits texts into pieces at single spaces after a character that is no
    white space, where no token of the pattern can cross, and encodes them."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.pattern = regex.compile(PATTERN)
        self.cache = PieceCache(self._new)
        marks = sorted(self.table.special, key=len, reverse=True)
        self.marks = regex.compile(b"(" + b"|".join(map(regex.escape, marks)) + b")") if marks else None

    def _new(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A key is a piece after a space, or VERBATIM and a piece, or SPECIAL and a special token."""
        words: dict[bytes, int] = {}
        of, many, fixed = [], np.ones(len(keys), np.int64), {}
        for i, key in enumerate(keys):
            if key[:1] == SPECIAL:
                fixed[i] = self.table.special[key[1:]]
                of.append(words.setdefault(b"", len(words)))
                continue
            text = key[1:].decode() if key[:1] == VERBATIM else " " + key.decode()
            if text[text[:1] == " " :].isalpha():
                of.append(words.setdefault(text.encode(), len(words)))
                continue
            found = self.pattern.findall(text)
            many[i] = len(found)
            of += [words.setdefault(w.encode(), len(words)) for w in found]
        flat, count = self.table.merge(list(words))
        at = np.array(of, np.int64)
        size = count[at]
        ids = flat[common.ragged((np.cumsum(count) - count)[at], size)]
        total = np.r_[0, np.cumsum(size)]
        ends = np.cumsum(many)
        out = total[ends] - total[ends - many]
        if fixed:
            where = np.array(list(fixed))
            ids = np.insert(ids, (np.cumsum(out) - out)[where], np.array(list(fixed.values()), np.uint32))
            out[where] = 1
        return ids, out

    def _careful(self, text: bytes) -> list[bytes]:
        out = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.table.special:
                out.append(SPECIAL + part)
            elif part:
                out += [VERBATIM + w.encode() for w in self.pattern.findall(part.decode())]
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the count of each text."""
        data = b" ".join(texts)
        odd = white_before_space(np.frombuffer(data, np.uint8))
        marked = any(s in data for s in self.table.special)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(lens + 1) - 1
        doc = np.searchsorted(end, odd)
        # a space that joins two texts is not of a text
        careful = set(doc[odd < end[doc]].tolist()) | ({i for i, t in enumerate(texts) if any(s in t for s in self.table.special)} if marked else set())
        if not careful:
            flat = np.frombuffer(data, np.uint8)
            ends = ends_after_letters(flat)
            cut = np.r_[0, end[:-1] + 1, ends]
            whole = np.insert(flat, np.repeat(cut, 2), np.tile(np.frombuffer(b" " + VERBATIM, np.uint8), len(cut)))
            # the space that joins two texts and the one put before the next make an empty piece: drop the first
            pieces = whole.tobytes()[1:].replace(b"  " + VERBATIM, b" " + VERBATIM).split(b" ")
            spaces = np.r_[0, np.cumsum(flat == 32)]
            n = spaces[end] - spaces[end - lens] + 1 + np.bincount(np.searchsorted(end, ends), minlength=len(texts))
        else:
            pieces, n = [], np.zeros(len(texts), np.int64)
            for i, t in enumerate(texts):
                own = self._careful(t) if i in careful else (VERBATIM + t).split(b" ")
                pieces += own
                n[i] = len(own)
        ids, count = self.cache.ids(pieces)
        total = np.r_[0, np.cumsum(count)]
        ends = np.cumsum(n)
        return ids, total[ends] - total[ends - n]


#: Byte classes of the cut before an end mark.
_ENDS, _LETTERS, _AFTER = np.zeros((3, 256), bool)
_ENDS[list(b".,")] = True
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_AFTER[[9, 10, 11, 12, 13, 32]] = True


def ends_after_letters(data: np.ndarray) -> np.ndarray:
    """Positions of the full stops and commas between A-Z or a-z and white space
    (or the end): they are tokens of their own, so words are looked up without."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    return np.flatnonzero(_ENDS[data[1:]] & _LETTERS[data[:-1]] & np.r_[_AFTER[data[2:]], True]) + 1


def white_before_space(data: np.ndarray) -> np.ndarray:
    """Positions of the spaces that follow any white space (Unicode's)."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[1:] == 32) + 1
    p1 = data[at - 1].astype(np.int64)
    odd = (p1 == 32) | ((p1 >= 9) & (p1 <= 13)) | ((p1 >= 28) & (p1 <= 31))
    wide = np.flatnonzero(p1 >= 0x80)
    if len(wide):
        q = at[wide]
        p2 = np.where(q > 1, data[q - 2], 0).astype(np.int64)
        p3 = np.where(q > 2, data[q - 3], 0).astype(np.int64)
        code = (p3 << 16) | (p2 << 8) | p1[wide]
        two = code & 0xFFFF
        # UTF-8 of U+0085 U+00A0 U+1680 U+2000..200A U+2028 U+2029 U+202F U+205F U+3000
        odd[wide] = (two == 0xC285) | (two == 0xC2A0) | (code == 0xE19A80) | ((code >= 0xE28080) & (code <= 0xE2808A)) | (code == 0xE280A8) | (code == 0xE280A9) | (code == 0xE280AF) | (code == 0xE2819F) | (code == 0xE38080)
    return at[odd]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker; its cache serves all its tasks."""
    return Encoder(path)


def binary_array(data: np.ndarray, lens: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A binary or string array over the bytes of ``data``."""
    off = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=off[1:])
    if off[-1] >= 1 << 31:
        raise ValueError("more than 2 GiB in one piece of a batch")
    return pa.Array.from_buffers(kind, len(lens), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _extend(df: DataFrame, added: dict[str, T.DataType], fn: Callable[[pa.RecordBatch], list[pa.Array]], column: str) -> DataFrame:
    rest = [c for c in df.columns if c not in added and c != column] if column in added else [c for c in df.columns if c not in added]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(c, t) for c, t in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, column):
                cols = [piece.column(piece.schema.get_field_index(c)) for c in rest]
                yield pa.RecordBatch.from_arrays(cols + fn(piece), names=[*rest, *added])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens``."""

    def fn(piece: pa.RecordBatch) -> list[pa.Array]:
        ids, n = encoder(path).encode(common.values(piece, column))
        return [binary_array(ids.astype("<u4").view(np.uint8), n * 4, pa.binary()), pa.array(n)]

    return _extend(df, {"ids": T.BinaryType(), "n_tokens": T.LongType()}, fn, column)


def decode(df: DataFrame, path: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text of ``ids``; a sequence that breaks a character decodes to
    U+FFFD there."""

    def fn(piece: pa.RecordBatch) -> list[pa.Array]:
        raw = common.values(piece, column)
        ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
        return [_texts(*encoder(path).table.decode(ids, np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))))]

    return _extend(df, {into: T.StringType()}, fn, column)


def _texts(data: np.ndarray, lens: np.ndarray) -> pa.Array:
    try:
        out = binary_array(data, lens, pa.string())
        out.validate(full=True)
        return out
    except pa.ArrowInvalid:
        ends = np.cumsum(lens)
        return pa.array([data[e - n : e].tobytes().decode("utf-8", "replace") for e, n in zip(ends, lens, strict=True)], pa.string())


def encode_decode(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """``encode`` and ``decode`` of the ids in one pass over the rows: adds
    ``ids``, ``n_tokens`` and ``decoded``."""

    def fn(piece: pa.RecordBatch) -> list[pa.Array]:
        e = encoder(path)
        ids, n = e.encode(common.values(piece, column))
        return [binary_array(ids.astype("<u4").view(np.uint8), n * 4, pa.binary()), pa.array(n), _texts(*e.table.decode(ids.astype(np.int64), n))]

    return _extend(df, {"ids": T.BinaryType(), "n_tokens": T.LongType(), "decoded": T.StringType()}, fn, column)
