"""Benchmark decontamination with an FM-index per training shard.

A shard is a piece of a task's documents: up to ``SHARD_WORDS`` words, all of
them symbols of the shard's own vocabulary, with a separator after each text
(longer texts go on in the next shard, which takes up ``WIDTH`` - 1 words again).
Its index is the suffix array's Burrows-Wheeler transform in a wavelet matrix,
built once. The windows of all test items are searched in it backwards by the
matrix's ranks, occurrences are located from sampled suffix positions, and the
covered words are merged to spans. Nothing is shuffled.

The items are cut into blocks of bounded text size, written by tasks to the
shared folder; a task holds ``HELD`` blocks at a time, so their total size is
free.

Edge cases: a null or empty text has no words; items without words have no
windows, those of fewer than ``WIDTH`` words are one window; items that repeat
an id count once, a null id is the empty string; with no items nothing is hit,
and an empty table has no rows. Rows that repeat are judged alike. A text of any
length is searched whole, with some 60 bytes of working memory a byte and the
index of one shard. Columns of the input are kept, those named like a result are
replaced.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.llm import common
from vicinal.llm.textscan import BREAK, Scan

WIDTH = 10
#: Bytes of item text in a block, blocks that a Python worker holds, words of a shard.
BLOCK_BYTES, HELD, SHARD_WORDS = 1 << 20, 8, 400_000
#: Every so many positions of a stretch has its suffix's place stored.
SAMPLED = 8
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit of the symbol a level."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.r_[seq[bit == 0], seq[bit == 1]]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k][low], self.ones[k][high]
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low


def suffix_array(seq: np.ndarray, separator: int = 0) -> np.ndarray:
    """By prefix doubling of what is not told apart yet. Separators are smaller
    than words and differ from each other by position, so no comparison runs
    past one."""
    n = len(seq)
    gaps = seq == separator
    first = np.where(gaps, np.cumsum(gaps) - 1, seq.astype(np.int64) + n)
    order = np.argsort(first, kind="stable")
    rank, slots, own, step = np.empty(n, np.int64), np.arange(n), first[order], 1
    held = order
    while True:
        fresh = np.r_[True, own[1:] != own[:-1]]
        at = np.flatnonzero(fresh)
        size = np.diff(np.r_[at, len(own)])
        rank[held] = np.repeat(slots[at], size)  # of equal ones: the first's slot
        open_ = np.repeat(size > 1, size)
        if not open_.any():
            return order
        slots, held = slots[open_], held[open_]
        key = rank[held] * (n + 1) + rank[held + step] + 1
        by = np.argsort(key, kind="stable")
        held, own = held[by], key[by]
        order[slots] = held
        step *= 2


class FMIndex:
    """Of a sequence of symbols 1..sigma-1 in stretches, each before a 0."""

    def __init__(self, seq: np.ndarray, sigma: int):
        sa = suffix_array(seq)
        self.bwt = seq[sa - 1]
        self.matrix = WaveletMatrix(self.bwt, sigma)
        self.first = np.r_[0, np.cumsum(np.bincount(seq, minlength=sigma))]
        # the first symbol of a stretch is always sampled: no walk leaves it
        starts = np.r_[True, seq[:-1] == 0]
        depth = np.arange(len(seq)) - np.maximum.accumulate(np.where(starts, np.arange(len(seq)), 0))
        marked = (depth % SAMPLED == 0)[sa]
        self.marked, self.place = marked, np.cumsum(marked) - 1
        self.samples = sa[marked]
        self.n = len(seq)

    def search(self, patterns: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that begin with each pattern
        (rows of a matrix, left aligned)."""
        low, high = np.zeros(len(lens), np.int64), np.full(len(lens), self.n, np.int64)
        for back in range(1, int(lens.max(initial=0)) + 1):
            at = np.flatnonzero((lens >= back) & (low < high))
            if not len(at):
                break
            c = patterns[at, lens[at] - back]
            both = self.matrix.rank(np.r_[c, c], np.r_[low[at], high[at]])
            low[at], high[at] = self.first[c] + both[: len(at)], self.first[c] + both[len(at) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left, rows = np.arange(len(rows)), rows.copy()
        while len(left):
            done = self.marked[rows]
            out[left[done]] = self.samples[self.place[rows[done]]] + steps[left[done]]
            left, rows = left[~done], rows[~done]
            steps[left] += 1
            c = self.bwt[rows]
            rows = self.first[c] + self.matrix.rank(c, rows)
        return out


class Block:
    """Windows of some items: words, patterns and the items of each pattern."""

    def __init__(self, ids: list[str], texts: list[bytes], key: int = 0):
        s = Scan(texts, BREAK, lower=True, key=key)
        self.vocabulary, word = np.unique(s.word_hashes, return_inverse=True)
        word = word.astype(np.int32) + 1
        n, first = s.n_words, np.cumsum(s.n_words) - s.n_words
        count = np.where(n == 0, 0, np.maximum(n - WIDTH + 1, 1))
        item = np.repeat(np.arange(len(texts)), count)
        start = common.ragged(first, count)
        size = np.minimum(n[item], WIDTH)
        rows = np.zeros((len(item), WIDTH + 1), np.int32)
        rows[:, WIDTH] = size
        for k in range(WIDTH):
            has = size > k
            rows[has, k] = word[start[has] + k]
        unique, of = np.unique(rows, axis=0, return_inverse=True)
        self.patterns, self.lens = unique[:, :WIDTH], unique[:, WIDTH].astype(np.int64)
        names, number = np.unique(np.array(ids, object), return_inverse=True)
        self.names = names
        pairs = np.unique(np.c_[of.ravel(), number[item]], axis=0)
        self.item_of, self.item_start = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(unique) + 1))

    def find(self, index: FMIndex, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows in an index over symbols 1 + number in
        ``vocabulary``: place, length and pattern."""
        if not len(self.lens) or not len(vocabulary):
            return (np.zeros(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(vocabulary, self.vocabulary), len(vocabulary) - 1)
        symbol = np.r_[0, np.where(vocabulary[at] == self.vocabulary, at + 1, -1)]
        patterns = symbol[self.patterns]
        there = np.flatnonzero((patterns >= 0).all(1))
        low, high = index.search(patterns[there], self.lens[there])
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit]
        pattern = np.repeat(there[hit], many)
        return index.locate(common.ragged(low[hit], many)), self.lens[pattern], pattern

    def items(self, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many items hold each pattern, and their numbers one after another."""
        n = (self.item_start[1:] - self.item_start[:-1])[pattern]
        return n, self.item_of[common.ragged(self.item_start[pattern], n)]


def _blocks(items: DataFrame, id_column: str, column: str, key: int) -> list[str]:
    """Write the items as blocks to the shared folder; their file names."""
    uri = common.shared_dir(items.sparkSession, "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(uri)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for piece in common.slices(batch, "text", BLOCK_BYTES):
                name = f"{uri}/{uuid.uuid4().hex}"
                with fs.open_output_stream(f"{root}/{name.rsplit('/', 1)[1]}", compression=None) as f:
                    f.write(pickle.dumps(Block([x.decode() for x in common.values(piece, "id")], common.values(piece, "text"), key)))
                yield pa.RecordBatch.from_pydict({"name": [name]})

    rows = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    return [r[0] for r in common.stored(rows.mapInArrow(run, "name string"), "blocks").collect()]  # a name a block


_turn = count()


@lru_cache(maxsize=HELD)
def _block(name: str) -> Block:
    fs, path = common.filesystem(name)
    with fs.open_input_stream(path, compression=None) as f:
        return pickle.loads(f.read())


def search(s: Scan, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Of the texts of a scan: first and last-but-one word of the merged spans,
    and the sorted ids of the items of each text."""
    doc, n = s.words[2], len(s.words[0])
    step = np.zeros(n + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(s.n)]
    for begin in range(0, n if names else 0, SHARD_WORDS):
        end = min(begin + SHARD_WORDS + WIDTH - 1, n)
        own = doc[begin:end]
        vocabulary, symbol = np.unique(s.word_hashes[begin:end], return_inverse=True)
        # text, 0, text, 0, ...
        cut = np.r_[np.flatnonzero(np.diff(own)) + 1, end - begin]
        word = np.insert(np.arange(begin, end), cut, -1)
        index = FMIndex(np.insert(symbol.astype(np.int32) + 1, cut, 0), len(vocabulary) + 1)
        # there and back, so that the blocks held from the shard before come first
        for name in names if next(_turn) % 2 else names[::-1]:
            block = _block(name)
            place, size, pattern = block.find(index, vocabulary)
            first = word[place]
            np.add.at(step, first, 1)
            np.add.at(step, first + size, -1)
            both = np.unique(doc[first] * max(1, len(block.lens)) + pattern)
            many, item = block.items(both % max(1, len(block.lens)))
            for t, i in zip(np.repeat(both // max(1, len(block.lens)), many).tolist(), item.tolist(), strict=True):
                found[t].add(block.names[i])
    hit = np.cumsum(step)[:-1] > 0
    begins = hit & np.r_[True, ~hit[:-1] | (doc[1:] != doc[:-1])][: len(hit)]
    ends = hit & np.r_[~hit[1:] | (doc[1:] != doc[:-1]), True][: len(hit)]
    return hit, np.flatnonzero(begins), np.flatnonzero(ends) + 1, [sorted(x) for x in found]


def find(docs: DataFrame, items: DataFrame, column: str = "text", id_column: str = "item_id", item_column: str = "text", clean: str | None = None) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``spans`` (byte
    ranges of the UTF-8 text that are covered); with ``clean`` also a column of
    that name with the text without its spans."""
    key = common.run_key()
    names = _blocks(items, id_column, item_column, key)
    added = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), "spans": SPAN}
    if clean:
        added[clean] = T.StringType()
    rest = [c for c in docs.columns if c not in added]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(c, t) for c, t in added.items()])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, column):
                texts = common.values(piece, column)
                s = Scan(texts, BREAK, lower=True, key=key)
                hit, first, last, found = search(s, names)
                start, end, doc = s.words
                own = doc[first]
                a, b = start[first] - s.start[own], end[last - 1] - s.start[own]
                spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(own, minlength=s.n))].astype(np.int32)), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["start", "end"])).cast(kind)
                out = [pa.array(s.n_words), pa.array(s.per_doc(doc[hit])), pa.array(found, pa.list_(pa.string())), spans]
                if clean:
                    cut = {}
                    for t, x, y in zip(own.tolist(), a.tolist(), b.tolist(), strict=True):
                        cut.setdefault(t, []).append((x, y))
                    at = piece.schema.get_field_index(column)
                    col = piece.column(at).to_pylist()
                    for t, ranges in cut.items():
                        edges = [0, *(e for r in ranges for e in r), len(texts[t])]
                        col[t] = b"".join(texts[t][i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)).decode()
                    out.append(pa.array(col, pa.string()))
                yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index(c)) for c in rest] + out, names=[*rest, *added])

    return docs.mapInArrow(run, schema)
