"""Near-duplicates by Order MinHash.

The k-mers of a text are its windows of five words, each labelled with its
occurrence number, so that a text's labelled k-mers are all different. A sketch
takes the ``PICKED`` smallest under one of ``SKETCHES`` hash functions and
keeps them in text order; equal sketches make a bucket.

Candidates are verified by a banded alignment of their words: of n1 and n2 words
L match in order, and the similarity is L / (n1 + n2 - L); 0.8 or more is a
link. Changed words cost what they are, not the five windows that each spoils,
so texts with two k-mers of five in common may be linked. (If the k-mers are
aligned to 0.8, the words are too.) Places of matches differ by no more than may
stay unmatched, which is the band.

Candidates, in buckets of any size by the same rules:

* In ``ROUNDS`` rounds each bucket names a centre and compares it with all its
  members of other classes; then the centre's class leaves the bucket. The first
  centre is the member that shares most sketches with others, as the original of
  many copies does. A round has at most a pair a member.
* Of what is still in different classes afterwards, all pairs of a bucket that
  share k-mers enough for a similarity of 0.8 by k-mers are found by their
  rarest k-mers: of n1 and n2 k-mers at least L = 0.8 / 1.8 * (n1 + n2) must be
  common, so under any one order of all k-mers the first n1 - L + 1 and
  n2 - L + 1 share one. The order begins with those that only texts of one class
  hold, which needn't be looked for, and goes on from rare to frequent; a table
  of counters, sized to the k-mers, holds both. A passage that many texts share
  is thus no reason to compare them.
* Texts of fewer than ``SHORT`` k-mers are found by their rarest k-mers in one
  bucket or not, as picks from so few agree too seldom.

What may be lost: longer texts that share no sketch. Two texts that share a part
J of their k-mers (Jaccard) have a given sketch in common with a chance of about
J**``PICKED``, and none of all with (1 - J**3)**24: 0.1 in 1000 at J = 0.7, 3 in
1000 at 0.6, 4 in 100 at 0.5, 2 in 10 at 0.4. The README has measured figures.

Edge cases: texts of fewer than five words have one k-mer, all their words;
texts without a word (null, empty) are in no group: each is its own class. Rows
that repeat an id are rows of their own; a class's id is the smallest id in it.
An empty table has no classes. A text is held whole, with some 60 bytes of
working memory a byte. Of the input only the id and the text are read, so other
columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm import common, linededup
from vicinal.llm.textscan import BREAK, Scan, mix

WORDS, SIMILARITY = 5, 0.8
SKETCHES, PICKED = 24, 3
#: K-mers below a threshold that are sorted to find the smallest: about so many.
TAKEN = 16
#: Centres that a bucket names one after another.
ROUNDS = 3
#: Texts of fewer k-mers are compared without regard to buckets: picks from so few
#: agree too seldom.
SHORT = 40
#: Counters by which k-mers are ordered: about this many for each k-mer, within
#: these bounds (a byte each), dealt in blocks.
COUNTERS, LEAST_BINS, MOST_BINS, BIN_BLOCK = 4, 1 << 16, 1 << 23, 1 << 16
#: Classes of more than 1 / HOT of the rows are at most HOT, and are broadcast.
HOT = 1000

_RNG = np.random.default_rng(3)
_A = _RNG.integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(1, 1 << 63, SKETCHES, dtype=np.uint64)
_STEP = _RNG.integers(1, 1 << 63, PICKED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KMER = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plain_kmers(words: np.ndarray) -> np.ndarray:
    """K-mers of one text (hashes of its words) without labels, in text order."""
    n = max(1, len(words) - WORDS + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(words))):
        h += words[k : k + n] * _KMER[k]
    return mix(h)


def kmers(words: np.ndarray) -> np.ndarray:
    """Labelled k-mers of one text (hashes of its words), in text order."""
    h = plain_kmers(words)
    return label(h, np.zeros(len(h), np.int64))


def label(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hash each k-mer with how many equal ones its text has before it."""
    own = h ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    s = own[order]
    fresh = np.r_[True, s[1:] != s[:-1]]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
    number = np.empty(len(s), np.int64)
    number[order] = np.arange(len(s)) - first
    return mix(h + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketches(s: Scan) -> np.ndarray:
    """A row of ``SKETCHES`` bucket keys for each text with words."""
    h, doc, n = mix(s.word_hashes & np.uint64(0xFFFFFFFF)), s.words[2], s.n_words
    some = np.flatnonzero(n > 0)
    count = np.maximum(n[some] - WORDS + 1, 1)
    at = common.ragged((np.cumsum(n) - n)[some], count)
    of = np.repeat(np.arange(len(some)), count)
    short = np.repeat(n[some], count)
    x = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        has = k < short
        x[has] += h[at[has] + k] * _KMER[k]
    x = label(mix(x), of)
    limit = np.where(count > TAKEN, (TAKEN / count * 2.0**64), 2.0**64 - 4096).clip(max=2.0**64 - 4096).astype(np.uint64)
    limit[count <= TAKEN] = np.uint64(0xFFFFFFFFFFFFFFFF)
    limits = limit[of]
    out = np.zeros((len(some), SKETCHES), np.uint64)
    need = np.minimum(count, PICKED)
    for t in range(SKETCHES):
        v = x * _A[t] + _B[t]
        under = np.flatnonzero(v <= limits)
        few = np.bincount(of[under], minlength=len(some)) < need
        if few.any():  # by bad luck too few are below the threshold: take all
            under = np.flatnonzero((v <= limits) | few[of])
        order = under[np.lexsort((v[under], of[under]))]
        d = of[order]
        begin = np.searchsorted(d, np.arange(len(some)))
        picked = np.sort(order[np.arange(len(d)) - begin[d] < PICKED])
        d = of[picked]
        begin = np.searchsorted(d, np.arange(len(some)))
        out[:, t] = mix(np.add.reduceat(x[picked] * _STEP[np.arange(len(d)) - begin[d]], begin) + np.uint64(t)) if len(some) else 0
    return out


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Of two texts' words (hashes), by banded alignment; 0 if below SIMILARITY
    for certain."""
    n = len(x) + len(y)
    least = int(np.ceil(SIMILARITY * n / (1 + SIMILARITY) - 1e-9))
    if min(len(x), len(y)) < least:
        return 0.0
    a, b = (label(w.astype(np.uint64), np.zeros(len(w), np.int64)) for w in (x, y))
    if len(np.intersect1d(a, b, assume_unique=True)) < least:
        return 0.0
    chain = alignment(x, y, least)
    return chain / (n - chain)


def alignment(x: np.ndarray, y: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence, exact if it is ``least`` or
    more. The places of such matches differ by no more than may stay unmatched
    in either text; bit vectors of that band hold a row of the table each."""
    m = min(len(x), len(y))
    off = np.flatnonzero(x[:m] != y[:m])
    head = int(off[0]) if len(off) else m
    x, y, m = x[head:], y[head:], m - head
    off = np.flatnonzero(x[len(x) - m :][::-1] != y[len(y) - m :][::-1])
    tail = int(off[0]) if len(off) else m
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    left = max(least - head - tail, 0)
    if len(x) < left or len(y) < left:
        return head + tail
    below, width = len(x) - left, len(x) + len(y) - 2 * left + 1
    places: dict[int, list[int]] = {}
    for j, h in enumerate(y.tolist()):
        places.setdefault(h, []).append(j)
    held: dict[int, tuple[int, int, int]] = {}  # of frequent k-mers: mask, its first place, places taken in
    top, full, count = 1 << (width - 1), (1 << width) - 1, head + tail
    v = full  # bit j - low; a zero is a step of the table
    for i, h in enumerate(x.tolist()):
        low = i - below
        if i:
            count += not v & 1
            v = v >> 1 | top
        at = places.get(h)
        if at is None:
            continue
        mask, since, taken = held.get(h, (0, low, 0))
        mask >>= low - since
        begin = taken if len(at) > 16 else 0
        while begin < len(at) and at[begin] < low + width:
            if at[begin] >= low:
                mask |= 1 << (at[begin] - low)
            begin += 1
        if len(at) > 16:
            held[h] = (mask, low, begin)
        u = v & mask
        v = (v + u | v & ~mask) & full
    return count + width - v.bit_count()


def digest(column: str) -> Column:
    """128 bits of a text as it is; null of null."""
    return F.unhex(F.md5(column))


def sketch_table(scratch: common.Scratch, docs: DataFrame, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, node (128-bit hash of the words; null without words), keys
    (buckets), n (k-mers), words (32-bit hashes, packed) and digest (of the text as
    it is), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, column):
                s = Scan(common.values(piece, column), BREAK, lower=True)
                n, word = s.n_words, s.word_hashes.astype("<u4")
                pack = zstandard.ZstdCompressor(level=1).compress
                ends = np.cumsum(n)
                words = [pack(word[e - k : e].tobytes()) for e, k in zip(ends, n, strict=True)]
                node = [xxhash.xxh3_128_digest(s.word_hashes[e - k : e].tobytes()) if k else None for e, k in zip(ends, n, strict=True)]
                keys = sketches(s).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((n > 0) * SKETCHES)].astype(np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(node, pa.binary()), lists, pa.array(np.where(n > 0, np.maximum(n - WORDS + 1, 1), 0)), pa.array(words, pa.binary()), piece.column(2)], names=["doc_id", "node", "keys", "n", "words", "digest"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), column, digest(column).alias("digest"))
    return scratch.stored(rows.mapInArrow(run, "doc_id long, node binary, keys array<long>, n long, words binary, digest binary"), "sketches")


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = [i for i in range(batch.num_rows) if similarity(*(np.frombuffer(unpack(c[i].as_py()), "<u4") for c in (x, y))) >= SIMILARITY]
            if keep:
                yield batch.take(pa.array(keep)).select(["a", "b"])

    left = words.select(F.col("node").alias("a"), F.col("words").alias("x"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def components(scratch: common.Scratch, edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of every node with an
    edge: each round every component hooks on its smallest neighbour."""
    labels, left = None, scratch.stored(edges.select("a", "b").distinct())
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        to = scratch.stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        if labels is None:
            labels = to.select(F.col("a").alias("node"), F.col("m").alias("label"))
        else:
            labels = labels.join(to, labels["label"] == to["a"], "left").select("node", F.coalesce("m", "label").alias("label"))
        labels = scratch.stored(labels)
        other = to.select(F.col("a").alias("b"), F.col("m").alias("mb"))
        left = left.join(to, "a").join(other, "b").where("m != mb").select(F.col("m").alias("a"), F.col("mb").alias("b")).distinct()
        left = scratch.stored(left)
    if labels is None:
        labels = left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def _unpacked(words: list[bytes]) -> Iterator[np.ndarray]:
    """The labelled k-mers of texts whose words are packed."""
    unpack = zstandard.ZstdDecompressor().decompress
    return (kmers(mix(np.frombuffer(unpack(w), "<u4").astype(np.uint64))) for w in words)


def _bin(km: np.ndarray, bins: int) -> np.ndarray:
    return (km & np.uint64(bins - 1)).astype(np.int64)


def orders(texts: DataFrame, bins: int) -> np.ndarray:
    """For each bin of k-mers: 0 if texts (label, words) of one class alone hold
    them, else how many there are, up to 255.

    Tasks send what they have of a block of bins (the count, and the least and
    the greatest hash of a label) to the task that merges the block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = np.zeros(bins, np.uint8), np.full(bins, 0xFFFFFFFF, np.uint32), np.zeros(bins, np.uint32)
        for batch in batches:
            for own, km in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1).to_pylist()), strict=True):
                at, c = np.unique(_bin(km, bins), return_counts=True)
                n[at] = np.minimum(n[at] + c, 255)
                h = np.uint32(xxhash.xxh32_intdigest(own))
                low[at], high[at] = np.minimum(low[at], h), np.maximum(high[at], h)
        for k in range(0, bins, BIN_BLOCK):
            part = slice(k, k + BIN_BLOCK)
            if n[part].any():
                packed = zlib.compress(n[part].tobytes() + low[part].tobytes() + high[part].tobytes(), 1)
                yield pa.RecordBatch.from_pydict({"block": [k // BIN_BLOCK], "part": pa.array([packed], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = zlib.decompress(packed)
                n, low, high = (np.frombuffer(raw, t, BIN_BLOCK, at * BIN_BLOCK) for t, at in (("u1", 0), ("<u4", 1), ("<u4", 5)))
                if k in held:
                    n0, low0, high0 = held[k]
                    n, low, high = np.minimum(n0.astype(np.int64) + n, 255).astype(np.uint8), np.minimum(low0, low), np.maximum(high0, high)
                held[k] = [n, low, high]
        for k, (n, low, high) in held.items():
            yield pa.RecordBatch.from_pydict({"block": [k], "part": pa.array([zlib.compress(np.where(low == high, 0, n).astype(np.uint8).tobytes(), 1)], pa.binary())})

    parts = texts.select("label", "words").mapInArrow(count, "block long, part binary").repartition("block").mapInArrow(merge, "block long, part binary")
    out = np.zeros(bins, np.uint8)
    for row in parts.toLocalIterator():  # at most MOST_BINS bytes
        out[row[0] * BIN_BLOCK : (row[0] + 1) * BIN_BLOCK] = np.frombuffer(zlib.decompress(row[1]), np.uint8)
    return out


def rarest(texts: DataFrame) -> DataFrame:
    """kmer, place, node, n, label: of each text (node, n, label, words) the
    k-mers of two classes or more among its rarest from place 0 on, as far as any
    text can need them."""
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = LEAST_BINS
    while bins < min(COUNTERS * total, MOST_BINS):
        bins *= 2
    shared = texts.sparkSession.sparkContext.broadcast(orders(texts, bins))  # at most MOST_BINS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, places = [], []
            for km in _unpacked(batch.column(3).to_pylist()):
                often = shared.value[_bin(km, bins)]
                first = np.lexsort((km, often))[: len(km) - int(np.ceil(SIMILARITY * len(km) - 1e-9)) + 1]
                place = np.flatnonzero(often[first])
                taken.append(km[first[place]])
                places.append(place)
            if sum(map(len, taken)):
                of = pa.array(np.repeat(np.arange(len(taken)), [len(x) for x in taken]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(taken).view(np.int64)), pa.array(np.concatenate(places)), *(batch.column(k).take(of) for k in range(3))], names=["kmer", "place", "node", "n", "label"])

    return texts.select("node", "n", "label", "words").mapInArrow(run, "kmer long, place long, node binary, n long, label binary")


def overlapping(scratch: common.Scratch, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts (node, n, label, words) of different classes that
    share one of their rarest k-mers."""
    rare = scratch.stored(rarest(scratch.stored(texts)))
    other = rare.select("kmer", F.col("place").alias("pb"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    least = lambda n: F.ceil(n * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)
    both = least(F.col("n") + F.col("nb"))
    fits = (F.col("n") <= F.col("nb")) & (F.col("label") != F.col("lb")) & (F.col("place") <= F.col("n") - both) & (F.col("pb") <= F.col("nb") - both)
    shorter = rare.where(F.col("place") <= F.col("n") - least(2 * F.col("n")))
    pairs = shorter.join(other, "kmer").where(fits)
    return pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def merged(scratch: common.Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links (a, b): only classes that these touch are
    joined anew, each named by its smallest node."""
    edges = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
    edges = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    edges = edges.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a != b")
    to = components(scratch, edges).select(F.col("node").alias("old"), F.col("label").alias("new"))
    alone = to.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    rest = labels.join(to, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    return scratch.stored(rest.unionByName(alone))


def _more(scratch: common.Scratch, labels: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Verify further pairs and join the classes that they link."""
    found = scratch.stored(verified(scratch.stored(pairs), words))
    return labels if found.isEmpty() else merged(scratch, labels, found)


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (bucket, label) of buckets with two classes or more."""
    some = rows.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("bucket")
    return rows.join(some, "bucket", "left_semi")


def labelled(docs: DataFrame, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row a document, stored: doc_id, label (its class; null without words),
    node and digest."""
    scratch = common.Scratch(docs.sparkSession, "near-copies")
    table = sketch_table(scratch, docs, column, id_column)
    some = table.where(F.col("node").isNotNull())
    rows = scratch.stored(table.select("doc_id", "node", "digest"))
    texts = scratch.stored(some.groupBy("node").agg(F.first("keys").alias("keys"), F.first("n").alias("n")), "texts")
    members = texts.select("node", F.explode("keys").alias("bucket"))
    members = scratch.stored(members.join(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket"))
    # those of under SHORT k-mers and all that may be similar to one; under 4 k-mers all must agree
    short = scratch.stored(texts.where(F.col("n") * SIMILARITY < SHORT).where("n > 3").select("node", "n"))
    scratch.free("texts")
    needed = members.select("node").union(short.select("node")).distinct()
    words = some.select("node", "n", "words").join(needed, "node", "left_semi")
    words = scratch.stored(words.groupBy("node").agg(F.first("n").alias("n"), F.first("words").alias("words")), "words")
    scratch.free("sketches")

    # the original of many copies shares most sketches with them all
    score = members.groupBy("node").agg(F.sum("size").alias("score"))
    left = scratch.stored(members.select("bucket", "node").join(score, "node"))
    labels = None
    for turn in range(ROUNDS):
        now = left.withColumn("label", F.col("node")) if labels is None else scratch.stored(_mixed(_named(left, labels)))
        centres = now.groupBy("bucket").agg(F.max_by(F.struct(F.col("node").alias("centre"), F.col("label").alias("lc")), F.struct("score", "node")).alias("c")).select("bucket", "c.*")
        others = now.join(centres, "bucket").where("label != lc")
        pairs = others.groupBy(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).agg(F.count("*").alias("shared"))
        if labels is None:  # first with the centre that shares most sketches, as most links are found so
            pairs = scratch.stored(pairs)
            best = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared")).groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
            links = verified(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), words)
            labels = components(scratch, links)
            named = labels.select("node", "label")
            pairs = pairs.join(named.toDF("a", "la"), "a", "left").join(named.toDF("b", "lb"), "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b"))
        labels = _more(scratch, labels, pairs.select("a", "b"), words)
        done = _named(centres.select("bucket", F.col("centre").alias("node")), labels).select("bucket", F.col("label").alias("lc"))
        left = _named(now.select("bucket", "node", "score"), labels).join(done, "bucket").where("label != lc").select("bucket", "node", "score")
        if turn == 0:  # from now on only texts of mixed buckets, and short ones, are read
            mixed = _mixed(_named(members.select("bucket", "node"), labels)).select("node")
            words = scratch.stored(words.join(mixed.union(short.select("node")).distinct(), "node", "left_semi"))
            scratch.free("words")

    mixed = _mixed(_named(members.select("bucket", "node"), labels)).select("node")
    texts = _named(words.join(mixed.union(short.select("node")).distinct(), "node", "left_semi"), labels)
    labels = _more(scratch, labels, overlapping(scratch, texts), words)

    named = rows.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"), "node", "digest")
    named = common.stored(named, "named")
    scratch.drop()
    return named


def by_class(rows: DataFrame, info: DataFrame, size: str, total: int) -> DataFrame:
    """Join rows with their class's row on ``label``, left: the few classes that
    hold many rows are broadcast, so that none of them meets in one task."""
    hot = F.broadcast(info.where(F.col(size) * HOT > total))  # at most HOT rows
    rest = rows.join(hot.select("label"), "label", "left_anti")
    return rows.join(hot, "label").unionByName(rest.join(info.where(F.col(size) * HOT <= total), "label", "left"))


def classes(docs: DataFrame, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, class_id (the smallest id of its class),
    class_size (documents of the class) and n_texts (different texts)."""
    named = labelled(docs, column, id_column)
    some = named.where(F.col("label").isNotNull())
    # nodes first, so that a class's copies count in their tasks
    texts = some.groupBy("label", "node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    info = texts.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n_texts"))
    info = common.stored(info.where("class_size > 1"), "classes")
    out = by_class(some, info, "class_size", named.count()).unionByName(named.where(F.col("label").isNull()), allowMissingColumns=True)
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_texts", F.lit(1)).alias("n_texts"))


def drop_copies(docs: DataFrame, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row of ``docs`` of each class: the first by id (null last), then by
    text. Rows that repeat an id have each its own fate; of rows that repeat
    both id and text one may stay. Rows without words all stay."""
    named = labelled(docs, column, id_column).where(F.col("label").isNotNull())
    held = named.groupBy("label", "doc_id", "node", "digest").agg(F.count("*").alias("rows"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "node", "digest")
    best = held.groupBy("label").agg(F.min(first).alias("best"), F.sum("rows").alias("size")).where("size > 1")
    best = common.stored(best, "best")
    marked = by_class(held, best, "size", held.count()).where("best is not null").withColumn("kept", first == F.col("best")).where("not kept or rows > 1")
    id_, digest_, kept_, row_ = common.fresh(docs.columns, "_id", "_digest", "_kept", "_row")
    marked = common.stored(marked.select(F.col("doc_id").alias(id_), F.col("digest").alias(digest_), F.col("kept").alias(kept_)), "marked")
    match = F.col(id_column).cast("long").eqNullSafe(F.col(id_)) & (digest(column) == F.col(digest_))
    # a filter of the marked rows, so that only suspects' texts are shuffled
    size = linededup.BLOCK
    while size < min(linededup.FILTER_BYTES, marked.count() * linededup.BITS_A_LINE // 8):
        size *= 2
    bits = docs.sparkSession.sparkContext.broadcast(linededup.once_seen(marked.select(F.xxhash64(id_, digest_)), size))  # at most FILTER_BYTES

    @F.pandas_udf("boolean")
    def suspect(h: pd.Series) -> pd.Series:
        return pd.Series(linededup.has(bits.value, h.to_numpy().astype(np.int64).view(np.uint64)))

    own = [F.col(f"`{c}`") for c in docs.columns]
    flagged = docs.withColumn(kept_, suspect(F.xxhash64(F.col(id_column).cast("long"), digest(column))))
    out = flagged.where(~F.col(kept_)).select(*own).unionByName(flagged.where(F.col(kept_)).select(*own).join(marked, match, "left_anti"))
    several = marked.where(F.col(kept_))
    if several.isEmpty():
        return out
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(row_)
    return out.unionByName(flagged.where(F.col(kept_)).select(*own).join(several, match).groupBy(id_, digest_).agg(one).select(f"{row_}.*"))
