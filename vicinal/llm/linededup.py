"""Line dedup with two Bloom filters.

Pass 1: every task sets the bits of its line keys in a once-seen filter and, if
they were set already, in a twice-seen filter. Filters are merged block by
block; a bit set in two once-seen filters goes to the twice-seen one, so that
one holds every key of two documents or more. Pass 2: only lines that it
suspects are hashed to 128 bits and shuffled, as counts a task, for exact
confirmation and for the choice of the first occurrence. Pass 3 drops the
lines. The filter has ten bits a line up to ``FILTER_BYTES``; beyond that more
lines are suspected, and the result stays the same.

A line's key is the line without white space at both ends, A-Z lowered. Edge
cases: a null or empty text is one empty line and stays (a null as null); lines
whose key is empty always stay; every row counts as a document of its own, even
if ids repeat. Columns of the input are kept, those named like a result are
replaced; an empty table has no rows. A text is held whole, with some 40 bytes
of working memory a byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.llm import common
from vicinal.llm.textscan import WHITE, Scan, mix

#: Documents that must hold a key, and code points that it must have.
LEAST_DOCS, LEAST_CHARS = 10, 1
#: Most bytes of one filter; bits a line; bytes of a block of a filter.
FILTER_BYTES, BITS_A_LINE, BLOCK = 64 << 20, 10, 1 << 15
#: Bytes of stored input that are taken for a line when a filter is sized.
BYTES_A_LINE = 100
PROBES = 2
#: Keys that are broadcast, at most (16 bytes each); more are joined.
BROADCAST_KEYS = 1 << 20


class Lines:
    """Lines of some texts with their keys' ranges and 64-bit hashes."""

    def __init__(self, texts: list[bytes], key: int = 0):
        s = self.scan = Scan(texts, WHITE, lower=True, key=key)
        self.start, self.end, self.doc = s.lines
        first, last, _ = s.words
        i, j = np.searchsorted(first, self.start), np.searchsorted(first, self.end)
        self.full = j > i
        at = np.where(self.full, i, 0)
        self.key_start = np.where(self.full, first[at], self.start) if len(first) else self.start
        self.key_end = np.where(self.full, last[np.where(self.full, j - 1, 0)], self.start) if len(first) else self.start
        self.hash = s.hashes(self.key_start, self.key_end)

    def exact(self, at: np.ndarray) -> list[bytes]:
        """128-bit hashes of the keys of some lines."""
        data, seed = self.scan.data, self.scan.key
        return [xxhash.xxh3_128_digest(data[a:b].tobytes(), seed=seed) for a, b in zip(self.key_start[at], self.key_end[at], strict=True)]

    def long_enough(self, chars: int) -> np.ndarray:
        if chars <= 1:
            return self.full
        points = np.r_[0, np.cumsum((self.scan.data & 0xC0) != 0x80)]
        return self.full & (points[self.key_end] - points[self.key_start] >= chars)


def bits_of(h: np.ndarray, n_bits: int) -> list[np.ndarray]:
    """The places of each key's bits."""
    return [(mix(h + np.uint64(k)) & np.uint64(n_bits - 1)).astype(np.int64) for k in range(PROBES)]


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for at in bits_of(h, 8 * len(bits)):
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def put(bits: np.ndarray, h: np.ndarray) -> None:
    for at in bits_of(h, 8 * len(bits)):
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def once_seen(keys: DataFrame, n_bytes: int) -> np.ndarray:
    """The filter of a column of 64-bit keys, merged block by block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bytes, np.uint8)
        for batch in batches:
            put(bits, batch.column(0).to_numpy().astype(np.int64).view(np.uint64))
        for k in range(0, n_bytes, BLOCK):
            if bits[k : k + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k // BLOCK]), "bits": [zlib.compress(bits[k : k + BLOCK].tobytes(), 1)]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, None
        for batch in batches:
            for k, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"block": pa.array([now]), "bits": [zlib.compress(bits.tobytes(), 1)]})
                    now, bits = k, np.zeros(BLOCK, np.uint8)
                bits |= np.frombuffer(zlib.decompress(part), np.uint8)
        if now is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([now]), "bits": [zlib.compress(bits.tobytes(), 1)]})

    schema, out = "block long, bits binary", np.zeros(n_bytes, np.uint8)
    parts = keys.mapInArrow(build, schema)
    for row in parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, schema).toLocalIterator():
        out[row[0] * BLOCK : (row[0] + 1) * BLOCK] = np.frombuffer(zlib.decompress(row[1]), np.uint8)
    return out


def filter_bytes(df: DataFrame) -> int:
    """A power of two: about ten bits a line of the stored input."""
    size = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = BLOCK
    while n < min(FILTER_BYTES, size / BYTES_A_LINE * BITS_A_LINE / 8):
        n *= 2
    return n


def twice_seen(df: DataFrame, column: str, chars: int, n_bytes: int, key: int = 0) -> np.ndarray:
    """The merged twice-seen filter (at most ``FILTER_BYTES``)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros((2, n_bytes), np.uint8)
        for batch in batches:
            for piece in common.slices(batch, column):
                x = Lines(common.values(piece, column), key)
                h, doc = x.hash[x.long_enough(chars)], x.doc[x.long_enough(chars)]
                h, n = np.unique(h[x.scan.first_in_doc(h, doc)], return_counts=True)
                put(twice, h[(n > 1) | has(once, h)])
                put(once, h)
        for k in range(n_bytes // BLOCK):
            a, b = once[k * BLOCK : (k + 1) * BLOCK], twice[k * BLOCK : (k + 1) * BLOCK]
            if a.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k]), "once": [zlib.compress(a.tobytes(), 1)], "twice": [zlib.compress(b.tobytes(), 1)]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([block]), "twice": [zlib.compress(twice.tobytes(), 1)]})

        block = None
        for batch in batches:
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != block:
                    if block is not None:
                        yield done()
                    block, once, twice = k, *np.zeros((2, BLOCK), np.uint8)
                a, b = (np.frombuffer(zlib.decompress(y), np.uint8) for y in (a, b))
                twice |= b | (once & a)
                once |= a
        if block is not None:
            yield done()

    parts = df.select(column).mapInArrow(build, "block long, once binary, twice binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, twice binary")
    out = np.zeros(n_bytes, np.uint8)
    for row in merged.toLocalIterator():
        out[row[0] * BLOCK : (row[0] + 1) * BLOCK] = np.frombuffer(zlib.decompress(row[1]), np.uint8)
    return out


def repeated(df: DataFrame, column: str = "text", id_column: str = "doc_id", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, key: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Keys in ``least_docs`` documents or more: key (128-bit hash), n_docs and
    first (the smallest id, then line, that holds it); and the filter."""
    # of two documents on, the twice-seen filter misses none
    bits = twice_seen(df, column, least_chars, filter_bytes(df), key) if least_docs > 1 else np.full(BLOCK, 255, np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(bits)  # at most FILTER_BYTES

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, column):
                x = Lines(common.values(piece, column), key)
                at = np.flatnonzero(x.long_enough(least_chars) & has(shared.value, x.hash))
                at = at[x.scan.first_in_doc(x.hash[at], x.doc[at])]
                ids = piece.column(0).take(pa.array(x.doc[at]))
                line = at - np.searchsorted(x.doc, x.doc[at])
                yield pa.RecordBatch.from_arrays([pa.array(x.exact(at), pa.binary()), ids, pa.array(line)], names=["key", "doc_id", "line"])

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), column).mapInArrow(suspects, "key binary, doc_id long, line long")
    keys = rows.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"), F.min(F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("doc_id"))).alias("any_id"))
    return keys.where(F.col("n_docs") >= least_docs).select("key", "n_docs", F.coalesce("first_id", "any_id").alias("first_id")), bits


def drop(df: DataFrame, column: str = "text", id_column: str = "doc_id", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, keep_first: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Drop all lines of repeated keys; with ``keep_first`` the first line in
    the document with the smallest id stays. ``column`` is replaced by the other
    lines; ``n_lines`` (before) and ``n_dropped`` are added."""
    key = common.run_key()
    keys, bits = repeated(df, column, id_column, least_docs, least_chars, key)
    keys = common.stored(keys, "repeated-lines")
    context = df.sparkSession.sparkContext
    added = {"n_lines": T.LongType(), "n_dropped": T.LongType()}
    own = [c for c in df.columns if c not in added]
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField(c, t) for c, t in added.items()])

    def cut(piece: pa.RecordBatch, x: Lines, gone: np.ndarray) -> pa.RecordBatch:
        n, out = x.scan.per_doc(x.doc), piece.column(piece.schema.get_field_index(column)).to_pylist()
        for d in np.unique(x.doc[gone]):
            at = np.arange(*np.searchsorted(x.doc, [d, d + 1]))
            stay = at[~gone[at]]
            out[d] = b"\n".join(x.scan.raw[x.start[i] : x.end[i]].tobytes() for i in stay).decode()
        cols = [pa.array(out, pa.string()) if c == column else piece.column(piece.schema.get_field_index(c)) for c in own]
        return pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.array(x.scan.per_doc(x.doc[gone]))], names=[*own, *added])

    shared_bits = context.broadcast(bits)
    if keys.count() <= broadcast_keys:
        table = context.broadcast({bytes(r[0]): r[1] for r in keys.select("key", "first_id").toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in common.slices(batch, column):
                    x = Lines(common.values(piece, column), key)
                    gone = np.zeros(len(x.doc), bool)
                    at = np.flatnonzero(x.long_enough(least_chars) & has(shared_bits.value, x.hash))
                    found = x.exact(at)
                    hit = np.fromiter((k in table.value for k in found), bool, len(found))
                    gone[at] = hit
                    if keep_first:
                        ids = piece.column(piece.schema.get_field_index(id_column)).to_pylist()
                        first = x.scan.first_in_doc(x.hash[at], x.doc[at])
                        for i, k, h, f in zip(at.tolist(), found, hit.tolist(), first.tolist(), strict=True):
                            if h and f and ids[x.doc[i]] == table.value[k]:
                                gone[i] = False
                    yield cut(piece, x, gone)

        return df.select(own).mapInArrow(run, schema)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, column):
                x = Lines(common.values(piece, column), key)
                at = np.flatnonzero(x.long_enough(least_chars) & has(shared_bits.value, x.hash))
                line = at - np.searchsorted(x.doc, x.doc[at])
                first = x.scan.first_in_doc(x.hash[at], x.doc[at])
                of = pa.array(x.doc[at])
                yield pa.RecordBatch.from_arrays([piece.column(0).take(of), piece.column(2).take(of), pa.array(line), pa.array(first), pa.array(x.exact(at), pa.binary())], names=["doc_id", "text_hash", "line", "first", "key"])

    # lines go by the row's id and text: rows equal in both lose the same lines
    text_hash, id_, hash_, gone_ = common.fresh(df.columns, "_text_hash", "_id", "_hash", "_gone")
    marked = df.select(own).withColumn(text_hash, F.xxhash64(F.col(column)))
    narrow = marked.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column), F.col(text_hash).alias("text_hash"))
    lines = narrow.mapInArrow(positions, "doc_id long, text_hash long, line long, first boolean, key binary").join(keys, "key")
    if keep_first:
        lines = lines.where(~(F.col("first") & F.col("doc_id").eqNullSafe(F.col("first_id"))))
    gone = lines.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.collect_set("line").alias(gone_))
    joined = marked.join(gone, F.col(id_column).cast("long").eqNullSafe(F.col(id_)) & F.col(text_hash).eqNullSafe(F.col(hash_)), "left").select(*own, gone_)

    def by_position(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, column):
                x = Lines(common.values(piece, column), key)
                lists = piece.column(piece.schema.get_field_index(gone_)).to_pylist()
                flags = np.zeros(len(x.doc), bool)
                first = np.searchsorted(x.doc, np.arange(x.scan.n))
                for d, own_lines in enumerate(lists):
                    if own_lines:
                        flags[first[d] + np.array(own_lines)] = True
                yield cut(piece, x, flags)

    return joined.mapInArrow(by_position, schema)
