"""Token-id files: independent zstandard frames with a trailing seek table.

A file holds, in ascending document order,

* frames of ids (little-endian unsigned 32-bit) of whole documents, each about
  ``FRAME_IDS`` ids, written with zstandard's own content checksum;
* one frame with the document index: for each document its id (signed 64-bit),
  1 if that id is null, and its count of ids (both signed 64-bit);
* a skippable frame with the seek table of the public zstandard seekable
  format: for each frame its compressed and decompressed size and the low 32
  bits of the XXH64 of its content, then the number of frames, a descriptor
  byte (0x80: checksums) and the magic number.

A reader takes the seek table from the file's end, the index, and then only
the frames of the documents that it wants.

Edge cases: a null or empty text has the end id alone; rows that repeat a
document id all stay, one after another in the order of a hash of their texts
(a hot id is dealt to several files); null document ids come first; an
empty table has no files. A document longer than a frame has a frame of its
own; encoding holds one text whole, with some 40 bytes of working memory a byte. Columns other than the id and the text are not stored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm import common
from vicinal.llm.bpe import PieceCache, binary_array, ends_after_letters

#: Ids a frame holds before the next begins.
FRAME_IDS = 1 << 16
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEK_MAGIC, SEEK_DESCRIPTOR = 0x184D2A5E, 0x8F92EAB1, 0x80
LEVEL = 3
#: Words kept by a Python worker (some 200 MB; the library is slower than a lookup).
KEPT_WORDS = 1_200_000
#: Ids and documents of a file, about: its index is held until it closes.
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 20


class Writer:
    """Writes one file; ``add`` takes documents in order."""

    def __init__(self, out):
        self.out, self.sizes = out, []
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.held, self.n_held, self.index = [], 0, []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids.astype("<u4").tobytes())
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
        self.held, self.n_held = [], 0

    def _frame(self, raw: bytes) -> None:
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.sizes.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        self._frame(np.array(self.index, "<i8").tobytes())
        table = b"".join(struct.pack("<III", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), SEEK_DESCRIPTOR, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class Reader:
    """Reads one file; only the frames that are asked for are decompressed."""

    def __init__(self, file):
        self.file, self.frames_read = file, 0
        size = file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the file's end")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.raw, self.sums = table.T
        self.start = np.cumsum(self.packed) - self.packed
        rows = np.frombuffer(self._frame(n - 1), "<i8").reshape(-1, 3)
        self.doc_id, self.null, self.count = rows[:, 0], rows[:, 1] != 0, rows[:, 2]
        self.first = np.cumsum(self.count) - self.count
        self.ids_before = (np.cumsum(self.raw[:-1]) - self.raw[:-1]) // 4

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(int(at))
        return self.file.read(int(n))

    def _frame(self, k: int) -> bytes:
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.start[k], self.packed[k]), max_output_size=int(self.raw[k]))
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def frame_of(self, row: int) -> int:
        """The frame that holds a document (an empty one: none is needed)."""
        return int(np.searchsorted(self.ids_before, self.first[row], side="right")) - 1

    def read(self, row: int) -> np.ndarray:
        """The ids of the document in that row of the index."""
        if not self.count[row]:
            return np.zeros(0, np.uint32)
        k = self.frame_of(row)
        self.frames_read += 1
        at = int(self.first[row] - self.ids_before[k])
        return np.frombuffer(self._frame(k), "<u4")[at : at + int(self.count[row])]

    def frames(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Frame by frame: the rows of its documents, and their ids."""
        of = np.searchsorted(self.ids_before, self.first, side="right") - 1
        edges = np.searchsorted(of, np.arange(len(self.raw)))
        for k in range(len(self.raw) - 1):
            yield np.arange(edges[k], edges[k + 1]), np.frombuffer(self._frame(k), "<u4")


class LibraryWords:
    """Ids of parts of text without white space, by the tokenizers library.

    Distinct parts go to the library many at a time, joined by a special token
    that none of them holds, and its id splits the result. A full stop or comma
    after a letter is a word of its own for the pattern, so it is cut off and
    the rest looked up alone. If the tokenizer lower-cases, A-Z may be lowered
    before the lookup."""

    JOINED = 128

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = spec["normalizer"] or {}
        self.lowers = any(n["type"] == "Lowercase" for n in parts.get("normalizers", [parts]) if n)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        plain = [t for t in spec["added_tokens"] if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.joint = plain[-1] if plain else None
        self.parts = PieceCache(self._ask, KEPT_WORDS)

    def _ask(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.zeros(len(words), np.int64)
        odd = [i for i, w in enumerate(words) if not self.joint or any(s in w for s in self.special)]
        if not odd:
            mark = self.joint["content"]
            texts = [w.decode() for w in words]
            groups = [mark.join(texts[i : i + self.JOINED]) + mark for i in range(0, len(texts), self.JOINED)]
            ids = np.concatenate([np.array(self.tok.encode(g, add_special_tokens=False).ids, np.uint32) for g in groups])
            ends = np.flatnonzero(ids == self.joint["id"])
            n = np.diff(np.r_[-1, ends]) - 1
            return ids[ids != self.joint["id"]], n
        ids = []
        for i, w in enumerate(words):
            own = self.tok.encode(w.decode(), add_special_tokens=False).ids
            ids += own
            n[i] = len(own)
        return np.array(ids, np.uint32), n

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts, n = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            flat = np.frombuffer(t.lower() if self.lowers and b"<" not in t else t, np.uint8)
            own = np.insert(flat, ends_after_letters(flat), 32).tobytes().split()
            parts += own
            n[i] = len(own)
        ids, count = self.parts.ids(parts)
        total = np.r_[0, np.cumsum(count)]
        ends = np.cumsum(n)
        return ids, total[ends] - total[ends - n]


library = lru_cache(maxsize=1)(LibraryWords)


def library_ids(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids by the tokenizers library, one after another, and each text's count.

    For tokenizers that drop white space: no word of the pattern crosses white
    space, so a text's ids are those of its parts between white space."""
    return library(path).ids(texts)


def write(df: DataFrame, uri: str, path: str, end_id: int, id_column: str = "doc_id", column: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of every text, ``end_id`` after each, to files below
    ``uri`` in ascending order of ``id_column``; a file ends after ``file_ids`` ids
    or ``FILE_DOCS`` documents, with the document that reaches them.

    Returns the manifest (kept in the same folder): file, first_id, n_docs,
    n_tokens and base, the count of ids in the files before. Files of attempts
    that failed are in no manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(uri)
        fs.create_dir(root, recursive=True)
        part, number, w, out, row = TaskContext.get().partitionId(), 0, None, None, {}

        def closed() -> pa.RecordBatch:
            w.close()
            out.close()
            return pa.RecordBatch.from_pydict({"file": [row["file"]], "first_id": pa.array([row["id"]], pa.int64()), "first_key": [row["key"]], "n_docs": [len(w.index)], "n_tokens": [w.n_ids]})

        for batch in batches:
            for piece in common.slices(batch, column):
                docs = piece.column(0).to_pylist()
                ids, n = library_ids(common.values(piece, column), path)
                ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
                ends = np.cumsum(n + 1)
                for i, (d, e, k) in enumerate(zip(docs, ends, n + 1, strict=True)):
                    if w is None:  # names rise with the order of rows, also where files begin with equal ones
                        row = {"file": f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.zst", "id": d, "key": piece.column(2)[i].as_py()}
                        out = fs.open_output_stream(f"{root}/{row['file']}", compression=None)
                        w, number = Writer(out), number + 1
                    w.add(d, ids[e - k : e])
                    if w.n_ids >= file_ids or len(w.index) >= FILE_DOCS:
                        yield closed()
                        w = None
        if w is not None:
            yield closed()

    text = F.col(column).cast("string")
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), text.alias(column), F.xxhash64(text).alias("key"))
    by = (F.col("doc_id").asc_nulls_first(), F.col("key").asc())
    parts = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    files = common.stored(parts.mapInArrow(run, "file string, first_id long, first_key long, n_docs long, n_tokens long"), "files")
    # one row a file, so one partition can order them
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_key", "file")
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read(manifest: DataFrame, uri: str) -> DataFrame:
    """Read the files of a manifest: doc_id, start, n_tokens, ids (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(uri)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    r = Reader(f)
                    for rows, ids in r.frames():
                        n = r.count[rows]
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(r.doc_id[rows], pa.int64(), mask=r.null[rows]), "start": pa.array(r.first[rows] + base), "n_tokens": pa.array(n), "ids": binary_array(ids.view(np.uint8), n * 4, pa.binary())})

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
