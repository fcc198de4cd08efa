"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words and their beginnings of
``PREFIXES`` bytes (so that inflected forms share a term), hashed into
2**``BITS`` slots. Slots that tell the classes apart in the labelled rows are
selected by their log-likelihood ratio; on them the machine learns a weight for
each slot and a factor vector whose inner products weigh pairs of slots, which
an additive model lacks. Scoring looks each term up in a table of the selected
slots, so most terms cost one array read.

Edge cases: a null or empty text has no terms and is scored by the intercept;
labels that are null, or whose document is missing, aren't used; with no
labelled row, or only one class, every score is the class's share (0.5 if
there is none), and an empty table has no scores. Columns of the input are kept;
``score`` and ``predicted`` are replaced. Rows that repeat a document id are
scored each by its text; in the fit one of them counts, the first by a hash of
the text, and of labels that disagree the smallest. A text is held whole, with
some 100 bytes of working memory a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.llm import common
from vicinal.llm.quality import labelled_rows
from vicinal.llm.textscan import BREAK, Scan, mix

BITS = 20
#: Lengths in bytes of the beginnings of words that are terms too.
PREFIXES = (4, 5, 6, 7, 8, 9)
#: Labelled rows that the machine is fitted on, at most (chosen by hash).
MAX_ROWS = 20_000
#: Slots kept, and the length of a factor vector.
SLOTS, FACTORS = 1000, 4
EPOCHS, RATE, SHRINK, SEED = 60, 0.1, 1e-3, 7
#: A document counts as toxic from this score on.
THRESHOLD = 0.3


def terms(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text of every term occurrence (with repeats)."""
    s = Scan(texts, BREAK, lower=True)
    start, end, doc = s.words
    out, of = [s.word_hashes], [doc]
    for n in PREFIXES:
        long = np.flatnonzero(end - start > n)
        out.append(mix(s.hashes(start[long], start[long] + n) + np.uint64(n)))
        of.append(doc[long])
    return (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(of)


@dataclass
class Machine:
    """``slot``: a slot's number among the selected ones, or -1."""

    slot: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margins(self, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        """Of n texts whose distinct selected slots are (row, col)."""
        out = np.full(n, self.bias) + np.bincount(row, self.weight[col], minlength=n)
        for f in range(self.factor.shape[1]):
            v = self.factor[col, f]
            out += 0.5 * (np.bincount(row, v, minlength=n) ** 2 - np.bincount(row, v * v, minlength=n))
        return out

    def active(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at, doc = terms(texts)
        at = self.slot[at]
        key = np.unique(doc[at >= 0] * len(self.weight) + at[at >= 0])
        return key // max(1, len(self.weight)), key % max(1, len(self.weight))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.active(texts), len(texts)), -30, 30)))


def fit_machine(row: np.ndarray, col: np.ndarray, y: np.ndarray, slots: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Full-batch Adam on the logistic loss with an L2 penalty; deterministic."""
    n, rng = len(y), np.random.default_rng(SEED)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    p = {"b": np.array([np.log(share / (1 - share))]), "w": np.zeros(slots), "v": rng.normal(0, 0.01, (slots, FACTORS))}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for t in range(1, EPOCHS * 5 + 1):
        sums = np.stack([np.bincount(row, p["v"][col, f], minlength=n) for f in range(FACTORS)], 1)
        z = Machine(col, p["b"][0], p["w"], p["v"]).margins(row, col, n)
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = {"b": np.array([e.mean()]), "w": np.bincount(col, e[row], minlength=slots) / n + SHRINK * p["w"] / n * 100}
        own = np.stack([np.bincount(col, e[row] * (sums[row, f] - p["v"][col, f]), minlength=slots) for f in range(FACTORS)], 1)
        g["v"] = own / n + SHRINK * p["v"] / n * 1000
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return float(p["b"][0]), p["w"], p["v"]


def fit(docs: DataFrame, labels: DataFrame, use: Column, column: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, slots: int = SLOTS) -> Machine:
    """Learn from the labelled rows for which ``use`` (a Column over doc_id)
    holds, at most ``max_rows`` of them, chosen by a hash of the id."""
    # one row an id, whatever repeats: at most max_rows, stored as all steps read them
    once = labelled_rows(docs, labels, use, column, label, max_rows).groupBy("doc_id", "y").agg(F.min_by(column, F.xxhash64(column)).alias(column))
    scratch = common.Scratch(docs.sparkSession, "labelled")
    rows = scratch.stored(once.select("doc_id", column, "y"))

    def slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hit = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for piece in common.slices(batch, column):
                at, doc = terms(common.values(piece, column))
                key = np.unique(doc * (1 << BITS) + at)
                y = piece.column(2).to_numpy(zero_copy_only=False)[key >> BITS]
                np.add.at(n, key & ((1 << BITS) - 1), 1)
                np.add.at(hit, key[y == 1] & ((1 << BITS) - 1), 1)
        at = np.flatnonzero(n > 0)
        for i in range(0, len(at), 1 << 16):
            k = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"slot": pa.array(k), "n": pa.array(n[k].astype(np.int64)), "hit": pa.array(hit[k].astype(np.int64))})

    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("hit")).first()
    none = np.full(1 << BITS, -1, np.int32)
    if not total["hit"] or total["hit"] == total["n"]:
        share = np.clip(total["hit"] / total["n"], 1e-3, 1 - 1e-3) if total["n"] else 0.5
        scratch.drop()
        return Machine(none, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    counts = rows.mapInArrow(slot_counts, "slot long, n long, hit long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).where("n >= 2")
    rate = total["hit"] / total["n"]
    x_log = lambda x, p: F.when(x > 0, x * F.ln(x / p)).otherwise(0.0)
    ratio = x_log(F.col("hit"), F.col("n") * rate) + x_log(F.col("n") - F.col("hit"), F.col("n") * (1 - rate))
    best = [r["slot"] for r in counts.where(F.col("hit") > 0).orderBy(F.round(ratio, 9).desc(), "slot").select("slot").limit(slots).collect()]
    none[best] = np.arange(len(best))
    machine = Machine(none, 0.0, np.zeros(len(best)), np.zeros((len(best), FACTORS)))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, column):
                doc, at = shared.value.active(common.values(piece, column))
                n = np.bincount(doc, minlength=piece.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists, piece.column(2)], names=["doc_id", "slots", "y"])

    data = rows.mapInArrow(selected, "doc_id long, slots array<int>, y int").orderBy("doc_id").toPandas()
    n = data["slots"].map(len).to_numpy()
    row, col = np.repeat(np.arange(len(n)), n), np.concatenate([*data["slots"], np.zeros(0, np.int32)]).astype(np.int64)
    shared.unpersist()
    scratch.drop()
    return Machine(none, *fit_machine(row, col, data["y"].to_numpy(float), len(best)))


def score(docs: DataFrame, machine: Machine, column: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # 4 MB of slots and at most SLOTS weights
    added = {"score": T.DoubleType(), "predicted": T.IntegerType()}
    rest = [c for c in docs.columns if c not in added]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(n, t) for n, t in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, column):
                s = shared.value.scores(common.values(piece, column))
                cols = [piece.column(piece.schema.get_field_index(c)) for c in rest]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*rest, *added])

    return docs.mapInArrow(run, schema)
