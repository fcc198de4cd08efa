"""Quality by a sparse rule ensemble.

Boosted shallow trees over statistics of the text are fitted to the labels;
every path from a root to a node is a rule, a conjunction of comparisons. A
lasso-penalised logistic regression over the rules leaves few of them, and
those are compiled into one Spark column expression over the statistics.

Edge cases: a null or empty text has statistics of 0 and is scored like any
other; null labels aren't used; without labelled rows of both classes the score
is the class's share (0.5 if there is none), and an empty table has no scores.
Columns of the input are kept; statistics, ``score`` and ``predicted`` replace
columns of their names. Rows that repeat an id are scored each by its text; in
the fit they count once, by the smallest statistics, and of labels that disagree
the smallest counts. A text is held whole, with some 60 bytes of working memory
a byte.
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
from vicinal.llm.textscan import CONTINUES, WHITE, Scan, table

#: Labelled rows that the rules are fitted on, at most (chosen by hash).
MAX_ROWS = 20_000
TREES, DEPTH, BINS, STEP, LEAST_ROWS = 40, 3, 32, 0.3, 20
PENALTY, ITERATIONS = 2e-3, 400
THRESHOLD = 0.3

_CLASSES = {
    "symbols": table(b"#*$%&|<>"),
    "pipes": table(b"|"),
    "exclamations": table(b"!"),
    "capitals": table(bytes(range(65, 91))),
    "digits": table(bytes(range(48, 58))),
    "points": table(b".,;:?"),
    "line_feeds": table(b"\n"),
}
_CHARS = ~WHITE & ~CONTINUES
STATISTICS = ("n_words", "word_length", *(f"{c}_per_word" for c in _CLASSES), "distinct_words", "repeated_words", "repeated_lines", "top_word")


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """``STATISTICS`` of each text, all finite."""
    s = Scan(texts)
    n = s.n_words.astype(float)
    per = np.maximum(n, 1)
    h, doc = s.word_hashes, s.words[2]
    out = {"n_words": n, "word_length": s.count(_CHARS) / per}
    out |= {f"{c}_per_word": s.count(t) / per for c, t in _CLASSES.items()}
    out["distinct_words"] = s.per_doc(doc[s.first_in_doc(h, doc)]) / per
    out["repeated_words"] = s.n_repeat_words(5) / per
    lines, dup = s.n_dup_lines()
    out["repeated_lines"] = dup / np.maximum(lines, 1)
    out["top_word"] = _most(h, doc, s.n) / per
    return out


def _most(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How often each text's most frequent word occurs."""
    out = np.zeros(n)
    if len(h):
        order = np.lexsort((h, doc))
        fresh = np.flatnonzero(np.r_[True, (np.diff(doc[order]) != 0) | (h[order][1:] != h[order][:-1])])
        np.maximum.at(out, doc[order][fresh], np.diff(np.r_[fresh, len(h)]))
    return out


#: A comparison: statistic, limit, and whether the value must exceed it.
Condition = tuple[str, float, bool]


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[float, tuple[Condition, ...]]]

    def column(self) -> Column:
        """The score as an expression over the statistics' columns."""
        z = F.lit(self.bias)
        for weight, rule in self.rules:
            holds = F.lit(True)
            for name, limit, above in rule:
                c = F.col(name)
                holds = holds & (c > limit if above else c <= limit)
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _tree(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> list[tuple[np.ndarray, tuple[tuple[int, int, bool], ...], float]]:
    """Nodes of a regression tree: members, path and value; leaves have one."""
    out, todo = [], [(np.arange(len(grad)), ())]
    while todo:
        rows, path = todo.pop()
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, -1, -1)
        if len(path) < DEPTH:
            for f in range(bins.shape[1]):
                b = bins[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, minlength=BINS)) for w in (grad[rows], hess[rows], None))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        _, f, k = best
        leaf = f < 0
        out.append((rows, path, -g / (h + 1) if leaf else None))
        if not leaf:
            above = bins[rows, f] > k
            todo += [(rows[above], (*path, (f, k, True))), (rows[~above], (*path, (f, k, False)))]
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATISTICS) -> Ensemble:
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Ensemble(base, [])
    limits = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(limits[f], x[:, f], side="left") for f in range(x.shape[1])], 1)
    z, paths = np.full(len(y), base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        for rows, path, value in _tree(bins, p - y, p * (1 - p)):
            if path:
                paths.setdefault(tuple(sorted(set(path))), None)
            if value is not None:
                z[rows] += STEP * value
    rules = []
    for path in paths:
        holds = np.ones(len(y), bool)
        for f, k, above in path:
            holds &= (bins[:, f] > k) == above
        rules.append(holds)
    a = np.stack(rules, 1).astype(float)
    a, first = np.unique(a, axis=1, return_index=True)
    paths = [list(paths)[i] for i in first]
    w, bias = _lasso(a, y, base)
    kept = [(float(w[j]), tuple((names[f], float(limits[f][k]), above) for f, k, above in paths[j])) for j in np.flatnonzero(w)]
    return Ensemble(bias, kept)


def _lasso(a: np.ndarray, y: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the bias isn't penalised."""
    a1 = np.c_[a, np.ones(len(y))]
    step = 4 * len(y) / max(np.linalg.norm(a1, 2) ** 2, 1e-9)
    w = v = np.r_[np.zeros(a.shape[1]), bias]
    t = 1.0
    for _ in range(ITERATIONS):
        p = 1 / (1 + np.exp(-np.clip(a1 @ v, -30, 30)))
        new = v - step * (a1.T @ (p - y)) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * PENALTY, 0)
        t, s = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (s - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


def with_statistics(docs: DataFrame, column: str = "text") -> DataFrame:
    rest = [c for c in docs.columns if c not in STATISTICS]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(n, T.DoubleType()) for n in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, column):
                found = statistics(common.values(piece, column))
                cols = [piece.column(piece.schema.get_field_index(c)) for c in rest]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(found[n], pa.float64()) for n in STATISTICS], names=[*rest, *STATISTICS])

    return docs.mapInArrow(run, schema)


def labelled_rows(docs: DataFrame, labels: DataFrame, use: Column, column: str, label: str, max_rows: int) -> DataFrame:
    """doc_id, ``column`` and y of the documents of at most ``max_rows`` labelled
    ids, chosen by a hash of the id; of labels that disagree the smallest counts."""
    own = labels.where(use & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", column).join(F.broadcast(chosen), "doc_id")  # at most max_rows pairs of numbers


def fit(docs: DataFrame, labels: DataFrame, use: Column, column: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> Ensemble:
    """Learn from the labelled rows for which ``use`` (a Column over doc_id)
    holds, at most ``max_rows`` of them, chosen by a hash of the id."""
    rows = with_statistics(labelled_rows(docs, labels, use, column, label, max_rows), column)
    data = rows.groupBy("doc_id", "y").agg(F.min(F.struct(*STATISTICS)).alias("x")).select("y", "doc_id", "x.*").toPandas().sort_values("doc_id")  # at most max_rows
    return fit_rules(data[list(STATISTICS)].to_numpy(float), data["y"].to_numpy(float))


def score(docs: DataFrame, ensemble: Ensemble, column: str = "text") -> DataFrame:
    """Add the statistics, ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on)."""
    out = with_statistics(docs.select(*(c for c in docs.columns if c not in ("score", "predicted"))), column)
    out = out.withColumn("score", ensemble.column())
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
