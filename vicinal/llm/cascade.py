"""Quality rules as a short-circuit cascade.

Base counts are taken of every text. Texts that pass the base rule go through
further rules; each rule only sees what the rules before it let through. The
order follows rejections per cost, both measured by tasks on a random sample of
about ``SAMPLE_ROWS`` rows. As a text is kept only if no rule rejects it, the
order changes the work, never the verdict. ``rejected_by`` names the rule that
rejected first in the order that was run, which may differ between runs where
several rules would reject; no other column depends on measured times.

Edge cases: a null or empty text has no words and fails the base rule; rows
that repeat are judged alike; columns of the input are kept, and those named
like a result are replaced. On an empty table the rules keep their given order.
A text of any length is judged whole, with some 60 bytes of working memory a byte.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.llm import common
from vicinal.llm.textscan import CONTINUES, WHITE, Scan, table

#: Rows of the sample that orders the rules, about.
SAMPLE_ROWS, SEED = 2000, 7
#: The symbols that are counted, and the base rule's limits.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
#: Of the hashes that say which lines and words are equal in a text: a process's own.
KEY = common.run_key()
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL, _LETTERS, _UPPER = table(SYMBOLS), table(bytes([*range(65, 91), *range(97, 123)])), table(bytes(range(65, 91)))
_CHARS = ~WHITE & ~CONTINUES


@dataclass(frozen=True)
class Rule:
    """``rejects(scan, base)``: a flag for each text; ``base`` has the counts."""

    name: str
    rejects: Callable[[Scan, dict[str, np.ndarray]], np.ndarray]


def _distinct(scan: Scan, base: dict) -> np.ndarray:
    first = scan.first_in_doc(scan.word_hashes, scan.words[2])
    return (base["n_words"] >= 50) & (100 * scan.per_doc(scan.words[2][first]) < 10 * base["n_words"])


#: Limits are whole per cents, so that no rounding decides.
RULES = (
    Rule("symbols", lambda s, b: 100 * b["n_symbols"] > 10 * b["n_words"]),
    Rule("dup_lines", lambda s, b: 100 * b["n_dup_lines"] > 30 * s.n_dup_lines()[0]),
    Rule("word_length", lambda s, b: (b["word_chars"] < 2 * b["n_words"]) | (b["word_chars"] > 15 * b["n_words"])),
    Rule("capitals", lambda s, b: 100 * s.count(_UPPER) > 40 * s.count(_LETTERS)),
    Rule("exclamations", lambda s, b: 100 * s.count(table(b"!")) > 30 * b["n_words"]),
    Rule("distinct_words", _distinct),
)


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    s = Scan(texts, key=KEY)
    return {
        "n_words": s.n_words,
        "word_chars": s.count(_CHARS),
        "n_symbols": s.count(_SYMBOL),
        "n_dup_lines": s.n_dup_lines()[1],
        "n_repeat_words": s.n_repeat_words(WINDOW),
    }


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])


def cascade(texts: list[bytes], base: dict[str, np.ndarray], rules: list[Rule]) -> np.ndarray:
    """The number in ``rules`` of a rule that rejects each text; -1: kept, -2: base."""
    out, scan, seen = np.where(base_failed(base), -2, -1), None, -1
    for k, rule in enumerate(rules):
        left = np.flatnonzero(out == -1)
        if not len(left):
            break
        if len(left) != seen:  # the rule before let fewer through
            scan, counts, seen = Scan([texts[i] for i in left], key=KEY), {n: v[left] for n, v in base.items()}, len(left)
        out[left[rule.rejects(scan, counts)]] = k
    return out


def order(df: DataFrame, column: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(name, cost in seconds a text, share rejected) of each rule on a sample
    of about ``rows`` rows, best first: by rejections per cost."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, hits, seen = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in batches:
            for piece in common.slices(batch, column):
                texts = common.values(piece, column)
                base = base_counts(texts)
                left = np.flatnonzero(~base_failed(base))
                some, counts = [texts[i] for i in left], {n: v[left] for n, v in base.items()}
                seen += len(left)
                for k, r in enumerate(rules if len(left) else ()):
                    r.rejects(Scan(some[:1], key=KEY), {n: v[:1] for n, v in counts.items()})
                    began = time.thread_time()
                    hits[k] += r.rejects(Scan(some, key=KEY), counts).sum()
                    cost[k] += time.thread_time() - began
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "cost": cost, "hits": hits, "seen": [seen] * len(rules)})

    some = df.select(column).sample(min(1.0, rows / max(df.count(), 1)), SEED)
    parts = some.mapInArrow(measure, "rule long, cost double, hits long, seen long")
    found = {r["rule"]: r for r in parts.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("cost", "hits", "seen"))).collect()}  # a row a rule
    if not any(r["seen"] for r in found.values()):
        return [(r.name, 0.0, 0.0) for r in rules]
    out = [(r.name, max(found[k]["cost"], 1e-6) / found[k]["seen"], found[k]["hits"] / found[k]["seen"]) for k, r in enumerate(rules)]
    return sorted(out, key=lambda x: -x[2] / x[1])


def apply(df: DataFrame, column: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add the base counts, ``base_failed``, ``rejected_by`` (null if kept) and ``kept``."""
    names = [n for n, _, _ in order(df, column, rules, rows)]
    by = {r.name: r for r in rules}
    added = {n: T.LongType() for n in BASE} | {"base_failed": T.BooleanType(), "rejected_by": T.StringType(), "kept": T.BooleanType()}
    rest = [c for c in df.columns if c not in added]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(n, t) for n, t in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [by[n] for n in names]
        labels = np.array([*names, "base", ""], object)
        for batch in batches:
            for piece in common.slices(batch, column):
                texts = common.values(piece, column)
                base = base_counts(texts)
                hit = cascade(texts, base, own)
                cols = [piece.column(piece.schema.get_field_index(c)) for c in rest]
                cols += [pa.array(base[n]) for n in BASE]
                cols += [pa.array(hit == -2), pa.array(labels[hit], pa.string(), mask=hit == -1), pa.array(hit == -1)]
                yield pa.RecordBatch.from_arrays(cols, names=[*rest, *added])

    return df.mapInArrow(run, schema)
