"""Secrets in texts, by patterns and by sliding-window entropy; DataFrame functions only.

Three patterns find the base spans. Besides, runs of a character class of at
least ``WINDOW`` characters are candidates, unless the allow-list knows them. A
window of ``WINDOW`` characters slides over a candidate and keeps
``s = sum(c * log2 c)`` over the counts ``c`` of its characters: the character
that enters raises its count, and s by the step of that count; the one that
leaves lowers its count, and s by that step. The window's Shannon entropy is
``log2(WINDOW) - s / WINDOW``. Windows with enough of it (and of digits and
letters) are hits; hits that touch are one span, which is dropped where a base
span covers it. s is kept in millionths, as whole numbers.

All work on a text is local to its row: one scan, no shuffle. Positions are
running sums over blocks of ``BLOCK`` matches, so texts with very many matches
stay near linear, and candidates are cut into pieces of ``PIECE`` characters
that overlap by a window less one, so a run of any length is covered whole.

Edge cases: a null text counts as empty and has no spans. Positions are code
points, ends exclusive. Matches of one kind don't overlap; those of different
kinds may. Rows that repeat an id are scanned each by itself; an empty table
gives none. Other columns go through, whatever their names; one called like a
result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the sliding window.
WINDOW = 20
#: Characters of a candidate that are folded together, and matches of a block.
PIECE, BLOCK = 256, 256

#: Words before an assigned secret, and the patterns of the base kinds.
NAMES = ["password", "passwd", "secret", "token", "api_?key"]
_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = f"({'|'.join(map(_either, NAMES))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Character classes: kind, characters, least bits of a window, and the least
#: number of its digits, upper-case and lower-case letters, and letters.
CLASSES = [
    ("entropy_hex", "0-9A-Fa-f", 3.0, {"digit": 2, "letter": 2}),
    ("entropy_base64", "0-9A-Za-z+/_-", 3.8, {"digit": 1, "upper": 1, "lower": 1}),
]
KINDS = ["assign", "access", "hex", *(c[0] for c in CLASSES)]
SETS = {"digit": "0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz"}
SETS["letter"] = SETS["upper"] + SETS["lower"]

#: Candidates that hold no secret, whole or by a part of them.
ALLOW = [
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]", r"[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]", r"[Dd][Uu][Mm][Mm][Yy]", r"[Rr][Ee][Dd][Aa][Cc][Tt][Ee][Dd]", r"[Ss][Aa][Mm][Pp][Ll][Ee]",
    r"0123456789", r"[Aa][Bb][Cc][Dd][Ee][Ff][Gg]", r"[Qq][Ww][Ee][Rr][Tt][Yy]", r"[Xx]{4}",
]


def weight(count: int) -> int:
    """c * log2 c in millionths."""
    return round(1e6 * count * log2(count)) if count else 0


def most(bits: float) -> int:
    """The largest s of a window with at least so many bits."""
    return int(1e6 * WINDOW * (log2(WINDOW) - bits))


def running(a: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Prefix folds of an array of longs by an associative ``merge``: within
    blocks, then over the blocks' totals."""
    none = F.array().cast("array<long>")

    def fold(x: Column) -> Column:
        return F.aggregate(x, none, lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) == 0, v).otherwise(merge(F.element_at(acc, F.greatest(F.size(acc), F.lit(1))), v)))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))
    one = F.transform(F.array(blocks), lambda bs: F.transform(F.array(fold(F.transform(bs, lambda b: F.element_at(b, -1)))), lambda t: F.flatten(F.transform(bs, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda v: merge(t[F.greatest(i - 1, F.lit(0))], v))))))[0])[0]
    return F.when(F.size(a) <= 1, a).when(F.size(a) <= BLOCK, fold(a)).otherwise(one)


class _Steps:
    """Columns of intermediate results under names that ``df`` has not."""

    def __init__(self, df: DataFrame):
        self.df, self.taken = df, {c.lower() for c in df.columns}

    def put(self, value: Column) -> Column:
        k = len(self.taken)
        while (name := f"_step{k}") in self.taken:
            k += 1
        self.taken.add(name)
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def found(self, text: Column, pattern: str) -> tuple[Column, Column]:
        """All matches of ``pattern`` from left to right, and where they start:
        the lengths of what lies before and between them, added up."""
        m = self.put(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        between = self.put(F.when(F.size(m) > 0, F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))))
        steps = self.put(F.transform(m, lambda x, i: between[i] + F.when(i == 0, F.lit(0)).otherwise(F.length(m[F.greatest(i - 1, F.lit(0))]))))
        return m, self.put(running(steps, lambda x, y: x + y))

    def spans(self, kind: str, matches: Column, starts: Column) -> Column:
        at = F.zip_with(matches, starts, lambda m, s: span(kind, s, s + F.length(m)))
        return self.put(at)


def span(kind: str, start: Column, end: Column) -> Column:
    """Ordered by start, then kind as listed."""
    return F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.cast("long").alias("end"), F.lit(kind).alias("kind"))


def base(steps: _Steps, text: Column) -> list[Column]:
    """The spans of the three patterns, one array a kind."""
    m, s = steps.found(text, ASSIGN)
    assign = steps.put(F.filter(F.zip_with(m, s, lambda x, a: F.struct(x.alias("m"), a.alias("s"))), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= LEAST_ASSIGNED))
    out = [steps.put(F.transform(assign, lambda x: span("assign", x["s"], x["s"] + F.length(x["m"]))))]
    # a run is matched whole, so the least length may stand in the pattern
    for kind, pattern in (("access", f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}"), ("hex", f"[0-9a-f]{{{LEAST_HEX},}}")):
        out.append(steps.spans(kind, *steps.found(text, pattern)))
    return out


def sums(text: Column) -> Column:
    """s of the window that ends at each character of a piece (shorter windows
    first), after a leading 0."""
    step = F.array(*(F.lit(weight(c) - weight(c - 1) if c else 0) for c in range(WINDOW + 1))).cast("array<long>")
    same = lambda part, ch: F.length(part) - F.length(F.replace(part, ch, F.lit("")))

    def slide(acc: Column, j: Column) -> Column:
        ch, before = F.substring(text, j, F.lit(1)), F.substring(text, F.greatest(j - WINDOW + 1, F.lit(1)), F.least(j - 1, F.lit(WINDOW - 1)))
        enters = step[1 + same(before, ch)]
        first = F.greatest(j - WINDOW, F.lit(1))
        leaves = F.when(j > WINDOW, step[same(F.substring(text, first, F.lit(WINDOW)), F.substring(text, first, F.lit(1)))]).otherwise(F.lit(0))
        return F.concat(acc, F.array(F.element_at(acc, -1) + enters - leaves))

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.array(F.lit(0).cast("long")), slide)


def entropy(steps: _Steps, text: Column, kind: str, chars: str, bits: float, least: dict[str, int], allow: list[str]) -> Column:
    """Spans of windows of one character class with ``bits`` or more."""
    m, s = steps.found(text, f"[{chars}]{{{WINDOW},}}")
    has = lambda c: [c.rlike(f"[{''.join({'digit': '0-9', 'upper': 'A-Z', 'lower': 'a-z', 'letter': 'A-Za-z'}[k])}]") for k in least]

    def wanted(c: Column) -> Column:
        ok = has(c["m"])
        keep = ok[0]
        for x in ok[1:]:
            keep = keep & x
        return keep & ~c["m"].rlike("|".join(f"(?:{p})" for p in allow)) if allow else keep

    left = steps.put(F.filter(F.zip_with(m, s, lambda x, a: F.struct(x.alias("m"), a.alias("s"))), wanted))
    cut = f"(?=(.{{1,{PIECE + WINDOW - 1}}})).{{1,{PIECE}}}"
    pieces = steps.put(F.flatten(F.transform(left, lambda c: F.transform(F.regexp_extract_all(c["m"], F.lit(cut), F.lit(1)), lambda p, b: F.struct(p.alias("p"), (c["s"] + b * PIECE).alias("at"))))))
    folded = steps.put(F.transform(pieces, lambda x: sums(x["p"])))

    def hits(x: Column, s: Column) -> Column:
        def hit(j: Column) -> Column:
            part, ok = F.substring(x["p"], j - WINDOW + 1, F.lit(WINDOW)), s[j] <= most(bits)
            for k, n in least.items():
                ok = ok & (WINDOW - F.length(F.translate(part, SETS[k], "")) >= n)
            return ok

        ends = F.when(F.length(x["p"]) >= WINDOW, F.sequence(F.lit(WINDOW), F.length(x["p"]))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(ends, hit), lambda j: x["at"] + j - WINDOW)

    at = steps.put(F.flatten(F.zip_with(pieces, folded, hits)))
    first = steps.put(F.filter(at, lambda x, i: (i == 0) | (x > at[F.greatest(i - 1, F.lit(0))] + WINDOW)))
    last = steps.put(F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.coalesce(F.get(at, i + 1), x) > x + WINDOW)))
    return steps.put(F.zip_with(first, last, lambda a, b: span(kind, a, b + WINDOW)))


def scan(docs: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """``docs`` (text, ...) with ``n_assign``, ``n_access``, ``n_hex`` and ``spans``,
    an array of (kind, start, end) by start, then kind. ``allow``: patterns of
    candidates that are no secrets."""
    results = {"n_assign", "n_access", "n_hex", "spans"}
    keep = [c for c in docs.columns if c.lower() not in results]
    quoted = [F.col(f"`{c.replace('`', '``')}`") for c in keep]
    steps = _Steps(docs.select(*quoted))
    text = steps.put(F.coalesce(F.col("text"), F.lit("")))
    known = base(steps, text)
    more = [entropy(steps, text, *c, ALLOW if allow is None else allow) for c in CLASSES]
    every = steps.put(F.array_sort(F.concat(*known, *more)))
    # of all base spans that start no later, how far the longest reaches
    covered = steps.put(running(F.transform(every, lambda x: F.when(x["rank"] < len(known), x["end"]).otherwise(F.lit(-1).cast("long"))), lambda x, y: F.greatest(x, y)))
    stays = F.filter(every, lambda x, i: (x["rank"] < len(known)) | (covered[i] < x["end"]))
    spans = F.transform(stays, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    counts = [F.size(a).cast("long").alias(n) for a, n in zip(known, ("n_assign", "n_access", "n_hex"), strict=True)]
    return steps.df.select(*quoted, *counts, spans.alias("spans"))


def written(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of each span, comma-joined; of some kinds only."""
    some = spans if kinds is None else F.filter(spans, lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
