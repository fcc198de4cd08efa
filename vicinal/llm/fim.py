"""Fill-in-the-middle rewriting of documents.

A text is cut into units (runs of ASCII letters, or one other code point) by a
matcher that streams: a first pass counts the units, a second moves a lazy match
iterator on to the two drawn ranks and takes the code-point offsets there. No
list of units is ever held, so memory is the text and its rewriting, whatever
the number of units.

Edge cases: a null text counts as empty and stays plain with no units, as does
an empty one. A text that contains a sentinel stays plain, so that every
rewriting can be undone. A null id draws as the empty string would. Rows that
repeat an id are rewritten with the same draws. An empty table gives none. Other
columns go through, whatever their names; one called like a result is replaced.
"""

from __future__ import annotations

import re
from collections import deque
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm import common

#: A unit, and the sentinels of the three parts.
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts about so many are rewritten, and of 100 rewritten ones about so
#: many start with the suffix.
REWRITTEN, SUFFIX_FIRST = 90, 20
FIELDS = [("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")]


def draws(doc_id: object, seed: int) -> list[int]:
    """Four unsigned 32-bit draws of a document."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def count(text: str) -> int:
    """First pass: the number of units."""
    last = deque(enumerate(UNIT.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def offsets(text: str, lower: int, upper: int) -> tuple[int, int]:
    """Second pass: where the first ``lower`` and the first ``upper`` units end."""
    units = UNIT.finditer(text)
    a = next(islice(units, lower - 1, None)).end() if lower else 0
    b = next(islice(units, upper - lower - 1, None)).end() if upper > lower else a
    return a, b


def rewrite(text: str, doc_id: object, seed: int, rewritten: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the output of a text."""
    n, (h1, h2, h3, h4) = count(text), draws(doc_id, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rewritten:
        return n, "plain", None, None, text
    a, b = offsets(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = 1, rewritten: int = REWRITTEN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the columns of ``FIELDS``."""
    names = {name for name, _ in FIELDS}
    keep = [f for f in docs.schema.fields if f.name not in names]
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in keep), *(f"{n} {t}" for n, t in FIELDS)])
    kinds = {"long": pa.int64(), "string": pa.large_string()}

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        at = piece.schema.get_field_index
        rows = zip(piece.column(at("text")), piece.column(at("doc_id")), strict=True)
        out = list(zip(*(rewrite(t.as_py() or "", i.as_py(), seed, rewritten, suffix_first) for t, i in rows), strict=True))
        new = [pa.array(x, kinds[kind]) for x, (_, kind) in zip(out, FIELDS, strict=True)]
        return pa.RecordBatch.from_arrays([*piece.columns, *(x.cast(pa.string()) if pa.types.is_large_string(x.type) else x for x in new)], names=[*piece.schema.names, *(n for n, _ in FIELDS)])

    return common.map_batches(docs.select(*(F.col(f"`{f.name.replace('`', '``')}`") for f in keep)), run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that a rewriting was made of: its three parts in their order."""
    part = F.split(output, "<[PSM]>", 4)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
