"""The whole pipeline against plain code, on documents whose fate is known by construction."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline as p
from vicinal.llm import toxicity

tokenizers = pytest.importorskip("tokenizers")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fixture(rnd):
    """Documents (doc_id, text) of distinct words, with copies, and what is planted."""
    fresh = iter(range(10**6))
    words = lambda n: [f"w{next(fresh)}x" for _ in range(n)]
    shared, passage = "a line that many documents share", words(14)
    docs, groups = {}, []
    for i in range(40):
        docs[i] = " ".join(words(60)) + (f"\n{shared}" if i < 12 else "") + "\nlast " + " ".join(words(5))
    for i in range(40, 46):  # near copies of 0 .. 5: one word of 66 changed
        own = docs[i - 40].split(" ")
        own[30] = f"changed{i}"
        docs[i] = " ".join(own)
        groups.append({i - 40, i})
    docs[46], docs[47] = docs[7], docs[7]
    groups.append({7, 46, 47})
    for i in (20, 21):  # in the midst of the first line
        own = docs[i].split(" ")
        docs[i] = " ".join(own[:20] + passage + own[20:])
    docs[48] = " ".join(passage)  # nothing else: it goes
    docs[49], docs[50] = None, ""
    for i in range(51, 90):
        docs[i] = " ".join(words(20) + ["idiot", "stupid"] * 3) if i % 2 else " ".join(words(26))
    return docs, groups, shared, passage


def test_pipeline_is_plain_code(spark, tmp_path):
    docs, groups, shared, passage = fixture(random.Random(3))
    rows = [(i, t, "en", "s", -1 if t is None else len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    toxic = {i for i in range(51, 90) if i % 2}
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in docs], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("b1", " ".join(passage)), ("b2", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in p.run(spark, str(tmp_path)).collect()}

    # 1: the machine's own margins decide; here they must find what was planted
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    machine = toxicity.fit(table, spark.read.parquet(str(tmp_path / "labels.parquet")), p.queries._remainder(4) != 2)
    gone = {r.doc_id for r in toxicity.score(table, machine).where("predicted = 1").collect()}
    assert gone == toxic
    left = {i: t for i, t in docs.items() if i not in gone}
    # 2: lines in ten documents
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\r\x0b\x0c"))
    holders: dict = {}
    for i, t in left.items():
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, set()).add(i)
    often = {k for k, v in holders.items() if k and len(v) >= 10}
    assert often == {shared}
    left = {i: None if t is None else "\n".join(x for x in t.split("\n") if key(x) not in often) for i, t in left.items()}
    # 3: one document of each group
    for group in groups:
        for i in group - {min(group)}:
            del left[i]
    # 4: spans of benchmark windows
    def cut(t):
        found = list(WORD.finditer(t or ""))
        hit = set()
        for a in range(len(found) - 9):
            if any([m[0] for m in found[a : a + 10]] == passage[b : b + 10] for b in range(5)):
                hit.update(range(a, a + 10))
        spans = [(found[a].start(), found[a].end()) for a in sorted(hit)]
        for a, b in zip(sorted(hit), sorted(hit)[1:]):
            if b == a + 1:
                spans.append((found[a].start(), found[b].end()))
        out = "".join(c for k, c in enumerate(t or "") if not any(a <= k < b for a, b in spans))
        return None if found and len(hit) == len(found) else out

    left = {i: cut(t) for i, t in left.items()}
    left = {i: t for i, t in left.items() if t is not None}
    assert 48 not in left and set(got) == set(left)
    # 5: the library's ids, and the text again
    lib = tokenizers.Tokenizer.from_file(p.queries.tokenizer("byte_bpe_50k.json"))
    for i, t in left.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), i
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
