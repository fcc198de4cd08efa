"""Fill-in-the-middle rewriting against a plain unit list."""

import hashlib
import random
import re

from vicinal.llm import fim

DOCS = "doc_id long, text string, n string, output string, _id string"


def brute(text, doc_id):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    d = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rewriting_is_brute_force_and_can_be_undone(spark):
    rnd = random.Random(5)
    bits = ["a", "Ab", "é", "中", "\n", "\r\n", " ", "😀", "1", "<", "P>", "<M", "zzz", "\x00", "'"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += ["", None, "x", "é", "has <P> in it", "<S>", "a<M>b", "word " * 30_000, "\n" * 5000]
    df = spark.createDataFrame([(i, t, "n", "o", "x") for i, t in enumerate(texts)], DOCS)
    out = fim.transform(df)
    rows = out.withColumn("back", fim.restored(out["output"], out["form"])).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id] or "", r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
        assert r.back == (texts[r.doc_id] or "") and r._id == "x"
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_ids_that_are_null_or_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(None, "one two three"), (7, "one two three"), (7, "one two three"), (None, None)], "doc_id long, text string")
    rows = fim.transform(df).collect()
    same = [r for r in rows if r.doc_id == 7]
    assert len(rows) == 4 and same[0] == same[1]
    assert [r.form for r in rows if r.text is None] == ["plain"]
    assert fim.transform(df.limit(0)).count() == 0


def test_ranks_move_one_iterator_on():
    assert fim.offsets("ab, cd", 0, 0) == (0, 0)
    assert fim.offsets("ab, cd", 1, 4) == (2, 6)
    assert fim.offsets("ab, cd", 2, 2) == (3, 3)
    assert fim.count("") == 0 and fim.count("ab, cd") == 4
