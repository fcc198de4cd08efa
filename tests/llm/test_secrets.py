"""Secret scans against a plain implementation, with built cases."""

import random
import re
from collections import Counter
from math import log2

import pytest

from vicinal.llm import secrets

DOCS = "doc_id long, text string, spans string, _step3 string, `a b` string"


def plain_entropy(text, chars, bits, least, allow):
    out = []
    test = {"digit": str.isdigit, "upper": str.isupper, "lower": str.islower, "letter": str.isalpha}
    for m in re.finditer(f"[{chars}]{{{secrets.WINDOW},}}", text):
        if any(re.search(p, m[0]) for p in allow):
            continue
        spans = []
        for k in range(len(m[0]) - secrets.WINDOW + 1):
            w = m[0][k : k + secrets.WINDOW]
            s = sum(round(1e6 * c * log2(c)) for c in Counter(w).values())
            if s <= int(1e6 * secrets.WINDOW * (log2(secrets.WINDOW) - bits)) and all(sum(map(test[n], w)) >= x for n, x in least.items()):
                a = m.start() + k
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = a + secrets.WINDOW
                else:
                    spans.append([a, a + secrets.WINDOW])
        out += spans
    return out


def brute(text, allow=secrets.ALLOW):
    found = {"assign": [], "access": [], "hex": []}
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            found["assign"].append(m.span())
    found["access"] = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found["hex"] = [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    known = [s for x in found.values() for s in x]
    spans = [(a, secrets.KINDS.index(k), b) for k, x in found.items() for a, b in x]
    for kind, *rest in secrets.CLASSES:
        spans += [(a, secrets.KINDS.index(kind), b) for a, b in plain_entropy(text, *rest, allow) if not any(x <= a and b <= y for x, y in known)]
    return {k: len(v) for k, v in found.items()}, ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def texts():
    rnd = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    bits = [
        lambda: "password", lambda: "Token", lambda: "aPi_KEY", lambda: "apikey", lambda: '"', lambda: "'", lambda: " ", lambda: ":", lambda: "=", lambda: " = ", lambda: "é", lambda: "😀", lambda: "\n",
        lambda: pick("0123456789abcdef", rnd.randint(1, 50)), lambda: pick(alphabet, rnd.randint(1, 60)), lambda: "AKIA" + pick("ABCDEFGHIJ0123", rnd.randint(1, 30)), lambda: pick("0123456789ABCDEF", rnd.randint(15, 40)),
        lambda: "internationalizationWithoutDigits", lambda: "aB1" * 12, lambda: "ſecret=abcdefgh",
    ]
    out = ["".join(rnd.choice(bits)() for _ in range(rnd.randint(0, 25))) for _ in range(250)]
    out += ["", None, "password=token:abcdefgh", "é token=secret=abcdefgh", "tokens: abcdef", "secret:abcde", "AKIAABCDEFGH AKIA" + "Z" * 16]
    out += [f"id 123e4567-e89b-12d3-a456-426614174000 {pick(alphabet, 8)}EXAMPLEkey{pick(alphabet, 30)}1aB"]
    out += [pick(alphabet, 1500), "x" * 700 + pick(alphabet, 40) + "x" * 700, pick("0123456789ABCDEF", 900), "a" * 3000]
    out += [" token=abcdef1" * 900, f"{pick(alphabet, 30)} " * 600]
    return out


def test_spans_are_brute_force(spark):
    given = texts()
    df = spark.createDataFrame([(i, t, "s", "own", "c") for i, t in enumerate(given)], DOCS)
    rows = secrets.scan(df).select("*", secrets.written(secrets.F.col("spans")).alias("w")).collect()
    assert len(rows) == len(given) and {(r._step3, r["a b"]) for r in rows} == {("own", "c")}
    kinds = Counter()
    for r in rows:
        counts, spans = brute(given[r.doc_id] or "")
        assert {"assign": r.n_assign, "access": r.n_access, "hex": r.n_hex} == counts, given[r.doc_id]
        assert r.w == spans, given[r.doc_id]
        kinds.update(s.kind for s in r.spans)
    assert set(kinds) == set(secrets.KINDS)


def test_allow_list_suppresses_candidates_only(spark):
    key = "k3Yz9QpLm2XvB7nRt5Wc8Jd4"
    df = spark.createDataFrame([(1, f"{key} token={key}")], "doc_id long, text string")
    with_all = secrets.scan(df, []).first()
    assert [s.kind for s in with_all.spans] == ["entropy_base64", "assign"]
    less = secrets.scan(df, [f"^{key}$"]).first()
    assert [s.kind for s in less.spans] == ["assign"] and less.n_assign == 1
    assert secrets.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 512, 700])
def test_running_sums_over_blocks(spark, n):
    rnd = random.Random(n)
    a = [rnd.randint(-9, 9) for _ in range(n)]
    df = spark.createDataFrame([(a,)], "a array<long>")
    F = secrets.F
    got = df.select(secrets.running(F.col("a"), lambda x, y: x + y).alias("s"), secrets.running(F.col("a"), lambda x, y: F.greatest(x, y)).alias("m")).first()
    assert got.s == [sum(a[: k + 1]) for k in range(n)] and got.m == [max(a[: k + 1]) for k in range(n)]
