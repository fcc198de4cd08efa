"""The prefix trie against plain lists of turns."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from vicinal.llm import common, prefixtrie

TURNS = "conv_id long, turn long, role string, text string, depth string, _at long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)


def brute(rows, group):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if group else 0
        base = own.get(c - int(math.fmod(c, group)), []) if group else []
        built[c] = base[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    own_saved = {p: (len(m) - 1) * len(p[-1][1]) if p else 0 for p, m in members.items()}
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own_saved[p]
    ends = {p: ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()), own, built


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(seed=3, n=150):
    rnd = random.Random(seed)
    pool = [[(rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "", None, "é😀", f"t{k}"])) for k in range(rnd.randint(1, 9))] for _ in range(12)]
    rows = []
    for c in [*rnd.sample(range(400), n), 10**12, 10**12 + 5, -3, -100, -205]:
        turns = rnd.choice(pool)[: rnd.randint(1, 9)] + [("user", f"own {rnd.randint(0, 3)}") for _ in range(rnd.randint(0, 3))]
        nos = rnd.sample(range(20), len(turns))
        nos.sort()
        rows += [(c, None if k == 0 and rnd.random() < 0.3 else no, r, t) for k, (no, (r, t)) in enumerate(zip(nos, turns, strict=True))]
    rows += [(7000, k, "user", f"long {k % 7}") for k in range(300)] + [(7001, k, "user", f"long {k % 7}") for k in range(280)] + [(7001, 280, "user", "other")]
    rows += [(8000, 1, "b", "tie"), (8000, 1, "a", "tie"), (8000, 1, "a", "tie"), (None, 1, "user", "nobody's"), (None, None, None, None)]
    rnd.shuffle(rows)
    return rows


def got(spark, rows, group):
    out = prefixtrie.build(frame(spark, rows), group)
    return sorted(((*(r[c] for c in COLUMNS),) for r in out.collect()), key=lambda r: r[:2]), out


@pytest.mark.parametrize("group", [0, 100])
def test_nodes_are_brute_force(spark, group):
    rows = table()
    have, out = got(spark, rows, group)
    want, own, built = brute(rows, group)
    assert have == want
    for r in out.where("depth > 0").collect():  # the turn that a node stands for
        assert own[r.src][r.at] == built[r.conv_id][r.depth - 1]


def test_colliding_fingerprints_are_split(spark, monkeypatch):
    rows = [r for r in table(4, 60) if r[0] not in (7000, 7001)]
    real = prefixtrie.prefixes
    weak = lambda *a: real(*a).withColumns({"f1": prefixtrie.F.col("f1") % 2, "f2": prefixtrie.F.lit(0).cast("long")})
    monkeypatch.setattr(prefixtrie, "prefixes", weak)
    assert got(spark, rows, 100)[0] == brute(rows, 100)[0]


def test_hot_first_turn_and_salted_representatives(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "SALTED", 3)
    monkeypatch.setattr(prefixtrie, "PIECE", 4)
    monkeypatch.setattr(prefixtrie, "HOT", 10)
    rows = [(c, 0, "user", "Hello") for c in range(90)] + [(c, 1, "assistant", f"{c % 5}") for c in range(0, 90, 2)]
    assert got(spark, rows, 0)[0] == brute(rows, 0)[0]
    assert got(spark, rows, 100)[0] == brute(rows, 100)[0]


def test_empty_tables_and_turnless_conversations(spark):
    assert got(spark, [], 100)[0] == []
    assert got(spark, [(None, 0, "user", "x")], 100)[0] == []
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(alone, 0, "user", "goes")]  # its source is absent and takes its only turn
    assert got(spark, rows, 100)[0] == brute(rows, 100)[0] == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_scan_goes_on_over_ranges(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 2, 2, 2, 2, 2, 3]), k, rnd.randint(0, 99), rnd.randint(-(1 << 62), 1 << 62)) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, o long, s long, x long")
    out = prefixtrie.scan(common.Scratch(spark, "scan"), df, "k", [prefixtrie.F.col("o").desc()], ["s"], "x").collect()
    for key in (1, 2, 3):
        n, total, f = 0, 0, [0, 0]
        own = {r.o: r for r in out if r.k == key}
        for _, o, s, x in sorted((r for r in rows if r[0] == key), key=lambda r: -r[1]):
            total += s
            f = [(f[i] + x * pow(b, n, p)) % p for i, (b, p) in enumerate(zip(prefixtrie.BASES, prefixtrie.MODULI, strict=True))]
            assert (own[o].at, own[o].s, own[o].f1, own[o].f2) == (n, total, *f)
            n += 1
