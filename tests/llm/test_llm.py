"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from vicinal.llm import bpe, cascade, common, decontam, linededup, omh, quality, sharding, tokenfile, toxicity, warc
from vicinal.llm.textscan import BREAK, Scan, mix

tokenizers = pytest.importorskip("tokenizers")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts, ["x"] * len(texts))), DOCS)


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def odd_texts(n=300, seed=1):
    rnd = random.Random(seed)
    bits = ["a", "b.", "c, ", " ", "  ", "\n", "\t", "é", "中", "'s", "12", " ", "　", "\x1c", "!", "<|endoftext|>", "Σ", "é", "😀", "İ", "The"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(n)] + ["", None, "a" * 3000, " " * 500]


def test_bpe_is_the_library_and_decodes(spark):
    texts = odd_texts()
    lib = tokenizers.Tokenizer.from_file(path("byte_bpe_50k.json"))
    for r in bpe.encode_decode(docs(spark, texts), path("byte_bpe_50k.json")).collect():
        want = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == lib.decode(want, skip_special_tokens=False) and r.score == "x"
    two = bpe.decode(bpe.encode(docs(spark, texts), path("byte_bpe_50k.json")), path("byte_bpe_50k.json"))
    assert all(r.decoded == (r.text or "") for r in two.collect())


def test_token_files_round_trip_by_frames(spark, monkeypatch):
    texts = odd_texts(200, 2)
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    ids[5] = ids[6]
    texts[7] = texts[8] = texts[9] = "same text"
    lib = tokenizers.Tokenizer.from_file(path("word_bpe_49k.json"))
    uri = common.shared_dir(spark, "ids")
    files = tokenfile.write(docs(spark, texts, ids), uri, path("word_bpe_49k.json"), 2)
    got = sorted((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in tokenfile.read(files, uri).collect())
    assert [g[1] for g in got] == sorted(ids)
    at, by = 0, {}
    for i, t in zip(ids, texts):
        by.setdefault(i, []).append(lib.encode(t or "", add_special_tokens=False).ids + [2])
    for start, i, x in got:
        assert start == at and x in by[i]
        at += len(x)


def test_token_files_end_by_ids(spark):
    texts = odd_texts(60, 5) + ["same text"] * 40
    ids = [*range(len(texts) - 40), *[7] * 40]
    uri = common.shared_dir(spark, "ids")
    files = tokenfile.write(docs(spark, texts, ids), uri, path("word_bpe_49k.json"), 2, file_ids=25)
    whole = tokenfile.write(docs(spark, texts, ids), common.shared_dir(spark, "ids"), path("word_bpe_49k.json"), 2)
    sizes = [r.n_tokens for r in files.collect()]
    assert len(sizes) > 20 and files.count() > whole.count() and max(sizes) < 25 + 3001
    rows = sorted(tokenfile.read(files, uri).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(ids) and [r.start for r in rows] == np.r_[0, np.cumsum([r.n_tokens for r in rows])[:-1]].tolist()


def test_blocks_are_visited_there_and_back(monkeypatch):
    from functools import lru_cache

    loads = []
    monkeypatch.setattr(decontam, "_block", lru_cache(maxsize=decontam.HELD)(lambda name: loads.append(name) or decontam.Block([], [])))
    for _ in range(5):
        decontam.search(Scan([b"one two three"], BREAK, lower=True), [f"b{k}" for k in range(9)])
    assert len(loads) == 9 + 4


def test_token_file_reader_takes_only_the_frames_it_needs(tmp_path):
    from pyarrow import fs

    local = fs.LocalFileSystem()
    p = str(tmp_path / "x")
    with local.open_output_stream(p, compression=None) as out:
        w = tokenfile.Writer(out)
        want = [np.arange(n, dtype=np.uint32) for n in (3, 70_000, 1, 5, 200_000, 2)]
        for i, x in enumerate(want):
            w.add(i, x)
        w.close()
    with local.open_input_file(p) as f:
        r = tokenfile.Reader(f)
        assert len(r.raw) == 4  # three of ids, one index
        assert r.read(5).tolist() == [0, 1] and r.frames_read == 1
        assert all((r.read(i) == x).all() for i, x in enumerate(want))
    data = bytearray(open(p, "rb").read())
    data[10] ^= 255
    open(p, "wb").write(data)
    with local.open_input_file(p) as f, pytest.raises(Exception):
        tokenfile.Reader(f).read(0)


def test_warc_round_trip_and_monolithic_input(spark):
    big = "<p>é" + "x" * 200
    pages = [(3, "http://a/ b", big), (1, None, big), (2, "http://c", "short"), (4, "u", "short"), (5, "u", None), (6, "u", big), (None, "u", "y" * 150)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    a, b = common.shared_dir(spark, "w"), common.shared_dir(spark, "w")
    whole = warc.write_monolithic(warc.with_types(df), a)
    fs, root = common.filesystem(a)
    for r in whole.collect():  # one gzip stream a file
        z = zlib.decompressobj(31)
        z.decompress(fs.open_input_file(f"{root}/{r.file}").read())
        assert z.eof and not z.unused_data
    files = warc.normalise(whole, a, b)
    got = {r.page_id: r for r in warc.read(warc.index(files, b), b).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), 6: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None), None: ("response", None)}
    for p, _, h in pages:
        assert got[p].payload_bytes == len((h or "").encode()) and got[p].payload_digest == hashlib.sha256((h or "").encode()).hexdigest()
    one = warc.read(warc.index(files, b).where("page_id = 2"), b).collect()
    assert [bytes(r.payload) for r in one] == [b"short"]
    empty = warc.write_monolithic(warc.with_types(df.limit(0)), common.shared_dir(spark, "w"))
    assert empty.count() == 0


def brute_windows(texts, items):
    words = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            iw = words(x)
            n = min(10, len(iw))
            wins = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if iw else set()
            for k in range(len(w) - n + 1) if iw else ():
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found.add(str(i))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block, shard", [(1, 50), (1 << 20, 400_000)])
def test_decontamination_is_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    real = decontam.search

    def search(*args):
        decontam.SHARD_WORDS = shard  # in the workers too
        return real(*args)

    monkeypatch.setattr(decontam, "search", search)
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(12)] + ["É", "the"]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.choice([1, 4, 10, 12, 30]))) for i in range(12)] + [(99, None), (98, ""), (7, say(15))]
    texts = [say(rnd.randint(0, 60)) for _ in range(40)] + [None, "", items[5][1].upper() + " tail", items[4][1] * 2, f"x. {items[3][1]}, y {items[2][1]}"]
    df = spark.createDataFrame(items, "item_id long, text string")
    rows = sorted(decontam.find(docs(spark, texts), df, clean="clean").collect())
    assert [(r.n_words, r.n_hit, list(r["items"])) for r in rows] == brute_windows(texts, items)
    for r in rows:
        raw, cut = (r.text or "").encode(), b""
        at = 0
        for s in r.spans:
            cut += raw[at : s.start]
            at = s.end
        assert (r.clean or "").encode() == cut + raw[at:]
    none = decontam.find(docs(spark, texts), df.limit(0)).collect()
    assert all(r.n_hit == 0 and not r["items"] for r in none)


def test_fm_index_locates_all_occurrences():
    rng = np.random.default_rng(0)
    seq = rng.integers(0, 4, 400)
    seq[-1] = 0
    index = decontam.FMIndex(seq, 4)
    for n in (1, 2, 5):
        p = rng.integers(1, 4, (30, n))
        low, high = index.search(p, np.full(30, n))
        for k in range(30):
            want = [i for i in range(400 - n + 1) if (seq[i : i + n] == p[k]).all()]
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def test_line_dedup_is_brute_force(spark):
    rnd = random.Random(5)
    pool = ["Common line", " common LINE\t", "rare one", "", "  ", "x", "déjà", "DÉJÀ", "other", "once more"]
    texts = ["\n".join([rnd.choice(pool) for _ in range(rnd.randint(1, 5))] + [f"own {i}"]) for i in range(60)] + [None, "", "\n\n"]
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(common.WHITE))
    held = {}
    for i, t in enumerate(texts):
        for k in {key(s) for s in (t or "").split("\n")}:
            held.setdefault(k, set()).add(i)
    gone = {k for k, v in held.items() if k and len(v) >= 10}
    for limit in (1 << 20, 0):  # broadcast keys, joined keys
        for r in linededup.drop(docs(spark, texts), broadcast_keys=limit).collect():
            lines = (texts[r.doc_id] or "").split("\n")
            stay = [s for s in lines if key(s) not in gone]
            assert (r.n_lines, r.n_dropped, r.text or "") == (len(lines), len(lines) - len(stay), "\n".join(stay))
        first = {r.doc_id: r.text for r in linededup.drop(docs(spark, texts), keep_first=True, broadcast_keys=limit).collect()}
        for k in gone:
            assert sum(k in map(key, (t or "").split("\n")) for t in first.values()) == 1
            assert k in map(key, first[min(held[k])].split("\n"))
    assert linededup.drop(docs(spark, []), least_docs=1).count() == 0


def word_hashes(t):
    return (Scan([(t or "").encode()], BREAK, lower=True).word_hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def brute_classes(texts):
    """By the longest common subsequence of the words themselves."""
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    root = list(range(len(texts)))
    find = lambda a: a if root[a] == a else find(root[a])
    for a in range(len(texts)):
        for b in range(a):
            n = len(words[a]) + len(words[b])
            if words[a] and words[b] and 9 * 2 * min(len(words[a]), len(words[b])) >= 8 * n:  # else too few can match
                found = brute_lcs(words[a], words[b])
                if found >= 0.8 * (n - found):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return [find(a) for a in range(len(texts))]


def test_near_duplicates_are_brute_force(spark):
    rnd = random.Random(6)
    say = lambda n: [f"v{rnd.randint(0, 5000)}" for _ in range(n)]
    texts = [" ".join(say(60)) for _ in range(15)] + [None, "", "one two", "One, two", "..."]
    base = say(150)
    for k in range(25):  # copies with 0 to 3 edits
        w = list(base)
        for _ in range(k % 4):
            w[rnd.randrange(150)] = "edit" + str(rnd.randint(0, 9999))
        texts.append(" ".join(w))
    got = {r.doc_id: r for r in omh.classes(docs(spark, texts)).collect()}
    want = brute_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    left = {r.doc_id for r in omh.drop_copies(docs(spark, texts)).collect()}
    assert left == set(want)
    assert omh.classes(docs(spark, [])).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(omh, "ROUNDS", 1)
    rnd = random.Random(11)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for _ in range(6):  # drifting chains around one passage that all share
        w = [f"v{rnd.randint(0, 9999)}" for _ in range(40)] + passage + [f"v{rnd.randint(0, 9999)}" for _ in range(rnd.choice((5, 60)))]
        for _ in range(9):
            texts.append(" ".join(w))
            w = list(w)
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 9999)}"
            if rnd.random() < 0.4:
                w.insert(rnd.randrange(len(w)), "and")
    got = {r.doc_id: r.class_id for r in omh.classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_overlapping_pairs_cover_all_similar_by_kmers(spark):
    rnd = random.Random(12)
    base, rows, km = [rnd.randrange(1 << 32) for _ in range(90)], [], {}
    for k in range(70):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = rnd.randrange(1 << 32)
        w = np.array(w[rnd.randint(0, 12) :], "<u4")
        node = bytes([k]) * 16
        km[node] = set(omh.kmers(mix(w.astype(np.uint64))).tolist())
        rows.append((node, len(km[node]), node, bytearray(zstandard.compress(w.tobytes()))))
    texts = spark.createDataFrame(rows, "node binary, n long, label binary, words binary")
    got = {(bytes(r.a), bytes(r.b)) for r in omh.overlapping(common.Scratch(spark, "t"), texts).collect()}
    want = {(a, b) for a in km for b in km if a < b and len(km[a] & km[b]) >= omh.SIMILARITY * len(km[a] | km[b])}
    assert len(want) > 50 and want <= got
    one = texts.withColumn("label", F.lit(b"x"))
    assert omh.overlapping(common.Scratch(spark, "t"), one).count() == 0 and omh.rarest(one).count() == 0


def thue_morse(rounds=11):
    a, b = "a", "b"
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


def test_texts_of_like_structure_do_not_collide(spark):
    a, b = thue_morse()
    s = Scan([a.encode(), b.encode()])
    assert len(set(s.word_hashes.tolist())) == 2
    assert cascade.base_counts([f"{a}\n{b}".encode()])["n_dup_lines"] == 0
    items = spark.createDataFrame([("i", a)], "item_id string, text string")
    assert [r.n_hit for r in sorted(decontam.find(docs(spark, [a, b]), items).collect())] == [1, 0]
    rows = linededup.drop(docs(spark, [f"{a}\n{b}"] * 10)).collect()
    assert {r.n_dropped for r in rows} == {2}
    words = " ".join(f"w{k}" for k in range(30))
    left = omh.classes(docs(spark, [f"{words} {a}", f"{words} {b}", a, b])).collect()
    assert {r.doc_id: r.class_id for r in left} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_order_matters_to_the_sketch():
    w = np.arange(1, 60, dtype=np.uint32)
    a, b = w, np.r_[w[30:], w[:30]]
    assert omh.similarity(a, a) == 1 and omh.similarity(a, b) < 0.8


def test_shards_fit_and_only_large_buckets_split(spark):
    rnd = random.Random(7)
    texts = ["x" * rnd.randint(0, 300) for _ in range(400)] + [None]
    rows = sharding.assign(docs(spark, texts), limit=2000).collect()
    assert len(rows) == 401
    total = {}
    for r in rows:
        total.setdefault(r.shard, []).append(r.n_bytes)
    assert all(sum(v) <= 2000 for v in total.values())
    assert all(r.shard_bytes == sum(total[r.shard]) and r.shard_docs == len(total[r.shard]) for r in rows)
    for s in total:  # its parent would not have fitted
        assert sum(sum(v) for k, v in total.items() if k.startswith(s[:-1])) > 2000
    same = sharding.assign(docs(spark, ["x" * 300] * 50 + ["y" * 5000], [1] * 51), limit=2000).collect()
    sizes = {}
    for r in same:
        sizes.setdefault(r.shard, []).append(r.n_bytes)
    assert sum(map(len, sizes.values())) == 51 and all(sum(v) <= 2000 or len(v) == 1 for v in sizes.values())
    assert sharding.assign(docs(spark, [])).count() == 0


def test_cascade_counts_and_any_order_of_rules(spark):
    texts = ["The cat sat on the mat and then it went home again.", "a b c d e a b c d e x", "l1 x\nl1 x\n \nl2", None, "", "é $5 <b> " * 30, "WOW " * 5 + "yes no maybe so ok!"]
    rows = sorted(cascade.apply(docs(spark, texts), rows=5).collect())
    for r, t in zip(rows, texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = {}
        for i in range(len(w) - 4):
            wins.setdefault(tuple(w[i : i + 5]), []).append(i)
        cov = {j for v in wins.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        lines = [s for s in t.split("\n") if s.strip(common.WHITE)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov))
        assert r.base_failed == (len(w) < 10 or 100 * len(cov) > 20 * len(w)) and r.kept == (r.rejected_by is None)
    texts = [(t or "").encode() for t in texts]
    base = cascade.base_counts(texts)
    one = cascade.cascade(texts, base, list(cascade.RULES)) == -1
    assert (one == (cascade.cascade(texts, base, list(cascade.RULES[::-1])) == -1)).all()
    assert cascade.apply(docs(spark, [])).count() == 0


def test_pairs_of_terms_are_learned():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2, (400, 2))
    row, col = np.nonzero(x)
    y = (x.sum(1) == 1).astype(float)  # no sum of weights tells these apart
    bias, w, v = toxicity.fit_machine(row, col, y, 2)
    p = toxicity.Machine(np.zeros(1), bias, w, v).margins(row, col, 400) > 0
    assert (p == (y == 1)).mean() > 0.95


def test_toxicity_and_quality_on_small_tables(spark):
    rnd = random.Random(9)
    say = lambda: " ".join(rnd.choice(["sun", "moon", "tree", "river", "stone"]) for _ in range(40))
    texts = [say() + (" idiot" if i % 3 == 0 else "") for i in range(150)] + [None, ""]
    rude = [(i, int(i % 3 == 0), None if i == 1 else i % 2) for i in range(150)]
    labels = spark.createDataFrame(rude, "doc_id long, toxic int, quality int")
    m = toxicity.fit(docs(spark, texts), labels, F.lit(True))
    got = {r.doc_id: r for r in toxicity.score(docs(spark, texts), m).collect()}
    assert all(got[i].predicted == (i % 3 == 0) and 0 <= got[i].score <= 1 for i in range(150)) and got[150].score == got[151].score
    bare = toxicity.fit(docs(spark, texts), labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs(spark, texts), bare).collect()} == {0.5}
    bad = [t if i % 2 else (t or "") + " $$$ ###" * 9 for i, t in enumerate(texts)]
    e = quality.fit(docs(spark, bad), labels, F.lit(True))
    rows = {r.doc_id: r for r in quality.score(docs(spark, bad), e).collect()}
    assert all(rows[i].predicted == i % 2 for i in range(150)) and 0 < len(e.rules) < 60
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert quality.score(docs(spark, []), e).count() == 0


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    raw = common.tables(spark, d, "documents")
    out = raw
    for name, stage in p.STAGES[:-1]:
        out = common.stored(stage(spark, out, d), "stage")
        assert out.columns == raw.columns and 0 < out.count() <= raw.count(), name
    items = common.tables(spark, d, "benchmark")
    assert decontam.find(out, items).where("n_hit > 0").count() == 0
    assert p.STAGES[-1][1](spark, out, d).count() == out.count()


def test_further_links_join_classes(spark):
    rnd = random.Random(13)
    name = lambda i: bytes([i]) * 16
    links = [tuple(rnd.sample(range(60), 2)) for _ in range(45)]
    table = lambda rows: spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in rows], "a binary, b binary")
    at_once = {(bytes(r.node), bytes(r.label)) for r in omh.components(common.Scratch(spark, "t"), table(links)).collect()}
    scratch = common.Scratch(spark, "t")
    labels = omh.components(scratch, table(links[:20]))
    for part in (links[20:30], links[:3], links[30:]):
        labels = omh.merged(scratch, labels, table(part))
    assert {(bytes(r.node), bytes(r.label)) for r in labels.collect()} == at_once


def brute_lcs(x, y):
    row = [0] * (len(y) + 1)
    for p in x:
        new = [0]
        for j, q in enumerate(y):
            new.append(row[j] + 1 if p == q else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_is_brute_force():
    rng = np.random.default_rng(5)
    for trial in range(300):
        x = rng.integers(0, (2, 5, 40)[trial % 3], rng.integers(1, 90)).astype(np.uint64)
        y = np.delete(x, rng.integers(0, len(x), rng.integers(0, 4))) if trial % 2 else np.insert(x, rng.integers(0, len(x), 4), rng.integers(0, 5, 4).astype(np.uint64))
        want = brute_lcs(x.tolist(), y.tolist())
        for least in {0, want, max(want - 3, 0)}:
            assert omh.alignment(x, y, least) == want
        assert omh.alignment(x, y, want + 1) <= want


def test_a_copy_without_an_early_repeat_is_linked(spark):
    rng = random.Random(8)
    line = " ".join(f"r{k}" for k in range(20))
    parts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(10)]
    whole = " ".join(f"{p} {line}" for p in parts)
    texts = [whole, whole.replace(line, "", 1)]
    assert omh.similarity(*map(word_hashes, texts)) > 0.9
    assert {r.class_id for r in omh.classes(docs(spark, texts)).collect()} == {0}


def test_short_texts_are_all_compared(spark):
    texts, want = [], []
    for k in range(60):  # each with one more word: 4 of 5 k-mers in common, or a few more
        w = [f"s{k}x{j}" for j in range(8 + k % 3)]
        texts += [" ".join(w), " ".join([*w, "more"])]
        want += [2 * k, 2 * k]
    got = {r.doc_id: r.class_id for r in omh.classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_one_row_of_each_class_stays_where_ids_repeat(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    texts, ids = [a, a, b, c, c, c, c, None, None], [1, 2, 2, 3, 3, None, None, None, 2]
    left = omh.drop_copies(docs(spark, texts, ids)).select("doc_id", "text").collect()
    assert sorted(map(repr, left)) == sorted(repr(type(left[0])(doc_id=i, text=t)) for i, t in [(1, a), (2, b), (3, c), (None, None), (2, None)])
    left = omh.drop_copies(docs(spark, [c, c], [None, None])).collect()
    assert len(left) == 1


def test_machine_margins_are_the_formula():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(np.zeros(1), 0.3, rng.normal(size=6), rng.normal(size=(6, 4)))
    sets = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5]]
    row, col = (np.array(x) for x in zip(*[(i, c) for i, s in enumerate(sets) for c in s]))
    for got, s in zip(m.margins(row, col, 4), sets):
        pairs = sum(float(m.factor[a] @ m.factor[b]) for a in s for b in s if a < b)
        assert abs(got - (0.3 + sum(m.weight[a] for a in s) + pairs)) < 1e-9


def test_rules_as_columns_are_the_rules(spark):
    rng = np.random.default_rng(3)
    x = rng.random((500, 2)).round(3)
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.4)).astype(float)
    e = quality.fit_rules(x, y, ("a", "b"))
    assert e.rules
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i long, a double, b double")
    got = {r.i: r.s for r in rows.select("i", e.column().alias("s")).collect()}
    for i, v in enumerate(x):
        at = {"a": v[0], "b": v[1]}
        z = e.bias + sum(w for w, rule in e.rules if all((at[n] > c) == above for n, c, above in rule))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
    assert np.mean([(got[i] > 0.5) == y[i] for i in range(500)]) > 0.97


def test_labels_that_disagree_and_rows_that_repeat_count_once(spark):
    texts, ids = [f"sun moon tree {i}" + " idiot" * (i % 2) for i in range(120)], [i if i < 100 else 5 for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(100)] + [(7, 0, 0), (8, None, None)], "doc_id long, toxic int, quality int")
    rows = quality.labelled_rows(docs(spark, texts, ids), labels, F.lit(True), "text", "toxic", 1000).collect()
    assert {r.y for r in rows if r.doc_id == 7} == {0} and sum(r.doc_id == 5 for r in rows) == 21
    one, two = (toxicity.fit(docs(spark, texts, ids).repartition(n), labels, F.lit(True)) for n in (1, 3))
    assert (one.weight == two.weight).all() and quality.fit(docs(spark, texts, ids), labels, F.lit(True)) == quality.fit(docs(spark, texts, ids).repartition(3), labels, F.lit(True))


def test_names_that_clash_are_replaced_or_kept(spark):
    from vicinal.llm import sharding as sh

    names = ["n_words", "items", "spans", "n_lines", "n_dropped", "n_tokens", "ids", "decoded", "shard", "depth", "n_bytes", "kept", "rejected_by", "label", "node", "n", "key", "digest"]
    wide = docs(spark, ["a b c\nd", None, ""]).withColumns({n: F.lit("own") for n in names})
    outs = [decontam.find(wide, spark.createDataFrame([("i", "a b c")], "item_id string, text string")), linededup.drop(wide), bpe.encode_decode(wide, path("byte_bpe_50k.json")), sh.assign(wide), cascade.apply(wide), omh.drop_copies(wide)]
    for out in outs:
        assert out.count() == 3 and len(set(out.columns)) == len(out.columns)
        assert all(r.key == "own" and r.digest == "own" for r in out.select("key", "digest").collect())
    pages = spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string").withColumns({n: F.lit("own") for n in ("key", "digest", "n", "first_id", "refers_to")})
    assert [r.refers_to for r in warc.with_types(pages).collect()] == [None]


def test_names_of_intermediate_columns_are_free_for_own_use(spark):
    import corpus_pipeline as p

    names = ["_id", "_digest", "_kept", "_row", "_gone", "_hash", "_text_hash", "_clean", "n_words", "score", "n_lines", "own3", "n_chars"]
    wide = docs(spark, ["a b c\nd", "a b c\nd", None, ""]).withColumns({n: F.lit(f"own {n}") for n in names if n != "n_chars"}).withColumn("n_chars", F.lit(7))
    for out in (omh.drop_copies(wide), linededup.drop(wide, broadcast_keys=0, least_docs=2), linededup.drop(wide, least_docs=2)):
        assert {r._id for r in out.select("_id").collect()} == {"own _id"} and len(set(out.columns)) == len(out.columns)
    items = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    real = common.tables
    common.tables = lambda spark, d, name: items if name == "benchmark" else real(spark, d, name)
    try:
        for out in (p.drop_lines(spark, wide, ""), p.drop_near_copies(spark, wide, ""), p.cut_benchmark(spark, wide, "")):
            assert out.columns == wide.columns
            for r in out.collect():
                assert all(r[n] == f"own {n}" for n in names if n != "n_chars")
                assert r.n_chars == (7 if r.text is None else len(r.text))
    finally:
        common.tables = real


def test_texts_made_to_collide_without_a_key(spark):
    a, b = "gzgeetyg}:d}O:y~", "the insurance is"
    assert len(set(Scan([a.encode()]).hashes(np.array([0]), np.array([16])).tolist() + Scan([b.encode()]).hashes(np.array([0]), np.array([16])).tolist())) == 1
    assert cascade.base_counts([f"{a}\n{b}".encode()])["n_dup_lines"] == 0
    rows = linededup.drop(docs(spark, [a] * 5 + [b] * 5), least_docs=6).collect()
    assert {r.n_dropped for r in rows} == {0}
    one, two = (Scan([b"insurance"], BREAK, lower=True, key=k).word_hashes.tolist() for k in (1, 2))
    assert one != two


def test_an_order_that_saves_work(spark, monkeypatch):
    seen = {"slow": 0, "quick": 0}

    def rule(name, work, rejects):
        def run(s, b):
            seen[name] += s.n
            for _ in range(work):
                s.count(cascade._UPPER)
            return rejects(s, b)

        return cascade.Rule(name, run)

    rules = (rule("slow", 60, lambda s, b: s.count(cascade._UPPER) > 10**6), rule("quick", 0, lambda s, b: b["n_symbols"] == 0))
    texts = [f"w{i} some plain words that go on and on for this text number {i} " + "x" * 500 for i in range(300)] + [f"$ w{i} one two three four five six seven eight nine ten" for i in range(30)]
    best = cascade.order(docs(spark, texts), rules=rules)
    assert [n for n, _, _ in best] == ["quick", "slow"]
    data = [t.encode() for t in texts]
    base, by = cascade.base_counts(data), {r.name: r for r in rules}
    work = {}
    for how, names in (("given", ["slow", "quick"]), ("measured", [n for n, _, _ in best])):
        seen.update(slow=0, quick=0)
        out = cascade.cascade(data, base, [by[n] for n in names])
        work[how] = sum(seen.values())
        assert (out == -1).sum() == 30
    assert work == {"given": 660, "measured": 360}
    rows = cascade.apply(docs(spark, texts), rules=rules).collect()
    assert sum(r.kept for r in rows) == 30 and {r.rejected_by for r in rows} == {None, "quick"}


def test_a_very_long_text(spark):
    rnd = random.Random(4)
    text = " ".join(f"w{rnd.randrange(5000)}" for _ in range(450_000)) + "\nlast line"  # longer than a shard
    item = " ".join(text.split()[399_990:400_010])  # across the cut
    rows = docs(spark, [text, text + " more"])
    assert [r.n_hit for r in decontam.find(rows, spark.createDataFrame([("i", item)], "item_id string, text string")).collect()] == [20, 20]
    assert {r.n_words for r in cascade.apply(rows).collect()} == {450_002, 450_003}
    assert {r.n_lines for r in linededup.drop(rows).collect()} == {2}
    lib = tokenizers.Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert [r.n_tokens for r in bpe.encode(rows.limit(1), path("byte_bpe_50k.json")).collect()] == [len(lib.encode(text, add_special_tokens=False).ids)]
