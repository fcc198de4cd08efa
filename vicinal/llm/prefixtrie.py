"""Prefix trie of conversations: which first turns conversations share, and what
storing shared prefixes once would save.

Turns are sorted by conversation over ranges of (conversation, turn), so that a
conversation of any length is dealt over many tasks. A numpy scan of each range
gives ranks and polynomial rolling fingerprints of all prefixes (two moduli, a
term ``x * B**rank`` for each turn); what the ranges before hold of a range's first
conversation is added from one row a range. A spliced conversation's prefixes
follow from those of its two sources by arithmetic, without scanning it again.

Prefixes of equal depth and fingerprint are one candidate group, whose smallest
conversation is its representative. Each member's turn is then compared with the
representative's, byte by byte, and the groups of the turns before must agree; by
induction over depth all members have equal prefixes. Groups that fail are split
by what the turns hold and by the groups before, until none fails.

A conversation represents the nodes of one path from some depth on, so the trie is
a tree of such chains. Sums over subtrees are added up chains by pointer doubling
and then along each chain by the scan that ranked the turns.

Hot groups: rows meet the few groups of more than 1 / ``HOT`` of all rows by a
broadcast of at most ``HOT`` rows, and the others by a shuffle; a representative's
text is copied once for each ``SALTED`` members. Ids that end in one node are
digested as a stream of joined pieces, never held at once.

Edge cases: null roles and texts count as empty. Rows without conv_id belong to no
conversation and are left out. Turns are ordered by turn (null first), and ties by
role, then text, so the result doesn't depend on the order of rows; repeated rows
are turns of their own. Negative ids: the source is conv_id - conv_id % group with
the sign of conv_id. An empty table has no node, not even a root. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm import common

#: Moduli (the two largest primes below 2**31) and bases of the fingerprints.
MODULI = (2147483647, 2147483629)
BASES = (1203471193, 918273647)
#: Groups of more than 1 / HOT of all rows are at most HOT in number.
HOT = 1000
#: Members that meet one copy of their representative's text.
SALTED = 1000
#: Ids joined in one piece of a digest.
PIECE = 4096


def power(base: int, e: np.ndarray, p: int) -> np.ndarray:
    """base ** e modulo p, of each exponent."""
    out, square, e = np.ones(len(e), np.uint64), base % p, e.astype(np.uint64)
    for bit in range(int(e.max(initial=0)).bit_length()):
        out[(e >> np.uint64(bit)) & np.uint64(1) == 1] *= np.uint64(square)
        out %= np.uint64(p)
        square = square * square % p
    return out


def scan(scratch: common.Scratch, df: DataFrame, key: str, order: list[Column], sums: list[str], hashed: str | None = None) -> DataFrame:
    """``df`` with the rank (``at``, from 0) of each row of a ``key`` (a long, not
    null) in ``order``, its ``sums`` made inclusive prefix sums, and with ``hashed``
    the prefix fingerprints ``f1, f2``. Stored in between: ranges are cut once."""
    marks = [] if hashed is None else ["f1", "f2"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != hashed), "at long", *(f"{m} long" for m in marks), "part int", "edge boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, have, held = TaskContext.get().partitionId(), None, {}, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = lambda name, b=batch: b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            k = col(key)
            fresh = np.r_[k[0] != last, k[1:] != k[:-1]]
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            goes_on = (start == 0) & (not fresh[0])  # rows of the key that the batch before ended with
            at = np.arange(n) - start + np.where(goes_on, have.get("at", -1) + 1, 0)
            out = {"at": at}

            def prefix(v: np.ndarray, name: str, start=start, goes_on=goes_on) -> np.ndarray:
                c = np.cumsum(v)
                return c - (c - v)[start] + np.where(goes_on, np.asarray(have.get(name, 0), c.dtype), np.asarray(0, c.dtype))

            for name in sums:
                out[name] = prefix(col(name).astype(np.int64), name)
            for name, p, base in zip(marks, MODULI, BASES, strict=False):
                terms = (col(hashed) % p).astype(np.uint64) * power(base, at, p) % np.uint64(p)
                out[name] = (prefix(terms, name) % np.uint64(p)).astype(np.int64)
            edge = np.zeros(n, bool)
            edge[0] = held is None
            names = [f for f in batch.schema.names if f != hashed and f not in out]
            columns = {f: batch.column(batch.schema.get_field_index(f)) for f in names} | {f: pa.array(v, pa.int64()) for f, v in out.items()}
            columns["part"] = pa.array(np.full(n, part, np.int32))
            if held is not None:
                yield finished(held)
            held, last, have = (columns, edge), k[-1], {f: v[-1] for f, v in out.items()}
        if held is not None:
            held[1][-1] = True  # the range's last row tells what it hands on
            yield finished(held)

    def finished(held: tuple) -> pa.RecordBatch:
        columns = held[0] | {"edge": pa.array(held[1])}
        fields = [f.split(" ")[0].strip("`") for f in schema.split(", ")]
        return pa.RecordBatch.from_arrays([columns[f] for f in fields], names=fields)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = scratch.stored(df.repartitionByRange(n, F.col(key), *order).sortWithinPartitions(F.col(key), *order).mapInArrow(run, schema))
    # two rows a range at most; what they hand on is one row a range
    edges = sorted((r.asDict() for r in table.where("edge").select("part", key, "at", *sums, *marks).collect()), key=lambda r: (r["part"], r[key], r["at"]))
    carried, state = [], None
    ranges = {}
    for r in edges:
        ranges.setdefault(r["part"], []).append(r)
    for part, rows in sorted(ranges.items()):
        end = dict(rows[-1]) | {"at": rows[-1]["at"] + 1}
        if state is not None and state[key] == rows[0][key]:
            shift = [pow(b, state["at"], p) for b, p in zip(BASES, MODULI, strict=True)]
            carried.append((part, state[key], state["at"], *(state[s] for s in sums), *(state[m] for m in marks), *shift))
            if end[key] == state[key]:
                end["at"] += state["at"]
                for s in sums:
                    end[s] += state[s]
                for m, q, p in zip(marks, shift, MODULI, strict=False):
                    end[m] = (state[m] + q * end[m]) % p
        state = end
    names = ["part", key, "_at", *(f"_{s}" for s in sums), *(f"_{m}" for m in marks), "q1", "q2"]
    before = F.broadcast(df.sparkSession.createDataFrame(carried, ", ".join(f"{x} {'int' if x == 'part' else 'long'}" for x in names)))
    joined = table.join(before, ["part", key], "left")
    none = F.lit(0)
    new = {"at": F.col("at") + F.coalesce("_at", none)} | {s: F.col(s) + F.coalesce(f"_{s}", none) for s in sums}
    new |= {m: (F.coalesce(f"_{m}", none) + F.coalesce(q, F.lit(1)) * F.col(m)) % p for m, q, p in zip(marks, ("q1", "q2"), MODULI, strict=False)}
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in table.columns if c not in ("part", "edge")))


def meet(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with unique ``groups`` that have ``size`` of the
    ``total`` rows each: the at most ``HOT`` largest are broadcast."""
    hot = groups.where(F.col(size) * HOT > total)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col(size) * HOT <= total), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def ranked(scratch: common.Scratch, conversations: DataFrame) -> DataFrame:
    """Turns with their rank ``at`` and the fingerprints of the prefixes they end."""
    empty = F.lit("")
    role, text = F.coalesce(F.col("role").cast("string"), empty), F.coalesce(F.col("text").cast("string"), empty)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).where("conv_id is not null")
    turns = turns.withColumns({"chars": F.length("text").cast("long"), "x": F.xxhash64("role", "text")})
    return scan(scratch, turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], [], "x")


def sources(turns: DataFrame, group: int, most: int) -> DataFrame:
    """A row a conversation: how many turns it has (``n``), how many it takes from
    conversation ``conv_id - conv_id % group`` (``head``, below ``most``), and the
    fingerprints where the two meet. ``group`` 0: none takes any."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most if group else F.lit(0)
    cut = [F.max(F.when(F.col("at") == h - 1, F.col(m))).alias(f"o{k}") for k, m in ((1, "f1"), (2, "f2"))]
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"), *cut).withColumn("h", h.cast("long"))
    kind = "array<struct<at:bigint,f1:bigint,f2:bigint,chars:bigint>>"
    if group:
        own = F.col("conv_id") - F.col("conv_id") % group
        heads = turns.where((F.col("conv_id") % group == 0) & (F.col("at") < most)).groupBy(F.col("conv_id").alias("source"))
        heads = heads.agg(F.array_sort(F.collect_list(F.struct("at", "f1", "f2", "chars"))).alias("first"))  # below ``most`` turns
        convs = convs.withColumn("source", own).join(heads, "source", "left")
        convs = convs.withColumn("head", F.coalesce(F.slice("first", F.lit(1), F.col("h").cast("int")), F.array().cast(kind))).drop("first")
    else:
        convs = convs.withColumns({"source": F.col("conv_id"), "head": F.array().cast(kind)})
    b = F.size("head").cast("long")
    end = lambda m: F.coalesce(F.get(F.col("head"), F.size("head") - 1)[m], F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return convs.select("conv_id", "source", "h", "head", b.alias("b"), zero(F.col("o1")).alias("o1"), zero(F.col("o2")).alias("o2"), end("f1").alias("t1"), end("f2").alias("t2"), "n", (b + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def prefixes(turns: DataFrame, convs: DataFrame, total: int, most: int) -> DataFrame:
    """(conv_id, depth, f1, f2, chars, src, at) of each prefix; (src, at) is the turn
    of the given table that ends it."""
    shared = convs.select("conv_id", F.col("source").alias("src"), F.explode("head").alias("t")).select("conv_id", (F.col("t.at") + 1).alias("depth"), "t.f1", "t.f2", "t.chars", "src", "t.at")
    rows = turns.select("conv_id", "at", "f1", "f2", "chars")
    rows = meet(rows.withColumnsRenamed({"f1": "g1", "f2": "g2"}), convs.select("conv_id", "h", "b", "o1", "o2", "t1", "t2", "n"), ["conv_id"], "n", total).where("at >= h")

    def moved(k: int) -> Column:
        p, base = MODULI[k], BASES[k]
        shift = F.element_at(F.array(*(F.lit(pow(base, -e, p)) for e in range(most + 1))).cast("array<long>"), (F.col("h") - F.col("b") + 1).cast("int"))
        return (F.col(f"t{k + 1}") + F.pmod(F.col(f"g{k + 1}") - F.col(f"o{k + 1}"), F.lit(p)) * shift) % p

    own = rows.select("conv_id", (F.col("b") + F.col("at") - F.col("h") + 1).alias("depth"), moved(0).alias("f1"), moved(1).alias("f2"), "chars", F.col("conv_id").alias("src"), "at")
    return shared.unionByName(own)


def labelled(scratch: common.Scratch, rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with the representative of their candidate group (``label``), its
    turn (``rsrc``, ``rat``) and the group's size."""
    key = ["depth", "f1", "f2"]
    groups = rows.groupBy(*key).agg(F.min("conv_id").alias("label"), F.count("*").alias("size"))
    ends = rows.select(F.col("conv_id").alias("label"), "depth", F.col("src").alias("rsrc"), F.col("at").alias("rat"))
    groups = scratch.stored(groups.join(ends, ["label", "depth"]))
    return meet(rows, groups, key, "size", total).drop("f1", "f2")


def with_parents(rows: DataFrame, root: int) -> DataFrame:
    """Adds the label of the prefix one turn shorter."""
    above = rows.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("label").alias("parent"))
    return rows.join(above, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(root)))


def unequal(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """(depth, label) of groups where a member's last turn is not byte for byte that
    of its representative. Each pair of different stored turns is compared once."""
    copies = F.ceil(F.col("size") / SALTED).cast("int")
    pairs = rows.where("src != rsrc or at != rat").select("depth", "label", "src", "at", "rsrc", "rat", copies.alias("copies")).distinct()
    texts = turns.select(F.col("conv_id").alias("src"), "at", "role", "text")
    theirs = pairs.select("rsrc", "rat", "copies").distinct().join(texts.withColumnsRenamed({"src": "rsrc", "at": "rat", "role": "rrole", "text": "rtext"}), ["rsrc", "rat"])
    theirs = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    mine = pairs.join(texts, ["src", "at"]).withColumn("salt", F.pmod(F.xxhash64("src", "at"), F.col("copies")).cast("int"))
    return mine.join(theirs, ["rsrc", "rat", "salt"]).where("role != rrole or text != rtext").select("depth", "label").distinct()


def strayed(rows: DataFrame) -> DataFrame:
    """(depth, label) of groups whose members come from different parents."""
    return rows.groupBy("depth", "label").agg(F.min("parent").alias("lo"), F.max("parent").alias("hi")).where("lo != hi").select("depth", "label")


def split(scratch: common.Scratch, rows: DataFrame, bad: DataFrame, turns: DataFrame, root: int, total: int) -> DataFrame:
    """Label the ``bad`` groups anew by parent and by what their last turn holds."""
    bad = scratch.stored(bad.distinct())
    texts = turns.select(F.col("conv_id").alias("src"), "at", "role", "text")
    hit = scratch.stored(rows.join(bad, ["depth", "label"], "left_semi").join(texts, ["src", "at"]).withColumn("turn", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).drop("role", "text", "size", "rsrc", "rat"))
    key = ["depth", "label", "parent", "turn"]
    groups = hit.groupBy(*key).agg(F.min("conv_id").alias("new"), F.count("*").alias("size"))
    fixed = meet(hit, scratch.stored(groups), key, "size", total).withColumn("label", F.col("new"))
    same = rows.select("conv_id", "depth", "label", "size", "chars", "src", "at").join(bad, ["depth", "label"], "left_anti")
    return scratch.stored(with_parents(same.unionByName(fixed.select(*same.columns)), root))


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, label, ends_sha256) of rows (depth, label, conv_id): SHA-256 of the
    ids in ascending order, comma-joined. Sorted ranges join up to ``PIECE`` ids;
    the pieces of a node then pass through one digest in their order."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            depth, label, ids = (batch.column(k).to_numpy() for k in range(3))
            fresh = np.flatnonzero(np.r_[True, (depth[1:] != depth[:-1]) | (label[1:] != label[:-1])])
            starts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(fresh, np.r_[fresh[1:], len(ids)], strict=True)])
            stops = np.r_[starts[1:], len(ids)]
            joined = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(depth[starts]), pa.array(label[starts]), pa.array(ids[starts]), pa.array(joined, pa.string())], names=["depth", "label", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for depth, label, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (depth, label) == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (depth, label), hashlib.sha256(ids.encode())
            if out:
                yield record(out)
        if now is not None:
            yield record([(*now, state.hexdigest())])

    def record(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["depth", "label", "ends_sha256"])

    n, key = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["depth", "label", "conv_id"]
    joined = ends.select(*key).repartitionByRange(n, *key).sortWithinPartitions(*key).mapInArrow(pieces, "depth long, label long, first long, ids string")
    return joined.repartition(n, "depth", "label").sortWithinPartitions("depth", "label", "first").mapInArrow(digests, "depth long, label long, ends_sha256 string")


def chain_totals(scratch: common.Scratch, nodes: DataFrame, root: int) -> DataFrame:
    """(v, parent, top, leaves, saved) of each chain but the root's: sums over it and
    all chains below it. ``up`` is the chain 2**k chains above after k rounds; each
    round adds the sums of those that point to a chain, then doubles the pointers."""
    heads = nodes.groupBy(F.col("conv_id").alias("v")).agg(F.min("depth").alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).where(F.col("v") != root)
    above = nodes.select(F.col("conv_id").alias("v"), F.col("depth").alias("top"), F.col("parent_conv_id").alias("parent"))
    state = scratch.stored(heads.join(above, ["v", "top"]).withColumn("up", F.when(F.col("parent") != root, F.col("parent"))))
    while not (going := state.where("up is not null")).isEmpty():
        total = going.count()
        add = scratch.stored(going.groupBy("up").agg(F.sum("leaves").alias("dl"), F.sum("saved").alias("ds"), F.count("*").alias("k")))
        further = state.select(F.col("v").alias("up"), F.col("up").alias("next")).join(add.select("up", "k"), "up")
        moved = meet(going.select("v", "up"), further, ["up"], "k", total).select("v", "next")
        both = state.drop("up").join(add.select(F.col("up").alias("v"), "dl", "ds"), "v", "left").join(moved, "v", "left")
        none = F.lit(0)
        state = scratch.stored(both.select("v", "top", "parent", (F.col("leaves") + F.coalesce("dl", none)).alias("leaves"), (F.col("saved") + F.coalesce("ds", none)).alias("saved"), F.col("next").alias("up")))
    return state


def build(conversations: DataFrame, group: int = 0, most: int = 6) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turn, role, text): conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (code points), ends_sha256, and the turn (src, at: conversation and
    rank) that the node stands for. With ``group`` each conversation first takes up
    to ``most`` - 1 turns of the first of its hundred (say), as ``sources`` has it."""
    scratch = common.Scratch(conversations.sparkSession, "trie")
    turns = ranked(scratch, conversations)
    convs = scratch.stored(sources(turns, group, most))
    root, n_convs, n_turns = convs.agg(F.min("conv_id"), F.count("*"), F.sum("n")).first()
    root = -1 if root is None else root
    paths = scratch.stored(prefixes(turns, convs, n_turns or 0, most))
    total = paths.count()
    rows = scratch.stored(with_parents(scratch.stored(labelled(scratch, paths, total)), root))
    bad = scratch.stored(unequal(rows, turns).unionByName(strayed(rows)))
    while not bad.isEmpty():
        rows = split(scratch, rows, bad, turns, root, total)
        bad = scratch.stored(strayed(rows))
    own = rows.where("conv_id = label").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("size").alias("n_convs"), ((F.col("size") - 1) * F.col("chars")).alias("saved"), "src", "at")
    top = convs.limit(1).select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_convs).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("saved"), F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("at"))
    nodes = own.unionByName(top)
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ended = convs.select("conv_id", F.col("length").alias("depth")).join(rows.select("conv_id", "depth", "label"), ["conv_id", "depth"], "left").withColumn("label", F.coalesce("label", F.lit(root)))
    digests = end_digests(ended).withColumnRenamed("label", "conv_id")
    at = ["conv_id", "depth"]
    nodes = nodes.join(children, at, "left").join(digests, at, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))})
    nodes = scratch.stored(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")))
    below = chain_totals(scratch, nodes, root).groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("dl"), F.sum("saved").alias("ds"))
    none = F.lit(0)
    nodes = nodes.join(below, at, "left").withColumns({"leaves": F.col("leaves") + F.coalesce("dl", none), "saved": F.col("saved") + F.coalesce("ds", none)}).drop("dl", "ds")
    # along a chain from its end: what lies below a node includes all deeper ones
    summed = scan(scratch, nodes.withColumnRenamed("at", "turn"), "conv_id", [F.col("depth").desc()], ["leaves", "saved"])
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256", "src", F.col("turn").alias("at"))
