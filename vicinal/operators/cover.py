"""Greedy nets and covers of all rows, over bunches of landmark cells with margins.

A greedy net goes through the rows in an order; a row becomes a representative
unless an earlier representative lies within the radius. Rows are dealt to bunches
by their nearest landmark. A bunch owns these rows and also sees its halo: rows of
other bunches that may lie within the radius of an owned one. Halo rows never seed
a representative; an owned row waits while an earlier halo row near it is open. So
each round decides exactly what the sequential pass would, and the net is the same
for any number of bunches: no two representatives lie within the radius, across
bunches or not, and each row has one within it.

A round takes the first ``BATCH`` open rows of each bunch, whatever its size, and
then drops all rows that the new representatives cover, in cells of bounded size;
in a dense bunch one round covers nearly all rows. Several radii are one pass: a
row carries a bit for each radius at which it is open.

Where bunches see more than ``HALO`` times all rows, they save nothing: then the rows
are stored once in their order, and a round decides the first ``ROUND`` open rows and
drops what these cover. This gives the same net, shuffles no row and copies none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.operators import knn as K
from vicinal.operators.lineage import cut
from vicinal.operators.order import before

#: Open rows of a bunch that a round decides (Spark limits such ranks before its shuffle).
BATCH = 1000
#: Open rows that a round over the whole order decides, and rows of bunches a row above
#: which it is taken.
ROUND, HALO = 8192, 2
#: Radii of one pass: bits that a double holds exactly.
MOST_RADII = 48


def hashed(seed: int = 0, column: str = "id") -> Column:
    """An order of rows that any engine can compute."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")).cast("binary"))


def longest_first(mass: DataFrame, bunches: int) -> DataFrame:
    """(l, bunch): landmarks (l, n) by falling mass, ties by id, each to the bunch
    with the least mass so far, ties by number. Landmarks are few: their counts are
    packed on the driver."""
    loads = [(0, b) for b in range(max(1, bunches))]
    out = []
    for row in sorted(mass.select("l", "n").collect(), key=lambda r: (-r.n, r.l)):
        load, b = heapq.heappop(loads)
        out.append((row.l, b))
        heapq.heappush(loads, (load + row.n, b))
    return mass.sparkSession.createDataFrame(out, "l long, bunch long")


def contiguous(landmarks: DataFrame, bunches: int) -> DataFrame:
    """(l, bunch): blocks of landmarks (id) by their position in the order of ids."""
    total = landmarks.agg(F.count("*").alias("n"))
    at = before(landmarks.select("id"), ["id"]).crossJoin(F.broadcast(total))  # one row
    return at.select(F.col("id").alias("l"), F.floor(F.col("before") * max(1, bunches) / F.col("n")).cast("long").alias("bunch"))


def margins(df: DataFrame, landmarks: DataFrame, margin: float) -> DataFrame:
    """(id, l, d) of all landmarks at most ``margin`` farther than a row's nearest."""
    top = K.assign(df, landmarks, 1).select("id", F.col("d").alias("least"))
    rows = df.join(top, "id").select("id", F.concat("v", F.array("least")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qi, a, ci, b in K.met(batches):
            most, a = a[:, -1] + margin, a[:, :-1]
            off = K.ROUNDING * ((a * a).sum(1)[:, None] + (b * b).sum(1)[None])
            row, col = np.nonzero(K.l2_kernel(a, b) - off <= most[:, None] ** 2)
            d = K.exact(a, b, row, col)
            ok = d <= most[row]
            yield pa.RecordBatch.from_pydict({"id": qi[row[ok]], "l": ci[col[ok]], "d": d[ok]})

    return K.block_pairs(rows, landmarks.select("id", "v")).mapInArrow(run, "id long, l long, d double")


def inside(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Which rows of ``b`` lie within ``radius`` of which rows of ``a``."""
    g, off = K.l2_kernel(a, b), K.ROUNDING * ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] + radius**2)
    out = g + off <= radius**2
    row, col = np.nonzero(~out & (g - off <= radius**2))  # too close to call
    out[row, col] = K.exact(a, b, row, col) <= radius
    return out


def decide(frame: pd.DataFrame, radii: list[float]) -> pd.DataFrame:
    """The new representatives among a bunch's first open rows, with their radii."""
    frame = frame.sort_values(["h", "id"])
    x, own, open_ = np.array(frame["v"].tolist(), float), frame["own"].to_numpy(), frame["open"].to_numpy()
    bits = [(open_ >> k) & 1 == 1 for k in range(len(radii))]
    chosen, waits = (np.zeros((len(radii), len(x)), bool) for _ in range(2))
    for i in range(len(x)):
        d = np.sqrt(((x[:i] - x[i]) ** 2).sum(1))
        for k, radius in enumerate(radii):
            if not bits[k][i]:
                continue
            near = d <= radius
            if (chosen[k, :i] & near).any():
                continue
            if own[i] and not (waits[k, :i] & near).any():
                chosen[k, i] = True
            else:  # a halo row, or a row near one that is open
                waits[k, i] = True
    mask = (chosen * (1 << np.arange(len(radii)))[:, None]).sum(0)
    new = mask > 0
    return frame.loc[new, ["id", "g", "v"]].assign(reps=mask[new])


def greedy(rows: DataFrame, radii: list[float]) -> DataFrame:
    """(id, g, reps): the representatives among ``rows`` (id, v, h, g, own) in order of
    (h, id), ``reps`` having bit k where a row is one at radii[k]. Rows see one
    another in equal ``g``; a row is its own in one of them."""
    if len(radii) > MOST_RADII:
        raise ValueError(f"at most {MOST_RADII} radii at a time")
    radii = [float(r) for r in radii]

    def covered(qi: np.ndarray, a: np.ndarray, ci: np.ndarray, b: np.ndarray) -> dict:
        open_, reps, a, b = a[:, -1].astype(np.int64), b[:, -1].astype(np.int64), a[:, :-1], b[:, :-1]
        out = np.zeros(len(a), np.int64)
        for k, radius in enumerate(radii):
            q, c = np.flatnonzero((open_ >> k) & 1), np.flatnonzero((reps >> k) & 1)
            if len(q) and len(c):
                out[q] |= inside(a[q], b[c], radius).any(1).astype(np.int64) << k
        some = out > 0
        return {"id": qi[some], "gone": out[some]}

    left = cut(rows.select("id", "v", "h", "g", "own", F.lit((1 << len(radii)) - 1).cast("long").alias("open")))
    found = left.select("id", "g", F.lit(0).cast("long").alias("reps")).limit(0)
    first = F.row_number().over(Window.partitionBy("g").orderBy("h", "id"))
    packed = lambda df, mask: df.select("id", F.concat("v", F.array(F.col(mask).cast("double"))).alias("v"), "g")
    while not left.isEmpty():
        batch = left.withColumn("rk", first).where(F.col("rk") <= BATCH)
        fresh = cut(batch.groupBy("g").applyInPandas(lambda f: decide(f, radii), "id long, g long, v array<double>, reps long"))
        found = found.unionByName(fresh.select("id", "g", "reps"))
        gone = K.in_buckets(packed(left, "open"), packed(fresh, "reps"), "g", covered, "id long, gone long")
        gone = gone.groupBy("id").agg(F.bit_or("gone").alias("gone"))
        still = F.col("open").bitwiseAND(F.bitwise_not(F.coalesce("gone", F.lit(0))))
        left = cut(left.join(gone, "id", "left").withColumn("open", still).drop("gone").where("open != 0"))
    return cut(found)


def covered(a: np.ndarray, open_: np.ndarray, b: np.ndarray, reps: np.ndarray, radii: list[float]) -> np.ndarray:
    """The bits of the radii at which rows of ``a`` are open and within one of ``b``."""
    out, na, nb = np.zeros(len(a), np.int64), (a * a).sum(1), (b * b).sum(1)
    if not len(b):
        return out
    left, right = np.hstack([-2 * a, na[:, None], np.ones((len(a), 1))]), np.hstack([b, np.ones((len(b), 1)), nb[:, None]]).T
    seen = [np.flatnonzero((reps >> k) & 1) for k in range(len(radii))]
    for at in range(0, len(a), K.STRIP):
        g = left[at : at + K.STRIP] @ right
        for k, radius in enumerate(radii):
            q, c = np.flatnonzero((open_[at : at + K.STRIP] >> k) & 1), seen[k]
            if not len(q) or not len(c):
                continue
            own = g if len(q) == len(g) and len(c) == len(b) else g[:, c] if len(q) == len(g) else g[np.ix_(q, c)]
            off = K.ROUNDING * (na[at + q] + nb.max() + radius**2)
            low = own.min(1)
            near = low + off <= radius**2
            close = np.flatnonzero(~near & (low - off <= radius**2))  # too close to call
            row, col = np.nonzero(own[close] - off[close, None] <= radius**2)
            near[close[row[K.exact(a, b, at + q[close[row]], c[col]) <= radius]]] = True
            out[at + q[near]] |= 1 << k
    return out


def sequential(x: np.ndarray, radii: list[float], open_: np.ndarray) -> np.ndarray:
    """The bits of the radii at which rows in order are representatives."""
    reps, open_ = np.zeros(len(x), np.int64), open_.copy()
    for at in range(0, len(x), K.STRIP):
        own = slice(at, at + K.STRIP)
        chosen = np.flatnonzero(reps[:at])
        now, part = open_[own], x[own]
        now = now & ~covered(part, now, x[chosen], reps[chosen], radii)
        near = sum(inside(part, part, r).astype(np.int64) << k for k, r in enumerate(radii))
        for i in range(len(part)):
            if now[i]:
                reps[at + i] = now[i]
                now[i + 1 :] &= ~(near[i, i + 1 :] & now[i])
    return reps


def in_order(df: DataFrame, radii: list[float], seed: int = 0) -> DataFrame:
    """(id, reps): ``greedy`` over all rows (id, v) as one group. Rows lie in blocks in
    their order; a block is a row of the table, and the representatives of a round, of
    at most ``ROUND`` rows or one block, are what is broadcast."""
    if len(radii) > MOST_RADII:
        raise ValueError(f"at most {MOST_RADII} radii at a time")
    radii = [float(r) for r in radii]
    schema = "h string, n long, ids binary, m binary, open binary"
    raw = lambda x, t: np.ascontiguousarray(x).astype(t).tobytes()
    size = max(1, min(K.BLOCK, ROUND))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (1 << len(radii)) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                ids, v, h = batch.slice(at, size).columns
                m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                key = f"{h[0].as_py()}:{ids[0].as_py()}"
                yield pa.RecordBatch.from_pydict({"h": [key], "n": [len(ids)], "ids": [raw(ids.to_numpy(), "<i8")], "m": [raw(m, "<f8")], "open": [raw(np.full(len(ids), every), "<i8")]})

    def read(ids: bytes, m: bytes, mask: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.frombuffer(ids, "<i8")
        return i, np.frombuffer(m, "<f8").reshape(len(i), -1), np.frombuffer(mask, "<i8")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: r[0])
        if held:
            ids, x, open_ = (np.concatenate(p) for p in zip(*(read(*r[2:]) for r in held), strict=True))
            reps = sequential(x, radii, open_)
            some = reps > 0
            yield pa.RecordBatch.from_pydict({"ri": [raw(ids[some], "<i8")], "rm": [raw(x[some], "<f8")], "reps": [raw(reps[some], "<i8")]})

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, _, ids, m, open_, ri, rm, reps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i, x, now = read(ids, m, open_)
                _, y, reps = read(ri, rm, reps)
                now = now & ~covered(x, now, y, reps, radii)
                some = now != 0
                if some.any():
                    yield pa.RecordBatch.from_pydict({"h": [h], "n": [int(some.sum())], "ids": [raw(i[some], "<i8")], "m": [raw(x[some], "<f8")], "open": [raw(now[some], "<i8")]})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ri, reps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pydict({"id": np.frombuffer(ri, "<i8"), "reps": np.frombuffer(reps, "<i8")})

    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    rows = df.select("id", "v", hashed(seed).alias("h")).repartitionByRange(parts, "h", "id").sortWithinPartitions("h", "id")
    left, found = cut(rows.mapInArrow(pack, schema)), None
    while heads := left.select("h", "n").orderBy("h").limit(ROUND // 32 + 1).collect():  # some blocks' sizes
        total, last = 0, heads[0].h
        for r in heads:
            total += r.n
            if total > ROUND:
                break
            last = r.h
        fresh = cut(left.where(F.col("h") <= last).coalesce(1).mapInArrow(first, "ri binary, rm binary, reps binary"))
        found = fresh if found is None else found.unionByName(fresh)
        left = cut(left.where(F.col("h") > last).crossJoin(F.broadcast(fresh)).mapInArrow(drop, schema))  # one row
    if found is None:
        return df.select("id", F.lit(0).cast("long").alias("reps")).limit(0)
    return cut(found.select("ri", "reps").mapInArrow(unpack, "id long, reps long"))


def sight(df: DataFrame, landmarks: DataFrame, radius: float, bunches: int) -> DataFrame:
    """(id, g, own): the bunch of a row's nearest landmark, and those where it may lie
    within ``radius`` of an owned row. By the triangle inequality these have a landmark
    at most 2 * radius farther than the nearest one."""
    near = cut(margins(df, landmarks, 2 * radius))
    rk = F.row_number().over(Window.partitionBy("id").orderBy("d", "l"))
    top = near.withColumn("rk", rk).where("rk = 1").select("id", "l")
    plan = F.broadcast(longest_first(top.groupBy("l").agg(F.count("*").alias("n")), bunches))  # one row a landmark
    owner = top.join(plan, "l").select("id", F.col("bunch").alias("owner"))
    seen = near.join(plan, "l").select("id", F.col("bunch").alias("g")).distinct().join(owner, "id")
    return cut(seen.select("id", "g", (F.col("g") == F.col("owner")).alias("own")))


def placed(df: DataFrame, seen: DataFrame, seed: int = 0) -> DataFrame:
    return cut(seen.join(df.select("id", "v"), "id").select("id", "v", hashed(seed).alias("h"), "g", "own"))


def bunched(df: DataFrame, landmarks: DataFrame, radius: float, bunches: int, seed: int = 0) -> DataFrame:
    """(id, v, h, g, own): rows in all bunches that see them."""
    return placed(df, sight(df, landmarks, radius, bunches), seed)


def crowded(df: DataFrame, seen: DataFrame) -> bool:
    """Do bunches see so many rows that they save nothing?"""
    return seen.count() > HALO * df.count()


def members(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, rep, d): the nearest representative of each row in its own bunch's sight."""
    seen = rows.join(reps.select("id").distinct(), "id", "left_semi")
    near = K.nearest(rows.where("own"), seen, 1, False, "g")
    return near.select(F.col("i").alias("id"), F.col("j").alias("rep"), "d")


def owned_net(df: DataFrame, landmarks: DataFrame, delta: float, bunches: int = 8, seed: int = 0) -> DataFrame:
    """(id, rep, d): the greedy net of all rows in hash order, built by bunches that
    see halos, and each row's nearest representative. The same for any ``bunches``."""
    seen = sight(df, landmarks, delta, bunches)
    if crowded(df, seen):
        reps = df.join(in_order(df, [delta], seed).select("id"), "id", "left_semi")
        return K.nearest(df, reps, 1, False).select(F.col("i").alias("id"), F.col("j").alias("rep"), "d")
    rows = placed(df, seen, seed)
    return members(rows, greedy(rows, [delta]))


def epsilon_net(df: DataFrame, landmarks: DataFrame, delta: float, seed: int = 0) -> DataFrame:
    """(id, rep): a greedy net of each nearest-landmark bucket for itself, in hash
    order, and each row's nearest representative in its bucket."""
    top = K.assign(df, landmarks, 1).select("id", F.col("l").alias("g"))
    rows = cut(top.join(df, "id").select("id", "v", hashed(seed).alias("h"), "g", F.lit(True).alias("own")))
    return members(rows, greedy(rows, [delta])).select("id", "rep")


def cover_counts(df: DataFrame, landmarks: DataFrame, radii: list[float], bunches: int = 8, seed: int = 0) -> DataFrame:
    """(radius, n): the size of the greedy net at each radius, from one pass over the
    rows for all radii."""
    seen = sight(df, landmarks, max(radii), bunches)
    reps = in_order(df, radii, seed) if crowded(df, seen) else greedy(placed(df, seen, seed), radii)
    return counts(reps, radii)


def counts(reps: DataFrame, radii: list[float]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(float(r)).alias("radius"), F.getbit("reps", F.lit(k)).cast("long").alias("n")) for k, r in enumerate(radii)))
    return reps.select(F.explode(each).alias("c")).groupBy("c.radius").agg(F.sum("c.n").alias("n"))


def choose_delta(df: DataFrame, landmarks: DataFrame, band: tuple[float, float], guard: float, bunches: int = 8, passes: int = 3, grid: int = 16, seed: int = 0) -> dict:
    """The smallest radius whose net has a size in ``band``, from nested grids: each
    pass counts covers at ``grid`` radii and keeps the bracket around the band.

    It falls back to epsilon (the 1 % quantile of 1-NN distances) where no radius
    reaches the band, where the net would collapse, or where less than ``guard`` of
    the pairs within delta are within epsilon. Keys: delta, eps_ref, r_est, mode
    (eps, calibrated, auto_fallback), guard_ok, fidelity."""
    low, high = sorted(map(float, band))
    nn1 = cut(K.one_nn(df).select("d"))
    q = nn1.agg(F.percentile("d", F.lit(0.01)).alias("q"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN d > 0 THEN d END)").alias("m")).first()
    n = df.count()
    eps = q.q if q.q and q.q > 0 else (q.m or 1e-12)
    far = df.agg(*(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("r") for _ in range(1))).first().r or 0.0
    sizes = lambda radii: {r.radius: r.n for r in cover_counts(df, landmarks, radii, bunches, seed).collect()}
    a, b, best = eps, max(2 * far, eps), None  # no two rows are farther apart
    nested = lambda: [a + (b - a) * k / (grid + 1) for k in range(1, grid + 1)] + [b]
    once = n >= low and grid + 2 <= MOST_RADII  # epsilon's cover is counted with the first grid's
    got = sizes(sorted({eps, *(nested() if once else [])})) if n else {}
    at_eps = got.get(eps, 0)
    report = {"eps_ref": eps, "r_band": (low, high), "alpha_guard": guard}
    if low <= at_eps <= high or n < low:
        return report | {"delta": eps, "r_est": at_eps, "mode": "eps", "guard_ok": True, "fidelity": 1.0}
    for k in range(passes):
        radii = set(nested())
        got = {r: got[r] for r in radii} if once and k == 0 else sizes(sorted(radii))
        fits = [r for r in sorted(got) if low <= got[r] <= high]
        if fits:
            best = (fits[0], got[fits[0]])
            b = fits[0]
        under = [r for r in got if got[r] < low and r < b]
        b = min([b, *under])
        over = [r for r in got if got[r] > high and r < b]
        a = max([a, *over])
        if b - a <= 1e-9 * max(eps, 1.0):
            break
    delta, size = best or (b, got.get(b, 0))
    fallback = report | {"delta": eps, "r_est": at_eps, "mode": "auto_fallback", "guard_ok": False, "candidate_delta": delta, "candidate_r_est": size}
    fidelity = pair_fidelity(df, delta, eps)
    if best is None or size < max(2.0, 0.01 * low) or fidelity < guard:
        return fallback | {"fidelity": fidelity}
    return report | {"delta": delta, "r_est": size, "mode": "calibrated", "guard_ok": True, "fidelity": fidelity}


def pair_fidelity(df: DataFrame, delta: float, eps: float) -> float:
    """Share of all pairs within ``delta`` that are within ``eps``, counted by pairs
    of blocks: no pair leaves a task."""
    if delta <= eps:
        return 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2, np.int64)
        for qi, a, ci, b in K.met(batches):
            na, nb = (a * a).sum(1), (b * b).sum(1)
            left, right = np.hstack([-2 * a, na[:, None], np.ones((len(a), 1))]), np.hstack([b, np.ones((len(b), 1)), nb[:, None]]).T
            same = np.isin(qi, ci)
            for at in range(0, len(a), K.STRIP):
                own = slice(at, at + K.STRIP)
                g = left[own] @ right
                if same[own].any():
                    g[qi[own, None] == ci[None]] = np.inf
                for k, radius in enumerate((eps, delta)):
                    off = K.ROUNDING * (na[own] + nb.max() + radius**2)[:, None]
                    sure = np.count_nonzero(g <= radius**2 - off)
                    maybe = np.count_nonzero(g <= radius**2 + off)
                    if maybe > sure:  # some are too close to call
                        row, col = np.nonzero((g > radius**2 - off) & (g <= radius**2 + off))
                        sure += np.count_nonzero(K.exact(a, b, at + row, col) <= radius)
                    n[k] += sure
        yield pa.RecordBatch.from_pydict({"e": n[:1], "d": n[1:]})

    row = K.block_pairs(df, df).mapInArrow(run, "e long, d long").agg(F.sum("e").alias("e"), F.sum("d").alias("d")).first()
    return row.e / row.d if row.d else 1.0
