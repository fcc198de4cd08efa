"""Shards of bounded size by extendible hashing.

A document's place is a hash of its id; a directory is indexed by the hash's
leading bits. Only a bucket that exceeds the byte limit splits, on one bit
more, until every bucket fits, so shards differ in depth.

The directory is found from byte sums of hash prefixes, never from single
documents: a level of sums serves ``STRIDE`` bits, and only what is still too
large at its last bit goes on to the next level. Sums, directory and the
assignment are DataFrames; nothing that grows with the data is collected.

Edge cases: a null or empty text has 0 bytes; a null id hashes as the empty
string. What all bits cannot part (rows with one id, or one document beyond the
limit) is cut by running bytes in a fixed order into numbered parts, so that a
part exceeds the limit only if it is a single document. Columns of the input
are kept, those named like a result are replaced; an empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm import common

#: Hash bits, and bits that one level of sums serves.
HASH_BITS, STRIDE = 60, 12
LIMIT = 64 << 20


def hash_of(id_column: str) -> Column:
    """The leading 60 bits of the id's MD5, as a number."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(h: Column, bits: int) -> Column:
    return F.shiftright(h, HASH_BITS - bits) if bits else F.lit(0).cast("long")


def directory(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Buckets of rows (h, bytes): depth, bucket (the leading bits as a number),
    shard_bytes, shard_docs. Buckets of depth HASH_BITS may exceed the limit."""
    found, left, top = [], sizes, 0
    while True:
        deep = min(top + STRIDE, HASH_BITS)
        sums = left.groupBy(prefix(F.col("h"), deep).alias("p")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        sums = common.stored(sums, "sums")
        open_ = None
        for depth in range(top, deep + 1):
            if depth == top and top:
                continue  # known to be too large
            part = sums.withColumn("bucket", F.shiftright("p", deep - depth))
            if open_ is not None:
                part = part.join(open_.select(F.col("bucket").alias("parent")), F.shiftright("bucket", 1) == F.col("parent"), "left_semi")
            part = part.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
            fits = (F.col("bytes") <= limit) | F.lit(depth == HASH_BITS)
            found.append(part.where(fits).select(F.lit(depth).alias("depth"), "bucket", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs")))
            open_ = part.where(~fits)
        open_ = common.stored(open_, "open")
        if deep == HASH_BITS or open_.isEmpty():
            break
        left = left.join(open_.select("bucket"), prefix(F.col("h"), deep) == F.col("bucket"), "left_semi")
        top = deep
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return common.stored(out, "directory")


def assign(docs: DataFrame, limit: int = LIMIT, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Add n_bytes, shard (the bucket's bits as text, the empty text if there is
    one bucket only; parts of what no bit can part end in ``.number``), depth,
    shard_bytes and shard_docs."""
    added = ("n_bytes", "shard", "depth", "shard_bytes", "shard_docs")
    own = docs.select(*(c for c in docs.columns if c not in added))
    rows = own.withColumns({"_h": hash_of(id_column), "n_bytes": F.coalesce(F.octet_length(F.col(column).cast("string")), F.lit(0)).cast("long")})
    sizes = rows.select(F.col("_h").alias("h"), F.col("n_bytes").alias("bytes"))
    buckets = directory(sizes, limit)
    # hash bits leave room for the depth: one key for buckets of all depths
    depths = [r[0] for r in buckets.select("depth").distinct().orderBy("depth").collect()]  # at most HASH_BITS + 1
    keys = F.array(*(F.struct(F.lit(d).alias("depth"), prefix(F.col("_h"), d).alias("bucket")) for d in depths)) if depths else F.array().cast("array<struct<depth:int,bucket:bigint>>")
    # a document lies in one bucket; the small table of depths and prefixes meets it there
    placed = _placed(rows, buckets, keys, depths)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("right(lpad(bin(bucket), 64, '0'), depth)"))
    out = placed.withColumn("shard", bits)
    full = (F.col("depth") == HASH_BITS) & (F.col("shard_bytes") > limit)
    if buckets.where((F.col("depth") == HASH_BITS) & (F.col("shard_bytes") > limit)).isEmpty():
        return out.select(*own.columns, *added)
    over = out.where(full)
    order = Window.partitionBy("bucket").orderBy("n_bytes", F.xxhash64(F.col(column)), F.col(id_column)).rowsBetween(Window.unboundedPreceding, -1)
    # documents of up to half the limit fill a part to half at least; larger ones are parts of their own
    big = F.col("n_bytes") * 2 > limit
    before = F.coalesce(F.sum(F.when(~big, F.col("n_bytes"))).over(order), F.lit(0))
    rank = F.coalesce(F.sum(F.when(big, 1)).over(order), F.lit(0))
    part = F.when(big, F.concat(F.lit("x"), rank.cast("string"))).otherwise(F.floor(before / F.lit(limit / 2)).cast("string"))
    over = over.withColumn("shard", F.concat_ws(".", "shard", part))
    total = over.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    over = over.drop("shard_bytes", "shard_docs").join(total, "shard")
    return out.where(~full).select(*own.columns, *added).unionByName(over.select(*own.columns, *added))


def _placed(rows: DataFrame, buckets: DataFrame, keys: Column, depths: list[int]) -> DataFrame:
    """Join rows with their bucket. Each row tries the depths that occur; a
    bucket table within ``BROADCAST_BUCKETS`` rows is broadcast, so that rows
    don't move, a larger one is joined by shuffling narrow rows only."""
    if buckets.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS:
        table = F.broadcast(buckets)
        return rows.withColumn("_k", F.explode(keys)).join(table, (F.col("_k.depth") == table["depth"]) & (F.col("_k.bucket") == table["bucket"])).drop("_k", "_h")
    narrow = rows.select("_h").distinct().withColumn("_k", F.explode(keys))
    found = narrow.join(buckets, (F.col("_k.depth") == buckets["depth"]) & (F.col("_k.bucket") == buckets["bucket"])).drop("_k")
    return rows.join(found, "_h").drop("_h")


#: Buckets (24 bytes each) that are broadcast at most.
BROADCAST_BUCKETS = 1 << 16


def write(docs: DataFrame, uri: str, limit: int = LIMIT, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Write each shard to a folder of its own; returns the table of shards."""
    out = assign(docs, limit, column, id_column)
    out.repartition("shard").write.partitionBy("shard").parquet(uri)
    return out.select("shard", "depth", "shard_bytes", "shard_docs").distinct()
