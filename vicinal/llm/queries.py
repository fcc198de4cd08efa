"""The registered queries of the training-data operators, and their SQL.

Each query applies its operator to the whole table and derives the columns of
the result from the operator's real output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import bpe, cascade, common, decontam, fim, linededup, omh, prefixtrie, quality, secrets, sharding, tokenfile, toxicity, warc

#: Id that ends a document in token files.
END_ID = 2
#: Bytes of a shard of the query: small enough that tables of a few MB split.
SHARD_BYTES = 256 << 10


def tokenizer(name: str) -> str:
    """Where the public tokenizers' files lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.tables(spark, sf_dir, "pages")
    source, target = common.shared_dir(spark, "warc"), common.shared_dir(spark, "warc")
    whole = warc.write_monolithic(warc.with_types(pages), source)
    files = warc.normalise(whole, source, target)
    common.drop_dir(source)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = warc.index(files, target).repartition(parts, "file").sortWithinPartitions("file", "offset")
    return warc.read(found, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _remainder(n: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(-1))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.tables(spark, sf_dir, "documents"), common.tables(spark, sf_dir, "labels")
    ensemble = quality.fit(docs, labels, _remainder(5) != 0)
    out = quality.score(docs.select("doc_id", "text"), ensemble)
    return out.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.classes(common.tables(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = common.tables(spark, sf_dir, "documents"), common.tables(spark, sf_dir, "benchmark")
    out = decontam.find(docs.select("doc_id", "text"), items)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.tables(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.tables(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs, SHARD_BYTES).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


def op7_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.tables(spark, sf_dir, "documents").select("doc_id", "text")
    return cascade.apply(docs).select("doc_id", *cascade.BASE, "base_failed", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.tables(spark, sf_dir, "documents"), common.tables(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels, _remainder(4) != 2)
    out = toxicity.score(docs.select("doc_id", "text"), machine)
    return out.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.tables(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return linededup.drop(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, uri = common.tables(spark, sf_dir, "documents"), common.shared_dir(spark, "ids")
    files = tokenfile.write(docs, uri, tokenizer("word_bpe_49k.json"), END_ID)
    return tokenfile.read(files, uri).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefixtrie.build(common.tables(spark, sf_dir, "conversations"), 100, 6)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(common.tables(spark, sf_dir, "documents").select("doc_id", "text"))
    base = secrets.written(F.col("spans"), ["assign", "access", "hex"])
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(common.tables(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_quality, op3_order_minhash, op4_decontamination, op5_bpe, op6_extendible_shards, op7_cascade, op8_toxicity, op9_line_dedup, op10_token_files, op11_prefix_trie, op12_secret_scan, op13_fill_in_middle)}

_WHITE = r"[\x20\x09-\x0D]"
_BLACK = r"[^\x20\x09-\x0D]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _matches(kind: str, pattern: str) -> str:
    """Matches of a pattern and where they start, from the texts between them."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, '{kind}' AS kind, m, sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
  SELECT r, unnest(m) AS m, unnest(p[1 : len(m)]) AS p, unnest(range(len(m))) AS k FROM (SELECT r, regexp_extract_all(t, '{quoted}') AS m, string_split_regex(t, '{quoted}') AS p FROM d)) WINDOW w AS (PARTITION BY r ORDER BY k)"""


def _op12_sql() -> str:
    width, tests = secrets.WINDOW, {"digit": "[^0-9]", "upper": "[^A-Z]", "lower": "[^a-z]", "letter": "[^A-Za-z]"}
    allow = "|".join(f"(?:{p})" for p in secrets.ALLOW)
    rank = "list_position([" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "], kind)"
    enough = " OR ".join(f"(kind = '{kind}' AND x <= {secrets.most(bits)}" + "".join(f" AND length(regexp_replace(part, '{tests[k]}', '', 'g')) >= {n}" for k, n in least.items()) + ")" for kind, _, bits, least in secrets.CLASSES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join([_matches("assign", secrets.ASSIGN), _matches("access", secrets.ACCESS), _matches("hex", secrets.HEX)])}),
base AS (SELECT r, kind, CAST(s AS BIGINT) AS a, CAST(s + length(m) AS BIGINT) AS b FROM found
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, '{secrets.ASSIGN.replace("'", "''")}', 2)) >= {secrets.LEAST_ASSIGNED} WHEN 'access' THEN length(m) >= {secrets.LEAST_ACCESS} ELSE length(m) >= {secrets.LEAST_HEX} END),
cand AS ({" UNION ALL ".join(_matches(kind, f"[{chars}]+") for kind, chars, _, _ in secrets.CLASSES)}),
win AS (SELECT r, kind, s + j AS h, substr(m, j + 1, {width}) AS part FROM (SELECT *, unnest(range(length(m) - {width - 1})) AS j FROM cand WHERE length(m) >= {width} AND NOT regexp_matches(m, '{allow}'))),
bits AS (SELECT *, list_sum(list_transform(map_values(list_aggregate(string_split(part, ''), 'histogram')), lambda c: {[secrets.weight(c) for c in range(width + 1)]}[CAST(c AS BIGINT) + 1])) AS x FROM win),
hit AS (SELECT r, kind, h, sum(CASE WHEN h <= before + {width} THEN 0 ELSE 1 END) OVER (PARTITION BY r, kind ORDER BY h) AS g FROM (SELECT *, lag(h) OVER (PARTITION BY r, kind ORDER BY h) AS before FROM bits WHERE {enough})),
more AS (SELECT r, kind, CAST(min(h) AS BIGINT) AS a, CAST(max(h) + {width} AS BIGINT) AS b FROM hit GROUP BY r, kind, g),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM more WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = more.r AND base.a <= more.a AND more.b <= base.b)),
per AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, {rank}) FILTER (kind IN ('assign', 'access', 'hex')) AS based, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, {rank}) AS every FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(based, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN per USING (r)"""


#: CRC-32 of a short ASCII string s: bytes come in by xor, then eight shifts each.
_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(s, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"

ORACLES = {
    "op11_prefix_trie": f"""
WITH t AS (SELECT conv_id AS c, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(x ORDER BY i) AS v FROM t GROUP BY c),
h AS (SELECT c, v, CAST({_CRC} % 6 AS BIGINT) AS h FROM (SELECT *, CAST(c AS VARCHAR) AS s FROM own)),
built AS (SELECT h.c, list_concat(coalesce(b.v[1 : h.h], []), h.v[h.h + 1 :]) AS v FROM h LEFT JOIN own b ON b.c = h.c - h.c % 100),
p AS (SELECT c, len(v) AS n, d, v[1 : d] AS p FROM (SELECT *, unnest(range(len(v) + 1)) AS d FROM built)),
node AS (SELECT p, d, min(c) AS c, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256,
  CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(p[d].t) END AS own FROM p GROUP BY p, d),
kids AS (SELECT p[1 : d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (p, d)),
below AS (SELECT p[1 : e] AS p, e AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM full_) GROUP BY ALL)
SELECT f.c AS conv_id, f.d AS depth, up.c AS parent_conv_id, f.n_convs, f.n_children, CAST(below.n_leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_ f JOIN below ON f.p = below.p AND f.d = below.d LEFT JOIN node up ON up.d = f.d - 1 AND up.p = f.p[1 : f.d - 1]""",
    "op12_secret_scan": _op12_sql(),
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= {warc.LEAST_BYTES} THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first_id FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q""",
    "op4_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {decontam.WIDTH}) AS n, array_to_string(w[i : i + least(len(w), {decontam.WIDTH}) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, 1 + greatest(len(w) - {decontam.WIDTH - 1}, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT d.r, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) s WHERE len(d.w) >= s.n)),
hit AS (SELECT DISTINCT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.phrase = bw.phrase),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op6_extendible_shards": f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
p AS (SELECT *, unnest(range(0, {sharding.HASH_BITS + 1})) AS depth FROM d),
q AS (SELECT doc_id, n_bytes, depth, h >> ({sharding.HASH_BITS} - depth) AS bucket,
  sum(n_bytes) OVER (PARTITION BY depth, h >> ({sharding.HASH_BITS} - depth)) AS shard_bytes,
  count(*) OVER (PARTITION BY depth, h >> ({sharding.HASH_BITS} - depth)) AS shard_docs FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM q WHERE shard_bytes <= {SHARD_BYTES})
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(bucket), 64, '0'), CAST(depth AS INTEGER)) END AS shard,
  CAST(depth AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs
FROM f WHERE k = 1""",
    "op7_cascade": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_BLACK}') AS w FROM documents),
g AS (SELECT r, i, w[i : i + {cascade.WINDOW - 1}] AS g FROM (SELECT r, w, unnest(range(1, len(w) - {cascade.WINDOW - 2})) AS i FROM d)),
twice AS (SELECT r, list(i) AS places FROM g GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {cascade.WINDOW})) AS j FROM (SELECT r, unnest(places) AS i FROM twice)) GROUP BY r),
c AS (SELECT r, doc_id, w, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_BLACK}')) AS lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (r)),
e AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < {cascade.LEAST_WORDS} OR 100 * n_repeat_words > {cascade.MOST_REPEATED} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * len(lines)
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 40 * length(regexp_replace(t, '[^A-Za-z]', '', 'g'))
    OR 100 * length(regexp_replace(t, '[^!]', '', 'g')) > 30 * n_words
    OR (n_words >= 50 AND 100 * len(list_distinct(w)) < 10 * n_words)) AS kept
FROM e""",
    "op9_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, i, lines[i] AS line, translate(regexp_replace(lines[i], '^{_WHITE}+|{_WHITE}+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS k
  FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
gone AS (SELECT k FROM l WHERE length(k) >= {linededup.LEAST_CHARS} GROUP BY k HAVING count(DISTINCT r) >= {linededup.LEAST_DOCS}),
m AS (SELECT l.*, gone.k IS NOT NULL AS dropped FROM l LEFT JOIN gone ON l.k = gone.k),
s AS (SELECT r, count(*) FILTER (dropped) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped) AS kept FROM m GROUP BY r)
SELECT doc_id, len(lines) AS n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN s USING (r)""",
    "op13_fill_in_middle": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) % (len(u) + 1) AS r1, CAST('0x' || x[9:16] AS BIGINT) % (len(u) + 1) AS r2, CAST('0x' || x[17:24] AS BIGINT) % 100 AS r3, CAST('0x' || x[25:32] AS BIGINT) % 100 AS r4 FROM d),
p AS (SELECT *, array_to_string(u[1 : least(r1, r2)], '') AS a, array_to_string(u[least(r1, r2) + 1 : greatest(r1, r2)], '') AS m, array_to_string(u[greatest(r1, r2) + 1 :], '') AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r3 >= {fim.REWRITTEN} THEN 'plain' WHEN r4 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || m ELSE '<P>' || a || '<S>' || z || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
}
