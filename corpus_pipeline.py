"""A training-data pipeline over ``documents``.

Toxic documents go, repeated lines go, of each class of near-duplicates one
document stays, benchmark passages are cut out, and what is left is encoded.
All stages but the last return the columns of ``documents``; ``n_chars`` follows
the text. Each stage is written as Parquet and read again as the next one's
input; the table before it is dropped then.

Edge cases: a null or empty text has no toxic term, one empty line, no class and
no benchmark window, so its row goes through all stages and has no ids in the
end. Rows that repeat an id are documents of their own, but exact copies: of
these, as of near copies, one stays. Other columns go through as they are,
whatever their names: stages see doc_id and text under their names and the others
under numbers (in the last stage only ``doc_id`` goes through). An empty table goes through as one. A text is held whole by each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import bpe, common, decontam, linededup, omh, queries, toxicity


def _names(docs: DataFrame) -> dict[str, str]:
    return {c: c if c in ("doc_id", "text") else f"own{k}" for k, c in enumerate(docs.columns)}


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with other columns under names that no stage uses."""
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in _names(docs).items()))


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """A stage's rows with the columns of ``docs`` again."""
    out = out.select(*(F.col(n).alias(c) for c, n in _names(docs).items()))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine predicts to be toxic go."""
    machine = toxicity.fit(docs, common.tables(spark, sf_dir, "labels"), queries._remainder(4) != 2)
    return _like(docs, toxicity.score(_apart(docs), machine).where("predicted = 0"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go."""
    return _like(docs, linededup.drop(_apart(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return _like(docs, omh.drop_copies(_apart(docs)))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark windows are cut out; a document of nothing else goes."""
    found = decontam.find(_apart(docs), common.tables(spark, sf_dir, "benchmark"), clean="_clean")
    left = found.where("n_hit = 0 or n_hit < n_words")
    return _like(docs, left.withColumn("text", F.col("_clean")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and its text decoded from them, as digests."""
    out = bpe.encode_decode(docs.select("doc_id", "text"), queries.tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near-dedup", drop_near_copies), ("decontamination", cut_benchmark), ("encoding", encode)]

#: SQL can't express the learned and the tokenizing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.tables(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        own = common.Scratch(spark, name.replace(" ", "-"))
        docs = own.stored(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        before = own
    return docs
