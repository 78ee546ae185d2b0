"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, tokenisation, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.llm import bpe, language, lines, minhash, mixing
from orderflow.llm.shared import scratch

WEIGHTS = (5.0, 2.0, 1.0)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the decoder does not reject; null texts and texts without a letter go too. An empty table stays empty."""
    return language.accepted(docs, language.fit(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before, in equal form or but for a few edits; those left without any go.

    n_chars is counted anew where a text lost lines. Columns of any other names stay as they are.
    """
    removed = "__n_removed"
    x = lines.without_repeats(docs, names=("__n_lines", removed, "__n_links"))
    x = x.filter((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return x.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of smallest id."""
    gone = minhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A row is known by a hash of all its columns, so rows that share an id, or have none, are taken each on its own; rows
    equal in every column share what is taken of them.
    """
    key = F.xxhash64(F.struct(*docs.columns))
    mixed = mixing.mix_sources(docs.select(key.alias("doc_id"), "source", "text"), WEIGHTS)
    taken = mixed.groupBy(F.col("doc_id").alias("__key")).agg(F.sum("copies").alias("__all"), F.count(F.lit(1)).alias("__n")).filter("__all > 0")
    x = docs.withColumn("__key", key).join(taken, "__key")
    turn = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0)))
    same = x.filter("__n > 1").withColumn("__turn", turn).withColumn("__all", F.expr("__all DIV __n + IF(__turn <= __all % __n, 1, 0)")).drop("__turn")
    each = x.filter("__n = 1").unionByName(same.filter("__all > 0"))
    return each.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__all")))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and digest of what they decode to."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.token_digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("language", keep_languages), ("lines", drop_lines), ("near_duplicates", drop_near_duplicates), ("mix", mix), ("tokens", tokenize)]

#: The learned classifier, the edit join and the tokens have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        path = scratch(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
