"""The corpus pipeline: each stage takes what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packframe.llm import decontaminate, minhash, mixing, quality, sharding
from packframe.llm.common import cut, discard, mark, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts fail the rules; repeated rows are judged each; any further columns stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more. The smallest doc_id stays (null last, then by text); equal rows are one;
    texts without words are linked with nothing and stay, once for each doc_id."""
    return minhash.keep_one_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks. Each row is judged by its own text, whatever its doc_id; null and empty texts stay."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a document as often as it is taken, dealt to output shards and shuffled in each. Texts without words are never taken; a null source
    is a source; repeated rows are documents of their own; a text that is cut gets its n_chars anew."""
    return mixing.mix_documents(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document of the mix, repeats included; null and empty texts have size 16."""
    return sharding.assign(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mix_stage),
    ("sharding", shard_stage),
]

#: The stages' fitted trees, signatures and edit distances can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote on its way is deleted when its result is written; the results themselves stay."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        start = mark()
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, start, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
