"""What the training-data operators share: text conventions, sizing, and tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packframe.sources.shared import fresh_path, remove

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


_cuts: list[str] = []  # tables written and not yet discarded


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet into the shared folder and read back: the lineage ends there,
    a lost executor costs nothing that was written, and later jobs read only the columns they use."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    _cuts.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    return len(_cuts)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the tables cut since the mark, but for the last ``keep``. For callers who know that nothing reads them any more."""
    upto = len(_cuts) - keep
    for path in _cuts[since:upto]:
        remove(spark, path)
    del _cuts[since:upto]


def join_hot(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with facts, which have each key once, with its count of rows out of total. Keys with over 1/1024 of all rows (so 1024 at most)
    are broadcast: their rows stay where they are, and no task gets all rows of a hot key."""
    hot = F.col(count) * 1024 > total
    cold = rows.join(F.broadcast(facts.filter(hot).select(key)), key, "left_anti")
    return rows.join(F.broadcast(facts.filter(hot)), key).unionByName(cold.join(facts.filter(~hot), key))


SIEVE, PAGE = 1 << 26, 1 << 15  # bits of a sieve at most, and of a row of it


def sieve(rows: DataFrame, found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The rows whose keys (nulls too) are among found's, of which there are n at most, and a few others: wide rows that a join with found drops needn't be shuffled for it.
    The hashes of found's keys are set bits in a bitmap of 8 MB at most, which is broadcast in pages; the more keys beyond 1 << 26, the more other rows pass."""
    bits = min(SIEVE, 1 << max(PAGE.bit_length() - 1, (8 * n).bit_length()))
    at = F.pmod(F.xxhash64(*keys), F.lit(bits))
    page, bit = F.floor(at / PAGE).alias("_page"), (at % PAGE).alias("_bit")
    pages = found.select(page, bit).repartition("_page").groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = rows.select("*", page, bit).join(F.broadcast(pages), "_page").filter(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1)
    return hit.select(*rows.columns)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads (of their files, or of literals); where one isn't known, the bytes of df's texts are counted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if size < 1 << 50:
        return size
    return df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2


def parts(df: DataFrame, mb: float) -> int:
    """Partitions of about mb MB of df's estimated size, and no fewer than the session's shuffle partitions."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(input_bytes(df) / (mb * 1e6)) + 1)


def values(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table of literals, held by the plan itself."""
    return spark.createDataFrame(rows, ddl)
