"""How queries are registered: a function of (spark, sf_dir), and SQL for the same rows where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packframe.sources.files import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: (what the shared text says, Spark, other engines)
WORDS = (("BYTES", "octet_length", "strlen"), ("ARRAY_AT", "element_at", "list_extract"))


def shared_sql(name: str, text: str) -> None:
    """A query whose text both engines read, but for WORDS; tables are written in braces."""
    spark_text, other = text, re.sub(r"\{(\w+)\}", r"\1", text)
    for word, here, there in WORDS:
        spark_text, other = re.sub(rf"\b{word}\b", here, spark_text), re.sub(rf"\b{word}\b", there, other)
    used = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_text, **{t: table(spark, sf_dir, t) for t in used})

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, other


#: Common table expressions of the SQL side.
FILES = "files AS (SELECT doc_id AS id, concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, strlen(text)::BIGINT AS size, text FROM documents)"
BYTES = """hx AS (SELECT doc_id AS id, hex(encode(text)) AS h FROM documents),
b AS (SELECT id, unnest(range(0, length(h) // 2)) AS pos, ('0x' || unnest(regexp_extract_all(h, '..')))::INT AS b FROM hx)"""
ENTROPY = """hist AS (SELECT id, b, count(*) AS n FROM b GROUP BY id, b),
ent AS (SELECT id, sum(n) AS total, -sum(n / t * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY id) AS t FROM hist) GROUP BY id)"""
