"""File collections as DataFrames: (id, path, size, content)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_from_documents(docs: DataFrame) -> DataFrame:
    """A document is the file SOURCE/LANG/doc_ID.txt with its UTF-8 text."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(F.col("doc_id").alias("id"), path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("content"))


def _relative(root: str):
    base = re.escape(root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/")
    return F.replace(F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", ""), "^.*?" + base, ""), F.lit("\\"), F.lit("/"))


FILES_A_TASK = 500


def _empty_files(index: DataFrame, found) -> DataFrame:
    """Files without a byte: Spark's file index has their names (found, which stay in the JVM), but its scans leave them out."""
    spark = index.sparkSession
    jvm = spark._jvm
    names = DataFrame(spark._jsparkSession.createDataset(jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(found), jvm.org.apache.spark.sql.Encoders.STRING()), spark)
    path = F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))  # names are encoded as in a URI, where a plus is itself
    names = names.select(F.regexp_replace(path, r"^(\w+):///", "$1:/").alias("path"))
    empty = names.join(index.select("path"), "path", "left_anti")
    return empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def files_from_dir(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Regular files under root, empty ones as well, with paths relative to it (forward slashes); content is read only if it is used. A task gets
    FILES_A_TASK files or so: Spark counts 4 MB for opening one, which would make a task for each few.
    As everywhere in Spark, files and folders whose names begin with a dot or an underscore are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    index = reader.load(root)
    found = index._jdf.inputFiles()
    index = index.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-len(found) // FILES_A_TASK)))
    every = index.select("path", "length", "content").unionByName(_empty_files(index, found))
    return every.select(F.xxhash64("path").alias("id"), _relative(root).alias("path"), F.col("length").alias("size"), "content")


def files_from_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files and directories together: directories are expanded, a file keeps its last name."""
    if not paths:
        return spark.createDataFrame([], "id long, path string, size long, content binary")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    out = None
    for p in paths:  # the stated list of inputs, not data
        where = hadoop(p)
        status = where.getFileSystem(conf).getFileStatus(where)
        one = files_from_dir(spark, p) if status.isDirectory() else spark.read.format("binaryFile").load(p).select(F.xxhash64("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("size"), "content")
        out = one if out is None else out.unionByName(one)
    return out


def directory_size(spark: SparkSession, root: str) -> int:
    return files_from_dir(spark, root).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


CHUNK = 64 << 20


def chunked(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """(id, path, chunk, content) with at most size bytes a row, for checksums and codecs that work in parts."""
    n = F.greatest(F.ceil(F.octet_length("content") / size), F.lit(1)).cast("int")
    x = files.select("id", "path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return x.select("id", "path", "chunk", F.expr(f"substring(content, chunk * {size} + 1, {size})").alias("content"))
