"""Queries over files, archives on disk and streams. They write below the shared folder and read back."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import functions as F

from packframe.functions import bytes as fb
from packframe.operators import archive, checksums, png, shrink
from packframe.plans.base import query
from packframe.plans.transforms import MD5
from packframe.sources import datasource, sinks
from packframe.sources.files import chunked, files_from_dir, files_from_documents, table
from packframe.sources.shared import fresh_path
from packframe.streaming import archives as streams

PATHS = "SELECT concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, md5(text) AS digest FROM documents"


def _files(spark, sf_dir):
    return files_from_documents(table(spark, sf_dir, "documents"))


def _all(df) -> None:
    """Run what writes files."""
    df.write.format("noop").mode("overwrite").save()


@query(PATHS)
def files_roundtrip(spark, sf_dir):
    """Documents as files of a directory, and the directory read again."""
    root = fresh_path(spark, "files")
    _all(sinks.write_files(_files(spark, sf_dir), root))
    return files_from_dir(spark, root).select("path", F.md5("content").alias("digest"))


def _archived(spark, sf_dir, kind):
    root, files = fresh_path(spark, f"archives-{kind}"), _files(spark, sf_dir)
    _all(sinks.write_archives(files, root, sinks.archives_for(files, 24), kind))
    return root


@query(PATHS)
def pack_files_roundtrip(spark, sf_dir):
    """Archives as files, read by the data source, an archive a partition."""
    root = _archived(spark, sf_dir, "pack")
    datasource.register(spark)
    return spark.read.format("packarchive").option("path", root).load().select("path", F.md5("content").alias("digest"))


@query(PATHS)
def png_files_roundtrip(spark, sf_dir):
    """Directories as compressed archives in images, read again."""
    return sinks.read_archives(spark, _archived(spark, sf_dir, "png")).select("path", F.md5("content").alias("digest"))


@query("SELECT concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, strlen(text)::BIGINT AS size FROM documents")
def png_list_files(spark, sf_dir):
    """What the list chunks of the images say, without reading image data."""
    root = _archived(spark, sf_dir, "png")
    datasource.register(spark)
    listed = spark.read.format("pngchunks").option("path", root).option("types", "rXFL").load()
    entries = F.from_json(F.decode("data", "UTF-8"), "array<struct<name:string,size:bigint>>")
    return listed.select(F.explode(entries).alias("e")).select(F.col("e.name").alias("path"), "e.size")


@query("SELECT concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def extract_files(spark, sf_dir):
    """Requested files out of archives of all layouts; each archive is read until its last requested file."""
    files, names = _files(spark, sf_dir), table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    n = sinks.archives_for(files, 24)
    where = F.pmod(F.xxhash64("path"), F.lit(n)).cast("int")
    wanted = files.join(names, "id", "left_semi").select(where.alias("archive"), "path").groupBy("archive").agg(F.collect_list("path").alias("names"))  # the request, by archive

    def read(batches):
        for batch in batches:
            for value, asked in zip(batch.column("content"), batch.column("names"), strict=True):
                b = value.as_py()
                for out in sinks.bounded(archive.unpack_stream((b[i : i + 4096] for i in range(0, len(b), 4096)), asked.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([c for _, c in out], pa.binary())], ["path", "content"])

    parts = [sinks.archives_of(files.filter(where % 3 == i), n, kind) for i, kind in enumerate(("pack", "indexed", "table"))]
    made = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("archive", "content")
    return made.join(wanted, "archive").select("content", "names").mapInArrow(read, "path string, content binary").select("path", F.md5("content").alias("digest"))


@query("SELECT concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, strlen(text)::BIGINT AS size FROM documents")
def tar_listing(spark, sf_dir):
    """Files of tar archives, by the headers alone."""

    def read(batches):
        for batch in batches:
            for b in batch.column("content"):
                out = archive.tar_list(io.BytesIO(b.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([s for _, s in out], pa.int64())], ["path", "size"])

    files = _files(spark, sf_dir)
    return sinks.archives_of(files, sinks.archives_for(files, 24), "tar").select("content").mapInArrow(read, "path string, size long")


@query(MD5)
def png_stream_roundtrip(spark, sf_dir):
    """Payloads written to image files in pieces and read in pieces, range by range."""

    def trip(b):
        f = io.BytesIO()
        png.write_image(f, (b[i : i + 1000] for i in range(0, len(b), 1000)), len(b), "x", None, 4096)
        return b"".join(png.payload_stream(f if not f.seek(0) else f))

    return _files(spark, sf_dir).select("id", fb.md5_function(trip)(F.col("content")).alias("digest"))


@query(MD5)
def png_optimise_roundtrip(spark, sf_dir):
    """Images made smaller (filters, palettes, deflate settings), whose payloads stay; none is larger than before."""

    def trip(b):
        image = png.encode_payload(b)
        small = shrink.optimise(image)
        if len(small) > len(image):
            raise ValueError("larger than before")
        return png.decode_payload(small)[1]

    return _files(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism * 4).select("id", fb.md5_function(trip)(F.col("content")).alias("digest"))


@query("""WITH hx AS (SELECT doc_id AS id, hex(encode(text)) AS h FROM documents)
SELECT id, md5(coalesce(string_agg(c, '' ORDER BY pos), '')) AS digest FROM (SELECT id, unnest(range(0, length(h) // 2)) AS pos, unnest(regexp_extract_all(h, '..')) AS c FROM hx) WHERE pos % 64 <> 0 GROUP BY id""")
def scanline_strip(spark, sf_dir):
    """Documents as rows of a filter byte and 21 pixels: what is left without the filter bytes."""

    def strip(b):
        return b"".join(b[i + 1 : i + 64] for i in range(0, len(b), 64)).hex().upper().encode()

    return _files(spark, sf_dir).filter("size > 1").select("id", fb.md5_function(strip)(F.col("content")).alias("digest"))


@query("""WITH hx AS (SELECT doc_id AS id, hex(encode(text)) AS h FROM documents),
t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n::BIGINT, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t)
SELECT id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda c, v: xor(t[xor(c, v) % 256 + 1], c // 256)))::BIGINT AS crc FROM hx, t""")
def crc32_combined(spark, sf_dir):
    """CRC-32 of documents in chunks: each chunk's where it is, then combined in order."""
    x = chunked(_files(spark, sf_dir), 700).select("id", F.struct("chunk", F.crc32("content").alias("crc"), F.octet_length("content").cast("long").alias("n")).alias("c"))
    parts = x.groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("c"))  # three numbers a chunk
    return parts.select("id", fb.binary_function(lambda c: checksums.combine_all([(e["crc"], e["n"]) for e in c]), "bigint")(F.col("c")).alias("crc"))


@query("SELECT event_type AS key, count(*) AS entries, sum(strlen(props))::BIGINT AS bytes FROM events GROUP BY event_type")
def archive_microbatches(spark, sf_dir):
    """Events arrive in micro-batches: running sums of each type's chunks, of which the last state counts."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("number"), F.encode("props", "UTF-8").alias("content"))
    arrived, out = fresh_path(spark, "arrived"), fresh_path(spark, "running-sums")
    events.repartitionByRange(4, "number").write.parquet(arrived)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    chunks = spark.readStream.schema("key string, number long, content binary").option("maxFilesPerTrigger", 2).parquet(arrived)

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch-{number:06d}")

    running = streams.running_sums(chunks).writeStream.outputMode("update").foreachBatch(write)
    query_ = running.option("checkpointLocation", fresh_path(spark, "running-sums-state")).trigger(availableNow=True).start()
    query_.awaitTermination()
    states = spark.read.option("recursiveFileLookup", True).schema(f"{streams.SUMS}, batch int").parquet(out)
    last = states.groupBy("key").agg(F.max_by(F.struct("entries", "bytes", "crc", "adler"), "batch").alias("s"))
    return last.select("key", "s.entries", "s.bytes")


@query(PATHS)
def archive_stream_roundtrip(spark, sf_dir):
    """Files arrive in a directory, micro-batches write archives, and the archives are read."""
    arrived, out = fresh_path(spark, "arriving"), fresh_path(spark, "stream-archives")
    _all(sinks.write_files(_files(spark, sf_dir), arrived))
    files = streams.arriving_files(spark, arrived, 4000)
    base = F.lit(arrived.removeprefix("file:").lstrip("/") + "/")
    relative = F.expr("substring(path, instr(path, base) + length(base))")
    streams.archive_stream(files.withColumn("base", base).select(relative.alias("path"), "content"), out, fresh_path(spark, "stream-state")).awaitTermination()
    return sinks.read_archives(spark, out).select("path", F.md5("content").alias("digest"))


