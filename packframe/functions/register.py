"""The codecs and parsers as SQL functions: register(spark), then SELECT pf_delta(content), * FROM pf_entries(...)."""

from __future__ import annotations

import zlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from packframe.functions import bytes as fb
from packframe.operators import archive, checksums, codecs, ecc, grid, png, robust, shrink, signal

#: name -> (function of one value, type)
SCALARS = {
    "pf_delta": (codecs.delta, "binary"),
    "pf_undelta": (codecs.undelta, "binary"),
    "pf_zstd": (codecs.zstd_by_policy, "binary"),
    "pf_unzstd": (codecs.unzstd, "binary"),
    "pf_hybrid": (lambda b: codecs.hybrid(b), "binary"),
    "pf_unhybrid": (codecs.unhybrid, "binary"),
    "pf_bwt": (lambda b: dict(zip(("last", "row"), codecs.bwt(b), strict=True)), "struct<last:binary,row:bigint>"),
    "pf_mtf": (codecs.mtf, "binary"),
    "pf_rle0": (codecs.rle0, "binary"),
    "pf_entropy": (codecs.entropy_bits, "double"),
    "pf_adler32": (lambda b: zlib.adler32(b), "bigint"),
    "pf_ecc": (lambda b: ecc.encode(b), "binary"),
    "pf_unecc": (lambda b: ecc.decode(b)[0], "binary"),
    "pf_png": (lambda b: png.encode_payload(b), "binary"),
    "pf_png_payload": (lambda b: png.find_payload(b)[2], "binary"),
    "pf_png_name": (png.find_name, "string"),
    "pf_png_list": (png.file_list, "string"),
    "pf_png_optimise": (lambda b: shrink.optimise(b), "binary"),
    "pf_robust_image": (lambda b: robust.encode_image(b), "binary"),
    "pf_robust_image_data": (lambda b: robust.decode_image(b)[0], "binary"),
    "pf_robust_audio": (lambda b: signal.encode_audio(b), "binary"),
    "pf_robust_audio_data": (lambda b: signal.decode_audio(b)[0], "binary"),
    "pf_find": (lambda b: grid.find_all(b), "array<bigint>"),
    "pf_entry_count": (archive.count_entries, "bigint"),
}


@udtf(returnType="path: string, size: bigint, content: binary")
class Entries:
    """The files in an archive of any kind."""

    def eval(self, content: bytes):
        from packframe.sources.sinks import entries_of

        for name, body in entries_of("", bytes(content or b"")):
            yield name, len(body), body


@udtf(returnType="seq: int, type: string, offset: bigint, length: bigint, crc: bigint, data: binary")
class Chunks:
    """The chunks of a PNG file."""

    def eval(self, content: bytes):
        for seq, (kind, at, data, crc) in enumerate(png.chunks(bytes(content or b""))):
            yield seq, kind, at, len(data), crc, data


def crc32_of_chunks(chunk, content):
    """CRC-32 of a value that comes in rows (chunk number, bytes), as an aggregate: each row's own is computed in Spark, a few numbers a row are combined in order."""
    parts = F.array_sort(F.collect_list(F.struct(chunk.alias("chunk"), F.crc32(content).alias("crc"), F.octet_length(content).cast("long").alias("n"))))
    return fb.binary_function(lambda c: checksums.combine_all([(e["crc"], e["n"]) for e in c]), "bigint")(parts)


def register(spark: SparkSession) -> None:
    """All of the above, and the data sources."""
    from packframe.sources import datasource

    for name, (f, kind) in SCALARS.items():
        spark.udf.register(name, fb.arrow_function(f, kind))
    spark.udtf.register("pf_entries", Entries)
    spark.udtf.register("pf_chunks", Chunks)
    datasource.register(spark)
