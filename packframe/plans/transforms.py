"""Queries over byte transforms and codecs. Round trips return the MD5 of what comes back."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from packframe.functions import bytes as fb
from packframe.operators import archive, codecs, ecc, envelope, png
from packframe.plans.base import BYTES, query
from packframe.sources.files import files_from_documents, table

MD5 = "SELECT doc_id AS id, md5(text) AS digest FROM documents"


def _files(spark, sf_dir):
    return files_from_documents(table(spark, sf_dir, "documents"))


def _trip(spark, sf_dir, there_and_back):
    return _files(spark, sf_dir).select("id", fb.md5_function(there_and_back)(F.col("content")).alias("digest"))


def _trips(spark, sf_dir, there_and_back):
    """As _trip, of many values together."""
    return _files(spark, sf_dir).select("id", fb.md5_of_many(there_and_back)(F.col("content")).alias("digest"))


def _bytes(spark, sf_dir, f):
    """(id, pos, b) of f(content), exploded."""

    def places(b):
        x = np.frombuffer(f(b), np.uint8)
        return np.arange(len(x), dtype=np.int32), x

    return fb.exploded(_files(spark, sf_dir), "content", places, "pos int, b int")


@query(f"""WITH {BYTES} SELECT id, ((sum((t - pos) * b) + max(t)) % 65521 * 65536 + (1 + sum(b)) % 65521)::BIGINT AS adler
FROM (SELECT *, count(*) OVER (PARTITION BY id) AS t FROM b) GROUP BY id UNION ALL SELECT doc_id, 1 FROM documents WHERE text = ''""")
def adler32_check(spark, sf_dir):
    return _files(spark, sf_dir).select("id", fb.adler32(F.col("content")).alias("adler"))


@query("""WITH hx AS (SELECT doc_id AS id, hex(encode(text)) AS h FROM documents),
t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n::BIGINT, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t)
SELECT id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda c, v: xor(t[xor(c, v) % 256 + 1], c // 256)))::BIGINT AS crc FROM hx, t""")
def crc32_check(spark, sf_dir):
    return _files(spark, sf_dir).select("id", F.crc32("content").alias("crc"))


@query(f"WITH {BYTES} SELECT id, pos::INT AS pos, ((b - coalesce(lag(b) OVER (PARTITION BY id ORDER BY pos), 0) + 256) % 256)::INT AS b FROM b")
def delta_encode(spark, sf_dir):
    return _bytes(spark, sf_dir, codecs.delta)


@query(MD5)
def delta_roundtrip(spark, sf_dir):
    return _trip(spark, sf_dir, lambda b: codecs.undelta(codecs.delta(b)))


@query(f"""WITH {BYTES}, n AS (SELECT b AS sym, count(*) AS c FROM b GROUP BY b), f AS (SELECT *, greatest(floor(c * 4096 / sum(c) OVER ()), 1)::BIGINT AS f FROM n),
k AS (SELECT *, 4096 - sum(f) OVER () AS off, row_number() OVER (ORDER BY c DESC, sym) AS r FROM f)
SELECT sym, (f + CASE WHEN r = 1 THEN off ELSE 0 END)::BIGINT AS freq FROM k""")
def symbol_freqs_4096(spark, sf_dir):
    """Frequencies of all documents' bytes, scaled to 4096; the surplus fits the most frequent symbol here."""
    x = _files(spark, sf_dir).select(F.posexplode(fb.histogram(F.col("content"))).alias("sym", "k")).groupBy("sym").agg(F.sum("k").alias("k"))
    whole = x.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("sym", "k"))), lambda s: s["k"]).alias("h"))  # 256 rows
    scaled = whole.select(F.posexplode(fb.binary_function(lambda h: codecs.normalize(np.asarray(h)), "array<bigint>")(F.col("h"))).alias("sym", "freq"))
    return scaled.filter("freq > 0")


@query(f"""WITH {BYTES}, p AS (SELECT b, lag(b) OVER (PARTITION BY id ORDER BY pos) AS context FROM b)
SELECT context, b AS sym, count(*) AS n FROM p WHERE context IS NOT NULL GROUP BY context, b""")
def order1_contexts(spark, sf_dir):
    def pairs(b):
        x = np.frombuffer(b, np.uint8).astype(np.int64)
        keys, n = np.unique(x[:-1] * 256 + x[1:], return_counts=True)
        return [(int(k), int(c)) for k, c in zip(keys, n, strict=True)]

    x = _files(spark, sf_dir).select(F.explode(fb.binary_function(pairs, "array<struct<k:bigint,n:bigint>>")(F.col("content"))).alias("p"))
    return x.groupBy(F.floor(F.col("p.k") / 256).cast("int").alias("context"), (F.col("p.k") % 256).cast("int").alias("sym")).agg(F.sum("p.n").alias("n"))


@query()
def bwt_block(spark, sf_dir):
    def block(b):
        last, row = codecs.bwt(b)
        return {"primary_index": row, "last_column": hashlib.md5(last).hexdigest()}

    x = _files(spark, sf_dir).select("id", fb.binary_function(block, "struct<primary_index:bigint,last_column:string>")(F.col("content")).alias("r"))
    return x.select("id", "r.primary_index", "r.last_column")


@query(MD5)
def bwt_roundtrip(spark, sf_dir):
    return _trip(spark, sf_dir, lambda b: codecs.unbwt(*codecs.bwt(b)))


@query(f"""WITH {BYTES}, o AS (SELECT id, pos, b, lag(pos) OVER w AS p, lead(pos) OVER w AS nx FROM b WINDOW w AS (PARTITION BY id, b ORDER BY pos)),
gap AS (SELECT id, pos, unnest(range(p + 1, pos)) AS q FROM o WHERE pos > p + 1),
again AS (SELECT gap.id, gap.pos, count(*) AS move FROM gap JOIN o ON o.id = gap.id AND o.pos = gap.q WHERE o.nx IS NULL OR o.nx > gap.pos GROUP BY gap.id, gap.pos),
first AS (SELECT f.id, f.pos, f.b + count(g.b) AS move FROM o f LEFT JOIN o g ON g.id = f.id AND g.p IS NULL AND g.pos < f.pos AND g.b > f.b WHERE f.p IS NULL GROUP BY f.id, f.pos, f.b)
SELECT move::INT AS move, count(*) AS n FROM (SELECT move FROM again UNION ALL SELECT move FROM first UNION ALL SELECT 0 FROM o WHERE pos = p + 1) GROUP BY move""")
def mtf_ranks(spark, sf_dir):
    """How often each rank occurs over all documents. A rank is the number of different bytes since the byte's last occurrence; at its first, what
    the table's order and the bytes before it make of it."""
    x = _files(spark, sf_dir).select(F.posexplode(fb.histogram(fb.many_function(codecs.mtf_all)(F.col("content")))).alias("move", "k")).filter("k > 0")
    return x.groupBy("move").agg(F.sum("k").alias("n"))


@query(MD5)
def mtf_roundtrip(spark, sf_dir):
    return _trips(spark, sf_dir, lambda v: codecs.unmtf_all(codecs.mtf_all(v)))


def _runs(b):
    x = np.frombuffer(b, np.uint8) == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], x.view(np.int8), [0]])))
    return np.diff(edge)[::2]


_DELTA = f"""WITH {BYTES}, d AS (SELECT id, pos, (b - coalesce(lag(b) OVER (PARTITION BY id ORDER BY pos), 0) + 256) % 256 AS d FROM b),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY id, d = 0 ORDER BY pos) AS g FROM d), r AS (SELECT id, g, count(*) AS run FROM g WHERE d = 0 GROUP BY id, g)"""


@query(f"{_DELTA} SELECT id, count(*) AS runs, sum(run)::BIGINT AS zeros, max(run) AS longest FROM r GROUP BY id")
def zero_runs(spark, sf_dir):
    """Zero runs of the delta-coded bytes."""
    x = _files(spark, sf_dir).select("id", fb.binary_function(lambda b: _runs(codecs.delta(b)), "array<bigint>")(F.col("content")).alias("r")).filter(F.size("r") > 0)
    return x.select("id", F.size("r").cast("long").alias("runs"), F.aggregate("r", F.lit(0).cast("long"), lambda a, v: a + v).alias("zeros"), F.array_max("r").alias("longest"))


@query(f"{_DELTA} SELECT id, (sum(bits) + 7)::BIGINT // 8 AS coded_bytes FROM (SELECT id, 9 AS bits FROM d WHERE d <> 0 UNION ALL SELECT id, 2 + 2 * floor(log2(run + 1)) FROM r UNION ALL SELECT doc_id, 0 FROM documents WHERE text = '') GROUP BY id")
def rle0_bits(spark, sf_dir):
    return _files(spark, sf_dir).select("id", fb.binary_function(lambda b: len(codecs.rle0(codecs.delta(b))), "bigint")(F.col("content")).alias("coded_bytes"))


@query(MD5)
def rle0_roundtrip(spark, sf_dir):
    return _trip(spark, sf_dir, lambda b: codecs.undelta(codecs.unrle0(codecs.rle0(codecs.delta(b)), len(b))))


@query(MD5)
def rans_roundtrip(spark, sf_dir):
    return _trips(spark, sf_dir, lambda v: codecs.rans_unpack_all(codecs.rans_pack_all(v)))


@query(MD5)
def hybrid_roundtrip(spark, sf_dir):
    return _trips(spark, sf_dir, lambda v: codecs.unhybrid_all(codecs.hybrid_all(v)))


@query()
def hybrid_report(spark, sf_dir):
    x = _files(spark, sf_dir).select("id", "size", fb.many_function(lambda v: [len(x) for x in codecs.hybrid_all(v)], "bigint")(F.col("content")).alias("packed"))
    return x.withColumn("ratio", F.when(F.col("size") > 0, F.col("packed") / F.col("size")).otherwise(0.0))


@query(MD5)
def zstd_roundtrip(spark, sf_dir):
    return _trip(spark, sf_dir, lambda b: codecs.unzstd(codecs.zstd(b, 3)))


@query(MD5)
def zstd_dict_roundtrip(spark, sf_dir):
    """A dictionary from the texts with the smallest hashes (512 at most), used for all documents."""
    x = _files(spark, sf_dir)
    rows = x.orderBy(F.xxhash64("id"), "id").select(F.substring("content", 1, 8192).alias("c")).limit(512).collect()
    dictionary = codecs.train_dictionary([bytes(r.c) for r in rows], 16 << 10)
    shared = spark.sparkContext.broadcast(dictionary)  # 16 KiB
    return x.select("id", fb.md5_function(lambda b: codecs.unzstd(codecs.zstd(b, 3, shared.value), shared.value))(F.col("content")).alias("digest"))


@query(MD5)
def zstd_chunked_roundtrip(spark, sf_dir):
    return _trip(spark, sf_dir, lambda b: codecs.unzstd_chunked(codecs.zstd_chunked(b, 1024)))


# ---- encryption; a count of key iterations that suits a query, the format's own is the default

PASS, SALT, ROUNDS = "passphrase", bytes(range(16)), 1000


@query(f"""WITH {BYTES}, k AS (SELECT 'passphrase' AS k)
SELECT id, md5(string_agg(printf('%02X', xor(b, ascii(k[(pos % 10 + 1)::INT]))), '' ORDER BY pos)) AS digest FROM b, k GROUP BY id UNION ALL SELECT doc_id, md5('') FROM documents WHERE text = ''""")
def xor_cipher(spark, sf_dir):
    x = _files(spark, sf_dir).withColumn("e", envelope.xor_encrypt(F.col("content"), PASS))
    return x.select("id", F.md5(F.hex(F.expr("substring(e, 2)")).cast("binary")).alias("digest"))


@query(MD5)
def aes_gcm_roundtrip(spark, sf_dir):
    x = envelope.gcm_encrypt(_files(spark, sf_dir), "content", "e", PASS, SALT, ROUNDS)
    return envelope.gcm_decrypt(x, "e", "d", PASS, SALT, ROUNDS).select("id", F.md5("d").alias("digest"))


@query(MD5)
def aes_ctr_hmac_roundtrip(spark, sf_dir):
    x = envelope.ctr_encrypt(_files(spark, sf_dir), "content", "e", PASS, SALT, ROUNDS)
    return envelope.ctr_decrypt(x, "e", "d", PASS, SALT, ROUNDS).select("id", F.md5("d").alias("digest"))


@query("SELECT doc_id AS id, true AS gcm_refused, true AS ctr_refused FROM documents")
def tamper_detected(spark, sf_dir):
    last = lambda c: F.conv(F.hex(F.substring(c, -1, 1)), 16, 10).cast("long").bitwiseXOR(F.lit(1))
    flip = lambda c: F.concat(F.expr(f"substring({c}, 1, octet_length({c}) - 1)"), F.unhex(F.lpad(F.hex(last(c)), 2, "0")))
    x = envelope.gcm_encrypt(_files(spark, sf_dir), "content", "g", PASS, SALT, ROUNDS)
    x = envelope.ctr_encrypt(x, "content", "c", PASS, SALT, ROUNDS).withColumn("g", flip("g")).withColumn("c", flip("c"))
    x = envelope.ctr_decrypt(envelope.gcm_decrypt(x, "g", "gd", PASS, SALT, ROUNDS), "c", "cd", PASS, SALT, ROUNDS)
    return x.select("id", F.col("gd").isNull().alias("gcm_refused"), F.col("cd").isNull().alias("ctr_refused"))


@query("SELECT doc_id AS id, doc_id % 4 <> 0 AS has_passphrase FROM documents")
def passphrase_flag(spark, sf_dir):
    x = envelope.gcm_encrypt(_files(spark, sf_dir), "content", "g", PASS, SALT, ROUNDS)
    x = envelope.ctr_encrypt(x, "content", "c", PASS, SALT, ROUNDS).withColumn("x", envelope.xor_encrypt(F.col("content"), PASS)).withColumn("p", F.concat(F.unhex(F.lit("00")), "content"))
    e = F.element_at(F.array("p", "g", "x", "c"), (F.col("id") % 4 + 1).cast("int"))
    return x.select("id", F.conv(F.hex(F.substring(e, 1, 1)), 16, 10).cast("int").isin(1, 2, 3).alias("has_passphrase"))


# ---- archives: one for each run of files of a partition, so no archive gathers a whole source

FILES = 1024  # of an archive


def _archives(spark, sf_dir, there, back):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                part = batch.slice(at, FILES)
                names, contents = ([x or empty for x in part.column(c).to_pylist()] for c, empty in (("path", ""), ("content", b"")))
                read = back(there(list(zip(names, contents, strict=True))))
                digests = [hashlib.md5(c).hexdigest() if n == name else None for name, (n, c) in zip(names, read, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(digests, pa.string(), mask=np.asarray(part.column("content").is_null()))], ["id", "digest"])

    return _files(spark, sf_dir).select("id", "path", "content").mapInArrow(run, "id long, digest string")


@query(MD5)
def pack_roundtrip(spark, sf_dir):
    return _archives(spark, sf_dir, archive.pack, archive.unpack)


@query(MD5)
def roxi_roundtrip(spark, sf_dir):
    return _archives(spark, sf_dir, lambda e: archive.indexed(e, 64 << 10), archive.unpack)


@query(MD5)
def vfs_roundtrip(spark, sf_dir):
    return _archives(spark, sf_dir, archive.offset_table, archive.unpack)


@query(MD5)
def tar_roundtrip(spark, sf_dir):
    return _archives(spark, sf_dir, archive.tar, archive.untar)


# ---- images


def _images(spark, sf_dir):
    make = fb.binary_function(lambda name, b: png.encode_payload(b"\0" + b, name, f'[{{"name":"{name}","size":{len(b)}}}]'))
    return _files(spark, sf_dir).select("id", "path", "size", make(F.col("path"), F.col("content")).alias("image"))


_PNG = """WITH f AS (SELECT doc_id AS id, concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, strlen(text) AS size FROM documents),
j AS (SELECT *, strlen(path) + length(size::VARCHAR) + 21 AS jl FROM f),
m AS (SELECT *, ceil((4 + 10 + strlen(path) + 1 + size + 8 + jl) / 3.0) * 3 AS padded FROM j),
s AS (SELECT *, greatest(ceil(sqrt(ceil((12 + padded) / 3.0) + 3)), 3)::BIGINT AS side FROM m)"""


@query(f"{_PNG} SELECT id, unnest(['IHDR', 'IDAT', 'rXFL', 'IEND']) AS type, unnest([13, 6 + 5 * ceil(side * (3 * side + 1) / 65535.0)::BIGINT + side * (3 * side + 1), jl, 0])::BIGINT AS length FROM s")
def png_chunks(spark, sf_dir):
    listed = fb.binary_function(lambda b: [(k, len(d)) for k, _, d, _ in png.chunks(b)], "array<struct<type:string,length:bigint>>")
    return _images(spark, sf_dir).select("id", F.explode(listed(F.col("image"))).alias("c")).select("id", "c.type", "c.length")


@query(f"{_PNG} SELECT id, side AS width, side AS height, 8 AS depth, 2 AS colour FROM s")
def png_metadata(spark, sf_dir):
    n = lambda at, size: F.conv(F.hex(F.substring("image", at, size)), 16, 10).cast("long")
    return _images(spark, sf_dir).select("id", n(17, 4).alias("width"), n(21, 4).alias("height"), n(25, 1).cast("int").alias("depth"), n(26, 1).cast("int").alias("colour"))


@query(MD5)
def png_payload_roundtrip(spark, sf_dir):
    return _images(spark, sf_dir).select("id", fb.md5_function(lambda b: png.decode_payload(b)[1][1:])(F.col("image")).alias("digest"))


@query("SELECT doc_id AS id, concat(source, '/', lang, '/doc_', doc_id, '.txt') AS name, strlen(text)::BIGINT AS size FROM documents")
def png_file_list(spark, sf_dir):
    listed = F.from_json(fb.binary_function(png.file_list, "string")(F.col("image")), "array<struct<name:string,size:bigint>>")
    return _images(spark, sf_dir).select("id", F.explode(listed).alias("e")).select("id", "e.name", "e.size")


@query()
def smallest_encoding(spark, sf_dir):
    """The smallest of several deflate settings for each page."""
    import zlib

    def sizes(b):
        out = []
        for level in (1, 6, 9):
            for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FILTERED, zlib.Z_HUFFMAN_ONLY, zlib.Z_RLE):
                c = zlib.compressobj(level, zlib.DEFLATED, 15, 9, strategy)
                out.append((level, strategy, len(c.compress(b) + c.flush())))
        return out

    x = table(spark, sf_dir, "pages").select("page_id", fb.binary_function(sizes, "array<struct<level:int,strategy:int,size:bigint>>")(F.encode("html", "UTF-8")).alias("t"))
    best = F.array_min(F.transform("t", lambda t: F.struct(t["size"].alias("size"), t["level"].alias("level"), t["strategy"].alias("strategy"))))
    return x.select("page_id", best["size"].alias("size"), best["level"].alias("level"), best["strategy"].alias("strategy"))


# ---- error correction


@query("""WITH RECURSIVE t AS (SELECT 0 AS i, 1 AS v UNION ALL SELECT i + 1, CASE WHEN v * 2 >= 256 THEN xor(v * 2, 285) ELSE v * 2 END FROM t WHERE i < 254) SELECT i, v FROM t""")
def gf_tables(spark, sf_dir):
    return spark.sql("WITH RECURSIVE t(i, v) MAX RECURSION LEVEL 300 AS (SELECT 0, 1 UNION ALL SELECT i + 1, CASE WHEN v * 2 >= 256 THEN (v * 2) ^ 285 ELSE v * 2 END FROM t WHERE i < 254) SELECT i, v FROM t")


#: Powers and logarithms as lists (log of 0: null), and a product of two bytes by them.
_FIELD = """e AS (SELECT 0 AS i, 1 AS v UNION ALL SELECT i + 1, CASE WHEN v * 2 >= 256 THEN xor(v * 2, 285) ELSE v * 2 END FROM e WHERE i < 254),
f AS (SELECT list(v ORDER BY i) AS ex, list_prepend(NULL, list(i ORDER BY v)) AS lg FROM e)"""
_TIMES = "coalesce(f.ex[(f.lg[({0})::INT + 1] + f.lg[({1})::INT + 1]) % 255 + 1], 0)"
#: Forty bytes that xor adds up, as five 64-bit words; and their hexadecimal digits in order.
_PACKED = ", ".join(f"bit_or(CASE WHEN j // 8 = {w} THEN v::UBIGINT << (8 * (j % 8))::UBIGINT ELSE 0::UBIGINT END) AS w{w}" for w in range(5))
_ADDED = ", ".join(f"bit_xor(w{w}) AS w{w}" for w in range(5))
_HEX = " || ".join(f"printf('%02x', ((w{j // 8} >> {8 * (j % 8)}::UBIGINT) & 255::UBIGINT)::INT)" for j in range(40))


def _by_blocks(values, k, f):
    """f's row of each block of k bytes of each value, in hexadecimal digits; the blocks of all values are computed together."""
    counts = [-(-len(b) // k) for b in values]
    data = np.frombuffer(b"".join(b.ljust(n * k, b"\0") for b, n in zip(values, counts, strict=True)), np.uint8).reshape(-1, k)
    rows = iter([w.tobytes().hex() for w in f(data)])
    return [[next(rows) for _ in range(n)] for n in counts]


@query(f"""WITH RECURSIVE {_FIELD}, {BYTES},
g AS (SELECT 0 AS k, list_prepend(1, list_transform(range(0, 40), lambda x: 0)) AS c UNION ALL
  SELECT k + 1, list_transform(range(1, 42), lambda n: xor(c[n], CASE WHEN n > 1 THEN {_TIMES.format("c[n - 1]", "f.ex[k + 1]")} ELSE 0 END)::INT) FROM g, f WHERE k < 40),
r AS (SELECT 214 AS i, c[2:41] AS rest, c FROM g WHERE k = 40 UNION ALL
  SELECT i - 1, list_transform(range(1, 41), lambda n: xor(coalesce(rest[n + 1], 0), {_TIMES.format("rest[1]", "c[n + 1]")})::INT), c FROM r, f WHERE i > 0),
t AS (SELECT i, s.b, j, {_TIMES.format("rest[j + 1]", "s.b")} AS v FROM r, f, range(1, 256) AS s(b), range(0, 40) AS n(j)),
u AS (SELECT i, b, {_PACKED} FROM t GROUP BY i, b)
SELECT id, pos // 215 AS block, {_HEX} AS parity FROM (SELECT id, pos // 215 * 215 AS pos, {_ADDED} FROM (SELECT b.id, b.pos, {", ".join(f"coalesce(w{w}, 0::UBIGINT) AS w{w}" for w in range(5))} FROM b LEFT JOIN u ON u.i = b.pos % 215 AND u.b = b.b) GROUP BY id, pos // 215)""")
def rs_parity(spark, sf_dir):
    """Parity bytes (medium level) of each block of each document."""

    def parity(values):
        return _by_blocks(values, ecc.N - 40, lambda data: ecc.parity(data, 40))

    x = _files(spark, sf_dir).select("id", F.posexplode(fb.many_function(parity, "array<string>")(F.col("content"))).alias("block", "parity"))
    return x.select("id", F.col("block").cast("long").alias("block"), "parity")


@query(f"""WITH RECURSIVE {_FIELD}, {BYTES},
t AS (SELECT p.i, s.b, j, f.ex[(f.lg[s.b + 1] + j * (254 - p.i)) % 255 + 1] AS v FROM f, range(0, 255) AS p(i), range(1, 256) AS s(b), range(0, 40) AS n(j)),
u AS (SELECT i, b, {_PACKED} FROM t GROUP BY i, b)
SELECT id, block, {_HEX} AS syndromes FROM (SELECT id, pos // 255 AS block, {_ADDED} FROM (SELECT b.id, b.pos, {", ".join(f"coalesce(w{w}, 0::UBIGINT) AS w{w}" for w in range(5))} FROM b LEFT JOIN u ON u.i = b.pos % 255 AND u.b = b.b) GROUP BY id, pos // 255)""")
def rs_syndromes(spark, sf_dir):
    """Syndromes of each document's bytes, taken as received words of 255 symbols: they are no code words, so hardly any is zero."""

    def syndromes(values):
        return _by_blocks(values, ecc.N, lambda words: ecc.syndromes(words, 40).astype(np.uint8))

    x = _files(spark, sf_dir).select("id", F.posexplode(fb.many_function(syndromes, "array<string>")(F.col("content"))).alias("block", "syndromes"))
    return x.select("id", F.col("block").cast("long").alias("block"), "syndromes")


def _damaged(b: bytes) -> bytes:
    """As many wrong bytes in each block as can be put right."""
    n = int.from_bytes(b[10:12], "big")
    out = np.frombuffer(b, np.uint8).copy()
    words = out[12:].reshape(255, n)
    i = np.arange(n)
    words[(np.arange(20)[:, None] * 11 + i) % 255, i] ^= (1 + i % 255).astype(np.uint8)
    return out.tobytes()


@query("SELECT doc_id AS id, md5(text) AS digest, (20 * ceil(strlen(text) / 215.0))::BIGINT AS corrected FROM documents")
def rs_correct(spark, sf_dir):
    def fix(values):
        return [{"digest": hashlib.md5(data).hexdigest(), "corrected": n} for data, n in ecc.decode_all([_damaged(b) for b in ecc.encode_all(values)])]

    x = _files(spark, sf_dir).select("id", fb.many_function(fix, "struct<digest:string,corrected:bigint>")(F.col("content")).alias("r"))
    return x.select("id", "r.digest", "r.corrected")


@query(f"""WITH {BYTES}, g AS (SELECT id, pos, b, ceil(count(*) OVER (PARTITION BY id) / 255.0)::BIGINT AS n FROM b)
SELECT id, (pos % 255 * n + pos // 255)::BIGINT AS pos, b::INT AS b FROM g""")
def interleave(spark, sf_dir):
    def places(b):
        n = -(-len(b) // 255)
        pos = np.arange(len(b))
        return pos % 255 * n + pos // 255, np.frombuffer(b, np.uint8)

    return fb.exploded(_files(spark, sf_dir), "content", places, "pos long, b int")


@query(MD5)
def ecc_roundtrip(spark, sf_dir):
    """Many values' blocks are encoded and checked together."""
    return _trips(spark, sf_dir, lambda v: [b for b, _ in ecc.decode_all(ecc.encode_all(v, "low"))])
