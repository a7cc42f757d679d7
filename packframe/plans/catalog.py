"""Queries over file catalogs: order, offsets, selection, names, policy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packframe.functions import bytes as fb
from packframe.functions import policy as po
from packframe.operators import archive
from packframe.operators.order import greedy_blocks, running
from packframe.plans.base import BYTES, ENTROPY, FILES, query, shared_sql
from packframe.sources.files import files_from_documents, table
from packframe.sources.sinks import archives_for


def _entry():
    """Bytes of a file's record: two of name length, eight of size, name and content."""
    return F.lit(10) + F.octet_length("path") + F.col("size")


def _files(spark, sf_dir) -> DataFrame:
    return files_from_documents(table(spark, sf_dir, "documents"))


def _aligned(size):
    return F.ceil(size / 4096.0).cast("long") * 4096


EXT_SQL = po.ext_of("path", "other")
LEVEL = po.adaptive_level("(size + 4)", "e", 19)


@query(f"""WITH {FILES}, {BYTES}, bb AS (SELECT * FROM b WHERE pos < 16384),
hist AS (SELECT id, b, count(*) AS n FROM b GROUP BY id, b),
ent AS (SELECT id, -sum(n / t * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY id) AS t FROM hist) GROUP BY id),
h2 AS (SELECT id, b, count(*) AS n FROM bb GROUP BY id, b),
e2 AS (SELECT id, -sum(n / t * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY id) AS t FROM h2) GROUP BY id),
f AS (SELECT f.*, {EXT_SQL} AS ext, coalesce(ent.e, 0) AS whole, coalesce(e2.e, 4) AS e FROM files f LEFT JOIN ent USING (id) LEFT JOIN e2 USING (id))
SELECT path, ext, size, round(whole, 4) AS entropy, {LEVEL}::INT AS level,
  row_number() OVER (ORDER BY ext, path) AS position,
  coalesce(sum(10 + strlen(path) + size) OVER w, 0)::BIGINT AS entry_offset,
  coalesce(sum(ceil(size / 4096.0)::BIGINT * 4096) OVER w, 0)::BIGINT AS aligned_offset
FROM f WINDOW w AS (ORDER BY ext, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def archive_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and offsets need paths and sizes only; entropies join them by file, so contents are read once and never sorted."""
    files = _files(spark, sf_dir)
    placed = running(files.select("id", "path", "size", F.expr(po.ext_of("path", "spark")).alias("ext")), ["ext", "path"], {"entry_offset": _entry(), "aligned_offset": _aligned(F.col("size"))}, "position")
    measured = files.select("id", fb.entropy_pair(F.col("content"), 16384, 4.0).alias("m"))
    x = placed.join(measured, "id").withColumn("e", F.col("m.sample"))
    return x.select("path", "ext", "size", F.round("m.whole", 4).alias("entropy"), F.expr(LEVEL).cast("int").alias("level"), "position", "entry_offset", "aligned_offset")


shared_sql("catalog_total_bytes", "SELECT source, CAST(sum(BYTES(text)) AS BIGINT) AS total_bytes, count(*) AS entries FROM {documents} GROUP BY source")


@query(f"""WITH {FILES} SELECT path AS name, size FROM files""")
def catalog_json_roundtrip(spark, sf_dir):
    """Each file's catalog entry through JSON and back; the tolerated spelling path stands for name."""
    x = _files(spark, sf_dir)
    listed = x.select(F.to_json(F.array(F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.col("path").alias("name"), "size"))).otherwise(F.to_json(F.struct("path", "size"))))).alias("j"))
    back = listed.select(F.explode(F.from_json("j", "array<string>")).alias("e")).select(F.from_json("e", "struct<name:string,path:string,size:bigint>").alias("e"))
    return back.select(F.coalesce("e.name", "e.path").alias("name"), F.coalesce("e.size", F.lit(0)).alias("size"))


@query(f"""WITH {FILES}, u AS (SELECT path FROM files UNION ALL SELECT concat('pages/', page_id, '.html') FROM pages)
SELECT path, {EXT_SQL} AS ext, row_number() OVER (ORDER BY {EXT_SQL}, path) AS position FROM u""")
def ext_clustered_order(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"))
    x = _files(spark, sf_dir).select("path").unionByName(pages).withColumn("ext", F.expr(po.ext_of("path", "spark")))
    return running(x, ["ext", "path"], {}, "position")


@query(f"""WITH {FILES} SELECT path, coalesce(sum(10 + strlen(path) + size) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS entry_offset FROM files""")
def pack_offsets(spark, sf_dir):
    return running(_files(spark, sf_dir).select("path", "size"), ["path"], {"entry_offset": _entry()}).select("path", "entry_offset")


@query(f"""WITH {FILES} SELECT path, size, coalesce(sum(ceil(size / 4096.0)::BIGINT * 4096) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS aligned_offset FROM files""")
def vfs_aligned_offsets(spark, sf_dir):
    return running(_files(spark, sf_dir).select("path", "size"), ["path"], {"aligned_offset": _aligned(F.col("size"))})


BLOCK = 64 << 10


@query(f"""WITH RECURSIVE {FILES},
o AS (SELECT *, 10 + strlen(path) + size AS n, regexp_extract(path, '^(.*)/', 1) AS dir, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/', 1) ORDER BY path) AS k FROM files),
r AS (SELECT dir, path, k, n AS cur, 0 AS block FROM o WHERE k = 1
  UNION ALL SELECT o.dir, o.path, o.k, CASE WHEN r.cur + o.n > {BLOCK} THEN o.n ELSE r.cur + o.n END, r.block + CASE WHEN r.cur + o.n > {BLOCK} THEN 1 ELSE 0 END
  FROM r JOIN o ON o.dir = r.dir AND o.k = r.k + 1)
SELECT dir, path, block::BIGINT AS block_id FROM r""")
def index_block_ids(spark, sf_dir):
    """Greedy blocks of each directory's archive, folded over its sizes in order: a directory is sorted by Spark and read batch by batch, with the state handed on,
    so that no directory is held."""
    x = _files(spark, sf_dir).select(F.regexp_extract("path", "^(.*)/", 1).alias("dir"), "path", _entry().alias("n"))
    return greedy_blocks(x, BLOCK)


@query(f"""WITH {FILES} SELECT id, path, size FROM files WHERE id IN (SELECT doc_id FROM labels)""")
def select_files(spark, sf_dir):
    want = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return _files(spark, sf_dir).join(want, "id", "left_semi").select("id", "path", "size")


@query(r"""SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(url, '[/\\]'), lambda s: translate(s, ':*?"<>|', '_______')), lambda s: s NOT IN ('', '.', '..')), '/') AS safe_path FROM pages""")
def sanitize_paths(spark, sf_dir):
    parts = F.transform(F.split("url", r"[/\\]"), lambda s: F.translate(F.translate(s, "\0", ""), ':*?"<>|', "_______"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.filter(parts, lambda s: ~s.isin("", ".", "..")), "/").alias("safe_path"))


@query(r"""SELECT item_id, coalesce(nullif(translate(trim(text, E' \t\n\r'), '/\:*?"<>|', '_________'), ''), 'file') AS flat_name FROM benchmark""")
def flat_names(spark, sf_dir):
    name = F.translate(F.regexp_replace("text", r"^[ \t\n\r]+|[ \t\n\r]+$", ""), '/\\:*?"<>|\0', "__________")
    return table(spark, sf_dir, "benchmark").select("item_id", F.coalesce(F.nullif(name, F.lit("")), F.lit("file")).alias("flat_name"))


@query(r"""WITH w AS (SELECT item_id, unnest(string_split(regexp_replace(text, '[\[\]"]', '', 'g'), ',')) AS n FROM benchmark)
SELECT item_id, trim(n, E' \t\n\r') AS name FROM w WHERE trim(n, E' \t\n\r') <> ''""")
def requested_list_parse(spark, sf_dir):
    """A list is JSON if it starts with a bracket, else it is split at commas; both kinds are made from the items."""
    x = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r'[\[\]"]', "").alias("t"))
    as_json = F.to_json(F.split("t", ","))
    x = x.withColumn("arg", F.when(F.col("item_id") % 2 == 0, as_json).otherwise(F.col("t")))
    names = F.when(F.substring("arg", 1, 1) == "[", F.from_json("arg", "array<string>")).otherwise(F.split("arg", ","))
    clean = F.filter(F.transform(names, lambda s: F.regexp_replace(s, r"^[ \t\n\r]+|[ \t\n\r]+$", "")), lambda s: s != "")
    return x.select("item_id", F.explode(clean).alias("name"))


@query(f"""WITH {FILES}, k AS (SELECT *, id % 6 AS k FROM files)
SELECT id, ['pack', 'indexed', 'table', 'zstd', 'png', 'raw'][(k + 1)::INT] AS format, k IN (0, 1, 2) AS is_archive,
 (size >= 1) AS valid_payload FROM k""")
def format_sniff(spark, sf_dir):
    """Formats told by their first bytes, after a prefix is put before each text; valid payloads start with a plain envelope."""
    magic = F.element_at(F.array(*[F.unhex(F.lit(m)) for m in ("524F5850", "524F5849", "524F5856", "28B52FFD", "89504E47", "")]), (F.col("id") % 6 + 1).cast("int"))
    x = _files(spark, sf_dir).withColumn("c", F.concat(magic, "content")).withColumn("p", F.concat(F.unhex(F.lit("00")), F.unhex(F.lit("524F5831")), "content"))
    kinds = {"524F5850": "pack", "524F5849": "indexed", "524F5856": "table", "28B52FFD": "zstd", "89504E47": "png"}
    fmt = F.lit("raw")
    for m, name in kinds.items():
        fmt = F.when(F.startswith("c", F.unhex(F.lit(m))), name).otherwise(fmt)
    flag = F.conv(F.hex(F.substring("p", 1, 1)), 16, 10).cast("int")
    inner = F.hex(F.substring("p", 2, 4))
    valid = (F.octet_length("p") > 5) & (flag.isin(1, 2, 3) | ((flag == 0) & inner.isin("524F5831", "28B52FFD")))
    return x.select("id", fmt.alias("format"), fmt.isin("pack", "indexed", "table").alias("is_archive"), valid.alias("valid_payload"))


shared_sql(
    "multi_path_union",
    """SELECT concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, CAST(BYTES(text) AS BIGINT) AS size FROM {documents}
UNION ALL SELECT concat('pages/', page_id, '.html'), CAST(BYTES(html) AS BIGINT) FROM {pages}
UNION ALL SELECT concat('conv_', conv_id, '/', turn, '.', role), CAST(BYTES(text) AS BIGINT) FROM {conversations}""",
)


@query(f"WITH {BYTES} SELECT b AS byte, count(*) AS n FROM b GROUP BY b")
def byte_histogram(spark, sf_dir):
    """Each batch's counts are added up where it is; 256 rows of a batch are combined before the shuffle."""

    def run(batches):
        for batch in batches:
            n = fb.counts_of(batch.column("content")).sum(0)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], ["byte", "k"])

    return _files(spark, sf_dir).select("content").mapInArrow(run, "byte int, k long").groupBy("byte").agg(F.sum("k").alias("n"))


@query(f"WITH {BYTES}, {ENTROPY} SELECT d.doc_id AS id, round(coalesce(e, 0), 4) AS entropy FROM documents d LEFT JOIN ent ON ent.id = d.doc_id")
def byte_entropy(spark, sf_dir):
    return _files(spark, sf_dir).select("id", F.round(fb.entropy_of(F.col("content")), 4).alias("entropy"))


@query(f"""WITH {BYTES}, bx AS (SELECT * FROM b WHERE pos < 16384), hist AS (SELECT id, b, count(*) AS n FROM bx GROUP BY id, b),
ent AS (SELECT id, -sum(n / t * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY id) AS t FROM hist) GROUP BY id)
SELECT d.doc_id AS id, round(coalesce(e, 4), 4) AS entropy FROM documents d LEFT JOIN ent ON ent.id = d.doc_id""")
def sampled_entropy(spark, sf_dir):
    """The operator looks at the first 16 KiB; without bytes it says 4."""
    return _files(spark, sf_dir).select("id", F.round(fb.entropy_of(F.col("content"), 16384, 4.0), 4).alias("entropy"))


@query(f"WITH {BYTES}, {ENTROPY} SELECT d.doc_id AS id, round((1 - coalesce(e, 0) / 8) * 100, 4) AS gain FROM documents d LEFT JOIN ent ON ent.id = d.doc_id")
def estimated_gain(spark, sf_dir):
    return _files(spark, sf_dir).select("id", F.round((1 - fb.entropy_of(F.col("content")) / 8) * 100, 4).alias("gain"))


@query(f"""WITH {BYTES}, bx AS (SELECT * FROM b WHERE pos < 4096), hist AS (SELECT id, b, count(*) AS n FROM bx GROUP BY id, b),
ent AS (SELECT id, -sum(n / t * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY id) AS t FROM hist) GROUP BY id)
SELECT d.doc_id AS id, round(coalesce(e, 0), 4) AS entropy FROM documents d LEFT JOIN ent ON ent.id = d.doc_id""")
def head_entropy(spark, sf_dir):
    """What a compression report says of a file: its first 4 KiB's entropy."""
    return _files(spark, sf_dir).select("id", F.round(fb.entropy_of(F.col("content"), 4096), 4).alias("entropy"))


_SIZES = "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * l_quantity * 997) AS BIGINT) AS size, l_discount * 80 + l_tax AS e FROM {lineitem}"
shared_sql("adaptive_level", f"WITH s AS ({_SIZES}) SELECT l_orderkey, l_linenumber, CAST({po.adaptive_level('(size + 4)', 'e', 19)} AS INT) AS level FROM s")
shared_sql("dir_size_cap", f"WITH s AS ({_SIZES}), t AS (SELECT l_orderkey, CAST(sum(size) AS BIGINT) AS total FROM s GROUP BY l_orderkey) SELECT l_orderkey, total, CAST({po.ladder('total', po.DIR_CAPS)} AS INT) AS cap FROM t")
shared_sql(
    "window_log",
    f"WITH s AS ({_SIZES}) SELECT l_orderkey, l_linenumber, CAST({po.ladder('size', po.WINDOW_LOGS)} AS INT) AS encode_log, CAST({po.ladder('size', po.DECODE_WINDOW_LOGS)} AS INT) AS decode_log, CASE WHEN size > {256 << 10} THEN CAST({po.ladder('size', po.MEMORY_WINDOW_LOGS)} AS INT) END AS memory_log, size > {32 << 20} AS long_distance FROM s",
)
shared_sql("codec_route", f"WITH s AS ({_SIZES}) SELECT l_orderkey, l_linenumber, {po.codec_route('size', 'e')} AS route FROM s")
shared_sql("stream_predicate", f"WITH s AS ({_SIZES}) SELECT l_orderkey, l_linenumber, {po.stream_predicate('size', '(l_linenumber = 1)', '(l_orderkey % 4096)')} AS streams FROM s")

_NAMED = "SELECT doc_id AS id, BYTES(text) AS size, BYTES(concat(source, '/', lang, '/doc_', doc_id, '.txt')) AS name_len FROM {documents}"
_SIDE = po.png_side("size", "least(name_len, 255)", "(name_len + 20)")
shared_sql("png_geometry", f"WITH f AS ({_NAMED}) SELECT id, {_SIDE} AS side FROM f")
shared_sql("png_file_size", f"WITH f AS ({_NAMED}), g AS (SELECT *, {_SIDE} AS side FROM f) SELECT id, side, {po.png_file_size('side', '(name_len + 20)')} AS file_size FROM g")
shared_sql("idat_split", f"WITH s AS ({_SIZES}) SELECT l_orderkey, l_linenumber, CAST(ceil(size / {64.0 * (1 << 20)}) AS BIGINT) AS chunks, CASE WHEN size = 0 THEN 0 ELSE (size - 1) % {64 << 20} + 1 END AS last_chunk FROM s")
shared_sql("stored_block_count", f"WITH s AS ({_SIZES}) SELECT l_orderkey, l_linenumber, CAST(greatest(1, ceil(size / 65535.0)) AS BIGINT) AS blocks, CAST(2 + 5 * greatest(1, ceil(size / 65535.0)) + size + 4 AS BIGINT) AS stream_bytes FROM s")
shared_sql("ecc_geometry", "SELECT doc_id AS id, level, CAST(ceil(BYTES(text) / (255.0 - nsym)) AS BIGINT) AS blocks, CAST(12 + 255 * ceil(BYTES(text) / (255.0 - nsym)) AS BIGINT) AS encoded FROM {documents}, (VALUES ('low', 20), ('medium', 40), ('quartile', 64), ('high', 128)) AS v(level, nsym)")
_ECC = "CAST(12 + 255 * ceil(BYTES(text) / 215.0) AS BIGINT)"
shared_sql("robust_image_geometry", f"WITH e AS (SELECT doc_id AS id, 8 * (14 + {_ECC}) AS bits FROM {{documents}}), s AS (SELECT *, {po.image_side('bits')} AS side FROM e) SELECT id, bits, side, side * side - 256 AS capacity, side * 4 AS pixels, bits <= side * side - 256 AS fits FROM s")
shared_sql("robust_audio_geometry", f"WITH e AS (SELECT doc_id AS id, {_ECC} AS n FROM {{documents}}) SELECT id, 4096 + (4 + n) * 2560 + 8820 AS samples, 44 + 2 * (4096 + (4 + n) * 2560 + 8820) AS wav_bytes FROM e")


@query(f"""WITH {FILES}, c AS (SELECT path, sum(size) OVER (ORDER BY path) AS done, sum(size) OVER () AS total FROM files)
SELECT path, (10 + least(done * 89 // total, 89))::BIGINT AS percent FROM c""")
def progress_percent(spark, sf_dir):
    x = running(_files(spark, sf_dir).select("path", "size"), ["path"], {"before": F.col("size")})
    total = x.groupBy().agg(F.sum("size").alias("total"))
    return x.crossJoin(F.broadcast(total)).select("path", (10 + F.least(F.floor((F.col("before") + F.col("size")) * 89 / F.col("total")), F.lit(89))).cast("long").alias("percent"))


@query(f"""WITH {FILES} SELECT regexp_extract(path, '^(.*)/', 1) AS dir, count(*) AS entries FROM files GROUP BY 1""")
def entry_count(spark, sf_dir):
    """Entries of each directory, counted in archives of its files: by the headers, without reading entries. A directory is dealt over archives, whose counts are added."""

    def count(key, rows):
        kind = (archive.pack, archive.indexed, archive.offset_table)[key[1].as_py() % 3]
        made = kind(list(zip(rows["path"].to_pylist(), rows["content"].to_pylist(), strict=True)))
        return pa.table({"dir": pa.array([key[0].as_py()], pa.string()), "n": pa.array([archive.count_entries(b"ROX1" + made)], pa.int64())})

    files = _files(spark, sf_dir)
    x = files.select(F.regexp_extract("path", "^(.*)/", 1).alias("dir"), F.pmod(F.xxhash64("path"), F.lit(archives_for(files, 12))).cast("int").alias("part"), "path", "content")
    return x.groupBy("dir", "part").applyInArrow(count, "dir string, n long").groupBy("dir").agg(F.sum("n").alias("entries"))
