"""Queries over pixel grids and tones. A page's bytes in triples are its pixels, 64 to a row; an embedding's numbers are a grid of eight columns, or a signal."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from packframe.functions import bytes as fb
from packframe.operators import grid, robust, shrink, signal
from packframe.plans.base import BYTES, query, shared_sql
from packframe.sources.files import files_from_documents, table

WIDTH = 64
#: c: a pixel's colour as six hexadecimal digits.
PIXELS = """hp AS (SELECT page_id AS id, hex(encode(html)) AS h FROM pages),
px AS (SELECT id, unnest(range(0, length(h) // 6)) AS i, unnest(regexp_extract_all(h, '.{6}')) AS c FROM hp)"""


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.encode("html", "UTF-8").alias("content"))


def _codes(b: bytes) -> np.ndarray:
    """Pixels as numbers r << 16 | g << 8 | b."""
    x = np.frombuffer(b, np.uint8, len(b) // 3 * 3).reshape(-1, 3).astype(np.int32)
    return x[:, 0] << 16 | x[:, 1] << 8 | x[:, 2]


def _rows(b: bytes) -> list[np.ndarray]:
    codes = _codes(b)
    return [codes[i : i + WIDTH] for i in range(0, len(codes), WIDTH)]


def changes(codes: np.ndarray) -> tuple[int, int]:
    """How often the colour changes along the rows, and down the columns."""
    across = codes[1:] != codes[:-1]
    across[WIDTH - 1 :: WIDTH] = False  # from a row to the next
    return int(across.sum()), int((codes[WIDTH:] != codes[:-WIDTH]).sum())


# ---- scans


@query("""WITH p AS (SELECT doc_id AS id, unnest(string_split(text, 'tion')) AS part, unnest(range(0, len(string_split(text, 'tion')))) AS k FROM documents),
o AS (SELECT id, k, sum(strlen(part) + 4) OVER (PARTITION BY id ORDER BY k) - 4 AS place, max(k) OVER (PARTITION BY id) AS last FROM p)
SELECT id, k, place::BIGINT AS place FROM o WHERE k < last""")
def pattern_scan(spark, sf_dir):
    """Byte offsets of a pattern in each document, none overlapping."""
    found = fb.binary_function(lambda b: grid.find_all(b, b"tion"), "array<bigint>")
    x = files_from_documents(table(spark, sf_dir, "documents"))
    return x.select("id", F.posexplode(found(F.col("content"))).alias("k", "place")).select("id", F.col("k").cast("long").alias("k"), "place")


MARKERS = "60:47:100, 32:99:108 116:104:101, 300:1:1, x:y:z"


@query(f"WITH {PIXELS} SELECT id, i AS pixel FROM px WHERE c IN ('3C2F64', '20636C', '746865')")
def marker_scan(spark, sf_dir):
    """Pixels of a marker's colour; the list of markers is given as text, in which what is no colour is dropped."""
    markers = grid.parse_markers(MARKERS)
    found = fb.binary_function(lambda b: grid.marker_pixels(b, 3, markers), "array<bigint>")
    return _pages(spark, sf_dir).select("id", F.explode(found(F.col("content"))).alias("pixel"))


@query(r"""WITH w AS (SELECT page_id AS id, unnest(string_split(regexp_replace(html, '[^0-9]+', ':', 'g'), ':')) AS v, unnest(range(0, len(string_split(regexp_replace(html, '[^0-9]+', ':', 'g'), ':')))) AS k FROM pages),
t AS (SELECT id, k // 3 AS g, list(v ORDER BY k) AS v FROM w GROUP BY id, k // 3)
SELECT id, count(*) AS markers FROM t WHERE len(v) = 3 AND len(list_filter(v, lambda s: regexp_full_match(s, '[0-9]+') AND length(s) < 10 AND coalesce(try_cast(s AS BIGINT), 256) < 256)) = 3 GROUP BY id""")
def marker_list(spark, sf_dir):
    """How many valid markers r:g:b the numbers of each page make, three by three."""
    numbers = F.split(F.regexp_replace(F.decode("content", "UTF-8"), "[^0-9]+", ":"), ":")
    x = _pages(spark, sf_dir).withColumn("w", numbers).withColumn("t", F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 3).cast("int")), lambda i: F.slice("w", i * 3 + 1, 3)))
    fine = lambda s: s.rlike("^[0-9]+$") & (F.char_length(s) < 10) & (F.coalesce(F.when(F.char_length(s) < 10, s).try_cast("bigint"), F.lit(256)) < 256)
    good = F.filter("t", lambda t: (F.size(t) == 3) & F.forall(t, fine))
    return x.select("id", F.size(good).cast("long").alias("markers")).filter("markers > 0")


# ---- runs


@query(f"""WITH {PIXELS}, s AS (SELECT id, i, i // {WIDTH} AS y, c, CASE WHEN c = lag(c) OVER (PARTITION BY id, i // {WIDTH} ORDER BY i) THEN 0 ELSE 1 END AS new FROM px),
g AS (SELECT id, y, sum(new) OVER (PARTITION BY id, y ORDER BY i) AS g FROM s), r AS (SELECT id, y, g, count(*) AS n FROM g GROUP BY id, y, g)
SELECT id, count(*) AS runs, max(n) AS longest, count(*) FILTER (n > 1) AS wide FROM r GROUP BY id""")
def colour_runs(spark, sf_dir):
    """Runs of equal pixels along the rows of each page."""

    def measure(b):
        sizes = np.concatenate([grid.runs(row)[1] for row in _rows(b)] or [np.zeros(0, np.int64)])
        return [len(sizes), int(sizes.max(initial=0)), int((sizes > 1).sum())]

    x = _pages(spark, sf_dir).select("id", fb.binary_function(measure, "array<bigint>")(F.col("content")).alias("r")).filter("r[0] > 0")
    return x.select("id", F.col("r")[0].alias("runs"), F.col("r")[1].alias("longest"), F.col("r")[2].alias("wide"))


@query(f"""WITH {PIXELS}, s AS (SELECT id, (c <> lag(c) OVER (PARTITION BY id, i // {WIDTH} ORDER BY i))::INT AS across, (c <> lag(c, {WIDTH}) OVER (PARTITION BY id ORDER BY i))::INT AS down FROM px)
SELECT id, coalesce(sum(across), 0)::BIGINT AS across, coalesce(sum(down), 0)::BIGINT AS down FROM s GROUP BY id""")
def transition_counts(spark, sf_dir):
    """Changes of colour along the rows and down the columns."""

    def measure(b):
        codes = _codes(b)
        return [len(codes), *changes(codes)]

    x = _pages(spark, sf_dir).select("id", fb.binary_function(measure, "array<bigint>")(F.col("content")).alias("r")).filter("r[0] > 0")
    return x.select("id", F.col("r")[1].alias("across"), F.col("r")[2].alias("down"))


@query(f"""WITH {PIXELS}, s AS (SELECT id, i // {WIDTH} AS y, i % {WIDTH} AS x, c, lag(c) OVER (PARTITION BY id, i // {WIDTH} ORDER BY i) AS b, count(*) OVER (PARTITION BY id, i // {WIDTH}) AS n FROM px)
SELECT id, coalesce(sum((c <> b AND floor((x - 0.5) * 16 / {WIDTH}) = floor((x + 0.5) * 16 / {WIDTH}))::INT), 0)::BIGINT AS inner_changes FROM s WHERE n = {WIDTH} GROUP BY id""")
def inner_transitions(spark, sf_dir):
    """Changes along whole rows that a logical row of 16 cells has inside its cells."""
    f = fb.binary_function(lambda b: sum(grid.inner_transitions(r, 16) for r in _rows(b) if len(r) == WIDTH) if len(b) >= 3 * WIDTH else None, "bigint")
    return _pages(spark, sf_dir).select("id", f(F.col("content")).alias("inner_changes")).filter("inner_changes is not null")


# ---- grids of embeddings

_CELLS = """e AS (SELECT vec_id, unnest(embedding) AS e, unnest(range(0, len(embedding))) AS i FROM embeddings),
v AS (SELECT vec_id, i, i % 8 AS x, i // 8 AS y, (floor(abs(e::DOUBLE) * 1000)::BIGINT % 256) AS v FROM e)"""


def _cells(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    value = F.floor(F.abs(F.col("e").cast("double")) * 1000).cast("long") % 256
    return x.select("vec_id", "i", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), value.alias("v"))


def _small(spark, sf_dir):
    """Each embedding as pixels (v, i, 255 - i), eight to a row."""
    value = lambda e: F.floor(F.abs(e.cast("double")) * 1000).cast("long") % 256
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", value).alias("v"))


@query(f"WITH {_CELLS} SELECT vec_id, 8 AS width, (max(i) // 8 + 1)::INT AS height, md5(string_agg(printf('%02X%02X%02X', v, i, 255 - i), '' ORDER BY i)) AS digest FROM v GROUP BY vec_id HAVING count(*) % 8 = 0 AND count(*) <= 256")
def unstretch_roundtrip(spark, sf_dir):
    """Each grid is stretched by whole factors, put on white, and found again without border and repetition."""

    def trip(vec_id, v):
        if len(v) % 8 or len(v) > 256:
            return None
        i = np.arange(len(v))
        small = np.stack([np.asarray(v), i, 255 - i], 1).astype(np.uint8).reshape(-1, 8, 3)
        big = np.pad(grid.stretch(small, 2 + vec_id % 3, 1 + vec_id % 4), ((3, 2), (1, 4), (0, 0)), constant_values=255)
        back = grid.unstretch(big)
        return {"width": back.shape[1], "height": back.shape[0], "hex": back.tobytes().hex().upper()}

    x = _small(spark, sf_dir).select("vec_id", fb.binary_function(trip, "struct<width:int,height:int,hex:string>")(F.col("vec_id"), F.col("v")).alias("r")).filter("r is not null")
    return x.select("vec_id", "r.width", "r.height", F.md5("r.hex").alias("digest"))


@query(f"WITH {_CELLS} SELECT vec_id, (x // 2)::INT AS bx, (y // 2)::INT AS by, list_sort(list(v))[len(list(v)) // 2 + 1] AS median FROM v GROUP BY vec_id, x // 2, y // 2")
def block_median(spark, sf_dir):
    """The upper median of each block of two by two cells; the lists have four entries."""
    x = _cells(spark, sf_dir).groupBy("vec_id", F.floor(F.col("x") / 2).cast("int").alias("bx"), F.floor(F.col("y") / 2).cast("int").alias("by")).agg(F.array_sort(F.collect_list("v")).alias("v"))
    return x.select("vec_id", "bx", "by", F.element_at("v", F.floor(F.size("v") / 2).cast("int") + 1).alias("median"))


@query(f"WITH {_CELLS} SELECT vec_id, (x // 2)::INT AS bx, (y // 2)::INT AS by, sum(v) > 128 * count(*) AS white FROM v GROUP BY vec_id, x // 2, y // 2")
def block_majority(spark, sf_dir):
    """Whether a block's mean is above the middle."""
    x = _cells(spark, sf_dir).groupBy("vec_id", F.floor(F.col("x") / 2).cast("int").alias("bx"), F.floor(F.col("y") / 2).cast("int").alias("by"))
    return x.agg((F.sum("v") > 128 * F.count("*")).alias("white"))


@query(f"WITH {_CELLS} SELECT vec_id, y * 4 + x // 2 AS i, v FROM v WHERE x % 2 = 1")
def resize_nearest(spark, sf_dir):
    """Grids at half their width, by the nearest cell."""

    def half(v):
        x = np.asarray(v[: len(v) // 8 * 8]).reshape(-1, 8, 1)
        return grid.resize(x, 4, len(x)).ravel().tolist() + [v[i] for i in range(len(v) // 8 * 8, len(v)) if i % 8 % 2 == 1]

    x = _small(spark, sf_dir).select("vec_id", F.posexplode(fb.binary_function(half, "array<bigint>")(F.col("v"))).alias("i", "v"))
    return x.select("vec_id", F.col("i").cast("long").alias("i"), "v")


SCALES = (1.5, 2.0, 2.3, 3.0, 4.7, 6.0, 8.0)


@query("SELECT scale, true AS found FROM (VALUES " + ", ".join(f"({s}::DOUBLE)" for s in SCALES) + ") AS s(scale)")
def reconstitute_synthetic(spark, sf_dir):
    """A grid of 30 by 30 noise pixels between markers, scaled and set in a picture of noise, is found again."""

    def found(scale):
        g = np.random.default_rng(11)
        small = g.integers(0, 256, (30, 30, 3)).astype(np.uint8)
        small[0, :3], small[-1, -3:] = [grid.RED, grid.GREEN, grid.BLUE], [grid.BLUE, grid.GREEN, grid.RED]
        n = int(30 * scale)
        picture = g.integers(0, 256, (400, 400, 3)).astype(np.uint8)
        at = np.arange(n) * 30 // n
        picture[37 : 37 + n, 51 : 51 + n] = small[at][:, at]
        back = grid.reconstitute(picture)
        return back.shape == small.shape and bool((back == small).all())

    return spark.createDataFrame([(s,) for s in SCALES], "scale double").select("scale", fb.binary_function(found, "boolean")(F.col("scale")).alias("found"))


# ---- colours and filters


@query(f"""WITH {PIXELS}, n AS (SELECT id, c, count(*) AS n, min(i) AS first FROM px GROUP BY id, c)
SELECT id, least(count(*), 257)::BIGINT AS colours, (CASE WHEN count(*) <= 2 THEN 1 WHEN count(*) <= 4 THEN 2 WHEN count(*) <= 16 THEN 4 ELSE 8 END)::INT AS depth,
 arg_min(c, (-n, first)) AS top_colour, max(n) AS top_count, (SELECT sum(m.n)::BIGINT FROM (SELECT n FROM n AS k WHERE k.id = n.id ORDER BY k.n DESC, k.first LIMIT 256) AS m) AS top_pixels FROM n GROUP BY id""")
def palette_stats(spark, sf_dir):
    """Distinct colours (257 stand for more), the depth of an index into them, the commonest one, and the pixels that the 256 commonest cover."""

    def stats(b):
        codes = _codes(b)
        if not len(codes):
            return None
        names, n = grid.colours(codes, len(codes))
        top = np.argsort(-n, kind="stable")[:256]
        return {"colours": min(len(names), 257), "depth": grid.bit_depth(len(names)), "top_colour": f"{names[top[0]]:06X}", "top_count": int(n[top[0]]), "top_pixels": int(n[top].sum())}

    kind = "struct<colours:bigint,depth:int,top_colour:string,top_count:bigint,top_pixels:bigint>"
    return _pages(spark, sf_dir).select("id", fb.binary_function(stats, kind)(F.col("content")).alias("r")).filter("r is not null").select("id", "r.*")


@query(f"""WITH hb AS (SELECT page_id AS id, hex(encode(html)) AS h FROM pages),
b AS (SELECT id, unnest(range(0, length(h) // {6 * WIDTH} * {3 * WIDTH})) AS pos, ('0x' || unnest(regexp_extract_all(substr(h, 1, length(h) // {6 * WIDTH} * {6 * WIDTH}), '..')))::INT AS b FROM hb),
n AS (SELECT id, pos // {3 * WIDTH} AS y, b, CASE WHEN pos % {3 * WIDTH} >= 3 THEN lag(b, 3) OVER w ELSE 0 END AS l, coalesce(lag(b, {3 * WIDTH}) OVER w, 0) AS u, CASE WHEN pos % {3 * WIDTH} >= 3 THEN coalesce(lag(b, {3 * WIDTH + 3}) OVER w, 0) ELSE 0 END AS c FROM b WINDOW w AS (PARTITION BY id ORDER BY pos)),
p AS (SELECT *, abs(u - c) AS pa, abs(l - c) AS pb, abs(l + u - 2 * c) AS pc FROM n),
f AS (SELECT id, y, unnest([0, 1, 2, 3, 4]) AS filter, unnest([b, (b - l + 256) % 256, (b - u + 256) % 256, (b - (l + u) // 2 + 256) % 256,
  (b - CASE WHEN pa <= pb AND pa <= pc THEN l WHEN pb <= pc THEN u ELSE c END + 256) % 256]) AS v FROM p),
s AS (SELECT id, y, filter, sum(CASE WHEN v > 127 THEN 256 - v ELSE v END) AS cost FROM f GROUP BY id, y, filter)
SELECT id, y, arg_min(filter, (cost, filter))::INT AS filter, min(cost)::BIGINT AS cost FROM s GROUP BY id, y""")
def png_filter_choice(spark, sf_dir):
    """The cheapest filter of each whole row of a page's pixels."""

    def choice(b):
        rows = np.frombuffer(b, np.uint8, len(b) // (3 * WIDTH) * 3 * WIDTH).reshape(-1, 3 * WIDTH)
        cost = shrink.costs(shrink.filtered(rows, 3))
        return [(int(k), int(c)) for k, c in zip(cost.argmin(0), cost.min(0), strict=True)] if len(rows) else []

    x = _pages(spark, sf_dir).select("id", F.posexplode(fb.binary_function(choice, "array<struct<filter:int,cost:bigint>>")(F.col("content"))).alias("y", "r"))
    return x.select("id", F.col("y").cast("long").alias("y"), "r.filter", "r.cost")


# ---- blocks, bits, palettes

ROWS = 256  # of cells that are digits at one time

shared_sql("palette_256", "SELECT i, i * 127 & 255 AS g, 255 - i AS b FROM (SELECT doc_id AS i FROM {documents} WHERE doc_id < 256)")


@query(f"""WITH {BYTES}, s AS (SELECT id, ceil(sqrt(count(*)))::BIGINT AS side, count(*) AS n FROM b GROUP BY id),
y AS (SELECT id, side, n, unnest(range(0, 2 * ceil(n / side)::BIGINT)) AS y FROM s), g AS (SELECT *, unnest(range(0, 2 * side)) AS x FROM y),
c AS (SELECT g.id, g.y, g.x, g.side, coalesce(b.b, 0) AS v FROM g LEFT JOIN b ON b.id = g.id AND b.pos = g.y // 2 * g.side + g.x // 2)
SELECT id, (2 * any_value(side))::INT AS width, (max(y) + 1)::INT AS height, md5(string_agg(printf('%02X', v), '' ORDER BY y, x)) AS digest FROM c GROUP BY id""")
def replicate_2x2(spark, sf_dir):
    """Each byte as a block of two by two cells of a square; the blocks are read back on the way."""

    def cells(b):
        if not b:
            return None
        out, width, height = grid.replicate(b)
        if grid.unreplicate(out)[: len(b)] != b:
            raise ValueError("blocks don't come back")
        digest = hashlib.md5()
        for y in range(0, height, ROWS):
            digest.update(out[y : y + ROWS].tobytes().hex().upper().encode())
        return {"width": width, "height": height, "digest": digest.hexdigest()}

    x = files_from_documents(table(spark, sf_dir, "documents"))
    x = x.select("id", fb.binary_function(cells, "struct<width:int,height:int,digest:string>")(F.col("content")).alias("r")).filter("r is not null")
    return x.select("id", "r.width", "r.height", "r.digest")


@query(f"WITH {BYTES} SELECT id, k::INT AS bit, sum((b >> (7 - k)) & 1)::BIGINT AS ones FROM b, range(0, 8) AS r(k) GROUP BY id, k")
def bit_unpack(spark, sf_dir):
    """How often each bit of a document's bytes is set, the highest first; the bits are packed again on the way."""

    def ones(b):
        bits = grid.bits_of(b)
        if grid.bytes_of(bits) != b:
            raise ValueError("bits don't come back")
        return bits.reshape(-1, 8).sum(0, dtype=np.int64).tolist() if b else []

    x = files_from_documents(table(spark, sf_dir, "documents"))
    return x.select("id", F.posexplode(fb.binary_function(ones, "array<bigint>")(F.col("content"))).alias("bit", "ones"))


# ---- robust images and audio


@query("SELECT doc_id AS id, md5(text) AS digest, 0::BIGINT AS corrected FROM documents")
def robust_image_roundtrip(spark, sf_dir):
    """Every document as a picture of blocks and back."""

    def trip(values):
        return [{"digest": hashlib.md5(data).hexdigest(), "n": n} for data, n in robust.there_and_back(values)]

    x = files_from_documents(table(spark, sf_dir, "documents")).repartition(spark.sparkContext.defaultParallelism * 4)  # few bytes, much work
    x = x.select("id", fb.many_function(trip, "struct<digest:string,n:bigint>")(F.col("content")).alias("r"))
    return x.select("id", "r.digest", F.col("r.n").alias("corrected"))


@query("""WITH t AS (SELECT x, y, x IN (0, 6) OR y IN (0, 6) OR (x BETWEEN 2 AND 4 AND y BETWEEN 2 AND 4) AS black FROM range(0, 7) AS a(x), range(0, 7) AS b(y)),
s AS (SELECT real, guess FROM range(2, 9) AS r(real), range(2, 9) AS g(guess)),
m AS (SELECT s.real, s.guess, t.x, t.y, t.black, (t.x * s.guess + s.guess // 2) // s.real AS sx, (t.y * s.guess + s.guess // 2) // s.real AS sy FROM s, t),
h AS (SELECT m.real, m.guess, count(*) FILTER (m.black = u.black) / 49.0 AS ratio FROM m JOIN t u ON u.x = m.sx AND u.y = m.sy WHERE m.guess <= m.real GROUP BY m.real, m.guess)
SELECT item_id, 2 + item_id % 7 AS block, (SELECT min(guess) FROM h WHERE h.real = 2 + item_id % 7 AND ratio >= 0.8) AS found FROM benchmark""")
def finder_match(spark, sf_dir):
    """The block size that the finder pattern tells for a picture of each item, drawn with blocks of 2 to 8 pixels."""
    size = fb.binary_function(lambda item, text: robust.block_size(robust.draw(text.encode(), 2 + item % 7)), "bigint")
    return table(spark, sf_dir, "benchmark").select("item_id", (2 + F.col("item_id") % 7).alias("block"), size(F.col("item_id"), F.coalesce("text", F.lit(""))).alias("found"))


@query("SELECT n, round(0.5 * (1 - cos(2 * pi() * n / 2047)), 6) AS w FROM range(0, 2048) AS r(n)")
def hann_window(spark, sf_dir):
    return spark.range(signal.SYMBOL).select(F.col("id").alias("n"), F.round(0.5 * (1 - F.cos(2 * F.pi() * F.col("id") / (signal.SYMBOL - 1))), 6).alias("w"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, unnest(range(0, len(embedding))) AS i, len(embedding) AS n FROM embeddings)
SELECT vec_id, k::INT AS k, round((pow(sum(e * cos(2 * pi() * k * i / n)), 2) + pow(sum(e * sin(2 * pi() * k * i / n)), 2)) / (any_value(n) * any_value(n)), 6) AS power FROM e, range(0, 8) AS r(k) GROUP BY vec_id, k""")
def goertzel_power(spark, sf_dir):
    """Power of each embedding's first eight bins."""
    f = fb.binary_function(lambda v: signal.power(np.asarray(v, np.float64)[None], np.arange(8))[0].tolist(), "array<double>")
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(f(F.col("embedding"))).alias("k", "p"))
    return x.select("vec_id", "k", F.round("p", 6).alias("power"))


@query("SELECT item_id, md5(text) AS digest, 0::BIGINT AS corrected FROM benchmark")
def tone_demod_roundtrip(spark, sf_dir):
    """Every item as a WAV file of tones and back."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data, n = signal.decode_audio(signal.encode_audio((text or "").encode()))
                yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([data], pa.binary()), pa.array([n], pa.int64())], ["item_id", "data", "corrected"])

    x = table(spark, sf_dir, "benchmark").select("item_id", "text").repartition(spark.sparkContext.defaultParallelism)  # few bytes, much work
    return x.mapInArrow(run, "item_id long, data binary, corrected long").select("item_id", F.md5("data").alias("digest"), "corrected")


@query("""WITH f AS (SELECT unnest([3200, 2400, 1600, 800]) AS f, unnest([0, 1, 2, 3]) AS t), n AS (SELECT f, t, n, 0.3 * 0.5 * (1 - cos(2 * pi() * n / 1023)) * sin(2 * pi() * f / 44100 * n) AS v FROM f, range(0, 1024) AS r(n)),
p AS (SELECT t * 1024 + n AS at, v FROM n), s AS (SELECT unnest(range(0, 8)) AS shift), o AS (SELECT shift, unnest(range(0, shift + 1)) AS step FROM s),
w AS (SELECT o.shift, o.step, f.t, floor(f.f * 1024 / 44100.0 + 0.5) AS k, p.v, (p.at + 256 * (o.shift - o.step)) - 1024 * f.t AS n FROM o, f, p WHERE p.at + 256 * (o.shift - o.step) BETWEEN 1024 * f.t AND 1024 * f.t + 1023),
e AS (SELECT shift, step, t, (pow(sum(v * cos(2 * pi() * k * n / 1024)), 2) + pow(sum(v * sin(2 * pi() * k * n / 1024)), 2)) / (1024.0 * 1024) AS e FROM w GROUP BY shift, step, t),
h AS (SELECT shift, min(step) AS step FROM (SELECT shift, step FROM e WHERE e >= 0.00025 GROUP BY shift, step HAVING count(*) = 4) GROUP BY shift)
SELECT vec_id, 256 * h.step + 4096 AS found FROM embeddings JOIN h ON h.shift = vec_id % 8""")
def preamble_search(spark, sf_dir):
    """Where the data begins that follows a preamble after some silence."""

    def found(vec_id):
        return signal.find_preamble(np.concatenate([np.zeros(256 * (vec_id % 8)), signal.PREAMBLE, np.zeros(4096)]))

    return table(spark, sf_dir, "embeddings").select("vec_id", fb.binary_function(found, "bigint")(F.col("vec_id")).alias("found"))
