"""Operators of images, tones, sinks and streams, beyond what the queries compare with SQL."""

import io
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packframe import cli
from packframe.functions import register
from packframe.operators import archive, checksums, codecs, ecc, envelope, grid, png, robust, shrink, signal
from packframe.sources import sinks
from packframe.sources.files import directory_size, files_from_dir, files_from_paths
from packframe.streaming import archives as streams

rng = random.Random(5)
noise = np.random.default_rng(5)
TEXTS = [b"", b"x", b"hello world " * 40, bytes(rng.randrange(256) for _ in range(3000))]


# ---- codecs


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 63, 64, 65, 1000])
def test_rans_streams_by_length(n):
    b = bytes(rng.choice(b"aaaabbc\0") for _ in range(n))
    freq = codecs.normalize(np.bincount(np.frombuffer(b, np.uint8), minlength=256))
    coded = codecs.rans_encode(b, freq)
    assert codecs.rans_decode(coded, freq, n) == b
    assert not n or coded[0] == (0 if n < 16 else 1 if n < 64 else 2)
    one = codecs.order1(b)
    assert codecs.rans_decode_order1(codecs.rans_encode_order1(b, one), one, n) == b
    assert (codecs.stats1_from(codecs.stats1_bytes(one))[0] == one).all() and (one.sum(1) == 4096).all()


def test_old_hybrid_containers_are_read():
    b = b"banana bandana " * 30
    part = codecs.bwt_block(b)
    old = b"RBW1" + (1).to_bytes(4, "little") + len(b).to_bytes(8, "little") + len(part).to_bytes(4, "little") + part
    assert codecs.unhybrid(old) == b
    with pytest.raises(ValueError):
        codecs.unhybrid(old[:-3])


def test_whole_frame_replaces_blocks_that_pack_badly():
    b = bytes(rng.randrange(40) for _ in range(4000)) * 2
    packed = codecs.hybrid(b, 500)
    assert packed[4:8] == (1).to_bytes(4, "little") and packed[20] == codecs.ZSTD_WHOLE and codecs.unhybrid(packed) == b


def test_zstd_options():
    b = b"some text to pack " * 5000
    for packed in (codecs.zstd(b, 3, None, 20, True), codecs.zstd_by_policy(b, 19, b"")):
        assert codecs.unzstd(packed) == b
    assert codecs.unzstd(codecs.zstd_by_policy(b)) == b"ROX1" + b
    assert codecs.directory_level(b"", 5) == 3 and codecs.directory_level(noise.bytes(9999), 9999) == 1
    assert codecs.directory_level(b"a" * 9999, 9999) == 6 and codecs.directory_level(b"a" * 9999, 3 << 30) == 1
    assert b"".join(map(codecs.unzstd, codecs.zstd_frames([b"a", b"", b"bc" * 99]))) == b"a" + b"bc" * 99


def test_bwt_of_repetitions():
    for b in (b"ab" * 700, b"\0" * 999, bytes(range(256)) * 3):
        assert codecs.unbwt(*codecs.bwt(b)) == b


def test_mtf_ranks_are_counts_of_bytes_seen_since():
    b = bytes(rng.choice(b"abcdef\0\xff") for _ in range(400))
    for i, rank in enumerate(codecs.mtf(b)):
        last = b.rfind(b[i], 0, i)
        assert rank == (len(set(b[last + 1 : i])) if last >= 0 else b[i] + sum(x > b[i] for x in set(b[:i])))


def test_parity_is_the_remainder_of_the_shifted_polynomial():
    for nsym in (20, 64):
        data = noise.integers(0, 256, (3, 255 - nsym)).astype(np.uint8)
        for row, got in zip(data, ecc.parity(data, nsym), strict=True):
            rest = np.concatenate([row, np.zeros(nsym)]).astype(np.int64)
            g = ecc.generator(nsym)
            for i in range(len(row)):
                rest[i : i + nsym + 1] ^= ecc.mul(g, rest[i])
            assert rest[len(row) :].tolist() == got.tolist()


def test_ecc_in_batches_is_ecc_one_by_one():
    coded = ecc.encode_all(TEXTS, "quartile")
    assert coded == [ecc.encode(b, "quartile") for b in TEXTS]
    hurt = [bytearray(c) for c in coded]
    hurt[2][13] ^= 77
    assert ecc.decode_all([bytes(h) for h in hurt]) == [(b, int(i == 2)) for i, b in enumerate(TEXTS)]


def test_checksums_combine():
    whole = bytes(rng.randrange(256) for _ in range(5000))
    for cut in (0, 1, 700, 4999, 5000):
        a, b = whole[:cut], whole[cut:]
        assert checksums.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(whole)
        assert checksums.adler32_combine(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(whole)


# ---- images


def test_scan_vectors():
    assert grid.find_all(b"xxxxROX1yyyyROX1") == [4, 12]
    assert grid.marker_pixels(bytes([1, 2, 3, 4, 5, 6, 1, 2, 3]), 3, [(1, 2, 3)]).tolist() == [0, 2]
    assert grid.marker_pixels(b"abcd", 2, [(1, 2, 3)]).tolist() == [] and grid.parse_markers("1:2:3,4:5,256:0:0 9:9:9") == [(1, 2, 3), (9, 9, 9)]


@pytest.mark.parametrize("scale", [1.5, 2, 2.75, 4.2, 8])
def test_reconstitution_of_scaled_grids(scale):
    small = noise.integers(0, 256, (24, 30, 3)).astype(np.uint8)
    small[0, :3], small[-1, -3:] = [grid.RED, grid.GREEN, grid.BLUE], [grid.BLUE, grid.GREEN, grid.RED]
    w, h = int(30 * scale), int(24 * scale)
    picture = noise.integers(0, 256, (300, 400, 3)).astype(np.uint8)
    picture[20 : 20 + h, 30 : 30 + w] = small[np.arange(h) * 24 // h][:, np.arange(w) * 30 // w]
    assert (grid.reconstitute(picture) == small).all()


def test_payload_is_found_in_copies_of_an_image():
    image = png.encode_payload(b"\0ROX1" + archive.pack([("a.txt", b"text")]), "a.pack", '[{"name":"a.txt","size":4}]')
    pixels = png._pixels(image)
    big = grid.stretch(pixels, 3, 3)
    framed = np.pad(big, ((9, 4), (5, 7), (0, 0)), constant_values=255)
    for x, stage in ((pixels, "direct"), (big, None), (framed, None)):
        b = png.write_rgb(np.ascontiguousarray(x).tobytes(), x.shape[1], x.shape[0])
        found = png.find_payload(b)
        assert found[1:] == ("a.pack", b"\0ROX1" + archive.pack([("a.txt", b"text")]), '[{"name":"a.txt","size":4}]') and (stage is None or found[0] == stage)
        assert png.file_list(b) == '[{"name":"a.txt","size":4}]' and png.find_name(b) == "a.pack"
        assert dict(sinks.entries_of("x", b)) == {"a.txt": b"text"}
    plain = png.write_rgb(bytes(300), 10, 10)
    assert png.find_name(plain) is None
    with pytest.raises(ValueError):
        png.find_payload(plain)
    assert png.is_payload(b"\0ROX1") and png.is_payload(b"\3abcd") and not png.is_payload(b"\0abcd") and not png.is_payload(b"\1")


@pytest.mark.parametrize("b", TEXTS, ids=range(len(TEXTS)))
def test_images_in_pieces(b):
    f = io.BytesIO()
    side = png.write_image(f, (b[i : i + 77] for i in range(0, len(b), 77)), len(b), "n", "[]", 1000)
    assert png.decode_payload(f.getvalue()) == ("n", b, "[]") and png.metadata(f.getvalue())[:2] == (side, side)
    assert f.getvalue() == png.reassemble([(k, d) for k, _, d, _ in png.chunks(f.getvalue())])
    f.seek(0)
    assert b"".join(png.payload_stream(f)) == b
    f.seek(0)
    kinds = [(k, d is None) for k, _, _, d in png.scan_chunks(f)]
    assert kinds[0] == ("IHDR", False) and kinds[1] == ("IDAT", True) and kinds[-1] == ("IEND", False)
    f.seek(0)
    assert sum(hi - lo for lo, hi in png.ranges(f)[2]) == len(zlib.compress(bytes(side * (3 * side + 1)), 0))
    with pytest.raises(ValueError):
        png.write_image(io.BytesIO(), [b + b"more than was said" * 400], len(b))


def test_readers_stop_early():
    asked = []

    def pieces(b):
        for i in range(0, len(b), 16):
            asked.append(i)
            yield b[i : i + 16]

    entries = [(f"f{i}", bytes([i]) * 100) for i in range(50)]
    for make in (archive.pack, archive.indexed, archive.offset_table):
        b = make(entries)
        asked.clear()
        assert list(archive.unpack_stream(pieces(b), ["f3", "f1"])) == [entries[1], entries[3]]
        assert asked[-1] < len(b) // 2 or make is archive.indexed
        assert list(archive.unpack_stream(pieces(b))) == entries
        with pytest.raises(ValueError):
            list(archive.unpack_stream(pieces(b[:-1] if make is not archive.offset_table else b[:-4096])))
    assert b"".join(archive.pack_stream(entries, 50)) == archive.pack(entries)
    assert b"".join(archive.indexed_stream([(n, len(c)) for n, c in entries], [c for _, c in entries], 300)) == archive.indexed(entries, 300)
    long = [("d/" + "x" * 150 + ".txt", b"1"), ("./a/../b.txt", b"22")]
    assert archive.tar_list(io.BytesIO(archive.tar(long))) == [("d/" + "x" * 150 + ".txt", 1), ("a/b.txt", 2)]


def test_optimised_images_hold_the_same_pixels():
    for pixels in (noise.integers(0, 256, (20, 30, 3)), noise.integers(0, 2, (20, 30, 1)) * np.array([10, 20, 30]), np.cumsum(np.ones((40, 40, 3)), 1), noise.integers(0, 3, (9, 7, 1)).repeat(3, 2)):
        x = pixels.astype(np.uint8)
        b = png.write_rgb(x.tobytes(), x.shape[1], x.shape[0], [(b"tEXt", b"note")])
        small = shrink.optimise(b)
        assert len(small) <= len(b) and png.read_rgb(small) == png.read_rgb(b) and "tEXt" in [k for k, *_ in png.chunks(small)]
    assert shrink.optimise(b, fast=True) == b


def test_filters_are_undone():
    rows = noise.integers(0, 256, (12, 30)).astype(np.uint8)
    for kind in range(5):
        raw = np.full((12, 31), kind, np.uint8)
        raw[:, 1:] = shrink.filtered(rows, 3)[kind]
        assert (png.unfilter(raw.tobytes(), 12, 30, 3) == rows).all()
    best, raw = shrink.choose(rows, 3)
    assert (png.unfilter(raw, 12, 30, 3) == rows).all() and len(best) == 12


def test_resize_kernels():
    x = noise.integers(0, 256, (8, 6, 3)).astype(np.uint8)
    for kernel in ("nearest", "bilinear", "cubic", "lanczos3", "unknown"):
        assert (grid.resize(x, 6, 8, kernel) == x).all()
        assert grid.resize(x, 13, 5, kernel).shape == (5, 13, 3)
        assert (grid.resize(np.full((5, 5, 3), 77, np.uint8), 11, 3, kernel) == 77).all()
    assert grid.resize(x, 3, 4)[0, 0].tolist() == x[1, 1].tolist()


def test_blocks_medians_and_bits():
    assert [grid.upper_median(np.array(v)) for v in ([], [3], [4, 1], [5, 1, 9, 7])] == [0, 3, 4, 7]
    x = noise.integers(0, 256, (10, 12, 3)).astype(np.uint8)
    assert (grid.block_median(grid.stretch(x, 3, 2), 12, 10) == x).all() and (grid.collapse(grid.stretch(x, 2, 5)) == x).all()
    assert grid.unstretch(np.full((4, 4, 3), 255, np.uint8)) is None and grid.unstretch(x) is None
    assert grid.pack_indices(np.array([1, 0, 1, 1, 0, 0, 0, 1, 1]), 1) == b"\xb1\x80" and grid.pack_indices(np.array([3, 1, 2]), 4) == b"\x31\x20"
    assert grid.palette()[3].tolist() == [3, 3 * 127 & 255, 252]


# ---- robust coding


@pytest.mark.parametrize("b", TEXTS[:3], ids=range(3))
@pytest.mark.parametrize("level", ["low", "high"])
def test_robust_images_and_audio(b, level):
    for block in (2, 5):
        assert robust.decode_image(robust.encode_image(b, block, level)) == (b, 0)
    assert signal.decode_audio(signal.encode_audio(b, level)) == (b, 0)


def test_robust_images_bear_noise_and_audio_a_gap():
    b = TEXTS[2]
    x = robust.draw(b).astype(np.int64)
    assert robust.read(np.clip(x + noise.integers(-90, 91, x.shape), 0, 255).astype(np.uint8))[0] == b
    wav = bytearray(signal.encode_audio(b))
    at = signal.HEADER + 2 * (len(signal.PREAMBLE) + 40 * (signal.SYMBOL + signal.GUARD))
    wav[at : at + 10_000] = bytes(10_000)
    data, fixed = signal.decode_audio(bytes(wav))
    assert data == b and fixed > 0
    eight = signal.read_wav(signal.wav(np.array([0.5, -0.5])))
    assert np.allclose(eight, [0.5, -0.5], atol=1e-4)
    odd = signal.wav(np.zeros(5000))
    assert not signal.is_audio(odd) and signal.is_audio(signal.encode_audio(b"")) and not signal.is_audio(b"RIFF")
    assert robust.is_image(robust.encode_image(b"q")) and not robust.is_image(png.write_rgb(bytes(60 * 60 * 3), 60, 60))


def test_power_is_goertzels():
    x, k = noise.normal(size=256), 9
    w = 2 * np.cos(2 * np.pi * k / 256)
    a = b = 0.0
    for v in x:
        a, b = v + w * a - b, a
    assert abs(signal.power(x[None], [k])[0, 0] - (a * a + b * b - w * a * b) / 256**2) < 1e-9


# ---- Spark


def test_directories_and_paths(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, text in (("a.txt", b"hello"), ("sub/b.txt", b"world"), ("sub/c", b"")):
        (tmp_path / "in" / name).write_bytes(text)
    (tmp_path / "one.bin").write_bytes(b"123")
    want = {"a.txt": b"hello", "sub/b.txt": b"world", "sub/c": b""}
    got = {r.path: bytes(r.content) for r in files_from_dir(spark, str(tmp_path / "in")).collect()}
    assert got == want and directory_size(spark, str(tmp_path / "in")) == 10
    both = files_from_paths(spark, [str(tmp_path / "in"), str(tmp_path / "one.bin")])
    assert {r.path for r in both.collect()} == {*want, "one.bin"} and files_from_paths(spark, []).count() == 0
    assert [r.path for r in files_from_dir(spark, str(tmp_path / "in"), "b*").collect()] == ["sub/b.txt"]
    for kind in sinks.FORMATS:
        root = str(tmp_path / f"out-{kind}")
        assert sum(r.size for r in sinks.write_archives(files_from_dir(spark, str(tmp_path / "in")), root, 2, kind).collect()) > 0
        assert {r.path: bytes(r.content) for r in sinks.read_archives(spark, root).collect()} == want
        assert [r.path for r in sinks.read_archives(spark, root, ["sub/b.txt"]).collect()] == ["sub/b.txt"]
    bad = spark.createDataFrame([("../x/./a?.txt", bytearray(b"1")), ("C:\\y", bytearray(b"2")), (None, None)], "path string, content binary")
    assert {r.path for r in sinks.write_files(bad, str(tmp_path / "safe")).collect()} == {"x/a_.txt", "C_/y", "file"}
    assert list(sinks.entries_of("../raw.bin", b"no archive")) == [("raw.bin", b"no archive")]
    with pytest.raises(ValueError):
        sinks.archives_of(bad, 2, "rar")


def test_envelopes_say_what_is_wrong(spark):
    base = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(TEXTS)], "id int, content binary")
    x = envelope.gcm_encrypt(base, "content", "g", "secret", iterations=10)
    x = envelope.ctr_encrypt(x, "content", "c", "secret", iterations=10).withColumn("x", envelope.xor_encrypt(F.col("content"), "secret")).withColumn("p", envelope.plain("content"))
    for name in ("g", "c", "x", "p"):
        for passphrase, good in (("secret", True), ("wrong", name in "xp"), (None, name == "p")):
            rows = envelope.decrypt(x, name, "d", "why", passphrase, iterations=10).select("content", "d", "why").collect()
            for r in rows:
                assert (r.why is None) == good
                if good and (passphrase == "secret" or name == "p"):
                    assert bytes(r.d) == bytes(r.content)
                if not good:
                    assert r.d is None and r.why == ("passphrase required" if passphrase is None else "wrong passphrase or changed")
    odd = spark.createDataFrame([(bytearray(b"\x09abc"),), (bytearray(b""),), (None,), (bytearray(b"\x01short"),)], "e binary")
    assert {r.why for r in envelope.decrypt(odd, "e", "d", "why", "secret", 10).collect()} == {"malformed"}


def test_sql_functions(spark, tmp_path):
    register.register(spark)
    df = spark.createDataFrame([(1, bytearray(b"banana")), (2, None)], "id int, content binary")
    df.createOrReplaceTempView("values_")
    row = spark.sql("SELECT pf_undelta(pf_delta(content)) AS a, pf_unecc(pf_ecc(content)) AS b, pf_png_payload(pf_png(content)) AS c, pf_unhybrid(pf_hybrid(content)) AS d, pf_bwt(content).row AS e, pf_find(content) AS f FROM values_ ORDER BY id").collect()
    assert [bytes(row[0][k]) for k in "abcd"] == [b"banana"] * 4 and row[0].f == [] and all(row[1][k] is None for k in "abcd")
    packed = archive.pack([("a", b"1"), ("b", b"22")])
    spark.createDataFrame([(bytearray(packed),)], "content binary").createOrReplaceTempView("packs_")
    assert [(r.path, r.size) for r in spark.sql("SELECT e.path, e.size FROM packs_, LATERAL pf_entries(content) e").collect()] == [("a", 1), ("b", 2)]
    spark.createDataFrame([(bytearray(png.encode_payload(b"x")),)], "content binary").createOrReplaceTempView("images_")
    assert [r.type for r in spark.sql("SELECT c.type FROM images_, LATERAL pf_chunks(content) c ORDER BY c.seq").collect()] == ["IHDR", "IDAT", "IEND"]
    chunks = spark.createDataFrame([(0, bytearray(b"ban")), (1, bytearray(b"ana"))], "chunk int, content binary")
    assert chunks.agg(register.crc32_of_chunks(F.col("chunk"), F.col("content")).alias("crc")).first().crc == zlib.crc32(b"banana")


def test_running_sums_over_micro_batches(spark, tmp_path):
    told = []
    listener = streams.Progress(lambda *x: told.append(x))
    spark.streams.addListener(listener)
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.bin").write_bytes(bytes([i]) * 10)
    query = streams.archive_stream(streams.arriving_files(spark, str(tmp_path / "in"), 2).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    spark.streams.removeListener(listener)
    assert {r.path: bytes(r.content) for r in sinks.read_archives(spark, str(tmp_path / "out")).collect()} == {f"{i}.bin": bytes([i]) * 10 for i in range(3)}


def test_command_line(tmp_path, capsys):
    src, image, out = tmp_path / "a.txt", tmp_path / "a.png", tmp_path / "out"
    src.write_bytes(b"some text " * 50)
    assert cli.main(["encode", str(src), str(image)]) == 0 and cli.main(["decode", str(image), str(out)]) == 0
    assert (out / "a.txt").read_bytes() == src.read_bytes()
    capsys.readouterr()
    cli.main(["list", str(image)])
    assert json.loads(capsys.readouterr().out) == [{"name": "a.txt", "size": 500}]
    cli.main(["havepassphrase", str(image)])
    assert capsys.readouterr().out == "false\n"
    for there, back in (("delta-encode", "delta-decode"), ("compress", "decompress")):
        assert cli.main([there, str(src), str(tmp_path / "x")]) == 0 and cli.main([back, str(tmp_path / "x"), str(tmp_path / "y")]) == 0
        assert (tmp_path / "y").read_bytes() == src.read_bytes()
    cli.main(["compress", str(src), str(tmp_path / "x"), "--bwt"])
    cli.main(["decompress", str(tmp_path / "x"), str(tmp_path / "y")])
    assert (tmp_path / "y").read_bytes() == src.read_bytes()
    cli.main(["crc32", str(src)])
    assert int(capsys.readouterr().out) == zlib.crc32(src.read_bytes())
    cli.main(["scan", str(src), "--markers", "115:111:109", "--channels", "3"])
    assert json.loads(capsys.readouterr().out)["markers"][0] == 0
    assert cli.main(["decode", str(src) + "x", str(out)]) == 1 and cli.requested('["a", " b "]') == cli.requested("a, b,") == ["a", "b"]
