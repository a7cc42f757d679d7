import random
import zlib

import numpy as np
import pytest

from packframe.operators import archive, codecs, ecc, envelope, png

rng = random.Random(7)
SAMPLES = [b"", b"a", b"banana", b"\0" * 300, bytes(range(256)), b"ab" * 500, bytes(rng.randrange(256) for _ in range(1000)), bytes(rng.randrange(3) for _ in range(1000))]


@pytest.mark.parametrize("b", SAMPLES, ids=range(len(SAMPLES)))
def test_round_trips(b):
    assert codecs.undelta(codecs.delta(b)) == b
    assert codecs.unbwt(*codecs.bwt(b)) == b
    assert codecs.unmtf(codecs.mtf(b)) == b
    assert codecs.unrle0(codecs.rle0(b), len(b)) == b
    assert codecs.rans_unpack(codecs.rans_pack(b)) == b
    assert codecs.unhybrid(codecs.hybrid(b, 256)) == b
    assert codecs.unzstd_chunked(codecs.zstd_chunked(b, 100)) == b
    for level in ecc.LEVELS:
        assert ecc.decode(ecc.encode(b, level)) == (b, 0)
    assert png.decode_payload(png.encode_payload(b, "n", "[]"))[1] == b


def test_bwt_is_the_sorted_suffixes_last_column():
    b = b"mississippi"
    rows = sorted(range(len(b) + 1), key=lambda i: b[i:])
    assert codecs.bwt(b) == (bytes(b[i - 1] for i in rows if i), rows.index(0))


def test_fixed_vectors():
    assert codecs.delta(bytes([10, 20, 30, 40, 250])) == bytes([10, 10, 10, 10, 210])
    assert zlib.crc32(b"123456789") == 0xCBF43926
    assert round(codecs.entropy_bits(b"aaaaabbbcc"), 4) == 1.4855
    assert [len(x) for x in png.split_idat(b"123456789", 4)] == [4, 4, 1]
    for n in (11, 100, 1000, 5000, 50000):
        flat, w, h = png.read_rgb(png.encode_payload(bytes(i % 256 for i in range(n))))
        assert w == h and flat[-9:] == png.FINISH


def test_normalized_frequencies_always_add_up():
    hard = np.array([1] * 200 + [300] * 56)
    for counts in (hard, np.zeros(256, int), np.bincount([3], minlength=256), np.arange(256)):
        f = codecs.normalize(counts)
        assert f.sum() == 4096 and ((f > 0) >= (counts > 0)).all()


def test_ecc_corrects_up_to_half_and_refuses_more():
    b = bytes(rng.randrange(256) for _ in range(500))
    coded = ecc.encode(b, "low")
    n = int.from_bytes(coded[10:12], "big")
    for errors, fine in ((0, True), (1, True), (10, True), (11, False)):
        x = bytearray(coded)
        for p in rng.sample(range(255), errors):
            x[12 + p * n] ^= rng.randrange(1, 256)
        if fine:
            assert ecc.decode(bytes(x)) == (b, errors)
        else:
            with pytest.raises(ValueError):
                ecc.decode(bytes(x))


def test_archives_select_and_refuse_truncation():
    entries = [("a.txt", b"hello"), ("sub/b.txt", b"world"), ("ü", b"")]
    for make in (archive.pack, archive.indexed, archive.offset_table):
        b = make(entries)
        assert archive.unpack(b) == entries and archive.count_entries(b"ROX1" + b) == 3
        assert archive.unpack(b, frozenset({"sub/b.txt"})) == [("sub/b.txt", b"world")]
    assert all(at % 4096 == archive.table_entries(archive.offset_table(entries))[0][1] % 4096 for _, at, _ in archive.table_entries(archive.offset_table(entries)))
    with pytest.raises(ValueError):
        archive.unpack(archive.pack(entries)[:-12])
    assert archive.untar(archive.tar(entries[:2])) == entries[:2]


def test_empty_passphrase_is_refused():
    with pytest.raises(ValueError):
        envelope.xor_bytes(b"x", b"")
