"""PNG containers: chunks, payload images, filters."""

from __future__ import annotations

import io
import json
import math
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import BinaryIO

import numpy as np

from packframe.operators import grid

# Fixed values of the formats.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
START = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255])
CODEC = bytes([0, 255, 0])
FINISH = bytes([0, 0, 255, 0, 255, 0, 255, 0, 0])
PAYLOAD_MAGIC, LIST_TAG, IDAT_LIMIT = b"PXL1", b"rXFL", 64 << 20


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def chunks(b: bytes) -> list[tuple[str, int, bytes, int]]:
    """(type, offset, data, crc); a truncated chunk ends the list."""
    out, at = [], 8 if b[:8] == SIGNATURE else len(b)
    while at + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, at)
        if at + 12 + n > len(b):
            break
        out.append((b[at + 4 : at + 8].decode("latin-1"), at, b[at + 8 : at + 8 + n], struct.unpack_from(">I", b, at + 8 + n)[0]))
        at += 12 + n
    return out


def split_idat(data: bytes, limit: int = IDAT_LIMIT) -> list[bytes]:
    return [data[i : i + limit] for i in range(0, len(data), limit)]


STORED = 65535  # fixed value of deflate: bytes of a stored block


def stored(raw: bytes) -> bytes:
    """A zlib stream of whole stored blocks. zlib's own at level 0 ends blocks where its buffers do, so its size would depend on them."""
    parts = [raw[i : i + STORED] for i in range(0, len(raw), STORED)] or [b""]
    out = [b"\x78\x01"]
    for k, part in enumerate(parts, 1):
        out += [struct.pack("<BHH", k == len(parts), len(part), len(part) ^ 0xFFFF), part]
    return b"".join([*out, struct.pack(">I", zlib.adler32(raw))])


def write_rgb(rgb: bytes, width: int, height: int, extra: list[tuple[bytes, bytes]] = ()) -> bytes:
    """Unfiltered rows in stored blocks."""
    rows = np.zeros((height, 1 + 3 * width), np.uint8)
    rows[:, 1:] = np.frombuffer(rgb, np.uint8).reshape(height, 3 * width)
    out = [SIGNATURE, chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))]
    out += [chunk(b"IDAT", part) for part in split_idat(stored(rows.tobytes()))]
    return b"".join([*out, *(chunk(k, d) for k, d in extra), chunk(b"IEND", b"")])


def metadata(b: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth, colour type."""
    return struct.unpack_from(">IIBB", b, 16)


def _paeth(a, b, c):
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def unfilter(raw: bytes, height: int, stride: int, step: int, above: np.ndarray | None = None) -> np.ndarray:
    """Rows of bytes; above: the row before the first one, if there is any."""
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    if not rows[:, 0].any():
        return rows[:, 1:].copy()
    out, above = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8) if above is None else above
    for y in range(height):
        kind, row = rows[y, 0], rows[y, 1:]
        if kind == 0:
            now = row.copy()
        elif kind == 1:
            now = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            now = row + above
        else:
            now = np.zeros(stride, np.uint8)
            for i in range(0, stride, step):
                left = now[i - step : i].astype(int) if i else np.zeros(step, int)
                corner = above[i - step : i].astype(int) if i else np.zeros(step, int)
                up = above[i : i + step].astype(int)
                now[i : i + step] = (row[i : i + step] + ((left + up) // 2 if kind == 3 else _paeth(left, up, corner))) & 255
        out[y], above = now, now
    return out


CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # fixed values: samples of a pixel by colour type


def read_pixels(b: bytes) -> np.ndarray:
    """(height, width, 3 or 4) samples of any PNG without interlacing: grey, RGB, palette, with or without alpha; deep samples keep their high byte."""
    width, height, depth, colour = metadata(b)
    if b[28]:
        raise ValueError("interlaced images aren't read")
    parts = chunks(b)
    channels = CHANNELS[colour]
    stride, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    rows = unfilter(zlib.decompress(b"".join(d for k, _, d, _ in parts if k == "IDAT")), height, stride, step)
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * channels * depth].reshape(height, width * channels, depth)
        rows = np.packbits(np.pad(bits, ((0, 0), (0, 0), (8 - depth, 0))), axis=2)[..., 0]
        rows = rows if colour == 3 else (rows.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    x = rows.reshape(height, width, channels)
    if colour == 3:
        table = np.frombuffer(next(d for k, _, d, _ in parts if k == "PLTE"), np.uint8).reshape(-1, 3)
        return table[np.minimum(x[..., 0], len(table) - 1)]
    if colour in (0, 4):
        return np.concatenate([np.repeat(x[..., :1], 3, 2), x[..., 1:]], 2)
    return x


def read_rgb(b: bytes) -> tuple[bytes, int, int]:
    x = read_pixels(b)
    return np.ascontiguousarray(x[:, :, :3]).tobytes(), x.shape[1], x.shape[0]


def payload_header(name: str, payload: bytes, file_list: str | None) -> bytes:
    raw = name.encode()[:255]
    out = PAYLOAD_MAGIC + bytes([2, len(raw)]) + raw + struct.pack(">Q", len(payload)) + payload
    return out + (LIST_TAG + struct.pack(">I", len(file_list.encode())) + file_list.encode() if file_list else b"")


def encode_payload(payload: bytes, name: str = "", file_list: str | None = None) -> bytes:
    """A square image: start marker and codec pixel, header and payload, zeros, end marker in the last three pixels."""
    body = payload_header(name, payload, file_list)
    body += b"\0" * (-len(body) % 3)
    pixels = math.ceil((len(START) + len(CODEC) + len(body)) / 3) + 3
    side = max(math.ceil(math.sqrt(pixels)), 3)
    flat = (START + CODEC + body).ljust(side * side * 3 - len(FINISH), b"\0") + FINISH
    return write_rgb(flat, side, side, [(LIST_TAG, file_list.encode())] if file_list else [])


def decode_payload(b: bytes) -> tuple[str, bytes, str | None]:
    return parse_header(read_rgb(b)[0])


def reassemble(parts: list[tuple[str, bytes]]) -> bytes:
    """A file of the chunks (type, data), with their checksums."""
    return SIGNATURE + b"".join(chunk(kind.encode("latin-1"), data) for kind, data in parts)


def scan_chunks(f: BinaryIO, skip: frozenset = frozenset({"IDAT"})) -> Iterator[tuple[str, int, int, bytes | None]]:
    """(type, offset of the data, length, data) of each chunk of a seekable file; the data of types in skip isn't read. Ends at a truncated chunk."""
    if f.read(8) != SIGNATURE:
        return
    end = f.seek(0, io.SEEK_END)
    at = 8
    while at + 12 <= end:
        f.seek(at)
        n, kind = struct.unpack(">I4s", f.read(8))
        if at + 12 + n > end:
            return
        name = kind.decode("latin-1")
        yield name, at + 8, n, None if name in skip else f.read(n)
        at += 12 + n


def ranges(f: BinaryIO) -> tuple[int, int, list[tuple[int, int]], int | None]:
    """Width, height, (first, past the last) byte of each IDAT's data, and the total size that the list chunk says (None without one)."""
    width = height = 0
    found, total = [], None
    for kind, at, n, data in scan_chunks(f):
        if kind == "IHDR":
            width, height = struct.unpack_from(">II", data)
        elif kind == "IDAT":
            found.append((at, at + n))
        elif kind == LIST_TAG.decode():
            total = listed_bytes(data.decode("utf-8", "replace"))
    return width, height, found, total


def listed_bytes(listed: str) -> int:
    """Sum of the sizes in a list of files; entries without a number count nothing."""
    entries = json.loads(listed)
    return sum(e["size"] for e in entries if isinstance(e, dict) and isinstance(e.get("size"), int))


def read_ranges(f: BinaryIO, found: list[tuple[int, int]], size: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of the ranges one after the other, in pieces."""
    for lo, hi in found:
        f.seek(lo)
        while lo < hi:
            piece = f.read(min(size, hi - lo))
            if not piece:
                raise ValueError(f"the file ends at {lo}; {hi} was said")
            yield piece
            lo += len(piece)


def inflate(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Inflated as the pieces come; a consumer that has enough stops asking."""
    z = zlib.decompressobj()
    for piece in pieces:
        if out := z.decompress(piece):
            yield out
        if z.eof:
            return
    if out := z.flush():
        yield out
    if not z.eof:
        raise ValueError("the image data ends early")


def strip_scanlines(pieces: Iterator[bytes], width: int, step: int = 3) -> Iterator[bytes]:
    """Rows of pixels from a stream of filtered rows; each row is undone by its own filter as soon as it is whole."""
    stride, held, above = width * step, b"", np.zeros(width * step, np.uint8)
    for piece in pieces:
        held += piece
        n = len(held) // (stride + 1)
        if n:
            rows = unfilter(held[: n * (stride + 1)], n, stride, step, above)
            above, held = rows[-1], held[n * (stride + 1) :]
            yield rows.tobytes()
    if held:
        raise ValueError("the last row isn't whole")


def payload_stream(f: BinaryIO) -> Iterator[bytes]:
    """The payload of an image file, read and inflated range by range; whoever has enough of it stops, and the rest of the file isn't read."""
    width, _, found, _ = ranges(f)
    held, left = b"", None
    for piece in strip_scanlines(inflate(read_ranges(f, found)), width):
        held += piece
        if left is None:
            at = held.find(PAYLOAD_MAGIC)
            if at < 0:
                held = held[-3:]
                continue
            held = held[at:]
            if len(held) < 6 or len(held) < 14 + held[5]:
                continue
            name = held[5]
            wide = 8 if held[4] >= 2 else 4
            left = int.from_bytes(held[6 + name : 6 + name + wide], "big")
            held = held[6 + name + wide :]
        if left is not None and held:
            out = held[:left]
            left, held = left - len(out), b""
            yield out
            if not left:
                return
    if left is None or left:
        raise ValueError("no whole payload in the image")


def write_image(f: BinaryIO, body: Iterable[bytes], size: int, name: str = "", listed: str | None = None, limit: int = IDAT_LIMIT) -> int:
    """An image file of a payload that comes in pieces, size bytes altogether; no more than a row and a block are held. Returns the side."""
    head = payload_header(name, b"", None)[:-8] + struct.pack(">Q", size)
    tail = LIST_TAG + struct.pack(">I", len(listed.encode())) + listed.encode() if listed else b""
    pixels = math.ceil((len(START) + len(CODEC) + -(-(len(head) + size + len(tail)) // 3) * 3) / 3) + 3
    side = max(math.ceil(math.sqrt(pixels)), 3)
    scan = side * (3 * side + 1)
    blocks = -(-scan // 65535)
    f.write(SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)))

    def flat() -> Iterator[bytes]:
        done = 0
        for piece in chain([START + CODEC + head], body, [tail]):
            done += len(piece)
            yield piece
        yield bytes(side * side * 3 - len(FINISH) - done) + FINISH

    def rows() -> Iterator[bytes]:
        held = b""
        for piece in flat():
            held += piece
            n = len(held) // (3 * side)
            if n:
                out = np.zeros((n, 1 + 3 * side), np.uint8)
                out[:, 1:] = np.frombuffer(held, np.uint8, n * 3 * side).reshape(n, -1)
                held = held[n * 3 * side :]
                yield out.tobytes()
        if held:
            raise ValueError("the payload isn't of the size that was said")

    def stored() -> Iterator[bytes]:
        """Deflate blocks without compression."""
        yield b"\x78\x01"
        held, check, left = b"", 1, scan
        for piece in rows():
            check = zlib.adler32(piece, check)
            held += piece
            while len(held) >= 65535 or (held and len(held) == left):
                part, held = held[:65535], held[65535:]
                left -= len(part)
                yield struct.pack("<BHH", not left, len(part), len(part) ^ 0xFFFF) + part
        yield struct.pack(">I", check)

    # a chunk's length and checksum enclose it: pieces are gathered up to the limit
    held = b""
    total = 2 + 5 * blocks + scan + 4
    for piece in stored():
        held += piece
        while len(held) >= min(limit, total):
            part, held, total = held[: min(limit, total)], held[min(limit, total) :], total - min(limit, total)
            f.write(chunk(b"IDAT", part))
            if not total:
                break
    if listed:
        f.write(chunk(LIST_TAG, listed.encode()))
    f.write(chunk(b"IEND", b""))
    return side


# ---- cascades: the ways to a payload, tried one after the other

FLAG_KINDS = {1, 2, 3}


def is_payload(p: bytes) -> bool:
    """Five bytes at least; an encrypted envelope, or a plain one around an archive or a zstd frame."""
    return len(p) > 4 and (p[0] in FLAG_KINDS or (p[0] == 0 and (p[1:5] == b"ROX1" or p[1:5] == b"\x28\xb5\x2f\xfd")))


def _pixels(b: bytes) -> np.ndarray:
    flat, width, height = read_rgb(b)
    return np.frombuffer(flat, np.uint8).reshape(height, width, 3)


def parse_header(flat: bytes) -> tuple[str, bytes, str | None]:
    """Name, payload and file list after the first payload magic of the pixels."""
    at = flat.find(PAYLOAD_MAGIC)
    if at < 0:
        raise ValueError("no payload in the image")
    version, n = flat[at + 4], flat[at + 5]
    name, at = flat[at + 6 : at + 6 + n].decode("utf-8", "replace"), at + 6 + n
    wide = 8 if version >= 2 else 4
    size = int.from_bytes(flat[at : at + wide], "big")
    payload, at = flat[at + wide : at + wide + size], at + wide + size
    if len(payload) < size:
        raise ValueError("the payload ends early")
    listed = None
    if flat[at : at + 4] == LIST_TAG:
        (m,) = struct.unpack_from(">I", flat, at + 4)
        listed = flat[at + 8 : at + 8 + m].decode()
    return name, payload, listed


def _ways(b: bytes):
    """(stage, flat pixels) of each way to read an image."""
    pixels = _pixels(b)
    yield "direct", pixels.tobytes()
    for stage, f in (("reconstituted", grid.reconstitute), ("unstretched", grid.unstretch), ("collapsed", grid.collapse)):
        try:
            small = f(pixels)
        except ValueError:
            continue
        if small is not None:
            yield stage, np.ascontiguousarray(small).tobytes()


def find_payload(b: bytes) -> tuple[str, str, bytes, str | None]:
    """(stage, name, payload, file list) by the first way that works: pixels as they are, the logical grid of a rescaled copy, without stretching and border."""
    failed = []
    for stage, flat in _ways(b):
        try:
            return (stage, *parse_header(flat))
        except (ValueError, IndexError, struct.error) as e:
            failed.append(f"{stage}: {e}")
    raise ValueError("no payload: " + "; ".join(failed))


def find_name(b: bytes) -> str | None:
    try:
        return find_payload(b)[1] or None
    except ValueError:
        return None


def file_list(b: bytes) -> str | None:
    """The list chunk, else the list in the pixels, read in whatever way works."""
    for kind, _, data, _ in chunks(b):
        if kind in ("rXFL", "rOXm", "rXDT"):
            return data.decode()
    try:
        return find_payload(b)[3]
    except ValueError:
        return None
