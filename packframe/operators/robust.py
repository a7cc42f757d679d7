"""Data as an image that bears lossy copies: black and white blocks, finder patterns in the corners, error correction."""

from __future__ import annotations

import math
import struct

import numpy as np

from packframe.operators import ecc, grid, png

# Fixed values of the format.
MAGIC = b"RBI1"
FINDER, QUIET = 7, 1
LEVEL_CODES = {"low": 0, "medium": 1, "quartile": 2, "high": 3}
MATCH = 0.8
SIZES = range(2, 9)
HEAD = 14
LEAST_SIDE = 20


def finder() -> np.ndarray:
    """True is black: a border and a centre of three by three."""
    out = np.zeros((FINDER, FINDER), bool)
    out[[0, -1]] = out[:, [0, -1]] = True
    out[2:5, 2:5] = True
    return out


def _free(width: int, height: int) -> np.ndarray:
    """Cells that hold data, in reading order."""
    out = np.ones((height, width), bool)
    k = FINDER + QUIET
    for ys in (slice(0, k), slice(height - k, height)):
        for xs in (slice(0, k), slice(width - k, width)):
            out[ys, xs] = False
    return np.flatnonzero(out)


def side_of(bits: int) -> int:
    return max(math.ceil(math.sqrt(bits + 4 * (FINDER + QUIET) ** 2)), LEAST_SIDE)


def draw(data: bytes, block: int = 4, level: str = "medium") -> np.ndarray:
    return _picture(ecc.encode(data, level), len(data), block, level)


def _picture(coded: bytes, n: int, block: int, level: str) -> np.ndarray:
    """The picture of n bytes, from their encoding."""
    if block not in SIZES:
        raise ValueError(f"blocks of {block} pixels; 2 to 8 are possible")
    side = side_of(8 * (HEAD + len(coded)))
    head = MAGIC + struct.pack(">BBIHH", block, LEVEL_CODES[level], n, side, side)
    bits = grid.bits_of(head + coded)
    cells = np.full(side * side, 255, np.uint8)
    cells[_free(side, side)[: len(bits)]] = (bits - 1).astype(np.uint8)  # 1 is black
    cells = cells.reshape(side, side)
    mark = np.where(finder(), 0, 255)
    for ys in (slice(0, FINDER), slice(side - FINDER, side)):
        for xs in (slice(0, FINDER), slice(side - FINDER, side)):
            cells[ys, xs] = mark
    out = np.empty((side, block, 3 * block * side), np.uint8)
    out[:] = np.repeat(cells, 3 * block, 1)[:, None]
    return out.reshape(side * block, side * block, 3)


def majority(pixels: np.ndarray, block: int, width: int, height: int) -> np.ndarray:
    """Whether each block is white: its pixels' mean is above 128."""
    down = pixels[: height * block, : width * block].reshape(height, block, -1)
    rows = down[:, 0].astype(np.uint16)
    for i in range(1, block):
        rows += down[:, i]
    channels = pixels.shape[2]
    cells = rows.reshape(height, width, block * channels)
    total = cells[..., 0].astype(np.uint32)
    for i in range(1, block * channels):
        total += cells[..., i]
    return total > 128 * block * block * channels


def match_ratio(pixels: np.ndarray, block: int) -> float:
    """Share of the finder's cells that the pixels at their centres agree with, were the blocks of this size."""
    at = np.arange(FINDER) * block + block // 2
    ys, xs = at[at < pixels.shape[0]], at[at < pixels.shape[1]]
    white = pixels[ys][:, xs].astype(np.float64).mean(2) > 128
    return float((white != finder()[: len(ys), : len(xs)]).mean()) if white.size else 0.0


def block_size(pixels: np.ndarray) -> int | None:
    """The smallest size at which the finder matches and the image could hold data."""
    for block in SIZES:
        if min(pixels.shape[:2]) // block >= FINDER * 2 + 4 and match_ratio(pixels, block) >= MATCH:
            return block
    return None


def _coded(pixels: np.ndarray) -> bytes:
    """The encoding that a picture holds. Sizes at which the finder matches are tried from the smallest; the header tells the right one."""
    for block in SIZES:
        height, width = pixels.shape[0] // block, pixels.shape[1] // block
        if min(height, width) < FINDER * 2 + 4 or match_ratio(pixels, block) < MATCH:
            continue
        bits = ~majority(pixels, block, width, height).ravel()[_free(width, height)]
        raw = grid.bytes_of(bits)
        if raw[:4] == MAGIC:
            _, code, n, _, _ = struct.unpack_from(">BBIHH", raw, 4)
            nsym = dict(zip(LEVEL_CODES.values(), map(ecc.LEVELS.get, LEVEL_CODES), strict=True)).get(code, 40)
            size = 12 + ecc.N * -(-n // (ecc.N - nsym))
            return raw[HEAD : HEAD + size]
    raise ValueError("no finder pattern with a header")


def read(pixels: np.ndarray) -> tuple[bytes, int]:
    """Data and the number of corrected bytes."""
    return ecc.decode(_coded(pixels))


def there_and_back(values: list[bytes], block: int = 4, level: str = "medium") -> list[tuple[bytes, int]]:
    """read() of draw() for many values: their blocks are encoded and checked together, pictures are drawn one at a time."""
    return ecc.decode_all([_coded(_picture(c, len(b), block, level)) for b, c in zip(values, ecc.encode_all(values, level), strict=True)])


def encode_image(data: bytes, block: int = 4, level: str = "medium") -> bytes:
    pixels = draw(data, block, level)
    return png.write_rgb(pixels.tobytes(), pixels.shape[1], pixels.shape[0])


def decode_image(b: bytes) -> tuple[bytes, int]:
    flat, width, height = png.read_rgb(b)
    return read(np.frombuffer(flat, np.uint8).reshape(height, width, 3))


def is_image(b: bytes) -> bool:
    try:
        flat, width, height = png.read_rgb(b)
        return block_size(np.frombuffer(flat, np.uint8).reshape(height, width, 3)) is not None
    except (ValueError, struct.error):
        return False
