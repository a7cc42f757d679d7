"""Smaller PNG files: filters by row, palettes, deflate settings; the smallest candidate wins and is never larger than the input."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from packframe.operators import grid, png

STRATEGIES = (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FILTERED, zlib.Z_HUFFMAN_ONLY, zlib.Z_RLE, zlib.Z_FIXED)
WINDOWS, MEMORY = (15, 12, 9), (9, 8)
LIMIT = 50 << 20  # larger files are returned as they are
KINDS = 5


def filtered(rows: np.ndarray, step: int) -> np.ndarray:
    """(filter, row, byte): each row under none, sub, up, average and Paeth, whose neighbours are the rows as they are."""
    x = rows.astype(np.int16)
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, step:], up[1:], corner[1:, step:] = x[:, :-step], x[:-1], x[:-1, :-step]
    guess = np.stack([np.zeros_like(x), left, up, (left + up) // 2, png._paeth(left, up, corner)])
    return ((x - guess) & 255).astype(np.uint8)


def costs(every: np.ndarray) -> np.ndarray:
    """(filter, row): sums of the filtered bytes' distances from zero, as signed bytes."""
    return np.abs(every.view(np.int8).astype(np.int64)).sum(2)


def choose(rows: np.ndarray, step: int) -> tuple[np.ndarray, bytes]:
    """Each row's filter (the cheapest; of equals the first), and the filtered rows."""
    every = filtered(rows, step)
    best = costs(every).argmin(0)
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0], out[:, 1:] = best, every[best, np.arange(len(rows))]
    return best, out.tobytes()


def _deflate(raw: bytes, level: int = 9, window: int = 15, memory: int = 9, strategy: int = zlib.Z_DEFAULT_STRATEGY) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, window, memory, strategy)
    return c.compress(raw) + c.flush()


# Fixed values of zlib: how much of a window a match can't reach, symbols of a block at MEMORY's least, entries of a hash chain that level 9 always follows.
UNREACHED, SYMBOLS, CHAIN = 262, (1 << 14) - 1, 1024


def settings(raw: bytes) -> list[tuple[int, int, int]]:
    """(strategy, window, memory) to try, without those that can't give less than one before them. A window that holds everything finds what the largest finds;
    without matches, or with those at distance 1, no window finds more; and memory decides where blocks end and how many different strings share a
    chain, which makes no difference in a single block whose chains are all followed to their ends. The fixed code is tried for each block of the default
    strategy, which has the same matches and takes it where it is shorter."""
    n = len(raw)
    windows = [w for w in WINDOWS if w == WINDOWS[0] or n > (1 << w) - UNREACHED]
    single = n < SYMBOLS
    x = np.frombuffer(raw, np.uint8).astype(np.int64)
    short = single and np.bincount((x[:-2] << 10 ^ x[1:-1] << 5 ^ x[2:]) & 0x7FFF, minlength=1).max() <= CHAIN
    out = []
    for s in STRATEGIES[:-1]:
        near = s in (zlib.Z_HUFFMAN_ONLY, zlib.Z_RLE)
        out += [(s, w, m) for w in (WINDOWS[:1] if near else windows) for m in (MEMORY[:1] if (single if near else short) else MEMORY)]
    return out


def _smallest(raw: bytes) -> bytes:
    return min((_deflate(raw, 9, w, m, s) for s, w, m in settings(raw)), key=len)


def _file(width: int, height: int, depth: int, colour: int, data: bytes, table: bytes, rest: list[tuple[str, bytes]]) -> bytes:
    parts = [("IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0))] + ([("PLTE", table)] if table else [])
    return png.reassemble([*parts, *(("IDAT", p) for p in png.split_idat(data)), *rest, ("IEND", b"")])


def optimise(b: bytes, fast: bool = False) -> bytes:
    """The smallest of: rows as they are and each row's cheapest filter, one filter for all rows, and a palette where there are at most 256
    colours. Other chunks are kept. Files over LIMIT, interlaced ones and those with alpha or few bits a sample come back as they are."""
    width, height, depth, colour = png.metadata(b)
    if fast or len(b) > LIMIT or (depth, colour, b[28]) != (8, 2, 0):
        return b
    rest = [(k, d) for k, _, d, _ in png.chunks(b) if k not in ("IHDR", "IDAT", "IEND", "PLTE", "tRNS")]
    flat, _, _ = png.read_rgb(b)
    rows = np.frombuffer(flat, np.uint8).reshape(height, 3 * width)
    every = filtered(rows, 3)
    raws = [choose(rows, 3)[1]]
    for kind in range(KINDS):
        raw = np.full((height, 3 * width + 1), kind, np.uint8)
        raw[:, 1:] = every[kind]
        raws.append(raw.tobytes())
    ranked = sorted(raws, key=lambda r: len(_deflate(r, 6)))
    out = [b, _file(width, height, 8, 2, _smallest(ranked[0]), b"", rest)]
    x = rows.reshape(-1, 3).astype(np.int64)
    codes = x[:, 0] << 16 | x[:, 1] << 8 | x[:, 2]
    names, _ = grid.colours(codes)
    if len(names) <= 256:
        bits = grid.bit_depth(len(names))
        order = np.argsort(names)
        index = order[np.searchsorted(names[order], codes)].astype(np.uint8).reshape(height, width)
        packed = b"".join(b"\0" + grid.pack_indices(r, bits) for r in index)
        table = np.stack([names >> 16, names >> 8 & 255, names & 255], 1).astype(np.uint8).tobytes()
        out.append(_file(width, height, bits, 3, _smallest(packed), table, rest))
    return min(out, key=len)
