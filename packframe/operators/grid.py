"""Pixel grids: scans, runs, block statistics, nearest-neighbour collapse, reconstitution, resize, palettes. Arrays are (height, width, 3) uint8."""

from __future__ import annotations

import numpy as np

MAGIC = b"ROX1"  # fixed value of the format
RED, GREEN, BLUE = (255, 0, 0), (0, 255, 0), (0, 0, 255)  # fixed values: the colours of the markers
NEAR = 50  # fixed value: colours closer than this (sum of channel differences) count as equal
RUN_RATIO = (0.3, 3.0)  # fixed values: how a marker's green and blue runs may relate to its red one
TOP_MARKERS = 8
MAX_SIDE = 1800


def parse_markers(text: str) -> list[tuple[int, int, int]]:
    """Markers r:g:b, separated by commas or spaces; what is no triple of bytes is dropped."""
    out = []
    for part in text.replace(",", " ").split():
        values = part.split(":")
        if len(values) == 3 and all(v.isdigit() and int(v) < 256 for v in values):
            out.append(tuple(map(int, values)))
    return out


def find_all(data: bytes, needle: bytes = MAGIC) -> list[int]:
    """Offsets of needle, none overlapping the one before."""
    out, at = [], data.find(needle)
    while at >= 0:
        out.append(at)
        at = data.find(needle, at + len(needle))
    return out


def marker_pixels(data: bytes, channels: int, markers: list[tuple[int, int, int]]) -> np.ndarray:
    """Indices of the pixels that have a marker's colour; none with fewer than three channels."""
    if channels < 3 or not markers:
        return np.zeros(0, np.int64)
    n = len(data) // channels
    raw = np.frombuffer(data, np.uint8, n * channels).reshape(n, channels).astype(np.int64)
    code = raw[:, 0] << 16 | raw[:, 1] << 8 | raw[:, 2]
    return np.flatnonzero(np.isin(code, [r << 16 | g << 8 | b for r, g, b in markers]))


def like(grid: np.ndarray, colour: tuple[int, int, int]) -> np.ndarray:
    return np.abs(grid[..., :3].astype(np.int64) - colour).sum(-1) < NEAR


def runs(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values (rows of an array)."""
    if not len(line):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = line.reshape(len(line), -1)
    start = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]).any(1)]))
    return start, np.diff(np.append(start, len(line)))


def transitions(line: np.ndarray) -> int:
    return max(0, len(runs(line)[0]) - 1)


def inner_transitions(line: np.ndarray, size: int) -> int:
    """Changes between neighbours that a logical grid of size cells over the line has in one cell."""
    n = len(line)
    i = np.arange(1, n)
    together = np.floor((i - 0.5) * size / n) == np.floor((i + 0.5) * size / n)
    return int((together & (line.reshape(n, -1)[1:] != line.reshape(n, -1)[:-1]).any(1)).sum())


def upper_median(values: np.ndarray) -> int:
    """The middle value; of two middle ones the greater. 0 for none."""
    return int(np.sort(values)[len(values) // 2]) if len(values) else 0


def block_median(grid: np.ndarray, width: int, height: int) -> np.ndarray:
    """The grid scaled down to width x height cells, each the upper median of its pixels, channel by channel."""
    h, w = grid.shape[:2]
    rows, cols = np.arange(h) * height // h, np.arange(w) * width // w
    cell = (rows[:, None] * width + cols).ravel()
    out = np.zeros((height * width, grid.shape[2]), np.uint8)
    for c in range(grid.shape[2]):
        v = grid[..., c].ravel()
        order = np.lexsort((v, cell))
        names, first, n = np.unique(cell[order], return_index=True, return_counts=True)
        out[names, c] = v[order][first + n // 2]
    return out.reshape(height, width, grid.shape[2])


def stretch(grid: np.ndarray, across: int, down: int) -> np.ndarray:
    return grid.repeat(down, 0).repeat(across, 1)


def collapse(grid: np.ndarray) -> np.ndarray:
    """Equal neighbouring rows become one, then columns that are equal in the first row that is left."""
    rows, _ = runs(grid)
    kept = grid[rows]
    cols, _ = runs(kept[0]) if len(kept) else (np.zeros(0, np.int64), None)
    return kept[:, cols]


def unstretch(grid: np.ndarray) -> np.ndarray | None:
    """Without its white border, each run of equal columns and rows as one; None if all is white, or nothing was stretched."""
    dark = (grid[..., :3] != 255).any(-1)
    if not dark.any():
        return None
    ys, xs = np.flatnonzero(dark.any(1)), np.flatnonzero(dark.any(0))
    inner = grid[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
    rows, tall = runs(inner)
    cols, wide = runs(inner.swapaxes(0, 1))
    if max(tall.max(), wide.max()) < 2:
        return None
    return inner[rows][:, cols]


def _marker_places(grid: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height of the red part) of each red, green and blue run side by side, read left to right."""
    kind = np.select([like(grid, c) for c in (RED, GREEN, BLUE)], [1, 2, 3], 0)
    out = []
    for y in np.flatnonzero((kind == 1).any(1)).tolist():
        start, size = runs(kind[y])
        what = kind[y][start]
        for k in np.flatnonzero((what[:-2] == 1) & (what[1:-1] == 2) & (what[2:] == 3)).tolist():
            r, g, b = size[k : k + 3].tolist()
            if all(RUN_RATIO[0] < v / r < RUN_RATIO[1] for v in (g, b)):
                below = kind[y:, start[k]] != 1
                out.append((int(start[k]), y, r + g + b, int(below.argmax()) if below.any() else len(below)))
    return out


def _largest(places: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The TOP_MARKERS of largest area; of places that overlap, the first in that order."""
    kept: list[tuple[int, int, int, int]] = []
    for x, y, w, h in sorted(places, key=lambda p: (-p[2] * p[3], p[1], p[0])):
        if all(abs(x - a) >= max(w, c) // 2 or abs(y - b) >= max(h, d) for a, b, c, d in kept):
            kept.append((x, y, w, h))
    return kept[:TOP_MARKERS]


def _marked(grid: np.ndarray) -> bool:
    return all(like(grid[0, i], c) and like(grid[-1, -1 - i], c) for i, c in enumerate((RED, GREEN, BLUE)))


def reconstitute(grid: np.ndarray) -> np.ndarray:
    """The logical grid of a screenshot or rescaled copy: from the start marker (red, green, blue pixels) at its first row to the same marker, read backwards, at
    the end of its last row. Each pair of a start and an end beyond it is a candidate; the logical width is a third of the markers' share of the width, the height
    the same scale; candidates are scored by how far their sizes are from whole numbers, by changes inside cells, and by area. A copy that was only
    stretched has as many different columns and rows as cells, which is tried first."""
    starts = _largest(_marker_places(grid))
    ends = _largest(_marker_places(grid[::-1, ::-1]))
    best = None
    for sx, sy, sw, sh in starts:
        for rx, ry, ew, eh in ends:
            ex, ey = grid.shape[1] - rx, grid.shape[0] - ry
            w, h = ex - sx, ey - sy
            if w < sw or h < max(sh, eh) or not 3 <= max(w, h) <= MAX_SIDE:
                continue
            cell = (sw + ew) / 6
            part = grid[sy:ey, sx:ex]
            (rows, _), (cols, _) = runs(part), runs(part.swapaxes(0, 1))
            exact = part[rows][:, cols]
            if abs(len(cols) - w / cell) <= 0.2 * w / cell and len(cols) >= 3 and _marked(exact) and (best is None or (-1.0, -w * h) < best[0]):
                best = ((-1.0, -w * h), exact)
                continue
            for lw in range(max(3, int(w / cell) - 2), int(w / cell) + 4):
                lh = max(1, round(h * lw / w))
                small = block_median(part, lw, lh)
                if not _marked(small):
                    continue
                inside = inner_transitions(part[h // 2], lw) + inner_transitions(part[:, w // 2], lh) + inner_transitions(part[0], lw)
                score = (inside + 2 * abs(lw - w / cell) + abs(w / lw - h / lh), -w * h)
                if best is None or score < best[0]:
                    best = (score, small)
    if best is None:
        raise ValueError("no start and end markers")
    return best[1]


# ---- resize

_KERNELS = {
    "triangle": (1.0, lambda x: np.maximum(0, 1 - np.abs(x))),
    "cubic": (2.0, lambda x: np.where(np.abs(x) < 1, 1.5 * np.abs(x) ** 3 - 2.5 * x**2 + 1, np.where(np.abs(x) < 2, -0.5 * np.abs(x) ** 3 + 2.5 * x**2 - 4 * np.abs(x) + 2, 0))),
    "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)),
}
_NAMES = {"bilinear": "triangle", "linear": "triangle", "bicubic": "cubic", "cubic": "cubic", "lanczos": "lanczos", "lanczos3": "lanczos"}  # other names: nearest


def _weights(n: int, size: int, kernel: str) -> np.ndarray:
    reach, f = _KERNELS[kernel]
    ratio = n / size
    scale = max(ratio, 1.0)
    centre = (np.arange(size) + 0.5) * ratio
    w = f((np.arange(n)[None, :] + 0.5 - centre[:, None]) / scale)
    w = np.where(np.abs(np.arange(n)[None, :] + 0.5 - centre[:, None]) <= reach * scale, w, 0)
    return w / w.sum(1, keepdims=True)


def resize(grid: np.ndarray, width: int, height: int, kernel: str = "nearest") -> np.ndarray:
    h, w = grid.shape[:2]
    name = _NAMES.get(kernel)
    if name is None:
        return grid[((np.arange(height) + 0.5) * h / height).astype(np.int64)][:, ((np.arange(width) + 0.5) * w / width).astype(np.int64)]
    out = np.einsum("yh,hwc->ywc", _weights(h, height, name), grid.astype(np.float64))
    out = np.einsum("xw,ywc->yxc", _weights(w, width, name), out)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


# ---- blocks of two by two, palettes, bits


def replicate(data: bytes) -> tuple[np.ndarray, int, int]:
    """Each byte as a block of two by two cells, row by row in a grid that is about square; unused cells are 0."""
    across = int(np.ceil(np.sqrt(len(data)))) if data else 0
    down = -(-len(data) // across) if across else 0
    cells = np.zeros(across * down, np.uint8)
    cells[: len(data)] = np.frombuffer(data, np.uint8)
    return cells.reshape(down, across).repeat(2, 0).repeat(2, 1), 2 * across, 2 * down


def unreplicate(grid: np.ndarray) -> bytes:
    """The grid's bytes, with the unused cells."""
    return grid[::2, ::2].tobytes()


def palette(n: int = 256) -> np.ndarray:
    i = np.arange(n)
    return np.stack([i, i * 127 & 255, 255 - i], 1).astype(np.uint8)


def bits_of(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8))


def bytes_of(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def pack_indices(row: np.ndarray, depth: int) -> bytes:
    """Palette indices of a row, depth bits each, the first in the highest bits."""
    bits = np.unpackbits(row.astype(np.uint8)[:, None], axis=1)[:, 8 - depth :]
    return np.packbits(bits.ravel()).tobytes()


def colours(codes: np.ndarray, cap: int = 257) -> tuple[np.ndarray, np.ndarray]:
    """Distinct colours by first occurrence (cap at most), and how often each occurs."""
    names, first, n = np.unique(codes, return_index=True, return_counts=True)
    order = np.argsort(first)[:cap]
    return names[order], n[order]


def bit_depth(n: int) -> int:
    """Bits of an index into n colours."""
    return 1 if n <= 2 else 2 if n <= 4 else 4 if n <= 16 else 8
