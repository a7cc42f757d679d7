"""Reversible codecs of one value: bytes in, bytes out. They run inside Arrow functions, a value or a block at a time."""

from __future__ import annotations

import struct
from functools import cache

import numpy as np
import zstandard

from packframe.functions import policy

U8 = np.uint8


def delta(b: bytes) -> bytes:
    x = np.frombuffer(b, U8)
    return np.diff(x, prepend=U8(0)).tobytes()


def undelta(b: bytes) -> bytes:
    return np.cumsum(np.frombuffer(b, U8), dtype=U8).tobytes()


# ---- Burrows-Wheeler


FIRST = 7  # bytes of a suffix that sort at once: nine bits each, as the end sorts before every byte


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Prefix doubling over the suffixes that aren't told apart yet. A rank is the place at which a suffix's group begins."""
    n = len(x)
    ahead = np.zeros(n + FIRST, np.int64)
    ahead[:n] = x
    ahead[:n] += 1
    key = ahead[:n].copy()
    for i in range(1, FIRST):
        key <<= 9
        key |= ahead[i : n + i]
    order = np.argsort(key)
    key = key[order]
    begins = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
    rank = np.zeros(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    left, step = np.flatnonzero(~(begins & np.append(begins[1:], True))), FIRST
    while len(left):
        some = order[left]
        after = some + step
        key = rank[some] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        now = np.argsort(key)
        key, some = key[now], some[now]
        begins = np.concatenate([[True], key[1:] != key[:-1]])
        order[left] = some
        rank[some] = np.maximum.accumulate(np.where(begins, left, 0))
        left, step = left[~(begins & np.append(begins[1:], True))], 2 * step
    return order


def bwt(b: bytes) -> tuple[bytes, int]:
    """The last column without the sentinel, and the row at which the sentinel stood."""
    if not b:
        return b"", 0
    x = np.frombuffer(b, U8)
    order = np.concatenate([[len(x)], suffix_array(x)])
    row = int(np.flatnonzero(order == 0)[0])
    last = x[order - 1]
    return np.delete(last, row).tobytes(), row


def unbwt(last: bytes, row: int) -> bytes:
    n = len(last)
    if not n:
        return b""
    col = np.insert(np.frombuffer(last, U8).astype(np.int64) + 1, row, 0)
    step = np.argsort(col, kind="stable")  # first-column row -> last-column row
    # the walk step[row], step[step[row]], ...: its first 2**k places give the next 2**k by steps of 2**k
    at = np.array([step[row]])
    while len(at) < n:
        at = np.concatenate([at, step[at]])
        step = step[step]
    return (col[at[:n]] - 1).astype(U8).tobytes()


# ---- many values, a byte of each at a time

LEAST = 12  # values with a byte left; for fewer a loop over their bytes takes less time


def _flat(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all values, the longest first, where each begins, and their sizes."""
    sizes = np.array([len(b) for b in values], np.int64)
    return np.frombuffer(b"".join(values), U8), np.cumsum(sizes) - sizes, sizes


def _sorted(f, values: list[bytes]) -> list[bytes]:
    """f of the values, which gets them with the longest first."""
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    out: list = [b""] * len(values)
    for i, x in zip(order, f([values[i] for i in order]), strict=True):
        out[i] = x
    return out


def _steps(sizes: np.ndarray, least: int):
    """(step, number of values that have a byte there), while there are so many; sizes descend."""
    left = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
    return ((t, int(k)) for t, k in enumerate(left.tolist()) if k >= least)


# ---- move to front, zero runs


def mtf(b: bytes) -> bytes:
    return bytes(_mtf(b, list(range(256))))


def _mtf(b: bytes, table: list[int]) -> bytearray:
    out = bytearray(len(b))
    for i, x in enumerate(b):
        k = table.index(x)
        out[i] = k
        if k:
            del table[k]
            table.insert(0, x)
    return out


def unmtf(b: bytes) -> bytes:
    return bytes(_unmtf(b, list(range(256))))


def _unmtf(b: bytes, table: list[int]) -> bytearray:
    out = bytearray(len(b))
    for i, k in enumerate(b):
        x = table[k]
        out[i] = x
        if k:
            del table[k]
            table.insert(0, x)
    return out


def mtf_all(values: list[bytes]) -> list[bytes]:
    """mtf() of many values."""
    return _sorted(lambda v: _fronts(v, False), values)


def unmtf_all(values: list[bytes]) -> list[bytes]:
    return _sorted(lambda v: _fronts(v, True), values)


def _fronts(values: list[bytes], back: bool) -> list[bytes]:
    """A row for each value holds the place of every byte in its table: at each step those before the byte's own move by one."""
    raw, start, sizes = _flat(values)
    out = np.empty_like(raw)
    places = np.tile(np.arange(256, dtype=U8), (len(values), 1))
    flat, rows, at, done = places.reshape(-1), np.arange(len(values)) * 256, start.copy(), 0
    for t, k in _steps(sizes, LEAST):
        here, table = at[:k], places[:k]
        now = raw[here]
        if back:
            own = rows[:k] + (table == now[:, None]).argmax(1)
            out[here] = own - rows[:k]
            place = now
        else:
            own = rows[:k] + now
            place = flat[own]
            out[here] = place
        table += (table < place[:, None]).view(U8)
        flat[own] = 0
        here += 1
        done = t + 1
    for i in np.flatnonzero(sizes > done).tolist():
        rest = slice(int(start[i]) + done, int(start[i] + sizes[i]))
        table = np.argsort(places[i]).tolist()
        out[rest] = np.frombuffer((_unmtf if back else _mtf)(raw[rest].tobytes(), table), U8)
    return [out[s : s + n].tobytes() for s, n in zip(start.tolist(), sizes.tolist(), strict=True)]


TOKENS = 1 << 15  # that are written or read at one time


def rle0(b: bytes) -> bytes:
    """A zero run: bit 0 and its length plus 1 in Elias gamma; any other byte: bit 1 and the byte."""
    x = np.frombuffer(b, U8)
    if not len(x):
        return b""
    zero = x == 0
    at = np.flatnonzero(~zero | np.append(True, ~zero[:-1]))  # a run is where it begins
    run = zero[at]
    value = np.where(run, np.diff(np.append(at, len(x))) + 1, x[at].astype(np.int64) | 256)
    size = np.where(run, 2 * np.frexp(value.astype(np.float64))[1], 9)
    end = np.cumsum(size)
    bits = np.zeros(int(end[-1]), U8)
    for i in range(0, len(at), TOKENS):
        v, e, r = value[i : i + TOKENS], end[i : i + TOKENS], run[i : i + TOKENS]
        bits[e[~r][:, None] - 1 - np.arange(9)] = v[~r][:, None] >> np.arange(9) & 1
        v, e = v[r], e[r]
        while len(v):  # the lowest bit that is left
            bits[e - 1] = v & 1
            v, e = v >> 1, e - 1
            v, e = v[v > 0], e[v > 0]
    return np.packbits(bits).tobytes()


WINDOW = 9 << 15  # bits that are looked through at one time


def _ends(bits: np.ndarray) -> np.ndarray:
    """For each bit the row, nine bits each, of the first 0 in its column from there on; the number of rows if there is none."""
    rows = -(-len(bits) // 9)
    first = np.zeros(rows * 9, U8)
    first[: len(bits)] = bits
    ends = np.where(first.reshape(rows, 9) == 0, np.arange(rows)[:, None], rows)
    return np.minimum.accumulate(ends[::-1], 0)[::-1].ravel()


def unrle0(b: bytes, n: int) -> bytes:
    bits = np.unpackbits(np.frombuffer(b, U8))
    text, at, done, found, window, ends = (bits | 48).tobytes(), 0, 0, [], 0, []
    while done < n:
        if at >= len(bits):
            raise IndexError("the bits end early")
        if bits[at]:
            if at - window >= len(ends):  # where the bytes that follow one another at a place end: the next 0 nine, eighteen, ... bits on
                window, ends = at, _ends(bits[at : at + WINDOW])
            k = min(int(ends[at - window]) - (at - window) // 9, n - done)
            found.append((at, done, k))
            at, done = at + 9 * k, done + k
        else:
            one = text.index(b"1", at + 1)
            size = one - at - 1
            done += int(text[one : one + size + 1], 2) - 1
            at = one + size + 1
    out = np.zeros(n, U8)
    if found:
        where, place, k = np.array(found).T
        inside = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        where, place = np.repeat(where, k) + 9 * inside, np.repeat(place, k) + inside
        bits = np.append(bits, np.zeros(9, U8))
        for i in range(0, len(where), TOKENS):
            out[place[i : i + TOKENS]] = np.packbits(bits[where[i : i + TOKENS, None] + np.arange(1, 9)], axis=1)[:, 0]
    return out.tobytes()


# ---- rANS

SCALE_BITS = 12
SCALE = 1 << SCALE_BITS
LOW = 1 << 23


def normalize(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 4096, at least 1 where the count is positive. Surplus or lack goes to the most frequent symbol
    (the first of equals); if that can't bear it, to the next ones as well."""
    total = int(counts.sum())
    if not total:
        out = np.zeros(256, np.int64)
        out[0] = SCALE
        return out
    out = np.where(counts > 0, np.maximum(counts.astype(np.int64) * SCALE // total, 1), 0)
    off = SCALE - int(out.sum())
    for s in np.argsort(-counts, kind="stable"):
        if not off:
            break
        change = max(off, 1 - int(out[s])) if out[s] else 0
        out[s] += change
        off -= change
    return out


def _put(x: int, out: bytearray, f: int, c: int) -> int:
    top = ((LOW >> SCALE_BITS) << 8) * f
    while x >= top:
        out.append(x & 255)
        x >>= 8
    return (x // f << SCALE_BITS) + x % f + c


# Fixed values of the format: below TWO bytes one stream, below FOUR two, else four; the mode byte says which.
TWO, FOUR = 16, 64


def rans_encode(b: bytes, freq: np.ndarray) -> bytes:
    """Mode, states (big-endian) and bytes. Symbols go in from the last to the first, so they come out in order. Two streams share their bytes;
    four have their own, with their sizes before them."""
    if not b:
        return b""
    f, c = freq.tolist(), (np.cumsum(freq) - freq).tolist()
    mode = 0 if len(b) < TWO else 1 if len(b) < FOUR else 2
    n = (1, 2, 4)[mode]
    states = [LOW] * n
    outs = [bytearray() for _ in range(n)] if mode == 2 else [bytearray()] * n
    for i in range(len(b) - 1, -1, -1):
        k, s = i % n, b[i]
        states[k] = _put(states[k], outs[k], f[s], c[s])
    head = bytes([mode]) + struct.pack(f">{n}I", *states)
    if mode < 2:
        return head + bytes(reversed(outs[0]))
    return head + struct.pack("<4I", *map(len, outs)) + b"".join(bytes(reversed(o)) for o in outs)


def rans_decode(b: bytes, freq: np.ndarray, size: int) -> bytes:
    if not size:
        return b""
    f, cum = freq.tolist(), (np.cumsum(freq) - freq).tolist()
    symbol = np.repeat(np.arange(256), freq).tolist()
    if b[0] > 2:
        raise ValueError(f"unknown mode {b[0]}")
    n = (1, 2, 4)[b[0]]
    states, at = list(struct.unpack_from(f">{n}I", b, 1)), [1 + 4 * n] * n
    if n == 4:
        sizes = struct.unpack_from("<4I", b, 17)
        at = [33 + sum(sizes[:k]) for k in range(4)]
    else:
        at = [1 + 4 * n] * n
    shared, out = n < 4, bytearray(size)
    for i in range(size):
        k = i % n
        x = states[k]
        slot = x & (SCALE - 1)
        s = symbol[slot]
        out[i] = s
        x = f[s] * (x >> SCALE_BITS) + slot - cum[s]
        p = 0 if shared else k
        while x < LOW and at[p] < len(b):
            x = x << 8 | b[at[p]]
            at[p] += 1
        states[k] = x
    return bytes(out)


def _lanes(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The four streams of each value, the longest first: value, stream, where its first symbol is in all bytes, number of symbols."""
    _, start, sizes = _flat(values)
    value, stream = np.divmod(np.arange(4 * len(values)), 4)
    n = (sizes[value] - stream + 3) // 4
    order = np.argsort(-n, kind="stable")
    return value[order], stream[order], (start[value] + stream)[order], n[order]


WIDE = 64 << 20  # bytes: the number of values times the longest, as what is held grows with it


def _together(values: list[bytes]) -> list[int]:
    """Those whose streams are coded together, if there are enough; others are coded by themselves."""
    some = [i for i, b in enumerate(values) if len(b) >= FOUR]
    return some if len(some) >= LEAST and len(some) * max(len(values[i]) for i in some) <= WIDE else []


def rans_encode_all(values: list[bytes], freqs: list[np.ndarray]) -> list[bytes]:
    """rans_encode() of many values, each by its own frequencies: a symbol of every stream at each step."""
    some = _together(values)
    out: list = [None] * len(values)
    if some:
        chosen = [values[i] for i in some]
        raw, _, sizes = _flat(chosen)
        freq = np.stack([freqs[i] for i in some])
        at = np.repeat(np.arange(len(some)) * 256, sizes) + raw
        f, c = freq.ravel()[at].astype(np.uint16), (np.cumsum(freq, 1) - freq).ravel()[at].astype(np.uint16)
        del at
        value, stream, first, n = _lanes(chosen)
        steps = int(n[0])
        put, state = np.zeros((2 * steps, len(n)), U8), np.full(len(n), LOW, np.int64)  # at a step two bytes at most
        there = np.zeros(put.shape, bool)
        for t, k in reversed([*_steps(n, 1)]):
            here = first[:k] + 4 * t
            x, g = state[:k], f[here].astype(np.int64)
            top = g << 19  # as in _put
            for row in (2 * t + 1, 2 * t):
                more = x >= top
                if not more.any():
                    break
                put[row, :k], there[row, :k] = x & 255, more
                x = np.where(more, x >> 8, x)
            state[:k] = x + (x / g).astype(np.int64) * (SCALE - g) + c[here]  # the quotient is exact: both are under 2**31
        counts = there.sum(0)
        flat, ends = put.T[there.T].tobytes(), np.cumsum(counts)
        slot = np.empty((len(some), 4), np.int64)
        slot[value, stream] = np.arange(len(n))
        for i, lanes in zip(some, slot.tolist(), strict=True):
            head = b"\2" + struct.pack(">4I", *state[lanes].tolist()) + struct.pack("<4I", *counts[lanes].tolist())
            out[i] = head + b"".join(flat[int(ends[k] - counts[k]) : int(ends[k])] for k in lanes)
    return [rans_encode(b, freqs[i]) if out[i] is None else out[i] for i, b in enumerate(values)]


def rans_decode_all(coded: list[bytes], freqs: list[np.ndarray], sizes: list[int]) -> list[bytes]:
    """rans_decode() of many values."""
    some = [i for i, (b, f, n) in enumerate(zip(coded, freqs, sizes, strict=True)) if n >= FOUR and len(b) >= 33 and b[0] == 2 and f.sum() == SCALE]
    out: list = [None] * len(coded)
    if len(some) >= LEAST:
        raw, start, _ = _flat([coded[i] for i in some])
        heads = [struct.unpack_from(">4I", coded[i], 1) + struct.unpack_from("<4I", coded[i], 17) for i in some]
        heads = np.array(heads, np.int64)
        freq = np.stack([freqs[i] for i in some])
        symbol = np.repeat(np.tile(np.arange(256, dtype=U8), len(some)), freq.ravel())
        by = np.repeat(freq.ravel(), freq.ravel()).astype(np.uint16)
        bias = (np.tile(np.arange(SCALE), len(some)) - np.repeat((np.cumsum(freq, 1) - freq).ravel(), freq.ravel())).astype(np.uint16)
        total = np.array([sizes[i] for i in some], np.int64)
        back = np.zeros(int(total.sum()), U8)
        origin = np.cumsum(total) - total
        value, stream = np.divmod(np.arange(4 * len(some)), 4)
        n = (total[value] - stream + 3) // 4
        order = np.argsort(-n, kind="stable")
        value, stream, n = value[order], stream[order], n[order]
        state, table, place = heads[value, stream], value * SCALE, origin[value] + stream
        at = (start[:, None] + 33 + np.cumsum(heads[:, 4:], 1) - heads[:, 4:])[value, stream]
        ends = (start + [len(coded[i]) for i in some])[value]
        raw = np.append(raw, U8(0))
        for t, k in _steps(n, 1):
            x = state[:k]
            j = table[:k] + (x & (SCALE - 1))
            back[place[:k] + 4 * t] = symbol[j]
            x = by[j] * (x >> SCALE_BITS) + bias[j]
            low = np.flatnonzero((x < LOW) & (at[:k] < ends[:k]))
            while len(low):
                x[low] = x[low] << 8 | raw[at[low]]
                at[low] += 1
                low = low[(x[low] < LOW) & (at[low] < ends[low])]
            state[:k] = x
        for i, o, m in zip(some, origin.tolist(), total.tolist(), strict=True):
            out[i] = back[o : o + m].tobytes()
    return [rans_decode(b, freqs[i], sizes[i]) if out[i] is None else out[i] for i, b in enumerate(coded)]


def order1(b: bytes) -> np.ndarray:
    """(context, symbol) frequencies that add up to 4096 in each context; the first byte's context is 0. Contexts that don't occur are uniform."""
    x = np.frombuffer(b, U8).astype(np.int64)
    counts = np.bincount(np.concatenate([[0], x[:-1]]) * 256 + x, minlength=65536).reshape(256, 256) if len(x) else np.zeros((256, 256), np.int64)
    return np.stack([normalize(row) if row.any() else np.full(256, SCALE // 256) for row in counts])


def rans_encode_order1(b: bytes, freq: np.ndarray) -> bytes:
    """As rans_encode with one stream, each symbol by the frequencies after its predecessor."""
    if not b:
        return b""
    f, c = freq.tolist(), (np.cumsum(freq, 1) - freq).tolist()
    x, out = LOW, bytearray()
    for i in range(len(b) - 1, -1, -1):
        before = b[i - 1] if i else 0
        x = _put(x, out, f[before][b[i]], c[before][b[i]])
    return b"\0" + struct.pack(">I", x) + bytes(reversed(out))


def rans_decode_order1(b: bytes, freq: np.ndarray, size: int) -> bytes:
    if not size:
        return b""
    f, cum = freq.tolist(), (np.cumsum(freq, 1) - freq).tolist()
    symbol = [np.repeat(np.arange(256), row).tolist() for row in freq]
    (x,), at, out, s = struct.unpack_from(">I", b, 1), 5, bytearray(size), 0
    for i in range(size):
        slot, before = x & (SCALE - 1), s
        s = symbol[before][slot]
        out[i] = s
        x = f[before][s] * (x >> SCALE_BITS) + slot - cum[before][s]
        while x < LOW and at < len(b):
            x = x << 8 | b[at]
            at += 1
    return bytes(out)


def stats1_bytes(freq: np.ndarray) -> bytes:
    """For each context: itself, then its frequencies as stats_bytes writes them."""
    return b"".join(bytes([c]) + stats_bytes(row) for c, row in enumerate(freq))


def stats1_from(b: bytes) -> tuple[np.ndarray, int]:
    freq, at = np.zeros((256, 256), np.int64), 0
    while at < len(b):
        c = b[at]
        freq[c], size = stats_from(b[at + 1 :])
        at += 1 + size
    return freq, at


def stats_bytes(freq: np.ndarray) -> bytes:
    """u16le count, then (u8 symbol, u16le frequency) each."""
    some = np.flatnonzero(freq)
    return struct.pack("<H", len(some)) + b"".join(struct.pack("<BH", s, freq[s]) for s in some)


def stats_from(b: bytes) -> tuple[np.ndarray, int]:
    (n,) = struct.unpack_from("<H", b)
    freq = np.zeros(256, np.int64)
    for k in range(n):
        s, f = struct.unpack_from("<BH", b, 2 + 3 * k)
        freq[s] = f
    return freq, 2 + 3 * n


def _frequencies(b: bytes) -> np.ndarray:
    return normalize(np.bincount(np.frombuffer(b, U8), minlength=256))


def rans_pack(b: bytes) -> bytes:
    return rans_pack_all([b])[0]


def rans_pack_all(values: list[bytes]) -> list[bytes]:
    freqs = [_frequencies(b) for b in values]
    return [struct.pack("<I", len(b)) + stats_bytes(f) + c for b, f, c in zip(values, freqs, rans_encode_all(values, freqs), strict=True)]


def rans_unpack(b: bytes) -> bytes:
    return rans_unpack_all([b])[0]


def rans_unpack_all(values: list[bytes]) -> list[bytes]:
    stats = [stats_from(b[4:]) for b in values]
    return rans_decode_all([b[4 + size :] for b, (_, size) in zip(values, stats, strict=True)], [f for f, _ in stats], [struct.unpack_from("<I", b)[0] for b in values])


# ---- zstd


@cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    """Its memory is used again by the next value."""
    return zstandard.ZstdCompressor(level=level)


def zstd(b: bytes, level: int = 3, dictionary: bytes | None = None, window_log: int = 0, long_distance: bool = False, prefix: bytes = b"") -> bytes:
    """A frame of prefix and b."""
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if not window_log and not long_distance:
        c = zstandard.ZstdCompressor(level=level, dict_data=d) if d else _compressor(level)
        return c.compress(prefix + b)
    options = {"window_log": window_log} if window_log else {}
    made = zstandard.ZstdCompressionParameters.from_level(level, source_size=len(prefix) + len(b), enable_ldm=long_distance, **options)
    return zstandard.ZstdCompressor(compression_params=made, dict_data=d).compress(prefix + b)


def zstd_by_policy(b: bytes, requested: int = 19, prefix: bytes = b"ROX1") -> bytes:
    """The frame of a payload: level, window and long-distance matching by size and entropy, as policy.py says."""
    size = len(b) + len(prefix)
    e = entropy_bits(b[: 16 << 10]) if b else 4.0
    bands = next(steps for at, steps in policy.LEVEL_BANDS if size > at)
    level = min(max(1, min(requested, 22)), next(v for top, v in bands if top is None or e < top))
    window = next(v for at, v in policy.MEMORY_WINDOW_LOGS if len(b) > at) if len(b) > 256 << 10 else 0
    return zstd(b, level, None, window, len(b) > 32 << 20, prefix)


def directory_level(sample: bytes, total: int) -> int:
    """The level for a directory of total bytes, by how its first bytes (4 MiB at most) compress at level 3."""
    if not sample:
        return 3
    ratio = len(zstd(sample[: 4 << 20], 3)) / len(sample[: 4 << 20])
    base = 1 if ratio > 0.90 else 3 if ratio > 0.75 else 6 if ratio < 0.25 else 5  # fixed values of the policy
    return min(base, next(v for at, v in policy.DIR_CAPS if total > at))


def zstd_frames(pieces, level: int = 19):
    """Each piece as a frame, one at a time."""
    c = zstandard.ZstdCompressor(level=level)
    for piece in pieces:
        yield c.compress(piece)


def unzstd(b: bytes, dictionary: bytes | None = None) -> bytes:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=d, max_window_size=1 << 31).decompressobj().decompress(b)


def train_dictionary(samples: list[bytes], size: int = 112_640) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their own bytes make a plain dictionary
        return b"".join(samples)[-size:]


CHUNK_MAGIC = b"ZSTD"


def zstd_chunked(b: bytes, chunk: int = 32 << 20, level: int = 3) -> bytes:
    """A bare frame up to a chunk; else magic, number of frames, their sizes, the frames (big-endian)."""
    if len(b) <= chunk:
        return zstd(b, level)
    frames = [zstd(b[i : i + chunk], level) for i in range(0, len(b), chunk)]
    return CHUNK_MAGIC + struct.pack(f">I{len(frames)}I", len(frames), *map(len, frames)) + b"".join(frames)


def unzstd_chunked(b: bytes) -> bytes:
    if b[:4] != CHUNK_MAGIC:
        return unzstd(b)
    (n,) = struct.unpack_from(">I", b, 4)
    sizes = struct.unpack_from(f">{n}I", b, 8)
    at, out = 8 + 4 * n, []
    for s in sizes:
        out.append(unzstd(b[at : at + s]))
        at += s
    return b"".join(out)


# ---- hybrid blocks: flags and layout are fixed values of the format

STORE, ZSTD9, BWT, ZSTD19, ZSTD_WHOLE = 0, 1, 2, 3, 4
HYBRID_MAGIC, HYBRID_OLD = b"RBW2", b"RBW1"


def entropy_bits(b: bytes) -> float:
    n = np.bincount(np.frombuffer(b, U8), minlength=256)
    p = n[n > 0] / max(1, len(b))
    return float(-(p * np.log2(p)).sum()) if len(b) else 0.0


def bwt_block(b: bytes) -> bytes:
    return bwt_blocks([b])[0]


def bwt_blocks(values: list[bytes]) -> list[bytes]:
    sorted_ = [bwt(b) for b in values]
    coded = [rle0(x) for x in mtf_all([last for last, _ in sorted_])]
    freqs = [_frequencies(x) for x in coded]
    parts = zip(values, sorted_, coded, freqs, rans_encode_all(coded, freqs), strict=True)
    return [struct.pack("<III", row, len(b), len(x)) + stats_bytes(f) + c for b, (_, row), x, f, c in parts]


def unbwt_block(b: bytes) -> bytes:
    return unbwt_blocks([b])[0]


def unbwt_blocks(blocks: list[bytes]) -> list[bytes]:
    heads, stats = [struct.unpack_from("<III", b) for b in blocks], [stats_from(b[12:]) for b in blocks]
    coded = rans_decode_all([b[12 + at :] for b, (_, at) in zip(blocks, stats, strict=True)], [f for f, _ in stats], [h[2] for h in heads])
    moves = unmtf_all([unrle0(x, n) for x, (_, n, _) in zip(coded, heads, strict=True)])
    return [unbwt(x, row) for x, (row, _, _) in zip(moves, heads, strict=True)]


def hybrid_block(b: bytes) -> bytes:
    return hybrid_blocks([b])[0]


def hybrid_blocks(blocks: list[bytes]) -> list[bytes]:
    """The smallest coding of each."""
    entropies = [entropy_bits(b) for b in blocks]
    sort = [i for i, (b, e) in enumerate(zip(blocks, entropies, strict=True)) if b and e < 7.5]
    sorted_ = dict(zip(sort, bwt_blocks([blocks[i] for i in sort]), strict=True))
    out = []
    for i, (b, e) in enumerate(zip(blocks, entropies, strict=True)):
        best = bytes([STORE]) + b
        if b and e < 7.95:
            size = struct.pack("<I", len(b))
            tries = [bytes([ZSTD9]) + size + zstd(b, 1 if e >= 7.5 else 9)]
            if i in sorted_:
                tries += [bytes([BWT]) + sorted_[i], bytes([ZSTD19]) + size + zstd(b, 19)]
            coded = min(tries, key=len)  # on a tie the first named
            best = coded if len(coded) < len(b) else best
        out.append(best)
    return out


def hybrid_unblock(b: bytes) -> bytes:
    return hybrid_unblocks([b])[0]


def hybrid_unblocks(blocks: list[bytes]) -> list[bytes]:
    sort = [i for i, b in enumerate(blocks) if b[0] == BWT]
    sorted_ = dict(zip(sort, unbwt_blocks([blocks[i][1:] for i in sort]), strict=True))
    for b in blocks:
        if b[0] > ZSTD_WHOLE:
            raise ValueError(f"unknown kind of block {b[0]}")
    return [b[1:] if b[0] == STORE else sorted_[i] if b[0] == BWT else unzstd(b[5:]) for i, b in enumerate(blocks)]


def hybrid(b: bytes, block: int = 16 << 20) -> bytes:
    return hybrid_all([b], block)[0]


def hybrid_all(values: list[bytes], block: int = 16 << 20) -> list[bytes]:
    """Blocks of the smallest coding each. If that comes to over 35 % of the input, one frame of the whole is tried, and taken if it is smaller."""
    parts = [[b[i : i + block] for i in range(0, len(b), block)] for b in values]
    coded, made = iter(hybrid_blocks([x for p in parts for x in p])), []
    for b, p in zip(values, parts, strict=True):
        blocks = [next(coded) for _ in p]
        out = HYBRID_MAGIC + struct.pack(f"<IQ{len(blocks)}I", len(blocks), len(b), *map(len, blocks)) + b"".join(blocks)
        if len(out) > len(b) * 35 // 100 and b:
            whole = bytes([ZSTD_WHOLE]) + struct.pack("<I", len(b)) + zstd(b, 15, None, 27) if len(b) < 1 << 32 else b""
            if whole and 20 + len(whole) < len(out):
                out = HYBRID_MAGIC + struct.pack("<IQI", 1, len(b), len(whole)) + whole
        made.append(out)
    return made


def unhybrid(b: bytes) -> bytes:
    return unhybrid_all([b])[0]


def unhybrid_all(values: list[bytes]) -> list[bytes]:
    """Both versions; blocks of the old one are always of the sorted coding, without a flag."""
    parts, totals = [], []
    for b in values:
        if b[:4] not in (HYBRID_MAGIC, HYBRID_OLD):
            raise ValueError("not a hybrid container")
        n, total = struct.unpack_from("<IQ", b, 4)
        if len(b) < 16 + 4 * n:
            raise ValueError("the table of blocks ends early")
        sizes, at, found = struct.unpack_from(f"<{n}I", b, 16), 16 + 4 * n, []
        for s in sizes:
            if at + s > len(b):
                raise ValueError("a block ends early")
            found.append(b[at : at + s] if b[:4] == HYBRID_MAGIC else bytes([BWT]) + b[at : at + s])
            at += s
        parts.append(found)
        totals.append(total)
    back, out = iter(hybrid_unblocks([x for p in parts for x in p])), []
    for p, total in zip(parts, totals, strict=True):
        whole = b"".join(next(back) for _ in p)
        if len(whole) != total:
            raise ValueError(f"{len(whole)} bytes where {total} were said")
        out.append(whole)
    return out
