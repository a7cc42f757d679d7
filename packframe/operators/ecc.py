"""Reed-Solomon over GF(256): polynomial 0x11D, generator 2, first root 2**0, 255 symbols a block; column-major interleaving."""

from __future__ import annotations

import struct
from functools import cache

import numpy as np

POLY, N = 0x11D, 255
LEVELS = {"low": 20, "medium": 40, "quartile": 64, "high": 128}
MAGIC = b"ECC1"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(512, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i], log[x] = x, i
        x <<= 1
        x ^= POLY if x & 256 else 0
    exp[255:510] = exp[:255]
    return exp, log


EXP, LOG = _tables()


def mul(a, b):
    a, b = np.asarray(a), np.asarray(b)
    return np.where((a == 0) | (b == 0), 0, EXP[LOG[a] + LOG[b]])


PRODUCT = mul(np.arange(256)[:, None], np.arange(256)[None, :]).astype(np.uint8)


@cache
def generator(nsym: int) -> np.ndarray:
    g = np.array([1])
    for i in range(nsym):
        g = np.bitwise_xor(np.append(g, 0), np.append([0], mul(g, EXP[i])))
    return g


@cache
def parity_rows(nsym: int) -> np.ndarray:
    """The parity of each unit vector: encoding is linear, so parity = xor of rows times symbols."""
    k, g = N - nsym, generator(nsym)
    rows, rest = np.zeros((k, nsym), np.int64), np.zeros(nsym, np.int64)
    rest[:] = g[1:]
    for i in range(k - 1, -1, -1):
        rows[i] = rest
        rest = np.bitwise_xor(np.append(rest[1:], 0), mul(rest[0], g[1:]))
    return rows


@cache
def _parity_tables(nsym: int) -> np.ndarray:
    """(position, symbol, parity): what a symbol at a position adds to the parity."""
    return PRODUCT[np.arange(256)[None, :, None], parity_rows(nsym)[:, None, :]]


def _words(x: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words, zero-padded: xor works on eight bytes at a time."""
    return np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, -x.shape[-1] % 8)]).view(np.uint64)


def parity(data: np.ndarray, nsym: int) -> np.ndarray:
    """(blocks, nsym) parity of (blocks, 255 - nsym) symbols."""
    table = _words(np.ascontiguousarray(_parity_tables(nsym)))
    out = np.zeros((len(data), table.shape[-1]), np.uint64)
    for i in range(N - nsym):
        out ^= table[i][data[:, i]]
    return out.view(np.uint8)[:, :nsym]


def encode_blocks(data: np.ndarray, nsym: int) -> np.ndarray:
    """(blocks, 255 - nsym) symbols to (blocks, 255)."""
    data = data.astype(np.uint8, copy=False)
    return np.concatenate([data, parity(data, nsym)], 1)


@cache
def _syndrome_tables(nsym: int) -> np.ndarray:
    powers = EXP[np.arange(nsym)[None, :] * (N - 1 - np.arange(N))[:, None] % 255]
    return PRODUCT[np.arange(256)[None, :, None], powers[:, None, :]]


def syndromes(words: np.ndarray, nsym: int) -> np.ndarray:
    table = _words(np.ascontiguousarray(_syndrome_tables(nsym)))
    out = np.zeros((len(words), table.shape[-1]), np.uint64)
    words = words.astype(np.uint8, copy=False)
    for i in range(N):
        out ^= table[i][words[:, i]]
    return out.view(np.uint8)[:, :nsym].astype(np.int64)


_FLAT = PRODUCT.ravel()
_INVERSE = np.concatenate([[0], EXP[(255 - LOG[1:]) % 255]]).astype(np.uint8)
TOGETHER = 4096  # blocks that are solved at one time


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _FLAT.take(a.astype(np.uint16) << 8 | b)


@cache
def _root_tables(terms: int) -> np.ndarray:
    """(term, coefficient, position from the end): a term's value where the position's root is tried, packed in words."""
    powers = EXP[(255 - np.arange(N)) * np.arange(terms)[:, None] % 255]
    return _words(np.ascontiguousarray(PRODUCT[np.arange(256)[None, :, None], powers[:, None, :]]))


def _values(table: np.ndarray, poly: np.ndarray, terms: range) -> np.ndarray:
    """(blocks, 255): the polynomials' terms summed up at each root."""
    out = np.zeros((len(poly), table.shape[-1]), np.uint64)
    for i in terms:
        out ^= table[i][poly[:, i]]
    return out.view(np.uint8)[:, :N]


def _locators(syn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Error locators (coefficients ascending) and their degrees of many blocks' syndromes, by Berlekamp and Massey, a step for all blocks at once."""
    count, nsym = syn.shape
    now, before = np.zeros((2, count, nsym + 1), np.uint8)
    now[:, 0] = before[:, 0] = 1
    degree, last = np.zeros(count, np.int64), np.ones(count, np.uint8)
    for n in range(nsym):
        gap = syn[:, n] ^ np.bitwise_xor.reduce(_times(now[:, 1 : n + 1], syn[:, :n][:, ::-1]), axis=1) if n else syn[:, 0]
        before = np.concatenate([np.zeros((count, 1), np.uint8), before[:, :-1]], 1)
        grow = (gap != 0) & (2 * degree <= n)
        new = now ^ _times(_times(gap, _INVERSE[last])[:, None], before)
        before = np.where(grow[:, None], now, before)
        now, last, degree = new, np.where(grow, gap, last), np.where(grow, n + 1 - degree, degree)
    return now, degree


def correct_all(words: np.ndarray, syn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks with non-zero syndromes, and how many symbols of each were wrong: roots of the locators by trial, magnitudes by Forney."""
    if len(words) > TOGETHER:
        parts = [correct_all(words[i : i + TOGETHER], syn[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        return np.concatenate([w for w, _ in parts]), np.concatenate([n for _, n in parts])
    nsym = syn.shape[1]
    most, syn = nsym // 2, syn.astype(np.uint8)
    locator, count = _locators(syn)
    if (count < 1).any() or (count > most).any():
        raise ValueError("too many errors")
    top = np.zeros((len(words), most), np.uint8)  # syndromes times locator, its low coefficients
    for i in range(most):
        top[:, i:] ^= _times(locator[:, i, None], syn[:, : most - i])
    table = _root_tables(most + 1)
    odd = _values(table, locator, range(1, most + 1, 2))
    hit = (odd ^ _values(table, locator, range(0, most + 1, 2))) == 0
    if (hit.sum(1) != count).any():
        raise ValueError("too many errors")
    block, place = np.nonzero(hit)
    out = words.astype(np.uint8)
    # Forney with first root 0: X * omega(1/X) / locator'(1/X), and the locator's slope is X times its odd terms
    out[block, N - 1 - place] ^= _times(_values(table, top, range(most))[hit], _INVERSE[odd[hit]])
    if syndromes(out, nsym).any():
        raise ValueError("too many errors")
    return out, count


def decode_blocks(words: np.ndarray, nsym: int) -> tuple[np.ndarray, np.ndarray]:
    """Data symbols, and the number of corrected ones of each block. A block whose parity is that of its data is clean; only the others are solved."""
    k = N - nsym
    words = words.astype(np.uint8, copy=False)
    out, total = words[:, :k].copy(), np.zeros(len(words), np.int64)
    dirty = np.flatnonzero((parity(out, nsym) != words[:, k:]).any(1))
    if len(dirty):
        fixed, total[dirty] = correct_all(words[dirty], syndromes(words[dirty], nsym))
        out[dirty] = fixed[:, :k]
    return out, total


def encode(b: bytes, level: str = "medium") -> bytes:
    return encode_all([b], level)[0]


def encode_all(values: list[bytes], level: str = "medium") -> list[bytes]:
    """encode() for many values, whose blocks are computed together."""
    nsym = LEVELS[level]
    k = N - nsym
    counts = [-(-len(b) // k) for b in values]
    if max(counts, default=0) > 65535:
        raise ValueError(f"{max(counts)} blocks; the format holds 65535")
    data = np.zeros((sum(counts), k), np.uint8)
    at = 0
    for b, n in zip(values, counts, strict=True):
        data[at : at + n].reshape(-1)[: len(b)] = np.frombuffer(b, np.uint8)
        at += n
    words, out, at = encode_blocks(data, nsym), [], 0
    for b, n in zip(values, counts, strict=True):
        out.append(MAGIC + struct.pack(">BBIH", 1, nsym, len(b), n) + np.ascontiguousarray(words[at : at + n].T).tobytes())
        at += n
    return out


def decode(b: bytes) -> tuple[bytes, int]:
    return decode_all([b])[0]


def decode_all(values: list[bytes]) -> list[tuple[bytes, int]]:
    """decode() for many values, whose blocks are checked and solved together. Missing bytes count as zero."""
    heads, words = [], []
    for b in values:
        if b[:4] != MAGIC:
            raise ValueError("no error-correction header")
        _, nsym, n, blocks = struct.unpack_from(">BBIH", b, 4)
        heads.append((nsym, n, blocks))
        words.append(np.frombuffer(b.ljust(12 + N * blocks, b"\0"), np.uint8, N * blocks, 12).reshape(N, blocks).T)
    out: list[tuple[bytes, int] | None] = [None] * len(values)
    for nsym in sorted({h[0] for h in heads}):
        some = [i for i, h in enumerate(heads) if h[0] == nsym]
        data, fixed = decode_blocks(np.concatenate([words[i] for i in some]), nsym)
        at = 0
        for i in some:
            part, n = slice(at, at + len(words[i])), heads[i][1]
            at += len(words[i])
            out[i] = (data[part].tobytes()[:n], int(fixed[part].sum()))
    return out
