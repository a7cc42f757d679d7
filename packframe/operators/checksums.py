"""CRC-32 and Adler-32 of parts, combined without the bytes."""

from __future__ import annotations

from functools import cache

POLY = 0xEDB88320  # fixed value
BASE = 65521  # fixed value


def _times(matrix: tuple[int, ...], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= matrix[i]
        v, i = v >> 1, i + 1
    return out


@cache
def _zeros(log: int) -> tuple[int, ...]:
    """What 2**log zero bytes do to a checksum's register, as a matrix over GF(2)."""
    if log:
        half = _zeros(log - 1)
        return tuple(_times(half, x) for x in half)
    one = (POLY, *(1 << i for i in range(31)))
    for _ in range(3):  # one bit, squared three times: a byte
        one = tuple(_times(one, x) for x in one)
    return one


def crc32_combine(a: int, b: int, size: int) -> int:
    """CRC-32 of two parts from theirs; size: bytes of the second."""
    log = 0
    while size:
        if size & 1:
            a = _times(_zeros(log), a)
        size, log = size >> 1, log + 1
    return a ^ b


def adler32_combine(a: int, b: int, size: int) -> int:
    low = (a & 0xFFFF) + (b & 0xFFFF) - 1
    high = (a >> 16) + (b >> 16) + size * ((a & 0xFFFF) - 1)
    return high % BASE << 16 | low % BASE


def combine_all(parts: list[tuple[int, int]]) -> int:
    out = 0
    for crc, size in parts:
        out = crc32_combine(out, crc, size)
    return out
