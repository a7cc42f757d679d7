"""Tones: windows, single-bin power, bytes as chords of eight carriers, preambles, WAV files."""

from __future__ import annotations

import struct

import numpy as np

from packframe.operators import ecc

# Fixed values of the format.
RATE = 44100
CARRIERS = (600, 900, 1200, 1500, 1800, 2100, 2400, 2700)
SYMBOL, GUARD = 2048, 512
AMPLITUDE, SYNC_AMPLITUDE = 0.35, 0.3
SYNC, SYNC_TONE = (3200, 2400, 1600, 800), 1024
THRESHOLD = 0.0005
TAIL = 8820
SEARCH_STEP, SEARCH_SECONDS = 256, 2
HEADER = 44


def hann(n: int) -> np.ndarray:
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1)))


def _tones(frequencies, n: int, amplitude: float) -> np.ndarray:
    t = np.arange(n)
    return np.stack([amplitude * hann(n) * np.sin(2 * np.pi * f / RATE * t) for f in frequencies])


CHORD = _tones(CARRIERS, SYMBOL, AMPLITUDE)
PREAMBLE = _tones(SYNC, SYNC_TONE, SYNC_AMPLITUDE).ravel()


def bins(frequencies, n: int) -> np.ndarray:
    """The nearest whole number of periods in n samples."""
    return np.floor(np.array(frequencies) * n / RATE + 0.5).astype(np.int64)


def power(samples: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Power at bins k of each row of samples: the squared sums against cosine and sine over the squared length. That is what Goertzel's recurrence computes."""
    n = samples.shape[-1]
    turn = 2 * np.pi * np.asarray(k)[None, :] * np.arange(n)[:, None] / n
    return ((samples @ np.cos(turn)) ** 2 + (samples @ np.sin(turn)) ** 2) / (n * n)


def modulate(data: bytes) -> np.ndarray:
    """A chord for each byte (bit k: carrier k), then silence."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
    out = np.zeros((len(data), SYMBOL + GUARD))
    out[:, :SYMBOL] = bits @ CHORD
    return out.ravel()


def demodulate(samples: np.ndarray, n: int) -> bytes:
    rows = np.zeros((n, SYMBOL + GUARD))
    have = min(len(samples), rows.size)
    rows.ravel()[:have] = samples[:have]
    on = power(rows[:, :SYMBOL], bins(CARRIERS, SYMBOL)) > THRESHOLD
    return np.packbits(on, axis=1, bitorder="little").tobytes()


def find_preamble(samples: np.ndarray) -> int:
    """Where the data begins: past the first place, in steps, at which the four tones are heard one after the other; -1 without one."""
    size = len(SYNC) * SYNC_TONE
    for at in range(0, min(len(samples) - size, RATE * SEARCH_SECONDS), SEARCH_STEP):
        rows = samples[at : at + size].reshape(len(SYNC), SYNC_TONE)
        if (np.diag(power(rows, bins(SYNC, SYNC_TONE))) >= THRESHOLD * 0.5).all():
            return at + size
    return -1


def wav(samples: np.ndarray) -> bytes:
    """16-bit mono."""
    pcm = np.floor(np.clip(samples, -1, 1) * 32767 + 0.5).astype("<i2").tobytes()
    head = b"RIFF" + struct.pack("<I", HEADER - 8 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE * 2, 2, 16)
    return head + b"data" + struct.pack("<I", len(pcm)) + pcm


def read_wav(b: bytes) -> np.ndarray:
    """Samples of an 8- or 16-bit mono file; chunks but the format and the data are stepped over."""
    if len(b) < HEADER or b[:4] != b"RIFF" or b[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, depth = 12, 16
    while at + 8 <= len(b):
        kind, (size,) = b[at : at + 4], struct.unpack_from("<I", b, at + 4)
        if kind == b"fmt ":
            (depth,) = struct.unpack_from("<H", b, at + 22)
        elif kind == b"data":
            body = b[at + 8 : at + 8 + size]
            if depth == 8:
                return (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
            return np.frombuffer(body[: len(body) // 2 * 2], "<i2") / 32768
        at += 8 + size + size % 2
    raise ValueError("no data in the WAVE file")


def encode_audio(data: bytes, level: str = "medium") -> bytes:
    """Preamble, length and error-corrected data as chords, silence."""
    coded = ecc.encode(data, level)
    return wav(np.concatenate([PREAMBLE, modulate(struct.pack(">I", len(coded)) + coded), np.zeros(TAIL)]))


def decode_audio(b: bytes) -> tuple[bytes, int]:
    samples = read_wav(b)
    at = find_preamble(samples)
    if at < 0:
        raise ValueError("no preamble")
    (n,) = struct.unpack(">I", demodulate(samples[at:], 4))
    if n > (len(samples) - at) // (SYMBOL + GUARD):
        raise ValueError("the audio ends early")
    return ecc.decode(demodulate(samples[at + 4 * (SYMBOL + GUARD) :], n))


def is_audio(b: bytes) -> bool:
    try:
        return find_preamble(read_wav(b)) >= 0
    except (ValueError, struct.error):
        return False
