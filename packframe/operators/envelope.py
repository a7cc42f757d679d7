"""Encryption envelopes. Byte 0 names the kind: 0 plain, 1 AES-GCM, 2 repeating XOR, 3 AES-CTR with HMAC-SHA256.

AES itself is Spark's; keys come from PBKDF2 once for each distinct salt, on the driver side of a join, never in the text of a plan."""

from __future__ import annotations

import hashlib
import hmac
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packframe.functions.bytes import ROWS, binary_function, in_parts

ITERATIONS = 600_000  # fixed value of the format


class PassphraseRequired(ValueError):
    """The envelope is encrypted and no passphrase was given."""


class WrongPassphrase(ValueError):
    """The envelope's tag doesn't verify with this passphrase, or the envelope was changed."""


class MalformedEnvelope(ValueError):
    """No envelope, an unknown kind, or too short for its kind."""


PLAIN, GCM, XOR, CTR = 0, 1, 2, 3


def derive(passphrase: str, salt: bytes, iterations: int = ITERATIONS) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, iterations, 32)


def xor_bytes(b: bytes, key: bytes) -> bytes:
    if not key:
        raise ValueError("an empty passphrase cannot be used")
    x = np.frombuffer(b, np.uint8)
    return (x ^ np.resize(np.frombuffer(key, np.uint8), len(x))).tobytes()


def xor_encrypt(content, passphrase: str) -> Column:
    key = passphrase.encode()
    return binary_function(lambda b: bytes([XOR]) + xor_bytes(b, key))(content)


def xor_decrypt(envelope, passphrase: str) -> Column:
    key = passphrase.encode()
    return binary_function(lambda b: xor_bytes(b[1:], key))(envelope)


def _secrets(df: DataFrame, passphrase: str, salt: bytes, iterations: int, iv: int = 0, counters_for: str | None = None) -> DataFrame:
    """df with _key (which only a function's closure holds), a new random _iv of so many bytes, and the counter blocks _n for a column's bytes. One function makes
    them all: each function of a task is a Python worker of its own."""
    key = derive(passphrase, salt, iterations)

    def make(a: pa.Array) -> pa.Array:
        n = len(a)
        ivs = [os.urandom(iv) for _ in range(n)]
        parts = [pa.repeat(pa.scalar(key), n), pa.array(ivs, pa.binary())]
        if counters_for:
            sizes = a.to_pylist()
            parts.append(in_parts(n, lambda at: [None if size is None else _counters(v, size) for v, size in zip(ivs[at : at + ROWS], sizes[at : at + ROWS], strict=True)], pa.binary()))
        return pa.StructArray.from_arrays(parts, ["key", "iv", "n"][: len(parts)])

    kind = "struct<key:binary,iv:binary" + (",n:binary>" if counters_for else ">")
    about = F.octet_length(counters_for) if counters_for else F.lit(0)
    made = F.arrow_udf(make, kind).asNondeterministic()(about)
    x = df.withColumn("_made", made).withColumn("_key", F.col("_made.key"))
    x = x.withColumn("_iv", F.col("_made.iv")) if iv else x
    return (x.withColumn("_n", F.col("_made.n")) if counters_for else x).drop("_made")


def gcm_encrypt(df: DataFrame, content: str, out: str, passphrase: str, salt: bytes | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """Layout: 01, salt (16), iv (12), tag (16), ciphertext. One salt a call, one iv a row."""
    salt = salt or os.urandom(16)
    x = _secrets(df, passphrase, salt, iterations, 12)
    x = x.withColumn("_c", F.aes_encrypt(F.col(content), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), F.col("_iv")))
    tag, body = F.expr("substring(_c, octet_length(_c) - 15, 16)"), F.expr("substring(_c, 13, octet_length(_c) - 28)")
    return x.withColumn(out, F.concat(F.lit(bytes([GCM])), F.lit(salt), F.col("_iv"), tag, body)).drop("_key", "_iv", "_c")


def gcm_decrypt(df: DataFrame, envelope: str, out: str, passphrase: str, salt: bytes, iterations: int = ITERATIONS) -> DataFrame:
    """Null where the tag doesn't verify."""
    x = _secrets(df, passphrase, salt, iterations)
    e = envelope
    joined = F.expr(f"concat(substring({e}, 18, 12), substring({e}, 46), substring({e}, 30, 16))")
    return x.withColumn(out, F.try_aes_decrypt(joined, F.col("_key"), F.lit("GCM"))).drop("_key")


def _counters(iv: bytes, n: int) -> bytes:
    """The 16-byte counter blocks for n bytes: the low 64 bits count, big-endian."""
    start = int.from_bytes(iv[8:], "big")
    low = (np.arange(-(-n // 16), dtype=np.uint64) + np.uint64(start)).astype(">u8")
    out = np.zeros((len(low), 16), np.uint8)
    out[:, :8] = np.frombuffer(iv[:8], np.uint8)
    out[:, 8:] = low.view(np.uint8).reshape(-1, 8)
    return out.tobytes()


def _mask(a: bytes, stream: bytes) -> bytes:
    return (np.frombuffer(a, np.uint8) ^ np.frombuffer(stream, np.uint8, len(a))).tobytes()


def _stream() -> Column:
    return F.aes_encrypt(F.col("_n"), F.col("_key"), F.lit("ECB"), F.lit("PKCS"))


def ctr_encrypt(df: DataFrame, content: str, out: str, passphrase: str, salt: bytes | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """Layout: 03, salt (16), iv (16), ciphertext, HMAC over all before (32). The MAC's key is derived from the salt and 00 4D 41 43."""
    salt = salt or os.urandom(16)
    mac_key = derive(passphrase, salt + b"\0MAC", iterations)

    def seal(b: bytes, iv_stream: bytes) -> bytes:
        body = bytes([CTR]) + salt + iv_stream[:16] + _mask(b, iv_stream[16:])
        return body + hmac.digest(mac_key, body, "sha256")

    x = _secrets(df, passphrase, salt, iterations, 16, content).withColumn("_s", F.concat(F.col("_iv"), _stream()))
    return x.withColumn(out, binary_function(seal)(F.col(content), F.col("_s"))).drop("_key", "_iv", "_n", "_s")


def ctr_decrypt(df: DataFrame, envelope: str, out: str, passphrase: str, salt: bytes, iterations: int = ITERATIONS) -> DataFrame:
    """The MAC is always verified; null where it fails."""
    key, mac_key = derive(passphrase, salt, iterations), derive(passphrase, salt + b"\0MAC", iterations)

    def check(b: bytes) -> dict | None:
        if len(b) < 65 or not hmac.compare_digest(hmac.digest(mac_key, b[:-32], "sha256"), b[-32:]):
            return None
        return {"key": key, "n": _counters(b[17:33], len(b) - 65)}

    x = df.withColumn("_o", binary_function(check, "struct<key:binary,n:binary>")(F.col(envelope)))
    x = x.withColumn("_key", F.col("_o.key")).withColumn("_n", F.col("_o.n")).withColumn("_s", _stream())
    return x.withColumn(out, binary_function(lambda b, s: _mask(b[33:-32], s))(F.col(envelope), F.col("_s"))).drop("_o", "_key", "_n", "_s")


LEAST = {PLAIN: 1, GCM: 45, XOR: 1, CTR: 65}  # bytes of the shortest envelope of each kind
#: What can be wrong with an envelope, as the column of decrypt() says it.
REASONS = {"passphrase required": PassphraseRequired, "wrong passphrase or changed": WrongPassphrase, "malformed": MalformedEnvelope}


def plain(content) -> Column:
    return F.concat(F.lit(bytes([PLAIN])), F.col(content) if isinstance(content, str) else content)


def kind_of(envelope) -> Column:
    """The envelope's kind; null for an empty value."""
    return F.conv(F.hex(F.substring(envelope, 1, 1)), 16, 10).cast("int")


def decrypt(df: DataFrame, envelope: str, out: str, reason: str, passphrase: str | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """Any envelope's content by its kind, and null with a reason (a key of REASONS) where there is none. Keys are derived once for each salt that occurs in a
    batch; authentic kinds are always verified."""

    def open_all(values: pd.Series) -> pd.DataFrame:
        keys: dict[tuple, bytes] = {}

        def key(salt: bytes) -> bytes:
            if salt not in keys:
                keys[salt] = derive(passphrase, salt, iterations)
            return keys[salt]

        rows = []
        for b in values:
            kind = b[0] if b else None
            if kind not in LEAST or len(b) < LEAST[kind]:
                rows.append((None, None, "malformed"))
            elif kind == PLAIN:
                rows.append((b[1:], None, None))
            elif not passphrase:
                rows.append((None, None, "passphrase required"))
            elif kind == XOR:
                rows.append((xor_bytes(b[1:], passphrase.encode()), None, None))
            elif kind == GCM:
                rows.append((b[17:29] + b[45:] + b[29:45], key(b[1:17]), None))
            elif not hmac.compare_digest(hmac.digest(key(b[1:17] + b"\0MAC"), b[:-32], "sha256"), b[-32:]):
                rows.append((None, None, "wrong passphrase or changed"))
            else:
                rows.append((_counters(b[17:33], len(b) - 65), key(b[1:17]), None))
        return pd.DataFrame(rows, columns=["body", "key", "reason"])

    opened = F.pandas_udf(open_all, "body binary, key binary, reason string")
    x = df.withColumn("_o", opened(F.col(envelope))).withColumn("_k", kind_of(F.col(envelope)))
    x = x.withColumn("_g", F.when(F.col("_k") == GCM, F.try_aes_decrypt(F.col("_o.body"), F.col("_o.key"), F.lit("GCM"))))
    x = x.withColumn("_s", F.when((F.col("_k") == CTR) & F.col("_o.key").isNotNull(), F.aes_encrypt(F.col("_o.body"), F.col("_o.key"), F.lit("ECB"), F.lit("PKCS"))))
    masked = binary_function(lambda b, stream: _mask(b[33:-32], stream))(F.col(envelope), F.col("_s"))
    content = F.when(F.col("_k") == GCM, F.col("_g")).when(F.col("_k") == CTR, masked).otherwise(F.col("_o.body"))
    failed = (F.col("_k") == GCM) & F.col("_o.key").isNotNull() & F.col("_g").isNull()
    return x.withColumn(out, content).withColumn(reason, F.coalesce("_o.reason", F.when(failed, "wrong passphrase or changed"))).drop("_o", "_k", "_g", "_s")


def checked(content: Column, reason: Column) -> Column:
    """content, or an error of the reason's name when a row without content is read."""
    return F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("envelope: "), reason))).otherwise(content)
