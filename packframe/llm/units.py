"""Units: groups of whole documents that several passes see alike, and the exchange of keys between them.

``unit_table`` deals documents to units by a hash of doc_id (of the text, without one); a unit holds about ``mb`` MB of text. The documents that a task has for a unit travel
as one compressed message, so the shuffle of the text is about half its size. Operators that must relate every position or token
of the corpus work in rounds: a unit sends, to each bucket of a key space, one packed message with its distinct keys (so whatever repeats
inside a unit is aggregated before the shuffle); a bucket merges the messages of all units and answers each with a message aligned with what it
sent; and the unit, recomputed from the same rows, reads the answers. All passes name the same exchange of the text, which Spark runs once
(reused exchange). Nothing is gathered by document or by key alone: a message is bounded by the unit and a bucket is dealt by hashed keys, so a key that occurs
in every document arrives once from each unit. With u units and b buckets there are u * b messages: the size of a unit grows with the root of the input, up to ``most`` MB,
to keep them few and large.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packframe.llm.common import input_bytes, parts

C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


def unit_table(docs: DataFrame, mb: float = 6.0, most: float = 24.0, train=None) -> tuple[DataFrame, int]:
    """(unit, docs): packed documents (ids, hashes of the texts, training flags, lengths, UTF-8 bytes; nothing for null). And the number of units."""
    size = input_bytes(docs) / 1e6
    n = parts(docs, min(most, max(mb, mb * (size / 500) ** 0.5)))
    unit = F.pmod(F.coalesce(F.when(F.col("doc_id").isNull(), F.xxhash64("text")), F.xxhash64("doc_id")), F.lit(n)).cast("int")
    slim = docs.select(unit.alias("unit"), "doc_id", F.xxhash64("text").alias("tie"), (F.lit(True) if train is None else train).alias("train"), "text")
    return slim.mapInArrow(_packed_documents, "unit int, docs binary"), n


def _packed_documents(batches, hold: int = 48 << 20):
    """The documents of about hold bytes at a time, a message for each unit."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        rows = rows.take(pc.sort_indices(rows["unit"])).combine_chunks()
        unit = rows["unit"].to_numpy()
        none = rows["doc_id"].is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        ids, tie, train = rows["doc_id"].fill_null(0).to_numpy(), rows["tie"].to_numpy(), rows["train"].to_numpy(zero_copy_only=False).astype(np.uint8)
        data, offsets = texts_of(rows["text"])
        edge = np.concatenate([np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])), [len(unit)]]) if len(unit) else np.zeros(1, np.int64)
        out = [pack(none[a:b], ids[a:b], tie[a:b], train[a:b], np.diff(offsets[a : b + 1]), data[offsets[a] : offsets[b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(unit[edge[:-1]], pa.int32()), pa.array(out, pa.binary())], ["unit", "docs"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= hold:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


class Unit:
    """A unit's documents in a fixed order: ids (null: the largest long), whether there is none, training flags, bytes end to end, and offsets."""

    def __init__(self, rows: pa.Table):
        parts_ = [unpack(m) for m in rows["docs"].to_pylist()]
        none, ids, tie, train, size = (np.concatenate([p[i] for p in parts_]) for i in range(5))
        ids = np.where(none == 1, np.iinfo(np.int64).max, ids)
        order = np.lexsort((tie, ids))
        self.none, self.ids, self.train = none[order].astype(bool), ids[order], train[order].astype(bool)
        self.offsets = np.concatenate([[0], np.cumsum(size[order])])
        every, start = np.concatenate([p[5] for p in parts_]), np.cumsum(size) - size
        self.data = np.concatenate([every[start[i] : start[i] + size[i]] for i in order]) if len(order) else every

    def __len__(self) -> int:
        return len(self.ids)

    def doc_ids(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.none)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(struct.pack("<8sq", a.dtype.str.encode().ljust(8), a.size) + a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(message: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(message)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<8sq", raw, at)
        dtype = np.dtype(kind.decode().strip())
        out.append(np.frombuffer(raw, dtype, size, at + 16))
        at += 16 + size * dtype.itemsize
    return out


def planes(x: np.ndarray) -> np.ndarray:
    """Non-negative integers as their bytes, lowest first, all first bytes before all second ones and so on, as many as the greatest needs: high bytes that are
    alike pack well."""
    x = np.ascontiguousarray(x).astype(np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return np.concatenate([np.array([width], np.uint8), np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).ravel()])


def unplanes(raw: np.ndarray) -> np.ndarray:
    width = int(raw[0])
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = raw[1:].reshape(width, -1).T
    return out.view(np.uint64).ravel()


def bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Buckets of keys below 2**bits, ascending with the key."""
    top = keys >> np.uint64(max(0, bits - 32))
    return ((top * np.uint64(buckets)) >> np.uint64(min(bits, 32))).astype(np.int64)


def slices(sorted_buckets: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, lo, hi) of each bucket that occurs."""
    edges = np.searchsorted(sorted_buckets, np.arange(buckets + 1))
    return [(b, int(lo), int(hi)) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]


MESSAGE = "bucket int, unit int, kind int, message binary"
MESSAGE_ARROW = pa.schema([("bucket", pa.int32()), ("unit", pa.int32()), ("kind", pa.int32()), ("message", pa.binary())])


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(cols, MESSAGE_ARROW.types, strict=True)], schema=MESSAGE_ARROW)


def answer(sent: DataFrame, reply) -> DataFrame:
    """One task group for each bucket: reply(list of (unit, kind, arrays)) yields (unit, kind, message bytes)."""

    def run(key, rows):
        got = sorted(zip(rows["unit"].to_pylist(), rows["kind"].to_pylist(), rows["message"].to_pylist(), strict=True), key=lambda r: r[:2])
        bucket = key[0].as_py()
        return messages([(bucket, u, k, m) for u, k, m in reply([(u, k, m) for u, k, m in got])])

    return sent.groupBy("bucket").applyInArrow(run, MESSAGE)


# ---- words

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""
    if len(_tables.get("pow", ())) < n:
        size = max(1 << 20, 1 << int(n).bit_length())
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            _tables[name] = out
    return _tables["pow"], _tables["inv"]


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True, segment: int = 1 << 20):
    """Yield (first document, past the last one, word hashes, each word's document) for runs of whole documents of about segment bytes.

    Words are maximal runs of bytes other than the six ASCII spaces (UTF-8 has those bytes for nothing else); fold lowers A-Z. A word's hash is that of its
    bytes and length: a polynomial modulo 2**64, mixed."""
    d, n = 0, len(offsets) - 1
    while d < n:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + segment, "right")) - 1)
        lo, hi = int(offsets[d]), int(offsets[e])
        raw = data[lo:hi]
        raw = _FOLD[raw] if fold else raw
        inner = ~_SPACE[raw]
        # documents end words too
        cuts = offsets[d : e + 1] - lo
        begin = inner.copy()
        begin[1:] &= ~inner[:-1]
        starts = cuts[:-1][cuts[:-1] < hi - lo]
        begin[starts] = inner[starts]
        last = inner.copy()
        last[:-1] &= ~inner[1:]
        ends = cuts[1:][cuts[1:] > 0] - 1
        last[ends] = inner[ends]
        b, z = np.flatnonzero(begin), np.flatnonzero(last) + 1
        power, inverse = _power_tables(hi - lo + 1)
        p = np.zeros(hi - lo + 1, np.uint64)
        each = raw.astype(np.uint64)
        each += np.uint64(1)
        each *= power[: hi - lo]
        np.cumsum(each, out=p[1:])
        h = mix((p[z] - p[b]) * inverse[b] + (z - b).astype(np.uint64))
        yield d, e, h, d + np.repeat(np.arange(e - d), np.diff(np.searchsorted(b, cuts)))
        d = e


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes end to end, and offsets, of an Arrow string or binary column; nulls are empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pa.concat_arrays(arr.chunks) if isinstance(arr, pa.ChunkedArray) and arr.num_chunks else arr
    if isinstance(arr, pa.ChunkedArray) or not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    else:
        arr = arr.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]
