"""Byte-level functions over binary columns: Arrow batches into numpy, one pass over the bytes."""

from __future__ import annotations

import hashlib
import inspect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


#: Rows of a batch that are Python objects at one time: a batch may have 10,000 of them.
ROWS = 64
#: Values that a function of many gets at one time: their number, and their number times the longest one's bytes.
MOST, AREA = 512, 8 << 20


def in_parts(n: int, part: Callable, to: pa.DataType) -> pa.Array:
    return pa.concat_arrays([pa.array(part(at), to) for at in range(0, n, ROWS)] or [pa.array([], to)])


def arrow_function(f: Callable, kind: str):
    """A function of one or two values as an Arrow function; null in, null out."""
    to = to_arrow_type(DataType.fromDDL(kind))

    def one(a: pa.Array) -> pa.Array:
        return in_parts(len(a), lambda at: [None if x is None else _plain(f(x)) for x in a.slice(at, ROWS).to_pylist()], to)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return in_parts(len(a), lambda at: [None if x is None or y is None else _plain(f(x, y)) for x, y in zip(a.slice(at, ROWS).to_pylist(), b.slice(at, ROWS).to_pylist(), strict=True)], to)

    needed = [p for p in inspect.signature(f).parameters.values() if p.default is p.empty]
    return F.arrow_udf(two if len(needed) == 2 else one, kind)


def _plain(x):
    """Arrays as lists, tuples in lists as structs stay."""
    return x.tolist() if isinstance(x, np.ndarray) else x


def binary_function(f: Callable, kind: str = "binary") -> Callable[..., Column]:
    """A function of one or two values as a column function, over Arrow batches; null in, null out."""
    return lambda *cols: arrow_function(f, kind)(*cols)


def md5_function(f: Callable) -> Callable[..., Column]:
    """The MD5 of f's bytes: they don't leave the function, which holds those of one value."""
    return binary_function(lambda b: hashlib.md5(f(b)).hexdigest(), "string")


def groups(sizes: np.ndarray, most: int = MOST, area: int = AREA) -> Iterator[np.ndarray]:
    """Places of all values in groups of similar size, the longest first; a group is one value at least, and within most and area."""
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(most, area // max(int(sizes[order[at]]), 1)))
        yield order[at : at + n]
        at += n


def many_function(f: Callable[[list[bytes]], list], kind: str = "binary") -> Callable[[Column], Column]:
    """A function of many values (a list in, a list of results out) as a column function; it gets groups of values of similar size. Null in, null out."""
    to = to_arrow_type(DataType.fromDDL(kind))

    def run(a: pa.Array) -> pa.Array:
        out: list = [None] * len(a)
        some = np.flatnonzero(np.asarray(a.is_valid()))
        for group in groups(np.asarray(pc.binary_length(a).take(pa.array(some))).astype(np.int64)):
            where = some[group]
            for i, x in zip(where.tolist(), f(a.take(pa.array(where)).to_pylist()), strict=True):
                out[i] = x
        return pa.array(out, to)

    return lambda col: F.arrow_udf(run, kind)(col)


def md5_of_many(f: Callable[[list[bytes]], list[bytes]]) -> Callable[[Column], Column]:
    """As md5_function, for a function of many values."""
    return many_function(lambda values: [hashlib.md5(b).hexdigest() for b in f(values)], "string")


def exploded(df: DataFrame, content: str, f: Callable[[bytes], tuple[np.ndarray, np.ndarray]], columns: str, rows: int = 1 << 17) -> DataFrame:
    """(id, columns): f makes two arrays of one length of a value, and each of their places is a row. They stay arrays, and no more than rows of them leave at once."""
    schema = DataType.fromDDL(f"id long, {columns}")
    kinds = [to_arrow_type(field.dataType) for field in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column("id"), batch.column("content"), strict=True):
                if (b := value.as_py()) is None:
                    continue
                made = f(b)
                for at in range(0, len(made[0]), rows):
                    one, two = (pa.array(x[at : at + rows]).cast(kind) for x, kind in zip(made, kinds[1:], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, len(one)), one, two], names=schema.fieldNames())

    return df.select("id", F.col(content).alias("content")).mapInArrow(run, schema)


def counts_of(column: pa.Array) -> np.ndarray:
    """(values, 256) counts of the byte values of a binary column, from its flat buffer."""
    arr = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return np.stack([np.bincount(raw[lo:hi], minlength=256) for lo, hi in zip(off[:-1], off[1:], strict=True)]) if len(arr) else np.zeros((0, 256), np.int64)


def entropies(counts: np.ndarray, empty: float = 0.0) -> np.ndarray:
    """Shannon entropy in bits a byte of each row of counts."""
    n = counts.sum(1)
    share = counts / np.maximum(n, 1)[:, None]
    return np.where(n > 0, -(share * np.log2(np.where(counts > 0, share, 1.0))).sum(1), empty)


def histogram(content) -> Column:
    """Counts of the 256 byte values."""

    @F.arrow_udf("array<bigint>")
    def count(column: pa.Array) -> pa.Array:
        counts = counts_of(column).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * 256), pa.array(counts.ravel()), mask=column.is_null() if column.null_count else None)

    return count(content)


def entropy_of(content, sample: int = 0, empty: float = 0.0) -> Column:
    """Entropy of a binary column; sample: of its first bytes only. One number a value leaves the function."""

    @F.arrow_udf("double")
    def measure(column: pa.Array) -> pa.Array:
        if sample:
            column = pc.binary_slice(column, 0, sample)
        return pa.array(entropies(counts_of(column), empty), mask=np.asarray(column.is_null()))

    return measure(content)


def entropy_pair(content, sample: int, empty: float) -> Column:
    """struct(whole, sample): both entropies in one pass over a batch."""

    @F.arrow_udf("struct<whole:double,sample:double>")
    def measure(column: pa.Array) -> pa.Array:
        whole, head = entropies(counts_of(column)), entropies(counts_of(pc.binary_slice(column, 0, sample)), empty)
        return pa.StructArray.from_arrays([pa.array(whole), pa.array(head)], ["whole", "sample"])

    return measure(content)


def adler32(content) -> Column:
    return binary_function(lambda b: zlib.adler32(b), "bigint")(content)
