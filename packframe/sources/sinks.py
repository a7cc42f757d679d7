"""Files and archives from DataFrames. Executors write through Spark's file system layer or, for paths of the shared folder, as local files that all of them see."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packframe.operators import archive, codecs, png


def _local(root: str) -> str:
    if "://" in root and not root.startswith("file:"):
        raise ValueError(f"{root}: only folders that executors mount can be written as files")
    return "/" + root.removeprefix("file:").lstrip("/")


def safe_path(name: str) -> str:
    """Without roots, parents and characters that file systems refuse."""
    parts = (p.replace("\0", "").translate(str.maketrans(':*?"<>|', "_______")) for p in name.replace("\\", "/").split("/"))
    return "/".join(p for p in parts if p not in ("", ".", ".."))


def _put(path: str, content: bytes, made: set[str]) -> None:
    """A whole file or none: it is written beside its place and renamed, so a task that runs twice leaves one."""
    folder = os.path.dirname(path)
    if folder not in made:
        os.makedirs(folder, exist_ok=True)
        made.add(folder)
    beside = f"{path}.{uuid.uuid4().hex}.part"
    with open(beside, "wb") as f:
        f.write(content)
    os.replace(beside, path)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """files (path, content) as files under root; (path, size) of what was written. Runs when the result is read; running again writes the same files."""
    base = _local(root)

    def run(batches: Iterator[pa.RecordBatch]):
        made: set[str] = set()
        for batch in batches:
            names, sizes = [], []
            for name, value in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                safe, content = safe_path(name or "") or "file", value.as_py()
                _put(f"{base}/{safe}", content or b"", made)
                names.append(safe)
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    return files.select("path", "content").mapInArrow(run, "path string, size long")


MAKERS = {"pack": archive.pack, "indexed": archive.indexed, "table": archive.offset_table, "tar": archive.tar}
FORMATS = (*MAKERS, "png")


EACH = 16 << 20


def archives_for(files: DataFrame, least: int = 1) -> int:
    """How many archives to deal files (size) to, so that one holds EACH bytes or so whatever there is; least at least."""
    return max(least, -(-(files.agg(F.sum("size")).first()[0] or 0) // EACH))


def _group_name(archives: int):
    return F.pmod(F.xxhash64("path"), F.lit(archives)).cast("int")


def archives_of(files: DataFrame, archives: int, kind: str = "pack", level: int = 3) -> DataFrame:
    """(archive, entries, content): files dealt by their paths' hash to a number of archives, each in order of extension and path. Choose the
    number so that an archive fits a task; no archive gathers a source or a directory. png: the packed, compressed archive as an image with its list."""
    if kind not in FORMATS:
        raise ValueError(f"{kind}: {', '.join(FORMATS)} are known")

    def one(key, rows):
        entries = list(zip(rows["path"].to_pylist(), (c or b"" for c in rows["content"].to_pylist()), strict=True))
        entries.sort(key=lambda e: (e[0].rpartition(".")[2] if "." in e[0] else "", e[0]))
        if kind == "png":
            listed = "[" + ",".join(f'{{"name":{_json(n)},"size":{len(c)}}}' for n, c in entries) + "]"
            body = png.encode_payload(b"\0" + codecs.zstd(b"ROX1" + archive.pack(entries), level), f"archive-{key[0].as_py()}", listed)
        else:
            body = MAKERS[kind](entries)
        return pa.table({"archive": pa.array([key[0].as_py()], pa.int32()), "entries": pa.array([len(entries)], pa.int64()), "content": pa.array([body], pa.binary())})

    x = files.select(_group_name(archives).alias("archive"), "path", "content")
    return x.groupBy("archive").applyInArrow(one, "archive int, entries long, content binary")


def _json(text: str) -> str:
    import json

    return json.dumps(text)


def normalise(payload: bytes) -> bytes:
    """What a payload holds: the plain envelope is taken off, a zstd frame is opened, the archive prefix is taken off."""
    if payload[:1] == b"\0":
        payload = payload[1:]
    elif payload[:1] in (b"\1", b"\2", b"\3"):
        raise ValueError("the payload is encrypted")
    if payload[:4] == b"\x28\xb5\x2f\xfd":
        payload = codecs.unzstd(payload)
    return payload[4:] if payload[:4] == b"ROX1" else payload


def entries_of(name: str, b: bytes, names: frozenset | None = None) -> Iterator[tuple[str, bytes]]:
    """The files in any archive: image, tar, compressed or plain layouts; what is no archive is one file of its own name. With names, only those,
    and reading stops after the last."""
    if b[:8] == png.SIGNATURE:
        _, inner, payload, _ = png.find_payload(b)
        name, b = inner or name, normalise(payload)
    elif b[:4] == b"\x28\xb5\x2f\xfd":
        b = normalise(b)
    if b[:4] == b"ROX1":
        b = b[4:]
    if b[:4] in (archive.PACK, archive.INDEXED, archive.TABLE):
        yield from archive.unpack_stream([b], names)
    elif b[257:262] == b"ustar":
        yield from ((archive.clean_tar_path(n), c) for n, c in archive.untar(b) if names is None or archive.clean_tar_path(n) in names)
    elif names is None or safe_path(name) in names or name in names:
        yield safe_path(name) or "file", b


def bounded(entries: Iterator[tuple[str, bytes]], size: int = 4 << 20) -> Iterator[list[tuple[str, bytes]]]:
    """The entries in lists that are closed when they hold size bytes or 10,000 entries."""
    out, held = [], 0
    for e in entries:
        out.append(e)
        held += len(e[1])
        if held >= size or len(out) == 10_000:
            yield out
            out, held = [], 0
    if out:
        yield out


def files_in(archives: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(path, size, content) of the files in archives (path, content)."""
    wanted = None if names is None else frozenset(names)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, b in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for out in bounded(entries_of(name or "", b.as_py() or b"", wanted)):
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([len(c) for _, c in out], pa.int64()), pa.array([c for _, c in out], pa.binary())], ["path", "size", "content"])

    return archives.select("path", "content").mapInArrow(run, "path string, size long, content binary")


SUFFIX = {"pack": "pack", "indexed": "roxi", "table": "roxv", "tar": "tar", "png": "png"}


def write_archives(files: DataFrame, root: str, archives: int, kind: str = "pack") -> DataFrame:
    """Archives as files under root; (path, size) of each."""
    made = archives_of(files, archives, kind)
    return write_files(made.select(F.concat(F.lit("archive-"), F.col("archive").cast("string"), F.lit("." + SUFFIX[kind])).alias("path"), "content"), root)


def read_archives(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    from packframe.sources.files import files_from_dir

    return files_in(files_from_dir(spark, root), names)
