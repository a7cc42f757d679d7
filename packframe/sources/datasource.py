"""Archives and PNG files as Spark data sources, batch reads with one partition a file (or a run of entries):

    register(spark)
    spark.read.format("packarchive").option("path", ...).load()   # path, size, content
    spark.read.format("pngchunks").option("path", ...).option("types", "IHDR,rXFL").load()   # file, seq, type, offset, length, data
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class FilePartition(InputPartition):
    def __init__(self, path: str, lo: int = 0, hi: int = -1):
        super().__init__(path)
        self.path, self.lo, self.hi = path, lo, hi


def _files(root: str) -> list[str]:
    root = "/" + root.removeprefix("file:").lstrip("/")
    if os.path.isfile(root):
        return [root]
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if not f.startswith((".", "_")) and not os.path.islink(os.path.join(d, f)))


def _pieces(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while piece := f.read(size):
            yield piece


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.names = [n for n in options.get("names", "").split(",") if n] or None

    def partitions(self):
        return [FilePartition(p) for p in _files(self.root)]

    def read(self, partition):
        from packframe.operators import archive, png
        from packframe.sources.sinks import entries_of

        with open(partition.path, "rb") as f:
            head = f.read(8)
        if head[:4] in (archive.PACK, archive.INDEXED, archive.TABLE, b"ROX1"):
            entries = archive.unpack_stream(_pieces(partition.path), self.names)
        else:
            with open(partition.path, "rb") as f:
                entries = entries_of(os.path.basename(partition.path), f.read(), frozenset(self.names) if self.names else None)
        del png
        for name, content in entries:
            yield name, len(content), content


class ArchiveSource(DataSource):
    @classmethod
    def name(cls):
        return "packarchive"

    def schema(self):
        return "path string, size long, content binary"

    def reader(self, schema):
        return ArchiveReader(self.options)


class ChunkReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.types = {t for t in options.get("types", "").split(",") if t}
        self.data = options.get("data", "meta")  # meta: no image data, all: every chunk's, none

    def partitions(self):
        return [FilePartition(p) for p in _files(self.root) if p.lower().endswith(".png")]

    def read(self, partition):
        from packframe.operators import png

        skip = {"meta": frozenset({"IDAT"}), "all": frozenset()}.get(self.data)
        with open(partition.path, "rb") as f:
            for seq, (kind, at, n, data) in enumerate(png.scan_chunks(f, skip if skip is not None else _Everything())):
                if not self.types or kind in self.types:
                    yield os.path.basename(partition.path), seq, kind, at, n, data


class _Everything:
    def __contains__(self, _):
        return True


class ChunkSource(DataSource):
    @classmethod
    def name(cls):
        return "pngchunks"

    def schema(self):
        return "file string, seq int, type string, offset long, length long, data binary"

    def reader(self, schema):
        return ChunkReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(ChunkSource)
