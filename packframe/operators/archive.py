"""Archive layouts of one collection: record stream, indexed stream, offset table with alignment, tar."""

from __future__ import annotations

import io
import json
import struct
import tarfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO

PACK, INDEXED, TABLE = b"ROXP", b"ROXI", b"ROXV"  # fixed values of the formats
ALIGN = 4096


def pack(entries: list[tuple[str, bytes]]) -> bytes:
    out = [PACK, struct.pack(">I", len(entries))]
    for name, content in entries:
        raw = name.encode()
        out += [struct.pack(">H", len(raw)), raw, struct.pack(">Q", len(content)), content]
    return b"".join(out)


def _need(b: bytes, at: int, n: int) -> bytes:
    if at + n > len(b):
        raise ValueError(f"archive ends at {len(b)}; {at + n} bytes are needed")
    return b[at : at + n]


def _entries(b: bytes, at: int, count: int | None, names: frozenset | None = None):
    done = 0
    while at < len(b) if count is None else done < count:
        (n,) = struct.unpack(">H", _need(b, at, 2))
        name = _need(b, at + 2, n).decode("utf-8", "replace")
        (size,) = struct.unpack(">Q", _need(b, at + 2 + n, 8))
        at += 10 + n
        if names is None or name in names:
            yield name, _need(b, at, size)
        at += size
        done += 1


def unpack(b: bytes, names: frozenset | None = None) -> list[tuple[str, bytes]]:
    """Entries of any of the three layouts; names: only those. Others' bytes are skipped, not copied."""
    if b[:4] == PACK:
        return list(_entries(b, 8, struct.unpack_from(">I", b, 4)[0], names))
    if b[:4] == INDEXED:
        (n,) = struct.unpack_from(">I", b, 4)
        start, out = 8 + n, []
        for e in json.loads(b[8:start]):
            if names is None or e["path"] in names:
                out += _entries(b, start + e["offset"], 1)
        return out
    if b[:4] == TABLE:
        return [(name, _need(b, at, size)) for name, at, size in table_entries(b) if names is None or name in names]
    raise ValueError("unknown archive")


def indexed(entries: list[tuple[str, bytes]], block: int = 8 << 20) -> bytes:
    """Entries with an index of path, blockId, offset and size; a block is closed when the next entry would take it beyond its size."""
    index, body, at, held, number = [], [], 0, 0, 0
    for name, content in entries:
        raw = name.encode()
        record = struct.pack(">H", len(raw)) + raw + struct.pack(">Q", len(content)) + content
        if held and held + len(record) > block:
            number, held = number + 1, 0
        index.append({"path": name, "blockId": number, "offset": at, "size": len(content)})
        body.append(record)
        at, held = at + len(record), held + len(record)
    head = json.dumps(index).encode()
    return INDEXED + struct.pack(">I", len(head)) + head + b"".join(body)


def offset_table(entries: list[tuple[str, bytes]]) -> bytes:
    head, body, at = [TABLE, struct.pack("<II", 1, len(entries))], [], 0
    for name, content in entries:
        raw = name.encode()
        head += [struct.pack("<H", len(raw)), raw, struct.pack("<QQQ", at, len(content), len(content))]
        room = -(-len(content) // ALIGN) * ALIGN
        body.append(content.ljust(room, b"\0"))
        at += room
    return b"".join(head + body)


def table_entries(b: bytes) -> list[tuple[str, int, int]]:
    """(name, absolute offset, size)."""
    _, count = struct.unpack_from("<II", b, 4)
    at, found = 12, []
    for _ in range(count):
        (n,) = struct.unpack_from("<H", b, at)
        name = b[at + 2 : at + 2 + n].decode("utf-8", "replace")
        found.append((name, *struct.unpack_from("<QQQ", b, at + 2 + n)[:2]))
        at += 26 + n
    return [(name, at + o, size) for name, o, size in found]


def count_entries(b: bytes) -> int:
    """Entries without reading them; a payload prefix is stepped over."""
    if b[:4] == b"ROX1":
        return count_entries(b[4:])
    if b[:4] == PACK:
        return struct.unpack_from(">I", b, 4)[0]
    if b[:4] == INDEXED:
        return len(json.loads(b[8 : 8 + struct.unpack_from(">I", b, 4)[0]]))
    return struct.unpack_from("<I", b, 8)[0] if b[:4] == TABLE else 0


def tar(entries: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as t:
        for name, content in entries:
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(content), 0o644
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


def untar(b: bytes) -> list[tuple[str, bytes]]:
    with tarfile.open(fileobj=io.BytesIO(b)) as t:
        return [(m.name, t.extractfile(m).read()) for m in t if m.isreg()]


# ---- streams: nothing but the entry at hand is held


class Pieces:
    """Reads exact sizes from an iterator of pieces."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held, self.at, self.done = iter(pieces), b"", 0, 0

    def _parts(self, n: int) -> Iterator[tuple[int, int]]:
        """From where to where in the piece at hand the next n bytes are; what is left of a piece stays where it is."""
        end = self.done + n
        while self.done < end:
            if self.at == len(self.held):
                piece = next(self.pieces, None)
                if piece is None:
                    raise ValueError(f"archive ends at {self.done}; {end} bytes are needed")
                self.held, self.at = piece, 0
            at, size = self.at, min(end - self.done, len(self.held) - self.at)
            self.at, self.done = at + size, self.done + size
            yield at, at + size

    def take(self, n: int) -> bytes:
        parts = [self.held[lo:hi] for lo, hi in self._parts(n)]
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def skip(self, n: int) -> None:
        for _ in self._parts(n):
            pass


def unpack_stream(pieces: Iterable[bytes], names: Iterable[str] | None = None) -> Iterator[tuple[str, bytes]]:
    """Entries of any layout as they come. With names, other entries are stepped over, and reading stops after the last name."""
    wanted = None if names is None else set(names)
    if wanted is not None and not wanted:
        return
    p = Pieces(pieces)
    magic = p.take(4)
    if magic == b"ROX1":
        magic = p.take(4)
    if magic == TABLE:
        _, count = struct.unpack("<II", p.take(8))
        table = []
        for _ in range(count):
            (n,) = struct.unpack("<H", p.take(2))
            name = p.take(n).decode("utf-8", "replace")
            table.append((*struct.unpack("<QQQ", p.take(24))[:2], name))
        at = 0
        for offset, size, name in sorted(table):
            if wanted is not None and name not in wanted:
                continue
            p.skip(offset - at)
            yield name, p.take(size)
            at = offset + size
            if wanted is not None:
                wanted.discard(name)
                if not wanted:
                    return
        return
    if magic == PACK:
        (count,) = struct.unpack(">I", p.take(4))
    elif magic == INDEXED:
        (n,) = struct.unpack(">I", p.take(4))
        count = len(json.loads(p.take(n)))
    else:
        raise ValueError("unknown archive")
    for _ in range(count):
        (n,) = struct.unpack(">H", p.take(2))
        name = p.take(n).decode("utf-8", "replace")
        (size,) = struct.unpack(">Q", p.take(8))
        if wanted is None or name in wanted:
            yield name, p.take(size)
            if wanted is not None:
                wanted.discard(name)
                if not wanted:
                    return
        else:
            p.skip(size)


def pack_stream(entries: Iterable[tuple[str, bytes]], count: int) -> Iterator[bytes]:
    yield PACK + struct.pack(">I", count)
    for name, content in entries:
        raw = name.encode()
        yield struct.pack(">H", len(raw)) + raw + struct.pack(">Q", len(content))
        yield content


def index_of(sizes: Iterable[tuple[str, int]], block: int = 8 << 20) -> list[dict]:
    """The index of an indexed archive, from names and sizes alone."""
    out, at, held, number = [], 0, 0, 0
    for name, size in sizes:
        record = 10 + len(name.encode()) + size
        if held and held + record > block:
            number, held = number + 1, 0
        out.append({"path": name, "blockId": number, "offset": at, "size": size})
        at, held = at + record, held + record
    return out


def indexed_stream(sizes: list[tuple[str, int]], contents: Iterable[bytes], block: int = 8 << 20) -> Iterator[bytes]:
    """An indexed archive in pieces: sizes are known first, contents come one by one in the same order."""
    head = json.dumps(index_of(sizes, block)).encode()
    yield INDEXED + struct.pack(">I", len(head)) + head
    for (name, size), content in zip(sizes, contents, strict=True):
        if len(content) != size:
            raise ValueError(f"{name}: {len(content)} bytes where {size} were said")
        raw = name.encode()
        yield struct.pack(">H", len(raw)) + raw + struct.pack(">Q", size) + content


def clean_tar_path(name: str) -> str:
    return "/".join(p for p in name.split("/") if p not in ("", ".", ".."))


def tar_list(f: BinaryIO) -> list[tuple[str, int]]:
    """(path, size) of the regular files, by their headers alone: contents are stepped over."""
    out, at, long_name = [], 0, None
    while True:
        f.seek(at)
        head = f.read(512)
        if len(head) < 512 or not head.strip(b"\0"):
            return out
        raw = head[124:136]
        size = int.from_bytes(raw[1:], "big") if raw[0] & 0x80 else int(raw.strip(b" \0") or b"0", 8)
        kind = head[156:157]
        if kind == b"L":  # the next entry's name
            long_name = f.read(size).rstrip(b"\0").decode("utf-8", "replace")
        elif kind in (b"0", b"\0"):
            prefix = head[345:500].rstrip(b"\0").decode("utf-8", "replace") if head[257:263] == b"ustar\0" else ""
            name = long_name or "/".join(x for x in (prefix, head[:100].rstrip(b"\0").decode("utf-8", "replace")) if x)
            out.append((clean_tar_path(name), size))
        if kind != b"L":
            long_name = None
        at += 512 + -(-size // 512) * 512
