"""python -m packframe.cli COMMAND ...: single files here, directories through Spark.

encode IN OUT.png [--passphrase P] [--archives N]   a file as an image, or a directory as images in a folder
decode IN OUT_DIR [--passphrase P] [--files LIST]   files out of an image, an archive, or a folder of them
list IN, havepassphrase IN, scan IN [--channels N] [--markers LIST], delta-encode / delta-decode IN OUT,
compress IN OUT [--level N] [--dict D] [--bwt], decompress IN OUT [--dict D], train-dict OUT FILES... [--size N], crc32 IN, adler32 IN, optimise IN OUT
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import zlib
from pathlib import Path

from packframe.operators import archive, codecs, envelope, grid, png, shrink
from packframe.sources import sinks


def requested(text: str | None) -> list[str] | None:
    """A list of names: JSON if it starts with a bracket, else split at commas."""
    if text is None:
        return None
    names = json.loads(text) if text.lstrip().startswith("[") else text.split(",")
    return [n.strip() for n in names if n.strip()]


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("packframe").getOrCreate()


def _said(done: int, total: int, step: str) -> None:
    print(f"PROGRESS:{done}:{total}:{step}", file=sys.stderr)


def _seal(payload: bytes, passphrase: str | None) -> bytes:
    if not passphrase:
        return bytes([envelope.PLAIN]) + payload
    spark = _spark()
    df = spark.createDataFrame([(bytearray(payload),)], "content binary")
    return bytes(envelope.ctr_encrypt(df, "content", "e", passphrase).first()["e"])


def _open(payload: bytes, passphrase: str | None) -> bytes:
    if payload[:1] == b"\0":
        return payload
    spark = _spark()
    row = envelope.decrypt(spark.createDataFrame([(bytearray(payload),)], "e binary"), "e", "d", "reason", passphrase).first()
    if row["reason"]:
        raise envelope.REASONS[row["reason"]](row["reason"])
    return b"\0" + bytes(row["d"])


def encode(a) -> None:
    if os.path.isdir(a.input):
        from packframe.sources.files import files_from_dir

        if a.passphrase:
            raise SystemExit("directories are written without a passphrase; encrypt() works on their archives")
        files = files_from_dir(_spark(), os.path.abspath(a.input))
        done = sinks.write_archives(files, os.path.abspath(a.output), a.archives, "png").collect()  # a row for each archive
        _said(len(done), len(done), "written")
        return
    name, content = os.path.basename(a.input), Path(a.input).read_bytes()
    payload = _seal(codecs.zstd_by_policy(archive.pack([(name, content)]), a.level), a.passphrase)
    listed = json.dumps([{"name": name, "size": len(content)}])
    Path(a.output).write_bytes(png.encode_payload(payload, name, listed))
    _said(len(content), len(content), "written")


def _entries(path: str, names, passphrase):
    b = Path(path).read_bytes()
    if b[:8] == png.SIGNATURE:
        _, inner, payload, _ = png.find_payload(b)
        return sinks.entries_of(inner or os.path.basename(path), sinks.normalise(_open(payload, passphrase)), names)
    return sinks.entries_of(os.path.basename(path), b, names)


def decode(a) -> None:
    names = requested(a.files)
    if os.path.isdir(a.input):
        files = sinks.read_archives(_spark(), os.path.abspath(a.input), names)
        sinks.write_files(files, os.path.abspath(a.output)).write.format("noop").mode("overwrite").save()
        return
    n = 0
    for name, content in _entries(a.input, frozenset(names) if names is not None else None, a.passphrase):
        to = Path(a.output) / (sinks.safe_path(name) or "file")
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(content)
        n += 1
        _said(n, 0, "file")


def show(a) -> None:
    b = Path(a.input).read_bytes()
    listed = png.file_list(b) if b[:8] == png.SIGNATURE else None
    entries = json.loads(listed) if listed else [{"name": n, "size": len(c)} for n, c in _entries(a.input, None, a.passphrase)]
    entries = [{"name": e, "size": 0} if isinstance(e, str) else {"name": e.get("name") or e.get("path"), "size": e.get("size") or 0} for e in entries]
    print(json.dumps(sorted(entries, key=lambda e: e["name"].encode())))


def has_passphrase(a) -> None:
    b = Path(a.input).read_bytes()
    payload = png.find_payload(b)[2] if b[:8] == png.SIGNATURE else b
    print(str(payload[:1] in (b"\1", b"\2", b"\3")).lower())


def scan(a) -> None:
    b = Path(a.input).read_bytes()
    print(json.dumps({"magic": grid.find_all(b), "markers": grid.marker_pixels(b, a.channels, grid.parse_markers(a.markers)).tolist()}))


def _copy(f):
    return lambda a: Path(a.output).write_bytes(f(Path(a.input).read_bytes(), a)) and None


def _dictionary(a) -> bytes | None:
    return Path(a.dict).read_bytes() if a.dict else None


def train(a) -> None:
    Path(a.output).write_bytes(codecs.train_dictionary([Path(p).read_bytes() for p in a.inputs], a.size))


COMMANDS = {
    "encode": encode,
    "decode": decode,
    "list": show,
    "havepassphrase": has_passphrase,
    "scan": scan,
    "delta-encode": _copy(lambda b, a: codecs.delta(b)),
    "delta-decode": _copy(lambda b, a: codecs.undelta(b)),
    "compress": _copy(lambda b, a: codecs.hybrid(b) if a.bwt else codecs.zstd(b, a.level, _dictionary(a))),
    "decompress": _copy(lambda b, a: codecs.unhybrid(b) if b[:4] in (codecs.HYBRID_MAGIC, codecs.HYBRID_OLD) else codecs.unzstd_chunked(b) if b[:4] == codecs.CHUNK_MAGIC else codecs.unzstd(b, _dictionary(a))),
    "train-dict": train,
    "crc32": lambda a: print(zlib.crc32(Path(a.input).read_bytes())),
    "adler32": lambda a: print(zlib.adler32(Path(a.input).read_bytes())),
    "optimise": _copy(lambda b, a: shrink.optimise(b)),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="packframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = commands.add_parser(name)
        if name == "train-dict":
            p.add_argument("output")
            p.add_argument("inputs", nargs="+")
            p.add_argument("--size", type=int, default=112_640)
            continue
        p.add_argument("input")
        if name not in ("list", "havepassphrase", "scan", "crc32", "adler32"):
            p.add_argument("output")
        for flag, kind, default in (("--passphrase", str, None), ("--files", str, None), ("--archives", int, 16), ("--level", int, 19), ("--dict", str, None), ("--channels", int, 4), ("--markers", str, "")):
            p.add_argument(flag, type=kind, default=default)
        p.add_argument("--bwt", action="store_true")
    a = parser.parse_args(argv)
    try:
        COMMANDS[a.command](a)
    except (ValueError, OSError) as e:
        print(f"{a.command}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
