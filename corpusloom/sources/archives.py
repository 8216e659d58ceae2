"""Data sources in Python: members of archives, and a vector store's batches.

`archive` reads tar, zip and WARC files without unpacking them.  A small
archive is one partition.  Of a large one only the members' headers are read
first (tar headers, a zip's directory, WARC headers), one after the other, and
it is cut into partitions of about split_bytes at members' places; what is
planned is a few offsets an archive, never a list of members.  Compressed tar
and WARC files cannot be entered in the middle and are one partition each.

    spark.dataSource.register(Archive)
    spark.read.format("archive").option("path", "s3://bucket/*.tar").load()

gives (archive, member, size, content).  Folders and special files are left
out; a broken end of an archive ends it, and its complete members are kept.

`batches` writes rows in batches of `size`, each a JSON lines file whose name
comes from the run, the partition and its place, so that a task that is run
again writes the same names.  A task writes to a folder of its own attempt; the
commit moves the folders of the attempts that won, and an abort takes all away.
"""

from __future__ import annotations

import gzip
import io
import json
import os
import posixpath
import struct
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SPLIT_BYTES = 64 << 20
BATCH = 50
_SCHEMA = "archive string, member string, size long, content binary"
_BLOCK = 512


def _filesystem(path: str):
    """A file system and a path in it: local folders, and whatever pyarrow reaches."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return fs.LocalFileSystem(), os.path.abspath(path)


def _files(path: str) -> list[str]:
    """The archives of a path: a file, a folder or a pattern in its last part."""
    from fnmatch import fnmatch

    from pyarrow import fs

    folder, _, name = path.rstrip("/").rpartition("/")
    pattern = any(c in name for c in "*?[")
    system, at = _filesystem(folder if pattern else path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at, recursive=not pattern))
    root = (folder if pattern else path).rstrip("/")
    names = [posixpath.relpath(f.path, at) for f in found if f.type == fs.FileType.File]
    return sorted(f"{root}/{n}" for n in names if not posixpath.basename(n).startswith((".", "_")) and (not pattern or fnmatch(n, name)))


def kind_of(name: str) -> str | None:
    low = name.lower()
    for end, kind in ((".tar", "tar"), (".tar.gz", "tar-packed"), (".tgz", "tar-packed"), (".tar.bz2", "tar-packed"), (".tar.xz", "tar-packed"), (".zip", "zip"), (".warc", "warc"), (".warc.gz", "warc-packed")):
        if low.endswith(end):
            return kind
    return None


@dataclass
class Part(InputPartition):
    """Members of one archive that start in [start, end)."""

    archive: str
    kind: str
    start: int
    end: int


def _number(raw: bytes) -> int:
    """A number of a tar header: octal digits, or binary behind a set bit."""
    if raw[:1] and raw[0] & 0x80:
        return int.from_bytes(bytes([raw[0] & 0x7F]) + raw[1:], "big")
    digits = raw.split(b"\0")[0].strip()
    return int(digits, 8) if digits else 0


def _tar_places(f, size: int) -> Iterator[int]:
    """Where members start, with the extra headers before them."""
    at, first = 0, None
    while at + _BLOCK <= size:
        f.seek(at)
        head = f.read(_BLOCK)
        if len(head) < _BLOCK or not head.strip(b"\0"):
            return
        try:
            n = _number(head[124:136])
        except ValueError:
            return
        first = at if first is None else first
        if head[156:157] not in (b"x", b"g", b"L", b"K"):  # those belong to the member behind them
            yield first
            first = None
        at += _BLOCK + -(-n // _BLOCK) * _BLOCK


def _tar_members(f, start: int, end: int) -> Iterator[tuple[str, bytes]]:
    f.seek(start)
    try:
        with tarfile.open(fileobj=_Range(f, start, end), mode="r:") as t:
            for m in t:
                if m.isfile():
                    data = t.extractfile(m).read()
                    if len(data) == m.size:
                        yield m.name, data
    except (tarfile.ReadError, EOFError):
        return


class _Range(io.RawIOBase):
    """A stretch of a file as a file."""

    def __init__(self, f, start: int, end: int):
        self.f, self.start, self.size, self.at = f, start, end - start, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = max(0, (0, self.at, self.size)[whence] + to)
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = self.size - self.at if n is None or n < 0 else min(n, self.size - self.at)
        if n <= 0:
            return b""
        self.f.seek(self.start + self.at)
        out = self.f.read(n)
        self.at += len(out)
        return out

    def readinto(self, b) -> int:
        data = self.read(len(b))
        b[: len(data)] = data
        return len(data)


def _warc_head(f) -> tuple[dict[str, str], int] | None:
    """The fields of the record at a file's place and the length of its content."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line.startswith(b"WARC/"):
        return None
    fields = {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return (fields, int(fields["content-length"])) if fields.get("content-length", "").isdigit() else None


def _warc_places(f, size: int) -> Iterator[int]:
    at = 0
    while at < size:
        f.seek(at)
        head = _warc_head(f)
        if head is None:
            return
        yield at
        at = f.tell() + head[1] + 4


def _warc_members(f, end: int | None) -> Iterator[tuple[str, bytes]]:
    """Responses and resources by their address, without the record's protocol head."""
    while (end is None or f.tell() < end) and (head := _warc_head(f)) is not None:
        fields, n = head
        content = f.read(n)
        if len(content) < n:
            return
        kind = fields.get("warc-type")
        if kind == "response" and "http" in fields.get("content-type", ""):
            yield fields.get("warc-target-uri", ""), content.partition(b"\r\n\r\n")[2]
        elif kind in ("response", "resource"):
            yield fields.get("warc-target-uri", ""), content
        f.readline()
        f.readline()


def plan(archive: str, split_bytes: int) -> list[Part]:
    """The partitions of one archive."""
    kind = kind_of(archive)
    if kind is None:
        return []
    system, at = _filesystem(archive)
    size = system.get_file_info(at).size
    whole = [Part(archive, kind, 0, size)]
    if size <= split_bytes or kind.endswith("packed"):
        return whole
    with system.open_input_file(at) as f:
        if kind == "zip":
            with zipfile.ZipFile(_Range(f, 0, f.size())) as z:  # which may look before the start of an empty archive
                places = iter(sorted(i.header_offset for i in z.infolist()))
                return _grouped(archive, kind, places, size, split_bytes)
        b = io.BufferedReader(_Range(f, 0, size), 1 << 13)
        return _grouped(archive, kind, (_tar_places if kind == "tar" else _warc_places)(b, size), size, split_bytes)


def _grouped(archive: str, kind: str, places: Iterator[int], size: int, split_bytes: int) -> list[Part]:
    cuts = [0]
    for p in places:
        if p - cuts[-1] >= split_bytes:
            cuts.append(p)
    return [Part(archive, kind, a, b) for a, b in zip(cuts, [*cuts[1:], size])]


def members(part: Part) -> Iterator[tuple[str, str, int, bytes]]:
    system, at = _filesystem(part.archive)
    with system.open_input_file(at) as f:
        if part.kind == "zip":
            with zipfile.ZipFile(_Range(f, 0, f.size())) as z:
                found = ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and part.start <= i.header_offset < part.end)
                yield from ((part.archive, n, len(c), c) for n, c in found)
            return
        if part.kind == "tar":
            found = _tar_members(f, part.start, part.end)
        elif part.kind == "warc":
            f.seek(part.start)
            b = io.BufferedReader(_Range(f, part.start, part.end), 1 << 16)
            found = _warc_members(b, None)
        elif part.kind == "warc-packed":
            found = _quiet(_warc_members(gzip.open(io.BufferedReader(_Range(f, 0, part.end), 1 << 16)), None))
        else:
            found = _quiet(_packed_tar(f))
        yield from ((part.archive, n, len(c), c) for n, c in found)


def _packed_tar(f) -> Iterator[tuple[str, bytes]]:
    with tarfile.open(fileobj=f, mode="r|*") as t:
        for m in t:
            if m.isfile():
                yield m.name, t.extractfile(m).read()


def _quiet(found: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    """Up to a broken end."""
    try:
        yield from found
    except (EOFError, zlib.error, gzip.BadGzipFile, tarfile.ReadError, struct.error):
        return


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Part]:
        size = int(self.options.get("split_bytes", SPLIT_BYTES))
        return [p for a in _files(self.options["path"]) for p in plan(a, size)] or [Part("", "none", 0, 0)]

    def read(self, part: Part) -> Iterator[tuple[str, str, int, bytes]]:
        if part.kind != "none":
            yield from members(part)


class Archive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int
    rows: int


def _plain(value):
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, Decimal):
        return str(value)
    if hasattr(value, "asDict"):
        return value.asDict(True)
    raise TypeError(type(value).__name__)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.size = options["path"].rstrip("/"), int(options.get("size", BATCH))
        self.run, self.overwrite = options.get("run") or uuid.uuid4().hex, overwrite

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        folder = f"{self.path}/_{self.run}/{part}-{uuid.uuid4().hex}"
        system, at = _filesystem(folder)
        system.create_dir(at, recursive=True)
        held: list[str] = []
        files = n = 0

        def flush() -> None:
            with system.open_output_stream(f"{at}/{self.run}-{part:06d}-{files:08d}.json") as out:
                out.write(("\n".join(held) + "\n").encode())

        for row in rows:
            held.append(json.dumps(row.asDict(True), default=_plain, ensure_ascii=False))
            n += 1
            if len(held) == self.size:
                flush()
                files, held = files + 1, []
        if held:
            flush()
            files += 1
        return Written(folder, files, n)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, at = _filesystem(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(at)):
                if f.type == fs.FileType.File:
                    system.delete_file(f.path)
        for m in messages:
            if m is not None:
                _, own = _filesystem(m.folder)
                for f in system.get_file_info(fs.FileSelector(own)):
                    system.move(f.path, f"{at}/{posixpath.basename(f.path)}")  # the same names if the run is repeated
        self._clear(system, at)

    def abort(self, messages: list[Written | None]) -> None:
        system, at = _filesystem(self.path)
        self._clear(system, at)

    def _clear(self, system, at: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{at}/_{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/_{self.run}")


class Batches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "batches"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark) -> None:
    from corpusloom.session import ship

    ship(spark)
    spark.dataSource.register(Archive)
    spark.dataSource.register(Batches)


def pack(df, path: str, member: str, content: str, kind: str = "tar"):
    """Writes an archive for each partition, of kind tar, zip or warc; returns (archive, members).  An archive that is written again has the same name."""
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    from corpusloom.session import ship

    ship(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        name = f"{path.rstrip('/')}/part-{TaskContext.get().partitionId():06d}.{kind}"
        system, at = _filesystem(name)
        system.create_dir(posixpath.dirname(at), recursive=True)
        n = 0
        with system.open_output_stream(at) as out:
            add, close = _packer(out, kind)
            for batch in batches:
                for m, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    add(m, c or b"")
                    n += 1
            close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["archive", "members"])

    return df.select(F.col(member).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "archive string, members long")


def _packer(out, kind: str):
    if kind == "warc":

        def record(name: str, data: bytes) -> None:
            out.write(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {name}\r\nContent-Length: {len(data)}\r\n\r\n".encode() + data + b"\r\n\r\n")

        return record, lambda: None
    if kind == "zip":
        z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        return z.writestr, z.close
    t = tarfile.open(fileobj=out, mode="w|")

    def member(name: str, data: bytes) -> None:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))

    return member, t.close
