"""A directory tree as rows: a Python data source named ``tree``, one partition a top directory.

    register(spark)
    spark.read.format("tree").load("/some/folder")

Paths must be ones that every executor can open. A regular file is one row, or one for each ``part_bytes`` of
it (32 MB), so that no file is ever whole in memory; the metadata are on all its rows, and ``part = 0`` is in
every file. Holes of a sparse file aren't read: its parts cover the data alone, and ``content_hash`` is that of
the file with its holes as zeros. ``xattr`` has the extended attributes as length-prefixed names and values in
order of name, ``acl`` the access lists. Options: ``exclude`` (comma-separated) leaves out paths and what is
under them, ``one_file_system`` what is mounted from elsewhere, ``payload`` = false the contents. What can't be
read is a row with ``error``, as a scan goes on past it.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "path string, type long, mode long, uid long, gid long, size long, mtime_sec long, mtime_nsec long, dev long, ino long, link_count long, target string, "
    "xattr binary, acl binary, content_hash string, sparse boolean, part long, parts long, at long, digest string, payload binary, error string"
)
# Node types.
KINDS = {stat.S_IFREG: 1, stat.S_IFDIR: 2, stat.S_IFLNK: 3, stat.S_IFIFO: 5, stat.S_IFCHR: 6, stat.S_IFBLK: 7}
# Attributes that hold access lists.
ACCESS_LISTS = ("system.posix_acl_access", "system.posix_acl_default")
PART_BYTES = 32 << 20


class Top(InputPartition):
    def __init__(self, name: str):
        self.name = name


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def packed(pairs: list[tuple[str, bytes]]) -> bytes | None:
    """Names and values, each after its length; nothing if there are none."""
    out = b"".join(len(x).to_bytes(4, "little") + x for name, value in pairs for x in (os.fsencode(name), value))
    return out or None


def unpacked(blob: bytes | None) -> list[tuple[str, bytes]]:
    fields, at = [], 0
    while blob and at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        fields.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return [(os.fsdecode(k), v) for k, v in zip(fields[::2], fields[1::2], strict=True)]


def attributes(full: str) -> tuple[bytes | None, bytes | None]:
    """Extended attributes and access lists; none where the file system has none."""
    try:
        names = sorted(os.listxattr(full, follow_symlinks=False))
    except OSError:
        return None, None
    found = []
    for n in names:
        try:
            found.append((n, os.getxattr(full, n, follow_symlinks=False)))
        except OSError:  # gone, or not ours to read
            continue
    return packed([x for x in found if x[0] not in ACCESS_LISTS]), packed([x for x in found if x[0] in ACCESS_LISTS])


def regions(fd: int, size: int) -> list[tuple[int, int]]:
    """Offset and length of a file's data between its holes."""
    out, at = [], 0
    while at < size:
        try:
            begin = os.lseek(fd, at, os.SEEK_DATA)
        except OSError:  # no data from here on
            break
        at = os.lseek(fd, begin, os.SEEK_HOLE)
        out.append((begin, min(at, size) - begin))
    return out


def pieces(found: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    return [(a + k, min(most, n - k)) for a, n in found for k in range(0, n, most)] or [(0, 0)]


def zeros(digest, n: int) -> None:
    block = bytes(1 << 20)
    while n > 0:
        digest.update(block[: min(n, len(block))])
        n -= len(block)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.payload = options.get("payload", "true") == "true"
        self.one = options.get("one_file_system", "false") == "true"
        self.most = int(options.get("part_bytes", PART_BYTES))
        self.exclude = [x.strip("/") for x in options.get("exclude", "").split(",") if x.strip("/")]

    def partitions(self) -> list[Top]:
        return [Top(e) for e in sorted(os.listdir(self.root))]

    def left_out(self, path: str) -> bool:
        return any(path == x or path.startswith(x + "/") for x in self.exclude)

    def read(self, partition: Top) -> Iterator[tuple]:
        device, todo = os.lstat(self.root).st_dev, [partition.name]
        while todo:
            path = todo.pop()
            full = os.path.join(self.root, path)
            nothing = (None,) * 12
            try:
                s = os.lstat(full)
                if self.left_out(path) or (self.one and s.st_dev != device):
                    continue
                kind = KINDS.get(stat.S_IFMT(s.st_mode), 1)
                if kind == 2:
                    todo += [f"{path}/{e}" for e in sorted(os.listdir(full), reverse=True)]
                target = os.readlink(full) if kind == 3 else None
                node = (path, kind, s.st_mode, s.st_uid, s.st_gid, s.st_size if kind == 1 else len(os.fsencode(target or "")), s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9, s.st_dev, s.st_ino, s.st_nlink, target, *attributes(full))
                if kind == 1 and self.payload:
                    yield from self.contents(full, node)
                else:
                    yield *node, hashlib.sha256(os.fsencode(target)).hexdigest() if target else None, False, 0, 1, 0, None, None, None
            except OSError as e:
                yield path, *nothing, None, None, False, 0, 1, 0, None, None, str(e)

    def contents(self, full: str, node: tuple) -> Iterator[tuple]:
        """A file's rows. It is read twice, for its hash and for its parts; one that changes meanwhile is an error."""
        with open(full, "rb") as f:
            size = node[5]
            found = regions(f.fileno(), size)
            sparse = sum(n for _, n in found) < size
            whole = hashlib.sha256()
            cuts, at, digests = pieces(found, self.most), 0, []
            for begin, n in cuts:
                zeros(whole, begin - at)
                f.seek(begin)
                data = f.read(n)
                whole.update(data)
                digests.append(hashlib.sha256(data).hexdigest())
                at = begin + n
            zeros(whole, size - at)
            for i, ((begin, n), digest) in enumerate(zip(cuts, digests, strict=True)):
                f.seek(begin)
                data = f.read(n)
                if len(data) != n or hashlib.sha256(data).hexdigest() != digest:
                    raise OSError(f"{full} changed while it was read")
                yield *node, whole.hexdigest(), sparse, i, len(cuts), begin, digest, data, None


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
