"""A repository in a folder: Parquet tables of nodes, entries, paths and objects, small JSON and TOML files beside them.

A commit writes objects, then the snapshot's partitions, then HEAD, then its header: a snapshot is there if
its header is, and HEAD means the newest one up to the id it names. What a commit that died left behind is
swept before the next one. Ids aren't given twice, even after the newest snapshot was deleted. Which folders hold objects is
told by one small file, the manifest, which is replaced whole: packing, merging and collecting garbage write
new folders, replace the manifest and only then delete old ones, so that at each moment it names whole data.
All data goes through Spark's readers and writers, the small files through Hadoop's file system, so a
repository may be wherever Spark can write.
"""

from __future__ import annotations

import json
import os
import re
import socket
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.codecs import compressed_fraction, interleaved_parity, interleaved_repair
from siltstone.operators import diff, objects, packs, retention, tree
from siltstone.sources import policy as policies

FORMAT = "2"
TAG = re.compile(r"[A-Za-z0-9._-]+")
# Bytes of a pack, of a large object whose beginning is probed, and of that beginning; the ratio from
# which it isn't packed; snapshots between two merges; bytes that a merge takes, at least, at most and in percent.
PACK_BYTES, LARGE, PROBE, WORTH = 256 << 20, 16 << 20, 64 << 10, 0.9
MERGE_EVERY, MERGE_LEAST, MERGE_MOST, MERGE_PERCENT = 10, 256 << 20, 10 << 30, 15
# Object types.
FILE, XATTR, ACL, SPARSE = 1, 2, 3, 4
NODE = "node_id long, type long, mode long, uid long, gid long, size long, mtime_sec long, mtime_nsec long, content_hash string, xattr_hash string, acl_hash string, link_count long, inode_identity string, target string"
PART = "hash string, part long, parts long, at long, type long, size long, digest string, skip long, payload binary, parity binary"
PLACE = "storage string, pack_num long, entry_index long, dat_offset long"
SCHEMAS = {
    "snapshots": "snap_id long, uid string, created timestamp, node_count long, dirent_count long, logical_bytes long, new_bytes long, warnings long, gfs_flags long",
    "nodes": f"{NODE}, snap_id long",
    "dirents": "parent_node long, node_id long, name string, snap_id long",
    "paths": "path string, parent string, depth long, node_id long, snap_id long",
    "objects": f"{PART}, {PLACE}",
}
BY_SNAPSHOT = ("nodes", "dirents", "paths")


class StoreError(Exception):
    """What the caller asked for isn't there or isn't allowed."""


def protected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of objects with the parity of their payloads."""
    for b in batches:
        parity = [interleaved_parity(x) if x else b"" for x in b.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parity, pa.binary())], [*b.schema.names, "parity"])


def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of objects, those with a wrong digest put right by their parity where that can be done."""
    import hashlib

    at = None
    for b in batches:
        at = b.schema.get_field_index("payload")
        out = []
        for x, p, d in zip(b.column("payload").to_pylist(), b.column("parity").to_pylist(), b.column("digest").to_pylist(), strict=True):
            if x and p and hashlib.sha256(x).hexdigest() != d:
                fixed = interleaved_repair(x, p)
                x = fixed if fixed is not None and hashlib.sha256(fixed).hexdigest() == d else x
            out.append(x)
        yield b.set_column(at, "payload", pa.array(out, pa.binary()))


def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash of those whose beginning doesn't shrink enough to be packed."""
    for b in batches:
        hashes = [h for h, x in zip(b.column("hash").to_pylist(), b.column("head").to_pylist(), strict=True) if compressed_fraction(x) >= WORTH]
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.string())], ["hash"])


class Lock:
    """A hold on the repository: shared by readers that must not see it change, or exclusive."""

    def __init__(self, store: Store, shared: bool):
        self.store, self.name = store, ""
        self._take(shared)

    def _take(self, shared: bool) -> None:
        name = f"locks/shared-{uuid.uuid4().hex}" if shared else "locks/exclusive"
        s = self.store
        s._fs.mkdirs(s._path("locks"))
        try:
            out = s._fs.create(s._path(name), False)
        except Py4JJavaError:
            if not self._abandoned(name):
                raise StoreError("another command is writing") from None
            s._fs.delete(s._path(name), False)
            out = s._fs.create(s._path(name), False)
        out.write(bytearray(json.dumps({"host": socket.gethostname(), "pid": os.getpid()}).encode()))
        out.close()
        # whoever comes second sees the first, as both look after they wrote
        others = [n for n in s._names("locks") if f"locks/{n}" not in (name, self.name) and (not shared or n == "exclusive") and not self._abandoned(f"locks/{n}")]
        if others:
            s._fs.delete(s._path(name), False)
            raise StoreError("another command is writing" if "exclusive" in others else "others are reading")
        old, self.name = self.name, name
        if old:
            s._fs.delete(s._path(old), False)

    def _abandoned(self, name: str) -> bool:
        """Whether a lock's holder was a process of this machine that is gone."""
        try:
            held = json.loads(self.store._get(name) or "{}")
        except ValueError:
            return False
        return held.get("host") == socket.gethostname() and not alive(int(held.get("pid", 0)))

    def upgrade(self) -> None:
        self._take(False)

    def downgrade(self) -> None:
        self._take(True)

    def release(self) -> None:
        self.store._fs.delete(self.store._path(self.name), False)


def alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return True


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        path = self._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # small files. A new text is first whole under a hidden name beside the old one; the old one goes, and the new one
    # takes its name. At each moment one of the two is there, and readers take the second where the first is missing.

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _beside(self, name: str) -> str:
        folder, _, last = name.rpartition("/")
        return f"{folder}/_{last}~" if folder else f"_{last}~"

    def _get(self, name: str) -> str | None:
        for each in (name, self._beside(name), name):
            try:
                stream = self._fs.open(self._path(each))
            except Py4JJavaError as e:
                if "FileNotFoundException" not in str(e.java_exception):
                    raise
                continue
            try:
                return bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
        return None

    def _put(self, name: str, text: str) -> None:
        new = self._beside(name)
        self._settle(name)
        part = f"{new}{uuid.uuid4().hex}"
        out = self._fs.create(self._path(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(self._path(new), False)
        if not self._fs.rename(self._path(part), self._path(new)):
            raise StoreError(f"can't write {name}")
        self._fs.delete(self._path(name), False)
        self._settle(name)

    def _settle(self, name: str) -> None:
        """End what a writer began that died between taking the old text away and renaming the new one."""
        new = self._beside(name)
        if self._fs.exists(self._path(new)) and not self._fs.exists(self._path(name)) and not self._fs.rename(self._path(new), self._path(name)) and not self._fs.exists(self._path(name)):
            raise StoreError(f"can't write {name}")

    def _remove(self, name: str) -> bool:
        beside = self._fs.delete(self._path(self._beside(name)), False)
        return self._fs.delete(self._path(name), False) or beside

    def _names(self, folder: str) -> list[str]:
        """Names of the small files of a folder."""
        if not self._fs.exists(self._path(folder)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        return sorted({n[1:-1] if n.startswith("_") and n.endswith("~") else n for n in found if not n.startswith((".", "_")) or n.endswith("~")})

    # the repository

    @classmethod
    def init(cls, spark: SparkSession, root: str) -> Store:
        store = cls(spark, root)
        if store._get("format"):
            raise StoreError("there is a repository already")
        for folder in ("tags", "snapshots", "data"):
            store._fs.mkdirs(store._path(folder))
        store._put("policy.toml", policies.dump(policies.DEFAULTS))
        store._put("manifest.json", json.dumps({"version": 0, "loose": [], "packs": {}, "merged": 0}))
        store._put("format", FORMAT)
        return store

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Store:
        store = cls(spark, root)
        if store._get("format") != FORMAT:
            raise StoreError("no repository of this format")
        return store

    @contextmanager
    def lock(self, wait: bool = False, shared: bool = False) -> Iterator[Lock]:
        """The one writer's lock, or a reader's that keeps writers out. What a dead process of this machine held is free."""
        while True:
            try:
                held = Lock(self, shared)
                break
            except StoreError:
                if not wait:
                    raise
                time.sleep(0.5)
        try:
            yield held
        finally:
            held.release()

    def table(self, name: str) -> DataFrame:
        """All rows of a table, of snapshots that are there or were; a folder that the manifest names must be there."""
        if name == "objects":
            return self._objects()
        if name == "snapshots":
            return self._headers()
        if not self._fs.exists(self._path(name)):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def _of(self, name: str, snaps: list[int]) -> DataFrame:
        """The rows of some snapshots: their partitions and no others."""
        if not snaps:
            return self.spark.createDataFrame([], SCHEMAS[name])
        folders = [f"{self.root}/{name}/snap_id={i}" for i in snaps]
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.root}/{name}").parquet(*folders)

    @property
    def manifest(self) -> dict:
        return json.loads(self._get("manifest.json") or "null")

    def _replace(self, **changes: object) -> None:
        """Let the manifest name other folders, then delete those that it names no more."""
        now = self.manifest | changes
        now["version"] += 1
        self._put("manifest.json", json.dumps(now))
        self.sweep()

    def sweep(self) -> int:
        """Delete folders of data that the manifest doesn't name, staged scans, and partitions without a header: what dead
        commands left. A commit sweeps before it writes, the others after; all hold the lock."""
        now = self.manifest
        named = {*now["loose"], *now["packs"].values()}
        gone = [s.getPath() for s in self._fs.listStatus(self._path("data")) if s.getPath().getName() not in named]
        ids = {f"snap_id={i}" for i in self.ids}
        for name in BY_SNAPSHOT:
            if self._fs.exists(self._path(name)):
                gone += [s.getPath() for s in self._fs.listStatus(self._path(name)) if s.getPath().getName() not in ids]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)

    def _objects(self, now: dict | None = None) -> DataFrame:
        now = now or self.manifest
        out = None
        if now["loose"]:
            loose = self.spark.read.schema(PART).parquet(*[f"{self.root}/data/{f}" for f in now["loose"]])
            out = loose.select("*", F.lit("loose").alias("storage"), *[F.lit(None).cast("long").alias(c) for c in ("pack_num", "entry_index", "dat_offset")])
        packed = self._packed(now)
        if packed is not None:
            out = packed if out is None else out.unionByName(packed)
        return self.spark.createDataFrame([], SCHEMAS["objects"]) if out is None else out

    def _packed(self, now: dict, numbers: list[int] | None = None) -> DataFrame | None:
        """The rows of packs, each in a folder of its own below the folder that the manifest names."""
        wanted = [f"{self.root}/data/{f}/pack_num={n}" for n, f in now["packs"].items() if numbers is None or int(n) in numbers]
        out = None
        for folder in sorted({now["packs"][n] for n in now["packs"]}):
            own = [w for w in wanted if f"/data/{folder}/" in w]
            if own:
                rows = self.spark.read.schema(f"{PART}, entry_index long, dat_offset long, pack_num long").option("basePath", f"{self.root}/data/{folder}").parquet(*own)
                out = rows if out is None else out.unionByName(rows)
        return None if out is None else out.withColumn("storage", F.lit("pack")).select(*self.spark.createDataFrame([], SCHEMAS["objects"]).columns)

    def loose(self) -> DataFrame:
        return self._objects(self.manifest | {"packs": {}})

    def packed(self) -> DataFrame:
        return self._objects(self.manifest | {"loose": []})

    def whole(self, hashes: DataFrame) -> DataFrame:
        """hash and content of some objects in one value each, of 2 GB at most; holes are zeros."""
        parts = self.table("objects").join(hashes.select("hash").distinct(), "hash", "left_semi")
        one = (F.col("parts") == 1) & (F.col("type") != SPARSE)
        many = parts.where(~one).groupBy("hash").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("at", "payload"))).alias("p"))
        zeros = lambda n: F.unhex(F.repeat(F.lit("00"), n.cast("int")))
        filled = F.aggregate("p", F.unhex(F.lit("")), lambda x, y: F.concat(x, zeros(y["at"] - F.octet_length(x)), y["payload"]))
        many = many.select("hash", "size", filled.alias("x")).select("hash", F.concat("x", zeros(F.col("size") - F.octet_length("x"))).alias("payload"))
        return parts.where(one).select("hash", "payload").unionByName(many)

    @property
    def ids(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("snapshots"))

    @property
    def head(self) -> int:
        """The newest snapshot, or the one before if HEAD's was deleted and HEAD not yet moved."""
        named = int(self._get("HEAD") or 0)
        return max((i for i in self.ids if i <= named), default=0)

    def _next(self) -> int:
        return max([int(self._get("HEAD") or 0), int(self._get("last") or 0), *self.ids]) + 1

    @property
    def policy(self) -> dict[str, object]:
        return policies.effective(self._get("policy.toml") or "")

    def save_policy(self, changes: dict[str, object]) -> None:
        self._put("policy.toml", policies.dump({**self.policy, **changes}))

    # ingest

    def run(self, scanned: DataFrame) -> int:
        """Commit ``scanned``, the rows of a ``tree`` source or at least path, type, mode, uid, gid, mtime_sec, payload
        and target, as a snapshot.

        The scan is read once, into a folder of its own. Only contents that aren't stored yet are written. A tree
        without changes makes no snapshot; the id of the newest one is returned. Entries that couldn't be read are
        counted in the header and left out.
        """
        self.sweep()
        snap, staging = self._next(), f"scan-{uuid.uuid4().hex}"
        self._complete(scanned).write.parquet(f"{self.root}/data/{staging}")
        rows = self.spark.read.parquet(f"{self.root}/data/{staging}")
        try:
            return self._commit(snap, rows)
        finally:
            self._fs.delete(self._path(f"data/{staging}"), True)

    def _complete(self, scanned: DataFrame) -> DataFrame:
        """All columns of a scan; what a plainer table of files lacks is filled in."""
        whole = F.when(F.col("type") == 1, F.coalesce("payload", F.lit(b"")))
        missing = {
            "size": F.coalesce(F.octet_length("payload"), F.lit(0)), "mtime_nsec": F.lit(0), "dev": F.lit(0), "ino": F.lit(0), "link_count": F.lit(1), "part": F.lit(0), "parts": F.lit(1), "at": F.lit(0),
            "content_hash": F.sha2(F.when(F.col("type") == 3, F.col("target").cast("binary")).otherwise(whole), 256), "digest": F.sha2(whole, 256), "xattr": F.lit(None).cast("binary"), "acl": F.lit(None).cast("binary"), "sparse": F.lit(False), "error": F.lit(None).cast("string"),
        }
        for name, value in missing.items():
            if name not in scanned.columns:
                scanned = scanned.withColumn(name, value.cast("long") if name in ("size", "mtime_nsec", "dev", "ino", "link_count", "part", "parts", "at") else value)
        return scanned

    def _commit(self, snap: int, rows: DataFrame) -> int:
        warnings = rows.where("error IS NOT NULL").count()
        rows = rows.where("error IS NULL")
        regular = F.col("type") == 1
        files = rows.where("part = 0").withColumn("xattr_hash", F.sha2("xattr", 256)).withColumn("acl_hash", F.sha2("acl", 256))
        files = files.withColumn("inode_identity", F.when(F.col("ino") != 0, F.concat_ws(":", "dev", "ino")))
        # a file's names share one node, that of its first name
        linked = files.where(regular & (F.col("link_count") > 1) & F.col("inode_identity").isNotNull()).groupBy("inode_identity").agg(F.min("path").alias("first"))
        files = files.join(linked, "inode_identity", "left").withColumn("first", F.coalesce("first", "path"))
        head = self.head
        if head:
            changes = diff.classify(self.files(head), files)
            if changes.where("change <> 'unchanged'").isEmpty():
                return head
        contents = rows.where(regular).select(F.col("content_hash").alias("hash"), "part", "parts", "at", F.when(F.col("sparse"), SPARSE).otherwise(FILE).cast("long").alias("type"), "size", "digest", "payload")
        # a link's target is an object too, as are attributes and access lists
        for column, hashed, kind in (("target", "content_hash", FILE), ("xattr", "xattr_hash", XATTR), ("acl", "acl_hash", ACL)):
            own = files.where(F.col(column).isNotNull())
            whole = [F.lit(x).cast("long").alias(c) for c, x in (("part", 0), ("parts", 1), ("at", 0), ("type", kind))]
            contents = contents.unionByName(own.select(F.col(hashed).alias("hash"), *whole, F.octet_length(column).cast("long").alias("size"), F.col(hashed).alias("digest"), F.col(column).cast("binary").alias("payload")))
        fresh = contents.join(self.table("objects").select("hash").distinct(), "hash", "left_anti").dropDuplicates(["hash", "part"])
        folder = f"loose-{uuid.uuid4().hex}"
        self._write_parts(fresh.withColumn("skip", F.lit(0).cast("long")), folder, parity=True)
        new_bytes = self.spark.read.schema(PART).parquet(f"{self.root}/data/{folder}").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()
        if new_bytes[0]:
            now = self.manifest
            self._put("manifest.json", json.dumps(now | {"loose": [*now["loose"], folder], "version": now["version"] + 1}))
        of = lambda c: F.xxhash64(F.lit(snap), c).bitwiseAND(2**62 - 1)
        parent = F.regexp_replace("path", "/?[^/]*$", "")
        placed = files.withColumn("node_id", of(F.col("first"))).withColumn("parent", parent).withColumn("parent_node", F.when(F.col("parent") == "", 0).otherwise(of(F.col("parent")))).withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
        nodes = [c.split()[0] for c in NODE.split(", ")]
        self._write("nodes", snap, placed.where("path = first").select(*nodes))
        self._write("dirents", snap, placed.select("parent_node", "node_id", "name"))
        self._write("paths", snap, self._paths(placed.select("path", "parent", "node_id")))
        totals = self._of("nodes", [snap]).agg(F.count("*"), F.coalesce(F.sum(F.when(regular, F.col("size")).otherwise(0)), F.lit(0))).first()
        header = {"snap_id": snap, "uid": uuid.uuid4().hex, "created": stamp(), "node_count": totals[0], "dirent_count": self._of("dirents", [snap]).count(), "logical_bytes": totals[1], "new_bytes": new_bytes[1], "warnings": warnings, "gfs_flags": 0}
        self._put("last", str(snap))
        self._put("HEAD", str(snap))  # leads to the snapshot before as long as there is no header
        self._put(f"snapshots/{snap}.json", json.dumps(header))
        return snap

    def _write(self, name: str, snap: int, rows: DataFrame) -> None:
        """A snapshot's partition of a table; a repeated write replaces it."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/snap_id={snap}")

    def _write_parts(self, rows: DataFrame, folder: str, parity: bool = False) -> None:
        columns = [c.split()[0] for c in PART.split(", ")]
        if parity:
            rows = rows.select(*columns[:-1]).mapInArrow(protected, PART)
        rows.select(*columns).repartitionByRange("hash", "part").sortWithinPartitions("hash", "part").write.mode("overwrite").parquet(f"{self.root}/data/{folder}")

    @staticmethod
    def _paths(rows: DataFrame) -> DataFrame:
        """A snapshot's path index: sorted by path, so that a directory's or subtree's rows lie in few row groups."""
        depth = (F.length("path") - F.length(F.replace("path", F.lit("/"))) + 1).cast("long")
        return rows.select("path", "parent", depth.alias("depth"), "node_id").repartitionByRange("path").sortWithinPartitions("path")

    def reindex(self) -> list[int]:
        """Build the path index of snapshots that have none; their ids."""
        done = []
        for snap in self.ids:
            if not self._fs.exists(self._path(f"paths/snap_id={snap}/_SUCCESS")):
                found = tree.paths(self._of("dirents", [snap])).select("path", F.regexp_replace("path", "/?[^/]*$", "").alias("parent"), "node_id")
                self._write("paths", snap, self._paths(found))
                done.append(snap)
        return done

    def after_run(self) -> dict[str, object]:
        """What follows a commit as the policy says: retention, garbage, packing."""
        p, out, collected = self.policy, {}, False
        if p["auto_prune"] and any(int(p[f"keep_{k}"]) for k in ("snaps", "daily", "weekly", "monthly", "yearly")):
            out["pruned"] = self.prune()
            if out["pruned"]:
                out["gc"], collected = self.gc(), True
        if p["auto_pack"]:
            if not collected:
                out["gc"] = self.gc()
            out["pack"] = self.pack()
        elif p["auto_gc"] and not collected:
            out["gc"] = self.gc()
        if p["verify_after"]:
            out["missing"] = objects.live(self.nodes(self.head)).join(self.table("objects").select("hash"), "hash", "left_anti").count()
        return out

    # queries

    def _headers(self) -> DataFrame:
        self._settle_all("snapshots")
        return self.spark.read.schema(SCHEMAS["snapshots"]).json(f"{self.root}/snapshots")

    def _settle_all(self, folder: str) -> None:
        for name in self._names(folder):
            self._settle(f"{folder}/{name}")

    def snapshots(self) -> DataFrame:
        return self._headers().where(F.col("snap_id") <= self.head)

    def _check(self, snap: int) -> None:
        if snap not in self.ids:
            raise StoreError(f"no snapshot {snap}")

    def nodes(self, snap: int) -> DataFrame:
        self._check(snap)
        return self._of("nodes", [snap])

    def dirents(self, snap: int) -> DataFrame:
        self._check(snap)
        return self._of("dirents", [snap])

    def paths(self, snap: int) -> DataFrame:
        """A snapshot's paths from its index, or built if it has none."""
        self._check(snap)
        if self._fs.exists(self._path(f"paths/snap_id={snap}/_SUCCESS")):
            return self._of("paths", [snap])
        return tree.paths(self.dirents(snap)).withColumn("parent", F.regexp_replace("path", "/?[^/]*$", ""))

    def files(self, snap: int) -> DataFrame:
        """Nodes of a snapshot with their paths."""
        return self.paths(snap).join(self.nodes(snap), ["snap_id", "node_id"])

    def diff(self, old: int, new: int) -> DataFrame:
        return diff.diff(self.files(old), self.files(new)).select("change", "path").orderBy("path")

    def ls(self, snap: int, path: str = "", recursive: bool = False, kind: str = "", glob: str = "") -> DataFrame:
        from siltstone.functions.text import below

        path = "" if path.strip("/") == "." else path.strip("/")
        found = self.paths(snap)
        found = found.where(below(F.col("path"), path)).where(F.col("path") != path) if recursive else found.where(F.col("parent") == path)
        found = found.join(self.nodes(snap), ["snap_id", "node_id"]).where(tree.of_type(kind))
        relative = F.substring("path", F.lit(len(path) + 2 if path else 1), F.length("path"))
        found = found.withColumn("name", relative)
        return (found.where(tree.named(glob)) if glob else found).select("name", "type", "mode", "size", "mtime_sec").orderBy("name")

    def search(self, needle: str, snap: int | None = None, limit: int = 500) -> DataFrame:
        """Entries by name with their paths; ``total`` counts those of a snapshot, not of the page."""
        snaps = self.ids if snap is None else [snap]
        hits = tree.search(self._of("dirents", snaps), self._of("nodes", snaps), needle).orderBy("snap_id", "node_id", "name").limit(limit)
        places = self._of("paths", [s for s in snaps if self._fs.exists(self._path(f"paths/snap_id={s}/_SUCCESS"))])
        places = places.withColumn("name", F.regexp_extract("path", "[^/]*$", 0)).select("snap_id", "node_id", "name", "path")
        return hits.join(places, ["snap_id", "node_id", "name"], "left").orderBy("snap_id", "node_id", "name")

    def grep(self, snap: int, pattern: str, path: str = "") -> DataFrame:
        from siltstone.functions.text import below

        files = self.files(snap).where("type = 1").where(below(F.col("path"), path)).select("path", F.col("content_hash").alias("hash"))
        return tree.grep(files.join(self.whole(files), "hash").select("path", F.col("payload").cast("string").alias("text")), pattern)

    def cat(self, snap: int, path: str) -> bytes:
        row = self.paths(snap).where(F.col("path") == path.strip("/")).join(self.nodes(snap), ["snap_id", "node_id"]).first()
        if row is None:
            raise StoreError(f"no file {path}")
        if row["type"] != 1:
            raise StoreError(f"{path} is no regular file")
        return self.load(row["content_hash"])

    def load(self, hash_: str) -> bytes:
        """An object's content, loose or packed, checked against its hash; its parts come one by one."""
        import hashlib

        out, seen = bytearray(), None
        for r in self.table("objects").where(F.col("hash") == hash_).orderBy("part").toLocalIterator():
            out += b"\0" * (r["at"] - len(out)) + bytes(r["payload"])
            seen = r
        if seen is None:
            raise StoreError(f"no object {hash_}")
        out += b"\0" * (seen["size"] - len(out))
        if hashlib.sha256(out).hexdigest() != hash_:
            raise StoreError(f"object {hash_} is damaged")
        return bytes(out)

    def verify(self) -> DataFrame:
        """Each hash that a snapshot refers to: ok, missing, or corrupt if a part has another digest or isn't there."""
        fine = F.sha2("payload", 256) == F.col("digest")
        fine = fine & ((F.col("parts") > 1) | (F.col("type") == SPARSE) | (F.col("digest") == F.col("hash")))
        parts = self.table("objects").select("hash", "part", "parts", "type", F.octet_length("payload").cast("long").alias("n"), fine.alias("fine"))
        found = parts.groupBy("hash").agg(F.countDistinct("part").alias("have"), F.max("parts").alias("parts"), F.max("type").alias("type"), F.min("fine").alias("fine"), F.sum("n").alias("bytes"))
        both = objects.live(self.live_nodes()).join(found, "hash", "left")
        status = F.when(F.col("have").isNull(), "missing").when(~F.col("fine") | (F.col("have") < F.col("parts")), "corrupt").otherwise("ok")
        return both.select("hash", status.alias("status"), "type", "bytes")

    def live_nodes(self) -> DataFrame:
        return self._of("nodes", self.ids)

    def stats(self) -> DataFrame:
        """One row over the whole repository; kept in a file until objects or snapshots change."""
        key = json.dumps([self.manifest["version"], self.head, self.ids])
        kept = json.loads(self._get("stats.json") or "{}")
        if kept.get("key") != key:
            o = self.table("objects").where("part = 0")
            stored = self.table("objects").agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("stored_bytes"))
            row = o.agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), *[F.coalesce(F.sum(F.when(F.col("storage") == s, 1).otherwise(0)), F.lit(0)).alias(f"{s}_objects") for s in ("loose", "pack")])
            row = {**row.first().asDict(), **stored.first().asDict(), "snapshots": len(self.ids), "head": self.head, "packs": len(self.manifest["packs"])}
            row["head_logical_bytes"] = self._of("nodes", [self.head]).where("type = 1").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] if self.head else 0
            kept = {"key": key, "row": row}
            self._put("stats.json", json.dumps(kept))
        row = kept["row"]
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row))

    # upkeep

    def gc(self) -> tuple[int, int]:
        """Drop objects that no snapshot refers to, loose and packed; how many were kept and deleted."""
        now, live = self.manifest, objects.live(self.live_nodes())
        every = self._objects(now).select("hash", "storage", "pack_num").distinct()
        gone = every.join(live, "hash", "left_anti").select("hash").distinct().count()
        kept = every.select("hash").distinct().count() - gone
        if not gone:
            self.sweep()
            return kept, 0
        changes = {"loose": self._rewrite_loose(now, lambda rows: rows.join(live, "hash", "left_semi"))}
        packed = self._packed(now)
        if packed is not None:
            plan = packs.gc_plan(packed.select("pack_num", "hash"), live)
            fate = {r["pack_num"]: r["plan"] for r in plan.collect()}  # a row per pack
            changes["packs"] = self._rewrite_packs(now, fate, lambda rows: rows.join(live, "hash", "left_semi"))
        self._replace(**changes)
        return kept, gone

    def _rewrite_loose(self, now: dict, of) -> list[str]:
        if not now["loose"]:
            return []
        folder = f"loose-{uuid.uuid4().hex}"
        self._write_parts(of(self._objects(now | {"packs": {}})), folder)
        return [folder]

    def _rewrite_packs(self, now: dict, fate: dict[int, str], of) -> dict[str, str]:
        """The packs of a manifest without those to delete, those to rewrite in a new folder under their numbers."""
        out = {n: f for n, f in now["packs"].items() if fate.get(int(n), "keep") != "delete"}
        again = [n for n in out if fate.get(int(n)) == "rewrite"]
        if again:
            folder = f"packs-{uuid.uuid4().hex}"
            rows = of(self._packed(now, [int(n) for n in again]))
            self._write_packs(rows, folder)
            out |= dict.fromkeys(again, folder)
        return out

    def _write_packs(self, rows: DataFrame, folder: str) -> None:
        """A folder for each pack, its parts in order of hash."""
        columns = [c.split()[0] for c in PART.split(", ")]
        rows.select(*columns, "entry_index", "dat_offset", "pack_num").repartition("pack_num").sortWithinPartitions("pack_num", "entry_index", "part").write.mode("overwrite").partitionBy("pack_num").parquet(f"{self.root}/data/{folder}")

    def pack(self, pack_bytes: int = PACK_BYTES, large: int = LARGE) -> dict[str, int]:
        """Move loose objects to packs in order of hash, then merge small packs if that is due.

        Large ones whose beginning doesn't shrink are marked and stay loose.
        """
        now = self.manifest
        loose = self._objects(now | {"packs": {}})
        heads = loose.where((F.col("part") == 0) & (F.col("skip") == 0) & (F.col("size") > large)).select("hash", F.substring("payload", 1, PROBE).alias("head"))
        marked = heads.mapInArrow(probed, "hash string").withColumn("mark", F.lit(1).cast("long"))
        marks = f"marks-{uuid.uuid4().hex}"
        marked.write.parquet(f"{self.root}/data/{marks}")
        marked = self.spark.read.schema("hash string, mark long").parquet(f"{self.root}/data/{marks}")
        loose = loose.join(marked, "hash", "left").withColumn("skip", F.coalesce("mark", "skip")).drop("mark")
        first = max([0, *map(int, now["packs"])])
        sizes = loose.where("skip = 0").groupBy("hash").agg(F.sum(F.octet_length("payload")).alias("compressed_size"))
        count = sizes.count()
        out = {"packed": count, "skipped": loose.where("skip <> 0").select("hash").distinct().count(), "packs": 0, "merged": 0}
        if count:
            places = packs.assign(sizes, pack_bytes).select("hash", (F.col("pack_num") + first).alias("pack_num"), "entry_index", "dat_offset")
            folder = f"packs-{uuid.uuid4().hex}"
            self._write_packs(loose.where("skip = 0").drop("pack_num", "entry_index", "dat_offset").join(places, "hash"), folder)
            numbers = [r[0] for r in self.spark.read.parquet(f"{self.root}/data/{folder}").select("pack_num").distinct().collect()]  # a row per pack
            out["packs"] = len(numbers)
            rest = self._rewrite_loose(now, lambda _: loose.where("skip <> 0")) if out["skipped"] else []
            self._replace(loose=rest, packs=now["packs"] | {str(n): folder for n in numbers})
        else:
            self.sweep()
        out["merged"] = self.merge(pack_bytes)
        return out

    def entries(self) -> DataFrame:
        """A row per object of the packs."""
        e = self.packed().groupBy("pack_num", "hash").agg(F.max("entry_index").alias("entry_index"), F.max("dat_offset").alias("dat_offset"), F.max("type").alias("type"), F.max("size").alias("uncompressed_size"), F.sum(F.octet_length("payload")).alias("compressed_size"))
        return e.withColumn("compression", F.lit(0).cast("long"))

    def merge(self, pack_bytes: int = PACK_BYTES, force: bool = False) -> int:
        """Rewrite the smallest packs as few full ones, if the rules say that it is due; how many were merged."""
        now = self.manifest
        if not now["packs"] or (not force and self.head - now["merged"] < MERGE_EVERY):
            return 0
        meta = packs.meta(self.entries())
        if not force and not packs.merge_due(meta, pack_bytes).first()["due"]:
            return 0
        total = meta.agg(F.sum("bytes")).first()[0] or 0
        budget = max(MERGE_LEAST, min(MERGE_MOST, total * MERGE_PERCENT // 100))
        chosen = [r["pack_num"] for r in packs.merge_candidates(meta, pack_bytes, budget).collect()]  # a row per pack
        if not chosen:
            return 0
        rows = self._packed(now, chosen)
        first = max(map(int, now["packs"]))
        sizes = rows.groupBy("hash").agg(F.sum(F.octet_length("payload")).alias("compressed_size"))
        places = packs.assign(sizes, pack_bytes).select("hash", (F.col("pack_num") + first).alias("pack_num"), "entry_index", "dat_offset")
        folder = f"packs-{uuid.uuid4().hex}"
        self._write_packs(rows.drop("pack_num", "entry_index", "dat_offset").join(places, "hash"), folder)
        numbers = [r[0] for r in self.spark.read.parquet(f"{self.root}/data/{folder}").select("pack_num").distinct().collect()]
        kept = {n: f for n, f in now["packs"].items() if int(n) not in chosen}
        self._replace(packs=kept | {str(n): folder for n in numbers}, merged=self.head)
        return len(chosen)

    def repair(self) -> dict[str, int]:
        """Put damaged objects right by their parity; how many were damaged, and how many still are."""
        bad = self.verify().where("status = 'corrupt'").select("hash")
        before = bad.count()
        if not before:
            return {"repaired": 0, "corrupt": 0}
        now, schema = self.manifest, self.spark.createDataFrame([], SCHEMAS["objects"]).schema
        mend = lambda rows: rows.mapInArrow(mended, schema)
        touched = {r[0] for r in self._objects(now).join(bad, "hash", "left_semi").select("pack_num").distinct().collect()}  # a row per pack
        changes: dict[str, object] = {}
        if None in touched:
            changes["loose"] = self._rewrite_loose(now, mend)
        if touched - {None}:
            changes["packs"] = self._rewrite_packs(now, dict.fromkeys(touched - {None}, "rewrite"), mend)
        self._replace(**changes)
        after = self.verify().where("status = 'corrupt'").count()
        return {"repaired": before - after, "corrupt": after}

    def delete(self, snap: int, force: bool = False, collect: bool = False) -> None:
        """Drop a snapshot; with ``force`` the newest too, or one with tags, which go with it. Its id isn't used again."""
        self._check(snap)
        tags = [t["name"] for t in self.tags() if t["snap_id"] == snap]
        if not force and (snap == self.head or tags):
            raise StoreError(f"snapshot {snap} is the newest or has a tag")
        self._put("last", str(self._next() - 1))
        for name in tags:
            self.untag(name)
        self._remove(f"snapshots/{snap}.json")
        self._put("HEAD", str(self.head))
        for name in BY_SNAPSHOT:
            self._fs.delete(self._path(f"{name}/snap_id={snap}"), True)
        if collect:
            self.gc()

    def prune(self, keep: retention.Keep | None = None, dry_run: bool = False) -> list[int]:
        """Elect tiers over all snapshots and delete what the policy lets go; the ids of those."""
        p = self.policy
        keep = keep or retention.Keep(*[int(p[f"keep_{k}"]) for k in ("snaps", "daily", "weekly", "monthly", "yearly")])
        tagged = [t["snap_id"] for t in self.tags() if t["preserve"]]
        s = retention.elect(self.snapshots()).withColumn("flags", F.col("gfs_flags").bitwiseOR(F.col("elected"))).withColumn("preserved", F.col("snap_id").isin(tagged) if tagged else F.lit(False))
        rows = retention.prune(s.select("snap_id", "flags", "gfs_flags", "preserved"), keep).select("snap_id", "flags", "gfs_flags", "pruned").collect()
        gone = [r["snap_id"] for r in rows if r["pruned"]]
        if not dry_run:
            for r in rows:
                if r["flags"] != r["gfs_flags"] and not r["pruned"]:
                    self.flag(r["snap_id"], r["flags"])
            for snap in gone:
                self.delete(snap, force=True)
        return sorted(gone)

    def flag(self, snap: int, flags: int, replace: bool = False) -> None:
        """Add retention flags to a snapshot's header, or replace them."""
        self._check(snap)
        header = json.loads(self._get(f"snapshots/{snap}.json"))
        header["gfs_flags"] = flags if replace else header["gfs_flags"] | flags
        self._put(f"snapshots/{snap}.json", json.dumps(header))

    # tags and notes

    def tags(self) -> list[dict]:
        return [{"name": n.removeprefix("tag-"), **json.loads(self._get(f"tags/{n}"))} for n in self._names("tags")]

    def tag(self, name: str, snap: int, preserve: bool = False) -> None:
        if not TAG.fullmatch(name):
            raise StoreError(f"no name for a tag: {name!r}")
        self._check(snap)
        self._put(f"tags/tag-{name}", json.dumps({"snap_id": snap, "preserve": preserve}))

    def untag(self, name: str) -> None:
        if not self._remove(f"tags/tag-{name}"):
            raise StoreError(f"no tag {name}")

    def rename_tag(self, old: str, new: str) -> None:
        text = self._get(f"tags/tag-{old}")
        if text is None or not TAG.fullmatch(new) or self._get(f"tags/tag-{new}") is not None:
            raise StoreError(f"can't rename {old} to {new}")
        self._put(f"tags/tag-{new}", text)
        self.untag(old)

    def resolve(self, ref: str) -> int:
        if ref.lower() == "head":
            return self.head
        if ref.isdecimal():
            return int(ref)
        text = self._get(f"tags/tag-{ref}")
        if text is None:
            raise StoreError(f"no snapshot {ref}")
        return json.loads(text)["snap_id"]

    def note(self, snap: int, text: str | None = None) -> str:
        """Set a snapshot's note, or give it; an empty text deletes it."""
        name = f"notes/{snap}"
        if text is None:
            return self._get(name) or ""
        self._check(snap)
        if text.rstrip():
            self._fs.mkdirs(self._path("notes"))
            self._put(name, text.rstrip())
        else:
            self._remove(name)
        return text.rstrip()

    # journal: one file an entry, so that appends need no lock

    def log(self, op_id: str, state: str, **fields: object) -> None:
        self._fs.mkdirs(self._path("journal"))
        now = time.time()
        self._put(f"journal/{int(now * 1e6):020d}-{uuid.uuid4().hex[:8]}.json", json.dumps({"op_id": op_id, "state": state, "timestamp": stamp(now), **fields}) + "\n")

    def journal(self) -> DataFrame:
        schema = "op_id string, state string, timestamp string, operation string, source string, user string, result string, duration_ms long, error string, task_id string"
        if not self._names("journal"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.root}/journal")


def stamp(now: float | None = None) -> str:
    """A time as ISO 8601 with milliseconds."""
    now = time.time() if now is None else now
    return time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(now)) + f".{int(now * 1000) % 1000:03d}Z"
