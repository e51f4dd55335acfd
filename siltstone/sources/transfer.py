"""Taking snapshots out of a repository and into another: restore, TAR, bundles."""

from __future__ import annotations

import os
import tarfile
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import below, unsafe_path
from siltstone.operators import objects
from siltstone.sources.filesystem import unpacked
from siltstone.sources.store import BY_SNAPSHOT, PART, SCHEMAS, Store, StoreError

COLUMNS = ("path", "first", "type", "mode", "uid", "gid", "mtime_sec", "mtime_nsec", "size", "target", "content_hash", "xattr", "acl")


def contents(store: Store, snap: int, path: str = "") -> DataFrame:
    """Names of a snapshot, or of a subtree, with their nodes, attributes and the first name of the same node."""
    files = store.files(snap).where(below(F.col("path"), path)).where(~unsafe_path(F.col("path")))
    firsts = files.where("link_count > 1").groupBy("node_id").agg(F.min("path").alias("first"))
    files = files.join(firsts, "node_id", "left").withColumn("first", F.coalesce("first", "path"))
    small = store.table("objects").where("part = 0")
    for c in ("xattr", "acl"):
        files = files.join(small.select(F.col("hash").alias(f"{c}_hash"), F.col("payload").alias(c)), f"{c}_hash", "left")
    return files.select(*COLUMNS)


def with_parts(store: Store, rows: DataFrame) -> DataFrame:
    """Rows of regular files with their objects' parts, one each; only what is wanted is joined."""
    parts = store.table("objects").select(F.col("hash").alias("content_hash"), "part", "at", "payload")
    return rows.join(parts, "content_hash", "left")


def dressed(full: str, r: dict) -> int:
    """Owner, mode, attributes and times of a restored file; how many of them couldn't be set."""
    missed = 0
    link = r["type"] == 3
    steps = [lambda: os.lchown(full, r["uid"], r["gid"])]
    steps += [lambda k=k, v=v: os.setxattr(full, k, v, follow_symlinks=False) for k, v in unpacked(r["xattr"]) + unpacked(r["acl"])]
    if not link:
        steps.append(lambda: os.chmod(full, r["mode"] & 0o7777))
    stamp = r["mtime_sec"] * 10**9 + (r["mtime_nsec"] or 0)
    steps.append(lambda: os.utime(full, ns=(stamp, stamp), follow_symlinks=False))
    for step in steps:
        try:
            step()
        except OSError:
            missed += 1
    return missed


def restore(store: Store, snap: int, target: str, path: str = "") -> dict[str, int]:
    """Write a snapshot's files under ``target``, a folder that all executors share: files, bytes, warnings.

    All of it is done by tasks. Directories come first, then files, each by the task that has its parts in
    order, under another name that it then gives up, so a repeated task does no harm; then links, hard ones
    to the file of the same node's first name; last the directories' own metadata. Holes stay holes. Owners
    and attributes that may not be set are counted as warnings.
    """
    rows = contents(store, snap, path)
    regular = rows.where("type = 1 AND path = first")
    counted = "files long, bytes long, warnings long"

    def done(files: int, size: int, warnings: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (files, size, warnings)], ["files", "bytes", "warnings"])

    def directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("path").to_pylist():
                os.makedirs(os.path.join(target, p), exist_ok=True)
            yield done(0, 0, 0)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, full, out, tally = None, "", None, [0, 0, 0]

        def finish() -> None:
            if out is not None:
                out.truncate(last["size"])
                out.close()
                tally[2] += dressed(full + ".part", last)
                os.replace(full + ".part", full)
                tally[0], tally[1] = tally[0] + 1, tally[1] + last["size"]

        for batch in batches:
            for r in batch.to_pylist():
                if last is None or r["path"] != last["path"]:
                    finish()
                    full = os.path.join(target, r["path"])
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    out = open(full + ".part", "wb")  # noqa: SIM115
                if r["payload"] is None:
                    tally[2] += 1
                else:
                    out.seek(r["at"])
                    out.write(r["payload"])
                last = {k: v for k, v in r.items() if k != "payload"}
        finish()
        yield done(*tally)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = warnings = 0
        for batch in batches:
            for r in batch.to_pylist():
                full = os.path.join(target, r["path"])
                os.makedirs(os.path.dirname(full), exist_ok=True)
                if r["type"] == 2:
                    warnings += dressed(full, r)
                    continue
                if os.path.lexists(full):
                    os.remove(full)
                try:
                    if r["type"] == 3:
                        os.symlink(r["target"], full)
                        warnings += dressed(full, r)
                    elif r["type"] == 5:
                        os.mkfifo(full)
                        warnings += dressed(full, r)
                    else:
                        os.link(os.path.join(target, r["first"]), full)
                    files += 1
                except OSError:
                    warnings += 1
        yield done(files, 0, warnings)

    ordered = with_parts(store, regular).repartition("path").sortWithinPartitions("path", "part")
    total = {"files": 0, "bytes": 0, "warnings": 0}
    steps = ((rows.where("type = 2"), directories), (ordered, write), (rows.where("type IN (3, 5) OR (type = 1 AND path <> first)"), others), (rows.where("type = 2"), others))
    for df, step in steps:
        row = df.mapInArrow(step, counted).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in total]).first()
        total = {k: v + row[k] for k, v in total.items()}
    return total


def export_tar(store: Store, snap: int, file: str) -> int:
    """A gzipped TAR of a snapshot, on the driver; rows come a partition at a time, large files part by part."""
    n, rows = 0, contents(store, snap)
    whole = with_parts(store, rows.where("type = 1 AND path = first"))
    every = whole.unionByName(rows.where("type <> 1 OR path <> first"), allowMissingColumns=True)
    with tarfile.open(file, "w:gz") as tar, tempfile.TemporaryFile() as held:
        info = None

        def add() -> None:
            nonlocal n
            if info is not None:
                held.truncate(info.size)
                held.seek(0)
                tar.addfile(info, held if info.isreg() else None)
                n += 1

        for r in every.orderBy(F.col("type") == 1, F.col("path") != F.col("first"), "path", "part").toLocalIterator(prefetchPartitions=True):
            if info is None or info.name != r["path"]:
                add()
                info = tarfile.TarInfo(r["path"])
                info.mode, info.mtime, info.uid, info.gid = r["mode"] & 0o7777, r["mtime_sec"], r["uid"], r["gid"]
                held.seek(0)
                held.truncate()
                if r["type"] == 2:
                    info.type = tarfile.DIRTYPE
                elif r["type"] == 3:
                    info.type, info.linkname = tarfile.SYMTYPE, r["target"]
                elif r["type"] == 5:
                    info.type = tarfile.FIFOTYPE
                elif r["type"] == 1 and r["path"] != r["first"]:
                    info.type, info.linkname = tarfile.LNKTYPE, r["first"]
                elif r["type"] != 1:
                    info = None
                    continue
                else:
                    info.size = r["size"]
            if info.isreg() and r["payload"] is not None:
                held.seek(r["at"])
                held.write(r["payload"])
        add()
    return n


def export_bundle(store: Store, folder: str, snap: int | None = None) -> None:
    """All that a snapshot, or the repository, needs, as Parquet tables in ``folder``."""
    if snap is not None:
        store._check(snap)
    snaps = store.ids if snap is None else [snap]
    for name in BY_SNAPSHOT:
        store._of(name, snaps).write.parquet(f"{folder}/{name}")
    store.snapshots().where(F.col("snap_id").isin(snaps)).write.parquet(f"{folder}/snapshots")
    parts = [c.split()[0] for c in PART.split(", ")]
    store.table("objects").join(objects.live(store._of("nodes", snaps)), "hash", "left_semi").select(*parts).write.parquet(f"{folder}/objects")


def verify_bundle(store: Store, folder: str) -> tuple[int, int]:
    """Objects of a bundle, and those of which a part has another digest or isn't there, or that nodes need and aren't."""
    o = store.spark.read.schema(PART).parquet(f"{folder}/objects")
    nodes = store.spark.read.schema(SCHEMAS["nodes"]).parquet(f"{folder}/nodes")
    wrong = (F.sha2("payload", 256) != F.col("digest")) | ((F.col("parts") == 1) & (F.col("type") != 4) & (F.col("digest") != F.col("hash")))
    found = o.groupBy("hash").agg(F.max(wrong).alias("wrong"), F.countDistinct("part").alias("have"), F.max("parts").alias("parts"))
    bad = found.where("wrong OR have < parts").count()
    return found.count(), bad + objects.live(nodes).join(o.select("hash"), "hash", "left_anti").count()


def import_bundle(store: Store, folder: str, dry_run: bool = False, move_head: bool = True) -> dict[str, int]:
    """Bring a verified bundle in: objects that are new, then snapshots that are, then HEAD.

    A snapshot is known by an identity of its own, not by its number: one whose number is taken here by
    another gets the next free one.
    """
    import json
    import uuid

    total, bad = verify_bundle(store, folder)
    if bad:
        raise StoreError(f"{bad} objects of the bundle are damaged or missing")
    read = lambda name: store.spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")
    have = {r["uid"] for r in store.snapshots().select("uid").collect()}
    headers = [json.loads(x) for x in read("snapshots").orderBy("snap_id").toJSON().collect()]  # the snapshots of one bundle
    new = [h for h in headers if h["uid"] not in have]
    fresh = store.spark.read.schema(PART).parquet(f"{folder}/objects").join(store.table("objects").select("hash").distinct(), "hash", "left_anti")
    out = {"objects": total, "new_objects": fresh.select("hash").distinct().count(), "snapshots": len(new)}
    if not dry_run:
        if out["new_objects"]:
            name = f"loose-{uuid.uuid4().hex}"
            store._write_parts(fresh, name)
            now = store.manifest
            store._put("manifest.json", json.dumps(now | {"loose": [*now["loose"], name], "version": now["version"] + 1}))
        taken = []
        for h in new:
            old = h["snap_id"]
            snap = old if old not in store.ids and old > int(store._get("last") or 0) else store._next()
            for name in BY_SNAPSHOT:
                store._write(name, snap, read(name).where(F.col("snap_id") == old).drop("snap_id"))
            store._put("last", str(max(snap, int(store._get("last") or 0))))
            store._put(f"snapshots/{snap}.json", json.dumps(h | {"snap_id": snap}))
            taken.append(snap)
        if taken and move_head:
            store._put("HEAD", str(max(store.head, *taken)))
    return out
