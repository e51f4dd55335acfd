"""Requests by name: ``call(store, action, params)`` gives what a JSON interface answers.

Lists are whole unless ``limit`` is given, or ``offset``: then they are pages, {"rows", "has_more"}. Actions on
objects, packs and the journal give pages always, as their tables have no bound.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import tasks
from siltstone.functions.codecs import parity_size
from siltstone.functions.text import pack_number, pack_path
from siltstone.operators import diff as d
from siltstone.operators import journal as j
from siltstone.operators import objects as o
from siltstone.operators import packs, retention, tree
from siltstone.sources.store import Store, StoreError

HASH = re.compile(r"[0-9a-fA-F]{64}")


def rows(df: DataFrame) -> list[dict]:
    """All rows, a partition at a time."""
    return [json.loads(r) for r in df.toJSON().toLocalIterator()]


def page(df: DataFrame, p: dict, default: int, most: int = 5000) -> dict:
    n, at = min(int(p.get("limit", default)), most), int(p.get("offset", 0))
    found = rows(df.offset(at).limit(n + 1))
    return {"rows": found[:n], "has_more": len(found) > n, "offset": at, "limit": n}


def listed(df: DataFrame, p: dict) -> list[dict] | dict:
    return page(df, p, 5000, 1 << 30) if "limit" in p or "offset" in p else rows(df)


def _hash(p: dict) -> str:
    if not HASH.fullmatch(p["hash"]):
        raise StoreError("a hash has 64 hexadecimal digits")
    return p["hash"].lower()


def _object(store: Store, p: dict) -> DataFrame:
    return store.table("objects").where(F.col("hash") == _hash(p))


def _located(store: Store, p: dict) -> list[dict]:
    """Where an object is, loose before packed."""
    found = _object(store, p).groupBy("hash", "storage", "pack_num").agg(F.max("type").alias("type"), F.max("size").alias("size"), F.sum(F.octet_length("payload")).alias("stored"), F.max("dat_offset").alias("dat_offset"))
    return rows(found.orderBy("storage").limit(1))


def _content(store: Store, p: dict) -> dict:
    most = int(p.get("max_bytes", 65536))
    out, size = bytearray(), None
    for r in _object(store, p).where(F.col("at") < most).select("at", "size", F.substring("payload", 1, most).alias("x")).orderBy("part").toLocalIterator():
        out += b"\0" * (r["at"] - len(out)) + bytes(r["x"])
        size = r["size"]
    if size is None:
        raise StoreError("no such object")
    out = (out + b"\0" * (min(most, size) - len(out)))[:most]
    return {"content": base64.b64encode(bytes(out)).decode(), "size": size, "truncated": size > most}


def _layout(store: Store, p: dict) -> dict:
    """An object's parts: where each lies in it, and the bytes of its payload and parity."""
    found = _object(store, p).orderBy("part").select("type", "size", "storage", "part", "at", F.octet_length("payload").alias("payload"), F.octet_length("parity").alias("parity"))
    parts = rows(found)
    if not parts:
        raise StoreError("no such object")
    segments = [{"kind": kind, "part": r["part"], "offset": r["at"], "size": r[kind]} for r in parts for kind in ("payload", "parity") if r.get(kind)]
    expected = sum(parity_size(r.get("payload") or 0) for r in parts)
    return {k: parts[0][k] for k in ("type", "size", "storage")} | {"segments": segments, "parity_expected": expected}


def _children(store: Store, p: dict) -> list[dict] | dict:
    entries = store.dirents(int(p["id"]))
    x = tree.children(entries, store.nodes(int(p["id"])), int(p.get("parent_node", 0)))
    return listed(tree.with_children_flag(x.select("snap_id", "node_id", "name", "type", "size"), entries).orderBy("name"), p)


#: Operations that change a repository.
WRITES = ("run", "gc", "gfs", "prune", "pack", "merge", "import", "snapshot")


def _journal(store: Store, p: dict) -> dict:
    entries = j.query(store.journal(), **{k: p.get(k) for k in ("operation", "result", "state", "since")})
    if p.get("kind"):
        writes = F.col("operation").isin(*WRITES)
        entries = entries.where(writes if p["kind"] == "write" else ~writes)
    unfinished = store.journal().where("state = 'started'").join(store.journal().where("state = 'completed'").select("op_id"), "op_id", "left_anti").count()
    return {**page(entries.orderBy(F.col("timestamp").desc(), "op_id"), p, 100), "orphans": unfinished}


#: Orders of a diff, by name.
DIFF_ORDERS = {
    "path": ["path"], "change": ["change", "path"], "delta": [F.desc, "delta", "path"], "old_size": [F.desc, "old_size", "path"], "new_size": [F.desc, "new_size", "path"],
}


def _diff(store: Store, p: dict) -> list[dict] | dict:
    """Changes with sizes: all, or those of some kinds (``change``: letters), by path or as ``sort`` says."""
    order = p.get("sort", "path")
    if order not in DIFF_ORDERS:
        raise StoreError(f"no order {order!r}")
    x = d.diff(store.files(int(p["id1"])), store.files(int(p["id2"]))).withColumn("delta", d.size_delta())
    if p.get("change"):
        x = x.where(F.col("change").isin(list(p["change"])))
    falling, *keys = DIFF_ORDERS[order] if order in ("delta", "old_size", "new_size") else [None, *DIFF_ORDERS[order]]
    by = [falling(keys[0]), *keys[1:]] if falling else keys
    return listed(x.select("change", "path", "old_size", "new_size", "delta").orderBy(*by), p)


def _list(store: Store, p: dict) -> list[dict] | dict:
    """Snapshots with their tags, the newest marked: all, or those of a retention tier, by id or as ``sort`` says."""
    tags: dict[int, list[str]] = {}
    for t in store.tags():
        tags.setdefault(t["snap_id"], []).append(t["name"])
    known = store.snapshots()
    if p.get("tier"):
        bits = dict(retention.TIERS)
        if p["tier"] not in bits:
            raise StoreError(f"no tier {p['tier']!r}")
        known = known.where(F.col("gfs_flags").bitwiseAND(bits[p["tier"]]) != 0)
    key = p.get("sort", "snap_id")
    if key not in known.columns:
        raise StoreError(f"no order {key!r}")
    found, head = listed(known.orderBy(F.desc(key) if p.get("descending") else F.asc(key), "snap_id"), p), store.head
    for r in found["rows"] if isinstance(found, dict) else found:
        r |= {"tags": sorted(tags.get(r["snap_id"], [])), "is_head": r["snap_id"] == head}
    return found


def _entries(store: Store, p: dict, order: str) -> dict:
    number = pack_number(p["name"])
    if number is None:
        raise StoreError(f"no name of a pack: {p['name']!r}")
    if str(number) not in store.manifest["packs"]:
        raise StoreError(f"no pack {p['name']}")
    found = store.entries().where(F.col("pack_num") == number)
    return {**page(found.orderBy(order), p, 5000), "count": found.count()}


def _scan(store: Store, p: dict) -> dict:
    meta = {r["pack_num"]: r["bytes"] for r in packs.meta(store.entries()).collect()} if store.manifest["packs"] else {}  # a row per pack
    return {
        "snapshot_files": len(store.ids), "loose_objects": store.loose().where("part = 0").count(),
        "packs": [{"name": pack_path(n), "size": b} for n, b in sorted(meta.items())], "tag_count": len(store.tags()), "format": store._get("format"),
    }


def _by_type(df: DataFrame) -> list[dict]:
    """All four types, those without objects as zeros."""
    found = df.where("part = 0").groupBy("type").agg(F.count("*").alias("count"), F.sum("size").alias("bytes"), F.sum(F.when(F.col("storage") == "pack", 1).otherwise(0)).alias("packed"), F.sum(F.when(F.col("storage") == "loose", 1).otherwise(0)).alias("loose"))
    have = {r["type"]: r for r in rows(found)}
    return [have.get(t, {"type": t, "count": 0, "bytes": 0, "packed": 0, "loose": 0}) for t in range(1, 5)]


def _loose_stats(store: Store, p: dict) -> dict:
    loose = store.loose()
    skip = loose.where("part = 0 AND skip <> 0").agg(F.count("*").alias("count"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    types = _by_type(loose)
    return {"count": sum(t["count"] for t in types), "bytes": sum(t["bytes"] for t in types), "per_type": types, "skip": rows(skip)[0]}


def _loose_list(store: Store, p: dict) -> dict:
    found = store.loose().groupBy("hash").agg(F.max("type").alias("type"), F.max("size").alias("uncompressed_size"), F.sum(F.octet_length("payload")).alias("compressed_size"), F.max("skip").alias("skip"))
    return page(found.orderBy("hash"), p, 5000)


def _index(store: Store, p: dict) -> dict:
    """A page of the index over all packs, and how many hashes begin with each byte or a lower one."""
    e = store.entries()
    fanout = [r["cumulative"] for r in packs.fanout(e).orderBy("byte").collect()]  # 256 rows
    found = page(e.select("hash", "pack_num", "dat_offset", "entry_index").orderBy("hash"), p, 1000)
    return {"header": {"entry_count": fanout[-1], "pack_count": len(store.manifest["packs"])}, "fanout": fanout, **found}


def _search(store: Store, p: dict) -> dict:
    most = int(p.get("max_results", 500))
    found = rows(store.search(p["query"], int(p["id"]) if "id" in p else None, most + 1))
    return {"rows": found[:most], "count": len(found[:most]), "truncated": len(found) > most}


def _summary(store: Store, p: dict) -> dict:
    """Seven answers at once; one that fails is null."""
    out: dict = {}
    for name in ("stats", "list", "tags", "policy", "scan", "loose_stats", "repo_stats"):
        try:
            out[name] = ACTIONS[name](store, {})
        except Exception:  # whatever it was, the other answers count
            out[name] = None
    return out


ACTIONS: dict[str, Callable[[Store, dict], object]] = {
    "stats": lambda s, p: rows(s.stats())[0],
    "list": _list,
    "snap": lambda s, p: {"header": rows(s.snapshots().where(F.col("snap_id") == int(p["id"]))), "nodes": page(s.nodes(int(p["id"])).orderBy("node_id"), p, 1000)},
    "snap_header": lambda s, p: rows(s.snapshots().where(F.col("snap_id") == int(p["id"]))),
    "snap_dir_children": _children,
    "tags": lambda s, p: s.tags(),
    "tag_set": lambda s, p: s.tag(p["name"], int(p["snap_id"]), bool(p.get("preserve"))),
    "tag_delete": lambda s, p: s.untag(p["name"]),
    "tag_rename": lambda s, p: s.rename_tag(p["old"], p["new"]),
    "policy": lambda s, p: s.policy,
    "save_policy": lambda s, p: s.save_policy(p),
    "object_locate": _located,
    "object_content": _content,
    "object_layout": _layout,
    "object_refs": lambda s, p: listed(o.references(s.live_nodes()).where(F.col("hash") == _hash(p)).groupBy("snap_id", "node_id").agg(F.min("field").alias("field")).orderBy("snap_id", "node_id"), p),
    "diff": _diff,
    "ls": lambda s, p: listed(s.ls(int(p["id"]), p.get("path", ""), bool(p.get("recursive")), p.get("type", ""), p.get("glob", "")), p),
    "search": _search,
    "scan": _scan,
    "pack_entries": lambda s, p: _entries(s, p, "entry_index"),
    "pack_index": lambda s, p: _entries(s, p, "hash"),
    "all_pack_entries": lambda s, p: {**page(s.entries().orderBy("pack_num", "entry_index"), p, 5000), "count": s.entries().count()},
    "loose_list": _loose_list,
    "loose_stats": _loose_stats,
    "repo_stats": lambda s, p: {"per_type": _by_type(s.table("objects")), "packs": len(s.manifest["packs"])},
    "global_pack_index": _index,
    "repo_summary": _summary,
    "journal": _journal,
    "task_start": lambda s, p: {"task_id": tasks.start(s, p["command"], p.get("params"))},
    "task_list": lambda s, p: listed(tasks.table(s), p),
    "task_status": lambda s, p: tasks.status(s, p["task_id"]),
    "task_cancel": lambda s, p: tasks.cancel(s, p["task_id"]),
    "note_get": lambda s, p: s.note(int(p["snap_id"])),
    "note_set": lambda s, p: s.note(int(p["snap_id"]), p["text"]),
    "note_delete": lambda s, p: s.note(int(p["snap_id"]), ""),
    "note_list": lambda s, p: [{"snap_id": int(n), "text": s.note(int(n))} for n in s._names("notes")],
}


def call(store: Store, action: str, params: dict | None = None) -> dict:
    """{"ok": true, "data": ...} or {"ok": false, "error": ...}."""
    try:
        if action not in ACTIONS:
            raise StoreError(f"no action {action}")
        return {"ok": True, "data": ACTIONS[action](store, params or {})}
    except (StoreError, KeyError, ValueError) as e:
        return {"ok": False, "error": str(e)}
