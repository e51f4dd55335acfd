"""Background tasks: commands that run beside the caller, with their state as JSON in the repository.

Each runs in a thread of this driver with a job group of its own, by which it is cancelled. Commands that
change the repository wait for its lock. A task tells when it was last alive; one whose driver is gone, by its
process where that is on this machine, else by a heartbeat that is too old, is told as failed.
"""

from __future__ import annotations

import json
import os
import socket
import threading
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources import filesystem, transfer
from siltstone.sources.store import Store, StoreError, alive

#: Seconds between heartbeats, and after which a task without one is dead.
BEAT, DEAD = 10, 60


def _run(s: Store, p: dict) -> dict:
    filesystem.register(s.spark)
    reader = s.spark.read.format("tree").option("exclude", ",".join(p.get("exclude") or s.policy["exclude"])).option("one_file_system", str(bool(p.get("one"))).lower())
    before = s.head
    out = {"snapshot": s.run(reader.load(p["source"]))}
    return out | {"changed": out["snapshot"] != before} | (s.after_run() if p.get("after", True) else {})


COMMANDS: dict[str, Callable[[Store, dict], object]] = {
    "run": _run,
    "gc": lambda s, p: s.gc(),
    "pack": lambda s, p: s.pack(),
    "prune": lambda s, p: s.prune(dry_run=bool(p.get("dry_run"))),
    "verify": lambda s, p: ({"repair": s.repair()} if p.get("repair") else {}) | {r["status"]: r["n"] for r in s.verify().groupBy("status").agg(F.count("*").alias("n")).collect()},
    "restore": lambda s, p: transfer.restore(s, s.resolve(str(p.get("ref", "HEAD"))), p["target"], p.get("path", "")),
}
#: These only read, side by side.
READERS = {"restore"}
SCHEMA = "task_id string, command string, state string, started double, ended double, result string, error string, host string, pid long, seen double"
_running: dict[str, threading.Thread] = {}


def _write(store: Store, status: dict) -> None:
    store._put(f"tasks/{status['task_id']}.json", json.dumps(status | {"seen": time.time()}))


def start(store: Store, command: str, params: dict | None = None) -> str:
    """Begin a command; the id of its task."""
    if command not in COMMANDS:
        raise StoreError(f"no background command {command}")
    store._fs.mkdirs(store._path("tasks"))
    status = {"task_id": uuid.uuid4().hex, "command": command, "state": "running", "started": time.time(), "host": socket.gethostname(), "pid": os.getpid()}
    _write(store, status)
    over, guard = threading.Event(), threading.Lock()

    def beat() -> None:
        while not over.wait(BEAT):
            with guard:
                if not over.is_set():
                    _write(store, status)

    def work() -> None:
        context = store.spark.sparkContext
        context.setJobGroup(status["task_id"], command, interruptOnCancel=True)
        end = dict(status)
        try:
            with store.lock(wait=True, shared=command in READERS):
                end["result"] = json.dumps(COMMANDS[command](store, params or {}))
            end["state"] = "completed"
        except Exception as e:  # whatever it was, the status must tell
            end["state"], end["error"] = "failed", str(e)[:500]
        end["ended"] = time.time()
        with guard:
            over.set()
            _write(store, end)

    _running[status["task_id"]] = thread = InheritableThread(target=work, daemon=True)
    thread.start()
    threading.Thread(target=beat, daemon=True).start()
    return status["task_id"]


def wait(task_id: str, timeout: float | None = None) -> None:
    if task_id in _running:
        _running[task_id].join(timeout)


def _judged(found: dict, now: float) -> dict:
    """A status as it must be if its driver died."""
    if found["state"] == "running" and found["task_id"] not in _running:
        here = found.get("host") == socket.gethostname()
        if (here and not alive(int(found.get("pid") or 0))) or (not here and now - float(found.get("seen") or 0) > DEAD):
            return found | {"state": "failed", "error": "its driver is gone"}
    return found


def status(store: Store, task_id: str) -> dict:
    text = store._get(f"tasks/{task_id}.json")
    if text is None:
        raise StoreError(f"no task {task_id}")
    return _judged(json.loads(text), time.time())


def cancel(store: Store, task_id: str) -> None:
    status(store, task_id)
    store.spark.sparkContext.cancelJobGroup(task_id)


def table(store: Store) -> DataFrame:
    """All tasks, running ones first, then the newest."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    found = [status(store, n.removesuffix(".json")) for n in store._names("tasks")]
    return store.spark.createDataFrame([tuple(x.get(c) for c in names) for x in found], SCHEMA).orderBy(F.col("state") != "running", F.col("started").desc())
