"""Commands: ``python -m siltstone.cli REPOSITORY COMMAND ...``."""

from __future__ import annotations

import argparse
import getpass
import json
import sys
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltstone import api, tasks
from siltstone.operators import packs
from siltstone.sources import transfer
from siltstone.sources.store import Store, StoreError

COMMANDS = {
    "init": [],
    "run": ["source?", "--exclude=", "--one-file-system", "--no-policy"],
    "list": [],
    "ls": ["ref", "path?", "--recursive", "--type=", "--glob="],
    "cat": ["ref", "path"],
    "diff": ["old", "new"],
    "search": ["needle", "--ref="],
    "grep": ["ref", "pattern", "path?"],
    "restore": ["ref", "target", "path?"],
    "export": ["file", "--ref=", "--tar"],
    "import": ["file", "--dry-run", "--no-head"],
    "bundle": ["file"],
    "tag": ["action", "name?", "value?", "--preserve"],
    "note": ["ref", "text?"],
    "policy": ["change*"],
    "snapshot": ["action", "ref", "--force", "--no-gc"],
    "gc": [],
    "pack": [],
    "merge": [],
    "reindex": [],
    "reindex-snaps": [],
    "gfs": ["--dry-run"],
    "prune": ["--dry-run"],
    "verify": ["--repair"],
    "stats": [],
    "journal": ["--limit="],
    "api": ["action", "params?"],
}
LOGGED = {"run", "restore", "import", "gc", "gfs", "prune", "pack", "merge", "snapshot"}
#: Commands that change the repository, and those that it mustn't change under.
WRITERS = LOGGED - {"restore"} | {"tag", "note", "policy", "reindex", "reindex-snaps"}
READERS = {"restore", "export"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    top.add_argument("repository")
    sub = top.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        p = sub.add_parser(name)
        for a in arguments:
            if a.startswith("--"):
                p.add_argument(a.rstrip("="), **({"default": ""} if a.endswith("=") else {"action": "store_true"}))
            elif a[-1] in "?*":
                p.add_argument(a[:-1], nargs=a[-1], **({"default": ""} if a[-1] == "?" else {}))
            else:
                p.add_argument(a)
    return top


def execute(spark: SparkSession, a: argparse.Namespace) -> object:
    """What a command prints: rows, a value, bytes, or nothing."""
    if a.command == "init":
        Store.init(spark, a.repository)
        return None
    s = Store.open(spark, a.repository)
    ref = lambda x: s.resolve(x or "HEAD")
    match a.command:
        case "run":
            return tasks._run(s, {"source": source(s, a), "exclude": [x for x in a.exclude.split(",") if x], "after": not a.no_policy, "one": a.one_file_system})
        case "list":
            return s.snapshots().orderBy("snap_id")
        case "ls":
            return s.ls(ref(a.ref), a.path, a.recursive, a.type, a.glob)
        case "cat":
            return s.cat(ref(a.ref), a.path)
        case "diff":
            return s.diff(ref(a.old), ref(a.new))
        case "search":
            return s.search(a.needle, ref(a.ref) if a.ref else None)
        case "grep":
            return s.grep(ref(a.ref), a.pattern, a.path)
        case "restore":
            return transfer.restore(s, ref(a.ref), a.target, a.path)
        case "export" if a.tar:
            return {"entries": transfer.export_tar(s, ref(a.ref), a.file)}
        case "export":
            return transfer.export_bundle(s, a.file, s.resolve(a.ref) if a.ref else None)
        case "import":
            return transfer.import_bundle(s, a.file, a.dry_run, not a.no_head)
        case "bundle":
            return dict(zip(("objects", "bad"), transfer.verify_bundle(s, a.file), strict=True))
        case "tag":
            match a.action:
                case "set":
                    return s.tag(a.name, ref(a.value), a.preserve)
                case "delete":
                    return s.untag(a.name)
                case "rename":
                    return s.rename_tag(a.name, a.value)
            return s.tags()
        case "note":
            return s.note(ref(a.ref), a.text or None)
        case "policy":
            if a.change:
                s.save_policy({k: json.loads(v) for k, v in (c.split("=", 1) for c in a.change)})
            return s.policy
        case "snapshot":
            return s.delete(ref(a.ref), a.force, collect=not a.no_gc)
        case "gc":
            return dict(zip(("kept", "deleted"), s.gc(), strict=True))
        case "gfs" | "prune":
            return {"pruned": s.prune(dry_run=a.dry_run)}
        case "pack":
            return s.pack()
        case "merge":
            return {"merged": s.merge(force=True)}
        case "reindex":
            return packs.fanout(s.entries()).agg(F.max("cumulative").alias("entries"))
        case "reindex-snaps":
            return {"built": s.reindex()}
        case "verify":
            if a.repair:
                with s.lock():
                    print(json.dumps(s.repair()), file=sys.stderr)
            return s.verify().groupBy("status").agg(F.count("*").alias("n"))
        case "stats":
            return s.stats()
        case "journal":
            return s.journal().orderBy(F.col("timestamp").desc()).limit(int(a.limit or 100))
        case "api":
            return api.call(s, a.action, json.loads(a.params or "{}"))


def source(s: Store, a: argparse.Namespace) -> str:
    """The folder to scan, as given or as the policy has it."""
    found = a.source or next(iter(s.policy["paths"]), "")
    if not found:
        raise StoreError("no folder to scan")
    return found


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("siltstone").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    op, began = uuid.uuid4().hex, time.time()
    result, error = "failed", "interrupted"
    try:
        if a.command in LOGGED:
            Store.open(spark, a.repository).log(op, "started", operation=a.command, source="cli", user=getpass.getuser())
        if a.command in WRITERS or a.command in READERS:
            with Store.open(spark, a.repository).lock(shared=a.command in READERS):
                out = execute(spark, a)
        else:
            out = execute(spark, a)
        if hasattr(out, "toJSON"):
            for line in out.toJSON().toLocalIterator():
                print(line)
        elif isinstance(out, bytes):
            sys.stdout.buffer.write(out)
        elif out is not None:
            print(json.dumps(out))
        result, error = "success", None
    except StoreError as e:
        print(f"siltstone: {e}", file=sys.stderr)
        error = str(e)
    except BaseException as e:  # an operation that failed must not look unfinished
        error = f"{type(e).__name__}: {e}"[:500]
        raise
    finally:
        if a.command in LOGGED:
            try:
                Store.open(spark, a.repository).log(op, "completed", result=result, error=error, duration_ms=int(1000 * (time.time() - began)))
            except StoreError:
                pass
    return int(result != "success")


if __name__ == "__main__":
    sys.exit(main())
