"""The repository end to end: ingest, diff, listings, search, restore, bundles, retention, command line."""

import datetime
import json
import os
import socket
import tarfile

import pytest
from pyspark.sql import functions as F

from siltstone import api, cli
from siltstone.operators import retention
from siltstone.sources import filesystem, policy, transfer
from siltstone.sources.store import Store, StoreError


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, text in {"home/a.txt": "alpha\nbeta\n", "home/b.txt": "bravo", "home/sub/c.TXT": "alpha\nbeta\n", "etc/conf": "x\0y"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text.encode())
    os.symlink("a.txt", root / "home/link")
    os.mkfifo(root / "home/fifo")
    return root


def run(store, spark, tree, **options):
    filesystem.register(spark)
    return store.run(spark.read.format("tree").options(**options).load(str(tree)))


@pytest.fixture()
def store(spark, tmp_path, tree):
    s = Store.init(spark, f"file://{tmp_path}/repo")
    run(s, spark, tree)
    return s


def test_ingest_and_diff(spark, store, tree):
    assert store.head == 1 and store.table("objects").count() == 4
    assert run(store, spark, tree) == 1 and store.ids == [1]
    for folder in ("home", "etc"):  # entries come and go in both
        os.utime(tree / folder, (1, 1))
    run(store, spark, tree)
    store.delete(1)
    store = Store.init(spark, f"{store.root}-again")
    run(store, spark, tree)
    (tree / "home/a.txt").write_text("changed")
    (tree / "home/new.txt").write_text("bravo")
    os.chmod(tree / "home/b.txt", 0o600)
    os.remove(tree / "etc/conf")
    assert run(store, spark, tree) == 2
    assert [tuple(r) for r in store.diff(1, 2).collect()] == [("m", "etc"), ("D", "etc/conf"), ("m", "home"), ("M", "home/a.txt"), ("m", "home/b.txt"), ("A", "home/new.txt")]
    assert store.diff(2, 2).count() == 0
    shown = lambda **p: [r["path"] for r in api.call(store, "diff", {"id1": 1, "id2": 2, **p})["data"]]
    assert shown(change="AD") == ["etc/conf", "home/new.txt"] and shown(sort="delta")[0] == "home/new.txt" and shown(sort="change")[0] == "home/new.txt"
    assert not api.call(store, "diff", {"id1": 1, "id2": 2, "sort": "x"})["ok"]
    assert store.table("objects").count() == 5
    with pytest.raises(StoreError):
        store.diff(1, 9)
    assert {r.status: r.n for r in store.verify().groupBy("status").agg(F.count("*").alias("n")).collect()} == {"ok": 5}
    store.delete(1)
    assert store.gc() == (4, 1)
    assert [r.snap_id for r in store.snapshots().collect()] == [2]


def test_listings(store):
    names = lambda df: [r.name for r in df.collect()]
    assert names(store.ls(1, "home")) == ["a.txt", "b.txt", "fifo", "link", "sub"]
    assert names(store.ls(1, "/home/", recursive=True)) == ["a.txt", "b.txt", "fifo", "link", "sub", "sub/c.TXT"]
    assert names(store.ls(1, "", recursive=True, kind="d")) == ["etc", "home", "home/sub"]
    assert names(store.ls(1, "home", recursive=True, glob="*.TXT")) == ["sub/c.TXT"]
    assert names(store.ls(1, "home", kind="p")) == ["fifo"] and names(store.ls(1, "home", kind="l")) == ["link"]
    assert sorted(names(store.search(".txt"))) == ["a.txt", "b.txt", "c.TXT"]
    assert sorted(tuple(r) for r in store.grep(1, "^b[[:alpha:]]+a$").collect()) == [("home/a.txt", 2, "beta"), ("home/sub/c.TXT", 2, "beta")]
    assert store.cat(1, "home/b.txt") == b"bravo"
    for path in ("home", "home/none"):
        with pytest.raises(StoreError):
            store.cat(1, path)


def test_exclude(spark, tmp_path, tree):
    s = Store.init(spark, f"file://{tmp_path}/other")
    run(s, spark, tree, exclude="home/sub,etc")
    assert {r.path for r in s.files(1).collect()} == {"home", "home/a.txt", "home/b.txt", "home/link", "home/fifo"}


def test_restore_and_bundles(spark, store, tmp_path):
    assert transfer.restore(store, 1, str(tmp_path / "out")) == {"files": 6, "bytes": 30, "warnings": 0}
    assert (tmp_path / "out/home/sub/c.TXT").read_text() == "alpha\nbeta\n" and os.readlink(tmp_path / "out/home/link") == "a.txt"
    assert transfer.restore(store, 1, str(tmp_path / "part"), "home/sub")["files"] == 1
    assert transfer.export_tar(store, 1, str(tmp_path / "x.tgz")) == 9
    assert tarfile.open(tmp_path / "x.tgz").extractfile("home/b.txt").read() == b"bravo"
    bundle = f"file://{tmp_path}/bundle"
    transfer.export_bundle(store, bundle, 1)
    assert transfer.verify_bundle(store, bundle) == (4, 0)
    other = Store.init(spark, f"file://{tmp_path}/second")
    assert transfer.import_bundle(other, bundle, dry_run=True) == {"objects": 4, "new_objects": 4, "snapshots": 1}
    assert other.head == 0
    transfer.import_bundle(other, bundle)
    assert other.head == 1 and other.cat(1, "home/b.txt") == b"bravo"
    assert transfer.import_bundle(other, bundle) == {"objects": 4, "new_objects": 0, "snapshots": 0}
    third = Store.init(spark, f"file://{tmp_path}/third")
    run(third, spark, tmp_path / "out", exclude="etc")
    transfer.import_bundle(third, bundle)
    assert third.ids == [1, 2] and third.head == 2
    assert third.cat(2, "etc/conf") == b"x\0y" and third.paths(1).where("path = 'etc'").count() == 0
    damaged = spark.read.parquet(f"{bundle}/objects").withColumn("payload", F.lit(b"?"))
    damaged.write.parquet(f"file://{tmp_path}/bad/objects")
    spark.read.parquet(f"{bundle}/nodes").write.parquet(f"file://{tmp_path}/bad/nodes")
    with pytest.raises(StoreError):
        transfer.import_bundle(other, f"file://{tmp_path}/bad")


def test_tags_notes_policy(store):
    store.tag("v1.0", 1, preserve=True)
    store.tag("other", 1)
    for bad in ("a b", "", "x/y"):
        with pytest.raises(StoreError):
            store.tag(bad, 1)
    with pytest.raises(StoreError):
        store.rename_tag("other", "v1.0")
    store.rename_tag("other", "again")
    assert [t["name"] for t in store.tags()] == ["again", "v1.0"] and store.resolve("v1.0") == store.resolve("HEAD") == store.resolve("1") == 1
    with pytest.raises(StoreError):
        store.delete(1)
    assert store.note(1, "two\nlines \n") == "two\nlines" and store.note(1) == "two\nlines"
    store.note(1, "  ")
    assert store.note(1) == ""
    store.save_policy({"keep_daily": 3, "keep_weekly": -2, "paths": ["/a"]})
    assert store.policy["keep_daily"] == 3 and store.policy["keep_weekly"] == 0 and store.policy["paths"] == ["/a"]
    assert policy.effective("not toml [") == policy.DEFAULTS


def test_command_line(spark, tmp_path, tree, capfd):
    repo = f"file://{tmp_path}/cli"
    do = lambda *a: cli.main([repo, *a], spark)
    assert do("list") == 1 and do("init") == 0 and do("init") == 1
    assert do("run", str(tree)) == 0 and do("tag", "set", "t", "HEAD") == 0
    capfd.readouterr()
    assert do("ls", "t", "home", "--glob", "b*") == 0
    assert json.loads(capfd.readouterr().out)["name"] == "b.txt"
    assert do("journal") == 0
    assert sorted(json.loads(x)["state"] for x in capfd.readouterr().out.splitlines()) == ["completed", "started"]
    assert do("cat", "HEAD", "home/b.txt") == 0 and capfd.readouterr().out == "bravo"
    assert do("cat", "HEAD", "none") == 1


def test_interface(store):
    assert api.call(store, "stats")["data"]["snapshots"] == 1
    assert api.call(store, "list", {"tier": "daily"})["data"] == [] and not api.call(store, "list", {"tier": "hourly"})["ok"] and not api.call(store, "list", {"sort": "x"})["ok"]
    assert api.call(store, "list", {"sort": "logical_bytes", "descending": True})["data"][0]["is_head"] is True
    store.log("a", "started", operation="run")
    store.log("b", "started", operation="restore")
    assert [[r["op_id"] for r in api.call(store, "journal", {"kind": k})["data"]["rows"]] for k in ("write", "read")] == [["a"], ["b"]]
    assert api.call(store, "nothing")["ok"] is False and api.call(store, "diff", {"id1": 1, "id2": 7})["ok"] is False
    assert [r["name"] for r in api.call(store, "ls", {"id": 1, "path": "home", "type": "f"})["data"]] == ["a.txt", "b.txt"]
    top = api.call(store, "snap_dir_children", {"id": 1})["data"]
    assert [(r["name"], r["has_children"]) for r in top] == [("etc", True), ("home", True)]
    digest = store.files(1).where("path = 'home/b.txt'").first()["content_hash"]
    assert api.call(store, "object_content", {"hash": digest, "max_bytes": 3})["data"] == {"content": "YnJh", "size": 5, "truncated": True}
    assert len(api.call(store, "object_refs", {"hash": digest})["data"]) == 1
    summary = api.call(store, "repo_summary")["data"]
    assert set(summary) == {"stats", "list", "tags", "policy", "scan", "loose_stats", "repo_stats"} and None not in summary.values()
    store.pack()
    assert api.call(store, "global_pack_index", {"limit": 2})["data"]["has_more"] is True
    names = [r["name"] for r in api.call(store, "ls", {"id": 1, "recursive": True, "limit": 3})["data"]["rows"]]
    assert len(names) == 3 and api.call(store, "ls", {"id": 1, "recursive": True, "limit": 3, "offset": 3})["data"]["has_more"] is True
    index = api.call(store, "global_pack_index")["data"]
    assert index["header"] == {"entry_count": 4, "pack_count": 1} and len(index["fanout"]) == 256 and [r["entry_index"] for r in index["rows"]] == [0, 1, 2, 3]
    entries = api.call(store, "pack_entries", {"name": "pack-00000001.dat"})["data"]
    assert entries["count"] == 4 and api.call(store, "pack_index", {"name": "pack-00000001.idx"})["data"]["rows"] == sorted(entries["rows"], key=lambda r: r["hash"])
    assert not api.call(store, "pack_entries", {"name": "../x"})["ok"] and not api.call(store, "pack_entries", {"name": "pack-00000009.dat"})["ok"]
    assert api.call(store, "all_pack_entries")["data"]["count"] == 4 and api.call(store, "loose_list")["data"]["rows"] == []
    assert api.call(store, "loose_stats")["data"]["count"] == 0 and [t["packed"] for t in api.call(store, "repo_stats")["data"]["per_type"]] == [4, 0, 0, 0]
    layout = api.call(store, "object_layout", {"hash": digest})["data"]
    assert layout["storage"] == "pack" and [(x["kind"], x["size"]) for x in layout["segments"]] == [("payload", 5), ("parity", 1024)]
    assert api.call(store, "object_locate", {"hash": digest})["data"][0]["pack_num"] == 1 and not api.call(store, "object_locate", {"hash": "x" * 64})["ok"]
    assert api.call(store, "search", {"query": ".txt", "max_results": 2})["data"]["truncated"] is True
    assert api.call(store, "scan")["data"]["packs"] == [{"name": "pack-00000001.dat", "size": 24}]


def test_tasks_and_lock(store, tree):
    from siltstone import tasks

    with store.lock(shared=True) as one, store.lock(shared=True):
        with pytest.raises(StoreError), store.lock():
            pass
        with pytest.raises(StoreError):
            one.upgrade()
    with store.lock(shared=True) as one:
        one.upgrade()
        with pytest.raises(StoreError), store.lock(shared=True):
            pass
        one.downgrade()
        with store.lock(shared=True):
            pass
    store._put("locks/exclusive", json.dumps({"host": socket.gethostname(), "pid": 2**22 + 1}))
    with store.lock():
        with pytest.raises(StoreError), store.lock():
            pass
        held = tasks.start(store, "verify")
        assert tasks.status(store, held)["state"] == "running"
    tasks.wait(held, 120)
    assert tasks.status(store, held)["state"] == "completed" and json.loads(tasks.status(store, held)["result"]) == {"ok": 4}
    done = api.call(store, "task_start", {"command": "gc"})["data"]["task_id"]
    tasks.wait(done, 120)
    assert [r["state"] for r in api.call(store, "task_list")["data"]] == ["completed", "completed"]
    dead = {"task_id": "dead", "command": "gc", "state": "running", "started": 1.0, "host": socket.gethostname(), "pid": 2**22 + 1}
    store._put("tasks/dead.json", json.dumps(dead))
    store._put("tasks/far.json", json.dumps(dead | {"task_id": "far", "host": "elsewhere", "seen": 1.0}))
    assert tasks.status(store, "dead")["state"] == tasks.status(store, "far")["state"] == "failed"
    again = [api.call(store, "task_start", {"command": "run", "params": {"source": str(tree)}}), api.call(store, "task_start", {"command": "restore", "params": {"target": str(tree.parent / "back")}})]
    for t in again:
        tasks.wait(t["data"]["task_id"], 240)
        assert tasks.status(store, t["data"]["task_id"])["state"] == "completed", tasks.status(store, t["data"]["task_id"])
    assert (tree.parent / "back/home/b.txt").read_text() == "bravo" and store.loose().count() == 0
    assert api.call(store, "task_start", {"command": "nothing"})["ok"] is False and api.call(store, "task_status", {"task_id": "x"})["ok"] is False


def test_retention_cases(spark):
    at = lambda *x: datetime.datetime(*x)

    def elected(times):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(times, 1)], "snap_id long, created timestamp_ntz")
        return {r.snap_id: r.elected for r in retention.elect(df).collect() if r.elected}

    monday = [at(2026, 3, 23, 11), at(2026, 3, 23, 12)]
    assert elected(monday) == {}
    assert elected([*monday, at(2026, 3, 24, 11)]) == {2: 1}
    assert elected([at(2026, 3, 29, 9), at(2026, 3, 30, 9)]) == {1: 3}
    assert elected([at(2026, 3, 25, 9), at(2026, 4, 20, 9)]) == {1: 7}
    assert elected([at(2025, 12, 30, 9), at(2026, 1, 9, 9)]) == {1: 15}


def test_retention_against_a_loop(spark):
    """Elections and pruning by plain Python over an irregular history."""
    import random

    rng = random.Random(5)
    t, times = at0 = datetime.datetime(2023, 11, 2, 8), []
    t = datetime.datetime(2023, 11, 2, 8)
    for _ in range(500):
        t += datetime.timedelta(hours=rng.choice([1, 5, 24, 24, 30, 90]))
        times.append(t)
    df = spark.createDataFrame([(i, t, i % 37 == 0) for i, t in enumerate(times, 1)], "snap_id long, created timestamp_ntz, preserved boolean")
    end = {"d": lambda d: d, "w": lambda d: d + datetime.timedelta(6 - d.weekday()), "m": lambda d: (d.replace(day=28) + datetime.timedelta(4)).replace(day=1) - datetime.timedelta(1), "y": lambda d: d.replace(month=12, day=31)}
    today, flags, pool = times[-1].date(), dict.fromkeys(range(1, 501), 0), list(range(1, 501))
    for bit, key in zip((1, 2, 4, 8), end.values(), strict=True):
        best = {}
        for i in pool:
            k = key(times[i - 1].date())
            if k < today and (k not in best or (times[i - 1], i) > (times[best[k] - 1], best[k])):
                best[k] = i
        pool = sorted(best.values())
        for i in pool:
            flags[i] |= bit
    found = retention.elect(df)
    assert {r.snap_id: r.elected for r in found.collect()} == flags
    for keep in (retention.Keep(), retention.Keep(5, 7, 4, 3, 1), retention.Keep(0, 2, 2, 2, 2), retention.Keep(1, 7, 4, 12, 0)):
        gone = set()
        start = max(500 - (keep.snaps - 1), 1) if keep.snaps else 1
        for i in range(1, 500):
            top = max((b for b in (1, 2, 4, 8) if flags[i] & b), default=0)
            rank = sum(1 for k in range(i + 1, 501) if max((b for b in (1, 2, 4, 8) if flags[k] & b), default=0) == top)
            n = {1: keep.daily, 2: keep.weekly, 4: keep.monthly, 8: keep.yearly}.get(top, 0)
            if not (top and (n == 0 or rank < n)) and i < start and i % 37:
                gone.add(i)
        out = retention.prune(found.select("snap_id", F.col("elected").alias("flags"), "preserved"), keep)
        assert {r.snap_id for r in out.where("pruned").collect()} == gone


def listing(store, snap):
    return sorted(r.path for r in store.files(snap).collect())


def test_ids_are_not_used_again(spark, store, tree):
    (tree / "home/new.txt").write_text("new")
    assert run(store, spark, tree) == 2
    store.tag("t", 2)
    with pytest.raises(StoreError):
        store.delete(2)
    store.delete(2, force=True)
    assert store.head == 1 and store.tags() == [] and store.ids == [1]
    assert run(store, spark, tree) == 3
    assert store.ids == [1, 3] and listing(store, 3) == sorted([*listing(store, 1), "home/new.txt"]) and store.nodes(3).count() == 10
    assert [tuple(r) for r in store.diff(1, 3).where("path LIKE '%new%'").collect()] == [("A", "home/new.txt")]


class Killed(BaseException):
    pass


def test_commands_that_die_between_two_writes(spark, store, tree, monkeypatch):
    """At whichever write a commit, a collection or a packing dies, what was there is, and a second try ends it."""
    before = listing(store, 1)
    step = {"left": 0}
    plain = {n: getattr(Store, n) for n in ("_put", "_write", "_write_parts", "_write_packs", "_settle", "sweep")}

    def dying(name):
        def call(self, *args, **kwargs):
            step["left"] -= 1
            if step["left"] == 0:
                raise Killed(name)
            return plain[name](self, *args, **kwargs)

        return call

    def killed(at, act):
        step["left"] = at
        for n in plain:
            monkeypatch.setattr(Store, n, dying(n))
        try:
            act()
            return False
        except Killed:
            return True
        finally:
            for n, f in plain.items():
                monkeypatch.setattr(Store, n, f)

    (tree / "home/late.txt").write_text("late")
    want = sorted([*before, "home/late.txt"])
    filesystem.register(spark)
    scan = spark.read.format("tree").load(str(tree))
    at, crashed = 1, 0
    while killed(at, lambda: store.run(scan)):
        again = Store.open(spark, store.root)
        assert listing(again, 1) == before and again.head in (1, 2) and all(listing(again, i) == want for i in again.ids if i > 1)
        at, crashed = at + 3, crashed + 1
    snap = store.run(scan)
    assert crashed >= 4 and listing(store, snap) == want and store.nodes(snap).count() == 10 and store.cat(snap, "home/late.txt") == b"late"
    for act in (lambda: store.delete(snap, force=True) if snap in store.ids else None, store.gc, store.pack):
        at = 1
        while killed(at, act):
            again = Store.open(spark, store.root)
            assert listing(again, 1) == before and {r.status for r in again.verify().collect()} == {"ok"}
            at += 3
    assert store.verify().where("status <> 'ok'").isEmpty() and store.table("objects").count() == 4 and store.loose().count() == 0
    assert store.sweep() == 0


def test_packs(spark, tmp_path, tree):
    s = Store.init(spark, f"file://{tmp_path}/packs")
    for i in range(20):
        (tree / f"home/f{i}").write_bytes(bytes([65 + i]) * 100)
    (tree / "home/noise").write_bytes(os.urandom(5000))
    run(s, spark, tree)
    out = s.pack(pack_bytes=300, large=4000)
    assert out["packed"] == 24 and out["skipped"] == 1 and out["packs"] > 2 and s.loose().count() == 1
    assert s.cat(1, "home/f3") == b"D" * 100 and s.cat(1, "home/b.txt") == b"bravo"
    rows = [(r.hash, r.pack_num, r.entry_index, r.dat_offset, r.compressed_size) for r in s.entries().orderBy("hash").collect()]
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)
    for number in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == number]
        assert [r[2] for r in own] == list(range(len(own))) and [r[3] for r in own] == [sum(x[4] for x in own[:k]) for k in range(len(own))]
    for i in range(10):
        os.remove(tree / f"home/f{i}")
    run(s, spark, tree)
    s.delete(1)
    assert s.gc() == (15, 10) and s.verify().where("status <> 'ok'").isEmpty()
    assert s.merge(pack_bytes=700) == 0  # not due
    merged = s.merge(pack_bytes=5000, force=True)
    assert merged >= 2 and s.entries().count() == 14 and s.verify().where("status <> 'ok'").isEmpty()
    assert s.stats().first()["packs"] == len(s.manifest["packs"]) and s.stats().first()["objects"] == 15


def test_repair(spark, store):
    """Damaged payloads, loose and packed, are put right by their parity; one that is beyond it is told."""
    for storage in ("loose", "pack"):
        if storage == "pack":
            store.pack()
        folder = next(iter(store.manifest["packs"].values())) if storage == "pack" else store.manifest["loose"][0]
        path = f"{store.root}/data/{folder}"
        rows = spark.read.parquet(path)
        flipped = F.when(F.col("payload") == F.lit(b"bravo"), F.lit(b"bravX")).otherwise(F.col("payload"))
        rows.withColumn("payload", flipped).write.parquet(f"{path}-bad", partitionBy="pack_num" if storage == "pack" else None)
        store._fs.delete(store._path(f"data/{folder}"), True)
        store._fs.rename(store._path(f"data/{folder}-bad"), store._path(f"data/{folder}"))
        assert store.verify().where("status = 'corrupt'").count() == 1
        with pytest.raises(StoreError):
            store.cat(1, "home/b.txt")
        assert store.repair() == {"repaired": 1, "corrupt": 0} and store.cat(1, "home/b.txt") == b"bravo"
    assert store.repair() == {"repaired": 0, "corrupt": 0}


def test_links_attributes_holes_and_parts(spark, tmp_path):
    root = tmp_path / "odd"
    (root / "d").mkdir(parents=True)
    (root / "d/one").write_bytes(b"shared")
    os.link(root / "d/one", root / "d/two")
    with open(root / "hole", "wb") as f:
        f.seek(3 << 20)
        f.write(b"end")
        f.truncate(5 << 20)
    (root / "large").write_bytes(bytes(range(256)) * 1000)
    (root / "empty").write_bytes(b"")
    tagged = True
    try:
        os.setxattr(root / "d/one", "user.colour", b"red")
    except OSError:
        tagged = False
    os.chmod(root / "d", 0o750)
    os.utime(root / "d", ns=(5, 1_600_000_000_123_456_789))
    s = Store.init(spark, f"file://{tmp_path}/odd-repo")
    assert run(s, spark, root, part_bytes=100_000) == 1
    rows = {r.path: r for r in s.files(1).collect()}
    assert rows["d/one"].node_id == rows["d/two"].node_id and rows["d/one"].link_count == 2 and s.nodes(1).count() == 5
    assert bool(rows["d/one"].xattr_hash) == tagged
    parts = s.table("objects").where(F.col("hash") == rows["large"].content_hash)
    assert parts.count() == 3 and s.cat(1, "large") == bytes(range(256)) * 1000
    kinds = {r["hash"]: r.type for r in s.table("objects").where("part = 0").collect()}
    stored = s.table("objects").where(F.col("hash") == rows["hole"].content_hash).agg(F.sum(F.octet_length("payload"))).first()[0]
    if kinds[rows["hole"].content_hash] == 4:  # the file system has holes
        assert stored < 1 << 20
    assert s.cat(1, "hole") == (root / "hole").read_bytes() and s.verify().where("status <> 'ok'").isEmpty()
    assert run(s, spark, root, part_bytes=100_000) == 1
    if tagged:
        os.setxattr(root / "d/one", "user.colour", b"blue")
        assert run(s, spark, root) == 2 and s.diff(1, 2).count() == 0
    s.pack()
    out = tmp_path / "odd-out"
    assert transfer.restore(s, s.head, str(out))["files"] == 5
    assert os.stat(out / "d/one").st_ino == os.stat(out / "d/two").st_ino and (out / "large").read_bytes() == (root / "large").read_bytes() and (out / "empty").read_bytes() == b""
    assert (out / "hole").read_bytes() == (root / "hole").read_bytes() and os.stat(out / "d").st_mode & 0o7777 == 0o750 and os.stat(out / "d").st_mtime_ns == 1_600_000_000_123_456_789
    assert not tagged or os.getxattr(out / "d/two", "user.colour") == b"blue"
    names = tarfile.open(tmp_path / "odd.tgz", "w:gz").close() or transfer.export_tar(s, s.head, str(tmp_path / "odd.tgz"))
    with tarfile.open(tmp_path / "odd.tgz") as tar:
        assert names == 6 and tar.extractfile("large").read() == (root / "large").read_bytes() and tar.getmember("d/two").linkname == "d/one"


def test_unreadable_and_reindex(spark, store, tree):
    rows = [("a", 1, 33188, 0, 0, 1, b"x", None, None), ("b", None, None, None, None, None, None, None, "denied")]
    s = Store.init(spark, f"{store.root}-few")
    assert s.run(spark.createDataFrame(rows, "path string, type long, mode long, uid long, gid long, mtime_sec long, payload binary, target string, error string")) == 1
    assert s.snapshots().first()["warnings"] == 1 and listing(s, 1) == ["a"]
    before = listing(store, 1)
    store._fs.delete(store._path("paths/snap_id=1"), True)
    assert listing(store, 1) == before and store.reindex() == [1] and store.reindex() == [] and listing(store, 1) == before


def test_after_run_and_crash_record(spark, tmp_path, tree, capfd, monkeypatch):
    repo = f"file://{tmp_path}/after"
    do = lambda *a: cli.main([repo, *a], spark)
    assert do("init") == 0 and do("policy", "verify_after=true") == 0 and do("run", str(tree)) == 0
    s = Store.open(spark, repo)
    assert s.loose().count() == 0 and s.entries().count() == 4 and '"missing": 0' in capfd.readouterr().out
    assert do("pack") == 0 and do("reindex") == 0 and do("reindex-snaps") == 0 and do("verify", "--repair") == 0 and do("run") == 1
    monkeypatch.setattr(Store, "gc", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        do("gc")
    ends = s.journal().where("state = 'completed'").select("op_id")
    assert s.journal().where("state = 'started'").join(ends, "op_id", "left_anti").isEmpty()
    assert s.journal().where("error LIKE 'ZeroDivisionError%'").count() == 1 and s._names("locks") == []
