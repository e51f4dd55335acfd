"""Codec vectors, patterns, and operators on literal rows."""

import base64
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import codecs, text
from siltstone.operators import diff, journal, objects, packs, tree
from siltstone.streaming import journal as stream


def test_crc32c():
    # Published check values.
    for data, crc in ((b"", 0), (b"123456789", 0xE3069283), (b"\0" * 32, 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43), (bytes(range(32)), 0x46DD794E)):
        assert codecs.crc32c(data) == crc
        assert codecs.crc32c(data[5:], codecs.crc32c(data[:5])) == crc


def test_fnv():
    # Published check values.
    assert codecs.fnv1a(b"") == 0xCBF29CE484222325 and codecs.fnv1a(b"a") == 0xAF63DC4C8601EC8C and codecs.fnv1a(b"foobar") == 0x85944171F73967E8


@pytest.mark.parametrize("n", [1, 255, 256, 257, 1000])
def test_xor_parity_repairs_any_byte(n):
    data = random.Random(n).randbytes(n)
    parity, crc = codecs.xor_parity(data)
    for at in range(n):
        broken = data[:at] + bytes([data[at] ^ 0x5A]) + data[at + 1 :]
        assert codecs.xor_repair(broken, parity, crc) == data
    assert codecs.xor_repair(data, parity, crc) == data
    if n > 2:
        assert codecs.xor_repair(bytes([data[0] ^ 1, data[1] ^ 1]) + data[2:], parity, crc) is None


def test_reed_solomon():
    rng = random.Random(2)
    data = rng.randbytes(codecs.RS_K)
    word = data + codecs.rs_encode(np.frombuffer(data, np.uint8)[None])[0].tobytes()
    for wrong in range(9):
        broken = bytearray(word)
        for at in rng.sample(range(codecs.RS_N), wrong):
            broken[at] ^= rng.randrange(1, 256)
        assert codecs.rs_decode(bytes(broken)) == word
    broken = bytearray(word)
    for at in rng.sample(range(codecs.RS_N), 30):
        broken[at] ^= rng.randrange(1, 256)
    assert codecs.rs_decode(bytes(broken)) != word


@pytest.mark.parametrize("n", [1, 15296, 15297, 40000])
def test_interleaved_parity_repairs_a_burst(n):
    data = random.Random(n).randbytes(n)
    parity = codecs.interleaved_parity(data)
    assert len(parity) == codecs.parity_size(n) == -(-n // 15296) * 1024
    at = random.Random(1).randrange(max(1, n - 512))
    broken = data[:at] + bytes(b ^ 0xFF for b in data[at : at + 512]) + data[at + 512 :]
    assert codecs.interleaved_repair(broken, parity) == data


def test_column_function(spark):
    df = spark.createDataFrame([(b"123456789",), (None,)], "x binary").repartition(1)
    assert [r[0] for r in df.select(codecs.column_function(codecs.crc32c, "long")("x")).collect()] == [0xE3069283, None]


def test_patterns(spark):
    df = spark.createDataFrame([("a/b.txt",), (".x",), ("a[1]",), ("İ",), ("line\nbreak.txt",)], "x string")
    found = lambda glob: [r.x for r in df.where(F.col("x").rlike(text.glob_regex(glob))).collect()]
    assert found("*.txt") == ["a/b.txt", "line\nbreak.txt"] and found("?x") == [".x"] and found("a\\[1\\]") == ["a[1]"] and found("[!a.l]*") == ["İ"] and found("[]a]*") == ["a/b.txt", "a[1]"]
    assert df.where(text.contains_ascii(F.col("x"), "B.TX")).count() == 1 and df.where(text.contains_ascii(F.col("x"), "i̇")).count() == 0 and df.where(text.contains_ascii(F.col("x"), "")).count() == 5
    assert text.extended_regex("^[[:alpha:]]+$") == r"^[\p{Alpha}]+$"
    p = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("a0",), ("a-x",)], "p string")
    assert [r.p for r in p.where(text.below(F.col("p"), "/a/")).collect()] == ["a", "a/b"]
    assert [r.p for r in spark.createDataFrame([("/a",), ("a/../b",), ("a..b",), ("..",)], "p string").where(text.unsafe_path(F.col("p"))).collect()] == ["/a", "a/../b", ".."]
    assert spark.range(1).select(text.human_bytes(F.lit(1536)), text.human_bytes(F.lit(1023))).first()[:] == ("1.5K", "1023B")
    assert spark.range(1).select(text.mode_string(F.lit(2), F.lit(0o40755))).first()[0] == "drwxr-xr-x"
    assert [tuple(r) for r in spark.range(1).select(F.inline(text.hex_lines(F.lit(b"0123456789abcdefX")))).collect()] == [(0, "30313233343536373839616263646566"), (16, "58")]


def test_diff_cases(spark):
    kind = "path string, content_hash string, mode long, uid long, gid long, mtime_sec long, size long"
    row = lambda p, h="h", m=420: (p, h, m, 1, 1, 7, 1)
    old = spark.createDataFrame([row("a"), row("b"), row("gone"), row("same"), row("dir", None)], kind)
    new = spark.createDataFrame([row("a", "x"), row("b", m=384), row("new"), row("same"), row("dir", None)], kind)
    assert {(r.path, r.change) for r in diff.diff(old, new).collect()} == {("a", "M"), ("b", "m"), ("gone", "D"), ("new", "A")}
    assert diff.diff(old, old).count() == 0
    assert {(r.path, r.change) for r in diff.classify(old, new).collect()} >= {("same", "unchanged"), ("dir", "unchanged"), ("gone", "deleted")}


def test_tree_cases(spark):
    rows = [(1, 0, 10, "a"), (1, 10, 11, "b"), (1, 11, 12, "c"), (1, 99, 13, "orphan"), (1, 13, 14, "x"), (2, 0, 10, "z")]
    found = {(r.snap_id, r.path, r.depth) for r in tree.paths(spark.createDataFrame(rows, "snap_id long, parent_node long, node_id long, name string")).collect()}
    assert found == {(1, "a", 1), (1, "a/b", 2), (1, "a/b/c", 3), (1, "orphan", 1), (1, "orphan/x", 2), (2, "z", 1)}
    files = spark.createDataFrame([("f", "x\nyes\n"), ("g", "yes\0")], "path string, text string")
    assert [tuple(r) for r in tree.grep(files, "^(yes|)$").collect()] == [("f", 2, "yes"), ("f", 3, "")]


def test_packs_against_a_loop(spark):
    rng = random.Random(3)
    rows = sorted((f"{rng.getrandbits(256):064x}", rng.randrange(1, 500)) for _ in range(800))
    found = {r["hash"]: (r.pack_num, r.entry_index, r.dat_offset) for r in packs.assign(spark.createDataFrame(rows, "hash string, compressed_size long"), 10_000).collect()}
    before, first, index, pack = 0, 0, 0, 0
    for h, n in rows:
        if before // 10_000 + 1 != pack:
            pack, first, index = before // 10_000 + 1, before, 0
        assert found[h] == (pack, index, before - first)
        before, index = before + n, index + 1


def test_pack_merging(spark):
    of = lambda sizes: spark.createDataFrame([(i, s) for i, s in enumerate(sizes, 1)], "pack_num long, bytes long")
    due = lambda sizes: packs.merge_due(of(sizes), 100).first().due
    assert due([500] * 33) and not due([500] * 32) and due([1] * 8 + [500] * 18) and not due([1] * 8 + [500] * 20) and not due([1] * 7)
    chosen = lambda sizes, budget: sorted(r.pack_num for r in packs.merge_candidates(of(sizes), 100, budget).collect())
    assert chosen([50, 10, 20, 500, 5, 5], 40) == [2, 3] and chosen([50, 10, 5, 5], 10) == [] and chosen([], 10) == []


def test_journal_cases(spark):
    rows = [(1, "a", "started", "t1", "run", None), (2, "a", "completed", "t2", None, "success"), (3, "b", "started", "t3", "gc", None)]
    df = spark.createDataFrame(rows, "line_no long, op_id string, state string, timestamp string, operation string, result string")
    assert [r.op_id for r in journal.orphans(df).collect()] == ["b"]
    assert [r.line_no for r in journal.page(journal.query(df, state="started", since="t1"), 0, 1, F.col("line_no").desc()).collect()] == [3]
    assert journal.query(df).count() == 3


def test_zero_runs():
    assert objects.zero_runs(b"ab" + b"\0" * 9 + b"c" + b"\0\0" + b"d" + b"\0" * 8, 8) == [(0, 2), (11, 4)]
    assert objects.zero_runs(b"\0" * 9, 8) == [] and objects.zero_runs(b"", 8) == []


def test_stream(spark, tmp_path):
    rows = [("a", "started", "2024-01-01T00:00:00Z"), ("a", "completed", "2024-01-01T00:20:00Z"), ("b", "started", "2024-01-01T00:30:00Z"), ("c", "completed", "2024-01-01T05:00:00Z"), ("d", "started", "2024-01-01T09:00:00Z"), ("d", "completed", "2024-01-01T09:30:00Z")]
    for i, (op, state, ts) in enumerate(rows):
        (tmp_path / f"{i}.json").write_text(f'{{"op_id": "{op}", "state": "{state}", "timestamp": "{ts}", "result": "success", "duration_ms": 10}}\n')
        time.sleep(0.02)
    entries = spark.readStream.option("maxFilesPerTrigger", 1).schema(stream.SCHEMA).json(str(tmp_path)).withColumn("ts", F.to_timestamp("timestamp"))
    for name, df, mode in (("ops", stream.finished(entries), "append"), ("rates", stream.rates(entries), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r.op_id, r.result) for r in spark.table("ops").collect()} >= {("a", "success"), ("b", None), ("d", "success")}
    assert {(r["window"].start.hour, r.n) for r in spark.table("rates").collect()} >= {(0, 1), (5, 1)}


def test_formats(spark):
    one = spark.range(1)
    assert one.select(text.long_bytes(F.lit(1536)), text.long_bytes(F.lit(5)), text.long_bytes(F.lit(3 << 40))).first()[:] == ("1.5 KB", "5 B", "3072.0 GB")
    assert one.select(text.shown_time(F.lit(60)), text.shown_time(F.lit(61), True)).first()[:] == ("1970-01-01 00:01", "1970-01-01 00:01:01")
    assert one.select(text.basename(F.lit("a/b")), text.parent(F.lit("a/b")), text.parent(F.lit("a")), text.pack_shard(F.lit(513)), text.is_hash(F.lit("aF" * 32)), text.is_hash(F.lit("ag" * 32))).first()[:] == ("b", "a", "", "0002", True, False)
    assert one.select(text.plain_base64(F.lit(b"x" * 99))).first()[0] == base64.b64encode(b"x" * 99).decode()
    assert text.pack_number("pack-00000012.idx") == 12 and text.pack_path(12) == "pack-00000012.dat"
    assert [text.pack_number(x) for x in ("pack-12.dat", "pack-000000012.dat", "x/pack-00000012.dat", "pack-00000012.da", "")] == [None] * 5


def test_paths_below(spark):
    rows = [(1, 0, 10, "a"), (1, 10, 11, "b"), (1, 11, 12, "c"), (1, 12, 15, "d"), (1, 15, 16, "e"), (1, 16, 17, "f"), (1, 17, 18, "g"), (1, 0, 13, "z"), (1, 13, 14, "x")]
    df = spark.createDataFrame(rows, "snap_id long, parent_node long, node_id long, name string")
    every = {(r.path, r.depth) for r in tree.paths(df).collect()}
    assert ("a/b/c/d/e/f/g", 7) in every and len(every) == 9
    assert {(r.path, r.depth) for r in tree.paths_below(df, 10, "a").collect()} == {x for x in every if x[0].startswith("a/")}


def test_sizes_as_sql_shows_them(spark, tmp_path):
    """Ties go to the even digit; a listing has no unit above K, and the formats none above M."""
    import duckdb

    from siltstone.plans import listing

    sizes = [0, 1, 1023, 1024, 1280, 1792, 24832, 25344, 1048575, 1 << 20, 5 << 18, 7 << 18, 3 << 20]
    rows = [(10 * i + 1, "x" * n, "en", "src1") for i, n in enumerate(sizes)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("ls_children", "text_formats"):
        query, sql = listing.PLANS[name]
        found, out = query(spark, str(tmp_path)), con.execute(sql)
        want = [dict(zip([d[0] for d in out.description], r, strict=True)) for r in out.fetchall()]
        found = [r.asDict() for r in found.collect()]
        assert found == want if name == "ls_children" else sorted(found, key=str) == sorted(want, key=str)
    big = [F.lit(x) for x in (5 << 28, 5 << 38, (1 << 53) + 1)]
    assert spark.range(1).select(*map(text.human_bytes, big), text.long_bytes(big[0])).first()[:] == ("1.2G", "1.2T", "8192.0T", "1.2 GB")
