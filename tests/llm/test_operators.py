"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing names, by brute force."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import caps, common, mixing, neardup, packing, pii, repetition, sharding, substrings, tokenfiles, tokens

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PHRASE = " ".join(f"word{i}" for i in range(40))
TEXTS = [
    (1, PHRASE), (2, PHRASE), (3, PHRASE + " and more"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One TWO"),
    (None, PHRASE.upper()), (9, "é" * 70), (10, "same line\n" * 30), (2, PHRASE), (11, "#$%|<>&* " * 25), (12, "long " * 20000), (13, "x" * 30000), (1, "another text for an id that is taken"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{k % 3}" if k % 5 else None, k) for k, (i, t) in enumerate(TEXTS)]
    # names that the operators use themselves
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rid long")
    return df.withColumn("kept", F.lit("x")).withColumn("_row", F.lit(1)).withColumn("node", F.lit(2)).withColumn("shard", F.lit(None).cast("int"))


def bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_repetition(docs):
    want = Counter()
    for i, t in TEXTS:
        w = WORDS.findall(t or "")
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w)] += 1
    out = repetition.repetition(docs, carry=["doc_id", "rid"])
    docs = docs.withColumn("dup8_chars", F.lit(0))
    assert bag(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    kept = {r.rid for r in out.collect() if r.kept}
    assert kept == {0, 1, 2, 8, 11}
    assert repetition.repetition(docs.limit(0)).count() == 0
    whole = repetition.filter_documents(docs.sparkSession, docs, "")
    assert whole.columns == docs.columns and {r.rid for r in whole.collect()} == kept


def test_sharding(docs):
    out = sharding.slots(sharding.shard(docs, "doc_id", [1.0] * 5), ["doc_id", "rid"])
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(len({r["shard"] for r in rows if r.doc_id == i}) == 1 for i in {r.doc_id for r in rows})
    assert sharding.slots(sharding.shard(docs.limit(0), "doc_id", [1.0]), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("x"), [1.0, 0.0])


def test_sharding_moves_and_weighs(spark):
    ids = spark.range(20000)
    a = sharding.shard(sharding.shard(ids, "id", [1, 1, 2], "a"), "id", [1, 1, 2, 1], "b")
    counts = bag(a, "a", "b")
    assert all(b in (a_, 3) for a_, b in counts)
    total = Counter()
    for (a_, _), n in counts.items():
        total[a_] += n
    assert abs(total[2] - 10000) < 500 and abs(total[0] - 5000) < 400
    heavier = sharding.shard(sharding.shard(ids, "id", [1, 1, 1], "a"), "id", [1, 1, 3], "b")
    assert all(b in (a_, 2) for a_, b in bag(heavier, "a", "b"))


def test_token_files(docs, spark):
    folder = common.scratch(spark, "test")
    tokenfiles.write_token_files(docs, folder, file_ids=1000)
    whole = Tokenizer.from_file(tokens.VOCABULARY)
    ids = [(i, whole.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in TEXTS]
    rows = tokenfiles.read_token_files(spark, folder).orderBy("file", "place").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((i, tuple(x)) for i, x in ids)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    spans = tokenfiles.read_token_spans(spark, folder).collect()
    at = 0
    for r in sorted(spans, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in spans) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    empty = common.scratch(spark, "test")
    tokenfiles.write_token_files(docs.limit(0), empty)
    assert tokenfiles.read_token_files(spark, empty).count() == 0 and tokenfiles.read_token_spans(spark, empty).count() == 0


def test_token_files_of_one_id(spark):
    """Rows of one id, and without one, in several files, still in order."""
    rows = [(7 if i % 3 else None, "some words " * (1 + i % 4)) for i in range(300)]
    folder = common.scratch(spark, "test")
    files = tokenfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), folder, file_ids=200)
    assert files.count() >= 5 and files.agg(F.sum("docs")).first()[0] == 300
    found = tokenfiles.read_token_files(spark, folder).orderBy("file", "place").collect()
    assert [r.doc_id for r in found] == [None] * 100 + [7] * 200


def test_token_files_without_child_processes(docs, spark, tmp_path, monkeypatch):
    """No file comes from Hadoop's local file system, which starts a process for each; its checksums would show that."""
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert tokenfiles.op3_tokenfiles(spark, str(tmp_path)).count() == len(TEXTS)
    names = [p.name for p in (tmp_path / "shared").rglob("*") if p.is_file()]
    assert [n for n in names if n.startswith("ids-")] and not [n for n in names if n.endswith((".crc", ".tmp")) or n == "_SUCCESS"]


def test_token_files_block_by_block(docs, spark):
    """A reader holds a block at a time, takes numbers of seven digits, and refuses what was cut off."""
    folder = common.scratch(spark, "test")
    tokenfiles.write_token_files(docs.where("doc_id = 12"), folder)
    path = Path(folder.removeprefix("file://"))
    (file,) = path.glob("ids-*")
    content, ranks = file.read_bytes(), np.frombuffer((path / "ranks").read_bytes(), "<u4")

    class Reader(io.BytesIO):
        def read(self, n):
            assert 0 <= n < len(content)
            return super().read(n)

    found = list(tokenfiles.unpack_blocks(Reader(content * 3), ranks))
    assert len(found) == 3 and all(d == [12] and len(x[0]) == 20001 for d, x in found)
    for cut in (10, 25, len(content) - 1):
        with pytest.raises(ValueError):
            list(tokenfiles.unpack_blocks(io.BytesIO(content[:cut]), ranks))
    (path / "ids-1000000").write_bytes(content)
    assert [(r.file, r.doc_id) for r in tokenfiles.read_token_files(spark, folder).orderBy("file").collect()] == [(int(file.name[4:]), 12), (1000000, 12)]
    assert sorted(r.start for r in tokenfiles.read_token_spans(spark, folder).collect()) == [0, 20001]


def test_variable_length_code():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1000):
        values = (2 ** rng.uniform(0, 32, n)).astype(np.uint32)
        assert (tokenfiles.decode(*tokenfiles.encode(values), n) == values).all()
    assert len(tokenfiles.encode(np.arange(256))[1]) == 256


@pytest.mark.parametrize("size", [16, 256])
def test_packing(docs, size):
    whole = Tokenizer.from_file(tokens.VOCABULARY)
    rows = packing.pack(docs, size=size).collect()
    ids = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in TEXTS)
    held, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        held[r.id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    total = sum(len(x) * n for (_, x), n in ids.items())
    assert sum(r.length for r in rows) == total and len(sequences) == -(-total // size)
    for k, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == size or k == max(sequences)
    for (i, x), n in ids.items():
        parts = Counter((r.start, tuple(r.ids)) for r in held[i, len(x)] if tuple(r.ids) == x[r.start : r.start + r.length])
        assert sum(len(p) * c for (_, p), c in parts.items()) >= len(x) * n
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_keeps_proportions(spark):
    rows = [(i, "a b c d e f g h " * (1 + i % 7), "big" if i % 3 else f"small{i % 4}") for i in range(600)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), with_ids=False).collect()
    total, by = Counter(), defaultdict(Counter)
    for r in out:
        total[r.source] += r.length
        by[r.sequence_id][r.source] += r.length
    every = sum(total.values())
    for k, found in by.items():
        if k != max(by):
            assert all(abs(found[s] - 2048 * total[s] / every) <= 2 for s in total)


def test_packing_meets_targets(spark):
    """Windows by target shares while the queues last, the others' shares kept after one is empty."""
    words = "a b c d e f g h "
    rows = [(i, words * (1 + i % 7), ("x", "y", "z", None, "rest")[i % 5]) for i in range(900)]
    shares = {"x": 6, "y": 2, "z": 1, None: 1}
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), size=512, with_ids=False, shares=shares).collect()
    left, by = Counter(), defaultdict(Counter)
    for r in out:
        left[r.source] += r.length
        by[r.sequence_id][r.source] += r.length
    assert sum(left.values()) == sum(8 * (1 + i % 7) + 1 for i in range(900))
    exact = 0
    for k in sorted(by):
        assert sum(by[k].values()) == 512 or k == max(by)
        # so long as all that still have a window's share are drawn by their targets
        last = [s for s in shares if left[s] - 1 >= 512 * shares[s] / sum(shares.values())]
        total = sum(shares[s] for s in last)
        if last and all(left[s] - 1 >= 512 * shares[s] / total for s in last):
            exact += all(abs(by[k][s] - 512 * shares[s] / total) <= 2 for s in last)
        left.subtract(by[k])
    assert exact >= 0.8 * len(by) - 25 and exact >= 10


def test_phases():
    rng = random.Random(6)
    for _ in range(300):
        q = rng.randrange(1, 8)
        m, w, size = [rng.randrange(0, 5000) for _ in range(q)], [rng.randrange(0, 9) for _ in range(q)], rng.choice([16, 128, 512])
        found = packing.phases(m, w, size)
        assert sum(found).tolist() == m and all((x >= 0).all() for x in found) and all(x.sum() % size == 0 for x in found[:-1])
        for x in found[:-1]:
            on = x > 0
            assert all(abs(a - x.sum() * b / sum(np.array(w)[on])) <= 1 for a, b in zip(x[on], np.array(w)[on], strict=True))
    assert [x.tolist() for x in packing.phases([5, 7], None, 4)] == [[5, 7]]


def test_large_products():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 1 << 44)
        a, b = rng.randrange(n + 1), rng.randrange(n + 1)
        assert packing.floor_ratio(np.array([a]), np.array([b]), n)[0] == a * b // n


def test_mixing(docs):
    rows = mixing.mix(docs, carry=["doc_id", "rid"]).collect()
    assert rows and Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(WORDS.findall(t or ""))) for i, t in TEXTS)
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in rows)
    again = mixing.mix(docs.repartition(3), carry=["doc_id", "rid"], key=["doc_id", "rid"]).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([1, 5, 40, 200]), rng.choice(["a", "b", "c", "d", "e", None])) for i in range(3000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=["doc_id"]).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in found:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    weights = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1], strict=True))
    want, left = {}, sum(size.values())
    free = set(size)
    while over := {s for s in free if left * weights[s] / sum(weights[x] for x in free) > 3 * size[s]}:
        want |= {s: 3 * size[s] for s in over}
        free -= over
        left = sum(size.values()) - sum(want.values())
    want |= {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 200


def reachable(n, links):
    low = list(range(n))
    for _ in range(n):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_near_duplicates(docs):
    sets = []
    for _, t in TEXTS:
        w = WORDS.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    low = reachable(len(sets), links)
    least = {c: min((TEXTS[k][0] for k in range(len(sets)) if low[k] == c and TEXTS[k][0] is not None), default=None) for c in set(low)}
    out = neardup.near_duplicates(docs)
    assert bag(out, "id", "n_shingles", "component_id") == Counter((TEXTS[k][0], len(sets[k]), least[low[k]]) for k in range(len(sets)))
    assert sum(r.first for r in out.collect()) == len(set(low))
    whole = neardup.keep_first(docs.sparkSession, docs, "")
    assert whole.columns == docs.columns and whole.count() == len(set(low))
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """Chains and hubs of near copies, with blocks and joins of every size."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(200), rng.choice([0, 1, 2, 3, 4])):
            w[k] = f"e{i}.{k}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in rows]
    links = [(a, b) for a in range(150) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    low = reachable(150, links)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for small, block in ((2, 8), (16, 384)):
        monkeypatch.setattr(neardup, "SMALL", small)
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert bag(neardup.near_duplicates(df), "id", "component_id") == Counter(enumerate(low))


def test_near_duplicates_of_frequent_keys(spark, monkeypatch):
    """A third of all rows equal, many near copies of one text: keys, sets and leaders are split, and nothing changes."""
    monkeypatch.setattr(common, "LEAST_SPLIT", 3)
    rng = random.Random(14)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(60)]
    for i in range(60, 120):
        w = list(base)
        w[rng.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(rng.choices("abcdefghijklmnop", k=30))) for i in range(120, 180)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    for percent in (85, 80):
        low = reachable(180, [(a, b) for a in range(180) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])])
        assert bag(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent), "id", "component_id") == Counter(enumerate(low))


def test_recall_of_bands():
    """Pairs of sets at the threshold share a band; the share that doesn't is what ``banding`` allows."""
    rng = np.random.default_rng(21)
    for percent in (80, 85):
        rows, bands = neardup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= neardup.MISSED and rows * bands <= neardup.COORDINATES
        met = 0
        for _ in range(300):
            x = rng.integers(0, 2**63, 220, dtype=np.uint64)
            both = 200 * percent // 100
            only = (200 - both) // 2
            a, b = np.sort(x[: both + only]), np.sort(np.r_[x[:both], x[both + only : both + 2 * only]])
            keys = neardup.band_keys(neardup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), rows * bands), bands)
            met += bool((keys[0] == keys[1]).any())
        assert met == 300


def test_sketches_agree_as_sets_do():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = np.sort(x[:250]), np.sort(x[50:])
        s = neardup.sketches(np.concatenate([a, b]), np.array([0, 250, 500]))
        assert (s != ~np.uint64(0)).all()
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 200 / 300) < 0.02
    one = neardup.sketches(np.array([5], np.uint64), np.array([0, 1, 1]))
    assert (one[0] != ~np.uint64(0)).all() and (one[1] == ~np.uint64(0)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 120), (101, 120), (120, 130), (7, 7), (200, 201), (201, 200)]
    found = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(51), 0), **dict.fromkeys([100, 101, 120, 130], 100), 200: 200, 201: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut(rows):
    """By brute force: what each row keeps."""
    low = {}
    key = lambda i: 2**63 if i is None else i
    data = [(key(i), (t or "").encode()) for i, t in rows]
    for o, b in data:
        for k in range(len(b) - 49):
            low[b[k : k + 50]] = min(low.get(b[k : k + 50], o), o)
    out = Counter()
    for (i, _), (o, b) in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if low[b[k : k + 50]] < o:
                gone[k : k + 50] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_substrings(docs):
    columns = ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    tables = docs.sparkSession.catalog.listTables()
    assert bag(substrings.repeated_substrings(docs), *columns) == cut(TEXTS)
    assert substrings.repeated_substrings(docs.limit(0)).count() == 0
    assert docs.sparkSession.catalog.listTables() == tables


@pytest.mark.parametrize("most", [3, 1 << 17])
def test_substrings_shared_passages(spark, most):
    rng = random.Random(9)
    passages = ["".join(rng.choices("abc ", k=n)) for n in (50, 55, 80, 200)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(["".join(rng.choices("xyz", k=rng.randrange(40))), rng.choice(passages), rng.choice(passages)[: rng.randrange(20, 60)], "-" * rng.randrange(70)]) for _ in range(6))
        rows.append((rng.randrange(50), text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = bag(substrings.repeated_substrings(df, most=most), "id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == cut(rows)


def test_substrings_in_an_order_that_changes(spark, monkeypatch):
    """Rows that come in another order at each evaluation; small flushes, so that every step meets its own leavings."""
    monkeypatch.setattr(substrings, "FLUSH", 50)
    monkeypatch.setattr(substrings, "HELD", 20)
    rng = random.Random(19)
    passages = ["".join(rng.choices("abc ", k=n)) for n in (50, 64, 120)]
    rows = [(i if i % 9 else None, "".join(rng.choice([rng.choice(passages), "".join(rng.choices("xyz", k=30)), "=" * rng.randrange(90)]) for _ in range(5))) for i in range(120)] + [(7, "same text of some length, in a third of all rows there are")] * 60

    def shuffled(batches):
        for b in batches:
            yield b.take(pa.array(np.random.default_rng().permutation(b.num_rows)))

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).mapInArrow(shuffled, "doc_id long, text string")
    for most in (3, 1 << 17):
        assert bag(substrings.repeated_substrings(df, most=most), "id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cut(rows)
    near = neardup.near_duplicates(df)
    assert near.count() == 180 and near.where("first").count() == neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("first").count()


def test_suffix_sort_with_colliding_hashes(monkeypatch):
    """With hashes that tell nothing, extensions are still those of the bytes."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 500).astype(np.uint8)
    start, length, group = rng.integers(0, 440, 80), rng.integers(0, 50, 80), np.sort(rng.integers(0, 4, 80))
    order, lcp = substrings.suffix_sort(data, start, length, group)
    texts = [bytes(data[s : s + n]) for s, n in zip(start, length, strict=True)]
    assert [(group[i], texts[i]) for i in order] == sorted((group[i], texts[i]) for i in range(80))
    monkeypatch.setattr(substrings, "BYTE_KEYS", np.zeros(256, np.uint64))
    order, lcp = substrings.suffix_sort(data, start, length, group)
    for x, y, n in zip(order[:-1], order[1:], lcp[1:], strict=True):
        if group[x] == group[y]:
            assert texts[x][:n] == texts[y][:n] and texts[x][n : n + 1] != texts[y][n : n + 1] or n == min(len(texts[x]), len(texts[y]))


def test_cosine_links(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 24))
    vectors = [(c + 0.12 * rng.standard_normal(24)).tolist() for c in centres for _ in range(12)]
    vectors += [None, [], [0.0] * 24, [None] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [-1.0, 1.0], vectors[0], vectors[0], [1e300] * 24, [1e-300] * 24]
    rows = [(i if i != 5 else None, v, 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node long")
    fine = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / np.abs(v).max() if fine(v) else None for v in vectors]
    unit = [u / np.sqrt(u @ u) if u is not None else None for u in unit]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    low, n = reachable(len(rows), links), Counter(x for link in links for x in link)
    least = {c: min((rows[k][0] for k in range(len(rows)) if low[k] == c and rows[k][0] is not None), default=None) for c in set(low)}
    out = caps.cosine_links(df)
    assert bag(out, "id", "n_links", "component_id") == Counter((rows[k][0], n[k], least[low[k]]) for k in range(len(rows)))
    assert sum(r["first"] for r in out.collect()) == len(set(low))
    assert caps.cosine_links(df.limit(0)).count() == 0


def test_cosine_links_of_one_cluster(spark, monkeypatch):
    """All vectors in the same buckets, of more blocks than one: what blocks give out grows with the vectors."""
    rng = np.random.default_rng(15)
    v = rng.standard_normal(16) + 0.12 * rng.standard_normal((400, 16))
    v[::7] += 0.3 * rng.standard_normal((58, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    low = reachable(len(v), [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a > b])
    want = Counter((i, int(near[i].sum()) - 1, low[i]) for i in range(len(v)))
    for block, strip in ((64, 10), (4096, 512)):
        monkeypatch.setattr(caps, "BLOCK", block)
        monkeypatch.setattr(caps, "STRIP", strip)
        assert bag(caps.cosine_links(df), "id", "n_links", "component_id") == want


def test_list_decoding():
    rng = np.random.default_rng(6)
    v = rng.standard_normal((50, 10))
    first, second = caps.codes(10, 20, 1)
    score = ((v @ first.T)[:, :, None] + (v @ second.T)[:, None, :]).reshape(50, -1)
    assert (caps.decode(v, first, second, 6) == np.sort(np.argsort(-score, axis=1)[:, :6], axis=1)).all()


def test_recall(spark):
    """Every pair at or above the threshold, in more vectors than a bucket holds."""
    rng = np.random.default_rng(8)
    v = np.array([c + 0.16 * rng.standard_normal(64) for c in rng.standard_normal((300, 64)) for _ in range(5)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    n = ((v @ v.T) >= 0.95).sum(1) - 1
    assert bag(caps.cosine_links(df), "id", "n_links") == Counter(enumerate(n.tolist()))


def test_readings_that_are_split_in_another_way(spark, tmp_path, monkeypatch):
    """Between two jobs the session may come to split the same files in another way, as when executors are lost."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(30)]
    rows = [(i, texts[i % 30] + (" more" if i < 30 else ""), f"s{i % 3}", len(texts[i % 30])) for i in range(90)] + [(95, texts[3], "s0", 119)] * 2
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(6).write.parquet(path)
    docs = spark.read.parquet(path)

    def found():
        cut = substrings.repeated_substrings(docs)
        near = neardup.near_duplicates(docs)
        return [bag(cut, "id", "n_removed", "kept_sha256"), bag(near, "id", "n_shingles", "component_id", "kept"), bag(neardup.keep_first(spark, docs, ""), *docs.columns), bag(mixing.repeat_documents(spark, docs, ""), *docs.columns)]

    want, plain = found(), common.stage
    assert sum(want[0].values()) == 92 and sum(want[2].values()) == 30
    name = "spark.sql.files.maxPartitionBytes"

    def moved(df, label):
        out = plain(df, label)
        spark.conf.set(name, "300" if spark.conf.get(name) != "300" else "128m")
        return out

    for module in (substrings, neardup, mixing):
        monkeypatch.setattr(module, "stage", moved)
    try:
        assert found() == want
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize(("dimensions", "n"), [(64, 10**8), (16, 10**8), (8, 10**6)])
def test_caps_of_large_tables_miss_no_pair(dimensions, n):
    """With the filters that a table of n vectors gets, pairs at the threshold meet, drawn apart from the plan's own."""
    words, number, listed = caps.planned(dimensions, n)
    rng = np.random.default_rng(77)
    a, b = (caps.scaled(rng.standard_normal((1000, dimensions))) for _ in range(2))
    b = caps.scaled(b - (a * b).sum(1, keepdims=True) * a)
    b = caps.COSINE * a + (1 - caps.COSINE**2) ** 0.5 * b
    met = np.zeros(len(a), bool)
    for i in range(number):
        code = caps.codes(dimensions, words, caps.SEED + i)
        x, y = (caps.decode(v[~met], *code, listed) for v in (a, b))
        met[~met] = (x[:, :, None] == y[:, None, :]).any((1, 2))
        if met.all():
            break
    assert met.all()


def test_mixing_rates_against_a_loop(spark):
    """Rates by bisection of each source's dual, and copies that add up to what the rates say."""
    rng = random.Random(12)
    rows = [(i, "w " * rng.choice([0, 1, 3, 9, 40, 200, 1000]), rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(1500)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=["doc_id"]).collect()
    for s in {r.source for r in found}:
        own = [r for r in found if r.source == s]
        sizes = [r["size"] for r in own]
        mean, target = sum(sizes) / sum(x > 0 for x in sizes), own[0].target
        low, high = -60 * mean, 60 * mean
        for _ in range(200):
            lam = (low + high) / 2
            low, high = (lam, high) if sum(x * min(3.0, np.exp(min(lam * x / mean, 2))) for x in sizes) < target else (low, lam)
        if target < 3 * sum(sizes):
            assert all(r.rate == pytest.approx(min(3.0, np.exp(min(lam * r["size"] / mean, 2))), rel=1e-5) for r in own)
        else:
            assert all(r.rate == (3 if r["size"] else 1) for r in own)
        assert all(abs(r.copies - r.rate) < 2 or r["size"] == 0 for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(x for x in sizes) / 2 + 1


def test_stages_on_odd_rows(spark, docs):
    """Null ids and texts, repeated rows, and columns with names that the operators use: each stage carries them whole."""
    rows = {tuple(r) for r in docs.collect()}
    for step in (repetition.filter_documents, neardup.keep_first, mixing.repeat_documents):
        out = step(spark, docs, "")
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= rows
    clean = pii.redact_documents(spark, docs.withColumn("n_chars", F.length("text")), "")
    assert clean.columns == [*docs.columns, "n_chars"] and Counter(r.text for r in clean.collect()) == Counter(t for _, t in TEXTS)
    packed = packing.pack_documents(spark, docs, "")
    assert packed.columns == list(packing.DIGEST) and packed.where("start = 0").count() == len(TEXTS)


def test_slots_of_one_key(spark):
    df = spark.createDataFrame([(5, "x")] * 40 + [(None, None)] * 9, "doc_id long, text string")
    found = sharding.slots(sharding.shard(df, "doc_id", [1.0] * 4), ["doc_id"]).collect()
    for key, n in ((5, 40), (None, 9)):
        own = [r for r in found if r.doc_id == key]
        assert len({r["shard"] for r in own}) == 1 and len({r.slot for r in own}) == n
    by = Counter(r["shard"] for r in found)
    assert all(sorted(r.slot for r in found if r["shard"] == s) == list(range(n)) for s, n in by.items())
