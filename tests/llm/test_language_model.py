"""The base score against plain Python; the model against it on texts held out; probabilities that sum to one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import language_model as lm

DATA = "/root/testdata/sf0.001"


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def check(rows, found):
    train = Counter(w for i, t in rows if lm.in_training(i) for w in words(t))
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t in rows:
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))
        want[i, not lm.in_training(i), len(words(t)), sum(train[w] > 0 for w in words(t)), n, round(base, 6)] += 1
    assert want == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    found = lm.op6_language_model(spark, DATA).collect()
    check(rows, found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sorted(map(str, found)) == sorted(map(str, lm.op6_language_model(spark, DATA).collect()))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b A"), (3, "a b A"), (None, "x"), (5, " \n"), (6, "w " * 3000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, flush long")
    found = lm.score(df).withColumnRenamed("id", "doc_id")
    check(rows, found.collect())
    assert lm.score(df.limit(0)).count() == 0
    assert all(r.n_known == 0 for r in lm.score(df, train="false").collect())


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    h, x, c = lm.counted(rng.integers(1, 60, 3000).astype(np.uint64), rng.integers(0, lm.FINE, 3000).astype(np.uint32), np.ones(3000, np.int64))
    state = lm.Restaurants(0, h, x, c)
    for i in range(3):
        state.sweep(state.totals(), i)
        assert (state.t2 <= state.c2).all() and (state.t2 >= 1).all()
    known = state.totals()
    every = np.r_[np.arange(len(state.words)), -1]
    for fine in (0, 17, int(x[5]), lm.FINE - 1):
        assert state.ask(known, every, np.full(len(every), fine)).sum() == pytest.approx(1)


def test_contexts_tell_words_apart(spark):
    """A word that its predecessor alone foretells; and scores that plain Python makes from one state."""
    rng = np.random.default_rng(3)
    pairs = [(f"a{i}", f"b{i}") for i in range(40)]
    rows = [(i, " ".join(w for k in rng.integers(0, 40, 60) for w in pairs[k])) for i in range(200)]
    found = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    # half of the words are drawn from 40, the others follow: about the square root of 40
    assert all(r.perplexity < 9 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in found)


def test_seating_against_exact_enumeration():
    """How many tables a word's customers take, on average over seatings one by one, against the sum over all ways."""
    n, a, d = 6, 0.7, 0.4
    ways = {1: 1.0}
    for c in range(1, n):
        new = {}
        for t, p in ways.items():
            opens = a / (a + c - d * t)
            new[t + 1] = new.get(t + 1, 0) + p * opens
            new[t] = new.get(t, 0) + p * (1 - opens)
        ways = new
    drawn = lm.seats(np.full(40000, n), np.full(40000, a), d, np.random.default_rng(2))
    for t, p in ways.items():
        assert abs((drawn == t).mean() - p) < 0.01
    large = [lm.seats(np.full(2000, 400), np.full(2000, a), d, np.random.default_rng(k)).mean() for k in range(3)]
    one = []
    rng = np.random.default_rng(9)
    for _ in range(300):
        t = 1
        for c in range(1, 400):
            t += rng.random() < a / (a + c - d * t)
        one.append(t)
    assert abs(np.mean(large) - np.mean(one)) < 0.06 * np.mean(one)


def test_condition():
    assert [lm.in_training(i) for i in range(30)] == [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(30)]


def test_parts_of_a_frequent_word(monkeypatch):
    """The parts of a bucket are added up a few at a time, however many there are."""
    rng = np.random.default_rng(4)
    parts = [lm.counted(rng.integers(1, 4, 400).astype(np.uint64), rng.integers(0, 300, 400).astype(np.uint16), np.ones(400, np.int64)) for _ in range(200)]
    want, sizes, plain = lm.counted(*(np.concatenate(c) for c in zip(*parts, strict=True))), [], lm.counted
    monkeypatch.setattr(lm, "HELD", 1000)
    monkeypatch.setattr(lm, "counted", lambda h, x, n: (sizes.append(len(h)), plain(h, x, n))[1])
    assert all((a == b).all() for a, b in zip(lm.added_up(iter(parts)), want, strict=True))
    assert max(sizes) <= 1000 + 900 + 400


def test_packed():
    for h, x, n in (([], [], []), ([7], [3], [1]), ([1, 1, 1, 5, 9, 9], [0, 4, 65535, 4, 0, 1], [1, 255, 3, 1, 1 << 40, 2])):
        h, x, n = np.array(h, np.uint64), np.array(x, np.uint32), np.array(n, np.int64)
        row = pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in lm.packed(h, x, n, np.uint16)], list(lm.BYTES))
        words, runs, x_, n_ = lm.unpacked(row, 0, np.uint16)
        assert (np.repeat(words, runs) == h).all() and (x_ == x).all() and (n_ == n).all() and len(words) == len(set(h.tolist()))


def test_asked_many_times():
    """What one state answers is made once: the same for any grouping of what is asked, as from its own probabilities."""
    rng = np.random.default_rng(6)
    state = lm.Restaurants(3, *lm.counted(rng.integers(1, 90, 5000).astype(np.uint64), rng.integers(0, lm.FINE, 5000).astype(np.uint32) % 999, np.ones(5000, np.int64)))
    state.sweep(state.totals(), 0)
    known = state.totals()
    asked, word = lm.Asked(state, known), state.key2 // lm.FINE
    p = asked(word, state.x2.astype(np.int64), *state.places(word, state.x2.astype(np.int64)))
    assert (p == state.probabilities(known)[2]).all() and (state.counts() == np.bincount(word, weights=state.c2)).all()
    some = np.array([-1, 0, 5]), np.array([998, 70000 % lm.FINE, 2])
    assert (asked(*some, *state.places(*some)) == np.concatenate([state.ask(known, some[0][i : i + 1], some[1][i : i + 1]) for i in range(3)])).all()
