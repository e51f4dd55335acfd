"""The stages one after another over the smallest documents, each held against its own input."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from siltstone.llm import mixing, neardup, pii, repetition, tokens
from siltstone.llm.common import stage

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def repeated(w, n):
    windows = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    return {k + j for k in range(len(w) - n + 1) if windows[tuple(w[k : k + n])] > 1 for j in range(n)}


def good(text):
    w = WORDS.findall(text or "")
    chars = sum(map(len, w))
    if len(w) < 20 or 100 * len(repeated(w, 8)) > 30 * len(w):
        return False
    seen, lines = set(), 0
    for line in text.split("\n"):
        if line in seen:
            lines += sum(map(len, WORDS.findall(line)))
        elif WORDS.search(line):
            seen.add(line)
    return 100 * lines <= 30 * chars and all(100 * sum(len(w[k]) for k in repeated(w, n)) <= most * chars for n, most in repetition.NGRAM_LIMITS.items())


def shingles(text):
    w = WORDS.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, held = docs.columns, [docs]
    for name, step in corpus_pipeline.STAGES:
        held.append(stage(step(spark, held[-1], SF), name))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "neardup", "pii", "mixing", "packing"]
    assert all(df.columns == names for df in held[1:-1])
    raw, quality, unique, clean, mixed, packed = ([r.asDict() for r in df.collect()] for df in held)
    assert {r["doc_id"] for r in quality} == {r["doc_id"] for r in raw if good(r["text"])}
    sets = {r["doc_id"]: shingles(r["text"]) for r in quality}
    links = {i: [j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0] for i in sets}
    low = {i: i for i in sets}
    for _ in sets:
        low = {i: min(low[j] for j in [i, *links[i]]) for i in sets}
    assert sorted(r["doc_id"] for r in unique) == sorted(set(low.values()))
    want = {}
    for r in unique:
        base, added = pii.find(r["text"])
        want[r["doc_id"]] = pii.redacted(r["text"], {k: base[k] + added[k] for k in pii.KINDS})
    assert {r["doc_id"]: r["text"] for r in clean} == want and all(r["n_chars"] == len(r["text"]) for r in clean)
    assert not any(pii.detect(r["text"])["email"] for r in clean)
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= set(want) and max(copies.values()) <= 3 and {(r["doc_id"], r["text"]) for r in mixed} <= set(want.items())
    whole = Tokenizer.from_file(tokens.VOCABULARY)
    ids = {i: whole.encode(want[i], add_special_tokens=False).ids + [1] for i in copies}
    got = Counter()
    for r in packed:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        got[r["doc_id"]] += r["length"]
    assert got == Counter({i: n * len(ids[i]) for i, n in copies.items()})


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    assert docs.count() == 0


def test_texts_are_joined_alike_at_every_size(spark):
    """A stage that Spark lets broadcast a side while it is small would shuffle all texts from some size on."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for step in (neardup.keep_first, mixing.repeat_documents):
        plan = step(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"ShuffledHashJoin(\(\w+=\w+\))? \[_rid", plan) and not re.search(r"Broadcast\w+Join", plan)
