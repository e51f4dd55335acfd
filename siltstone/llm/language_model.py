"""LM scoring with a hierarchical Pitman-Yor model of words.

Restaurants form a tree: one for each class of the preceding word, ``FINE`` or more as the corpus grows, so that
a frequent word has one nearly for itself; their parents, one for each of ``COARSE`` classes; above them the
restaurant of all words; and at the root a uniform draw from the words of the training texts and one that stands
for all others. A customer who opens a table sends a customer to
the parent. Who opens tables is sampled by Gibbs sweeps: the customers of a word leave a restaurant together
and are seated again one by one, by the Chinese-restaurant probabilities that the parent's word probability
gives. A word's probability is averaged over the sweeps after the first ones.

Words are dealt out by their hashes: all that a word's customers need to know of other words are the
restaurants' totals, a vector of a few numbers a restaurant, which is summed over all tasks after each sweep. A
task's random numbers follow from its words and the sweep, so the state needs no storing: a later pass makes the
same sweeps again from the counts and the totals so far.

Texts are never dealt out. A group of texts sends each word's occurrences to where the word's customers are,
and gets back sums by text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import U, Words, chunks, mix, stage

#: Classes of the preceding word: the parents, and at least and at most the restaurants below them; bytes of text for each.
COARSE, FINE, MOST_FINE, CLASS_BYTES = 32, 1 << 16, 1 << 20, 1 << 17
SWEEPS, BURN_IN = 3, 1
STRENGTH = 1.0
SEED = 20240611
#: Tokens that a task gathers before it deals them out, at most 65,536 texts at a time; bytes of text for each bucket.
FLUSH, BUCKET_BYTES = 3 << 19, 16 << 20
#: Tokens of a bucket that are scored in one task, parts of a bucket's counts that are merged in one, and counts added up at once.
SCORED, MERGED, HELD = 1 << 22, 1 << 10, 1 << 20
#: Numbers of a totals vector before those of classes; numbers of it that a task sums up at once.
SCALARS, RANGE = 10, 1 << 13
#: Columns of packed words, classes and counts.
BYTES = ("h", "runs", "x", "n")
END, START = U(0x51C6B0F5A3D98E27), U(0x2B9A6F4471D0C835)


def classes(size: int) -> int:
    """How many classes a corpus of so many bytes has: a power of two."""
    return min(max(FINE, 1 << max(size // CLASS_BYTES, 1).bit_length() - 1), MOST_FINE)


def tokens(texts: list[bytes | None], fine: int = FINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash, the class of the preceding token, and the text, of each token; a text's last is its end."""
    words = Words(texts, lower=True)
    ends = words.first[1:]
    h = np.insert(words.hashes(), ends, END)
    doc = np.insert(words.doc, ends, np.arange(len(texts)))
    tail = words.bytes[words.end - 1].astype(np.uint64) << U(8) | words.bytes[np.maximum(words.end - 2, words.start)]
    coarse = np.insert(mix(tail) % U(COARSE), ends, U(0))
    before = np.r_[START, h[:-1]]
    coarse = np.r_[U(0), coarse[:-1]]
    opens = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    before[:1], before[1:][opens[1:]] = START, START
    coarse[opens] = mix(np.array([START]))[0] % U(COARSE)
    x = coarse * U(fine // COARSE) + mix(before) % U(fine // COARSE)
    return h, x[: len(h)].astype(np.uint32), doc


def counted(h: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of ``n`` by word and class, sorted."""
    order = np.lexsort((x, h))
    h, x, n = h[order], x[order], n[order]
    edge = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])][: len(h)])
    return h[edge], x[edge], np.add.reduceat(n, edge) if len(edge) else n


def added_up(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of words, classes and counts of any number of parts, of which about ``HELD`` are held beside the sums so far.

    A frequent word is in each part with most classes: its parts grow with the corpus, its sums don't.
    """
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n > HELD + len(held[0][0]) and len(held) > 1:
            held = [counted(*(np.concatenate(c) for c in zip(*held, strict=True)))]
            n = len(held[0][0])
    return held[0] if len(held) == 1 else counted(*(np.concatenate(c) for c in zip(*held, strict=True)))


def packed(h: np.ndarray, x: np.ndarray, n: np.ndarray, narrow: type) -> list[bytes]:
    """Sorted words, classes and counts in few bytes: a word once, how many classes it has, and counts as wide as the largest."""
    edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    runs = np.diff(np.r_[edge, len(h)])
    return [h[edge].tobytes(), runs.astype(np.uint32).tobytes(), x.astype(narrow).tobytes(), n.astype(np.min_scalar_type(int(n.max(initial=0)))).tobytes()]


def unpacked(batch: pa.RecordBatch, i: int, narrow: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words, how many classes each has, classes and counts of a row, where they lie."""
    h, runs, x, n = (batch.column(c)[i].as_buffer() for c in ("h", "runs", "x", "n"))
    x = np.frombuffer(x, narrow)
    return np.frombuffer(h, np.uint64), np.frombuffer(runs, np.uint32), x, np.frombuffer(n, f"u{n.size // len(x)}" if len(x) else np.uint8)


def seats(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of words with ``c`` customers each, if a new table draws ``a`` and n seated at t tables n - d * t.

    The first 32 are seated one by one, later ones a sixteenth of those seated at a time, in which the
    chance of a new table hardly changes.
    """
    t = np.minimum(c, 1)
    live, n = np.flatnonzero(c > 1), 1
    while len(live):
        m = 1 if n < 32 else n // 16
        step = np.minimum(m, c[live] - n)
        p = a[live] / (a[live] + n - d * t[live])
        t[live] += rng.random(len(live)) < p if m == 1 else rng.binomial(step, p)
        n += m
        live = live[c[live] > n]
    return t


class Restaurants:
    """The customers of a bucket's words: ``h``, ``x``, ``c`` sorted by word and class."""

    def __init__(self, bucket: int, h: np.ndarray, x: np.ndarray, c: np.ndarray, fine: int = FINE):
        fresh = np.r_[True, h[1:] != h[:-1]][: len(h)]
        self.seat(bucket, h[fresh], np.diff(np.r_[np.flatnonzero(fresh), len(h)]), x, c, fine)

    @classmethod
    def of(cls, bucket: int, words: np.ndarray, runs: np.ndarray, x: np.ndarray, c: np.ndarray, fine: int) -> Restaurants:
        """From each word once and how many classes it has."""
        out = cls.__new__(cls)
        out.seat(bucket, words, runs, x, c, fine)
        return out

    def seat(self, bucket: int, words: np.ndarray, runs: np.ndarray, x: np.ndarray, c: np.ndarray, fine: int) -> None:
        self.bucket, self.words, self.c2, self.x2, self.fine = bucket, words, c.astype(np.int64), x.astype(np.int32), fine
        self.key2 = np.repeat(np.arange(len(words)), runs) * fine + self.x2
        # sorted by class, so by coarse class too
        key1 = self.key2 // (fine // COARSE)
        fresh = np.r_[True, key1[1:] != key1[:-1]][: len(key1)]
        self.key1, self.up = key1[fresh], np.cumsum(fresh, dtype=np.int32) - np.int32(1)
        self.word1, self.x1 = self.key1 // COARSE, self.key1 % COARSE
        self.t2 = np.minimum(self.c2, 1)
        self.c1 = np.bincount(self.up, weights=self.t2, minlength=len(self.key1)).astype(np.int64)
        self.t1 = np.minimum(self.c1, 1)
        self.c0 = np.bincount(self.word1, weights=self.t1, minlength=len(self.words)).astype(np.int64)
        self.t0 = np.minimum(self.c0, 1)

    def totals(self) -> np.ndarray:
        """What other buckets need to know: customers, words, the upper restaurants, and of each class customers and tables."""
        seen = [int((c == i).sum()) for c in (self.c0, self.c1, self.c2) for i in (1, 2)]
        scalars = np.array([self.c2.sum(), len(self.words), self.c0.sum(), self.t0.sum(), *seen], np.int64)
        sums = [np.bincount(by, weights=n, minlength=k).astype(np.int64) for by, n, k in ((self.x1, self.c1, COARSE), (self.x1, self.t1, COARSE), (self.x2, self.c2, self.fine), (self.x2, self.t2, self.fine))]
        return np.concatenate([scalars, *sums])

    def sweep(self, known: np.ndarray, number: int) -> None:
        rng = np.random.default_rng([SEED, self.bucket, number])
        p0, p1, _ = self.probabilities(known)
        k = Totals(known)
        self.t2 = seats(self.c2, (STRENGTH + k.d[2] * k.T2[self.x2]) * p1[self.up], k.d[2], rng)
        self.c1 = np.bincount(self.up, weights=self.t2, minlength=len(self.key1)).astype(np.int64)
        self.t1 = seats(self.c1, (STRENGTH + k.d[1] * k.T1[self.x1]) * p0[self.word1], k.d[1], rng)
        self.c0 = np.bincount(self.word1, weights=self.t1, minlength=len(self.words)).astype(np.int64)
        self.t0 = seats(self.c0, np.full(len(self.c0), (STRENGTH + k.d[0] * k.T0) * k.uniform), k.d[0], rng)

    def probabilities(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word, of each word in each coarse class, and in each fine one, where there are customers."""
        k = Totals(known)
        p0 = (self.c0 - k.d[0] * self.t0 + (STRENGTH + k.d[0] * k.T0) * k.uniform) / (STRENGTH + k.C0)
        p1 = (self.c1 - k.d[1] * self.t1 + (STRENGTH + k.d[1] * k.T1[self.x1]) * p0[self.word1]) / (STRENGTH + k.C1[self.x1])
        p2 = (self.c2 - k.d[2] * self.t2 + (STRENGTH + k.d[2] * k.T2[self.x2]) * p1[self.up]) / (STRENGTH + k.C2[self.x2])
        return p0, p1, p2

    def counts(self) -> np.ndarray:
        """How often each word occurs."""
        return np.bincount(self.key2 // self.fine, weights=self.c2, minlength=len(self.words))

    def places(self, word: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Where words (numbers in ``words``, -1: not among them) after fine classes have customers, coarse and fine; -1: nowhere."""
        out = []
        for keys, asked in ((self.key1, word * COARSE + x // (self.fine // COARSE)), (self.key2, word * self.fine + x)):
            at = np.searchsorted(keys, asked)
            at[(word < 0) | (np.r_[keys, -1][at] != asked)] = -1
            out.append(at)
        return out

    def ask(self, known: np.ndarray, word: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The probability of words (numbers in ``words``, -1: not among them) after fine classes."""
        return Asked(self, known)(word, x, *self.places(word, x))


class Asked:
    """The probabilities of one state of restaurants, made once for all that is asked of it."""

    def __init__(self, state: Restaurants, known: np.ndarray):
        k = Totals(known)
        self.p0, self.p1, self.p2 = (np.r_[p, 0.0] for p in state.probabilities(known))
        self.p0[-1] = (STRENGTH + k.d[0] * k.T0) * k.uniform / (STRENGTH + k.C0)
        self.up1, self.up2 = (STRENGTH + k.d[1] * k.T1) / (STRENGTH + k.C1), (STRENGTH + k.d[2] * k.T2) / (STRENGTH + k.C2)
        self.share = state.fine // COARSE

    def __call__(self, word: np.ndarray, x: np.ndarray, at1: np.ndarray, at2: np.ndarray) -> np.ndarray:
        p = np.where(at1 < 0, self.up1[x // self.share] * self.p0[word], self.p1[at1])
        return np.where(at2 < 0, self.up2[x] * p, self.p2[at2])


class Totals:
    def __init__(self, known: np.ndarray):
        known = known.astype(np.float64)
        self.C1, self.T1 = known[SCALARS : SCALARS + 2 * COARSE].reshape(2, -1)
        self.C2, self.T2 = known[SCALARS + 2 * COARSE :].reshape(2, -1)
        _, words, self.C0, self.T0, *seen = known[:SCALARS]
        self.uniform = 1 / (words + 1)
        # the usual estimate of a discount, from how many words were seen once and twice
        self.d = [min(max((a + 1) / (a + 2 * b + 2), 0.05), 0.95) for a, b in zip(seen[::2], seen[1::2], strict=True)]


def dealt(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of sorted words that have some, the order by bucket, and where each one's begin and end."""
    b = (mix(h) >> U(11)) % U(buckets)
    order = np.argsort(b, kind="stable")
    edge = np.flatnonzero(np.r_[True, b[order][1:] != b[order][:-1]][: len(b)])
    return b[order][edge].astype(np.int64), order, np.r_[edge, len(b)]


def score(df: DataFrame, id: str = "doc_id", text: str = "text", train: str | None = None) -> DataFrame:
    """One row per row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``train`` is a condition that tells the rows to learn from; without one, those for which
    crc32(id as text) mod 10 is not 0. Every row is scored. A null or empty text has one token, its end.
    A null id counts as an empty text in the condition. Repeated rows count as often as they occur and get
    equal scores. Other columns aren't read. An empty table gives an empty result; without a row to learn
    from, all words are unknown.
    """
    spark = df.sparkSession
    learnt = F.expr(train) if train else F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 10 != 0
    docs = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id).cast("long").alias("id"), F.coalesce(learnt, F.lit(False)).alias("learnt"), F.col(text).cast("binary").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    buckets, fine = max(1, int(size) // BUCKET_BYTES + 1), classes(int(size))
    narrow = np.uint16 if fine <= 1 << 16 else np.uint32

    def flushes(batches: Iterator[pa.RecordBatch], learnt_only: bool) -> Iterator[tuple]:
        """Tokens of many texts at a time: hashes, classes, numbers of the texts, and the texts' columns."""
        held, columns, docs_, n = [], [[], [], []], 0, 0
        for chunk in chunks(batches):
            raw = chunk.column("text").to_pylist()
            if learnt_only:
                raw = [t for t, use in zip(raw, chunk.column("learnt").to_pylist(), strict=True) if use]
            for at in range(0, len(raw), 1 << 14):
                h, x, doc = tokens(raw[at : at + (1 << 14)], fine)
                if held and (n + len(h) > FLUSH or docs_ + len(raw[at : at + (1 << 14)]) > 1 << 16):
                    yield *(np.concatenate(c) for c in zip(*held, strict=True)), columns
                    held, columns, docs_, n = [], [[], [], []], 0, 0
                held.append((h, x, doc + docs_))
                if not learnt_only:
                    part = chunk.slice(at, 1 << 14)
                    for column, name in zip(columns, ("rid", "id", "learnt"), strict=True):
                        column += part.column(name).to_pylist()
                docs_ += len(raw[at : at + (1 << 14)])
                n += len(h)
        if held:
            yield *(np.concatenate(c) for c in zip(*held, strict=True)), columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (h, x, _, _) in enumerate(flushes(batches, True)):
            h, x, n = counted(h, x, np.ones(len(h), np.uint32))
            names, order, edge = dealt(h, buckets)
            rows = [packed(h[r], x[r], n[r], narrow) for r in (order[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), number)), *[pa.array(c, pa.binary()) for c in zip(*rows, strict=True)]], ["b", "part", *BYTES])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of a bucket's parts."""
        b = []

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                b[:] = [batch.column("b")[0].as_py()]
                for i in range(batch.num_rows):
                    words, runs, x, c = unpacked(batch, i, narrow)
                    yield np.repeat(words, runs), x.copy(), c.astype(np.int64)

        whole = packed(*added_up(parts()), narrow)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array([0], pa.int64()), *[pa.array([x], pa.binary()) for x in whole]], ["b", "part", *BYTES])

    kind = "b long, part long, h binary, runs binary, x binary, n binary"
    counts = docs.select("learnt", "text").where("learnt").mapInArrow(count, kind)
    salts = int(size) // (4 * FLUSH * MERGED)
    if salts:
        counts = counts.withColumn("part", F.pmod(F.xxhash64("part", F.spark_partition_id()), F.lit(salts))).groupBy("b", "part").applyInArrow(merge, kind)
    counts = stage(counts.groupBy("b").applyInArrow(merge, kind).drop("part"), "counts")

    def load(batch: pa.RecordBatch, i: int) -> Restaurants:
        return Restaurants.of(batch.column("b")[i].as_py(), *unpacked(batch, i, narrow), fine)

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("v").to_pylist())
        return pa.table({"r": table.column("r")[:1], "s": pa.array([0], pa.int64()), "v": [total.tobytes()]})

    length = SCALARS + 2 * COARSE + 2 * fine
    history: list[np.ndarray] = []
    while len(history) <= SWEEPS:
        so_far = list(history)

        def totals(batches: Iterator[pa.RecordBatch], so_far: list = so_far) -> Iterator[pa.RecordBatch]:
            """The sum of a task's totals, in ranges."""
            found = np.zeros(length, np.int64)
            for batch in batches:
                for row in range(batch.num_rows):
                    state = load(batch, row)
                    for i, known in enumerate(so_far):
                        state.sweep(known, i)
                    found += state.totals()
            starts = range(0, length, RANGE)
            salt = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int64()), pa.array([salt] * len(starts), pa.int64()), pa.array([found[a : a + RANGE].tobytes() for a in starts], pa.binary())], ["r", "s", "v"])

        kinds = "r long, s long, v binary"
        sums = counts.mapInArrow(totals, kinds).groupBy("r", "s").applyInArrow(added, kinds).groupBy("r").applyInArrow(added, kinds)
        # a vector as long as there are classes, whatever the corpus
        vector = [np.frombuffer(r["v"], np.int64) for r in sorted(sums.collect(), key=lambda r: r["r"])]
        history.append(np.concatenate(vector) if vector else np.zeros(length, np.int64))
    n_train, n_words = int(history[0][0]), int(history[0][1])

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each group of texts, its header (bucket -1), and each bucket's words, classes and texts."""
        names = ["b", "flush", *BYTES, "docs", "ids", "learnt"]
        for h, x, doc, (rid, ids, learnt_) in flushes(batches, False):
            order = np.lexsort((x, h))  # which leaves equal ones in the order of their texts
            h, x, doc = h[order], x[order], doc[order]
            edge = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])])
            n = np.diff(np.r_[edge, len(h)])
            b, by, ends = dealt(h[edge], buckets)
            rows = []
            for k, (s, e) in zip(b.tolist(), zip(ends[:-1], ends[1:], strict=True), strict=True):
                r = by[s:e]
                at = np.repeat(edge[r] - (np.cumsum(n[r]) - n[r]), n[r]) + np.arange(n[r].sum())
                rows.append((k, rid[0], *packed(h[edge[r]], x[edge[r]], n[r], narrow), doc[at].astype(np.uint16).tobytes(), None, None))
            rows.append((-1, rid[0], None, None, None, np.bincount(doc, minlength=len(rid)).astype(np.uint32).tobytes(), None, ids, learnt_))
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    asked = docs.mapInArrow(request, "b long, flush long, h binary, runs binary, x binary, n binary, docs binary, ids array<long>, learnt array<boolean>")
    asked = stage(asked, "asked")
    # buckets with very frequent words are scored by many tasks
    loads = asked.where("b >= 0").groupBy("b").agg(F.sum(F.octet_length("docs") / 2).alias("t")).withColumn("s", F.ceil(F.col("t") / SCORED).cast("int")).select("b", "s")
    loads = stage(loads, "loads")
    words = asked.where("b >= 0").select("b", "flush", *BYTES, "docs").join(loads, "b").withColumn("salt", F.pmod(F.xxhash64("flush"), F.col("s")).cast("int")).drop("s")
    models = loads.join(counts, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).drop("s")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by text of what is asked of a bucket. Its model, the row without a group of texts, comes first, or none does."""
        known, waiting = None, []
        for batch in batches:
            at = np.flatnonzero(batch.column("flush").is_null().to_numpy(zero_copy_only=False))
            if known is None and len(at):
                known = learned(load(batch, int(at[0])))
                for x in waiting:
                    yield answered(x, *known)
                waiting = []
            if known is None:
                waiting.append(batch)
            else:
                yield answered(batch, *known)
        if waiting:
            none = np.zeros(0, np.int64)
            known = learned(Restaurants(0, none.astype(np.uint64), none, none, fine))
            for x in waiting:
                yield answered(x, *known)

    def learned(state: Restaurants) -> tuple[Restaurants, list[Asked], np.ndarray]:
        states = []
        for i in range(SWEEPS):
            state.sweep(history[i], i)
            if i >= BURN_IN:
                states.append(Asked(state, history[i + 1]))
        seen = np.r_[state.counts(), 0.0]
        return state, states, np.log10((seen + 0.1) / (n_train + 0.1 * (n_words + 1)))

    def answered(batch: pa.RecordBatch, state: Restaurants, states: list[Asked], base: np.ndarray) -> pa.RecordBatch:
        out = []
        for i in range(batch.num_rows):
            flush = batch.column("flush")[i].as_py()
            if flush is None:
                continue
            h, runs, x, n = unpacked(batch, i, narrow)
            docs_ = np.frombuffer(batch.column("docs")[i].as_buffer(), np.uint16)
            word = np.searchsorted(state.words, h)
            word = np.where(np.r_[state.words, U(0)][word] == h, word, -1) if len(state.words) else np.full(len(h), -1)
            word, x = np.repeat(word, runs), x.astype(np.int64)
            at = state.places(word, x)
            p = sum(ask(word, x, *at) for ask in states)
            # of the texts that have words here, as most haven't once there are many buckets
            some = np.flatnonzero(np.bincount(docs_))
            known, *sums = (np.bincount(docs_, weights=np.repeat(v, n))[some] for v in ((word >= 0).astype(float), base[word], np.log10(p / len(states))))
            out.append((flush, batch.column("b")[i].as_py(), some.astype(np.uint16).tobytes(), known.astype(np.uint32).tobytes(), *[s.tobytes() for s in sums]))
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        columns = zip(*out, strict=True) if out else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["flush", "b", "some", "known", "base", "score"])

    asks = words.unionByName(models, allowMissingColumns=True).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("flush").asc_nulls_first())
    parts = asks.groupBy("b", "salt").applyInArrow(answer, "flush long, b long, some binary, known binary, base binary, score binary")
    heads = asked.where("b < 0").select("flush", F.col("b"), F.col("n"), "ids", "learnt")
    both = parts.unionByName(heads, allowMissingColumns=True)

    def gather(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("b").to_numpy())
        head = table.slice(int(order[0]), 1).to_pylist()[0]
        n = np.frombuffer(head["n"], np.uint32).astype(np.int64)
        sums = {"known": np.zeros(len(n)), "base": np.zeros(len(n)), "score": np.zeros(len(n))}
        for i in order[1:].tolist():
            some = np.frombuffer(table.column("some")[i].as_buffer(), np.uint16)
            for name, total in sums.items():
                total[some] += np.frombuffer(table.column(name)[i].as_buffer(), np.uint32 if name == "known" else np.float64)
        held = [not x for x in head["learnt"]]
        return pa.table({"id": pa.array(head["ids"], pa.int64()), "held_out": held, "n_tokens": n, "n_known": np.rint(sums["known"]).astype(np.int64), "train_tokens": np.full(len(n), n_train), "base_score": sums["base"], "score": sums["score"], "perplexity": 10 ** (-sums["score"] / np.maximum(n, 1))})

    return both.groupBy("flush").applyInArrow(gather, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


def in_training(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 != 0
