"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A set's sketch has ``COORDINATES`` entries. In round i every element is hashed to a bin and a value
i + h, and a bin keeps its least value; rounds go on until all bins are filled. In the first t rounds
the bin is hashed as well, in the last t rounds it is the round's own, so that every bin fills and the
entries of two sets agree with the probability of their Jaccard similarity, concentrated as for t
independent ones. Most sets need a few rounds, not t hashes of each element.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Rolling, U, Words, chunks, components, discard, forest, mix, spread_join, stage

#: The similarity that op7's contract names, and the one for which near copies leave a corpus.
SHINGLE, PERCENT, CORPUS_PERCENT = 5, 85, 80
#: Two sets at the threshold share no band with at most this probability; coordinates of a sketch at most.
MISSED, COORDINATES = 1e-6, 384
#: Of what rounds of leaders leave, buckets of up to so many classes are joined with themselves, as their sets are then
#: moved once; larger ones are compared in blocks of about BLOCK classes. Either way every pair is compared.
SMALL, BLOCK = 16, 384


def banding(percent: int) -> tuple[int, int]:
    """Rows of a band, and bands: the longest bands that miss a pair at the threshold with probability ``MISSED`` at most."""
    for rows in range(16, 0, -1):
        bands = int(np.ceil(np.log(MISSED) / np.log1p(-((percent / 100) ** rows)))) if percent < 100 else 1
        if rows * bands <= COORDINATES or rows == 1:
            return rows, bands


def shingle_sets(texts: list[bytes | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sets of hashed k-word shingles, each sorted, one after the other; where each begins, and the end."""
    words = Words(texts, lower=True)
    rolling = Rolling(words.hashes())
    width = np.minimum(words.count, k)
    n = np.where(words.count > 0, words.count - width + 1, 0)
    doc = np.repeat(np.arange(len(texts)), n)
    first = np.concatenate([[0], np.cumsum(n)])
    start = np.arange(first[-1]) - first[doc] + words.first[doc]
    h = mix(rolling(start, start + width[doc]) + width[doc].astype(np.uint64))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def salt(i: int) -> np.uint64:
    return U((int(i) + 1) * 0xA0761D6478BD642F % 2**64)


def sketches(h: np.ndarray, starts: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The sketch of each set as a row of t integers; an empty set's row is all ones."""
    sets = len(starts) - 1
    out = np.full((sets, t), ~U(0))
    doc = np.repeat(np.arange(sets), np.diff(starts))
    filled = np.zeros((sets, t), bool)
    open_ = np.diff(starts) > 0
    for i in range(t):
        if not open_.any():
            break
        live = open_[doc]
        d, x = doc[live], mix(h[live] + salt(i))
        at = d * t + ((x >> U(32)) * U(t) >> U(32)).astype(np.int64)
        # a value begins with its round, so bins of earlier rounds keep theirs
        value = (U(i) << U(48)) | (mix(x) >> U(16))
        todo = ~filled.ravel()[at]
        np.minimum.at(out.ravel(), at[todo], value[todo])
        filled.ravel()[at] = True
        open_ &= ~filled.all(1)
    for s in np.flatnonzero(open_):
        own = h[starts[s] : starts[s + 1]]
        for b in np.flatnonzero(~filled[s]):
            out[s, b] = (U(t + b) << U(48)) | (mix(mix(own + salt(t + b))) >> U(16)).min()
    return out


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch; the band's number is part of it."""
    rows = sketch.reshape(len(sketch), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * U(0xE7037ED1A0B428DB), rows.shape[:2]).copy()
    for r in range(rows.shape[2]):
        key = mix(key + rows[:, :, r])
    return key


def _sketched(percent: int):
    rows, bands = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each set its size, a digest of all of it, and its band keys."""
        for chunk in chunks(batches, limit=1 << 19):
            h, starts = shingle_sets(chunk.column("text").to_pylist())
            keys = band_keys(sketches(h, starts, rows * bands), bands).view(np.int64)
            sig = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([chunk.column("rid"), chunk.column("id"), pa.array(np.diff(starts), pa.int64()), pa.array(sig, pa.binary()), lists], ["rid", "id", "n", "sig", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches):
        h, starts = shingle_sets(chunk.column("text").to_pylist())
        sets = [h[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([chunk.column("rid"), pa.array(sets, pa.binary())], ["node", "set"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b, ...), those with 100 * intersection >= percent * union of their full sets.

    A leader is in very many pairs, so its set goes to as many tasks as those need.
    """
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    # by shuffle at every size, as pairs and sets both grow with the data
    leaders = sets.select(F.col("node").alias("b"), F.col("set").alias("y")).hint("merge").join(pairs.groupBy("b").agg(F.count("*").alias("c")), "b")
    full = spread_join(pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")).hint("merge"), "a"), leaders, "b").drop("c")
    return full.select(*names, "x", "y").mapInArrow(run, pairs.schema)


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``a`` has in common with each of ``b``."""
    owner = np.repeat(np.arange(len(b)), [len(x) for x in b])
    every = np.concatenate(b)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    out = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(a):
        low, high = np.searchsorted(every, x, "left"), np.searchsorted(every, x, "right")
        n = high - low
        at = np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())
        out[i] = np.bincount(owner[at], minlength=len(b))
    return out


def compared(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components whose classes meet in large buckets, found block against block.

    A bucket of c classes is cut into c / ``BLOCK`` blocks by a hash, and two blocks of it are compared at a time.
    A pair that meets in several buckets is compared in the least one. What comes out joins what is linked and
    grows with a block's classes, not with its pairs.
    """
    count = F.ceil(F.col("c") / BLOCK).cast("int")
    keys = members.groupBy("node").agg(F.collect_list("key").alias("keys"))
    rows = members.where(F.col("c") > SMALL).select("key", "node", "component", "c").join(keys.join(sets, "node"), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "c")

    def links(table: pa.Table) -> pa.Table:
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        own, component = (table.column(c).to_numpy() for c in ("own", "component"))
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        less = [k[k < key] for k in map(np.array, table.column("keys").to_pylist())]
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        both = shared([found[x] for x in a], [found[x] for x in b])
        n = np.array([len(x) for x in found])
        near = 100 * both >= percent * (n[a][:, None] + n[b] - both)
        near &= component[a][:, None] != component[b]
        near &= shared([less[x] for x in a], [less[x] for x in b]) == 0
        x = component[forest(near, a, b, len(n))]
        linked = x != component
        return pa.table({"a": component[linked], "b": x[linked]})

    return rows.groupBy("key", "i", "j").applyInArrow(links, "a long, b long")


def joined_up(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Nodes and their components, after components that ``links`` (a, b) tells of are one."""
    new = components(links)
    if found is None:
        return new
    to = new.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    moved = found.join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return moved.union(new.join(found, "node", "left_anti").select("node", "component"))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, number: str | None = None) -> DataFrame:
    """One row per row of ``df``: rid, id, n_shingles, component_id, kept, first.

    Rows with equal sets are one class, known by a digest of the set, and bands are joined between classes
    only. In rounds, a bucket's classes are compared with a leader, the class that meets most others in all
    buckets, and the leader leaves the bucket; buckets whose classes are in one component are done. When a
    round no longer halves the pairs of different components, those that are left are compared with each
    other. So no link is lost, while a bucket of near copies costs about as many comparisons as it has
    members. Comparisons are of full sets. Rows of frequent keys, sets and leaders are dealt to many tasks.

    ``rid`` is the column ``number``, a number of each row that is stored, so that every reading has the same;
    without one, rows are numbered and staged here. ``component_id`` is the
    least non-null id reachable (null: none), ``kept`` is id = component_id (null id: false), ``first``
    is true for one row of each component. A null, empty or wordless text has an empty set, links with
    nothing and is its own component. Repeated rows link. Other columns aren't read. An empty table
    gives an empty result. A very long text is sketched whole by one task.
    """
    docs = df.select((F.col(number) if number else F.monotonically_increasing_id()).alias("rid"), F.col(id).alias("id"), F.col(text).cast("binary").alias("text"))
    # a second reading may be split, and so numbered, in another way
    docs = docs if number else stage(docs, "numbered")
    kind = docs.schema["id"].dataType.simpleString()
    rows = stage(docs.mapInArrow(_sketched(percent), f"rid long, id {kind}, n long, sig binary, bands array<long>"), "sketches")
    plain = rows.drop("bands")
    classes = plain.where("n > 0").groupBy("sig").agg(F.min("rid").alias("node"), F.min("id").alias("low"), F.count("*").alias("c"))
    classes = stage(classes, "classes")
    heads = rows.join(classes.select(F.col("node").alias("rid")), "rid", "left_semi").withColumnRenamed("rid", "node")
    banded = heads.select("node", "n", F.explode("bands").alias("key"))
    counts = stage(banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "keys")
    buckets = stage(spread_join(banded, counts, "key"), "buckets")
    weights = buckets.groupBy("node").agg(F.sum("c").alias("weight"))
    members = buckets.select("key", "node", "n").join(weights, "node")
    wanted = buckets.select(F.col("node").alias("rid")).distinct()
    # by shuffle at every size too: Spark would guess ``wanted`` from all buckets
    sets = stage(docs.select("rid", "text").join(wanted.hint("merge"), "rid", "left_semi").mapInArrow(_sets, "node long, set binary"), "sets")
    used = [counts, buckets, sets, *([] if number else [docs])]
    near = F.expr(f"component <> d AND 100 * least(n, m) >= {int(percent)} * greatest(n, m)")
    found, before = None, None
    while True:
        rest = members if found is None else members.join(found, "node", "left")
        rest = rest.withColumn("component", F.col("node") if found is None else F.coalesce("component", "node"))
        stat = rest.groupBy("key", "component").agg(F.count("*").alias("k"), F.max(F.struct("weight", "node", "n", "component")).alias("l"))
        stat = stat.groupBy("key").agg(F.sum("k").alias("c"), F.sum(F.col("k") * F.col("k")).alias("s"), F.max("l").alias("l")).where("c * c > s")
        stat = stage(stat.select("key", "c", "s", F.col("l.node").alias("b"), F.col("l.n").alias("m"), F.col("l.component").alias("d")), "leaders")
        left = stat.agg(F.coalesce(F.sum(F.col("c") * F.col("c") - F.col("s")), F.lit(0))).first()[0]
        used.append(stat)
        if left == 0:
            break
        every, before = before is not None and 2 * left > before, left
        led = stage(spread_join(rest, stat.drop("s"), "key"), "led")
        used.append(led)
        pairs = led
        if every:
            small = led.where(F.col("c") <= SMALL).drop("b", "m", "d", "c")
            pairs = small.join(small.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("component").alias("d")), "key").where("node < b")
        pairs = stage(pairs.where(near).select(F.col("node").alias("a"), "b", "component", "d").distinct(), "pairs")
        links = verified(pairs, sets, percent).select(F.col("component").alias("a"), F.col("d").alias("b"))
        if every:
            links = links.union(compared(led, sets, percent))
        old, found = found, stage(joined_up(found, links), "components")
        used += [pairs, *([] if old is None else [old])]
        if every:
            break
        members = led.where("node <> b").select("key", "node", "n", "weight")
    labels = classes.withColumn("component", F.col("node")) if found is None else classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labels.groupBy("component").agg(F.min("low").alias("component_id"), F.min(F.struct(F.col("low").isNull().alias("z"), "low", "node"))["node"].alias("head"))
    labels = labels.join(least, "component").select("sig", "c", "node", "low", "component_id", "head")
    out = stage(spread_join(plain.where("n > 0"), labels, "sig").drop("c"), "labelled")
    # of the head's class, the row with the least id stays, and of equal ids the least rid
    stays = out.where("node = head AND id <=> low").groupBy("sig").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("stays"))
    out = out.join(stays, "rid", "left").select("rid", "id", F.col("n").alias("n_shingles"), "component_id", F.coalesce("stays", F.lit(False)).alias("first"))
    lone = plain.where("n = 0").select("rid", "id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("first"))
    for df_ in used:
        discard(df_)
    out = out.union(lone)
    return out.select("rid", "id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"), "first")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that are near copies of another, of similarity 0.8 or more: one of each component stays."""
    numbered = stage(docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("_rid")), "numbered")
    given = numbered.select("_rid", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"))
    kept = stage(near_duplicates(given, percent=CORPUS_PERCENT, number="_rid").where("first").select(F.col("rid").alias("_rid")), "kept")
    # by shuffle at every size, as both grow with the data; texts aren't sorted for it, as numbers are looked up
    return numbered.join(kept.hint("shuffle_hash"), "_rid", "left_semi").select("_doc.*")


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM e JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""
