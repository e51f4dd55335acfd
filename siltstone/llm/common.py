"""Helpers shared by the operators of this subpackage: the shared folder, text chunks, hashes, offsets.

Conventions used everywhere in ``llm``:

* a *word* is a run of bytes other than 0x20 and 0x09-0x0D;
* a null text is an empty text; extra columns of an input are ignored unless an operator says it
  carries them;
* intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_KEYS = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 2**64))
#: Text is worked on in pieces of about this size, so that numpy's temporaries stay small.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where all of Spark runs on it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/siltstone-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``stage`` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in {f.rpartition("/")[0] for f in df.inputFiles() if "/siltstone-" in f}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text; one longer text makes a slice alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > at and held + n > limit:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        yield batch.slice(at)


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one byte array, each followed by a newline; where each begins, and the end."""
    texts = [t or b"" for t in texts]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), starts


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class Rolling:
    """Hashes of all slices of a sequence, from its prefix polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(BASE, n), out=self.prefix[1:])
        self.back = powers(BASE_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.back[start]


class Words:
    """The words of joined texts: starts, ends, document of each, and a 64-bit hash of each."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        self.bytes, self.texts = joined(texts)
        if lower:
            self.bytes = LOWER[self.bytes]
        inside = np.zeros(len(self.bytes) + 1, np.int8)
        inside[1:] = ~SPACE[self.bytes]
        edges = np.diff(inside)
        self.start, self.end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.doc = np.searchsorted(self.texts, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(self.count, out=self.first[1:])

    def hashes(self) -> np.ndarray:
        h = Rolling(BYTE_KEYS[self.bytes])(self.start, self.end)
        return mix(h + (self.end - self.start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def uniform_key(*columns) -> F.Column:
    """60 bits of the md5 of the columns: an order that spreads any keys evenly, the same in other engines."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("~")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


KEY_BITS = 60


def running(df: DataFrame, group: list[str], order: list[str], value: str | None, out: str) -> DataFrame:
    """Per ``group``, the sum of ``value`` (None: the number) over the rows before each row in ``order``.

    ``order[0]`` is a ``uniform_key``. Its leading bits cut each group into slices that one task can
    hold, however large the group: rows are ranked in their slice, and the sums of the slices before
    it are added. What comes out doesn't depend on the number of slices.
    """
    from pyspark.sql import Window

    slices = 1 << (4 * tasks(df.sparkSession) - 1).bit_length()
    df = df.withColumn("_slice", F.shiftright(F.col(order[0]), KEY_BITS - slices.bit_length() + 1).cast("int"))
    # without nulls, so that the sums are joined on the columns that the rows are dealt by already
    keys = ["_slice"]
    for i, c in enumerate(group):
        df = df.withColumn(f"_g{i}", F.coalesce(F.col(c).cast("string"), F.lit(""))).withColumn(f"_n{i}", F.col(c).isNull())
        keys += [f"_g{i}", f"_n{i}"]
    one = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    sums = df.groupBy(*keys).agg(F.sum(one).alias("_sum"))
    over = Window.partitionBy(*keys[1:]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(over), F.lit(0).cast("long")).alias("_before"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_own", F.coalesce(F.sum(one).over(inner), F.lit(0).cast("long")))
    return df.join(sums, keys).withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before", *keys)


def forest(near: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` vectors, the least one that it reaches by the links of ``a`` with ``b``."""
    root, seen = np.arange(n), np.ones(n, bool)
    seen[a[near.any(1)]], seen[b[near.any(0)]] = False, False
    for x in np.flatnonzero(~seen):
        if seen[x]:
            continue
        seen[x], new = True, np.zeros(n, bool)
        new[x] = True
        # breadth first; a vector is taken up once, so rows and columns are read once
        while new.any():
            reached = np.zeros(n, bool)
            reached[b] |= near[new[a]].any(0)
            reached[a] |= near[:, new[b]].any(1)
            new = reached & ~seen
            seen |= new
            root[new] = x
    return root


#: Rows of one key from which a join splits them, at least.
LEAST_SPLIT = 64


def spread_join(many: DataFrame, few: DataFrame, key: str, count: str = "c", total: int | None = None) -> DataFrame:
    """``many`` joined with ``few`` on ``key``, keys of very many rows dealt to several tasks.

    ``few`` has a row a key with its number of rows in ``many``. A key with more than a quarter of a task's
    share is hot: of those there are at most four for each task, so they are broadcast whatever the tables' size.
    ``total`` is the rows of ``many``, if that is known.
    """
    if total is None:
        total = few.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    most = max(LEAST_SPLIT, int(total) // (4 * tasks(many.sparkSession)))
    parts = F.when(F.col(count) > most, F.ceil(F.col(count) / most)).otherwise(1).cast("int")
    hot = F.broadcast(few.where(F.col(count) > most).select(key, parts.alias("_parts")))
    dealt = many.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*[c for c in many.columns if c != key]), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    # by shuffle at every size: ``few`` grows with the data
    return dealt.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).hint("merge"), [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """The connected components of ``edges`` (a, b: of one type): rows (node, component), the smallest node.

    Large-star and small-star steps alternate until nothing changes. A node's smallest neighbour is an
    aggregate that is joined back, the edges of a hub in many tasks, so that no node's neighbours meet in one.
    """
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen, n = None, links.count()
    while n:
        both = links.union(links.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        large = spread_join(both, low, "u", total=2 * n).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        small = spread_join(large, low, "a", total=n).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        old, links = links, stage(small.where("a <> b").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(old)
        if now == seen:
            break
        seen, n = now, now[0]
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
