"""Mixture-controlled packing: deficit round-robin over source queues.

Every window of ``size`` ids draws from each source's queue what the queue's deficit counter allows. A
counter gains the queue's target share of a window, loses what is drawn, and carries the rest on. While all
queues last, counters only depend on the shares: with M_i the ids of the queues up to i in these windows and N
those of all, queue i has given

    B_i(k) = C_i(k) - C_(i-1)(k),    C_i(k) = floor(k * size * M_i / N)

ids in the first k windows. So its counter, k * size * m_i / N - B_i(k), stays within one id of zero, each
window is full, and any task can take up the round at any window with the counters that belong there:
deficits are carried across windows and partitions without one task going through all of them. Where a queue
can't fill its share of one more window a *phase* ends, and the others share the windows of the next by their
targets; the rests of queues, less than a window's share each, fill the last windows together. Without targets
of its own the mixture is the corpus's, and one phase has all.

A queue must have a share of at least one id a window, else its documents would be cut into single ids. Sources
below that share one queue, in the order of a hash, and have its target.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import running, stage, uniform_key
from siltstone.llm.tokens import VOCABULARY, tokenized, width

SIZE = 2048


def floor_ratio(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """floor(a * b / n) of integers below 2**63 whose product may exceed 64 bits: guessed, then put right modulo 2**64."""
    guess = np.floor(a.astype(np.float64) * b / n).astype(np.int64)
    with np.errstate(over="ignore"):
        left = a * b - guess * n
    return guess + left // n


def given(k: np.ndarray, m: np.ndarray, total: int, size: int) -> np.ndarray:
    """C_i(k), for queues with ``m`` ids up to their end; from the last window on, all of them."""
    last = -(-total // size)
    return np.where(k >= last, m, floor_ratio(np.minimum(k, last) * size, m, total))


def cut(start: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, total: int, size: int) -> tuple[np.ndarray, ...]:
    """Pieces of documents at ``start`` .. ``start + n`` in queues that hold the ids ``low`` .. ``high`` of all queues.

    Returns arrays: document's index, start in the document, length, window, offset in the window.
    """
    drawn = lambda k, i: given(k, high[i], total, size) - given(k, low[i], total, size)

    def window(at: np.ndarray) -> np.ndarray:
        i = np.arange(len(at))
        k = np.floor(at.astype(np.float64) * total / np.maximum(high - low, 1) / size).astype(np.int64)
        while (over := drawn(k, i) > at).any():
            k = k - over
        while (under := drawn(k + 1, i) <= at).any():
            k = k + under
        return k

    first, last = window(start), window(start + n - 1)
    doc = np.repeat(np.arange(len(n)), last - first + 1)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[doc]
    begin, end = drawn(k, doc), drawn(k + 1, doc)
    a, b = np.maximum(begin, start[doc]), np.minimum(end, (start + n)[doc])
    before = given(k + 1, low[doc], total, size) - given(k, low[doc], total, size)
    some = b > a
    return tuple(x[some] for x in (doc, a - start[doc], b - a, k, before + a - begin))


def phases(m: list[int], shares: list[int] | None, size: int) -> list[np.ndarray]:
    """How many ids each queue gives in each phase, queues with ``m`` ids and the target shares; all of them in all."""
    left, out = [int(x) for x in m], []
    open_ = [i for i, x in enumerate(shares or []) if x > 0]
    while open_:
        whole = sum(shares[i] for i in open_)
        # of so many windows each queue can fill its share, rounded up
        k = min((left[i] - 1) * whole // (size * shares[i]) for i in open_)
        if k > 0:
            given_, at, up = [0] * len(left), 0, 0
            for i in open_:
                up += shares[i]
                given_[i] = k * size * up // whole - at
                at += given_[i]
            left = [x - g for x, g in zip(left, given_, strict=True)]
            out.append(np.array(given_, np.int64))
        open_ = [i for i in open_ if (left[i] - 1) * whole >= size * shares[i]]
    return [*out, np.array(left, np.int64)] if sum(left) or not out else out


def numbered(sources: list) -> F.Column:
    """The queue of a row's source: its place in the list, or the queue after them."""
    pairs = [F.lit(x) for i, s in enumerate(sources) if s is not None for x in (s, i)]
    null = sources.index(None) if None in sources else len(sources)
    other = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(len(sources))) if pairs else F.lit(len(sources))
    return F.when(F.col("source").isNull(), F.lit(null)).otherwise(other)


def pack(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", size: int = SIZE, vocabulary: str = VOCABULARY, with_ids: bool = True, shares: dict | None = None) -> DataFrame:
    """One row per piece: id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (unless not wanted).

    ``shares`` are the sources' target proportions in each window, as whole numbers; sources that it doesn't name
    come last. Without them targets are the sources' shares of all ids. Every id of every row lies in one piece; all sequences have ``size`` ids but the last. A null or
    empty text is the end id alone. A null source is a source. Rows with equal ids are packed apart,
    repeated rows too. A document's place in its queue is a hash's. Other columns aren't read. An empty
    table gives no rows.
    """
    rows = df.select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    table = stage(tokenized(rows, "text", ["id", "source"], vocabulary), "tokens")
    sums = table.groupBy("source").agg(F.sum("n_ids").alias("m"))
    total = int(sums.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0])
    small = F.col("m") * size < total
    # at most size + 1 rows: sources that have a share of a window, and what the others have together
    queues = sorted(((r["own"], r["m"]) for r in sums.groupBy(F.when(~small, F.struct(F.lit(1).alias("own"), "source")).alias("own")).agg(F.sum("m").alias("m")).collect()), key=lambda q: (q[0] is None, q[0] is not None and (q[0]["source"] is None, str(q[0]["source"]))))
    pooled = [q for q in queues if q[0] is None]
    if pooled and pooled[0][1] * size < total and len(queues) > 1:
        pooled.append(min((q for q in queues if q[0] is not None), key=lambda q: q[1]))
    alone = [q for q in queues if q not in pooled]
    held = [q[1] for q in alone] + [sum(q[1] for q in pooled)]
    aims = None if shares is None else [int(shares.get(q[0]["source"], 0)) for q in alone] + [sum(int(shares.get(q[0]["source"], 0)) for q in pooled if q[0] is not None)]
    steps = phases(held, aims, size)
    placed = table.withColumn("queue", numbered([q[0]["source"] for q in alone]))
    placed = running(placed.withColumn("_key", uniform_key("id", "crc", "n_ids")), ["queue"], ["_key", "id", "crc", "n_ids"], "n_ids", "_at")
    kind = width(vocabulary)
    # for each phase: where it begins in each queue, the ends of the queues in it, all its ids, and its first window
    begins = np.concatenate([np.zeros((1, len(held)), np.int64), np.cumsum(steps, axis=0)])
    bounds = [np.concatenate([[0], np.cumsum(x)]) for x in steps]
    opens = np.cumsum([0, *[-(-int(x.sum()) // size) for x in steps]])
    schema = placed.select("id", "source").schema.add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                queue, start, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("queue", "_at", "n_ids"))
                found = []
                for p, x in enumerate(bounds):
                    a, b = np.maximum(start, begins[p][queue]), np.minimum(start + n, begins[p + 1][queue])
                    some = np.flatnonzero(b > a)
                    if len(some):
                        q = queue[some]
                        doc, at_, length, k, offset = cut((a - begins[p][queue])[some], (b - a)[some], x[q], x[q + 1], int(x[-1]), size)
                        found.append((some[doc], at_ + (a - start)[some][doc], length, k + opens[p], offset))
                doc, begin, length, k, offset = (np.concatenate(c) for c in zip(*found, strict=True))
                ids = [np.frombuffer(x, kind).astype("<u4") for x in batch.column("ids").to_pylist()]
                pieces = [ids[d][a : a + m] for d, a, m in zip(doc.tolist(), begin.tolist(), length.tolist(), strict=True)]
                crc = [zlib.crc32(p.tobytes()) for p in pieces]
                lists = []
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(pieces).astype(np.int32))))
                take = pa.array(doc)
                columns = [pa.array(np.asarray(x, np.int64)) for x in (begin, length, crc, n[doc], k, offset)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("source").take(take), *columns, *lists], schema.names)

    return placed.select("id", "source", "n_ids", "ids", "queue", "_at").mapInArrow(run, schema)


DIGEST = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).withColumnRenamed("id", "doc_id").select(*DIGEST)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, with_ids=False).withColumnRenamed("id", "doc_id").select(*DIGEST)
