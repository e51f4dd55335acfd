"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

A data set is a folder with ``ranks`` (the ids from the most frequent to the least, unsigned 32-bit) and
files ``ids-NNNNNN``, each a run of blocks in ascending document order. A block is

    magic, documents, ids, control bytes, data bytes      5 unsigned 32-bit integers
    document ids (signed 64-bit), null flags (bytes), ids of each document (unsigned 32-bit)
    control bytes: four 2-bit codes each, a code being a value's bytes less one
    data bytes: the ranks of the ids, little-endian, without leading zero bytes

all little-endian. A frequent id has a low rank and takes one byte. The decoder looks up the lengths of
four values at a time by their control byte.
"""

from __future__ import annotations

import contextlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import scratch, tasks
from siltstone.llm.tokens import VOCABULARY, encoded, forget, width

MAGIC = 0x31444954
BLOCK_IDS = 1 << 20
FILE_IDS = 10 << 20
#: Bytes of ids in a row group of the table that is sorted into files.
GROUP_BYTES = 4 << 20
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
OFFSETS = np.cumsum(LENGTHS, axis=1) - LENGTHS
TOTALS = LENGTHS.sum(axis=1)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    n = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = n - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    at = np.cumsum(n) - n
    data = np.empty(int(n.sum()), np.uint8)
    for i in range(4):
        has = n > i
        data[at[has] + i] = values[has] >> np.uint32(8 * i) & np.uint32(255)
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again, by table lookup of whole control bytes."""
    control = np.frombuffer(control, np.uint8)
    ends = np.cumsum(TOTALS[control])
    at = ((ends - TOTALS[control])[:, None] + OFFSETS[control]).ravel()[:count]
    n = LENGTHS[control].ravel()[:count]
    data = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = data[at].astype(np.uint32)
    for i in range(1, 4):
        has = np.flatnonzero(n > i)
        out[has] |= data[at[has] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def pack_block(doc_ids: list[int | None], ids: list[np.ndarray], rank: np.ndarray) -> bytes:
    control, data = encode(rank[np.concatenate(ids)])
    head = np.array([MAGIC, len(ids), sum(map(len, ids)), len(control), len(data)], "<u4")
    return b"".join([head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array([len(x) for x in ids], "<u4").tobytes(), control, data])


def blocks(file: BinaryIO) -> Iterator[tuple[int, int, int, int]]:
    """Documents, ids, control bytes and data bytes of a file's blocks in turn; the rest of each may be read meanwhile."""
    at = 0
    while head := file.read(20):
        magic, docs, count, controls, bytes_ = np.frombuffer(head, "<u4").tolist() if len(head) == 20 else [0] * 5
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        yield docs, count, controls, bytes_
        at += 20 + 13 * docs + controls + bytes_
        file.seek(at)


def unpack_blocks(file: BinaryIO, ids: np.ndarray) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """The documents of a file, block by block: their ids and their token ids. No more than a block is held."""
    for docs, count, controls, bytes_ in blocks(file):
        doc_ids, null, sizes = (np.frombuffer(file.read(docs * w), kind) for w, kind in ((8, "<i8"), (1, np.uint8), (4, "<u4")))
        control, data = file.read(controls), file.read(bytes_)
        if int(sizes.sum()) != count or len(control) != controls or len(data) != bytes_:
            raise ValueError("a token-id file that was cut off")
        values = ids[decode(control, data, count)]
        yield [None if z else d for d, z in zip(doc_ids.tolist(), null.tolist(), strict=True)], np.split(values, np.cumsum(sizes)[:-1])


@contextlib.contextmanager
def whole(uri: str) -> Iterator[pa.NativeFile]:
    """Write a file under a hidden name of its own, then move it: a repeated task leaves one whole file.

    Spark's own writers start processes that set a local file's mode; a process that starts shares its
    executor's memory and so shows as a second one of that size.
    """
    store, path = fs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    part = f"{folder}/_{name}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as out:
        yield out
    store.move(part, path)


@contextlib.contextmanager
def table_file(uri: str, first: pa.RecordBatch) -> Iterator[pq.ParquetWriter]:
    """A Parquet file with the columns of ``first``."""
    with whole(uri) as out, pq.ParquetWriter(out, first.schema, compression="zstd", compression_level=3, use_dictionary=False, write_statistics=False) as table:
        yield table


def write_token_files(df: DataFrame, folder: str, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``df``'s texts into files in ``folder``, ascending by ``id`` (long), nulls first.

    Returns one row per file: file, docs, ids. Ids are ranked by their counts over all documents, then
    by id; ids that don't occur come last. A null or empty text is the end id alone. Rows with equal ids
    are ordered by length and checksum. An empty table gives no ``ids-`` file. Other columns aren't read.
    """
    spark = df.sparkSession
    kind = width(vocabulary)
    parts, counts = scratch(spark, "tokens"), scratch(spark, "counts")
    for x in (folder, parts, counts):
        store, path = fs.FileSystem.from_uri(x)
        store.create_dir(path, recursive=True)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total, docs, held = TaskContext.get().partitionId(), np.zeros(1, np.int64), 0, []
        columns = (pa.RecordBatch.from_arrays([chunk.column("_id"), *of], ["_id", "n_ids", "ids", "crc"]) for chunk, of in encoded(batches, kind, vocabulary))
        first = next(columns, None)
        if first is None:
            return
        with table_file(f"{parts}/part-{number:06d}.parquet", first) as table:
            for batch in (x for part in ([first], columns) for x in part):
                got = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind))
                total = np.pad(total, (0, max(0, len(got) - len(total))))
                total[: len(got)] += got
                docs += batch.num_rows
                held.append(batch)
                if sum(x.nbytes for x in held) >= GROUP_BYTES:
                    table.write_table(pa.Table.from_batches(held))
                    held = []
            if held:
                table.write_table(pa.Table.from_batches(held))
        found = np.flatnonzero(total)
        found = pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])
        with table_file(f"{counts}/part-{number:06d}.parquet", found) as table:
            table.write_batch(found)
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64())], ["docs"])

    # a task that has ended isn't run again, as its one row goes to the driver
    df.select(F.col(id).cast("long").alias("_id"), F.col(text).cast("binary").alias("text")).mapInArrow(tokens, "docs long").collect()
    table = spark.read.schema("_id long, n_ids long, ids binary, crc long").parquet(parts)
    # at most as many rows as the vocabulary has ids
    counted = spark.read.schema("id long, n long").parquet(counts).groupBy("id").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(1 << (8 * np.dtype(kind).itemsize if kind == "<u2" else 20), np.int64)
    for row in counted:
        seen[row["id"]] = row["n"]
    order = np.argsort(-seen, kind="stable")
    order = order[: max(1, int((seen > 0).sum()))]
    rank = np.zeros(len(seen), np.uint32)
    rank[order] = np.arange(len(order))
    with whole(f"{folder}/ranks") as out:
        out.write(order.astype("<u4").tobytes())
    shared = spark.sparkContext.broadcast(rank)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tally = TaskContext.get().partitionId(), [0, 0]
        forget()

        def packed() -> Iterator[bytes]:
            docs, ids, held = [], [], 0
            for batch in batches:
                for d, x in zip(batch.column("_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                    docs.append(d)
                    ids.append(np.frombuffer(x, kind))
                    held += len(ids[-1])
                    if held >= BLOCK_IDS:
                        tally[0], tally[1] = tally[0] + len(docs), tally[1] + held
                        yield pack_block(docs, ids, shared.value)
                        docs, ids, held = [], [], 0
            if docs:
                tally[0], tally[1] = tally[0] + len(docs), tally[1] + held
                yield pack_block(docs, ids, shared.value)

        content = packed()
        first = next(content, None)
        if first is not None:
            with whole(f"{folder}/ids-{number:06d}") as out:
                for block in (x for part in ([first], content) for x in part):
                    out.write(block)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array(tally[:1], pa.int64()), pa.array(tally[1:], pa.int64())], ["file", "docs", "ids"])

    files = max(tasks(spark), -(-int(seen.sum()) // file_ids))
    # equal ids, and equal rows, may go to several files: those are of bounded size however often an id occurs
    ranged = table.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(files, "_id", "n_ids", "crc", "_at").sortWithinPartitions("_id", "n_ids", "crc").select("_id", "ids")
    # a row per file
    written = ranged.mapInArrow(write, "file long, docs long, ids long").toArrow()
    return spark.createDataFrame(written, "file long, docs long, ids long")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """What the files of ``folder`` hold, one row per document: file, place (in it), doc_id, ids (array of long)."""

    def documents(number: int, file: BinaryIO, ranks: np.ndarray) -> Iterator[list]:
        place = 0
        for docs, ids in unpack_blocks(file, ranks):
            n = len(docs)
            yield [np.full(n, number), np.arange(place, place + n), pa.array(docs, pa.int64()), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))]
            place += n

    return _read(spark, folder, "file long, place long, doc_id long, ids array<long>", documents)


def _read(spark: SparkSession, folder: str, columns: str, of: Callable[[int, BinaryIO, np.ndarray], Iterator[list]]) -> DataFrame:
    """What ``of`` gives for each file: it gets the file's number, the file and the ranks.

    A task has four files or so, fewer where that would leave cores idle.
    """
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/ranks") as file:
        ranks = np.frombuffer(file.read(), "<u4")
    found = [x.base_name for x in store.get_file_info(fs.FileSelector(path)) if re.fullmatch(r"ids-\d{6,}", x.base_name)]
    shared = spark.sparkContext.broadcast((sorted(found, key=lambda x: int(x[4:])), ranks))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, ranks = shared.value
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for i in batch.column("id").to_pylist():
                with store.open_input_file(f"{path}/{files[i]}") as file:
                    for arrays in of(int(files[i][4:]), file, ranks):
                        yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in arrays], names)

    n = len(found)
    parts = max(1, min(n, max(n // 4, 2 * spark.sparkContext.defaultParallelism)))
    return spark.range(0, n, 1, parts).mapInArrow(run, columns)


def read_token_spans(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # the heads of the blocks first, of which there is a row per file
    heads = _read(spark, folder, "file long, ids long", lambda number, file, _: iter([[np.array([number]), np.array([sum(n for _, n, *_ in blocks(file))])]]))
    before, total = {}, 0
    for row in sorted(heads.collect()):
        before[row["file"]], total = total, total + row["ids"]
    shared = spark.sparkContext.broadcast(before)

    def spans(number: int, file: BinaryIO, ranks: np.ndarray) -> Iterator[list]:
        at = shared.value[number]
        for docs, ids in unpack_blocks(file, ranks):
            sizes = np.array([len(x) for x in ids], np.int64)
            ends = at + np.cumsum(sizes)
            yield [pa.array(docs, pa.int64()), ends - sizes, sizes, pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
            at = int(ends[-1])

    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", spans)


def op3_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokenfiles")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_spans(spark, folder)
