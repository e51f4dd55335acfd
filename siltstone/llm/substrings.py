"""Exact-substring dedup with a hash-compared suffix sort.

Bytes are removed that lie in a 50-byte string which also starts in a document with a smaller id.

1. Equal texts become one, that of the smallest id; its copies go whole.
2. *Anchors* are chosen by content: of the 20-byte strings in each 50-byte window, the one with the least
   hash. Equal windows have equal anchors, so only texts that share an anchor can share a window. About
   one byte in fifteen begins an anchor. A flush of texts (some MB) keeps those that two of its texts have,
   and of each sends one entry to the task that has the anchor's hash; the others are sent as they are, and
   those of one text only are dropped there. So an anchor that all texts have costs an entry a flush.
3. The bytes around the anchors that are left (30 before, 50 from it on) are dealt out by the anchor's hash.
   Here too a flush comes first: of equal contexts the smallest id's goes out, and the others are spans already,
   as a smaller id has all of their bytes. In each group the suffixes from the anchor and the reversed
   prefixes before it are merge-sorted. Two suffixes are compared by their longest common extension, found
   by binary search over prefix polynomial hashes; neighbours' extensions are then checked byte by byte. A
   window that begins a bytes before the anchor equals another if they share a run of extensions of at least
   50 - a in the first order, and one of at least a in the second.
4. The windows' spans go back to the texts, which are cut.

A window has 30 bytes beside its anchor, so at least 15 on one side. Anchors in very many texts, of which there
are few, are dealt out by those 15 bytes too, once for either side, and sorted for the windows of that side.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import BASE, BYTE_KEYS, Rolling, U, chunks, joined, mix, powers, scratch, spread_join, stage, tasks

LENGTH, ANCHOR = 50, 20
LEFT = LENGTH - ANCHOR
#: Bytes beside a frequent anchor by which it is dealt out; every window has them on one side.
SIDE = LEFT // 2
#: An anchor is frequent from so many texts on, and from a share of all anchors that at most FREQUENT have.
MOST, FREQUENT = 1 << 17, 4096
#: Anchors, and contexts of anchors, that a task has at once.
ANCHORS_PER_BUCKET, CONTEXTS_PER_BUCKET = 1 << 20, 1 << 17
#: Anchors, and contexts, that a task of texts gathers before it deals them out.
FLUSH, HELD = 1 << 19, 1 << 17
LAST = 2**63 - 1


def sliding(op: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """op over each n values in turn."""
    done, out = 1, x
    while done < n:
        step = min(done, n - done)
        out = op(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """Hash, text and place of each anchor; and, for all texts joined, where each begins, and slices' hashes.

    The place counts from the start of the joined texts.
    """
    data, starts = joined(texts)
    rolling, none = Rolling(BYTE_KEYS[data]), np.array([], np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, starts, rolling
    at = np.arange(len(data) - ANCHOR + 1)
    h = mix(rolling(at, at + ANCHOR)) | U(1)
    least = sliding(np.minimum, h, LEFT + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    ends = starts[1:][owner[: len(least)]] - 1
    least[np.arange(len(least)) + LENGTH > ends] = 0
    padded = np.concatenate([np.zeros(LEFT, np.uint64), least, np.zeros(LEFT, np.uint64)])
    chosen = np.flatnonzero(sliding(np.maximum, padded, LEFT + 1)[: len(h)] == h)
    return h[chosen], owner[chosen], chosen, starts, rolling


def extensions(rolling: Rolling, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The length of the common extension of the suffixes at x and y, ``most`` at most: binary search over hashes."""
    low, high = np.zeros(len(x), np.int64), most.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = rolling(x, x + mid) == rolling(y, y + mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def suffix_sort(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, ``length`` bytes from ``start``, by group (ascending already) and content.

    Returns the order and each one's common extension with the one before it (0 for a group's first).
    Runs double in each pass of the mergesort: an element's place is its own rank plus that in the run
    beside it, which binary search finds for all elements at once. Hashes only decide comparisons; the
    extensions returned are counted in bytes, so a collision can part equal suffixes but never join others.
    """
    n = len(start)
    rolling = Rolling(BYTE_KEYS[data])
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, n])
    begin, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    rank = np.arange(n) - begin
    order, width = np.arange(n), 1
    padded = np.concatenate([data, np.zeros(1, np.uint8)])

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y; equal ones as ``ties`` says."""
        most = np.minimum(length[x], length[y])
        e = extensions(rolling, start[x], start[y], most)
        a, b = padded[start[x] + np.where(e < most, e, 0)], padded[start[y] + np.where(e < most, e, 0)]
        return np.where(e < most, a < b, (length[x] < length[y]) | ((length[x] == length[y]) & ties))

    while width < (sizes.max() if n else 0):
        run = rank // width
        low = np.minimum((run ^ 1) * width, size)
        high = np.minimum(low + width, size)
        q = np.flatnonzero(low < high)
        low, high, x = low[q] + begin[q], high[q] + begin[q], order[q]
        base, right = low.copy(), run[q] % 2 == 1
        while len(live := np.flatnonzero(low < high)):
            mid = (low[live] + high[live]) // 2
            less = before(order[mid], x[live], right[live])
            low[live], high[live] = np.where(less, mid + 1, low[live]), np.where(less, high[live], mid)
        place = begin[q] + run[q] // 2 * 2 * width + rank[q] % width + low - base
        moved = order.copy()
        moved[place] = x
        order, width = moved, 2 * width
    lcp = np.zeros(n, np.int64)
    for at in range(1, n, 1 << 16):
        x, y = order[at - 1 : at - 1 + (1 << 16)][: n - at], order[at : at + (1 << 16)]
        width = int(max(length[x].max(), length[y].max(), 1))
        step = np.arange(width)
        same = (step < length[x][:, None]) & (step < length[y][:, None])
        reach = lambda s: padded[np.minimum(s[:, None] + step, len(data))]
        same &= reach(start[x]) == reach(start[y])
        lcp[at : at + len(x)] = np.where(same.all(1), width, same.argmin(1))
    lcp[first] = 0
    return order, lcp


def matches(data: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray, owner: np.ndarray, group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For contexts low:mid:high in ``data`` with an anchor at mid, sorted by group: the smallest owner of each
    window, a row for each number of bytes that it begins before the anchor.

    Where ``side`` is 1 only windows with ``SIDE`` bytes behind the anchor are looked at, where it is 2 those with
    as many before it.
    """
    n = len(low)
    right, right_lcp = suffix_sort(data, mid, high - mid, group)
    left, left_lcp = suffix_sort(data[::-1], len(data) - mid, mid - low, group)
    heads = np.r_[True, group[1:] != group[:-1]][:n]
    out = np.full((LEFT + 1, n), LAST)
    for a in range(LEFT + 1):
        runs = []
        for order, lcp, need in ((right, right_lcp, LENGTH - a), (left, left_lcp, a)):
            run = np.empty(n, np.int64)
            run[order] = np.cumsum((lcp < need) | heads)
            runs.append(run)
        key = runs[0] * (n + 1) + runs[1]
        by = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]][:n])
        if n:
            out[a, by] = np.repeat(np.minimum.reduceat(owner[by], edge), np.diff(np.r_[edge, n]))
        out[a, (mid - low < a) | (high - mid < LENGTH - a) | ((side == 1) & (a > LEFT - SIDE)) | ((side == 2) & (a < SIDE))] = LAST
    return out


def same_contexts(key: list[np.ndarray], start: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal contexts, by group first, and each context's number among those.

    Contexts with equal hashes are compared by their bytes; should two differ, each stays alone.
    """
    n = len(start)
    order = np.lexsort(key[::-1])
    fresh = np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)][:n] if n else np.zeros(0, bool)
    head = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    for at in range(0, n, 1 << 15):
        x, y = order[at : at + (1 << 15)], head[at : at + (1 << 15)]
        step = np.arange(size[x].max())
        inside = step < size[x][:, None]
        last = len(data) - 1
        equal = data[np.minimum(start[x][:, None] + step, last)] == data[np.minimum(start[y][:, None] + step, last)]
        fresh[at : at + len(x)] |= ~(equal | ~inside).all(1)
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[np.flatnonzero(fresh)], number


def dealt(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of the columns by bucket."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
    for a, b in zip(edges, np.r_[edges[1:], len(order)], strict=True):
        yield int(bucket[order[a]]), [c[order[a:b]] for c in columns]


def smaller(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of anchor and text, sorted; where each anchor's begin, and how many there are."""
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])][: len(h)]
    h, d = h[fresh], d[fresh]
    edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    return h, d, edge, np.diff(np.r_[edge, len(h)])


def merged(text: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans by text and place, those that touch as one."""
    order = np.lexsort((s, text))
    text, s, e = text[order], s[order], e[order]
    if not len(s):
        return text, s, e
    # ends only grow along a text, as all texts lie one after another in one line
    line = text.astype(np.int64) << 34
    reach = np.maximum.accumulate(line + e)
    first = np.r_[True, (line + s)[1:] > reach[:-1]]
    at = np.flatnonzero(first)
    return text[at], s[at], np.r_[reach[at[1:] - 1], reach[-1]] - line[at]


def repeated_substrings(df: DataFrame, id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256.

    A null text is empty. A null id counts as larger than all others; rows with equal ids don't remove
    from each other, unless both repeat a smaller one. Repeated rows give equal rows. Texts under 50 bytes
    stay whole. Only the two columns named are read, and they are read once. An empty table gives an empty
    result. ``most`` is how many texts an anchor is in at least before it is dealt out by the bytes beside it.
    """
    spark = df.sparkSession
    given = df.select(F.col(id).alias("id"), F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("o"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    given = given.withColumn("tk", F.unhex(F.md5("text")))
    rows = stage(given.select("id", "o", "tk", F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.octet_length("text") < LENGTH, F.col("text")).alias("short")), "rows")
    firsts = stage(rows.where(F.col("n_bytes") >= LENGTH).groupBy("tk").agg(F.min("o").alias("head_o"), F.count("*").alias("c")), "firsts")
    heads = firsts.select(F.xxhash64("head_o", "tk").alias("head_d"), "head_o", F.col("tk").alias("head"))
    buckets = min(max(tasks(spark), 4), 100_000)
    name, path = f"siltstone_{uuid.uuid4().hex}", scratch(spark, "texts")
    # texts are dealt out by a hash of id and digest, joined on it with those that are kept, and stored so: they are
    # moved once, and texts that share an id, or have none, aren't dealt to one task. In a second reading rows may come
    # in another order, but id and digest are the same; numbers are given where the texts are stored.
    texts = given.select(F.xxhash64("o", "tk").alias("d"), "o", "tk", "text").repartition(buckets, "d")
    exact = (F.greatest("o", "head_o") == F.least("o", "head_o")) & (F.greatest("tk", "head") == F.least("tk", "head"))
    texts = texts.join(heads, (F.col("d") == F.col("head_d")) & exact, "left_semi")
    texts = texts.groupBy("d", "o", "tk").agg(F.first("text").alias("text")).select("d", "o", F.monotonically_increasing_id().alias("rid"), "tk", "text")
    texts.write.bucketBy(buckets, "d").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    texts = spark.table(name)
    total = int(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    deal = total // (15 * ANCHORS_PER_BUCKET) + 1
    # no table has more anchors than bytes, so at most 15 * FREQUENT anchors are frequent
    limit = max(most, total // (15 * FREQUENT))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of anchors by bucket; and, dealt anywhere, the anchors that two texts of a flush have, by text."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        turn = itertools.count(TaskContext.get().partitionId() * 7919)

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, d, edge, count = smaller(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()
                both = np.repeat(count > 1, count)
                parts = [(b, hs.tobytes(), ds.tobytes(), ns.tobytes()) for b, (hs, ds, ns) in dealt((h[edge] >> U(8)) % U(deal), [h[edge], d[edge], count.astype(np.uint32)])]
                if both.any():
                    parts.append((deal + next(turn) % deal, h[both].tobytes(), d[both].tobytes(), None))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*parts, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], ["b", "h", "d", "n"])

        for chunk in chunks(batches):
            h, owner, *_ = anchors(chunk.column("text").to_pylist())
            if len(h):
                held.append((h, chunk.column("d").to_numpy()[owner]))
            if sum(len(x) for x, _ in held) >= FLUSH:
                yield from flush()
        yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        """The anchors of a bucket that two texts have, by text; frequent ones once more, without a text."""
        h = np.frombuffer(b"".join(table.column("h").to_pylist()), np.uint64)
        d = np.frombuffer(b"".join(table.column("d").to_pylist()), np.int64)
        if table.column("b")[0].as_py() >= deal:
            return pa.table({"d": d, "h": h.view(np.int64)})
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), np.uint32).astype(np.int64)
        order = np.lexsort((d, h))
        h, d, n = h[order], d[order], n[order]
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[edge, len(h)])
        shared = (d[edge] != d[edge + size - 1]) | (np.maximum.reduceat(n, edge) > 1)
        keep = np.repeat(shared, size) & (n == 1)
        often = h[edge][np.add.reduceat(n, edge) > limit]
        return pa.table({"d": pa.concat_arrays([pa.array(d[keep]), pa.nulls(len(often), pa.int64())]), "h": np.r_[h[keep], often].view(np.int64)})

    plain = texts.select("d", "o", "rid", "text")
    found = stage(plain.mapInArrow(find, "b long, h binary, d binary, n binary").groupBy("b").applyInArrow(meet, "d long, h long"), "anchors")
    frequent = np.sort(np.array([r["h"] for r in found.where("d IS NULL").select("h").collect()], np.int64).view(np.uint64))
    count = found.count()
    spread = 2 * count // CONTEXTS_PER_BUCKET + 1
    wanted = found.where("d IS NOT NULL").groupBy("d").agg(F.collect_list("h").alias("hs"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of shared anchors the bytes around them, by bucket, and spans that are known already, dealt anywhere."""
        held: list[list[np.ndarray]] = []
        turn = itertools.count(TaskContext.get().partitionId() * 7919)

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, context, left, right, o, rid, d, inside, data = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                size = left + right
                start = np.cumsum(size) - size
                first, number = same_contexts([h, context], start, size, data)
                least = np.full(len(first), LAST)
                np.minimum.at(least, number, o)
                later = o > least[number]
                out = []
                if later.any():
                    out.append((spread + next(turn) % spread, packed_spans(d[later], rid[later], (inside - left)[later], (inside + right)[later])))
                # each context with its owners' places; a frequent anchor's twice, by the bytes on either side of it
                often = np.isin(h[first], frequent)
                which, key, side = [np.flatnonzero(~often)], [h[first][~often]], [np.zeros(int((~often).sum()), np.uint8)]
                for code, offset, fits in ((1, (left + ANCHOR)[first], right[first] >= ANCHOR + SIDE), (2, (left - SIDE)[first], left[first] >= SIDE)):
                    x = np.flatnonzero(often & fits)
                    beside = data[(start[first] + offset)[x][:, None] + np.arange(SIDE)]
                    which.append(x)
                    key.append(mix(h[first][x] + mix((BYTE_KEYS[beside] * powers(BASE, SIDE)).sum(1) + U(code))))
                    side.append(np.full(len(x), code, np.uint8))
                which, key, side = (np.concatenate(x) for x in (which, key, side))
                places = np.flatnonzero(~later)
                places = places[np.argsort(number[places], kind="stable")]
                begin = np.searchsorted(number[places], which)
                n = np.searchsorted(number[places], which, "right") - begin
                for b, (w, k, sd, at, m) in dealt((key >> U(8)) % U(spread), [which, key, side, begin, n]):
                    item = places[np.repeat(at - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                    f = first[w]
                    bytes_ = data[np.repeat(start[f] - (np.cumsum(size[f]) - size[f]), size[f]) + np.arange(size[f].sum())]
                    columns = (k, context[f], left[f].astype(np.uint8), right[f].astype(np.uint8), sd, np.repeat(np.arange(len(w)), m).astype(np.uint32), o[item], rid[item], d[item], inside[item].astype(np.uint32))
                    out.append((b, b"".join([np.array([len(w), len(item)], np.int64).tobytes(), *(c.tobytes() for c in columns), bytes_.tobytes()])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary()), strict=True)], ["b", "blob"])

        for chunk in chunks(batches):
            raw = chunk.column("text").to_pylist()
            h, owner, at, starts, rolling = anchors(raw)
            lists = chunk.column("hs")
            every = lists.flatten().to_numpy().view(np.uint64)
            of = np.repeat(np.arange(len(raw)), np.diff(lists.offsets.to_numpy()))
            # an anchor is sought if its hash and text are among the pairs
            sought = np.sort(mix(every + mix(of.astype(np.uint64) + U(1))))
            asked = mix(h + mix(owner.astype(np.uint64) + U(1)))
            hit = sought[np.minimum(np.searchsorted(sought, asked), max(len(sought) - 1, 0))] == asked if len(sought) else np.zeros(len(asked), bool)
            left = np.minimum(at - starts[owner], LEFT)
            right = np.minimum(starts[owner + 1] - 1 - at, LENGTH)
            hit &= left + right >= LENGTH
            h, owner, at, left, right = (x[hit] for x in (h, owner, at, left, right))
            if len(h):
                size = left + right
                data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
                bytes_ = data[np.repeat(at - left - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                context = mix(rolling(at - left, at + right) + (left * 64 + right).astype(np.uint64))
                o, rid, d = (chunk.column(c).to_numpy()[owner] for c in ("o", "rid", "d"))
                held.append([h, context, left, right, o, rid, d, at - starts[owner], bytes_])
            if sum(len(x[0]) for x in held) >= HELD:
                yield from flush()
        yield from flush()

    def sort(table: pa.Table) -> pa.Table:
        """Of a bucket's contexts, sorted from the anchor on and back from it, the spans that a smaller id has too."""
        if table.column("b")[0].as_py() >= spread:
            return unpacked_spans(table.column("blob").to_pylist())
        parts, seen = [], 0
        for blob in table.column("blob"):
            blob = blob.as_buffer()
            n, m = np.frombuffer(blob, np.int64, 2).tolist()
            at, columns = 16, []
            for kind, count_ in ((np.uint64, n), (np.uint64, n), (np.uint8, n), (np.uint8, n), (np.uint8, n), (np.uint32, m), (np.int64, m), (np.int64, m), (np.int64, m), (np.uint32, m)):
                columns.append(np.frombuffer(blob, kind, count_, at))
                at += columns[-1].nbytes
            columns[5] = columns[5].astype(np.int64) + seen
            seen += n
            parts.append((*columns, np.frombuffer(blob, np.uint8, -1, at)))
        h, context, left, right, side, item, o, rid, d, inside, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        left, right = left.astype(np.int64), right.astype(np.int64)
        size = left + right
        start = np.cumsum(size) - size
        first, number = same_contexts([h, context], start, size, data)
        item = number[item]
        least = np.full(len(first), LAST)
        np.minimum.at(least, item, o)
        smallest = matches(data, start[first], (start + left)[first], (start + size)[first], least, h[first], side[first])
        before, after = np.full(len(o), -1), np.full(len(o), -1)
        for a in range(LEFT + 1):
            hit = smallest[a][item] < o
            before[hit] = a
            after[hit & (after < 0)] = LENGTH - a
        hit = before >= 0
        inside = inside.astype(np.int64)
        return unpacked_spans([packed_spans(d[hit], rid[hit], (inside - before)[hit], (inside + after)[hit])])

    around = plain.join(wanted, "d").select("d", "o", "rid", "text", "hs").mapInArrow(contexts, "b long, blob binary")
    spans = around.groupBy("b").applyInArrow(sort, "d long, rid long, s long, e long")
    # by d alone, which the texts are in buckets of
    spans = spans.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("rid", "s", "e"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            out = []
            for value, row, found_ in zip(chunk.column("text").to_pylist(), chunk.column("rid").to_pylist(), chunk.column("spans"), strict=True):
                kept, at, removed, n = [], 0, 0, 0
                if found_.is_valid:
                    flat = found_.values
                    own = flat.field(0).to_numpy() == row
                    for s, e in zip(flat.field(1).to_numpy()[own].tolist(), flat.field(2).to_numpy()[own].tolist(), strict=True):
                        if s > at or n == 0:
                            kept.append(value[at:s])
                            n += 1
                            removed -= s - e
                        elif e > at:
                            removed += e - at
                        at = max(at, e)
                kept.append(value[at:])
                rest = b"".join(kept)
                out.append((removed, n, rest, hashlib.sha256(rest).hexdigest()))
            yield pa.RecordBatch.from_arrays([chunk.column("tk"), *[pa.array(x) for x in zip(*out, strict=True)]], ["tk", "n_removed", "n_spans", "kept", "kept_sha256"])

    result = texts.join(spans, "d", "left").select("tk", "rid", "text", "spans").mapInArrow(cut, "tk binary, n_removed long, n_spans long, kept binary, kept_sha256 string")
    # short texts stay as they are, and copies of a smaller id's go whole: neither waits for the texts, however many there are
    none = [F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans")]
    short = rows.where(F.col("n_bytes") < LENGTH).select("id", "n_bytes", *none, F.col("short").alias("kept"), F.sha2("short", 256).alias("kept_sha256"))
    placed = spread_join(rows.where(F.col("n_bytes") >= LENGTH).select("id", "o", "tk", "n_bytes"), firsts, "tk")
    gone = placed.where("o > head_o").select("id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    own = placed.where("o = head_o").join(result, "tk").select("id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
    out = short.union(gone).union(own)
    # the plan has the table's files; its name is no longer needed
    spark.sql(f"DROP TABLE {name}")
    return out


def packed_spans(d: np.ndarray, rid: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    """Spans of texts, those that touch as one."""
    _, at, text = np.unique(rid, return_index=True, return_inverse=True)
    text, s, e = merged(text, s, e)
    return b"".join([np.array([len(s)], np.int64).tobytes(), d[at][text].tobytes(), rid[at][text].tobytes(), s.astype(np.int64).tobytes(), e.astype(np.int64).tobytes()])


def unpacked_spans(blobs: list[bytes]) -> pa.Table:
    columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        for i, c in enumerate(columns):
            c.append(np.frombuffer(blob, np.int64, n, 8 + 8 * n * i))
    return pa.table({name: np.concatenate(c) for name, c in zip(("d", "rid", "s", "e"), columns, strict=True)})


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, array_slice(b, i + 1, i + {LENGTH}) AS g FROM d, unnest(range(0, greatest(n - {LENGTH - 1}, 0))) t(i)),
m AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g),
x AS (SELECT w.doc_id, i FROM w JOIN m ON w.g = m.g WHERE m < w.doc_id),
f AS (SELECT *, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH}, -1) AS fresh FROM x),
r AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f),
s AS (SELECT doc_id, min(i) AS s, max(i) + {LENGTH} AS e FROM r GROUP BY doc_id, r),
p AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS o FROM s
  UNION ALL SELECT d.doc_id, n, NULL, coalesce(max(e), 0) FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, n),
k AS (SELECT p.doc_id, string_agg(hex(array_slice(b, o + 1, s)), '' ORDER BY s, o) AS kept,
  sum(e - s) AS n_removed, count(e) AS n_spans FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k JOIN d USING (doc_id)
"""
