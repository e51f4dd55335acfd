"""Token ids by a public tokenizer whose words are encoded apart: each distinct word once per worker."""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm.common import chunks

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END = 1
#: Words that a worker remembers; beyond that it begins anew.
REMEMBERED = 500_000
#: Marks that never join a letter beside them, in this tokenizer's words (an apostrophe can).
MARKS = ".,!?;:#$%&*|()[]{}<>\"-_/+=~^@\\"


class Encoder(dict):
    """word -> its ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words
    in turn. A word of plain letters, with or without marks at its end, is split and put in lower case
    here as the tokenizer would, and its model is asked for the parts; any other word goes to the
    tokenizer whole.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.plain: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        found = self.plain.get(part)
        if found is None:
            if len(self.plain) >= 2 * REMEMBERED:
                self.plain.clear()
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(SHOWN)
            found = self.plain[part] = pack(*[t.id for t in self.merge(shown)])
        return found

    def __missing__(self, word: str) -> bytes:
        body = word.rstrip(MARKS)
        if len(word) <= 64 and body.isalpha() and (body.isascii() or max(body) < "\u0130"):
            found = self.part(body.lower())
            if len(body) < len(word):
                found += self.part(word[len(body) :])
        else:
            found = pack(*self.tokenizer.encode(word, add_special_tokens=False).ids)
            if len(word) > 64:
                return found
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found

    def text(self, text: bytes | None) -> bytes:
        words = (text or b"").decode("utf-8", "replace")
        for c in "\t\n\v\f\r":
            if c in words:
                words = words.replace(c, " ")
        return b"".join([self[w] for w in words.split(" ") if w])


def pack(*ids: int) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def shown_bytes() -> dict[int, str]:
    """How a byte-level vocabulary shows bytes: printable ones as themselves, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


SHOWN = shown_bytes()


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget() -> None:
    """Give back what a worker keeps for encoding."""
    encoder.cache_clear()
    pa.default_memory_pool().release_unused()


def width(path: str) -> str:
    """The smallest type that holds the vocabulary's ids."""
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def encoded(batches: Iterator[pa.RecordBatch], kind: str, vocabulary: str = VOCABULARY, end: int = END) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
    """Slices of the batches, each with n_ids, ids (packed as ``kind``) and crc (of the 32-bit ids) of its column ``text``."""
    encode = encoder(vocabulary)
    last = np.array([end], "<u4").tobytes()
    for chunk in chunks(batches):
        ids = [encode.text(t) + last for t in chunk.column("text").to_pylist()]
        packed = [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in ids]
        yield chunk, [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(packed, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]


def tokenized(df: DataFrame, text: str, carry: Sequence[str], vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """The columns ``carry`` of each row, n_ids, ids (packed in ``width``) and crc (of the 32-bit ids).

    Whole texts are encoded and ``end`` is appended; a null or empty text gives ``end`` alone.
    """
    given = df.select(F.struct(*carry).alias("_row"), F.col(text).cast("binary").alias("text"))
    kind = width(vocabulary)
    schema = given.select("_row").schema.add("n_ids", "long").add("ids", "binary").add("crc", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, columns in encoded(batches, kind, vocabulary, end):
            yield pa.RecordBatch.from_arrays([chunk.column("_row"), *columns], ["_row", "n_ids", "ids", "crc"])

    return given.mapInArrow(run, schema).select("_row.*", "n_ids", "ids", "crc")
