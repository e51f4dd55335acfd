"""Quality rules by repetition coverage: characters inside duplicated word n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import SPACE, U, Rolling, Words, chunks, mix

#: Word n-gram lengths, and the percentage of word characters above which duplicates of that length reject.
NGRAM_LIMITS = {5: 40, 8: 32, 12: 30}
#: The same for lines that repeat an earlier one.
LINE_LIMIT = 30
#: The base rule.
BASE_NGRAM, LEAST_WORDS, BASE_LIMIT = 8, 20, 30
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def covered(words: Words, hashes: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that occurs twice or more in their text, the first included."""
    cover = np.zeros(len(hashes) + 1, np.int64)
    start = np.arange(max(0, len(hashes) - n + 1))
    start = start[words.doc[start] == words.doc[start + n - 1]] if len(start) else start
    if len(start):
        key = mix(Rolling(hashes)(start, start + n) ^ mix(words.doc[start].astype(np.uint64) + U(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = start[order[np.r_[same, False] | np.r_[False, same]]]
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + n, -1)
    return np.cumsum(cover[:-1]) > 0


def repeated_lines(text: bytes) -> tuple[int, int]:
    """The lines with a word that equal an earlier line, and the characters of their words."""
    seen, lines, chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line in seen:
            lines += 1
            chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
        elif not line.isspace() and line:
            seen.add(line)
    return lines, chars


def measure(texts: list[bytes | None], ngrams: Sequence[int]) -> dict[str, np.ndarray]:
    """The counts of each text; null counts as empty, and an empty text has zero of everything."""
    texts = [t or b"" for t in texts]
    words = Words(texts)
    hashes = words.hashes()
    chars = np.zeros(len(words.bytes) + 1, np.int64)
    np.cumsum(~SPACE[words.bytes] & ((words.bytes & 0xC0) != 0x80), out=chars[1:])
    long = chars[words.end] - chars[words.start]
    per = lambda x: np.bincount(words.doc, weights=x, minlength=len(texts)).astype(np.int64)
    symbols = np.zeros(len(words.bytes) + 1, np.int64)
    np.cumsum(SYMBOLS[words.bytes], out=symbols[1:])
    lines = np.array([repeated_lines(t) for t in texts], np.int64).reshape(len(texts), 2)
    out = {"n_words": words.count, "word_chars": per(long), "n_symbols": np.diff(symbols[words.texts]), "n_dup_lines": lines[:, 0], "dup_line_chars": lines[:, 1]}
    for n in sorted({BASE_NGRAM, *ngrams}):
        inside = covered(words, hashes, n)
        out[f"dup{n}_chars"] = per(long * inside)
        if n == BASE_NGRAM:
            out["n_repeat_words"] = per(inside)
    return out


def repetition(df: DataFrame, text: str = "text", limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT, carry: Sequence[str] = ()) -> DataFrame:
    """The columns ``carry`` of each row, its repetition counts and the verdict ``kept``.

    Every row gives one row. A null or empty text has no words and is rejected by the base rule, which
    takes at least 20 words. Texts are judged alone, so repeated rows get equal verdicts. Other columns,
    whatever their names, are not read. A text of any length is judged whole by one task.
    """
    limits = NGRAM_LIMITS if limits is None else limits
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup{n}_chars" for n in sorted({BASE_NGRAM, *limits})]]
    given = df.select(F.struct(*[F.col(c) for c in carry]).alias("_row") if carry else F.struct(F.lit(0).alias("_")).alias("_row"), F.col(text).cast("binary").alias("text"))
    schema = given.select("_row").schema
    for name in names:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found = measure(chunk.column("text").to_pylist(), sorted(limits))
            yield pa.RecordBatch.from_arrays([chunk.column("_row"), *[pa.array(found[n], pa.int64()) for n in names]], ["_row", *names])

    out = given.mapInArrow(run, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > BASE_LIMIT * F.col("n_words"))
    over = 100 * F.col("dup_line_chars") > line_limit * F.col("word_chars")
    for n, most in limits.items():
        over = over | (100 * F.col(f"dup{n}_chars") > most * F.col("word_chars"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in carry], *names[:5], "base_failed", "kept", *names[5:])


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])


def filter_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    given = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    return repetition(given, carry=["_doc"]).where("kept").select("_doc.*")


def _ngram_sql(n: int) -> str:
    return f"""g{n} AS (SELECT doc_id, i, hash(array_to_string(w[i:i+{n - 1}], ' ')) AS g FROM w, unnest(range(1, greatest(len(w) - {n - 2}, 1))) t(i)),
c{n} AS (SELECT DISTINCT doc_id, i + o AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g{n}) q, range({n}) r(o) WHERE c > 1),
s{n} AS (SELECT doc_id, count(*) AS words, sum(len(w[p])) AS chars FROM c{n} JOIN w USING (doc_id) GROUP BY doc_id)"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
{", ".join(_ngram_sql(n) for n in sorted(NGRAM_LIMITS))},
l AS (SELECT doc_id, line, ord FROM d, unnest(string_split(text, chr(10))) WITH ORDINALITY t(line, ord)),
dl AS (SELECT doc_id, count(*) AS n, sum(len(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS chars FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY ord) AS r FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) q
  WHERE r > 1 GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(s8.words, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(dl.chars, 0) AS BIGINT) AS dup_line_chars,
  {", ".join(f"CAST(coalesce(s{n}.chars, 0) AS BIGINT) AS dup{n}_chars" for n in sorted(NGRAM_LIMITS))}
  FROM w {" ".join(f"LEFT JOIN s{n} USING (doc_id)" for n in sorted(NGRAM_LIMITS))} LEFT JOIN dl USING (doc_id)),
v AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {BASE_LIMIT} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars
  {" ".join(f"AND 100 * dup{n}_chars <= {m} * word_chars" for n, m in NGRAM_LIMITS.items())} AS kept FROM v
"""
