"""Personal data: plain identifiers, and disguised ones found by offset-preserving deobfuscation.

A chain of transducers rewrites a text: look-alike characters to ASCII, spelled digits to digits, and
"at" / "dot" disguises to their signs. Each keeps, for every character that it writes, the span of source
characters it stands for. The plain detectors run on what comes out, and their spans are mapped back.
A text that no transducer changes isn't searched twice.
"""

from __future__ import annotations

import copy
import hashlib
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import chunks
from siltstone.llm.endings import ENDINGS

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def emails(text: str) -> list[Span]:
    """From each at sign outwards, so that a long run of other characters is passed over once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append((begin, found.end()))
            done = found.end()
        at = text.find("@", found.end() if found else at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]


def detect(text: str) -> dict[str, list[Span]]:
    """The spans of each kind, leftmost first and without overlaps; failing matches are dropped, not retried."""
    numbers = DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if numbers and "." in text else [],
        "card": cards(text) if numbers else [],
        "phone": phones(text) if numbers and "+" in text else [],
    }


# Letters of other scripts that look like Latin ones, in the order of the second string.
ALIKE = {a: chr(b) for a, b in str.maketrans("аеорсухіјѕһԁԛԝвкмнтАВЕКМНОРСТУХІЈЅαοενρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwbkmhtABEKMHOPCTYXIJSaoevptuikABEZHIKMNOPTYX").items()}
ALIKE |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
ALIKE |= dict.fromkeys(map(ord, "‐‑‒–—−﹣"), "-")
ALIKE |= dict.fromkeys(map(ord, "      　"), " ")
ALIKE |= dict.fromkeys(map(ord, "․。｡"), ".") | {0xFE6B: "@", 0x2795: "+"}
ALIKE |= dict.fromkeys(map(ord, "­​‌‍⁠﻿"), "")
ALIKE |= {c: str(unicodedata.decimal(chr(c))) for c in [*range(0x0660, 0x066A), *range(0x06F0, 0x06FA), *range(0x0966, 0x0970), *range(0x1D7CE, 0x1D800)]}
LOOKS = re.compile("[" + "".join(re.escape(chr(c)) for c in ALIKE) + "]")
# The digits' names in four languages, from zero to nine.
NAMES = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zéro un deux trois quatre cinq six sept huit neuf",
)
DIGITS = {name: str(i) for names in NAMES for i, name in enumerate(names.split())} | {"oh": "0"}
_NAME = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")(?![^\\W\\d_])"
_POINT = r"(?:dot|punkt|punto|point)(?![^\W\d_])"
_GAP = r"[ ,]{0,2}[ \n-]"
SPELLED = re.compile(rf"(?<![^\W_])(?:plus{_GAP})?(?:{_NAME}|[0-9]++)(?:(?:{_GAP})(?:{_POINT}{_GAP})?(?:{_NAME}|[0-9]++(?![^\W_])))+", re.IGNORECASE)
PART = re.compile(rf"(?P<plus>plus)|(?P<point>{_POINT})|(?P<name>{_NAME})|(?P<number>[0-9]+)", re.IGNORECASE)
#: Runs of fewer names may be prose beside a number; they are read both as spelled digits and as they stand.
SURE_NAMES = 4
#: Endings of a host's or file's name after "at" in prose ("look at main.py"), and words after "at this point":
#: with a plain point only the first count there, with a spoken one all top-level domains but the second.
USUAL = frozenset("com org net edu gov info io co biz eu uk de fr es it nl us ch at be ca".split())
PROSE = frozenset("am as at by do here how in is it me my no now one so to today you".split()) - USUAL
AT_SIGN = re.compile(r"[ \t]?[\[({<][ \t]*(?:at|arroba|chez|ät|@)[ \t]*[\])}>][ \t]?", re.IGNORECASE)
DOT_SIGN = re.compile(r"[ \t]?[\[({<][ \t]*(?:dot|punkt|punto|point|\.)[ \t]*[\])}>][ \t]?", re.IGNORECASE)
SPOKEN = re.compile(rf"(?<=[A-Za-z0-9])(?P<at>[ \t]+(?:at|arroba|ät|@)[ \t]+|@)(?P<labels>(?:[A-Za-z0-9-]+(?:[ \t]+(?:dot|punkt|punto|point)[ \t]+|\.))*[A-Za-z0-9-]+)(?P<dot>[ \t]+(?:dot|punkt|punto|point)[ \t]+|\.)(?P<end>{'|'.join(sorted(ENDINGS, key=len, reverse=True))})(?![A-Za-z0-9])", re.IGNORECASE)
SPOKEN_DOT = re.compile(r"[ \t]+(?:dot|punkt|punto|point)[ \t]+", re.IGNORECASE)
NAMED_DOT = re.compile(r"(?<=[A-Za-z0-9])[ \t]+(?:dot|punkt|punto|point)[ \t]+(?=[A-Za-z0-9._%+-]*(?:@|[ \t]+(?:at|arroba|ät)[ \t]))", re.IGNORECASE)


class Rewritten:
    """A text, and the source characters that each of its characters stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put strings in place of spans, given in order; each new character stands for all that it replaces."""
        if not edits:
            return
        if self.start is None:
            self.start = np.arange(len(self.text))
            self.end = self.start + 1
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += [self.start[at:a], np.full(len(new), self.start[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end = np.concatenate([*start, self.start[at:]]), np.concatenate([*end, self.end[at:]])

    def source(self, span: Span) -> Span:
        return int(self.start[span[0]]), int(self.end[span[1] - 1])


def look_alikes(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    return [(*m.span(), ALIKE[ord(m[0])]) for m in LOOKS.finditer(text)]


def spelled_digits(runs: list[list[re.Match]], least: int, trim: bool = False) -> list[tuple[int, int, str]]:
    """Runs of names of digits, with numbers among them: gaps beside a name go, and "dot" becomes a point.

    A run has ``least`` names, or if one is enough, a point. With ``trim``, names at its ends stay as they
    are where a number follows or precedes them.
    """
    edits = []
    for parts in runs:
        kinds = [p.lastgroup for p in parts]
        if trim and "number" in kinds:
            while kinds[0] == "name" and next(k for k in kinds if k != "name") == "number":
                parts, kinds = parts[1:], kinds[1:]
            while kinds[-1] == "name" and next(k for k in reversed(kinds) if k != "name") == "number":
                parts, kinds = parts[:-1], kinds[:-1]
        if kinds.count("name") < least and not (least == 1 and "point" in kinds):
            continue
        for i, p in enumerate(parts):
            new = {"plus": "+", "point": ".", "name": DIGITS.get(p[0].lower(), "")}.get(p.lastgroup)
            beside = i > 0 and "number" not in (p.lastgroup, parts[i - 1].lastgroup)
            mixed = i > 0 and (p.lastgroup != "number" or parts[i - 1].lastgroup != "number")
            if (beside or mixed) and parts[i - 1].end() < p.start():
                edits.append((parts[i - 1].end(), p.start(), ""))
            if new is not None:
                edits.append((*p.span(), new))
    return edits


def signs(text: str) -> list[tuple[int, int, str]]:
    edits = [(*m.span(), "@") for m in AT_SIGN.finditer(text)] + [(*m.span(), ".") for m in DOT_SIGN.finditer(text)]
    return apart(edits)


def apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The edits in order, none of them over another: what an earlier one covers is cut off a later one's beginning."""
    out: list[tuple[int, int, str]] = []
    for a, b, new in sorted(set(edits)):
        a = max(a, out[-1][1]) if out else a
        if a < b:
            out.append((a, b, new))
    return out


def spoken(text: str) -> list[tuple[int, int, str]]:
    edits, ends = [], set()
    for m in SPOKEN.finditer(text):
        end, dot = m["end"].lower(), m["dot"].strip().lower()
        if m["at"].strip().lower() == "at" and (end in PROSE if dot in ("dot", "point") else dot == "." and end not in USUAL):
            continue
        edits.append((*m.span("at"), "@"))
        edits += [(*d.span(), ".") for d in SPOKEN_DOT.finditer(text, m.start("labels"), m.end("labels"))]
        edits.append((*m.span("dot"), "."))
        ends.add(m.end())
    # a dot right after an address's end doesn't lengthen it
    edits += [(*m.span(), ".") for m in NAMED_DOT.finditer(text) if m.start() not in ends]
    return apart(edits)


def deobfuscated(text: str) -> Iterator[Rewritten]:
    """Readings of the text, by which runs are spelled digits: the sure ones, all, all without names at their ends."""
    plain = Rewritten(text)
    plain.replace(look_alikes(text))
    low = plain.text.lower()
    runs = [list(PART.finditer(plain.text, *run.span())) for run in SPELLED.finditer(plain.text)]
    tried: list[list] = []
    for least, trim in ((SURE_NAMES, False), (1, False), (1, True)):
        edits = spelled_digits(runs, least, trim)
        if edits in tried:
            continue
        tried.append(edits)
        out = copy.copy(plain)
        out.replace(edits)
        if any(b in out.text for b in "[({<"):
            out.replace(signs(out.text))
        if "@" in out.text or " at " in low or "arroba" in low or " ät " in low:
            out.replace(spoken(out.text))
        yield out


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """The plain spans of each kind, and those that only show when the text is deobfuscated.

    Of the latter, those that touch a plain span of their kind are left out: plain spans stay as they are.
    Runs with few names are read last, so that a name beside a number hides nothing that shows without it.
    """
    base = detect(text)
    added: dict[str, list[Span]] = {k: [] for k in KINDS}
    for clear in deobfuscated(text):
        if clear.start is None:
            continue
        for kind, spans in detect(clear.text).items():
            for span in map(clear.source, spans):
                if all(span[1] <= a or b <= span[0] for a, b in [*base[kind], *added[kind]]):
                    added[kind].append(span)
    return base, {k: sorted(v) for k, v in added.items()}


def listed(spans: dict[str, list[Span]]) -> str:
    """kind:start:end, by start, then by kind in the order of ``KINDS``."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, KINDS.index(k), b) for k, found in spans.items() for a, b in found))


def redacted(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at, last = [], 0, 0
    for a, b, kind in sorted((a, b, k) for k, found in spans.items() for a, b in found):
        if a >= last:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = last = max(last, b)
    return "".join([*out, text[at:]])


def personal_data(df: DataFrame, text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """The columns ``carry`` of each row, n_<kind> (plain spans), n_added, base_sha256, spans and redacted.

    Offsets count code points of the whole text, ends excluded. A null text counts as empty and has no
    spans (its ``redacted`` is null). Texts are judged alone; repeated rows give equal rows. Other columns,
    whatever their names, aren't read. An empty table gives an empty result.
    """
    given = df.select(F.struct(*carry).alias("_row") if carry else F.struct(F.lit(0).alias("_")).alias("_row"), F.col(text).cast("binary").alias("text"))
    schema = given.select("_row").schema
    counts = [f"n_{k}" for k in KINDS] + ["n_added"]
    for name in counts:
        schema = schema.add(name, "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("redacted", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            columns: list[list] = [[] for _ in range(8)]
            for raw in chunk.column("text").to_pylist():
                value = (raw or b"").decode("utf-8", "replace")
                base, added = find(value)
                both = {k: base[k] + added[k] for k in KINDS}
                row = [*(len(base[k]) for k in KINDS), sum(map(len, added.values())), hashlib.sha256(listed(base).encode()).hexdigest(), listed(both), None if raw is None else redacted(value, both)]
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 5 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([chunk.column("_row"), *map(pa.array, columns, kinds)], schema.names)

    out = given.mapInArrow(run, schema)
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in carry], *counts, "base_sha256", "spans", "redacted")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added")


def redact_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their personal data replaced; n_chars, where there is one, is that of the new text."""
    given = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    found = personal_data(given, carry=["_doc"])
    new = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("redacted").isNull(), F.col("_doc.n_chars")).otherwise(F.length("redacted").cast(docs.schema["n_chars"].dataType))
    return found.select(*[new[c].alias(c) if c in new else F.col(f"_doc.{c}").alias(c) for c in docs.columns])
