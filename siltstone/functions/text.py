"""Text predicates and formats as column expressions, and pattern translators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# POSIX bracket classes and what they are in Java's expressions.
POSIX_CLASSES = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\p{Space}", "blank": r"\p{Blank}", "punct": r"\p{Punct}", "print": r"\p{Print}", "graph": r"\p{Graph}", "cntrl": r"\p{Cntrl}", "xdigit": r"\p{XDigit}"}


def fold_ascii(c: F.Column) -> F.Column:
    """Lower case for A-Z alone; other scripts stay as they are."""
    return F.translate(c, UPPER, LOWER)


def contains_ascii(c: F.Column, needle: str) -> F.Column:
    """Whether the text has ``needle``, A-Z and a-z alike; an empty needle is in every text."""
    return F.contains(fold_ascii(c), F.lit(needle.translate(str.maketrans(UPPER, LOWER))))


def glob_regex(glob: str) -> str:
    """The expression for a shell pattern in which ``*`` and ``?`` also match a slash and a leading dot."""
    out, i = [], 0
    while i < len(glob):
        c, i = glob[i], i + 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i < len(glob):
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "[" and (end := glob.find("]", i + 1 + glob.startswith(("!", "^"), i))) > 0:
            body = glob[i:end]
            negated = body[:1] in ("!", "^")
            body = body[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&&", "&\\&")
            out.append(f"[{'^' * negated}{body}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return f"^(?s:{''.join(out)})$"


def extended_regex(pattern: str) -> str:
    """A POSIX extended expression in Java's syntax: bracket classes are named otherwise there."""
    return re.sub(r"\[:(\w+):\]", lambda m: POSIX_CLASSES.get(m[1], m[0]), pattern)


def below(path: F.Column, prefix: str) -> F.Column:
    """Whether ``path`` is ``prefix`` or lies under it, as a range that reaches the scan, and the exact test."""
    prefix = prefix.strip("/")
    if prefix in ("", "."):
        return F.lit(True)
    # '0' follows '/', so what begins with prefix + '/' lies between them
    return (path >= prefix) & (path < prefix + "0") & ((path == prefix) | path.startswith(prefix + "/"))


def unsafe_path(path: F.Column) -> F.Column:
    """Whether a path is absolute or has a component that leads upwards."""
    return path.rlike(r"(^/)|(^|/)\.\.(/|$)")


def tenths(x: F.Column) -> F.Column:
    """One decimal of the exact value, a tie to the even one, as C's and DuckDB's formats have it; Java's %.1f rounds ties up."""
    return F.call_function("format_number", x, F.lit("0.0"))


def human_bytes(n: F.Column, units: str = "KMGT") -> F.Column:
    """Bytes with one decimal and a unit, from 1024 on; what is above the last unit stays in it."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for i, u in enumerate(units, 1):
        out = F.when(n >= 1 << (10 * i), F.concat(tenths(n / float(1 << (10 * i))), F.lit(u))).otherwise(out)
    return out


def long_bytes(n: F.Column, units: tuple[str, ...] = ("KB", "MB", "GB")) -> F.Column:
    """The same in words: 1.5 KB, 1023 B, and nothing above GB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, u in enumerate(units, 1):
        out = F.when(n >= 1 << (10 * i), F.concat(tenths(n / float(1 << (10 * i))), F.lit(f" {u}"))).otherwise(out)
    return out


def shown_time(seconds: F.Column, with_seconds: bool = False) -> F.Column:
    """A time of the session's zone, to the minute or the second."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss" if with_seconds else "yyyy-MM-dd HH:mm")


def basename(path: F.Column) -> F.Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def parent(path: F.Column) -> F.Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def plain_base64(x: F.Column) -> F.Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(x), "[\\r\\n]", "")


def pack_shard(number: F.Column) -> F.Column:
    """The folder of a pack: its number by 256, in four hexadecimal digits or more."""
    digits = F.lower(F.hex(F.floor(number / 256).cast("long")))
    return F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)


# Names of packs.
PACK_NAME = re.compile(r"pack-([0-9]{8})\.(?:dat|idx)")


def pack_number(name: str) -> int | None:
    """The number in a pack's name; none if it isn't one."""
    found = PACK_NAME.fullmatch(name)
    return int(found[1]) if found else None


def pack_path(number: int, ext: str = "dat") -> str:
    return f"pack-{number:08d}.{ext}"


def is_hash(c: F.Column) -> F.Column:
    return c.rlike("^[0-9a-fA-F]{64}$")


def type_letter(kind: F.Column) -> F.Column:
    # Node types 1 to 7.
    return F.element_at(F.array(*[F.lit(c) for c in "-dl-pcb"]), kind.cast("int"))


def mode_string(kind: F.Column, mode: F.Column) -> F.Column:
    """Like -rwxr-x---."""
    bits = [F.when(mode.bitwiseAND(1 << (8 - i)) != 0, "rwxrwxrwx"[i]).otherwise("-") for i in range(9)]
    return F.concat(type_letter(kind), *bits)


def node_type(mode: F.Column) -> F.Column:
    """The node type of a mode's format bits; anything else is regular."""
    fmt = mode.bitwiseAND(0o170000)
    out = F.lit(1)
    # Format bits of directories, links, pipes, character and block devices.
    for bits, kind in ((0o040000, 2), (0o120000, 3), (0o010000, 5), (0o020000, 6), (0o060000, 7)):
        out = F.when(fmt == bits, kind).otherwise(out)
    return out


def hex_lines(payload: F.Column) -> F.Column:
    """Rows of a hex dump: offset and up to 16 bytes in hex."""
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(payload) - 1, F.lit(0)), F.lit(16))
    return F.transform(starts, lambda s: F.struct(s.alias("offset"), F.lower(F.hex(F.substring(payload, s + 1, F.lit(16)))).alias("bytes")))
