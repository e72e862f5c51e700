"""Functions of binary columns: integers, content types, prefixes; no user functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def little_endian(data: Column, at: int | Column, width: int) -> Column:
    """The unsigned integer in ``width`` bytes from a 1-based position on."""
    at = at if isinstance(at, Column) else F.lit(at)
    digits = [F.lpad(F.hex(F.substring(data, at + i, F.lit(1))), 2, "0") for i in reversed(range(width))]
    return F.conv(F.concat(*digits), 16, 10).cast("long")


def signed16(value: Column) -> Column:
    """A 16-bit number read as two's complement."""
    return F.when(value >= 32768, value - 65536).otherwise(value)


def magic(data: Column, length: int = 8) -> Column:
    return F.substring(data, F.lit(1), F.lit(length))


def starts(data: Column, *prefixes: bytes, fold: bool = False) -> Column:
    """Whether the bytes begin with one of the prefixes; with ``fold`` ASCII case doesn't matter."""

    def one(prefix: bytes) -> Column:
        head = F.substring(data, F.lit(1), F.lit(len(prefix)))
        if fold:
            return F.lower(F.decode(head, "ISO-8859-1")) == prefix.decode("latin-1").lower()
        return F.hex(head) == prefix.hex().upper()

    return reduce(lambda a, b: a | b, map(one, prefixes))


# Signatures of content types in their order: prefixes, whether ASCII case matters not,
# whether a brace must follow among the first 50 bytes, extension.
SIGNATURES = [
    ((b"GIF89a", b"GIF87a"), False, False, ".gif"),
    ((b"\x89PNG\r\n\x1a\n",), False, False, ".png"),
    ((b"\xff\xd8",), False, False, ".jpg"),
    ((b"%PDF",), False, False, ".pdf"),
    ((b"<html",), True, False, ".htm"),
    ((b"<svg",), True, False, ".svg"),
    ((b"<workunit>",), True, False, ".xml"),
    ((b"; ",), False, False, ".wcf"),
    ((b"A ", b"A{", b"BO", b"/*", b".p", b".P"), False, True, ".css"),
    ((b"body ", b"body{", b"a {co", b"a{col"), True, False, ".css"),
]


def sniff_extension(data: Column) -> Column:
    """A file extension from the first bytes; the first signature that fits decides."""
    brace = F.instr(F.decode(F.substring(data, F.lit(1), F.lit(50)), "ISO-8859-1"), "{") > 0
    rules = [(starts(data, *prefixes, fold=fold) & (brace if braced else F.lit(True)), ext) for prefixes, fold, braced, ext in SIGNATURES]
    first = reduce(lambda chain, rule: chain.when(*rule), rules[1:], F.when(*rules[0]))
    return first.otherwise(".bin")


def sniffed(data: bytes) -> str:
    """The same for one value, from the same signatures."""
    low = data[:16].lower()
    fits = (ext for prefixes, fold, braced, ext in SIGNATURES if (low if fold else data).startswith(prefixes) and (not braced or b"{" in data[:50]))
    return next(fits, ".bin")


def common_prefix(a: Column, b: Column, bits: int = 31) -> Column:
    """Length of the longest common prefix, by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bits))])
    most = F.least(F.octet_length(a), F.octet_length(b))

    def longer(known: Column, step: Column) -> Column:
        # Only the part after what is known to agree is compared.
        fits = step <= most - known
        same = F.substring(a, known + 1, step) == F.substring(b, known + 1, step)
        return F.when(fits, F.when(same, known + step).otherwise(known)).otherwise(known)

    return F.aggregate(steps, F.lit(0), longer)


def first_difference(a: Column, b: Column) -> Column:
    """Where two binaries differ first, null if one begins with the other."""
    prefix = common_prefix(a, b)
    return F.when(prefix < F.least(F.octet_length(a), F.octet_length(b)), prefix)


def tag_text(xml: Column, tag: str) -> Column:
    """The text of a tag in any case, null if there is none."""
    found = F.regexp_extract(xml, f"(?i)<{tag}>([^<]+)</{tag}>", 1)
    return F.when(found != "", found)
