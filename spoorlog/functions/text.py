"""Text expressions over one log line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoorlog.functions import patterns as P


def trim(col: Column) -> Column:
    """Strip Unicode blanks and byte-order marks at both ends."""
    return F.btrim(col, F.lit(P.BLANKS))


def is_blank(col: Column) -> Column:
    return trim(col) == ""


def non_empty(col: Column) -> Column:
    """NULL for the empty string, which the readers treat as missing."""
    return F.nullif(col, F.lit(""))


def first_match(col: Column, pattern: str, group: int = 0, needs: str = "") -> Column:
    """Capture of the first hit, NULL without one (captures are never empty).

    ``needs`` is a text every hit contains; lines without it skip the regex.
    """
    found = F.regexp_extract(col, P.java(pattern), group)
    return non_empty(F.when(F.contains(col, F.lit(needs)), found) if needs else found)


def captures(col: Column, pattern: str, groups: list[int]) -> Column:
    """All wanted groups of an anchored pattern from one run of the regex.

    A line holds no line feed, so the rewritten text splits on it without
    ambiguity; a line that does not match stays in one piece.
    """
    rewritten = F.regexp_replace(col, P.java(pattern), "\n".join(f"${g}" for g in groups))
    return F.split(rewritten, "\n", len(groups))


def has_any(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def first_word(col: Column, words: list[str]) -> Column:
    """The first of ``words``, in their order, that ``col`` contains."""
    return F.coalesce(*[F.when(F.contains(col, F.lit(w)), F.lit(w)) for w in words])


def leading_int(col: Column) -> Column:
    return F.regexp_extract(col, P.java(r"^\s*([+-]?\d+)"), 1).try_cast("int")


def extract_ipv4(col: Column) -> Column:
    """First IPv4-shaped token; octet ranges are not checked."""
    return first_match(col, P.IPV4, needs=".")


def extract_destination_port(raw: Column, strict: bool = False) -> Column:
    """Destination port of a firewall, key=value or socket line.

    By default ``DST=203.0.113.5`` yields 203 and ``12:00:01`` yields 0, as the
    rule is defined. ``strict`` skips addresses after ``DST=``, reads ``DPT=``
    and takes ``:n`` only behind a host and not inside a clock time. Any number
    of digits is a number, in double precision, as the rule's own numbers are.
    """
    if strict:
        digits = F.coalesce(
            first_match(raw, r"(?:DPT|dpt)=(\d+)", 1),
            first_match(raw, r"(?:DST|dst)=(\d+)(?![\d.])", 1),
            first_match(raw, r"(?<![A-Za-z])(?:port|Port|PORT|dport|dest_port)[=:\s]+(\d+)", 1),
            first_match(raw, r"(?<=[A-Za-z0-9\]])(?<!\d\d:\d\d)(?<![ T]\d\d):(\d{1,5})(?![\d:])\b", 1),
        )
    else:
        digits = F.coalesce(
            first_match(raw, P.PORT_DST, 1),
            first_match(raw, P.PORT_NAMED, 1),
            first_match(raw, P.PORT_SOCKET, 1, needs=":"),
        )
    return digits.cast("double")


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 units, so characters beyond the BMP count twice."""
    return (F.length(F.encode(col, "UTF-16BE")) / 2).cast("bigint")


def stable_uuid(*parts: Column) -> Column:
    """UUID-shaped id derived from the values, the same on every rerun."""
    digest = F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts]))
    pieces = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *pieces)
