"""Date texts to timestamps, at millisecond precision and in UTC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoorlog.functions import patterns as P
from spoorlog.functions.text import trim

_ISO = (
    r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?( ?(Z|[+-]\d{2}:?\d{2}))?)?)?)?$"
)
_RFC1123 = r"^(?:[A-Za-z]{3}, )?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) (?:GMT|UTC|Z)$"


def to_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def _whole_millis(ts: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(ts))


def parse_iso(col: Column) -> Column:
    """ISO-8601 dates and date-times; no zone means UTC, anything else NULL."""
    return F.when(col.rlike(P.java(_ISO)), _whole_millis(col.try_cast("timestamp")))


_CLOCK = r"(?:(?:T|,? +)(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,3})\d*)?)?(?: ?([AaPp])[Mm])?)?"
_ZONE = r"(?: ?(?:Z|UTC|GMT)?(?: ?([+-]\d{2}:?\d{2}))?)?(?: ?\([^)]*\))?$"
_WEEKDAY = r"^(?:[A-Za-z]{3,9},? +)?"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: Spellings of a day, and which of their groups are year, month and day.
_SPELLINGS = (
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})", "$1|$2|$3"),
    (r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})", "$3|$1|$2"),
    (_WEEKDAY + r"([A-Za-z]{3,9})\.? +(\d{1,2}),? +(\d{4})", "$3|$1|$2"),
    (_WEEKDAY + r"(\d{1,2})[ -]([A-Za-z]{3,9})\.?,?[ -](\d{4})", "$3|$2|$1"),
)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _from_parts(parts: Column) -> Column:
    """A timestamp of year, month, day, hour, minute, second, fraction, a or p, zone; impossible ones NULL."""
    number = lambda k: F.coalesce(F.get(parts, k).try_cast("int"), F.lit(0))
    name = F.instr(F.lit(_MONTHS), F.lower(F.substring(F.get(parts, 1), 1, 3)))
    month = F.coalesce(F.get(parts, 1).try_cast("int"), F.when(name % 3 == 1, F.floor(name / 3).cast("int") + 1))
    half = F.lower(F.get(parts, 7))
    hour = F.when(half == "p", number(3) % 12 + 12).when(half == "a", number(3) % 12).otherwise(number(3))
    whole = F.try_make_timestamp(number(0), month, number(2), hour, number(4), number(5).cast("decimal(8,6)"))
    fraction = F.rpad(F.get(parts, 6), 3, "0").try_cast("int")
    zone = F.replace(F.get(parts, 8), F.lit(":"), F.lit(""))
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    shift = F.coalesce(F.when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes), F.lit(0))
    return F.timestamp_millis(F.unix_millis(whole) + F.coalesce(fraction, F.lit(0)) - shift * 60_000)


def parse_general(col: Column) -> Column:
    """Dates as people and programs spell them: year first, month first, day first, with month names.

    A clock time, AM or PM, a zone and a comment in brackets may follow. No zone
    means UTC; a month's name counts by its first three letters.
    """
    rest = r"|$4|$5|$6|$7|$8|$9"
    spelled = F.coalesce(*[
        F.when(col.rlike(P.java(day + _CLOCK + _ZONE)), F.regexp_replace(col, P.java(day + _CLOCK + _ZONE), order + rest))
        for day, order in _SPELLINGS])
    return _bound(F.split(spelled, r"\|"), _from_parts)


def parse_date(col: Column) -> Column:
    """ISO-8601, RFC-1123 or a general spelling."""
    rfc = F.regexp_extract(col, P.java(_RFC1123), 1)
    spoken = F.try_to_timestamp(F.concat(rfc, F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(parse_iso(col), F.when(rfc != "", spoken), F.when(~col.rlike(P.java(_ISO)), parse_general(col)))


def parse_epoch_or_date(col: Column) -> Column:
    """10 digits are seconds, 13 are milliseconds, the rest is a date text."""
    return (
        F.when(col.rlike(r"^\d{10}\z"), F.timestamp_seconds(col.try_cast("bigint")))
        .when(col.rlike(r"^\d{13}\z"), F.timestamp_millis(col.try_cast("bigint")))
        .otherwise(parse_date(trim(col)))
    )


def parse_bsd(stamp: Column, year: int | Column) -> Column:
    """``May 26 12:00:01``: the stamp has no year, so the caller gives one."""
    one_space = F.regexp_replace(F.initcap(stamp), P.java(r"\s+"), " ")
    text = F.concat_ws(" ", F.lit(year).cast("string"), one_space)
    return F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss"))


def parse_access_date(col: Column) -> Column:
    """``10/Oct/2000:13:55:36 -0700``."""
    one_space = F.regexp_replace(col, P.java(r"\s+"), " ")
    stamp = F.try_to_timestamp(one_space, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return F.when(col.rlike(P.java(P.ACCESS_DATE)), stamp)


def rfc1123(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
