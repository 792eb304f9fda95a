"""Instants and ISO 8601 periods."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

_PERIOD = (
    r"^P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:[.](\d{1,3})\d*)?S)?)?$"
)
_UNITS = (604_800_000, 86_400_000, 3_600_000, 60_000, 1000)


def period_millis(text: str) -> int:
    """ISO 8601 period of weeks to seconds as milliseconds. Months and years have no fixed
    length and are rejected."""
    match = re.match(_PERIOD, text)
    if not match or not any(match.groups()):
        raise ValueError(f"not a period of fixed length: {text!r}")
    total = sum(int(g) * u for g, u in zip(match.groups(), _UNITS) if g)
    return total + int((match.group(6) or "0").ljust(3, "0"))


def period_millis_column(text: Column | str) -> Column:
    """The same for a column; null where the text is not such a period."""
    text = F.col(text) if isinstance(text, str) else text

    def total(parts: Column) -> Column:
        millis = F.lit(0).cast("long")
        for i, unit in enumerate(_UNITS):
            # an empty part is no number: a failed cast costs an exception
            number = F.when(parts[i] != "", parts[i].try_cast("long"))
            millis = millis + F.coalesce(number, F.lit(0)) * F.lit(unit)
        fraction = F.rpad(parts[5], 3, "0").try_cast("long")
        given = F.exists(parts, lambda p: p != "")
        return F.when((F.size(parts) == 7) & given, millis + F.coalesce(fraction, F.lit(0)))

    # one pass of the pattern lays the units out as w|d|h|m|s|fraction|
    laid_out = F.regexp_replace(text, _PERIOD, "$1|$2|$3|$4|$5|$6|")
    return F.when(~F.contains(text, F.lit("|")), bind(F.split(laid_out, "[|]"), total))


def instant(text: Column | str) -> Column:
    """ISO text to a timestamp, null if it is none. A bare year or month is legal."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text)


def utc(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


def at(now: dt.datetime | str) -> Column:
    """An explicit clock as a literal."""
    return F.lit(utc(now) if isinstance(now, str) else now).cast("timestamp")


def millis(ts: Column | str) -> Column:
    return F.unix_millis(F.col(ts) if isinstance(ts, str) else ts)


def lag_seconds(earlier: Column, later: Column) -> Column:
    """Whole seconds between two instants, truncated towards zero."""
    return ((millis(later) - millis(earlier)) / F.lit(1000)).cast("long")


def shift(ts: Column | str, millis_: Column | int) -> Column:
    """An instant moved by milliseconds."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    step = millis_ if isinstance(millis_, Column) else F.lit(millis_)
    return F.timestamp_micros(F.unix_micros(ts) + step.cast("long") * F.lit(1000))
