"""Instants with an offset, and half-open validity intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A date and time with an offset; without one a time is no instant.
INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|z|[+-]\d{2}:?\d{2})$"


def instant(c: Column) -> Column:
    """Microseconds since 1970 of an ISO text with offset; null for anything else, times without offset included."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"^(\d{4}-\d{2}-\d{2}) ", "$1T"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    with_seconds = F.regexp_replace(F.upper(spaced), r"T(\d{2}:\d{2})(?=[Z+-])", "T$1:00")
    return F.when(c.rlike(INSTANT), F.unix_micros(F.try_to_timestamp(with_seconds)))


def holds_at(start: Column, stop: Column, at: Column) -> Column:
    """start <= at < stop, an absent bound being open."""
    return (start.isNull() | (start <= at)) & (stop.isNull() | (at < stop))


def interval_errors(start_text: Column, stop_text: Column) -> Column:
    """Array of what is wrong with an interval: unreadable bounds, an end without a start, or one not after it."""
    start, stop = instant(start_text), instant(stop_text)
    return F.array_compact(
        F.array(
            F.when(start_text.isNotNull() & start.isNull(), F.lit("valid_from is not an instant")),
            F.when(stop_text.isNotNull() & stop.isNull(), F.lit("valid_until is not an instant")),
            F.when(stop_text.isNotNull() & start_text.isNull(), F.lit("valid_until without valid_from")),
            F.when(start.isNotNull() & stop.isNotNull() & (stop <= start), F.lit("valid_until is not after valid_from")),
        )
    )
