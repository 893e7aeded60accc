"""Structured filters of entries as column predicates; all are ANDed. Columns that are null never match a value."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultspark.functions import text as T
from vaultspark.functions.instants import holds_at, instant

#: Filters that are plain equality on a column of the same name.
EXACT = ("type", "reading_status", "bookmark_kind", "place_kind", "product_kind", "experience_kind", "interest_status")
READABLE_SCHEMAS = range(8, 13)


def exact(name: str, value) -> Column:
    return F.coalesce(F.col(name) == value, F.lit(False))


def has_attachment(wanted: bool, column: str = "attachments") -> Column:
    return F.coalesce(F.size(column) > 0, F.lit(False)) == wanted


def attribute(name: str, value) -> Column:
    """Equality on an attribute; a list matches an equal list in the same order."""
    c = F.col(f"attributes.{name}")
    if isinstance(value, list):
        return F.coalesce(c == F.array(*map(F.lit, value)), F.lit(False))
    return F.coalesce(c == F.lit(value), F.lit(False))


def domain(value: str) -> Column:
    own = F.coalesce(F.when(F.col("domain") != "", F.col("domain")), F.col("source_domain"))
    return F.coalesce(T.fold(own) == T.fold(F.lit(value)), F.lit(False))


def experienced(wanted: bool) -> Column:
    return F.col("last_experienced_at").isNotNull() == wanted


def min_rating(least: int) -> Column:
    return F.coalesce(F.col("rating") >= least, F.lit(False))


def window(column: str, after: str | None = None, before: str | None = None) -> Column:
    """after <= instant < before on a text column; texts that are no instant never match."""
    at = instant(F.col(column))
    out = at.isNotNull()
    if after is not None:
        out &= at >= instant(F.lit(after))
    if before is not None:
        out &= at < instant(F.lit(before))
    return out


def related(target: str | None = None, predicate: str | None = None, as_of: str | None = None, column: str = "relations") -> Column:
    """One relation that satisfies all of it at once, in force at `as_of` if that is given."""

    def test(r: Column) -> Column:
        out = F.lit(True)
        if target is not None:
            out &= r["target"] == target
        if predicate is not None:
            out &= r["predicate"] == predicate
        if as_of is not None:
            out &= holds_at(instant(r["valid_from"]), instant(r["valid_until"]), instant(F.lit(as_of)))
        return out

    return F.coalesce(F.exists(column, test), F.lit(False))


def moment(text: str) -> datetime:
    """The instant of an ISO text with offset; an error for anything else."""
    try:
        found = datetime.fromisoformat(text)
    except ValueError as e:
        raise ValueError(f"{text!r} is not an instant") from e
    if found.tzinfo is None:
        raise ValueError(f"{text!r} has no offset")
    return found.astimezone(UTC)


def as_of(text: str | None = None) -> tuple[str, bool]:
    """(the instant asked for in UTC, whether it was asked for): now, where none is."""
    return (moment(text) if text is not None else datetime.now(UTC)).isoformat(), text is not None


def readable() -> Column:
    return F.col("schema_version").isin(*READABLE_SCHEMAS)


def review_reasons() -> Column:
    """Array of reasons for review, in their fixed order."""
    note_missing = (F.col("type") == "bookmark") & (F.trim(F.coalesce(F.col("personal_note"), F.lit(""))) == "") & F.col("reviewed_at").isNull()
    return F.array_compact(F.array(F.when(F.col("status") == "unreviewed", F.lit("unreviewed")), F.when(F.size("unresolved_relations") > 0, F.lit("unresolved_relations")), F.when(note_missing, F.lit("bookmark_missing_personal_note"))))


def purgeable(now: str, older_than_days: int | None = None) -> Column:
    """Deleted long enough ago, or past the row's own date."""
    at = instant(F.lit(now))
    if older_than_days is not None:
        return F.coalesce(instant(F.col("deleted_at")) <= at - older_than_days * 86_400_000_000, F.lit(False))
    return F.coalesce(instant(F.col("purge_after")) <= at, F.lit(False))


def all_of(*tests: Column) -> Column:
    out = F.lit(True)
    for t in tests:
        out &= t
    return out


def check_bounds(limit: int = 20, offset: int = 0, k1: float = 1.2, b: float = 0.75, after: str | None = None, before: str | None = None) -> None:
    """Refuses arguments out of range. Bounds of time are compared as instants, whatever their offsets."""
    if not 1 <= limit <= 50 or offset < 0 or k1 < 0 or not 0 <= b <= 1:
        raise ValueError("an argument is out of range")
    first, last = (None if t is None else moment(t) for t in (after, before))
    if first is not None and last is not None and not first < last:
        raise ValueError("the window ends before it begins")
