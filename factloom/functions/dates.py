"""Dates, partial dates and elapsed time as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECENT_DAYS = 60
LATE_DAYS = 60


def partial_sort_key(c: Column) -> Column:
    """'YYYY', 'YYYY-M' or 'YYYY-M-D' as a sortable string; missing parts are 00, never an invented day."""
    part = lambda i: F.lpad(F.coalesce(F.regexp_extract(c, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?$", i), F.lit("")), 2, "0")
    return F.concat_ws("-", F.substring(c, 1, 4), part(2), part(3))


def pad_partial(c: Column) -> Column:
    """Month and day of a partial date with two digits; what is missing stays missing."""
    return F.regexp_replace(F.regexp_replace(c, r"-(\d)(?=-|$)", "-0$1"), r"-(\d)$", "-0$1")


def compact_date(c: Column) -> Column:
    """20240131 as 2024-01-31; null for other numbers."""
    s = c.cast("string")
    return F.when(s.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Days between timestamps as a fraction."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000)


def whole_days(later: Column, earlier: Column) -> Column:
    """Completed days: the floor of what elapsed, which differs from calendar days."""
    return F.floor(elapsed_days(later, earlier)).cast("bigint")


def is_late(confidence: Column, created: Column, published: Column) -> Column:
    """Whether a fact was found long after its published date; null unless that date is known."""
    return F.when(confidence == "published", whole_days(created, published) > LATE_DAYS)


def plausible(c: Column, last_year: int) -> Column:
    """The ISO date at the front of a string, if its year lies between 1995 and the last one."""
    d = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(F.substring(d, 1, 4).try_cast("int").between(1995, last_year) & d.try_cast("date").isNotNull(), d)
