"""Date helpers: local 'today', default ingest window, election-cycle rules."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_TZ = "America/New_York"
FIRST_CYCLE = 1980


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_date(utc_ts) -> Column:
    """Calendar date, in the source's home time zone, of a UTC wall-clock time.

    The input is read as a timestamp without time zone (the parquet columns are
    TIMESTAMP_NTZ) and converted explicitly from UTC, so the session time zone
    plays no part.
    """
    ntz = _col(utc_ts).cast("timestamp_ntz")
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_TZ), ntz))


def date_window(start, end, run_ts) -> tuple[Column, Column]:
    """Default window: missing start = local yesterday, missing end = local today.

    ``run_ts`` is the job's reference time (UTC wall clock), passed in so runs repeat.
    Given bounds are parsed as ``yyyy-MM-dd``.
    """
    today = local_date(run_ts)
    lo = F.to_date(_col(start), "yyyy-MM-dd")
    hi = F.to_date(_col(end), "yyyy-MM-dd")
    return (F.coalesce(lo, F.date_sub(today, 1)), F.coalesce(hi, today))


def cycle_of(ts) -> Column:
    """Two-year election cycle of a date: odd years round up to the next even year."""
    y = F.year(_col(ts))
    return (y + y % 2).cast("int")


def latest_even_year(today: _dt.date) -> int:
    return today.year - today.year % 2


def check_even_cycle(cycle: int, today: _dt.date | None = None) -> int:
    """Argument rule: even, and between 1980 and the latest even year to date."""
    today = today or _dt.date.today()
    top = latest_even_year(today)
    if not isinstance(cycle, int) or cycle % 2 != 0 or not (FIRST_CYCLE <= cycle <= top):
        raise ValueError(f"cycle must be an even year between {FIRST_CYCLE} and {top}")
    return cycle


def even_cycle_predicate(c, today: _dt.date) -> Column:
    """The same rule as a data predicate."""
    x = _col(c)
    return (x % 2 == 0) & x.between(FIRST_CYCLE, latest_even_year(today))
