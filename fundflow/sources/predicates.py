"""Source-side predicates: what a fetch asks the source for.

Expressed as plain ``filter`` calls so Catalyst pushes them into the parquet / JSON
scan (``PushedFilters``) and prunes partitions when the table is partitioned by cycle.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_OFFICES = ("P", "S", "H")


def source_filter(df: DataFrame, offices=DEFAULT_OFFICES, cycle: int | None = None,
                  cycle_column: str = "cycles", **equals) -> DataFrame:
    """``office IN offices``, cycle membership/equality, and any other named equalities.

    ``cycle`` tests an array column by containment and a scalar column by equality.
    Arguments that are None add no predicate; one that names a column the feed lacks
    is an error, never an unfiltered result.
    """
    wanted = {"office": offices, cycle_column: cycle, **equals}
    missing = [c for c, v in wanted.items() if v is not None and c not in df.columns]
    if missing:
        raise ValueError(f"the feed has no column {missing} to filter by; it has {df.columns}")
    if offices is not None:
        df = df.filter(F.col("office").isin(list(offices)))
    if cycle is not None:
        dtype = df.schema[cycle_column].dataType.typeName()
        df = df.filter(F.array_contains(cycle_column, cycle) if dtype == "array"
                       else F.col(cycle_column) == cycle)
    for k, v in equals.items():
        if v is not None:
            df = df.filter(F.col(k) == F.lit(v))
    return df


#: What the totals endpoints ask for unless told otherwise.
DEFAULT_CYCLE = 2024


def totals_filter(df: DataFrame, cycle: int | None = DEFAULT_CYCLE, offices=DEFAULT_OFFICES, **equals) -> DataFrame:
    """What a fetch of candidate totals asks for: one cycle, the federal offices, and of a feed that
    tells full elections from two-year periods (``election_full``) the periods."""
    if "election_full" in df.columns:
        equals = {"election_full": False} | equals
    return source_filter(df, offices, cycle, "cycle", **equals)


def first_file_range(df: DataFrame, min_date: str | _dt.date | None = None,
                     max_date: str | _dt.date | None = None,
                     column: str = "first_file_date") -> DataFrame:
    """Inclusive ``min <= first_file_date <= max`` when either bound is given."""
    if min_date is not None:
        df = df.filter(F.col(column) >= F.lit(str(min_date)).cast("date"))
    if max_date is not None:
        df = df.filter(F.col(column) <= F.lit(str(max_date)).cast("date"))
    return df
