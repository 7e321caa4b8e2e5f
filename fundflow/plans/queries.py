"""Read-side queries: filtered/sorted/paged lists, point lookups, history, headlines.

Each list query returns ``Page(rows, total)``: the page DataFrame and a one-row
count DataFrame of the *unsorted* filtered set (Catalyst drops nothing it needs;
the count never pays for the sort). A page near the start is ``orderBy().offset().limit()``, which
Spark plans as a bounded top-k (TakeOrderedAndProject), never a full sort to one task. A deep page
comes from a ``PageIndex``: the sorted rows are stored once in range slices, the slices' counts say
which of them hold the page, and only those are read.

``spending_history``, ``spending_list`` and the candidates they attach compute their page while the frame
is built (at most MAX_LIMIT rows, else an error).
"""

from __future__ import annotations

import datetime as _dt
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow.functions.dates import check_even_cycle, even_cycle_predicate
from fundflow.functions.money import response_ratio
from fundflow.operators.ordered import SLICE
from fundflow.session import new_location

MAX_LIMIT = 1000
DEFAULT_LIMIT = 100
# Sort keys and response fields.
CANDIDATE_SORT_KEYS = ("name", "state", "first_file_date", "last_file_date")
SPENDING_SORT_KEYS = ("cycle", "inside_receipts", "inside_disbursements", "outside_support",
                      "outside_oppose", "outside_total", "influence_ratio", "vulnerability_factor")
CANDIDATE_OUT = ("candidate_id", "name", "office", "state", "party", "party_full", "district",
                 "incumbent_challenge", "incumbent_challenge_full", "candidate_status",
                 "active_through", "cycles", "election_years", "federal_funds_flag",
                 "has_raised_funds", "first_file_date")
CANDIDATE_INFO = ("candidate_id", "name", "state", "office", "district", "party", "incumbent_challenge")


@dataclass
class Page:
    rows: DataFrame
    total: DataFrame
    limit: int
    offset: int


#: Rows up to the end of a page beyond which it is read from an index: a top-k holds them all in one task.
DEEP = 10_000
#: Rows of a slice of an index.
SLICE_ROWS = 1 << 18


def check_page(limit: int, offset: int) -> None:
    if not isinstance(limit, int) or not (1 <= limit <= MAX_LIMIT):
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    if not isinstance(offset, int) or offset < 0:
        raise ValueError("offset must not be negative")


def page_errors(limit: Column, offset: Column, sort_by: Column, order: Column, keys=SPENDING_SORT_KEYS) -> Column:
    """The rules of ``check_page`` and ``check_choice`` over a table of requests: names of those that are broken."""
    rules = {"limit": limit.between(1, MAX_LIMIT), "offset": offset >= 0, "sort_by": sort_by.isin(*keys), "order": order.isin("asc", "desc")}
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def check_choice(value: str, allowed, what: str) -> None:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {list(allowed)}")


def sort_key(c: Column, order: Literal["asc", "desc"]) -> Column:
    """Null placement of the source database: DESC puts nulls first, ASC last."""
    return c.desc_nulls_first() if order == "desc" else c.asc_nulls_last()


def equality_filters(df: DataFrame, **filters) -> DataFrame:
    """AND of ``col == value`` for every argument that is not None."""
    for k, v in filters.items():
        if v is not None:
            df = df.filter(F.col(k) == F.lit(v))
    return df


@dataclass
class PageIndex:
    """Sorted rows in range slices, stored once; ``ends`` are the ranks at which the slices end."""

    stored: DataFrame
    order_by: list[Column]
    ends: list[int]

    def page(self, limit: int, offset: int) -> DataFrame:
        """Reads the slices that the page overlaps; of the first, the rows before it are skipped."""
        first, last = bisect_right(self.ends, offset), bisect_left(self.ends, offset + limit)
        before = self.ends[first - 1] if first else 0
        held = self.stored.where(F.col(SLICE).between(first, last)).drop(SLICE)
        return held.orderBy(*self.order_by).offset(offset - before).limit(limit)


def page_index(base: DataFrame, order_by: list[Column], slice_rows: int = SLICE_ROWS) -> PageIndex:
    """Cut ``base`` into slices by ``order_by`` (which must not tie) and store them, a folder each.

    The counts, one number a slice, come to the driver. Range bounds are sampled, so slices
    differ in size; what a page reads is a slice or two whatever its offset.
    """
    slices = max(1, -(-base.count() // slice_rows))
    sliced = base.repartitionByRange(slices, *order_by).withColumn(SLICE, F.spark_partition_id())
    path = new_location(base.sparkSession, "staging/page_index")
    sliced.write.partitionBy(SLICE).parquet(path)
    stored = base.sparkSession.read.schema(sliced.schema).parquet(path)
    rows = {r[SLICE]: r["n"] for r in stored.groupBy(SLICE).agg(F.count(F.lit(1)).alias("n")).collect()}
    return PageIndex(stored, order_by, list(accumulate(rows.get(i, 0) for i in range(slices))))


def paginate(base: DataFrame, order_by: list[Column], limit: int, offset: int, index: PageIndex | None = None) -> Page:
    """One page of ``base``; a deep one from ``index`` (made here if none is given)."""
    check_page(limit, offset)
    total = base.agg(F.count(F.lit(1)).cast("bigint").alias("total_count"))
    if index is not None or offset + limit > DEEP:
        return Page((index or page_index(base, order_by)).page(limit, offset), total, limit, offset)
    rows = base.orderBy(*order_by)
    if offset:
        rows = rows.offset(offset)
    return Page(rows.limit(limit), total, limit, offset)


# ---------------------------------------------------------------- candidates
def candidate_filter(candidates: DataFrame, state: str | None = None, office: str | None = None,
                     cycle: int | None = None) -> DataFrame:
    """Falsy arguments add no predicate; state is compared upper-cased (2 letters)."""
    df = candidates
    if state:
        if len(state) != 2:
            raise ValueError("state must be a 2-letter code")
        df = df.filter(F.col("state") == F.lit(state.upper()))
    if office:
        check_choice(office, ("P", "S", "H"), "office")
        df = df.filter(F.col("office") == F.lit(office))
    if cycle:
        # null arrays give null -> row dropped
        df = df.filter(F.array_contains("cycles", F.lit(cycle)))
    return df


def candidate_list(candidates: DataFrame, state: str | None = None, office: str | None = None,
                   cycle: int | None = None, sort_by: str = "name", order: str = "asc",
                   limit: int = DEFAULT_LIMIT, offset: int = 0) -> Page:
    check_choice(sort_by, CANDIDATE_SORT_KEYS, "sort_by")
    check_choice(order, ("asc", "desc"), "order")
    base = candidate_filter(candidates, state, office, cycle)
    page = paginate(base, [sort_key(F.col(sort_by), order), F.col("candidate_id").asc()], limit, offset)
    page.rows = page.rows.select(*CANDIDATE_OUT)  # all of them: a table that lacks one is an error
    return page


def candidate_by_id(candidates: DataFrame, candidate_id: str) -> DataFrame:
    """Point lookup of the full response; zero rows means not found."""
    return candidates.filter(F.col("candidate_id") == F.lit(candidate_id)).select(*CANDIDATE_OUT).limit(1)


# ---------------------------------------------------------------- spending
def _info(candidates: DataFrame) -> list[Column]:
    """The embedded candidate fields; a table that lacks one is an error."""
    missing = [x for x in CANDIDATE_INFO if x not in candidates.columns]
    if missing:
        raise ValueError(f"the candidates table has no column {missing}")
    return [F.col(x) for x in CANDIDATE_INFO]


def held(page: DataFrame, most: int = MAX_LIMIT) -> DataFrame:
    """A page computed once: its rows, at most ``most``, as a local table in their order."""
    rows = page.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a page has at most {most} rows")
    return page.sparkSession.createDataFrame(rows, page.schema)


def attach_candidates(page: DataFrame, candidates: DataFrame, known_only: bool = False) -> DataFrame:
    """Nest candidate details into each row of a page; missing candidate -> null struct, or
    no row with ``known_only`` (for consumers that skip such rows anyway).

    The page (at most MAX_LIMIT rows, checked) is computed once; its ids are an ``IN``
    filter of the candidates scan, and what that finds, one row per id, is joined back.
    """
    local = held(page)
    ids = sorted({r.candidate_id for r in local.select("candidate_id").collect() if r.candidate_id is not None})
    c = (candidates.select(*_info(candidates)).filter(F.col("candidate_id").isin(ids))
         .select(F.col("candidate_id").alias("__cid"), F.struct(*[F.col(x) for x in CANDIDATE_INFO]).alias("candidate")))
    # at most one row per page row, so it may be broadcast
    return local.join(F.broadcast(c), F.col("candidate_id") == F.col("__cid"), "inner" if known_only else "left").drop("__cid")


def with_candidates(rows: DataFrame, candidates: DataFrame, keep_unmatched: bool = True) -> DataFrame:
    """Unbounded form of ``attach_candidates``: a plain left join on the key.

    No broadcast hint: for a whole table the planner (AQE) picks the strategy from
    measured sizes, shuffling both sides on ``candidate_id`` when they are large.
    """
    c = candidates.select(F.col("candidate_id").alias("__cid"), F.struct(*_info(candidates)).alias("candidate"))
    how = "left" if keep_unmatched else "inner"
    return rows.join(c, F.col("candidate_id") == F.col("__cid"), how).drop("__cid")


def spending_order(sort_by: str, order: str) -> list[Column]:
    check_choice(sort_by, SPENDING_SORT_KEYS, "sort_by")
    check_choice(order, ("asc", "desc"), "order")
    key = (F.col("outside_support") + F.col("outside_oppose")) if sort_by == "outside_total" \
        else F.col(sort_by)
    return [sort_key(key, order), F.col("candidate_id").asc(), F.col("cycle").asc()]


def spending_list(summary: DataFrame, candidates: DataFrame, cycle: int | None = None,
                  sort_by: str = "outside_total", order: str = "desc",
                  limit: int = DEFAULT_LIMIT, offset: int = 0) -> Page:
    """Sorted, paged spending rows; candidate details attached to the page only."""
    base = equality_filters(summary, cycle=cycle)
    page = paginate(base, spending_order(sort_by, order), limit, offset)
    page.rows = attach_candidates(page.rows, candidates)
    return page


def spending_count(summary: DataFrame, cycle: int | None = None) -> DataFrame:
    """The number of rows that ``spending_list`` pages through."""
    return equality_filters(summary, cycle=cycle).agg(F.count(F.lit(1)).cast("bigint").alias("total_count"))


def response_ratios(rows: DataFrame) -> DataFrame:
    """Spending rows with the ratios of the response instead of the stored ones: from doubles, missing
    amounts as 0, both null when nothing was disbursed."""
    support, oppose = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("outside_support", "outside_oppose"))
    return rows.withColumns({"influence_ratio": response_ratio(support + oppose, "inside_disbursements"),
                             "vulnerability_factor": response_ratio(oppose, "inside_disbursements")})


def spending_history(summary: DataFrame, candidates: DataFrame, candidate_id: str) -> DataFrame:
    """All cycles of one candidate, newest first, with candidate details.

    Use ``history_gate`` first to tell "unknown candidate" from "no rows".
    """
    rows = summary.filter(F.col("candidate_id") == F.lit(candidate_id))
    return attach_candidates(rows, candidates).orderBy(F.col("cycle").desc())


def history_gate(candidates: DataFrame, summary: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probed id: not_found / found_empty / found, and its number of history rows.

    Equivalent to checking existence before listing history. Both tables are first
    reduced to the probed ids (semi joins, which AQE turns into broadcasts of the probe
    list when it measures it small), so only the probed candidates are aggregated.
    """
    ids = probes.select("candidate_id").distinct()
    known = (candidates.select("candidate_id").join(ids, "candidate_id", "left_semi")
             .select(F.col("candidate_id").alias("k_id")).distinct())
    counts = (summary.select("candidate_id").join(ids, "candidate_id", "left_semi")
              .groupBy(F.col("candidate_id").alias("h_id"))
              .agg(F.count(F.lit(1)).cast("bigint").alias("history_rows")))
    j = (probes.join(known, probes.candidate_id == known.k_id, "left")
         .join(counts, probes.candidate_id == counts.h_id, "left"))
    n = F.coalesce(F.col("history_rows"), F.lit(0).cast("bigint"))
    status = (F.when(F.col("k_id").isNull(), "not_found")
              .when(n == 0, "found_empty").otherwise("found"))
    return j.select("candidate_id", status.alias("status"), n.alias("history_rows"))


def top_outside_spenders(summary: DataFrame, cycle: int | None, n: int = 500) -> DataFrame:
    """The chart feed: top ``n`` rows (at most MAX_LIMIT) of a cycle by outside total."""
    check_page(n, 0)
    base = equality_filters(summary, cycle=cycle)
    return base.orderBy(*spending_order("outside_total", "desc")).limit(n)


# ---------------------------------------------------------------- elections
def election_list(election: DataFrame) -> DataFrame:
    return election.orderBy(F.col("cycle").desc())


def election_by_cycle(election: DataFrame, cycle: int, today: _dt.date | None = None) -> DataFrame:
    """Validated cycle argument, then a key lookup (zero rows = not found)."""
    check_even_cycle(cycle, today)
    return election.filter(F.col("cycle") == F.lit(cycle))


def even_cycles(election: DataFrame, today: _dt.date) -> DataFrame:
    """The cycle rule as a data predicate: even and within [1980, latest even year]."""
    return election.filter(even_cycle_predicate("cycle", today))
