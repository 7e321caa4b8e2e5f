"""Derived tables: per-candidate-and-cycle spending summary, and per-cycle rollup.

Plan shape of the candidate summary (``full_outer`` form): each side is aggregated
on (candidate_id, cycle) with a partial (map-side) and a final aggregate, which
leaves both hash-partitioned on that key; the full outer join then needs no further
exchange. Two shuffles in total, and no key can be hot after its aggregate because
each side holds one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.functions.money import WIDE_MONEY, ratio, zero_if_null

KEY = ["candidate_id", "cycle"]
SUMMARY_MONEY = ["inside_receipts", "inside_disbursements", "outside_support", "outside_oppose"]
SUMMARY_COLUMNS = KEY + SUMMARY_MONEY + ["influence_ratio", "vulnerability_factor"]
ELECTION_COLUMNS = ["cycle", "candidate_count", "total_inside_receipts", "total_inside_disbursements",
                    "total_outside_support", "total_outside_oppose", "global_influence_ratio"]


def inside_subtotals(inside: DataFrame) -> DataFrame:
    """SUM(receipts), SUM(disbursements) per key (null-skipping, like SQL SUM)."""
    return inside.groupBy(*KEY).agg(F.sum("receipts").alias("inside_receipts"),
                                    F.sum("disbursements").alias("inside_disbursements"))


def outside_subtotals(outside: DataFrame) -> DataFrame:
    """Conditional sums: support ('S') and oppose ('O') totals per key."""
    ind, total = F.col("support_oppose_indicator"), F.col("total")
    return outside.groupBy(*KEY).agg(
        F.sum(F.when(ind == "S", total).otherwise(F.lit(0))).alias("outside_support"),
        F.sum(F.when(ind == "O", total).otherwise(F.lit(0))).alias("outside_oppose"))


def only(totals: DataFrame, cycle: int | None = None, candidate_ids: list[str] | DataFrame | None = None) -> DataFrame:
    """Rows of a totals table of one cycle and of the given candidates (a list, or a table with ``candidate_id``)."""
    if cycle is not None:
        totals = totals.filter(F.col("cycle") == cycle)
    if isinstance(candidate_ids, DataFrame):
        totals = totals.join(candidate_ids.select("candidate_id").distinct(), "candidate_id", "left_semi")
    elif candidate_ids is not None:
        totals = totals.filter(F.col("candidate_id").isin(candidate_ids))
    return totals


def all_pairs(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """Distinct (candidate_id, cycle) of either side (UNION, not UNION ALL)."""
    return inside.select(*KEY).union(outside.select(*KEY)).distinct()


def _finish(df: DataFrame) -> DataFrame:
    money = {c: zero_if_null(c).cast(WIDE_MONEY) for c in SUMMARY_MONEY}
    support, oppose, disb = money["outside_support"], money["outside_oppose"], money["inside_disbursements"]
    return df.select(*KEY, *[money[c].alias(c) for c in SUMMARY_MONEY],
                     ratio(support + oppose, disb).alias("influence_ratio"),
                     ratio(oppose, disb).alias("vulnerability_factor"))


def candidate_spending_summary(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """Flagship: aggregate each side, then one full outer join on the key."""
    return _finish(inside_subtotals(inside).join(outside_subtotals(outside), KEY, "full_outer"))


def candidate_spending_summary_spine(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """The literal form: key spine (UNION) LEFT JOIN inside LEFT JOIN outside.

    Same rows as ``candidate_spending_summary``; kept as an equivalence check.
    """
    i, o = inside_subtotals(inside), outside_subtotals(outside)
    spine = i.select(*KEY).union(o.select(*KEY)).distinct()
    return _finish(spine.join(i, KEY, "left").join(o, KEY, "left"))


def election_spending_summary(summary: DataFrame) -> DataFrame:
    """Per-cycle totals over the candidate summary.

    ``candidate_count`` is COUNT(DISTINCT candidate_id); the summary is unique on
    (candidate_id, cycle) (checked when ``plans.refresh`` writes it), so a plain
    count per cycle is the same number without the distinct-aggregate expansion.
    The ratio is a ratio of sums, never an average of ratios.
    """
    s = summary
    sums = {c: F.sum(c) for c in SUMMARY_MONEY}
    return (s.groupBy("cycle").agg(
        F.count("candidate_id").cast("int").alias("candidate_count"),
        sums["inside_receipts"].cast(WIDE_MONEY).alias("total_inside_receipts"),
        sums["inside_disbursements"].cast(WIDE_MONEY).alias("total_inside_disbursements"),
        sums["outside_support"].cast(WIDE_MONEY).alias("total_outside_support"),
        sums["outside_oppose"].cast(WIDE_MONEY).alias("total_outside_oppose"),
        ratio(F.sum(F.col("outside_support") + F.col("outside_oppose")),
              F.sum("inside_disbursements")).alias("global_influence_ratio")))


def cycle_headline(election: DataFrame) -> DataFrame:
    """Dashboard headline per cycle: direct spending and independent total, formatted."""
    from fundflow.functions.money import full_dollars
    outside_total = zero_if_null("total_outside_support") + zero_if_null("total_outside_oppose")
    return election.select(
        "cycle",
        full_dollars("total_inside_disbursements").alias("inside_disbursements_text"),
        full_dollars(outside_total).alias("outside_total_text"))
