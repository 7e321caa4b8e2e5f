"""Every named query with its oracle SQL. Importing this module fills the catalog."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fundflow.catalog import register
from fundflow.oracle.bindings import with_views
from fundflow.plans import marts, tables

# ---------------------------------------------------------------- derived tables


SUMMARY_SQL = with_views("SELECT candidate_id, cycle, CAST(inside_receipts AS DOUBLE) AS inside_receipts, "
                     "CAST(inside_disbursements AS DOUBLE) AS inside_disbursements, "
                     "CAST(outside_support AS DOUBLE) AS outside_support, "
                     "CAST(outside_oppose AS DOUBLE) AS outside_oppose, "
                     "influence_ratio, vulnerability_factor FROM summary", "summary")


@register("candidate_spending_summary", SUMMARY_SQL)
def candidate_spending_summary(spark: SparkSession, sf_dir: str):
    return tables.as_output(tables.summary(spark, sf_dir))


@register("candidate_spending_summary_spine", SUMMARY_SQL)
def candidate_spending_summary_spine(spark: SparkSession, sf_dir: str):
    return tables.as_output(marts.candidate_spending_summary_spine(
        tables.inside_totals(spark, sf_dir), tables.outside_totals(spark, sf_dir)))


@register("election_spending_summary",
          with_views("SELECT cycle, candidate_count, CAST(total_inside_receipts AS DOUBLE) AS total_inside_receipts, "
                     "CAST(total_inside_disbursements AS DOUBLE) AS total_inside_disbursements, "
                     "CAST(total_outside_support AS DOUBLE) AS total_outside_support, "
                     "CAST(total_outside_oppose AS DOUBLE) AS total_outside_oppose, "
                     "global_influence_ratio FROM election", "election"))
def election_spending_summary(spark: SparkSession, sf_dir: str):
    return tables.as_output(tables.election(spark, sf_dir))


from fundflow.plans import registered_reads, registered_tree  # noqa: E402,F401
from fundflow.plans import registered_ingest  # noqa: E402,F401
from fundflow.plans import registered_jobs  # noqa: E402,F401
from fundflow.plans import registered_edges  # noqa: E402,F401
