"""Keyed tables built from the bound feeds (what an ingest run would have stored)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.operators.ingest import transform_inside, transform_outside
from fundflow.operators.specs import INSIDE_COLUMNS, OUTSIDE_COLUMNS
from fundflow.plans import marts
from fundflow.sources import fixtures


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.candidates(spark, sf_dir)


def registered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as the source delivers them by default: offices P, S, H only."""
    from fundflow.sources.predicates import source_filter
    return source_filter(candidates(spark, sf_dir), offices=("P", "S", "H"))


def inside_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform_inside(fixtures.inside_raw(spark, sf_dir)).rows.select(*INSIDE_COLUMNS)


def outside_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform_outside(fixtures.outside_raw(spark, sf_dir)).rows.select(*OUTSIDE_COLUMNS)


def summary(spark: SparkSession, sf_dir: str, cycle: int | None = None, candidate_ids: list[str] | DataFrame | None = None) -> DataFrame:
    """The spending summary, of one cycle or some candidates if asked: the filter is put on
    both inputs (it holds for whole keys), as nothing is pushed below a full outer join."""
    inside, outside = (marts.only(t, cycle, candidate_ids) for t in (inside_totals(spark, sf_dir), outside_totals(spark, sf_dir)))
    return marts.candidate_spending_summary(inside, outside)


def election(spark: SparkSession, sf_dir: str, cycle: int | None = None) -> DataFrame:
    return marts.election_spending_summary(summary(spark, sf_dir, cycle))


def as_output(df: DataFrame) -> DataFrame:
    """Response projection: decimals become doubles (the API speaks floats)."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name)
                       if f.dataType.typeName() == "decimal" else F.col(f.name)
                       for f in df.schema.fields])
