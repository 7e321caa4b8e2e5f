"""Order-within-group operators that stay balanced when one group is huge.

``Window.partitionBy(group)`` sends a whole group to one task; a group holding a
third of all rows would then be sorted by a single core. Two ways around it:

* ``run_summary`` (any order): summaries of a group's slices (first value, last value, changes
  between neighbours, rows) that combine, in slice order, to the summary of the group;
* ``rank_within_group`` (any order): range-partition on (group, order) so Spark's
  sampled bounds cut a hot group into contiguous, evenly sized slices, store the rows
  with their slice number, number rows inside each slice and add the counts of the
  group's earlier slices. The slices are read from the stored rows by both steps: a
  range partitioning that is planned twice may sample different bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fundflow.session import new_location

SLICE = "__slice"


def _slices(df: DataFrame, sort_cols: list[Column], partitions: int | None) -> DataFrame:
    """``df`` with the number of its range slice, stored once in the shared folder."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.repartitionByRange(n, *sort_cols).withColumn(SLICE, F.spark_partition_id())
    path = new_location(spark, "staging/slices")
    sliced.write.mode("errorifexists").parquet(path)
    return spark.read.schema(sliced.schema).parquet(path)


def run_summary(df: DataFrame, group: list[str], order: list[Column], value: Column,
                partitions: int | None = None) -> DataFrame:
    """Per group: ``first`` and ``last`` value in ``order``, ``changes`` (rows whose value differs from the row
    before) and ``n`` rows. Values that are null are values; a null group is a group.

    A summary of consecutive rows is (first, last, changes, n), and two of them combine to
    (first of one, last of other, changes of both + whether last and first differ, sum of n). Rows are
    cut into range slices by (group, order), each slice is summarised for itself, and a group's slices
    (one row each, however many rows they hold) are combined in their order. ``order`` must not tie
    within a group.
    """
    sorted_by = [F.col(g) for g in group] + order
    sliced = _slices(df.withColumn("__v", F.struct(value.alias("v"))), sorted_by, partitions)
    own = Window.partitionBy(SLICE, *group).orderBy(*order)
    local = sliced.withColumns({"__before": F.lag("__v").over(own), "__at": F.row_number().over(own)})
    differs = F.col("__before").isNotNull() & ~F.col("__v").eqNullSafe(F.col("__before"))
    parts = local.groupBy(SLICE, *group).agg(
        F.min_by("__v", "__at").alias("first"), F.max_by("__v", "__at").alias("last"),
        F.count_if(differs).alias("changes"), F.count(F.lit(1)).alias("n"))
    joined = parts.withColumn("__before", F.lag("last").over(Window.partitionBy(*group).orderBy(SLICE)))
    edge = F.col("__before").isNotNull() & ~F.col("first").eqNullSafe(F.col("__before"))
    total = joined.groupBy(*group).agg(
        F.min_by("first", SLICE)["v"].alias("first"), F.max_by("last", SLICE)["v"].alias("last"),
        (F.sum("changes") + F.count_if(edge)).alias("changes"), F.sum("n").alias("n"))
    return total.select(*group, "first", "last", "changes", "n")


def rank_within_group(df: DataFrame, group: list[str], order: list[Column],
                      partitions: int | None = None, name: str = "rank") -> DataFrame:
    """``row_number()`` within ``group`` by ``order`` without sending a group to one task.

    Ties in ``order`` are numbered in no fixed order, as by ``row_number()``; equal rows
    stay in one slice. Local row numbers inside each (slice, group), plus the number of rows the same
    group has in earlier slices. The per-(slice, group) counts are at most
    slices + groups rows and are joined back on (slice, group). Groups are keyed by
    a non-null encoding, so a null group value is a group like any other.
    """
    keyed = df.withColumn("__gk", F.to_json(F.struct(*[F.col(g) for g in group])))
    sliced = _slices(keyed, [F.col(g) for g in group] + order, partitions)
    w = Window.partitionBy(SLICE, "__gk").orderBy(*order)
    local = sliced.withColumn("__local", F.row_number().over(w))
    counts = local.groupBy(SLICE, "__gk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__gk").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(SLICE, "__gk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    out = local.join(offsets, [SLICE, "__gk"], "left")
    return out.select(*df.columns, (F.col("__off") + F.col("__local")).cast("int").alias(name))
