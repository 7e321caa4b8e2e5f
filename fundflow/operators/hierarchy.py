"""Office -> candidate -> spending-type tree, as flat node rows.

Input: spending rows of one cycle with candidate details. Output: one row per node
with its level, path, parent, value (sum of the leaves below it), labels, and rank
among siblings. Tree shape:

    root (All Races)
      race (Presidential / Senate / House, always all three)
        candidate (outside total >= threshold), with 3 leaves: Inside, Outside Support, Outside Oppose
        Others (always present; inside + outside money of everyone under the threshold)

Plan: one pass over the input explodes each row into its leaves (3 for a named
candidate, one "Others" leaf otherwise), a 3-row race scaffold is unioned in, and every
inner node's value, Others included, comes from a single ``rollup`` (Expand +
partial/final aggregate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fundflow.functions.labels import (
    LEAF_NAMES, NO_CATEGORY, OFFICE_LABELS, OFFICE_ORDER, OTHERS, ROOT_LABEL, ROOT_NAME, display_category, leaf_label,
    office_label,
)
from fundflow.functions.money import WIDE_MONEY, compact_dollars
from fundflow.operators.ordered import rank_within_group
from fundflow.session import new_location

DEFAULT_THRESHOLD = 1_000_000
SEP = "/"


def race_scaffold(spark: SparkSession) -> DataFrame:
    """The fixed domain of races (3 rows), so every race exists even with no data."""
    return spark.createDataFrame([(c, OFFICE_LABELS[c], i) for i, c in enumerate(OFFICE_ORDER)],
                                 "office string, race string, race_order int")


def spending_tree(spark: SparkSession, rows: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Flat tree over spending rows that carry a ``candidate`` struct (or null).

    The node rows are staged in the shared folder (so the rank's range sampling does not
    re-run the query above) and siblings are ranked on balanced range slices, whatever the
    size of the input: a race can have very many candidates. Labels are joined back to the
    nodes after the rollup, which sums values only.
    """
    zero = F.lit(0).cast(WIDE_MONEY)
    base = rows.select(
        "candidate_id",
        F.col("candidate.office").alias("office"),
        F.coalesce(F.col("candidate.name"), F.col("candidate_id")).alias("cand_name"),
        F.col("candidate.party").alias("party"),
        F.coalesce(F.col("inside_disbursements"), zero).alias("v_inside"),
        F.coalesce(F.col("outside_support"), zero).alias("v_support"),
        F.coalesce(F.col("outside_oppose"), zero).alias("v_oppose"),
    ).filter(F.col("office").isin(OFFICE_ORDER))          # null candidate / office skipped
    outside_total = F.col("v_support") + F.col("v_oppose")
    named = outside_total >= F.lit(threshold)

    # one pass over the input: a named candidate becomes its 3 leaves, anyone under the
    # threshold one "Others" leaf of its race (summed by the rollup below); the 3-row race
    # scaffold guarantees every race and Others exists
    text = lambda v: F.lit(v).cast("string")
    leaf = lambda name, v: F.struct(F.col("candidate_id").alias("candidate_id"), text(name).alias("leaf"),
                                    v.cast(WIDE_MONEY).alias("value"))
    other = F.struct(F.lit(OTHERS).alias("candidate_id"), text(None).alias("leaf"),
                     (F.col("v_inside") + outside_total).cast(WIDE_MONEY).alias("value"))
    named_leaves = F.array(*[leaf(n, F.col(c)) for n, c in zip(LEAF_NAMES, ["v_inside", "v_support", "v_oppose"])])
    leaves = (base.select("office", F.explode(F.when(named, named_leaves).otherwise(F.array(other))).alias("x"))
              .select("office", "x.*"))
    scaffold = race_scaffold(spark).select("office", F.lit(OTHERS).alias("candidate_id"), text(None).alias("leaf"),
                                           zero.alias("value"))
    sums = (leaves.unionByName(scaffold).rollup("office", "candidate_id", "leaf")
            .agg(F.sum("value").alias("value"), F.grouping_id().alias("gid")))
    labels = (base.where(named).groupBy("office", "candidate_id")
              .agg(F.max("cand_name").alias("cand_name"), F.max("party").alias("party"))
              .unionByName(race_scaffold(spark).select("office", F.lit(OTHERS).alias("candidate_id"),
                                                       F.lit(OTHERS).alias("cand_name"), text(None).alias("party"))))
    agg = sums.join(labels, ["office", "candidate_id"], "left")
    # gid bits (office, candidate_id, leaf): 0 leaf, 1 candidate/others node, 3 race, 7 root.
    # "Others" is a leaf of its race: keep its node-level row, drop its empty leaf-level twin.
    agg = agg.filter(~((F.col("gid") == 0) & F.col("leaf").isNull()))

    level = (F.when(F.col("gid") == 7, 0).when(F.col("gid") == 3, 1)
             .when(F.col("gid") == 1, 2).otherwise(3))
    race = office_label("office")
    is_others = F.col("candidate_id") == OTHERS
    node_name = (F.when(level == 0, F.lit(ROOT_NAME)).when(level == 1, race)
                 .when(level == 2, F.col("cand_name")).otherwise(F.col("leaf")))
    path = F.concat_ws(SEP, F.lit(ROOT_NAME),
                       F.when(level >= 1, race), F.when(level >= 2, F.col("candidate_id")),
                       F.when(level >= 3, F.col("leaf")))
    parent = (F.when(level == 0, F.lit(None).cast("string"))
              .when(level == 1, F.lit(ROOT_NAME))
              .when(level == 2, F.concat_ws(SEP, F.lit(ROOT_NAME), race))
              .otherwise(F.concat_ws(SEP, F.lit(ROOT_NAME), race, F.col("candidate_id"))))
    crumbs = F.concat_ws(" > ", F.lit(ROOT_LABEL), F.when(level >= 1, race),
                         F.when(level >= 2, F.col("cand_name")), F.when(level >= 3, leaf_label("leaf")))
    kind = (F.when(level == 0, "root").when(level == 1, "race")
            .when((level == 2) & is_others, "others").when(level == 2, "candidate").otherwise("spending"))
    group = (F.when(level == 1, display_category("race", race))
             .when((level == 2) & ~is_others, display_category("party", "party"))
             .when(level == 3, display_category("leaf", "leaf"))
             .otherwise(F.lit(NO_CATEGORY)))
    nodes = agg.select(
        level.alias("level"), kind.alias("kind"), path.alias("path"), parent.alias("parent"),
        node_name.alias("name"),
        F.when(level == 3, leaf_label("leaf")).otherwise(node_name).alias("label"),
        F.when((level == 2) & ~is_others, F.col("party")).alias("party"),
        group.alias("color_group"),
        F.col("value").cast(WIDE_MONEY).alias("value"),
        compact_dollars(F.col("value")).alias("value_text"),
        crumbs.alias("breadcrumb"))
    # siblings by summed value, largest first; ties by name then path for a total order
    order = [F.col("value").desc(), F.col("name").asc(), F.col("path").asc()]
    stored = new_location(spark, "staging/tree_nodes")
    nodes.write.mode("errorifexists").parquet(stored)
    return rank_within_group(spark.read.schema(nodes.schema).parquet(stored), ["parent"], order, name="sibling_rank")
