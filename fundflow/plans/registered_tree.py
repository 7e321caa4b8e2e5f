"""Spending hierarchy and its labels, with oracles."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fundflow.catalog import register
from fundflow.operators.hierarchy import spending_tree
from fundflow.oracle.bindings import compact_sql, with_views
from fundflow.plans import queries as Q, tables

CYCLE = 2000
THRESHOLD = 100_000
TOP_N = 500


def tree_sql(top_n: int | None) -> str:
    limit = f"LIMIT {top_n}" if top_n else ""
    race = "CASE office WHEN 'P' THEN 'Presidential' WHEN 'S' THEN 'Senate' WHEN 'H' THEN 'House' END"
    leaf_label = ("CASE leaf WHEN 'Inside' THEN 'Direct Campaign Spending' WHEN 'Outside Support' "
                  "THEN 'Independent Support' WHEN 'Outside Oppose' THEN 'Independent Opposition' ELSE leaf END")
    body = f"""
, feed AS (
  SELECT * FROM summary_c WHERE cycle = {CYCLE}
  ORDER BY (outside_support + outside_oppose) DESC NULLS FIRST, candidate_id, cycle {limit}),
base AS (
  SELECT candidate_id, candidate_office AS office, COALESCE(candidate_name, candidate_id) AS cand_name,
    candidate_party AS party, COALESCE(inside_disbursements, 0) AS v_inside,
    COALESCE(outside_support, 0) AS v_support, COALESCE(outside_oppose, 0) AS v_oppose
  FROM feed WHERE candidate_office IN ('P', 'S', 'H')),
leaves AS (
  SELECT office, candidate_id, cand_name, party, 'Inside' AS leaf, v_inside AS value
    FROM base WHERE v_support + v_oppose >= {THRESHOLD}
  UNION ALL SELECT office, candidate_id, cand_name, party, 'Outside Support', v_support
    FROM base WHERE v_support + v_oppose >= {THRESHOLD}
  UNION ALL SELECT office, candidate_id, cand_name, party, 'Outside Oppose', v_oppose
    FROM base WHERE v_support + v_oppose >= {THRESHOLD}
  UNION ALL SELECT r.office, 'Others', 'Others', NULL, NULL, COALESCE(o.v, 0)
    FROM (VALUES ('P'), ('S'), ('H')) r(office)
    LEFT JOIN (SELECT office, SUM(v_inside + v_support + v_oppose) AS v FROM base
               WHERE v_support + v_oppose < {THRESHOLD} GROUP BY office) o ON r.office = o.office),
agg AS (
  SELECT office, candidate_id, leaf, SUM(value) AS value, MAX(cand_name) AS cand_name, MAX(party) AS party,
    GROUPING_ID(office, candidate_id, leaf) AS gid
  FROM leaves GROUP BY ROLLUP (office, candidate_id, leaf)),
lv AS (
  SELECT *, CASE gid WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS level, {race} AS race
  FROM agg WHERE NOT (gid = 0 AND leaf IS NULL)),
nodes AS (
  SELECT level,
    CASE WHEN level = 0 THEN 'root' WHEN level = 1 THEN 'race' WHEN level = 2 AND candidate_id = 'Others'
         THEN 'others' WHEN level = 2 THEN 'candidate' ELSE 'spending' END AS kind,
    concat_ws('/', 'root', CASE WHEN level >= 1 THEN race END, CASE WHEN level >= 2 THEN candidate_id END,
              CASE WHEN level >= 3 THEN leaf END) AS path,
    CASE WHEN level = 0 THEN NULL WHEN level = 1 THEN 'root' WHEN level = 2 THEN concat_ws('/', 'root', race)
         ELSE concat_ws('/', 'root', race, candidate_id) END AS parent,
    CASE WHEN level = 0 THEN 'root' WHEN level = 1 THEN race WHEN level = 2 THEN cand_name ELSE leaf END AS name,
    CASE WHEN level = 3 THEN {leaf_label} WHEN level = 0 THEN 'root' WHEN level = 1 THEN race
         WHEN level = 2 THEN cand_name END AS label,
    CASE WHEN level = 2 AND candidate_id <> 'Others' THEN party END AS party,
    CASE WHEN level = 1 THEN (CASE race WHEN 'House' THEN 'house' WHEN 'Senate' THEN 'senate'
                                        WHEN 'Presidential' THEN 'president' ELSE 'neutral' END)
         WHEN level = 2 AND candidate_id <> 'Others' THEN (CASE WHEN party IN ('DEM', 'DFL') THEN 'dem'
                                                                WHEN party = 'REP' THEN 'rep' ELSE 'neutral' END)
         WHEN level = 3 THEN (CASE leaf WHEN 'Inside' THEN 'president' WHEN 'Outside Oppose' THEN 'rep'
                                        WHEN 'Outside Support' THEN 'house' ELSE 'neutral' END)
         ELSE 'neutral' END AS color_group,
    value,
    concat_ws(' > ', 'All Races', CASE WHEN level >= 1 THEN race END, CASE WHEN level >= 2 THEN cand_name END,
              CASE WHEN level >= 3 THEN {leaf_label} END) AS breadcrumb
  FROM lv)
SELECT level, kind, path, parent, name, label, party, color_group, CAST(value AS DOUBLE) AS value,
  {compact_sql('value')} AS value_text, breadcrumb,
  CAST(ROW_NUMBER() OVER (PARTITION BY parent ORDER BY value DESC, name ASC, path ASC) AS INTEGER) AS sibling_rank
FROM nodes"""
    head = with_views("SELECT 1", "summary_c")
    return head[: -len("\nSELECT 1")] + body


@register("spending_hierarchy", tree_sql(TOP_N))
def spending_hierarchy(spark: SparkSession, sf_dir: str):
    feed = Q.top_outside_spenders(tables.summary(spark, sf_dir, CYCLE), CYCLE, TOP_N)
    # rows without a known candidate are skipped by the tree
    rows = Q.attach_candidates(feed, tables.candidates(spark, sf_dir), known_only=True)
    return tables.as_output(spending_tree(spark, rows, THRESHOLD))


@register("spending_hierarchy_all", tree_sql(None))
def spending_hierarchy_all(spark: SparkSession, sf_dir: str):
    rows = Q.with_candidates(tables.summary(spark, sf_dir, CYCLE),
                             tables.candidates(spark, sf_dir), keep_unmatched=False)
    return tables.as_output(spending_tree(spark, rows, THRESHOLD))
