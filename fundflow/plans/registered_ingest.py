"""Write-path queries: cleaning, names, de-duplication, quality, FK, merge, sources,
refresh, batch job and incremental stream, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.catalog import register
from fundflow.functions.text import TITLE_SUFFIXES, UPPER_SUFFIXES, person_name
from fundflow.operators import merge as M
from fundflow.operators.ingest import transform_candidates, transform_committees, transform_outside
from fundflow.operators.quality import ERRORS, SEQ, fk_split, quarantine_report, validate
from fundflow.operators.specs import CANDIDATES, INSIDE_TOTALS
from fundflow.oracle.bindings import title_sql, with_views, words_sql, strip_sql
from fundflow.plans import tables
from fundflow.sources import fixtures as FX

CAND_RAW_OUT = ["candidate_id", "name", "office", "state", "party", "district", "last_file_date"]


def _cand_out(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in CAND_RAW_OUT])


# ---------------------------------------------------------------- accumulation / first wins
@register("inside_accumulated", with_views(
    "SELECT candidate_id, cycle, CAST(receipts AS DOUBLE) AS receipts, "
    "CAST(disbursements AS DOUBLE) AS disbursements FROM inside_t", "inside_t"))
def inside_accumulated(spark: SparkSession, sf_dir: str):
    return tables.as_output(tables.inside_totals(spark, sf_dir))


@register("outside_first_wins", with_views(
    "SELECT candidate_id, cycle, support_oppose_indicator, CAST(total AS DOUBLE) AS total FROM outside_t",
    "outside_t"))
def outside_first_wins(spark: SparkSession, sf_dir: str):
    return tables.as_output(tables.outside_totals(spark, sf_dir))


@register("outside_duplicates", with_views(
    "SELECT CAST((SELECT COUNT(*) FROM outside_raw WHERE COALESCE(candidate_id, '') <> '' AND COALESCE(cycle, 0) <> 0 "
    "AND COALESCE(support_oppose_indicator, '') <> '') - (SELECT COUNT(*) FROM outside_t) AS BIGINT) AS duplicates",
    "outside_raw", "outside_t"))
def outside_duplicates(spark: SparkSession, sf_dir: str):
    """Rows dropped by first-wins on the raw key and last-wins on the clean key."""
    return transform_outside(FX.outside_raw(spark, sf_dir)).tally.select("duplicates")


# ---------------------------------------------------------------- candidates
@register("candidates_clean", with_views(
    "SELECT seq, candidate_id, name, office, state, party, district, last_file_date, errors "
    "FROM candidates_checked", "candidates_checked"))
def candidates_clean(spark: SparkSession, sf_dir: str):
    v = validate(FX.candidates_raw(spark, sf_dir), CANDIDATES)
    return v.select(F.col(SEQ).alias("seq"), *[F.col(c).cast("string").alias(c) for c in CAND_RAW_OUT],
                    F.array_join(ERRORS, ",").alias("errors"))


@register("candidates_last_wins", with_views(
    "SELECT candidate_id, name, office, state, party, district, last_file_date FROM candidates_last",
    "candidates_last"))
def candidates_last_wins(spark: SparkSession, sf_dir: str):
    return _cand_out(transform_candidates(FX.candidates_raw(spark, sf_dir)).rows)


@register("quality_report", with_views(
    "SELECT 'candidates' AS entity, 'kept' AS metric, CAST(COUNT(*) AS BIGINT) AS rows FROM candidates_last "
    "UNION ALL SELECT 'candidates', 'invalid', CAST(COUNT(*) FILTER (WHERE errors <> '') AS BIGINT) FROM candidates_checked "
    "UNION ALL SELECT 'candidates', 'skipped', CAST(0 AS BIGINT) "
    "UNION ALL SELECT 'candidates', 'duplicates', CAST(COUNT(*) FILTER (WHERE errors = '') AS BIGINT) - "
    "(SELECT COUNT(*) FROM candidates_last) FROM candidates_checked "
    "UNION ALL SELECT 'schedule_e_totals_by_candidate', 'kept', COUNT(*) FROM outside_t "
    "UNION ALL SELECT 'schedule_e_totals_by_candidate', 'invalid', COUNT(*) FILTER (WHERE UPPER(support_oppose_indicator) "
    "NOT IN ('S', 'O')) FROM outside_first "
    "UNION ALL SELECT 'schedule_e_totals_by_candidate', 'skipped', COUNT(*) FILTER (WHERE support_oppose_indicator IS NULL) FROM outside_raw "
    "UNION ALL SELECT 'schedule_e_totals_by_candidate', 'duplicates', (SELECT COUNT(*) FROM outside_raw "
    "WHERE support_oppose_indicator IS NOT NULL) - (SELECT COUNT(*) FROM outside_t)",
    "candidates_last", "candidates_checked", "outside_t"))
def quality_report(spark: SparkSession, sf_dir: str):
    return (transform_candidates(FX.candidates_raw(spark, sf_dir)).report()
            .unionByName(transform_outside(FX.outside_raw(spark, sf_dir)).report()))


@register("quarantine_rules", with_views(
    "SELECT rule, CAST(COUNT(*) AS BIGINT) AS rows FROM (SELECT unnest(string_split(errors, ',')) AS rule "
    "FROM committees_checked WHERE errors <> '') GROUP BY rule", "committees_checked"))
def quarantine_rules(spark: SparkSession, sf_dir: str):
    return quarantine_report(transform_committees(FX.committees_raw(spark, sf_dir)).quarantine)


@register("committees_clean", with_views(
    "SELECT committee_id, name, committee_type, affiliated_committee_name, state, errors "
    "FROM committees_checked", "committees_checked"))
def committees_clean(spark: SparkSession, sf_dir: str):
    from fundflow.operators.specs import COMMITTEES
    v = validate(FX.committees_raw(spark, sf_dir), COMMITTEES)
    return v.select("committee_id", "name", "committee_type", "affiliated_committee_name", "state",
                    F.array_join(ERRORS, ",").alias("errors"))


# ---------------------------------------------------------------- person names
_UPPER = ", ".join(f"'{s}'" for s in UPPER_SUFFIXES)
_TITLE = ", ".join(f"'{s}'" for s in TITLE_SUFFIXES)
_NORM = "regexp_replace(upper(w), '\\.+$', '')"
PERSON_NAMES_SQL = f"""
WITH p AS (
  SELECT p_partkey AS name_id,
    UPPER(split_part(p_name, ' ', 2)) || ', ' || UPPER(split_part(p_name, ' ', 1)) ||
    CASE p_size % 5 WHEN 0 THEN ', JR.' WHEN 1 THEN ' III' WHEN 2 THEN ' PhD' WHEN 3 THEN ' V' ELSE '' END AS raw_name
  FROM part),
s AS (SELECT name_id, raw_name, {strip_sql('raw_name')} AS v FROM p),
c AS (
  SELECT name_id, raw_name, v, string_split(v, ',') AS parts FROM s),
w AS (
  SELECT name_id, raw_name, v, {strip_sql('parts[1]')} AS last_name,
    {words_sql("array_to_string(parts[2:], ' ')")} AS words FROM c),
g AS (
  SELECT name_id, raw_name, v, last_name,
    list_filter(words, lambda w: {_NORM} NOT IN ({_UPPER}, {_TITLE})) AS given,
    list_transform(list_filter(words, lambda w: {_NORM} IN ({_UPPER}, {_TITLE})),
                   lambda w: CASE WHEN {_NORM} IN ({_UPPER}) THEN {_NORM} ELSE {title_sql(_NORM)} END) AS sfx
  FROM w),
r AS (
  SELECT name_id, raw_name,
    CASE WHEN position(',' IN v) = 0
         THEN array_to_string(list_transform({words_sql('v')}, lambda w: {title_sql('w')}), ' ')
         ELSE array_to_string(list_transform(list_append(given, last_name), lambda w: {title_sql('w')}), ' ')
              || CASE WHEN len(sfx) > 0 THEN ' ' || array_to_string(sfx, ' ') ELSE '' END
    END AS name
  FROM g)
SELECT name_id, raw_name, {strip_sql('name')} AS name FROM r
"""


@register("person_names", PERSON_NAMES_SQL)
def person_names(spark: SparkSession, sf_dir: str):
    p = FX.part_names(spark, sf_dir)
    return p.select("name_id", "raw_name", person_name("raw_name").alias("name"))


# ---------------------------------------------------------------- foreign keys
_OUT_T = "SELECT candidate_id, cycle, support_oppose_indicator, CAST(total AS DOUBLE) AS total FROM outside_t "


@register("fk_accepts", with_views(
    _OUT_T + "WHERE candidate_id IN (SELECT candidate_id FROM registered)", "outside_t", "registered"))
def fk_accepts(spark: SparkSession, sf_dir: str):
    ok, _ = fk_split(tables.outside_totals(spark, sf_dir), tables.registered_candidates(spark, sf_dir))
    return tables.as_output(ok)


@register("fk_rejects", with_views(
    _OUT_T + "WHERE candidate_id NOT IN (SELECT candidate_id FROM registered)", "outside_t", "registered"))
def fk_rejects(spark: SparkSession, sf_dir: str):
    _, bad = fk_split(tables.outside_totals(spark, sf_dir), tables.registered_candidates(spark, sf_dir))
    return tables.as_output(bad)


# ---------------------------------------------------------------- merge
_MERGE_VIEWS = f"""
WITH stored AS (
  SELECT CAST(o_custkey AS VARCHAR) AS candidate_id, CAST(YEAR(o_orderdate) + YEAR(o_orderdate) % 2 AS INTEGER) AS cycle,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(15,2)) AS receipts,
    CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(15,2)) END) AS DECIMAL(15,2)) AS disbursements,
    TIMESTAMP '{FX.STORED_CREATED_AT}' AS created_at, TIMESTAMP '{FX.STORED_CREATED_AT}' AS updated_at
  FROM orders WHERE o_orderdate < TIMESTAMP '{FX.MERGE_STORED_BEFORE}' GROUP BY 1, 2),
incoming AS (
  SELECT CAST(o_custkey AS VARCHAR) AS candidate_id, CAST(YEAR(o_orderdate) + YEAR(o_orderdate) % 2 AS INTEGER) AS cycle,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(15,2)) AS receipts,
    CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(15,2)) END) AS DECIMAL(15,2)) AS disbursements
  FROM orders WHERE o_orderdate >= TIMESTAMP '{FX.MERGE_INCOMING_FROM}' GROUP BY 1, 2),
j AS (
  SELECT COALESCE(s.candidate_id, i.candidate_id) AS candidate_id, COALESCE(s.cycle, i.cycle) AS cycle,
    s.receipts AS s_r, s.disbursements AS s_d, i.receipts AS i_r, i.disbursements AS i_d,
    s.created_at, s.updated_at,
    CASE WHEN s.candidate_id IS NULL THEN 'insert' WHEN i.candidate_id IS NULL THEN 'keep'
         WHEN s.receipts IS DISTINCT FROM i.receipts OR s.disbursements IS DISTINCT FROM i.disbursements
         THEN 'update' ELSE 'unchanged' END AS action
  FROM stored s FULL OUTER JOIN incoming i ON s.candidate_id = i.candidate_id AND s.cycle = i.cycle)
"""


def _merge(spark: SparkSession, sf_dir: str) -> M.MergeResult:
    return M.merge(FX.merge_stored(spark, sf_dir), FX.merge_incoming(spark, sf_dir), INSIDE_TOTALS, FX.RUN_TS)


@register("merge_result", _MERGE_VIEWS + f"""
SELECT candidate_id, cycle,
  CAST(CASE WHEN action IN ('insert', 'update') THEN i_r ELSE s_r END AS DOUBLE) AS receipts,
  CAST(CASE WHEN action IN ('insert', 'update') THEN i_d ELSE s_d END AS DOUBLE) AS disbursements,
  CAST(COALESCE(created_at, TIMESTAMP '{FX.RUN_TS}') AS VARCHAR) AS created_at,
  CAST(CASE WHEN action IN ('insert', 'update') THEN TIMESTAMP '{FX.RUN_TS}' ELSE updated_at END AS VARCHAR) AS updated_at,
  action
FROM j""")
def merge_result(spark: SparkSession, sf_dir: str):
    f = _merge(spark, sf_dir).frame
    return tables.as_output(f.select("candidate_id", "cycle", "receipts", "disbursements",
                                     F.col("created_at").cast("string").alias("created_at"),
                                     F.col("updated_at").cast("string").alias("updated_at"),
                                     F.col(M.ACTION).alias("action")))


@register("merge_stats", _MERGE_VIEWS + """
SELECT CAST(COUNT(*) FILTER (WHERE action = 'insert') AS BIGINT) AS inserted,
  CAST(COUNT(*) FILTER (WHERE action = 'update') AS BIGINT) AS updated,
  CAST(COUNT(*) FILTER (WHERE action = 'unchanged') AS BIGINT) AS unchanged,
  CAST(COUNT(*) FILTER (WHERE action = 'keep') AS BIGINT) AS kept,
  CAST(0 AS BIGINT) AS errors
FROM j""")
def merge_stats(spark: SparkSession, sf_dir: str):
    return _merge(spark, sf_dir).stats()


@register("merge_duplicate_stats", _MERGE_VIEWS.replace("WITH stored AS", "WITH stored0 AS", 1).replace(
    "incoming AS (", "stored AS (SELECT * FROM stored0), incoming_unused AS (", 1) + f"""
, v AS (
  SELECT CAST(o_custkey AS VARCHAR) AS candidate_id, CAST(YEAR(o_orderdate) + YEAR(o_orderdate) % 2 AS INTEGER) AS cycle,
    CAST(FLOOR(o_totalprice / 100000) * 100000 AS DECIMAL(15,2)) AS receipts,
    CASE WHEN o_orderstatus = 'F' THEN CAST(FLOOR(o_totalprice / 100000) * 100000 AS DECIMAL(15,2)) END AS disbursements,
    o_orderkey AS seq
  FROM orders WHERE o_orderdate >= TIMESTAMP '{FX.MERGE_INCOMING_FROM}'),
r AS (
  SELECT *, ROW_NUMBER() OVER w AS rn, LAG(receipts) OVER w AS p_r, LAG(disbursements) OVER w AS p_d
  FROM v WINDOW w AS (PARTITION BY candidate_id, cycle ORDER BY seq))
SELECT CAST(COUNT(*) FILTER (WHERE r.rn = 1 AND s.candidate_id IS NULL) AS BIGINT) AS inserted,
  CAST(COUNT(*) FILTER (WHERE (r.rn = 1 AND s.candidate_id IS NOT NULL AND
                               (r.receipts IS DISTINCT FROM s.receipts OR r.disbursements IS DISTINCT FROM s.disbursements))
                           OR (r.rn > 1 AND (r.receipts IS DISTINCT FROM r.p_r OR r.disbursements IS DISTINCT FROM r.p_d)))
       AS BIGINT) AS updated
FROM r LEFT JOIN stored s ON r.candidate_id = s.candidate_id AND r.cycle = s.cycle""")
def merge_duplicate_stats(spark: SparkSession, sf_dir: str):
    return M.write_counts(FX.merge_stored(spark, sf_dir), FX.merge_incoming_versions(spark, sf_dir), INSIDE_TOTALS)


@register("merge_empty_batch", _MERGE_VIEWS + """
SELECT CAST(0 AS BIGINT) AS inserted, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS unchanged,
  CAST(COUNT(*) AS BIGINT) AS kept, CAST(0 AS BIGINT) AS errors FROM stored""")
def merge_empty_batch(spark: SparkSession, sf_dir: str):
    """An empty incoming batch: every stored row is kept, nothing else counted."""
    incoming = FX.merge_incoming(spark, sf_dir).filter(F.lit(False))  # the batch that arrives empty
    return M.merge(FX.merge_stored(spark, sf_dir), incoming, INSIDE_TOTALS, FX.RUN_TS).stats()
