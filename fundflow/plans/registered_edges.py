"""Queries for the edges of the rules: deep pages, request arguments, response ratios, source defaults, typed
and null fields, failed ids, the date window of a job and the refresh of single cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundflow.catalog import register
from fundflow.functions.dates import cycle_of
from fundflow.operators.ingest import transform_candidates, transform_committees, transform_inside, transform_outside
from fundflow.operators.quality import ERRORS, SEQ, validate
from fundflow.operators.specs import CANDIDATES, COMMITTEES
from fundflow.oracle.bindings import CYCLE, with_views
from fundflow.plans import jobs, queries as Q, tables
from fundflow.plans.refresh import SUMMARY_TABLE
from fundflow.plans.registered_jobs import REGISTERED, _fresh_store
from fundflow.session import new_location
from fundflow.sources import fixtures as FX
from fundflow.sources.paged_json import read_pages
from fundflow.sources.predicates import totals_filter


def by_remainder(c: Column, values: list) -> Column:
    """The value at ``c`` modulo the number of values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values)).cast("int") + 1)


def by_remainder_sql(c: str, values: list) -> str:
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values))
    return f"CASE {c} % {len(values)} {cases} END"


# ---------------------------------------------------------------- deep pages
DEEP_LIMIT, DEEP_OFFSETS = 1000, (0, 15_000, 50_000, 1_000_001)
_EXPENDITURES = ("(SELECT l_orderkey, l_linenumber, candidate_id, total, ROW_NUMBER() OVER (ORDER BY total DESC NULLS FIRST, "
                 "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place FROM outside_raw)")


@register("deep_pages", with_views(" UNION ALL ".join(
    f"SELECT CAST({o} AS BIGINT) AS page_offset, candidate_id, CAST(total AS DOUBLE) AS total FROM {_EXPENDITURES} "
    f"WHERE place >= {o} AND place < {o + DEEP_LIMIT}" for o in DEEP_OFFSETS), "outside_raw"))
def deep_pages(spark: SparkSession, sf_dir: str):
    """Pages of all expenditures by amount, one of them beyond a million rows; the index is made once."""
    base = FX.outside_raw(spark, sf_dir)
    order_by = [Q.sort_key(F.col("total"), "desc"), F.col(SEQ).asc()]
    index, out = Q.page_index(base, order_by), None
    for offset in DEEP_OFFSETS:
        page = Q.paginate(base, order_by, DEEP_LIMIT, offset, index).rows
        page = page.select(F.lit(offset).cast("long").alias("page_offset"), "candidate_id", F.col("total").cast("double").alias("total"))
        out = page if out is None else out.unionByName(page)
    return out


# ---------------------------------------------------------------- request arguments
_SORTS = {"1-URGENT": "cycle", "2-HIGH": "outside_total", "3-MEDIUM": "influence_ratio"}
_ORDERS = {"F": "asc", "O": "desc"}


def _case_sql(c: str, values: dict, default: str) -> str:
    return f"CASE {c} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in values.items())} ELSE {default!r} END"


@register("page_argument_rules", f"""
SELECT o_orderkey, concat_ws(',', CASE WHEN NOT (lim BETWEEN 1 AND 1000) THEN 'limit' END, CASE WHEN off < 0 THEN 'offset' END,
  CASE WHEN key NOT IN ('cycle', 'outside_total', 'influence_ratio') THEN 'sort_by' END, CASE WHEN way NOT IN ('asc', 'desc') THEN 'order' END) AS errors
FROM (SELECT o_orderkey, o_orderkey % 1200 AS lim, o_custkey - 100 AS off, {_case_sql("o_orderpriority", _SORTS, "name")} AS key,
  {_case_sql("o_orderstatus", _ORDERS, "up")} AS way FROM orders)""")
def page_argument_rules(spark: SparkSession, sf_dir: str):
    """Requests made of the orders, and the arguments that each gets wrong."""
    errors = Q.page_errors(F.col("o_orderkey") % 1200, F.col("o_custkey") - 100, FX._case(F.col("o_orderpriority"), _SORTS, "name"),
                           FX._case(F.col("o_orderstatus"), _ORDERS, "up"))
    return FX.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(errors, ",").alias("errors"))


# ---------------------------------------------------------------- response ratios
def _rounded_sql(x: str) -> str:
    """A non-negative double rounded to cents by its binary value, half to even, in whole numbers of 2**-100."""
    unit, two = f"CAST({2 ** 100} AS HUGEINT)", f"{2 ** 100}.0::DOUBLE"
    n = f"CAST(({x} - floor({x})) * {two} AS HUGEINT)"
    cents, rest = f"(({n} * 100) // {unit})", f"(({n} * 100) % {unit})"
    up = f"CASE WHEN {rest} * 2 > {unit} OR ({rest} * 2 = {unit} AND {cents} % 2 = 1) THEN 1 ELSE 0 END"
    return f"CAST(CAST(floor({x}) AS HUGEINT) * 100 + {cents} + {up} AS DOUBLE) / 100.0"


@register("spending_response_ratios", with_views(f"""
SELECT candidate_id, cycle, {_rounded_sql('i')} AS influence_ratio, {_rounded_sql('v')} AS vulnerability_factor
FROM (SELECT candidate_id, cycle, (support + oppose) / denominator AS i, oppose / denominator AS v FROM (
  SELECT candidate_id, cycle, CAST(outside_support AS DOUBLE) AS support, CAST(outside_oppose AS DOUBLE) AS oppose,
    NULLIF(CAST(inside_disbursements AS DOUBLE), 0) AS denominator FROM summary))""", "summary"))
def spending_response_ratios(spark: SparkSession, sf_dir: str):
    return Q.response_ratios(tables.summary(spark, sf_dir)).select("candidate_id", "cycle", "influence_ratio", "vulnerability_factor")


# ---------------------------------------------------------------- source defaults
def _office_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw totals as the source has them: every office, and both two-year periods and full elections."""
    o, c = FX.table(spark, sf_dir, "orders"), FX.table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_custkey").cast("string").alias("candidate_id"), cycle_of("o_orderdate").alias("cycle"),
        FX._case(F.col("c_mktsegment"), FX.SEGMENT_OFFICE, "L").alias("office"), (F.col("o_orderkey") % 3 == 0).alias("election_full"))


@register("totals_source_defaults", f"""
WITH t AS (SELECT {CYCLE.format(t='o_orderdate')} AS cycle, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'H' WHEN 'BUILDING' THEN 'S'
    WHEN 'AUTOMOBILE' THEN 'P' ELSE 'L' END AS office, o_orderkey % 3 = 0 AS election_full FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'default' AS request, CAST(COUNT(*) AS BIGINT) AS rows FROM t WHERE cycle = 2024 AND office <> 'L' AND NOT election_full
UNION ALL SELECT 'cycle', COUNT(*) FROM t WHERE cycle = 1996 AND office <> 'L' AND NOT election_full
UNION ALL SELECT 'full', COUNT(*) FROM t WHERE cycle = 1996 AND office <> 'L' AND election_full
UNION ALL SELECT 'office', COUNT(*) FROM t WHERE cycle = 1996 AND office = 'S' AND NOT election_full
UNION ALL SELECT 'everything', COUNT(*) FROM t""")
def totals_source_defaults(spark: SparkSession, sf_dir: str):
    feed = _office_totals(spark, sf_dir)
    asked = {"default": totals_filter(feed), "cycle": totals_filter(feed, 1996), "full": totals_filter(feed, 1996, election_full=True),
             "office": totals_filter(feed, 1996, ("S",)), "everything": totals_filter(feed, None, None, election_full=None)}
    out = None
    for request, rows in asked.items():
        counted = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(request).alias("request"), "rows")
        out = counted if out is None else out.unionByName(counted)
    return out


# ---------------------------------------------------------------- typed fields
# Texts that a feed may carry, by the remainder of the key.
ACTIVE = ["2024", "2024.0", "2024.7", " 2020 ", "soon", None]
FLAGS = ["true", "false", "maybe", None]
DATES = ["2020-01-31", "31/01/2020", None, "2020-02-30", "1999-12-31"]
LOADED = ["2024-01-01T10:00:00", "x", None]
CYCLES = ["2020,2022", " 2020", "2020.5", None]


@register("typed_fields", f"""
WITH r AS (SELECT c_custkey AS k, {by_remainder_sql('c_custkey', ACTIVE)} AS a, {by_remainder_sql('c_custkey', FLAGS)} AS f,
  {by_remainder_sql('c_custkey', DATES)} AS d, {by_remainder_sql('c_custkey', LOADED)} AS l, {by_remainder_sql('c_custkey', CYCLES)} AS c FROM customer)
SELECT CAST(k AS VARCHAR) AS candidate_id,
  concat_ws(',', CASE WHEN a IN ('2024.7', 'soon') THEN 'active_through_type' END, CASE WHEN c = '2020.5' THEN 'cycles_type' END,
    CASE WHEN f = 'maybe' THEN 'federal_funds_flag_type' END, CASE WHEN l = 'x' THEN 'load_date_type' END,
    CASE WHEN d IN ('31/01/2020', '2020-02-30') THEN 'first_file_date_type' END) AS errors,
  CASE WHEN a IN ('2024', '2024.0') THEN '2024' WHEN a = ' 2020 ' THEN '2020' END AS active_through,
  CASE WHEN f <> 'maybe' THEN f END AS federal_funds_flag,
  CASE WHEN d IN ('2020-01-31', '1999-12-31') THEN d END AS first_file_date,
  CASE WHEN l LIKE '2024%' THEN '2024-01-01 10:00:00' END AS load_date,
  CASE c WHEN '2020,2022' THEN '2020,2022' WHEN ' 2020' THEN '2020' ELSE '' END AS cycles
FROM r""")
def typed_fields(spark: SparkSession, sf_dir: str):
    """Candidate records whose fields come as text, some of them not of the field's type."""
    k = F.col("c_custkey")
    feed = FX.table(spark, sf_dir, "customer").select(
        k.cast("string").alias("candidate_id"), F.col("c_name").alias("name"), by_remainder(k, ACTIVE).alias("active_through"),
        by_remainder(k, FLAGS).alias("federal_funds_flag"), by_remainder(k, DATES).alias("first_file_date"),
        by_remainder(k, LOADED).alias("load_date"), F.split(by_remainder(k, CYCLES), ",").alias("cycles"), k.alias(SEQ))
    v = validate(feed, CANDIDATES)
    return v.select("candidate_id", F.array_join(ERRORS, ",").alias("errors"),
                    *[F.col(c).cast("string").alias(c) for c in ("active_through", "federal_funds_flag", "first_file_date", "load_date")],
                    F.array_join("cycles", ",").alias("cycles"))


CYCLE_TEXTS = ["2000", "2000.0", "2000.7", " 1998 ", "next"]


@register("whole_cycles", f"""
WITH r AS (SELECT o_custkey, {by_remainder_sql('o_orderkey', CYCLE_TEXTS)} AS c FROM orders),
t AS (SELECT CAST(o_custkey AS VARCHAR) AS candidate_id, CASE WHEN c LIKE '2000%' AND c <> '2000.7' THEN '2000' WHEN c = ' 1998 ' THEN '1998' END AS cycle FROM r),
k AS (SELECT DISTINCT candidate_id, cycle FROM t WHERE cycle IS NOT NULL),
x AS (SELECT DISTINCT o_custkey, c FROM r WHERE c IN ('2000.7', 'next'))
SELECT 'inside' AS side, cycle, '' AS errors, CAST(COUNT(*) AS BIGINT) AS rows FROM k GROUP BY cycle
UNION ALL SELECT 'inside', NULL, 'cycle_type', COUNT(*) FROM r WHERE c IN ('2000.7', 'next')
UNION ALL SELECT 'outside', cycle, '', COUNT(*) FROM k GROUP BY cycle
UNION ALL SELECT 'outside', NULL, 'cycle_type', COUNT(*) FROM x""")
def whole_cycles(spark: SparkSession, sf_dir: str):
    """Both totals feeds with cycles as text: a cycle with a fraction, or none at all, rejects the record."""
    o = FX.table(spark, sf_dir, "orders")
    feed = o.select(F.col("o_custkey").cast("string").alias("candidate_id"), by_remainder(F.col("o_orderkey"), CYCLE_TEXTS).alias("cycle"),
                    F.lit("S").alias("support_oppose_indicator"), F.lit(1).cast("decimal(14,2)").alias("total"),
                    F.lit(1).cast("decimal(15,2)").alias("receipts"), F.lit(1).cast("decimal(15,2)").alias("disbursements"),
                    F.col("o_orderkey").alias(SEQ))
    out = None
    for side, t in (("inside", transform_inside(feed)), ("outside", transform_outside(feed))):
        for rows, errors in ((t.rows, F.lit("")), (t.quarantine, F.array_join(ERRORS, ","))):
            got = rows.groupBy(F.col("cycle").cast("string").alias("cycle"), errors.alias("errors")).agg(F.count(F.lit(1)).alias("rows"))
            got = got.select(F.lit(side).alias("side"), "cycle", "errors", "rows")
            out = got if out is None else out.unionByName(got)
    return out


# ---------------------------------------------------------------- absent and null lists
# The lists of a committee record as it is sent, by the remainder of its key.
SENT_LISTS = ["", ', "candidate_ids": null, "sponsor_candidate_ids": null', ', "cycles": null, "candidate_ids": ["P1 "]',
              ', "cycles": [2020, 2022], "candidate_ids": ["P1", " P2"], "sponsor_candidate_ids": []', ', "cycles": [2020, 2021.5]']
COMMITTEE_RECORD = T.StructType([T.StructField("committee_id", T.StringType()), T.StructField("name", T.StringType()),
                                 *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("candidate_ids", "sponsor_candidate_ids", "cycles")]])


@register("null_lists", f"""
SELECT 'C' || s_suppkey AS committee_id, CASE s_suppkey % {len(SENT_LISTS)} WHEN 2 THEN 'cycles_null' WHEN 4 THEN 'cycles_type' ELSE '' END AS errors,
  CASE s_suppkey % {len(SENT_LISTS)} WHEN 2 THEN 'P1' WHEN 3 THEN 'P1,P2' ELSE '' END AS candidate_ids, '' AS sponsor_candidate_ids,
  CASE s_suppkey % {len(SENT_LISTS)} WHEN 3 THEN '2020,2022' WHEN 4 THEN '2020' ELSE '' END AS cycles FROM supplier""")
def null_lists(spark: SparkSession, sf_dir: str):
    """Committee pages read strictly: an absent list is empty, a null one is too or rejects the record, by the field."""
    k = F.col("s_suppkey")
    record = F.concat(F.lit('{"committee_id": "C'), k.cast("string"), F.lit('", "name": "'), F.col("s_name"), F.lit('"'),
                      by_remainder(k, SENT_LISTS), F.lit("}"))
    suppliers = FX.table(spark, sf_dir, "supplier")
    pages = suppliers.agg(F.floor(F.max(k) / FX.PAGE_SIZE) + 1).scalar()
    page = suppliers.groupBy((F.floor(k / FX.PAGE_SIZE) + 1).alias("page")).agg(F.collect_list(record).alias("rows"))  # one page
    line = F.concat(F.lit('{"endpoint": "committees", "fetch": 1, "results": ['), F.array_join("rows", ", "),
                    F.lit('], "pagination": {"page": '), F.col("page").cast("string"), F.lit(', "pages": '), pages.cast("string"), F.lit("}}"))
    path = new_location(spark, "landing_committees")
    page.select(line.alias("value")).write.text(path)
    v = validate(read_pages(spark, path, COMMITTEE_RECORD, strict=True), COMMITTEES)
    return v.select("committee_id", F.array_join(ERRORS, ",").alias("errors"),
                    *[F.array_join(c, ",").alias(c) for c in ("candidate_ids", "sponsor_candidate_ids", "cycles")])


# ---------------------------------------------------------------- failed ids
@register("quality_failed_ids", with_views("""
SELECT 'candidates' AS entity, candidate_id AS failed_id, CAST(COUNT(*) AS BIGINT) AS rows, (SELECT COUNT(*) FROM candidates_checked) AS raw
FROM candidates_checked WHERE errors <> '' GROUP BY candidate_id
UNION ALL SELECT 'committees', committee_id, COUNT(*), (SELECT COUNT(*) FROM committees_checked) FROM committees_checked WHERE errors <> '' GROUP BY committee_id
""", "candidates_checked", "committees_checked"))
def quality_failed_ids(spark: SparkSession, sf_dir: str):
    """Which ids broke a rule, how often, and how many rows the feed had."""
    out = None
    for t in (transform_candidates(FX.candidates_raw(spark, sf_dir)), transform_committees(FX.committees_raw(spark, sf_dir))):
        failed = t.failed_ids().withColumn("raw", t.raw_count().select("raw").scalar())
        out = failed if out is None else out.unionByName(failed)
    return out


# ---------------------------------------------------------------- jobs
WINDOW = ("1995-01-01", "1996-12-31")


@register("ingest_window", with_views(
    "SELECT candidate_id, office, CAST(first_file_date AS VARCHAR) AS first_file_date FROM candidates "
    f"WHERE first_file_date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'", "candidates"))
def ingest_window(spark: SparkSession, sf_dir: str):
    """The single entry point: a window of filing dates, one entity, into an empty store."""
    store = _fresh_store(spark, "window")
    feed = tables.candidates(spark, sf_dir).withColumn(SEQ, F.col("candidate_id").cast("long"))
    result = jobs.ingest(store, {"candidates": feed}, FX.RUN_TS, *WINDOW, entities=["candidates"])
    if result.results["candidates"].error or result.refreshed:
        raise RuntimeError(str(result))
    return store.read("candidates").select("candidate_id", "office", F.col("first_file_date").cast("string").alias("first_file_date"))


CHANGED_CYCLE = 1996


@register("changed_cycle_refresh", with_views(f"""
SELECT candidate_id, cycle, CAST(COALESCE(receipts, 0) AS DOUBLE) AS inside_receipts, CAST(COALESCE(support, 0) AS DOUBLE) AS outside_support,
  CAST(COALESCE(oppose, 0) AS DOUBLE) AS outside_oppose FROM (
    SELECT candidate_id, cycle, receipts * CASE WHEN cycle = {CHANGED_CYCLE} THEN 2 ELSE 1 END AS receipts FROM inside_t WHERE {REGISTERED})
  FULL JOIN (SELECT candidate_id, cycle, SUM(CASE support_oppose_indicator WHEN 'S' THEN total ELSE 0 END) AS support,
    SUM(CASE support_oppose_indicator WHEN 'O' THEN total ELSE 0 END) AS oppose FROM outside_t WHERE {REGISTERED} GROUP BY candidate_id, cycle)
  USING (candidate_id, cycle)""", "candidates_last", "inside_t", "outside_t"))
def changed_cycle_refresh(spark: SparkSession, sf_dir: str):
    """All totals, then a second run that changes one cycle: only that cycle is read, merged and rebuilt."""
    store = _fresh_store(spark, "cycles")
    inside = FX.inside_raw(spark, sf_dir)
    feeds = {"candidates": FX.candidates_raw(spark, sf_dir).where("office IS NOT NULL"), "inside_totals_by_candidate": inside,
             "schedule_e_totals_by_candidate": FX.outside_raw(spark, sf_dir)}
    jobs.ingest_batch(store, feeds, FX.RUN_TS, list(feeds))
    before = {c: store.cycle_location(SUMMARY_TABLE, c) for c in store.cycles(SUMMARY_TABLE)}
    twice = inside.where(F.col("cycle") == CHANGED_CYCLE).withColumn("receipts", (F.col("receipts") * 2).cast("decimal(15,2)"))
    jobs.ingest_batch(store, {"inside_totals_by_candidate": twice}, FX.RUN_TS, ["inside_totals_by_candidate"])
    moved = [c for c, p in before.items() if store.cycle_location(SUMMARY_TABLE, c) != p]
    if moved != [CHANGED_CYCLE]:
        raise RuntimeError(f"cycles written anew: {moved}")
    return store.read(SUMMARY_TABLE).select("candidate_id", "cycle", *[F.col(c).cast("double").alias(c)
                                                                       for c in ("inside_receipts", "outside_support", "outside_oppose")])
