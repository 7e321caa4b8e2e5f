"""Sources, sinks, jobs and the stream: each callable writes under the shared folder
(``spark.checkpoint.dir``), reads its own output back, and returns it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundflow.catalog import register
from fundflow.functions.dates import date_window
from fundflow.oracle.bindings import ELECTION_OUT, with_views
from fundflow.plans import jobs, tables
from fundflow.plans.refresh import ELECTION_TABLE, SUMMARY_TABLE, TableStore, key_report, refresh_spending
from fundflow.session import new_location
from fundflow.sources import fixtures as FX
from fundflow.sources.paged_json import land, page_coverage, page_envelopes, read_pages
from fundflow.sources.predicates import first_file_range, source_filter
from fundflow.streaming.micro_batch import batch_files, run_incremental

EVENT_RECORD = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
EVENT_COLS = [f.name for f in EVENT_RECORD.fields]
# the coverage audit's feed comes from a source that fails part of the way: 0-based page
# numbers 3, 10, 17, ... never arrive
DROPPED = "(page - 1) % 7 = 3"


def _land_events(spark: SparkSession, sf_dir: str, dropped: str = "false") -> str:
    path = new_location(spark, "landing_events")
    events = FX.table(spark, sf_dir, "events").select(*EVENT_COLS)
    pages = page_envelopes(events, "events", FX.PAGE_SIZE, "event_id")
    land(pages.where(f"NOT ({dropped.replace('page', 'pagination.page')})"), path)
    return path


@register("paged_source", f"""
SELECT event_id, user_id, event_type, value, props, CAST(n // {FX.PAGE_SIZE} + 1 AS INTEGER) AS page,
  CAST(n % {FX.PAGE_SIZE} AS INTEGER) AS pos
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS n FROM events)""")
def paged_source(spark: SparkSession, sf_dir: str):
    return read_pages(spark, _land_events(spark, sf_dir), EVENT_RECORD).select(*EVENT_COLS, "page", "pos")


@register("page_coverage", f"""
SELECT 'events' AS endpoint, CAST(page AS INTEGER) AS page FROM (
  SELECT unnest(generate_series(1, CAST(CEIL(COUNT(*) / {FX.PAGE_SIZE}.0) AS BIGINT))) AS page FROM events)
WHERE {DROPPED}""")
def page_coverage_q(spark: SparkSession, sf_dir: str):
    return page_coverage(spark, _land_events(spark, sf_dir, DROPPED), EVENT_RECORD)


# ---------------------------------------------------------------- predicates and date window
@register("source_predicates", with_views(
    "SELECT candidate_id, name, office, state, CAST(first_file_date AS VARCHAR) AS first_file_date "
    "FROM candidates WHERE office IN ('P', 'S', 'H') AND list_contains(cycles, 2000) "
    "AND first_file_date BETWEEN DATE '1995-01-01' AND DATE '1995-03-31'", "candidates"))
def source_predicates(spark: SparkSession, sf_dir: str):
    df = source_filter(tables.candidates(spark, sf_dir), offices=("P", "S", "H"), cycle=2000)
    df = first_file_range(df, "1995-01-01", "1995-03-31")
    return df.select("candidate_id", "name", "office", "state",
                     F.col("first_file_date").cast("string").alias("first_file_date"))


@register("date_window", """
SELECT event_id,
  CAST(COALESCE(CASE WHEN event_type = 'click' THEN DATE '2024-01-01' END,
       CAST(timezone('America/New_York', ts AT TIME ZONE 'UTC') AS DATE) - 1) AS VARCHAR) AS window_start,
  CAST(CAST(timezone('America/New_York', ts AT TIME ZONE 'UTC') AS DATE) AS VARCHAR) AS window_end
FROM events""")
def date_window_q(spark: SparkSession, sf_dir: str):
    ev = FX.table(spark, sf_dir, "events")
    start = F.when(F.col("event_type") == "click", F.lit("2024-01-01"))
    lo, hi = date_window(start, F.lit(None).cast("string"), F.col("ts"))
    return ev.select("event_id", lo.cast("string").alias("window_start"), hi.cast("string").alias("window_end"))


# ---------------------------------------------------------------- refresh chain
def _fresh_store(spark: SparkSession, tag: str) -> TableStore:
    """An empty store per call: a new folder and a new catalog database, so calling a
    query twice in one session gives the same result."""
    return TableStore(spark, root=new_location(spark, f"tables_{tag}"), db=f"ff_{tag}_{uuid.uuid4().hex[:12]}")


@register("refresh_chain", with_views(f"SELECT {ELECTION_OUT} FROM election", "election"))
def refresh_chain(spark: SparkSession, sf_dir: str):
    store = _fresh_store(spark, "refresh")
    refresh_spending(store, tables.inside_totals(spark, sf_dir), tables.outside_totals(spark, sf_dir))
    return tables.as_output(store.read(ELECTION_TABLE))


@register("unique_key_check", with_views(
    "SELECT 'mv_candidate_spending_summary' AS table_name, CAST(COUNT(*) AS BIGINT) AS rows, "
    "CAST(COUNT(DISTINCT (candidate_id, cycle)) AS BIGINT) AS distinct_keys, CAST(0 AS BIGINT) AS duplicate_keys "
    "FROM summary UNION ALL SELECT 'mv_election_spending_summary', CAST(COUNT(*) AS BIGINT), "
    "CAST(COUNT(DISTINCT cycle) AS BIGINT), CAST(0 AS BIGINT) FROM election", "summary", "election"))
def unique_key_check(spark: SparkSession, sf_dir: str):
    store = _fresh_store(spark, "unique")
    refresh_spending(store, tables.inside_totals(spark, sf_dir), tables.outside_totals(spark, sf_dir))
    return (key_report(store.read(SUMMARY_TABLE), ["candidate_id", "cycle"], SUMMARY_TABLE)
            .unionByName(key_report(store.read(ELECTION_TABLE), ["cycle"], ELECTION_TABLE)))


# ---------------------------------------------------------------- batch pipeline
# The candidate feed carries registered offices only, so the totals of all others name an
# unknown candidate and must end up in quarantine.
def _feeds(spark: SparkSession, sf_dir: str) -> dict:
    return {"committees": FX.committees_raw(spark, sf_dir),
            "candidates": FX.candidates_raw(spark, sf_dir).where("office IS NOT NULL"),
            "inside_totals_by_candidate": FX.inside_raw(spark, sf_dir),
            "schedule_e_totals_by_candidate": FX.outside_raw(spark, sf_dir)}


REGISTERED = "candidate_id IN (SELECT candidate_id FROM candidates_last WHERE office IS NOT NULL)"
BATCH_VIEWS = ("committees_checked", "candidates_last", "candidates_checked", "inside_t", "outside_t", "outside_writes")


def _batch(spark: SparkSession, sf_dir: str) -> tuple[TableStore, jobs.BatchResult]:
    """All four entities in dependency order into an empty store, then the refresh."""
    store = _fresh_store(spark, "batch")
    result = jobs.ingest_batch(store, _feeds(spark, sf_dir), FX.RUN_TS)
    failed = {e: r.error for e, r in result.results.items() if r.error}
    if failed or not result.refreshed:
        raise RuntimeError(f"failed: {failed}; refreshed: {result.refreshed}")
    return store, result


@register("pipeline_batch", with_views(f"""
SELECT 'committees' AS entity, CAST(COUNT(*) FILTER (WHERE errors = '') AS BIGINT) AS table_rows,
  CAST(COUNT(*) FILTER (WHERE errors = '') AS BIGINT) AS inserted, CAST(0 AS BIGINT) AS updated,
  CAST(COUNT(*) FILTER (WHERE errors <> '') AS BIGINT) AS errors FROM committees_checked
UNION ALL SELECT 'candidates', (SELECT COUNT(*) FROM candidates_last WHERE office IS NOT NULL),
  (SELECT COUNT(*) FROM candidates_last WHERE office IS NOT NULL), 0,
  CAST(COUNT(*) FILTER (WHERE errors <> '') AS BIGINT) FROM candidates_checked WHERE office IS NOT NULL
UNION ALL SELECT 'inside_totals_by_candidate', COUNT(*) FILTER (WHERE {REGISTERED}), COUNT(*) FILTER (WHERE {REGISTERED}), 0,
  COUNT(*) FILTER (WHERE NOT {REGISTERED}) FROM inside_t
UNION ALL SELECT 'schedule_e_totals_by_candidate', (SELECT COUNT(*) FROM outside_t WHERE {REGISTERED}), COUNT(*) FILTER (WHERE {REGISTERED} AND n = 1),
  COUNT(*) FILTER (WHERE {REGISTERED} AND n > 1 AND total <> before), COUNT(*) FILTER (WHERE NOT {REGISTERED}) FROM outside_writes
UNION ALL SELECT 'mv_candidate_spending_summary', COUNT(*), 0, 0, 0 FROM (
  SELECT candidate_id, cycle FROM inside_t WHERE {REGISTERED} UNION SELECT candidate_id, cycle FROM outside_t WHERE {REGISTERED})
UNION ALL SELECT 'mv_election_spending_summary', COUNT(DISTINCT cycle), 0, 0, 0 FROM (
  SELECT cycle FROM inside_t WHERE {REGISTERED} UNION SELECT cycle FROM outside_t WHERE {REGISTERED})""", *BATCH_VIEWS))
def pipeline_batch(spark: SparkSession, sf_dir: str):
    store, result = _batch(spark, sf_dir)
    rows = [(e, r.stats["inserted"], r.stats["updated"], r.stats["errors"]) for e, r in result.results.items()]
    stats = spark.createDataFrame(rows, "entity string, inserted bigint, updated bigint, errors bigint")
    counts = None
    for name in list(result.results) + [SUMMARY_TABLE, ELECTION_TABLE]:
        c = store.read(name).agg(F.count(F.lit(1)).cast("bigint").alias("table_rows")) \
                 .select(F.lit(name).alias("entity"), "table_rows")
        counts = c if counts is None else counts.unionByName(c)
    zero = F.lit(0).cast("bigint")
    return counts.join(stats, "entity", "left").select(
        "entity", "table_rows", *[F.coalesce(F.col(c), zero).alias(c) for c in ("inserted", "updated", "errors")])


@register("pipeline_stored_totals", with_views(f"""
SELECT 'inside' AS side, candidate_id, cycle, '' AS indicator, CAST(receipts AS DOUBLE) AS amount,
  CAST(disbursements AS DOUBLE) AS disbursements FROM inside_t WHERE {REGISTERED}
UNION ALL SELECT 'outside', candidate_id, cycle, support_oppose_indicator, CAST(total AS DOUBLE), NULL
FROM outside_t WHERE {REGISTERED}""", *BATCH_VIEWS))
def pipeline_stored_totals(spark: SparkSession, sf_dir: str):
    """What the batch stored in the two totals tables, row by row."""
    store, _ = _batch(spark, sf_dir)
    inside = store.read("inside_totals_by_candidate").select(
        F.lit("inside").alias("side"), "candidate_id", "cycle", F.lit("").alias("indicator"), F.col("receipts").alias("amount"), "disbursements")
    outside = store.read("schedule_e_totals_by_candidate").select(
        F.lit("outside").alias("side"), "candidate_id", "cycle", F.col("support_oppose_indicator").alias("indicator"),
        F.col("total").alias("amount"), F.lit(None).cast("decimal(15,2)").alias("disbursements"))
    return tables.as_output(inside.select(*[F.col(c).cast("decimal(38,2)").alias(c) if c in ("amount", "disbursements") else c for c in inside.columns])
                            .unionByName(outside.select(*[F.col(c).cast("decimal(38,2)").alias(c) if c in ("amount", "disbursements") else c
                                                          for c in outside.columns])))


@register("pipeline_quarantine", with_views(f"""
SELECT entity, failed_id, rules, CAST(COUNT(*) AS BIGINT) AS rows FROM (
  SELECT 'committees' AS entity, committee_id AS failed_id, errors AS rules FROM committees_checked WHERE errors <> ''
  UNION ALL SELECT 'candidates', candidate_id, errors FROM candidates_checked WHERE errors <> '' AND office IS NOT NULL
  UNION ALL SELECT 'inside_totals_by_candidate', candidate_id, 'unknown_parent' FROM inside_t WHERE NOT {REGISTERED}
  UNION ALL SELECT 'schedule_e_totals_by_candidate', candidate_id, 'unknown_parent' FROM outside_writes WHERE NOT {REGISTERED})
GROUP BY entity, failed_id, rules""", *BATCH_VIEWS))
def pipeline_quarantine(spark: SparkSession, sf_dir: str):
    """The quarantine log of the batch: failed ids by entity and rules."""
    _, result = _batch(spark, sf_dir)
    logs = [r.quarantine for r in result.results.values() if r.quarantine is not None]
    log = logs[0]
    for more in logs[1:]:
        log = log.unionByName(more)
    return (log.groupBy("entity", "failed_id", F.array_join("errors", ",").alias("rules"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("rows")))


# ---------------------------------------------------------------- incremental stream
CANDIDATE_RECORD = T.StructType([
    T.StructField("order_key", T.LongType()),
    T.StructField("candidate_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("office", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("party", T.StringType()),
    T.StructField("last_file_date", T.StringType()),
])
#: Least pages of a landed file and files of a micro-batch, and most files that a fetch lands in.
PAGES_PER_FILE, FILES_PER_BATCH, MOST_FILES = 16, 16, 1024
STREAM_OUT = ["candidate_id", "name", "office", "state", "party", "district", "last_file_date"]


def _candidate_pages(raw: DataFrame, fetch: int) -> tuple[DataFrame, int]:
    """A feed as the pages of one fetch, and the files they are landed in."""
    feed = raw.withColumnRenamed("_seq", "order_key").select(*[f.name for f in CANDIDATE_RECORD.fields])
    pages = page_envelopes(feed, "candidates", FX.STREAM_PAGE_SIZE, "order_key", fetch=fetch)
    return pages, min(MOST_FILES, max(1, -(-feed.count() // (FX.STREAM_PAGE_SIZE * PAGES_PER_FILE))))


def _drain(spark: SparkSession, store: TableStore, landing: str, checkpoint: str, files: int):
    """Drain the ``files`` that have landed since the last time."""
    return run_incremental(spark, store, landing, CANDIDATE_RECORD, "candidates", FX.RUN_TS, batch_files(files, FILES_PER_BATCH), checkpoint)


def _stream(spark: SparkSession) -> tuple[str, str, TableStore]:
    return new_location(spark, "landing_candidates"), new_location(spark, "stream_checkpoint"), _fresh_store(spark, "stream")


def _stored(store: TableStore) -> DataFrame:
    return store.read("candidates").select(*[F.col(c).cast("string").alias(c) for c in STREAM_OUT])


def _streamed(spark: SparkSession, feeds: list) -> DataFrame:
    """Land the feeds as one fetch each and drain them in micro-batches of a few files."""
    landing, checkpoint, store = _stream(spark)
    for number, raw in enumerate(feeds, 1):
        pages, files = _candidate_pages(raw, number)
        land(pages, landing, files=files, mode="append")
        _drain(spark, store, landing, checkpoint, files)
    return _stored(store)


@register("incremental_stream", with_views(
    "SELECT candidate_id, name, office, state, party, district, last_file_date FROM candidates_last",
    "candidates_last"))
def incremental_stream(spark: SparkSession, sf_dir: str):
    """Candidate pages landed in several files, drained a few files per micro-batch."""
    return _streamed(spark, [FX.candidates_raw(spark, sf_dir)])


@register("incremental_refetch", with_views(
    "SELECT candidate_id, name, office, state, party, district, last_file_date FROM (SELECT *, ROW_NUMBER() OVER ("
    f"PARTITION BY candidate_id ORDER BY (last_file_date >= '{FX.MERGE_INCOMING_FROM}') DESC, seq DESC) AS r "
    "FROM candidates_checked WHERE errors = '') WHERE r = 1", "candidates_checked"))
def incremental_refetch(spark: SparkSession, sf_dir: str):
    """Two fetches, the second with the newer snapshots: its pages start at 1 again and still win."""
    raw, newer = FX.candidates_raw(spark, sf_dir), F.col("last_file_date") >= FX.MERGE_INCOMING_FROM
    return _streamed(spark, [raw.filter(~newer), raw.filter(newer)])


@register("late_first_page", with_views(
    "SELECT candidate_id, name, office, state, party, district, last_file_date FROM (SELECT *, ROW_NUMBER() OVER ("
    "PARTITION BY candidate_id ORDER BY seq DESC) AS r "
    f"FROM candidates_checked WHERE errors = '' AND last_file_date < '{FX.MERGE_INCOMING_FROM}') WHERE r = 1", "candidates_checked"))
def late_first_page(spark: SparkSession, sf_dir: str):
    """Two fetches whose page 1 lands after all other pages. The second one's is empty, so nothing of it counts."""
    raw, newer = FX.candidates_raw(spark, sf_dir), F.col("last_file_date") >= FX.MERGE_INCOMING_FROM
    landing, checkpoint, store = _stream(spark)
    fetches = [_candidate_pages(raw.filter(~newer), 1), _candidate_pages(raw.filter(newer), 2)]
    for pages, files in fetches:
        land(pages.where("pagination.page > 1"), landing, files=files, mode="append")
    _drain(spark, store, landing, checkpoint, sum(files for _, files in fetches))
    land(fetches[0][0].where("pagination.page = 1"), landing, files=1, mode="append")
    empty = fetches[1][0].where("pagination.page = 1")
    land(empty.withColumn("results", F.filter("results", lambda r: F.lit(False))), landing, files=1, mode="append")
    _drain(spark, store, landing, checkpoint, 2)
    return _stored(store)
