"""Read-side queries (lists, lookups, history, elections, hierarchy) with oracles."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.catalog import register
from fundflow.functions.money import compact_dollars
from fundflow.oracle.bindings import (
    CANDIDATE_INFO_OUT, ELECTION_OUT, SUMMARY_OUT, compact_sql, dollars_sql, with_views,
)
from fundflow.plans import marts, queries as Q, tables
from fundflow.sources.fixtures import RUN_TS

INFO_FIELDS = ("name", "state", "office", "district", "party", "incumbent_challenge")
HIERARCHY_CYCLE = 2000
HIERARCHY_THRESHOLD = 100_000
TODAY = _dt.date.fromisoformat(RUN_TS[:10])


def flatten_candidate(df: DataFrame) -> DataFrame:
    """Struct -> flat columns for comparison (candidate_<field>)."""
    return df.select(*[c for c in df.columns if c != "candidate"],
                     *[F.col("candidate")[f].alias(f"candidate_{f}") for f in INFO_FIELDS])


def candidate_out(df: DataFrame) -> DataFrame:
    """Arrays and dates as text so both engines print them the same way."""
    return df.select(*[F.array_join(F.col(c), ",").alias(c) if c in ("cycles", "election_years")
                       else F.col(c).cast("string").alias(c) if c.endswith("_date") else F.col(c)
                       for c in df.columns])


CAND_OUT_SQL = ("candidate_id, name, office, state, party, party_full, district, incumbent_challenge, "
                "incumbent_challenge_full, candidate_status, active_through, array_to_string(cycles, ',') AS cycles, "
                "array_to_string(election_years, ',') AS election_years, federal_funds_flag, has_raised_funds, "
                "CAST(first_file_date AS VARCHAR) AS first_file_date")


# ---------------------------------------------------------------- key spine
@register("all_pairs", with_views(
    "SELECT candidate_id, cycle FROM inside_t UNION SELECT candidate_id, cycle FROM outside_t",
    "inside_t", "outside_t"))
def all_pairs(spark: SparkSession, sf_dir: str):
    return marts.all_pairs(tables.inside_totals(spark, sf_dir), tables.outside_totals(spark, sf_dir))


@register("node_labels", with_views(
    "SELECT candidate_id, CASE office WHEN 'P' THEN 'Presidential' WHEN 'S' THEN 'Senate' "
    "WHEN 'H' THEN 'House' END AS race, "
    "CASE office WHEN 'H' THEN 'house' WHEN 'S' THEN 'senate' WHEN 'P' THEN 'president' ELSE 'neutral' END "
    "AS office_group, CASE WHEN party IN ('DEM', 'DFL') THEN 'dem' WHEN party = 'REP' THEN 'rep' "
    "ELSE 'neutral' END AS party_group FROM candidates", "candidates"))
def node_labels(spark: SparkSession, sf_dir: str):
    from fundflow.functions.labels import display_category, office_label
    c = tables.candidates(spark, sf_dir)
    race = office_label("office")
    return c.select("candidate_id", race.alias("race"), display_category("race", race).alias("office_group"),
                    display_category("party", "party").alias("party_group"))


# ---------------------------------------------------------------- candidates
@register("candidate_list_by_state_office", with_views(
    f"SELECT {CAND_OUT_SQL} FROM candidates WHERE state = '07' AND office = 'H' "
    "ORDER BY last_file_date DESC NULLS FIRST, candidate_id LIMIT 50 OFFSET 5", "candidates"))
def candidate_list_by_state_office(spark: SparkSession, sf_dir: str):
    page = Q.candidate_list(tables.candidates(spark, sf_dir), state="07", office="H",
                            sort_by="last_file_date", order="desc", limit=50, offset=5)
    return candidate_out(page.rows)


@register("candidate_list_by_cycle", with_views(
    f"SELECT {CAND_OUT_SQL} FROM candidates WHERE list_contains(cycles, 1998) "
    "ORDER BY name ASC NULLS LAST, candidate_id LIMIT 1000 OFFSET 100", "candidates"))
def candidate_list_by_cycle(spark: SparkSession, sf_dir: str):
    page = Q.candidate_list(tables.candidates(spark, sf_dir), cycle=1998, sort_by="name",
                            order="asc", limit=1000, offset=100)
    return candidate_out(page.rows)


@register("candidate_list_by_state", with_views(
    f"SELECT {CAND_OUT_SQL} FROM candidates ORDER BY state DESC NULLS FIRST, candidate_id LIMIT 200", "candidates"))
def candidate_list_by_state(spark: SparkSession, sf_dir: str):
    return candidate_out(Q.candidate_list(tables.candidates(spark, sf_dir), sort_by="state", order="desc", limit=200).rows)


@register("candidate_list_by_first_file_date", with_views(
    f"SELECT {CAND_OUT_SQL} FROM candidates WHERE office = 'S' ORDER BY candidates.first_file_date ASC NULLS LAST, candidate_id "
    "LIMIT 200 OFFSET 20", "candidates"))
def candidate_list_by_first_file_date(spark: SparkSession, sf_dir: str):
    return candidate_out(Q.candidate_list(tables.candidates(spark, sf_dir), office="S", sort_by="first_file_date", limit=200, offset=20).rows)


@register("candidate_list_count", with_views(
    "SELECT CAST(COUNT(*) AS BIGINT) AS total_count FROM candidates "
    "WHERE list_contains(cycles, 1998) AND office = 'S'", "candidates"))
def candidate_list_count(spark: SparkSession, sf_dir: str):
    return Q.candidate_list(tables.candidates(spark, sf_dir), office="S", cycle=1998).total


@register("candidate_by_id", with_views(
    f"SELECT {CAND_OUT_SQL} FROM candidates WHERE candidate_id = '7'", "candidates"))
def candidate_by_id(spark: SparkSession, sf_dir: str):
    return candidate_out(Q.candidate_by_id(tables.candidates(spark, sf_dir), "7"))


# ---------------------------------------------------------------- history
@register("candidate_spending_history", with_views(
    f"SELECT {SUMMARY_OUT}, {CANDIDATE_INFO_OUT} FROM summary_c WHERE candidate_id = '7'", "summary_c"))
def candidate_spending_history(spark: SparkSession, sf_dir: str):
    return flatten_candidate(tables.as_output(
        Q.spending_history(tables.summary(spark, sf_dir, candidate_ids=["7"]), tables.candidates(spark, sf_dir), "7")))


PROBES = ["7", "42", "no-such-candidate"]


@register("candidate_history_gate", with_views(
    "SELECT p.candidate_id, CASE WHEN k.candidate_id IS NULL THEN 'not_found' "
    "WHEN COALESCE(h.n, 0) = 0 THEN 'found_empty' ELSE 'found' END AS status, "
    "CAST(COALESCE(h.n, 0) AS BIGINT) AS history_rows "
    "FROM (VALUES " + ", ".join(f"('{p}')" for p in PROBES) + ") p(candidate_id) "
    "LEFT JOIN (SELECT DISTINCT candidate_id FROM candidates) k ON p.candidate_id = k.candidate_id "
    "LEFT JOIN (SELECT candidate_id, COUNT(*) AS n FROM summary GROUP BY candidate_id) h "
    "ON p.candidate_id = h.candidate_id", "candidates", "summary"))
def candidate_history_gate(spark: SparkSession, sf_dir: str):
    probes = spark.createDataFrame([(p,) for p in PROBES], "candidate_id string")
    return Q.history_gate(tables.candidates(spark, sf_dir), tables.summary(spark, sf_dir, candidate_ids=probes), probes)


# ---------------------------------------------------------------- spending pages (8 sort keys)
PAGES = {
    # sort key: (cycle filter, order, limit, offset)
    "cycle": (None, "asc", 100, 0),
    "inside_receipts": (2000, "desc", 100, 0),
    "inside_disbursements": (2000, "asc", 100, 0),
    "outside_support": (1998, "desc", 100, 50),
    "outside_oppose": (1998, "asc", 100, 0),
    "outside_total": (2000, "desc", 100, 0),
    "influence_ratio": (2000, "desc", 100, 200),
    "vulnerability_factor": (1996, "asc", 1000, 0),
}


def _page_sql(key: str, cycle, order: str, limit: int, offset: int) -> str:
    expr = "(outside_support + outside_oppose)" if key == "outside_total" else key
    nulls = "NULLS FIRST" if order == "desc" else "NULLS LAST"
    where = f"WHERE cycle = {cycle}" if cycle is not None else ""
    return with_views(f"SELECT {SUMMARY_OUT}, {CANDIDATE_INFO_OUT} FROM summary_c {where} "
                      f"ORDER BY {expr} {order.upper()} {nulls}, candidate_id, cycle "
                      f"LIMIT {limit} OFFSET {offset}", "summary_c")


def _page_query(key: str):
    cycle, order, limit, offset = PAGES[key]

    def run(spark: SparkSession, sf_dir: str):
        page = Q.spending_list(tables.summary(spark, sf_dir, cycle), tables.candidates(spark, sf_dir),
                               cycle=cycle, sort_by=key, order=order, limit=limit, offset=offset)
        return flatten_candidate(tables.as_output(page.rows))
    return run


for _k, (_c, _o, _l, _off) in PAGES.items():
    register(f"spending_page_by_{_k}", _page_sql(_k, _c, _o, _l, _off))(_page_query(_k))


@register("spending_page_count", with_views(
    "SELECT CAST(COUNT(*) AS BIGINT) AS total_count FROM summary WHERE cycle = 2000", "summary"))
def spending_page_count(spark: SparkSession, sf_dir: str):
    return Q.spending_count(tables.summary(spark, sf_dir, 2000), cycle=2000)


@register("top_outside_spenders", with_views(
    f"SELECT {SUMMARY_OUT} FROM summary WHERE cycle = 2000 "
    "ORDER BY (outside_support + outside_oppose) DESC NULLS FIRST, candidate_id, cycle LIMIT 500", "summary"))
def top_outside_spenders(spark: SparkSession, sf_dir: str):
    return tables.as_output(Q.top_outside_spenders(tables.summary(spark, sf_dir, 2000), 2000, 500))


# ---------------------------------------------------------------- elections
@register("election_list", with_views(f"SELECT {ELECTION_OUT} FROM election ORDER BY cycle DESC", "election"))
def election_list(spark: SparkSession, sf_dir: str):
    return tables.as_output(Q.election_list(tables.election(spark, sf_dir)))


@register("election_by_cycle", with_views(f"SELECT {ELECTION_OUT} FROM election WHERE cycle = 1998", "election"))
def election_by_cycle(spark: SparkSession, sf_dir: str):
    return tables.as_output(Q.election_by_cycle(tables.election(spark, sf_dir, 1998), 1998, TODAY))


EVEN_TODAY = _dt.date(1999, 6, 30)


@register("even_cycles", with_views(
    f"SELECT {ELECTION_OUT} FROM election WHERE cycle % 2 = 0 AND cycle BETWEEN 1980 AND 1998", "election"))
def even_cycles(spark: SparkSession, sf_dir: str):
    return tables.as_output(Q.even_cycles(tables.election(spark, sf_dir), EVEN_TODAY))


@register("cycle_headline", with_views(
    f"SELECT cycle, {dollars_sql('total_inside_disbursements')} AS inside_disbursements_text, "
    f"{dollars_sql('COALESCE(total_outside_support, 0) + COALESCE(total_outside_oppose, 0)')} "
    "AS outside_total_text FROM election", "election"))
def cycle_headline(spark: SparkSession, sf_dir: str):
    return marts.cycle_headline(tables.election(spark, sf_dir))


@register("compact_dollars", with_views(
    f"SELECT candidate_id, cycle, {compact_sql('outside_support + outside_oppose')} AS outside_text, "
    f"{compact_sql('inside_receipts')} AS receipts_text FROM summary", "summary"))
def compact_dollars_q(spark: SparkSession, sf_dir: str):
    s = tables.summary(spark, sf_dir)
    return s.select("candidate_id", "cycle",
                    compact_dollars(F.col("outside_support") + F.col("outside_oppose")).alias("outside_text"),
                    compact_dollars("inside_receipts").alias("receipts_text"))
