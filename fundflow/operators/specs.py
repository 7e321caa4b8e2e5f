"""The four landed entities: cleaning expressions, rules, keys and table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow.functions.money import MONEY, OUTSIDE_MONEY
from fundflow.functions.text import none_sentinel, pad_district, person_name, strip_ws
from fundflow.operators.quality import (
    EntitySpec, bad_array, bad_coercion, blank, coerce, coerce_array, null_list, outside, raw, raw_int, too_long,
)

# Closed code domains.
OFFICE_CODES = ["H", "S", "P"]
INDICATOR_CODES = ["S", "O"]
COMMITTEE_TYPE_CODES = ["C", "D", "E", "H", "I", "N", "O", "P", "Q", "S", "U", "V", "W", "X", "Y", "Z"]

AUDIT_COLUMNS = ("created_at", "updated_at")


def _s(df: DataFrame, name: str) -> Column:
    """A raw text field, stripped."""
    return strip_ws(raw(df, name).cast("string"))


def _str_list(df: DataFrame, name: str) -> Column:
    arr = raw(df, name, "array<string>").cast("array<string>")
    return F.coalesce(F.transform(arr, lambda x: strip_ws(x)), F.array().cast("array<string>"))


# ---------------------------------------------------------------- candidates
# Table columns.
CANDIDATE_COLUMNS = (
    "candidate_id", "name", "office", "state", "party", "party_full", "district",
    "incumbent_challenge", "incumbent_challenge_full", "candidate_status", "active_through",
    "cycles", "election_years", "federal_funds_flag", "has_raised_funds",
    "first_file_date", "last_f2_date", "last_file_date", "load_date",
)
_CAND_DATES = ("first_file_date", "last_f2_date", "last_file_date")


def _candidate_clean(df: DataFrame) -> dict[str, Column]:
    out = {
        "candidate_id": _s(df, "candidate_id"),
        "name": person_name(raw(df, "name").cast("string")),
        "office": F.upper(raw(df, "office").cast("string")),
        "district": pad_district(_s(df, "district")),
        "active_through": raw_int(df, "active_through"),
        "cycles": F.coalesce(coerce_array(raw(df, "cycles", "array<int>"), "int"),
                             F.array().cast("array<int>")),
        "election_years": F.coalesce(coerce_array(raw(df, "election_years", "array<int>"), "int"),
                                     F.array().cast("array<int>")),
        "federal_funds_flag": coerce(raw(df, "federal_funds_flag"), "boolean"),
        "has_raised_funds": coerce(raw(df, "has_raised_funds"), "boolean"),
        "load_date": coerce(raw(df, "load_date"), "timestamp"),
    }
    for c in ("state", "party", "party_full", "incumbent_challenge",
              "incumbent_challenge_full", "candidate_status"):
        out[c] = _s(df, c)
    for c in _CAND_DATES:
        out[c] = coerce(raw(df, c), "date")
    return out


def _candidate_rules(r, c: dict[str, Column]) -> list[tuple[str, Column]]:
    rules = [
        ("candidate_id_required", blank(c["candidate_id"])),
        ("name_required", blank(c["name"])),
        ("office_domain", outside(c["office"], OFFICE_CODES)),
        ("state_length", too_long(c["state"], 2)),
        ("district_length", too_long(c["district"], 2)),
        ("incumbent_challenge_length", too_long(c["incumbent_challenge"], 1)),
        ("candidate_status_length", too_long(c["candidate_status"], 1)),
        ("active_through_type", bad_coercion(r("active_through"), c["active_through"])),
        ("cycles_type", bad_array(r("cycles", "array<int>"), c["cycles"])),
        ("election_years_type", bad_array(r("election_years", "array<int>"), c["election_years"])),
        ("cycles_null", null_list(r, "cycles")),
        ("election_years_null", null_list(r, "election_years")),
        ("federal_funds_flag_type", bad_coercion(r("federal_funds_flag"), c["federal_funds_flag"])),
        ("has_raised_funds_type", bad_coercion(r("has_raised_funds"), c["has_raised_funds"])),
        ("load_date_type", bad_coercion(r("load_date"), c["load_date"])),
    ]
    rules += [(f"{d}_type", bad_coercion(r(d), c[d])) for d in _CAND_DATES]
    return rules


CANDIDATES = EntitySpec("candidates", ("candidate_id",), CANDIDATE_COLUMNS,
                        _candidate_clean, _candidate_rules)

# ---------------------------------------------------------------- committees
# Table columns.
COMMITTEE_COLUMNS = (
    "committee_id", "name", "committee_type", "committee_type_full", "affiliated_committee_name",
    "candidate_ids", "sponsor_candidate_ids", "cycles", "designation", "designation_full",
    "filing_frequency", "first_f1_date", "first_file_date", "last_f1_date", "last_file_date",
    "organization_type", "organization_type_full", "party", "party_full", "state", "treasurer_name",
)
_COMM_DATES = ("first_f1_date", "first_file_date", "last_f1_date", "last_file_date")
_COMM_TEXT = ("committee_id", "name", "committee_type_full", "designation", "designation_full",
              "filing_frequency", "organization_type", "organization_type_full", "party",
              "party_full", "state", "treasurer_name")


def _committee_clean(df: DataFrame) -> dict[str, Column]:
    out = {c: _s(df, c) for c in _COMM_TEXT}
    out["committee_type"] = F.upper(raw(df, "committee_type").cast("string"))
    out["affiliated_committee_name"] = none_sentinel(raw(df, "affiliated_committee_name").cast("string"))
    out["candidate_ids"] = _str_list(df, "candidate_ids")
    out["sponsor_candidate_ids"] = _str_list(df, "sponsor_candidate_ids")
    out["cycles"] = F.coalesce(coerce_array(raw(df, "cycles", "array<int>"), "int"),
                               F.array().cast("array<int>"))
    for d in _COMM_DATES:
        out[d] = coerce(raw(df, d), "date")
    return out


def _committee_rules(r, c: dict[str, Column]) -> list[tuple[str, Column]]:
    rules = [
        ("committee_id_required", blank(c["committee_id"])),
        ("name_required", blank(c["name"])),
        ("committee_type_domain", outside(c["committee_type"], COMMITTEE_TYPE_CODES)),
        ("designation_length", too_long(c["designation"], 1)),
        ("filing_frequency_length", too_long(c["filing_frequency"], 1)),
        ("organization_type_length", too_long(c["organization_type"], 1)),
        ("state_length", too_long(c["state"], 2)),
        ("cycles_type", bad_array(r("cycles", "array<int>"), c["cycles"])),
        ("cycles_null", null_list(r, "cycles")),
    ]
    rules += [(f"{d}_type", bad_coercion(r(d), c[d])) for d in _COMM_DATES]
    return rules


COMMITTEES = EntitySpec("committees", ("committee_id",), COMMITTEE_COLUMNS,
                        _committee_clean, _committee_rules)

# ---------------------------------------------------------------- inside totals
# Table columns.
INSIDE_COLUMNS = ("candidate_id", "cycle", "receipts", "disbursements")


def _inside_clean(df: DataFrame) -> dict[str, Column]:
    return {
        "candidate_id": _s(df, "candidate_id"),
        "cycle": raw_int(df, "cycle"),
        "receipts": coerce(raw(df, "receipts"), MONEY),
        "disbursements": coerce(raw(df, "disbursements"), MONEY),
    }


def _inside_rules(r, c: dict[str, Column]) -> list[tuple[str, Column]]:
    return [
        ("candidate_id_required", blank(c["candidate_id"])),
        ("cycle_type", bad_coercion(r("cycle"), c["cycle"])),
        ("cycle_required", r("cycle").isNull()),
        ("receipts_overflow", bad_coercion(r("receipts"), c["receipts"])),
        ("disbursements_overflow", bad_coercion(r("disbursements"), c["disbursements"])),
    ]


INSIDE_TOTALS = EntitySpec("inside_totals_by_candidate", ("candidate_id", "cycle"),
                           INSIDE_COLUMNS, _inside_clean, _inside_rules, parent="candidates")

# ---------------------------------------------------------------- outside totals
# Table columns.
OUTSIDE_COLUMNS = ("candidate_id", "cycle", "support_oppose_indicator", "total")


def _outside_clean(df: DataFrame) -> dict[str, Column]:
    return {
        "candidate_id": _s(df, "candidate_id"),
        "cycle": raw_int(df, "cycle"),
        "support_oppose_indicator": F.upper(raw(df, "support_oppose_indicator").cast("string")),
        "total": coerce(raw(df, "total"), OUTSIDE_MONEY),
    }


def _outside_rules(r, c: dict[str, Column]) -> list[tuple[str, Column]]:
    ind = c["support_oppose_indicator"]
    return [
        ("candidate_id_required", blank(c["candidate_id"])),
        ("cycle_type", bad_coercion(r("cycle"), c["cycle"])),
        ("cycle_required", r("cycle").isNull()),
        ("indicator_domain", ind.isNull() | ~ind.isin(INDICATOR_CODES)),
        ("total_overflow", bad_coercion(r("total"), c["total"])),
    ]


OUTSIDE_TOTALS = EntitySpec("schedule_e_totals_by_candidate",
                            ("candidate_id", "cycle", "support_oppose_indicator"),
                            OUTSIDE_COLUMNS, _outside_clean, _outside_rules, parent="candidates")

ENTITIES = {s.name: s for s in (COMMITTEES, CANDIDATES, INSIDE_TOTALS, OUTSIDE_TOTALS)}
# Dependency order of a batch: committees, candidates, then the two totals tables.
ENTITY_ORDER = ["committees", "candidates", "inside_totals_by_candidate",
                "schedule_e_totals_by_candidate"]
# Entities of one level do not reference each other; a level starts when the previous
# one (the tables its rows refer to) is done.
ENTITY_LEVELS = [["committees", "candidates"],
                 ["inside_totals_by_candidate", "schedule_e_totals_by_candidate"]]
