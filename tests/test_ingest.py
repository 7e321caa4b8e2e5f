from decimal import Decimal as D

from fundflow.operators.ingest import (
    transform_candidates, transform_committees, transform_inside, transform_outside,
)
from fundflow.operators.quality import fk_split

from conftest import rows


def test_validate_and_skip_keeps_good_rows(spark):
    raw = spark.createDataFrame([("C001", "Valid", 1), (None, "No ID", 2), ("C003", "Also Valid", 3)],
                                "candidate_id string, name string, _seq long")
    t = transform_candidates(raw)
    assert sorted(rows(t.rows, "candidate_id")) == [("C001",), ("C003",)]
    assert rows(t.quarantine, "_errors") == [(["candidate_id_required"],)]


def test_candidate_cleaning_rules(spark):
    raw = spark.createDataFrame(
        [("  C1 ", "OBAMA, BARACK", "h", "9", " IL ", 1),
         ("C2", "X", "z", None, None, 2),
         ("C3", "Y", None, "5", "ILL", 3)],
        "candidate_id string, name string, office string, district string, state string, _seq long")
    t = transform_candidates(raw)
    good = {r.candidate_id: r for r in t.rows.collect()}
    assert set(good) == {"C1"}
    assert (good["C1"].name, good["C1"].office, good["C1"].district, good["C1"].state) == \
        ("Barack Obama", "H", "09", "IL")
    bad = {r.candidate_id: r._errors for r in t.quarantine.collect()}
    assert bad == {"C2": ["office_domain"], "C3": ["state_length"]}
    assert good["C1"].cycles == [] and good["C1"].election_years == []


def test_last_wins_after_validation(spark):
    raw = spark.createDataFrame([("C1", "A", "DEM", 1), ("C1", "B", "REP", 2), ("C1 ", "", "GRN", 3)],
                                "candidate_id string, name string, party string, _seq long")
    t = transform_candidates(raw)
    assert rows(t.rows, "candidate_id", "party") == [("C1", "REP")]
    assert t.tally.first().duplicates == 1


def test_committee_rules(spark):
    raw = spark.createDataFrame(
        [("C1", "ACME", "q", " none ", None, None, 1),
         ("C2", "BETA", "Z9", "Parent PAC ", ["P1 "], None, 2)],
        "committee_id string, name string, committee_type string, affiliated_committee_name string, "
        "candidate_ids array<string>, sponsor_candidate_ids array<string>, _seq long")
    t = transform_committees(raw)
    r = t.rows.first()
    assert (r.committee_id, r.committee_type, r.affiliated_committee_name) == ("C1", "Q", None)
    assert r.candidate_ids == [] and r.sponsor_candidate_ids == [] and r.cycles == []
    assert rows(t.quarantine, "committee_id", "_errors") == [("C2", ["committee_type_domain"])]


def test_inside_accumulation(spark):
    raw = spark.createDataFrame(
        [("P1", 2024, D("100"), D("90"), 1), ("P1", 2024, D("50"), D("40"), 2),
         ("P2", 2024, None, None, 3), ("P2", 2024, D("50"), None, 4),
         ("", 2024, D("1"), D("1"), 5), ("P3", 0, D("1"), D("1"), 6)],
        "candidate_id string, cycle int, receipts decimal(15,2), disbursements decimal(15,2), _seq long")
    t = transform_inside(raw)
    got = {r.candidate_id: (r.receipts, r.disbursements) for r in t.rows.collect()}
    assert got == {"P1": (D("150.00"), D("130.00")), "P2": (D("50.00"), D("0.00"))}
    assert t.skipped.count() == 2


def test_inside_non_numeric_amount_is_quarantined(spark):
    raw = spark.createDataFrame([("P1", 2024, "12.5", "x", 1), ("P1", 2024, "1", "1", 2)],
                                "candidate_id string, cycle int, receipts string, disbursements string, _seq long")
    t = transform_inside(raw)
    assert rows(t.rows, "receipts", "disbursements") == [(D("1.00"), D("1.00"))]
    assert rows(t.quarantine, "_errors") == [(["disbursements_not_numeric"],)]


def test_inside_overflow_is_quarantined(spark):
    raw = spark.createDataFrame([("P1", 2024, D("9999999999999.00"), D("1"), 1),
                                 ("P1", 2024, D("9999999999999.00"), D("1"), 2)],
                                "candidate_id string, cycle int, receipts decimal(38,2), disbursements decimal(38,2), _seq long")
    t = transform_inside(raw)
    assert t.rows.count() == 0
    assert rows(t.quarantine, "_errors") == [(["receipts_overflow"],)]


def test_outside_first_wins_before_validation(spark):
    raw = spark.createDataFrame(
        [("C1", 2024, "X", D("1"), 1), ("C1", 2024, "X", D("2"), 2),   # invalid first hides later
         ("C2", 2024, "s", D("10"), 3), ("C2", 2024, "s", D("11"), 4),  # first wins
         ("C2", 2024, "S", D("12"), 5),                                   # different raw key
         ("C3", 2024, None, D("1"), 6)],                                  # skipped
        "candidate_id string, cycle int, support_oppose_indicator string, total decimal(14,2), _seq long")
    t = transform_outside(raw)
    assert sorted(rows(t.rows, "candidate_id", "support_oppose_indicator", "total")) == \
        [("C2", "S", D("12.00"))]                                            # of its raw keys the last
    assert rows(t.quarantine, "candidate_id", "_errors") == [("C1", ["indicator_domain"])]
    assert t.skipped.count() == 1
    assert t.tally.first().duplicates == 3


def test_fk_split(spark):
    child = spark.createDataFrame([("A", 1), ("B", 2), ("Z", 3)], "candidate_id string, v int")
    parent = spark.createDataFrame([("A",), ("B",), ("B",)], "candidate_id string")
    ok, bad = fk_split(child, parent)
    assert sorted(rows(ok, "candidate_id")) == [("A",), ("B",)]
    assert rows(bad, "candidate_id") == [("Z",)]


def test_typed_coercion_from_landed_strings(spark):
    """Records landed as JSON text: coercible values are typed, others reject the record."""
    raw = spark.createDataFrame(
        [("C1", "A", "2024", "true", "2020-01-31", [" 2020", "2022"], 1),
         ("C2", "B", "soon", None, None, None, 2),
         ("C3", "C", None, "maybe", "31/01/2020", ["x"], 3)],
        "candidate_id string, name string, active_through string, has_raised_funds string, "
        "first_file_date string, cycles array<string>, _seq long")
    t = transform_candidates(raw)
    good = t.rows.first()
    import datetime as dt
    assert (good.candidate_id, good.active_through, good.has_raised_funds, good.first_file_date, good.cycles) == \
        ("C1", 2024, True, dt.date(2020, 1, 31), [2020, 2022])
    bad = {r.candidate_id: sorted(r._errors) for r in t.quarantine.collect()}
    assert bad == {"C2": ["active_through_type"],
                   "C3": ["cycles_type", "first_file_date_type", "has_raised_funds_type"]}


def test_committee_lists_default_to_empty_and_strip(spark):
    raw = spark.createDataFrame([("C1", " ACME ", [" P1 ", "P2"], None, [2022], 1),
                                 ("C2", "   ", None, None, None, 2)],
                                "committee_id string, name string, candidate_ids array<string>, "
                                "sponsor_candidate_ids array<string>, cycles array<int>, _seq long")
    t = transform_committees(raw)
    r = t.rows.first()
    assert (r.name, r.candidate_ids, r.sponsor_candidate_ids, r.cycles) == ("ACME", ["P1", "P2"], [], [2022])
    assert rows(t.quarantine, "committee_id", "_errors") == [("C2", ["name_required"])]


def test_case_twins_of_a_key_are_not_summed(spark):
    raw = spark.createDataFrame([("C1", 2024, "s", D("10"), 1), ("C1", 2024, "S", D("12"), 2), ("C1", 2024, "s", D("99"), 3),
                                 ("C1", 2024, "x", D("1"), 4), (None, 2024, "S", D("1"), 5), ("", 2024, "S", D("1"), 6)],
                                "candidate_id string, cycle int, support_oppose_indicator string, total decimal(14,2), _seq long")
    t = transform_outside(raw)
    assert rows(t.rows, "candidate_id", "support_oppose_indicator", "total") == [("C1", "S", D("12.00"))]
    assert tuple(t.tally.first()) == (1, 1, 2, 2)  # kept, invalid, skipped, duplicates
    assert {r.metric: r["rows"] for r in t.report().collect()} == {"kept": 1, "invalid": 1, "skipped": 2, "duplicates": 2}


def test_tally_of_sums_and_of_an_empty_feed(spark):
    schema = "candidate_id string, cycle int, receipts string, disbursements string, _seq long"
    raw = spark.createDataFrame([("C1", 2024, "1", None, 1), ("C1", 2024, "2", "1", 2), (" ", 2024, "1", "1", 3),
                                 ("C2", 2024, "abc", "1", 4), ("C3", 0, "1", "1", 5), ("C4", 2024, "1e15", "1", 6)], schema)
    t = transform_inside(raw)
    assert tuple(t.tally.first()) == (1, 3, 1, 1)
    assert t.rows.count() == 1 and t.quarantine.count() == 3 and t.skipped.count() == 1
    assert tuple(transform_inside(raw.limit(0)).tally.first()) == (0, 0, 0, 0)


def test_whole_numbers_only(spark):
    from pyspark.sql import functions as F
    from fundflow.operators.quality import coerce_array, whole_number
    texts = ["2024", "2024.0", " 7 ", "2024.7", "1e3", "x", "", None, "99999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(whole_number(F.col("t"))).collect()] == [2024, 2024, 7, None, 1000, None, None, None, None]
    doubles = spark.createDataFrame([(2024.0,), (2024.7,), (None,)], "d double")
    assert [r[0] for r in doubles.select(whole_number(F.col("d"))).collect()] == [2024, None, None]
    lists = spark.createDataFrame([([2020.0, 2021.5],)], "l array<double>")
    assert lists.select(coerce_array(F.col("l"), "int")).first()[0] == [2020, None]


def test_key_fields_are_filtered_below_a_join(spark):
    from fundflow.operators.dedupe import key_present
    left = spark.createDataFrame([(1, "S", 2024), (2, None, 2024), (3, "", 2024), (4, "O", 0), (5, "O", None), (6, "S", 2024), (7, "S", 2024)],
                                 "k long, ind string, cycle int")
    right = spark.createDataFrame([(k, None if k == 6 else "" if k == 7 else f"C{k}") for k in range(1, 8)], "k long, id string")
    kept, skipped = key_present(left.join(right, "k"), ["id", "ind"], ["cycle"])
    assert rows(kept, "id") == [("C1",)]
    assert sorted(rows(skipped, "k")) == [(k,) for k in range(2, 8)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[:plan.index("Join")]


def test_a_tally_is_planned_when_it_is_asked_for(spark, monkeypatch):
    from fundflow.operators import ingest
    made = []
    tally = ingest._tally
    monkeypatch.setattr(ingest, "_tally", lambda per_key: made.append(1) or tally(per_key))
    raw = spark.createDataFrame([("C1", "DOE, JO", 1), ("C1", "DOE, JO", 2), ("C2", " ", 3)], "candidate_id string, name string, _seq long")
    t = ingest.transform_candidates(raw)
    assert t.rows.count() == 1 and made == []
    assert tuple(t.tally.first()) == (1, 1, 0, 1) and t.tally.count() == 1 and made == [1]
