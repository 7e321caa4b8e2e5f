import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from fundflow.plans import marts, queries as Q

CAND = "candidate_id string, name string, office string, state string, cycles array<int>, first_file_date date"


def cands(spark):
    some = spark.createDataFrame([
        ("C1", "Ann", "H", "CA", [2020, 2022], dt.date(2019, 1, 1)),
        ("C2", "Bob", "S", "CA", [2022, 2024], None),
        ("C3", "Cid", "H", "NY", [2024], dt.date(2023, 1, 1)),
        ("C4", "Dee", "H", "CA", None, dt.date(2021, 1, 1)),
    ], CAND)
    return some.withColumns({c: F.lit(None).cast("string") for c in Q.CANDIDATE_OUT if c not in some.columns})


def ids(df):
    return [r.candidate_id for r in df.collect()]


def test_cycle_containment(spark):
    page = Q.candidate_list(cands(spark), cycle=2022, sort_by="name", order="asc")
    assert ids(page.rows) == ["C1", "C2"]
    assert page.total.first().total_count == 2


def test_falsy_filters_add_nothing(spark):
    page = Q.candidate_list(cands(spark), state="", office=None, cycle=0)
    assert page.total.first().total_count == 4


def test_state_upper_and_office(spark):
    assert ids(Q.candidate_list(cands(spark), state="ca", office="H", sort_by="name").rows) == ["C1", "C4"]


def test_desc_puts_nulls_first_asc_last(spark):
    desc = Q.candidate_list(cands(spark), sort_by="first_file_date", order="desc")
    assert ids(desc.rows) == ["C2", "C3", "C4", "C1"]
    asc = Q.candidate_list(cands(spark), sort_by="first_file_date", order="asc")
    assert ids(asc.rows) == ["C1", "C4", "C3", "C2"]


def test_limit_offset_and_domains(spark):
    assert ids(Q.candidate_list(cands(spark), sort_by="name", limit=2, offset=1).rows) == ["C2", "C3"]
    for kw in ({"limit": 0}, {"limit": 1001}, {"offset": -1}, {"sort_by": "party"}, {"order": "up"}):
        with pytest.raises(ValueError):
            Q.candidate_list(cands(spark), **kw)
    with pytest.raises(ValueError):
        Q.candidate_list(cands(spark), state="CAL")


SUMMARY = ("candidate_id string, cycle int, inside_receipts decimal(15,2), inside_disbursements decimal(15,2), "
           "outside_support decimal(15,2), outside_oppose decimal(15,2), influence_ratio decimal(10,2), "
           "vulnerability_factor decimal(10,2)")


def summary(spark):
    z = D(0)
    return spark.createDataFrame([
        ("C1", 2024, z, z, D(5000), D(1000), None, None),
        ("C2", 2024, z, z, D(2000), D(500), None, None),
        ("C3", 2024, z, z, D(10000), D(1000), None, None),
        ("C1", 2022, z, z, D(1), z, None, None),
    ], SUMMARY)


def test_outside_total_order_and_attach(spark):
    page = Q.spending_list(summary(spark), cands(spark), cycle=2024)
    got = page.rows.collect()
    assert [r.candidate_id for r in got] == ["C3", "C1", "C2"]
    assert got[0].candidate.name == "Cid" and got[0].candidate.office == "H"
    assert page.total.first().total_count == 3


def test_missing_candidate_gives_null_struct(spark):
    s = spark.createDataFrame([("ZZ", 2024, D(0), D(0), D(1), D(0), None, None)], SUMMARY)
    assert Q.spending_list(s, cands(spark)).rows.first().candidate is None


def test_history_and_gate(spark):
    h = Q.spending_history(summary(spark), cands(spark), "C1").collect()
    assert [r.cycle for r in h] == [2024, 2022]
    probes = spark.createDataFrame([("C1",), ("C4",), ("nope",)], "candidate_id string")
    g = {r.candidate_id: (r.status, r.history_rows) for r in Q.history_gate(cands(spark), summary(spark), probes).collect()}
    assert g == {"C1": ("found", 2), "C4": ("found_empty", 0), "nope": ("not_found", 0)}


def test_election_by_cycle_validates(spark):
    e = spark.createDataFrame([(2024, 1)], "cycle int, candidate_count int")
    assert Q.election_by_cycle(e, 2024, dt.date(2025, 1, 1)).count() == 1
    with pytest.raises(ValueError):
        Q.election_by_cycle(e, 2023, dt.date(2025, 1, 1))


def test_a_response_has_every_column_or_fails(spark):
    assert tuple(Q.candidate_list(cands(spark)).rows.columns) == Q.CANDIDATE_OUT == tuple(Q.candidate_by_id(cands(spark), "C1").columns)
    with pytest.raises(Exception, match="party"):
        Q.candidate_list(cands(spark).drop("party"))
    with pytest.raises(ValueError, match="party"):
        Q.spending_list(summary(spark), cands(spark).drop("party"))


def test_pages_are_bounded(spark):
    with pytest.raises(ValueError):
        Q.spending_list(summary(spark), cands(spark), offset=-1)
    with pytest.raises(ValueError):
        Q.top_outside_spenders(summary(spark), 2024, 1001)
    with pytest.raises(ValueError):
        Q.held(spark.range(30), most=20)


def test_filters_reach_both_sides_of_the_summary_join(spark):
    inside = spark.createDataFrame([("C1", 2024, D(1), D(1))], "candidate_id string, cycle int, receipts decimal(15,2), disbursements decimal(15,2)")
    outside = spark.createDataFrame([("C1", 2024, "S", D(1))], "candidate_id string, cycle int, support_oppose_indicator string, total decimal(14,2)")
    sides = [marts.only(t, cycle=2024, candidate_ids=["C1"]) for t in (inside, outside)]
    plan = marts.candidate_spending_summary(*sides)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join FullOuter")
    assert "Filter" not in above and below.count("Aggregate") == below.count("Filter") == 2
    assert below.count("cycle#") >= 2 and below.count("= 2024") == 2
    page = Q.spending_list(summary(spark), cands(spark), cycle=2024).rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in page and " IN (" in page  # the page is computed once, its candidates are looked up


def test_deep_pages_come_from_slices(spark, monkeypatch):
    import random
    from pyspark.sql import functions as F
    from fundflow.plans import queries as Q
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 3])) for i in range(5000)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(7)
    by = [Q.sort_key(F.col("v"), "desc"), F.col("id").asc()]
    want = [i for i, v in sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))]
    index = Q.page_index(df, by, slice_rows=300)
    for offset in (0, 1, 299, 300, 2222, 4990, 4999, 5000, 1_000_001):
        assert [r.id for r in index.page(700, offset).collect()] == want[offset:offset + 700]
    deep = index.page(10, 4000)
    first = deep._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__slice" in first  # the slices that don't overlap the page are not read
    read = index.stored.where(F.col(Q.SLICE).between(0, 0))
    assert read.count() == index.ends[0] and max(b - a for a, b in zip(index.ends, index.ends[1:])) < 1500
    monkeypatch.setattr(Q, "DEEP", 1000)
    page = Q.paginate(df, by, 100, 3000)
    assert [r.id for r in page.rows.collect()] == want[3000:3100] and page.total.first()[0] == 5000
    assert Q.paginate(df.limit(0), by, 100, 10 ** 9).rows.collect() == []
