from decimal import Decimal as D

from pyspark.sql import functions as F

from fundflow.plans import marts

INSIDE = "candidate_id string, cycle int, receipts decimal(15,2), disbursements decimal(15,2)"
OUTSIDE = "candidate_id string, cycle int, support_oppose_indicator string, total decimal(14,2)"


def _summary(spark, inside, outside):
    return marts.candidate_spending_summary(spark.createDataFrame(inside, INSIDE),
                                            spark.createDataFrame(outside, OUTSIDE))


def test_cycle_totals_anchor(spark):
    s = _summary(spark,
                 [("C1", 2024, D("100000"), D("80000")), ("C2", 2024, D("50000"), D("40000"))],
                 [("C1", 2024, "S", D("20000")), ("C1", 2024, "O", D("4000")),
                  ("C2", 2024, "S", D("10000")), ("C2", 2024, "O", D("6000"))])
    e = marts.election_spending_summary(s).first()
    assert e.candidate_count == 2
    assert (e.total_inside_receipts, e.total_inside_disbursements) == (D("150000.00"), D("120000.00"))
    assert (e.total_outside_support, e.total_outside_oppose) == (D("30000.00"), D("10000.00"))
    assert e.global_influence_ratio == D("0.33")


def test_zero_denominator_gives_null_ratio(spark):
    s = _summary(spark, [("C1", 2024, D("10"), D("0"))],
                 [("C1", 2024, "S", D("500")), ("C1", 2024, "O", D("100"))])
    assert s.first().influence_ratio is None
    assert marts.election_spending_summary(s).first().global_influence_ratio is None


def test_one_sided_keys_and_coalesce(spark):
    s = _summary(spark, [("A", 2020, D("5"), None)], [("B", 2022, "S", D("7")), ("B", 2022, "S", None)])
    got = {(r.candidate_id, r.cycle): r for r in s.collect()}
    assert got[("A", 2020)].outside_support == D("0.00") and got[("A", 2020)].inside_disbursements == D("0.00")
    assert got[("B", 2022)].outside_support == D("7.00") and got[("B", 2022)].inside_receipts == D("0.00")
    assert got[("A", 2020)].influence_ratio is None


def test_spine_and_full_outer_forms_agree(spark):
    import random
    rnd = random.Random(7)
    inside = [(f"C{rnd.randint(0, 30)}", rnd.choice([2020, 2022]), D(rnd.randint(0, 999)),
               rnd.choice([None, D(0), D(rnd.randint(1, 99))])) for _ in range(80)]
    outside = [(f"C{rnd.randint(0, 30)}", rnd.choice([2020, 2022, 2024]), rnd.choice(["S", "O"]),
                rnd.choice([None, D(rnd.randint(1, 500))])) for _ in range(80)]
    i, o = spark.createDataFrame(inside, INSIDE), spark.createDataFrame(outside, OUTSIDE)
    a = sorted(map(tuple, marts.candidate_spending_summary(i, o).collect()))
    b = sorted(map(tuple, marts.candidate_spending_summary_spine(i, o).collect()))
    assert a == b


def test_summary_plan_has_two_exchanges_without_broadcast(spark):
    """Each side aggregates on (candidate_id, cycle); the full outer join reuses that
    partitioning, so the whole plan shuffles exactly twice."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        i = spark.createDataFrame([("C1", 2024, D(1), D(1))], INSIDE)
        o = spark.createDataFrame([("C1", 2024, "S", D(1))], OUTSIDE)
        plan = marts.candidate_spending_summary(i, o)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2, plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_filters_and_columns_reach_the_parquet_scan(spark):
    import os
    from fundflow.sources import fixtures as FX
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    df = FX.merge_stored(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line or "Scan parquet" in line]
    assert scan, plan
    assert "LessThan(o_orderdate" in plan                # the date predicate is pushed to the reader
    assert "o_orderpriority" not in plan                # unused columns are not read


def test_totals_beyond_the_column_width(spark):
    """A cycle total of 2e13 and a ratio of 5e8 are results, not errors."""
    top = D("9999999999999.99")
    s = _summary(spark, [("C1", 2024, top, D("0.01")), ("C2", 2024, top, top), ("C3", 2024, top, None)], [("C1", 2024, "S", D("5000000"))])
    e = marts.election_spending_summary(s).first()
    assert e.total_inside_receipts == 3 * top
    one = next(r for r in s.collect() if r.candidate_id == "C1")
    assert one.influence_ratio == D("500000000.00") and one.vulnerability_factor == D("0.00")
