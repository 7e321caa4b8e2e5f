import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fundflow.functions import (
    check_even_cycle, compact_dollars, date_window, full_dollars, none_sentinel, pad_district,
    person_name, ratio, title_case,
)
from fundflow.functions.labels import display_category, leaf_label, office_label

# names of our own, by the rule that each exercises
NAMES = [
    ("VANCE, CYRUS", "Cyrus Vance"),                     # last, first
    ("O'HARA, MAUREEN", "Maureen O'Hara"),               # letters after an apostrophe
    ("VAN DER BERG, PIET", "Piet Van Der Berg"),         # several words before the comma
    ("LOWELL, AMY, SR.", "Amy Lowell Sr"),               # suffix after a second comma, dot dropped
    ("TUDOR, HENRY VIII", "Henry Tudor VIII"),           # roman numeral stays upper case
    ("PLATO", "Plato"),                                  # no comma: title case only
    ("NYE, BILL X", "Bill Nye X"),
    ("NYE, BILL ii.", "Bill Nye II"),
    ("NYE, BILL ESQ.", "Bill Nye Esq"),
    ("KING-HELE, ANNE", "Anne King-Hele"),
    ("2ND", "2Nd"),
    ("BARD,", "Bard"),
    (", BARD", "Bard"),
    ("  KAHLO ,  FRIDA  ", "Frida Kahlo"),
    ("CURIE, MARIE MD, PHD", "Marie Curie MD PHD"),
    ("   ", ""),
    (",", ""),
]


def test_person_name_cases(spark):
    df = spark.createDataFrame([(a,) for a, _ in NAMES], "raw string")
    got = [r[0] for r in df.select(person_name("raw")).collect()]
    assert got == [b for _, b in NAMES]


def test_person_name_null(spark):
    df = spark.createDataFrame([(None,)], "raw string")
    assert df.select(person_name("raw")).first()[0] is None


def test_title_case_matches_python(spark):
    words = ["d'arcy", "KING-HELE", "2ND", "macBETH", "émile ZOLA", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(title_case("w")).collect()] == [w.title() for w in words]


def test_pad_district(spark):
    df = spark.createDataFrame([("9",), ("123",), ("AL",), ("",), (None,), ("07",)], "d string")
    assert [r[0] for r in df.select(pad_district("d")).collect()] == ["09", "123", "AL", "", None, "07"]


def test_none_sentinel(spark):
    df = spark.createDataFrame([("NONE",), (" none ",), ("Acme PAC ",), (None,)], "a string")
    assert [r[0] for r in df.select(none_sentinel("a")).collect()] == [None, None, "Acme PAC", None]


RATIOS = [  # inside, support, oppose -> influence, vulnerability
    ("80.00", "20.00", "60.00", "1.00", "0.75"),
    ("0.00", "7.00", "7.00", None, None),              # nothing to divide by
    ("700.00", "100.00", "0.00", "0.14", "0.00"),
    ("12.00", "0.00", "0.00", "0.00", "0.00"),
    ("40.00", "90.00", "50.00", "3.50", "1.25"),
    ("200.00", "0.01", "0.02", "0.00", "0.00"),
    ("16.00", "0.00", "2.00", "0.13", "0.13"),         # 0.125 rounds half up
    ("0.01", "4000000.00", "1000000.00", "500000000.00", "100000000.00"),  # wider than any table column
]


def test_ratio_anchor_cases(spark):
    df = spark.createDataFrame([tuple(Decimal(x) for x in r[:3]) for r in RATIOS],
                               "d decimal(15,2), s decimal(15,2), o decimal(15,2)")
    out = df.select(ratio(F.col("s") + F.col("o"), "d").alias("r"), ratio("o", "d").alias("v")).collect()
    got = [(None if r.r is None else str(r.r), None if r.v is None else str(r.v)) for r in out]
    assert got == [(r[3], r[4]) for r in RATIOS]


def test_compact_and_full_dollars(spark):
    vals = ["2500000000.00", "1250000.00", "999.50", "12499.99", "950.40", "0.00"]
    df = spark.createDataFrame([(Decimal(v),) for v in vals] + [(None,)], "v decimal(15,2)")
    got = df.select(compact_dollars("v").alias("c"), full_dollars("v").alias("f")).collect()
    assert [r.c for r in got] == ["$2.5B", "$1.3M", "$1000", "$12K", "$950", "$0", None]
    assert [r.f for r in got] == ["$2,500,000,000", "$1,250,000", "$1,000", "$12,500", "$950", "$0", "N/A"]


def test_labels(spark):
    df = spark.createDataFrame([("P", "DEM", "Inside"), ("S", "GRN", "Outside Support"),
                                ("X", None, "elsewhere"), (None, "REP", None)], "o string, p string, l string")
    got = df.select(office_label("o"), display_category("party", "p"), leaf_label("l"), display_category("leaf", "l")).collect()
    assert [tuple(r) for r in got] == [
        ("Presidential", "dem", "Direct Campaign Spending", "president"), ("Senate", "neutral", "Independent Support", "house"),
        (None, "neutral", "elsewhere", "neutral"), (None, "rep", None, "neutral")]


def test_default_date_window_uses_new_york_date(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 6, 15, 2, 0),)], "ts timestamp_ntz")
    lo, hi = date_window(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("ts"))
    r = df.select(lo.alias("lo"), hi.alias("hi")).first()
    assert (r.lo, r.hi) == (dt.date(2024, 6, 13), dt.date(2024, 6, 14))
    lo, hi = date_window(F.lit("2024-01-01"), F.lit("2024-02-01"), F.col("ts"))
    r = df.select(lo.alias("lo"), hi.alias("hi")).first()
    assert (r.lo, r.hi) == (dt.date(2024, 1, 1), dt.date(2024, 2, 1))


def test_even_cycle_rule():
    today = dt.date(2025, 3, 1)
    assert check_even_cycle(2024, today) == 2024
    for bad in (2023, 1978, 2026):
        with pytest.raises(ValueError):
            check_even_cycle(bad, today)


def test_cluster_conf_sizing():
    from fundflow.session import cluster_conf
    small, mid, huge = cluster_conf(1024 ** 3), cluster_conf(10 * 1024 ** 4), cluster_conf(100 * 1024 ** 4)
    assert small["spark.sql.shuffle.partitions"] == "200"          # floor
    assert mid["spark.sql.shuffle.partitions"] == str(10 * 1024 ** 4 // (256 * 1024 ** 2))
    assert huge["spark.sql.shuffle.partitions"] == str(100 * 4096)  # no cap; AQE coalesces from there
    assert huge["spark.sql.files.maxPartitionBytes"] == str(256 * 1024 ** 2)


def test_round_binary_is_what_a_response_shows(spark):
    import random
    from pyspark.sql import functions as F
    from fundflow.functions.money import response_ratio, round_binary
    rng = random.Random(9)
    ties = [n / 8 for n in range(1, 4000, 7)] + [2.675, 0.125, 0.375, 1.005, 1.115, 5e-324, 0.0, 0.004999999999999999, 0.005, 0.015, 1e300, 2.0 ** 52, 2.0 ** 51 + 0.5]
    xs = ties + [rng.uniform(0, 10) for _ in range(500)] + [rng.randint(0, 10 ** 9) / rng.randint(1, 10 ** 6) for _ in range(500)]
    xs += [(2 * rng.randint(0, 10 ** 12) + 1) / 200 for _ in range(500)] + [rng.uniform(0, 1e15) for _ in range(200)]
    xs += [-x for x in xs[:50]]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [(r.x, r.y) for r in df.select("x", round_binary("x").alias("y")).collect()] == [(x, round(x, 2)) for x in xs]
    amounts = [(1.0, 8.0), (5.0, 0.0), (None, 2.0), (3.0, None), (2.675, 1.0)]
    got = spark.createDataFrame(amounts, "n double, d double").select(response_ratio("n", "d").alias("r")).collect()
    assert [r.r for r in got] == [0.12, None, None, None, 2.67]
    assert spark.createDataFrame([(None,)], "x double").select(round_binary(F.col("x"))).first()[0] is None


def test_totals_are_asked_for_by_default(spark):
    from fundflow.sources.predicates import totals_filter
    rows = [("a", 2024, "P", False), ("b", 2024, "P", True), ("c", 2022, "S", False), ("d", 2024, "X", False), ("e", 2024, "H", None)]
    df = spark.createDataFrame(rows, "id string, cycle int, office string, election_full boolean")
    assert [r.id for r in totals_filter(df).collect()] == ["a"]
    assert [r.id for r in totals_filter(df, 2022).collect()] == ["c"]
    assert sorted(r.id for r in totals_filter(df.drop("election_full")).collect()) == ["a", "b", "e"]
    assert [r.id for r in totals_filter(df, election_full=True).collect()] == ["b"]
