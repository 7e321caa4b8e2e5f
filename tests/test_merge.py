import datetime as dt
from decimal import Decimal as D

from fundflow.operators import merge as M
from fundflow.operators.specs import CANDIDATES, INSIDE_TOTALS

RUN = "2024-06-01 12:00:00"
OLD = dt.datetime(2020, 1, 1)
STORED = ("candidate_id string, cycle int, receipts decimal(15,2), disbursements decimal(15,2), "
          "created_at timestamp, updated_at timestamp")
INCOMING = "candidate_id string, cycle int, receipts decimal(15,2), disbursements decimal(15,2), _seq long"


def _stored(spark):
    return spark.createDataFrame([("A", 2024, D(1), D(1), OLD, OLD), ("B", 2024, D(2), D(2), OLD, OLD),
                                  ("C", 2024, D(3), D(3), OLD, OLD)], STORED)


def test_insert_update_unchanged_keep(spark):
    inc = spark.createDataFrame([("A", 2024, D(1), D(1), 1),       # unchanged
                                 ("B", 2024, D(2), None, 2),        # null overwrites
                                 ("N", 2024, D(9), D(9), 3)], INCOMING)  # insert
    r = M.merge(_stored(spark), inc, INSIDE_TOTALS, RUN)
    got = {x.candidate_id: x for x in r.frame.collect()}
    assert {k: v._action for k, v in got.items()} == {"A": "unchanged", "B": "update", "C": "keep", "N": "insert"}
    assert got["B"].disbursements is None
    assert got["B"].created_at == OLD and got["B"].updated_at == dt.datetime(2024, 6, 1, 12)
    assert got["A"].updated_at == OLD
    assert got["N"].created_at == got["N"].updated_at == dt.datetime(2024, 6, 1, 12)
    s = r.stats().first()
    assert (s.inserted, s.updated, s.unchanged, s.kept, s.errors) == (1, 1, 1, 1, 0)


def test_party_overwrite(spark):
    stored = spark.createDataFrame([("C1", "Tom", "DEM", OLD, OLD)],
                                   "candidate_id string, name string, party string, created_at timestamp, updated_at timestamp")
    inc = spark.createDataFrame([("C1", "Tom", "REP", 1)], "candidate_id string, name string, party string, _seq long")
    from pyspark.sql import functions as F
    pad = lambda df: df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in
                                      [(c, CANDIDATE_TYPES.get(c, "string")) for c in CANDIDATES.value_columns
                                       if c not in df.columns]])
    r = M.merge(pad(stored), pad(inc), CANDIDATES, RUN)
    row = r.frame.first()
    assert (row.party, row._action) == ("REP", "update")


CANDIDATE_TYPES = {"active_through": "int", "cycles": "array<int>", "election_years": "array<int>",
                   "federal_funds_flag": "boolean", "has_raised_funds": "boolean",
                   "first_file_date": "date", "last_f2_date": "date", "last_file_date": "date",
                   "load_date": "timestamp"}


def test_in_batch_duplicates_count_each_write(spark):
    empty = spark.createDataFrame([], STORED)
    inc = spark.createDataFrame([("K", 2024, D(1), D(1), 1), ("K", 2024, D(2), D(2), 2),
                                 ("K", 2024, D(3), D(3), 3)], INCOMING)
    w = M.write_counts(empty, inc, INSIDE_TOTALS).first()
    assert w.inserted + w.updated == 3 and w.inserted == 1
    r = M.merge(empty, inc, INSIDE_TOTALS, RUN).frame.first()
    assert r.receipts == D(3)


def test_in_batch_repeat_of_same_value_is_not_a_write(spark):
    inc = spark.createDataFrame([("A", 2024, D(1), D(1), 1), ("A", 2024, D(5), D(1), 2),
                                 ("A", 2024, D(5), D(1), 3)], INCOMING)
    w = M.write_counts(_stored(spark), inc, INSIDE_TOTALS).first()
    assert (w.inserted, w.updated) == (0, 1)


def test_versioned_merge_ignores_stale_rows(spark):
    stored = spark.createDataFrame([("A", 2024, D(7), D(7), 10, OLD, OLD)],
                                   "candidate_id string, cycle int, receipts decimal(15,2), "
                                   "disbursements decimal(15,2), _seq long, created_at timestamp, updated_at timestamp")
    inc = spark.createDataFrame([("A", 2024, D(1), D(1), 5)], INCOMING)
    r = M.merge(stored, inc, INSIDE_TOTALS, RUN, version="_seq").frame.first()
    assert (r.receipts, r._action, r._seq) == (D(7), "unchanged", 10)
    inc2 = spark.createDataFrame([("A", 2024, D(1), D(1), 11)], INCOMING)
    r2 = M.merge(stored, inc2, INSIDE_TOTALS, RUN, version="_seq").frame.first()
    assert (r2.receipts, r2._action, r2._seq) == (D(1), "update", 11)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_known_to_be_unique_are_not_looked_for_again(spark):
    from fundflow.plans.refresh import TableStore
    inc = spark.createDataFrame([("A", 2024, D(5), D(1), 1), ("D", 2024, D(4), D(4), 2)], INCOMING)
    once, again = M.merge(_stored(spark), inc, INSIDE_TOTALS, RUN, repeats=False), M.merge(_stored(spark), inc, INSIDE_TOTALS, RUN)
    assert "Aggregate" in _plan(again.frame) and "Aggregate" not in _plan(once.frame)
    assert sorted(once.frame.collect()) == sorted(again.frame.collect())
    empty = TableStore.empty_like(None, _stored(spark))  # of a table that isn't there yet: nothing to join or shuffle
    first = M.merge(empty, inc, INSIDE_TOTALS, RUN, repeats=False).frame
    assert "Join" not in _plan(first)
    assert sorted((r.candidate_id, r["_action"]) for r in first.collect()) == [("A", "insert"), ("D", "insert")]
