"""Hot-group operators must equal a plain per-group window, however the group is cut."""

import random

import pytest
from pyspark.sql import functions as F

from fundflow.operators.ordered import rank_within_group, run_summary


def _data(spark):
    rnd = random.Random(3)
    rows = []
    for seq in range(400):
        # one hot key with most rows, a few small ones
        key = "HOT" if rnd.random() < 0.7 else f"k{rnd.randint(0, 5)}"
        rows.append((key, seq * 3 + 1, rnd.choice([1, 1, 2, None])))
    return spark.createDataFrame(rows, "k string, seq long, v int")


@pytest.mark.parametrize("partitions", [1, 3, 8, 40])
def test_run_summary_matches_a_loop(spark, tmp_path, partitions):
    path = str(tmp_path / "rows")
    _data(spark).unionByName(spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("one", 3, None)], "k string, seq long, v int")) \
        .withColumn("at", F.struct((F.col("seq") / 7).cast("int").alias("a"), F.col("seq").alias("b"))).repartition(5).write.parquet(path)
    df = spark.read.parquet(path)
    want = {}
    for r in sorted(df.collect(), key=lambda r: r.seq):
        first, last, changes, n = want.get(r.k, (r.v, r.v, 0, 0))
        want[r.k] = (first, r.v, changes + (n > 0 and r.v != last), n + 1)
    for order in (F.col("seq"), F.col("at")):  # a number or a struct
        got = run_summary(df, ["k"], [order], F.col("v"), partitions)
        assert {r.k: (r["first"], r["last"], r.changes, r.n) for r in got.collect()} == want


@pytest.mark.parametrize("partitions", [2, 3, 4, 8, 50])
def test_rank_within_group_matches_row_number(spark, tmp_path, partitions):
    """More rows than range sampling sees, in several files, one group with most of them; three runs."""
    rnd = random.Random(7)
    rows = [("HOT" if rnd.random() < 0.6 else rnd.choice([None, "a", "b"]), i, rnd.randint(0, 500)) for i in range(20_000)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "g string, seq long, v int").repartition(6).write.parquet(path)
    df = spark.read.parquet(path)
    expected = {}
    for g in ("HOT", None, "a", "b"):
        group = sorted((-v, seq) for gg, seq, v in rows if gg == g)
        expected.update({seq: n + 1 for n, (_, seq) in enumerate(group)})
    for _ in range(3):
        got = rank_within_group(df, ["g"], [F.col("v").desc_nulls_last(), F.col("seq").asc()], partitions=partitions, name="r")
        assert {r.seq: r.r for r in got.collect()} == expected
