"""Per-entity transform: raw feed -> (clean keyed rows, quarantine, quality report).

The order of steps differs by entity, as in the source system:

* candidates, committees: validate, then last-wins by the stripped id;
* inside totals: drop rows without id/cycle, sum amounts per key, then validate
  (amounts that are not numbers are quarantined before the sum);
* schedule E totals: drop rows without id/cycle/indicator, first-wins by the *raw*
  key (an invalid first row hides later valid ones), then validate; of the rows of a clean key
  (raw keys that differ in case) the store applies each in order, so the last one stays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fundflow.functions.text import strip_ws
from fundflow.operators import dedupe
from fundflow.operators.quality import ERRORS, SEQ, EntitySpec, bad_coercion, count_invalid, observed, raw_int, split, validate
from fundflow.functions.money import MONEY as INSIDE_TOTALS_MONEY
from fundflow.operators.specs import CANDIDATES, COMMITTEES, ENTITIES, INSIDE_TOTALS, OUTSIDE_TOTALS


@dataclass
class Transformed:
    entity: str
    rows: DataFrame          # clean rows, one per key, table columns (+ _seq)
    quarantine: DataFrame    # rows that broke a rule, with _errors
    skipped: DataFrame       # rows dropped for a missing key
    count: Callable[[], DataFrame]  # makes ``tally``
    checks: tuple = ()       # Observations with an "invalid" count, filled when ``rows`` runs
    all_writes: DataFrame | None = None  # what the store applies in order, if keys repeat in it

    @cached_property
    def tally(self) -> DataFrame:
        """One row: kept, invalid, skipped, duplicates, from one pass over the feed. Planned when it is asked for:
        an ingest run (each micro-batch is one) has no use for it."""
        return _tally(self.count())

    @property
    def repeats(self) -> bool:
        return self.all_writes is not None

    @property
    def writes(self) -> DataFrame:
        """Clean rows as they are written: ``rows``, or several of a key in arrival order."""
        return self.all_writes if self.repeats else self.rows

    def invalid_count(self) -> int:
        """Quarantined rows, read from metrics observed while ``rows`` was computed.

        Call only after an action that ran ``rows``; every quarantined row passes one
        of the observed rule checkpoints on its way out of the plan of ``rows``.
        """
        return sum(observed(o, "invalid") for o in self.checks)

    def failed_ids(self) -> DataFrame:
        """(entity, failed_id, rows): the ids of the rows that broke a rule."""
        key = ENTITIES[self.entity].key[0]
        return (self.quarantine.groupBy(F.col(key).cast("string").alias("failed_id")).agg(F.count(F.lit(1)).alias("rows"))
                .select(F.lit(self.entity).alias("entity"), "failed_id", "rows"))

    def raw_count(self) -> DataFrame:
        """(entity, raw): rows that the feed delivered."""
        return self.tally.select(F.lit(self.entity).alias("entity"), sum((F.col(m) for m in METRICS), F.lit(0)).cast("bigint").alias("raw"))

    def report(self) -> DataFrame:
        """(entity, metric, rows): the tally, one row for each metric."""
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("rows")) for m in METRICS])
        return self.tally.select(F.lit(self.entity).alias("entity"), F.explode(pairs).alias("m")).select("entity", "m.*")


METRICS = ("kept", "invalid", "skipped", "duplicates")


def _tally(per_key: DataFrame) -> DataFrame:
    """Sum a table of keys with ``rows`` (raw), ``invalid`` and ``skipped`` rows and whether one is ``kept``."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sums = per_key.agg(total(F.col("kept").cast("int")).alias("kept"), total("invalid").alias("invalid"),
                       total("skipped").alias("skipped"), total("rows").alias("rows"))
    return sums.select("kept", "invalid", "skipped",
                       (F.col("rows") - F.col("kept") - F.col("invalid") - F.col("skipped")).alias("duplicates"))


def _none(df: DataFrame) -> DataFrame:
    """An empty frame with ``df``'s columns (a step that has nothing to report)."""
    return df.sparkSession.createDataFrame([], df.schema)


def transform_keyed_last_wins(spec: EntitySpec, raw_df: DataFrame) -> Transformed:
    seen = Observation(f"validate_{spec.name}_{uuid.uuid4().hex[:12]}")
    checked = validate(raw_df, spec, observation=seen)
    good, bad = split(checked)
    ok = F.size(ERRORS) == 0

    def per_key() -> DataFrame:
        return (validate(raw_df, spec).groupBy(*spec.key)
                .agg(F.count(F.lit(1)).alias("rows"), F.count_if(~ok).alias("invalid"), (F.count_if(ok) > 0).alias("kept"))
                .withColumn("skipped", F.lit(0)))

    return Transformed(spec.name, dedupe.last_wins(good, list(spec.key)), bad, _none(raw_df), per_key, (seen,))


def transform_candidates(raw_df: DataFrame) -> Transformed:
    return transform_keyed_last_wins(CANDIDATES, raw_df)


def transform_committees(raw_df: DataFrame) -> Transformed:
    return transform_keyed_last_wins(COMMITTEES, raw_df)


def _rule_names(rules) -> Column:
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())


def transform_inside(raw_df: DataFrame) -> Transformed:
    """Accumulate every raw row of a (candidate, cycle): null amounts count as 0.

    Key rules hold for a whole group, so they are checked per raw row *before*
    the sum, and only the amount width after it. The sum's output keeps the hash
    partitioning on (candidate_id, cycle), so later aggregates and joins on that
    key (the spending summary) add no exchange. In the tally, rows that are summed
    into a key count as duplicates of the one row that is kept.
    """
    amounts, key = ["receipts", "disbursements"], ["candidate_id", "cycle"]

    def typed(df: DataFrame, *more: Column) -> DataFrame:
        cast = df.select(
            F.col(SEQ), *more,
            strip_ws(F.col("candidate_id").cast("string")).alias("candidate_id"),
            raw_int(df, "cycle").alias("cycle"), F.col("cycle").alias("__raw_cycle"),
            *[F.col(a).alias(f"__raw_{a}") for a in amounts],
            *[F.col(a).try_cast("decimal(38,2)").alias(a) for a in amounts])
        rules = [("candidate_id_required", F.col("candidate_id").isNull() | (F.col("candidate_id") == "")),
                 ("cycle_type", bad_coercion(F.col("__raw_cycle"), F.col("cycle"))),
                 ("cycle_required", F.col("__raw_cycle").isNull())]
        rules += [(f"{a}_not_numeric", F.col(f"__raw_{a}").isNotNull() & F.col(a).isNull()) for a in amounts]
        return cast.withColumn(ERRORS, _rule_names(rules))

    too_wide = [(f"{a}_overflow", F.col(a).try_cast(INSIDE_TOTALS_MONEY).isNull()) for a in amounts]
    sums = [F.sum(F.coalesce(F.col(a), F.lit(0))).alias(a) for a in amounts]

    kept, skipped = dedupe.key_present(raw_df, ["candidate_id"], ["cycle"])
    row_check = Observation(f"inside_rows_{uuid.uuid4().hex[:12]}")
    good_rows, bad_rows = split(count_invalid(typed(kept), row_check))
    summed = good_rows.groupBy(*key).agg(F.min(SEQ).alias(SEQ), *sums)
    checked = summed.select(SEQ, *key, *[F.col(a).try_cast(INSIDE_TOTALS_MONEY).alias(a) for a in amounts],
                            _rule_names(too_wide).alias(ERRORS))
    sum_check = Observation(f"inside_sums_{uuid.uuid4().hex[:12]}")
    good, bad = split(count_invalid(checked, sum_check))
    bad_rows = bad_rows.select(SEQ, *key, *[F.col(a).try_cast(INSIDE_TOTALS_MONEY).alias(a) for a in amounts], ERRORS)

    def per_key() -> DataFrame:
        missing = dedupe.key_missing(["candidate_id"], ["cycle"])
        flags = typed(raw_df, missing.alias("__skip")).withColumn("__ok", ~F.col("__skip") & (F.size(ERRORS) == 0))
        return (flags.groupBy(*key)
                .agg(F.count(F.lit(1)).alias("rows"), F.count_if("__skip").alias("skipped"),
                     F.count_if(~F.col("__skip") & ~F.col("__ok")).alias("bad_rows"), F.count_if("__ok").alias("ok_rows"),
                     *[F.sum(F.when(F.col("__ok"), F.coalesce(F.col(a), F.lit(0)))).alias(a) for a in amounts])
                .withColumn("fits", F.size(_rule_names(too_wide)) == 0)
                .select("rows", "skipped", (F.col("fits") & (F.col("ok_rows") > 0)).alias("kept"),
                        (F.col("bad_rows") + (~F.col("fits") & (F.col("ok_rows") > 0)).cast("int")).alias("invalid")))

    return Transformed(INSIDE_TOTALS.name, good, bad.unionByName(bad_rows), skipped, per_key, (row_check, sum_check))


def transform_outside(raw_df: DataFrame) -> Transformed:
    """First row of each raw (candidate, cycle, indicator) wins, then validation, then the
    last row of each clean key: raw keys that differ only in case are one stored key."""
    raw_key = ["candidate_id", "cycle", "support_oppose_indicator"]
    kept, skipped = dedupe.key_present(raw_df, ["candidate_id", "support_oppose_indicator"], ["cycle"])
    seen = Observation(f"validate_outside_{uuid.uuid4().hex[:12]}")
    good, bad = split(validate(dedupe.first_wins(kept, raw_key), OUTSIDE_TOTALS, observation=seen))
    rows = dedupe.last_wins(good, list(OUTSIDE_TOTALS.key))

    def per_key() -> DataFrame:
        missing = dedupe.key_missing(["candidate_id", "support_oppose_indicator"], ["cycle"])
        tagged = raw_df.withColumn("__skip", missing)
        firsts = dedupe.first_wins(tagged, ["__skip", *raw_key], count="__rows")
        flagged = validate(firsts, OUTSIDE_TOTALS, keep=(SEQ, "__skip", "__rows"))
        ok = ~F.col("__skip") & (F.size(ERRORS) == 0)
        return (flagged.groupBy(*OUTSIDE_TOTALS.key)
                .agg(F.sum("__rows").alias("rows"), F.sum(F.when(F.col("__skip"), F.col("__rows")).otherwise(0)).alias("skipped"),
                     F.count_if(~F.col("__skip") & ~ok).alias("invalid"), (F.count_if(ok) > 0).alias("kept")))

    return Transformed(OUTSIDE_TOTALS.name, rows, bad, skipped, per_key, (seen,), good)


TRANSFORMS = {
    "committees": transform_committees,
    "candidates": transform_candidates,
    "inside_totals_by_candidate": transform_inside,
    "schedule_e_totals_by_candidate": transform_outside,
}
