"""Insert-or-update of keyed rows into a stored table, with change detection.

The stored table is immutable parquet, so a merge produces the *next state* of the
keys plus a change log (``plans.refresh`` stores the changed rows):

* a key only in the incoming batch        -> ``insert`` (created_at = updated_at = run time)
* a key in both, some value distinct      -> ``update`` (all values overwritten, nulls too;
                                               created_at kept, updated_at = run time)
* a key in both, no value distinct        -> ``unchanged`` (row untouched, not counted)
* a key only in the stored table          -> ``keep``

Within one batch a key may arrive several times; they apply in ``_seq`` order, so the
last one is the state, and every write that changes the value counts as one
insert/update in the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow.operators import dedupe
from fundflow.operators.ordered import run_summary
from fundflow.operators.quality import SEQ, EntitySpec

ACTION = "_action"
#: Whether a merged row differs from the stored one in any column (values, version) and must be written.
WRITE = "_write"
ACTION_COUNTS = (("insert", "inserted"), ("update", "updated"), ("unchanged", "unchanged"), ("keep", "kept"))


def distinct_from(a: list[Column], b: list[Column]) -> Column:
    """``a IS DISTINCT FROM b`` for any of the column pairs (null-safe)."""
    out = F.lit(False)
    for x, y in zip(a, b):
        out = out | ~x.eqNullSafe(y)
    return out


@dataclass
class MergeResult:
    """The merged frame: next-version table columns plus ``_action`` per key."""

    frame: DataFrame
    columns: tuple[str, ...]
    key: tuple[str, ...]

    @property
    def table(self) -> DataFrame:
        return self.frame.select(*self.columns)

    @property
    def changes(self) -> DataFrame:
        return self.frame.select(*self.key, ACTION)

    def stats(self, quarantine: DataFrame | None = None) -> DataFrame:
        """inserted / updated / unchanged / kept / errors as one row, in one aggregate."""
        acts = self.frame.select(ACTION)
        if quarantine is not None:
            acts = acts.unionByName(quarantine.select(F.lit("error").alias(ACTION)))
        return acts.agg(*[F.count_if(F.col(ACTION) == a).cast("bigint").alias(n) for a, n in
                          ACTION_COUNTS + (("error", "errors"),)])


def merge(stored: DataFrame, incoming: DataFrame, spec: EntitySpec, run_ts: str,
          version: str | None = None, repeats: bool = True) -> MergeResult:
    """Merge ``incoming`` (spec columns + ``_seq``, duplicates allowed) into ``stored``.

    Without ``repeats`` the caller has made the keys of ``incoming`` unique.

    With ``version`` (a column kept in the stored table, e.g. the arrival ``_seq``),
    an incoming row applies only when it is newer than the stored one, which makes
    replayed or out-of-order micro-batches converge to the same table.
    """
    key = list(spec.key)
    vals = list(spec.value_columns)
    latest = incoming.select(*key, *vals, SEQ)
    if repeats:
        latest = dedupe.last_wins(latest, key)
    vcols = [version] if version else []
    s = stored.select(*key, *[F.col(v).alias(f"s__{v}") for v in vals + vcols],
                      F.col("created_at").alias("s__created_at"),
                      F.col("updated_at").alias("s__updated_at"),
                      F.lit(True).alias("s__present"))
    i = latest.select(*key, *[F.col(v).alias(f"i__{v}") for v in vals],
                      *([F.col(SEQ).alias(f"i__{version}")] if version else []),
                      F.lit(True).alias("i__present"))
    j = s.join(i, key, "full_outer")
    in_s, in_i = F.col("s__present").isNotNull(), F.col("i__present").isNotNull()
    changed = distinct_from([F.col(f"s__{v}") for v in vals], [F.col(f"i__{v}") for v in vals])
    stale = (F.col(f"i__{version}") <= F.col(f"s__{version}")) if version else F.lit(False)
    action = (F.when(~in_s, "insert").when(~in_i, "keep").when(stale, "unchanged")
              .when(changed, "update").otherwise("unchanged"))
    run = F.lit(run_ts).cast("timestamp")
    j = j.withColumn(ACTION, action)
    take_new = F.col(ACTION).isin("insert", "update")
    newer = F.col(ACTION) == "insert"
    if version:  # an unchanged row takes the newer version
        newer = newer | (in_s & in_i & ~stale)
    frame = j.select(
        *key,
        *[F.when(take_new, F.col(f"i__{v}")).otherwise(F.col(f"s__{v}")).alias(v) for v in vals],
        *([F.when(newer, F.col(f"i__{version}")).otherwise(F.col(f"s__{version}")).alias(version)]
          if version else []),
        F.coalesce(F.col("s__created_at"), run).alias("created_at"),
        F.when(take_new, run).otherwise(F.col("s__updated_at")).alias("updated_at"),
        F.col(ACTION), (take_new | newer).alias(WRITE),
    )
    cols = tuple(key + vals + vcols + ["created_at", "updated_at"])
    return MergeResult(frame, cols, tuple(key))


def write_counts(stored: DataFrame, incoming: DataFrame, spec: EntitySpec, version: str | None = None) -> DataFrame:
    """Effective writes when a batch repeats keys: (inserted, updated) as one row.

    Rows of a key apply in ``_seq`` order. The first is an insert when the key is
    not stored, an update when it differs from the stored row; each later row is
    an update when it differs from the row before it. With ``version`` rows that are not
    newer than the stored one don't apply.
    """
    key, vals = list(spec.key), list(spec.value_columns)
    canon = F.to_json(F.struct(*[F.col(v) for v in vals]), {"ignoreNullFields": "false"})
    if version:
        known = stored.select(*key, F.col(version).alias("__version"))
        incoming = (incoming.select(*key, *vals, SEQ).join(known, key, "left")
                    .where(F.col("__version").isNull() | (F.col(SEQ) > F.col("__version"))).drop("__version"))
    runs = run_summary(incoming.select(*key, *vals, SEQ), key, [F.col(SEQ)], canon)
    j = runs.join(stored.select(*key, canon.alias("__stored")), key, "left")
    new = F.col("__stored").isNull()
    return j.agg(F.count_if(new).cast("bigint").alias("inserted"),
                 F.coalesce(F.sum(F.col("changes") + (~new & (F.col("first") != F.col("__stored"))).cast("int")), F.lit(0))
                 .cast("bigint").alias("updated"))
