"""Order-dependent de-duplication, written as aggregates rather than windows.

``max_by`` / ``min_by`` over a struct are ordinary aggregates, so Spark runs them
partial (map side) then final: a key holding a third of all rows is reduced to one
row per map task before the shuffle, instead of landing whole in one window task.

Where every carried column has a fixed width (numbers, dates, decimals) each is picked by itself: the
aggregation buffer is then fixed as well, which is what Spark's hash aggregate needs. A row with texts or
arrays is picked as one struct, in sorted runs. Arrival numbers (``_seq``) never tie within a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQ = "_seq"


#: Types of fixed width in Spark's row format.
FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _pick(df: DataFrame, key: list[str], by_first: bool, seq: str, count: str | None = None) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    chosen = F.min_by if by_first else F.max_by
    counted = [F.count(F.lit(1)).alias(count)] if count else []
    if all(isinstance(df.schema[c].dataType, FIXED) for c in rest):
        own = {c: (F.min if by_first else F.max)(c) if c == seq else chosen(c, seq) for c in rest}
        return df.groupBy(*key).agg(*[own[c].alias(c) for c in rest], *counted)
    row = chosen(F.struct(*[F.col(c) for c in rest]), F.col(seq))
    return (df.groupBy(*key).agg(row.alias("__row"), *counted)
            .select(*key, *[F.col("__row")[c].alias(c) for c in rest], *[count] * bool(count)))


def last_wins(df: DataFrame, key: list[str], seq: str = SEQ) -> DataFrame:
    """One row per key: the one that arrived last (largest ``_seq``)."""
    return _pick(df, key, by_first=False, seq=seq)


def first_wins(df: DataFrame, key: list[str], seq: str = SEQ, count: str | None = None) -> DataFrame:
    """One row per key: the one that arrived first (smallest ``_seq``); ``count`` names a column for the key's rows."""
    return _pick(df, key, by_first=True, seq=seq, count=count)


def falsy(c: Column, kind: str) -> Column:
    """Python truthiness of a raw value: null, empty text or numeric zero. What isn't a number is for the rules to reject."""
    empty = c.isNull() | (c.cast("string") == "")
    return empty if kind == "text" else empty | F.coalesce(c.try_cast("double") == 0, F.lit(False))


def key_missing(text_keys: list[str], number_keys: list[str]) -> Column:
    """Whether some key field of a row is falsy."""
    bad = F.lit(False)
    for k in text_keys:
        bad = bad | falsy(F.col(k), "text")
    for k in number_keys:
        bad = bad | falsy(F.col(k), "number")
    return F.coalesce(bad, F.lit(True))


def key_present(df: DataFrame, text_keys: list[str], number_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key fields are all truthy, skipped rows).

    One filter a field, each never null, so Spark can put each below a join on the side that has the field.
    """
    kept = df
    for k, kind in [*((k, "text") for k in text_keys), *((k, "number") for k in number_keys)]:
        kept = kept.filter(~F.coalesce(falsy(F.col(k), kind), F.lit(True)))
    return kept, df.filter(key_missing(text_keys, number_keys))
