"""Rule evaluation: every raw row gets its cleaned columns plus the list of rules it breaks.

Rows are never dropped silently: ``split`` returns the rows that pass and a
quarantine of the rest with their reasons. All rules are Column expressions, so
validation is one projection inside whole-stage codegen (no Python per row).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERRORS = "_errors"
SEQ = "_seq"
#: Names of a landed record's lists that were null, where the source can tell (``sources.paged_json``).
NULLS = "_nulls"


def raw(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """A raw field, or a typed null when the feed does not carry it (absent field)."""
    if name in df.columns:
        return F.col(name)
    return F.lit(None).cast(dtype)


def coerce(c: Column, dtype: str) -> Column:
    """Typed coercion that yields null instead of raising (ANSI mode stays on)."""
    return c.try_cast(dtype)


def whole_number(c: Column) -> Column:
    """An int from a number without a fraction or from its text; anything else is null (and so rejected)."""
    text = c.cast("string")
    value = text.try_cast("decimal(38,10)")
    return F.when((value == F.floor(value)) & text.rlike(r"^\s*[+-]?[0-9]+([.]0*)?([eE][+]?[0-9]+)?\s*$"),
                  value.try_cast("int"))


def raw_int(df: DataFrame, name: str) -> Column:
    """A raw field as a whole number; a field that lands as one only has to fit."""
    c = raw(df, name)
    return c.try_cast("int") if name in df.columns and isinstance(df.schema[name].dataType, T.IntegralType) else whole_number(c)


def coerce_array(c: Column, dtype: str) -> Column:
    return F.transform(c.cast("array<string>"), lambda x: whole_number(x) if dtype == "int" else x.try_cast(dtype))


def bad_coercion(raw_c: Column, typed: Column) -> Column:
    """Raw value present but not convertible."""
    return raw_c.isNotNull() & typed.isNull()


def bad_array(raw_c: Column, typed: Column) -> Column:
    return F.coalesce(
        F.exists(F.arrays_zip(raw_c.cast("array<string>").alias("r"), typed.alias("t")),
                 lambda z: z["r"].isNotNull() & z["t"].isNull()),
        F.lit(False))


def null_list(r, name: str) -> Column:
    """Whether a list was an explicit null: landed records keep those apart from absent ones (``NULLS``)."""
    return F.coalesce(F.array_contains(r(NULLS, "array<string>"), name), F.lit(False))


def blank(c: Column) -> Column:
    return c.isNull() | (F.length(c) == 0)


def too_long(c: Column, n: int) -> Column:
    return F.coalesce(F.length(c) > n, F.lit(False))


def outside(c: Column, domain: list[str]) -> Column:
    return c.isNotNull() & ~c.isin(domain)


@dataclass(frozen=True)
class EntitySpec:
    """What a landed entity looks like once clean, and how it is keyed and merged."""

    name: str
    key: tuple[str, ...]
    columns: tuple[str, ...]
    clean: Callable[[DataFrame], dict[str, Column]]
    # rules(r, cleaned): r(name, dtype) is the raw field (typed null when absent)
    rules: Callable[[Callable[..., Column], dict[str, Column]], list[tuple[str, Column]]]
    parent: str | None = None  # entity whose key the first key column refers to

    @property
    def value_columns(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c not in self.key)


def validate(raw_df: DataFrame, spec: EntitySpec, keep: tuple[str, ...] = (SEQ,),
             observation: Observation | None = None) -> DataFrame:
    """Cleaned table columns + ``_errors`` (array of violated rule names, empty if none).

    Two projections: the cleaned columns are computed once, then the rules refer to
    them by name. (Inlined, an expensive cleaning expression such as the person-name
    rule would be evaluated once for the output and again inside its rule; Catalyst
    keeps the two projections apart because the aliases are reused.)
    """
    cleaned = spec.clean(raw_df)
    kept = [k for k in keep if k in raw_df.columns]
    raw_names = [c for c in raw_df.columns if c not in kept]
    step1 = raw_df.select(*kept, *[F.col(c).alias(f"__raw__{c}") for c in raw_names],
                          *[cleaned[c].alias(c) for c in spec.columns])

    def r(name: str, dtype: str = "string") -> Column:
        return F.col(f"__raw__{name}") if name in raw_names else F.lit(None).cast(dtype)

    checks = spec.rules(r, {c: F.col(c) for c in spec.columns})
    flags = F.array(*[F.when(pred, F.lit(name)) for name, pred in checks]) if checks \
        else F.array().cast("array<string>")
    out = step1.select(*kept, *spec.columns, F.filter(flags, lambda x: x.isNotNull()).alias(ERRORS))
    # An observed-metrics node (public ``observe`` API) between the cleaning and the
    # good/quarantine filters: Catalyst does not push filters through it, so the
    # filters test ``_errors`` instead of re-inlining every cleaning expression. Its
    # counts (rows, invalid) arrive with whatever action runs the plan.
    return count_invalid(out, observation or f"validate_{spec.name}_{uuid.uuid4().hex[:12]}")


def count_invalid(df: DataFrame, observation) -> DataFrame:
    """Observe (rows, invalid) of a frame carrying ``_errors``; no extra pass."""
    return df.observe(observation, F.count(F.lit(1)).alias("rows"),
                      F.count_if(F.size(F.col(ERRORS)) > 0).alias("invalid"))


def observed(metrics: Observation, name: str) -> int:
    """A count that an action has observed. A plan whose input turned out to be empty is cut down by Spark to
    an empty relation and delivers no metrics at all: nothing was counted."""
    try:
        return int(metrics.get[name])
    except Py4JJavaError as e:
        if "AssertionError" not in str(e.java_exception):
            raise
        return 0


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.size(F.col(ERRORS)) == 0
    return validated.filter(ok).drop(ERRORS), validated.filter(~ok)


def quarantine_report(quarantine: DataFrame) -> DataFrame:
    """Rows per violated rule (one quarantined row may break several rules)."""
    return (quarantine.select(F.explode(ERRORS).alias("rule"))
            .groupBy("rule").agg(F.count("*").cast("bigint").alias("rows")))


def fk_split(df: DataFrame, parent: DataFrame, key: str = "candidate_id",
             parent_key: str = "candidate_id") -> tuple[DataFrame, DataFrame]:
    """Foreign-key check: (rows whose parent exists, rows whose parent is unknown).

    Semi/anti joins never duplicate child rows. The parent side is reduced to its
    distinct keys first; Spark/AQE picks broadcast only if it measures it small.
    """
    keys = parent.select(F.col(parent_key).alias("__fk")).distinct()
    cond = F.col(key) == F.col("__fk")
    return df.join(keys, cond, "left_semi"), df.join(keys, cond, "left_anti")
