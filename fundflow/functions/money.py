"""Money arithmetic and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"
OUTSIDE_MONEY = "decimal(14,2)"
#: Sums over any number of rows, and ratios of them, keep the widest decimal: totals grow with the data.
WIDE_MONEY = "decimal(38,2)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_if_null(c) -> Column:
    return F.coalesce(_col(c), F.lit(0))


def nullif_zero(c) -> Column:
    x = _col(c)
    return F.when(x != 0, x)


def ratio(numerator, denominator, scale: int = 2) -> Column:
    """``ROUND(n / NULLIF(d, 0), 2)`` on decimals: half away from zero, null at d = 0.

    The denominator is guarded before dividing, so ANSI mode never raises. Both sides are
    brought to 24 digits before the point, which leaves the quotient six exact places.
    """
    n, d = _col(numerator).cast("decimal(26,2)"), nullif_zero(denominator).cast("decimal(26,2)")
    return F.round(n / d, scale).cast(WIDE_MONEY)


def round_binary(c) -> Column:
    """A double rounded to cents by its exact binary value, exact ties to the even cent.

    2.675 is stored as a little less than that and becomes 2.67; 0.125 is a tie and becomes 0.12. The part after
    the point is taken apart exactly; its product with 200 is computed with the error that rounding made
    (the factor has 8 bits, so the two halves of a split factor multiply without error). Comparing product
    and error with the odd number between two cents decides. From 2**52 on doubles have no cents.
    """
    x = _col(c).cast("double")
    size = F.abs(x)
    small = F.when(size < 2.0 ** 52, size).otherwise(0.0)
    whole = F.floor(small)
    part = small - whole.cast("double")
    product = part * 200.0
    high = part * 134217729.0 - (part * 134217729.0 - part)  # the leading 26 bits
    error = (high * 200.0 - product) + (part - high) * 200.0
    cents = F.floor(product / 2.0)
    middle = (cents * 2 + 1).cast("double")
    up = (product > middle) | ((product == middle) & ((error > 0.0) | ((error == 0.0) & (cents % 2 == 1))))
    exact = (whole.cast("decimal(20,0)") * 100 + cents + up.cast("int")).cast("decimal(24,0)")
    rounded = (exact / F.lit(100).cast("decimal(3,0)")).cast("decimal(24,2)").cast("double")
    return F.when((size >= 2.0 ** 52) | F.isnan(x), x).when(x < 0, -rounded).when(x.isNotNull(), rounded)


def response_ratio(numerator, denominator) -> Column:
    """The ratio as a response computes it: doubles, null without a denominator, ``round_binary``."""
    d = _col(denominator).cast("double")
    return round_binary(_col(numerator).cast("double") / F.when(d != 0, d))


def compact_dollars(c) -> Column:
    """``$1.2B`` / ``$3.4M`` / ``$12K`` / ``$950``: one decimal for B and M, whole K and units.

    Computed on exact decimals, rounding half up (the display rule for the
    non-negative amounts it is used on).
    """
    v = _col(c).cast("decimal(27,2)")  # leaves the scaled value 13 exact places

    def scaled(unit: int, places: int) -> Column:
        return F.round(v / F.lit(unit).cast("decimal(10,0)"), places).cast("string")

    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(v >= 10**9, F.concat(F.lit("$"), scaled(10**9, 1), F.lit("B")))
            .when(v >= 10**6, F.concat(F.lit("$"), scaled(10**6, 1), F.lit("M")))
            .when(v >= 10**3, F.concat(F.lit("$"), scaled(10**3, 0), F.lit("K")))
            .otherwise(F.concat(F.lit("$"), F.round(v, 0).cast("decimal(38,0)").cast("string"))))


def full_dollars(c) -> Column:
    """``$1,234,568`` (no cents, half away from zero); negative as ``-$5``; null as ``N/A``."""
    v = _col(c).cast("decimal(38,2)")
    whole = F.round(F.abs(v), 0)
    body = F.concat(F.lit("$"), F.format_number(whole, 0))
    return (F.when(v.isNull(), F.lit("N/A"))
            .when(F.round(v, 0) < 0, F.concat(F.lit("-"), body))
            .otherwise(body))
