"""Rounding, number recognition and seeded ordering keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text shapes accepted as numbers.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"


def half_up(x: Column, digits: int) -> Column:
    """Round half up on the scaled double.

    ``round`` works on the shortest decimal text of a double and differs from
    other engines at ties; this form gives the same value everywhere. The small
    lift keeps values that are a tie but for summation order on one side.
    """
    scale = 10.0 ** digits
    return F.floor(x * F.lit(scale) + F.lit(0.5 + 1e-6)).cast("double") / F.lit(scale)


def r3(x: Column) -> Column:
    return half_up(x, 3)


def r4(x: Column) -> Column:
    return half_up(x, 4)


def r6(x: Column) -> Column:
    return half_up(x, 6)


def share(cond: Column) -> Column:
    """Aggregate: share of rows for which ``cond`` holds; NULL counts as not."""
    return F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))


def pearson(a: str, b: str) -> Column:
    """Aggregate: Pearson correlation of two columns, NULL without spread (``corr`` divides by zero there).

    Rows without one of the two don't count.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    spread = (F.stddev_pop(x) > 1e-9) & (F.stddev_pop(y) > 1e-9)
    return F.when(spread, F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y)))


def to_number(text: Column) -> Column:
    """Text to double, NULL when the text is not a plain number."""
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def to_integer(text: Column) -> Column:
    """Text to integer, NULL when the text is not a whole number."""
    return F.when(text.rlike(INTEGER_PATTERN), F.trim(text).try_cast("bigint"))


def code_text(number: Column) -> Column:
    """Answer code as text: whole numbers without a fraction part."""
    return F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(
        number.cast("string"))


def seeded_key(*parts) -> Column:
    """Ordering key for shuffles and draws: md5 over the parts, '|' between."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))
