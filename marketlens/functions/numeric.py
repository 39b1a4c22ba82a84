"""Exact numeric helpers: money, averages, percentages, rounding, day spans.

Rules (all reports follow them):

* Money is DECIMAL; sums are exact and independent of partitioning.
* An average is ``sum / count`` over a wide decimal (scale 18), then rounded
  once, half away from zero, and only then cast to DOUBLE for output.
  ``avg(decimal)`` is not used: its scale-6 result would round twice.
* Day spans are integer microsecond differences; their averages are rounded
  by an exact integer floor (see ``round_ratio``), because a microsecond sum
  over billions of rows needs more digits than DECIMAL(38) leaves for the
  quotient's scale.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MICROS_PER_DAY = 86_400_000_000
WIDE_INT = DecimalType(20, 0)      # integer sums and counts before division
HUGE_INT = DecimalType(38, 0)      # microsecond sums


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str, precision: int = 12, scale: int = 2) -> Column:
    """Exact decimal money value (what ``::numeric`` guarantees)."""
    return _col(c).cast(DecimalType(precision, scale))


def round_out(c: Column | str, places: int) -> Column:
    """Round a DECIMAL half away from zero, then expose it as DOUBLE."""
    return F.round(_col(c), places).cast("double")


def mean_of(total: Column | str, count: Column | str, places: int, scale: int = 10) -> Column:
    """``total / count`` rounded to ``places`` -> DOUBLE; NULL when ``count`` is 0.

    ``total`` is cast to DECIMAL(20+scale, scale) (10 decimals by default, so that
    no money scale in use is cut) and ``count`` to DECIMAL(20,0),
    which gives the quotient scale 18: exact enough that rounding to 1 or 2
    places never rounds twice for groups below 10**16 rows.
    """
    t = _col(total).cast(DecimalType(20 + scale, scale))
    return round_out(t / F.nullif(_col(count).cast(WIDE_INT), F.lit(0)), places)


def avg_exact(x: Column | str, places: int, integral: bool = False) -> Column:
    """Aggregate: mean of ``x`` (NULLs skipped) rounded to ``places`` -> DOUBLE.

    ``x`` is money (DECIMAL), or integral when ``integral=True``.
    """
    x = _col(x)
    return mean_of(F.sum(x), F.count(x), places, scale=0 if integral else 10)


def sum_money(x: Column | str) -> Column:
    """Aggregate: exact decimal sum rounded to cents -> DOUBLE."""
    return round_out(F.sum(_col(x)), 2)


def pct(num: Column | str, den: Column | str, places: int = 2, scale: int = 0) -> Column:
    """``100.0 * num / den`` rounded -> DOUBLE; ``scale`` is the inputs' decimal scale
    (0 for counts, 2 for money)."""
    t = DecimalType(20 + scale, scale)
    return round_out(_col(num).cast(t) * 100 / F.nullif(_col(den).cast(t), F.lit(0)), places)


def round_ratio(num: Column | str, den: Column | str, places: int) -> Column:
    """Exact ``num / den`` of two integral values, rounded half away from zero -> DOUBLE.

    ``round(x) = floor((2 * 10^p * |num| + den) / (2 * den))`` with the sign
    restored. The floor is taken of the DECIMAL quotient and corrected by one
    with an exact multiply-and-compare, so it is exact for every input whose
    terms fit DECIMAL(38,0) (an overflow raises, it never wraps). NULL when
    ``den`` is 0 or NULL.
    """
    scale = 10 ** places
    n = _col(num).cast(HUGE_INT)
    d = F.nullif(_col(den).cast(HUGE_INT), F.lit(0))
    a = F.abs(n) * (2 * scale) + d
    b = d * 2
    q0 = F.floor(a / b)                     # the quotient rounds at scale 6: may be one too high
    q = F.when(q0 * b > a, q0 - 1).otherwise(q0)
    signed = F.when(n < 0, -q).otherwise(q)
    return (signed / F.lit(scale)).cast(DecimalType(38, places)).cast("double")


def micros_between(start: Column | str, end: Column | str) -> Column:
    """``end - start`` in microseconds (BIGINT); NULL if either is NULL."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def days_between(start: Column | str, end: Column | str, places: int = 6) -> Column:
    """Per-row fractional days ``(end - start) / 86400 s`` rounded to ``places`` -> DOUBLE."""
    return round_ratio(micros_between(start, end), F.lit(MICROS_PER_DAY), places)


def sum_micros(us: Column | str) -> Column:
    """Aggregate: exact sum of microsecond spans."""
    return F.sum(_col(us).cast(HUGE_INT))


def avg_days(sum_us: Column | str, count: Column | str, places: int) -> Column:
    """Mean span in days from an exact microsecond sum and a row count -> DOUBLE."""
    return round_ratio(sum_us, _col(count).cast(HUGE_INT) * MICROS_PER_DAY, places)


def share(value: Column | str, places: int = 2, scale: int = 0) -> Column:
    """``100 * value / SUM(value) OVER ()`` rounded -> DOUBLE.

    The window has no partition key: apply it to aggregated rows only.
    """
    from pyspark.sql import Window
    v = _col(value)
    return pct(v, F.sum(v).over(Window.partitionBy()), places, scale)
