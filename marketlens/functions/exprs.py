"""Business expressions shared by the reports (all built-in Column functions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and bounds of the reports.
UNKNOWN_CATEGORY = "Unknown"
ON_TIME, LATE = "On Time", "Late"
SEGMENT_LABELS = ("One-time buyer", "Repeat (2 orders)", "Loyal (3-5 orders)", "Champion (6+ orders)")
SHORT_SEGMENT_LABELS = ("One-time", "Repeat (2x)", "Loyal (3-5x)", "Champion (6x+)")
LOYAL_RANGE = (3, 5)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def category_expr(english: Column | str = "product_category_name_english",
                  raw: Column | str = "product_category_name",
                  default: str = UNKNOWN_CATEGORY) -> Column:
    """English name, else raw name, else a fixed label (two raw names may merge)."""
    return F.coalesce(_col(english), _col(raw), F.lit(default))


def to_ts(c: Column | str) -> Column:
    """Text -> timestamp without zone (what ``::timestamp`` does to text columns)."""
    return _col(c).cast("timestamp_ntz")


def is_after(a: Column | str, b: Column | str) -> Column:
    """``a > b``, three-valued: NULL when either side is NULL."""
    return _col(a) > _col(b)


def is_on_time(delivered: Column | str, estimate: Column | str) -> Column:
    """``delivered <= estimate``, three-valued."""
    return _col(delivered) <= _col(estimate)


def late_flag(delivered: Column | str = "order_delivered_customer_date",
              estimate: Column | str = "order_estimated_delivery_date") -> Column:
    """1 when delivered after the estimate, else 0 (a NULL comparison counts as 0)."""
    return F.when(is_after(delivered, estimate), 1).otherwise(0)


def delivery_result(delivered: Column | str = "order_delivered_customer_date",
                    estimate: Column | str = "order_estimated_delivery_date") -> Column:
    """'On Time' when delivered no later than the estimate, else 'Late' (NULL -> 'Late')."""
    return F.when(is_on_time(delivered, estimate), ON_TIME).otherwise(LATE)


def between(c: Column | str, lo, hi) -> Column:
    """Inclusive range test."""
    return _col(c).between(lo, hi)


def segment_expr(order_count: Column | str, labels: Sequence[str] = SEGMENT_LABELS) -> Column:
    """Loyalty segment of a customer's order count: 1, 2, 3-5, anything else."""
    n = _col(order_count)
    one, two, loyal, champion = labels
    return (F.when(n == 1, one).when(n == 2, two)
            .when(between(n, *LOYAL_RANGE), loyal).otherwise(champion))


def title_case(c: Column | str) -> Column:
    """Python ``str.title()``: a cased letter is upper after a non-cased character, else lower.

    ``initcap`` only splits on spaces, so the string is split into characters
    and each is cased by its predecessor with a higher-order function. A
    character whose title case differs from its upper case (``ß`` -> ``Ss``)
    takes the upper case here.
    """
    chars = F.split(_col(c), "")
    cased = r"[\p{Lu}\p{Ll}\p{Lt}]"
    return F.array_join(
        F.transform(chars, lambda ch, i: F.when((i == 0) | ~F.element_at(chars, i).rlike(cased),
                                                F.upper(ch)).otherwise(F.lower(ch))),
        "")


def display_millions(x: Column | str, prefix: str = "R$ ", places: int = 1) -> Column:
    """``R$ 12.3M`` from a 2-decimal amount, rounded half away from zero in decimal.

    The amount is held at DECIMAL(22,2) so the quotient keeps scale 13 and the
    rounding to ``places`` happens once.
    """
    m = F.round(_col(x).cast("decimal(22,2)") / 1_000_000, places).cast(f"decimal(38,{places})")
    return F.concat(F.lit(prefix), m.cast("string"), F.lit("M"))


def display_int(x: Column | str) -> Column:
    """``99,441`` with thousands separators."""
    return F.format_number(_col(x), 0)


def display_pct(x: Column | str, places: int = 1) -> Column:
    """``10.4%`` from a percentage value."""
    p = F.round(_col(x).cast("decimal(38,6)"), places).cast(f"decimal(38,{places})")
    return F.concat(p.cast("string"), F.lit("%"))
