"""Window bounds over BIGINT nanoseconds, as expressions.

``window_stop`` labels a window by its end. Widths are nanoseconds or calendar months, never both; a null time gives a
null bound, and times before 1970 are floored like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000


@dataclass(frozen=True)
class Span:
    """A window width or offset: nanoseconds or whole calendar months."""

    ns: int = 0
    months: int = 0

    def __post_init__(self) -> None:
        if self.ns and self.months:
            raise ValueError("a span is either nanoseconds or months")
        if self.months < 0:
            raise ValueError("months must not be negative")


def _as_column(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def int_div(a: Column, b: int) -> Column:
    """Exact integer division for operands whose remainder is known; ``/`` would pass through floating point."""
    return F.call_function("div", a, F.lit(b))


def window_start(time: Column, every: Column | int, offset: Column | int = 0) -> Column:
    """Start of the window of fixed width that holds ``time``."""
    every, shifted = _as_column(every), time - _as_column(offset)
    return time - F.pmod(shifted, every)


def ns_to_micros(time: Column) -> Column:
    """Floor to microseconds without passing through floating point."""
    return int_div(time - F.pmod(time, F.lit(1000)), 1000)


def window_stop(time: Column, every: Span | int, offset: Span | int = 0) -> Column:
    """End of the tumbling window that holds ``time``."""
    every = every if isinstance(every, Span) else Span(ns=every)
    offset = offset if isinstance(offset, Span) else Span(ns=offset)
    if every.months == 0 and every.ns <= 0:
        raise ValueError("the window width must be positive")
    if every.ns:
        if offset.months:
            raise ValueError("an offset in months needs a width in months")
        return window_start(time, every.ns, offset.ns) + F.lit(every.ns)
    return _add(_month_floor(_add(time, offset, -1), every.months, every.months), offset, 1)


def _day_of(time: Column) -> tuple[Column, Column]:
    """The date of ``time`` in UTC, and the ns since its midnight."""
    inside = F.pmod(time, F.lit(DAY_NS))
    days = int_div(time - inside, DAY_NS)
    return F.date_from_unix_date(days.cast("int")), inside


def _to_ns(date: Column) -> Column:
    return F.unix_date(date).cast("bigint") * F.lit(DAY_NS)


def _month_floor(time: Column, months: int, plus: int) -> Column:
    date, _ = _day_of(time)
    total = F.year(date) * 12 + F.month(date) - 1
    total = total - F.pmod(total, F.lit(months)) + plus
    return _to_ns(F.make_date(int_div(total, 12).cast("int"), (F.pmod(total, F.lit(12)) + 1).cast("int"), F.lit(1)))


def _add(time: Column, span: Span, sign: int) -> Column:
    if span.months:
        date, inside = _day_of(time)
        return _to_ns(F.add_months(date, sign * span.months)) + inside
    return time + F.lit(sign * span.ns) if span.ns else time
