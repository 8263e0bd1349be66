"""Selectors: aggregates that return a value together with its time. All are built-in expressions.

``first`` and ``last`` take the earliest or latest row, whose value may be null. ``min`` and ``max`` ignore nulls, and
among equal values both return the earliest time. NaN is greater than any number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SELECTORS = ("first", "last", "min", "max")


def selector(kind: str, value: Column, time: Column) -> tuple[Column, Column]:
    """(value, time) of a selector, each an aggregate."""
    if kind == "first":
        return F.min_by(value, time), F.min(time)
    if kind == "last":
        return F.max_by(value, time), F.max(time)
    if kind == "min":
        best = F.min(F.when(value.isNotNull(), F.struct(value.alias("v"), time.alias("t"))))
        return best["v"], best["t"]
    if kind == "max":
        best = F.max(F.when(value.isNotNull(), F.struct(value.alias("v"), (-time).alias("t"))))
        return best["v"], -best["t"]
    raise ValueError(f"unknown selector: {kind}")
