"""Partition keys from templates, and the assignment of tables to shards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import ns_to_micros

# Strftime directives and their patterns in Spark.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%y": "yy", "%b": "MMM", "%B": "MMMM"}


@dataclass(frozen=True)
class TablePart:
    """The table's name."""


@dataclass(frozen=True)
class ColumnPart:
    """``<column>_<value>``, or an empty part where the column is absent or null."""

    name: str


@dataclass(frozen=True)
class TimePart:
    """The time in UTC by a strftime format."""

    format: str


def strftime_pattern(text: str) -> str:
    out, i, plain = "", 0, ""

    def close(plain: str) -> str:
        return "'" + plain.replace("'", "''") + "'" if any(c.isalpha() for c in plain) else plain.replace("'", "''")

    while i < len(text):
        if text[i] == "%":
            directive = text[i : i + 2]
            if directive not in STRFTIME:
                raise ValueError(f"strftime directive not supported: {directive}")
            out += close(plain) + STRFTIME[directive]
            plain, i = "", i + 2
        else:
            plain, i = plain + text[i], i + 1
    return out + close(plain)


def partition_key(parts: list, table: str, columns: list[str], time: Column) -> Column:
    """The template's parts joined with ``-``; the session's time zone must be UTC."""
    made = []
    for part in parts:
        match part:
            case TablePart():
                made.append(F.lit(table))
            case ColumnPart(name):
                value = F.col(f"`{name}`").cast("string") if name in columns else F.lit(None).cast("string")
                made.append(F.coalesce(F.concat(F.lit(f"{name}_"), value), F.lit("")))
            case TimePart(text):
                made.append(F.date_format(F.timestamp_micros(ns_to_micros(time)), strftime_pattern(text)))
            case _:
                raise ValueError(f"template part not supported: {part}")
    return F.concat_ws("-", *made)


def shard(table: Column, keys: list[Column], patterns: list[tuple[str, int]], shards: int | None) -> Column:
    """The first pattern that matches the table's name gives the shard, else a hash of table and keys; else an error.

    The hash is the first 60 bits of an MD5 over the texts, so that writers outside Spark find the same shard. A null key
    counts as absent."""
    joined = F.concat_ws("\u0001", table, *[k.cast("string") for k in keys])
    fallback = F.pmod(F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint"), F.lit(shards)).cast("int") if shards else F.raise_error(F.lit("no shard for this table")).cast("int")
    chosen = fallback
    for pattern, number in reversed(patterns):
        chosen = F.when(table.rlike(pattern), F.lit(number)).otherwise(chosen)
    return chosen


def routed(df: DataFrame, table: str, parts: list, keys: list[str], patterns: list[tuple[str, int]], shards: int | None, time: str = "time") -> DataFrame:
    """Rows of a table with ``shard`` and ``partition_key``, laid out so that each (shard, partition) is written together.
    Rebalancing splits a partition that has most of the rows, and joins small ones."""
    number = shard(F.lit(table), [F.col(f"`{k}`") for k in keys], patterns, shards)
    placed = df.withColumn("shard", number).withColumn("partition_key", partition_key(parts, table, df.columns, F.col(time)))
    return placed.hint("rebalance", "shard", "partition_key")
